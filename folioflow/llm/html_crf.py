"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi.

A leaf block is the text between two block-level tags; its features are its
ancestors' tags, the words of their class, id and role, and its own text's
shape (length, links, punctuation).  The chain's two states are main
text and the rest.  The model is trained on labelled pages from
:func:`labelled_pages`, which lays out random articles with the furniture of
common sites (menus, banners, notices, adverts, forms, sidebars, related
links, reader comments, footers) in many markups, or without any; invented
words and characters keep it free of any language.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*?)(?:>|\Z)",
    re.S,
)
#: Elements whose content is not text of the page.
_RAW = {"script", "style", "template", "svg", "iframe", "head", "title", "textarea", "select", "math"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    "noscript", "object", "canvas", "audio", "video",  # what stands in for them is a block that the model judges
}
#: An opening tag ends an open element of these kinds, looked for up to the given container.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An open element; what its path says is carried down, so that a block at any depth costs the same."""

    __slots__ = ("tag", "words", "main", "last", "said", "parent", "features")

    def __init__(self, tag: str, words: tuple[str, ...], main: bool, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.main = main or (parent is not None and parent.main)
        self.last = tag if tag != "div" or parent is None else parent.last  # the nearest element that is no div
        said = parent.said if parent is not None else ()
        fresh = [f for f in (*(() if tag in ("html", "body", "div") else (f"t:{tag}",)), *(f"c:{w}" for w in words)) if f not in said]
        self.said = (*said, *fresh) if fresh else said
        self.features: tuple[str, ...] | None = None


class Block:
    __slots__ = ("text", "path", "linked", "main")

    def __init__(self, text: str, path: Node | None, linked: int, main: bool):
        self.text, self.path, self.linked, self.main = text, path, linked, main

    @property
    def last(self) -> str:
        return self.path.last if self.path is not None and self.path.last != "div" else "body"


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; ``path`` is the innermost open element.  Of classes only the words in ``known`` are kept, if given."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, link, at, n = 0, False, 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                inner = stack[-1] if stack else None
                out.append(Block(text, inner, min(linked, len(text)), inner is not None and inner.main))
            parts.clear()
        linked = 0

    def pop(to: int):
        for node in stack[to:]:
            opened[node.tag] -= 1
        del stack[to:]

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) if link else 0
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW and tag != "math" and not m["close"]:
            if m["attrs"].endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(page, at)
            at = close.end() if close else (n if tag in ("script", "style", "textarea", "title") else at)
            if tag != "svg":
                parts.append(" ")
            continue
        if tag == "a":
            link = not m["close"]
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        flush()
        if tag in _VOID:
            continue
        if m["close"]:
            link = False
            if opened.get(tag):
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag not in ("button", "label", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":  # a paragraph holds no block
                    pop(i)
                    break
                if stack[i].tag not in ("button", "label"):
                    break
        if tag in _ENDS:
            kinds, within = _ENDS[tag]
            for i in range(len(stack) - 1, -1, -1) if any(map(opened.get, kinds)) else ():
                if stack[i].tag in within:
                    break
                if stack[i].tag in kinds:
                    pop(i)
                    break
        words, main = (), "data-main" in m["attrs"]
        if "=" in m["attrs"]:
            got = {a.lower(): x or y or z for a, x, y, z in _ATTR.findall(m["attrs"])}
            words = tuple(w for w in dict.fromkeys(w.lower() for k in ("class", "id", "role") if k in got for w in _WORDS.findall(got[k])) if known is None or w in known)
        stack.append(Node(tag, words, main, stack[-1] if stack else None))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def _path_features(path: Node | None) -> tuple[str, ...]:
    if path is None:
        return ("last:body",)
    if path.features is not None:
        return path.features
    own = dict.fromkeys(f"own:{w}" for node in (path.parent, path) if node is not None for w in node.words)
    path.features = (*path.said, f"last:{path.last if path.last != 'div' else 'body'}", *own)
    return path.features


def _shape(b: Block) -> tuple[str, ...]:
    """Features of a block's own text; few enough that their sums can be kept."""
    text, n = b.text, len(b.text)
    words = max(text.count(" ") + 1, n // 12)  # scripts without blanks have words too
    share = b.linked / n
    return (
        f"w{min(6, words.bit_length() - 1)}", f"link{0 if share < 0.1 else 1 if share < 0.6 else 2}", b.last, "stop" if text[-1] in ".!?…。！？:;\"'»”" else "",
        "marks" if "©" in text or "·" in text or "|" in text else "", "inner" if words > 3 and any(x in text for x in (". ", ", ", "。", "，")) else "",
    )


def _named(shape: tuple[str, ...]) -> list[str]:
    kind, link, last, *more = shape
    return ["bias", kind, link, f"{last}&{kind}", *(m for m in more if m)]


def features(b: Block) -> list[str]:
    return [*_named(_shape(b)), *_path_features(b.path)]


class ChainCRF:
    """Two states (0 the rest, 1 main text), sparse indicator features, Adam on the log likelihood."""

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 10, rate: float = 0.05, ridge: float = 1e-4, seed: int = 3) -> ChainCRF:
        index = {f: k for k, f in enumerate(dict.fromkeys(f for fs, _ in pages for own in fs for f in own))}
        data = [([np.array([index[f] for f in own]) for own in fs], np.array(ys)) for fs, ys in pages if fs]
        W, T = np.zeros((len(index), 2)), np.zeros((2, 2))
        moments = [(np.zeros_like(P), np.zeros_like(P)) for P in (W, T)]
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 16)):
                gW, gT = ridge * len(part) * W, ridge * len(part) * T
                for k in part:
                    ids, ys = data[k]
                    u = np.stack([W[i].sum(0) for i in ids])
                    node, edge = _marginals(u, T)
                    node[np.arange(len(ys)), ys] -= 1
                    for i, g in zip(ids, node):
                        gW[i] += g
                    np.add.at(edge, (ys[:-1], ys[1:]), -1)
                    gT += edge
                step += 1
                for P, G, (m, v) in zip((W, T), (gW / len(part), gT / len(part)), moments):
                    m[:] = 0.9 * m + 0.1 * G
                    v[:] = 0.99 * v + 0.01 * G**2
                    P -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        # with two states only differences matter
        self.weight = {f: float(W[k, 1] - W[k, 0]) for f, k in index.items()}
        self.known = frozenset(f.split(":", 1)[1] for f in index if f.startswith(("c:", "own:")))  # words of classes that weigh anything
        self.move = [[float(T[0, 0]), float(T[0, 1])], [float(T[1, 0]), float(T[1, 1])]]
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_sum"}

    def weigh(self, own: list[Block]) -> list[float]:
        """What each block's features add up to: sums over a shape and over a path are taken once and kept."""
        if "_sum" not in self.__dict__:
            weight = self.weight.get
            total = lambda names: sum([weight(f, 0.0) for f in names])
            self._sum = functools.lru_cache(4096)(lambda shape: total(_named(shape))), functools.lru_cache(65536)(total)
        shape, path = self._sum
        return [shape(_shape(b)) + path(_path_features(b.path)) for b in own]

    def decode(self, fs: list[list[str]]) -> list[int]:
        """The most likely states of feature lists."""
        return self.best([sum(self.weight.get(f, 0.0) for f in own) for own in fs])

    def best(self, weights: list[float]) -> list[int]:
        """The most likely states (Viterbi)."""
        a, b = self.move
        s0, s1, back = 0.0, 0.0, []
        for i, u in enumerate(weights):
            if i:
                from0, from1 = s0 + a[0] >= s1 + b[0], s0 + a[1] > s1 + b[1]
                back.append((0 if from0 else 1, 0 if from1 else 1))
                s0, s1 = max(s0 + a[0], s1 + b[0]), max(s0 + a[1], s1 + b[1]) + u
            else:
                s1 = u
        state = int(s1 > s0)
        out = [state] if weights else []
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


def _marginals(u: np.ndarray, T: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(u)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = u[0]
    for i in range(1, n):
        f[i] = u[i] + np.logaddexp(f[i - 1, 0] + T[0], f[i - 1, 1] + T[1])
    for i in range(n - 2, -1, -1):
        x = T + u[i + 1] + b[i + 1]
        b[i] = np.logaddexp(x[:, 0], x[:, 1])
    z = np.logaddexp(*f[-1])
    edge = np.exp(f[:-1, :, None] + T + (u[1:] + b[1:])[:, None, :] - z).sum(0) if n > 1 else np.zeros((2, 2))
    return np.exp(f + b - z), edge


# --- labelled pages -------------------------------------------------------------


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages of random layout; elements of the main text carry ``data-main``."""
    r = random.Random(seed)
    return [_Page(r).html for _ in range(n)]


class _Page:
    def __init__(self, r: random.Random):
        self.r = r
        self.wide = r.random() < 0.12
        self.syllables = [r.choice("bcdfglmnprstvz") + r.choice(["a", "e", "i", "o", "u", "é", "ö", "ei", "ou"]) + r.choice(["", "n", "r", "s"]) for _ in range(40)]
        if r.random() < 0.3:
            self.html = self.plain()
            return
        top = [self.menu() if r.random() < 0.8 else "", self.header() if r.random() < 0.6 else ""]
        r.shuffle(top)
        pre = [x() for x in r.sample([self.notice, self.advert, self.crumbs, self.form, self.sidebar], r.randint(0, 3))]
        post = [x() for x in r.sample([self.related, self.comments, self.share, self.advert, self.form, self.sidebar, self.notice, self.author], r.randint(0, 4))]
        after = [self.footer() if r.random() < 0.85 else ""]
        article = self.article(post if r.random() < 0.35 else [])
        if "<article" in article or r.random() < 0.8:
            middle = "".join(pre) + article + "".join(post if "comments" not in article else [])
        else:
            middle = article
        if r.random() < 0.4:
            middle = f'<div class="{r.choice(["wrapper", "container", "page", "row", "site", "layout"])}">{middle}</div>'
        head = f"<head><title>{self.sentence()}</title><style>p{{}}</style></head>"
        self.html = f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{middle}{''.join(after)}" + ("</body></html>" if r.random() < 0.9 else "")

    def plain(self) -> str:
        """A page of few blocks, or of elements that say nothing, with or without furniture."""
        r = self.r
        text = lambda tag: f"<{tag} data-main>{self.prose(1, 8)}</{tag}>"
        parts = "".join(text(r.choice(["p", "p", "div"])) for _ in range(r.choice([1, 1, 1, 2, 3, 6])))
        named = lambda tag, inner: f"<{tag}{r.choice(['', '', f' id={self.word()}', f' class={self.word()}'])}>{inner}</{tag}>"
        body = r.choice([
            lambda: named("article", parts), lambda: named("main", parts), lambda: parts, lambda: named("div", parts), lambda: named("div", named("div", parts)), lambda: named("section", named("div", parts)),
            lambda: f"<div data-main>{self.prose(1, 20)}</div>", lambda: f"<article data-main>{self.prose(1, 20)}</article>", lambda: text("pre"), lambda: f"<table><tr>{text('td')}</tr></table>",
            lambda: named("ul", "".join(f"<li data-main>{self.prose(1, 2)}</li>" for _ in range(r.randint(1, 6)))), lambda: f"<h1 data-main>{self.words(2, 8)}</h1>{parts}",
        ])()
        if r.random() < 0.15:
            return f"<html><body data-main>{self.prose(1, 6)}</body></html>"
        before = "".join(x() for x in (self.menu, self.header, self.notice) if r.random() < 0.25)
        after = "".join(x() for x in (self.footer, self.sidebar, self.comments, self.form) if r.random() < 0.2)
        return r.choice(["<!DOCTYPE html><html><head><title>x</title></head><body>{}</body></html>", "<html><body>{}</body></html>", "{}"]).format(before + body + after)

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        if self.wide:
            part = lambda: "".join(chr(self.r.randint(0x4E00, 0x9FA0)) for _ in range(self.r.randint(2, 12)))
            return "，".join(part() for _ in range(self.r.randint(1, 3))) + self.r.choice("。。！？")
        s = self.words(1, 18)
        if self.r.random() < 0.4:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + self.r.choice("...!?")

    def prose(self, lo: int = 1, hi: int = 6) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))
        if self.r.random() < 0.2:
            w = s.split(" ")
            w[len(w) // 2] = f'<a href="/x">{w[len(w) // 2]}</a>'
            s = " ".join(w)
        if self.r.random() < 0.25:  # the main text is not always clean
            s = self.r.choice([s.replace(" ", "%%% "), s.replace(" ", " &amp; "), s.replace(" ", "### "), s.replace(" ", " | ") + " |", s.upper(), s.replace(" ", "!! ") + "!!", (self.word() + " ") * 12, s + " © " + self.word(), s.rstrip(".!?")])
        return s

    def pick(self, *names: str) -> str:
        name = self.r.choice(names)
        return self.r.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {self.word()}"', f'class="{self.word()} {name}-{self.r.choice(["box", "area", "wrap", "inner"])}"'])

    def links(self, lo: int = 2, hi: int = 9) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(lo, hi)))

    def menu(self) -> str:
        return self.r.choice(["<nav>{}</nav>", "<nav " + self.pick("menu", "nav", "navbar") + ">{}</nav>", "<div " + self.pick("menu", "nav", "navigation", "topbar") + ">{}</div>", "<header><nav>{}</nav></header>"]).format(self.r.choice(["<ul>{}</ul>", "{}", "<ol>{}</ol>"]).format(self.links()))

    def header(self) -> str:
        inner = f"<{self.r.choice(['h1', 'p', 'div'])}>{self.words(1, 5).title()}" + f"<p>{self.words(2, 8)}</p>" * self.r.randint(0, 1)
        return self.r.choice(["<header>{}</header>", "<header " + self.pick("header", "masthead", "site-header") + ">{}</header>", "<div " + self.pick("header", "masthead", "branding", "banner") + ">{}</div>"]).format(inner)

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.com &middot; {self.prose(1, 2)}", f"<p>© 20{self.r.randint(10, 24)} {self.words(1, 4)}</p><ul>{self.links(1, 4)}</ul>", self.prose(1, 2), f"<ul>{self.links(1, 5)}</ul><p>{self.sentence()}</p>"])
        return self.r.choice(["<footer>{}</footer>", "<footer " + self.pick("footer", "colophon") + ">{}</footer>", "<div " + self.pick("footer", "bottom", "copyright") + ">{}</div>"]).format(inner)

    def advert(self) -> str:
        return f"<{(t := self.r.choice(['div', 'aside', 'section', 'div']))} {self.pick('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{self.r.choice(['{}', '<p>{}</p>', '<a href=/x>{}</a>', '<h3>' + self.words(1, 4) + '</h3><p>{}</p>']).format(self.prose(1, 3))}</{t}>"

    def notice(self) -> str:
        if self.r.random() < 0.15:
            return f"<{(t := self.r.choice(['noscript', 'video', 'object', 'audio', 'canvas']))}>{self.r.choice(['{}', '<p>{}</p>']).format(self.prose(1, 2))}</{t}>"
        return f"<{(t := self.r.choice(['div', 'section', 'dialog']))} {self.pick('cookie', 'consent', 'notice', 'alert', 'gdpr', 'message', 'modal', 'popup', 'paywall')}>{self.r.choice(['{}', '<p>{}</p>']).format(self.prose(1, 3))}{self.r.choice(['', '<button>' + self.words(1, 2) + '</button>'])}</{t}>"

    def form(self) -> str:
        return f"<form {self.pick('newsletter', 'subscribe', 'search', 'login', 'signup', 'contact')}><{(t := self.r.choice(['p', 'label', 'div', 'h3']))}>{self.r.choice([self.words(1, 6), self.sentence()])}</{t}><input type=text><button>{self.words(1, 2)}</button></form>"

    def crumbs(self) -> str:
        return f"<{(t := self.r.choice(['div', 'ol', 'ul']))} {self.pick('breadcrumb', 'breadcrumbs', 'crumbs')}>{self.links(2, 4)}</{t}>"

    def sidebar(self) -> str:
        inner = "".join(self.r.choice([f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose(1, 3)}</p>", f"<ul>{self.links()}</ul>"]) for _ in range(self.r.randint(1, 4)))
        return self.r.choice(["<aside>{}</aside>", "<aside " + self.pick("sidebar", "widget") + ">{}</aside>", "<div " + self.pick("sidebar", "widget", "rail", "secondary") + ">{}</div>"]).format(inner)

    def related(self) -> str:
        return f"<{(t := self.r.choice(['div', 'section', 'aside']))} {self.pick('related', 'recommended', 'more', 'trending', 'popular')}><h3>{self.words(1, 4)}</h3>{self.r.choice(['<ul>' + self.links() + '</ul>', '<p>' + self.prose(1, 2) + '</p>'])}</{t}>"

    def share(self) -> str:
        return f"<div {self.pick('share', 'social', 'sharing', 'tags', 'meta')}>{self.r.choice(['<ul>' + self.links(2, 5) + '</ul>', self.words(1, 6)])}</div>"

    def author(self) -> str:
        return f"<div {self.pick('author', 'byline', 'bio')}><p>{self.prose(1, 2)}</p></div>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.r.choice(['div', 'li', 'article', 'section']))} {self.pick('comment', 'reply', 'response')}><p>{self.words(1, 3)}</p><p>{self.prose(1, 5)}</p></{t}>"
        return f"<{(t := self.r.choice(['div', 'section', 'ol']))} {self.pick('comments', 'discussion', 'responses', 'disqus', 'replies')}><h3>{self.words(1, 4)}</h3>{''.join(one() for _ in range(self.r.randint(1, 5)))}</{t}>"

    def article(self, inside: list[str]) -> str:
        parts = [f"<{(h := self.r.choice(['h1', 'h1', 'h2']))} data-main>{self.r.choice([self.sentence(), self.words(2, 9)])}</{h}>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            kind = self.r.random()
            if kind < 0.62:
                parts.append(f"<p data-main>{self.prose()}</p>" if self.r.random() < 0.8 else f"<p data-main>{self.prose()}")
            elif kind < 0.74:
                parts.append(f"<p data-main><b>{self.sentence()}<br><p data-main>{self.prose()}</p>")
            elif kind < 0.82:
                parts.append(f"<{(h := self.r.choice(['h2', 'h3', 'h4']))} data-main>{self.words(1, 7)}</{h}>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li data-main>{self.r.choice([self.words(1, 6), self.prose(1, 2)])}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote data-main>{self.r.choice(['{}', '<p>{}</p>']).format(self.prose(1, 3))}</blockquote>")
            elif kind < 0.96:
                parts.append(f"<pre data-main>{self.words(2, 12)}</pre>")
            else:
                parts.append("<table>" + "".join(f"<tr><td data-main>{self.words(1, 3)}</td><td data-main>{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 3))) + "</table>")
        for x in inside + ([self.r.choice([self.advert, self.share, self.related, self.notice])()] if self.r.random() < 0.2 else []):
            parts.insert(self.r.randint(min(1, len(parts)), len(parts)), x)
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.r.choice(['', ' ' + self.pick('post', 'article', 'entry', 'story')])}>{''.join(parts)}</article>"
        if kind < 0.68:
            return f"<main>{self.r.choice(['{}', '<article>{}</article>', '<section>{}</section>']).format(''.join(parts))}</main>"
        if kind < 0.93:
            return f"<div {self.pick('content', 'post', 'article', 'entry', 'main', 'story', 'text', 'body')}>{''.join(parts)}</div>"
        return "".join(parts)


@functools.lru_cache(1)
def trained(pages: int = 1000, seed: int = 11) -> ChainCRF:
    data = []
    for page in labelled_pages(pages, seed):
        own = blocks(page)
        data.append(([features(b) for b in own], [int(b.main) for b in own]))
    return ChainCRF().fit(data)


def main_text(page: str, model: ChainCRF) -> str:
    own = blocks(page, model.known)
    states = model.best(model.weigh(own))
    return "\n\n".join(b.text for b, s in zip(own, states) if s)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, without a shuffle.

    Null or empty html gives the empty text; null ids and urls stay null;
    repeated rows are extracted each; other columns are ignored; an empty
    table gives an empty result.  A page cut off inside a tag ends there.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x or "", shared.value) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
