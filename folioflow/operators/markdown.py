"""Markdown to flat blocks, per document: a block scanner applied by mapInPandas."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.config import MAX_CELLS, MAX_NESTING

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*|(?<=~).*)$")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))( +|\t|$)(.*)$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:(script|pre|style|textarea)(?:[\s>]|$)|(!--)|(\?)|(![A-Za-z])|(!\[CDATA\[)|(/?(?:address|article|aside|base|blockquote|body|caption|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))|(/?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>\s*$))", re.I)
_HTML_END = (r"</(script|pre|style|textarea)>", "-->", r"\?>", ">", r"\]\]>")
_INLINE = re.compile(
    r"(?P<esc>\\[!-/:-@\[-`{-~])|(?P<code>(?<!`)(`+)(?!`)(?P<inner>.+?)(?<!`)\3(?!`))|(?P<image>!\[(?P<alt>(?:[^\[\]\\]|\\.|\[[^\]]*\])*)\](?:\([^()\s]*(?:\([^()]*\))?[^()]*\)|\[[^\]]*\]))"
    r"|(?P<link>\[(?P<label>(?:[^\[\]\\]|\\.|!?\[[^\]]*\](?:\([^)]*\))?)*)\]\([^()\s]*(?:\([^()]*\))?[^()]*\))|(?P<auto><(?P<uri>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w.-]+)>)|(?P<html></?[A-Za-z][^<>]*>|<!--.*?-->)"
    r"|(?P<hard> {2,}\n|\\\n)|(?P<soft> ?\n[ \t]*)|(?P<marks>\*+|(?<!\w)_+|_+(?!\w))|(?P<ref>&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);)",
    re.S,
)


class TooDeep(Exception):
    """Nesting beyond the limit: content would be lost."""


def inline_text(text: str) -> str:
    """Inline marks removed: links and images as their text, breaks as line feeds."""

    def plain(m: re.Match) -> str:
        if m["esc"]:
            return m["esc"][1]
        if m["code"]:
            inner = m["inner"].replace("\n", " ")
            return inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner
        if m["image"]:
            return inline_text(m["alt"])
        if m["link"]:
            return inline_text(m["label"])
        if m["auto"]:
            return m["uri"]
        if m["html"]:
            return m["html"]
        if m["hard"] or m["soft"]:
            return "\n"
        if m["ref"]:
            return html.unescape(m["ref"])
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        return m["marks"] if not around.strip() or around.isspace() else ""

    return _INLINE.sub(plain, text)


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline_text(c.strip().replace("\\|", "|")).strip() for c in re.split(r"(?<!\\)\|", line)]


def _starts(line: str) -> bool:
    """Whether a line ends a paragraph by opening another block."""
    item = _ITEM.match(line)
    html_block = _HTML.match(line)
    return bool(_ATX.match(line) or _BREAK.match(line) or _FENCE.match(line) or _QUOTE.match(line) or (item and item[6].strip() and (item[3] is None or item[3] == "1")) or (html_block and not html_block[7]))


class Scanner:
    def __init__(self):
        self.blocks: list[dict] = []
        self.headings: list[tuple[int, str]] = []

    def add(self, kind: str, text: str, first: int, last: int, level: int | None = None, rows: list[list[str]] | None = None) -> None:
        if text.strip():
            self.blocks.append({"kind": kind, "text": text, "level": level, "rows": rows, "line_start": first, "line_end": last, "section_path": [t for _, t in self.headings]})

    def heading(self, level: int, raw: str, first: int, last: int) -> None:
        text = " ".join(x.strip() for x in inline_text(raw).split("\n")).strip()
        if text:
            while self.headings and self.headings[-1][0] >= level:
                self.headings.pop()
            self.add("heading", text, first, last, level)
            self.headings.append((level, text))

    def paragraph(self, raw: str, first: int, last: int, marker: str | None) -> None:
        text = inline_text(raw).strip()
        if marker is not None:
            self.add("list_item", f"{marker} {text}" if marker and text else text, first, last)
            return
        images = [m for m in _INLINE.finditer(raw) if m["image"] or (m["link"] and _INLINE.fullmatch(m["label"] or "") and _INLINE.fullmatch(m["label"])["image"])]
        if images and not _strip(raw, images).strip():
            self.add("figure", "\n".join(inline_text(m.group(0)) for m in images), first, last)
        else:
            self.add("paragraph", text, first, last)

    def scan(self, lines: list[tuple[int, str]], depth: int = 0, marker: str | None = None) -> None:
        """``marker`` is that of the list item whose content starts here ('' for bullets)."""
        if depth > MAX_NESTING and any(x.strip() for _, x in lines):
            raise TooDeep
        i, n = 0, len(lines)
        while i < n:
            no, line = lines[i]
            if not line.strip():
                i, marker = i + 1, None
                continue
            own, marker = marker, None
            j = i + 1
            if len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip()) >= 4:
                while j < n and (not lines[j][1].strip() or lines[j][1].expandtabs(4).startswith("    ")):
                    j += 1
                body = [x.expandtabs(4)[4:] for _, x in lines[i:j]]
                while body and not body[-1].strip():
                    body.pop()
                self.add("paragraph", "\n".join(body), no, no + len(body) - 1)
            elif m := _FENCE.match(line):
                close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                while j < n and not close.match(lines[j][1]):
                    j += 1
                strip = re.compile(f" {{0,{len(m[1])}}}")
                text = "\n".join(strip.sub("", x, count=1) for _, x in lines[i + 1 : j])
                j = min(j + 1, n)
                self.add("paragraph", text.rstrip("\n"), no, lines[j - 1][0])
            elif m := _ATX.match(line):
                self.heading(len(m[1]), m[2] or "", no, no)
            elif _BREAK.match(line):
                pass
            elif _QUOTE.match(line):
                while j < n and lines[j][1].strip() and (_QUOTE.match(lines[j][1]) or not _starts(lines[j][1])):
                    j += 1
                self.scan([(k, re.sub(r"^ {0,3}> ?", "", x)) for k, x in lines[i:j]], depth + 1)
            elif m := _ITEM.match(line):
                pad = len(m[5]) if m[6].strip() and len(m[5]) <= 4 else 1
                width = len(m[1]) + len(m[2]) + pad
                body = [(no, (m[5][pad:] if len(m[5]) > 4 else "") + m[6])]
                while j < n:
                    k, x = lines[j]
                    if not x.strip():
                        ahead = next((y for _, y in lines[j:] if y.strip()), None)
                        if ahead is None or len(ahead) - len(ahead.lstrip()) < width:
                            break
                        body.append((k, ""))
                    elif len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) >= width:
                        body.append((k, x.expandtabs(4)[width:]))
                    elif body[-1][1].strip() and not _starts(x) and not _ITEM.match(x):
                        body.append((k, x.lstrip()))
                    else:
                        break
                    j += 1
                self.scan(body, depth + 1, m[2] if m[3] else "")
            elif m := _HTML.match(line):
                kind = next(g for g in range(1, 8) if m[g])
                if kind < 6:
                    end = re.compile(_HTML_END[kind - 1], re.I)
                    j = i
                    while j < n and not end.search(lines[j][1], m.end() if j == i else 0):
                        j += 1
                    j = min(j + 1, n)
                else:
                    while j < n and lines[j][1].strip():
                        j += 1
                self.add("paragraph", "\n".join(x for _, x in lines[i:j]).rstrip("\n"), no, lines[j - 1][0])
            elif "|" in line and j < n and _DELIMITER.match(lines[j][1]) and "|" in lines[j][1] + line and len(_cells(line)) == len(_cells(lines[j][1])):
                head = _cells(line)
                rows = [head]
                j += 1
                while j < n and lines[j][1].strip() and not _starts(lines[j][1]):
                    rows.append((_cells(lines[j][1]) + [""] * len(head))[: len(head)])
                    j += 1
                if len(rows) * len(head) > MAX_CELLS:
                    raise ValueError("table too large")
                self.add("table", "\n".join("\t".join(r) for r in rows), no, lines[j - 1][0], rows=rows)
            else:
                level = None
                while j < n and lines[j][1].strip():
                    if s := _SETEXT.match(lines[j][1]):
                        level = 1 if s[1][0] == "=" else 2
                        j += 1
                        break
                    if _starts(lines[j][1]):
                        break
                    j += 1
                part = lines[i : j - 1] if level else lines[i:j]
                raw = "\n".join(x.lstrip() for _, x in part).rstrip()
                if level:
                    self.heading(level, raw, no, lines[j - 1][0])
                else:
                    self.paragraph(raw, no, lines[j - 1][0], own)
            i = j


def _strip(raw: str, spans: list[re.Match]) -> str:
    out, at = "", 0
    for m in spans:
        out, at = out + raw[at : m.start()], m.end()
    return out + raw[at:]


def scan(text: str) -> list[dict]:
    s = Scanner()
    s.scan(list(enumerate(text.split("\n"), 1)))
    return s.blocks


SCHEMA = "document_id {id}, ord int, kind string, text string, level int, section_path array<string>, line_start int, line_end int, rows array<array<string>>, error string"


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of each Markdown text in order; a text that cannot be read gives one row with its error."""

    def run(parts):
        for part in parts:
            out = []
            for key, text in zip(part["document_id"], part["text"]):
                try:
                    found = scan(text or "")
                    out += [(key, i, b["kind"], b["text"], b["level"], b["section_path"], b["line_start"], b["line_end"], b["rows"], None) for i, b in enumerate(found)]
                except TooDeep:
                    out.append((key, 0, None, None, None, None, None, None, None, "block nesting too deep"))
                except ValueError as e:
                    out.append((key, 0, None, None, None, None, None, None, None, str(e)))
            df = pd.DataFrame(out, columns=["document_id", "ord", "kind", "text", "level", "section_path", "line_start", "line_end", "rows", "error"])
            yield df.astype({"level": "Int32", "line_start": "Int32", "line_end": "Int32"})

    rows = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, SCHEMA.format(id=rows.schema["document_id"].dataType.simpleString()))


class _Scan:
    """A table function over rows of a text with its key: its blocks in order, or one row with what is wrong."""

    def eval(self, row):
        key, text = row[0], row[1]
        try:
            for i, b in enumerate(scan(text or "")):
                yield key, i, b["kind"], b["text"], b["level"], b["section_path"], b["line_start"], b["line_end"], b["rows"], None
        except TooDeep:
            yield key, 0, None, None, None, None, None, None, None, "block nesting too deep"
        except ValueError as e:
            yield key, 0, None, None, None, None, None, None, None, str(e)


def register(spark, name: str = "markdown_scan", id_type: str = "bigint") -> None:
    """Makes the block rules callable from SQL: ``SELECT * FROM markdown_scan(TABLE(SELECT id, text FROM t))``.

    The first column is the key, of ``id_type``, the second the text; with
    ``PARTITION BY`` the rows of a key meet in one task, in the given order.
    A text that nests too deep is one row with its error.
    """
    spark.udtf.register(name, F.udtf(_Scan, returnType=SCHEMA.format(id=id_type)))
