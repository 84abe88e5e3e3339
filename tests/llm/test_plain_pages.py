"""Operator 8 on pages written by hand, far from its generator; its CRF against enumeration."""

import itertools

import numpy as np
import pytest

from folioflow.llm import html_crf as H

A = "The committee met on Tuesday to discuss the new budget. It agreed on most points, but not on the tax."
B = "Members will meet again next week. A vote is expected then, said the chair."
C = "Residents had asked for a longer debate, which the council refused."
ZH, ZH2 = "委员会周二开会讨论新预算，大多数问题达成一致。但税收问题没有。", "委员们将于下周再次开会，预计届时投票。"
LONG = " ".join(f"Sentence number {i} of a very long text goes on, as texts do." for i in range(4000))
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>© 2020 Example Press. All rights reserved.</p></footer>"

PAGES = {
    "one paragraph": (f"<article><p>{A}</p></article>", [A]),
    "plain nested divs": (f'<div id="c1"><div>{A}</div><div>{B}</div></div>', [A, B]),
    "body only": (f"<html><body>{A}</body></html>", [A]),
    "no markup": (A, [A]),
    "body paragraphs": (f"<body><p>{A}</p><p>{B}</p></body>", [A, B]),
    "main": (f"<main><p>{A}</p></main>", [A]),
    "menu and footer around one paragraph": (f"<body>{NAV}<article><p>{A}</p></article>{FOOT}</body>", [A]),
    "table cell": (f"<table><tr><td>{A}</td></tr></table>", [A]),
    "preformatted": (f"<body><pre>{A}</pre></body>", [A]),
    "chinese": (f"<article><p>{ZH}</p><p>{ZH2}</p></article>", [ZH, ZH2]),
    "chinese with furniture": (f"<body>{NAV}<article><h1>新预算</h1><p>{ZH}</p></article>{FOOT}</body>", ["新预算", ZH]),
    "short": ("<article><p>Closed today.</p></article>", ["Closed today."]),
    "heading and text": (f"<h1>Budget talks</h1><p>{A}</p>", ["Budget talks", A]),
    "noscript notice": (f"<body><noscript>Please enable JavaScript to view this site.</noscript><article><h1>Budget talks</h1><p>{A}</p></article></body>", ["Budget talks", A]),
    "video fallback": (f"<article><h1>Budget talks</h1><p>{A}</p><video src=x>Your browser cannot play this.</video><p>{B}</p></article>", ["Budget talks", A, B]),
    "reader comments": (f'<body>{NAV}<article><p>{A}</p><p>{B}</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>anna</p><p>I do not agree.</p></div></section>{FOOT}</body>', [A, B]),
    "sidebar and advert": (f'<body><div class="content"><h1>Budget talks</h1><p>{A}</p><div class="ad">Buy two, get one.</div><p>{C}</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Rain</a></li></ul></div></body>', ["Budget talks", A, C]),
    "list": (f"<article><p>{A}</p><ul><li>First point.</li><li>Second point.</li></ul></article>", [A, "First point.", "Second point."]),
    "references and blanks": ("<article><p>Caf&eacute;&nbsp;&amp;\n\t bar &#8211; open.</p></article>", ["Café & bar – open."]),
    "long text": (f"<article><p>{LONG}</p></article>", [LONG]),
    "form and notice": (f'<body><div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div><main><p>{A}</p><p>{B}</p></main><form class="newsletter"><label>Your address</label><button>Sign up</button></form></body>', [A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    page, want = PAGES[name]
    assert H.main_text(page, H.trained()).split("\n\n") == want


def test_kept_sums_equal_features():
    m = H.trained()
    for page in H.labelled_pages(30, seed=5):
        own = H.blocks(page, m.known)
        plain = [sum(m.weight.get(f, 0.0) for f in H.features(b)) for b in own]
        assert m.weigh(own) == pytest.approx(plain) and m.best(m.weigh(own)) == m.decode([H.features(b) for b in own])


def test_marginals_equal_enumeration():
    """Forward and backward sums give what all state sequences together give: the gradient of the likelihood."""
    r = np.random.default_rng(2)
    for n in (1, 2, 5):
        u, T = r.normal(size=(n, 2)), r.normal(size=(2, 2))
        node, edge, z = np.zeros((n, 2)), np.zeros((2, 2)), 0.0
        for ys in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(u[i, y] for i, y in enumerate(ys)) + sum(T[a, b] for a, b in zip(ys, ys[1:])))
            z += p
            for i, y in enumerate(ys):
                node[i, y] += p
            for a, b in zip(ys, ys[1:]):
                edge[a, b] += p
        got = H._marginals(u, T)
        assert got[0] == pytest.approx(node / z) and got[1] == pytest.approx(edge / z)
