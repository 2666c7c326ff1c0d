"""The random field against enumeration and differences, and hand-written layouts that share nothing with its training."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from driftline.llm import crf, extract, labelled
from driftline.llm.blocks import leaf_blocks


@pytest.fixture(scope="module")
def model():
    return extract.fitted()


def test_viterbi_equals_enumeration():
    rng = random.Random(1)
    pages = [blocks[:9] for blocks, _ in labelled.marked(labelled.pages(40, seed=8))]
    for blocks in pages:
        names = {f for i, b in enumerate(blocks) for f in (*crf.path_features(b.path), *crf.text_features(b, i == 0, i == len(blocks) - 1))}
        own = crf.Crf({f: rng.gauss(0, 1) for f in sorted(names)}, np.array([[rng.gauss(0, 2) for _ in "ab"] for _ in "ab"]))
        s = own.scores(blocks)
        value = lambda y: sum(a for a, m in zip(s, y, strict=True) if m) + sum(own.pairs[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(map(value, itertools.product((0, 1), repeat=len(blocks))))
        assert np.isclose(value(tuple(map(int, own.decode(blocks)))), best)  # equal blocks may tie


def test_sums_equal_enumeration_and_gradients_equal_differences():
    rng = np.random.default_rng(2)
    s, pairs = rng.normal(size=(3, 6)), rng.normal(size=(2, 2))
    there = np.arange(6) < np.array([6, 1, 4])[:, None]
    total, main, expected = crf.sums(s, there, pairs)
    for p, n in enumerate((6, 1, 4)):
        values = {y: sum(s[p, i] for i in range(n) if y[i]) + sum(pairs[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=n)}
        z = sum(map(np.exp, values.values()))
        assert np.isclose(total[p], np.log(z))
        for i in range(n):
            assert np.isclose(main[p, i], sum(np.exp(v) for y, v in values.items() if y[i]) / z)
    whole = lambda s, pairs: crf.sums(s, there, pairs)[0].sum()
    for p, i in itertools.product(range(3), range(6)):
        if there[p, i]:
            step = np.zeros_like(s)
            step[p, i] = 1e-5
            assert np.isclose((whole(s + step, pairs) - whole(s - step, pairs)) / 2e-5, main[p, i], atol=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros_like(pairs)
        step[a, b] = 1e-5
        assert np.isclose((whole(s, pairs + step) - whole(s, pairs - step)) / 2e-5, expected[a, b], atol=1e-6)


def test_scores_of_shared_elements_equal_those_of_paths(model):
    for blocks in (leaf_blocks(p) for p in labelled.pages(60, seed=3)):
        plain = [
            sum(model.weights.get(f, 0) for f in (*crf.path_features(b.path), *crf.text_features(b, i == 0, i == len(blocks) - 1)))
            for i, b in enumerate(blocks)
        ]
        assert np.allclose(model.scores(blocks), plain)


@pytest.mark.parametrize("part", ["<div>x", '<div class="a b">x', "<section><p>x", "<ul><li>x", "<table><tr><td>x", "<svg><g>", "</p>x"])
def test_many_open_elements_take_time_in_proportion(model, part):
    began = time.monotonic()
    blocks = leaf_blocks(part * 100_000)
    model.decode(blocks)
    assert time.monotonic() - began < 60


def test_names_without_end_take_time_in_proportion(model):
    began = time.monotonic()
    model.decode(leaf_blocks("".join(f'<div class="n{i} m{i}q">x' for i in range(30_000))))
    assert time.monotonic() - began < 60


A = "The harbour lay quiet when the first boats came in, and nobody was there to meet them."
B = "By noon the market had filled, and the price of herring rose twice before the bell was rung."
C = "Nobody could say afterwards who had opened the gate, or why the lamps had been left burning."
T = "Boats return to the harbour"
LINKS = '<a href="/1">Home</a> <a href="/2">World</a> <a href="/3">Sport</a>'
LIST = '<ul><li><a href="/1">Home</a></li><li><a href="/2">World</a></li><li><a href="/3">Sport</a></li></ul>'
COPY = "&copy; 2019 The Harbour Times. All rights reserved."
STORY = f"<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = f"{T} {A} {B} {C}"

LAYOUTS = {
    "bare": f"<html><body>{STORY}</body></html>",
    "no end tags": f"<body><h1>{T}</h1><p>{A}<p>{B}<p>{C}",
    "one div": f"<body><div>{STORY}</div></body>",
    "deep divs": f"<body><div><div><div><div>{STORY}</div></div></div></div></body>",
    "links above": f"<body><div>{LINKS}</div>{STORY}</body>",
    "list above": f"<body>{LIST}{STORY}</body>",
    "list above and below": f"<body>{LIST}{STORY}{LIST}</body>",
    "nav and footer": f"<body><nav>{LIST}</nav>{STORY}<footer>{COPY}</footer></body>",
    "main": f"<body><header>{LINKS}</header><main>{STORY}</main><footer><p>{COPY}</p></footer></body>",
    "article in section": f"<body><section><article>{STORY}</article></section></body>",
    "with sidebar": f'<body><div class="page-with-sidebar"><div>{STORY}</div></div></body>',
    "has comments": f'<body><article class="story has-comments">{STORY}</article></body>',
    "no sidebar": f'<body class="no-sidebar">{STORY}</body>',
    "table columns": f"<table><tr><td>{LINKS}</td><td>{STORY}</td></tr></table>",
    "table of nineties": f'<table width="600"><tr><td width="120"><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Links</a></td><td>{STORY}</td></tr></table>',
    "foreign names": f'<div id="kopf">{LIST}</div><div id="inhalt">{STORY}</div>',
    "hashed names": f'<div class="x1a9"><div class="q77z">{LIST}</div></div><div class="b3kk"><div class="zz0">{STORY}</div></div>',
    "aside after": f"<body><article>{STORY}</article><aside><h3>Most read</h3>{LIST}</aside></body>",
    "aside before": f"<body><aside>{LIST}</aside><article>{STORY}</article></body>",
    "comments after": f'<article>{STORY}</article><div id="comments"><h2>3 comments</h2><div>Great read, thanks!</div><div>I was there that day.</div></div>',
    "cookie notice": f'<div class="cookie-bar">We use cookies. <button>Accept</button></div><article>{STORY}</article>',
    "search form": f'<form action="/s"><label>Search</label><input name="q"></form><div class="post">{STORY}</div>',
    "scripts between": f"<body><script>var a = '<p>{A}</p>';</script>{STORY}<script>go()</script></body>",
    "styles and comments": f"<body><style>p {{ color: red }}</style><!-- <p>{A}</p> -->{STORY}</body>",
    "upper case": f"<BODY><DIV><H1>{T}</H1><P>{A}</P><P>{B}</P><P>{C}</P></DIV></BODY>",
    "inline markup": f"<article><h1><em>{T}</em></h1><p>{A}</p><p><b>{B}</b></p><p><i>{C}</i></p></article>",
    "figure": f'<article>{STORY}<figure><img src="a.jpg"></figure></article>',
    "hidden advert": f'<article><h1>{T}</h1><p>{A}</p><div class="ad-slot">Sponsored: buy a boat</div><p>{B}</p><p>{C}</p></article>',
    "share links": f'<article>{STORY}</article><div class="share"><a href="/f">Facebook</a> <a href="/t">Twitter</a></div>',
    "related": f'<main><article>{STORY}</article></main><section class="related"><h2>Related</h2>{LIST}</section>',
    "newsletter": f'<article>{STORY}</article><section class="newsletter"><h3>Sign up</h3><p>Subscribe to our newsletter.</p></section>',
    "whole page": f'<header><a href="/">The Harbour Times</a></header><nav>{LIST}</nav><main><article>{STORY}</article><aside>{LIST}</aside></main><footer>{COPY}</footer>',
    "schema names": f'<div itemprop="articleBody">{STORY}</div><div role="contentinfo">{COPY}</div>',
    "role main": f'<div role="navigation">{LIST}</div><div role="main">{STORY}</div>',
    "blog": f'<div id="wrapper"><div id="header"><h2><a href="/">My blog</a></h2></div><div class="entry">{STORY}</div><div id="footer">{COPY}</div></div>',
    "wide page": f'<div class="container"><div class="row"><div class="col-md-8">{STORY}</div><div class="col-md-4">{LIST}</div></div></div>',
    "breadcrumb": f'<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><div class="content">{STORY}</div>',
    "ordered list below": f"<body>{STORY}<ol><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ol></body>",
    "font tags": f'<body><font face="arial"><center><h1>{T}</h1></center><p>{A}</p><p>{B}</p><p>{C}</p></font></body>',
    "attributes unquoted": f"<div class=content id=c1>{STORY}</div><div class=footer>{COPY}</div>",
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts_written_by_hand(model, name):
    assert extract.extract(LAYOUTS[name], model) == WANT
