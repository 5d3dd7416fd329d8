"""Composite text density against a plain recomputation on random trees; deep and cut pages; layout names."""

from __future__ import annotations

import math
import random
import time

import pytest

from symtrace.llm import html


def tree(rng, depth=0):
    """(tag, parts): parts are trees and texts."""
    tag = "body" if depth == 0 else rng.choice(["div", "section", "p", "a", "span"] if depth < 4 else ["p", "a"])
    parts = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and tag in ("body", "div", "section") and rng.random() < 0.75:
            parts.append(tree(rng, depth + 1))
        elif not parts or not isinstance(parts[-1], str):
            parts.append(" ".join(rng.choice(["word", "of", "text,", "longer-word"]) for _ in range(rng.randrange(1, 25))))
    return tag, parts


def written(t):
    return f" {t} " if isinstance(t, str) else f"<{t[0]}>{''.join(map(written, t[1]))}</{t[0]}>"


def counts(t):
    """characters, tags, link characters, link tags."""
    c = g = lc = lt = 0
    for p in t[1]:
        if isinstance(p, str):
            c += len(p)
        else:
            x = counts(p)
            c, g, lc, lt = c + x[0], g + x[1] + 1, lc + x[2], lt + x[3] + (p[0] == "a")
    return c, g, c if t[0] == "a" else lc, lt


def density(t, body):
    c, g, lc, lt = (len(t), 0, 0, 0) if isinstance(t, str) else counts(t)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + body[2] / max(1, body[0]) * c + math.e)
    return c / max(1, g) * math.log(c / max(1, lc) * max(1, g) / max(1, lt)) / math.log(max(base, 1 + 1e-9))


@pytest.mark.parametrize("seed", range(150))
def test_core_and_threshold(seed):
    root = tree(random.Random(seed))
    body = counts(root)
    every, above = [], {}

    def walk(t, path):
        above[id(t)] = [*path, t]
        every.append(t)
        for p in t[1]:
            if not isinstance(p, str):
                walk(p, above[id(t)])

    walk(root, [])
    total = [sum(density(p, body) for p in t[1] if not isinstance(p, str)) for t in every]
    core = every[max(range(len(every)), key=lambda k: total[k])]
    threshold = min(density(t, body) for t in above[id(core)])
    found_body, found_core, found = html.selected(html.parse(f"<html>{written(root)}</html>"))
    assert (found_body.chars, found_body.tags, found_body.link_chars, found_body.link_tags) == body
    assert found == pytest.approx(threshold) and found_core.tag == core[0] and found_core.chars == counts(core)[0]
    text = html.main_text(f"<html>{written(root)}</html>").split()
    whole = [w for t in _texts(core) for w in t.split()]
    assert _within(whole, text)
    for outer, inner in zip(above[id(core)], above[id(core)][1:], strict=False):
        for p in outer[1]:
            if p is not inner and not isinstance(p, str) and p[0] in ("div", "section", "p") and abs(density(p, body) - threshold) > 1e-9:
                assert _within([w for t in _texts(p) for w in t.split()], text) or density(p, body) < threshold


def _texts(t):
    return [t] if isinstance(t, str) else [x for p in t[1] for x in _texts(p)]


def _within(part, whole):
    return any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep" + "</div>" * 100_000, "<b>" * 30_000 + "</i>" * 30_000 + "x" + "<p>" * 30_000, "<i>" * 30_000 + "<div>" + "</b>" * 30_000, "<table><tr>" * 20_000 + "<td>x" + "</b>" * 20_000])
def test_time_grows_with_the_page(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 10


PAGES = {
    "<body>Opening sentence of the page, long enough to stay. <div><p>Hello world of long sentences here.</p><p>More of it, and more words.</p></div>Closing sentence of the <i>page</i>, long enough as well.</body>": "Opening sentence of the page, long enough to stay. Hello world of long sentences here. More of it, and more words. Closing sentence of the page, long enough as well.",
    "<body><div class='content has-sidebar'><h1>T</h1><p>Hello world of long sentences here.</p></div></body>": "T Hello world of long sentences here.",
    "<article><div class=entry-header><h1>Title</h1></div><p>Text of the article.</p></article>": "Title Text of the article.",
    "<body><div class=notice><p>Most of the text of this page is in a part whose name speaks of notices.</p></div></body>": "Most of the text of this page is in a part whose name speaks of notices.",
    "<body><p>Short article.</p><div class=comments><p>Readers write far more than the author of this article ever did, but they are no article.</p></div></body>": "Short article.",
    "<article><p>First of two articles, with words.</p></article><article><p>Second of two articles, with words.</p></article>": "First of two articles, with words. Second of two articles, with words.",
    "<article><p>Ok.</p><div><p>A longer paragraph that is the core of this article by far.</p><p>And another one of the kind.</p></div></article><p>A line outside of the article, not of it.</p>": "Ok. A longer paragraph that is the core of this article by far. And another one of the kind.",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_no_text_is_lost(page):
    assert html.main_text(page) == PAGES[page]
