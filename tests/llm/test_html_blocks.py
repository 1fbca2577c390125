"""Line blocks, attributes and broken pages."""

import random
import time

import numpy as np
import pytest

from textloom.llm import html

P = "Two hundred letters of a paragraph. " * 6
T = P.strip()
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(4)) + "</ul>"


def plain_runs(plain, within, marked):
    """The rule line by line: a surge begins a run, a window of nothing ends it; an article widens what was found in it and outweighs shorter runs outside."""
    n, w = len(plain), html.WINDOW
    window = lambda k: plain[k : k + w]
    least = min(html.SURGE, max(sum(window(k)) for k in range(n)) // 2)
    found = set()
    k = 0
    while k < n:
        if plain[k] and sum(window(k)) > least:
            back = [j for j in range(k - 1, max(-1, k - w), -1)]
            for j in back:
                if j in found or not plain[j]:
                    break
                found.add(j)
            while k < n and any(window(k)):
                found.add(k)
                k += 1
        else:
            k += 1
    if not (marked and any(within)):
        return [k in found for k in range(n)]
    groups = []
    for k in range(n):
        if k and within[k] == within[k - 1]:
            groups[-1].append(k)
        else:
            groups.append([k])

    def undived(g):
        own, k = set(), g[0]
        while k <= g[-1]:
            ahead = [j for j in range(k, k + w) if j <= g[-1]]
            if len(ahead) == w and not any(plain[j] for j in ahead):
                while k <= g[-1] and not plain[k]:
                    k += 1
            else:
                own.add(k)
                k += 1
        return own

    article, out = sum(p for p, i in zip(plain, within) if i), set()
    for g in groups:
        if within[g[0]]:
            out |= undived(g) if found & set(g) else set()
        else:
            part = []
            for k in [*g, None]:
                if k in found:
                    part.append(k)
                else:
                    out |= set(part) if sum(plain[j] for j in part) > article else set()
                    part = []
    if not out:
        out = set().union(*(undived(g) for g in groups if within[g[0]]))
    return [k in out for k in range(n)]


def test_runs_are_those_of_the_plain_rule():
    r = random.Random(4)
    for _ in range(3000):
        n = r.randrange(1, 14)
        plain = [r.choice([0, 0, 5, 30, 90, 400]) for _ in range(n)]
        a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
        within = [a <= k < b for k in range(n)]
        marked = r.random() < 0.6
        assert html.runs(np.array(plain), np.array(within), marked).tolist() == plain_runs(plain, within, marked)
        assert html.blocks(np.array(plain)).tolist() == [sum(plain[k : k + html.WINDOW]) for k in range(n)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a menu in an article dives; a paragraph of one link does not
        (f"<article><h1>T</h1><p>{P}</p>{LINKS}<p>{P}</p></article>", f"T\n{T}\n{T}"),
        (f"<article><h1><a href=x>T</a></h1><p>{P}</p><p><a href=y>More of it</a></p></article>", f"T\n{T}\nMore of it"),
        # longer than the article, which is a teaser
        (f"<article><p>Teaser.</p></article><div><p>{P}</p><p>{P}</p></div><p>Foot</p>", f"Teaser.\n{T}\n{T}\nFoot"),
        (f"<p>Before.</p><article><p>{P}</p></article><p>After.</p>", T),
        # menus and short lines around unmarked text
        (f"{LINKS}<div><p>{P}</p><p>Short.</p></div>{LINKS}<p>Small print.</p>", f"{T}\nShort."),
        # attributes are read one by one
        ("<article><p title=\"the hidden river\">Text one</p><p data-x='class=\"ad\"'>Two</p></article>", "Text one\nTwo"),
        ("<article><p class=share-price>A</p><div class='related-work'>B</div><div class='shareButtons'>C</div><p class='adBox top'>D</p></article>", "A\nB"),
        ("<article><p a=\"x>y\" class=ad>No</p><p b='1>2'>Yes</p><p class = \"x ad\">No</p><p hidden>No</p></article>", "Yes"),
        ("<article><p>1 < 2 and 3 <4 &lt;b&gt; a<b>c</b></p></article>", "1 < 2 and 3 <4 <b> ac"),
        ("<article><p>a</p><!-- > <p>no</p> --><p>b</p><!-- open <p>no</p></article>", "a\nb"),
        ("<!-- never closed <p>no</p>", ""),
        ("<article><p>a</p><p class=x", "a"),
        ("<article><p>a</p><script>var x = '<p>no</p>'", "a"),
    ],
)
def test_page(page, want):
    assert html.main_text(page) == want


def test_blocks_decide(monkeypatch):
    pages = [f"<article><h1>T</h1><p>{P}</p>{LINKS}<p>{P}</p></article>", f"{LINKS}<p>{P}</p>{LINKS}<p>Small print.</p>"]
    before = [html.main_text(p) for p in pages]
    monkeypatch.setattr(html, "runs", lambda plain, within, marked: np.ones(len(plain), bool))
    assert all(html.main_text(p) != b for p, b in zip(pages, before, strict=True))


@pytest.mark.parametrize("unit", ["<a ", "<p>", "</p>", "<", "<!", "<!--", "<a b=\"", "<a b='", "<div><b>", "</b></i>", "<p class=a  ", "&amp;", "<script>", "<td><tr>", "a = = ", "<x =", "<b></article>"])
def test_broken_pages_take_linear_time(unit):
    seconds = []
    for n in (60_000, 240_000):
        page = "<article><p>x" + unit * (n // len(unit))
        begin = time.perf_counter()
        html.main_text(page)
        seconds.append(time.perf_counter() - begin)
    assert seconds[1] < 8 * seconds[0] + 0.3


def test_the_given_pages_need_no_article_tags(spark, sf):
    """Blocks alone find what the marked article holds."""
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert html.main_text(re.sub(r"</?(article|main)\b[^>]*>", "", r.html, flags=re.I)) == html.main_text(r.html)


def test_short_lines_before_a_surge_belong_to_it():
    assert html.main_text(f"<nav><a href=/>x</a></nav><h1>Title</h1><p>By me</p><p>{P}</p>") == f"Title\nBy me\n{T}"
