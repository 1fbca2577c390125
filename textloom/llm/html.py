"""Main text of web pages by line-block distribution.

Markup is stripped first: every block-level tag begins a new line, inline tags vanish, and elements that are never
main text (scripts, menus, footers, forms, adverts by their class or id, and so on) leave empty lines. A line's length is its text
outside links. The lengths of WINDOW lines of text in a row make a block, whatever markup stands between them. Text
begins where blocks surge and ends where they dive to nothing, and all lines between are kept whole, with up to WINDOW - 1 short
lines right before the surge. Blocks surge over SURGE letters, or over half of the page's largest block if that is less. Where the page marks its
article, what the blocks found there is widened to the article's ends, but for dives, and text outside is kept only where a run of it is longer than
all of the article, which then is but a teaser; an article without a surge stays if nothing else does. A form or marked wrapper that the page's article or
nearly all of its text stands in is not left out.

Tags are read as browsers do, attribute by attribute, in time linear in the page: a `<` that no letter follows is
text, and a tag that the page's end cuts off is none.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches

WINDOW = 3
#: Letters of a block that begin main text.
SURGE = 80
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_MARKS = {"class", "id", "role", "hidden", "aria-hidden", "style"}
_RAW = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split())
_DROP = set("script style head title noscript template svg annotation annotation-xml canvas iframe object embed audio video nav footer aside form button select option textarea input dialog menu noembed noframes applet map".split())
#: Words of a class or id: it marks what is not main text if it holds a word of _BAD and no words but those of _BAD and _PLAIN.
_BAD = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner cookie cookies consent gdpr notice notices alert alerts sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay paywall widget pagination pager toolbar trending".split())
_PLAIN = set("area bar block blog body bottom box button buttons container content cta desktop entry fixed form global group icons inline inner item items js left link links list main message mobile news outer page panel policy post posts primary reader right row secondary section site slot sm st sticky story stories text thread top unit user web wp wrap wrapper article articles".split())
_WHOLE = {"side-bar", "skip-link", "sr-only", "screen-reader-text", "most-read"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Only outside an article: in one, a header holds its title.
_HEAD = {"header", "site-header", "page-header", "main-header", "top-header", "global-header"}
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Tags that end an open paragraph.
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


#: A paragraph's or inline end tag does not close what stands outside these.
_CLOSED = {"article", "main", "body", "nav", "footer", "aside", "td", "li"}
_LOOSE = _INLINE | {"p"}
_MARKUP = re.compile(r"<(?:[A-Za-z!?]|/[A-Za-z])")


def _not_main(value: str) -> bool:
    """Whether one name of a class or id marks what is not main text."""
    if value.lower() in _WHOLE:
        return True
    words = {w.lower() for w in _WORD.findall(value)}
    return not words.isdisjoint(_BAD) and words <= _BAD | _PLAIN


def _dropped(tag: str, marks: dict[str, str], inside: bool) -> int:
    """0 for an element that stays, 1 for one that goes, 2 for one that goes unless it holds the page's main text."""
    if tag in _DROP and tag != "form":
        return 1
    bad = 2 if tag == "form" or tag == "header" and not inside else 0
    if tag in ("html", "body", "main", "header") or not marks:
        return bad
    names = marks.get("class", "").split() + marks.get("id", "").split()
    if any(map(_not_main, names)) or not inside and tag != "article" and not _HEAD.isdisjoint(n.lower() for n in names) or marks.get("role", "").strip().lower() in _ROLE:
        bad = 2
    if "hidden" in marks or marks.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(marks.get("style", "")):
        return 1
    return bad


def _tag(page: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """The name, marks and end of the tag whose name begins at `at`, and whether it closes itself; the end is -1 if the page ends first."""
    name = _NAME.match(page, at)
    at = name.end()
    marks: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        key = m[1].lower()
        if key in _MARKS:
            marks.setdefault(key, html.unescape(m[2] or m[3] or m[4] or ""))
    end = page.find(">", at)
    return name[0].lower(), marks, end > 0 and page[end - 1] == "/", end


def lines(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[str], np.ndarray, np.ndarray, bool, frozenset[int]]:
    """Lines of text, their lengths outside links, whether each stands in an article, whether the page has one, and where elements begin that were left out but hold its main text; those in spared are not left out."""
    text: list[str] = []
    plain: list[int] = []
    within: list[bool] = []
    piece: list[str] = []
    free = 0
    #: Tag, how it is dropped, and for what may be spared its number in `wraps`.
    stack: list[tuple[str, int, int]] = []
    #: Where in the stack each tag is open.
    open_: dict[str, list[int]] = {}
    off = hard = links = articles = 0
    #: Letters outside links and what is dropped for good; those of them in articles and in <main>; open articles and <main>s that count for these.
    letters = [0, 0, 0]
    good = [0, 0]
    #: Where it begins, whether it is a form outside articles, and its letters: what was counted before, then what stands in it.
    wraps: list[list] = []
    marked = False

    def line() -> None:
        nonlocal free
        text.append(" ".join(html.unescape("".join(piece)).split()))
        plain.append(free)
        within.append(articles > 0)
        piece.clear()
        free = 0

    def pop(n: int) -> None:
        nonlocal off, hard, links, articles
        while len(stack) > n:
            tag, bad, wrap = stack.pop()
            open_[tag].pop()
            off -= bad > 0
            hard -= bad == 1
            if wrap >= 0:
                wraps[wrap][2:] = [b - a for a, b in zip(wraps[wrap][2:], letters, strict=True)]
            if not bad:
                good[0] -= tag in ("article", "main")
                good[1] -= tag == "main"
            links -= tag == "a"
            articles -= tag in ("article", "main")

    def last(tag: str) -> int:
        own = open_.get(tag)
        return own[-1] if own else -1

    def last_of(tags: set[str]) -> int:
        return max((own[-1] for t in tags if (own := open_.get(t))), default=-1)

    def count(s: str) -> None:
        if not hard and not links:
            n = len(s.strip())
            letters[0] += n
            letters[1] += n if good[0] else 0
            letters[2] += n if good[1] else 0

    def take(s: str) -> None:
        nonlocal free
        if not hard:
            count(s)
        if not off:
            piece.append(s)
            if not links:
                free += len(s.strip())

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        while begin >= 0 and not _MARKUP.match(page, begin):
            begin = page.find("<", begin + 1)
        if begin != at:
            take(page[at:begin] if begin >= 0 else page[at:])
        if begin < 0:
            break
        if page[begin + 1] in "!?":
            stop = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(stop, begin + 2)
            at = end + len(stop) if end >= 0 else len(page)
            continue
        closing = page[begin + 1] == "/"
        tag, marks, alone, end = _tag(page, begin + 1 + closing)
        if end < 0:
            break
        at = end + 1
        if tag not in _INLINE and tag not in ("script", "style", "noscript", "template"):
            line()
        if closing:
            if (k := last(tag)) >= 0 and not (tag in _LOOSE and last_of(_CLOSED) > k):
                pop(k)
            continue
        if tag in _VOID or alone and tag not in ("p", "div", "span", "a", "b", "i"):
            continue
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        same, stop = ({"p"}, _ENDS_P - {"p"}) if tag in _ENDS_P else (_SAME.get(tag, set()), _SCOPE.get(tag, set()))
        if same and (k := last_of(same)) >= 0 and last_of(stop) < k:
            pop(k)
        bad = 0 if begin in spared else _dropped(tag, marks, articles > 0)
        wrap = -1
        if bad == 2 and not hard:
            wrap = len(wraps)
            wraps.append([begin, tag == "form", *(letters[:1] + [n if not good[0] else math.inf for n in letters[1:]])])
        open_.setdefault(tag, []).append(len(stack))
        stack.append((tag, bad, wrap))
        off += bad > 0
        hard += bad == 1
        if not bad:
            good[0] += tag in ("article", "main")
            good[1] += tag == "main"
        links += tag == "a"
        if tag in ("article", "main") and not off:
            marked = True
        articles += tag in ("article", "main")
    line()
    pop(0)
    kept = any(t and w for t, w in zip(text, within, strict=True))
    holds = lambda form, n, article, main: (article if form else main) > 0 or not kept and n > SURGE and (form and 2 * n > letters[0] or letters[0] - n < SURGE)
    return text, np.array(plain), np.array(within), marked, frozenset(x[0] for x in wraps if holds(*x[1:]))


def blocks(plain: np.ndarray) -> np.ndarray:
    """The sum of each line's length and those of the lines after it, WINDOW in all; beyond the last there is nothing."""
    return np.convolve(plain, np.ones(WINDOW, np.int64))[WINDOW - 1 :]


def runs(plain: np.ndarray, within: np.ndarray, marked: bool) -> np.ndarray:
    """Which lines of text are main text: by the lines' lengths first; whether they stand in a marked article widens or settles what the blocks found."""
    sums = blocks(plain)
    least = min(SURGE, int(sums.max()) // 2)
    keep = np.zeros(len(plain), bool)
    at = 0
    while at < len(plain):
        if sums[at] <= least or not plain[at]:
            at += 1
            continue
        # short lines just before a surge, such as a title, belong to it
        begin, to = at, at
        while begin > max(0, at - WINDOW + 1) and plain[begin - 1] and not keep[begin - 1]:
            begin -= 1
        while to < len(plain) and plain[to : to + WINDOW].any():
            to += 1
        keep[begin:to] = True
        at = to
    if not (marked and within.any()):
        return keep
    article = int(plain[within].sum())
    edges = [0, *(np.flatnonzero(within[1:] != within[:-1]) + 1).tolist(), len(plain)]
    parts = list(zip(edges, edges[1:], strict=False))
    for begin, end in parts:
        if within[begin] and keep[begin:end].any():
            keep[begin:end] = _undived(plain[begin:end])
        elif not within[begin]:
            cuts = [begin, *(np.flatnonzero(keep[begin + 1 : end] != keep[begin : end - 1]) + begin + 1).tolist(), end]
            for a, b in zip(cuts, cuts[1:], strict=False):
                keep[a:b] &= plain[a:b].sum() > article
    if not keep.any():
        for begin, end in parts:
            if within[begin]:
                keep[begin:end] = _undived(plain[begin:end])
    return keep


def _undived(plain: np.ndarray) -> np.ndarray:
    """An article's lines but for its dives: WINDOW lines or more of nothing but links."""
    keep = np.zeros(len(plain), bool)
    at = 0
    while at < len(plain):
        to = at
        while to < len(plain) and (plain[to : to + WINDOW].any() or to + WINDOW > len(plain)):
            to += 1
        keep[at:to] = True
        at = to
        while at < len(plain) and not plain[at]:
            at += 1
    return keep


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks, one a line. A null or empty page, or one without text, has none."""
    text, plain, within, marked, wraps = lines(page or "")
    if wraps:
        text, plain, within, marked, _ = lines(page or "", wraps)
    # empty lines, which markup makes, count for nothing
    full = [k for k, t in enumerate(text) if t]
    if not full:
        return ""
    keep = runs(plain[full], within[full], marked)
    return "\n".join(text[k] for k, kept in zip(full, keep, strict=True) if kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from its whole html; a null html has an empty text. Repeated rows and nulls in other columns pass through."""
    rows = small_batches(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                got = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
