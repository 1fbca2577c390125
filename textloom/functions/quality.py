"""Validity rules: reasons as arrays, quality of rewrites, predicates on passages, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions.text import ascii_pattern, col, contains_any, jaccard, lines, space_words, squeeze, starts_with_any, strip, text_of, word_count

DANGLING = [r"\b(and|or|but|because|while|although|though|that|which|who|whom|whose|where|when|if|to|of|in|on|at|by|with|from|into|for|as|than|the|a|an)\s*$", r"[,;:]\s*$", r"\b(can|could|would|should|may|might|must|shall|will|is|are|was|were|be|been|being|have|has|had|do|does|did)\s*$"]


def reasons(**checks: Column) -> Column:
    """The names of the checks that hold, in their order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def blank(c: Column | str) -> Column:
    return F.length(strip(text_of(c))) == 0


def looks_truncated(c: Column | str, dangling: bool = True) -> Column:
    """No closing mark at the end, or a dangling word there. The mark is looked for first, so a dangling word never decides."""
    t = strip(text_of(c))
    out = (F.length(t) == 0) | ~F.right(t, F.lit(1)).isin(L.VALID_ENDINGS)
    for p in DANGLING if dangling else []:
        out = out | F.lower(t).rlike(p)
    return out


def looks_complete(c: Column | str) -> Column:
    return F.coalesce(F.right(strip(text_of(c)), F.lit(1)).isin(L.VALID_ENDINGS[:7]), F.lit(False))


def starts_with_meta_text(c: Column | str) -> Column:
    return starts_with_any(F.lower(strip(text_of(c))), L.META_PREFIXES)


def has_prompt_leakage(c: Column | str) -> Column:
    """Only texts that hold letters of a pattern meet them all."""
    return contains_any(F.lower(text_of(c)), ["as an ai", "i cannot", "i can't", "sure", "here is ", "rewritten ", "return only"]) & text_of(c).rlike("(?i)" + ascii_pattern("|".join(L.PROMPT_LEAKAGE)))


def human_reasons(label="label", id_="id", pair="pair_id", text="text") -> Column:
    missing = lambda c: F.coalesce(col(c).cast("string") == "", F.lit(True))
    return reasons(bad_label=F.coalesce(col(label) != 0, F.lit(True)), missing_id=missing(id_), missing_pair_id=missing(pair), empty_text=blank(text))


def llm_reasons(reject_truncated: bool = True, label="label", id_="id", pair="pair_id", text="text", domain="domain", passed: Column | None = None, issues: Column | None = None, finish: Column | None = None) -> Column:
    """Reasons against a rewrite; verse may end anywhere, and only an explicit false fails quality."""
    missing = lambda c: F.coalesce(col(c).cast("string") == "", F.lit(True))
    no = F.lit(False)
    prose = F.lower(text_of(domain)) != "poetry"
    return reasons(
        bad_label=F.coalesce(col(label) != 1, F.lit(True)),
        missing_id=missing(id_),
        missing_pair_id=missing(pair),
        empty_text=blank(text),
        quality_failed=F.coalesce(~passed, no) if passed is not None else no,
        possibly_truncated_quality_issue=F.lit(reject_truncated) & prose & F.coalesce(F.array_contains(issues, "possibly_truncated"), no) if issues is not None else no,
        finish_reason_length=F.coalesce(finish == "length", no) if finish is not None else no,
        possibly_truncated_text=F.lit(reject_truncated) & prose & looks_truncated(text),
    )


def thresholds(domain: Column | str, prompt: Column | str | None = None) -> Column:
    """(min_abs_words, min_length_ratio, max_length_ratio, max_jaccard, fail_on_truncated) by prompt and domain."""
    p, d = F.lower(text_of(F.lit("") if prompt is None else prompt)), F.lower(text_of(domain))
    row = lambda a, b, c, j, t: F.struct(F.lit(a).alias("min_abs_words"), F.lit(b).alias("min_length_ratio"), F.lit(c).alias("max_length_ratio"), F.lit(j).alias("max_jaccard"), F.lit(t).alias("fail_on_truncated"))
    return (
        F.when(F.startswith(p, F.lit("chatgpt_conservative")) | F.contains(p, F.lit("old_fiction")), row(20, 0.55, 1.60, 0.90, False))
        .when(contains_any(p, ["archaic_poetry", "poetry_freeverse"]), row(12, 0.45, 1.80, 0.92, False))
        .when(d == "academic", row(20, 0.50, 2.00, 0.92, True))
        .otherwise(row(20, 0.45, 2.00, 0.82, False))
    )


def rewrite_quality(source: str, rewrite: str, domain: Column | str = "domain", prompt: Column | str | None = None) -> Column:
    """Counts, ratios (rounded; the limits see them unrounded), issues and verdict of a rewrite."""
    q = thresholds(domain, prompt)
    ns, nr = space_words(source), space_words(rewrite)
    ratio, overlap = nr / F.greatest(ns, F.lit(1)), jaccard(source, rewrite)
    issues = reasons(
        empty_output=blank(rewrite),
        too_short_absolute=nr < q["min_abs_words"],
        too_short_relative=ratio < q["min_length_ratio"],
        too_long_relative=ratio > q["max_length_ratio"],
        too_similar_to_source=overlap > q["max_jaccard"],
        possibly_truncated=q["fail_on_truncated"] & looks_truncated(rewrite, dangling=False),
        contains_meta_text=starts_with_meta_text(rewrite),
    )
    return F.struct(
        ns.alias("source_word_count"), nr.alias("rewrite_word_count"), F.round(ratio, 4).alias("length_ratio"), F.round(overlap, 4).alias("lexical_jaccard"), issues.alias("quality_issues"), (F.size(issues) == 0).alias("passed_basic_quality_check")
    )


def valid_paragraph(c: Column | str, least: int = 50, most: int = 400) -> Column:
    return space_words(c).between(least, most) & ~contains_any(F.lower(text_of(c)), L.PARAGRAPH_BAD)


def heading_like(c: Column | str) -> Column:
    """At most three lines of at most twelve words, most of them in capitals; no words at all count too."""
    rows = F.transform(lines(c), lambda x: strip(x))
    ws = F.regexp_extract_all(F.array_join(rows, " "), F.lit("[A-Za-z]+"), F.lit(0))
    capitals = F.size(F.filter(ws, lambda w: (w == F.upper(w)) & (F.length(w) > 1)))
    return (F.size(rows) <= 3) & ((F.size(ws) == 0) | ((F.size(ws) <= 12) & (capitals / F.greatest(F.size(ws), F.lit(1)) > 0.6)))


def valid_verse(c: Column | str, words_: tuple[int, int] = (20, 400), lines_: tuple[int, int] = (4, 60)) -> Column:
    t = text_of(c)
    rows = F.transform(lines(t), lambda x: strip(x))
    n = F.size(rows)
    ended = F.size(F.filter(rows, lambda x: x.rlike(r"""[,.;:!?)\]}"'”’—]$""")))
    mean = F.aggregate(rows, F.lit(0.0), lambda s, x: s + F.length(x)) / F.greatest(n, F.lit(1))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return ~contains_any(F.lower(t), L.POETRY_BAD) & space_words(t).between(*words_) & n.between(*lines_) & ~heading_like(t) & (mean <= 95) & (ended / F.greatest(n, F.lit(1)) >= 0.35) & (letters >= 0.55 * F.greatest(F.length(t), F.lit(1)))


def bad_section(c: Column | str) -> Column:
    return F.coalesce(contains_any(F.lower(col(c)), L.BAD_SECTIONS), F.lit(False))


def has_keyword(c: Column | str) -> Column:
    return contains_any(F.lower(text_of(c)), L.ACADEMIC_KEYWORDS)


def digit_ratio(c: Column | str) -> Column:
    t = text_of(c)
    return F.regexp_count(t, F.lit(r"\p{Nd}")) / F.greatest(F.length(t), F.lit(1))


def valid_academic(c: Column | str, section: Column | str) -> Column:
    t = squeeze(c)
    return ~bad_section(section) & space_words(t).between(80, 320) & ~contains_any(F.lower(t), L.ACADEMIC_BAD) & (digit_ratio(t) <= 0.12) & has_keyword(t)


def structured_noise(c: Column | str) -> Column:
    t = text_of(c)
    return (
        contains_any(F.lower(t), L.NOISE_MARKERS)
        | (F.regexp_count(t, F.lit(r"[{}\[\]]")) >= 6)
        | (F.regexp_count(t, F.lit(r'"[A-Za-z_][A-Za-z0-9_]*"\s*:')) >= 2)
        | (F.regexp_count(t, F.lit(r"[{}\[\]<>|\\]")) / F.greatest(F.length(t), F.lit(1)) > 0.025)
    )


def quality_flags(text="text", label="label", words_: tuple[int, int] = (30, 420), short_verse: int = 12, bucket: Column | str = "bucket", domain: Column | str = "domain", passed: Column | None = None, finish: Column | None = None) -> dict[str, Column]:
    """Flags against a candidate. Verse, by bucket or domain, may be shorter; leakage counts against rewrites only, quality only where it is an explicit false."""
    n = space_words(text)
    no = F.lit(False)
    verse = text_of(bucket).startswith("poetry") | (F.lower(text_of(domain)) == "poetry")
    return {
        "empty_text": blank(text),
        "too_short": (n < words_[0]) & ~(verse & (n >= short_verse)),
        "too_long": n > words_[1],
        "prompt_leakage": F.coalesce(col(label) == 1, no) & has_prompt_leakage(text),
        "failed_basic_quality": F.coalesce(~passed, no) if passed is not None else no,
        "finish_reason_length": F.coalesce(finish == "length", no) if finish is not None else no,
    }
