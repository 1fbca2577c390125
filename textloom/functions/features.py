"""Surface, stylometric and fusion features as columns."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations
from string import punctuation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon as L
from textloom.functions.text import ascii_pattern, contains_any, has_word, lines, replace_many, space_words, text_of, word_count, words

SURFACE = ["length_chars", "length_words", "num_lines", "linebreak_ratio", "avg_line_length", "punctuation_ratio", "quote_count", "dash_count", "semicolon_count", "archaic_word_count", "academic_marker_count", "poetic_marker_count", "type_token_ratio", "sentence_length_mean", "sentence_length_std"]
STYLE = ["length_chars", "length_words", "num_lines", "linebreak_ratio", "avg_line_length", "punctuation_ratio", "quote_count", "dash_count", "semicolon_count", "colon_count", "comma_count", "period_count", "question_count", "exclamation_count", "parenthesis_count", "digit_ratio", "uppercase_ratio", "avg_word_length", "word_length_std", "type_token_ratio", "stopword_ratio", "function_word_ratio", "sentence_length_mean", "sentence_length_std", "archaic_word_count", "academic_marker_count", "poetic_marker_count"]


def _n(c: Column) -> Column:
    return c.cast("double")


def _count(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def _chars(t: Column, chars: str) -> Column:
    """How many of a text's characters are among chars: from the bytes that go with each of a few, or with runs of many of ASCII."""
    if len(chars) > 8 and chars.isascii():
        return F.octet_length(t) - F.octet_length(F.regexp_replace(t, f"[{re.escape(chars)}]+", ""))
    return reduce(lambda a, b: a + b, (((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(x)))) / len(x.encode())).cast("int") for x in chars))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def _std(a: Column) -> Column:
    """The population's deviation, from one pass over small whole numbers; 0 for fewer than two."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n = F.size(a)
    end = lambda z: F.sqrt(F.greatest(F.lit(0.0), z["q"] / n - (z["s"] / n) * (z["s"] / n)))
    return F.when(n > 1, F.aggregate(a, zero, lambda z, x: F.struct((z["s"] + x).alias("s"), (z["q"] + x * x).alias("q")), end)).otherwise(0.0)


def _among(ws: Column, words_: list[str]) -> Column:
    return _n(F.size(F.filter(ws, lambda w: w.isin(words_))))


_MARKERS = sorted({*L.ARCHAIC, *L.ACADEMIC, *L.POETIC, *L.LEDGER_ARCHAIC, *L.LEDGER_ACADEMIC, *L.LEDGER_POETIC})


def with_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the pieces that features share, computed once: t_, words_ in lower case, marked_ (those of them that a list of markers has), lines_ and sents_."""
    df = df.withColumn("t_", text_of(text))
    df = df.withColumns({"words_": F.transform(words("t_"), lambda w: F.lower(w)), "lines_": lines("t_"), "sents_": F.split("t_", "[.!?]+")})
    lengths = F.filter(F.transform("sents_", lambda s: word_count(s).cast("double")), lambda n: n > 0)
    return df.withColumns({"marked_": F.filter("words_", lambda w: w.isin(_MARKERS)), "sents_": lengths, "lines_": F.when(F.size("lines_") > 0, F.col("lines_")).otherwise(F.array("t_"))})


def surface_features() -> dict[str, Column]:
    """The fifteen surface features, over with_parts' pieces."""
    t, n, w = F.col("t_"), F.length("t_"), F.size("words_")
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return {
        "length_chars": _n(n),
        "length_words": _n(w),
        "num_lines": _n(F.greatest(F.lit(1), F.size("lines_"))),
        "linebreak_ratio": ratio(_chars(t, "\n"), n),
        "avg_line_length": F.aggregate("lines_", F.lit(0.0), lambda s, x: s + F.length(x)) / F.greatest(F.lit(1), F.size("lines_")),
        "punctuation_ratio": ratio(_chars(t, punctuation), n),
        "quote_count": _n(_chars(t, "'\"`‘’“”")),
        "dash_count": _n(_chars(t, "-–—")),
        "semicolon_count": _n(_chars(t, ";")),
        "archaic_word_count": _among(F.col("marked_"), L.ARCHAIC),
        "academic_marker_count": _among(F.col("marked_"), L.ACADEMIC),
        "poetic_marker_count": _among(F.col("marked_"), L.POETIC),
        "type_token_ratio": ratio(F.size(F.array_distinct("words_")), w),
        "sentence_length_mean": _mean(F.col("sents_")),
        "sentence_length_std": _std(F.col("sents_")),
    }


def _refers(t: Column, name: str) -> Column:
    """Whether a text cites a paper, a table or a figure. Only texts that hold what a pattern begins with meet it; edges are those of ASCII words, as in SQL."""
    space = r"[ \t\n\f\r]"
    numbered = [F.contains(t, F.lit(x)) & t.rlike(rf"{x}(?<!\w{x}){space}+\d") for x in ("table", "figure")]
    author = F.contains(t, F.lit("(")) & t.rlike(rf"\([A-Z]{name}+,{space}*\d{{4}}\)")
    return reduce(lambda a, b: a | b, numbered, author | F.contains(t, F.lit("et al.")) & t.rlike(r"et al\.(?<!\wet al\.)(?=\w)"))


def bucket() -> Column:
    """The six-way bucket of a text, from its surface features."""
    t, low = F.col("t_"), F.lower("t_")
    archaic, poetic, academic = F.col("archaic_word_count"), F.col("poetic_marker_count"), F.col("academic_marker_count")
    nw, nl, avg = F.col("length_words"), F.col("num_lines"), F.col("avg_line_length")
    verse = lambda classical: F.when(classical, "poetry_classical").otherwise("poetry_freeverse")
    return (
        F.when((nl >= 4) & (avg <= 72), verse((archaic >= 1) | (poetic >= 2)))
        .when((nw <= 55) & ((poetic >= 2) | (archaic >= 1) | ((nl >= 2) & (avg <= 90))), verse((archaic >= 1) | contains_any(low, ["sonnet", "poesy"])))
        .when((academic >= 4) | _refers(t, "[A-Za-z-]"), "academic_formal")
        .when((archaic >= 2) | has_word(low, re.findall("[a-z]+", L.OLD_PROSE.replace(r"\b", ""))), "literary_old_prose")
        .when(nw <= 55, "literary_short_fragment")
        .otherwise("general_prose")
    )


def with_surface(df: DataFrame, text: str = "text", keep_existing: bool = True) -> DataFrame:
    """Adds the surface features and the bucket; a column that is there already wins where it has a value."""
    own = set(df.columns)
    out = with_parts(df, text).withColumns({f"f_{k}" if k in own else k: v for k, v in surface_features().items()})
    for k in SURFACE:
        if k in own:
            out = out.withColumn(k, F.coalesce(k, f"f_{k}") if keep_existing else F.col(f"f_{k}")).drop(f"f_{k}")
    b = F.coalesce("bucket", bucket()) if "bucket" in own and keep_existing else bucket()
    return out.withColumn("bucket", b)


def drop_parts(df: DataFrame) -> DataFrame:
    return df.drop("t_", "words_", "marked_", "lines_", "sents_")


def style_features() -> dict[str, Column]:
    """The twelve stylometric features beyond the surface ones."""
    t, w = F.col("t_"), F.size("words_")
    chars = F.greatest(F.lit(1), F.length("t_"))
    sizes = F.transform("words_", lambda x: F.length(x).cast("double"))
    function = F.when(w > 0, _among(F.col("words_"), L.FUNCTION_WORDS) / w).otherwise(0.0)
    return {
        "colon_count": _n(_chars(t, ":")),
        "comma_count": _n(_chars(t, ",")),
        "period_count": _n(_chars(t, ".")),
        "question_count": _n(_chars(t, "?")),
        "exclamation_count": _n(_chars(t, "!")),
        "parenthesis_count": _n(_chars(t, "()")),
        "digit_ratio": _count(t, r"\p{Nd}") / chars,
        "uppercase_ratio": _count(t, r"\p{Lu}") / chars,
        "avg_word_length": _mean(sizes),
        "word_length_std": _std(sizes),
        "stopword_ratio": function,
        "function_word_ratio": function,
    }


def shape_features(per_letter: bool = True) -> dict[str, Column]:
    """Lexical shape; the share of capitals is of letters, or of all characters."""
    t, w = F.col("t_"), F.greatest(F.lit(1), F.size("words_"))
    chars = F.greatest(F.lit(1), F.length("t_"))
    return {
        "uppercase_char_ratio": _count(t, r"\p{Lu}") / (F.greatest(F.lit(1), _count(t, r"\p{L}")) if per_letter else chars),
        "digit_char_ratio": _count(t, r"\p{Nd}") / chars,
        "space_char_ratio": _count(t, r"(?U)\s") / chars,
        "comma_count": _n(_chars(t, ",")),
        "colon_count": _n(_chars(t, ":")),
        "paren_count": _n(_chars(t, "()")),
        "long_word_ratio": F.size(F.filter("words_", lambda x: F.length(x) >= 9)) / w,
        "avg_word_len": F.aggregate("words_", F.lit(0.0), lambda s, x: s + F.length(x)) / w,
        "first_person_count": _among(F.col("words_"), L.FIRST_PERSON),
        "quote_count_raw": _n(_chars(t, "'\"`‘’“”")),
    }


def entropy(p: Column, eps: float = 1e-9) -> Column:
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))


def fusion_features(runs: list[str]) -> dict[str, Column]:
    """Of columns p_<run>: pairwise differences, moments, range and mean entropy."""
    p = [F.col(f"p_{r}") for r in runs]
    n, total = len(p), reduce(lambda a, b: a + b, p)
    mean = total / n
    out = {f"abs_{a}_{b}": F.abs(F.col(f"p_{a}") - F.col(f"p_{b}")) for a, b in combinations(runs, 2)}
    low, high = (F.least(*p), F.greatest(*p)) if n > 1 else (p[0], p[0])
    return out | {
        "prob_mean": mean,
        "prob_std": F.sqrt(reduce(lambda a, b: a + b, ((x - mean) * (x - mean) for x in p)) / n) if n > 1 else F.lit(0.0),
        "prob_min": low,
        "prob_max": high,
        "prob_range": high - low,
        "prob_entropy": reduce(lambda a, b: a + b, map(entropy, p)) / n,
    }


def hardness(c: Column | str) -> Column:
    """A score of literary difficulty; tokens count as substrings, so `ere` is in `here`."""
    t = text_of(c)
    part = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        part(contains_any(F.lower(t), L.HARDNESS_TOKENS), 3)
        + part(contains_any(t, [";", ":", "--", "—"]), 2)
        + part(contains_any(t, ['"', "“", "”", "'"]), 2)
        + part(contains_any(t, ["!", "?"]), 1)
        + part(t.rlike(r"\b[A-Z][a-z]+(?:'s)?\b"), 1)
    )


def rough_domain(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds rough_domain: an older cut of texts, by other word lists and bounds than bucket's."""
    df = with_parts(df, text)
    t, low = F.col("t_"), F.lower("t_")
    n, nl = F.size("words_"), F.size("lines_")
    archaic, academic, poetic = (_among(F.col("marked_"), x) for x in (L.LEDGER_ARCHAIC, L.LEDGER_ACADEMIC, L.LEDGER_POETIC))
    avg = F.aggregate("lines_", F.lit(0.0), lambda s, x: s + F.length(x)) / F.greatest(F.lit(1), nl)
    contracted = _count(t, ascii_pattern(r"[A-Za-z]+[’']d\b"))
    verse = lambda c: F.when(c, "poetry_classical").otherwise("poetry_freeverse")
    case = (
        F.when((nl >= 4) & (avg <= 55), verse(archaic >= 2))
        .when((n <= 150) & ((_count(t, " {2,}") >= 2) | (archaic >= 3) | (contracted >= 3) | (poetic >= 3)), verse((archaic >= 2) | (contracted >= 3) | contains_any(low, ["poesy", "muse", "muses", "sonnet"])))
        .when((n <= 50) & ((poetic >= 1) | ((_count(t, ",") >= 2) & (_count(t, "[.!?]+") <= 1))), verse(archaic >= 1))
        .when((nl >= 2) & (n <= 45), "poetry_or_fragment")
        .when((academic >= 5) | _refers(t, "[A-Za-z]"), "academic_formal")
        .when((archaic >= 2) | has_word(low, ["whilst", "whereupon", "thereof", "hitherto", "nay", "alas"]), "literary_old_prose")
        .when(n <= 45, "literary_short_fragment")
        .otherwise("general_prose")
    )
    return drop_parts(df.withColumn("rough_domain", case))


def space_word_feature(c: Column | str) -> Column:
    return space_words(c).cast("double")
