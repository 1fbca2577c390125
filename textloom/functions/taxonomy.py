"""Classification of rows: probability bins, tiers, flips, tags and weights, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import col, contains_any, text_of, word_count


def confidence_bucket(p: Column | str, threshold: float) -> Column:
    p = col(p)
    m = F.abs(p - F.lit(threshold))
    return F.when(m <= 0.05, "boundary").when(m <= 0.15, "near_boundary").when(p >= 0.90, "very_high_llm").when(p <= 0.10, "very_high_human").when(p >= threshold, "confident_llm").otherwise("confident_human")


def probability_bucket(p: Column | str) -> Column:
    p = col(p)
    return F.when(p < 0.2, "lt_0.20").when(p < 0.35, "0.20_0.35").when(p < 0.45, "0.35_0.45").when(p < 0.55, "0.45_0.55").when(p < 0.65, "0.55_0.65").when(p < 0.8, "0.65_0.80").otherwise("ge_0.80")


def selection_tier(label: Column | str, p: Column | str) -> Column:
    label, p = col(label), col(p)
    near = p.between(0.35, 0.65)
    human = F.when(p >= 0.65, "very_hard_human_fp").when(p >= 0.55, "hard_human_fp").when(near, "ambiguous_human_support").otherwise("human_support")
    llm = F.when(p <= 0.35, "very_hard_llm_fn").when(p <= 0.45, "hard_llm_fn").when(near, "ambiguous_llm_support").otherwise("llm_support")
    return F.when(label == 0, human).otherwise(llm)


def hardness_of(label: Column | str, p: Column | str) -> Column:
    """How far a row's probability is on the wrong side."""
    return F.when(col(label) == 0, col(p)).otherwise(1 - col(p))


#: Names of flips, by the first run's prediction, the second's and the label. Fixed values.
FLIPS = {
    "000": "stable_step7_correct", "001": "both_miss", "010": "induced_fp", "011": "fixed_fn_candidate",
    "100": "round4_fixed_fp", "101": "round4_induced_fn", "110": "both_miss", "111": "stable_step7_correct",
}


def flip_type(label: Column | str, base: Column | str, new: Column | str) -> Column:
    """What a second run changes against the first; `other` for a row without label or with values that are not 0 or 1."""
    key = F.concat(*(col(c).cast("string") for c in (base, new, label)))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FLIPS.items() for x in kv)), key), F.lit("other"))


def override_safety(flip: Column | str) -> Column:
    return F.when(col(flip) == "fixed_fn_candidate", "safe").when(col(flip) == "induced_fp", "unsafe").otherwise("not_override")


def sample_weight(label: Column | str, bucket: Column | str, tag: Column | str) -> Column:
    b = col(bucket)
    return F.when(col(label) == 1, 1.0).when(b.isin("poetry_classical", "poetry_freeverse"), 2.0).when(b.isin("literary_old_prose", "literary_short_fragment"), 1.7).when(b == "academic_formal", 1.4).when(col(tag) == "human_ornate_literary_mirror", 1.5).otherwise(1.2)


def _quotes(t: Column) -> Column:
    return F.regexp_count(t, F.lit('["“”]'))


def human_taxonomy(bucket: Column | str, domain: Column | str, signal: Column, text: Column | str, academic_markers: Column | str) -> Column:
    b, t = col(bucket), text_of(text)
    return (
        F.when(b == "poetry_classical", "human_classical_poetry")
        .when(b == "poetry_freeverse", "human_free_verse")
        .when(F.contains(signal, F.lit("dialogue")) | (_quotes(t) >= 4), F.when(b == "literary_old_prose", "human_old_fiction_dialogue").otherwise("human_polished_literary_prose"))
        .when(b == "literary_old_prose", "human_archaic_prose")
        .when((b == "academic_formal") | (F.lower(text_of(domain)) == "academic"), "human_formal_academic")
        .when(b == "literary_short_fragment", "human_literary_short_fragment")
        .when((col(academic_markers) >= 2) & (word_count(t) >= 80), "human_structured_explanatory")
        .otherwise("human_polished_literary_prose")
    )


def llm_taxonomy(bucket: Column | str, domain: Column | str, signal: Column, text: Column | str, prompt: Column | str, generator: Column | str, jaccard: Column) -> Column:
    b, p, d, t = col(bucket), F.lower(text_of(prompt)), F.lower(text_of(domain)), text_of(text)
    return (
        F.when((b == "academic_formal") | (d == "academic"), "llm_academic_term_preserving_paraphrase")
        .when(b.isin("poetry_classical", "poetry_freeverse") | (d == "poetry"), "llm_archaic_poetry_rewrite")
        .when(contains_any(p, ["old", "archaic"]) | (b == "literary_old_prose") | F.contains(signal, F.lit("old_prose")), "llm_old_fiction_style_rewrite")
        .when(F.contains(p, F.lit("dialogue")) | (_quotes(t) >= 4), "llm_style_preserving_dialogue_rewrite")
        .when(jaccard >= 0.68, "llm_high_jaccard_rewrite")
        .when(contains_any(p, ["minimal", "conservative", "preserving"]), "llm_low_temperature_minimal_rewrite")
        .when(F.lower(text_of(generator)) == "chatgpt", "llm_conservative_chatgpt_paraphrase")
        .otherwise("llm_human_like_formal_paraphrase")
    )


def text_signal(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(text_of(c) for c in columns)))


def to_double(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def histogram_bin(p: Column | str, bins: int = 10) -> Column:
    """The bin of a value clipped to [0, 1]; the last bin is closed, a null goes to `missing`."""
    k = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(p))) * bins), F.lit(bins - 1))
    return F.when(col(p).isNull(), "missing").otherwise(F.format_string("%.1f-%.1f", k / F.lit(float(bins)), (k + 1) / F.lit(float(bins))))
