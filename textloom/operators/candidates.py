"""Candidate rows of training pools: projections, eligibility, resolvers of ids, labels and stages, as columns and tables.

Rows carry a string map `metadata` where they have one. A value counts as missing where it is null or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import quality as Q
from textloom.functions import taxonomy as C
from textloom.functions.features import drop_parts, with_surface
from textloom.functions.text import col, jaccard, slug, space_words, strip, text_key, text_of, word_count
from textloom.operators.normalise import hard_bucket, inferred_bucket, present
from textloom.operators.order import positions

#: The stages that a file's name tells, by what the name begins with or holds, in order of precedence.
STAGES = [("^round3_", "round3_reused_pool"), ("round2_", "round2_reused_pool"), ("hard_positive|hardpos", "hard_positive_pool"), ("poetry", "poetry_pool"), ("academic", "academic_pool"), ("hard_negative", "hard_negative_pool")]
EXACT_FLIPS = {"fixed_fn_candidate": "safe_override", "induced_fp": "unsafe_override"}


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# resolvers


def source_document(metadata: str = "metadata") -> Column:
    """The document that a row comes from: what its metadata names, else the first id that it has."""
    meta = [F.col(metadata)[k] for k in ("paper_id", "gutenberg_id", "source_file", "title")]
    return present(*meta, *(F.col(c).cast("string") for c in ("source_pair_id", "pair_id", "source_id", "original_id", "id")), default="unknown_source_doc")


def split_group(text: str = "text") -> Column:
    """The group that keeps a row's relatives in one split, by its text where it has no id."""
    return present(*(F.col(c).cast("string") for c in ("source_pair_id", "pair_id", "source_id", "original_id", "source_doc_id", "id")), text_key(text))


def group_key(*columns: str, index: Column | None = None, prefix: str = "group") -> Column:
    """The first of some ids, else a number of the row."""
    return present(*(F.col(c).cast("string") for c in columns), *([F.format_string(f"{prefix}_%06d", index)] if index is not None else []))


def origin(*columns: str, default: str = "unknown_non_teacher_source") -> Column:
    return present(*columns, default=default)


def source_stage(name: Column | str) -> Column:
    n = F.lower(text_of(name))
    out = F.lit("generic_rewrite_pool")
    for pattern, stage in reversed(STAGES):
        out = F.when(n.rlike(pattern), stage).otherwise(out)
    return out


def source_priority(name: Column | str) -> Column:
    """0 to 4: reused pools first, then hard positives, then verse and academic pools."""
    n = F.lower(text_of(name))
    return F.when(n.startswith("round3_"), 0).when(n.startswith("round2_"), 1).when(n.rlike("hard_positive|hardpos"), 2).when(n.rlike("poetry|academic"), 3).otherwise(4)


def mirror_tag(label: Column | str, bucket: Column | str, domain: Column | str, prompt: Column | str) -> Column:
    """The tag of a residual candidate: which human style it mirrors, or which hard rewrite it is."""
    b, d, p = col(bucket), F.lower(text_of(domain)), F.lower(text_of(prompt))
    human = (
        F.when(b == "poetry_classical", "human_poetry_classical_mirror").when(b == "poetry_freeverse", "human_poetry_freeverse_mirror").when(b == "literary_old_prose", "human_literary_old_prose_mirror")
        .when((b == "academic_formal") | (text_of(domain) == "academic"), "human_formal_academic_mirror").when(b == "literary_short_fragment", "human_short_fragment_mirror").otherwise("human_polished_general_mirror")
    )
    llm = (
        F.when((b == "poetry_classical") | p.contains("archaic"), "llm_archaic_poetry_hardpos").when((b == "poetry_freeverse") | (d == "poetry"), "llm_freeverse_poetry_hardpos")
        .when((b == "academic_formal") | (d == "academic"), "llm_natural_academic_hardpos").when((b == "literary_old_prose") | p.contains("old"), "llm_old_prose_hardpos")
        .when(b == "literary_short_fragment", "llm_short_fragment_hardpos").otherwise("llm_polished_general_hardpos")
    )
    return F.when(col(label) == 0, human).otherwise(llm)


def mirror_weight(label: Column | str, bucket: Column | str, tag: Column | str) -> Column:
    b = col(bucket)
    return F.when(col(label) == 1, 1.0).when(b.isin("poetry_classical", "poetry_freeverse", "literary_old_prose"), 2.0).when(b == "literary_short_fragment", 1.7).when(b == "academic_formal", 1.4).when(col(tag) == "human_polished_general_mirror", 1.5).otherwise(1.2)


def safety(flip: Column | str = "flip_type", given: Column | str = "override_safety") -> Column:
    f = col(flip)
    return F.when(f == "fixed_fn_candidate", "safe_override").when(f == "induced_fp", "unsafe_override").otherwise(present(given, default="unknown"))


def binary(c: Column | str) -> Column:
    """A 0 or 1, else null."""
    v = col(c).try_cast("int") if not isinstance(c, str) else F.col(c).try_cast("int")
    return F.when(v.isin(0, 1), v)


def guard_target(flip_label: str, target: str, safety_: str, original: str, label: str) -> Column:
    """1 for an override that must be stopped, 0 for one that may pass, null where nothing tells."""
    s = F.col(safety_)
    return F.coalesce(binary(flip_label), binary(target), F.when(s == "unsafe_override", 1).when(s == "safe_override", 0), F.when(F.col(original).isNotNull(), binary(label)))


def selector_target(selector: str, target: str, label: str, safety_: str) -> Column:
    """1 for an override that is safe, 0 for one that is not; a row that tells neither raises."""
    s = F.col(safety_)
    return F.coalesce(binary(selector), binary(target), binary(label), F.when(s == "safe_override", 1).when(s == "unsafe_override", 0), F.raise_error(F.lit("a row has no selector label")).cast("int"))


def selector_pass(flag: str = "safe_selector_pass", threshold: str = "safe_selector_threshold", p: str = "p_safe_override") -> Column:
    """The flag where a row has one, else whether p reaches the threshold."""
    f = F.col(flag).cast("string")
    return F.when(f.isNotNull() & (f != ""), F.coalesce(f.try_cast("int"), F.lit(0)) != 0).otherwise(_no(F.col(p) >= F.col(threshold)))


def reasons_to_rerun(min_ratio: float, max_jaccard: float, task="task_id", source="source_text", text="text", issues: Column | None = None, passed: Column | None = None, finish: Column | None = None) -> Column:
    """Why a rewrite is asked for again, each reason once; an empty text is the last reason looked for."""
    ratio = space_words(text) / F.greatest(space_words(source), F.lit(1))
    missing = Q.reasons(missing_task_id=F.coalesce(col(task).cast("string") == "", F.lit(True)))
    own = Q.reasons(possibly_truncated=Q.looks_truncated(text), too_short_relative=ratio < min_ratio, too_similar_to_source=jaccard(source, text) > max_jaccard)
    after = Q.reasons(quality_failed=_no(~passed) if passed is not None else F.lit(False))
    end = Q.reasons(finish_reason_length=_no(finish == "length") if finish is not None else F.lit(False))
    parts = [missing, own, *([F.coalesce(issues, F.array().cast("array<string>"))] if issues is not None else []), after]
    return F.when(Q.blank(text), F.concat(missing, F.array(F.lit("empty_text")))).otherwise(F.concat(F.array_distinct(F.concat(*parts)), end))


def failure_reasons(error="error", finish="finish_reason", issues: Column | str = "issues") -> Column:
    """What a failed task's record says against it, or that it stands there."""
    said = F.array_compact(F.concat(F.array(F.when(text_of(error) != "", text_of(error)), F.when(text_of(finish) != "", F.concat(F.lit("finish_reason="), text_of(finish)))), F.coalesce(col(issues), F.array().cast("array<string>"))))
    return F.when(F.size(said) == 0, F.array(F.lit("failed_file_record"))).otherwise(said)


# eligibility


def quality_reason(text="text", label="label", passed: Column | str = "passed", least: int = 15) -> Column:
    """`ok`, or the first reason against a candidate; quality and leakage count against rewrites only."""
    llm = col(label) == 1
    return F.when(Q.blank(text), "empty_text").when(space_words(text) < least, "too_short").when(_no(llm & ~col(passed)), "failed_basic_quality").when(_no(llm & Q.has_prompt_leakage(text)), "prompt_leakage").otherwise("ok")


def valid_human_seed() -> Column:
    has = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return _no((F.col("label") == 0) & ~Q.blank("text") & has("id") & has("pair_id"))


def valid_academic_seed() -> Column:
    return _no(~Q.blank("text") & (F.col("label") == 0) & (F.col("domain") == "academic") & F.coalesce(F.col("pair_id").cast("string") != "", F.lit(False)))


def valid_detection() -> Column:
    return _no(F.col("label").isin(0, 1) & ~Q.blank("text"))


def valid_rewrite(generator: str, min_ratio: float, max_jaccard: float, require_quality: bool = True, reject_truncated: bool = True, source="source_text", text="text") -> Column:
    """Whether a rewrite may replace an earlier one."""
    ratio = space_words(text) / F.greatest(space_words(source), F.lit(1))
    ok = F.coalesce(F.col("task_id") != "", F.lit(False)) & ~Q.blank(text) & (F.col("label") == 1) & (F.col("generator") == generator) & (ratio >= min_ratio) & (jaccard(source, text) <= max_jaccard) & ~_no(F.col("finish_reason") == "length")
    ok = ok & _no(F.col("passed")) if require_quality else ok
    return _no(ok & ~Q.looks_truncated(text) if reject_truncated else ok)


def valid_academic_negative(text="text", section="section") -> Column:
    """An academic passage fit to be a hard negative: 60 to 260 words, few digits, no structured noise."""
    return ~Q.bad_section(section) & space_words(text).between(60, 260) & (Q.digit_ratio(text) <= 0.15) & ~Q.structured_noise(text)


def exact_override(flip="flip_type", base="step7_pred", new="round4_pred") -> Column:
    return _no(F.col(flip).isin(*EXACT_FLIPS) & (F.col(base).try_cast("int") == 0) & (F.col(new).try_cast("int") == 1))


def residual_proxy(tag="round4_tag", stage="round4_source_stage") -> Column:
    return ~text_of(tag).startswith("base_") & ~text_of(stage).isin("", "step7_base_train")


def allowed(value: Column, only: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> Column:
    """Whether a value is on the list of allowed ones, of which none allows all, and on no list of excluded ones."""
    out = F.lit(True)
    if only:
        out = out & value.isin(*only)
    return out & ~value.isin(*never) if never else out


def subset(df: DataFrame, **values: str) -> DataFrame:
    """Labelled predictions whose columns have these values; an empty value asks for nothing."""
    out = df.where(F.col("label").isin(0, 1) & F.col("pred").isin(0, 1))
    for c, v in values.items():
        out = out.where(F.col(c) == v) if v else out
    return out


# projections


def _augmented(df: DataFrame, kind: str) -> Column:
    return F.map_concat(F.map_filter("metadata", lambda k, _: k != "training_augmentation"), F.create_map(F.lit("training_augmentation"), F.lit(kind))) if "metadata" in df.columns else F.create_map(F.lit("training_augmentation"), F.lit(kind))


def human_seed_rows(df: DataFrame) -> DataFrame:
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return df.where(valid_human_seed()).withColumns({"label": F.lit(0), "generation": F.lit("human"), "domain": unknown("domain"), "source": unknown("source")})


def human_train_rows(df: DataFrame, kind: str, prompt: Column | None = None, domain: str | None = None) -> DataFrame:
    """Human rows added to training, marked with the kind of augmentation."""
    own = {c: F.lit("human") for c in ("generator", "model", "generation")} | ({"domain": F.lit(domain)} if domain else {})
    return df.withColumns({"label": F.lit(0), "split": F.lit("train"), "prompt_type": prompt if prompt is not None else F.lit("human_hard_negative"), "metadata": _augmented(df, kind), **own})


def llm_train_rows(df: DataFrame, kind: str, domain: str | None = None) -> DataFrame:
    """Rewrites added to training: the generator is the assigned one where there is none, and the source where that is missing."""
    g = present("generator", "assigned_generator", default="chatgpt")
    own = {"domain": F.lit(domain)} if domain else {}
    return df.withColumns({"label": F.lit(1), "split": F.lit("train"), "generator": g, "source": present("source", g), "generation": present("generation", default="llm_rewrite"), "metadata": _augmented(df, kind), **own})


def hard_negative_samples(df: DataFrame, domain: str, order: list[str], start: int = 1) -> DataFrame:
    """New human samples with ids by position: id, pair_id and source_id of one number."""
    own = positions(df, order).withColumn("n_", (F.col("position") - 1 + start).cast("int"))
    ids = {c: F.format_string(f"{p}_%06d", "n_") for c, p in (("id", "human_hardneg"), ("pair_id", "pair_hardneg"), ("source_id", domain))}
    return own.withColumns({"original_id": F.col("id").cast("string"), **ids, "label": F.lit(0), "domain": F.lit(domain), "generation": F.lit("human"), "word_count": word_count("text")}).drop("position", "n_")


def teacher_like(df: DataFrame, label: int, kind: str, bucket: Column | str = "bucket") -> DataFrame:
    """Candidates of a teacher-like set, with their hard bucket as tag."""
    g = F.lit("human") if label == 0 else present("generator", "source", default="unknown_llm")
    tag = hard_bucket(F.lit(label), bucket, "domain", "prompt_type")
    return df.withColumns({
        "round2_tag": tag, "subdomain": tag, "label": F.lit(label), "text": strip(text_of("text")), "domain": present("domain", default="unknown"), "generator": g, "source": present("source", g),
        "pair_id": present(*(F.col(c).cast("string") for c in ("pair_id", "source_id", "id"))), "source_id": present(*(F.col(c).cast("string") for c in ("source_id", "id"))), "round2_source": F.lit(kind),
    })


def residual_candidates(df: DataFrame, order: list[str], name: str = "input_name", prefix: str = "round4") -> DataFrame:
    """Candidates under new ids that tell file, label and position; the old ids stay as original_id and source_pair_id."""
    own = positions(df, order).withColumn("n_", F.col("position").cast("int"))
    stem = slug(F.regexp_replace(text_of(name), r"\.[^.]*$", ""))
    b = inferred_bucket("label", "bucket", name, "round4_tag", "prompt_type", "domain")
    own = own.withColumns({"round4_bucket": b, "stem_": stem, "original_id": present(F.col("id").cast("string"), F.format_string("candidate_%d_%06d", "label", "n_")), "source_pair_id": present(F.col("pair_id").cast("string"), F.col("source_id").cast("string"), F.format_string("pair_%d_%06d", "label", "n_"))})
    tag = mirror_tag("label", "round4_bucket", "domain", "prompt_type")
    own = own.withColumns({"round4_tag": tag, "round4_source_stage": source_stage(name), "id": F.format_string(f"{prefix}_%s_%d_%06d", "stem_", "label", "n_"), "pair_id": F.concat_ws("_", F.lit(prefix), "stem_", "source_pair_id")})
    return own.withColumn("sample_weight", mirror_weight("label", "round4_bucket", "round4_tag")).drop("position", "n_", "stem_")


def overlaid(proxy: DataFrame, exact: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """proxy with the values of exact's row of the same key laid over its own, `is_exact` where there is one.

    As an override's default, a round4_pred of 0 counts as missing and becomes 1, a step7_pred that is missing 0.
    """
    other = exact.select(F.col(key).alias("k_"), F.lit(True).alias("is_exact"), *(F.col(c).alias(f"e_{c}") for c in columns))
    own = proxy.join(other, F.col(key) == F.col("k_"), "left").withColumns({c: F.coalesce(f"e_{c}", c) for c in columns})
    own = own.withColumns({"is_exact": _no(F.col("is_exact")), "round4_pred": F.coalesce(F.nullif("round4_pred", F.lit(0)), F.lit(1)), "step7_pred": F.coalesce("step7_pred", F.lit(0))})
    return own.drop("k_", *(f"e_{c}" for c in columns))


def exact_rows(df: DataFrame) -> DataFrame:
    """Exact override candidates as rows of the selector: its label is whether the override is safe."""
    own = df.where(exact_override())
    safe = F.when(F.col("flip_type") == "fixed_fn_candidate", 1).otherwise(0)
    b = present("bucket", default="unknown")
    return own.withColumns({"original_detection_label": F.coalesce("label", F.lit(-1)), "label": safe, "override_safety": safety(), "origin_split": present("split", default="unknown"), "group_key": group_key("pair_id", "source_pair_id", "source_id", "original_id", "id"), "text_key": text_key("text"), "bucket": b, "round4_bucket": b})


def mixed_rows(base: DataFrame, residual: DataFrame, order: list[str]) -> DataFrame:
    """Anchors and residual rows of one training mix, told apart by source and role; residual rows get new ids."""
    own = positions(residual, order)
    new = own.withColumn("id", F.concat(F.format_string("round8_residual_%06d_", F.col("position").cast("int")), F.col("id").cast("string"))).drop("position")
    tag = lambda df, s, r: df.withColumns({"mix_source": F.lit(s), "mix_role": F.lit(r), "sample_weight": F.coalesce("sample_weight", F.lit(1.0))})
    return tag(base.withColumn("id", F.col("id").cast("string")), "step7_base_train", "base_anchor").unionByName(tag(new, "residual_train_v1", "residual_hard_or_support"))


def guard_rows(df: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Exact flips of some splits as rows of the guard: 1 where the flip must be stopped; the detection label is kept."""
    return df.where(F.col("split").isin(*splits) & F.col("flip_type").isin(*EXACT_FLIPS)).withColumns({"original_detection_label": F.col("label"), "label": (F.col("flip_type") == "induced_fp").cast("int")})


def style_guard_rows(df: DataFrame) -> DataFrame:
    """Labelled rows with text outside the base's training: 1 for human style."""
    return df.where(valid_detection() & (text_of("round4_source_stage") != "step7_base_train")).withColumn("guard_label", 1 - F.col("label"))


def tiered(df: DataFrame, p: str = "p_step7") -> DataFrame:
    """Labelled rows with tier, hardness, whether they are of the core, and their priority (smaller first)."""
    tier = C.selection_tier("label", p)
    own = df.where(F.col("label").isin(0, 1) & F.col(p).isNotNull()).withColumns({"selection_tier": tier, "hardness_score": C.hardness_of("label", p)})
    rank = F.when(F.col("selection_tier").startswith("very_hard"), 0).when(F.col("selection_tier").startswith("hard"), 1).when(F.col("selection_tier").startswith("ambiguous"), 2).otherwise(3)
    return own.withColumns({"core": rank <= 1, "priority": rank})


def prediction_rows(df: DataFrame, order: list[str], strict: bool = False, aliases: tuple[str, ...] = ("prob_llm", "probability", "score"), threshold: float = 0.5) -> DataFrame:
    """(id, label, prediction, probability) of labelled rows; a missing id is the row's position from 0.

    The probability is the first alias that a row has, 0 where that is no number. A prediction that is none follows from it, or with `strict` drops the row.
    """
    p = F.coalesce(F.coalesce(*(F.col(a).cast("string") for a in aliases if a in df.columns)).try_cast("double"), F.lit(0.0))
    own = positions(df, order).withColumns({"probability_": p, "prediction_": binary("prediction"), "id": present(F.col("id").cast("string"), (F.col("position") - 1).cast("string")), "label": binary("label")}).where("label is not null")
    own = own.where("prediction_ is not null") if strict else own.withColumn("prediction_", F.coalesce("prediction_", (F.col("probability_") >= threshold).cast("int")))
    return own.select("id", "label", F.col("prediction_").alias("prediction"), F.col("probability_").alias("probability"))


def fused_probability(alpha: float, a: str = "p_neural", b: str = "p_tfidf", fallback: str = "probability") -> Column:
    """The weighted mean of two branches where a row has both."""
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), alpha * F.col(a) + (1 - alpha) * F.col(b)).otherwise(F.coalesce(F.col(fallback).try_cast("double"), F.lit(0.0)))


def by_position_or_id(predictions: DataFrame, raw: DataFrame, raw_order: list[str], columns: list[str]) -> DataFrame:
    """predictions with raw's columns where they have none: of the row whose id is the prediction's, else whose position (from 0) it is."""
    own = positions(raw, raw_order).withColumn("at_", (F.col("position") - 1).cast("string"))
    pick = lambda key, s: own.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(f"k{s}_")).agg(*(F.max_by(c, "position").alias(f"{s}_{c}") for c in columns), F.lit(True).alias(f"has{s}_"))
    out = predictions.join(pick("id", "i"), F.col("id") == F.col("ki_"), "left").join(pick("at_", "p"), F.col("id") == F.col("kp_"), "left")
    value = lambda c: F.coalesce(F.col(c), F.when(F.col("hasi_"), F.col(f"i_{c}")).otherwise(F.col(f"p_{c}"))) if c in predictions.columns else F.when(F.col("hasi_"), F.col(f"i_{c}")).otherwise(F.col(f"p_{c}"))
    return out.select(*(c for c in predictions.columns if c not in columns), *(value(c).alias(c) for c in columns))


def pool(rows: DataFrame, forbidden: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """rows without blank texts and texts of `forbidden`, the first of each text."""
    from textloom.operators.dedup import first_wins

    own = rows.withColumn("text_key", text_key(text)).where("text_key <> ''")
    own = own.join(forbidden.select(text_key(text).alias("text_key")).distinct(), "text_key", "left_anti")
    return first_wins(own, ["text_key"], order)


def guard_tag(label: Column | str, bucket: Column | str, domain: Column | str, prompt: Column | str) -> Column:
    """What a candidate of the precision guard mirrors, by its bucket, then domain or prompt."""
    l, b, d, p = col(label), col(bucket), text_of(domain), F.lower(text_of(prompt))
    human = (
        F.when(b == "poetry_classical", "human_poetry_classical_mirror").when(b == "poetry_freeverse", "human_poetry_freeverse_mirror").when(b == "literary_old_prose", "human_literary_old_prose_mirror")
        .when((b == "academic_formal") | (d == "academic"), "human_formal_academic_mirror").when(b == "literary_short_fragment", "human_short_fragment_mirror").otherwise("human_ornate_literary_mirror")
    )
    llm = (
        F.when((b == "poetry_classical") | F.contains(p, F.lit("archaic")), "llm_archaic_poetry_hardpos").when((b == "poetry_freeverse") | (F.lower(d) == "poetry"), "llm_poetry_preserving_hardpos")
        .when((b == "academic_formal") | (F.lower(d) == "academic"), "llm_natural_academic_hardpos").when((b == "literary_old_prose") | F.contains(p, F.lit("old")), "llm_old_fiction_style_hardpos")
        .when(b == "literary_short_fragment", "llm_short_fragment_hardpos").otherwise("llm_conservative_literary_hardpos")
    )
    return F.when(l == 0, human).otherwise(llm)


def guard_candidates(df: DataFrame, order: list[str], name: str = "input_name") -> DataFrame:
    """Candidates of the precision guard: stripped text, its own bucket, tag and weight, where they come from, and the surface features, of which those that are there win."""
    own = positions(df, order, ["label"]).withColumn("n_", F.col("position").cast("int")).withColumn("text", strip(text_of("text")))
    own = with_surface(own.drop("bucket") if "bucket" in own.columns else own)
    own = drop_parts(own)
    human, file = F.col("label") == 0, text_of(name)
    stage = F.lit("round3_local_pool")
    # the first of them that the name holds wins
    for word, value in (("hard_negative", "round3_hard_negative_pool"), ("academic", "round3_academic_mirror_pool"), ("poetry", "round3_poetry_mirror_pool"), ("round2", "round2_reused_pool")):
        stage = F.when(F.contains(file, F.lit(word)), value).otherwise(stage)
    tag = guard_tag("label", "bucket", "domain", "prompt_type")
    g = F.when(human, "human").otherwise(present("generator", "source", default="unknown_llm"))
    number = lambda f: F.format_string(f, "label", "n_")
    own = own.withColumns({"round3_tag": tag, "subdomain": tag, "round3_source": file, "round3_source_stage": stage, "generator": g})
    own = own.withColumns({
        "id": F.coalesce(present(F.trim(F.col("id").cast("string"))), number("round3_%d_%06d")), "domain": present("domain", F.when(F.col("bucket") == "academic_formal", "academic").otherwise("literature")),
        "source": present("source", "generator"), "pair_id": F.coalesce(present(F.col("pair_id").cast("string"), F.col("source_id").cast("string")), number("round3_pair_%d_%06d")),
        "sample_weight": C.sample_weight("label", "bucket", "round3_tag"),
    })
    return own.withColumn("source_id", present(F.col("source_id").cast("string"), "id")).drop("position", "n_")


def original_label(original: Column | str, label: Column | str) -> Column:
    """The label that a row had before it was turned into a question of overrides, or the one it has; null where neither is 0 or 1."""
    number = lambda c: F.when(col(c).try_cast("int").isin(0, 1), col(c).try_cast("int"))
    return F.coalesce(number(original), number(label))
