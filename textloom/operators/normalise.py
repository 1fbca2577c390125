"""Canonical projections of corpus rows, candidates and prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import taxonomy as C
from textloom.functions.text import col, contains_any, text_of
from textloom.operators.order import positions


def present(*columns: Column | str, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    some = [F.when(col(c).cast("string") != "", col(c)) for c in columns]
    return F.coalesce(*some, F.lit(default)) if default is not None else F.coalesce(*some)


def first_value(df: DataFrame, keys: list[str], default: str = "", metadata: str = "metadata") -> Column:
    """The first of keys that a row, or its metadata map, has; each key is looked for in both before the next."""
    where = []
    for k in keys:
        where += [F.col(k)] if k in df.columns else []
        where += [F.col(metadata)[k]] if metadata in df.columns else []
    return present(*where, default=default)


def _or(df: DataFrame, name: str, default: Column | str) -> Column:
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.col(name).cast("string"), d) if name in df.columns else d


def human_rows(df: DataFrame) -> DataFrame:
    """Human rows as corpus rows: label 0, themselves their source."""
    own = [F.col("id").cast("string").alias("id"), "text", F.lit(0).alias("label"), _or(df, "domain", "unknown").alias("domain"), _or(df, "source", "unknown").alias("source")]
    fixed = [F.lit("human").alias(c) for c in ("generator", "model")]
    return df.select(*own, *fixed, F.col("pair_id").cast("string").alias("pair_id"), F.col("id").cast("string").alias("source_id"), F.lit("human").alias("prompt_type"), F.lit("human").alias("generation"))


def llm_rows(df: DataFrame) -> DataFrame:
    """Rewrites as corpus rows: label 1; source and generator stand in for each other."""
    null = F.lit(None).cast("string")
    source, generator = (F.col(c).cast("string") if c in df.columns else null for c in ("source", "generator"))
    return df.select(
        F.col("id").cast("string").alias("id"), "text", F.lit(1).alias("label"), _or(df, "domain", "unknown").alias("domain"), F.coalesce(source, generator, F.lit("unknown")).alias("source"), F.coalesce(generator, source, F.lit("unknown")).alias("generator"),
        _or(df, "model", "unknown").alias("model"), F.col("pair_id").cast("string").alias("pair_id"), _or(df, "source_id", null).alias("source_id"), _or(df, "prompt_type", "unknown").alias("prompt_type"), _or(df, "generation", "llm_rewrite").alias("generation"),
    )


def renumbered(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """New ids by position, the old one kept as original_id."""
    own = positions(df.withColumn("original_id", F.col("id").cast("string")), order)
    return own.withColumn("id", F.format_string(f"human_{prefix}_%06d", F.col("position").cast("int"))).drop("position")


def tagged(df: DataFrame, label: int, tag: str, source: str) -> DataFrame:
    """Candidates with a tag, their bucket's weight and where they come from."""
    own = df.withColumns({"label": F.lit(label), "tag": F.lit(tag), "candidate_source": F.lit(source)})
    return own.withColumn("sample_weight", C.sample_weight("label", "bucket", "tag"))


def hard_bucket(label: Column | str, bucket: Column | str, domain: Column | str, prompt: Column | str) -> Column:
    b, d, p = col(bucket), text_of(domain), text_of(prompt)
    human = (
        F.when(b == "poetry_classical", "classical_poetry_human").when(b == "poetry_freeverse", "modern_freeverse_human").when((b == "academic_formal") | (d == "academic"), "formal_academic_human")
        .when(b == "literary_short_fragment", "short_fragment_human").otherwise("ornate_literary_prose_human")
    )
    has = lambda s: F.contains(p, F.lit(s))
    llm = (
        F.when((d == "academic") | has("academic"), "chatgpt_natural_academic")
        .when((d == "poetry") | has("poetry"), F.when(has("archaic") | (b == "poetry_classical"), "chatgpt_archaic_poetry").otherwise("chatgpt_poetry_conservative"))
        .when(has("archaic"), "chatgpt_old_fiction").otherwise("chatgpt_conservative_literary")
    )
    return F.when(col(label) == 0, human).otherwise(llm)


def inferred_bucket(label: Column | str, bucket: Column | str, *signals: Column | str) -> Column:
    """The bucket, or old prose where the row's signals say so."""
    s = F.lower(F.concat_ws(" ", *(text_of(x) for x in signals)))
    old = ((col(label) == 0) & contains_any(s, ["round4_old_prose_human_mirror_candidates", "short_polished_or_archaic_literary_prose"])) | ((col(label) == 1) & contains_any(s, ["old_fiction", "old_prose", "old-prose", "older literary fiction"]))
    return F.when(old, "literary_old_prose").otherwise(col(bucket))


def expanded(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """A row for each prompt bucket that a source serves: two of them serve a second."""
    b = F.col(bucket)
    more = F.when(b == "chatgpt_conservative_literary", F.array(b, F.lit("chatgpt_old_fiction"))).when(b == "chatgpt_poetry_freeverse", F.array(b, F.lit("chatgpt_archaic_poetry"))).otherwise(F.array(b))
    return df.withColumn(bucket, F.explode(more))


def row_weight(weights: dict[str, float], base: Column | str = "sample_weight", label: str = "label", *keys: str) -> Column:
    """A row's weight (null or 0 count as 1) times the weights of its label and of each key's value that has one."""
    if not weights:
        return F.coalesce(F.when(col(base) != 0, col(base)), F.lit(1.0))
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    out = F.coalesce(F.when(col(base) != 0, col(base)), F.lit(1.0)) * F.coalesce(F.element_at(table, F.concat(F.lit("label_"), F.col(label).cast("string"))), F.lit(1.0))
    for k in keys:
        out = out * F.coalesce(F.element_at(table, text_of(k)), F.lit(1.0))
    return out


def enriched(df: DataFrame, p: str = "p_step7", label: str = "label", threshold: float = 0.55, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Scored rows with correctness, zone, bin and hardness flags; an unlabelled row has no correctness and is never hard."""
    q, y = F.col(p), F.col(label)
    known = F.coalesce(y.isin(0, 1), F.lit(False))
    no = F.lit(False)
    return df.withColumns({
        "step7_pred": (q >= threshold).cast("int"), "step7_correct": F.when(known, (q >= threshold).cast("int") == y), "ambiguous_zone": q.between(low, high), "step7_probability_bucket": C.probability_bucket(q),
        "hard_human_candidate": F.coalesce((y == 0) & (q >= 0.55), no), "very_hard_human_candidate": F.coalesce((y == 0) & (q >= 0.65), no), "hard_llm_candidate": F.coalesce((y == 1) & (q <= 0.45), no), "very_hard_llm_candidate": F.coalesce((y == 1) & (q <= 0.35), no),
    })


def ledger(df: DataFrame, threshold: float = 0.55, p: str = "p", label: str = "label") -> DataFrame:
    """Errors with kind, margin, confidence and notes."""
    q, y = F.col(p), F.col(label)
    kind = F.when((y == 0) & (q >= threshold), "false_positive").when((y == 1) & (q < threshold), "false_negative")
    out = df.withColumn("error_type", kind).where("error_type is not null").withColumn("margin", F.abs(q - threshold)).withColumn("confidence_bucket", C.confidence_bucket(q, threshold))
    return out.withColumn("notes", F.array_join(F.array_compact(F.array(F.when(F.col("margin") <= 0.05, "near threshold"), F.when(F.col("margin") >= 0.35, "confident error"))), ";"))
