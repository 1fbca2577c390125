"""Readers of record files: line JSON, JSON containers, text folders, run specifications."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORPUS = "id STRING, text STRING, label INT, domain STRING, source STRING, generator STRING, model STRING, pair_id STRING, source_id STRING, prompt_type STRING, generation STRING, finish_reason STRING, split STRING"
PREDICTION = "id STRING, label INT, prediction INT, prob_llm DOUBLE, probability DOUBLE, score DOUBLE, domain STRING, generator STRING, source STRING, pair_id STRING, bucket STRING"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def lines(spark: SparkSession, paths: str | list[str], schema: str = CORPUS, strict: bool = False, origin: str | None = None) -> DataFrame:
    """Line JSON, gzip or not. Strict fails on a bad line; else bad lines are skipped, and paths that do not exist read as no rows.

    `origin` names a column for the file a row stands in.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
        return df.withColumn(origin, F.col("_metadata.file_path")) if origin else df
    there = [p for p in paths if exists(spark, p)]
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not there:
        kind = StructType(kind.fields + ([StructField(origin, StringType())] if origin else []))
        return spark.createDataFrame([], kind)
    df = spark.read.schema(kind).option("mode", "DROPMALFORMED").json(there)
    return df.withColumn(origin, F.col("_metadata.file_path")) if origin else df


def numbered_lines(spark: SparkSession, paths: str | list[str], schema: str = CORPUS, strict: bool = False, observed: Observation | None = None) -> DataFrame:
    """(file, line, record) of line JSON: the line's number in its file from 1 on, blank and bad lines counted, though the file is read in many ranges.

    A range's lines are numbered in its task; its first number is the count of lines in the file's ranges before it, so the only table besides the scan
    has a row for each range. Blank lines are left out. Bad ones, which are no JSON object, are left out and counted in `observed` (lines, bad);
    in strict mode the first that a task meets ends the job, with its file and number.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("at_"))
    blocks = raw.groupBy("file", "block_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.sum("n_").over(Window.partitionBy("file").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block_", "n_", "first_", F.coalesce(before, F.lit(0)).alias("base_"))
    within = F.col("at_") - F.col("first_")
    # both scans deal the same ranges to the same tasks; were that ever not so, no number would be given
    line = F.when(within.between(0, F.col("n_") - 1), F.col("base_") + within + 1).otherwise(F.raise_error(F.lit("ranges of a file changed while it was read")).cast("long"))
    own = raw.join(blocks, ["file", "block_"]).where(F.trim("value") != "").select("file", line.alias("line"), "value")
    record = F.from_json("value", StructType.fromDDL(schema))
    bad = F.try_parse_json("value").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    if observed is not None:
        own = own.observe(observed, F.count("*").alias("lines"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad"))
    if strict:
        return own.select("file", "line", F.when(bad, F.raise_error(F.concat(F.lit("no JSON object in line "), F.col("line").cast("string"), F.lit(" of "), F.col("file")))).otherwise(record).alias("record"))
    return own.where(~bad).select("file", "line", record.alias("record"))


def bad_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, bad): lines that are no JSON object, by file; blank lines are none."""
    own = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    return own.where(bad).groupBy("file").agg(F.count("*").alias("bad"))


def containers(spark: SparkSession, paths: str | list[str], record: str = CORPUS, keys: tuple[str, ...] = ("data", "samples", "records", "items")) -> DataFrame:
    """Records of whole-file JSON: a list, or an object with a list under the first of the keys that it has. A task holds one file at a time, whole."""
    raw = spark.read.text(paths, wholetext=True)
    listed = F.from_json("value", F.lit(f"array<struct<{_struct(record)}>>"))
    held = F.from_json("value", F.lit("struct<" + ", ".join(f"{k}: array<struct<{_struct(record)}>>" for k in keys) + ">"))
    start = F.regexp_extract("value", r"^\s*([\[{])", 1)
    return raw.select(F.when(start == "[", listed).otherwise(F.coalesce(*(held[k] for k in keys))).alias("r")).select(F.inline("r"))


def _struct(ddl: str) -> str:
    return ", ".join(re.sub(r"^(\w+)\s+", r"\1: ", c.strip()) for c in ddl.split(","))


def records(spark: SparkSession, path: str, schema: str = CORPUS, strict: bool = False) -> DataFrame:
    """By suffix: line JSON for .jsonl and .jsonl.gz, containers for .json, Parquet and CSV."""
    if path.endswith((".jsonl", ".jsonl.gz", ".ndjson")):
        return lines(spark, path, schema, strict)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return containers(spark, path, schema)


def labelled(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.where(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.trim(text) != ""))


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".json", ".jsonl", ".json.gz", ".jsonl.gz"), skip: tuple[str, ...] = ("readme", "dataset_infos"), most: int | None = None) -> DataFrame:
    """(path, bytes) of a folder's files of these suffixes, at any depth, by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    keep = name.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")
    for s in skip:
        keep = keep & ~F.contains(name, F.lit(s))
    out = found.where(keep).orderBy("path")
    return out.limit(most) if most else out


def books(spark: SparkSession, folder: str, metadata: str | None = None) -> DataFrame:
    """(file, text) of a folder's .txt files, with the metadata record whose local_path has the same name."""
    own = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    if not metadata:
        return own
    info = containers(spark, metadata, "gutenberg_id INT, title STRING, authors array<string>, text_url STRING, local_path STRING")
    info = info.withColumn("name_", F.regexp_extract("local_path", r"([^/\\]+)$", 1))
    return own.join(info, F.col("file") == F.col("name_"), "left").drop("name_")


def plain_text_url(formats: str = "formats"):
    """Of a map of types to addresses, the best plain-text one: UTF-8 first, no readme."""
    rows = F.filter(F.map_entries(formats), lambda e: F.startswith(e["key"], F.lit("text/plain")) & ~F.contains(F.lower(e["value"]), F.lit("readme")))
    ranked = F.array_sort(F.transform(rows, lambda e: F.struct(F.when(F.contains(e["value"], F.lit(".utf-8")), 0).otherwise(1).alias("k"), e["value"].alias("url"))))
    return F.get(ranked, F.lit(0))["url"]


def predictions(df: DataFrame, aliases: tuple[str, ...] = ("prob_llm", "probability", "score"), threshold: float = 0.5) -> DataFrame:
    """Canonical predictions: id (a missing one is its position), label, prediction, probability; unlabelled rows go.

    The probability is the first alias that has a value, 0 where none has; a missing prediction follows from it.
    """
    p = F.coalesce(*(F.col(a).try_cast("double") for a in aliases if a in df.columns), F.lit(0.0))
    pred = F.coalesce(*(F.col(c).try_cast("int") for c in ("prediction", "pred", "label_pred") if c in df.columns), (p >= threshold).cast("int"))
    own = df.where(F.col("label").isin(0, 1)).withColumns({"probability_": p, "prediction_": pred})
    if "id" not in df.columns:
        own = own.withColumn("id", F.monotonically_increasing_id().cast("string"))
    rest = [c for c in ("domain", "generator", "source", "pair_id", "bucket") if c in df.columns]
    return own.select(F.col("id").cast("string").alias("id"), "label", F.col("prediction_").alias("prediction"), F.col("probability_").alias("probability"), *rest)


def parse_run(spec: str) -> tuple[str, str]:
    """NAME=PATH."""
    name, sep, path = spec.partition("=")
    if not sep or not name.strip() or not path.strip():
        raise ValueError(f"expected NAME=PATH, got {spec!r}")
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_"), path.strip()


def parse_limits(spec: str) -> dict[str, int]:
    """`a=3,b:4` as a mapping."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"([^=:]+)[=:]\s*(-?\d+)", part)
        if not m:
            raise ValueError(f"expected NAME=NUMBER, got {part!r}")
        out[m[1].strip()] = int(m[2])
    return out


def parse_split(values: list[str], required: tuple[str, ...] = ()) -> tuple[str, dict[str, str]]:
    """SPLIT NAME=PATH...: the split and its runs, of which the required ones must be there."""
    if len(values) < 2:
        raise ValueError("expected SPLIT followed by NAME=PATH")
    runs = {}
    for v in values[1:]:
        name, sep, path = v.partition("=")
        if not sep:
            raise ValueError(f"expected NAME=PATH, got {v!r}")
        runs[name.strip()] = path.strip()
    missing = sorted(set(required) - set(runs))
    if missing:
        raise ValueError(f"{values[0]} lacks {missing}")
    return values[0], runs


def rewrite_inputs(spark: SparkSession, folder: str, first: tuple[str, ...] = ()) -> list[str]:
    """The files of `first` that a folder has, then its llm_rewrite*.jsonl by name, without failed ones; each once. Only names are listed."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.jsonl")) or []
    names = sorted(s.getPath().getName() for s in found)
    own = [n for n in first if n in names] + [n for n in names if n.startswith("llm_rewrite") and "failed" not in n.lower()]
    return list(dict.fromkeys(own))


def any_json(spark: SparkSession, paths: str | list[str], record: str = CORPUS) -> DataFrame:
    """Records of files that each hold one JSON object, a list of them, or a line each; what is no object is skipped."""
    raw = spark.read.text(paths, wholetext=True).select(F.trim("value").alias("v"))
    own = F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != "")
    # a parser stops at a value's end, so a first line that is one tells a file of lines
    whole = F.try_parse_json("v").isNotNull() & ~((F.size(own) > 1) & F.try_parse_json(F.get(own, F.lit(0))).isNotNull())
    one = F.when(F.startswith("v", F.lit("{")), F.array("v")).otherwise(F.from_json("v", F.lit("array<string>")))
    split = F.filter(F.split("v", r"\r?\n"), lambda x: F.startswith(F.trim(x), F.lit("{")) & F.try_parse_json(x).isNotNull())
    rows = raw.select(F.explode(F.when(whole, one).otherwise(split)).alias("r")).where(F.startswith(F.trim("r"), F.lit("{")))
    return rows.select(F.from_json("r", F.lit(f"struct<{_struct(record)}>")).alias("s")).select("s.*")
