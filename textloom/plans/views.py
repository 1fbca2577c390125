"""The driver tables in the roles of a text corpus, in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prediction runs: p = (id * multiplier) mod modulus / modulus, the same double in every engine.
RUNS = {"step7": (7919, 10007), "tfidf": (104729, 9973), "neural": (15485863, 9901), "round4": (32452843, 9887), "guard": (49979687, 9857)}
THRESHOLD = 0.55
#: The source that a run has not scored.
LACKS = {run: f"src{k}" for k, run in enumerate(RUNS)}

CORPUS_SQL = "SELECT d.doc_id AS id, d.text, CAST(l.quality AS INT) AS label, CAST(l.toxic AS INT) AS toxic, d.lang AS domain, d.source, d.doc_id // 2 AS pair_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
REWRITES_SQL = "SELECT u.conv_id || '_' || u.turn AS task_id, u.text AS source_text, a.text AS rewrite_text, CASE u.conv_id % 2 WHEN 0 THEN 'academic' ELSE 'literature' END AS domain FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"
PREDS_SQL = (
    "SELECT id, label, domain, source, pair_id, "
    + ", ".join(f"CAST((id * {a}) % {m} AS DOUBLE) / {m} AS p_{r}" for r, (a, m) in RUNS.items())
    + f" FROM ({CORPUS_SQL}) WHERE label IS NOT NULL"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, such as one small file, dealt out to all of them; any larger one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = l.select("doc_id", F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"))
    own = spread(d.select("doc_id", "text", F.col("lang").alias("domain"), "source")).join(labels, "doc_id", "left")
    return own.select(F.col("doc_id").alias("id"), "text", "label", "toxic", "domain", "source", F.expr("doc_id div 2").alias("pair_id"))


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewrite_text"))
    both = user.join(answer, ["conv_id", "turn"])
    domain = F.when(F.col("conv_id") % 2 == 0, "academic").otherwise("literature")
    return both.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("task_id"), "source_text", "rewrite_text", domain.alias("domain"))


def probability(run: str, id_: str = "id") -> Column:
    a, m = RUNS[run]
    return (F.col(id_) * a % m).cast("double") / F.lit(float(m))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a probability from each run."""
    own = corpus(spark, sf_dir).where("label is not null").select("id", "label", "domain", "source", "pair_id")
    return own.withColumns({f"p_{r}": probability(r) for r in RUNS})


def run_of(spark: SparkSession, sf_dir: str, run: str, threshold: float = THRESHOLD) -> DataFrame:
    """One run as a table: id, label, p and pred. Each run lacks one source, so runs differ in extent."""
    own = preds(spark, sf_dir).select("id", "label", "domain", "source", F.col(f"p_{run}").alias("p"))
    return own.where(F.col("source") != LACKS[run]).withColumn("pred", (F.col("p") >= threshold).cast("int"))


def run_sql(run: str, threshold: float = THRESHOLD) -> str:
    return f"SELECT id, label, domain, source, p_{run} AS p, CAST(p_{run} >= {threshold} AS INT) AS pred FROM ({PREDS_SQL}) WHERE source <> '{LACKS[run]}'"
