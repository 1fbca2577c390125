"""The training-data queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.ann import nearest_neighbours
from textloom.llm.common import spread, table
from textloom.llm.divergence import SQL as DIVERGENCE_SQL
from textloom.llm.divergence import source_divergence
from textloom.llm.html import extract
from textloom.llm.lines import SQL as LINES_SQL
from textloom.llm.lines import drop_repeated_lines
from textloom.llm.minhash import near_duplicates
from textloom.llm.mixing import mix, taken_words
from textloom.llm.pii import personal_data
from textloom.llm.pieces import encode_decode
from textloom.llm.pq import near_duplicate_vectors
from textloom.llm.sharding import compacted
from textloom.llm.tokens import round_trip
from textloom.llm.toxicity import fit, score
from textloom.llm.whitening import whiten


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compacted(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(spread(docs), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents"))).drop("source")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spread(table(spark, sf_dir, "documents")))


def op7_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spread(table(spark, sf_dir, "documents")), keep=False)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), percent=85)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spread(table(spark, sf_dir, "embeddings"))).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_repeated_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spread(table(spark, sf_dir, "documents").select("text", "lang", "source")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_sharding": op2_sharding,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_personal_data": op6_personal_data,
    "op7_vector_near_dedup": op7_vector_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}
SQL: dict[str, str] = {
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op12_line_dedup": LINES_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
