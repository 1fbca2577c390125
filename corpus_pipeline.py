"""A corpus pipeline of five stages, each of them one operator of textloom.llm over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, written
from textloom.llm.minhash import near_duplicates
from textloom.llm.mixing import mixed_documents
from textloom.llm.pieces import encode_decode
from textloom.llm.pii import redacted
from textloom.llm.toxicity import fit, passed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labels of docs, does not reject.

    Null and empty texts have the score of no finding and stay, as do repeated rows and rows without doc_id that score alike; no labels reject nothing.
    """
    return passed(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more: the one of smallest doc_id.

    Rows that repeat a doc_id and its text are one document, of which the row of the least JSON stays; texts that differ under one doc_id all stay, unless
    the doc_id goes. Rows without doc_id, and documents without words, stay. No documents are none.
    """
    found = near_duplicates(docs, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_")).where("n_ > 1").select("doc_id")
    gone, twice = written(gone, "gone"), written(twice, "twice")
    own = docs.select(F.struct(*docs.columns).alias("d_"), F.col("doc_id").cast("long").alias("i_"))
    kept = own.join(gone, F.col("i_") == gone.doc_id, "left_anti")
    once = kept.join(twice, F.col("i_") == twice.doc_id, "left_anti").select("d_")
    t = F.col("d_").getField("text").cast("string")
    again = kept.join(twice, F.col("i_") == twice.doc_id, "left_semi").groupBy("i_", F.sha2(t, 256)).agg(F.min_by("d_", F.to_json("d_")).alias("d_")).select("d_")
    return once.unionAll(again).select(*[F.col("d_").getField(c).alias(c) for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind. Null texts stay null; repeated rows and null ids are rows like others; no documents are none."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each document and pass over it, with the words taken, by shard and place.

    Null and empty texts hold no words and are not taken; a null source is a source; repeated rows are taken apart; no documents make an empty mixture.
    """
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the mixture's rows, as digests. A null text counts as empty; repeated rows and null ids are rows like others."""
    return encode_decode(docs, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Compression lengths, expectation-maximisation and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
