"""Lines that repeat across documents: exploded, hashed, counted by document, dropped, and texts put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is hot if it has this part of all repeats or more; so no more lines than this are hot, and they are broadcast.
HOT = 4096


def folded(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hashed(docs: DataFrame, id_: str, text: str, least_chars: int) -> DataFrame:
    """(i_, t_, pos, a_, b_) of each line of least_chars code points or more without white space at its ends; t_ tells texts of one id apart, a_ and b_ are 128 bits of the line."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_).alias("i_"), F.xxhash64(own).alias("t_"), F.posexplode(F.split(own, "\n", -1)).alias("pos", "line"))
    bare = lines.select("i_", "t_", "pos", F.btrim("line", F.lit(SPACE)).alias("bare")).where(F.length("bare") >= least_chars)
    keyed = bare.select("i_", "t_", "pos", folded(F.col("bare")).alias("key"))
    return keyed.select("i_", "t_", "pos", F.xxhash64("key").alias("a_"), F.xxhash64(F.lit("line"), "key").alias("b_"))


def drop_repeated_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", least_chars: int = 10, least_docs: int = 2, hot: int = HOT) -> DataFrame:
    """docs with `text` less its repeated lines, n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. All lines whose key has least_chars code points and is found in
    least_docs documents are dropped, except those of the smallest id that has it. Keys are compared by 128 bits of hash.

    Rows of one id are one document: a line is not repeated by them, and is kept or dropped in all of them alike. Rows without id are one document
    that comes after all others. A null or empty text is one empty line. No documents give no rows; n_lines and n_dropped replace columns so named.

    Only hashes, ids and positions of lines are shuffled to find what is dropped, then whole texts once, by id. A line in very many documents is
    counted by partial sums and found again by broadcast; there are `hot` such lines at most.
    """
    lines = _hashed(docs, id_, text, least_chars)
    counts = lines.groupBy("a_", "b_", "i_").agg(F.lit(1).alias("one_")).groupBy("a_", "b_").agg(F.count("*").alias("n_"), F.min("i_").alias("keeper_"))
    counts = written(counts.where(F.col("n_") >= least_docs), "lines")
    repeats = counts.agg(F.sum("n_")).first()[0] or 0
    is_hot = F.col("n_") * hot >= repeats
    some = F.broadcast(counts.where(is_hot).select("a_", "b_", F.col("keeper_").alias("hot_"), F.lit(True).alias("in_hot_")))
    rest = counts.where(~is_hot).select(F.col("a_").alias("c_"), "b_", F.col("keeper_").alias("cold_"), F.lit(True).alias("in_cold_"))
    found = lines.join(some, ["a_", "b_"], "left")
    # a hot line needs no partner any more, so it goes anywhere
    found = found.withColumn("c_", F.when(F.col("in_hot_"), F.xxhash64("i_", "t_", "pos")).otherwise(F.col("a_"))).join(rest, ["c_", "b_"], "left")
    gone = found.where((F.col("in_hot_") & ~F.col("i_").eqNullSafe(F.col("hot_"))) | (F.col("in_hot_").isNull() & F.col("in_cold_") & ~F.col("i_").eqNullSafe(F.col("cold_"))))
    gone = gone.groupBy(F.col("i_").alias("j_"), F.col("t_").alias("u_")).agg(F.sort_array(F.collect_set("pos")).alias("gone_"))

    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(F.lit(0).alias("none_"), *others).alias("d_"), F.col(id_).alias("i_"), F.xxhash64(own).alias("t_"), F.split(own, "\n", -1).alias("lines_"))
    rows = rows.join(gone, rows.i_.eqNullSafe(gone.j_) & (rows.t_ == gone.u_), "left")
    n, none = F.size("lines_"), F.array().cast("array<int>")
    # what stays lies between one dropped line and the next
    rows = rows.select("d_", "lines_", n.alias("n_"), F.concat(F.array(F.lit(-1)), F.coalesce("gone_", none), F.array(n)).alias("edges_"))
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size("edges_") - 1), lambda k: F.slice("lines_", F.get("edges_", k - 1) + 2, F.get("edges_", k) - F.get("edges_", k - 1) - 1)))
    rows = rows.select("d_", F.when(F.size("edges_") == 2, F.col("lines_")).otherwise(stay).alias("stay_"), F.col("n_").cast("long").alias("n_lines"), (F.size("edges_") - 2).cast("long").alias("n_dropped"))
    kept = F.array_join("stay_", "\n")
    return rows.select(*(kept.alias(c) if c == text else F.col("d_").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


#: The query's rows in DuckDB: documents of unique ids.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), counts AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM keyed l LEFT JOIN counts c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
