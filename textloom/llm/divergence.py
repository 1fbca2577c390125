"""How far sources of a language differ in their terms: dense group-by-term tiles of exact integers, all pairs of sources in each."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

#: Runs of letters, in UTF-8: ASCII ones and every character beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Distinct terms by source that a task keeps before it gives out their counts; it looks after every two million words.
ENTRIES = 300_000
#: Counts of a tile, and sums of a matrix of pairs, that a task holds at a time.
TILE, MATRIX = 1 << 16, 1 << 22
SCALE = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each source in a task, given out whenever they or the texts read for them grow large."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (tf, df) in found.items():
            words = list(tf)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                n = len(some)
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(some).cast(pa.string()), pa.array([tf[w] for w in some]), pa.array([df[w] for w in some])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(k) for k in range(3)), strict=True):
            # on UTF-8, lower() changes A-Z alone
            words = TERM.findall(text.as_buffer().to_pybytes().lower())
            tf, df = found.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            tf.update(words)
            df.update(set(words))
            held += len(words)
            if held > 2_000_000:
                if sum(len(t) for t, _ in found.values()) > ENTRIES:
                    yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a source, and the documents that hold it. Nulls count as empty."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("text", text), ("lang", lang), ("source", source))))
    parts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), by long division, three digits at a time: totals may come near 2**53."""
    left, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        digit = left // total
        left -= digit * total
        out = out * 1000 + digit
    return out + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """((lang, slab, block), rows) of each block, whose rows follow each other."""
    key, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        lang = batch.column("lang").to_numpy(zero_copy_only=False)
        slab, block = batch.column("slab").to_numpy(), batch.column("block").to_numpy()
        new = np.r_[True, (lang[1:] != lang[:-1]) | (slab[1:] != slab[:-1]) | (block[1:] != block[:-1])]
        at = np.flatnonzero(new)
        for a, b in zip(at, [*at[1:], len(batch)], strict=True):
            k = (lang[a], int(slab[a]), int(block[a]))
            if k != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = k
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


class _Slab:
    """Sums of pairs and heaps of terms of some of a language's sources, over the blocks of terms that a task meets."""

    def __init__(self, lang: str, sources: list[str], low: int, high: int, top: int):
        self.lang, self.sources, self.low, self.high, self.top = lang, sources, low, high, top
        self.pairs = np.zeros((high - low, len(sources)), np.int64)
        self.heaps: list[list[tuple[int, str]]] = [[] for _ in range(low, high)]

    def add(self, count: np.ndarray, p: np.ndarray, q: np.ndarray, terms: list[str]) -> None:
        for i in range(self.low, self.high):
            d = p[i] - p
            self.pairs[i - self.low] += (d * d // p).sum(axis=1)
            over = p[i] - q
            at = np.flatnonzero((count[i] > 0) & (over > 0))
            value = over[at] * over[at] // q[at]
            # terms come in order, so a stable sort leaves ties in it
            best = np.argsort(-value, kind="stable")[: self.top]
            mine = [(-int(value[k]), terms[at[k]]) for k in best]
            self.heaps[i - self.low] = heapq.nsmallest(self.top, [*self.heaps[i - self.low], *mine])

    def rows(self) -> Iterator[tuple]:
        for i, (sums, heap) in enumerate(zip(self.pairs.tolist(), self.heaps, strict=True)):
            own = self.sources[self.low + i]
            for j, value in enumerate(sums):
                if j != self.low + i:
                    yield self.lang, own, "pair", self.sources[j], value
            for value, term in heap:
                yield self.lang, own, "term", term, -value


def _tiles(slab_rows: int, top: int):
    """The task: blocks in, partial sums of pairs and best terms out."""
    names = ["lang", "source", "part", "item", "value"]
    types = [pa.string()] * 4 + [pa.int64()]

    def out(slab: _Slab | None) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in slab.rows() if slab else ():
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, at = None, None
        for (lang, number, _), rows in _runs(batches):
            is_term = rows.column("kind").to_numpy() == 1
            groups = rows.filter(pa.array(~is_term))
            sources = groups.column("key").to_pylist()
            if at != (lang, number):
                yield from out(slab)
                slab, at = None, (lang, number)
            low, high = number * slab_rows, min(len(sources), (number + 1) * slab_rows)
            if low >= high:
                continue
            slab = slab or _Slab(lang, sources, low, high, top)
            some = rows.filter(pa.array(is_term))
            if not len(some):
                continue
            kept, in_lang, in_group = groups.column("kept")[0].as_py(), groups.column("total")[0].as_py(), groups.column("n").to_numpy()
            cells = some.column("cells").combine_chunks()
            column = np.repeat(np.arange(len(some)), pc.list_value_length(cells).to_numpy())
            flat = cells.flatten()
            row = pc.index_in(flat.field("source"), value_set=pa.array(sources, flat.field("source").type)).to_numpy()
            count = np.zeros((len(sources), len(some)), np.int64)
            count[row, column] = flat.field("n").to_numpy()
            slab.add(count, _p(count, (in_group + kept)[:, None]), _p(some.column("n").to_numpy(), np.int64(in_lang + kept)), some.column("key").to_pylist())
        yield from out(slab)

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, tile: int = TILE, matrix: int = MATRIX) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from each other one, and its `top` terms over the language.

    A language keeps the terms (runs of letters, A-Z in lower case) that least_docs of its documents hold. With p = 1 + floor(1e9 * (count + 1) /
    (all + kept terms)) of a term in a source or a language, a difference is floor((p - q) ** 2 / q): summed over all kept terms for a pair of
    sources, q the other's; for a term that the source has and p > q, q the language's. All arithmetic is exact in 64 bits: p adds up to 1e9 and
    the number of terms, so a sum stays under 2 ** 63 with two thousand million kept terms.

    Null text, language and source count as ''; every row is a document, repeated ones too. Sources without terms have pairs; a language without
    kept terms has pairs of value 0; a language of one source has no rows. Ties go to the smaller item in UTF-8. No documents give no rows.

    A row for each kept term carries its counts by source, as many as the language has sources. Terms are hashed to blocks, so that a tile of all
    sources by a block's terms has about `tile` counts; a task sums the pairs of its blocks in a matrix of at most `matrix` sums, with more sources
    than that holds in slabs of rows, and keeps the best terms of each source. Sums and best terms of tasks are then put together by Spark. The
    result itself has a row for each pair of sources in a language.
    """
    spark = docs.sparkSession
    counts = term_counts(docs, text, lang, source)
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    terms = written(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(own(lang).alias("lang"), own(source).alias("source")).distinct()
    sums = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "total", "kept")))
    groups = written(groups, "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("g"), F.max("kept").alias("kept")).agg(F.max("g"), F.max(F.ceil(F.col("g") * F.col("kept") / tile))).first()
    slab_rows = max(1, matrix // (most[0] or 1))
    slabs, blocks = -(-(most[0] or 1) // slab_rows), max(1, most[1] or 1)

    slab = F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab")
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    tall = terms.select("lang", block, F.lit(1).alias("kind"), F.col("term").alias("key"), "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kept"), "cells")
    # each block starts with the language's sources; block 0 is there for languages without terms too
    met = terms.select("lang", block).distinct().unionAll(groups.select("lang", F.lit(0).cast("long")).distinct()).distinct()
    head = met.join(groups, "lang").select("lang", "block", F.lit(0).alias("kind"), F.col("source").alias("key"), "n", "total", "kept", F.lit(None).cast(terms.schema["cells"].dataType).alias("cells"))
    rows = tall.unionByName(head).select("*", slab).repartition("lang", "slab", "block").sortWithinPartitions("lang", "slab", "block", "kind", "key")
    parts = written(rows.mapInArrow(_tiles(slab_rows, top), "lang string, source string, part string, item string, value long"), "divergence")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best)


#: The query's rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS ln FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (ln + 1)) // (sum(ln) OVER w + count(*) OVER w) AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
