"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

The documents of a source, in a hashed order, lie end to end on a line of words, and the line is cut
into blocks. A source's target fixes how many blocks it gives: whole passes over the line,
then exactly as many blocks of one further pass as the rest asks for. These quotas go down a binary
tree over the output shards: a node gives its left child half of its blocks, so many of each source as
a draw without replacement would, by inversion of the hypergeometric distribution. A shard then takes the
next blocks of each source's permutation, as many as it drew, so shards are disjoint, and orders its blocks by hash.

Every order comes from hashes of ids, so reruns agree. No step sorts a whole source: positions are
sums over buckets of about BUCKET rows plus an order within the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import forget, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 1024


def unit(*cols: Column | str) -> Column:
    """A number from 0 to below 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rank, source_size, rows, target) from (source, source_size, rows).

    Sources in code point order, null last, weigh as weights repeats. They share `share` times all sizes by
    weight; a target stops at `most` times its source's size and what it leaves goes to the others by
    weight. That ends at min(most * size, level * weight) with one level for all, found in one pass over the
    sources ordered by size to weight. A source without words has target 0.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    up = everything.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("total", total).withColumn("before", F.sum("cap").over(up) - F.col("cap")).withColumn("left", F.sum("w").over(everything) - F.sum("w").over(up) + F.col("w"))
    # the level if this source and all after it stay below their caps; it holds at the first for which it does
    level = (F.col("total") - F.col("before")) / F.col("left")
    ranked = ranked.withColumn("level", F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct(F.col("before").alias("b"), level.alias("level")))).over(everything)["level"])
    return ranked.select("source", "rank", "source_size", "rows", F.least("cap", F.coalesce("level", F.lit(float("inf"))) * F.col("w")).alias("target"))


def _split(level: int, seed: int) -> str:
    """SQL: the left child's quota of each source, drawn one source after another given what is left."""
    u = f"(shiftrightunsigned(xxhash64({seed}, {level}, node, acc.at), 11) / 9007199254740992D)"
    # q: this source's blocks, p: all blocks left, d: draws left
    ratio = "(s.q - k) * (s.d - k) / ((k + 1) * (s.p - s.q - s.d + k + 1))"
    bounds = f"""transform(array(named_struct('q', cast(q as double), 'p', cast(acc.p as double), 'd', cast(acc.d as double), 'u', {u})), s ->
        named_struct('q', s.q, 'p', s.p, 'd', s.d, 'u', s.u, 'mean', s.d * s.q / greatest(s.p, 1D), 'sd', sqrt(s.d * s.q / greatest(s.p, 1D) * (s.p - s.q) / greatest(s.p, 1D) * (s.p - s.d) / greatest(s.p - 1, 1D))))"""
    ends = f"""transform({bounds}, s -> named_struct('q', s.q, 'p', s.p, 'd', s.d, 'u', s.u,
        'lo', cast(greatest(0D, s.d - (s.p - s.q), floor(s.mean - 10 * s.sd - 1)) as bigint), 'hi', cast(least(s.q, s.d, ceil(s.mean + 10 * s.sd + 1)) as bigint)))"""
    sums = f"""transform({ends}, s -> named_struct('q', s.q, 'p', s.p, 'd', s.d, 'lo', s.lo, 'hi', s.hi, 'want', s.u * if(s.hi > s.lo,
        aggregate(sequence(s.lo, s.hi - 1), named_struct('w', 1D, 'sum', 1D), (z, k) -> named_struct('w', z.w * {ratio}, 'sum', z.sum + z.w * {ratio}), z -> z.sum), 1D)))"""
    draw = f"""transform({sums}, s -> if(s.hi > s.lo,
        aggregate(sequence(s.lo, s.hi - 1), named_struct('w', 1D, 'sum', 1D, 'x', s.lo),
            (z, k) -> named_struct('w', z.w * {ratio}, 'sum', z.sum + z.w * {ratio}, 'x', if(z.sum <= s.want, k + 1, z.x)), z -> z.x), s.lo))[0]"""
    step = f"transform(array({draw}), x -> named_struct('p', acc.p - q, 'd', acc.d - x, 'at', acc.at + 1, 'left', concat(acc.left, array(x))))[0]"
    whole = "aggregate(quotas, 0L, (a, q) -> a + q)"
    return f"aggregate(quotas, named_struct('p', {whole}, 'd', {whole} div 2, 'at', 0, 'left', cast(array() as array<bigint>)), (acc, q) -> {step}, acc -> acc.left)"


def split_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(shard, rank, first, quota): each of 2**depth shards' quota of each source, and where it begins in the source's order.

    quotas has (rank, quota), ranks from 0 without gaps. Quotas of a source add up to its own.
    """
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas")).withColumn("node", F.lit(0).cast("long"))
    for level in range(depth):
        if level and level % 4 == 0:
            node = node.repartition("node")  # sixteen times as many nodes as before: other tasks split them on
        node = node.withColumn("left", F.expr(_split(level, seed)))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("n")).select("n.*")
    out = node.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("rank", "quota"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


#: SQL: of ranges in the order of where they begin, the last that begins at the turn or before it, by halving.
_SEARCH = """element_at(ranges, aggregate(sequence(1, greatest(1, cast(ceil(log2(size(ranges) + 1)) as int))), named_struct('lo', 1, 'hi', size(ranges) + 1),
    (a, k) -> if(a.hi - a.lo <= 1, a, if(element_at(ranges, cast((a.lo + a.hi) div 2 as int)).first <= turn,
        named_struct('lo', cast((a.lo + a.hi) div 2 as int), 'hi', a.hi), named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int)))), a -> a.lo))"""


def _placed(rows: DataFrame, by: list[str], order: list[str], length: str, into: str, count: str) -> DataFrame:
    """Adds `into`: the sum of `length` over the rows before this one within `by`, ordered by `u` and then `order`. `count` holds the rows of the group."""
    rows = rows.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col(count) / BUCKET)))
    sums = rows.groupBy(*by, "bucket").agg(F.sum(length).alias("sum"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = Window.partitionBy(*by, "bucket").orderBy("u", *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum(length).over(local), F.lit(0)))
    return rows.join(sums.drop("sum"), [*by, "bucket"]).withColumn(into, F.col("base") + F.col("local")).drop("bucket", "local", "base", "u")


class Mixture:
    """docs: a row for each document, with its place; spans: what the mixture takes, shard by shard; shards: how many there are."""

    def __init__(self, docs: DataFrame, spans: DataFrame, shards: int):
        self.docs, self.spans, self.shards = docs, spans, shards


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 1024, least_blocks: int = 256, shard_words: int = 4 << 20, most_shards: int = 4096, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mixture:
    """Mixes all documents to their sources' targets.

    docs: (doc_id, source, text_hash, copy, size, source_size, target, rank, start), one row for each row of the input.
    spans: (shard, place, rank, block, pass, doc_id, source, text_hash, copy, from_word, to_word): ordered by shard and
    place they are the mixture; from_word and to_word bound the words of the document that are taken.

    A block has block_words words, or fewer where its source would have less than least_blocks of them. A null
    or empty text has size 0 and is never taken. A null source is a source, after all others. Equal
    rows (doc_id, source, text) are distinct copies, taken apart. Null ids are ids like others; no rows make an empty mixture.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(t).alias("text_hash"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = written(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("times")), "sized")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("rows"))
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / least_blocks)))
    sources = targets(sources, weights, share, most).withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round((F.col("target") - passes * F.col("source_size")) / F.col("words")).cast("long")
    sources = written(sources.withColumn("quota", passes * F.col("blocks") + rest), "sources")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    depth = max(0, min(most_shards, int(-(-total // shard_words))) - 1).bit_length()
    quotas = written(split_quotas(sources.select("rank", "quota"), depth, seed), "quotas")

    placed = rows.join(sources.drop("words", "blocks", "quota"), rows.source.eqNullSafe(sources.source)).drop(sources.source)
    placed = placed.withColumn("u", unit(F.lit(seed), "doc_id", "text_hash")).withColumn("length", F.col("size") * F.col("times"))
    placed = _placed(placed, ["rank"], ["doc_id", "text_hash"], "length", "line", "rows")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).withColumn("start", F.col("line") + F.col("copy") * F.col("size"))
    placed = written(placed.select("doc_id", "source", "text_hash", "copy", "size", "source_size", "target", "rank", "start"), "placed")

    blocks = sources.where("quota > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("blocks")))))
    # a range of blocks to a row first, so that a large source's are made by many tasks
    runs = blocks.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / BUCKET)))).select("rank", "words", "blocks", "quota", "pass", "run").repartition("rank", "pass", "run")
    drawn = runs.withColumn("block", F.explode(F.sequence(F.col("run") * BUCKET, F.least(F.col("blocks"), (F.col("run") + 1) * BUCKET) - 1)))
    drawn = drawn.withColumn("u", unit(F.lit(seed + 1), "rank", "pass", "block")).withColumn("one", F.lit(1).cast("long"))
    drawn = _placed(drawn, ["rank", "pass"], ["block"], "one", "turn", "blocks").withColumn("turn", F.col("turn") + F.col("pass") * F.col("blocks"))
    # the shard whose part of the source's order holds the turn takes the block; what no shard drew is not taken
    ranges = quotas.where("quota > 0").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "quota", "shard"))).alias("ranges"))
    drawn = drawn.join(ranges, "rank").withColumn("range", F.expr(_SEARCH)).where("range.first <= turn and turn < range.first + range.quota")
    drawn = written(drawn.select("rank", "words", "pass", "block", F.col("range.shard").alias("shard")), "drawn")

    cut = placed.where("size > 0").join(sources.select(F.col("rank").alias("r"), "words"), F.col("rank") == F.col("r")).drop("r")
    cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("words")))))
    cut = cut.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * F.col("words") - F.col("start"))).withColumn("to_word", F.least("size", (F.col("block") + 1) * F.col("words") - F.col("start")))
    taken = cut.drop("words", "size", "source_size", "target").join(drawn.drop("words"), ["rank", "block"])
    spans = taken.withColumn("place", F.xxhash64(F.lit(seed + 2), "rank", "pass", "block"))
    spans = written(spans.select("shard", "place", "rank", "block", "pass", "doc_id", "source", "text_hash", "copy", "start", "from_word", "to_word"), "spans")
    for used in (rows, sources, quotas, drawn):
        forget(used)
    return Mixture(placed, spans, 1 << depth)


def taken_words(mixture: Mixture) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard, placement, source) for every document.

    taken: the words that the mixture takes of it, repeats counted; the shards that hold them, null if none; placement:
    a digest of every shard, place and stretch of words of it, 0 if none.
    """
    digest = F.xxhash64("shard", "place", "block", "pass", "from_word", "to_word")
    taken = mixture.spans.groupBy("rank", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"), F.bit_xor(digest).alias("placement"))
    out = mixture.docs.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "at"), ["rank", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard", F.coalesce("placement", F.lit(0)).alias("placement"), "source")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", **parameters) -> DataFrame:
    """The mixture as documents, by shard and in each by place: a row with docs' columns for each document and pass over it, holding the words taken.

    A document taken whole keeps its text as it is; else its text is the words taken, in their order, with the white space after
    them; it stands where its first words are placed. `length`, where docs has that column, counts the code points of the new text. Documents of which nothing is
    taken have no row. Of rows equal in (doc_id, source, text) that differ in other columns, the one of the least JSON stands for all. Clashing names in docs do no harm: its columns travel as one struct.
    """
    mixture = mix(docs, doc_id=doc_id, text=text, source=source, **parameters)
    sizes = mixture.docs.select("rank", "start", F.col("size").alias("words")).where("words > 0")
    parts = mixture.spans.join(sizes, ["rank", "start"]).groupBy("doc_id", "source", "text_hash", "copy", "pass", "words").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("parts"), F.min(F.struct("from_word", "shard", "place")).alias("first"))
    parts = parts.groupBy("doc_id", "source", "text_hash").agg(F.collect_list(F.struct("copy", "pass", "words", "parts", F.col("first.shard").alias("shard"), F.col("first.place").alias("place"))).alias("takes"))
    own = docs.select(F.struct(*docs.columns).alias("d"))
    t = F.col("d").getField(text).cast("string")
    own = own.select("d", F.col("d").getField(doc_id).cast("long").alias("i"), F.col("d").getField(source).cast("string").alias("s"), F.xxhash64(t).alias("h"))
    again = own.groupBy("i", "s", "h").agg(F.count("*").alias("n")).where("n > 1")
    kinds = parts.withColumns({"i": F.col("doc_id"), "s": F.col("source"), "h": F.col("text_hash")}).select("i", "s", "h", "takes")
    both = own.join(kinds, own.i.eqNullSafe(kinds.i) & own.s.eqNullSafe(kinds.s) & own.h.eqNullSafe(kinds.h)).select(own.i, own.s, own.h, "d", "takes")
    # equal rows are taken apart but joined alike: one of them stands for all
    both = both.join(again.select(F.col("i").alias("i2"), F.col("s").alias("s2"), F.col("h").alias("h2"), "n"), F.col("i").eqNullSafe(F.col("i2")) & F.col("s").eqNullSafe(F.col("s2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    single = both.where("n is null").select("d", "takes")
    multiple = both.where("n is not null").groupBy("i", "s", "h").agg(F.min_by("d", F.to_json("d")).alias("d"), F.first("takes").alias("takes")).select("d", "takes")
    out = single.unionAll(multiple).select("d", F.explode("takes").alias("t"))
    words = F.regexp_extract_all(F.col("d").getField(text).cast("string"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    slices = F.flatten(F.transform("t.parts", lambda p: F.slice(F.col("w"), (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int"))))
    whole = F.aggregate("t.parts", F.lit(0).cast("long"), lambda a, p: a + p["to_word"] - p["from_word"]) == F.col("t.words")
    out = out.withColumn("whole", whole).withColumn("w", F.when(~F.col("whole"), words)).withColumn("x", F.when(F.col("whole"), F.col("d").getField(text)).otherwise(F.array_join(slices, "")))
    # as many tasks as shards, so that a task holds few, however many there are
    out = out.repartition(mixture.shards, "t.shard").sortWithinPartitions("t.shard", "t.place", "t.copy", "t.pass")
    new = {text: F.col("x")} | ({length: F.length("x").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col("d").getField(c).alias(c) for c in docs.columns])
