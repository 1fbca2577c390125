"""Token files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart.

A file holds consecutive documents in ascending doc_id order. Ids are replaced by their rank in
the corpus (0 the most frequent), so that nearly all fit one or two bytes. Four values share one
control byte of four two-bit lengths; control bytes and data bytes stand in separate streams, as in
Lemire, Kurz and Rupp, "Stream VByte" (2018). The decoder looks each control byte up in a table of
four lengths and gathers all values of a file at once.

File: magic `TLVB`, version (u32), documents (u64), values (u64), then doc_ids (i64 each), lengths (u32
each), control bytes ((values + 3) // 4), data bytes. All little-endian. The folder also has
`ranks`, the ids in rank order as unsigned 32-bit integers, and the table `_segments` of
(segment, file, documents, values, first value), written last: a folder without it is not complete.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import forget, scratch, small_batches, written

MAGIC, VERSION = b"TLVB", 1
#: Ids to a file, about; a longer document is still whole in one.
SEGMENT_VALUES = 4 << 20
#: Stretches end where the library's pattern must end one: before white space, and between a letter and an ASCII
#: character that is neither letter nor apostrophe.
_SPLIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[!-&(-@\[-`{-~])| ?\S+|\s+(?!\S)|\s+")
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ID = attrgetter("id")
_ODD = "\x1c\x1d\x1e\x1f"
CACHE_CHUNKS, CACHE_CHARS = 600_000, 64


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    length = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = length - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control, values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]


#: Lengths of the four values of every control byte.
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values: lengths from the table, then each of the up to four bytes gathered for all values at once."""
    length = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder(dict):
    """Stretches of text and their ids as bytes, from the tokenizers library, asked once for each stretch that is not known.

    Its byte-level pattern never joins what `_SPLIT` parts, so a text's ids are those of its stretches end
    to end. Texts with one of its special tokens, or with a separator on which regular-expression engines
    differ, go to it whole. A stretch of letters is one word of the pattern: of the library, its model alone is asked for it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + list(_ODD)
        self.model = self.tokenizer.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = "".join(chr(b if b in plain else next(others)) for b in range(256))

    def _ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        if _LETTERS.fullmatch(stretch):
            word = charmap_decode(stretch.encode(), "strict", self.letters)[0]
            ids = array("I", map(_ID, self.model.tokenize(word))).tobytes()
        else:
            ids = self._ask(stretch)
        if len(stretch) <= CACHE_CHARS:
            self[stretch] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > CACHE_CHUNKS:
            # stretches met first are the frequent ones
            for stretch in list(islice(self, CACHE_CHUNKS // 3, None)):
                del self[stretch]
        of = self.__getitem__
        return [np.frombuffer(self._ask(t) if any(w in t for w in self.whole) else b"".join(map(of, _SPLIT.findall(t))), np.uint32) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, whose tasks share its cache."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


_CHUNK = "first_doc long, last_doc long, documents long, n_values long, docs binary, sizes binary, ids binary, counts binary"


def _encoded(path: str, end: int, segment_values: int):
    """A task's documents, which come in order, as rows of up to segment_values ids, each with its ids' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        wide = "<u2" if e.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        docs: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            sizes = np.array([len(p) for p in parts], "<u4")
            flat = np.concatenate(parts)
            times = np.bincount(flat)
            seen = np.flatnonzero(times)
            row = [docs[0], docs[-1], len(docs), len(flat), np.array(docs, "<i8").tobytes(), sizes.tobytes(), flat.tobytes(), np.stack([seen, times[seen]]).astype("<i8").tobytes()]
            docs.clear(), parts.clear()
            held = 0
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 1 << 20 and to - at < 4096:
                    size += len(texts[to] or "")
                    to += 1
                for d, own in zip(ids[at:to], e.encode([t or "" for t in texts[at:to]]), strict=True):
                    docs.append(d)
                    parts.append(np.append(own, np.uint32(end)).astype(wide))
                    held += len(parts[-1])
                    if held >= segment_values:
                        yield flush()
                at = to
        if docs:
            yield flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each id that a task has seen."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            ids, times = np.frombuffer(raw, "<i8").reshape(2, -1)
            if len(ids) and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
            total[ids] += times
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "times"])


def _filed(folder: str):
    """Writes each row as a file. Another attempt of a task writes files of other names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        with fs.open_input_stream(f"{root}/ranks") as f:
            ids = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        for batch in batches:
            names = []
            for k in range(len(batch)):
                sizes, raw = batch.column("sizes")[k].as_py(), batch.column("ids")[k].as_buffer()
                n = batch.column("n_values")[k].as_py()
                control, data = encode_values(rank[np.frombuffer(raw, f"<u{raw.size // n}")])
                names.append(f"{batch.column('first_doc')[k].as_py():020d}-{uuid.uuid4().hex}.tlv")
                with fs.open_output_stream(f"{root}/{names[-1]}") as f:
                    f.write(MAGIC + np.array([VERSION], "<u4").tobytes() + np.array([len(sizes) // 4, n], "<u8").tobytes())
                    for x in (batch.column("docs")[k].as_py(), sizes, control.tobytes(), data.tobytes()):
                        f.write(x)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(batch.column(c) for c in ("first_doc", "last_doc", "documents", "n_values"))], ["file", "first_doc", "last_doc", "documents", "n_values"])

    return run


def _by_range(docs: DataFrame, parts: int) -> DataFrame:
    """docs in partitions of consecutive doc_ids, of which only the ids are read to find the bounds."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))

    def below(lo: int, hi: int):
        """How many of the bounds lie below the id, found by halves."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(cuts[mid]), below(lo, mid)).otherwise(below(mid + 1, hi))

    return docs.repartitionById(parts, below(0, len(cuts)))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = 0, segment_values: int = SEGMENT_VALUES, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes every whole text, appends the end id, and writes files in ascending doc_id order to folder.

    A null text is empty: the end id alone. A null doc_id has no place in the files' order and its row is
    left out. Rows that repeat a doc_id all stay, next to each other, ordered by text.
    An empty table makes a folder without files. Executors may write a file twice; only files
    that the table of segments names count, and that table comes last.
    """
    spark, path = docs.sparkSession, path or default_tokenizer()
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    ordered = _by_range(docs, int(spark.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions("doc_id", "text")
    encoded = written(ordered.mapInArrow(_encoded(path, end, segment_values), _CHUNK), "encoded", compression="zstd")
    times = encoded.select("counts").mapInArrow(_counted, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))
    # one row for each id of the vocabulary, however large the corpus
    ids = [r.id for r in times.orderBy(F.desc("times"), "id").select("id").collect()]
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks") as f:
        f.write(np.array(ids, "<u4").tobytes())
    files = written(encoded.drop("counts").mapInArrow(_filed(folder), "file string, first_doc long, last_doc long, documents long, n_values long"), "files")
    # a few numbers for each file: the one ordered pass is over files, not documents
    order = Window.orderBy("first_doc", "last_doc", "file")
    start = F.coalesce(F.sum("n_values").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.select((F.row_number().over(order) - 1).alias("segment"), "file", "documents", "n_values", start.alias("start")).write.mode("overwrite").parquet(f"{folder}/_segments")
    forget(encoded), forget(files)
    return folder


def read_tokens(spark: SparkSession, folder: str, keep: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, and with keep its ids; start counts all ids before it."""
    segments = spark.read.parquet(f"{folder}/_segments")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        with fs.open_input_stream(f"{root}/ranks") as f:
            ids = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    raw = np.frombuffer(f.read(), np.uint8)
                if raw[:4].tobytes() != MAGIC:
                    raise ValueError(f"{name} is no token file")
                n, total = raw[8:24].view("<u8").tolist()
                at = 24
                docs, at = raw[at : at + 8 * n].view("<i8"), at + 8 * n
                sizes, at = raw[at : at + 4 * n].view("<u4").astype(np.int64), at + 4 * n
                control, at = raw[at : at + -(-total // 4)], at + -(-total // 4)
                values = ids[decode_values(control, raw[at:], total)]
                ends = np.cumsum(sizes)
                begin = ends - sizes
                for lo in range(0, n, 4096):
                    some = range(lo, min(n, lo + 4096))
                    own = [values[begin[k] : ends[k]] for k in some]
                    out = [pa.array(docs[lo : lo + 4096]), pa.array(begin[lo : lo + 4096] + start), pa.array(sizes[lo : lo + 4096]), pa.array([zlib.crc32(v.tobytes()) for v in own], pa.int64())]
                    if keep:
                        out.append(pa.array([v.astype(np.int64) for v in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return segments.repartition(max(1, min(segments.count(), 4096)), "segment").select("file", "start").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back, without the ids themselves."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, scratch(spark, "tokens"), path), keep=False)
