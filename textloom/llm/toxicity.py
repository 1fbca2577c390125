"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, and the lengths to which they compress each window.

A text is lower-cased, runs of other characters than letters and digits become one space, and its UTF-8 bytes are cut into windows of whole words. A
window's saving is its compressed length with the ordinary dictionary less that with the toxic one. Both dictionaries begin with
the same content, trained on ordinary text; what differs is trained on windows of toxic and of ordinary documents, as many bytes of either.

A toxic document is mostly ordinary text, so its label is one for a bag of windows. A committee of dictionaries, each trained on the
whole text of one part of either class, first says which windows are more toxic than ordinary to all members that have not seen
the document. Rounds follow: the dictionaries are trained on the windows of each document with the largest savings,
and all windows are compressed anew by dictionaries trained without their own part. The ordinary dictionary thus learns
what the toxic one would wrongly save on. No word is ever picked, listed or looked up.

Thresholds are calibrated on savings by dictionaries that have not seen the document: each saving weighs as the
log of its share among toxic over that among ordinary windows, less what ordinary windows weigh on average, and a logistic model maps a document's
sum over its standard error and the likelihood of its largest saving to its score.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import mix64, slices, small_batches

#: Labelled documents of either class that a classifier is fitted on, at most.
SAMPLE_DOCS = 2000
#: Bytes of a window at most.
WINDOW = 32
PARTS, ROUNDS = 4, 6
#: Tasks that judge a part's windows.
SLICES = 2
#: Windows of a document that a round's dictionaries are trained on.
TOP = 3
#: Bytes of the content that both dictionaries begin with, of what each adds, and of a committee's member.
BASE_BYTES, OWN_BYTES, MEMBER_BYTES = 500_000, 8192, 65_536
#: Bytes that text is cut into to train on whole texts.
PIECE = 256
#: A search of all matches, by trees: savings of faster ones hang on which positions their tables happen to keep.
STRATEGY, MIN_MATCH, SEARCH = zstd.STRATEGY_BTLAZY2, 6, 5
#: What the mean weight of a text's windows may err by, however many they are.
BIAS = 0.02
#: Savings beyond these weigh like these.
LEAST, MOST = -8, 24
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> bytes:
    """What of a text is compressed; nothing of one without letters or digits."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode() if words else b""


class Windows:
    """The windows of some texts: where each begins and ends in their joined bytes, and whose it is.

    A window holds as many whole words as fit into WINDOW bytes, each with the space before it; a longer word is cut. Every byte lies in one
    window. A window that a text repeats counts once: repetition is no further evidence.
    """

    def __init__(self, texts: Sequence[bytes]):
        self.data = b"".join(texts)
        cuts, owner, at = [0], [], 0
        for k, t in enumerate(texts):
            stop = at + len(t)
            while at < stop:
                end = at + WINDOW
                if end < stop:
                    space = self.data.rfind(b" ", at + 1, end + 1)
                    at = space if space > 0 else end
                else:
                    at = stop
                cuts.append(at)
                owner.append(k)
        ends, owner = np.array(cuts, np.int64), np.array(owner, np.int64)
        begin, length = ends[:-1], np.diff(ends)
        mark = self._hashes(begin, length)
        order = np.lexsort((mark, owner))
        key = np.stack([owner, mark.view(np.int64)])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.sort(order[new])  # lexsort is stable: the first of equal windows
        self.owner, self.begin, self.size = owner[first], begin[first], length[first]
        self.count = np.bincount(self.owner, minlength=len(texts))

    def _hashes(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.data + bytes(WINDOW), np.uint8)
        out = np.empty(len(begin), np.uint64)
        for at in range(0, len(begin), 65_536):
            b, n = begin[at : at + 65_536, None], size[at : at + 65_536, None]
            inside = np.arange(WINDOW)[None] < n
            eight = np.where(inside, raw[b + np.arange(WINDOW)[None]], 0).astype(np.uint8).view(np.uint64)
            h = n[:, 0].astype(np.uint64)
            for k in range(eight.shape[1]):
                h = mix64(h ^ eight[:, k])
            out[at : at + len(b)] = h
        return out

    def cut(self, some: np.ndarray) -> list[bytes]:
        return [self.data[b : b + n] for b, n in zip(self.begin[some].tolist(), self.size[some].tolist(), strict=True)]

    def lengths(self, compressor: zstd.ZstdCompressor, some: np.ndarray | None = None) -> np.ndarray:
        """Compressed lengths of the windows, or of some of them."""
        begin, size = (self.begin, self.size) if some is None else (self.begin[some], self.size[some])
        out = np.empty(len(begin), np.int64)
        for at in range(0, len(begin), 32_768):
            b, n = begin[at : at + 32_768], size[at : at + 32_768]
            low, high = int(b.min()), int((b + n).max())
            segments = np.stack([b - low, n], axis=1).astype(np.uint64).tobytes()
            got = compressor.multi_compress_to_buffer(zstd.BufferWithSegments(self.data[low:high], segments), threads=0)
            out[at : at + len(b)] = np.fromiter((len(s) for s in got), np.int64, len(b))
        return out


def compressor(content: bytes) -> zstd.ZstdCompressor:
    """Content is given raw: entropy tables would differ between dictionaries and blur small differences of length."""
    content = content or b" "
    log = max(17, (len(content) + WINDOW).bit_length())
    p = zstd.ZstdCompressionParameters(strategy=STRATEGY, window_log=log, chain_log=log, hash_log=log - 1, search_log=SEARCH, min_match=MIN_MATCH, target_length=32, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=p)


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of at most `size` bytes trained on samples, whose segments have about `segment` bytes; of too few samples, themselves."""
    order = np.random.Generator(np.random.PCG64(2)).permutation(len(samples))
    samples = [samples[i] for i in order]  # long runs of like samples would end the training early
    total = sum(map(len, samples))
    try:
        return zstd.train_dictionary(min(size, max(256, total)), samples, k=segment, d=8, f=20, accel=1).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:size]


def _pieces(texts: list[bytes]) -> list[bytes]:
    return [t[a : a + PIECE] for t in texts for a in range(0, len(t), PIECE)]


@dataclass
class Model:
    """The dictionaries' contents, the weight of each saving and the share of ordinary windows that save as much or more, and the logistic model of the features with their means and deviations."""

    base: bytes = b""
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (MOST - LEAST + 1))
    tail: list[float] = field(default_factory=lambda: [1.0] * (MOST - LEAST + 1))
    logistic: list[float] = field(default_factory=lambda: [0.0] * 3)
    centre: list[float] = field(default_factory=lambda: [0.0] * 2)
    spread: list[float] = field(default_factory=lambda: [1.0] * 2)


def features(windows: Windows, saved: np.ndarray, weights: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of each text: the sum of its savings' weights over its standard error, and how unlikely its largest saving is among so many ordinary windows: neither grows with the length of an ordinary text."""
    n = len(windows.count)
    saved = np.clip(saved, LEAST, MOST) - LEAST
    total = np.bincount(windows.owner, weights[saved], n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, windows.owner, saved)
    n = np.maximum(1, windows.count)
    return np.column_stack([total / np.sqrt(n + (BIAS * n) ** 2), -np.log(np.minimum(1, n * tail[top]))])


class Scorer:
    """A model with its compressors."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = np.array(model.weights)
        self.pair = compressor(model.base + model.ordinary), compressor(model.base + model.toxic)

    def savings(self, windows: Windows) -> np.ndarray:
        return windows.lengths(self.pair[0]) - windows.lengths(self.pair[1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m, windows = self.model, Windows([normalised(t) for t in texts])
        x = (features(windows, self.savings(windows), self.weights, np.array(self.model.tail)) - m.centre) / m.spread
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ np.array(m.logistic), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (each * (y - p)) - keep * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _largest(windows: Windows, saved: np.ndarray) -> np.ndarray:
    """Each text's TOP windows of the largest savings, where they save at all."""
    order = np.lexsort((-saved, windows.owner))
    first = np.cumsum(windows.count) - windows.count
    rank = np.arange(len(order)) - first[windows.owner[order]]
    out = np.zeros(len(order), bool)
    out[order] = rank < TOP
    return out & (saved > 0)


class _Sample:
    """The labelled texts of a fit by class, with their windows, cut into parts: every dictionary judges parts that it was not trained on."""

    def __init__(self, bags: list[list[bytes]]):
        self.bags, self.parts = bags, min(PARTS, *map(len, bags))
        self.windows = [Windows(b) for b in bags]
        self.part = [w.owner % self.parts for w in self.windows]

    def member(self, side: int, p: int) -> list[np.ndarray]:
        """Lengths of all windows, by class, by a dictionary of one part of a class."""
        c = compressor(dictionary(_pieces(self.bags[side][p :: self.parts]), MEMBER_BYTES, 64))
        return [w.lengths(c).astype(np.int16) for w in self.windows]

    def base(self, p: int) -> bytes:
        """Ordinary text without part p."""
        return dictionary(_pieces([t for k, t in enumerate(self.bags[0]) if k % self.parts != p]), BASE_BYTES, 64)

    def contents(self, p: int, saved: list[np.ndarray]) -> tuple[bytes, bytes]:
        """What the toxic and the ordinary dictionary add, from windows of other parts than p."""
        ordinary, known = (dictionary(w.cut(np.flatnonzero((own != p) & _largest(w, s))), OWN_BYTES, 16) for w, own, s in zip(self.windows, self.part, saved, strict=True))
        return known, ordinary

    def judged(self, p: int, slice_: int, base: bytes, saved: list[np.ndarray]) -> list[np.ndarray]:
        """Savings, by class, of a slice of part p's windows by the dictionaries of the other parts."""
        pair = Scorer(Model(base, *self.contents(p, saved))).pair
        mine = [self.slice(side, p, slice_) for side in (0, 1)]
        return [(w.lengths(pair[0], m) - w.lengths(pair[1], m)).astype(np.int16) for w, m in zip(self.windows, mine, strict=True)]

    def slice(self, side: int, p: int, slice_: int) -> np.ndarray:
        return np.array_split(np.flatnonzero(self.part[side] == p), SLICES)[slice_]


#: The sample that this worker has built last, by its fit's name: rounds of a fit need not build it again.
_held: dict[str, _Sample] = {}


def _each(name: str, bags: list[list[bytes]], step: str, arguments: tuple):
    """One step of the training over a sample."""
    if name not in _held:
        _held.clear()
        _held[name] = _Sample(bags)
    return getattr(_held[name], step)(*arguments)


def train(texts: list[str | None], toxic: list[int], share: float | None = None, run=None) -> Model:
    """A model from labelled texts, of which a share of `share` (as in the texts, if None) is toxic where it will be used.

    With fewer than two texts of a class, every text scores the smoothed share of toxic ones. Texts without letters or digits are
    no evidence for either class but count in that share. run(bags) gives a function that does a list of steps; by default they are done one by one.
    """
    y = np.array(toxic, int)
    counts = [int((y == c).sum()) for c in (0, 1)]
    share = (counts[1] + 0.5) / (len(y) + 1) if share is None else share
    share = min(max(share, 1e-6), 1 - 1e-6)
    bags = [[t for t in (normalised(t) for t, own in zip(texts, y, strict=True) if own == c) if t] for c in (0, 1)]
    if min(map(len, bags)) < 2:
        return Model(logistic=[math.log(share / (1 - share)), 0.0, 0.0])
    sample = _Sample(bags)
    parts, windows, part = sample.parts, sample.windows, sample.part
    do = run(bags) if run else lambda steps, shared=(): [getattr(sample, step)(*arguments, *shared) for step, *arguments in steps]
    # the dictionary of all ordinary text is that without a part which is none
    first = do([("member", side, p) for side in (0, 1) for p in range(parts)] + [("base", p) for p in range(parts + 1)])
    member, base = [first[:parts], first[parts : 2 * parts]], first[2 * parts :]
    saved = []
    for k, own in enumerate(part):
        length = np.stack([[m[k].astype(np.int64) for m in side] for side in member])
        # a member does not judge the part that it was trained on
        length[0][own[None] == np.arange(parts)[:, None]] = 1 << 30
        length[1][own[None] == np.arange(parts)[:, None]] = 0
        saved.append(length[0].min(axis=0) - length[1].max(axis=0))
    for _ in range(ROUNDS):
        new = [np.zeros_like(s) for s in saved]
        steps = [("judged", p, j) for p in range(parts) for j in range(SLICES)]
        for (_, p, j), got in zip(steps, do([(*s, base[s[1]]) for s in steps], (saved,)), strict=True):
            for side in (0, 1):
                new[side][sample.slice(side, p, j)] = got[side]
        saved = new
    # the last savings, all by dictionaries that have not seen the text
    count = [np.bincount(np.clip(s, LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1) + 0.5 for s in saved]
    weights = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    weights -= weights @ count[0] / count[0].sum()  # ordinary windows add up to nothing, however many
    tail = np.cumsum(count[0][::-1])[::-1] / count[0].sum()
    x = np.concatenate([features(w, s, weights, tail) for w, s in zip(windows, saved, strict=True)])
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    n = [len(b) for b in bags]
    each = np.repeat([(1 - share) * sum(n) / n[0], share * sum(n) / n[1]], n)
    fitted = _logistic((x - centre) / spread, np.repeat([0.0, 1.0], n), each)
    return Model(base[parts], *sample.contents(parts, saved), weights.tolist(), tail.tolist(), fitted.tolist(), centre.tolist(), spread.tolist())


def _in_tasks(spark: SparkSession):
    """Steps of a training as tasks of a Spark job; the sample travels once, as a broadcast."""

    def begin(bags: list[list[bytes]]):
        name, sample = uuid.uuid4().hex, spark.sparkContext.broadcast(bags)

        def do(steps: list[tuple], shared: tuple = ()) -> list:
            given = spark.sparkContext.broadcast((steps, shared))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in batch.column(0).to_pylist():
                        steps, shared = given.value
                        out = _each(name, sample.value, steps[k][0], (*steps[k][1:], *shared))
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(out)], pa.binary())], ["k", "out"])

            got = {r.k: pickle.loads(r.out) for r in spark.range(0, len(steps), 1, len(steps)).mapInArrow(run, "k long, out binary").collect()}
            given.destroy()
            return [got[k] for k in range(len(steps))]

        return do

    return begin


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most sample_docs labelled documents of each class, whole: those whose ids have the smallest hashes.

    Labels other than 0 and 1, and documents without label, are left out; a document labelled twice counts by its larger label, and
    of rows that repeat a doc_id one counts, that whose text has the smallest hash. Only the sampled ids, which the bound keeps few, go to the documents.
    The sample comes to the driver, which deals dictionaries to train and windows to judge to tasks, round by round.
    """
    own = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    some = [own.where(F.col("y") == c).orderBy(F.xxhash64("i"), "i").limit(sample_docs) for c in (0, 1)]
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1) if counts else 0.25
    known = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    known = known.join(F.broadcast(some[0].unionAll(some[1])), "i").groupBy("i").agg(F.max("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = sorted((r.i, r.y, r.t) for r in known.toLocalIterator())
    return train([t for _, _, t in rows], [y for _, y, _ in rows], share, _in_tasks(docs.sparkSession))


def _parts(texts: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    return slices(texts, [column], 512, 1 << 20)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row: the score of its whole text, and 1 where it is 0.5 or more.

    A null or empty text, or one without letters or digits, has the score of no finding. Repeated rows and null ids are rows like others.
    """
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for batch in batches:
            for part in _parts(batch, "text"):
                got = s.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def passed(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose texts score below 0.5."""
    small_batches(docs)
    s: list[Scorer] = []

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        if not s:
            s.append(Scorer(model))
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        got = [s[0].scores(part.column("text").to_pylist()) for part in _parts(batch, "text")]
        return pd.Series(np.concatenate(got) if got else np.zeros(0))

    return docs.where(rated(F.col(text).cast("string")) < 0.5)
