"""SentencePiece BPE encoding and decoding by vectorised merge rounds in numpy.

Texts fall into words that no piece can straddle; the distinct words of a batch lie end to end in
flat symbol arrays. Every round finds each word's smallest pair rank by a segmented minimum, merges
all its leftmost non-overlapping occurrences at once, and compacts the arrays; a word without a
known pair leaves. Rounds follow the longest merge chain, not the number of symbols. A long word, such as a text without
spaces, would need a round for each of its thousands of ranks: once a round does little for it, a queue of its pairs makes the
remaining merges in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches

SPACE = "▁"
_NONE = np.int64(np.iinfo(np.int64).max)
#: Words of which the encoding is kept within a worker, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Symbols of a long word, and the share of them that a round merges at least, or leaves to the queue.
LONG, LITTLE = 2048, 1 / 64


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of one protocol buffer message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = 4 if kind == 5 else 8 if kind == 1 else varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Pieces:
    """A BPE model with byte fallback, identity normalisation and a dummy prefix, as arrays."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        score, kind = [], []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {3: 1, 4: 1}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                score.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                kind.append(own.get(3, self.NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal |= dict(_fields(value))
        self.prefix = bool(normal[3])
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normal.get(1, b"identity") != b"identity" or normal[4] or set(kind) & {self.USER, self.UNUSED}:
            raise ValueError("only plain BPE models with byte fallback and without normalisation are supported")
        self.kind = np.array(kind)
        self.unk = kind.index(self.UNKNOWN)
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kind == self.BYTE):
            self.byte[int(self.pieces[i][3:5], 16)] = i
        self.id = {p: i for i, p in enumerate(self.pieces) if kind[i] == self.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece crosses the start of a word")
        self._pairs(score)
        self._char = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self._char[ord(p)] = i
        joined = "".join(p for p in self.id if len(p) > 1)
        #: Characters in no longer piece, such as a line feed, are words of their own.
        self.alone = sorted({c for c in "\n\t\r" if c not in joined})
        stop = "".join(map(re.escape, self.alone))
        self.words = re.compile(f"[{stop}]+|{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" if stop else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.raw = [bytes([int(p[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else p.encode() for p, k in zip(self.pieces, kind, strict=True)]
        self.raw[self.unk] = b" \xe2\x81\x87 "

    def _pairs(self, score: list[float]) -> None:
        """An open-addressed table of (left, right) -> rank, and the pieces that a merge must make one at a time.

        Symbols that are no piece but could be part of one do not exist: every symbol is a piece, a
        single character or an earlier merge. A merge makes one occurrence at a time where its
        product could at once be part of a better-ranked pair.
        """
        multi = [i for p, i in self.id.items() if len(p) > 1]
        order = sorted(multi, key=lambda i: (-score[i], i))
        rank = {i: r for r, i in enumerate(order)}
        single = {p: i for p, i in self.id.items()}
        left, right, value = [], [], []
        extra: dict[str, int] = {}
        for i in order:
            p = self.pieces[i]
            for k in range(1, len(p)):
                ends = []
                for q in (p[:k], p[k:]):
                    if q in single:
                        ends.append(single[q])
                    elif len(q) == 1:
                        ends.append(extra.setdefault(q, -2 - len(extra)))
                if len(ends) == 2:
                    left.append(ends[0])
                    right.append(ends[1])
                    value.append(rank[i])
        if extra:
            raise ValueError("a piece holds a character that is no piece")
        self.product = np.array(order, np.int64)
        self.careful = np.zeros(len(order), bool)
        for i in multi:
            p = self.pieces[i]
            for k in range(1, len(p)):
                for q in (p[:k], p[k:]):
                    j = self.id.get(q)
                    if j in rank and rank[j] > rank[i]:
                        self.careful[rank[j]] = True
        ties = [i for i, j in zip(order, order[1:], strict=False) if score[i] == score[j]]
        if any(len(self.pieces[i].strip(SPACE)) for i in ties):
            raise ValueError("pieces with equal scores are supported among runs of spaces only")
        self.first_tied = next((r for r, i in enumerate(order) if ties and score[i] == score[ties[0]]), len(order))
        scores = [score[i] for i in order]
        #: Ranks with equal scores are equally good: the leftmost pair of theirs is merged first.
        self.level = np.concatenate(([0], np.cumsum([a != b for a, b in zip(scores, scores[1:], strict=False)]))).astype(np.int64) if order else np.zeros(0, np.int64)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self._known: dict[int, int] | None = None
        self.bits = int(len(key)).bit_length() + 2
        self.slots = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        todo, slot, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(todo):
            self.probes += 1
            free = self.slots[slot] == np.iinfo(np.uint64).max
            took, where = np.unique(slot[free], return_index=True)
            mine = todo[free][where]
            self.slots[took], self.ranks[took] = key[mine], np.array(value)[mine]
            keep = ~np.isin(todo, mine)
            todo, slot = todo[keep], (slot[keep] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the largest integer where they make no piece."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(key), _NONE, np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        for _ in range(self.probes):
            at = self.slots[slot]
            hit = at == key[left]
            out[left[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at != np.iinfo(np.uint64).max)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
            if not len(left):
                break
        return out

    def _queue(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols of one word after all its merges, best pair first, the leftmost of equally good ones: n log n."""
        if self._known is None:
            full = self.ranks != _NONE
            self._known = dict(zip(self.slots[full].tolist(), self.ranks[full].tolist(), strict=True))
        known, level, product = self._known, self.level.tolist(), self.product.tolist()
        n = len(symbol)
        both = (symbol[:-1] >= 0) & (symbol[1:] >= 0)
        at = np.flatnonzero(both)
        ranks = self.rank(symbol[at], symbol[at + 1])
        at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
        # a pair is one number: its level, then where it begins
        heap = ((self.level[ranks] << 40) | at).tolist()
        heapq.heapify(heap)
        gone = -(1 << 40)
        s, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << 40) - 1)
            a, j = s[i], after[i]
            if a < 0 or j >= n or s[j] < 0:
                continue
            r = known.get(a << 32 | s[j])
            if r is None or level[r] != entry >> 40:
                continue
            s[i], s[j] = product[r], gone
            after[i] = k = after[j]
            p = before[i]
            if p >= 0 and s[p] >= 0 and (r := known.get(s[p] << 32 | s[i])) is not None:
                heapq.heappush(heap, level[r] << 40 | p)
            if k < n:
                before[k] = i
                if s[k] >= 0 and (r := known.get(s[i] << 32 | s[k])) is not None:
                    heapq.heappush(heap, level[r] << 40 | i)
        out = np.array(s, np.int64)
        return out[out != gone]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and their offsets (n + 1). Characters that are no piece become bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        # an unknown character is a negative symbol, which is in no pair
        known = self._char[chars].astype(np.int64)
        symbol = np.where(known >= 0, known, -1 - chars.astype(np.int64))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = np.ones(len(symbol), bool)
        ranks = np.full(len(symbol), _NONE, np.int64)
        while len(symbol):
            # ranks[k] belongs to the pair (k, k + 1)
            ask = np.flatnonzero(fresh[:-1] & (word[:-1] == word[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0))
            ranks[:-1][fresh[:-1]] = _NONE
            ranks[-1] = _NONE
            ranks[ask] = self.rank(symbol[ask], symbol[ask + 1])
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(ranks, begin)
            size = np.diff(np.append(begin, len(word)))
            over = np.repeat(least == _NONE, size)
            if over.any():
                done.append((word[over], symbol[over]))
                on = ~over
                symbol, word, ranks, size, least = symbol[on], word[on], ranks[on], size[least != _NONE], least[least != _NONE]
                if not len(symbol):
                    break
            lowest = np.repeat(least, size)
            hit = np.flatnonzero(ranks == lowest)
            # leftmost first: in a run of hits that overlap (a a a), every other one
            new = np.concatenate(([True], np.diff(hit) != 1))
            run = np.flatnonzero(new)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            slow = self.careful[lowest[hit]] | (lowest[hit] >= self.first_tied)
            if slow.any():
                first = np.concatenate(([True], word[hit][1:] != word[hit][:-1]))
                hit = hit[~slow | first]
            if (size > LONG).any():
                part = np.repeat(np.arange(len(size)), size)
                slow = (size > LONG) & (np.bincount(part[hit], minlength=len(size)) < LITTLE * size)
                if slow.any():
                    ends = np.cumsum(size)
                    for k in np.flatnonzero(slow):
                        own = slice(ends[k] - size[k], ends[k])
                        rest = self._queue(symbol[own])
                        done.append((np.full(len(rest), word[ends[k] - 1]), rest))
                    on = ~slow[part]
                    symbol, word, ranks, fresh = symbol[on], word[on], ranks[on], np.zeros(int(on.sum()), bool)
                    continue
            fresh = np.zeros(len(symbol), bool)
            fresh[hit] = True
            fresh[hit[hit > 0] - 1] = True
            symbol[hit] = self.product[lowest[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            gone = hit + 1
            fresh[gone[fresh[gone]] - 1] = True
            symbol, word, ranks, fresh = symbol[keep], word[keep], ranks[keep], fresh[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        lost = np.flatnonzero(symbol < 0)
        if len(lost):
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in symbol[lost].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[lost] = [len(r) for r in raw]
            wide = np.repeat(symbol < 0, times)
            flat = np.frombuffer(b"".join(raw), np.uint8)
            symbol, word = np.repeat(symbol, times), np.repeat(word, times)
            symbol[wide] = self.byte[flat]
        return symbol, np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def encode(self, texts: list[str | None], cache: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
        """The ids of each text, with begin and end ids. A null or empty text has those two alone."""
        cache = {} if cache is None else cache
        index: dict[str, int] = {}
        flow: list[list[int]] = []
        for t in texts:
            t = (t or "").replace(" ", SPACE)
            flow.append([index.setdefault(w, len(index)) for w in self.words.findall(SPACE + t if self.prefix and t else t)])
        words = list(index)
        got = [cache.get(w) for w in words]
        new = [k for k, g in enumerate(got) if g is None]
        ids, off = self.encode_words([words[k] for k in new])
        ids = ids.astype(np.int32)
        for n, k in enumerate(new):
            got[k] = ids[off[n] : off[n + 1]]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        room = CACHE_WORDS - len(cache)
        cache.update((words[k], got[k].copy()) for k in new[: max(0, room)] if len(words[k]) <= CACHE_CHARS)
        ends = [np.array([i], np.int32) for i in (self.bos, self.eos)]
        return [np.concatenate([ends[0], *(got[k] for k in f), ends[1]]) for f in flow]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of pieces end to end, begin and end ids nothing, the dummy prefix off."""
        raw = b"".join([self.raw[i] for i in ids.tolist()])
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with keep also (ids, decoded), for every row.

    A null text counts as empty: begin and end ids, decoded to nothing. Repeated rows, null ids and
    very long texts are rows like others; a batch goes through in pieces of about a megabyte. The
    model's path is one that every executor has.
    """
    path = path or default_model()
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = model(path), {}
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1 << 20) and to - at < 4096:
                    size += len(texts[to] or "")
                    to += 1
                ids = m.encode(texts[at:to], cache)
                plain = [m.decode(i) for i in ids]
                out = [
                    batch.column("doc_id").slice(at, to - at),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in plain]),
                ]
                if keep:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])
                at = to

    return docs.mapInArrow(run, schema)
