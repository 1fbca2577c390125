"""Near-duplicate vectors by product quantisation, with no link lost.

Distinct vectors, scaled to length one, go to coarse inverted lists (k-means cells). Their residuals are coded in
subspaces of 256 codewords each. A vector probes every list that could hold a link: one whose dividing plane with the
vector's own cell is no farther than linked vectors can be from each other. In a list, the estimate
x . c + sum over subspaces of table[code] misses x . y by at most the length of y's coding error, which is stored
with its code; what stays above the threshold by that margin is compared exactly, in double precision.

Work goes in two passes over pairs of parts of lists. In the first only codes and errors travel to the parts that probe them, many parts'
at once, and each pair's rows that stand in any candidate are found. In the second the full vectors of those rows alone
meet, and links are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import components, forget, small_batches, written
from textloom.llm.vectors import k_means, matrices, nearest, sample, usable

CHUNK = 256
#: Rows of codes that meet a part at once, about.
GROUP_ROWS = 1 << 18


class Quantiser:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, cells: int, subspaces: int, seed: int = 7):
        d = x.shape[1]
        self.centres = k_means(x, cells, seed)
        rest = x - self.centres[nearest(x, self.centres)]
        self.cuts = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], 256, seed + 1 + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and the length of the coding error of each row."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1).astype(np.uint8)
        for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            rest[:, a:b] -= self.books[i][codes[:, i]]
        return cell, codes, np.linalg.norm(rest, axis=1)

    def probes(self, x: np.ndarray, cell: int, reach: float) -> np.ndarray:
        """For rows of one cell, each cell: whether a vector within reach of any of them may be nearest to its centre."""
        own = np.einsum("kd,kd->k", self.centres, self.centres)[None]
        bound = 2 * np.linalg.norm(self.centres - self.centres[cell], axis=1) * (reach + 1e-9)
        out = np.zeros(len(self.centres), bool)
        for at in range(0, len(x), 512):
            square = own - 2 * x[at : at + 512] @ self.centres.T
            out |= (square - square[:, cell : cell + 1] <= bound).any(axis=0)
        return out

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Products of the codewords with each row's subvectors."""
        return [np.ascontiguousarray(book @ x[:, a:b].T, np.float32) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_BLOCK = "dim int, cell int, part int, rows int, node binary, class binary, times binary, vectors binary, codes binary, errors binary"
_BLOCK_TYPES = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("node", "class", "times", "vectors", "codes", "errors"))])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assigned(models: dict[int, Quantiser]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            dim = np.zeros(len(batch), np.int32)
            for rows, m in matrices(batch.column("v")):
                dim[rows] = m.shape[1]
                if m.shape[1] in models:
                    for at in range(0, len(rows), 4096):
                        cell[rows[at : at + 4096]] = nearest(_unit(m[at : at + 4096]), models[m.shape[1]].centres)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "class", "times", "v")), pa.array(dim), pa.array(cell)], ["node", "class", "times", "v", "dim", "cell"])

    return run


def _packed(models: dict[int, Quantiser]):
    """A part of a list as one row: ids, vectors, codes and errors."""

    def run(group: pa.Table) -> pa.Table:
        dim, cell, part = (group.column(c)[0].as_py() for c in ("dim", "cell", "part"))
        ((_, m),) = matrices(group.column("v").combine_chunks())
        codes, errors = np.zeros((len(m), 0), np.uint8), np.full(len(m), 9.0)
        if dim in models:
            _, codes, errors = models[dim].code(_unit(m))
        ints = [_blob(group.column(c).to_numpy()) for c in ("node", "class", "times")]
        return pa.table([[dim], [cell], [part], [len(m)], *([b] for b in ints), [_blob(m)], [_blob(codes)], [_blob(errors.astype(np.float32))]], schema=_BLOCK_TYPES)

    return run


def _wanted(models: dict[int, Quantiser], reach: float):
    """The lists, this one or later ones, that a part probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for r in batch.to_pylist():
                d, cell = r["dim"], r["cell"]
                if d not in models:
                    out.append((d, cell, r["part"], cell))
                    continue
                x = _unit(np.frombuffer(r["vectors"]).reshape(-1, d))
                at = models[d].probes(x, cell, reach)
                at[cell] = True
                out += [(d, cell, r["part"], int(j)) for j in np.flatnonzero(at) if j >= cell]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["dim", "cell", "part", "other"])

    return run


def _forest(link: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
    """Of links (rows, columns) among n nodes, a spanning forest."""
    label = np.arange(n)
    found = []
    rows, columns = link
    if not len(rows):
        return found
    begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    for b, e in zip(begin, np.append(begin[1:], len(rows)), strict=True):
        x, ys = rows[b], columns[b:e]
        other, where = np.unique(label[ys], return_index=True)
        apart = other != label[x]
        if apart.any():
            found += [(int(x), int(y)) for y in ys[where[apart]]]
            label[np.isin(label, other[apart])] = label[x]
    return found


def _candidates(m: Quantiser, q: np.ndarray, cell: int, codes: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and of a part of a list whose estimated cosine reaches the part's margins."""
    # a codeword's products with all rows of the chunk lie together: a look-up copies one row of the table
    near = np.repeat((q @ m.centres[cell]).astype(np.float32)[None], len(codes), axis=0)
    for table, column in zip(m.tables(q), codes.T, strict=True):
        near += table.take(column, axis=0)
    j, i = np.nonzero(near >= margin[:, None])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


_FOUND = "dim int, cell_x int, part_x int, cell_y int, part_y int, side int, rows binary"


def _screened(models: dict[int, Quantiser], least: float):
    """For a part and the codes of others: for each pair that has candidates, the rows of either side that stand in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                d = r["dim"]
                x = _unit(np.frombuffer(r["vectors"]).reshape(-1, d))
                for y in r["others"]:
                    n = y["rows"]
                    if d in models:
                        codes, margin = np.frombuffer(y["codes"], np.uint8).reshape(n, -1), np.float32(least - 1e-5) - np.frombuffer(y["errors"], np.float32)
                        own = r["cell"] == y["cell"] and r["part"] == y["part"]
                        hit = np.zeros(len(x), bool), np.zeros(n, bool)
                        for at in range(0, len(x), CHUNK):
                            i, j = _candidates(models[d], x[at : at + CHUNK], y["cell"], codes, margin)
                            if own:  # a vector is its own candidate
                                i, j = i[i + at != j], j[i + at != j]
                            hit[0][i + at] = True
                            hit[1][j] = True
                        if own:
                            hit = (hit[0] | hit[1],) * 2
                    else:
                        hit = np.ones(len(x), bool), np.ones(n, bool)
                    if hit[0].any() and hit[1].any():
                        out += [(d, r["cell"], r["part"], y["cell"], y["part"], k, np.flatnonzero(h).astype(np.int32).tobytes()) for k, h in enumerate(hit)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 6 + [pa.binary()], strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


_SIDE = "dim int, cell_x int, part_x int, cell_y int, part_y int, side int, node binary, class binary, times binary, vectors binary, codes binary, errors binary"


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's rows that each pair needs."""
    names = [c.split()[0] for c in _SIDE.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            wide = {c: np.frombuffer(r[c], np.uint8).reshape(n, -1) for c in names[6:]}
            for at in range(0, len(r["wants"]), 8):
                some = r["wants"][at : at + 8]
                rows = [np.frombuffer(w["rows"], np.int32) for w in some]
                head = [pa.array([r["dim"]] * len(some), pa.int32()), *(pa.array([w[c] for w in some], pa.int32()) for c in names[1:6])]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array([wide[c][k].tobytes() for k in rows], pa.binary()) for c in names[6:])], names)


def _compared(models: dict[int, Quantiser], least: float):
    """For each pair of parts: how many rows each vector links with, and links that hold the same components together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d, own = r["dim"], r["cell_x"] == r["cell_y"] and r["part_x"] == r["part_y"]
                raw = {s: np.frombuffer(r["vectors" + s]).reshape(-1, d) for s in ("_x", "_y")}
                x, y = _unit(raw["_x"]), _unit(raw["_y"])
                ints = {c + s: np.frombuffer(r[c + s], np.int64) for s in ("_x", "_y") for c in ("node", "class", "times")}
                codes, errors = np.frombuffer(r["codes_y"], np.uint8).reshape(len(y), -1), np.frombuffer(r["errors_y"], np.float32)
                margin = np.float32(least - 1e-5) - errors
                links: list[tuple[np.ndarray, np.ndarray]] = []
                mine, theirs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                for at in range(0, len(x), CHUNK):
                    q = x[at : at + CHUNK]
                    if d in models:
                        i, j = _candidates(models[d], q, r["cell_y"], codes, margin)
                    else:
                        i, j = (k.reshape(-1) for k in np.indices((len(q), len(y))))
                    if own:
                        later = j > i + at
                        i, j = i[later], j[later]
                    # row by row whatever their number, so that a cosine does not hang on how many are compared
                    good = np.concatenate([np.einsum("nd,nd->n", q[i[k : k + 65536]], y[j[k : k + 65536]]) >= least for k in range(0, max(len(i), 1), 65536)])
                    i, j = i[good] + at, j[good]
                    mine += np.bincount(i, ints["times_y"][j], len(x)).astype(np.int64)
                    theirs += np.bincount(j, ints["times_x"][i], len(y)).astype(np.int64)
                    # what has been joined before needs no further link: keep a forest of this chunk
                    both = _forest((i, j + len(x)), len(x) + len(y)) if not own else _forest((i, j), len(x))
                    if both:
                        u, v = np.array(both).T
                        links.append((u, v if own else v - len(x)))
                u, v = (np.concatenate(k) for k in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
                node_y = ints["node_x"] if own else ints["node_y"]
                a, b = np.flatnonzero(mine), np.flatnonzero(theirs)
                kind = np.concatenate([np.zeros(len(a) + len(b), np.int32), np.ones(len(u), np.int32)])
                first = np.concatenate([ints["class_x"][a], ints["class_y"][b], ints["node_x"][u]])
                second = np.concatenate([mine[a], theirs[b], node_y[v]])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(first), pa.array(second)], ["kind", "a", "b"])

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, part_rows: int = 8192, most_cells: int = 4096, subspaces: int = 16, sample_rows: int = 20_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors, linked where the cosine is at least `least`.

    The quantiser is fitted on at most sample_rows distinct vectors; every vector is coded and compared. Equal vectors are
    one class: they link with each other and share all links, which are counted without being listed. A part of a list has about
    part_rows rows, so a dense group is met in pairs of parts, and writes counts and a forest only; codes travel first, and of vectors only the rows of candidates. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor does a row without id; vectors of different lengths do not link. A repeated row is another vector.
    """
    rows = small_batches(vectors).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # -0.0 and 0.0 are equal components
    same = F.transform("v", lambda x: x + F.lit(0.0))
    ok = usable("v") & F.col("vec_id").isNotNull()
    keyed = rows.select("vec_id", F.when(ok, F.xxhash64(same)).alias("c1"), F.when(ok, F.xxhash64(F.lit(1), F.reverse(same))).alias("c2"), F.when(ok, F.col("v")).alias("v"))
    classes = keyed.where("c1 is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"), F.first("v").alias("v"))
    classes = written(classes.withColumn("class", F.xxhash64("c1", "c2")), "classes")
    total = classes.count()
    fitted = sample(classes, "node", "v", sample_rows, 11)
    cells = min(most_cells, -(-total // part_rows))
    models = {d: Quantiser(_unit(m), cells, subspaces) for d, m in fitted.items()}
    listed = written(classes.select("node", "class", "times", "v").mapInArrow(_assigned(models), "node long, class long, times long, v array<double>, dim int, cell int"), "listed")
    sizes = listed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    parts = listed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    # the join above leaves the rows by list; a large list's parts must not meet in one task
    blocks = written(parts.repartition("dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(_packed(models), _BLOCK), "blocks")
    reach = float(np.sqrt(2 - 2 * least))
    want = blocks.select("dim", "cell", "part", "vectors").mapInArrow(_wanted(models, reach), "dim int, cell int, part int, other int")
    names = blocks.select("dim", F.col("cell").alias("other"), F.col("part").alias("part_y"))
    pairs = written(want.join(names, ["dim", "other"]).where("other > cell or part_y >= part").select("dim", F.col("cell").alias("cell_x"), F.col("part").alias("part_x"), F.col("other").alias("cell_y"), "part_y"), "pairs")
    # codes and errors of many parts meet a part's vectors at once
    codes = blocks.select("dim", F.col("cell").alias("cell_y"), F.col("part").alias("part_y"), F.struct("cell", "part", "rows", "codes", "errors").alias("other"))
    per_group = max(1, GROUP_ROWS // part_rows)
    turn = F.row_number().over(Window.partitionBy("dim", "cell_x", "part_x").orderBy("cell_y", "part_y"))
    grouped = pairs.withColumn("group", F.floor(turn / per_group)).join(codes, ["dim", "cell_y", "part_y"])
    grouped = grouped.groupBy("dim", F.col("cell_x").alias("cell"), F.col("part_x").alias("part"), "group").agg(F.collect_list("other").alias("others"))
    met = grouped.join(blocks.select("dim", "cell", "part", "vectors"), ["dim", "cell", "part"]).repartition("dim", "cell", "part", "group")
    screened = written(met.mapInArrow(_screened(models, least), _FOUND), "screened")
    # of each part, the rows that a pair needs
    own = lambda k, s: screened.where(f"side = {k}").select("dim", F.col(f"cell_{s}").alias("cell"), F.col(f"part_{s}").alias("part"), F.struct("cell_x", "part_x", "cell_y", "part_y", "side", "rows").alias("want"))
    wants = own(0, "x").unionAll(own(1, "y")).groupBy("dim", "cell", "part", F.pmod(F.xxhash64("want"), F.lit(8))).agg(F.collect_list("want").alias("wants"))
    sides = written(wants.join(blocks.withColumnRenamed("rows", "n"), ["dim", "cell", "part"]).mapInArrow(_picked, _SIDE), "sides")
    key = ["dim", "cell_x", "part_x", "cell_y", "part_y"]
    side = lambda k, s: sides.where(f"side = {k}").select(*key, *(F.col(c).alias(c + s) for c in ("node", "class", "times", "vectors", "codes", "errors")))
    full = side(0, "_x").join(side(1, "_y"), key).repartition(*key)
    found = written(full.mapInArrow(_compared(models, least), "kind int, a long, b long"), "compared")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "class")
    joined = components(found.where("kind = 1"), "a", "b")
    named = classes.select("c1", "c2", "node", "times", "class").join(counts, "class", "left").join(joined, "node", "left")
    named = written(named.select("c1", "c2", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    for used in (classes, listed, blocks, pairs, screened, sides, found):
        forget(used)
    out = keyed.select("vec_id", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
