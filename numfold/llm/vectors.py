"""Embedding near-dedup by an epsilon grid order join.

Linked vectors have equal labels and a cosine of at least the threshold, so their unit
vectors lie within epsilon = sqrt(2 - 2 * threshold). A vector's sketch is its projections
on leading principal directions (from a bounded sample; any orthonormal directions give
right results) and the norm of what is left. Sketches are unit vectors again, and the
product of two is never below the cosine, so sketches of linked vectors lie within epsilon.

Vectors are sorted by label and epsilon-grid cell of the sketch, then cut into blocks, and
SUPER blocks in a row make an interval. The sequence of a label's intervals is joined
recursively: an interval whose bounding box is farther than epsilon is skipped whole. Block
pairs of near intervals are tested by their own boxes. The pairs left are compared on
sketches first, and only vectors with a possible partner are sent in full and compared in
double precision. A block pair returns sums and a spanning forest of its links, at most a
row for each of its vectors. near_blocks() tells which block pairs were left.

Equal vectors of a label form one class first and are compared once; they count as links.
The driver holds one box for each SUPER * BLOCK vectors or part of a label, nothing else.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
or have a null label, link with nothing (0 links, a component of their own); vectors of
different lengths do not link; rows that share an id are vectors of their own. A row with
a null id is compared and counted like any other; its component is the least id reachable,
null and kept if there is none. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, bounded_sample
from .graph import components

LEADING, BLOCK, SUPER, SAMPLE = 32, 1024, 256, 4096
SLACK = 1e-4  # of sketches, which are 32-bit floats


def directions(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """Leading principal directions (dim x k) by vector length."""
    out = {}
    for d in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == d], np.float64))
        out[d] = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1][:, :LEADING]
    return out


def sketch(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """LEADING projections of unit vectors, padded by 0, and the norm of the rest."""
    d = x.shape[1]
    p = x @ basis[d] if d in basis else x[:, :LEADING]
    rest = np.sqrt(np.maximum(1 - (p * p).sum(axis=1, keepdims=True), 0))
    return np.hstack([p, np.zeros((len(p), LEADING - p.shape[1])), rest])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grid(classes: DataFrame, basis: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Adds the cells of the sketches."""

    def run(batch: pa.RecordBatch):
        size = np.array(batch.column(4).value_lengths())
        for d in np.unique(size).tolist():
            part = batch.filter(pa.array(size == d))
            p = sketch(unit(matrix(part.column(4), d)), basis)
            cells = pa.array(np.floor(p / eps).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, "cells"])

    return arrow_map(classes.select("label", "dim", "node", "m", "v"), run, "label string, dim int, node long, m long, v array<double>, cells array<int>")


def blocks(placed: DataFrame, basis: dict[int, np.ndarray], size: int, partitions: int) -> DataFrame:
    """The grid order cut into blocks: (block, super, label, dim, low, high, nodes, m, sketch, body)."""
    from pyspark import TaskContext

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        within, last = 0, None
        for batch in batches:
            label, dim = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            same = np.array([a == b for a, b in zip(label[1:], label[:-1], strict=True)], bool) & (dim[1:] == dim[:-1])
            edge = [0, *(np.flatnonzero(~same) + 1).tolist(), len(label)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                for lo in range(a, z, size):
                    part, d = batch.slice(lo, min(size, z - lo)), int(dim[lo])
                    if within == SUPER or last != (label[lo], d):
                        within, last, interval = 0, (label[lo], d), number
                    u = unit(matrix(part.column(4), d))
                    p = sketch(u, basis)
                    boxes = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (p.min(axis=0), p.max(axis=0))]
                    bodies = [pa.array([x.tobytes()], pa.binary()) for x in (part.column(2).to_numpy(), part.column(3).to_numpy(), p.astype(np.float32), u)]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([interval], pa.int64()), pa.array([label[lo]], pa.string()), pa.array([d], pa.int32()), *boxes, *bodies], ["block", "super", "label", "dim", "low", "high", "nodes", "m", "sketch", "body"])
                    number, within = number + 1, within + 1

    order = ["label", "dim", "cells", "node"]
    cut = placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("label", "dim", "node", "m", "v")
    return cut.mapInArrow(run, "block long, super long, label string, dim int, low array<double>, high array<double>, nodes binary, m binary, sketch binary, body binary")


class Directory:
    """Bounding boxes of the intervals of each label, as a tree over their sequence."""

    def __init__(self, rows: list[tuple], eps: float):
        self.eps = eps
        self.own: dict[tuple, list] = {}
        self.place: dict[int, int] = {}
        for name, label, dim, low, high in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            line = self.own.setdefault((label, dim), [])
            self.place[name] = len(line)
            line.append((name, np.array(low), np.array(high)))
        self.boxes: dict[tuple, tuple] = {}

    def box(self, key: tuple, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (key, lo, hi) not in self.boxes:
            if hi - lo == 1:
                found = self.own[key][lo][1:]
            else:
                mid = (lo + hi) // 2
                a, b = self.box(key, lo, mid), self.box(key, mid, hi)
                found = np.minimum(a[0], b[0]), np.maximum(a[1], b[1])
            self.boxes[key, lo, hi] = found
        return self.boxes[key, lo, hi]

    def near(self, key: tuple, at: int, lo: int, hi: int):
        """Intervals of the part lo..hi, from `at` on, that may hold a vector within eps of interval `at`."""
        if hi <= at:
            return
        if lo < at:  # a part that reaches back is cut, so that no box of what lies before counts
            mid = (lo + hi) // 2
            yield from self.near(key, at, lo, mid)
            yield from self.near(key, at, mid, hi)
            return
        (low, high), (own_low, own_high) = self.box(key, lo, hi), self.own[key][at][1:]
        gap = np.maximum(0, np.maximum(low - own_high, own_low - high))
        if (gap * gap).sum() > self.eps * self.eps:
            return
        if hi - lo == 1:
            yield self.own[key][lo][0]
        else:
            mid = (lo + hi) // 2
            yield from self.near(key, at, lo, mid)
            yield from self.near(key, at, mid, hi)


def near_blocks(kept: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """Pairs (i, j) of blocks, i <= j, that may hold linked vectors."""
    size = LEADING + 1
    least = F.array(*(F.min(F.col("low")[k]) for k in range(size)))
    most = F.array(*(F.max(F.col("high")[k]) for k in range(size)))
    supers = kept.groupBy("super", "label", "dim").agg(least.alias("low"), most.alias("high"))
    directory = Directory([tuple(r) for r in supers.collect()], eps)
    sent = kept.sparkSession.sparkContext.broadcast(directory)

    def partners(batch: pa.RecordBatch):
        names: Directory = sent.value
        a, b = [], []
        for name, label, dim in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            found = list(names.near((label, dim), names.place[name], 0, len(names.own[label, dim])))
            a += [name] * len(found)
            b += found
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    near = scratch.keep(arrow_map(supers.select("super", "label", "dim"), partners, "a long, b long"))
    inside = kept.groupBy("super").agg(F.collect_list(F.struct("block", "low", "high")).alias("inside"))  # SUPER at most
    inside = scratch.keep(inside)
    sides = [inside.select(F.col("super").alias(x), F.col("inside").alias(f"in_{x}")) for x in "ab"]

    def boxes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = column.values
        return rows.field("block").to_numpy(), *(rows.field(c).flatten().to_numpy().reshape(-1, size) for c in ("low", "high"))

    def test(batch: pa.RecordBatch):
        for r in range(batch.num_rows):
            (ni, li, hi), (nj, lj, hj) = (boxes(pa.ListArray.from_arrays([0, len(x)], x)) for x in (batch.column(c)[r].values for c in (0, 1)))
            i, j = [], []
            for name, low, high in zip(ni.tolist(), li, hi, strict=True):
                gap = np.maximum(0, np.maximum(lj - high, low - hj))
                found = nj[((gap * gap).sum(axis=1) <= eps * eps) & (nj >= name)]
                i.append(np.full(len(found), name))
                j.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(i), pa.int64()), pa.array(np.concatenate(j), pa.int64())], ["i", "j"])

    both = near.join(sides[0], "a").join(sides[1], "b").select("in_a", "in_b")
    return scratch.keep(arrow_map(both, test, "i long, j long"))


def possible(threshold: float):
    """Of block pairs (i, j, sketches): which rows of each side have a partner that their sketches allow."""

    def run(batch: pa.RecordBatch):
        rows = []
        for r in range(batch.num_rows):
            i, j = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            x, y = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float32).reshape(-1, LEADING + 1) for c in (2, 3))
            hit = x @ y.T >= threshold - SLACK
            if i == j:
                np.fill_diagonal(hit, False)
            left, right = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if len(left):
                rows.append((i, i, j, 0, left.astype(np.int32).tobytes()))
                if i != j:
                    rows.append((j, i, j, 1, right.astype(np.int32).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], k) for c, k in enumerate(kinds)], ["block", "i", "j", "side", "rows"])

    return run


def cut_out(requests: pa.Table, body: pa.Table) -> pa.Table:
    """The rows of one block that pairs ask for: (i, j, side, dim, nodes, m, body)."""
    out = []
    if body.num_rows:
        d = body["dim"][0].as_py()
        nodes, m, x = (np.frombuffer(body[c][0].as_py(), t) for c, t in (("nodes", np.int64), ("m", np.int64), ("body", np.float64)))
        x = x.reshape(-1, d)
        for i, j, side, rows in zip(*(requests[c].to_pylist() for c in ("i", "j", "side", "rows")), strict=True):
            at = np.frombuffer(rows, np.int32)
            out.append((i, j, side, d, nodes[at].tobytes(), m[at].tobytes(), x[at].tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([x[c] for x in out], k) for c, (n, k) in enumerate(zip(("i", "j", "side", "dim", "nodes", "m", "body"), kinds, strict=True))})


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place that each of n places reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def compare(threshold: float):
    """Links of the rows of a pair of blocks: (node, links, root)."""

    def run(group: pa.Table) -> pa.Table:
        sides = sorted(zip(*(group[c].to_pylist() for c in ("side", "dim", "nodes", "m", "body")), strict=True))
        nodes, m, x = ([np.frombuffer(s[c], t) for s in sides] for c, t in ((2, np.int64), (3, np.int64), (4, np.float64)))
        x = [v.reshape(-1, sides[0][1]) for v in x]
        linked = x[0] @ x[-1].T >= threshold
        if len(sides) == 1:
            np.fill_diagonal(linked, False)
        a, b = np.nonzero(linked)
        if len(sides) == 2:
            own, count, b = np.concatenate(nodes), np.concatenate([linked @ m[1], linked.T @ m[0]]), b + len(nodes[0])
        else:
            own, count = nodes[0], linked @ m[0]
        order = np.argsort(own, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        root = own[order][forest(len(own), place[a], place[b])][place]
        some = count > 0
        return pa.table({"node": pa.array(own[some]), "links": pa.array(count[some].astype(np.int64)), "root": pa.array(root[some])})

    return run


def grid_order(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as read, classes of equal vectors, and the blocks of their grid order."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    sound = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.coalesce(sound, F.lit(False)))
    classes = usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = scratch.keep(classes.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}))  # written once, so the names hold
    n = classes.count()
    basis = directions([r[0] for r in bounded_sample(classes, SAMPLE, "label", "v").select("v").collect()])
    return rows, classes, scratch.keep(blocks(grid(classes, basis, epsilon(threshold)), basis, block, max(1, math.ceil(n / (4 * block)))))


def epsilon(threshold: float) -> float:
    return math.sqrt(2 - 2 * threshold) + 1e-6


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows, classes, kept = grid_order(vectors, threshold, id_col, vector_col, label_col, block, scratch)
    pairs = near_blocks(kept, epsilon(threshold), scratch)
    sides = [kept.select(F.col("block").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ij"]
    both = pairs.join(sides[0], "i").join(sides[1], "j").select("i", "j", "si", "sj")
    asked = scratch.keep(arrow_map(both, possible(threshold), "block long, i long, j long, side int, rows binary"))
    bodies = kept.select("block", "dim", "nodes", "m", "body")
    parts = asked.groupBy("block").cogroup(bodies.groupBy("block")).applyInArrow(cut_out, "i long, j long, side int, dim int, nodes binary, m binary, body binary")
    found = scratch.keep(parts.groupBy("i", "j").applyInArrow(compare(threshold), "node long, links long, root long"))
    comps = components(found.where("node > root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = classes.join(links, "node", "left").join(comps.select(F.col("id").alias("node"), "comp"), "node", "left")
    info = scratch.keep(info.select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")))
    names = info.groupBy("comp").agg(F.min("rep").alias("component"))
    info = info.join(names, "comp").select("label", "v", "n_links", "component")
    out = rows.join(info, ["label", "v"], "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, comp.isNull()).alias("kept"))
