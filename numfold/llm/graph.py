"""Connected components by alternating large-star and small-star steps over kept tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map


class Union:
    """Union-find over any ids whose roots are the smallest ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (n := up.get(top, top)) != top:
            top = n
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def contract(batch: pa.RecordBatch):
    """The links of one batch as stars around its smallest ids."""
    u = Union()
    a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u.link(x, y)
    nodes = np.unique(np.concatenate([a, b]))
    root = np.array([u.root(x) for x in nodes.tolist()], np.int64)
    out = nodes != root
    yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(root[out])], ["a", "b"])


def settled(links: DataFrame) -> bool:
    """Whether links (a, b) are stars: every a names one b, and no b is an a itself."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("child")).union(links.select("b", F.lit(0)))
    seen = ends.groupBy("u").agg(F.sum("child").alias("c"), F.min("child").alias("low"))
    return seen.where("c > 1 or (c = 1 and low = 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, comp) of every id that has a smaller one in its component; comp is the smallest.

    links: two long columns. Only kept tables of links move between rounds; the driver learns
    of each round whether it was the last."""
    now = scratch.keep(arrow_map(links.toDF("a", "b"), contract, "a long, b long").distinct())
    while not settled(now):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least2 = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        spread = large.join(least2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = scratch.keep(spread.select("x.a", "x.b").where("a <> b").distinct())
        scratch.drop(least, large, least2, now)
        now = new
    return now.toDF("id", "comp")
