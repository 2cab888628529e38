"""Connected components within groups by alternating large-star and small-star steps over kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared


def settled(links: DataFrame, by: str) -> bool:
    """Whether links (by, a, b) are stars: every a names one b, and no b is an a itself."""
    ends = links.select(by, F.col("a").alias("u"), F.lit(1).alias("child")).union(links.select(by, "b", F.lit(0)))
    seen = ends.groupBy(by, "u").agg(F.sum("child").alias("c"), F.min("child").alias("low"))
    return seen.where("c > 1 or (c = 1 and low = 0)").isEmpty()


def components(links: DataFrame, shared: Shared, by: str) -> DataFrame:
    """Rows (by, id, comp) of every id that has a smaller one in its component; comp is the smallest.

    links: a group column `by`, then a and b (long). Only kept tables of links move between
    rounds; the driver learns of each round whether it was the last."""
    pairs = links.where("a <> b").select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = shared.keep(pairs.distinct())
    while not settled(now, by):
        both = now.union(now.select(by, "b", "a")).toDF(by, "u", "v")
        least = shared.keep(both.groupBy(by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = shared.keep(both.join(least, [by, "u"]).where("v > u").select(by, F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least2 = shared.keep(large.groupBy(by, "a").agg(F.min("b").alias("m")))
        pairs = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        new = shared.keep(large.join(least2, [by, "a"]).select(by, pairs.alias("x")).select(by, "x.a", "x.b").where("a <> b").distinct())
        shared.drop(least, large, least2, now)
        now = new
    return now.toDF(by, "id", "comp")
