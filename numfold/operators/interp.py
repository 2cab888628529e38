"""Interpolation of queries (x) on knots (x, y): each query meets the knots around it, then expressions.

Up to KNOTS knots (8 bytes a column each) are sent to the executors as sorted arrays and
searched there. Beyond, queries and knots are sorted together in range partitions, windows
carry the nearest knots to the queries, and one row a partition closes the gaps between
partitions; nothing else is collected. Both ways give the same values.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import Shared

KNOTS, BLOCK, OVERLAP = 1_000_000, 100_000, 64


class InterpError(ValueError):
    """Too few knots, knots that do not increase, or lengths that differ."""


def arrays(knots: DataFrame, *columns: str, least: int = 2) -> list[np.ndarray]:
    """Sorted knots on the driver, KNOTS at most."""
    rows = knots.select(*columns).orderBy(columns[0]).limit(KNOTS + 1).toArrow()
    if not least <= rows.num_rows <= KNOTS:
        raise InterpError(f"needs {least} to {KNOTS} knots, got {rows.num_rows}")
    out = [rows[c].cast(pa.float64()).to_numpy() for c in columns]
    if not (np.diff(out[0]) > 0).all():
        raise InterpError("knots must be strictly increasing")
    return out


def place(xs: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(xs, x, "right") - 1, 0, len(xs) - 2)


def with_columns(df: DataFrame, f, names: list[str]) -> DataFrame:
    """df with double columns computed from x by batches; null for a null x."""
    at = df.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).cast(pa.float64())
            gone = np.array(x.is_null(), bool)
            found = f(x.fill_null(0.0).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, mask=gone) for v in found)], [*batch.schema.names, *names])

    kinds = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return df.mapInArrow(run, kinds)


def sorted_apart(rows: DataFrame, n: int, shared: Shared, *order: str) -> DataFrame:
    """Range partitions of rows, kept, with their number as `part`."""
    cut = rows.repartitionByRange(max(1, math.ceil(n / BLOCK)), *order)
    return shared.keep(cut.withColumn("part", F.spark_partition_id()))


def around(queries: DataFrame, knots: DataFrame, columns: list[str]) -> DataFrame:
    """queries with the columns of the knots around x as l_* and r_*; outside, those of the end segment."""
    names = [f"{side}_{c}" for side in "lr" for c in ("x", *columns)]
    n = knots.count()
    if n <= KNOTS:
        found = arrays(knots, "x", *columns)

        def look(x: np.ndarray) -> list[np.ndarray]:
            i = place(found[0], x)
            return [v[i] for v in found] + [v[i + 1] for v in found]

        return with_columns(queries, look, names)
    shared = Shared(queries.sparkSession, "knots")
    if not knots.groupBy("x").count().where("count > 1 or x is null").isEmpty():
        raise InterpError("knots must be strictly increasing")
    values = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", *columns)))
    points = queries.select(F.col("x").cast("double").alias("x")).where("x is not null").distinct()
    both = knots.select(F.col("x").cast("double").alias("x"), F.lit(0).alias("kind"), values.alias("knot")).unionByName(points.select("x", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = sorted_apart(both, n, shared, "x", "kind")
    up = Window.partitionBy("part").orderBy("x", "kind")
    down = Window.partitionBy("part").orderBy(F.desc("x"), F.desc("kind"))
    near = rows.select("x", "kind", "part", F.last("knot", ignorenulls=True).over(up).alias("l"), F.last("knot", ignorenulls=True).over(down).alias("r")).where("kind = 1")
    edges = rows.where("kind = 0").groupBy("part").agg(F.min_by("knot", "x").alias("a"), F.max_by("knot", "x").alias("z")).orderBy("part").collect()  # one row a partition
    parts = [r["part"] for r in rows.select("part").distinct().collect()]
    before = {p: next((e["z"] for e in reversed(edges) if e["part"] < p), None) for p in parts}
    after = {p: next((e["a"] for e in edges if e["part"] > p), None) for p in parts}
    kind = rows.schema["knot"].dataType
    gaps = queries.sparkSession.createDataFrame([(p, before[p], after[p]) for p in parts], StructType([StructField("part", rows.schema["part"].dataType), StructField("before", kind), StructField("after", kind)]))
    first, second = knots.select(values.alias("k")).orderBy("k.x").limit(2).collect()
    last, last_but_one = knots.select(values.alias("k")).orderBy(F.desc("k.x")).limit(2).collect()
    fixed = lambda row: F.struct(*(F.lit(float(row["k"][c])).alias(c) for c in ("x", *columns)))
    closed = near.join(F.broadcast(gaps), "part").select("x", F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))
    left = F.when(F.col("l").isNull(), fixed(first)).when(F.col("r").isNull(), fixed(last_but_one)).otherwise(F.col("l"))
    right = F.when(F.col("l").isNull(), fixed(second)).when(F.col("r").isNull(), fixed(last)).otherwise(F.col("r"))
    segments = closed.select(F.col("x").alias("at_x"), left.alias("l"), right.alias("r")).select("at_x", *(F.col(f"{n[0]}.{n[2:]}").alias(n) for n in names))
    return queries.join(segments, queries["x"].cast("double") == F.col("at_x"), "left").drop("at_x")


def evaluated(found: DataFrame, queries: DataFrame, y: Column, slope: Column) -> DataFrame:
    return found.select(*queries.columns, y.alias("y"), slope.alias("slope"))


def linear(queries: DataFrame, knots: DataFrame) -> DataFrame:
    """queries with y and slope; points outside extrapolate the end segments."""
    slope = (F.col("r_y") - F.col("l_y")) / (F.col("r_x") - F.col("l_x"))
    return evaluated(around(queries, knots, ["y"]), queries, F.col("l_y") + slope * (F.col("x") - F.col("l_x")), slope)


def hermite(queries: DataFrame, knots: DataFrame) -> DataFrame:
    """Cubic Hermite on knots (x, y, dy): y and slope."""
    h = F.col("r_x") - F.col("l_x")
    t = (F.col("x") - F.col("l_x")) / h
    a, b, p, q = F.col("l_y"), F.col("r_y"), F.col("l_dy"), F.col("r_dy")
    y = (1 + 2 * t) * (1 - t) * (1 - t) * a + t * (1 - t) * (1 - t) * h * p + t * t * (3 - 2 * t) * b + t * t * (t - 1) * h * q
    slope = 6 * t * (t - 1) * (a - b) / h + (1 - t) * (1 - 3 * t) * p + t * (3 * t - 2) * q
    return evaluated(around(queries, knots, ["y", "dy"]), queries, y, slope)


def second_derivatives(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Of the natural cubic spline, by elimination of its tridiagonal system."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    n = len(xs) - 2
    diagonal, rhs = 2 * (h[:-1] + h[1:]), 6 * np.diff(d)
    c, g = np.zeros(n), np.zeros(n)
    for k in range(n):
        w = diagonal[k] - (h[k] * c[k - 1] if k else 0)
        c[k], g[k] = h[k + 1] / w, (rhs[k] - (h[k] * g[k - 1] if k else 0)) / w
    out = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        out[k + 1] = g[k] - c[k] * out[k + 2]
    return out


def bent(knots: DataFrame) -> DataFrame:
    """knots (x, y) with the spline's second derivative m.

    Many knots are solved in blocks of BLOCK by rank with OVERLAP more on both sides: an end
    value's influence at least halves from knot to knot, so what is cut off is below rounding."""
    if knots.count() <= KNOTS:
        xs, ys = arrays(knots, "x", "y", least=3)
        m = second_derivatives(xs, ys)
        return knots.sparkSession.createDataFrame(pa.table({"x": xs, "y": ys, "m": m}))
    shared = Shared(knots.sparkSession, "spline")
    rows = sorted_apart(knots.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), knots.count(), shared, "x")
    sizes = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())  # one row a partition
    starts = knots.sparkSession.createDataFrame([(p, sum(c for q, c in sizes if q < p)) for p, _ in sizes], "part int, start long")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1
    ranked = rows.join(F.broadcast(starts), "part").select("x", "y", rank.alias("rank"))
    own = F.floor(F.col("rank") / BLOCK)
    near = F.filter(F.array(own - 1, own, own + 1), lambda b: (b >= 0) & (F.col("rank") >= b * BLOCK - OVERLAP) & (F.col("rank") < (b + 1) * BLOCK + OVERLAP))
    dealt = ranked.select("x", "y", "rank", F.explode(near).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        m = second_derivatives(pdf["x"].to_numpy(), pdf["y"].to_numpy()) if len(pdf) > 2 else np.zeros(len(pdf))
        mine = (pdf["rank"] // BLOCK == pdf["block"]).to_numpy()
        return pd.DataFrame({"x": pdf["x"][mine], "y": pdf["y"][mine], "m": m[mine]})

    return shared.keep(dealt.groupBy("block").applyInPandas(run, "x double, y double, m double"))


def spline(queries: DataFrame, knots: DataFrame) -> DataFrame:
    """Natural cubic spline, at least three knots: y and slope."""
    h = F.col("r_x") - F.col("l_x")
    a, b = F.col("r_x") - F.col("x"), F.col("x") - F.col("l_x")
    m, n, p, q = F.col("l_m"), F.col("r_m"), F.col("l_y"), F.col("r_y")
    y = (m * a * a * a + n * b * b * b) / (6 * h) + (p / h - m * h / 6) * a + (q / h - n * h / 6) * b
    slope = (n * b * b - m * a * a) / (2 * h) + (q - p) / h - (n - m) * h / 6
    return evaluated(around(queries, bent(knots), ["y", "m"]), queries, y, slope)


def lagrange(queries: DataFrame, knots: DataFrame) -> DataFrame:
    """Barycentric form, y and slope; at a knot its value. A polynomial through more than KNOTS knots is an error."""
    xs, ys = arrays(knots, "x", "y", least=1)
    gaps = xs[:, None] - xs
    np.fill_diagonal(gaps, 1.0)
    w = 1 / gaps.prod(axis=1)
    rows = max(1, (1 << 20) // len(xs))

    def part(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = x[:, None] - xs
        hit = np.abs(gap) < 1000 * np.finfo(float).eps
        at, on = hit.argmax(axis=1), hit.any(axis=1)
        r = np.where(hit, 0.0, w / np.where(hit, 1.0, gap))
        total = np.where(on, 1.0, r.sum(axis=1))
        y = np.where(on, ys[at], (r * ys).sum(axis=1) / total)
        change = (r * (y[:, None] - ys) / np.where(hit, 1.0, gap)).sum(axis=1)
        between = np.where(np.arange(len(xs)) == at[:, None], 0.0, w * (ys[at][:, None] - ys) / np.where(np.arange(len(xs)) == at[:, None], 1.0, xs[at][:, None] - xs)).sum(axis=1)
        return y, np.where(on, -between / w[at], change / total)

    def f(x: np.ndarray) -> list[np.ndarray]:
        parts = [part(x[k : k + rows]) for k in range(0, len(x), rows)] or [(x, x)]
        return [np.concatenate(v) for v in zip(*parts, strict=True)]

    return with_columns(queries, f, ["y", "slope"])


def bilinear(x: Column, y: Column, xs: list[float], ys: list[float], z: list[list[float]]) -> Column:
    """Bilinear value on a grid; outside points extrapolate."""
    if len(z) != len(xs) or any(len(row) != len(ys) for row in z):
        raise InterpError("the grid's sides differ from its axes")
    for axis in (xs, ys):
        if len(axis) < 2 or any(b <= a for a, b in zip(axis, axis[1:], strict=False)):
            raise InterpError("an axis has two values at least, and they increase")

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        gx, gy, g = np.array(xs), np.array(ys), np.array(z)
        p, q = a.to_numpy(float), b.to_numpy(float)
        i, j = place(gx, p), place(gy, q)
        t, u = (p - gx[i]) / (gx[i + 1] - gx[i]), (q - gy[j]) / (gy[j + 1] - gy[j])
        return pd.Series((1 - t) * (1 - u) * g[i, j] + t * (1 - u) * g[i + 1, j] + (1 - t) * u * g[i, j + 1] + t * u * g[i + 1, j + 1])

    return run(x, y)


def find_interval(xs: list[float], x: float) -> int:
    return min(max(bisect_right(xs, x) - 1, 0), len(xs) - 2)
