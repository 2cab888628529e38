"""Ordered scans over signals (series, k, x): filters, controllers, scalar estimators, integration.

One step function serves the batch form and the streaming form (state per series). The batch
form sorts in Spark and streams the samples of a partition through Python, carrying one state,
so no series has to fit a worker. Linear filters also have linear_scan(), which splits a long
series over tasks: a range of samples acts on the state by a matrix and a vector.

Null and NaN samples leave the state as it is and give null, in both forms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numfold.protocols import Step


def biquad_step(b0: float, b1: float, b2: float, a1: float, a2: float) -> Step:
    """Second-order section, transposed direct form II; state (z0, z1)."""

    def step(z: list, x: float) -> tuple[list, float]:
        y = b0 * x + z[0]
        return [b1 * x - a1 * y + z[1], b2 * x - a2 * y], y

    return step


def cascade_step(sections: list[tuple[float, float, float, float, float]]) -> Step:
    steps = [biquad_step(*s) for s in sections]

    def step(z: list, x: float) -> tuple[list, float]:
        out = []
        for k, f in enumerate(steps):
            own, x = f(z[2 * k : 2 * k + 2], x)
            out += own
        return out, x

    return step


def pid_step(kp: float, ki: float, kd: float, dt: float, setpoint: float, low: float = -math.inf, high: float = math.inf, tau: float = 0.0, kb: float | None = None) -> Step:
    """Trapezoidal integral, derivative on the measurement, clamp, back-calculation; state (integral, last error, last measurement, derivative, started)."""
    kb = kb if kb is not None else (ki / kp if kp else ki)
    alpha = dt / (tau + dt)

    def step(z: list, m: float) -> tuple[list, float]:
        integral, e1, m1, d, started = z
        e = setpoint - m
        if started:
            integral += ki * 0.5 * (e + e1) * dt
            d += alpha * (-(m - m1) / dt - d)
        u = kp * e + integral + kd * d
        clamped = min(max(u, low), high)
        if started:
            integral += kb * (clamped - u) * dt
        return [integral, e, m, d, 1.0], clamped

    return step


def kalman_step(a: float, q: float, h: float, r: float, gamma: float = 1.0, gate: float = math.inf) -> Step:
    """Scalar Kalman filter with fading memory and an NIS gate; state (x, p)."""

    def step(s: list, z: float) -> tuple[list, float]:
        x, p = a * s[0], gamma * a * a * s[1] + q
        y, v = z - h * x, h * h * p + r
        if y * y / v > gate:
            return [x, p], x
        k = p * h / v
        x += k * y
        return [x, (1 - k * h) ** 2 * p + k * k * r], x

    return step


def missing(x: float | None) -> bool:
    return x is None or x != x


def in_order(signal: DataFrame) -> DataFrame:
    """Whole series in a partition each, sorted, with spilling left to Spark."""
    return signal.select(F.col("series").cast("long").alias("series"), F.col("k").cast("long").alias("k"), "x").repartition("series").sortWithinPartitions("series", "k")


def scan(signal: DataFrame, step: Step, start: list[float]) -> DataFrame:
    """(series, k, y) in each series' order of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run  # no series is this
        state: list = []
        for batch in batches:
            out = []
            for series, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if series != now:
                    now, state = series, list(start)
                if missing(x):
                    out.append(None)
                else:
                    state, y = step(state, x)
                    out.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["series", "k", "y"])

    return in_order(signal).mapInArrow(run, "series long, k long, y double")


Linear = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def cascade(sections: list[tuple[float, float, float, float, float]]) -> Linear:
    """Sections in series as one linear step: z' = A z + b x and y = c z + d x, transposed direct form II."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        i, j = 2 * k, 2 * k + 1
        into, x = c.copy(), d  # what the section is fed, in terms of the states before and the sample
        out = b0 * into
        out[i] += 1.0
        a[i], b[i] = b1 * into - a1 * out, (b1 - a1 * b0) * x
        a[i, j] += 1.0
        a[j], b[j] = b2 * into - a2 * out, (b2 - a2 * b0) * x
        c, d = out, b0 * x
    return a, b, c, d


def linear_scan(signal: DataFrame, system: Linear, partitions: int | None = None) -> DataFrame:
    """(series, k, y) of a linear step from a zero state, with every series split by ranges of (series, k).

    The first pass runs each part of a series from zero and keeps what it does to a state, one
    row for a part; parts are composed by series (as many as there are partitions at most), and
    the second pass runs them from their true states."""
    from .shared import Shared

    a, b, c, d = system
    n = len(b)
    rows = signal.select(F.col("series").cast("long").alias("series"), F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))
    cut = rows.repartitionByRange(partitions, "series", "k") if partitions else rows.repartitionByRange("series", "k")
    shared = Shared(signal.sparkSession, "scan")
    parts = shared.keep(cut.withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part", "series").agg(F.count(F.when(~F.isnan("x"), F.col("x"))).alias("n"))
    ends = sums.groupBy("series").agg(F.count("*").alias("parts")).where("parts > 1").select("series")

    def run_part(batches: Iterator[pa.RecordBatch], samples: bool) -> Iterator[pa.RecordBatch]:
        now: Any = run_part
        z, seen = np.zeros(n), 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([np.linalg.matrix_power(a, seen).reshape(-1).tolist()]), pa.array([z.tolist()])], ["part", "series", "m", "v"])

        for batch in batches:
            part, series, xs = (batch.column(k).to_pylist() for k in (0, 1, 3))
            starts = batch.column(4).to_pylist() if samples else None
            out = []
            for i, (key, x) in enumerate(zip(zip(part, series, strict=True), xs, strict=True)):
                if key != now:
                    if not samples and now is not run_part:
                        yield done()
                    now, seen = key, 0
                    z = np.array(starts[i] or [0.0] * n) if samples else np.zeros(n)
                if missing(x):
                    out.append(None)
                else:
                    out.append(float(c @ z + d * x))
                    z, seen = a @ z + b * x, seen + 1
            if samples:
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.float64())], ["series", "k", "y"])
        if not samples and now is not run_part:
            yield done()

    long = parts.join(ends, "series", "left_semi").select("part", "series", "k", "x")
    effects = shared.keep(long.repartition("part", "series").sortWithinPartitions("part", "series", "k").mapInArrow(lambda x: run_part(x, False), "part int, series long, m array<double>, v array<double>"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        z, out = np.zeros(n), []
        for m, v in zip(pdf["m"], pdf["v"], strict=True):
            out.append(z.tolist())
            z = np.asarray(m).reshape(n, n) @ z + np.asarray(v)
        return pd.DataFrame({"part": pdf["part"], "series": pdf["series"], "start": out})

    starts = shared.keep(effects.groupBy("series").applyInPandas(compose, "part int, series long, start array<double>"))
    ready = parts.join(starts, ["part", "series"], "left").select("part", "series", "k", "x", "start")
    return ready.repartition("part", "series").sortWithinPartitions("part", "series", "k").mapInArrow(lambda x: run_part(x, True), "series long, k long, y double")


def biquad_fold(x: Column, b0: float, b1: float, b2: float, a1: float, a2: float) -> Column:
    """Last output of the section over an ordered array, as one expression."""
    start = F.struct(F.lit(0.0).alias("z0"), F.lit(0.0).alias("z1"), F.lit(0.0).alias("y"))

    def step(z: Column, v: Column) -> Column:
        y = b0 * v + z["z0"]
        return F.struct((b1 * v - a1 * y + z["z1"]).alias("z0"), (b2 * v - a2 * y).alias("z1"), y.alias("y"))

    return F.aggregate(x, start, step, lambda z: z["y"])


def rk4_linear(y0: Column, rate: float, dt: float, steps: int) -> Column:
    """Classic Runge-Kutta for y' = rate * y."""

    def step(y: Column, _: Column) -> Column:
        k1 = rate * y
        k2 = rate * (y + 0.5 * dt * k1)
        k3 = rate * (y + 0.5 * dt * k2)
        k4 = rate * (y + dt * k3)
        return y + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y0.cast("double"), step)


def streaming(step: Step, start: list[float]):
    """A stateful function for applyInPandasWithState: (series, k, y), state (values array)."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values = list(state.get[0]) if state.exists else list(start)
        rows = pd.concat(list(frames)).sort_values("k")
        out = []
        for x in rows["x"].tolist():
            if missing(x):
                out.append(None)
            else:
                values, y = step(values, x)
                out.append(y)
        state.update((values,))
        yield pd.DataFrame({"series": rows["series"], "k": rows["k"], "y": pd.Series(out, index=rows.index, dtype="float64")})

    return run
