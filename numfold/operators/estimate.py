"""Kalman filters over signals and their smoother, for states of any size.

A filter keeps its mean and covariance (the square-root form a factor of it) along a series.
A sample that cannot be used, null or with a NaN, is predicted through but not updated with.
Numerical failures never end a job: the row's status names them and the prediction stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numfold.protocols import Motion

from .linalg import rank1_stack, solve_stack
from .scan import in_order
from .shared import Shared

KINDS = ("extended", "unscented", "square_root", "cubature")
#: What is added to a covariance's diagonal, in turn, until it has a factor.
JITTER = (0.0, 1e-9, 1e-7, 1e-5)


class EstimateError(ArithmeticError):
    """CovarianceNotPD or SingularInnovation."""


def jacobian(f: Motion, x: np.ndarray) -> np.ndarray:
    """Forward differences, with steps of sqrt(eps) * max(|x|, 1)."""
    y, out = f(x), []
    for j in range(len(x)):
        h = math.sqrt(np.finfo(float).eps) * max(abs(x[j]), 1.0)
        z = x.copy()
        z[j] += h
        out.append((f(z) - y) / h)
    return np.array(out).T


def root(p: np.ndarray) -> np.ndarray:
    for jitter in JITTER:
        try:
            return np.linalg.cholesky(p + jitter * np.eye(len(p)))
        except np.linalg.LinAlgError:
            continue
    raise EstimateError("CovarianceNotPD")


def gain(cross: np.ndarray, s: np.ndarray) -> np.ndarray:
    """cross times the inverse of the innovation covariance."""
    try:
        return np.linalg.solve(s, cross.T).T
    except np.linalg.LinAlgError:
        raise EstimateError("SingularInnovation") from None


@dataclass
class Model:
    """x' = f(x) with noise q, z = h(x) with noise r; Jacobians by forward differences unless given."""

    f: Motion
    h: Motion
    q: np.ndarray
    r: np.ndarray
    x0: np.ndarray
    p0: np.ndarray
    df: Motion | None = None
    dh: Motion | None = None


@dataclass
class Options:
    """gamma: fading memory; gate: largest normalised innovation squared; rounds, tol: of the iterated update."""

    kind: str = "extended"
    gamma: float = 1.0
    min_variance: float = 0.0
    gate: float = math.inf
    rounds: int = 1
    tol: float = 1e-9
    alpha: float = 1.0
    beta: float = 2.0
    kappa: float = 0.0

    def __post_init__(self):
        if self.kind not in KINDS or self.rounds < 1 or self.gamma < 1:
            raise ValueError(f"a filter is one of {KINDS}, with rounds and gamma of 1 or more")


class Filter:
    def __init__(self, model: Model, options: Options):
        self.model, self.o = model, options
        self.x, p = np.array(model.x0, float), np.array(model.p0, float)
        self.square = options.kind == "square_root"
        self.s = root(p) if self.square else None
        self._p = p

    @property
    def p(self) -> np.ndarray:
        return self.s @ self.s.T if self.square else self._p

    def settle(self, p: np.ndarray) -> None:
        """Symmetric, with a floor under the variances."""
        p = 0.5 * (p + p.T)
        if self.o.min_variance > 0:
            np.fill_diagonal(p, np.maximum(np.diagonal(p), self.o.min_variance))
        self._p = p

    def settle_root(self, s: np.ndarray) -> None:
        self.s = s
        low = (s * s).sum(axis=1) < self.o.min_variance
        if low.any():
            p = s @ s.T
            np.fill_diagonal(p, np.maximum(np.diagonal(p), self.o.min_variance))
            self.s = root(p)

    def points(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sigma points and their weights for means and covariances."""
        n, s = len(self.x), self.s if self.square else root(self._p)
        if self.o.kind == "cubature":
            step = math.sqrt(n) * s.T
            w = np.full(2 * n, 0.5 / n)
            return np.vstack([self.x + step, self.x - step]), w, w
        lam = self.o.alpha**2 * (n + self.o.kappa) - n
        step = math.sqrt(n + lam) * s.T
        wm = np.full(2 * n + 1, 0.5 / (n + lam))
        wm[0] = lam / (n + lam)
        wc = wm.copy()
        wc[0] += 1 - self.o.alpha**2 + self.o.beta
        return np.vstack([self.x, self.x + step, self.x - step]), wm, wc

    @staticmethod
    def spread(deviations: np.ndarray, wc: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Factor of the weighted covariance plus noise: QR of all but the first point, then its rank-one change."""
        rows = np.vstack([np.sqrt(wc[1:, None]) * deviations[1:], root(noise).T])
        r = np.linalg.qr(rows, mode="r")
        low = (r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]).T
        out, good = rank1_stack(low[None], math.sqrt(abs(wc[0])) * deviations[0], math.copysign(1.0, wc[0]))
        if not good[0]:
            raise EstimateError("CovarianceNotPD")
        return out[0]

    def predict(self) -> np.ndarray:
        """Moves to the next sample; returns the Jacobian for the extended kind, else the cross covariance of before and after."""
        m, gamma = self.model, self.o.gamma
        if self.o.kind == "extended":
            j = m.df(self.x) if m.df else jacobian(m.f, self.x)
            self.x = m.f(self.x)
            self.settle(gamma * j @ self._p @ j.T + m.q)
            return j
        pts, wm, wc = self.points()
        y = np.array([m.f(z) for z in pts])
        before, self.x = self.x, wm @ y
        dev = y - self.x
        cross = (wc[:, None] * (pts - before)).T @ dev
        if self.square:
            self.settle_root(self.spread(math.sqrt(gamma) * dev, wc, m.q))
        else:
            self.settle(gamma * (wc[:, None] * dev).T @ dev + m.q)
        return cross

    def update(self, z: np.ndarray) -> float | None:
        """Returns the normalised innovation squared, or None if the gate rejects the sample."""
        m = self.model
        if self.o.kind == "extended":
            x = self.x
            for _ in range(self.o.rounds):
                j = m.dh(x) if m.dh else jacobian(m.h, x)
                s = j @ self._p @ j.T + m.r
                k = gain(self._p @ j.T, s)
                y = z - m.h(x) - j @ (self.x - x)
                new = self.x + k @ y
                moved, x = float(((new - x) ** 2).sum()), new
                if moved < self.o.tol**2:
                    break
            first = z - m.h(self.x)
            j0 = m.dh(self.x) if m.dh else jacobian(m.h, self.x)
            nis = float(first @ gain(first[None], j0 @ self._p @ j0.T + m.r)[0])
            if nis > self.o.gate:
                return None
            i = np.eye(len(self.x)) - k @ j
            self.x = x
            self.settle(i @ self._p @ i.T + k @ m.r @ k.T)
            return nis
        pts, wm, wc = self.points()
        y = np.array([m.h(p) for p in pts])
        mean = wm @ y
        dev = y - mean
        cross = (wc[:, None] * (pts - self.x)).T @ dev
        low = self.spread(dev, wc, m.r) if self.square else None
        s = low @ low.T if self.square else (wc[:, None] * dev).T @ dev + m.r
        k = gain(cross, s)
        e = z - mean
        nis = float(e @ gain(e[None], s)[0])
        if nis > self.o.gate:
            return None
        if self.square:
            factor = self.s[None]
            for u in (k @ low).T:
                factor, good = rank1_stack(factor, u, -1.0)
                if not good[0]:
                    raise EstimateError("CovarianceNotPD")
            self.x = self.x + k @ e
            self.settle_root(factor[0])
        else:
            self.x = self.x + k @ e
            self.settle(self._p - k @ s @ k.T)
        return nis


def sample(x: Any) -> np.ndarray | None:
    if x is None:
        return None
    z = np.atleast_1d(np.array([np.nan if v is None else v for v in x] if isinstance(x, list) else x, float))
    return None if np.isnan(z).any() else z


LISTS = pa.list_(pa.float64())
STEPS = "series long, k long, state array<double>, covariance array<double>, nis double, status string"
BACK = ", before array<double>, spread array<double>, link array<double>"


def track(signal: DataFrame, model: Model, options: Options | None = None, steps: bool = False) -> DataFrame:
    """(series, k, state, covariance, nis, status) of every sample, in each series' order of k.

    x is a number or an array. Status: ok, missing, gated, CovarianceNotPD or SingularInnovation.
    With `steps` the predictions come as well, for the smoother."""
    options = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run
        g = Filter(model, options)
        for batch in batches:
            rows = []
            for series, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if series != now:
                    now, g = series, Filter(model, options)
                z, nis, before, spread, link = sample(x), None, None, None, None
                try:
                    link = g.predict()
                    before, spread = g.x.copy(), g.p.copy()
                    nis = None if z is None else g.update(z)
                    status = "missing" if z is None else "gated" if nis is None else "ok"
                except EstimateError as e:
                    status = str(e)
                flat = [None if v is None else v.reshape(-1).tolist() for v in (before, spread, link)]
                rows.append((g.x.tolist(), g.p.reshape(-1).tolist(), nis, status, *flat))
            kinds = (LISTS, LISTS, pa.float64(), pa.string(), LISTS, LISTS, LISTS)[: 7 if steps else 4]
            names = ["state", "covariance", "nis", "status", "before", "spread", "link"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], ["series", "k", *names[: len(kinds)]])

    return in_order(signal).mapInArrow(run, STEPS + BACK * steps)


def smooth(signal: DataFrame, model: Model, options: Options | None = None) -> DataFrame:
    """(series, k, state, covariance) by the Rauch-Tung-Striebel backward pass; the last sample keeps its filtered state.

    The forward pass is kept in the shared folder and read back in falling order, so no series
    has to fit a worker."""
    options, n = options or Options(), len(model.x0)
    kept = Shared(signal.sparkSession, "smooth").keep(track(signal, model, options, steps=True))
    extended = options.kind == "extended"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = run
        later: tuple = ()
        for batch in batches:
            out = []
            for series, x, p, before, spread, link in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)), strict=True):
                x, p = np.array(x), np.array(p).reshape(n, n)
                if series == now and later[2] is not None:
                    xs, ps, predicted, pp, link_next = later
                    cross = p @ link_next.T if extended else link_next
                    g = np.linalg.solve(pp, cross.T).T
                    x, p = x + g @ (xs - predicted), p + g @ (ps - pp) @ g.T
                now = series
                later = (x, p, *(None if v is None else np.array(v).reshape(shape) for v, shape in ((before, n), (spread, (n, n)), (link, (n, n)))))
                out.append((x.tolist(), p.reshape(-1).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[c] for r in out], LISTS) for c in range(2))], ["series", "k", "state", "covariance"])

    columns = kept.select("series", "k", "state", "covariance", "before", "spread", "link")
    return columns.repartition("series").sortWithinPartitions("series", F.desc("k")).mapInArrow(run, "series long, k long, state array<double>, covariance array<double>")


def batch_lsq(rows: DataFrame, keys: list[str], design: list[Column], z: Column, r: Column | float = 1.0, prior: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(keys, x, information, status): least squares of z on the design columns, weighted by 1 / r, in information form.

    Sums are added up on the map side; one small system a key is solved at the end. The prior
    is a mean and a covariance. Rows with a null are left out; a system that has no solution
    gives null and the status Singular."""
    n = len(design)
    weight = 1 / (F.lit(float(r)) if isinstance(r, (int, float)) else r)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    fit = rows.groupBy(*keys).agg(*(F.sum(design[i] * design[j] * weight).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(d * z * weight).alias(f"b{i}") for i, d in enumerate(design)))
    inverse = np.linalg.inv(prior[1]) if prior else np.zeros((n, n))
    start = inverse @ prior[0] if prior else np.zeros(n)
    names = [f"a{min(i, j)}_{max(i, j)}" for j in range(n) for i in range(n)] + [f"b{i}" for i in range(n)]
    packed = fit.select(*keys, F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in names)).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column(len(keys)).flatten().to_numpy().reshape(-1, n * n + n)
            a, b = sums[:, : n * n].reshape(-1, n, n) + inverse, sums[:, n * n :] + start
            x, good = solve_stack(a, b[:, :, None])
            found = [v.tolist() if g else None for v, g in zip(x[:, :, 0], good, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, LISTS), pa.array(a.reshape(len(a), -1).tolist(), LISTS), pa.array(np.where(good, "ok", "Singular").tolist(), pa.string())], [*keys, "x", "information", "status"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields[: len(keys)])
    return packed.mapInArrow(run, f"{kinds}, x array<double>, information array<double>, status string")
