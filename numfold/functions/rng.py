"""Seeded random streams, one for each row: xoshiro256++ from a splitmix64 seed, bit for bit.

A batch of rows advances together; where a draw is rejected, only that row's stream goes on."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64


class Streams:
    def __init__(self, seeds: np.ndarray):
        at, state = seeds.astype(np.int64).view(U), []
        for _ in range(4):
            at = at + U(0x9E3779B97F4A7C15)
            z = (at ^ (at >> U(30))) * U(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
            state.append(z ^ (z >> U(31)))
        self.state = np.array(state).reshape(4, len(seeds))

    def bits(self, rows: np.ndarray) -> np.ndarray:
        """The next 64 bits of the streams of those row numbers."""
        a, b, c, d = self.state[:, rows]
        turn = lambda x, k: (x << U(k)) | (x >> U(64 - k))
        out = turn(a + d, 23) + a
        c, d = c ^ a, d ^ b
        self.state[:, rows] = a ^ d, b ^ c, c ^ (b << U(17)), turn(d, 45)
        return out

    def uniform(self, rows: np.ndarray) -> np.ndarray:
        return (self.bits(rows) >> U(11)).astype(np.float64) * 2.0**-53

    def until(self, rows: np.ndarray, attempt: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Repeats attempt(rows) -> (values, accepted) for the rows not yet accepted."""
        out, left = np.zeros(len(rows)), np.arange(len(rows))
        while len(left):
            value, good = attempt(rows[left])
            out[left[good]] = value[good]
            left = left[~good]
        return out

    def normal(self, rows: np.ndarray) -> np.ndarray:
        """Box and Muller, cosine branch."""

        def attempt(some: np.ndarray):
            u, v = self.uniform(some), self.uniform(some)
            return np.sqrt(-2 * np.log(np.where(u > 0, u, 1.0))) * np.cos(2 * math.pi * v), u > 0

        return self.until(rows, attempt)

    def gamma(self, rows: np.ndarray, shape: float) -> np.ndarray:
        """Marsaglia and Tsang with rate 1; below shape 1 from the next shape and a power of a uniform."""
        if shape < 1:
            grown = self.gamma(rows, shape + 1)
            return grown * self.uniform(rows) ** (1 / shape)
        d = shape - 1 / 3
        c = 1 / math.sqrt(9 * d)

        def attempt(some: np.ndarray):
            x = self.normal(some)
            v = 1 + c * x
            good = v > 0
            cube, u = np.where(good, v, 1.0) ** 3, np.ones(len(some))
            u[good] = self.uniform(some[good])
            with np.errstate(divide="ignore"):
                fits = (u < 1 - 0.0331 * x**4) | (np.log(u) < 0.5 * x * x + d * (1 - cube + np.log(cube)))
            return d * cube, good & fits

        return self.until(rows, attempt)

    def poisson(self, rows: np.ndarray, mean: float) -> np.ndarray:
        """Products of uniforms (Knuth) under a mean of 30, else the rounded normal."""
        if mean >= 30:
            return np.floor(np.maximum(mean + math.sqrt(mean) * self.normal(rows), 0) + 0.5)
        out, product, left = np.zeros(len(rows)), np.ones(len(rows)), np.arange(len(rows))
        while len(left):
            product[left] *= self.uniform(rows[left])
            left = left[product[left] > math.exp(-mean)]
            out[left] += 1
        return out

    def binomial(self, rows: np.ndarray, n: int, p: float) -> np.ndarray:
        """Counted trials up to 20 or where a side expects under 5, else the rounded normal."""
        if n <= 20 or min(n * p, n * (1 - p)) < 5:
            return sum(((self.uniform(rows) < p).astype(float) for _ in range(n)), np.zeros(len(rows)))
        return np.minimum(np.floor(np.maximum(n * p + math.sqrt(n * p * (1 - p)) * self.normal(rows), 0) + 0.5), n)


def student_t(s: Streams, rows: np.ndarray, nu: float) -> np.ndarray:
    z = s.normal(rows)
    return z / np.sqrt(2 * s.gamma(rows, nu / 2) / nu)


def beta(s: Streams, rows: np.ndarray, a: float, b: float) -> np.ndarray:
    x = s.gamma(rows, a)
    return x / (x + s.gamma(rows, b))


#: One draw of each distribution from (streams, rows, parameters).
DRAWS: dict[str, Callable[..., np.ndarray]] = {
    "uniform": lambda s, rows, a, b: a + (b - a) * s.uniform(rows),
    "exponential": lambda s, rows, rate: -np.log(1 - s.uniform(rows)) / rate,
    "normal": lambda s, rows, mu, sigma: mu + sigma * s.normal(rows),
    "gamma": lambda s, rows, shape, rate: s.gamma(rows, shape) / rate,
    "chi_squared": lambda s, rows, k: s.gamma(rows, k / 2) / 0.5,
    "beta": beta,
    "student_t": student_t,
    "bernoulli": lambda s, rows, p: (s.uniform(rows) < p).astype(float),
    "binomial": Streams.binomial,
    "poisson": Streams.poisson,
}


def sample(seed: Column, n: int, kind: str, *parameters: float) -> Column:
    """Array of the first n draws of each row's stream; null for a null seed."""

    @F.pandas_udf("array<double>")
    def run(seeds: pd.Series) -> pd.Series:
        known = seeds.notna().to_numpy()
        streams, rows = Streams(seeds.fillna(0).to_numpy()), np.arange(len(seeds))
        drawn = np.array([DRAWS[kind](streams, rows, *parameters) for _ in range(n)]).reshape(n, len(seeds)).T
        return pd.Series([list(x) if k else None for x, k in zip(drawn, known, strict=True)], dtype=object)

    return run(seed.cast("long"))
