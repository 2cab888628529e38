"""Distributions as objects of one surface over Column expressions.

A continuous one has pdf, ln_pdf, cdf and quantile, a discrete one pmf, ln_pmf, cdf and
quantile; all have mean, variance and seeded sample arrays. Parameters outside their range
raise StatsError when the object is made."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import rng, special


class StatsError(ValueError):
    """A parameter outside its range."""


def need(condition: bool, message: str) -> None:
    if not condition:
        raise StatsError(message)


class Distribution(ABC):
    kind: str

    @abstractmethod
    def cdf(self, x: Column) -> Column: ...

    @abstractmethod
    def quantile(self, p: Column) -> Column: ...

    @abstractmethod
    def mean(self) -> float: ...

    @abstractmethod
    def variance(self) -> float: ...

    def parameters(self) -> tuple[float, ...]:
        return tuple(self.__dict__.values())

    def sample(self, seed: Column, n: int) -> Column:
        """n draws of the stream of each seed."""
        return rng.sample(seed, n, self.kind, *self.parameters())


class Continuous(Distribution):
    @abstractmethod
    def ln_pdf(self, x: Column) -> Column: ...

    def pdf(self, x: Column) -> Column:
        return F.exp(self.ln_pdf(x))


class Discrete(Distribution):
    @abstractmethod
    def ln_pmf(self, k: Column) -> Column: ...

    def pmf(self, k: Column) -> Column:
        return F.exp(self.ln_pmf(k))


def never() -> Column:
    return F.lit(float("-inf"))


def inside(condition: Column, value: Column) -> Column:
    """The value within the support, minus infinity outside."""
    return F.when(condition, value).otherwise(never())


@dataclass(frozen=True)
class Normal(Continuous):
    mu: float = 0.0
    sigma: float = 1.0
    kind = "normal"

    def __post_init__(self):
        need(self.sigma > 0, "sigma must be positive")

    def ln_pdf(self, x: Column) -> Column:
        z = (x - self.mu) / self.sigma
        return -0.5 * z * z - math.log(self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x: Column) -> Column:
        return special.normal_cdf(x, self.mu, self.sigma)

    def quantile(self, p: Column) -> Column:
        return self.mu + self.sigma * special.normal_quantile(p)

    def mean(self) -> float:
        return self.mu

    def variance(self) -> float:
        return self.sigma**2


@dataclass(frozen=True)
class Uniform(Continuous):
    a: float
    b: float
    kind = "uniform"

    def __post_init__(self):
        need(self.a < self.b, "a must be less than b")

    def ln_pdf(self, x: Column) -> Column:
        return inside((x >= self.a) & (x <= self.b), F.lit(-math.log(self.b - self.a)))

    def cdf(self, x: Column) -> Column:
        return special.uniform_cdf(x, self.a, self.b)

    def quantile(self, p: Column) -> Column:
        return special.uniform_quantile(p, self.a, self.b)

    def mean(self) -> float:
        return (self.a + self.b) / 2

    def variance(self) -> float:
        return (self.b - self.a) ** 2 / 12


@dataclass(frozen=True)
class Exponential(Continuous):
    rate: float
    kind = "exponential"

    def __post_init__(self):
        need(self.rate > 0, "the rate must be positive")

    def ln_pdf(self, x: Column) -> Column:
        return inside(x >= 0, math.log(self.rate) - self.rate * x)

    def cdf(self, x: Column) -> Column:
        return special.exponential_cdf(x, self.rate)

    def quantile(self, p: Column) -> Column:
        return special.exponential_quantile(p, self.rate)

    def mean(self) -> float:
        return 1 / self.rate

    def variance(self) -> float:
        return 1 / self.rate**2


@dataclass(frozen=True)
class Gamma(Continuous):
    shape: float
    rate: float
    kind = "gamma"

    def __post_init__(self):
        need(self.shape > 0 and self.rate > 0, "shape and rate must be positive")

    def ln_pdf(self, x: Column) -> Column:
        return inside(x > 0, self.shape * math.log(self.rate) + (self.shape - 1) * F.log(x) - self.rate * x - math.lgamma(self.shape))

    def cdf(self, x: Column) -> Column:
        return special.gamma_cdf(F.greatest(x, F.lit(0.0)), self.shape, self.rate)

    def quantile(self, p: Column) -> Column:
        return special.gamma_quantile(p, self.shape, self.rate)

    def mean(self) -> float:
        return self.shape / self.rate

    def variance(self) -> float:
        return self.shape / self.rate**2


@dataclass(frozen=True)
class ChiSquared(Continuous):
    k: float
    kind = "chi_squared"

    def __post_init__(self):
        need(self.k > 0, "the degrees of freedom must be positive")

    def as_gamma(self) -> Gamma:
        return Gamma(self.k / 2, 0.5)

    def ln_pdf(self, x: Column) -> Column:
        return self.as_gamma().ln_pdf(x)

    def cdf(self, x: Column) -> Column:
        return self.as_gamma().cdf(x)

    def quantile(self, p: Column) -> Column:
        return self.as_gamma().quantile(p)

    def mean(self) -> float:
        return self.k

    def variance(self) -> float:
        return 2 * self.k


@dataclass(frozen=True)
class Beta(Continuous):
    a: float
    b: float
    kind = "beta"

    def __post_init__(self):
        need(self.a > 0 and self.b > 0, "both shapes must be positive")

    def ln_pdf(self, x: Column) -> Column:
        ln_b = math.lgamma(self.a) + math.lgamma(self.b) - math.lgamma(self.a + self.b)
        return inside((x > 0) & (x < 1), (self.a - 1) * F.log(x) + (self.b - 1) * F.log(1 - x) - ln_b)

    def cdf(self, x: Column) -> Column:
        return special.beta_cdf(F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x), self.a, self.b)

    def quantile(self, p: Column) -> Column:
        return special.beta_quantile(p, self.a, self.b)

    def mean(self) -> float:
        return self.a / (self.a + self.b)

    def variance(self) -> float:
        s = self.a + self.b
        return self.a * self.b / (s * s * (s + 1))


@dataclass(frozen=True)
class StudentT(Continuous):
    nu: float
    kind = "student_t"

    def __post_init__(self):
        need(self.nu > 0, "the degrees of freedom must be positive")

    def ln_pdf(self, x: Column) -> Column:
        c = math.lgamma((self.nu + 1) / 2) - math.lgamma(self.nu / 2) - 0.5 * math.log(self.nu * math.pi)
        return c - (self.nu + 1) / 2 * F.log(1 + x * x / self.nu)

    def cdf(self, x: Column) -> Column:
        return special.student_t_cdf(x, self.nu)

    def quantile(self, p: Column) -> Column:
        return special.student_t_quantile(p, self.nu)

    def mean(self) -> float:
        return 0.0 if self.nu > 1 else math.nan

    def variance(self) -> float:
        return self.nu / (self.nu - 2) if self.nu > 2 else math.inf if self.nu > 1 else math.nan


def least_whole(cdf: Callable[[np.ndarray], np.ndarray], high: float) -> Callable[[Column], Column]:
    """Least k with cdf(k) >= p, by doubling and halving whole batches; 0 for p <= 0, `high` (null if infinite) for p >= 1."""

    @F.pandas_udf(LongType())
    def run(p: pd.Series) -> pd.Series:
        v = p.to_numpy(float, na_value=np.nan)
        inner = np.where((v > 0) & (v < 1), v, 0.5)
        lo, hi = np.full(len(v), -1.0), np.ones(len(v))
        while (short := cdf(hi) < inner).any():
            lo, hi = np.where(short, hi, lo), np.where(short, np.minimum(2 * hi, high), hi)
        while (wide := hi - lo > 1).any():
            mid = np.where(wide, np.floor((lo + hi) / 2), hi)
            enough = cdf(mid) >= inner
            hi, lo = np.where(wide & enough, mid, hi), np.where(wide & ~enough, mid, lo)
        out = np.where(v <= 0, 0.0, np.where(v >= 1, high, hi))
        return pd.Series([None if not math.isfinite(x) else int(x) for x in np.where(np.isnan(v), np.nan, out)], dtype="Int64")

    return run


@dataclass(frozen=True)
class Bernoulli(Discrete):
    p: float
    kind = "bernoulli"

    def __post_init__(self):
        need(0 <= self.p <= 1, "p must lie in [0, 1]")

    def pmf(self, k: Column) -> Column:
        return special.bernoulli_pmf(k, self.p)

    def ln_pmf(self, k: Column) -> Column:
        return F.coalesce(F.log(F.nullif(self.pmf(k), F.lit(0.0))), never())

    def cdf(self, x: Column) -> Column:
        return special.bernoulli_cdf(x, self.p)

    def quantile(self, p: Column) -> Column:
        return F.when((p <= 0) | (F.lit(1 - self.p) >= p), 0).otherwise(1).cast("long")

    def mean(self) -> float:
        return self.p

    def variance(self) -> float:
        return self.p * (1 - self.p)


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int
    p: float
    kind = "binomial"

    def __post_init__(self):
        need(self.n >= 0 and 0 <= self.p <= 1, "n must not be negative and p must lie in [0, 1]")

    def ln_pmf(self, k: Column) -> Column:
        k = k.cast("double")
        if self.p in (0, 1):
            return F.when(k == self.n * self.p, 0.0).otherwise(never())
        body = math.lgamma(self.n + 1) - special.lgamma(k + 1) - special.lgamma(self.n - k + 1) + k * math.log(self.p) + (self.n - k) * math.log1p(-self.p)
        return inside((k >= 0) & (k <= self.n), body)

    def cdf(self, x: Column) -> Column:
        return special.binomial_cdf(x, self.n, self.p)

    def quantile(self, p: Column) -> Column:
        n, q = self.n, 1 - self.p
        return least_whole(lambda k: np.where(k >= n, 1.0, special.regular_beta(np.maximum(n - k, 1e-9), np.maximum(k, 0) + 1, np.full_like(k, q))), float(n))(p)

    def mean(self) -> float:
        return self.n * self.p

    def variance(self) -> float:
        return self.n * self.p * (1 - self.p)


@dataclass(frozen=True)
class Poisson(Discrete):
    rate: float
    kind = "poisson"

    def __post_init__(self):
        need(self.rate > 0, "the rate must be positive")

    def ln_pmf(self, k: Column) -> Column:
        k = k.cast("double")
        return inside(k >= 0, k * math.log(self.rate) - self.rate - special.lgamma(k + 1))

    def cdf(self, x: Column) -> Column:
        return special.poisson_cdf(x, self.rate)

    def quantile(self, p: Column) -> Column:
        rate = self.rate
        return least_whole(lambda k: special.gamma_parts(k + 1, np.full_like(k, rate))[1], math.inf)(p)

    def mean(self) -> float:
        return self.rate

    def variance(self) -> float:
        return self.rate
