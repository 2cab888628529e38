"""Vectors as ARRAY<DOUBLE> columns: elementwise operators, reductions, norms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with IEEE infinities and NaN instead of an error or null."""
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(F.isnan(a) | F.isnan(b) | (a == 0), nan).when(a > 0, inf).otherwise(-inf))


def same_size(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("vectors differ in length")))


def zipped(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: same_size(a, b, F.zip_with(a, b, f))


add = zipped(lambda x, y: x + y)
sub = zipped(lambda x, y: x - y)
mul = zipped(lambda x, y: x * y)
div = zipped(ieee_div)
pairwise_max = zipped(lambda x, y: F.greatest(x, y))


def neg(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def scale(a: Column, s: float | Column) -> Column:
    return F.transform(a, lambda x: x * s)


def shift(a: Column, s: float | Column) -> Column:
    return F.transform(a, lambda x: x + s)


def over(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: ieee_div(x, s))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def kahan_total(a: Column) -> Column:
    """Compensated sum."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        y = x - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(a, start, step, lambda acc: acc["s"])


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm_squared(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def norm(a: Column) -> Column:
    return F.sqrt(kahan_total(F.transform(a, lambda x: x * x)))


def norm_l1(a: Column) -> Column:
    return kahan_total(absolute(a))


def scaled_norm(a: Column) -> Column:
    return norm(a) / F.sqrt(F.size(a).cast("double"))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector gives NaNs."""
    return over(a, norm(a))


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def tail(a: Column, n: int) -> Column:
    return F.slice(a, -n, n)


def segment(a: Column, start: int, n: int) -> Column:
    return F.slice(a, start + 1, n)
