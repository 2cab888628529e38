"""Special functions, distributions, quaternions and design rules as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .mat import bound

#: Lanczos coefficients (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lanczos(x: Column) -> Column:
    """log gamma for x of 1/2 and more."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + k)
    t = z + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def stirling(x: Column) -> Column:
    """log gamma for large x."""
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)


INFINITE, NAN = float("inf"), float("nan")


def lgamma(x: Column) -> Column:
    """log |gamma(x)|: by reflection below 1/2, infinite at 0, -1, -2, ..."""
    x = x.cast("double")
    up = F.greatest(F.when(x < 0.5, 1 - x).otherwise(x), F.lit(0.5))
    right = F.when(up > 1e6, stirling(up)).otherwise(lanczos(up))
    mirrored = math.log(math.pi) - F.log(F.abs(F.sin(math.pi * x))) - right
    return F.when(F.isnan(x), NAN).when((x <= 0) & (x == F.floor(x)), INFINITE).when(x < 0.5, mirrored).otherwise(right)


def gamma(x: Column) -> Column:
    """Exact factorials for 1 to 21, infinite at the poles, by reflection below 1/2."""
    x = x.cast("double")
    whole = x == F.floor(x)
    size = F.exp(lgamma(x))
    negative = (x < 0) & (F.floor(x) % 2 != 0)
    exact = F.factorial(F.when(whole & (x >= 1) & (x <= 21), x - 1).otherwise(0.0).cast("int")).cast("double")
    return F.when(F.isnan(x), NAN).when(whole & (x >= 1) & (x <= 21), exact).when(negative & ~whole, -size).otherwise(size)


def lbeta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta(a: Column, b: Column) -> Column:
    return F.exp(lbeta(a, b))


def digamma(x: Column) -> Column:
    """Six recurrence steps, then the asymptotic series; by reflection below 0, NaN at the poles."""
    x = x.cast("double")
    up = F.when(x < 0, 1 - x).when(x == 0, 1.0).otherwise(x)
    out = F.lit(0.0)
    for k in range(6):
        out = out - 1 / (up + k)
    y = up + 6
    z = 1 / (y * y)
    value = out + F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    pole = (x <= 0) & (x == F.floor(x))
    mirrored = value - math.pi / F.when(pole, 1.0).otherwise(F.tan(math.pi * x))
    return F.when(pole | F.isnan(x), NAN).when(x < 0, mirrored).otherwise(value)


log_gamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_parts(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised P and Q of (a, x): a series for P below a + 1, else a continued fraction for Q; NaN outside a > 0, x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    fine = (a > 0) & (x >= 0)
    a, x = np.where(fine, a, 1.0), np.where(fine, x, 1.0)
    shapes, at = np.unique(a, return_inverse=True)
    scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - log_gamma(shapes)[at].reshape(a.shape) if a.size else a)
    low, tiny = x < a + 1, 1e-300
    term = total = 1 / a
    for n in range(1, 500):
        term = term * x / (a + n)
        total = total + np.where(low, term, 0)
        if np.all((np.abs(term) < 1e-17 * np.abs(total)) | ~low):
            break
    b = x + 1 - a
    c, d = np.full_like(b, 1 / tiny), 1 / np.where(b == 0, tiny, b)
    h = d
    for n in range(1, 500):
        k = -n * (n - a)
        b = b + 2
        d = k * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + k / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-16) | low):
            break
    p = np.where(x <= 0, 0.0, np.where(low, scale * total, 1 - scale * h))
    q = np.where(x <= 0, 1.0, np.where(low, 1 - scale * total, scale * h))
    return np.where(fine, p, np.nan), np.where(fine, q, np.nan)


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return gamma_parts(a, x)[0]


def nullable(values: np.ndarray, *inputs: pd.Series) -> pd.Series:
    """Null where an input is null or the value lies outside the domain."""
    out = pd.Series(values)
    return out.where(~out.isna() & np.logical_and.reduce([x.notna().to_numpy() for x in inputs]))


@F.pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    v = x.to_numpy(float, na_value=np.nan)
    return nullable(np.where(np.abs(v) > 6, np.sign(v), np.sign(v) * gamma_parts(0.5, np.minimum(v * v, 40.0))[0]), x)


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    v = x.to_numpy(float, na_value=np.nan)
    p, q = gamma_parts(0.5, np.minimum(v * v, 729.0))
    return nullable(np.where(v > 27, 0.0, np.where(v >= 0, q, 1 + p)), x)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's form over flat arrays; a value whose factor is 1 to the last places leaves the turns."""
    tiny, out, left = 1e-300, np.ones_like(x), np.arange(x.size)
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        on = np.abs(d * c - 1) > 4.5e-16
        if not on.all():
            out[left[~on]] = h[~on]
            a, b, x, c, d, h, left = (v[on] for v in (a, b, x, c, d, h, left))
        if not left.size:
            break
    out[left] = h
    return out


def regular_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), with the symmetric form above the mean."""
    a, b, x = np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)

    def lg(v: np.ndarray) -> np.ndarray:  # few distinct parameters as a rule
        shapes, at = np.unique(v, return_inverse=True)
        return log_gamma(shapes)[at].reshape(v.shape)

    fine = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b = np.where(a > 0, a, 1.0), np.where(b > 0, b, 1.0)
    inside = np.clip(np.where(fine, x, 0.5), 1e-300, 1 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    near, far = np.where(low, a, b), np.where(low, b, a)
    part = front * beta_fraction(near.ravel(), far.ravel(), np.where(low, inside, 1 - inside).ravel()).reshape(low.shape) / near
    return np.where(fine, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part))), np.nan)


@F.pandas_udf(DoubleType())
def gamma_p(a: pd.Series, x: pd.Series) -> pd.Series:
    return nullable(gamma_parts(a.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan))[0], a, x)


@F.pandas_udf(DoubleType())
def gamma_q(a: pd.Series, x: pd.Series) -> pd.Series:
    return nullable(gamma_parts(a.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan))[1], a, x)


@F.pandas_udf(DoubleType())
def betainc(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return nullable(regular_beta(a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan)), a, b, x)


def normal_pdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return 0.5 * erfc(-(x - mu) / (sigma * math.sqrt(2)))


#: Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def horner(cs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile; null outside [0, 1]."""
    q = p - 0.5
    r = q * q
    middle = horner(ACKLAM_A, r) * q / (horner(ACKLAM_B, r) * r + 1)
    tail = lambda t: horner(ACKLAM_C, t) / (horner(ACKLAM_D, t) * t + 1)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    inf = F.lit(float("inf"))
    return F.when(p == 0, -inf).when(p == 1, inf).when((p > 0) & (p < ACKLAM_LOW), tail(low)).when((p >= ACKLAM_LOW) & (p <= 1 - ACKLAM_LOW), middle).when((p > 1 - ACKLAM_LOW) & (p < 1), -tail(high))


def uniform_cdf(x: Column, a: float, b: float) -> Column:
    return F.when(x < a, 0.0).when(x > b, 1.0).otherwise((x - a) / (b - a))


def exponential_cdf(x: Column, rate: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(1 - F.exp(-rate * x))


def gamma_pdf(x: Column, shape: float, rate: float) -> Column:
    return F.when(x > 0, F.exp(shape * math.log(rate) + (shape - 1) * F.log(x) - rate * x - math.lgamma(shape))).otherwise(0.0)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    ln_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return F.when((x > 0) & (x < 1), F.exp((a - 1) * F.log(x) + (b - 1) * F.log(1 - x) - ln_b)).otherwise(0.0)


def chi_squared_pdf(x: Column, k: float) -> Column:
    return gamma_pdf(x, k / 2, 0.5)


def student_t_pdf(x: Column, nu: float) -> Column:
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return F.exp(c - (nu + 1) / 2 * F.log(1 + x * x / nu))


def gamma_cdf(x: Column, shape: float, rate: float) -> Column:
    return gamma_p(F.lit(shape), rate * x)


def beta_cdf(x: Column, a: float, b: float) -> Column:
    return betainc(F.lit(a), F.lit(b), x)


def chi_squared_cdf(x: Column, k: float) -> Column:
    return gamma_cdf(x, k / 2, 0.5)


def student_t_cdf(x: Column, nu: float) -> Column:
    tail = 0.5 * betainc(F.lit(nu / 2), F.lit(0.5), nu / (nu + x * x))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def binomial_cdf(k: Column, n: int, p: float) -> Column:
    k = k.cast("double")
    inside = F.least(F.greatest(k, F.lit(0.0)), F.lit(n - 1.0))
    return F.when(k < 0, 0.0).when(k >= n, 1.0).otherwise(betainc(n - inside, inside + 1, F.lit(1 - p)))


def poisson_cdf(k: Column, lam: float) -> Column:
    k = k.cast("double")
    return F.when(k < 0, 0.0).otherwise(1 - gamma_p(F.greatest(k, F.lit(0.0)) + 1, F.lit(lam)))


def inverse(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quantiles of a continuous cdf, by inverse quadratic steps kept inside a shrinking bracket (Chandrupatla's rule, and
    a bisection every fourth turn); a value leaves the turns when its bracket is closed. The support's ends at 0 and 1, NaN outside."""
    inner = np.clip(np.nan_to_num(p, nan=0.5), 1e-300, 1 - 1e-16)
    ends = []
    for start, limit, sign in ((max(low, -1.0), low, -1), (min(high, 1.0), high, 1)):
        end = np.full(len(p), start)
        f = cdf(end) - inner
        for _ in range(1100):
            short = np.flatnonzero((sign * f < 0) & (np.abs(end) < 1e300) & (sign * end < sign * limit))
            if not short.size:
                break
            end[short] *= 2
            f[short] = cdf(end[short]) - inner[short]
        ends += [end, f]
    a, fa, b, fb = ends
    out, left = np.where(-fa < fb, a, b), np.flatnonzero((fa < 0) & (fb > 0))
    a, fa, b, fb, goal = (v[left] for v in (a, fa, b, fb, inner))
    c, fc, t = b, fb, np.full(len(left), 0.5)
    for turn in range(4400):
        if not left.size:
            break
        x = a + t * (b - a)
        f = cdf(x) - goal
        same = np.sign(f) == np.sign(fa)
        c, fc, b, fb = np.where(same, a, b), np.where(same, fa, fb), np.where(same, b, a), np.where(same, fb, fa)
        a, fa = x, f
        best = np.where(np.abs(fa) < np.abs(fb), a, b)
        with np.errstate(all="ignore"):
            least = 2e-16 * np.abs(best) / np.abs(b - a)
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            step = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            t = np.where((turn % 4 != 3) & (phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi) & np.isfinite(step), np.clip(step, least, 1 - least), 0.5)
        on = (f != 0) & (least < 0.5) & (np.nextafter(a, b) != b)
        out[left] = best
        if not on.all():
            a, fa, b, fb, c, fc, t, goal, left = (v[on] for v in (a, fa, b, fb, c, fc, t, goal, left))
    return np.where(p == 0, low, np.where(p == 1, high, np.where((p > 0) & (p < 1), out, np.nan)))


def by_inverse(cdf: Callable[[np.ndarray], np.ndarray], low: float, high: float):
    @F.pandas_udf(DoubleType())
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(inverse(cdf, p.to_numpy(dtype=float, na_value=np.nan), low, high)).where(p.notna())

    return run


def gamma_quantile(p: Column, shape: float, rate: float) -> Column:
    return by_inverse(lambda x: lower_gamma(shape, rate * x), 0.0, math.inf)(p)


def beta_quantile(p: Column, a: float, b: float) -> Column:
    return by_inverse(lambda x: regular_beta(a, b, x), 0.0, 1.0)(p)


def chi_squared_quantile(p: Column, k: float) -> Column:
    return gamma_quantile(p, k / 2, 0.5)


def student_t_tail_point(q: np.ndarray, nu: float) -> np.ndarray:
    """The t > 0 with a share q of (0, 1/2) above it, infinite at 0, 0 at 1/2, NaN outside. Halley's steps in log t from Wallace's
    approximation, on the logarithm of the share above t or, where q is above 1/4, of that between 0 and t, so that neither
    cancels; kept inside a bracket, halved every fourth turn. A value leaves after a step so small that what it leaves, in its third power,
    is below the last place."""
    out = np.where(q == 0, np.inf, np.where(q == 0.5, 0.0, np.nan))
    left = np.flatnonzero((q > 0) & (q < 0.5) & (nu > 0))
    if not left.size:
        return out
    q = q[left]
    a, root, top = nu / 2, math.sqrt(nu), np.finfo(float).max
    rise = math.lgamma(a + 0.5) - math.lgamma(a) if a < 100 else 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)
    ln_b = 0.5 * math.log(math.pi) - rise
    middle, r = 0.5 - q, np.sqrt(-2 * np.log(q))
    z = np.where(q < ACKLAM_LOW, np.polyval(ACKLAM_C, r) / np.polyval((*ACKLAM_D, 1.0), r), np.polyval(ACKLAM_A, middle**2) * middle / np.polyval((*ACKLAM_B, 1.0), middle**2))
    central = q > 0.25
    goal = np.log(np.where(central, middle, q))
    u = np.sqrt(np.expm1(np.minimum((z * (8 * nu + 3) / (8 * nu + 1)) ** 2 / nu, 700.0)))  # t / sqrt(nu)
    lo, hi = np.zeros_like(u), np.full_like(u, np.inf)
    for turn in range(200):
        with np.errstate(all="ignore"):
            far = u > 1
            v = np.where(far, 1 / u, u)
            ln_small, ln_large = 2 * np.log(v) - np.log1p(v * v), -np.log1p(v * v)
            ln_y, ln_w = np.where(far, ln_large, ln_small), np.where(far, ln_small, ln_large)
            y, w = np.exp(ln_y), np.exp(ln_w)
            density = 0.5 * ln_y + a * ln_w - ln_b  # log of t times the density
            inner = y < 1.5 / (a + 2.5)
            near, away = np.where(inner, 0.5, a), np.where(inner, a, 0.5)
            part = density + np.log(beta_fraction(near, away, np.where(inner, y, w)) / (2 * near))
            value = np.where(inner == central, part, np.log(np.maximum(0.5 - np.exp(part), 1e-300)))
            h, slope = value - goal, np.exp(density - value)
            step = np.where(central, -h, h) / slope
            bend = 1 - (nu + 1) * y + np.where(central, -slope, slope)
            step = np.clip(step / np.clip(1 + step * bend / 2, 0.5, 2.0), -300.0, 300.0)
            less = (h > 0) == central
            lo, hi = np.where(less, lo, u), np.where(less, u, hi)
            new = u * np.exp(step)
            wide = np.abs(step) * (1 + slope) > 3e-6
            held = (lo > 0) & (hi < np.inf) & wide & ((turn % 4 == 3) | (new <= lo) | (new >= hi))
            new = np.clip(np.where(held, np.sqrt(lo) * np.sqrt(hi), new), 1e-300, top)
            on = wide & (h != 0) & (new != u)
            out[left] = np.where(h == 0, u, np.where((new == top) & (lo == top), np.inf, new)) * root
        if not on.any():
            break
        if not on.all():
            left, u, lo, hi, goal, central = (x[on] for x in (left, new, lo, hi, goal, central))
        else:
            u = new
    return out


def student_t_quantile(p: Column, nu: float) -> Column:
    """Odd about 1/2: solved for the smaller of p and 1 - p, where small ones keep their digits."""

    @F.pandas_udf(DoubleType())
    def run(q: pd.Series) -> pd.Series:
        return pd.Series(student_t_tail_point(q.to_numpy(dtype=float, na_value=np.nan), nu)).where(q.notna())

    point = run(F.least(p, 1 - p))
    return F.when(p < 0.5, -point).when(p == 0.5, 0.0).otherwise(point)


def uniform_quantile(p: Column, a: float, b: float) -> Column:
    return a + p * (b - a)


def exponential_quantile(p: Column, rate: float) -> Column:
    return -F.log1p(-p) / rate


def bernoulli_pmf(k: Column, p: float) -> Column:
    return F.when(k == 1, p).when(k == 0, 1 - p).otherwise(0.0)


def bernoulli_cdf(k: Column, p: float) -> Column:
    return F.when(k < 0, 0.0).when(k < 1, 1 - p).otherwise(1.0)


def binomial_pmf(k: Column, n: int, p: float) -> Column:
    k = k.cast("double")
    return F.exp(math.lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))


def poisson_pmf(k: Column, lam: float) -> Column:
    k = k.cast("double")
    return F.exp(k * math.log(lam) - lam - lgamma(k + 1))


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def quat_mul(p: Column, q: Column) -> Column:
    """Hamilton product."""
    return bound(
        lambda p, q: quaternion(
            p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
            p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
            p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
            p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
        ),
        p,
        q,
    )


def quat_conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def quat_norm(q: Column) -> Column:
    return F.sqrt(q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def bound_pair(q: Column) -> tuple[Column, Column]:
    return q, bound(quat_norm, q)


def quat_normalize(q: Column) -> Column:
    return bound(lambda q, n: quaternion(*(q[c] / n for c in "wxyz")), *bound_pair(q))


def quat_inverse(q: Column) -> Column:
    n = quat_norm(q)
    return quaternion(q["w"] / (n * n), -q["x"] / (n * n), -q["y"] / (n * n), -q["z"] / (n * n))


def quat_rotate(q: Column, v: list[Column]) -> list[Column]:
    """v + 2 w (u x v) + 2 u x (u x v)."""
    u = [q["x"], q["y"], q["z"]]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    once = cross(u, v)
    twice = cross(u, once)
    return [v[i] + 2.0 * (q["w"] * once[i] + twice[i]) for i in range(3)]


def quat_to_matrix(q: Column) -> list[list[Column]]:
    w, x, y, z = (q[c] for c in "wxyz")
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quat_from_axis_angle(axis: list[Column], angle: Column) -> Column:
    """An axis without length is taken as it stands."""
    n = F.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
    s = F.sin(angle / 2) / F.when(n > 2.220446049250313e-16, n).otherwise(1.0)
    return quaternion(F.cos(angle / 2), axis[0] * s, axis[1] * s, axis[2] * s)


def quat_identity() -> Column:
    return quaternion(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))


def quat_rot(axis: str, angle: Column) -> Column:
    """Rotation about x, y or z."""
    s = F.sin(angle / 2)
    return quaternion(F.cos(angle / 2), *(s if c == axis else F.lit(0.0) for c in "xyz"))


def cross_of(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def scaled_to_one(v: list[Column]) -> list[Column]:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [x / n for x in v]


UNIT_EPS = 2.220446049250313e-16


def quat_between(a: list[Column], b: list[Column]) -> Column:
    """The shortest rotation from a to b; opposite vectors turn about an axis across a."""

    def turn(a: Column, b: Column) -> Column:
        a, b = ([v[k] for k in range(3)] for v in (a, b))
        dot, axis = a[0] * b[0] + a[1] * b[1] + a[2] * b[2], cross_of(a, b)
        near_x = F.abs(a[0]) < 0.9
        beside = cross_of(a, [F.when(near_x, 1.0).otherwise(0.0), F.when(near_x, 0.0).otherwise(1.0), F.lit(0.0)])
        across = bound(lambda v: quaternion(F.lit(0.0), *scaled_to_one([v[k] for k in range(3)])), F.array(*beside))
        # w is lost in rounding closer to the opposite than 1e-14, where the cross product still has seven digits
        return F.when(dot > 1 - UNIT_EPS, quat_identity()).when(dot < -(1 - 1e-14), across).otherwise(quat_normalize(quaternion(1 + dot, *axis)))

    one = lambda v: bound(lambda v: F.array(*scaled_to_one([v[k] for k in range(3)])), F.array(*v))
    return bound(turn, one(a), one(b))


def quat_from_matrix(m: list[list[Column]]) -> Column:
    """From a rotation matrix, by its largest diagonal sum."""
    trace = m[0][0] + m[1][1] + m[2][2]
    root = lambda v: F.sqrt(F.greatest(v, F.lit(1e-300)))

    def by(k: int) -> Column:
        i, j = (k + 1) % 3, (k + 2) % 3
        big = root((1 + m[k][k] - m[i][i] - m[j][j]) / 4)
        part = {k: big, i: (m[k][i] + m[i][k]) / (4 * big), j: (m[k][j] + m[j][k]) / (4 * big)}
        return quaternion((m[j][i] - m[i][j]) / (4 * big), part[0], part[1], part[2])

    s = root(trace + 1)
    whole = quaternion(s / 2, (m[2][1] - m[1][2]) / (2 * s), (m[0][2] - m[2][0]) / (2 * s), (m[1][0] - m[0][1]) / (2 * s))
    return F.when(trace > 0, whole).when((m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2]), by(0)).when(m[1][1] >= m[2][2], by(1)).otherwise(by(2))


def quat_from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Turns about z, then y, then x (ZYX, intrinsic)."""
    return quat_mul(quat_mul(quat_rot("z", yaw), quat_rot("y", pitch)), quat_rot("x", roll))


def quat_from_velocity(omega: list[Column], dt: float | Column) -> Column:
    """The turn of an angular velocity over dt; the identity for a vanishing angle."""
    angle = F.sqrt(omega[0] * omega[0] + omega[1] * omega[1] + omega[2] * omega[2]) * dt
    return bound(lambda v, angle: F.when(angle < UNIT_EPS, quat_identity()).otherwise(quat_from_axis_angle([v[k] for k in range(3)], angle)), F.array(*omega), angle)


def quat_to_axis_angle(q: Column) -> tuple[list[Column], Column]:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    still = n < UNIT_EPS
    axis = [F.when(still, 1.0 if c == "x" else 0.0).otherwise(F.try_divide(q[c], n)) for c in "xyz"]
    return axis, F.when(still, 0.0).otherwise(2 * F.atan2(n, q["w"]))


def quat_dot(p: Column, q: Column) -> Column:
    return p["w"] * q["w"] + p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def quat_neg(q: Column) -> Column:
    return quaternion(*(-q[c] for c in "wxyz"))


def quat_derivative(q: Column, omega: list[Column]) -> Column:
    """Half of q times the velocity."""
    out = quat_mul(q, quaternion(F.lit(0.0), *omega))
    return quaternion(*(out[c] * 0.5 for c in "wxyz"))


def quat_propagate(q: Column, omega: list[Column], dt: float | Column) -> Column:
    return quat_normalize(quat_mul(q, quat_from_velocity(omega, dt)))


def quat_text(q: Column) -> Column:
    return F.concat(F.lit("("), q["w"].cast("string"), F.lit(" + "), q["x"].cast("string"), F.lit("i + "), q["y"].cast("string"), F.lit("j + "), q["z"].cast("string"), F.lit("k)"))


def quat_to_euler(q: Column) -> list[Column]:
    """Roll, pitch, yaw (ZYX); pitch is clamped to a quarter turn."""
    w, x, y, z = (q[c] for c in "wxyz")
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return [F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(s), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))]


def quat_slerp(p: Column, q: Column, t: float) -> Column:
    """Short-path spherical interpolation; linear and renormalised for nearly equal ones."""
    raw = p["w"] * q["w"] + p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
    sign, d = F.when(raw < 0, -1.0).otherwise(1.0), F.least(F.abs(raw), F.lit(1.0))
    near = d > 1 - 1e-6
    angle = F.acos(d)
    s = F.when(near, 1.0).otherwise(F.sin(angle))
    a = F.when(near, 1.0 - t).otherwise(F.sin((1 - t) * angle) / s)
    b = F.when(near, F.lit(t)).otherwise(F.sin(t * angle) / s)
    return quat_normalize(quaternion(*(a * p[c] + b * sign * q[c] for c in "wxyz")))


def pid_ziegler_nichols(k: Column, tau: Column, delay: Column) -> list[Column]:
    """kp, ki, kd from a first-order-plus-delay plant."""
    kp = 1.2 * tau / (k * delay)
    return [kp, kp / (2 * delay), kp * delay / 2]


def butterworth(order: int, cutoff: float, rate: float) -> list[tuple[float, float, float, float, float]]:
    """Low-pass second-order sections (b0, b1, b2, a1, a2) by the bilinear transform."""
    if not 0 < cutoff < rate / 2 or order < 1:
        raise ValueError("order must be positive and the cutoff under half the rate")
    w = 2 * rate * math.tan(math.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        theta = math.pi * (2 * k + order + 1) / (2 * order)
        a, c = -2 * w * math.cos(theta), 2 * rate
        d = c * c + a * c + w * w
        out.append((w * w / d, 2 * w * w / d, w * w / d, (2 * w * w - 2 * c * c) / d, (c * c - a * c + w * w) / d))
    if order % 2:
        d = 2 * rate + w
        out.append((w / d, w / d, 0.0, (w - 2 * rate) / d, 0.0))
    return out
