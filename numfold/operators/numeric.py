"""Root finding, minimisation, least squares and quadrature; batches of problems at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)


class BracketInvalid(ValueError):
    """No sign change over the bracket."""


def brent(f: Callable[[np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, x_tol: float = 1e-12, f_tol: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """Roots of f for arrays of brackets: secant steps that stay inside, else bisection."""
    a, b = np.array(a, float), np.array(b, float)
    fa, fb = f(a), f(b)
    if (fa * fb > 0).any():
        raise BracketInvalid("f has one sign at both ends")
    for k in range(rounds):
        gap = np.where(fb != fa, fb - fa, 1.0)
        s = b - fb * (b - a) / gap
        low, high = np.minimum(a, b), np.maximum(a, b)
        s = np.where((s > low) & (s < high) & (k % 3 < 2), s, 0.5 * (a + b))
        fs = f(s)
        left = fa * fs <= 0
        a, fa, b, fb = np.where(left, a, s), np.where(left, fa, fs), np.where(left, s, b), np.where(left, fs, fb)
        if np.all((np.abs(b - a) < x_tol) | (np.minimum(np.abs(fa), np.abs(fb)) < f_tol)):
            break
    return np.where(np.abs(fa) < np.abs(fb), a, b)


def newton(f: Column, df: Callable[[Column], Column], x: Column) -> Column:
    """One Newton step as an expression; null where the slope vanishes."""
    return F.when(F.abs(df(x)) >= EPS, x - f / df(x))


class OptimError(ArithmeticError):
    """A search that reached its limit, a singular system, or a line search without progress."""


@dataclass
class Minimum:
    """Of a batch of problems: places (b, n), values, gradient norms, rounds, calls of f, and status."""

    x: np.ndarray
    f: np.ndarray
    grad_norm: np.ndarray
    rounds: np.ndarray
    evals: np.ndarray
    status: np.ndarray


def steps_of(x: np.ndarray) -> np.ndarray:
    return math.sqrt(EPS) * np.maximum(np.abs(x), 1.0)


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """Forward-difference Jacobians (b, m, n) of f on stacks (b, n) -> (b, m)."""
    base, h, out = f(x), steps_of(x), []
    for j in range(x.shape[1]):
        z = x.copy()
        z[:, j] += h[:, j]
        out.append((f(z) - base) / h[:, j, None])
    return np.stack(out, axis=2)


def gradient(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """Forward-difference gradients (b, n) of f on stacks (b, n) -> (b,)."""
    return jacobian(lambda z: f(z)[:, None], x)[:, 0]


def bfgs(f: Callable[[np.ndarray], np.ndarray], g: Callable[[np.ndarray], np.ndarray] | None, x: np.ndarray, tol: float = 1e-8, rounds: int = 200) -> Minimum:
    """Minima of a batch by inverse-Hessian updates with backtracking; f and g take (rows, x) of the problems still open.

    Without g, forward differences."""
    x = np.array(x, float)
    b, n = x.shape
    rows = np.arange(b)
    g = g or (lambda some, z: gradient(lambda y: f(some, y), z))
    h, fx, gx = np.tile(np.eye(n), (b, 1, 1)), f(rows, x), g(rows, x)
    spent, evals, status = np.zeros(b, int), np.ones(b, int), np.full(b, "ok", object)
    going = np.sqrt((gx * gx).sum(axis=1)) >= tol
    for _ in range(rounds):
        at = np.flatnonzero(going)
        if not len(at):
            break
        p = -(h[at] @ gx[at, :, None])[:, :, 0]
        slope = (p * gx[at]).sum(axis=1)
        up = slope >= 0
        h[at[up]], p[up] = np.eye(n), -gx[at[up]]
        slope = (p * gx[at]).sum(axis=1)
        t, fy, found = np.ones(len(at)), fx[at].copy(), np.zeros(len(at), bool)
        for _ in range(40):
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            fy[open_] = f(at[open_], x[at[open_]] + t[open_, None] * p[open_])
            evals[at[open_]] += 1
            found[open_] = fy[open_] <= fx[at[open_]] + 1e-4 * t[open_] * slope[open_]
            t[open_[~found[open_]]] *= 0.5
        status[at[~found]], going[at[~found]] = "LineSearchFailed", False
        at, p, t, fy = at[found], p[found], t[found], fy[found]
        s = t[:, None] * p
        gy = g(at, x[at] + s)
        y = gy - gx[at]
        ys = (y * s).sum(axis=1)
        bent = ys > EPS
        rho = 1 / np.where(bent, ys, 1.0)
        left = np.eye(n) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        new = left @ h[at] @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        h[at] = np.where(bent[:, None, None], new, h[at])
        x[at], fx[at], gx[at] = x[at] + s, fy, gy
        spent[at] += 1
        going[at] = np.sqrt((gy * gy).sum(axis=1)) >= tol
    status[going] = "MaxIterations"
    return Minimum(x, fx, np.sqrt((gx * gx).sum(axis=1)), spent, evals, status)


def normal_equations(df: DataFrame, residual: Callable[[list[float]], Column], jacobian: Callable[[list[float]], list[Column]], params: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """J'J, J'r and the cost r'r / 2 in one distributed aggregate."""
    r, j = residual(params), jacobian(params)
    n = len(params)
    sums = [F.sum(j[a] * j[b]) for a in range(n) for b in range(a + 1)] + [F.sum(x * r) for x in j] + [F.sum(r * r)]
    row = df.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()
    jj = np.zeros((n, n))
    at = 0
    for a in range(n):
        for b in range(a + 1):
            jj[a, b] = jj[b, a] = row[at]
            at += 1
    return jj, np.array([row[at + k] for k in range(n)]), 0.5 * row[at + n]


def levenberg_marquardt(df: DataFrame, residual, jacobian, params: list[float], damping: float = 1e-3, rounds: int = 50, tol: float = 1e-10) -> tuple[list[float], float]:
    """Least squares over all rows of df; damping 0 gives Gauss-Newton steps. A singular system is an OptimError."""
    x, mu = list(params), damping
    jj, g, cost = normal_equations(df, residual, jacobian, x)
    for _ in range(rounds):
        try:
            step = np.linalg.solve(jj + mu * np.eye(len(x)), -g)
        except np.linalg.LinAlgError:
            raise OptimError("Singular") from None
        new = [a + float(b) for a, b in zip(x, step, strict=True)]
        jj2, g2, cost2 = normal_equations(df, residual, jacobian, new)
        if not damping or cost2 < cost:
            done = abs(cost - cost2) <= tol * max(cost, 1e-300) or np.linalg.norm(step) < tol
            x, jj, g, cost, mu = new, jj2, g2, cost2, max(mu * 0.1, 1e-10) if damping else 0.0
            if done:
                break
        else:
            mu *= 10
            if mu > 1e10:
                break
    return x, cost


def gauss_legendre(f: Callable[[Column], Column], a: Column, b: Column, n: int) -> Column:
    """Integral over [a, b], exact up to degree 2n - 1."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    half, mid = (b - a) / 2, (a + b) / 2
    total = F.lit(0.0)
    for x, w in zip(nodes.tolist(), weights.tolist(), strict=True):
        total = total + w * f(mid + half * x)
    return total * half


def trapezoid(f: Callable[[Column], Column], a: Column, b: Column, n: int) -> Column:
    h = (b - a) / n
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda s, k: s + f(a + k * h)) if n > 1 else F.lit(0.0)
    return h * (0.5 * (f(a) + f(b)) + inner)


def simpson(f: Callable[[Column], Column], a: Column, b: Column, n: int) -> Column:
    if n <= 0 or n % 2:
        raise ValueError("n must be even")
    h = (b - a) / n
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 4.0).otherwise(2.0) * f(a + k * h))
    return h / 3 * (f(a) + f(b) + inner)


def adaptive_simpson(f: Callable[[np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, tol: float, deepest: int = 50) -> np.ndarray:
    """Integrals of f over a batch of intervals: all open halves at once, with Richardson's correction, at most 50 deep."""
    if not tol > 0:
        raise ValueError("tol must be positive")
    lo, hi = np.broadcast_arrays(np.asarray(a, float).reshape(-1), np.asarray(b, float).reshape(-1))
    simple = lambda lo, hi: (hi - lo) / 6 * (f(lo) + 4 * f((lo + hi) / 2) + f(hi))
    total, of, whole, t = np.zeros(len(lo)), np.arange(len(lo)), simple(lo, hi), tol
    for depth in range(deepest + 1):
        if not len(of):
            break
        mid = (lo + hi) / 2
        left, right = simple(lo, mid), simple(mid, hi)
        error = left + right - whole
        done = (np.abs(error) <= 15 * t) | (depth == deepest)
        np.add.at(total, of[done], (left + right + error / 15)[done])
        lo, hi, whole = (np.concatenate([x[~done], y[~done]]) for x, y in ((lo, mid), (mid, hi), (left, right)))
        of, t = np.concatenate([of[~done]] * 2), t / 2
    return total
