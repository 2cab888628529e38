"""Decompositions of many small matrices: numpy kernels over whole Arrow batches of matrices.

A kernel takes a stack (b, m, n) and works on all matrices of the batch at once; failures
(a pivot under the absolute tolerance, a matrix that is not positive definite, an iteration
that does not settle) mark their own matrix and leave the others alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numfold.protocols import Kernel

EPS = float(np.finfo(float).eps)


class Singular(ArithmeticError):
    """A pivot under the absolute tolerance."""


def stack(a: np.ndarray) -> np.ndarray:
    a = np.array(a, complex if np.iscomplexobj(a) else float)
    return a[None] if a.ndim == 2 else a


def safe(d: np.ndarray) -> np.ndarray:
    return np.where(d == 0, 1.0, d)


# --- LU, of real or complex matrices ---------------------------------------------------

def lu_stack(a: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partial-pivot LU in one matrix, permutations, signs, and which matrices are regular."""
    a = stack(a)
    b, n, _ = a.shape
    every = np.arange(b)
    perm, sign, good = np.tile(np.arange(n), (b, 1)), np.ones(b), np.ones(b, bool)
    for k in range(n):
        p = k + np.abs(a[:, k:, k]).argmax(axis=1)
        good &= np.abs(a[every, p, k]) >= eps
        sign[p != k] *= -1
        for x in (a, perm):
            top = x[every, p].copy()
            x[every, p] = x[:, k]
            x[:, k] = top
        a[:, k + 1 :, k] /= safe(a[:, k, k])[:, None]
        a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, k, None, k + 1 :]
    return a, perm, sign, good


def substitute(f: np.ndarray, b: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    """Solves triangular systems f x = b for stacks of right sides (b, n, k)."""
    x, n = b.copy(), f.shape[1]
    for i in range(n) if lower else range(n - 1, -1, -1):
        known = slice(0, i) if lower else slice(i + 1, n)
        x[:, i] -= (f[:, i, known, None] * x[:, known]).sum(axis=1)
        if not unit:
            x[:, i] /= safe(f[:, i, i])[:, None]
    return x


def lu_apply(f: np.ndarray, perm: np.ndarray, b: np.ndarray) -> np.ndarray:
    return substitute(f, substitute(f, np.take_along_axis(b, perm[:, :, None], axis=1), True, True), False, False)


def solve_stack(a: np.ndarray, b: np.ndarray, refinements: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Solutions for right sides (b, n, k); refinement stops where a correction does not shrink."""
    a = stack(a)
    f, perm, _, good = lu_stack(a)
    x, last = lu_apply(f, perm, np.asarray(b, np.result_type(a, b))), np.full(len(a), np.inf)
    going = good.copy()
    for _ in range(refinements):
        d = lu_apply(f, perm, b - a @ x)
        size = np.sqrt((np.abs(d) ** 2).sum(axis=(1, 2)))
        going &= size < last
        x, last = x + d * going[:, None, None], np.where(going, size, last)
        going &= size > EPS * np.sqrt((np.abs(x) ** 2).sum(axis=(1, 2)))
    return x, good


def inverse_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = stack(a)
    return solve_stack(a, np.tile(np.eye(a.shape[1]), (len(a), 1, 1)))


def det_stack(a: np.ndarray) -> np.ndarray:
    """Sign times the product of pivots; 0 if a pivot is under the tolerance."""
    f, _, sign, good = lu_stack(a)
    return np.where(good, sign * np.diagonal(f, axis1=1, axis2=2).prod(axis=1), 0.0)


def lu_solve(a: np.ndarray, b: np.ndarray, refinements: int = 0) -> np.ndarray:
    x, good = solve_stack(a, np.asarray(b, float)[None, :, None], refinements)
    if not good[0]:
        raise Singular
    return x[0, :, 0]


def lu_det(a: np.ndarray) -> float:
    return float(det_stack(a)[0])


# --- QR ------------------------------------------------------------------------------

def reflect(x: np.ndarray) -> np.ndarray:
    """Unit Householder vectors of stacked columns (0 for a null column); the reflected first entry gets the other sign."""
    v = x.copy()
    size = np.sqrt((x * x).sum(axis=1))
    v[:, 0] += np.where(x[:, 0] >= 0, size, -size)
    return v / safe(np.sqrt((v * v).sum(axis=1)))[:, None]


def qr_stack(a: np.ndarray, pivot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Householder QR: thin Q, R, column permutations, and which matrices have full column rank (squared norms over EPS)."""
    r = stack(a)
    b, m, n = r.shape
    every, k_max = np.arange(b), min(m, n)
    q, perm, good = np.tile(np.eye(m), (b, 1, 1)), np.tile(np.arange(n), (b, 1)), np.ones(b, bool)
    for k in range(k_max):
        if pivot:
            p = k + (r[:, k:, k:] ** 2).sum(axis=1).argmax(axis=1)
            for x in (r.transpose(0, 2, 1), perm):
                top = x[every, p].copy()
                x[every, p] = x[:, k]
                x[:, k] = top
        good &= (r[:, k:, k] ** 2).sum(axis=1) >= EPS
        v = reflect(r[:, k:, k])
        r[:, k:] -= 2 * v[:, :, None] * (v[:, None, :] @ r[:, k:])
        q[:, :, k:] -= 2 * (q[:, :, k:] @ v[:, :, None]) * v[:, None, :]
    return q[:, :, :k_max], np.triu(r[:, :k_max]), perm, good


def lsq_stack(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares solutions by QR."""
    q, r, _, good = qr_stack(a)
    return substitute(r, q.transpose(0, 2, 1) @ b, False, False), good


def qr_det(a: np.ndarray) -> np.ndarray:
    """Product of R's diagonal, without the sign of the reflections."""
    return np.diagonal(qr_stack(a)[1], axis1=1, axis2=2).prod(axis=1)


def pivoted_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, r, perm, _ = qr_stack(a, pivot=True)
    return q[0], r[0], perm[0]


def rank_stack(a: np.ndarray, tol: float) -> np.ndarray:
    """Leading diagonal entries of the pivoted R above tol."""
    d = np.abs(np.diagonal(qr_stack(a, pivot=True)[1], axis1=1, axis2=2)) > tol
    return np.cumprod(d, axis=1).sum(axis=1)


def rank(a: np.ndarray, tol: float) -> int:
    return int(rank_stack(a, tol)[0])


# --- SVD and symmetric eigenvalues -----------------------------------------------------

def signed(x: np.ndarray) -> np.ndarray:
    """Sign by which the largest entry of each column is positive."""
    at = np.abs(x).argmax(axis=1)[:, None, :]
    return np.where(np.take_along_axis(x, at, axis=1)[:, 0] < 0, -1.0, 1.0)


def svd_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin U, falling singular values, V'; the largest entry of each column of U is positive."""
    u, s, vt = np.linalg.svd(stack(a), full_matrices=False)
    sign = signed(u)
    return u * sign[:, None, :], s, vt * sign[:, :, None]


def cut_off(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Reciprocals of singular values above EPS * largest * size; 0 for the others."""
    good = s > EPS * max(a.shape[1:]) * s[:, :1]
    return np.where(good, 1 / np.where(good, s, 1), 0.0)


def svd_rank(a: np.ndarray, tol: float | None = None) -> np.ndarray:
    a = stack(a)
    s = np.linalg.svd(a, compute_uv=False)
    return (cut_off(a, s) > 0).sum(axis=1) if tol is None else (s > tol).sum(axis=1)


def condition(a: np.ndarray) -> np.ndarray:
    s = np.linalg.svd(stack(a), compute_uv=False)
    return np.divide(s[:, 0], s[:, -1], out=np.full(len(s), np.inf), where=s[:, -1] > 0)


def pinv_stack(a: np.ndarray) -> np.ndarray:
    u, s, vt = svd_stack(a)
    return (vt.transpose(0, 2, 1) * cut_off(stack(a), s)[:, None, :]) @ u.transpose(0, 2, 1)


def pinv(a: np.ndarray) -> np.ndarray:
    return pinv_stack(a)[0]


def eigh_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and vectors of symmetric matrices (lower triangle); largest entries positive."""
    w, v = np.linalg.eigh(stack(a))
    return w, v * signed(v)[:, None, :]


# --- Cholesky --------------------------------------------------------------------------

def cholesky_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors, and which matrices are positive definite."""
    a = stack(a)
    low, good = np.zeros_like(a), np.ones(len(a), bool)
    for j in range(a.shape[1]):
        rest = a[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
        good &= rest > 0
        low[:, j, j] = np.sqrt(np.where(rest > 0, rest, 1.0))
        below = a[:, j + 1 :, j] - (low[:, j + 1 :, :j] * low[:, j, None, :j]).sum(axis=2)
        low[:, j + 1 :, j] = below / low[:, j, j, None]
    return low, good


def cholesky_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return substitute(low.transpose(0, 2, 1), substitute(low, b, True, False), False, False)


def rank1_stack(low: np.ndarray, x: np.ndarray, sign: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Factors of L L' + sign * x x', and which of them exist."""
    low, x = stack(low).copy(), np.array(x, float).reshape(-1, np.shape(low)[-1])
    good = np.ones(len(low), bool)
    for k in range(x.shape[1]):
        square = low[:, k, k] ** 2 + sign * x[:, k] ** 2
        good &= square > 0
        r = np.sqrt(np.where(square > 0, square, 1.0))
        c, s = (r / low[:, k, k])[:, None], (x[:, k] / low[:, k, k])[:, None]
        low[:, k, k] = r
        low[:, k + 1 :, k] = (low[:, k + 1 :, k] + sign * s * x[:, k + 1 :]) / c
        x[:, k + 1 :] = c * x[:, k + 1 :] - s * low[:, k + 1 :, k]
    return low, good


def rank1_update(low: np.ndarray, x: np.ndarray, sign: float = 1.0) -> np.ndarray:
    out, good = rank1_stack(low, x, sign)
    if not good.all():
        raise Singular
    return out[0]


# --- Hessenberg, Schur, exponential ----------------------------------------------------

def hessenberg_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """H and Q with Q H Q' = A."""
    h = stack(a)
    n = h.shape[1]
    q = np.tile(np.eye(n), (len(h), 1, 1))
    for k in range(n - 2):
        v = reflect(h[:, k + 1 :, k])
        h[:, k + 1 :] -= 2 * v[:, :, None] * (v[:, None, :] @ h[:, k + 1 :])
        for x in (h, q):
            x[:, :, k + 1 :] -= 2 * (x[:, :, k + 1 :] @ v[:, :, None]) * v[:, None, :]
        h[:, k + 2 :, k] = 0
    return h, q


def hessenberg(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, q = hessenberg_stack(a)
    return h[0], q[0]


class NotSettled(ArithmeticError):
    """An iteration reached its limit."""


def turn(s: np.ndarray, q: np.ndarray, at: int, rows: int, v: np.ndarray) -> None:
    """Applies the reflection of v to rows and columns at .. at + rows of s, and to columns of q."""
    part = slice(at, at + rows)
    s[part] -= 2 * np.outer(v, v @ s[part])
    s[:, part] -= 2 * np.outer(s[:, part] @ v, v)
    q[:, part] -= 2 * np.outer(q[:, part] @ v, v)


def split_pair(s: np.ndarray, q: np.ndarray, k: int) -> None:
    """Makes a 2 x 2 block with real eigenvalues upper triangular by one rotation."""
    a, b, c, d = s[k, k], s[k, k + 1], s[k + 1, k], s[k + 1, k + 1]
    half = 0.5 * (a - d)
    disc = half * half + b * c
    if c == 0 or disc < 0:
        return
    shift = half + math.copysign(math.sqrt(disc), half if half else 1.0)
    x = np.array([shift, c])  # an eigenvector of the block, for the eigenvalue d + shift
    size = math.hypot(*x)
    g = np.array([[x[0], -x[1]], [x[1], x[0]]]) / size
    part = slice(k, k + 2)
    s[part] = g.T @ s[part]
    s[:, part] = s[:, part] @ g
    q[:, part] = q[:, part] @ g
    s[k + 1, k] = 0.0


def schur(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Real Schur form S and Q with Q S Q' = A: implicit double shifts on the Hessenberg form.

    Blocks of S are 1 x 1, or 2 x 2 for a pair of complex eigenvalues."""
    s, q = hessenberg(a)
    hi, spent = len(s) - 1, 0
    while hi > 0:
        lo = hi
        while lo > 0 and abs(s[lo, lo - 1]) > EPS * (abs(s[lo, lo]) + abs(s[lo - 1, lo - 1])):
            lo -= 1
        if lo > 0:
            s[lo, lo - 1] = 0.0
        if hi - lo < 2:
            if hi - lo == 1:
                split_pair(s, q, lo)
            hi, spent = lo - 1, 0
            continue
        spent += 1
        if spent > 30 * len(s):
            raise NotSettled
        total, product = s[hi - 1, hi - 1] + s[hi, hi], s[hi - 1, hi - 1] * s[hi, hi] - s[hi - 1, hi] * s[hi, hi - 1]
        if spent % 10 == 0:  # an exceptional shift
            w = abs(s[hi, hi - 1]) + abs(s[hi - 1, hi - 2])
            total, product = 1.5 * w, w * w
        x = np.array([s[lo, lo] ** 2 + s[lo, lo + 1] * s[lo + 1, lo] - total * s[lo, lo] + product, s[lo + 1, lo] * (s[lo, lo] + s[lo + 1, lo + 1] - total), s[lo + 1, lo] * s[lo + 2, lo + 1]])
        for k in range(lo, hi):
            if k > lo:
                x = s[k : min(k + 3, hi + 1), k - 1].copy()
            if x.any():
                turn(s, q, k, len(x), reflect(x[None])[0])
            if k > lo:
                s[k + 1 : min(k + 3, hi + 1), k - 1] = 0.0
    return s, q


def schur_stack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """S, Q and which matrices settled; the iteration differs from matrix to matrix."""
    a = stack(a)
    s, q, good = np.zeros_like(a), np.zeros_like(a), np.ones(len(a), bool)
    for i, x in enumerate(a):
        try:
            s[i], q[i] = schur(x)
        except NotSettled:
            good[i] = False
    return s, q, good


def eigenvalues_of_schur(s: np.ndarray) -> np.ndarray:
    """Complex eigenvalues (b, n) in the order of the blocks."""
    b, n, _ = s.shape
    out = np.diagonal(s, axis1=1, axis2=2).astype(complex)
    for k in range(n - 1):
        pair = s[:, k + 1, k] != 0
        x, y, z, w = (s[pair, i, j] for i, j in ((k, k), (k, k + 1), (k + 1, k), (k + 1, k + 1)))
        root = np.sqrt((0.25 * (x - w) ** 2 + y * z).astype(complex))
        out[pair, k], out[pair, k + 1] = 0.5 * (x + w) + root, 0.5 * (x + w) - root
    return out


def pade(p: int) -> list[float]:
    """Coefficients of the diagonal approximant of exp of degree p, from their rule."""
    c = [Fraction(1)]
    for k in range(1, p + 1):
        c.append(c[-1] * (p - k + 1) / ((2 * p - k + 1) * k))
    return [float(x) for x in c]


#: Fixed value: the norm up to which the approximant of degree 13 needs no scaling.
THETA = 5.371920351148152


def expm_stack(a: np.ndarray) -> np.ndarray:
    """Matrix exponentials by scaling and squaring of the [13/13] Pade approximant."""
    a = stack(a)
    n = a.shape[1]
    size = np.abs(a).sum(axis=1).max(axis=1)
    s = np.where(size > THETA, np.ceil(np.log2(np.maximum(size, THETA) / THETA)), 0).astype(int)
    x, c, eye = a / (2.0**s)[:, None, None], pade(13), np.eye(n)
    square = x @ x
    even = odd = np.zeros_like(x)
    for k in range(6, -1, -1):  # Horner's scheme in x^2
        even, odd = even @ square + c[2 * k] * eye, odd @ square + c[2 * k + 1] * eye
    odd = x @ odd
    out, _ = solve_stack(even - odd, even + odd)
    for k in range(int(s.max(initial=0))):
        out = np.where((s > k)[:, None, None], out @ out, out)
    return out


def expm(a: np.ndarray) -> np.ndarray:
    return expm_stack(a)[0]


# --- over DataFrames ---------------------------------------------------------------------

def per_matrix(df: DataFrame, kernel: Kernel, m: int, n: int, outputs: list[str], id_col: str = "mat_id", values: str = "a", failure: str = "Singular") -> DataFrame:
    """(id, one array column for each output, status) of a kernel over column-major matrices.

    The kernel gets a stack (b, m, n) and returns stacks by name and a mask of the good ones;
    matrices come back column-major. A failed matrix has null outputs and `failure` as status;
    a null one, or one of another size, has the status DimensionMismatch."""
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths().fill_null(-1))
            fits = sizes == m * n
            a = batch.column(1).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n, m).transpose(0, 2, 1)
            good = np.isfinite(a).all(axis=(1, 2))
            made, ok = kernel(np.where(good[:, None, None], a, 0.0)) if len(a) else ({name: a for name in outputs}, good)
            ok = ok & good
            place = np.full(len(sizes), -1)
            place[np.flatnonzero(fits)] = np.where(ok, np.arange(len(a)), -1)
            taken = pa.array(np.maximum(place, 0), mask=place < 0)
            columns = []
            for name in outputs:
                x = np.asarray(made[name], float)
                line = np.ascontiguousarray(x.transpose(0, 2, 1) if x.ndim == 3 else x).reshape(len(a), -1)
                lists = pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * line.shape[1] if len(a) else np.zeros(1, np.int32), line.reshape(-1)).cast(kind)
                columns.append(lists.take(taken) if len(a) else pa.nulls(len(sizes), kind))
            status = np.full(len(sizes), "DimensionMismatch", object)
            status[np.flatnonzero(fits)] = np.where(ok, "ok", failure)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(status, pa.string())], [id_col, *outputs, "status"])

    schema = f"{id_col} long, " + ", ".join(f"{x} array<double>" for x in outputs) + ", status string"
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(values).cast("array<double>").alias(values)).mapInArrow(run, schema)


def gram_matrix(df: DataFrame, values: str, n: int) -> DataFrame:
    """(i, j, v): X' X of the rows in an array column of length n. Each task adds up whole batches and hands on one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = batch.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["m"])

    parts = df.select(F.col(values).cast("array<double>").alias("a")).where(F.size("a") == n).mapInArrow(run, "m array<double>")
    place = parts.select(F.posexplode("m").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    return place.select((F.col("pos") % n).alias("i"), F.floor(F.col("pos") / n).cast("int").alias("j"), "v")


def tall_qr_r(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of a tall matrix of rows: QR in each batch, then QR of the stacked factors (n x n each)."""
    n = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for pdf in frames:
            r = np.linalg.qr(np.vstack([r, pdf.to_numpy(float)]), mode="r")
        yield pd.DataFrame({"r": [r.reshape(-1).tolist()], "rows": [len(r)]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for pdf in frames:
            for v, k in zip(pdf["r"], pdf["rows"], strict=True):
                r = np.linalg.qr(np.vstack([r, np.asarray(v).reshape(int(k), n)]), mode="r")
        yield pd.DataFrame({"r": [r.reshape(-1).tolist()], "rows": [len(r)]})

    schema = "r array<double>, rows int"
    row = df.select(*columns).mapInPandas(run, schema).coalesce(1).mapInPandas(merge, schema).first()
    return np.asarray(row["r"]).reshape(row["rows"], n)


def spd3(v: Column) -> Column:
    """V V' + I of the first nine elements, column-major."""
    item = lambda i, k: v[3 * k + i]
    return F.array(*(sum((item(i, k) * item(j, k) for k in range(3)), F.lit(1.0 if i == j else 0.0)) for j in range(3) for i in range(3)))
