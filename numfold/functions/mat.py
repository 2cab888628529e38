"""Dense matrices as column-major ARRAY<DOUBLE> columns of known shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import ieee_div, kahan_total, total


def at(a: Column, m: int, i: int | Column, j: int | Column) -> Column:
    """Element (i, j) of a matrix of m rows."""
    return F.get(a, (F.lit(j) * m + F.lit(i)).cast("int")) if isinstance(i, Column) or isinstance(j, Column) else a[j * m + i]


def bound(f: Callable[..., Column], *columns: Column) -> Column:
    """f of columns that are evaluated once, however often f names them."""
    one = F.array(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))))
    return F.transform(one, lambda s: f(*(s[f"c{k}"] for k in range(len(columns)))))[0]


def from_fn(m: int, n: int, f: Callable[[Column, Column], Column]) -> Column:
    """Column-major matrix of f(row, column)."""
    return F.transform(F.sequence(F.lit(0), F.lit(m * n - 1)), lambda k: f(k % m, F.floor(k / m).cast("int")))


def identity(n: int) -> Column:
    return from_fn(n, n, lambda i, j: F.when(i == j, 1.0).otherwise(0.0))


def transpose(a: Column, m: int, n: int) -> Column:
    return bound(lambda a: from_fn(n, m, lambda i, j: at(a, m, j, i)), a)


def filled(m: int, n: int, value: float | Column = 0.0) -> Column:
    return F.array_repeat(F.lit(value), m * n)


def from_rows(rows: list[list[Column]]) -> Column:
    """Column-major matrix of rows of entries."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in length")
    return F.array(*(r[j] for j in range(len(rows[0])) for r in rows))


def is_square(m: int, n: int) -> bool:
    return m == n


def cast(a: Column, kind: str) -> Column:
    """Entries as another numeric type; integers take what stands before the point."""
    return a.cast(f"array<{kind}>")


def with_at(a: Column, m: int, i: int, j: int, value: Column) -> Column:
    """The matrix with one entry replaced."""
    return F.transform(a, lambda x, k: F.when(k == j * m + i, value).otherwise(x))


def columns(a: Column, m: int, n: int) -> Column:
    """The columns as an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.slice(a, j * m + 1, m))


def diag(a: Column, m: int, n: int) -> Column:
    return F.array(*(a[k * m + k] for k in range(min(m, n))))


def from_diag(d: Column, n: int) -> Column:
    return from_fn(n, n, lambda i, j: F.when(i == j, F.get(d, i)).otherwise(0.0))


def block(a: Column, m: int, i0: int, j0: int, p: int, q: int) -> Column:
    return from_fn(p, q, lambda i, j: at(a, m, i + i0, j + j0))


def corner(a: Column, m: int, n: int, p: int, q: int, bottom: bool = False, right: bool = False) -> Column:
    """A p x q block in a corner; p = m or q = n gives edge rows or columns."""
    return block(a, m, m - p if bottom else 0, n - q if right else 0, p, q)


def set_block(a: Column, m: int, n: int, b: Column, i0: int, j0: int, p: int, q: int) -> Column:
    inside = lambda i, j: (i >= i0) & (i < i0 + p) & (j >= j0) & (j < j0 + q)
    return from_fn(m, n, lambda i, j: F.when(inside(i, j), at(b, p, i - i0, j - j0)).otherwise(at(a, m, i, j)))


def swap_rows(a: Column, m: int, n: int, p: int, q: int) -> Column:
    return from_fn(m, n, lambda i, j: at(a, m, F.when(i == p, q).when(i == q, p).otherwise(i), j))


def swap_cols(a: Column, m: int, n: int, p: int, q: int) -> Column:
    return from_fn(m, n, lambda i, j: at(a, m, i, F.when(j == p, q).when(j == q, p).otherwise(j)))


def row(a: Column, m: int, n: int, i: int) -> Column:
    return F.array(*(a[j * m + i] for j in range(n)))


def col(a: Column, m: int, j: int) -> Column:
    return F.slice(a, j * m + 1, m)


def set_row(a: Column, m: int, n: int, i0: int, values: Column) -> Column:
    return from_fn(m, n, lambda i, j: F.when(i == i0, F.get(values, j)).otherwise(at(a, m, i, j)))


def set_col(a: Column, m: int, n: int, j0: int, values: Column) -> Column:
    return F.concat(*([F.slice(a, 1, j0 * m)] if j0 else []), F.slice(values, 1, m), *([F.slice(a, (j0 + 1) * m + 1, (n - 1 - j0) * m)] if j0 < n - 1 else []))


def matmul(a: Column, b: Column, m: int, k: int, n: int) -> Column:
    """Product of m x k and k x n; rows of the first and columns of the second are cut once."""

    def product(a: Column, b: Column) -> Column:
        lines = columns(transpose(a, m, k), k, m)
        inner = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return bound(lambda lines: F.flatten(F.transform(columns(b, k, n), lambda y: F.transform(lines, lambda x: inner(x, y)))), lines)

    return bound(product, a, b)


def kronecker(a: Column, m: int, n: int, b: Column, p: int, q: int) -> Column:
    div = lambda x, y: F.floor(x / y).cast("int")
    return from_fn(m * p, n * q, lambda i, j: at(a, m, div(i, p), div(j, q)) * at(b, p, i % p, j % q))


def power(a: Column, n: int, exponent: int) -> Column:
    """Matrix power by repeated squaring; exponent 0 gives the identity."""
    out, square = None, a
    while exponent:
        if exponent & 1:
            out = square if out is None else matmul(out, square, n, n, n)
        exponent >>= 1
        square = matmul(square, square, n, n, n) if exponent else square
    return identity(n) if out is None else out


def trace(a: Column, m: int, n: int) -> Column:
    return total(diag(a, m, n))


def is_symmetric(a: Column, n: int) -> Column:
    def test(a: Column) -> Column:
        out = F.lit(True)
        for i in range(n):
            for j in range(i):
                out = out & (a[j * n + i] == a[i * n + j])
        return out

    return bound(test, a)


def frobenius(a: Column) -> Column:
    return F.sqrt(kahan_total(F.transform(a, lambda x: x * x)))


def norm_inf(a: Column, m: int, n: int) -> Column:
    """Largest absolute row sum."""
    return F.array_max(F.array(*(total(F.transform(row(a, m, n, i), F.abs)) for i in range(m))))


def norm_one(a: Column, m: int, n: int) -> Column:
    """Largest absolute column sum."""
    return F.array_max(F.array(*(total(F.transform(col(a, m, j), F.abs)) for j in range(n))))


def det(a: Column, n: int) -> Column:
    """Determinant by cofactors, n up to 4."""

    def minor(a: Column, rows: tuple[int, ...], cols: tuple[int, ...]) -> Column:
        if len(rows) == 1:
            return a[cols[0] * n + rows[0]]
        out = None
        for k, j in enumerate(cols):
            term = a[j * n + rows[0]] * minor(a, rows[1:], cols[:k] + cols[k + 1 :])
            out = term if out is None else (out + term if k % 2 == 0 else out - term)
        return out

    return bound(lambda a: minor(a, tuple(range(n)), tuple(range(n))), a)


def solve(a: Column, b: Column, n: int, eps: float = 2.220446049250313e-16) -> Column:
    """Solution of a x = b by elimination with the largest pivot of each column; null if a pivot is under eps (absolute).

    The state of the fold is the list of rows (with b), so a step's work is written once."""
    rows = bound(lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(a, (j * n + i).cast("int"))), F.array(F.get(b, i)))), a, b)

    def step(rows: Column, k: Column) -> Column:
        size = F.transform(rows, lambda r, i: F.when(i >= k, F.abs(F.get(r, k))).otherwise(-1.0))
        place = (F.array_position(size, F.array_max(size)) - 1).cast("int")

        def eliminate(place: Column) -> Column:
            top = F.get(rows, place)
            swapped = F.transform(rows, lambda r, i: F.when(i == k, top).when(i == place, F.get(rows, k)).otherwise(r))
            clear = lambda r, i: F.when(i == k, r).otherwise(F.zip_with(r, top, lambda x, y: x - y * ieee_div(F.get(r, k), F.get(top, k))))
            return F.when(F.abs(F.get(top, k)) >= eps, F.transform(swapped, clear))

        return bound(eliminate, place)

    finish = lambda rows: F.transform(rows, lambda r, i: ieee_div(F.get(r, F.lit(n)), F.get(r, i)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step, finish)


def inverse(a: Column, n: int, eps: float = 2.220446049250313e-16) -> Column:
    """Inverse, column by column; null if singular."""
    unit = lambda j: F.array(*(F.lit(1.0 if i == j else 0.0) for i in range(n)))
    return bound(lambda a: F.when(solve(a, unit(0), n, eps).isNotNull(), F.concat(*(solve(a, unit(j), n, eps) for j in range(n)))), a)


def cholesky(a: Column, n: int) -> Column:
    """Lower factor of a positive definite matrix, read from its lower triangle; null if it is not one."""
    l: dict[tuple[int, int], Column] = {}
    good = F.lit(True)
    for j in range(n):
        rest = a[j * n + j]
        for k in range(j):
            rest = rest - l[j, k] * l[j, k]
        good = good & (rest > 0)
        l[j, j] = F.sqrt(F.greatest(rest, F.lit(0.0)))
        for i in range(j + 1, n):
            x = a[j * n + i]
            for k in range(j):
                x = x - l[i, k] * l[j, k]
            l[i, j] = ieee_div(x, l[j, j])
    return F.when(good, F.array(*(l.get((i, j), F.lit(0.0)) for j in range(n) for i in range(n))))
