"""Queries of matrix structure and decompositions.

A factor is never compared with another library's factor: Spark multiplies the factors back
with the expressions of `mat` (not the kernels), and SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numfold.functions import mat, vec
from numfold.operators import linalg
from numfold.plans.registry import M_SQL, S_SQL, q, register, sq
from numfold.sources.tables import vectors

Part = tuple[int, Callable[[dict[str, Column]], Column]]
N = 8
G_SQL = M_SQL + ", g AS (SELECT vec_id, i, j, v+CASE WHEN i=j THEN 1 ELSE 0 END AS v FROM (SELECT x.vec_id, x.i, y.i AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.j GROUP BY ALL))"
EYE = "SELECT vec_id, '{0}' AS part, i, j, CASE WHEN i=j THEN 1::DOUBLE ELSE 0 END AS v FROM m"
ONE = "SELECT vec_id, '{0}' AS part, 0 AS i, 0 AS j, {1}::DOUBLE AS v FROM embeddings"
ALL = "SELECT vec_id, '{0}' AS part, i, j, v FROM {1}"


def entries(df: DataFrame, parts: dict[str, tuple[int, Column]], digits: int = 6) -> DataFrame:
    """Rows (vec_id, part, i, j, v) of column-major matrices, each with its number of rows."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.lit(r).alias("rows"), x.alias("values")) for n, (r, x) in parts.items()))).alias("p")
    out = df.select("vec_id", each).select("vec_id", "p.part", "p.rows", F.posexplode("p.values").alias("pos", "v"))
    return out.select("vec_id", "part", (F.col("pos") % F.col("rows")).alias("i"), F.floor(F.col("pos") / F.col("rows")).cast("int").alias("j"), q(F.col("v"), digits).alias("v"))


def entries_sql(parts: list[str], ctes: str = M_SQL, digits: int = 6) -> str:
    return f"WITH {ctes}, o AS ({' UNION ALL '.join(parts)}) SELECT vec_id, part, i::INT AS i, j::INT AS j, {sq('v', digits)} AS v FROM o"


def factored(name: str, kernel: linalg.Kernel, outputs: list[str], parts: dict[str, Part], sql: list[str], ctes: str = M_SQL, digits: int = 6, failure: str = "Singular", n: int = N, m: int = N) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        source = vectors(spark, sf).select("vec_id", F.slice("a", 1, m * n).alias("a"))
        out = linalg.per_matrix(source, kernel, m, n, outputs, id_col="vec_id", failure=failure)
        c = {x: F.col(x) for x in outputs}
        return entries(out, {k: (rows, f(c)) for k, (rows, f) in parts.items()}, digits)

    register(name, query, entries_sql(sql, ctes, digits))


def times(x: str, y: str, m: int = N, k: int = N, n: int = N) -> Callable[[dict[str, Column]], Column]:
    return lambda c: mat.matmul(c[x], c[y], m, k, n)


def of_transpose(x: str, m: int = N, n: int = N) -> Callable[[dict[str, Column]], Column]:
    """X' X."""
    return lambda c: mat.matmul(mat.transpose(c[x], m, n), c[x], n, m, n)


def single(f: Callable[[dict[str, Column]], Column]) -> Part:
    return 1, lambda c: F.array(f(c))


def no_more(x: str, keep: Callable[[Column, Column], Column], m: int = N) -> Part:
    """Sum of the absolute entries (i, j) for which keep holds."""
    return single(lambda c: F.aggregate(F.transform(c[x], lambda v, k: F.when(keep(k % m, F.floor(k / m)), F.abs(v)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v))


def every(a: np.ndarray) -> np.ndarray:
    return np.ones(len(a), bool)


def gram(a: np.ndarray) -> np.ndarray:
    return a @ a.transpose(0, 2, 1) + np.eye(a.shape[1])


def side(a: np.ndarray) -> np.ndarray:
    """First column as a right side."""
    return a[:, :, :1]


# --- structure -------------------------------------------------------------------------

def structure(name: str, parts: dict[str, tuple[int, Callable[[Column], Column]]], sql: list[str]) -> None:
    register(name, lambda s, sf: entries(vectors(s, sf), {k: (rows, f(F.col("a"))) for k, (rows, f) in parts.items()}), entries_sql(sql))


def cut_sql(part: str, where: str, i0: int = 0, j0: int = 0) -> str:
    return f"SELECT vec_id, '{part}' AS part, i-{i0} AS i, j-{j0} AS j, v FROM m WHERE {where}"


structure("mat_corners", {
    "top_left": (3, lambda a: mat.corner(a, N, N, 3, 2)),
    "top_right": (3, lambda a: mat.corner(a, N, N, 3, 2, right=True)),
    "bottom_left": (3, lambda a: mat.corner(a, N, N, 3, 2, bottom=True)),
    "bottom_right": (3, lambda a: mat.corner(a, N, N, 3, 2, bottom=True, right=True)),
    "top_rows": (2, lambda a: mat.corner(a, N, N, 2, N)),
    "bottom_rows": (2, lambda a: mat.corner(a, N, N, 2, N, bottom=True)),
    "left_cols": (N, lambda a: mat.corner(a, N, N, N, 3)),
    "right_cols": (N, lambda a: mat.corner(a, N, N, N, 3, right=True)),
    "middle_rows": (2, lambda a: mat.block(a, N, 3, 0, 2, N)),
    "middle_cols": (N, lambda a: mat.block(a, N, 0, 4, N, 2)),
}, [
    cut_sql("top_left", "i<3 AND j<2"), cut_sql("top_right", "i<3 AND j>=6", 0, 6), cut_sql("bottom_left", "i>=5 AND j<2", 5, 0), cut_sql("bottom_right", "i>=5 AND j>=6", 5, 6),
    cut_sql("top_rows", "i<2"), cut_sql("bottom_rows", "i>=6", 6), cut_sql("left_cols", "j<3"), cut_sql("right_cols", "j>=5", 0, 5), cut_sql("middle_rows", "i IN (3,4)", 3), cut_sql("middle_cols", "j IN (4,5)", 0, 4),
])
structure("mat_rows_cols", {
    "row": (1, lambda a: mat.row(a, N, N, 2)),
    "col": (N, lambda a: mat.col(a, N, 5)),
    "set_col": (N, lambda a: mat.set_col(a, N, N, 3, mat.row(a, N, N, 0))),
    "set_at": (N, lambda a: mat.with_at(a, N, 1, 6, F.lit(9.5))),
    "at": (1, lambda a: F.array(mat.at(a, N, 4, 7))),
}, [
    "SELECT vec_id, 'row' AS part, 0 AS i, j, v FROM m WHERE i=2", "SELECT vec_id, 'col' AS part, i, 0 AS j, v FROM m WHERE j=5",
    "SELECT vec_id, 'set_col' AS part, i, j, CASE WHEN j=3 THEN embedding[8*i+1]::DOUBLE ELSE v END AS v FROM m JOIN embeddings USING (vec_id)",
    "SELECT vec_id, 'set_at' AS part, i, j, CASE WHEN i=1 AND j=6 THEN 9.5::DOUBLE ELSE v END AS v FROM m", "SELECT vec_id, 'at' AS part, 0 AS i, 0 AS j, v FROM m WHERE i=4 AND j=7",
])
structure("mat_constructors", {
    "zeros": (3, lambda a: mat.filled(3, 2)),
    "fill": (2, lambda a: mat.filled(2, 2, a[0])),
    "from_rows": (2, lambda a: mat.from_rows([[a[0], a[1], a[2]], [a[3], a[4], a[5]]])),
    "from_diag": (2, lambda a: mat.from_diag(vec.head(a, 2), 2)),
    "diag_wide": (1, lambda a: mat.diag(a, 4, 16)),
    "cast": (1, lambda a: mat.cast(F.transform(a, lambda x: x * 100), "int").cast("array<double>")),
    "shape": (1, lambda a: F.array(F.size(a).cast("double"), (F.size(a) / N).cast("double"), F.lit(float(mat.is_square(N, N))))),
}, [
    "SELECT vec_id, 'zeros' AS part, a.i, b.j, 0::DOUBLE AS v FROM embeddings, range(3) a(i), range(2) b(j)", "SELECT vec_id, 'fill' AS part, a.i, b.j, embedding[1]::DOUBLE AS v FROM embeddings, range(2) a(i), range(2) b(j)",
    "SELECT vec_id, 'from_rows' AS part, a.i, b.j, embedding[3*a.i+b.j+1]::DOUBLE AS v FROM embeddings, range(2) a(i), range(3) b(j)",
    "SELECT vec_id, 'from_diag' AS part, a.i, b.j, CASE WHEN a.i=b.j THEN embedding[a.i+1]::DOUBLE ELSE 0 END AS v FROM embeddings, range(2) a(i), range(2) b(j)",
    "SELECT vec_id, 'diag_wide' AS part, 0 AS i, k.j, embedding[4*k.j+k.j+1]::DOUBLE AS v FROM embeddings, range(4) k(j)",
    "SELECT vec_id, 'cast' AS part, 0 AS i, 8*j+i AS j, trunc(v*100) AS v FROM m",
    "SELECT vec_id, 'shape' AS part, 0 AS i, k.j, CASE k.j WHEN 0 THEN 64::DOUBLE WHEN 1 THEN 8 ELSE 1 END AS v FROM embeddings, range(3) k(j)",
])
structure("mat_iter_columns", {f"col{j}": (N, lambda a, j=j: F.get(mat.columns(a, N, N), F.lit(j))) for j in range(N)}, ["SELECT vec_id, 'col' || j AS part, i, 0 AS j, v FROM m"])
structure("vec_constructors", {
    "fill": (4, lambda a: F.array_repeat(F.lit(2.5), 4)),
    "from_fn": (5, lambda a: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (k * k).cast("double"))),
    "set_xyz": (3, lambda a: mat.with_at(mat.with_at(mat.with_at(vec.head(a, 3), 3, 0, 0, F.lit(1.5)), 3, 1, 0, F.lit(-2.0)), 3, 2, 0, F.get(a, 0))),
    "cast": (8, lambda a: mat.cast(vec.head(a, 8), "float").cast("array<double>")),
    "len": (1, lambda a: F.array(F.size(a).cast("double"), (F.size(a) == 0).cast("double"))),
}, [
    "SELECT vec_id, 'fill' AS part, k.i, 0 AS j, 2.5::DOUBLE AS v FROM embeddings, range(4) k(i)", "SELECT vec_id, 'from_fn' AS part, k.i, 0 AS j, (k.i*k.i)::DOUBLE AS v FROM embeddings, range(5) k(i)",
    "SELECT vec_id, 'set_xyz' AS part, k.i, 0 AS j, CASE k.i WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN -2 ELSE embedding[1]::DOUBLE END AS v FROM embeddings, range(3) k(i)",
    "SELECT vec_id, 'cast' AS part, i, 0 AS j, v FROM m WHERE j=0", "SELECT vec_id, 'len' AS part, 0 AS i, k.j, CASE k.j WHEN 0 THEN 64::DOUBLE ELSE 0 END AS v FROM embeddings, range(2) k(j)",
])

# --- decompositions ----------------------------------------------------------------------


def lu_kernel(a: np.ndarray):
    f, perm, sign, good = linalg.lu_stack(a)
    p = np.take_along_axis(np.tile(np.eye(a.shape[1]), (len(a), 1, 1)), perm[:, :, None], axis=1)
    return {"l": np.tril(f, -1) + np.eye(a.shape[1]), "u": np.triu(f), "p": p}, good


factored("lu_n", lu_kernel, ["l", "u", "p"], {
    "product": (N, lambda c: mat.matmul(mat.transpose(c["p"], N, N), mat.matmul(c["l"], c["u"], N, N, N), N, N, N)),
    "permutation": (N, of_transpose("p")),
    "largest_l": single(lambda c: F.array_max(F.transform(c["l"], F.abs))),
    "above_l": no_more("l", lambda i, j: i < j),
    "below_u": no_more("u", lambda i, j: i > j),
}, [ALL.format("product", "m"), EYE.format("permutation"), ONE.format("largest_l", 1), ONE.format("above_l", 0), ONE.format("below_u", 0)])
factored("lu_inverse_n", lambda a: (lambda x: ({"a": a, "x": x[0]}, x[1]))(linalg.inverse_stack(a)), ["a", "x"], {"right": (N, times("a", "x")), "left": (N, times("x", "a"))}, [EYE.format("right"), EYE.format("left")], digits=4)
factored("lu_solve_matrix_n", lambda a: (lambda x: ({"g": gram(a), "x": x[0]}, x[1]))(linalg.solve_stack(gram(a), a[:, :, :3])), ["g", "x"], {"back": (N, times("g", "x", N, N, 3))}, [cut_sql("back", "j<3")])
factored("solve_refined_n", lambda a: (lambda x: ({"g": gram(a), "x": x[0]}, x[1]))(linalg.solve_stack(gram(a), side(a), 3)), ["g", "x"], {"back": (N, times("g", "x", N, N, 1))}, [cut_sql("back", "j=0")], digits=9)


def complex_kernel(a: np.ndarray):
    """4 x 4 complex systems: real parts above, imaginary ones below, the right side in column 4."""
    whole, right = a[:, :4, :4] + 1j * a[:, 4:, :4], (a[:, :4, 4] + 1j * a[:, 4:, 4])[:, :, None]
    x, good = linalg.solve_stack(whole, right, 2)
    inverse, _ = linalg.inverse_stack(whole)
    unit = linalg.det_stack(whole) * linalg.det_stack(inverse)
    return {"p": whole.real, "q": whole.imag, "x": x.real, "y": x.imag, "unit": np.stack([unit.real, unit.imag], axis=1)}, good


factored("solve_complex", complex_kernel, ["p", "q", "x", "y", "unit"], {
    "real": (4, lambda c: vec.sub(mat.matmul(c["p"], c["x"], 4, 4, 1), mat.matmul(c["q"], c["y"], 4, 4, 1))),
    "imag": (4, lambda c: vec.add(mat.matmul(c["p"], c["y"], 4, 4, 1), mat.matmul(c["q"], c["x"], 4, 4, 1))),
    "unit": (1, lambda c: c["unit"]),
}, ["SELECT vec_id, 'real' AS part, i, 0 AS j, v FROM m WHERE i<4 AND j=4", "SELECT vec_id, 'imag' AS part, i-4 AS i, 0 AS j, v FROM m WHERE i>=4 AND j=4", "SELECT vec_id, 'unit' AS part, 0 AS i, k.j, 1-k.j::DOUBLE AS v FROM embeddings, range(2) k(j)"])


def mixed(a: np.ndarray) -> np.ndarray:
    """6 x 6 matrices of the 3 x 3 blocks of the first and next nine entries, with rows and columns shuffled (an odd permutation in all)."""
    flat = a.transpose(0, 2, 1).reshape(len(a), -1)
    out = np.zeros((len(a), 6, 6))
    out[:, :3, :3], out[:, 3:, 3:] = (flat[:, k : k + 9].reshape(-1, 3, 3).transpose(0, 2, 1) for k in (0, 9))
    return out[:, [3, 1, 4, 0, 2, 5]][:, :, [1, 0, 2, 3, 4, 5]]


def det3_sql(k: int) -> str:
    e = [f"embedding[{k + n}]::DOUBLE" for n in range(1, 10)]
    return f"({e[0]}*({e[4]}*{e[8]}-{e[7]}*{e[5]})-{e[3]}*({e[1]}*{e[8]}-{e[7]}*{e[2]})+{e[6]}*({e[1]}*{e[5]}-{e[4]}*{e[2]}))"


factored("lu_det_n", lambda a: ({"d": 1e7 * linalg.det_stack(mixed(a))[:, None], "s": linalg.det_stack(a[:, :, [0, 1, 2, 3, 4, 5, 6, 0]])[:, None]}, every(a)), ["d", "s"], {"det": (1, lambda c: c["d"]), "singular": (1, lambda c: F.transform(c["s"], lambda x: F.when(F.abs(x) < 1e-12, 0.0).otherwise(x)))},
         [f"SELECT vec_id, 'det' AS part, 0 AS i, 0 AS j, -1e7*{det3_sql(0)}*{det3_sql(9)} AS v FROM embeddings", ONE.format("singular", 0)], digits=4)
factored("qr_n", lambda a: (lambda x: ({"q": x[0], "r": x[1]}, x[3]))(linalg.qr_stack(a)), ["q", "r"], {
    "product": (N, times("q", "r")), "orthogonal": (N, of_transpose("q")), "below": no_more("r", lambda i, j: i > j),
    "sign": single(lambda c: F.signum(c["r"][0])),
}, [ALL.format("product", "m"), EYE.format("orthogonal"), ONE.format("below", 0), "SELECT vec_id, 'sign' AS part, 0 AS i, 0 AS j, CASE WHEN embedding[1]>=0 THEN -1::DOUBLE ELSE 1 END AS v FROM embeddings"])
factored("qr_solve_n", lambda a: (lambda x: ({"a": a[:, :, 1:5], "x": x[0]}, x[1]))(linalg.lsq_stack(a[:, :, 1:5], side(a))), ["a", "x"], {"normal": (4, lambda c: mat.matmul(mat.transpose(c["a"], N, 4), mat.matmul(c["a"], c["x"], N, 4, 1), 4, N, 1))},
         ["SELECT x.vec_id, 'normal' AS part, x.j-1 AS i, 0 AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.i=y.i AND y.j=0 AND x.j BETWEEN 1 AND 4 GROUP BY ALL"])
factored("qr_det_n", lambda a: ({"d": 1e7 * linalg.qr_det(mixed(a))[:, None]}, every(a)), ["d"], {"size": (1, lambda c: F.transform(c["d"], F.abs))}, [f"SELECT vec_id, 'size' AS part, 0 AS i, 0 AS j, abs(1e7*{det3_sql(0)}*{det3_sql(9)}) AS v FROM embeddings"], digits=4)


def pivot_kernel(a: np.ndarray):
    x, r, perm, _ = linalg.qr_stack(a, pivot=True)
    p = np.take_along_axis(np.tile(np.eye(a.shape[2]), (len(a), 1, 1)), perm[:, None, :], axis=2)
    low = a[:, :, :3] @ a[:, :, 3:6].transpose(0, 2, 1)
    return {"q": x, "r": r, "p": p, "rank": linalg.rank_stack(low, 1e-10)[:, None]}, every(a)


factored("qr_pivot_n", pivot_kernel, ["q", "r", "p", "rank"], {
    "product": (N, lambda c: mat.matmul(mat.matmul(c["q"], c["r"], N, N, N), mat.transpose(c["p"], N, N), N, N, N)), "orthogonal": (N, of_transpose("q")), "permutation": (N, of_transpose("p")),
    "falling": single(lambda c: mat.bound(lambda d: F.forall(F.sequence(F.lit(1), F.lit(N - 1)), lambda k: F.get(d, k) <= F.get(d, k - 1)), F.transform(mat.diag(c["r"], N, N), F.abs)).cast("double")),
    "rank": (1, lambda c: c["rank"]),
}, [ALL.format("product", "m"), EYE.format("orthogonal"), EYE.format("permutation"), ONE.format("falling", 1), ONE.format("rank", 3)])


def svd_kernel(a: np.ndarray):
    u, s, vt = linalg.svd_stack(a)
    low = a[:, :, :3] @ a[:, :, 3:6].transpose(0, 2, 1)
    return {"u": u, "s": s, "vt": vt, "more": np.stack([linalg.svd_rank(low), linalg.svd_rank(low, 1e-10)], axis=1), "cond": linalg.condition(a[:, :, :2])[:, None]}, every(a)


POWER_SQL = "SELECT vec_id, 'sum2' AS part, 0 AS i, 0 AS j, sum(v*v) AS v FROM m GROUP BY ALL UNION ALL SELECT vec_id, 'sum4' AS part, 0 AS i, 0 AS j, sum(v*v) AS v FROM (SELECT x.vec_id, x.i, y.i AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.j GROUP BY ALL) GROUP BY ALL"
COND_SQL = "SELECT vec_id, 'cond' AS part, 0 AS i, 0 AS j, sqrt((a+d+w)/(a+d-w)) AS v FROM (SELECT *, sqrt((a-d)*(a-d)+4*b*b) AS w FROM (SELECT vec_id, sum(x*x) AS a, sum(x*y) AS b, sum(y*y) AS d FROM (SELECT vec_id, i, max(CASE WHEN j=0 THEN v END) AS x, max(CASE WHEN j=1 THEN v END) AS y FROM m GROUP BY ALL) GROUP BY ALL))"
power = lambda k: single(lambda c: F.aggregate(c["s"], F.lit(0.0), lambda t, x: t + F.pow(x, F.lit(float(k)))))
factored("svd_n", svd_kernel, ["u", "s", "vt", "more", "cond"], {
    "product": (N, lambda c: mat.matmul(mat.matmul(c["u"], mat.from_diag(c["s"], N), N, N, N), c["vt"], N, N, N)), "u": (N, of_transpose("u")), "v": (N, of_transpose("vt")),
    "sum2": power(2), "sum4": power(4), "falling": single(lambda c: (F.reverse(F.array_sort(c["s"])) == c["s"]).cast("double")), "rank": (1, lambda c: c["more"]), "cond": (1, lambda c: c["cond"]),
}, [ALL.format("product", "m"), EYE.format("u"), EYE.format("v"), POWER_SQL, ONE.format("falling", 1), "SELECT vec_id, 'rank' AS part, 0 AS i, k.j, 3::DOUBLE AS v FROM embeddings, range(2) k(j)", COND_SQL], digits=5)
factored("pinv_n", lambda a: ({"a": a[:, :, :4], "x": linalg.pinv_stack(a[:, :, :4])}, every(a)), ["a", "x"], {
    "inverse": (4, times("x", "a", 4, N, 4)), "again": (N, lambda c: mat.matmul(mat.matmul(c["a"], c["x"], N, 4, N), c["a"], N, N, 4)),
}, ["SELECT vec_id, 'inverse' AS part, i, j, CASE WHEN i=j THEN 1::DOUBLE ELSE 0 END AS v FROM m WHERE i<4 AND j<4", cut_sql("again", "j<4")])
factored("svd_solve_n", lambda a: ({"a": a[:, :, 1:5], "x": linalg.pinv_stack(a[:, :, 1:5]) @ side(a)}, every(a)), ["a", "x"], {"normal": (4, lambda c: mat.matmul(mat.transpose(c["a"], N, 4), mat.matmul(c["a"], c["x"], N, 4, 1), 4, N, 1))},
         ["SELECT x.vec_id, 'normal' AS part, x.j-1 AS i, 0 AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.i=y.i AND y.j=0 AND x.j BETWEEN 1 AND 4 GROUP BY ALL"])
factored("eig_sym_n", lambda a: (lambda x: ({"w": x[0], "v": x[1]}, every(a)))(linalg.eigh_stack(a + a.transpose(0, 2, 1))), ["w", "v"], {
    "product": (N, lambda c: mat.matmul(mat.matmul(c["v"], mat.from_diag(c["w"], N), N, N, N), mat.transpose(c["v"], N, N), N, N, N)), "orthogonal": (N, of_transpose("v")), "rising": single(lambda c: (F.array_sort(c["w"]) == c["w"]).cast("double")),
}, ["SELECT vec_id, 'product' AS part, i, j, v+embedding[8*i+j+1]::DOUBLE AS v FROM m JOIN embeddings USING (vec_id)", EYE.format("orthogonal"), ONE.format("rising", 1)])
factored("hessenberg_n", lambda a: (lambda x: ({"h": x[0], "q": x[1]}, every(a)))(linalg.hessenberg_stack(a)), ["h", "q"], {
    "product": (N, lambda c: mat.matmul(mat.matmul(c["q"], c["h"], N, N, N), mat.transpose(c["q"], N, N), N, N, N)), "orthogonal": (N, of_transpose("q")), "below": no_more("h", lambda i, j: i > j + 1),
}, [ALL.format("product", "m"), EYE.format("orthogonal"), ONE.format("below", 0)])


def schur_kernel(a: np.ndarray):
    s, x, good = linalg.schur_stack(a)
    w = linalg.eigenvalues_of_schur(s)
    sums = np.stack([(w**k).sum(axis=1).real for k in (1, 2, 3)] + [np.abs(w.imag.sum(axis=1))], axis=1)
    return {"s": s, "q": x, "sums": sums}, good


TRACES_SQL = "SELECT vec_id, 'traces' AS part, 0 AS i, 0 AS j, sum(v) AS v FROM m WHERE i=j GROUP BY ALL UNION ALL SELECT x.vec_id, 'traces' AS part, 0 AS i, 1 AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.i AND y.j=x.i GROUP BY ALL UNION ALL SELECT x.vec_id, 'traces' AS part, 0 AS i, 2 AS j, sum(x.v*y.v) AS v FROM (SELECT x.vec_id, x.i, y.j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.i GROUP BY ALL) x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.i AND y.j=x.i GROUP BY ALL UNION ALL SELECT vec_id, 'traces' AS part, 0 AS i, 3 AS j, 0::DOUBLE AS v FROM embeddings"
factored("schur_n", schur_kernel, ["s", "q", "sums"], {
    "product": (N, lambda c: mat.matmul(mat.matmul(c["q"], c["s"], N, N, N), mat.transpose(c["q"], N, N), N, N, N)), "orthogonal": (N, of_transpose("q")), "below": no_more("s", lambda i, j: i > j + 1),
    "blocks": single(lambda c: mat.bound(lambda s: F.exists(F.sequence(F.lit(0), F.lit(N - 3)), lambda k: (F.get(s, (k * (N + 1) + 1).cast("int")) != 0) & (F.get(s, ((k + 1) * (N + 1) + 1).cast("int")) != 0)), c["s"]).cast("double")), "traces": (1, lambda c: c["sums"]),
}, [ALL.format("product", "m"), EYE.format("orthogonal"), ONE.format("below", 0), ONE.format("blocks", 0), TRACES_SQL], failure="ConvergenceFailure")
factored("eigenvalues_2x2", lambda a: (lambda w: ({"re": np.sort_complex(w).real, "im": np.sort_complex(w).imag}, every(a)))(linalg.eigenvalues_of_schur(linalg.schur_stack(a)[0])), ["re", "im"], {"re": (2, lambda c: c["re"]), "im": (2, lambda c: c["im"])},
         [f"SELECT vec_id, '{part}' AS part, k.i, 0 AS j, {value} AS v FROM (SELECT vec_id, (e0+e3)/2 AS h, (e0-e3)*(e0-e3)/4+e2*e1 AS d FROM s), range(2) k(i)" for part, value in (("re", "CASE WHEN d>=0 THEN h+(2*k.i-1)*sqrt(d) ELSE h END"), ("im", "CASE WHEN d>=0 THEN 0 ELSE (2*k.i-1)*sqrt(-d) END"))], ctes=S_SQL, n=2, m=2)
def exp_scale(a: np.ndarray) -> np.ndarray:
    """A factor that brings exp of 2 x 2 matrices to about 1."""
    h, z = (a[:, 0, 0] + a[:, 1, 1]) / 2, (a[:, 0, 0] - a[:, 1, 1]) ** 2 / 4 + a[:, 0, 1] * a[:, 1, 0]
    return np.exp(-np.abs(h) - np.sqrt(np.abs(z)))


EXP2_SQL = "x AS (SELECT vec_id, 40*e0 AS a, 40*e1 AS c, 40*e2 AS b, 40*e3 AS d FROM s), y AS (SELECT *, (a+d)/2 AS h, (a-d)*(a-d)/4+b*c AS z FROM x), f AS (SELECT *, CASE WHEN z>1e-12 THEN sinh(sqrt(z))/sqrt(z) WHEN z<-1e-12 THEN sin(sqrt(-z))/sqrt(-z) ELSE 1 END AS s1, CASE WHEN z>0 THEN cosh(sqrt(z)) ELSE cos(sqrt(-z)) END AS c1 FROM y), r AS (SELECT vec_id, exp(h) AS e, exp(-abs(h)-sqrt(abs(z))) AS w, s1, c1, h, a, b, c, d FROM f)"
factored("expm_2x2", lambda a: (lambda x, k: ({"e": x * k[:, None, None]}, every(a)))(linalg.expm_stack(40 * a), exp_scale(40 * a)), ["e"], {"exp": (2, lambda c: c["e"])},
         [f"SELECT vec_id, 'exp' AS part, {i} AS i, {j} AS j, e*w*({'c1+' if i == j else ''}s1*{x}) AS v FROM r" for i, j, x in ((0, 0, "(a-h)"), (0, 1, "b"), (1, 0, "c"), (1, 1, "(d-h)"))], ctes=S_SQL + ", " + EXP2_SQL, n=2, m=2)


factored("expm_n", lambda a: ({"e": linalg.expm_stack(a), "f": linalg.expm_stack(-a), "h": linalg.expm_stack(a / 2)}, every(a)), ["e", "f", "h"], {"inverse": (N, times("e", "f")), "half": (N, lambda c: mat.matmul(mat.matmul(c["h"], c["h"], N, N, N), c["f"], N, N, N))}, [EYE.format("inverse"), EYE.format("half")])


def cholesky_kernel(a: np.ndarray):
    g = gram(a)
    low, good = linalg.cholesky_stack(g)
    up, _ = linalg.rank1_stack(low, a[:, :, 1])
    down, _ = linalg.rank1_stack(up, a[:, :, 1], -1.0)
    ln = 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)
    det = np.diagonal(low, axis1=1, axis2=2).prod(axis=1) ** 2
    eye = np.tile(np.eye(a.shape[1]), (len(a), 1, 1))
    return {"g": g, "l": low, "x": linalg.cholesky_solve(low, a[:, :, :2]), "inv": linalg.cholesky_solve(low, eye), "up": up, "down": down, "ln": np.stack([ln - np.log(det)], axis=1)}, good


square = lambda x: (N, lambda c: mat.matmul(c[x], mat.transpose(c[x], N, N), N, N, N))
factored("cholesky_n", cholesky_kernel, ["g", "l", "x", "inv", "up", "down", "ln"], {
    "product": square("l"), "above": no_more("l", lambda i, j: i < j), "solve": (N, times("g", "x", N, N, 2)), "inverse": (N, times("g", "inv")), "update": square("up"), "downdate": square("down"), "ln_det": (1, lambda c: c["ln"]),
}, [ALL.format("product", "g"), ONE.format("above", 0), cut_sql("solve", "j<2"), EYE.format("inverse"), "SELECT vec_id, 'update' AS part, i, j, v+embedding[8+i+1]::DOUBLE*embedding[8+j+1]::DOUBLE AS v FROM g JOIN embeddings USING (vec_id)", ALL.format("downdate", "g"), ONE.format("ln_det", 0)], ctes=G_SQL, failure="NotPositiveDefinite")


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """What failing matrices say: singular, not positive definite, of another size, null, regular."""
    v = vectors(spark, sf).withColumn("k", F.col("vec_id") % 4)
    a = F.when(F.col("k") == 0, F.transform(F.slice("a", 1, 4), lambda x: F.lit(0.0))).when(F.col("k") == 1, F.slice("a", 1, 3)).when(F.col("k") == 2, F.array(*map(F.lit, (-1.0, 0.5, 0.5, 2.0)))).otherwise(F.array(*map(F.lit, (2.0, 0.5, 0.5, 2.0))))
    v = v.select("vec_id", a.alias("a"))
    lu = linalg.per_matrix(v, lambda a: (lambda x: ({"x": x[0]}, x[3]))(linalg.lu_stack(a)), 2, 2, ["x"], id_col="vec_id")
    low = linalg.per_matrix(v, lambda a: (lambda x: ({"y": x[0]}, x[1]))(linalg.cholesky_stack(a)), 2, 2, ["y"], id_col="vec_id", failure="NotPositiveDefinite")
    both = lu.select("vec_id", F.col("status").alias("lu"), F.col("x").isNull().alias("lu_null")).join(low.select("vec_id", F.col("status").alias("cholesky")), "vec_id")
    return both.select("vec_id", "lu", "lu_null", "cholesky")


register("linalg_status", statuses, "SELECT vec_id, CASE vec_id%4 WHEN 0 THEN 'Singular' WHEN 1 THEN 'DimensionMismatch' ELSE 'ok' END AS lu, vec_id%4 IN (0,1) AS lu_null, CASE vec_id%4 WHEN 0 THEN 'NotPositiveDefinite' WHEN 1 THEN 'DimensionMismatch' WHEN 2 THEN 'NotPositiveDefinite' ELSE 'ok' END AS cholesky FROM embeddings")
