"""Queries of the numerical operators, each with its DuckDB form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from numfold.functions import design, mat, rng, special, vec
from numfold.operators import estimate, image, interp, linalg, numeric, ode, scan
from numfold.plans.registry import IMG_SQL, M_SQL, ORACLES, QUERIES, S_SQL, V_SQL, Query, q, register, sq
from numfold.sources.tables import HEIGHT, WIDTH, from_json, images, signal, table, to_json, vectors

# --- vectors -------------------------------------------------------------------------

def elementwise(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        return v.select("vec_id", F.posexplode(f(F.col("a"), F.reverse("a"))).alias("pos", "v")).select("vec_id", "pos", q(F.col("v")).alias("v"))

    register(name, query, f"WITH {V_SQL} SELECT vec_id, pos, {sq(sql)} AS v FROM v")


elementwise("vec_add", vec.add, "a+b")
elementwise("vec_sub", vec.sub, "a-b")
elementwise("vec_neg", lambda a, b: vec.neg(a), "-a")
elementwise("vec_scale", lambda a, b: vec.scale(a, 2.5), "a*2.5::DOUBLE")
elementwise("vec_add_scalar", lambda a, b: vec.shift(a, 1.5), "a+1.5::DOUBLE")
elementwise("vec_div_scalar", lambda a, b: vec.over(a, F.lit(3.0)), "a/3::DOUBLE")
elementwise("hadamard_mul", vec.mul, "a*b")
elementwise("hadamard_div", lambda a, b: vec.div(a, vec.shift(vec.mul(b, b), 1.0)), "a/(b*b+1)")
elementwise("mat_abs", lambda a, b: vec.absolute(a), "abs(a)")
elementwise("element_max", vec.pairwise_max, "greatest(a,b)")
elementwise("mat_map", lambda a, b: F.transform(a, lambda x: x * x + 1), "a*a+1")
elementwise("vec_reverse", lambda a, b: b, "b")


def per_vector(name: str, columns: Callable[[Column, Column], dict[str, Column]], sql: dict[str, str]) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        return v.select("vec_id", *(q(c).alias(k) for k, c in columns(F.col("a"), F.reverse("a")).items()))

    register(name, query, f"WITH {V_SQL} SELECT vec_id, " + ", ".join(f"{sq(s)} AS {k}" for k, s in sql.items()) + " FROM v GROUP BY vec_id")


per_vector("mat_sum", lambda a, b: {"s": vec.total(a)}, {"s": "sum(a)"})
per_vector("dot", lambda a, b: {"d": vec.dot(a, b)}, {"d": "sum(a*b)"})
per_vector("norm_l2", lambda a, b: {"n": vec.norm(a)}, {"n": "sqrt(sum(a*a))"})
per_vector("norm_squared", lambda a, b: {"n": vec.norm_squared(a)}, {"n": "sum(a*a)"})
per_vector("norm_l1", lambda a, b: {"n": vec.norm_l1(a)}, {"n": "sum(abs(a))"})
per_vector("scaled_norm", lambda a, b: {"n": vec.scaled_norm(a)}, {"n": "sqrt(avg(a*a))"})
per_vector("norm_fro", lambda a, b: {"n": mat.frobenius(a)}, {"n": "sqrt(sum(a*a))"})
per_vector("vec_components", lambda a, b: {"x": a[0], "y": a[1], "z": a[2]}, {k: f"max(CASE WHEN pos={i} THEN a END)" for i, k in enumerate("xyz")})
elementwise("normalize", lambda a, b: vec.normalize(a), "a/sqrt(sum(a*a) OVER (PARTITION BY vec_id))")
register("cross3", lambda s, sf: vectors(s, sf).select("vec_id", vec.cross(vec.head(F.col("a"), 3), vec.tail(F.col("a"), 3)).alias("c")).select("vec_id", *(q(F.col("c")[i]).alias(f"c{i}") for i in range(3))),
         "WITH " + S_SQL + ", z AS (SELECT vec_id, embedding[62]::DOUBLE p, embedding[63]::DOUBLE q, embedding[64]::DOUBLE r FROM embeddings) SELECT vec_id, " + f"{sq('e1*r-e2*q')} AS c0, {sq('e2*p-e0*r')} AS c1, {sq('e0*q-e1*p')} AS c2 FROM s JOIN z USING (vec_id)")
register("vec_head_tail_segment", lambda s, sf: vectors(s, sf).select("vec_id", q(vec.total(vec.head(F.col("a"), 5))).alias("h"), q(vec.total(vec.tail(F.col("a"), 5))).alias("t"), q(vec.total(vec.segment(F.col("a"), 10, 4))).alias("g")),
         f"WITH {V_SQL} SELECT vec_id, {sq('sum(CASE WHEN pos<5 THEN a ELSE 0 END)')} AS h, {sq('sum(CASE WHEN pos>=59 THEN a ELSE 0 END)')} AS t, {sq('sum(CASE WHEN pos BETWEEN 10 AND 13 THEN a ELSE 0 END)')} AS g FROM v GROUP BY vec_id")


# --- matrices (8 x 8, column-major) --------------------------------------------------

def matrices(name: str, f: Callable[[Column], Column], rows: int, sql: str) -> None:
    """Entries (vec_id, i, j, v) of a matrix of `rows` rows; sql selects i, j, v from m."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = vectors(spark, sf).select("vec_id", F.posexplode(f(F.col("a"))).alias("pos", "v"))
        return out.select("vec_id", (F.col("pos") % rows).alias("i"), F.floor(F.col("pos") / rows).cast("int").alias("j"), q(F.col("v")).alias("v"))

    register(name, query, f"WITH {M_SQL}, o AS ({sql}) SELECT vec_id, i::INT AS i, j::INT AS j, {sq('v')} AS v FROM o")


matrices("transpose", lambda a: mat.transpose(a, 8, 8), 8, "SELECT vec_id, j AS i, i AS j, v FROM m")
matrices("block", lambda a: mat.block(a, 8, 2, 3, 3, 4), 3, "SELECT vec_id, i-2 AS i, j-3 AS j, v FROM m WHERE i BETWEEN 2 AND 4 AND j BETWEEN 3 AND 6")
matrices("set_block", lambda a: mat.set_block(a, 8, 8, F.array(*(F.lit(float(k)) for k in range(4))), 1, 2, 2, 2), 8, "SELECT vec_id, i, j, CASE WHEN i BETWEEN 1 AND 2 AND j BETWEEN 2 AND 3 THEN ((j-2)*2+i-1)::DOUBLE ELSE v END AS v FROM m")
matrices("swap_rows", lambda a: mat.swap_rows(a, 8, 8, 1, 5), 8, "SELECT vec_id, CASE i WHEN 1 THEN 5 WHEN 5 THEN 1 ELSE i END AS i, j, v FROM m")
matrices("swap_cols", lambda a: mat.swap_cols(a, 8, 8, 0, 7), 8, "SELECT vec_id, i, CASE j WHEN 0 THEN 7 WHEN 7 THEN 0 ELSE j END AS j, v FROM m")
matrices("set_row", lambda a: mat.bound(lambda a: mat.set_row(a, 8, 8, 3, mat.row(a, 8, 8, 0)), a), 8, "SELECT vec_id, i, j, CASE WHEN i=3 THEN embedding[8*j+1]::DOUBLE ELSE v END AS v FROM m JOIN embeddings USING (vec_id)")
matrices("identity", lambda a: mat.identity(8), 8, "SELECT vec_id, i, j, CASE WHEN i=j THEN 1::DOUBLE ELSE 0 END AS v FROM m")
matrices("from_diag", lambda a: mat.from_diag(mat.diag(a, 8, 8), 8), 8, "SELECT vec_id, i, j, CASE WHEN i=j THEN v ELSE 0 END AS v FROM m")
matrices("mat_from_fn", lambda a: mat.from_fn(8, 8, lambda i, j: (i * 10 + j).cast("double")), 8, "SELECT vec_id, i, j, (i*10+j)::DOUBLE AS v FROM m")
matrices("outer", lambda a: mat.from_fn(8, 8, lambda i, j: F.get(a, i) * F.get(a, j + 8)), 8, "SELECT x.vec_id, x.i, y.i AS j, x.v*y.v AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=0 AND y.j=1")
matrices("matmul", lambda a: mat.matmul(a, mat.transpose(a, 8, 8), 8, 8, 8), 8, "SELECT x.vec_id, x.i, y.i AS j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.j GROUP BY ALL")
matrices("mat_pow", lambda a: mat.power(a, 8, 2), 8, "SELECT x.vec_id, x.i, y.j, sum(x.v*y.v) AS v FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.j=y.i GROUP BY ALL")
matrices("kronecker", lambda a: mat.kronecker(F.slice(a, 1, 4), 2, 2, F.slice(a, 5, 4), 2, 2), 4,
         "SELECT p.vec_id, (p.i%2)*2+(r.i%2) AS i, (p.i//2)*2+(r.i//2) AS j, p.v*r.v AS v FROM (SELECT vec_id, i, v FROM m WHERE j=0 AND i<4) p JOIN (SELECT vec_id, i-4 AS i, v FROM m WHERE j=0 AND i>=4) r USING (vec_id)")
per_vector("mat_norms", lambda a, b: {"d": mat.trace(a, 8, 8), "s": vec.total(mat.diag(mat.transpose(a, 8, 8), 8, 8))}, {"d": "sum(CASE WHEN pos%9=0 THEN a ELSE 0 END)", "s": "sum(CASE WHEN pos%9=0 THEN a ELSE 0 END)"})
register("norm_inf_one", lambda s, sf: vectors(s, sf).select("vec_id", q(mat.norm_inf(F.col("a"), 8, 8)).alias("inf"), q(mat.norm_one(F.col("a"), 8, 8)).alias("one")),
         f"WITH {M_SQL}, r AS (SELECT vec_id, max(s) x FROM (SELECT vec_id, i, sum(abs(v)) s FROM m GROUP BY ALL) GROUP BY vec_id), c AS (SELECT vec_id, max(s) x FROM (SELECT vec_id, j, sum(abs(v)) s FROM m GROUP BY ALL) GROUP BY vec_id) SELECT vec_id, {sq('r.x')} AS inf, {sq('c.x')} AS one FROM r JOIN c USING (vec_id)")
register("is_symmetric", lambda s, sf: vectors(s, sf).select("vec_id", mat.is_symmetric(F.col("a"), 8).alias("sym"), mat.is_symmetric(mat.matmul(F.col("a"), mat.transpose(F.col("a"), 8, 8), 8, 8, 8), 8).alias("gram_sym")),
         f"WITH {M_SQL} SELECT x.vec_id, bool_and(x.v=y.v) AS sym, true AS gram_sym FROM m x JOIN m y ON x.vec_id=y.vec_id AND x.i=y.j AND x.j=y.i GROUP BY x.vec_id")


def gram(spark: SparkSession, sf: str) -> DataFrame:
    """Gram matrix of all vectors."""
    return linalg.gram_matrix(vectors(spark, sf), "a", 64).select("i", "j", q(F.col("v")).alias("v"))


register("gram", gram, f"WITH {V_SQL} SELECT x.pos AS i, y.pos AS j, {sq('sum(x.a*y.a)')} AS v FROM v x JOIN v y USING (vec_id) GROUP BY ALL")

DET3 = "(e0*(e4*e8-e7*e5)-e3*(e1*e8-e7*e2)+e6*(e1*e5-e4*e2))"
SPD_SQL = S_SQL + ", p AS (SELECT vec_id, e0*e0+e3*e3+e6*e6+1 a, e1*e0+e4*e3+e7*e6 b, e2*e0+e5*e3+e8*e6 c, e1*e1+e4*e4+e7*e7+1 d, e2*e1+e5*e4+e8*e7 e, e2*e2+e5*e5+e8*e8+1 f, e0 x, e1 y, e2 z FROM s)"
PDET = "(a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c))"
spd = lambda s, sf: vectors(s, sf).select("vec_id", F.col("a"), linalg.spd3(F.col("a")).alias("p"))
register("det3", lambda s, sf: vectors(s, sf).select("vec_id", q(mat.det(F.slice("a", 1, 9), 3)).alias("d")), f"WITH {S_SQL} SELECT vec_id, {sq(DET3)} AS d FROM s")
register("det2", lambda s, sf: vectors(s, sf).select("vec_id", q(mat.det(F.slice("a", 1, 4), 2)).alias("d")), f"WITH {S_SQL} SELECT vec_id, {sq('e0*e3-e1*e2')} AS d FROM s")
register("solve_3x3", lambda s, sf: spd(s, sf).select("vec_id", mat.solve(F.col("p"), F.slice("a", 1, 3), 3).alias("x")).select("vec_id", *(q(F.col("x")[k]).alias(f"x{k}") for k in range(3))),
         f"WITH {SPD_SQL} SELECT vec_id, {sq(f'(x*(d*f-e*e)-b*(y*f-e*z)+c*(y*e-d*z))/{PDET}')} AS x0, {sq(f'(a*(y*f-e*z)-x*(b*f-e*c)+c*(b*z-y*c))/{PDET}')} AS x1, {sq(f'(a*(d*z-y*e)-b*(b*z-y*c)+x*(b*e-d*c))/{PDET}')} AS x2 FROM p")
register("inverse_3x3", lambda s, sf: spd(s, sf).select("vec_id", mat.inverse(F.col("p"), 3).alias("x")).select("vec_id", *(q(F.col("x")[k]).alias(f"x{k}") for k in (0, 1, 2, 4, 5, 8))),
         f"WITH {SPD_SQL} SELECT vec_id, {sq(f'(d*f-e*e)/{PDET}')} AS x0, {sq(f'(c*e-b*f)/{PDET}')} AS x1, {sq(f'(b*e-c*d)/{PDET}')} AS x2, {sq(f'(a*f-c*c)/{PDET}')} AS x4, {sq(f'(b*c-a*e)/{PDET}')} AS x5, {sq(f'(a*d-b*b)/{PDET}')} AS x8 FROM p")
register("cholesky_3x3", lambda s, sf: spd(s, sf).select("vec_id", mat.cholesky(F.col("p"), 3).alias("l")).select("vec_id", *(q(F.col("l")[k]).alias(f"l{k}") for k in (0, 1, 2, 4, 5, 8))),
         f"WITH {SPD_SQL}, l AS (SELECT *, sqrt(a) l0, b/sqrt(a) l1, c/sqrt(a) l2 FROM p), k AS (SELECT *, sqrt(d-l1*l1) l4 FROM l), h AS (SELECT *, (e-l2*l1)/l4 l5 FROM k) SELECT vec_id, " + ", ".join(f"{sq(x)} AS {n}" for n, x in (("l0", "l0"), ("l1", "l1"), ("l2", "l2"), ("l4", "l4"), ("l5", "l5"), ("l8", "sqrt(f-l2*l2-l5*l5)"))) + " FROM h")
register("ln_det", lambda s, sf: spd(s, sf).select("vec_id", mat.cholesky(F.col("p"), 3).alias("l")).select("vec_id", q(2 * (F.log(F.col("l")[0]) + F.log(F.col("l")[4]) + F.log(F.col("l")[8]))).alias("d")), f"WITH {SPD_SQL} SELECT vec_id, {sq(f'ln({PDET})')} AS d FROM p")


def sym2(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = F.col("p")[0], F.col("p")[1], F.col("p")[4]
    root = F.sqrt((x - z) * (x - z) + 4 * y * y)
    return spd(spark, sf).select("vec_id", q((x + z - root) / 2).alias("l0"), q((x + z + root) / 2).alias("l1"), q(vec.ieee_div(x + z + root, x + z - root)).alias("cond"))


register("eig_sym_2x2", sym2, f"WITH {SPD_SQL}, r AS (SELECT *, sqrt((a-d)*(a-d)+4*b*b) w FROM p) SELECT vec_id, {sq('(a+d-w)/2')} AS l0, {sq('(a+d+w)/2')} AS l1, {sq('(a+d+w)/(a+d-w)')} AS cond FROM r")


register("lsq_line", lambda s, sf: table(s, sf, "lineitem").groupBy("l_returnflag").agg(q(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), q(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept")),
         f"SELECT l_returnflag, {sq('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {sq('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem GROUP BY l_returnflag")


def batch_lsq(spark: SparkSession, sf: str) -> DataFrame:
    """Information form with unit noise and prior I."""
    found = estimate.batch_lsq(table(spark, sf, "lineitem"), ["l_returnflag"], [F.lit(1.0), F.col("l_quantity") / 50], F.col("l_discount"), prior=(np.zeros(2), np.eye(2)))
    return found.select("l_returnflag", q(F.col("x")[0]).alias("x0"), q(F.col("x")[1]).alias("x1"))


register("batch_lsq", batch_lsq, f"WITH s AS (SELECT l_returnflag, count(*)+1::DOUBLE a, sum(l_quantity/50) b, sum(l_quantity/50*l_quantity/50)+1 d, sum(l_discount) u, sum(l_quantity/50*l_discount) w FROM lineitem GROUP BY 1) SELECT l_returnflag, {sq('(d*u-b*w)/(a*d-b*b)')} AS x0, {sq('(a*w-b*u)/(a*d-b*b)')} AS x1 FROM s")

# --- scans ---------------------------------------------------------------------------

BW = special.butterworth(2, 1000.0, 8000.0)[0]
ORDERED = "o AS (SELECT user_id AS series, event_id AS k, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events)"


def scanned(step: scan.Step, start: list[float]) -> Query:
    return lambda s, sf: scan.scan(signal(s, sf), step, start).select("series", "k", q(F.col("y")).alias("y"))




def cascade_sql(sections: list[design.Section]) -> str:
    """Sections in series, two states each, one step a sample."""
    parts = [[f"({x!r})::DOUBLE" for x in sec] for sec in sections]

    def columns(x: str, z: Callable[[int], str]) -> tuple[str, str]:
        states = []
        for k, (b0, b1, b2, a1, a2) in enumerate(parts):
            y = f"({b0}*{x}+{z(2 * k)})"
            states += [f"{b1}*{x}-{a1}*{y}+{z(2 * k + 1)}", f"{b2}*{x}-{a2}*{y}"]
            x = y
        return x, ", ".join(f"{v} AS z{k}" for k, v in enumerate(states))

    y0, s0 = columns("x", lambda k: "0::DOUBLE")
    y1, s1 = columns("o.x", lambda k: f"f.z{k}")
    return f"WITH RECURSIVE {ORDERED}, f AS (SELECT series, k, n, {y0} AS y, {s0} FROM o WHERE n=1 UNION ALL SELECT o.series, o.k, o.n, {y1}, {s1} FROM f JOIN o ON o.series=f.series AND o.n=f.n+1) SELECT series, k, {sq('y')} AS y FROM f"


def filtered(name: str, sections: list[design.Section]) -> None:
    register(name, scanned(scan.cascade_step(sections), [0.0] * (2 * len(sections))), cascade_sql(sections))
    register(f"{name}_split", lambda s, sf: scan.linear_scan(signal(s, sf), scan.cascade(sections), 7).select("series", "k", q(F.col("y")).alias("y")), cascade_sql(sections))


filtered("biquad", [BW])
filtered("biquad_cascade", special.butterworth(4, 1000.0, 8000.0))
filtered("chebyshev1_filter", design.chebyshev1(2, 1.0, 1000.0, 8000.0))
filtered("lead_filter", [design.lead(math.pi / 4, 10.0, 1.0, 1000.0)])
register("pid", scanned(scan.pid_step(0.5, 0.1, 0.05, 1.0, 50.0, -20.0, 20.0), [0.0] * 5),
         f"WITH RECURSIVE {ORDERED}, f AS (SELECT series, k, n, x, 0::DOUBLE AS i, 50-x AS e, 0::DOUBLE AS d, greatest(-20, least(20, 0.5::DOUBLE*(50-x))) AS y FROM o WHERE n=1 UNION ALL SELECT series, k, n, x, i+0.2::DOUBLE*(greatest(-20, least(20, u))-u), e, d, greatest(-20, least(20, u)) FROM (SELECT *, 0.5::DOUBLE*e+i+0.05::DOUBLE*d AS u FROM (SELECT o.series, o.k, o.n, o.x, f.i+0.1::DOUBLE*0.5*((50-o.x)+f.e) AS i, 50-o.x AS e, -(o.x-f.x) AS d FROM f JOIN o ON o.series=f.series AND o.n=f.n+1))) SELECT series, k, {sq('y')} AS y FROM f")
register("pid_filtered", scanned(scan.pid_step(0.4, 0.2, 0.3, 0.5, 40.0, -15.0, 15.0, tau=0.8, kb=0.6), [0.0] * 5),
         f"WITH RECURSIVE {ORDERED}, f AS (SELECT series, k, n, x, 0::DOUBLE AS i, 40-x AS e, 0::DOUBLE AS d, greatest(-15, least(15, 0.4::DOUBLE*(40-x))) AS y FROM o WHERE n=1 UNION ALL SELECT series, k, n, x, i+0.6::DOUBLE*(greatest(-15, least(15, u))-u)*0.5, e, d, greatest(-15, least(15, u)) FROM (SELECT *, 0.4::DOUBLE*e+i+0.3::DOUBLE*d AS u FROM (SELECT o.series, o.k, o.n, o.x, f.i+0.2::DOUBLE*0.5*((40-o.x)+f.e)*0.5 AS i, 40-o.x AS e, f.d+(0.5::DOUBLE/1.3::DOUBLE)*(-(o.x-f.x)/0.5::DOUBLE-f.d) AS d FROM f JOIN o ON o.series=f.series AND o.n=f.n+1))) SELECT series, k, {sq('y')} AS y FROM f")


def kf_sql(step: str, columns: str = "s, p", out: str = "s AS y", digits: int = 6, predicted: str = "f.p+0.1::DOUBLE", first: str = "10.1::DOUBLE") -> str:
    """Scalar filters from s = 50, p = 10: `step` gives the new columns from z, s and the predicted p."""
    return f"WITH RECURSIVE {ORDERED}, f AS (SELECT series, k, n, {step} FROM (SELECT series, k, n, x AS z, 50::DOUBLE AS s, {first} AS p FROM o WHERE n=1) UNION ALL SELECT series, k, n, {step} FROM (SELECT o.series, o.k, o.n, o.x AS z, f.s, {predicted} AS p FROM f JOIN o ON o.series=f.series AND o.n=f.n+1)) SELECT series, k, {sq(out.split(' AS ')[0], digits)} AS y FROM f"


PLAIN = "s+(p/(p+4))*(z-s) AS s, (1-p/(p+4))*p AS p"
register("kf_scalar", scanned(scan.kalman_step(1.0, 0.1, 1.0, 4.0), [50.0, 10.0]), kf_sql(PLAIN))
register("kf_gated", scanned(scan.kalman_step(1.0, 0.1, 1.0, 4.0, gate=9.0), [50.0, 10.0]), kf_sql("CASE WHEN (z-s)*(z-s)/(p+4)>9 THEN s ELSE s+(p/(p+4))*(z-s) END AS s, CASE WHEN (z-s)*(z-s)/(p+4)>9 THEN p ELSE (1-p/(p+4))*p END AS p"))
register("kf_fading", scanned(scan.kalman_step(1.0, 0.1, 1.0, 4.0, gamma=1.02), [50.0, 10.0]), kf_sql(PLAIN, predicted="1.02::DOUBLE*f.p+0.1::DOUBLE", first="1.02::DOUBLE*10+0.1::DOUBLE"))

SCALAR = dict(q=np.array([[0.1]]), r=np.array([[4.0]]), x0=np.array([50.0]), p0=np.array([[10.0]]))
same = lambda x: x
bent = lambda x: x + 0.002 * (x - 50.0) ** 2
one = lambda x: np.eye(1)
LEVEL = estimate.Model(same, same, **SCALAR, df=one, dh=one)
CURVED = estimate.Model(same, bent, **SCALAR, df=one, dh=lambda x: np.array([[1 + 0.004 * (x[0] - 50.0)]]))
DIFFERENCED = estimate.Model(same, bent, **SCALAR)


def tracked(model: estimate.Model, digits: int = 4, **options) -> Query:
    return lambda s, sf: estimate.track(signal(s, sf), model, estimate.Options(**options)).select("series", "k", q(F.col("state")[0], digits).alias("y"))


H_SQL = "({0}+0.002::DOUBLE*({0}-50)*({0}-50))"
EKF_SQL = "s+p*g/(g*g*p+4)*(z-" + H_SQL.format("s") + ") AS s, (1-p*g/(g*g*p+4)*g)*(1-p*g/(g*g*p+4)*g)*p+4*(p*g/(g*g*p+4))*(p*g/(g*g*p+4)) AS p"
EKF_SQL = EKF_SQL.replace("g", "(1+0.004::DOUBLE*(s-50))")
A_SQL, B_SQL = H_SQL.format("(s+sqrt(p))"), H_SQL.format("(s-sqrt(p))")


def sigma_sql(centre: str) -> str:
    """Two points at a standard deviation's distance, and the middle one with a covariance weight of `centre`."""
    mean = f"(0.5::DOUBLE*{A_SQL}+0.5::DOUBLE*{B_SQL})"
    v = f"({centre}*({H_SQL.format('s')}-{mean})*({H_SQL.format('s')}-{mean})+0.5::DOUBLE*({A_SQL}-{mean})*({A_SQL}-{mean})+0.5::DOUBLE*({B_SQL}-{mean})*({B_SQL}-{mean})+4)"
    c = f"(0.5::DOUBLE*sqrt(p)*({A_SQL}-{B_SQL}))"
    return f"s+{c}/{v}*(z-{mean}) AS s, p-{c}*{c}/{v} AS p"


register("ekf_fd", tracked(DIFFERENCED, 2), kf_sql(EKF_SQL, digits=2))
for name_, options_, sql_ in (("ekf", {}, EKF_SQL), ("ukf", {"kind": "unscented"}, sigma_sql("2")), ("srukf", {"kind": "square_root"}, sigma_sql("2")), ("ckf", {"kind": "cubature"}, sigma_sql("0"))):
    register(name_, tracked(CURVED, **options_), kf_sql(sql_, digits=4))
FLOOR_SQL = "s+(p/(p+4))*(z-s) AS s, greatest(1.5::DOUBLE, (1-p/(p+4))*p) AS p"
for name_, kind_ in (("kf_min_variance", "extended"), ("srukf_min_variance", "square_root")):
    register(name_, tracked(LEVEL, kind=kind_, min_variance=1.5), kf_sql(FLOOR_SQL, digits=4, predicted="greatest(1.5::DOUBLE, f.p+0.1::DOUBLE)"))
for name_, kind_ in (("ekf_gated", "extended"), ("ukf_gated", "unscented"), ("srukf_gated", "square_root"), ("ckf_gated", "cubature")):
    register(name_, tracked(LEVEL, kind=kind_, gate=9.0, gamma=1.02), kf_sql("CASE WHEN (z-s)*(z-s)/(p+4)>9 THEN s ELSE s+(p/(p+4))*(z-s) END AS s, CASE WHEN (z-s)*(z-s)/(p+4)>9 THEN p ELSE (1-p/(p+4))*p END AS p", digits=4, predicted="1.02::DOUBLE*f.p+0.1::DOUBLE", first="1.02::DOUBLE*10+0.1::DOUBLE"))
register("iekf", tracked(LEVEL, rounds=3), kf_sql(PLAIN, digits=4))
#: A position and its change, of which the position is seen.
DRIFT = estimate.Model(lambda x: np.array([x[0] + x[1], 0.9 * x[1]]), lambda x: x[:1], np.diag([0.1, 0.2]), np.array([[4.0]]), np.array([50.0, 0.0]), np.diag([10.0, 1.0]), df=lambda x: np.array([[1.0, 1.0], [0.0, 0.9]]), dh=lambda x: np.array([[1.0, 0.0]]))
DRIFT_P = "SELECT series, k, n, z, s+v AS s, 0.9::DOUBLE*v AS v, a+2*b+d+0.1::DOUBLE AS a, 0.9::DOUBLE*(b+d) AS b, 0.81::DOUBLE*d+0.2::DOUBLE AS d FROM ({})"
DRIFT_U = "SELECT series, k, n, s+a/(a+4)*(z-s) AS s, v+b/(a+4)*(z-s) AS v, a-a*a/(a+4) AS a, b-a*b/(a+4) AS b, d-b*b/(a+4) AS d FROM ({})"
DRIFT_SQL = f"WITH RECURSIVE {ORDERED}, f AS ({DRIFT_U.format(DRIFT_P.format('SELECT series, k, n, x AS z, 50::DOUBLE AS s, 0::DOUBLE AS v, 10::DOUBLE AS a, 0::DOUBLE AS b, 1::DOUBLE AS d FROM o WHERE n=1'))} UNION ALL {DRIFT_U.format(DRIFT_P.format('SELECT o.series, o.k, o.n, o.x AS z, f.s, f.v, f.a, f.b, f.d FROM f JOIN o ON o.series=f.series AND o.n=f.n+1'))})"
for kind_ in estimate.KINDS:
    register(f"kf_drift_{kind_}", lambda s, sf, kind=kind_: estimate.track(signal(s, sf), DRIFT, estimate.Options(kind)).select("series", "k", q(F.col("state")[0], 4).alias("y"), q(F.col("state")[1], 4).alias("v"), q(F.col("covariance")[1], 4).alias("b")), DRIFT_SQL + f" SELECT series, k, {sq('s', 4)} AS y, {sq('v', 4)} AS v, {sq('b', 4)} AS b FROM f")
RTS_SQL = kf_sql("s+(p/(p+4))*(z-s) AS s, (1-p/(p+4))*p AS p").split(" SELECT series, k, floor")[0] + ", m AS (SELECT series, max(n) AS last FROM f GROUP BY series), b AS (SELECT f.series, f.k, f.n, f.s, f.p FROM f JOIN m ON m.series=f.series AND m.last=f.n UNION ALL SELECT f.series, f.k, f.n, f.s+f.p/(f.p+0.1::DOUBLE)*(b.s-f.s), f.p+f.p/(f.p+0.1::DOUBLE)*(b.p-f.p-0.1::DOUBLE)*f.p/(f.p+0.1::DOUBLE) FROM b JOIN f ON f.series=b.series AND f.n=b.n-1)"
for name_, kind_ in (("rts_scalar", "extended"), ("rts_unscented", "unscented")):
    register(name_, lambda s, sf, kind=kind_: estimate.smooth(signal(s, sf), LEVEL, estimate.Options(kind)).select("series", "k", q(F.col("state")[0], 5).alias("y"), q(F.col("covariance")[0], 5).alias("p")), RTS_SQL + f" SELECT series, k, {sq('s', 5)} AS y, {sq('p', 5)} AS p FROM b")


def butterworth_design(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, *(math.floor(x * 1e6 + 0.5) / 1e6 for x in sec)) for k, sec in enumerate(special.butterworth(2, 1000.0, 8000.0))], "section int, b0 double, b1 double, b2 double, a1 double, a2 double")


register("butterworth_design", butterworth_design, f"WITH w AS (SELECT 16000*tan(pi()/8) AS w, 16000::DOUBLE AS c), d AS (SELECT *, c*c+sqrt(2)*w*c+w*w AS d FROM w) SELECT 0::INT AS section, {sq('w*w/d')} AS b0, {sq('2*w*w/d')} AS b1, {sq('w*w/d')} AS b2, {sq('(2*w*w-2*c*c)/d')} AS a1, {sq('(c*c-sqrt(2)*w*c+w*w)/d')} AS a2 FROM d")


def pid_tune(spark: SparkSession, sf: str) -> DataFrame:
    k, tau, delay = F.lit(2.0), F.col("p_retailprice") / 100, F.col("p_size") + 0.5
    return table(spark, sf, "part").select("p_partkey", *(q(c, 4).alias(n) for n, c in zip(("kp", "ki", "kd"), special.pid_ziegler_nichols(k, tau, delay), strict=True)))


register("pid_tune_zn", pid_tune, f"WITH t AS (SELECT p_partkey, p_retailprice/100 AS t, p_size+0.5::DOUBLE AS l FROM part) SELECT p_partkey, {sq('1.2::DOUBLE*t/(2*l)', 4)} AS kp, {sq('1.2::DOUBLE*t/(2*l)/(2*l)', 4)} AS ki, {sq('1.2::DOUBLE*t/(2*l)*l/2', 4)} AS kd FROM t")

def tuned(name: str, rule: Callable[..., list[Column]], sql: str) -> None:
    """Plants of gain 2 from parts; ti and td are given in SQL after kp."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        got = rule(F.lit(2.0), F.col("p_retailprice") / 100, F.col("p_size") + 0.5)
        return table(spark, sf, "part").select("p_partkey", *(q(c, 4).alias(n) for n, c in zip(("kp", "ki", "kd"), got, strict=True)))

    register(name, query, f"WITH t AS (SELECT p_partkey, p_retailprice/100 AS t, p_size+0.5::DOUBLE AS l FROM part), g AS (SELECT p_partkey, {sql} FROM t) SELECT p_partkey, {sq('kp', 4)} AS kp, {sq('kp/ti', 4)} AS ki, {sq('kp*td', 4)} AS kd FROM g")


tuned("pid_tune_cohen_coon", design.cohen_coon, "t/(2*l)*(4::DOUBLE/3+l/t/4) AS kp, l*(32+6*l/t)/(13+8*l/t) AS ti, 4*l/(11+2*l/t) AS td")
tuned("pid_tune_simc", lambda k, tau, delay: design.simc(k, tau, delay, delay), "t/(2*(l+l)) AS kp, least(t, 8*l) AS ti, l/2 AS td")
tuned("pid_tune_ultimate", lambda k, tau, delay: design.ultimate(tau, delay), "0.6::DOUBLE*t AS kp, l/2 AS ti, l/8 AS td")


def designed(name: str, found: list[design.Section], sql: str) -> None:
    """SQL: tables of w and c before, then the section's (b0, b1, b2, a1, a2) over d."""
    rows = [(k, *(math.floor(x * 1e6 + 0.5) / 1e6 for x in sec)) for k, sec in enumerate(found)]
    register(name, lambda spark, sf: spark.createDataFrame(rows, "section int, b0 double, b1 double, b2 double, a1 double, a2 double"), sql)


PAIR_SQL = f"SELECT 0::INT AS section, {sq('g/d')} AS b0, {sq('s*2*g/d')} AS b1, {sq('g/d')} AS b2, {sq('(2*w-2*c*c)/d')} AS a1, {sq('(c*c-a*c+w)/d')} AS a2 FROM (SELECT *, c*c+a*c+w AS d FROM p)"
ELLIPSE_SQL = "e AS (SELECT 16000*tan(pi()/8) AS v, 16000::DOUBLE AS c, sqrt(pow(10, 0.1::DOUBLE)-1) AS r), h AS (SELECT *, asinh(1/r)/2 AS h FROM e), u AS (SELECT v, c, 1/sqrt(1+r*r) AS k, sinh(h)/sqrt(2) AS x, cosh(h)/sqrt(2) AS y FROM h)"
designed("butterworth_highpass_design", design.butterworth_highpass(2, 1000.0, 8000.0), "WITH e AS (SELECT 16000*tan(pi()/8) AS v, 16000::DOUBLE AS c), p AS (SELECT c, v*v AS w, sqrt(2)*v AS a, c*c AS g, -1 AS s FROM e) " + PAIR_SQL)
designed("chebyshev1_lowpass_design", design.chebyshev1(2, 1.0, 1000.0, 8000.0), f"WITH {ELLIPSE_SQL}, p AS (SELECT c, v*v*(x*x+y*y) AS w, 2*v*x AS a, k*v*v*(x*x+y*y) AS g, 1 AS s FROM u) " + PAIR_SQL)
designed("chebyshev1_highpass_design", design.chebyshev1(2, 1.0, 1000.0, 8000.0, high=True), f"WITH {ELLIPSE_SQL}, p AS (SELECT c, v*v/(x*x+y*y) AS w, 2*v*x/(x*x+y*y) AS a, k*c*c AS g, -1 AS s FROM u) " + PAIR_SQL)
FIRST_SQL = f"SELECT 0::INT AS section, {sq('k*(c+z)/(c+p)')} AS b0, {sq('k*(z-c)/(c+p)')} AS b1, 0::DOUBLE AS b2, {sq('(p-c)/(c+p)')} AS a1, 0::DOUBLE AS a2 FROM t"
designed("lead_design", [design.lead(math.pi / 4, 10.0, 1.0, 1000.0)], "WITH m AS (SELECT (1-sin(pi()/4))/(1+sin(pi()/4)) AS m), t AS (SELECT 2000::DOUBLE AS c, 1/m AS k, 20*pi()*sqrt(m) AS z, 20*pi()/sqrt(m) AS p FROM m) " + FIRST_SQL)
designed("lag_design", [design.lag(10.0, 1.0, 1000.0)], "WITH t AS (SELECT 2000::DOUBLE AS c, 1::DOUBLE AS k, 2*pi() AS z, 0.2::DOUBLE*pi() AS p) " + FIRST_SQL)

# --- interpolation -------------------------------------------------------------------


def knots(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("double").alias("x")).agg(F.sum(F.floor("value")).cast("double").alias("y"))
    return e.withColumn("dy", F.col("x") / 2)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", (F.col("value") / 4).alias("x"))


KNOTS_SQL = "kn AS (SELECT day(ts)::DOUBLE AS x, sum(floor(value))::DOUBLE AS y, day(ts)/2::DOUBLE AS dy FROM events GROUP BY ALL), sg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(dy) OVER w AS d1, row_number() OVER w AS n, lead(x, 2) OVER w AS x2 FROM kn WINDOW w AS (ORDER BY x)), pt AS (SELECT event_id, value/4 AS t FROM events), j AS (SELECT * FROM pt JOIN sg ON sg.x1 IS NOT NULL AND (t>=x OR n=1) AND (t<x1 OR x2 IS NULL))"
register("interp_linear", lambda s, sf: interp.linear(points(s, sf), knots(s, sf)).select("event_id", q(F.col("y"), 4).alias("y"), q(F.col("slope"), 4).alias("slope")), f"WITH {KNOTS_SQL} SELECT event_id, {sq('y+(y1-y)/(x1-x)*(t-x)', 4)} AS y, {sq('(y1-y)/(x1-x)', 4)} AS slope FROM j")
register("interp_hermite", lambda s, sf: interp.hermite(points(s, sf), knots(s, sf)).select("event_id", q(F.col("y"), 3).alias("y"), q(F.col("slope"), 3).alias("slope")), f"WITH {KNOTS_SQL}, u AS (SELECT *, (t-x)/(x1-x) AS u, x1-x AS h FROM j) SELECT event_id, {sq('(1+2*u)*(1-u)*(1-u)*y+u*(1-u)*(1-u)*h*dy+u*u*(3-2*u)*y1+u*u*(u-1)*h*d1', 3)} AS y, {sq('6*u*(u-1)*(y-y1)/h+(1-u)*(1-3*u)*dy+u*(3*u-2)*d1', 3)} AS slope FROM u")
THOMAS_SQL = "kk AS (SELECT x, y, row_number() OVER (ORDER BY x) AS n, lead(x) OVER (ORDER BY x)-x AS h, x-lag(x) OVER (ORDER BY x) AS g, (lead(y) OVER (ORDER BY x)-y)/(lead(x) OVER (ORDER BY x)-x) AS d, (y-lag(y) OVER (ORDER BY x))/(x-lag(x) OVER (ORDER BY x)) AS e FROM kn), f AS (SELECT n, 0::DOUBLE AS c, 0::DOUBLE AS r FROM kk WHERE n=1 UNION ALL SELECT kk.n, kk.h/(2*(kk.g+kk.h)-kk.g*f.c), (6*(kk.d-kk.e)-kk.g*f.r)/(2*(kk.g+kk.h)-kk.g*f.c) FROM f JOIN kk ON kk.n=f.n+1 WHERE kk.h IS NOT NULL), b AS (SELECT max(n)+1 AS n, 0::DOUBLE AS m FROM f UNION ALL SELECT f.n, f.r-f.c*b.m FROM b JOIN f ON f.n=b.n-1 WHERE f.n>1), mm AS (SELECT kk.x, coalesce(b.m, 0::DOUBLE) AS m FROM kk LEFT JOIN b USING (n))"
register("interp_spline", lambda s, sf: interp.spline(points(s, sf), knots(s, sf)).select("event_id", q(F.col("y"), 3).alias("y"), q(F.col("slope"), 3).alias("slope")), f"WITH RECURSIVE {KNOTS_SQL}, {THOMAS_SQL}, u AS (SELECT event_id, t, j.x, j.x1, y, y1, p.m AS m0, z.m AS m1, j.x1-j.x AS h, j.x1-t AS a, t-j.x AS b FROM j JOIN mm p ON p.x=j.x JOIN mm z ON z.x=j.x1) SELECT event_id, {sq('(m0*a*a*a+m1*b*b*b)/(6*h)+(y/h-m0*h/6)*a+(y1/h-m1*h/6)*b', 3)} AS y, {sq('(m1*b*b-m0*a*a)/(2*h)+(y1-y)/h-(m1-m0)*h/6', 3)} AS slope FROM u")
LAG = [(0.0, 1.0), (1.0, 3.0), (3.0, -2.0), (6.0, 4.0)]
register("interp_lagrange", lambda s, sf: interp.lagrange(table(s, sf, "events").select("event_id", (F.col("value") / 4.1).alias("x")), s.createDataFrame(LAG, "x double, y double")).select("event_id", q(F.col("y"), 4).alias("y"), q(F.col("slope"), 4).alias("slope")),
         "WITH p AS (SELECT event_id, value/4.1::DOUBLE AS t FROM events) SELECT event_id, " + sq("+".join(f"({y}::DOUBLE)*" + "*".join(f"(t-{z})/({x - z}::DOUBLE)" for z, _ in LAG if z != x) for x, y in LAG), 4) + " AS y, " + sq("+".join(f"({y}::DOUBLE)*(" + "+".join("*".join(["1", *(f"(t-{z})" for z, _ in LAG if z not in (x, o))]) for o, _ in LAG if o != x) + ")/" + "*".join(f"({x - z}::DOUBLE)" for z, _ in LAG if z != x).join("()") for x, y in LAG), 4) + " AS slope FROM p")
register("interp_bilinear", lambda s, sf: table(s, sf, "part").select("p_partkey", q(interp.bilinear(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, [0.0, 20.0, 60.0], [0.0, 30.0], [[1.0, 2.0], [3.0, 5.0], [-1.0, 4.0]])).alias("z")),
         f"WITH p AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice/100/30 AS u FROM part), g AS (SELECT *, CASE WHEN a<20 THEN a/20 ELSE (a-20)/40 END AS t, CASE WHEN a<20 THEN 1 ELSE 3 END AS z00, CASE WHEN a<20 THEN 2 ELSE 5 END AS z01, CASE WHEN a<20 THEN 3 ELSE -1 END AS z10, CASE WHEN a<20 THEN 5 ELSE 4 END AS z11 FROM p) SELECT p_partkey, {sq('(1-t)*(1-u)*z00+t*(1-u)*z10+(1-t)*u*z01+t*u*z11')} AS z FROM g")

# --- images --------------------------------------------------------------------------

BORDERS = {"replicate": "greatest(0, least({n}-1, {x}))", "reflect": "least((({x})%(2*{n}-2)+2*{n}-2)%(2*{n}-2), 2*{n}-2-(({x})%(2*{n}-2)+2*{n}-2)%(2*{n}-2))", "zero": "{x}", "constant": "{x}", "truncate": "{x}"}


def near_sql(taps: image.Taps, border: str, source: str = "img", constant: float = 0.0) -> str:
    values = ", ".join(f"({k}, {dr}, {dc}, {w!r}::DOUBLE)" for k, (dr, dc, w) in enumerate(taps))
    sr, sc = BORDERS[border].format(x="i.r+t.dr", n=HEIGHT), BORDERS[border].format(x="i.c+t.dc", n=WIDTH)
    kind = "JOIN" if border == "truncate" else "LEFT JOIN"
    return f"SELECT i.img, i.r, i.c, t.k, t.w, coalesce(p.v, {constant}::DOUBLE) AS v FROM {source} i CROSS JOIN (VALUES {values}) t(k, dr, dc, w) {kind} {source} p ON p.img=i.img AND p.r={sr} AND p.c={sc}"


def picture(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None, ctes: str = "", digits: int = 4) -> None:
    register(name, lambda s, sf: f(images(s, sf)).select("img", "r", "c", q(F.col("v"), digits).alias("v")), f"WITH {IMG_SQL}{', ' + ctes if ctes else ''} SELECT img, r::INT AS r, c::INT AS c, {sq('v', digits)} AS v FROM ({sql})" if sql else None)


def conv_sql(kernel: list[list[float]], border: str, source: str = "img", constant: float = 0.0) -> str:
    return f"SELECT img, r, c, sum(w*v) AS v FROM ({near_sql(image.taps(kernel), border, source, constant)}) GROUP BY ALL"


def blur_ctes(sigma: float, source: str = "img", out: str = "bl", border: str = "replicate") -> str:
    k = image.gaussian_kernel(sigma)
    return f"{out}0 AS ({conv_sql([[x] for x in k], border, source)}), {out} AS ({conv_sql([k], border, out + '0')})"


H, W = HEIGHT, WIDTH
for border_ in ("zero", "constant", "replicate", "reflect"):
    picture(f"convolve2d_{border_}", lambda i, b=border_: image.convolve(i, image.SOBEL_X, H, W, b, 3.0 if b == "constant" else 0.0), conv_sql(image.SOBEL_X, border_, constant=3.0 if border_ == "constant" else 0.0))
picture("gaussian_blur", lambda i: image.gaussian_blur(i, 1.0, H, W), "SELECT * FROM bl", blur_ctes(1.0))
picture("box_blur", lambda i: image.convolve_separable(i, image.box_kernel(3), image.box_kernel(3), H, W), f"SELECT img, r, c, sum(v)/9 AS v FROM ({near_sql(image.square(1), 'replicate')}) GROUP BY ALL")
picture("convolve_separable", lambda i: image.convolve_separable(i, [1.0, 2.0, 1.0], [1.0, 0.0, -1.0], H, W, "reflect"), conv_sql([[1.0, 0.0, -1.0], [2.0, 0.0, -2.0], [1.0, 0.0, -1.0]], "reflect"))
picture("laplacian", lambda i: image.convolve(i, image.LAPLACIAN, H, W), conv_sql(image.LAPLACIAN, "replicate"))
picture("laplacian_of_gaussian", lambda i: image.convolve(image.gaussian_blur(i, 1.0, H, W), image.LAPLACIAN, H, W), conv_sql(image.LAPLACIAN, "replicate", "bl"), blur_ctes(1.0))
picture("unsharp", lambda i: i.join(image.gaussian_blur(i, 1.0, H, W).withColumnRenamed("v", "b"), ["img", "r", "c"]).select("img", "r", "c", (F.col("v") + 1.5 * (F.col("v") - F.col("b"))).alias("v")), "SELECT img, r, c, i.v+1.5::DOUBLE*(i.v-bl.v) AS v FROM img i JOIN bl USING (img, r, c)", blur_ctes(1.0))


def magnitude(kx: list[list[float]], ky: list[list[float]]) -> Callable[[DataFrame], DataFrame]:
    return lambda i: image.gradients(i, kx, ky, H, W).select("img", "r", "c", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("v"))


for name_, kx_, ky_ in (("sobel_magnitude", image.SOBEL_X, image.SOBEL_Y), ("scharr_magnitude", image.SCHARR_X, image.SCHARR_Y)):
    picture(name_, magnitude(kx_, ky_), "SELECT img, r, c, sqrt(x.v*x.v+y.v*y.v) AS v FROM gx x JOIN gy y USING (img, r, c)", f"gx AS ({conv_sql(kx_, 'replicate')}), gy AS ({conv_sql(ky_, 'replicate')})")
picture("integral_image", image.integral, "SELECT img, r, c, sum(s) OVER (PARTITION BY img, r ORDER BY c) AS v FROM (SELECT *, sum(v) OVER (PARTITION BY img, c ORDER BY r) AS s FROM img)")
picture("local_mean", lambda i: image.local_stats(i, 2, H, W).select("img", "r", "c", F.col("mean").alias("v")), f"SELECT img, r, c, avg(v) AS v FROM ({near_sql(image.square(2), 'truncate')}) GROUP BY ALL")
picture("local_variance", lambda i: image.local_stats(i, 2, H, W).select("img", "r", "c", F.col("variance").alias("v")), f"SELECT img, r, c, greatest(avg(v*v)-avg(v)*avg(v), 0) AS v FROM ({near_sql(image.square(2), 'truncate')}) GROUP BY ALL", digits=2)
picture("local_stddev", lambda i: image.local_stats(i, 2, H, W).select("img", "r", "c", F.sqrt("variance").alias("v")), f"SELECT img, r, c, sqrt(greatest(avg(v*v)-avg(v)*avg(v), 0)) AS v FROM ({near_sql(image.square(2), 'truncate')}) GROUP BY ALL", digits=3)
for name_, f_, k_, radius_, border_ in (("rank_filter", lambda i: image.rank(i, 1, 2, H, W), 3, 1, "replicate"), ("percentile_filter", lambda i: image.percentile(i, 1, 0.8, H, W, "reflect"), 7, 1, "reflect"), ("median_filter", lambda i: image.median(i, 1, H, W), 5, 1, "replicate")):
    picture(name_, f_, f"SELECT img, r, c, list_sort(list(v))[{k_}] AS v FROM ({near_sql(image.square(radius_), border_)}) GROUP BY ALL")


def morph_sql(fn: str, source: str, radius: int = 2) -> str:
    return f"SELECT img, r, c, {fn}(v) AS v FROM ({near_sql(image.square(radius), 'replicate', source)}) GROUP BY ALL"


DIL, ERO = f"dl AS ({morph_sql('max', 'img')})", f"er AS ({morph_sql('min', 'img')})"
OPEN, CLOSE = f"{ERO}, op AS ({morph_sql('max', 'er')})", f"{DIL}, cl AS ({morph_sql('min', 'dl')})"
picture("dilate", lambda i: image.dilate(i, 2, H, W), "SELECT * FROM dl", DIL)
picture("erode", lambda i: image.erode(i, 2, H, W), "SELECT * FROM er", ERO)
picture("opening", lambda i: image.opening(i, 2, H, W), "SELECT * FROM op", OPEN)
picture("closing", lambda i: image.closing(i, 2, H, W), "SELECT * FROM cl", CLOSE)
picture("morph_gradient", lambda i: image.minus(image.dilate(i, 2, H, W), image.erode(i, 2, H, W)), "SELECT img, r, c, a.v-b.v AS v FROM dl a JOIN er b USING (img, r, c)", f"{DIL}, {ERO}")
picture("top_hat", lambda i: image.minus(i, image.opening(i, 2, H, W)), "SELECT img, r, c, a.v-b.v AS v FROM img a JOIN op b USING (img, r, c)", OPEN)
picture("black_hat", lambda i: image.minus(image.closing(i, 2, H, W), i), "SELECT img, r, c, b.v-a.v AS v FROM img a JOIN cl b USING (img, r, c)", CLOSE)
picture("median_pool", lambda i: image.median_pool(i, 4), "SELECT img, r//4 AS r, c//4 AS c, list_sort(list(v))[count(*)//2+1] AS v FROM img GROUP BY ALL")
picture("threshold", lambda i: image.threshold(i, 50.0), "SELECT img, r, c, CASE WHEN v>50 THEN 1::DOUBLE ELSE 0 END AS v FROM img")
picture("adaptive_threshold", lambda i: i.join(image.local_stats(i, 2, H, W), ["img", "r", "c"]).select("img", "r", "c", F.when(F.col("v") > F.col("mean") + 5.3, 1.0).otherwise(0.0).alias("v")), "SELECT i.img, i.r, i.c, CASE WHEN i.v>m.v+5.3::DOUBLE THEN 1::DOUBLE ELSE 0 END AS v FROM img i JOIN mn m USING (img, r, c)", f"mn AS (SELECT img, r, c, avg(v) AS v FROM ({near_sql(image.square(2), 'truncate')}) GROUP BY ALL)")
picture("flip_h", lambda i: i.withColumn("c", W - 1 - F.col("c")), f"SELECT img, r, {W - 1}-c AS c, v FROM img")
picture("flip_v", lambda i: i.withColumn("r", H - 1 - F.col("r")), f"SELECT img, {H - 1}-r AS r, c, v FROM img")
picture("rot90", lambda i: i.select("img", F.col("c").alias("r"), (H - 1 - F.col("r")).alias("c"), "v"), f"SELECT img, c AS r, {H - 1}-r AS c, v FROM img")
picture("rot180", lambda i: i.select("img", (H - 1 - F.col("r")).alias("r"), (W - 1 - F.col("c")).alias("c"), "v"), f"SELECT img, {H - 1}-r AS r, {W - 1}-c AS c, v FROM img")
picture("rot270", lambda i: i.select("img", (W - 1 - F.col("c")).alias("r"), F.col("r").alias("c"), "v"), f"SELECT img, {W - 1}-c AS r, r AS c, v FROM img")
picture("crop", lambda i: image.crop(i, H, W, 5, 3, 10, 10), "SELECT img, r-5 AS r, c-3 AS c, v FROM img WHERE r BETWEEN 5 AND 14 AND c BETWEEN 3 AND 12")
picture("difference_of_gaussians", lambda i: image.minus(image.gaussian_blur(i, 1.0, H, W), image.gaussian_blur(i, 2.0, H, W)), "SELECT img, r, c, a.v-b.v AS v FROM ba a JOIN bb b USING (img, r, c)", blur_ctes(1.0, "img", "ba") + ", " + blur_ctes(2.0, "img", "bb"))
CORNERS = f"gx AS ({conv_sql(image.SOBEL_X, 'replicate')}), gy AS ({conv_sql(image.SOBEL_Y, 'replicate')}), p AS (SELECT img, r, c, x.v*x.v AS v FROM gx x), q AS (SELECT img, r, c, x.v*y.v AS v FROM gx x JOIN gy y USING (img, r, c)), s AS (SELECT img, r, c, y.v*y.v AS v FROM gy y), {blur_ctes(1.0, 'p', 'bp')}, {blur_ctes(1.0, 'q', 'bq')}, {blur_ctes(1.0, 's', 'bs')}, t AS (SELECT img, r, c, bp.v AS a, bq.v AS b, bs.v AS d FROM bp JOIN bq USING (img, r, c) JOIN bs USING (img, r, c))"
picture("harris", lambda i: image.harris(i, 1.0, 0.04, H, W).withColumn("v", F.col("v") / 1e6), "SELECT img, r, c, (a*d-b*b-0.04::DOUBLE*(a+d)*(a+d))/1e6 AS v FROM t", CORNERS, 3)
picture("shi_tomasi", lambda i: image.harris(i, 1.0, 0.0, H, W, True), "SELECT img, r, c, greatest(0.5::DOUBLE*(a+d-sqrt((a-d)*(a-d)+4*b*b)), 0) AS v FROM t", CORNERS, 3)
picture("resize_bilinear", lambda i: image.resize_bilinear(i, H, W, 15, 12),
        f"SELECT g.img, g.r, g.c, (1-fy)*(1-fx)*a.v+(1-fy)*fx*b.v+fy*(1-fx)*d.v+fy*fx*e.v AS v FROM g JOIN img a ON a.img=g.img AND a.r=y0 AND a.c=x0 JOIN img b ON b.img=g.img AND b.r=y0 AND b.c=least(x0+1,{W - 1}) JOIN img d ON d.img=g.img AND d.r=least(y0+1,{H - 1}) AND d.c=x0 JOIN img e ON e.img=g.img AND e.r=least(y0+1,{H - 1}) AND e.c=least(x0+1,{W - 1})",
        f"g0 AS (SELECT DISTINCT img, r.i::INT AS r, c.i::INT AS c, greatest(0, least({H - 1}, (r.i+0.5::DOUBLE)*({H}/15::DOUBLE)-0.5::DOUBLE)) AS y, greatest(0, least({W - 1}, (c.i+0.5::DOUBLE)*2-0.5::DOUBLE)) AS x FROM img, range(15) r(i), range(12) c(i)), g AS (SELECT *, floor(y)::INT AS y0, floor(x)::INT AS x0, y-floor(y) AS fy, x-floor(x) AS fx FROM g0)", 3)
OTSU_SQL = "sp AS (SELECT img, min(v) lo, max(v)-min(v) rg FROM img GROUP BY img), hi AS (SELECT img, lo, rg, floor((v-lo)/rg*255)::INT AS bin, count(*) n FROM img JOIN sp USING (img) GROUP BY ALL), fu AS (SELECT sp.img, sp.lo, sp.rg, b.i::INT AS bin, coalesce(h.n, 0) n FROM sp CROSS JOIN range(256) b(i) LEFT JOIN hi h ON h.img=sp.img AND h.bin=b.i), cu AS (SELECT *, (sum(n) OVER w)::DOUBLE w0, (sum(n) OVER z)::DOUBLE nn, (sum(n*bin) OVER w)::DOUBLE s0, (sum(n*bin) OVER z)::DOUBLE ss FROM fu WINDOW w AS (PARTITION BY img ORDER BY bin), z AS (PARTITION BY img)), be AS (SELECT *, CASE WHEN w0=0 OR nn=w0 THEN 0 ELSE w0*(nn-w0)*(s0/w0-(ss-s0)/(nn-w0))*(s0/w0-(ss-s0)/(nn-w0)) END AS g FROM cu)"
register("otsu", lambda s, sf: image.otsu(images(s, sf)).select("img", q(F.col("t")).alias("t")), f"WITH {IMG_SQL}, {OTSU_SQL} SELECT img, {sq('lo+(floor((min(bin)+max(bin))/2)+0.5::DOUBLE)/256*rg')} AS t FROM (SELECT *, max(g) OVER (PARTITION BY img) top FROM be) WHERE g=top GROUP BY img, lo, rg")


def segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """Blur, Otsu threshold, and area and centroid of the foreground of each image."""
    blurred = image.gaussian_blur(images(spark, sf), 1.0, H, W)
    t = image.otsu(images(spark, sf))
    mask = blurred.join(F.broadcast(t), "img").where(F.col("v") > F.col("t"))  # one row an image
    return mask.groupBy("img").agg(F.count("*").alias("area"), q(F.avg("r"), 4).alias("cy"), q(F.avg("c"), 4).alias("cx"))


register("segmentation", segmentation, f"WITH {IMG_SQL}, {OTSU_SQL}, {blur_ctes(1.0)}, th AS (SELECT img, lo+(floor((min(bin)+max(bin))/2)+0.5::DOUBLE)/256*rg AS t FROM (SELECT *, max(g) OVER (PARTITION BY img) top FROM be) WHERE g=top GROUP BY img, lo, rg) SELECT img, count(*) AS area, {sq('avg(r)', 4)} AS cy, {sq('avg(c)', 4)} AS cx FROM bl JOIN th USING (img) WHERE v>t GROUP BY img")

# --- scalar functions ----------------------------------------------------------------


def scalar(name: str, columns: Callable[[Column], dict[str, Column]], sql: dict[str, str] | None, digits: int = 6) -> None:
    """x = p_retailprice / 1000, for every part."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("x"), F.col("p_size").alias("k"))
        return p.select("p_partkey", *(q(c, digits).alias(k) for k, c in columns(F.col("x")).items()))

    register(name, query, "WITH p AS (SELECT p_partkey, p_retailprice/1000 AS x, p_size AS k FROM part) SELECT p_partkey, " + ", ".join(f"{sq(s, digits)} AS {k}" for k, s in sql.items()) + " FROM p" if sql else None)


def scalars(expr: Column | Callable[[Column], Column], sql: str, name: str, digits: int = 6) -> None:
    scalar(name, lambda x: {"y": expr(x)}, {"y": sql}, digits)


LN2PI = "0.9189385332046727::DOUBLE"
scalars(special.gamma, "gamma(x)", "gamma")
scalars(special.lgamma, "lgamma(x)", "lgamma")
scalars(lambda x: special.beta(x, F.lit(2.5)), "exp(lgamma(x)+lgamma(2.5::DOUBLE)-lgamma(x+2.5::DOUBLE))", "beta")
scalars(lambda x: special.lbeta(x, F.lit(2.5)), "lgamma(x)+lgamma(2.5::DOUBLE)-lgamma(x+2.5::DOUBLE)", "lbeta")
scalars(special.digamma, "(lgamma(x+1e-4)-lgamma(x-1e-4))/2e-4", "digamma", 4)
ERF_SERIES = "2/sqrt(pi())*list_sum(list_transform(range(60), lambda n: (CASE WHEN n%2=0 THEN 1 ELSE -1 END)*pow({x}, 2*n+1)/(gamma(n+1)*(2*n+1))))"
scalars(special.erf, ERF_SERIES.format(x="x"), "erf")
scalars(special.erfc, "1-" + ERF_SERIES.format(x="x"), "erfc")
scalars(lambda x: special.normal_cdf(x, 1.0, 2.0), "0.5::DOUBLE*(1+" + ERF_SERIES.format(x="((x-1)/(2*sqrt(2)))") + ")", "normal_cdf")
scalars(lambda x: special.normal_pdf(x, 1.0, 2.0), f"exp(-(x-1)*(x-1)/8-{LN2PI})/2", "normal_pdf")
scalars(lambda x: special.gamma_p(F.lit(2.0), x), "1-exp(-x)*(1+x)", "gamma_inc")
scalars(lambda x: special.betainc(F.lit(2.0), F.lit(3.0), x / 3), "6*pow(x/3,2)-8*pow(x/3,3)+3*pow(x/3,4)", "betainc")
scalars(lambda x: special.uniform_cdf(x, 0.5, 1.5), "CASE WHEN x<0.5 THEN 0 WHEN x>1.5 THEN 1 ELSE (x-0.5::DOUBLE)/1 END", "uniform_cdf")
scalars(lambda x: special.exponential_cdf(x, 1.5), "1-exp(-1.5::DOUBLE*x)", "exponential_cdf")
scalars(lambda x: special.gamma_pdf(x, 2.5, 1.5), "exp(2.5::DOUBLE*ln(1.5::DOUBLE)+1.5::DOUBLE*ln(x)-1.5::DOUBLE*x-lgamma(2.5::DOUBLE))", "gamma_pdf")
scalars(lambda x: special.beta_pdf(x / 3.14159, 2.0, 3.0), "12*(x/3.14159::DOUBLE)*pow(1-x/3.14159::DOUBLE,2)", "beta_pdf")
scalars(lambda x: special.chi_squared_pdf(x, 3.0), "exp(0.5::DOUBLE*ln(x)-x/2-1.5::DOUBLE*ln(2)-lgamma(1.5::DOUBLE))", "chi2_pdf")
scalars(lambda x: special.student_t_pdf(x, 5.0), "exp(lgamma(3::DOUBLE)-lgamma(2.5::DOUBLE)-0.5::DOUBLE*ln(5*pi())-3*ln(1+x*x/5))", "student_t_pdf")
scalars(lambda x: special.binomial_pmf(F.col("k"), 60, 0.3), "exp(lgamma(61::DOUBLE)-lgamma(k+1::DOUBLE)-lgamma(61::DOUBLE-k)+k*ln(0.3::DOUBLE)+(60-k)*ln(0.7::DOUBLE))", "binomial_pmf")
scalars(lambda x: special.poisson_pmf(F.col("k"), 7.5), "exp(k*ln(7.5::DOUBLE)-7.5::DOUBLE-lgamma(k+1::DOUBLE))", "poisson_pmf")
scalars(lambda x: special.gamma_cdf(x, 2.0, 1.5), "1-exp(-1.5::DOUBLE*x)*(1+1.5::DOUBLE*x)", "gamma_cdf")
scalars(lambda x: special.beta_cdf(x / 3, 2.0, 3.0), "6*pow(x/3,2)-8*pow(x/3,3)+3*pow(x/3,4)", "beta_cdf")
scalars(lambda x: special.chi_squared_cdf(x, 4.0), "1-exp(-x/2)*(1+x/2)", "chi2_cdf")
scalars(lambda x: special.student_t_cdf(x - 1.5, 2.0), "0.5::DOUBLE+(x-1.5::DOUBLE)/(2*sqrt(2+(x-1.5::DOUBLE)*(x-1.5::DOUBLE)))", "student_t_cdf")
scalars(lambda x: special.binomial_cdf(F.col("k"), 60, 0.3), "list_sum(list_transform(range(k+1), lambda i: exp(lgamma(61::DOUBLE)-lgamma(i+1::DOUBLE)-lgamma(61::DOUBLE-i)+i*ln(0.3::DOUBLE)+(60-i)*ln(0.7::DOUBLE))))", "binomial_cdf")
scalars(lambda x: special.poisson_cdf(F.col("k"), 7.5), "list_sum(list_transform(range(k+1), lambda i: exp(i*ln(7.5::DOUBLE)-7.5::DOUBLE-lgamma(i+1::DOUBLE))))", "poisson_cdf")
scalars(lambda x: special.gamma_quantile(x / 3, 1.0, 1.5), "-ln(1-x/3)/1.5::DOUBLE", "gamma_quantile")
scalars(lambda x: special.beta_quantile(x / 3, 2.0, 1.0), "sqrt(x/3)", "beta_quantile")
scalars(lambda x: special.chi_squared_quantile(x / 3, 2.0), "-2*ln(1-x/3)", "chi2_quantile")
scalars(lambda x: special.student_t_quantile(x / 3, 2.0), "(2*x/3-1)*sqrt(2/(4*x/3*(1-x/3)))", "student_t_quantile")
scalars(lambda x: special.uniform_quantile(x / 3, 0.5, 1.5), "0.5::DOUBLE+x/3", "uniform_quantile")
scalars(lambda x: special.exponential_quantile(x / 3, 1.5), "-ln(1-x/3)/1.5::DOUBLE", "exponential_quantile")
scalars(lambda x: special.bernoulli_pmf(F.col("k") % 3, 0.3), "CASE k%3 WHEN 1 THEN 0.3::DOUBLE WHEN 0 THEN 0.7::DOUBLE ELSE 0 END", "bernoulli_pmf")


def horner_sql(cs: tuple[float, ...], x: str) -> str:
    out = f"({cs[0]!r})::DOUBLE"
    for c in cs[1:]:
        out = f"({out}*{x}+({c!r})::DOUBLE)"
    return out


U_SQL = "(l_discount*5+0.25::DOUBLE)"
register("normal_quantile", lambda s, sf: table(s, sf, "part").select("p_partkey", q(special.normal_quantile((F.col("p_size") + 0.5) / 60)).alias("y")),
         "WITH p AS (SELECT p_partkey, (p_size+0.5::DOUBLE)/60 AS p FROM part), r AS (SELECT *, p-0.5::DOUBLE AS q, (p-0.5::DOUBLE)*(p-0.5::DOUBLE) AS r, sqrt(-2*ln(p)) AS lo FROM p) SELECT p_partkey, " + sq(f"CASE WHEN p<{special.ACKLAM_LOW} THEN {horner_sql(special.ACKLAM_C, 'lo')}/({horner_sql(special.ACKLAM_D, 'lo')}*lo+1) ELSE {horner_sql(special.ACKLAM_A, 'r')}*q/({horner_sql(special.ACKLAM_B, 'r')}*r+1) END") + " AS y FROM r")
scalars(lambda x: numeric.gauss_legendre(lambda t: t * t * t - t, F.lit(0.0), x, 5), "x*x*x*x/4-x*x/2", "gauss_legendre")
scalars(lambda x: numeric.trapezoid(lambda t: t * t, F.lit(0.0), x, 8), "x*x*x/3+x*x*x/6/64", "trapezoid")
scalars(lambda x: numeric.simpson(lambda t: t * t * t, F.lit(0.0), x, 8), "x*x*x*x/4", "simpson")


def newton_sqrt(x: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), x, lambda y, _: numeric.newton(y * y - x, lambda t: 2 * t, y))


scalars(newton_sqrt, "sqrt(x)", "newton_sqrt")


def vectorised(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    return run


scalars(vectorised(lambda x: numeric.brent(lambda t: t**3 - x, np.zeros_like(x), np.full_like(x, 10.0))), "pow(x, 1/3::DOUBLE)", "brent")
scalars(vectorised(lambda x: numeric.adaptive_simpson(np.exp, np.zeros_like(x), x, 1e-10)), "exp(x)-1", "adaptive_simpson")
scalars(vectorised(lambda x: ode.solve_many(lambda t, y: -y, 0.0, 1.0, x[:, None]).y[:, 0]), "x*exp(-1::DOUBLE)", "ode_rkf45")
target = lambda x: np.stack([x, -x], axis=1)
scalars(vectorised(lambda x: numeric.bfgs(lambda i, y: ((y - target(x[i])) ** 2).sum(axis=1), lambda i, y: 2 * (y - target(x[i])), np.zeros((len(x), 2))).x[:, 0]), "x", "bfgs")
# (1 - u)^2 + 5 (v - u^2)^2 + (w - x)^2: a bent valley whose floor is at (1, 1, x)
valley = lambda x, i, y: (1 - y[:, 0]) ** 2 + 5 * (y[:, 1] - y[:, 0] ** 2) ** 2 + (y[:, 2] - x[i]) ** 2
off = lambda f: lambda x: vectorised(f)(x * 0.975318642)  # noqa: E731  points without decimal ties
scalars(off(lambda x: numeric.bfgs(lambda i, y: valley(x, i, y), None, np.full((len(x), 3), -0.5), 1e-6).x.sum(axis=1)), "x*0.975318642::DOUBLE+2", "bfgs_valley", 3)
# x^3, sin(2 x): forward differences against the derivatives
scalars(off(lambda x: numeric.jacobian(lambda z: np.stack([z[:, 0] ** 3 + np.sin(2 * z[:, 1]), z[:, 0] * z[:, 1]], axis=1), np.stack([x, x / 2], axis=1)) @ np.array([1.0, 10.0]) @ np.array([1.0, 100.0])), "3*z*z+20*cos(z)+100*(z/2)+1000*z".replace("z", "(x*0.975318642::DOUBLE)"), "finite_difference_jacobian", 3)
scalars(off(lambda x: numeric.gradient(lambda z: z[:, 0] ** 3 + z[:, 1] * z[:, 0], np.stack([x, 2 * x], axis=1)).sum(axis=1)), "3*z*z+3*z".replace("z", "(x*0.975318642::DOUBLE)"), "finite_difference_gradient", 3)
scalars(vectorised(lambda x: ode.rk4(lambda t, y: -0.5 * y, 0.0, 1.03, x[:, None], 0.1)[:, 0]), "x*pow(1-0.05::DOUBLE+0.00125::DOUBLE-0.05::DOUBLE*0.05*0.05/6+pow(0.05::DOUBLE,4)/24, 10)*(1-0.015::DOUBLE+0.015::DOUBLE*0.015/2-0.015::DOUBLE*0.015*0.015/6+pow(0.015::DOUBLE,4)/24)", "rk4_cut")
for method_ in ("order65", "order87", "order98"):
    # y'' = -y from (x, 0), and backwards
    scalars(vectorised(lambda x, m=method_: ode.solve_many(lambda t, y: np.stack([y[:, 1], -y[:, 0]], axis=1), 0.0, 2.0, np.stack([x, 0 * x], axis=1), m, 1e-11, 1e-11).y[:, 0]), "x*cos(2::DOUBLE)", f"ode_{method_}")
    scalars(vectorised(lambda x, m=method_: ode.solve_many(lambda t, y: np.stack([y[:, 1], -y[:, 0]], axis=1), 2.0, 0.0, np.stack([x, 0 * x], axis=1), m, 1e-11, 1e-11).y[:, 1]), "x*sin(2::DOUBLE)", f"ode_{method_}_backwards")
for method_ in ("rkf45", "tsit54", "order87"):
    scalars(vectorised(lambda x, m=method_: ode.solve_many(lambda t, y: y * np.cos(t)[:, None], 0.0, 3.0, x[:, None], m, 1e-11, 1e-11, dense=True).at(np.where(x > 1.5, 1.234, 2.5))[:, 0]), "x*exp(sin(CASE WHEN x>1.5 THEN 1.234::DOUBLE ELSE 2.5::DOUBLE END))", f"ode_dense_{method_}", 5)
scalars(lambda x: scan.rk4_linear(x, -0.5, 0.1, 20), "x*pow(1-0.05::DOUBLE+0.00125::DOUBLE-0.05::DOUBLE*0.05*0.05/6+pow(0.05::DOUBLE,4)/24, 20)", "rk4_decay")


def line_fit(damping: float) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        d = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("t"), F.col("l_discount").alias("y"))
        x, cost = numeric.levenberg_marquardt(d, lambda p: p[0] + p[1] * F.col("t") - F.col("y"), lambda p: [F.lit(1.0), F.col("t")], [0.0, 0.0], damping, tol=1e-14)
        return spark.createDataFrame([tuple(math.floor(v * 1e5 + 0.5) / 1e5 for v in x)], "x0 double, x1 double")

    return query


LINE_SQL = f"SELECT {sq('regr_intercept(l_discount, l_quantity/50)', 5)} AS x0, {sq('regr_slope(l_discount, l_quantity/50)', 5)} AS x1 FROM lineitem"
register("gauss_newton", line_fit(0.0), LINE_SQL)
register("levenberg_marquardt", line_fit(1e-3), LINE_SQL)

# --- quaternions ---------------------------------------------------------------------

Q_SQL = "r AS (SELECT vec_id, embedding[1]::DOUBLE a, embedding[2]::DOUBLE b, embedding[3]::DOUBLE c, embedding[4]::DOUBLE d, embedding[5]::DOUBLE x, embedding[6]::DOUBLE y, embedding[7]::DOUBLE z FROM embeddings), n AS (SELECT *, sqrt(a*a+b*b+c*c+d*d) AS n FROM r), u AS (SELECT vec_id, a/n AS w, b/n AS i, c/n AS j, d/n AS k, x, y, z FROM n)"


def rotations(name: str, f: Callable[[Column, list[Column]], dict[str, Column]], sql: dict[str, str]) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        e = [F.col("a")[k] for k in range(7)]
        out = vectors(spark, sf).withColumn("q", special.quat_normalize(special.quaternion(*e[:4])))
        return out.select("vec_id", *(q(c).alias(k) for k, c in f(F.col("q"), e[4:]).items()))

    register(name, query, f"WITH {Q_SQL} SELECT vec_id, " + ", ".join(f"{sq(s)} AS {k}" for k, s in sql.items()) + " FROM u")


wxyz = lambda p: {c: p[c] for c in "wxyz"}
rotations("quat_normalize", lambda p, v: wxyz(p), {"w": "w", "x": "i", "y": "j", "z": "k"})
rotations("quat_inverse", lambda p, v: wxyz(special.quat_inverse(p)), {"w": "w", "x": "-i", "y": "-j", "z": "-k"})
rotations("quat_mul", lambda p, v: wxyz(special.quat_mul(p, special.quaternion(p["x"], p["w"], p["z"], p["y"]))), {"w": "w*i-i*w-j*k-k*j", "x": "w*w+i*i+j*j-k*k", "y": "w*k-i*j+j*i+k*w", "z": "w*j+i*k-j*w+k*i"})
rotations("quat_rotate", lambda p, v: dict(zip("xyz", special.quat_rotate(p, v), strict=True)), {"x": "(1-2*(j*j+k*k))*x+2*(i*j-w*k)*y+2*(i*k+w*j)*z", "y": "2*(i*j+w*k)*x+(1-2*(i*i+k*k))*y+2*(j*k-w*i)*z", "z": "2*(i*k-w*j)*x+2*(j*k+w*i)*y+(1-2*(i*i+j*j))*z"})
rotations("quat_to_matrix", lambda p, v: {f"m{r}{c}": x for r, row in enumerate(special.quat_to_matrix(p)) for c, x in enumerate(row)}, {"m00": "1-2*(j*j+k*k)", "m01": "2*(i*j-w*k)", "m02": "2*(i*k+w*j)", "m10": "2*(i*j+w*k)", "m11": "1-2*(i*i+k*k)", "m12": "2*(j*k-w*i)", "m20": "2*(i*k-w*j)", "m21": "2*(j*k+w*i)", "m22": "1-2*(i*i+j*j)"})
rotations("quat_from_axis_angle", lambda p, v: wxyz(special.quat_from_axis_angle(v, p["w"])), {"w": "cos(w/2)", "x": "x*sin(w/2)/sqrt(x*x+y*y+z*z)", "y": "y*sin(w/2)/sqrt(x*x+y*y+z*z)", "z": "z*sin(w/2)/sqrt(x*x+y*y+z*z)"})
rotations("quat_to_euler", lambda p, v: dict(zip(("roll", "pitch", "yaw"), special.quat_to_euler(p), strict=True)), {"roll": "atan2(2*(w*i+j*k), 1-2*(i*i+j*j))", "pitch": "asin(greatest(-1, least(1, 2*(w*j-k*i))))", "yaw": "atan2(2*(w*k+i*j), 1-2*(j*j+k*k))"})
rotations("quat_slerp", lambda p, v: wxyz(special.quat_slerp(p, special.quaternion(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), 0.3)), {"w": "(sin(0.7::DOUBLE*acos(abs(w)))*w+sin(0.3::DOUBLE*acos(abs(w)))*sign(w))/sin(acos(abs(w)))", "x": "sin(0.7::DOUBLE*acos(abs(w)))*i/sin(acos(abs(w)))", "y": "sin(0.7::DOUBLE*acos(abs(w)))*j/sin(acos(abs(w)))", "z": "sin(0.7::DOUBLE*acos(abs(w)))*k/sin(acos(abs(w)))"})
register("matrix_json", lambda s, sf: vectors(s, sf).select("vec_id", F.posexplode(from_json(to_json(F.slice("a", 1, 6), 2, 3))).alias("pos", "v")).select("vec_id", "pos", q(F.col("v")).alias("v")), f"WITH {V_SQL} SELECT vec_id, pos, {sq('a')} AS v FROM v WHERE pos<6")
register("vec_order", lambda s, sf: vectors(s, sf).select("vec_id", (F.slice("a", 1, 3) < F.slice("a", 4, 3)).alias("less")), f"WITH {S_SQL} SELECT vec_id, e0<e3 OR (e0=e3 AND (e1<e4 OR (e1=e4 AND e2<e5))) AS less FROM s")
scalars(vectorised(lambda x: ode.solve_many(lambda t, y: -y, 0.0, 1.0, x[:, None], "tsit54").y[:, 0]), "x*exp(-1::DOUBLE)", "ode_tsit54")
scalars(vectorised(lambda x: ode.solve_stiff_many(lambda t, y: -50 * (y - np.cos(t)[:, None]), 0.0, 0.5, x[:, None]).y[:, 0]), "(2500*cos(0.5::DOUBLE)+50*sin(0.5::DOUBLE))/2501+(x-2500::DOUBLE/2501)*exp(-25::DOUBLE)", "ode_rodas4")


# --- random streams ------------------------------------------------------------------

def sampled(kind: str, *parameters: float) -> None:
    """16 draws of a stream for each part, seeded by its key."""
    register(f"sample_{kind}", lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.posexplode(rng.sample(F.col("p_partkey"), 16, kind, *parameters)).alias("n", "x")).select("p_partkey", "n", q(F.col("x")).alias("x")))


for kind_, parameters_ in {"uniform": (0.5, 1.5), "exponential": (1.5,), "normal": (1.0, 2.0), "gamma": (2.5, 1.5), "chi_squared": (3.0,), "beta": (2.0, 3.0), "student_t": (5.0,), "bernoulli": (0.3,), "binomial": (60, 0.3), "poisson": (7.5,)}.items():
    sampled(kind_, *parameters_)
from numfold.plans import linear, more, pictures  # noqa: E402,F401  they register their queries
