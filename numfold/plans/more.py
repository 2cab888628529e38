"""Queries of distributions, random streams, quaternions, special functions and JSON forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numfold.functions import distributions as dist
from numfold.functions import special
from numfold.operators import numeric
from numfold.plans.catalog import rotations, scalars, wxyz
from numfold.plans.registry import ORACLES, V_SQL, q, register, sq
from numfold.sources import tables
from numfold.sources.tables import table, vector_from_json, vector_to_json, vectors

# --- special functions below zero, upper forms --------------------------------------------

scalars(lambda x: special.gamma(-x - 0.3), "pi()/(sin(pi()*(-x-0.3::DOUBLE))*gamma(1.3::DOUBLE+x))", "gamma_negative")
scalars(lambda x: special.gamma(x / 5), "gamma(x/5)", "gamma_small", 5)
scalars(lambda x: special.gamma((F.col("k") % 20 + 1).cast("double")) / 1e12, "gamma(k%20+1::DOUBLE)/1e12", "gamma_factorial")
scalars(lambda x: special.lgamma(-x - 0.3), "ln(pi())-ln(abs(sin(pi()*(-x-0.3::DOUBLE))))-lgamma(1.3::DOUBLE+x)", "lgamma_negative")
scalars(lambda x: special.lgamma(x * 1e7) / 1e7, "lgamma(x*1e7)/1e7", "lgamma_large")
scalars(lambda x: special.digamma(-x - 0.3), "(lgamma(1.3::DOUBLE+x+1e-4)-lgamma(1.3::DOUBLE+x-1e-4))/2e-4-pi()/tan(pi()*(-x-0.3::DOUBLE))", "digamma_negative", 4)
scalars(lambda x: special.gamma_q(F.lit(2.0), x), "exp(-x)*(1+x)", "gamma_inc_upper")
scalars(lambda x: special.gamma_q(F.lit(2.0), x * 20) * 1e9, "exp(-20*x)*(1+20*x)*1e9", "gamma_inc_upper_tail", 4)


def poles(spark: SparkSession, sf: str) -> DataFrame:
    """Poles and arguments outside the domain."""
    x = -(F.col("p_size") % 4).cast("double")
    return table(spark, sf, "part").select("p_partkey", (special.gamma(x) == math.inf).alias("gamma"), (special.lgamma(x) == math.inf).alias("lgamma"), F.isnan(special.digamma(x)).alias("digamma"), special.gamma_p(F.lit(-1.0), F.abs(x)).isNull().alias("p_domain"), special.betainc(F.lit(1.0), F.lit(2.0), F.abs(x) + 2).isNull().alias("b_domain"))


register("special_poles", poles, "SELECT p_partkey, true AS gamma, true AS lgamma, true AS digamma, true AS p_domain, true AS b_domain FROM part")

# --- distributions -------------------------------------------------------------------------

LN2PI = "0.9189385332046727::DOUBLE"
U_SQL = "((p_size+0.5::DOUBLE)/60)"
#: name: (distribution, log density at x in SQL, mean, variance)
CONTINUOUS = {
    "normal": (dist.Normal(1.0, 2.0), f"-(x-1)*(x-1)/8-{LN2PI}-ln(2::DOUBLE)", "1", "4"),
    "uniform": (dist.Uniform(0.5, 1.5), "CASE WHEN x BETWEEN 0.5 AND 1.5 THEN 0::DOUBLE END", "1", "1/12::DOUBLE"),
    "exponential": (dist.Exponential(1.5), "ln(1.5::DOUBLE)-1.5::DOUBLE*x", "1/1.5::DOUBLE", "1/2.25::DOUBLE"),
    "gamma": (dist.Gamma(2.5, 1.5), "2.5::DOUBLE*ln(1.5::DOUBLE)+1.5::DOUBLE*ln(x)-1.5::DOUBLE*x-lgamma(2.5::DOUBLE)", "2.5::DOUBLE/1.5", "2.5::DOUBLE/2.25"),
    "chi_squared": (dist.ChiSquared(3.0), "0.5::DOUBLE*ln(x)-x/2-1.5::DOUBLE*ln(2::DOUBLE)-lgamma(1.5::DOUBLE)", "3", "6"),
    "beta": (dist.Beta(2.0, 3.5), "CASE WHEN x<1 THEN ln(x)+2.5::DOUBLE*ln(1-x)-lgamma(2::DOUBLE)-lgamma(3.5::DOUBLE)+lgamma(5.5::DOUBLE) END", "2/5.5::DOUBLE", "7/(5.5::DOUBLE*5.5::DOUBLE*6.5::DOUBLE)"),
    "student_t": (dist.StudentT(5.0), "lgamma(3::DOUBLE)-lgamma(2.5::DOUBLE)-0.5::DOUBLE*ln(5*pi())-3*ln(1+x*x/5)", "0", "5/3::DOUBLE"),
}


def continuous(name: str, d: dist.Continuous, ln: str, mean: str, variance: str) -> None:
    """ln_pdf (null outside the support), pdf, cdf of the quantile, mean and variance."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        x, p = F.col("p_retailprice") / 1000 - (0.5 if name == "beta" else 0.0), (F.col("p_size") + 0.5) / 60
        ln_pdf = d.ln_pdf(x)
        return table(spark, sf, "part").select("p_partkey", F.when(ln_pdf > -math.inf, q(ln_pdf)).alias("ln_pdf"), q(d.pdf(x)).alias("pdf"), q(d.cdf(d.quantile(p))).alias("back"), q(F.lit(d.mean())).alias("mean"), q(F.lit(d.variance())).alias("variance"))

    shift = "-0.5::DOUBLE" if name == "beta" else ""
    register(f"dist_{name}", query, f"WITH p AS (SELECT p_partkey, p_size, p_retailprice/1000{shift} AS x FROM part), l AS (SELECT *, {ln} AS l FROM p) SELECT p_partkey, {sq('l')} AS ln_pdf, {sq('coalesce(exp(l), 0)')} AS pdf, {sq(U_SQL)} AS back, {sq(f'({mean})::DOUBLE')} AS mean, {sq(f'({variance})::DOUBLE')} AS variance FROM l")


for name_, spec_ in CONTINUOUS.items():
    continuous(name_, *spec_)
DISCRETE = {
    "bernoulli": (dist.Bernoulli(0.3), 2, "CASE i WHEN 0 THEN ln(0.7::DOUBLE) ELSE ln(0.3::DOUBLE) END", "0.3", "0.21"),
    "binomial": (dist.Binomial(40, 0.3), 41, "lgamma(41::DOUBLE)-lgamma(i+1::DOUBLE)-lgamma(41::DOUBLE-i)+i*ln(0.3::DOUBLE)+(40-i)*ln(0.7::DOUBLE)", "12", "8.4"),
    "poisson": (dist.Poisson(7.5), 60, "i*ln(7.5::DOUBLE)-7.5::DOUBLE-lgamma(i+1::DOUBLE)", "7.5", "7.5"),
}


def discrete(name: str, d: dist.Discrete, n: int, ln: str, mean: str, variance: str) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        k, p = F.col("p_size") % n, (F.col("p_size") + 0.5) / 60
        return table(spark, sf, "part").select("p_partkey", q(d.ln_pmf(k)).alias("ln_pmf"), q(d.pmf(k)).alias("pmf"), q(d.cdf(k)).alias("cdf"), d.quantile(p).alias("quantile"), q(F.lit(d.mean())).alias("mean"), q(F.lit(d.variance())).alias("variance"))

    cumulated = f"t AS (SELECT i::INT AS i, l, exp(l) AS m, sum(exp(l)) OVER (ORDER BY i) AS c FROM (SELECT i, {ln} AS l FROM range({n}) r(i)))"
    register(f"dist_{name}", query, f"WITH {cumulated}, z AS (SELECT p_partkey, p_size%{n} AS k, (SELECT min(i) FROM t WHERE c>={U_SQL}) AS z FROM part) SELECT p_partkey, {sq('l')} AS ln_pmf, {sq('m')} AS pmf, {sq('c')} AS cdf, z::BIGINT AS quantile, {sq(f'{mean}::DOUBLE')} AS mean, {sq(f'{variance}::DOUBLE')} AS variance FROM z JOIN t ON t.i=z.k")


for name_, spec_ in DISCRETE.items():
    discrete(name_, *spec_)

# --- random streams: the generator in whole numbers, then each draw by its definition -------

M = "18446744073709551616::UHUGEINT"
DRAWN = 200


def wrap(x: str) -> str:
    return f"(({x})%{M})"


def turn(x: str, k: int) -> str:
    return f"({wrap(f'{x}*{2**k}::UHUGEINT')}+({x})//{2 ** (64 - k)}::UHUGEINT)"


SEED_SQL = (
    f"i0 AS (SELECT p_partkey, j.j, {wrap('p_partkey::UHUGEINT+(j.j+1)::UHUGEINT*11400714819323198485::UHUGEINT')} AS z FROM part, range(4) j(j)), "
    f"i1 AS (SELECT p_partkey, j, {wrap('xor(z, z//1073741824::UHUGEINT)*13787848793156543929::UHUGEINT')} AS z FROM i0), "
    f"i2 AS (SELECT p_partkey, j, {wrap('xor(z, z//134217728::UHUGEINT)*10723151780598845931::UHUGEINT')} AS z FROM i1), "
    "i3 AS (SELECT p_partkey, j, xor(z, z//2147483648::UHUGEINT) AS z FROM i2), "
    "st AS (SELECT p_partkey, " + ", ".join(f"max(CASE WHEN j={k} THEN z END) AS {c}" for k, c in enumerate("abcd")) + " FROM i3 GROUP BY p_partkey), "
)
SUM_SQL = wrap("a+d")
STREAM_SQL = SEED_SQL + (
    "g AS (SELECT p_partkey, 0 AS n, a, b, c, d, 0::UHUGEINT AS v FROM st UNION ALL SELECT p_partkey, n+1, xor(a, y), xor(b, x), xor(x, " + wrap("b*131072::UHUGEINT") + "), " + turn("y", 45) + ", " + wrap(turn(SUM_SQL, 23) + "+a") + f" FROM (SELECT *, xor(c, a) AS x, xor(d, b) AS y FROM g) WHERE n<{DRAWN}), "
    "us AS (SELECT p_partkey, list((v//2048::UHUGEINT)::DOUBLE*pow(2::DOUBLE, -53) ORDER BY n) AS u FROM g WHERE n>0 GROUP BY p_partkey)"
)


def direct(kind: str, per: int, x: str) -> None:
    """Draws that take a fixed number of uniforms, u and w."""
    ORACLES[f"sample_{kind}"] = f"WITH RECURSIVE {STREAM_SQL}, d AS (SELECT p_partkey, r.n::INT AS n, u[{per}*r.n+1] AS u, u[{per}*r.n+{min(per, 2)}] AS w FROM us, range(16) r(n)) SELECT p_partkey, n, {sq(x)} AS x FROM d"


BELL = "sqrt(-2*ln(u))*cos(2*pi()*w)"
direct("uniform", 1, "0.5::DOUBLE+u")
direct("exponential", 1, "-ln(1-u)/1.5::DOUBLE")
direct("bernoulli", 1, "CASE WHEN u<0.3::DOUBLE THEN 1::DOUBLE ELSE 0 END")
direct("normal", 2, f"1+2*{BELL}")
direct("binomial", 2, f"least(60, floor(greatest(0, 18::DOUBLE+sqrt(60*0.3::DOUBLE*(1-0.3::DOUBLE))*{BELL})+0.5::DOUBLE))")
ORACLES["sample_poisson"] = f"WITH RECURSIVE {STREAM_SQL}, w AS (SELECT p_partkey, 0 AS pos, 0 AS n, 1::DOUBLE AS m, 0::DOUBLE AS x, false AS done FROM us UNION ALL SELECT p_partkey, pos+1, CASE WHEN done THEN n+1 ELSE n END, t, CASE WHEN done THEN 0 ELSE x END+CASE WHEN t>exp(-7.5::DOUBLE) THEN 1 ELSE 0 END, t<=exp(-7.5::DOUBLE) FROM (SELECT w.*, CASE WHEN done THEN 1 ELSE m END*u[pos+1] AS t FROM w JOIN us USING (p_partkey)) WHERE pos<{DRAWN} AND NOT (done AND n=15)) SELECT p_partkey, n::INT AS n, {sq('x')} AS x FROM w WHERE done"


def rejected(kind: str, stages: list[tuple[str, float]], x: str) -> None:
    """Draws of several stages (normal, or gamma of a shape); a rejected attempt moves on in the stream only."""
    bell = "sqrt(-2*ln(u[pos+1]))*cos(2*pi()*u[pos+2])"
    of = lambda values: "CASE s " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    shape = of([f"{max(v, 1.0)!r}::DOUBLE" for _, v in stages])
    attempt = f"SELECT *, {bell} AS z, {shape}-1/3::DOUBLE AS d, {of(['true' if k == 'normal' else 'false' for k, _ in stages])} AS plain FROM w JOIN us USING (p_partkey) WHERE n<16 AND pos<{DRAWN - 3}"
    cube = f"SELECT *, 1+z/sqrt(9*d) AS v FROM ({attempt})"
    tried = f"SELECT *, plain OR (v>0 AND (u[pos+3]<1-0.0331::DOUBLE*z*z*z*z OR ln(u[pos+3])<0.5::DOUBLE*z*z+d*(1-v*v*v+ln(v*v*v)))) AS good FROM ({cube})"
    last = len(stages) - 1
    step = f"SELECT p_partkey, pos+CASE WHEN plain OR v<=0 THEN 2 ELSE 3 END AS pos, CASE WHEN good AND s={last} THEN n+1 ELSE n END AS n, CASE WHEN NOT good THEN s WHEN s={last} THEN 0 ELSE s+1 END AS s, CASE WHEN good AND s=0 THEN CASE WHEN plain THEN z ELSE d*v*v*v END ELSE g0 END AS g0, CASE WHEN good AND s={last} THEN CASE WHEN plain THEN z ELSE d*v*v*v END END AS g1 FROM ({tried})"
    ORACLES[f"sample_{kind}"] = f"WITH RECURSIVE {STREAM_SQL}, w AS (SELECT p_partkey, 0 AS pos, 0 AS n, 0 AS s, 0::DOUBLE AS g0, NULL::DOUBLE AS g1 FROM us UNION ALL {step}) SELECT p_partkey, (n-1)::INT AS n, {sq(x)} AS x FROM w WHERE g1 IS NOT NULL"


rejected("gamma", [("gamma", 2.5)], "g1/1.5::DOUBLE")
rejected("chi_squared", [("gamma", 1.5)], "g1/0.5::DOUBLE")
rejected("beta", [("gamma", 2.0), ("gamma", 3.0)], "g0/(g0+g1)")
rejected("student_t", [("normal", 1.0), ("gamma", 2.5)], "g0/sqrt(2*g1/5)")

# --- quaternions ---------------------------------------------------------------------------

for axis_, sql_ in (("x", {"x": "sin(w/2)", "y": "0::DOUBLE", "z": "0::DOUBLE"}), ("y", {"x": "0::DOUBLE", "y": "sin(w/2)", "z": "0::DOUBLE"}), ("z", {"x": "0::DOUBLE", "y": "0::DOUBLE", "z": "sin(w/2)"})):
    rotations(f"quat_rot{axis_}", lambda p, v, a=axis_: wxyz(special.quat_rot(a, p["w"])), {"w": "cos(w/2)", **sql_})
rotations("quat_from_euler", lambda p, v: wxyz(special.quat_from_euler(p["x"], p["y"], p["z"])), {
    "w": "cos(i/2)*cos(j/2)*cos(k/2)+sin(i/2)*sin(j/2)*sin(k/2)", "x": "sin(i/2)*cos(j/2)*cos(k/2)-cos(i/2)*sin(j/2)*sin(k/2)", "y": "cos(i/2)*sin(j/2)*cos(k/2)+sin(i/2)*cos(j/2)*sin(k/2)", "z": "cos(i/2)*cos(j/2)*sin(k/2)-sin(i/2)*sin(j/2)*cos(k/2)"})
# a rotation matrix gives its quaternion back, up to the sign that makes the chosen largest part positive
LARGEST = "CASE WHEN 4*w*w-1>0 THEN w WHEN i*i>=j*j AND i*i>=k*k THEN i WHEN j*j>=k*k THEN j ELSE k END"
rotations("quat_from_matrix", lambda p, v: wxyz(special.quat_from_matrix(special.quat_to_matrix(p))), {c: f"{s}*sign({LARGEST})" for c, s in zip("wxyz", "wijk", strict=True)})
BETWEEN = "sqrt(x*x+y*y+z*z)"
rotations("quat_between", lambda p, v: dict(zip("xyz", special.quat_rotate(special.quat_between([p["x"], p["y"], p["z"]], v), [p["x"], p["y"], p["z"]]), strict=True)), {c: f"{c}/{BETWEEN}*sqrt(i*i+j*j+k*k)" for c in "xyz"})
rotations("quat_between_opposite", lambda p, v: dict(zip("xyz", special.quat_rotate(special.quat_between(v, [-x for x in v]), v), strict=True)), {c: f"-{c}" for c in "xyz"})
rotations("quat_to_axis_angle", lambda p, v: (lambda t: {"x": t[0][0], "y": t[0][1], "z": t[0][2], "angle": t[1]})(special.quat_to_axis_angle(p)), {"x": "i/sqrt(i*i+j*j+k*k)", "y": "j/sqrt(i*i+j*j+k*k)", "z": "k/sqrt(i*i+j*j+k*k)", "angle": "2*atan2(sqrt(i*i+j*j+k*k), w)"})
rotations("quat_identity_axis_angle", lambda p, v: (lambda t: {"x": t[0][0], "angle": t[1]})(special.quat_to_axis_angle(special.quat_identity())), {"x": "1::DOUBLE", "angle": "0::DOUBLE"})
rotations("quat_derivative", lambda p, v: wxyz(special.quat_derivative(p, v)), {"w": "0.5::DOUBLE*(-i*x-j*y-k*z)", "x": "0.5::DOUBLE*(w*x+j*z-k*y)", "y": "0.5::DOUBLE*(w*y-i*z+k*x)", "z": "0.5::DOUBLE*(w*z+i*y-j*x)"})
TURN = {"w": "cos(0.15::DOUBLE*n)", **{c: f"{c}/n*sin(0.15::DOUBLE*n)" for c in "xyz"}}
rotations("quat_from_angular_velocity", lambda p, v: wxyz(special.quat_from_velocity(v, 0.3)), {k: s.replace("n)", f"{BETWEEN})").replace("/n", f"/{BETWEEN}") for k, s in TURN.items()})
T = {k: "(" + s.replace("n)", f"{BETWEEN})").replace("/n", f"/{BETWEEN}") + ")" for k, s in TURN.items()}
rotations("quat_propagate", lambda p, v: wxyz(special.quat_propagate(p, v, 0.3)), {
    "w": f"w*{T['w']}-i*{T['x']}-j*{T['y']}-k*{T['z']}", "x": f"w*{T['x']}+i*{T['w']}+j*{T['z']}-k*{T['y']}", "y": f"w*{T['y']}-i*{T['z']}+j*{T['w']}+k*{T['x']}", "z": f"w*{T['z']}+i*{T['y']}-j*{T['x']}+k*{T['w']}"})
rotations("quat_dot_neg", lambda p, v: {"dot": special.quat_dot(p, special.quat_neg(p)), "w": special.quat_neg(p)["w"]}, {"dot": "-1::DOUBLE", "w": "-w"})
register("quat_display", lambda s, sf: vectors(s, sf).select("vec_id", special.quat_text(special.quaternion(*(F.floor(F.col("a")[k] * 100).cast("int") for k in range(4)))).alias("t")),
         "SELECT vec_id, '(' || " + " || ".join(f"floor(embedding[{k + 1}]::DOUBLE*100)::INT::VARCHAR || '{end}'" for k, end in enumerate((" + ", "i + ", "j + ", "k)"))) + " AS t FROM embeddings")

# --- JSON forms ------------------------------------------------------------------------------

register("vector_json", lambda s, sf: vectors(s, sf).select("vec_id", F.posexplode(vector_from_json(vector_to_json(F.col("a")))).alias("pos", "v")).select("vec_id", "pos", q(F.col("v")).alias("v")), f"WITH {V_SQL} SELECT vec_id, pos, {sq('a')} AS v FROM v")


def sized(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("vec_id", tables.sized_from_json(tables.sized_to_json(F.slice("a", 1, 6), F.lit(2), F.lit(3))).alias("m"))
    return v.select("vec_id", "m.nrows", "m.ncols", F.posexplode("m.data").alias("pos", "v")).select("vec_id", "nrows", "ncols", "pos", q(F.col("v")).alias("v"))


register("sized_matrix_json", sized, f"WITH {V_SQL} SELECT vec_id, 2::INT AS nrows, 3::INT AS ncols, pos, {sq('a')} AS v FROM v WHERE pos<6")

register("ml_vectors", lambda s, sf: vectors(s, sf).select("vec_id", F.posexplode(tables.from_ml(tables.to_ml(F.col("a")))).alias("pos", "v")).select("vec_id", "pos", q(F.col("v")).alias("v")), f"WITH {V_SQL} SELECT vec_id, pos, {sq('a')} AS v FROM v")

# --- least squares of a model that is not linear in its parameters -----------------------------


def decay_fit(damping: float):
    """y = 2 exp(-0.3 t), t from the parts' sizes, found from a start of (1, 0)."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        t = F.col("t")
        d = table(spark, sf, "part").select((F.col("p_size") / 50).alias("t")).withColumn("y", 2 * F.exp(-0.3 * t))
        x, cost = numeric.levenberg_marquardt(d, lambda p: p[0] * F.exp(p[1] * t) - F.col("y"), lambda p: [F.exp(p[1] * t), p[0] * t * F.exp(p[1] * t)], [1.0, 0.0], damping, tol=1e-14)
        return spark.createDataFrame([tuple(math.floor(v * 1e5 + 0.5) / 1e5 for v in (*x, cost))], "x0 double, x1 double, cost double")

    return query


for name_, damping_ in (("gauss_newton_decay", 0.0), ("levenberg_marquardt_decay", 1e-3)):
    register(name_, decay_fit(damping_), "SELECT 2::DOUBLE AS x0, -0.3::DOUBLE AS x1, 0::DOUBLE AS cost")
