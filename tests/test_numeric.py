"""Kernels and expressions against literal expectations."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from numfold.functions import design, mat, rng, special, vec
from numfold.functions import distributions as dist
from numfold.operators import estimate, image, interp, linalg, numeric, ode, scan


def test_solve_literal(spark):
    a, b = [2.0, -3.0, -2.0, 1.0, -1.0, 1.0, -1.0, 2.0, 2.0], [8.0, -11.0, -3.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(mat.solve(F.col("a"), F.col("b"), 3).alias("x")).first()
    assert row.x == pytest.approx([2.0, 3.0, -1.0])


def test_ieee_division(spark):
    row = spark.range(1).select(*(vec.ieee_div(F.lit(a), F.lit(0.0)).alias(n) for n, a in (("p", 1.0), ("m", -1.0), ("z", 0.0)))).first()
    assert row.p == math.inf and row.m == -math.inf and math.isnan(row.z)


def test_butterworth():
    b0, b1, b2, a1, a2 = special.butterworth(2, 1000.0, 8000.0)[0]
    assert (b0, b1, b2) == pytest.approx((0.0976310729378175, 0.195262145875635, 0.0976310729378175))
    assert (a1, a2) == pytest.approx((-0.9428090415820631, 1 / 3))
    assert special.butterworth(1, 1000.0, 8000.0)[0][:2] == pytest.approx((0.2928932188134525,) * 2)
    with pytest.raises(ValueError):
        special.butterworth(2, 5000.0, 8000.0)


def test_kernels():
    a = np.random.default_rng(5).normal(size=(6, 6))
    assert np.allclose(linalg.expm(a) @ linalg.expm(-a), np.eye(6))
    q, r, perm = linalg.pivoted_qr(a)
    assert np.allclose(q @ r, a[:, perm])
    assert linalg.lu_det(np.ones((3, 3))) == 0.0
    assert linalg.rank(np.outer(np.arange(1.0, 5), np.arange(1.0, 4)), 1e-10) == 1
    low = np.linalg.cholesky(a @ a.T + np.eye(6))
    assert np.allclose(linalg.rank1_update(linalg.rank1_update(low, a[0]), a[0], -1.0), low)


def test_numeric():
    assert numeric.brent(lambda t: t * t - 2, np.array([0.0]), np.array([2.0]))[0] == pytest.approx(math.sqrt(2))
    with pytest.raises(numeric.BracketInvalid):
        numeric.brent(lambda t: t * t + 1, np.array([0.0]), np.array([2.0]))
    assert numeric.adaptive_simpson(np.sin, 0.0, math.pi, 1e-12)[0] == pytest.approx(2.0)
    y, *_ = ode.solve_ivp(lambda t, y: np.array([y[1], -y[0]]), 0.0, 2 * math.pi, np.array([1.0, 0.0]))
    assert y == pytest.approx([1.0, 0.0], abs=1e-8)


def test_border_and_components(spark):
    img = spark.createDataFrame([("a", r, c, float(r * 6 + c)) for r in range(5) for c in range(6)], "img string, r int, c int, v double")
    same = image.convolve(img, [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]], 5, 6)
    assert same.exceptAll(img).isEmpty() and same.count() == 30
    const = img.withColumn("v", F.lit(3.0))
    assert {r.v for r in image.convolve(const, [[0.1, 0.2, 0.3], [0.1, 0.4, 0.3], [0.2, 0.2, 0.2]], 5, 6).select(F.round("v", 9).alias("v")).collect()} == {6.0}
    flat = image.otsu(const).first()
    assert flat.t == 3.0


def test_otsu_bimodal(spark):
    img = spark.createDataFrame([("a", r, c, 1.0 if c % 2 else 10.0) for r in range(16) for c in range(16)], "img string, r int, c int, v double")
    assert 1.5 < image.otsu(img).first().t < 9.5


def test_interpolation_reproduces_a_line(spark):
    knots = spark.createDataFrame([(float(x), 2.0 * x + 1, 2.0) for x in range(4)], "x double, y double, dy double")
    at = spark.createDataFrame([(-1.0,), (0.0,), (1.5,), (3.0,), (5.0,)], "x double")
    for f in (interp.linear, interp.hermite, interp.spline, interp.lagrange):
        assert all(abs(r.y - (2 * r.x + 1)) < 1e-9 for r in f(at, knots).collect()), f.__name__


def test_streaming_equals_batch(spark, tmp_path):
    from numfold.streaming.scans import scan_stream

    rows = spark.range(40).select((F.col("id") % 2).alias("series"), F.col("id").alias("k"), F.sin("id").alias("x"))
    rows.where("k < 20").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    step, start = scan.biquad_step(*special.butterworth(2, 1000.0, 8000.0)[0]), [0.0, 0.0]
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = lambda: scan_stream(stream, step, start).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    query()
    rows.where("k >= 20").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    query()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("k").collect()
    want = scan.scan(rows, step, start).orderBy("k").collect()
    assert [(r.series, r.k, r.y) for r in got] == [(r.series, r.k, r.y) for r in want]


@pytest.mark.parametrize("name", ["segmentation", "biquad", "interp_linear", "normal_quantile", "erf", "lu_n", "schur_n", "srukf", "rts_scalar", "sample_gamma", "canny", "dist_gamma", "interp_spline", "quat_propagate"])
def test_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "embeddings", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    keys = list(got.columns)
    assert got.sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_design():
    for order in (1, 2, 3, 5):
        for high in (False, True):
            z = -1.0 if high else 1.0
            gain = math.prod((b0 + b1 * z + b2) / (1 + a1 * z + a2) for b0, b1, b2, a1, a2 in design.chebyshev1(order, 1.0, 900.0, 8000.0, high))
            assert gain == pytest.approx(1.0 if order % 2 else 10 ** (-1 / 20))
    assert np.allclose(design.prototype(3, 1000.0, 8000.0, False, None), special.butterworth(3, 1000.0, 8000.0))
    b0, b1, _, a1, _ = design.lag(10.0, 1.0, 1000.0)
    assert (b0 + b1) / (1 + a1) == pytest.approx(10.0) and (b0 - b1) / (1 - a1) == pytest.approx(1.0)
    for bad in (lambda: design.lead(2.0, 10.0, 1.0, 1000.0), lambda: design.lag(1.0, 1.0, 1000.0), lambda: design.chebyshev1(2, 0.0, 10.0, 100.0)):
        with pytest.raises(ValueError):
            bad()


def test_quantiles():
    p = np.array([0.0, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999, 1.0])
    x = special.inverse(lambda v: special.lower_gamma(2.5, 1.5 * v), p, 0.0, math.inf)
    assert special.lower_gamma(2.5, 1.5 * x[1:-1]) == pytest.approx(p[1:-1], rel=1e-9) and x[0] == 0 and x[-1] == math.inf
    y = special.inverse(lambda v: special.regular_beta(0.5, 3.0, v), p, 0.0, 1.0)
    assert special.regular_beta(0.5, 3.0, y[1:-1]) == pytest.approx(p[1:-1], rel=1e-9)
    assert np.isnan(special.inverse(lambda v: special.lower_gamma(1.0, v), np.array([-0.1, 1.1, np.nan]), 0.0, math.inf)).all()


def test_beta_quantile_takes_few_steps():
    """Few values of the cdf for each quantile, each of few turns of the fraction: 70 values and 48 CPU seconds once."""
    p, asked, start = np.linspace(0.3, 0.34, 20000), [], time.process_time()
    x = special.inverse(lambda v: asked.append(len(v)) or special.regular_beta(2.0, 1.0, v), p, 0.0, 1.0)
    assert time.process_time() - start < 5 and sum(asked) < 20 * len(p)
    assert x == pytest.approx(np.sqrt(p), rel=1e-14)
    far = np.array([1e-12, 1e-30, 0.5, np.nan, 1.0, 0.0])
    assert special.inverse(lambda v: special.regular_beta(0.5, 1.0, v), far, 0.0, 1.0) == pytest.approx([1e-24, 1e-60, 0.25, np.nan, 1.0, 0.0], rel=1e-9, nan_ok=True)


def test_beta_distribution_goes_there_and_back(spark):
    """The cdf of 100,000 values took 5.6 CPU seconds, on both sides of the mean; a null counted as 1."""
    x, start = np.linspace(0.0, 1.0, 100_000), time.process_time()
    got = special.regular_beta(2.0, 3.5, x)
    assert time.process_time() - start < 1
    assert got == pytest.approx(1 - (1 - x) ** 3.5 * (1 + 3.5 * x), abs=1e-14)
    d, rows = dist.Beta(2.0, 3.5), spark.createDataFrame([(None,), (-0.5,), (0.0,), (0.4,), (1.0,), (1.5,)], "x double")
    assert [r.y for r in rows.select(d.cdf(F.col("x")).alias("y")).collect()] == [None, 0.0, 0.0, pytest.approx(1 - 0.6**3.5 * 2.4), 1.0, 1.0]
    assert [r.y for r in rows.select(d.cdf(d.quantile(F.col("x"))).alias("y")).collect()] == [None, None, 0.0, pytest.approx(0.4), 1.0, None]


def test_student_t_goes_there_and_back(spark):
    """Of quantiles far out too: a p of 1e-18 went to minus infinity and back to 0."""
    d = dist.StudentT(5.0)
    rows = spark.createDataFrame([(p,) for p in (1e-18, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999, 0.0, 1.0, None, -0.1, 1.1)], "p double")
    got = rows.select("p", d.cdf(d.quantile(F.col("p"))).alias("y")).collect()
    assert [r.y for r in got[:9]] == pytest.approx([r.p for r in got[:9]], rel=1e-9, abs=0) and [r.y for r in got[9:]] == [None] * 3


def test_student_t_quantiles_by_their_closed_form(spark):
    """These 20,000 quantiles took 91 s; that of 1e-12 was wrong in the fifth digit."""
    p = np.r_[np.linspace(0.3, 0.3333, 20000), 1e-15, 1e-12, 0.001, 0.75, 0.9375]
    rows = spark.createDataFrame(list(enumerate(p.tolist())), "k int, p double").coalesce(1)
    start = time.monotonic()
    got = np.array([r.x for r in rows.select("k", special.student_t_quantile(F.col("p"), 2.0).alias("x")).orderBy("k").collect()])
    assert time.monotonic() - start < 45
    assert got == pytest.approx((2 * p - 1) / np.sqrt(2 * p * (1 - p)), rel=1e-10)


def test_student_t_quantiles_near_the_middle_and_far_out(spark):
    """Those near 1/2 were off by up to 1.5e-8, whatever their size; that of 1e-200 at one degree of freedom was -1.3e154."""
    p = np.r_[0.5 - 10.0 ** -np.arange(1, 16), 0.5 + 10.0 ** -np.arange(1, 16), 1e-200, 1e-20]
    rows = spark.createDataFrame(list(enumerate(p.tolist())), "k int, p double").coalesce(1)
    got = rows.select("k", *(special.student_t_quantile(F.col("p"), nu).alias(f"x{nu:g}") for nu in (1.0, 2.0))).orderBy("k").collect()
    assert [r.x2 for r in got] == pytest.approx((2 * (p - 0.5)) / np.sqrt(2 * p * (1 - p)), rel=1e-12, abs=0)
    assert [r.x1 for r in got] == pytest.approx(np.r_[np.tan(np.pi * (p[:-2] - 0.5)), -1 / np.tan(np.pi * p[-2:])], rel=1e-12, abs=0)


def test_student_t_quantile_takes_few_steps(monkeypatch):
    """Two or three values of the fraction for each quantile; they were 10 to 17, in up to 85 turns of a batch."""
    asked, whole = [], special.beta_fraction
    monkeypatch.setattr(special, "beta_fraction", lambda a, b, x: asked.append(x.size) or whole(a, b, x))
    for nu in (0.3, 2.0, 5.0, 30.0):
        for q in (np.linspace(0.3, 0.3333, 10000), np.linspace(1e-6, 0.4999, 10000)):
            asked.clear()
            t = special.student_t_tail_point(q, nu)
            assert len(asked) < 6 and sum(asked) < 3.5 * len(q)
            assert 0.5 * special.regular_beta(nu / 2, 0.5, nu / (nu + t * t)) == pytest.approx(q, rel=1e-11)
    q, nu = np.array([0.4, 0.2, 0.1]), 1e7  # many degrees of freedom: the normal's and the first term beyond
    z = np.array([0.2533471031357998, 0.8416212335729143, 1.2815515655446004])
    assert special.student_t_tail_point(q, nu) == pytest.approx(z + (z**3 + z) / (4 * nu), rel=1e-12)
    assert special.student_t_tail_point(np.array([0.0, 0.5, np.nan, -0.1, 0.6]), 2.0) == pytest.approx([math.inf, 0.0, *[math.nan] * 3], nan_ok=True)


def test_streams(spark):
    s = rng.Streams(np.zeros(1))
    s.state = np.array([[1], [2], [3], [4]], np.uint64)
    assert [int(s.bits(np.arange(1))[0]) for _ in range(4)] == [41943041, 58720359, 3588806011781223, 3591011842654386]
    together, rows = rng.Streams(np.arange(50)), np.arange(50)
    both = [together.gamma(rows, 0.7) for _ in range(3)]
    for i in (0, 17, 49):
        alone = rng.Streams(np.array([i]))
        assert [alone.gamma(np.arange(1), 0.7)[0] for _ in range(3)] == [b[i] for b in both]
    many, rows = rng.Streams(np.arange(40_000)), np.arange(40_000)
    for kind, parameters, mean, var in (("normal", (1.0, 2.0), 1, 4), ("gamma", (2.5, 1.5), 5 / 3, 10 / 9), ("beta", (2.0, 3.0), 0.4, 0.04), ("student_t", (5.0,), 0, 5 / 3), ("poisson", (7.5,), 7.5, 7.5), ("poisson", (40.0,), 40, 40), ("binomial", (60, 0.3), 18, 12.6), ("binomial", (9, 0.3), 2.7, 1.89), ("exponential", (1.5,), 2 / 3, 4 / 9)):
        x = rng.DRAWS[kind](many, rows, *parameters)
        assert abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and x.var() == pytest.approx(var, rel=0.1)
    got = spark.createDataFrame([(1,), (None,)], "seed long").select(rng.sample(F.col("seed"), 3, "uniform", 0.0, 1.0).alias("x")).collect()
    assert len(got[0].x) == 3 and got[1].x is None


def test_solvers():
    turn = lambda t, y: np.array([y[1], -y[0]])
    assert np.allclose(ode.solve_ivp(turn, 0.0, 3.0, [0.0, 1.0], "tsit54")[0], [math.sin(3), math.cos(3)], atol=1e-8)
    assert np.allclose(ode.solve_stiff(turn, 3.0, 0.0, [math.sin(3), math.cos(3)])[0], [0.0, 1.0], atol=1e-6)
    fast = ode.solve_stiff(lambda t, y: -1000 * y, 0.0, 0.01, [1.0], lambda t, y: np.array([[-1000.0]]))
    assert fast[0][0] == pytest.approx(math.exp(-10), abs=1e-8)
    robertson = ode.solve_stiff(lambda t, y: np.array([-0.04 * y[0] + 1e4 * y[1] * y[2], 0.04 * y[0] - 1e4 * y[1] * y[2] - 3e7 * y[1] ** 2, 3e7 * y[1] ** 2]), 0.0, 40.0, [1.0, 0.0, 0.0], rtol=1e-8, atol=1e-12)
    assert robertson[0] == pytest.approx([0.7158270688, 9.185534765e-6, 0.2841637458], rel=1e-4) and robertson[1] < 1000


def test_square_root_filter_equals_textbook():
    """A bent 2-D model: sigma-point filters against the plain formulas, the square root staying a factor."""
    f = lambda x: np.array([x[0] + 0.1 * x[1], x[1] - 0.1 * math.sin(x[0])])
    h = lambda x: np.array([math.hypot(x[0] + 2, x[1]), x[0] * x[1]])
    model = estimate.Model(f, h, np.diag([0.01, 0.02]), np.diag([0.1, 0.2]), np.array([0.5, 0.1]), np.array([[1.0, 0.2], [0.2, 0.5]]))

    def textbook(kind, zs):
        x, p, out = model.x0, model.p0, []
        for z in zs:
            for g, noise, seen in ((f, model.q, None), (h, model.r, z)):
                low = np.linalg.cholesky(p)
                pts = [x] * (kind == "unscented") + [x + s * math.sqrt(2) * low[:, k] for s in (1, -1) for k in range(2)]
                wm = [0.0, *[0.25] * 4] if kind == "unscented" else [0.25] * 4
                wc = [2.0, *[0.25] * 4] if kind == "unscented" else [0.25] * 4
                y = [g(v) for v in pts]
                mean = sum(w * v for w, v in zip(wm, y, strict=True))
                cov = sum(w * np.outer(v - mean, v - mean) for w, v in zip(wc, y, strict=True)) + noise
                if seen is None:
                    x, p = mean, cov
                else:
                    cross = sum(w * np.outer(u - x, v - mean) for w, u, v in zip(wc, pts, y, strict=True))
                    k = cross @ np.linalg.inv(cov)
                    x, p = x + k @ (seen - mean), p - k @ cov @ k.T
            out.append((x, p))
        return out

    zs = np.random.default_rng(3).normal(size=(12, 2)) * 0.3 + [2.5, 0.1]
    for kind, like in (("unscented", "unscented"), ("square_root", "unscented"), ("cubature", "cubature")):
        g = estimate.Filter(model, estimate.Options(kind))
        for z, (x, p) in zip(zs, textbook(like, zs), strict=True):
            g.predict()
            assert g.update(z) >= 0
            assert g.x == pytest.approx(x, abs=1e-9) and np.allclose(g.p, p, atol=1e-9)
            if kind == "square_root":
                assert np.allclose(np.triu(g.s, 1), 0)
    # iterated: the update of a bent measurement reaches the point where another round changes nothing
    g = estimate.Filter(model, estimate.Options(rounds=50))
    g.predict()
    x, p = g.x.copy(), g.p.copy()
    g.update(zs[0])
    j = estimate.jacobian(h, g.x)
    k = p @ j.T @ np.linalg.inv(j @ p @ j.T + model.r)
    assert g.x == pytest.approx(x + k @ (zs[0] - h(g.x) - j @ (x - g.x)), abs=1e-6)


def test_estimators_keep_going(spark):
    rows = [(1, k, x) for k, x in enumerate([1.0, None, float("nan"), 2.0, 50.0])] + [(2, 0, 1.0), (None, 0, 3.0)]
    signal = spark.createDataFrame(rows, "series long, k long, x double")
    model = estimate.Model(lambda x: x, lambda x: x, np.eye(1), np.eye(1), np.zeros(1), np.eye(1))
    got = {(r.series, r.k): r for r in estimate.track(signal, model, estimate.Options(gate=20.0)).collect()}
    assert [got[1, k].status for k in range(5)] == ["ok", "missing", "missing", "ok", "gated"] and got[2, 0].status == "ok"
    assert got[1, 2].covariance[0] == pytest.approx(got[1, 0].covariance[0] + 2)
    bad = estimate.Model(lambda x: x, lambda x: x, np.eye(1) * -5, np.eye(1), np.zeros(1), np.eye(1))
    assert {r.status for r in estimate.track(signal, bad, estimate.Options("cubature")).collect()} <= {"CovarianceNotPD", "missing"}
    assert estimate.smooth(signal, model).count() == 7 and estimate.smooth(signal.limit(0), model).count() == 0
    out = {(r.series, r.k): r.y for r in scan.scan(signal, scan.kalman_step(1.0, 1.0, 1.0, 1.0), [0.0, 1.0]).collect()}
    assert out[1, 1] is None and out[1, 2] is None and out[1, 3] is not None


def test_a_series_split_over_tasks(spark):
    rows = spark.range(3000).select(F.lit(7).alias("series"), F.col("id").alias("k"), F.when(F.col("id") % 50 == 3, None).otherwise(F.sin(F.col("id") * 0.1)).alias("x"))
    sections = special.butterworth(5, 1000.0, 8000.0)
    one = {r.k: r.y for r in scan.scan(rows, scan.cascade_step(sections), [0.0] * (2 * len(sections))).collect()}
    many = {r.k: r.y for r in scan.linear_scan(rows, scan.cascade(sections), 9).collect()}
    assert one.keys() == many.keys() and all((one[k] is None and many[k] is None) or one[k] == pytest.approx(many[k], abs=1e-12) for k in one)


def test_many_knots(spark, monkeypatch):
    rng_ = np.random.default_rng(8)
    xs = np.sort(rng_.choice(4000, 700, replace=False)).astype(float)
    knots = spark.createDataFrame([(float(x), math.sin(x / 50), math.cos(x / 50) / 50) for x in xs], "x double, y double, dy double")
    at = spark.createDataFrame([(i, float(x)) for i, x in enumerate([*rng_.uniform(-100, 4100, 300), *xs[:20], xs[-1], xs[0]])] + [(999, None)], "id long, x double")
    want = {f: {r.id: (r.y, r.slope) for r in f(at, knots).collect()} for f in (interp.linear, interp.hermite, interp.spline)}
    monkeypatch.setattr(interp, "KNOTS", 10)
    monkeypatch.setattr(interp, "BLOCK", 100)
    for f, small in want.items():
        large = {r.id: (r.y, r.slope) for r in f(at, knots).collect()}
        assert large.keys() == small.keys() and large[999] == (None, None)
        assert all(large[i] == pytest.approx(small[i], rel=1e-9, abs=1e-12) for i in large if i != 999), f.__name__
    with pytest.raises(interp.InterpError):
        interp.lagrange(at, knots)
    with pytest.raises(interp.InterpError):
        interp.linear(at, knots.union(knots))


def test_components_of_literal_images(spark):
    def found(lines, eight=False):
        img = spark.createDataFrame([("a", r, c, float(v)) for r, line in enumerate(lines) for c, v in enumerate(line)], "img string, r int, c int, v double")
        return image.component_stats(image.labelled(img, len(lines), len(lines[0]), eight)).orderBy("label").collect()

    two = found([[1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [0, 0, 0, 1, 1], [0, 0, 0, 1, 1]])
    assert [(r.label, r.area, r.r0, r.c0, r.r1, r.c1) for r in two] == [(1, 4, 0, 0, 1, 1), (2, 4, 2, 3, 3, 4)]
    assert len(found([[1, 0], [0, 1]])) == 2 and len(found([[1, 0], [0, 1]], True)) == 1
    u = found([[1, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 0]])
    assert [(r.label, r.area) for r in u] == [(1, 7)]
    block = found([[1 if 1 <= r <= 3 and 2 <= c <= 4 else 0 for c in range(8)] for r in range(6)])
    assert [(r.area, r.cy, r.cx, r.mu20, r.mu02, r.mu11) for r in block] == [(9, 2.0, 3.0, 6.0, 6.0, 0.0)]
    spiral = found(["1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111"])
    assert len(spiral) == 1
    assert found([[0, 0], [0, 0]]) == []


def test_canny_finds_a_step(spark):
    img = spark.createDataFrame([("a", r, c, 1.0 if c >= 8 else 0.0) for r in range(16) for c in range(16)], "img string, r int, c int, v double")
    edges = {(r.r, r.c) for r in image.canny(img, 1.0, 0.05, 0.15, 16, 16).where("v = 1").collect()}
    assert edges and {c for _, c in edges} <= {7, 8} and {r for r, _ in edges} == set(range(1, 15))


def test_distributions_refuse_bad_parameters():
    for make in (lambda: dist.Normal(0, 0), lambda: dist.Uniform(1, 1), lambda: dist.Exponential(0), lambda: dist.Gamma(-1, 1), lambda: dist.Beta(0, 1), lambda: dist.Bernoulli(1.5), lambda: dist.Binomial(-1, 0.5), lambda: dist.Poisson(0), lambda: dist.ChiSquared(0), lambda: dist.StudentT(0)):
        with pytest.raises(dist.StatsError):
            make()
    assert math.isnan(dist.StudentT(1.0).mean()) and dist.StudentT(1.5).variance() == math.inf


def test_extrapolated_pairs_have_their_order():
    decay = lambda t, y: -2 * y + np.cos(t)[:, None]
    exact = lambda t: (2 * math.cos(t) + math.sin(t)) / 5 + (1 - 0.4) * math.exp(-2 * t)
    for name, order in (("order65", 6), ("order87", 8)):
        step = ode.explicit(decay, ode.TABLEAUS[name])
        errors = [abs(step(np.zeros(1), np.ones((1, 1)), np.array([h]))[0][0, 0] - exact(h)) for h in (0.8, 0.4)]
        assert errors[0] / errors[1] == pytest.approx(2 ** (order + 1), rel=0.35), name
    for t in ode.TABLEAUS.values():
        assert sum(t[2]) == pytest.approx(1, abs=1e-9) and sum(t[3]) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ode.OdeError):
        ode.solve_many(decay, 0.0, 1.0, np.ones((1, 1))).at(0.5)
    stopped = ode.solve_many(lambda t, y: np.where(y > 2, np.nan, y * y), 0.0, 2.0, np.array([[0.1], [1.0]]))
    assert list(stopped.status) == ["ok", "NotFinite"] and stopped.y[0, 0] == pytest.approx(0.1 / 0.8)


def test_searches_report_how_they_ended():
    m = numeric.bfgs(lambda i, x: (x**2).sum(axis=1), None, np.array([[1.0, 2.0], [0.0, 0.0]]), tol=1e-6, rounds=0)
    assert list(m.status) == ["MaxIterations", "ok"] and m.evals[0] == 1 and m.rounds[1] == 0
    assert numeric.adaptive_simpson(np.sin, np.zeros(2), np.array([math.pi, 1.0]), 1e-12) == pytest.approx([2.0, 1 - math.cos(1.0)])
    with pytest.raises(ValueError):
        numeric.adaptive_simpson(np.sin, np.zeros(1), np.ones(1), 0.0)


def test_circle_and_decay_fits(spark):
    points = spark.createDataFrame([(1 + 2 * math.cos(t), 1 + 2 * math.sin(t)) for t in range(6)], "px double, py double")
    away = lambda p: F.sqrt((F.col("px") - p[0]) ** 2 + (F.col("py") - p[1]) ** 2)
    for damping in (0.0, 1e-3):
        x, cost = numeric.levenberg_marquardt(points, lambda p: away(p) - p[2], lambda p: [(F.lit(p[0]) - F.col("px")) / away(p), (F.lit(p[1]) - F.col("py")) / away(p), F.lit(-1.0)], [0.3, 0.2, 1.5], damping)
        assert x == pytest.approx([1, 1, 2], abs=1e-6) and cost < 1e-12
    decay = spark.createDataFrame(list(zip([0.0, 1.0, 2.0, 3.0, 4.0], [2.0, 2.7, 3.65, 4.95, 6.7], strict=True)), "t double, y double")
    x, cost = numeric.levenberg_marquardt(decay, lambda p: p[0] * F.exp(p[1] * F.col("t")) - F.col("y"), lambda p: [F.exp(p[1] * F.col("t")), p[0] * F.col("t") * F.exp(p[1] * F.col("t"))], [1.0, 0.1])
    assert cost < 0.1 and x == pytest.approx([2.0, 0.3], abs=0.05)


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from numfold.operators import shared

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster())


def test_matrices_between_forms(spark):
    from numfold.sources import tables

    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "a array<double>").select(tables.from_ml(tables.to_ml(F.col("a"))).alias("ml"), tables.to_json(F.col("a"), 2, 2).alias("j"), tables.sized_to_json(F.col("a"), F.lit(2), F.lit(2)).alias("s")).first()
    assert row.ml == [1.0, 2.0, 3.0, 4.0] and row.j == "[[1.0,3.0],[2.0,4.0]]" and '"nrows":2' in row.s
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([('{"nrows":2,"ncols":2,"data":[1.0]}',)], "j string").select(tables.sized_from_json(F.col("j"))).collect()
