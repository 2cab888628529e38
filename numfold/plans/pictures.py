"""Queries of padding, resampling, labelling and edges of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numfold.operators import image
from numfold.plans.catalog import BORDERS, H, W, blur_ctes, conv_sql, near_sql, picture
from numfold.plans.registry import IMG_SQL, q, register, sq
from numfold.sources.tables import images

PAD_SQL = "SELECT g.img, g.r, g.c, coalesce(p.v, {fill}::DOUBLE) AS v FROM (SELECT DISTINCT img, a.i::INT AS r, b.i::INT AS c FROM img, range({h}) a(i), range({w}) b(i)) g LEFT JOIN img p ON p.img=g.img AND p.r={r} AND p.c={c}"
for border_ in ("zero", "constant", "replicate", "reflect"):
    picture(f"pad_{border_}", lambda i, b=border_: image.pad(i, H, W, 2, 3, 4, 1, b, 7.0), PAD_SQL.format(fill=7 if border_ == "constant" else 0, h=H + 5, w=W + 5, r=BORDERS[border_].format(x="g.r-2", n=H), c=BORDERS[border_].format(x="g.c-4", n=W)))
for border_ in ("zero", "constant"):
    picture(f"dilate_{border_}", lambda i, b=border_: image.dilate(i, 2, H, W, b, 300.0), f"SELECT img, r, c, max(v) AS v FROM ({near_sql(image.square(2), border_, constant=300.0 if border_ == 'constant' else 0.0)}) GROUP BY ALL")
    picture(f"erode_{border_}", lambda i, b=border_: image.erode(i, 2, H, W, b, 20.0), f"SELECT img, r, c, min(v) AS v FROM ({near_sql(image.square(2), border_, constant=20.0 if border_ == 'constant' else 0.0)}) GROUP BY ALL")
picture("opening_reflect", lambda i: image.opening(i, 1, H, W, "reflect"), f"SELECT img, r, c, max(v) AS v FROM ({near_sql(image.square(1), 'reflect', 'er')}) GROUP BY ALL", f"er AS (SELECT img, r, c, min(v) AS v FROM ({near_sql(image.square(1), 'reflect')}) GROUP BY ALL)")
picture("laplacian_diagonal", lambda i: image.convolve(i, image.LAPLACIAN_DIAGONAL, H, W), conv_sql(image.LAPLACIAN_DIAGONAL, "replicate"))
picture("gaussian_blur_constant", lambda i: image.gaussian_blur(i, 1.0, H, W, "constant", 9.0), f"SELECT img, r, c, sum(w*v) AS v FROM ({near_sql(image.taps([image.gaussian_kernel(1.0)]), 'constant', 'down', 9.0)}) GROUP BY ALL", f"down AS ({conv_sql([[x] for x in image.gaussian_kernel(1.0)], 'constant', constant=9.0)})")
picture("median_filter_u16", lambda i: image.histogram_median(i, 2, H, W, "reflect"), f"SELECT img, r, c, list_sort(list(v))[13] AS v FROM ({near_sql(image.square(2), 'reflect')}) GROUP BY ALL")
NEAREST = "CASE WHEN (2*{i}+1)*{n}-{m}<=0 THEN 0 ELSE least(((2*{i}+1)*{n}-{m}+{m})//(2*{m}), {n}-1) END"
for name_, h_, w_ in (("resize_nearest_down", 13, 10), ("resize_nearest_up", 70, 31)):
    picture(name_, lambda i, h=h_, w=w_: image.resize_nearest(i, H, W, h, w), f"SELECT g.img, g.r, g.c, p.v FROM (SELECT DISTINCT img, a.i::INT AS r, b.i::INT AS c FROM img, range({h_}) a(i), range({w_}) b(i)) g JOIN img p ON p.img=g.img AND p.r={NEAREST.format(i='g.r', n=H, m=h_)} AND p.c={NEAREST.format(i='g.c', n=W, m=w_)}")


def bilinear_sql(source: str, h: int, w: int, h2: int, w2: int) -> str:
    place = lambda i, n, m: f"greatest(0, least({n - 1}, ({i}+0.5::DOUBLE)*({n}/{m}::DOUBLE)-0.5::DOUBLE))"
    grid = f"SELECT *, floor(y)::INT AS y0, floor(x)::INT AS x0, y-floor(y) AS fy, x-floor(x) AS fx FROM (SELECT DISTINCT img, r.i::INT AS r, c.i::INT AS c, {place('r.i', h, h2)} AS y, {place('c.i', w, w2)} AS x FROM {source}, range({h2}) r(i), range({w2}) c(i))"
    return f"SELECT g.img, g.r, g.c, (1-fy)*(1-fx)*a.v+(1-fy)*fx*b.v+fy*(1-fx)*d.v+fy*fx*e.v AS v FROM ({grid}) g JOIN {source} a ON a.img=g.img AND a.r=y0 AND a.c=x0 JOIN {source} b ON b.img=g.img AND b.r=y0 AND b.c=least(x0+1,{w - 1}) JOIN {source} d ON d.img=g.img AND d.r=least(y0+1,{h - 1}) AND d.c=x0 JOIN {source} e ON e.img=g.img AND e.r=least(y0+1,{h - 1}) AND e.c=least(x0+1,{w - 1})"


picture("median_pool_upsampled", lambda i: image.median_pool_upsampled(i, 4, H, W), bilinear_sql("pool", 8, 6, H, W), "pool AS (SELECT img, r//4 AS r, c//4 AS c, list_sort(list(v))[count(*)//2+1] AS v FROM img GROUP BY ALL)", 3)
register("gaussian_pyramid", lambda s, sf: image.gaussian_pyramid(images(s, sf), 3, 1.0, H, W).select("level", "img", "r", "c", q(F.col("v"), 3).alias("v")),
         f"WITH {IMG_SQL}, {blur_ctes(1.0)}, one AS ({bilinear_sql('bl', H, W, 15, 12)}), {blur_ctes(1.0, 'one', 'bm').replace('greatest(0, least(31-1', 'greatest(0, least(15-1').replace('greatest(0, least(24-1', 'greatest(0, least(12-1')}, two AS ({bilinear_sql('bm', 15, 12, 7, 6)}) SELECT level::INT AS level, img, r::INT AS r, c::INT AS c, {sq('v', 3)} AS v FROM (SELECT 0 AS level, img, r, c, v FROM img UNION ALL SELECT 1, img, r, c, v FROM one UNION ALL SELECT 2, img, r, c, v FROM two)")
register("integral_rect_sum", lambda s, sf: image.rect_sum(images(s, sf), H, W, 3, 5, 20, 40).select("img", q(F.col("v"), 4).alias("v")), f"WITH {IMG_SQL} SELECT img, {sq('sum(v)', 4)} AS v FROM img WHERE r BETWEEN 3 AND 19 AND c>=5 GROUP BY img")

# --- components and edges ----------------------------------------------------------------

LEVEL = 60.0


def front(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels up to the image's mean are background."""
    i = images(spark, sf)
    mean = i.groupBy("img").agg(F.avg("v").alias("mean"))
    return i.join(mean, "img").select("img", "r", "c", F.when(F.col("v") > F.col("mean"), F.col("v")).otherwise(0.0).alias("v"))


def labels_sql(near: str) -> str:
    return f"WITH RECURSIVE {IMG_SQL}, fg AS (SELECT img, r, c, r*{W}+c AS p FROM img JOIN (SELECT img, avg(v) AS mean FROM img GROUP BY img) USING (img) WHERE v>mean AND v<>0), lab AS (SELECT img, r, c, p AS l FROM fg UNION SELECT n.img, n.r, n.c, lab.l FROM lab JOIN fg n ON n.img=lab.img AND {near} AND n.p>lab.l), comp AS (SELECT img, r, c, min(l) AS comp FROM lab GROUP BY ALL)"


FOUR, EIGHT = "abs(n.r-lab.r)+abs(n.c-lab.c)=1", "abs(n.r-lab.r)<=1 AND abs(n.c-lab.c)<=1"
STATS_SQL = f" SELECT img, row_number() OVER (PARTITION BY img ORDER BY comp)::INT AS label, area, r0, c0, r1, c1, {', '.join(f'{sq(x, 4)} AS {x}' for x in ('cy', 'cx', 'mu20', 'mu02', 'mu11'))} FROM (SELECT img, comp, count(*) AS area, min(r)::INT AS r0, min(c)::INT AS c0, max(r)::INT AS r1, max(c)::INT AS c1, avg(r) AS cy, avg(c) AS cx, sum(r*r)-count(*)*avg(r)*avg(r) AS mu20, sum(c*c)-count(*)*avg(c)*avg(c) AS mu02, sum(r*c)-count(*)*avg(r)*avg(c) AS mu11 FROM comp GROUP BY ALL)"
for name_, eight_, near_ in (("connected_components_4", False, FOUR), ("connected_components_8", True, EIGHT)):
    register(name_, lambda s, sf, e=eight_: image.component_stats(image.labelled(front(s, sf), H, W, e)).select("img", "label", "area", "r0", "c0", "r1", "c1", *(q(F.col(x), 4).alias(x) for x in ("cy", "cx", "mu20", "mu02", "mu11"))), labels_sql(near_) + STATS_SQL)
register("component_labels", lambda s, sf: image.labelled(front(s, sf), H, W).select("img", "r", "c", F.col("comp").cast("long").alias("comp")), labels_sql(FOUR) + " SELECT img, r, c, comp::BIGINT AS comp FROM comp")
CANNY_SQL = f"WITH RECURSIVE {IMG_SQL}, {blur_ctes(1.0)}, gx AS ({conv_sql(image.SOBEL_X, 'replicate', 'bl')}), gy AS ({conv_sql(image.SOBEL_Y, 'replicate', 'bl')}), mg AS (SELECT img, r, c, x.v AS gx, y.v AS gy, sqrt(x.v*x.v+y.v*y.v) AS m FROM gx x JOIN gy y USING (img, r, c)), di AS (SELECT *, CASE WHEN abs(gy)<=tan(pi()/8)*abs(gx) THEN 0 ELSE 1 END AS dr, CASE WHEN abs(gy)<=tan(pi()/8)*abs(gx) THEN 1 WHEN abs(gy)>=tan(3*pi()/8)*abs(gx) THEN 0 WHEN (gx>0)=(gy>0) THEN 1 ELSE -1 END AS dc FROM mg), cl AS (SELECT d.img, d.r, d.c, CASE WHEN d.m>=400 THEN 2 WHEN d.m>=200 THEN 1 ELSE 0 END AS k FROM di d JOIN mg a ON a.img=d.img AND a.r=d.r-d.dr AND a.c=d.c-d.dc JOIN mg b ON b.img=d.img AND b.r=d.r+d.dr AND b.c=d.c+d.dc WHERE d.r BETWEEN 1 AND {H - 2} AND d.c BETWEEN 1 AND {W - 2} AND d.m+d.m*pow(2::DOUBLE,-53)>=greatest(a.m, b.m)), e AS (SELECT img, r, c FROM cl WHERE k=2 UNION SELECT w.img, w.r, w.c FROM e JOIN cl w ON w.img=e.img AND w.k>=1 AND abs(w.r-e.r)<=1 AND abs(w.c-e.c)<=1) SELECT img, r, c, CASE WHEN e.r IS NULL THEN 0::DOUBLE ELSE 1 END AS v FROM img LEFT JOIN e USING (img, r, c)"
register("canny", lambda s, sf: image.canny(images(s, sf), 1.0, 200.0, 400.0, H, W), CANNY_SQL)
