"""Images as relations (img, r, c, v) of whole grids: pixels scattered to the windows they lie in.

A neighbourhood operator sends every pixel, and its copies beyond the border, to the pixels
whose taps reach it, and aggregates there. Sums are added up on the map side first; nothing
is joined, and one large image is as parallel as many small ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Shared

Taps = list[tuple[int, int, float]]


def border_index(i: Column, n: int, border: str) -> Column:
    """Source index of index i of n; out of range for zero and constant borders."""
    if border == "replicate" or n == 1:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    if border == "reflect":
        p = F.pmod(i, F.lit(2 * n - 2))
        return F.least(p, 2 * n - 2 - p)
    return i


class ImageError(ValueError):
    """A kernel of even size, or a parameter outside its range."""


def valid(condition: bool, message: str) -> None:
    if not condition:
        raise ImageError(message)


def each(lo: int, hi: int) -> Column:
    """Literals lo .. hi - 1."""
    return F.sequence(F.lit(lo), F.lit(hi - 1))


def bordered(img: DataFrame, h: int, w: int, top: int, bottom: int, left: int, right: int, border: str, constant: float = 0.0, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """The grid with what the border mode puts around it, at negative places and beyond h and w."""
    if border == "truncate":
        return img.select("img", "r", "c", *columns)
    if border in ("zero", "constant"):
        fill = constant if border == "constant" else 0.0
        value = [F.lit(float(fill)).alias(c) for c in columns]
        grid = img.select("img").distinct().select("img", F.explode(each(-top, h + bottom)).alias("r")).select("img", "r", F.explode(each(-left, w + right)).alias("c"))
        outside = (F.col("r") < 0) | (F.col("r") >= h) | (F.col("c") < 0) | (F.col("c") >= w)
        return img.select("img", "r", "c", *columns).union(grid.where(outside).select("img", "r", "c", *value))

    def places(x: str, n: int, before: int, after: int) -> Column:
        """A pixel's own place and those beyond the border that show it."""
        beyond = [F.lit(p) for p in (*range(-before, 0), *range(n, n + after))]
        own = F.array(F.col(x).cast("int"))
        return F.explode(F.concat(own, F.filter(F.array(*beyond), lambda p: border_index(p, n, border) == F.col(x))) if beyond else own).alias(x)

    rows = img.select("img", places("r", h, top, bottom), "c", *columns)
    return rows.select("img", "r", places("c", w, left, right), *columns)


def neighbours(img: DataFrame, taps: Taps, h: int, w: int, border: str, constant: float = 0.0, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Rows (img, r, c, k, weight, v): the source values of every pixel's taps; no shuffle but for constant borders' images.

    border: replicate, reflect, zero, constant, or truncate (taps outside do not count)."""
    top, bottom = max(0, -min(dr for dr, _, _ in taps)), max(0, max(dr for dr, _, _ in taps))
    left, right = max(0, -min(dc for _, dc, _ in taps)), max(0, max(dc for _, dc, _ in taps))
    wide = bordered(img, h, w, top, bottom, left, right, border, constant, columns)
    tap = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(x)).alias("weight")) for k, (dr, dc, x) in enumerate(taps))))
    out = wide.select("img", "r", "c", *columns, tap.alias("t")).select("img", (F.col("r") - F.col("t.dr")).alias("r"), (F.col("c") - F.col("t.dc")).alias("c"), "t.k", "t.weight", *columns)
    return out.where((F.col("r") >= 0) & (F.col("r") < h) & (F.col("c") >= 0) & (F.col("c") < w))


def square(radius: int) -> Taps:
    return [(i, j, 1.0) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]


def taps(kernel: list[list[float]]) -> Taps:
    """Taps of an odd kernel, not flipped; zero weights are left out."""
    valid(len(kernel) % 2 == 1 and len(kernel[0]) % 2 == 1, "a kernel has odd sides")
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    return [(i - h, j - w, x) for i, line in enumerate(kernel) for j, x in enumerate(line) if x]


def convolve(img: DataFrame, kernel: list[list[float]], h: int, w: int, border: str = "replicate", constant: float = 0.0, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    found = neighbours(img, taps(kernel), h, w, border, constant, columns)
    return found.groupBy("img", "r", "c").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns))


def convolve_separable(img: DataFrame, ky: list[float], kx: list[float], h: int, w: int, border: str = "replicate", constant: float = 0.0, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    return convolve(convolve(img, [[y] for y in ky], h, w, border, constant, columns), [kx], h, w, border, constant, columns)


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[float]:
    valid(sigma > 0 and truncate > 0, "sigma and truncate must be positive")
    radius = math.ceil(truncate * sigma)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def box_kernel(n: int) -> list[float]:
    valid(n % 2 == 1 and n > 0, "a box kernel has an odd size")
    return [1 / n] * n


def gaussian_blur(img: DataFrame, sigma: float, h: int, w: int, border: str = "replicate", constant: float = 0.0, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Sigma of 0 or less, or NaN, gives the image itself."""
    if not sigma > 0:
        return img
    k = gaussian_kernel(sigma)
    return convolve_separable(img, k, k, h, w, border, constant, columns)


#: Derivative kernels.
SOBEL_X = [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]
SOBEL_Y = [[-1.0, -2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 2.0, 1.0]]
SCHARR_X = [[-3.0, 0.0, 3.0], [-10.0, 0.0, 10.0], [-3.0, 0.0, 3.0]]
SCHARR_Y = [[-3.0, -10.0, -3.0], [0.0, 0.0, 0.0], [3.0, 10.0, 3.0]]
LAPLACIAN = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]
LAPLACIAN_DIAGONAL = [[1.0, 1.0, 1.0], [1.0, -8.0, 1.0], [1.0, 1.0, 1.0]]


def gradients(img: DataFrame, kx: list[list[float]], ky: list[list[float]], h: int, w: int, border: str = "replicate") -> DataFrame:
    """(img, r, c, gx, gy) in one neighbourhood join."""
    both = [(i, j, 1.0) for i, j, _ in square(1)]
    weight = lambda k: F.sum(F.col("v") * F.get(F.array(*(F.lit(x) for line in k for x in line)), F.col("k")))
    return neighbours(img, both, h, w, border).groupBy("img", "r", "c").agg(weight(kx).alias("gx"), weight(ky).alias("gy"))


def integral(img: DataFrame) -> DataFrame:
    """Summed-area table without its zero row and column: sums of v over 0..r x 0..c."""
    down = img.withColumn("s", F.sum("v").over(Window.partitionBy("img", "c").orderBy("r")))
    return down.select("img", "r", "c", F.sum("s").over(Window.partitionBy("img", "r").orderBy("c")).alias("v"))


def rect_sum(img: DataFrame, h: int, w: int, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """(img, v): sums over rows top .. bottom - 1 and columns left .. right - 1, clamped to the grid, from four corners of the table."""
    valid(top <= bottom and left <= right, "a rectangle's ends are in order")
    top, bottom, left, right = min(top, h), min(bottom, h), min(left, w), min(right, w)
    sign = lambda r, c: F.when((F.col("r") == r - 1) & (F.col("c") == c - 1), F.col("v")).otherwise(0.0)
    total = sign(bottom, right) + sign(top, left) - sign(top, right) - sign(bottom, left)
    return integral(img).groupBy("img").agg(F.sum(total).alias("v"))


def local_stats(img: DataFrame, radius: int, h: int, w: int) -> DataFrame:
    """Mean and population variance over windows truncated at the border."""
    n = neighbours(img, square(radius), h, w, "truncate").groupBy("img", "r", "c")
    return n.agg(F.avg("v").alias("mean"), F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)).alias("variance"))


def rank(img: DataFrame, radius: int, k: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    """k-th smallest of the window after border fill."""
    valid(0 <= k < (2 * radius + 1) ** 2, "the rank lies within the window")
    return neighbours(img, square(radius), h, w, border, constant).groupBy("img", "r", "c").agg(F.sort_array(F.collect_list("v"))[k].alias("v"))


def percentile(img: DataFrame, radius: int, p: float, h: int, w: int, border: str = "replicate") -> DataFrame:
    n = (2 * radius + 1) ** 2
    return rank(img, radius, math.floor(min(max(p, 0.0), 1.0) * (n - 1)), h, w, border)


def median(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate") -> DataFrame:
    return rank(img, radius, (2 * radius + 1) ** 2 // 2, h, w, border)


def histogram_median(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    """Median of whole values from counts of values: the least one that has more than half of the window at or below it."""
    by = ["img", "r", "c"]
    counted = neighbours(img, square(radius), h, w, border, constant).groupBy(*by, "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("v"))
    half = (2 * radius + 1) ** 2 // 2
    return counted.withColumn("upto", upto).where(F.col("upto") > half).groupBy(*by).agg(F.min("v").alias("v"))


def extreme(img: DataFrame, radius: int, h: int, w: int, largest: bool, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    """Dilation or erosion: two separable sliding windows.

    What replicate and reflect show beyond the border lies inside the window already; zero and
    constant borders take part where the window reaches out of the grid."""
    f, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    by = lambda part, order: Window.partitionBy("img", part).orderBy(order).rowsBetween(-radius, radius)
    down = img.withColumn("v", f("v").over(by("c", "r")))
    out = down.withColumn("v", f("v").over(by("r", "c"))).select("img", "r", "c", "v")
    if border in ("zero", "constant"):
        reaches = (F.col("r") < radius) | (F.col("c") < radius) | (F.col("r") >= h - radius) | (F.col("c") >= w - radius)
        fill = F.lit(float(constant if border == "constant" else 0.0))
        out = out.withColumn("v", F.when(reaches, pick("v", fill)).otherwise(F.col("v")))
    return out


def dilate(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    return extreme(img, radius, h, w, True, border, constant)


def erode(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    return extreme(img, radius, h, w, False, border, constant)


def opening(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    return dilate(erode(img, radius, h, w, border, constant), radius, h, w, border, constant)


def closing(img: DataFrame, radius: int, h: int, w: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    return erode(dilate(img, radius, h, w, border, constant), radius, h, w, border, constant)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "other"), ["img", "r", "c"]).select("img", "r", "c", (F.col("v") - F.col("other")).alias("v"))


def median_pool(img: DataFrame, size: int) -> DataFrame:
    """Upper median of tiles; ragged edges stay."""
    tile = lambda x: F.floor(F.col(x) / size).cast("int").alias(x)
    return img.groupBy("img", tile("r"), tile("c")).agg(F.sort_array(F.collect_list("v")).alias("s")).select("img", "r", "c", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("v"))


def threshold(img: DataFrame, t: float | Column) -> DataFrame:
    return img.withColumn("v", F.when((F.col("v") > t) & ~F.isnan("v"), 1.0).otherwise(0.0))


def otsu(img: DataFrame) -> DataFrame:
    """(img, t): between-class variance over 256 bins; ties give the middle bin; a constant image gives its value."""
    span = img.groupBy("img").agg(F.min("v").alias("lo"), (F.max("v") - F.min("v")).alias("range"))
    binned = img.join(span, "img").withColumn("bin", F.when(F.col("range") > 0, F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("range")) * 255)).otherwise(0).cast("int"))
    hist = binned.groupBy("img", "lo", "range", "bin").agg(F.count("*").alias("n"))
    upto, all_ = Window.partitionBy("img").orderBy("bin"), Window.partitionBy("img")
    cum = hist.select("img", "lo", "range", "bin", F.sum("n").over(upto).cast("double").alias("w0"), F.sum("n").over(all_).cast("double").alias("n"), F.sum(F.col("n") * F.col("bin")).over(upto).cast("double").alias("s0"), F.sum(F.col("n") * F.col("bin")).over(all_).cast("double").alias("s"), F.lead("bin").over(upto).alias("next"))
    w1 = F.col("n") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    scored = cum.withColumn("between", F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0)))
    best = scored.withColumn("top", F.max("between").over(all_)).where("between = top")
    # the score is flat from a bin to the one before the next filled bin
    tied = best.groupBy("img", "lo", "range").agg(F.min("bin").alias("a"), F.max(F.coalesce(F.col("next") - 1, F.col("bin"))).alias("b"))
    mid = F.floor((F.col("a") + F.col("b")) / 2)
    return tied.select("img", F.when(F.col("range") > 0, F.col("lo") + (mid + 0.5) / 256 * F.col("range")).otherwise(F.col("lo")).alias("t"))


def harris(img: DataFrame, sigma: float, k: float, h: int, w: int, shi_tomasi: bool = False) -> DataFrame:
    """Corner responses of the smoothed structure tensor, whose three entries go through each pass together."""
    gx, gy = F.col("gx"), F.col("gy")
    g = gradients(img, SOBEL_X, SOBEL_Y, h, w).select("img", "r", "c", (gx * gx).alias("a"), (gx * gy).alias("b"), (gy * gy).alias("d"))
    t = gaussian_blur(g, sigma, h, w, columns=("a", "b", "d"))
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    v = F.greatest(0.5 * (a + d - F.sqrt((a - d) * (a - d) + 4 * b * b)), F.lit(0.0)) if shi_tomasi else a * d - b * b - k * (a + d) * (a + d)
    return t.select("img", "r", "c", v.alias("v"))


def resize_bilinear(img: DataFrame, h: int, w: int, h2: int, w2: int) -> DataFrame:
    """Half-pixel centres, clamped."""
    grid = img.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(h2 - 1))).alias("r")).select("img", "r", F.explode(F.sequence(F.lit(0), F.lit(w2 - 1))).alias("c"))
    place = lambda x, n, m: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(x) + 0.5) * (n / m) - 0.5))
    g = grid.withColumns({"y": place("r", h, h2), "x": place("c", w, w2)})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    g = g.withColumn("k", corner).withColumns({"r0": F.floor("y").cast("int"), "c0": F.floor("x").cast("int")})
    part = lambda x, x0, k: F.when(F.col(k) == 1, F.col(x) - F.col(x0)).otherwise(1 - (F.col(x) - F.col(x0)))
    g = g.select("img", "r", "c", F.least(F.col("r0") + F.col("k.i"), F.lit(h - 1)).alias("sr"), F.least(F.col("c0") + F.col("k.j"), F.lit(w - 1)).alias("sc"), (part("y", "r0", "k.i") * part("x", "c0", "k.j")).alias("weight"))
    source = img.select("img", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    return g.join(source, ["img", "sr", "sc"]).groupBy("img", "r", "c").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def pad(img: DataFrame, h: int, w: int, top: int, bottom: int, left: int, right: int, border: str = "replicate", constant: float = 0.0) -> DataFrame:
    out = bordered(img, h, w, top, bottom, left, right, border, constant)
    return out.select("img", (F.col("r") + top).alias("r"), (F.col("c") + left).alias("c"), "v")


def crop(img: DataFrame, h: int, w: int, top: int, left: int, height: int, width: int) -> DataFrame:
    valid(top + height <= h and left + width <= w, "the region lies within the grid")
    inside = (F.col("r") >= top) & (F.col("r") < top + height) & (F.col("c") >= left) & (F.col("c") < left + width)
    return img.where(inside).select("img", (F.col("r") - top).alias("r"), (F.col("c") - left).alias("c"), "v")


def resize_nearest(img: DataFrame, h: int, w: int, h2: int, w2: int) -> DataFrame:
    """Each output pixel takes the input pixel whose centre is nearest, by whole numbers; halves go up."""
    def targets(x: str, n: int, m: int) -> Column:
        lo, hi = F.floor(F.col(x) * m / n) - 1, F.floor((F.col(x) + 1) * m / n) + 1
        around = F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(m - 1)).cast("int"))
        num = lambda i: (2 * i + 1) * n - m
        source = lambda i: F.when(num(i) <= 0, F.lit(0)).otherwise(F.least(F.floor((num(i) + m) / (2 * m)), F.lit(n - 1)))
        return F.explode(F.filter(around, lambda i: source(i) == F.col(x))).alias(x)

    rows = img.select("img", targets("r", h, h2), "c", "v")
    return rows.select("img", "r", targets("c", w, w2), "v")


def median_pool_upsampled(img: DataFrame, size: int, h: int, w: int) -> DataFrame:
    return resize_bilinear(median_pool(img, size), -(-h // size), -(-w // size), h, w)


def gaussian_pyramid(img: DataFrame, levels: int, sigma: float, h: int, w: int, border: str = "replicate") -> DataFrame:
    """(level, img, r, c, v): the image, then blurred halves until a side is 1."""
    valid(levels > 0, "a pyramid has a level at least")
    out, now = img.select(F.lit(0).alias("level"), "img", "r", "c", "v"), img
    for level in range(1, levels):
        if min(h, w) <= 1:
            break
        now = resize_bilinear(gaussian_blur(now, sigma, h, w, border), h, w, h // 2, w // 2)
        h, w = h // 2, w // 2
        out = out.union(now.select(F.lit(level), "img", "r", "c", "v"))
    return out


def labelled(img: DataFrame, h: int, w: int, eight: bool = False, background: float = 0.0) -> DataFrame:
    """(img, r, c, comp): pixels other than the background, with the raster place of their component's first pixel.

    Rows fall into runs first; runs that touch in neighbouring rows are linked, and the links
    go through distributed star steps, so no image is gathered."""
    line = Window.partitionBy("img", "r").orderBy("c")
    front = img.where((F.col("v") != background) | F.isnan("v")).select("img", "r", "c")
    start = F.when(F.coalesce(F.lag("c").over(line) != F.col("c") - 1, F.lit(True)), F.col("r").cast("long") * w + F.col("c"))
    shared = Shared(img.sparkSession, "labels")
    pixels = shared.keep(front.withColumn("run", start).withColumn("run", F.last("run", ignorenulls=True).over(line)))
    reach = F.explode(F.array(*(F.col("c") + k for k in ((-1, 0, 1) if eight else (0,)))))
    above = pixels.select("img", (F.col("r") + 1).alias("r"), reach.alias("c"), F.col("run").alias("b"))
    links = pixels.select("img", "r", "c", F.col("run").alias("a")).join(above, ["img", "r", "c"]).select("img", "a", "b").distinct()
    comps = components(links, shared, by="img")
    return pixels.join(comps.withColumnRenamed("id", "run"), ["img", "run"], "left").select("img", "r", "c", F.coalesce("comp", "run").alias("comp"))


def component_stats(labels: DataFrame) -> DataFrame:
    """(img, label, area, box, centroid, central moments): labels count an image's components in raster order of their first pixels."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    sums = labels.groupBy("img", "comp").agg(F.count("*").alias("area"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg(r).alias("cy"), F.avg(c).alias("cx"), F.sum(r * r).alias("rr"), F.sum(c * c).alias("cc"), F.sum(r * c).alias("rc"))
    n = F.col("area")
    moment = lambda s, x, y: F.col(s) - n * F.col(x) * F.col(y)
    label = F.row_number().over(Window.partitionBy("img").orderBy("comp"))
    return sums.select("img", label.alias("label"), "area", "r0", "c0", "r1", "c1", "cy", "cx", moment("rr", "cy", "cy").alias("mu20"), moment("cc", "cx", "cx").alias("mu02"), moment("rc", "cy", "cx").alias("mu11"))


def canny(img: DataFrame, sigma: float, low: float, high: float, h: int, w: int, border: str = "replicate") -> DataFrame:
    """Edges 1, all else 0: smoothed gradients, thinned across the edge, and weak pixels that are 8-connected to a strong one.

    A pixel stays if no neighbour along its gradient (one of four directions) is larger; the outermost pixels never do."""
    g = gradients(gaussian_blur(img, sigma, h, w, border), SOBEL_X, SOBEL_Y, h, w, border)
    g = g.withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    around = neighbours(g.select("img", "r", "c", F.col("m").alias("v"), "gx", "gy"), square(1), h, w, "truncate", columns=("v", "gx", "gy"))
    at = lambda k, x: F.max(F.when(F.col("k") == k, F.col(x)))
    grid = around.groupBy("img", "r", "c").agg(*(at(k, "v").alias(f"m{k}") for k in range(9)), at(4, "gx").alias("gx"), at(4, "gy").alias("gy"))
    ax, ay, m = F.abs("gx"), F.abs("gy"), F.col("m4")
    larger = lambda a, b: F.greatest(f"m{a}", f"m{b}")
    diagonal = F.when((F.col("gx") > 0) == (F.col("gy") > 0), larger(0, 8)).otherwise(larger(2, 6))
    across = F.when(ay <= math.tan(math.pi / 8) * ax, larger(3, 5)).when(ay >= math.tan(3 * math.pi / 8) * ax, larger(1, 7)).otherwise(diagonal)
    inner = (F.col("r") > 0) & (F.col("r") < h - 1) & (F.col("c") > 0) & (F.col("c") < w - 1)
    thin = F.when(inner & (m != 0) & (m + m * (2.0**-53) >= across), m).otherwise(0.0)
    shared = Shared(img.sparkSession, "edges")
    kept = shared.keep(grid.select("img", "r", "c", thin.alias("m")))
    strong = F.when(F.col("m") >= high, 2.0).when(F.col("m") >= low, 1.0).otherwise(0.0)
    marked = kept.select("img", "r", "c", strong.alias("v"))
    labels = shared.keep(labelled(marked, h, w, eight=True).join(marked, ["img", "r", "c"]))
    edges = labels.groupBy("img", "comp").agg(F.max("v").alias("top")).where("top = 2").select("img", "comp")
    found = labels.join(edges, ["img", "comp"]).select("img", "r", "c", F.lit(1.0).alias("v"))
    return marked.join(found.withColumnRenamed("v", "edge"), ["img", "r", "c"], "left").select("img", "r", "c", F.coalesce("edge", F.lit(0.0)).alias("v"))
