"""Page images as a long table ``pixels(page_id, y, x, v)``: statistics, thresholds, integrals, skew and votes.

Every step is a grouped sum or a window over one page, so pages spread over the cluster. The forms on
whole arrays, for pages by the thousand, are in ``image_arrays``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
INK, SAUVOLA_K, SAUVOLA_R = 128, 0.34, 128.0
DEFAULT_THRESHOLD, MIN_SEPARATION, MIN_PEAK_SHARE, SMOOTH_REACH, SMOOTH_PASSES = 127, 40, 0.01, 4, 3


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def clamped(position: Column, size: Column) -> Column:
    """A place outside the image stands for the nearest one inside."""
    return F.least(F.greatest(position, F.lit(0)), size - 1)


def sample(points: DataFrame, pixels: DataFrame, fallback: int, exact: bool = False) -> DataFrame:
    """``points`` (page_id, px, py) with the bilinear value there, a whole number unless ``exact``; ``fallback`` half a pixel or more outside."""
    at = points.join(sizes(pixels), "page_id").withColumn("x0", F.floor("px")).withColumn("y0", F.floor("py"))
    at = at.withColumn("fx", F.col("px") - F.col("x0")).withColumn("fy", F.col("py") - F.col("y0"))
    corner = lambda dx, dy: F.struct(clamped(F.col("x0") + dx, F.col("w")).alias("x"), clamped(F.col("y0") + dy, F.col("h")).alias("y"), (F.when(F.lit(dx == 1), F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.lit(dy == 1), F.col("fy")).otherwise(1 - F.col("fy"))).alias("share"))
    keys = ["page_id", "px", "py"]
    inside = (F.col("px") > -0.5) & (F.col("py") > -0.5) & (F.col("px") < F.col("w") - 0.5) & (F.col("py") < F.col("h") - 0.5)
    four = at.select(*keys, inside.alias("inside"), F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c")).select(*keys, "inside", "c.*")
    value = F.sum(F.col("share") * F.col("v"))
    value = value if exact else F.floor(value + 0.5).cast("int")
    return four.join(pixels.select("page_id", "x", "y", "v"), ["page_id", "x", "y"]).groupBy(*keys).agg(F.when(F.first("inside"), value).otherwise(fallback).alias("v"))


def downscale(pixels: DataFrame, longest: int) -> DataFrame:
    """Box averages down to a longest side: each source pixel belongs to the boxes that cover it (one, as boxes don't overlap)."""
    shape = sizes(pixels).withColumn("l", F.greatest("w", "h"))
    shape = shape.withColumn("f", F.lit(float(longest)) / F.col("l"))
    side = lambda c: F.when(F.col("l") <= longest, F.col(c)).otherwise(F.greatest(F.floor(F.col(c) * F.col("f")), F.lit(1)))
    shape = shape.select("page_id", "w", "h", side("w").cast("int").alias("dw"), side("h").cast("int").alias("dh"))
    # The box d of a line of n covers floor(d n / m) up to floor((d + 1) n / m): source s is in box ceil((s + 1) m / n) - 1.
    box = lambda s, m, n: (F.ceil((F.col(s) + 1) * F.col(m) / F.col(n)) - 1).cast("int")
    return pixels.join(shape, "page_id").groupBy("page_id", box("y", "dh", "h").alias("y"), box("x", "dw", "w").alias("x")).agg(F.floor(F.sum("v") / F.count("*")).cast("int").alias("v"))


def integral(pixels: DataFrame) -> DataFrame:
    """Summed-area tables (s, q) of values and squares, by two running sums."""
    row = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v").cast("long")
    across = pixels.withColumn("_s", F.sum(v).over(row)).withColumn("_q", F.sum(v * v).over(row))
    return across.select("page_id", "y", "x", F.sum("_s").over(column).alias("s"), F.sum("_q").over(column).alias("q"))


def window_size(w: Column, h: Column, requested: int = 0) -> Column:
    base = F.lit(requested) if requested > 0 else F.floor(F.greatest(w, h) / 40)
    base = F.greatest(base, F.lit(3))
    return (base + F.when(base % 2 == 0, 1).otherwise(0)).cast("int")


def window_stats(pixels: DataFrame, window: int) -> DataFrame:
    """(page_id, y, x, v, mean, std) over a square around each pixel, cut at the border.

    Moments are separable: sums along rows, then along columns, by frames of rows.
    """
    r = window // 2
    row = Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(-r, r)
    column = Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(-r, r)
    v = F.col("v").cast("long")
    across = pixels.withColumn("_n", F.count("*").over(row)).withColumn("_s", F.sum(v).over(row)).withColumn("_q", F.sum(v * v).over(row))
    down = across.withColumn("_n", F.sum("_n").over(column)).withColumn("_s", F.sum("_s").over(column)).withColumn("_q", F.sum("_q").over(column))
    mean = F.col("_s") / F.col("_n")
    return down.select("page_id", "y", "x", "v", mean.alias("mean"), F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("std"))


def sauvola(pixels: DataFrame, window: int, k: float = SAUVOLA_K) -> DataFrame:
    limit = F.col("mean") * (1 + k * (F.col("std") / SAUVOLA_R - 1))
    return window_stats(pixels, window).select("page_id", "y", "x", F.when(F.col("v") <= limit, 0).otherwise(255).alias("v"))


def histogram(pixels: DataFrame) -> DataFrame:
    """(page_id, v, n) on the full spine of 0 to 255."""
    counts = pixels.groupBy("page_id", "v").agg(F.count("*").alias("n"))
    spine = counts.select("page_id").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return spine.join(counts.withColumn("v", F.col("v").cast("int")), ["page_id", "v"], "left").fillna(0, ["n"])


def otsu(pixels: DataFrame) -> DataFrame:
    """(page_id, threshold): the first greatest variance between the classes; 127 if there is one class."""
    page = Window.partitionBy("page_id")
    upto = page.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(pixels).withColumn("wb", F.sum("n").over(upto).cast("double")).withColumn("sb", F.sum(F.col("v") * F.col("n")).over(upto).cast("double"))
    h = h.withColumn("w", F.sum("n").over(page).cast("double")).withColumn("s", F.sum(F.col("v") * F.col("n")).over(page).cast("double"))
    split = (F.col("wb") > 0) & (F.col("wb") < F.col("w"))
    gap = F.try_divide(F.col("sb"), F.col("wb")) - F.try_divide(F.col("s") - F.col("sb"), F.col("w") - F.col("wb"))
    between = F.when(split, F.col("wb") * (F.col("w") - F.col("wb")) * gap * gap)
    first_best = F.max(F.when(F.col("between").isNotNull(), F.struct("between", (-F.col("v")).alias("t"))))
    best = h.withColumn("between", between).groupBy("page_id").agg(first_best.alias("m"))
    return best.select("page_id", F.coalesce(-F.col("m.t"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def valley(pixels: DataFrame) -> DataFrame:
    """(page_id, threshold): the lowest place between the two highest peaks of the smoothed histogram; else Otsu's."""
    near = Window.partitionBy("page_id").orderBy("v").rowsBetween(-SMOOTH_REACH, SMOOTH_REACH)
    h = histogram(pixels).withColumn("n", F.col("n").cast("double"))
    for _ in range(SMOOTH_PASSES):
        h = h.withColumn("n", F.avg("n").over(near))
    highest = F.max(F.struct("n", (-F.col("v")).alias("t")))
    first = h.groupBy("page_id").agg(highest.alias("m")).select("page_id", F.col("m.n").alias("n1"), (-F.col("m.t")).alias("p1"))
    both = h.join(first, "page_id")
    far = F.abs(F.col("v") - F.col("p1")) >= MIN_SEPARATION
    second = both.filter(far).groupBy("page_id", "n1", "p1").agg(highest.alias("m")).select("page_id", "n1", "p1", F.col("m.n").alias("n2"), (-F.col("m.t")).alias("p2"))
    second = second.filter((F.col("n2") > 0) & (F.col("n2") >= MIN_PEAK_SHARE * F.col("n1")))
    between = h.join(second, "page_id").filter(F.col("v").between(F.least("p1", "p2"), F.greatest("p1", "p2")))
    lowest = between.groupBy("page_id").agg(F.min(F.struct("n", "v")).alias("m")).select("page_id", F.col("m.v").alias("low"))
    return otsu(pixels).join(lowest, "page_id", "left").select("page_id", F.coalesce("low", "threshold").alias("threshold"))


def ink_fraction(pixels: DataFrame, threshold: int = INK) -> DataFrame:
    return pixels.groupBy("page_id").agg(F.avg(F.when(F.col("v") <= threshold, 1.0).otherwise(0.0)).alias("ink"))


def skew_scores(binary: DataFrame, angles: list[float]) -> DataFrame:
    """(page_id, angle, score): ink rows of the turned page, squared first differences of their counts.

    Ink meets the angles by an explode of a fixed list, and is counted by row before anything else moves.
    """
    table = F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(math.sin(math.radians(a))).alias("s"), F.lit(math.cos(math.radians(a))).alias("c")) for a in angles])
    ink = binary.join(sizes(binary), "page_id").filter(F.col("v") < INK).withColumn("a", F.explode(table)).select("page_id", "w", "h", "x", "y", "a.*")
    half = lambda c: F.floor(F.col(c) / 2)
    span = F.floor(F.abs(F.col("w") * F.col("s")) + F.abs(F.col("h") * F.col("c"))) + 2
    place = -(F.col("x") - half("w")) * F.col("s") + (F.col("y") - half("h")) * F.col("c") + F.floor(span / 2) + 0.5
    # Towards zero, as a cast does.
    bins = ink.withColumn("span", span).withColumn("bin", F.when(place < 0, F.ceil(place)).otherwise(F.floor(place))).filter((F.col("bin") >= 0) & (F.col("bin") < F.col("span")))
    counts = bins.groupBy("page_id", "angle", "span", "bin").agg(F.count("*").alias("n"))
    # On a spine without gaps the sum of (p[i] - p[i-1])**2 is sum p**2 twice (less the ends) minus twice sum p[i] p[i-1].
    order = Window.partitionBy("page_id", "angle").orderBy("bin")
    before = F.when(F.lag("bin").over(order) == F.col("bin") - 1, F.lag("n").over(order)).otherwise(0)
    each = counts.withColumn("b", before)
    ends = F.when(F.col("bin") == 0, 1).otherwise(2) - F.when(F.col("bin") == F.col("span") - 1, 1).otherwise(0)
    return each.groupBy("page_id", "angle").agg((F.sum(ends * F.col("n") * F.col("n")) - 2 * F.sum(F.col("n") * F.col("b"))).cast("double").alias("score"))


def coarse_angles(limit: float = 10.0, step: float = 0.25) -> list[float]:
    return [-limit + i * step for i in range(int(2 * limit / step) + 1)]


def best_skew(binary: DataFrame, limit: float = 10.0) -> DataFrame:
    """(page_id, angle): the first best of the coarse sweep; pages with little ink are left out."""
    enough = binary.groupBy("page_id").agg(F.count_if(F.col("v") < INK).alias("ink"), F.count("*").alias("n")).filter("ink >= 200 and ink >= 0.0005D * n").select("page_id")
    scores = skew_scores(binary.join(enough, "page_id", "left_semi"), coarse_angles(limit))
    return scores.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("m")).select("page_id", (-F.col("m.a")).alias("angle"))


def hough_votes(binary: DataFrame, max_angle: float = 6.0, step: float = 0.5, min_fill: float = 0.75) -> DataFrame:
    """(page_id, t, c, votes): cells of angle and intercept with at least min_length * min_fill ink pixels; a border of 2 % doesn't vote."""
    n = int(2 * max_angle / step) + 1
    slopes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(math.tan(math.radians(-max_angle + t * step))).alias("slope")) for t in range(n)])
    edge = lambda c: F.floor(F.col(c) / 50) + 1
    inner = (F.col("x") >= edge("w")) & (F.col("x") < F.col("w") - edge("w")) & (F.col("y") >= edge("h")) & (F.col("y") < F.col("h") - edge("h"))
    ink = binary.join(sizes(binary), "page_id").filter((F.col("v") < INK) & inner).withColumn("a", F.explode(slopes))
    margin = F.floor(F.col("w") * math.tan(math.radians(max_angle))) + 2
    raw = F.col("y") - F.col("a.slope") * F.col("x") + 0.5
    cell = F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw)) + margin
    voted = ink.select("page_id", "w", "h", margin.alias("margin"), F.col("a.t").alias("t"), cell.alias("c")).filter((F.col("c") >= 0) & (F.col("c") < F.col("h") + 2 * F.col("margin")))
    least = F.floor(F.greatest(F.floor(F.col("w") / 15), F.lit(24)) * min_fill)
    return voted.groupBy("page_id", "t", "c", "w").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least).select("page_id", "t", "c", "votes")


def line_params(w: Column, h: Column) -> Column:
    """Struct of the defaults that depend on the size."""
    thick = F.least(F.greatest(F.floor(h / 150), F.lit(3)), F.lit(14))
    return F.struct(F.greatest(F.floor(w / 15), F.lit(24)).cast("int").alias("min_length"), thick.cast("int").alias("max_thickness"))


def homography_apply(h: list[Column], x: Column, y: Column) -> Column:
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) < 1e-12, 1e-12).otherwise(w)
    return F.struct(((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y"))


def quad_area(x: list[Column], y: list[Column]) -> Column:
    twice = sum((x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)), F.lit(0.0))
    return F.abs(twice) / 2


def quad_output_size(x: list[Column], y: list[Column]) -> Column:
    """Struct (w, h): the longer of opposite edges, rounded, at least 1."""
    edge = lambda i, j: F.sqrt((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]))
    side = lambda a, b: F.greatest(F.floor(F.greatest(a, b) + 0.5), F.lit(1)).cast("int")
    return F.struct(side(edge(0, 1), edge(3, 2)).alias("w"), side(edge(0, 3), edge(1, 2)).alias("h"))
