"""Queries over page images as long tables: a page for each region, its pixels by an arithmetic pattern."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import image
from ..operators import image_arrays as arrays
from .common import register, table

W, H = 60, 40
_GRID = f"regions AS (SELECT r_regionkey AS page_id FROM region), pixels AS (SELECT page_id, y::INT AS y, x::INT AS x, ((7 * x + 13 * y + 31 * page_id) % 256)::INT AS v FROM regions, range({H}) AS a(y), range({W}) AS b(x))"
BW, BH = 420, 300
_INK = f"regions AS (SELECT r_regionkey AS page_id FROM region), binary_ AS (SELECT page_id, y::INT AS y, x::INT AS x, (CASE WHEN (y + x // 20 + page_id) % 12 < 3 AND x % 7 <> 0 THEN 0 ELSE 255 END)::INT AS v FROM regions, range({BH}) AS a(y), range({BW}) AS b(x))"


def _spread(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    pages = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page_id"))
    return pages.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, W, H).withColumn("v", (7 * F.col("x") + 13 * F.col("y") + 31 * F.col("page_id")) % 256)


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = ((F.col("y") + F.floor(F.col("x") / 20) + F.col("page_id")) % 12 < 3) & (F.col("x") % 7 != 0)
    return _spread(spark, sf_dir, BW, BH).withColumn("v", F.when(ink, 0).otherwise(255))


@register(f"""WITH {_GRID} SELECT page_id, y, x, (sum(s) OVER (PARTITION BY page_id, x ORDER BY y))::BIGINT AS s, (sum(q) OVER (PARTITION BY page_id, x ORDER BY y))::BIGINT AS q FROM (
  SELECT page_id, y, x, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM pixels WINDOW w AS (PARTITION BY page_id, y ORDER BY x))""")
def integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.integral(pixels(spark, sf_dir))


_STATS = """stats AS (SELECT a.page_id, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS mean, sqrt(greatest(avg(b.v * b.v) - avg(b.v) * avg(b.v), 0.0)) AS std
  FROM pixels a JOIN pixels b ON a.page_id = b.page_id AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 GROUP BY ALL)"""


@register(f"WITH {_GRID}, {_STATS.replace('any_value(a.v) AS v', 'any_value(a.v)::INT AS v')} SELECT page_id, y, x, v, round(mean, 6) AS mean, round(std, 6) AS std FROM stats".replace("GROUP BY ALL)", "GROUP BY a.page_id, a.y, a.x)"))
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.window_stats(pixels(spark, sf_dir), 9).select("page_id", "y", "x", "v", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register(f"WITH {_GRID}, {_STATS} SELECT page_id, y, x, CASE WHEN v <= mean * (1 + 0.34::DOUBLE * (std / 128.0::DOUBLE - 1)) THEN 0 ELSE 255 END AS v FROM stats".replace("GROUP BY ALL)", "GROUP BY a.page_id, a.y, a.x)"))
def sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.sauvola(pixels(spark, sf_dir), 9)


_HIST = "hist AS (SELECT r.page_id, t.v::INT AS v, (SELECT count(*) FROM shade p WHERE p.page_id = r.page_id AND p.v = t.v)::DOUBLE AS n FROM regions r, range(256) AS t(v))"
_SHADE = "shade AS (SELECT page_id, y, x, CASE WHEN x < 20 + 3 * page_id THEN 40 + v % 17 ELSE 200 + v % 31 END AS v FROM pixels)"
_OTSU = """cum AS (SELECT page_id, v, sum(n) OVER o AS wb, sum(n * v) OVER o AS sb, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * v) OVER (PARTITION BY page_id) AS s FROM hist WINDOW o AS (PARTITION BY page_id ORDER BY v)),
otsu AS (SELECT page_id, arg_max(v, (b, -v)) AS threshold FROM (SELECT page_id, v, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS b FROM cum WHERE wb > 0 AND wb < w) GROUP BY page_id)"""


def shaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("x") < 20 + 3 * F.col("page_id"), 40 + F.col("v") % 17).otherwise(200 + F.col("v") % 31)
    return pixels(spark, sf_dir).withColumn("v", v)


@register(f"WITH {_GRID}, {_SHADE}, {_HIST}, {_OTSU} SELECT page_id, threshold FROM otsu")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.otsu(shaded(spark, sf_dir))


def _smooth(name: str, source: str) -> str:
    return f"{name} AS (SELECT page_id, v, avg(n) OVER (PARTITION BY page_id ORDER BY v ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS n FROM {source})"


@register(f"""WITH {_GRID}, {_SHADE}, {_HIST}, {_OTSU}, {_smooth('s1', 'hist')}, {_smooth('s2', 's1')}, {_smooth('s3', 's2')},
  f AS (SELECT page_id, arg_max(v, (n, -v)) AS p1, max(n) AS n1 FROM s3 GROUP BY page_id),
  g AS (SELECT page_id, any_value(p1) AS p1, any_value(n1) AS n1, arg_max(v, (n, -v)) AS p2, max(n) AS n2 FROM s3 JOIN f USING (page_id) WHERE abs(v - p1) >= 40 GROUP BY page_id),
  l AS (SELECT page_id, arg_min(v, (n, v)) AS low FROM s3 JOIN g USING (page_id) WHERE n2 > 0 AND n2 >= 0.01::DOUBLE * n1 AND v BETWEEN least(p1, p2) AND greatest(p1, p2) GROUP BY page_id)
  SELECT o.page_id, coalesce(low, threshold) AS threshold FROM otsu o LEFT JOIN l USING (page_id)""")
def valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.valley(shaded(spark, sf_dir))


@register(f"""WITH {_GRID}, boxes AS (SELECT page_id, dx, dy, (dx * {W}) // 25 AS x0, ((dx + 1) * {W}) // 25 AS x1, (dy * {H}) // 16 AS y0, ((dy + 1) * {H}) // 16 AS y1 FROM regions, range(25) AS a(dx), range(16) AS b(dy))
  SELECT b.page_id, dy::INT AS y, dx::INT AS x, (sum(v) // count(*))::INT AS v FROM boxes b JOIN pixels p ON p.page_id = b.page_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY b.page_id, dx, dy""")
def downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.downscale(pixels(spark, sf_dir), 25)


@register(f"WITH {_GRID} SELECT page_id, round(avg(CASE WHEN v <= 128 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS ink FROM pixels GROUP BY page_id")
def ink_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.ink_fraction(pixels(spark, sf_dir)).withColumn("ink", F.round("ink", 9))


_POINTS = "points AS (SELECT page_id, i, -1.0::DOUBLE + i * 0.77::DOUBLE AS px, -0.9::DOUBLE + i * 0.53::DOUBLE AS py FROM regions, range(80) AS t(i))"


@register(f"""WITH {_GRID}, {_POINTS}, c AS (SELECT page_id, px, py, px > -0.5 AND py > -0.5 AND px < {W} - 0.5 AND py < {H} - 0.5 AS inside, floor(px)::INT AS x0, floor(py)::INT AS y0, px - floor(px) AS fx, py - floor(py) AS fy FROM points),
  v AS (SELECT c.*, (SELECT p.v FROM pixels p WHERE p.page_id = c.page_id AND p.x = least(greatest(x0, 0), {W - 1}) AND p.y = least(greatest(y0, 0), {H - 1})) AS v00,
    (SELECT p.v FROM pixels p WHERE p.page_id = c.page_id AND p.x = least(greatest(x0 + 1, 0), {W - 1}) AND p.y = least(greatest(y0, 0), {H - 1})) AS v10,
    (SELECT p.v FROM pixels p WHERE p.page_id = c.page_id AND p.x = least(greatest(x0, 0), {W - 1}) AND p.y = least(greatest(y0 + 1, 0), {H - 1})) AS v01,
    (SELECT p.v FROM pixels p WHERE p.page_id = c.page_id AND p.x = least(greatest(x0 + 1, 0), {W - 1}) AND p.y = least(greatest(y0 + 1, 0), {H - 1})) AS v11 FROM c)
  SELECT page_id, round(px, 6) AS px, round(py, 6) AS py, CASE WHEN inside THEN round((v00 * (1 - fx) + v10 * fx) * (1 - fy) + (v01 * (1 - fx) + v11 * fx) * fy, 6) ELSE 255.0::DOUBLE END AS v FROM v""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("page_id"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("i"))
    points = points.select("page_id", (-1.0 + F.col("i") * 0.77).alias("px"), (-0.9 + F.col("i") * 0.53).alias("py"))
    return image.sample(points, pixels(spark, sf_dir), 255, exact=True).select("page_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), F.round("v", 6).alias("v"))


_ANGLES = [-2.0, -0.5, 0.0, 0.5, 2.0]


@register(f"""WITH {_INK}, angles AS (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in _ANGLES)}]) AS angle, unnest([{', '.join(f'{math.sin(math.radians(a))!r}::DOUBLE' for a in _ANGLES)}]) AS s, unnest([{', '.join(f'{math.cos(math.radians(a))!r}::DOUBLE' for a in _ANGLES)}]) AS c),
  spans AS (SELECT *, (floor(abs({BW} * s) + abs({BH} * c)) + 2)::INT AS span FROM angles),
  counted AS (SELECT page_id, angle, trunc(-(x - {BW // 2}) * s + (y - {BH // 2}) * c + span // 2 + 0.5::DOUBLE)::INT AS bin, count(*) AS n FROM binary_, spans WHERE v < 128 GROUP BY ALL),
  spine AS (SELECT page_id, angle, bin FROM regions, spans, unnest(range(span)) AS t(bin)),
  full_ AS (SELECT s.page_id, s.angle, s.bin, coalesce(n, 0) AS n FROM spine s LEFT JOIN counted k ON k.page_id = s.page_id AND k.angle = s.angle AND k.bin = s.bin),
  d AS (SELECT page_id, angle, n - lag(n) OVER (PARTITION BY page_id, angle ORDER BY bin) AS d FROM full_)
  SELECT page_id, angle, sum(d * d)::DOUBLE AS score FROM d GROUP BY ALL""")
def skew_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.skew_scores(binary(spark, sf_dir), _ANGLES)


@register()
def skew_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.best_skew(binary(spark, sf_dir))


_SLOPES = ", ".join(f"{math.tan(math.radians(-6.0 + t * 0.5))!r}::DOUBLE" for t in range(25))
_MARGIN = int(BW * math.tan(math.radians(6.0))) + 2


@register(f"""WITH {_INK}, slopes AS (SELECT unnest([{_SLOPES}]) AS slope, unnest(range(25)) AS t)
  SELECT page_id, t::INT AS t, c, votes FROM (SELECT page_id, t, (trunc(y - slope * x + 0.5::DOUBLE) + {_MARGIN})::BIGINT AS c, count(*)::BIGINT AS votes FROM binary_, slopes
    WHERE v < 128 AND x >= {BW // 50 + 1} AND x < {BW - BW // 50 - 1} AND y >= {BH // 50 + 1} AND y < {BH - BH // 50 - 1} GROUP BY ALL)
  WHERE c >= 0 AND c < {BH + 2 * _MARGIN} AND votes >= {int(max(24, BW // 15) * 0.75)}""")
def hough_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.hough_votes(binary(spark, sf_dir))


_H = [1.1, 0.02, -3.0, -0.04, 0.95, 2.0, 0.0005, -0.0003, 1.0]


@register(f"""SELECT l_orderkey, l_linenumber, round(({_H[0]} * x + {_H[1]} * y + {_H[2]}) / d, 6) AS x, round(({_H[3]} * x + {_H[4]} * y + {_H[5]}) / d, 6) AS y FROM (
  SELECT *, {_H[6]:f}::DOUBLE * x + {_H[7]:f}::DOUBLE * y + {_H[8]} AS d FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y FROM lineitem))""")
def homography_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = image.homography_apply([F.lit(v) for v in _H], F.col("l_quantity"), F.col("l_discount") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@register("""SELECT l_orderkey, l_linenumber, round(abs((10 * (5 + b) - (200 + a) * 8) + ((200 + a) * (300 - b) - 190 * (5 + b)) + (190 * 310 - 12 * (300 - b)) + (12 * 8 - 10 * 310)) / 2, 6) AS area,
  greatest(floor(greatest(sqrt((190 + a) * (190 + a) + (b - 3) * (b - 3)), sqrt(178 * 178 + (10 + b) * (10 + b))) + 0.5), 1)::INT AS w,
  greatest(floor(greatest(sqrt(4 + 302.0 * 302.0), sqrt((10 + a) * (10 + a) + (295 - 2 * b) * (295 - 2 * b))) + 0.5), 1)::INT AS h
  FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount * 100 AS b FROM lineitem)""")
def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_discount") * 100
    x, y = [F.lit(10.0), 200 + a, F.lit(190.0), F.lit(12.0)], [F.lit(8.0), 5 + b, 300 - b, F.lit(310.0)]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(image.quad_area(x, y), 6).alias("area"), image.quad_output_size(x, y).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "area", "s.w", "s.h")


@register("""SELECT l_orderkey, l_linenumber, n + (CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) AS sauvola, greatest(w // 15, 24)::INT AS min_length, least(greatest(h // 150, 3), 14)::INT AS max_thickness FROM (
  SELECT l_orderkey, l_linenumber, w, h, greatest(greatest(w, h) // 40, 3)::INT AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey AS w, l_suppkey * 20 AS h FROM lineitem))""")
def page_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("l_partkey"), F.col("l_suppkey") * 20
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", image.window_size(w, h).alias("sauvola"), image.line_params(w, h).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "sauvola", "p.min_length", "p.max_thickness")


def synthetic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated page image for each nation, with a skew of -3 to 3 degrees; every third has a struck word."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            for key in batch.column(0).to_pylist():
                page, _ = arrays.synthetic_page(500, 640, lines=9, margin=40, skew=float(key % 7 - 3), seed=key, strike=key % 3 == 0)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([page.shape[1]], pa.int32()), pa.array([page.shape[0]], pa.int32()), pa.array([page.tobytes()], pa.binary())], names=["page_id", "w", "h", "gray"])

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long")).mapInArrow(make, "page_id long, w int, h int, gray binary")


@register()
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = arrays.clean_pages(synthetic_pages(spark, sf_dir))
    return done.select("page_id", "width", "height", "perspective_applied", "deskew_applied", F.round("rotation_deg", 2).alias("rotation_deg"), "window", F.size("rules").alias("n_rules"), F.sha2("cleaned", 256).alias("png_sha256"))
