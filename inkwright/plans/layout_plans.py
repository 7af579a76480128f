"""Queries over layout and provider replies: each conversation turn is a page of word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..operators import layout
from ..sources import providers
from .common import register, table

#: Places follow from the text: lines 46 apart, 11 a character, heights from 24 to 30, a wider gap before every fifth line, some shift by word length.
_LINE, _X, _H = 46.0, 11.0, 24.0


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, text, confidence, x0, y0, x1, y1) of all words of all turns."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), split_words(F.col("text")).alias("w"))
    words = turns.select("page_id", F.posexplode("w").alias("ord", "text"))
    line, slot = F.floor(F.col("ord") / 8), F.col("ord") % 8
    x0 = 60.0 + slot * 110.0
    y0 = 80.0 + line * _LINE + F.floor(line / 5) * 60.0 + F.length("text") % 5
    rows = words.select("page_id", F.col("ord").cast("long").alias("ord"), "text", F.lit(0.9).alias("confidence"), x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + F.length("text") * _X).alias("x1"), (y0 + _H + F.length("text") % 7).cast("double").alias("y1"))
    return rows


_BOXES = """_w AS (SELECT conv_id * 1000 + turn AS page_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
_o AS (SELECT page_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS ord FROM _w),
_b AS (SELECT page_id, ord, text, 60.0::DOUBLE + (ord % 8) * 110.0::DOUBLE AS x0, 80.0::DOUBLE + (ord // 8) * 46.0::DOUBLE + (ord // 8 // 5) * 60.0::DOUBLE + length(text) % 5 AS y0 FROM _o),
boxes AS (SELECT page_id, ord, text, x0, y0, x0 + length(text) * 11.0::DOUBLE AS x1, y0 + 24.0::DOUBLE + length(text) % 7 AS y1 FROM _b),
heights AS (SELECT page_id, h[len(h) // 2 + 1] AS height FROM (SELECT page_id, list_sort(list(y1 - y0)) AS h FROM boxes GROUP BY page_id))"""

#: CTEs up to ``placed``: the fold over sorted words as a recursion, a word of each page a step.
_LINES = f"""{_BOXES},
_s AS (SELECT b.*, height, (y0 + y1) / 2 AS mid, row_number() OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, ord) AS r FROM boxes b JOIN heights USING (page_id)),
_fold AS (SELECT page_id, ord, r, 0 AS line, y0 AS top, y1 AS bottom FROM _s WHERE r = 1
  UNION ALL SELECT s.page_id, s.ord, s.r, CASE WHEN abs(s.mid - (f.top + f.bottom) / 2) <= 0.6::DOUBLE * s.height THEN f.line ELSE f.line + 1 END,
    CASE WHEN abs(s.mid - (f.top + f.bottom) / 2) <= 0.6::DOUBLE * s.height THEN least(f.top, s.y0) ELSE s.y0 END,
    CASE WHEN abs(s.mid - (f.top + f.bottom) / 2) <= 0.6::DOUBLE * s.height THEN greatest(f.bottom, s.y1) ELSE s.y1 END
  FROM _fold f JOIN _s s ON s.page_id = f.page_id AND s.r = f.r + 1),
placed AS (SELECT b.*, line AS line_index, row_number() OVER (PARTITION BY b.page_id, line ORDER BY x0, b.ord) - 1 AS line_order FROM boxes b JOIN _fold f ON b.page_id = f.page_id AND b.ord = f.ord),
_lb AS (SELECT page_id, line_index, min(y0) AS top, max(y1) AS bottom FROM placed GROUP BY ALL),
_g AS (SELECT *, top - lag(bottom) OVER (PARTITION BY page_id ORDER BY line_index) AS gap FROM _lb),
_q AS (SELECT page_id, 1.8::DOUBLE * CASE WHEN coalesce(q, 0) > 0 THEN q ELSE 0.4::DOUBLE * height END + 0.3::DOUBLE * height AS lim
  FROM (SELECT page_id, l[floor(len(l) * 0.25::DOUBLE)::INT + 1] AS q FROM (SELECT page_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM _g GROUP BY page_id)) JOIN heights USING (page_id)),
paras AS (SELECT page_id, line_index, top, bottom, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_index)::INT AS para_index FROM _g JOIN _q USING (page_id))"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_lines(boxes(spark, sf_dir))


def rules(words: DataFrame) -> DataFrame:
    """A stroke for each word whose place is 3 past a multiple of 7: through the middle, or below it, or half way."""
    some = words.filter("ord % 7 = 3")
    middle = (F.col("y0") + F.col("y1")) / 2
    y = F.when(F.col("ord") % 3 == 0, middle).when(F.col("ord") % 3 == 1, F.col("y1") + 3).otherwise(middle)
    x1 = F.when(F.col("ord") % 3 == 2, (F.col("x0") + F.col("x1")) / 2).otherwise(F.col("x1") + 2)
    return some.select("page_id", (F.col("x0") - 2).alias("x0"), (y - 1).alias("y0"), x1.alias("x1"), (y + 1).alias("y1"))


_RULES = """rules AS (SELECT page_id, x0 - 2 AS rx0, y - 1 AS ry0, CASE WHEN ord % 3 = 2 THEN (x0 + x1) / 2 ELSE x1 + 2 END AS rx1, y + 1 AS ry1 FROM (
  SELECT *, CASE ord % 3 WHEN 1 THEN y1 + 3 ELSE (y0 + y1) / 2 END AS y FROM boxes WHERE ord % 7 = 3)),
hits AS (SELECT DISTINCT b.page_id, b.ord FROM boxes b JOIN rules r USING (page_id) WHERE least(rx1, x1) - greatest(rx0, x0) >= 0.6::DOUBLE * (x1 - x0)
  AND abs(ry0 + CASE WHEN rx1 = rx0 THEN 0 ELSE (ry1 - ry0) / (rx1 - rx0) * ((x0 + x1) / 2 - rx0) END - (y0 + y1) / 2) <= 0.25::DOUBLE * (y1 - y0))"""


@register(f"WITH {_BOXES} SELECT page_id, round(height, 6) AS height FROM heights")
def median_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.median_heights(boxes(spark, sf_dir)).select("page_id", F.round("height", 6).alias("height"))


@register(f"WITH RECURSIVE {_LINES} SELECT page_id, ord, line_index::INT AS line_index, line_order::INT AS line_order FROM placed")
def line_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("page_id", "ord", "line_index", "line_order")


@register(f"WITH RECURSIVE {_LINES} SELECT page_id, line_index::INT AS line_index, para_index FROM paras")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = placed(spark, sf_dir)
    return layout.paragraphs(layout.line_boxes(words), layout.median_heights(words)).select("page_id", "line_index", "para_index")


@register(f"WITH {_BOXES}, {_RULES} SELECT b.page_id, b.ord, CASE WHEN h.ord IS NULL THEN text ELSE '' END AS text, text AS original, h.ord IS NOT NULL AS struck FROM boxes b LEFT JOIN hits h ON b.page_id = h.page_id AND b.ord = h.ord")
def strike_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes(spark, sf_dir)
    return layout.strike_out(words, rules(words)).select("page_id", "ord", "text", "original", "struck")


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes(spark, sf_dir)
    lines = layout.group_lines(words)
    paras = layout.paragraphs(layout.line_boxes(lines), layout.median_heights(words))
    return layout.assemble(layout.with_paragraphs(layout.strike_out(lines, rules(words)), paras))


_ASSEMBLED = f"""{_LINES}, {_RULES},
_t AS (SELECT p.page_id, p.ord, p.line_index, p.line_order, a.para_index, CASE WHEN h.ord IS NULL THEN text ELSE '' END AS text, h.ord IS NOT NULL AS struck
  FROM placed p JOIN paras a ON a.page_id = p.page_id AND a.line_index = p.line_index LEFT JOIN hits h ON h.page_id = p.page_id AND h.ord = p.ord),
_l AS (SELECT *, last_value(CASE WHEN text <> '' THEN line_index END IGNORE NULLS) OVER w AS l0, last_value(CASE WHEN text <> '' THEN para_index END IGNORE NULLS) OVER w AS p0 FROM _t
  WINDOW w AS (PARTITION BY page_id ORDER BY line_index, line_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
_p AS (SELECT *, CASE WHEN text = '' OR l0 IS NULL THEN '' WHEN p0 <> para_index THEN chr(10) || chr(10) WHEN l0 <> line_index THEN chr(10) ELSE ' ' END AS sep FROM _l),
assembled AS (SELECT *, row_number() OVER o - 1 AS idx, (sum(strlen(sep || text)) OVER o)::INT AS end_offset, (sum(length(sep || text)) OVER o)::INT AS char_end, sep || text AS piece FROM _p
  WINDOW o AS (PARTITION BY page_id ORDER BY line_index, line_order ROWS UNBOUNDED PRECEDING))"""


@register(f"WITH RECURSIVE {_ASSEMBLED} SELECT page_id, idx::INT AS idx, text, struck, end_offset - strlen(text)::INT AS start_offset, end_offset, char_end - length(text)::INT AS char_start, char_end FROM assembled")
def assemble_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir).select("page_id", F.col("idx").cast("int").alias("idx"), "text", "struck", "start_offset", "end_offset", "char_start", "char_end")


@register(f"WITH RECURSIVE {_ASSEMBLED} SELECT page_id, string_agg(piece, '' ORDER BY idx) AS text FROM assembled GROUP BY page_id")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(_assembled(spark, sf_dir))


@register(f"WITH RECURSIVE {_ASSEMBLED} SELECT page_id, ord, (row_number() OVER (PARTITION BY page_id ORDER BY line_index, line_order) - 1)::INT AS decode_index FROM assembled WHERE NOT struck")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_assembled(spark, sf_dir)).select("page_id", "ord", "decode_index")


_TIER = "CASE WHEN length(text) % 4 = 0 THEN 'red' WHEN length(text) % 4 = 1 THEN 'amber' ELSE 'none' END"


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 4
    return _assembled(spark, sf_dir).withColumn("tier", F.when(n == 0, "red").when(n == 1, "amber").otherwise("none"))


@register(f"WITH RECURSIVE {_ASSEMBLED} SELECT page_id, idx::INT AS idx, {_TIER} AS tier, end_offset FROM assembled WHERE {_TIER} <> 'none' AND NOT struck AND text <> ''")
def editor_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.spans(_tiered(spark, sf_dir)).select("page_id", F.col("idx").cast("int").alias("idx"), "tier", "end_offset")


@register(f"WITH RECURSIVE {_ASSEMBLED} SELECT page_id, count_if({_TIER} = 'red')::BIGINT AS red, count_if({_TIER} = 'amber')::BIGINT AS amber FROM assembled GROUP BY page_id")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tier_counts(_tiered(spark, sf_dir))


# --- provider replies: made from the boxes, then parsed -----------------------------------------


def _collected(words: DataFrame, item) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("w")))), lambda x: x["w"])
    return words.groupBy("page_id").agg(ordered.alias("words"))


def _corners() -> list:
    return [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]


@register(f"""WITH {_BOXES} SELECT page_id, ord::INT AS ord, text, round(CASE WHEN length(text) % 2 = 0 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END, 6) AS confidence, x0, y0, x1, y1 FROM boxes""")
def google_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes(spark, sf_dir)
    symbols = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("text"), F.when(i % 2 == 0, 0.6).otherwise(0.8).alias("confidence")))
    given = F.when(F.length("text") % 2 == 0, F.lit(None).cast("double")).otherwise(0.9)
    item = F.struct(given.alias("confidence"), F.struct(F.array(*_corners()).alias("vertices")).alias("boundingBox"), symbols.alias("symbols"))
    page = F.struct(F.array(F.struct(F.array(F.struct(F.col("words").alias("words"))).alias("paragraphs"))).alias("blocks"))
    reply = F.struct(F.array(F.struct(F.struct(F.lit("").alias("text"), F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses"))
    pages = _collected(words, item).select("page_id", F.to_json(reply).alias("json"))
    found = providers.vision_words(pages, "json", "page_id")
    return found.select("page_id", "ord", "text", F.round("confidence", 6).alias("confidence"), "x0", "y0", "x1", "y1")


@register(f"WITH {_BOXES} SELECT page_id, ord::INT AS ord, text, 0.9::DOUBLE AS confidence, x0, y0, x1, y1 FROM boxes")
def azure_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("text", "confidence", F.array(*_corners()).alias("boundingPolygon"))
    line = F.struct(F.lit("").alias("text"), F.col("words").alias("words"))
    reply = F.struct(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("blocks")).alias("readResult"))
    pages = _collected(boxes(spark, sf_dir), item).select("page_id", F.to_json(reply).alias("json"))
    return providers.read_words(pages, "json", "page_id")


@register(f"WITH {_BOXES} SELECT page_id, ord::INT AS ord, text, 0.9::DOUBLE AS confidence, x0, y0, x1, y1 FROM boxes")
def replay_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("text", "confidence", "x0", "y0", "x1", "y1")
    pages = _collected(boxes(spark, sf_dir), item).select("page_id", F.to_json(F.struct("words")).alias("json"))
    return providers.recorded_words(pages, "json", "page_id").drop("alternatives")


@register("""SELECT l_orderkey, l_linenumber, l_quantity AS angle_deg, l_discount AS ink_fraction, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS n_rules FROM lineitem""")
def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.array(F.struct(F.lit(1.0).alias("x0"), F.lit(2).alias("votes")))
    report = F.struct(F.col("l_discount").alias("ink_fraction"), F.struct(F.lit(True).alias("applied"), F.col("l_quantity").alias("angle_deg")).alias("deskew"), F.when(F.col("l_returnflag") != "A", rule).alias("rules"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(report).alias("json"))
    parsed = providers.metadata(rows)
    return parsed.select("l_orderkey", "l_linenumber", F.col("deskew.angle_deg").alias("angle_deg"), "ink_fraction", F.size("rules").alias("n_rules"))


@register()
def mock_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.col("text").cast("binary").alias("image"), "text")
    return providers.mock_recognise(turns, "image", "text", "page_id").select("page_id", "ord", "text", "confidence", F.size("alternatives").alias("n_alternatives"))
