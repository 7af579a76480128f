"""Recognition results: provider JSON to words, recorded results, and a deterministic mock."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: Fixed values of the mock: shape confusions in the order of their number, page geometry, second stream.
MOCK_CONFUSIONS = [("m", "rn"), ("S", "5"), ("cl", "d"), ("a", "o"), ("i", "l"), ("n", "h"), ("t", "f"), ("e", "c")]
ORIGIN_X, ORIGIN_Y, LINE_PITCH, CHAR_WIDTH, WORD_HEIGHT = 60.0, 80.0, 46.0, 11.0, 28.0
SECOND_STREAM = 0x5BD1E9955BD1E995


def box(points: Column) -> Column:
    """Extent of an array of (x, y); missing coordinates are 0, no points a box of zeros."""
    value = lambda f, c: F.coalesce(f(F.transform(points, lambda p: F.coalesce(p[c], F.lit(0.0)))), F.lit(0.0))
    return F.struct(value(F.array_min, "x").alias("x0"), value(F.array_min, "y").alias("y0"), value(F.array_max, "x").alias("x1"), value(F.array_max, "y").alias("y1"))


def _numbered(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.select(*keys, "ord", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence"), "w.box.*")


def vision_words(pages: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """(keys, ord, text, confidence, x0..y1) of the first response: symbols joined; a missing confidence is the symbols' mean."""
    parsed = pages.select(*keys, F.get(F.from_json(json, schemas.VISION)["responses"], F.lit(0)).alias("r"))

    def word(w: Column) -> Column:
        symbols = F.coalesce(w["symbols"], F.array().cast("array<struct<text:string,confidence:double>>"))
        mean = F.try_divide(F.aggregate(symbols, F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"], F.lit(0.0))), F.size(symbols))
        given = F.coalesce(w["confidence"], F.lit(0.0))
        text = F.array_join(F.transform(symbols, lambda x: F.coalesce(x["text"], F.lit(""))), "")
        return F.struct(text.alias("text"), F.when(given == 0, F.coalesce(mean, F.lit(0.0))).otherwise(given).alias("confidence"), box(w["boundingBox"]["vertices"]).alias("box"))

    def listed(c: Column, kind: str) -> Column:
        return F.when(c.isNotNull(), c).otherwise(F.array().cast(kind))

    one = "struct<confidence:double,boundingBox:struct<vertices:array<struct<x:double,y:double>>>,symbols:array<struct<text:string,confidence:double>>>"
    para, block = f"struct<words:array<{one}>>", f"struct<paragraphs:array<struct<words:array<{one}>>>>"
    page = f"struct<blocks:array<{block}>>"
    words = F.flatten(F.transform(listed(F.col("r.fullTextAnnotation.pages"), f"array<{page}>"), lambda p: F.flatten(F.transform(listed(p["blocks"], f"array<{block}>"), lambda b: F.flatten(F.transform(listed(b["paragraphs"], f"array<{para}>"), lambda g: F.transform(listed(g["words"], f"array<{one}>"), word)))))))
    return _numbered(parsed.filter("r.error is null").select(*keys, F.posexplode(words).alias("ord", "w")), list(keys))


def provider_errors(pages: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """(keys, error) of pages whose reply holds an error or nothing at all."""
    r = pages.select(*keys, F.from_json(json, schemas.VISION)["responses"].alias("all"))
    first = F.get("all", F.lit(0))
    message = F.when(F.coalesce(F.size("all"), F.lit(0)) <= 0, "empty response").otherwise(first["error"]["message"])
    return r.select(*keys, message.alias("error")).filter("error is not null")


def read_words(pages: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """(keys, ord, text, confidence, x0..y1) of a blocks, lines, words reply with polygons."""
    parsed = pages.select(*keys, F.from_json(json, schemas.READ).alias("r")).filter("r.error is null")
    word = lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"), box(w["boundingPolygon"]).alias("box"))
    blocks = F.filter(F.col("r.readResult.blocks"), lambda b: b["lines"].isNotNull())
    words = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(F.filter(b["lines"], lambda line: line["words"].isNotNull()), lambda line: F.transform(line["words"], word)))))
    return _numbered(parsed.select(*keys, F.posexplode(words).alias("ord", "w")), list(keys))


def recorded_words(results: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """Words of recorded results: ``{"words": [...]}`` with flat boxes."""
    words = F.from_json(json, f"words array<{schemas.WORD}>")["words"]
    return results.select(*keys, F.posexplode(words).alias("ord", "w")).select(*keys, "ord", "w.*")


def metadata(reports: DataFrame, json: str = "json") -> DataFrame:
    """Fields of a preprocess report; without rules an empty array."""
    parsed = reports.withColumn("_m", F.from_json(json, schemas.METADATA)).select(*[c for c in reports.columns if c != json], "_m.*")
    return parsed.withColumn("rules", F.coalesce("rules", F.array().cast(f"array<{schemas.RULE}>")))


class SplitMix:
    """A small generator of 64-bit numbers from a 64-bit state."""

    MASK = (1 << 64) - 1

    def __init__(self, state: int):
        self.state = state & self.MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & self.MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & self.MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & self.MASK
        return z ^ (z >> 31)

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)


def _misread(word: str, rng: SplitMix) -> str:
    for _ in MOCK_CONFUSIONS:
        old, new = MOCK_CONFUSIONS[rng.next() % len(MOCK_CONFUSIONS)]
        if old in word:
            return word.replace(old, new, 1)
    return word


def mock_words(image: bytes, lines: list[str]) -> list[dict]:
    """The same bytes give the same words: one in five misread, a quarter of those with high confidence."""
    seed = int.from_bytes(hashlib.sha256(image).digest()[:8], "little")
    rng, other = SplitMix(seed), SplitMix(seed ^ SECOND_STREAM)
    out = []
    for n, line in enumerate(lines):
        x, y = ORIGIN_X, ORIGIN_Y + n * LINE_PITCH
        for word in line.split():
            text, conf, alternatives = word, 0.90 + rng.unit() * 0.09, []
            if rng.unit() < 0.20:
                text = _misread(word, rng)
                conf = 0.88 + rng.unit() * 0.09 if rng.unit() < 0.25 else 0.30 + rng.unit() * 0.45
                if text != word:
                    spare = 1 - conf
                    if other.unit() < 0.6:
                        alternatives.append({"text": word, "confidence": min(spare * (0.3 + 0.5 * other.unit()), 0.9 * conf)})
                    more = _misread(word, other)
                    if more not in (text, word):
                        alternatives.append({"text": more, "confidence": min(0.2 * spare * other.unit(), 0.9 * conf)})
            width = len(text.encode()) * CHAR_WIDTH
            out.append({"text": text, "confidence": conf, "x0": x, "y0": y, "x1": x + width, "y1": y + WORD_HEIGHT, "alternatives": alternatives})
            x += width + CHAR_WIDTH
    return out


def mock_recognise(pages: DataFrame, image: str = "image", text: str = "text", *keys: str) -> DataFrame:
    """(keys, ord, text, confidence, box, alternatives) by the mock, with the page's own text as what was written."""

    @F.pandas_udf(f"array<{schemas.WORD}>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for images, texts in batches:
            yield pd.Series([mock_words(bytes(i), (t or "").split("\n")) for i, t in zip(images, texts, strict=True)])

    return pages.select(*keys, F.posexplode(read(image, text)).alias("ord", "w")).select(*keys, "ord", "w.*")


PROVIDERS = {"google": vision_words, "azure": read_words, "replay": recorded_words, "mock": mock_recognise}


def provider(name: str):
    """By name; an empty name is the mock; an unknown one raises."""
    try:
        return PROVIDERS[name or "mock"]
    except KeyError:
        raise ValueError(f"unknown provider {name!r}") from None
