"""Sources: uploads, page files, plain text, word lists, JSON lines, model tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import page_number

#: The formats that an upload may have.
IMAGE_TYPES = (".png", ".jpg", ".jpeg", ".bmp", ".tga")
PDF_MAGIC = "%PDF-"


def is_pdf(content: Column) -> Column:
    """Begins with the PDF signature (binary)."""
    return F.coalesce(F.substring(content, 1, 5) == F.lit(PDF_MAGIC).cast("binary"), F.lit(False))


def extension(name: Column) -> Column:
    """With its dot, in lower case; empty if the last part of the path has none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def upload_route(name: Column, content: Column) -> Column:
    """split for a PDF, the extension an image is stored under, or error."""
    ext = extension(name)
    return F.when(is_pdf(content), "split").when(ext == "", ".png").when(ext.isin(*IMAGE_TYPES), ext).otherwise("error")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "content", upload_route(F.col("path"), F.col("content")).alias("route"))


def pages_in_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Split pages by their number, then path."""
    return files.withColumn("page_number", page_number(F.col(path))).orderBy("page_number", path)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, gray) of image files through Spark's own decoder; files that it can't decode are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("binary")
    def gray(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        from ..operators.image_arrays import luma

        out = []
        for d, w, h, c in zip(data, width, height, channels, strict=True):
            a = np.frombuffer(d, dtype=np.uint8).reshape(h, w, c)
            out.append((a[..., 0] if c == 1 else luma(a[..., 2::-1])).tobytes())  # stored as blue, green, red
        return pd.Series(out)

    return images.select(F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"), gray("data", "width", "height", "nChannels").alias("gray"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): bytes that aren't UTF-8 become replacement signs."""
    files = spark.read.format("binaryFile").load(path)

    @F.pandas_udf("string")
    def lenient(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8", errors="replace"))

    return files.select("path", lenient("content").alias("text"))


def word_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(word): trimmed lines that aren't blank; the first ``limit`` in the file's order."""
    text = spark.read.text(path, wholetext=True)
    words = text.select(F.posexplode(F.split("value", "\n")).alias("line", "word")).select("line", F.trim(F.regexp_replace("word", "[\r\t]", " ")).alias("word")).filter("word <> ''")
    return (words.orderBy("line").limit(limit) if limit else words).select("word")


def corrections_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("predicted string, corrected string").json(path)


def read_corrections(lines: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """(keys, predicted, corrected) from JSON lines; blank lines are skipped."""
    return lines.filter(F.trim(column) != "").select(*keys, F.from_json(column, "predicted string, corrected string").alias("c")).select(*keys, "c.*")


def read_samples(lines: DataFrame, column: str = "value", *keys: str) -> DataFrame:
    """(keys, truth, observed): ``observed`` is a string (all confidence 1) or an array of tokens."""
    raw = lines.filter(F.trim(column) != "").select(*keys, F.from_json(column, "truth string, observed string").alias("r"))
    full = F.from_json("r.observed", f"array<{schemas.TOKEN}>")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    short = F.transform(words(F.col("r.observed")), lambda w: F.struct(w.alias("text"), F.lit(1.0).alias("confidence"), F.array().cast(schemas.ALTERNATIVES).alias("alternatives")))
    filled = F.transform(full, lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["confidence"], F.lit(1.0)).alias("confidence"), F.coalesce(t["alternatives"], F.array().cast(schemas.ALTERNATIVES)).alias("alternatives")))
    return raw.select(*keys, words(F.col("r.truth")).alias("truth"), F.when(F.col("r.observed").startswith("["), filled).otherwise(short).alias("observed"))
