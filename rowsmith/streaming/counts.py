"""Line templates and column classes over streams of documents: the batch aggregates, run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import actual_of, class_of, mask
from ..operators.lines import signature
from ..operators.templates import Template, parse


def signature_counts(stream: DataFrame, text: str = "text", time: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """signature, n so far; with a time column by window, which closes once the watermark has passed it."""
    lines = stream.select(*([time] if time else []), F.explode(F.split(text, "\r\n|\r|\n")).alias("line"))
    keys = [signature(F.col("line")).alias("signature")]
    if time:
        return lines.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count("*").alias("n"))
    return lines.groupBy(*keys).agg(F.count("*").alias("n"))


def class_so_far(stream: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, n, class, actual of all values so far: the state of a key is one mask and a count."""
    g = stream.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"), F.bit_and(mask(F.col(value))).alias("_mask"))
    return g.select(key, "n", class_of(F.col("_mask")).alias("class"), actual_of(F.col("_mask")).alias("actual"))


def parsed(stream: DataFrame, template: Template, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of whole documents as they arrive; documents are independent, so there is no state."""
    return parse(stream, template, key, text)
