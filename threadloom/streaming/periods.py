"""Outcomes by day as a stream, an extension beside the batch operators: late rows count until the watermark passes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_outcomes(stream: DataFrame, at: str, lateness: str, measures: dict[str, Column]) -> DataFrame:
    """(day, rows, each measure) of windows of a day, emitted when they close."""
    windows = stream.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("w"))
    return windows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in measures.items()]).select(F.to_date("w.start").alias("day"), "rows", *measures)
