"""The bar: one row per symbol and time."""

from __future__ import annotations

from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
