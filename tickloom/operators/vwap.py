"""Volume-weighted average price in four scopes, at the end of the data, at every bar, and in steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.functions.bars import typical_price
from tickloom.plans.chunks import CHUNK_ROWS, chunk_order, looking_back, on_keys, running_sums


def weighted() -> Column:
    return typical_price() * F.col("volume")


def ratio(value: Column, volume: Column) -> Column:
    """value / volume, 0 without volume."""
    return F.when(volume == 0, F.lit(0.0)).otherwise(value / F.nullif(volume.cast("double"), F.lit(0.0)))


def vwap(bars: DataFrame) -> DataFrame:
    """Per symbol: vwap, total_volume (double), data_points. Symbols without bars have no row. Bars are not split by day."""
    out = bars.groupBy("symbol").agg(F.sum(weighted()).alias("v"), F.sum(F.col("volume").cast("double")).alias("total_volume"), F.count("*").alias("data_points"))
    return out.select("symbol", ratio(F.col("v"), F.col("total_volume")).alias("vwap"), "total_volume", "data_points")


session = vwap


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    ends = bars.groupBy("symbol").agg(F.max("row_idx").alias("__end"))
    return on_keys(bars, ends, "symbol").where(F.col("row_idx") > F.col("__end") - n).drop("__end")


def rolling(bars: DataFrame, n: int) -> DataFrame:
    """Over each symbol's last n bars. n = 0 leaves nothing to average."""
    if n < 1:
        raise errors.EmptyDataset
    return vwap(last_rows(bars, n))


def anchored(bars: DataFrame, anchor: datetime) -> DataFrame:
    """Over the bars from the anchor on."""
    return vwap(bars.where(F.col("timestamp") >= F.lit(anchor)))


def between(bars: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Over the bars of a closed interval."""
    return vwap(bars.where(F.col("timestamp").between(F.lit(start), F.lit(end))))


def rolling_at_every_bar(bars: DataFrame, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """symbol, row_idx, timestamp, vwap and data_points of the n bars that end here."""
    w = chunk_order().rowsBetween(1 - n, Window.currentRow)
    value, volume = F.sum(weighted()).over(w), F.sum(F.col("volume").cast("double")).over(w)
    out = looking_back(bars.select("symbol", "row_idx", "timestamp", "high", "low", "close", "volume"), n - 1, {"__v": value, "__q": volume, "data_points": F.count("*").over(w)}, chunk_rows)
    return out.select("symbol", "row_idx", "timestamp", ratio(F.col("__v"), F.col("__q")).alias("vwap"), "data_points")


def running(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """symbol, row_idx, timestamp and vwap of all bars up to here."""
    out = running_sums(bars.select("symbol", "row_idx", "timestamp", "high", "low", "close", "volume"), {"v": weighted(), "q": F.col("volume").cast("double")}, chunk_rows)
    return out.select("symbol", "row_idx", "timestamp", ratio(F.col("v"), F.col("q")).alias("vwap"))


def incremental(bars: DataFrame, scope: str = "session", n: int = 0, anchor: datetime | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """What a caller gets who feeds one bar at a time: a rolling scope keeps its last n bars; every other scope sees only
    the new bar, so its vwap is that bar's typical price (no row if the scope leaves the bar out)."""
    if scope == "rolling":
        return rolling_at_every_bar(bars, n)
    kept = bars
    if scope == "anchored":
        kept = bars.where(F.col("timestamp") >= F.lit(anchor))
    elif scope == "custom":
        kept = bars.where(F.col("timestamp").between(F.lit(start), F.lit(end)))
    return kept.select("symbol", "row_idx", "timestamp", ratio(weighted(), F.col("volume").cast("double")).alias("vwap"), F.lit(1).cast("long").alias("data_points"))


def multi_timeframe(bars: DataFrame, windows: list[str]) -> DataFrame:
    """symbol, timeframe, vwap of the last window of each length, last close, bullish (close above vwap) and whether all
    timeframes are bullish."""
    ends = bars.groupBy("symbol").agg(F.max("timestamp").alias("end"), F.max_by("close", "timestamp").alias("last_close"))
    scopes = F.array(*[F.struct(F.lit(w).alias("timeframe"), F.expr(f"INTERVAL {w}").alias("length")) for w in windows])
    rows = on_keys(bars, ends, "symbol").withColumn("s", F.explode(scopes)).where(F.col("timestamp") > F.col("end") - F.col("s.length"))
    out = rows.groupBy("symbol", "s.timeframe").agg(F.sum(weighted()).alias("v"), F.sum(F.col("volume").cast("double")).alias("q"), F.max("last_close").alias("last_close"))
    out = out.select("symbol", "timeframe", ratio(F.col("v"), F.col("q")).alias("vwap"), "last_close").withColumn("bullish", F.col("last_close") > F.col("vwap"))
    return out.withColumn("all_bullish", F.min("bullish").over(Window.partitionBy("symbol")))
