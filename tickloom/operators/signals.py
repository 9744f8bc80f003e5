"""Buy, sell and hold signals from the distance to VWAP."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ieee_div, smaller
from tickloom.operators import vwap as vwaps
from tickloom.plans.chunks import on_keys


@dataclass(frozen=True)
class SignalThresholds:
    vwap_buy_threshold: float = 0.001
    vwap_sell_threshold: float = 0.001
    volume_threshold: float = 1.5
    price_change_threshold: float = 0.005
    min_confidence: float = 0.6


DEFAULT = SignalThresholds()


def deviation(close: Column, vwap: Column) -> Column:
    return ieee_div(close - vwap, vwap)


def _above(x: Column, t: float) -> Column:
    return ~F.isnan(x) & (x > t)


def signal(dev: Column, t: SignalThresholds = DEFAULT) -> Column:
    return F.when(_above(dev, t.vwap_buy_threshold), "Buy").when(_above(-dev, t.vwap_sell_threshold), "Sell").otherwise("Hold")


def strength(dev: Column, t: SignalThresholds = DEFAULT) -> Column:
    """The distance; null for a hold."""
    return F.when(signal(dev, t) != "Hold", F.abs(dev))


def reason(dev: Column, t: SignalThresholds = DEFAULT) -> Column:
    kind = signal(dev, t)
    percent = F.abs(dev) * 100.0
    return F.when(kind == "Buy", F.format_string("Price %.2f%% above VWAP", percent)).when(kind == "Sell", F.format_string("Price %.2f%% below VWAP", percent)).otherwise("Price within VWAP threshold")


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _from_deviation(dev: Column, most: float) -> Column:
    return F.lit(0.5) + smaller(F.abs(dev) * 10.0, F.lit(most))


def confidence(dev: Column, volume: Column, mean_volume: Column, close: Column, previous: Column, n: Column, t: SignalThresholds = DEFAULT) -> Column:
    """Of a signal that knows the bars before: 0.5, up to 0.3 for the distance, 0.2 for much volume and 0.1 for a move."""
    spike = F.when((n > 1) & _above(ieee_div(volume, mean_volume), t.volume_threshold), 0.2).otherwise(0.0)
    move = F.when((n > 1) & _above(F.abs(ieee_div(close - previous, previous)), t.price_change_threshold), 0.1).otherwise(0.0)
    return _clamped(_from_deviation(dev, 0.3) + spike + move)


def confidence_single(dev: Column) -> Column:
    return _clamped(_from_deviation(dev, 0.4))


def batch_signal(bars: DataFrame, thresholds: SignalThresholds = DEFAULT, scope=vwaps.vwap) -> DataFrame:
    """One signal per symbol, for its last bar. scope: bars to (symbol, vwap). Aggregations only, no window."""
    ends = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max("row_idx").alias("end"), F.avg("volume").alias("mean_volume"), F.max_by(F.struct("timestamp", "close", "volume"), "row_idx").alias("last"))
    before = on_keys(bars, ends.select("symbol", "end"), "symbol").where(F.col("row_idx") < F.col("end")).groupBy("symbol").agg(F.max_by("close", "row_idx").alias("previous"))
    rows = on_keys(on_keys(ends, before, "symbol", "left"), scope(bars).select("symbol", "vwap"), "symbol")
    close, volume = F.col("last.close"), F.col("last.volume")
    rows = rows.withColumn("deviation", deviation(close, F.col("vwap")))
    dev = F.col("deviation")
    sure = confidence(dev, volume.cast("double"), F.col("mean_volume"), close, F.col("previous"), F.col("n"), thresholds)
    return rows.select("symbol", F.col("last.timestamp").alias("timestamp"), signal(dev, thresholds).alias("signal"), strength(dev, thresholds).alias("strength"), reason(dev, thresholds).alias("reason"), close.alias("price"), volume.alias("volume"), "vwap", "deviation", sure.alias("confidence"))


def incremental_signals(bars: DataFrame, thresholds: SignalThresholds = DEFAULT) -> DataFrame:
    """One signal per bar from that bar alone: its typical price is the VWAP (0 without volume). A projection, so it
    works on streams too."""
    own = vwaps.ratio(vwaps.weighted(), F.col("volume").cast("double"))
    rows = bars.withColumn("vwap", own).withColumn("deviation", deviation(F.col("close"), F.col("vwap")))
    dev = F.col("deviation")
    keep = [c for c in ("symbol", "row_idx", "timestamp") if c in bars.columns]
    return rows.select(*keep, signal(dev, thresholds).alias("signal"), strength(dev, thresholds).alias("strength"), reason(dev, thresholds).alias("reason"), F.col("close").alias("price"), "volume", "vwap", confidence_single(dev).alias("confidence"))


def signal_counts(signals: DataFrame) -> DataFrame:
    """Per symbol: total, buys, sells (exits count as sells) and holds."""
    kind = F.col("signal")
    return signals.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(kind == "Buy").alias("buys"), F.count_if(kind.isin("Sell", "Exit")).alias("sells"), F.count_if(kind == "Hold").alias("holds"))
