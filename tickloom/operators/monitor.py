"""Trading metrics, risk and alerts from what a strategy emits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.chunks import on_keys


@dataclass(frozen=True)
class MonitorConfig:
    drawdown_threshold: float = 0.1
    win_rate_threshold: float = 0.5
    pnl_threshold: float = -1000.0
    latency_threshold: float = 0.001
    max_history_size: int = 10_000


def trades(emitted: DataFrame, pnl: str = "pnl") -> DataFrame:
    """symbol, trade (1, 2, ... in order), timestamp, pnl of the closed trades."""
    closed = emitted.where(F.col("signal") == "Exit")
    return closed.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("row_idx")).cast("long").alias("trade"), "row_idx", "timestamp", F.col(pnl).alias("pnl"))


def trade_metrics(closed: DataFrame) -> DataFrame:
    """Per symbol: trades with a gain or a loss, gains, losses, win_rate, total_pnl, avg_pnl. A trade of 0 is in no count
    but the average divides by the counted ones."""
    p = F.col("pnl")
    out = closed.groupBy("symbol").agg(F.count_if(p > 0).alias("winning"), F.count_if(p < 0).alias("losing"), F.coalesce(F.sum(p), F.lit(0.0)).alias("total_pnl"))
    n = F.col("winning") + F.col("losing")
    rate = lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0))).otherwise(0.0)
    return out.select("symbol", n.alias("total"), "winning", "losing", rate(F.col("winning")).alias("win_rate"), "total_pnl", rate(F.col("total_pnl")).alias("avg_pnl"))


def equity(closed: DataFrame) -> DataFrame:
    """closed plus equity (running pnl), peak (from 0) and drawdown ((peak - equity) / max(peak, 1))."""
    w = Window.partitionBy("symbol").orderBy("trade").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = closed.withColumn("equity", F.sum("pnl").over(w))
    out = out.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w)))
    return out.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.greatest(F.col("peak"), F.lit(1.0)))


def _current(peak: Column, now: Column) -> Column:
    return F.when(peak > 0, (peak - now) / F.nullif(peak, F.lit(0.0))).otherwise(0.0)


def drawdown(closed: DataFrame) -> DataFrame:
    """Per symbol: max_drawdown, current_drawdown ((peak - equity) / peak), peak_equity, current_equity."""
    out = equity(closed).groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"), F.max("peak").alias("peak_equity"), F.max_by("equity", "trade").alias("current_equity"))
    return out.select("symbol", "max_drawdown", _current(F.col("peak_equity"), F.col("current_equity")).alias("current_drawdown"), "peak_equity", "current_equity")


def risk(closed: DataFrame) -> DataFrame:
    """Per symbol: sharpe (mean / population deviation; 0 if that is 0) and sortino (mean / root mean square of the losses;
    the mean if there are none)."""
    p = F.col("pnl")
    out = closed.groupBy("symbol").agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s"), F.sqrt(F.avg(F.when(p < 0, p * p))).alias("d"))
    return out.select("symbol", F.when(F.col("s") > 0, F.col("m") / F.nullif("s", F.lit(0.0))).otherwise(0.0).alias("sharpe"), F.when(F.col("d") > 0, F.col("m") / F.nullif("d", F.lit(0.0))).otherwise(F.col("m")).alias("sortino"))


def metrics(closed: DataFrame) -> DataFrame:
    """trade_metrics, drawdown and risk in one row a symbol."""
    return on_keys(on_keys(trade_metrics(closed), drawdown(closed), "symbol"), risk(closed), "symbol")


def history(emitted: DataFrame, n: int, config: MonitorConfig | None = None) -> DataFrame:
    """The latest n recorded signals (exits are no records of their own) of each symbol, newest first (seq 1), of the max_history_size that are kept."""
    records = emitted.where(F.col("signal") != "Exit")
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("row_idx").desc()))
    return records.withColumn("seq", seq.cast("long")).where(F.col("seq") <= min(n, (config or MonitorConfig()).max_history_size))


def latency_statistics(timed: DataFrame) -> DataFrame:
    """Per symbol of rows with a latency in seconds: calls, total, average, smallest and largest."""
    x = F.col("latency")
    return timed.groupBy("symbol").agg(F.count(x).alias("calls"), F.sum(x).alias("total"), F.avg(x).alias("average"), F.min(x).alias("smallest"), F.max(x).alias("largest"))


def alerts(emitted: DataFrame, config: MonitorConfig | None = None, pnl: str = "pnl") -> DataFrame:
    """symbol, row_idx, alert_type, current, threshold: every check that fails at every event, recorded signal or exit, with
    the metrics up to that event. If the rows have a latency (seconds), the average so far is checked too; if they have an `error`, it is
    reported as SignalGenerationFailed. Repeated alerts are kept; retained() and recent() are the bounded lists."""
    config = config or MonitorConfig()
    w = Window.partitionBy("symbol").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.when(F.col("signal") == "Exit", F.col(pnl))
    optional = [F.col(c) if c in emitted.columns else F.lit(None).cast(t).alias(c) for c, t in (("latency", "double"), ("error", "string"))]
    rows = emitted.select("symbol", "row_idx", p.alias("p"), *optional).withColumns({"pnl": F.coalesce(F.sum("p").over(w), F.lit(0.0)), "won": F.count_if(F.col("p") > 0).over(w), "lost": F.count_if(F.col("p") < 0).over(w), "waited": F.avg("latency").over(w)})
    rows = rows.withColumn("peak", F.greatest(F.lit(0.0), F.max("pnl").over(w)))
    total = F.col("won") + F.col("lost")
    now, rate = _current(F.col("peak"), F.col("pnl")), F.when(total > 0, F.col("won") / F.nullif(total, F.lit(0))).otherwise(0.0)
    one = lambda name, bad, value, limit: F.when(bad, F.struct(F.lit(name).alias("alert_type"), value.alias("current"), F.lit(limit).cast("double").alias("threshold")))
    found = F.array(
        one("DrawdownExceeded", now > config.drawdown_threshold, now, config.drawdown_threshold),
        one("WinRateLow", (rate < config.win_rate_threshold) & (total > 10), rate, config.win_rate_threshold),
        one("PnLLow", F.col("pnl") < config.pnl_threshold, F.col("pnl"), config.pnl_threshold),
        one("LatencyHigh", F.col("waited") > config.latency_threshold, F.col("waited"), config.latency_threshold),
        one("SignalGenerationFailed", F.col("error").isNotNull(), F.lit(None).cast("double"), None),
    )
    return rows.select("symbol", "row_idx", F.posexplode(F.array_compact(found)).alias("place", "a")).select("symbol", "row_idx", "place", "a.*")


def retained(alerted: DataFrame) -> DataFrame:
    """The alerts of each symbol that are still held, oldest first (seq 1): whenever an event takes the list beyond 100, its oldest 50 go. So a list
    that ever passed 100 holds 51 to 100 alerts, and their number is that of all modulo 50."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    held = F.when(n <= 100, n).otherwise(51 + (n - 51) % 50)
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("row_idx", "place")) - (n - held)
    return alerted.withColumn("seq", at.cast("long")).where("seq > 0").drop("place")


def recent(alerted: DataFrame, n: int) -> DataFrame:
    """The latest n alerts of each symbol, newest first (seq 1)."""
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("row_idx").desc(), F.col("alert_type").desc()))
    return alerted.drop("place").withColumn("seq", seq.cast("long")).where(F.col("seq") <= n)
