"""Further analysis of bars: technical features, swing points, volume profile, alerts, sizing, spreads, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import typical_price
from tickloom.functions.numeric import ieee_div
from tickloom.operators import vwap as vwaps
from tickloom.operators.strategy import StrategyConfig, run_incremental
from tickloom.plans.chunks import CHUNK_ROWS, chunk_order, looking_back, on_keys, running_sums


def technical_features(bars: DataFrame, window: int = 20, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """symbol, row_idx, returns, volatility (population deviation of the returns of the last `window` bars), volume_ratio (to their mean
    volume) and range_ratio (high - low over close)."""
    w = chunk_order()
    last = w.rowsBetween(1 - window, Window.currentRow)
    before = F.lag("close").over(w)
    with_returns = looking_back(bars, 1, {"returns": F.when(before.isNotNull(), ieee_div(F.col("close") - before, before))}, chunk_rows)
    out = looking_back(with_returns, window - 1, {"volatility": F.stddev_pop("returns").over(last), "mean_volume": F.avg("volume").over(last)}, chunk_rows)
    return out.select("symbol", "row_idx", "returns", "volatility", ieee_div(F.col("volume"), F.col("mean_volume")).alias("volume_ratio"), ieee_div(F.col("high") - F.col("low"), F.col("close")).alias("range_ratio"))


def swing_points(bars: DataFrame, reach: int = 2) -> DataFrame:
    """symbol, row_idx, timestamp, kind ("high" or "low"), price: bars whose high (low) is strictly above (below) that of the `reach`
    bars on both sides."""
    w = Window.partitionBy("symbol").orderBy("row_idx")
    top, bottom, whole = F.lit(True), F.lit(True), F.lit(True)
    for k in range(1, reach + 1):
        for at in (F.lag, F.lead):
            h, low = at("high", k).over(w), at("low", k).over(w)
            whole = whole & h.isNotNull()
            top, bottom = top & (F.col("high") > h), bottom & (F.col("low") < low)
    rows = bars.withColumns({"top": whole & top, "bottom": whole & bottom})
    kinds = F.array_compact(F.array(F.when(F.col("top"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("bottom"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    return rows.where("top OR bottom").select("symbol", "row_idx", "timestamp", F.explode(kinds).alias("k")).select("symbol", "row_idx", "timestamp", "k.*")


def swing_vwap(bars: DataFrame, reach: int = 2) -> DataFrame:
    """symbol, row_idx, kind, vwap from each swing point to the end: total minus what lies before, from running sums."""
    sums = running_sums(bars.select("symbol", "row_idx", "high", "low", "close", "volume"), {"v": vwaps.weighted(), "q": F.col("volume").cast("double")})
    total = sums.groupBy("symbol").agg(F.max_by("v", "row_idx").alias("tv"), F.max_by("q", "row_idx").alias("tq"))
    own = sums.select("symbol", "row_idx", (F.col("v") - vwaps.weighted()).alias("bv"), (F.col("q") - F.col("volume")).alias("bq"))
    points = swing_points(bars, reach).select("symbol", "row_idx", "kind")
    points = on_keys(on_keys(points, own, ["symbol", "row_idx"]), total, "symbol")
    return points.select("symbol", "row_idx", "kind", vwaps.ratio(F.col("tv") - F.col("bv"), F.col("tq") - F.col("bq")).alias("vwap"))


def volume_profile(bars: DataFrame, bins: int = 10) -> DataFrame:
    """symbol, bin (1 .. bins over the symbol's range of typical prices), volume, share, is_key (the bins with the most volume, ties by
    bin, that hold the first 70 percent)."""
    price = bars.select("symbol", typical_price().alias("p"), "volume")
    ends = price.groupBy("symbol").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), F.floor((F.col("p") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins) + 1)).otherwise(1)
    out = on_keys(price, ends, "symbol").groupBy("symbol", at.cast("int").alias("bin")).agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy("symbol")
    out = out.withColumn("share", F.col("volume") / F.sum("volume").over(w))
    before = F.coalesce(F.sum("volume").over(w.orderBy(F.col("volume").desc(), "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("is_key", before * 10 < F.sum("volume").over(w) * 7)


def market_alerts(bars: DataFrame, deviation: float = 0.02, spike: float = 2.0, move: float = 0.03, window: int = 20) -> DataFrame:
    """symbol, row_idx, alert, value: bars far from their rolling VWAP, with volume far above its rolling mean, or with a large move."""
    vw = vwaps.rolling_at_every_bar(bars, window).select("symbol", "row_idx", "vwap")
    row = ["symbol", "row_idx"]
    rows = on_keys(on_keys(technical_features(bars, window), vw, row), bars.select(*row, "close"), row)
    dev = ieee_div(F.col("close") - F.col("vwap"), F.col("vwap"))
    one = lambda name, value, limit: F.when(F.abs(value) > limit, F.struct(F.lit(name).alias("alert"), value.alias("value")))
    found = F.array_compact(F.array(one("vwap_deviation", dev, deviation), one("volume_spike", F.col("volume_ratio"), spike), one("price_move", F.col("returns"), move)))
    return rows.select("symbol", "row_idx", F.explode(found).alias("a")).select("symbol", "row_idx", "a.*")


def position_size(capital: Column, risk: Column, entry: Column, stop: Column) -> Column:
    """Pieces for which hitting the stop costs the given share of the capital."""
    return ieee_div(capital * risk, F.abs(entry - stop))


def dynamic_stop(entry: Column, volatility: Column, factor: float = 2.0, long: bool = True) -> Column:
    return entry * (1 - factor * volatility) if long else entry * (1 + factor * volatility)


def spreads(bars: DataFrame, least: float = 0.0) -> DataFrame:
    """timestamp, cheap, dear, spread: at each time the symbols with the lowest and highest typical price and their relative distance."""
    rows = bars.select("timestamp", "symbol", typical_price().alias("p"))
    out = rows.groupBy("timestamp").agg(F.min(F.struct("p", "symbol")).alias("a"), F.max(F.struct("p", "symbol")).alias("b"), F.count("*").alias("n"))
    return out.where("n > 1").select("timestamp", F.col("a.symbol").alias("cheap"), F.col("b.symbol").alias("dear"), ieee_div(F.col("b.p") - F.col("a.p"), F.col("a.p")).alias("spread")).where(F.col("spread") > least)


def key_figures(bars: DataFrame, within: float = 0.01) -> DataFrame:
    """Per symbol: vwap_hit_rate (closes within `within` of the running VWAP), volume_weighted_return, mean_deviation."""
    vw = vwaps.running(bars).select("symbol", "row_idx", "vwap")
    row = ["symbol", "row_idx"]
    rows = on_keys(on_keys(technical_features(bars).select(*row, "returns"), vw, row), bars.select(*row, "close", "volume"), row)
    dev = F.abs(ieee_div(F.col("close") - F.col("vwap"), F.col("vwap")))
    has = F.col("returns").isNotNull()
    return rows.groupBy("symbol").agg((F.count_if(dev <= within) / F.count("*")).alias("vwap_hit_rate"), (F.sum(F.col("returns") * F.col("volume")) / F.sum(F.when(has, F.col("volume")))).alias("volume_weighted_return"), F.avg(dev).alias("mean_deviation"))


def market_quotes(bars: DataFrame, multiplier: float = 1.5, window: int = 20) -> DataFrame:
    """symbol, row_idx, vwap (of all bars so far), bid and ask: the VWAP less and plus multiplier times the population deviation of the closes
    of the last `window` bars."""
    row = ["symbol", "row_idx"]
    wide = looking_back(bars.select(*row, "close"), window - 1, {"deviation": F.stddev_pop("close").over(chunk_order().rowsBetween(1 - window, Window.currentRow))})
    out = on_keys(vwaps.running(bars).select(*row, "vwap"), wide, row)
    return out.select(*row, "vwap", (F.col("vwap") - multiplier * F.col("deviation")).alias("bid"), (F.col("vwap") + multiplier * F.col("deviation")).alias("ask"))


def gains(emitted: DataFrame, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """symbol, row_idx, timestamp (if there is one), gain of a strategy's closed trades, each for its size, less commission and slippage (shares of the traded value)."""
    cost = F.col("size") * (commission + slippage) * 2
    return emitted.where(F.col("signal") == "Exit").select("symbol", "row_idx", *[c for c in ("timestamp",) if c in emitted.columns], (F.col("size") * ieee_div(F.col("standard_pnl"), F.col("price")) - cost).alias("gain"))


def equity_curve(closed: DataFrame, capital: float) -> DataFrame:
    """gains() plus equity, peak (from the capital) and below (share of the peak that is lost). Trades are few beside bars: a symbol's are one task."""
    upto = Window.partitionBy("symbol").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = closed.withColumn("equity", capital + F.sum("gain").over(upto))
    out = out.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(upto)))
    return out.withColumn("below", (F.col("peak") - F.col("equity")) / F.col("peak"))


def backtest(emitted: DataFrame, capital: float = 10_000.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Per symbol: trades, final_capital, total_return, win_rate, avg_trade, best_trade, worst_trade, avg_win, avg_loss, sharpe and sortino of the gains,
    profit_factor, max_drawdown, calmar (return over the largest drawdown of the capital), longest winning and losing streaks."""
    rows = equity_curve(gains(emitted, commission, slippage), capital)
    g, w = F.col("gain"), Window.partitionBy("symbol").orderBy("row_idx")
    islands = rows.withColumn("won", g > 0).withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("symbol", "won").orderBy("row_idx")))
    streak = islands.groupBy("symbol", "won", "island").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("longest_wins"), F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("longest_losses"))
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("trades"), (F.lit(capital) + F.sum(g)).alias("final_capital"), (F.sum(g) / capital).alias("total_return"), (F.count_if(g > 0) / F.count("*")).alias("win_rate"), F.avg(g).alias("avg_trade"), F.max(g).alias("best_trade"), F.min(g).alias("worst_trade"),
        F.avg(F.when(g > 0, g)).alias("avg_win"), F.avg(F.when(g < 0, g)).alias("avg_loss"), F.stddev_pop(g).alias("s"), F.sqrt(F.avg(F.when(g < 0, g * g))).alias("d"), F.sum(F.when(g > 0, g)).alias("up"), F.sum(F.when(g < 0, -g)).alias("down"), F.max("below").alias("max_drawdown"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, a / F.nullif(b, F.lit(0.0)))
    out = out.withColumns({"sharpe": over(F.col("avg_trade"), "s"), "sortino": over(F.col("avg_trade"), "d"), "profit_factor": over(F.coalesce("up", F.lit(0.0)), "down"), "calmar": over(F.col("total_return"), "max_drawdown")})
    return on_keys(out.drop("up", "down", "s", "d"), streak, "symbol")


def monthly_returns(emitted: DataFrame, capital: float = 10_000.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """symbol, month, trades, return: the month's gains over the capital at its beginning."""
    by_month = gains(emitted, commission, slippage).groupBy("symbol", F.date_trunc("month", "timestamp").cast("date").alias("month")).agg(F.count("*").alias("trades"), F.sum("gain").alias("gain"))
    before = F.coalesce(F.sum("gain").over(Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a month
    return by_month.select("symbol", "month", "trades", (F.col("gain") / (capital + before)).alias("return"))


def drawdown_periods(emitted: DataFrame, capital: float = 10_000.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """symbol, first and last (times of the first and last trade below a peak), trades, drawdown (the largest), seconds."""
    rows = equity_curve(gains(emitted, commission, slippage), capital)
    w = Window.partitionBy("symbol").orderBy("row_idx")
    rows = rows.withColumn("period", F.sum(F.when(F.col("below") > 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("below > 0")
    out = rows.groupBy("symbol", "period").agg(F.min_by("timestamp", "row_idx").alias("first"), F.max_by("timestamp", "row_idx").alias("last"), F.count("*").alias("trades"), F.max("below").alias("drawdown"))
    seconds = F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))
    return out.withColumn("seconds", seconds).drop("period")


def grid_search(bars: DataFrame, grid: list[StrategyConfig], capital: float = 10_000.0, commission: float = 0.0) -> DataFrame:
    """The back-test of each configuration (column config: its place in the grid), with its rank by return among those of the symbol, best first."""
    runs = [backtest(run_incremental(bars, c), capital, commission).withColumn("config", F.lit(k)) for k, c in enumerate(grid)]
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("total_return").desc(), "config")).cast("long"))
