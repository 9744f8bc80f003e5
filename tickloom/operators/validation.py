"""Data-quality rules, outliers, order, gaps and statistics of bars.

A rule is a column that is null for a good bar and a message for a bad one. Contextual checks look at other bars of the
same symbol.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite, greater, less
from tickloom.plans.chunks import on_keys
from tickloom.sources.schema import PRICES

_c = F.col


def bar_error() -> Column:
    """The first broken rule of a bar's logic, or null. Comparisons with NaN hold nothing against a bar."""
    positive = F.lit(False)
    for p in PRICES:
        positive = positive | (~F.isnan(_c(p)) & (_c(p) <= 0))
    return (
        F.when(positive, F.lit("All prices must be positive"))
        .when(less(_c("high"), _c("low")), F.lit("High price cannot be less than low price"))
        .when(less(_c("high"), _c("open")) | less(_c("high"), _c("close")), F.lit("High price must be >= open and close prices"))
        .when(greater(_c("low"), _c("open")) | greater(_c("low"), _c("close")), F.lit("Low price must be <= open and close prices"))
    )


Rule = tuple[str, Column]


def logical_consistency() -> Rule:
    return "LogicalConsistency", F.concat(F.lit("Invalid OHLCV data: "), bar_error())


def price_range(low: float, high: float) -> Rule:
    """Prices must lie in [low, high)."""
    first = F.coalesce(*[F.when(F.isnan(_c(p)) | (_c(p) < low) | (_c(p) >= high), _c(p)) for p in PRICES])
    return "PriceRange", F.concat(F.lit("Price "), first.cast("string"), F.lit(f" is outside valid range {low}..{high}"))


def volume_threshold(least: int) -> Rule:
    return "VolumeThreshold", F.when(_c("volume") < least, F.concat(F.lit("Volume "), _c("volume").cast("string"), F.lit(f" is below threshold {least}")))


def no_missing_values() -> Rule:
    first = F.coalesce(*[F.when(~finite(_c(p)), F.coalesce(_c(p).cast("string"), F.lit("null"))) for p in PRICES])
    return "NoMissingValues", F.concat(F.lit("Invalid price value: "), first)


def custom(check: Callable[[], Column]) -> Rule:
    """check() is a column: null for a good bar, else the message."""
    return "Custom", check()


#: A rule that looks at other bars: name and bars to the (symbol, row_idx) of bad ones.
ContextRule = tuple[str, Callable[[DataFrame], DataFrame]]


def no_duplicate_timestamps() -> ContextRule:
    return "NoDuplicateTimestamps", lambda bars: duplicate_timestamps(bars)


def chronological_order() -> ContextRule:
    return "ChronologicalOrder", lambda bars: order_violations(bars)


def time_series_gaps(longest_seconds: int) -> ContextRule:
    return "TimeSeriesGaps", lambda bars: time_gaps(bars, longest_seconds)


def outlier_detection(method: str = "zscore", threshold: float = 3.0) -> ContextRule:
    """method: "zscore", "iqr" or "modified_zscore". A bar counts once, however many of its prices are outliers."""
    found = {"zscore": outliers_zscore, "iqr": outliers_iqr, "modified_zscore": outliers_modified_zscore}[method]
    return "OutlierDetection", lambda bars: found(bars, threshold).select("symbol", "row_idx").distinct()


@dataclass(frozen=True)
class Validator:
    """Rules in order, then contextual rules. A bar's errors stop after the first with stop_on_first_error; bars are read in order of row_idx
    until at least max_errors errors are found. In mode "reference" contextual rules are accepted and find nothing."""

    rules: tuple[Rule, ...] = ()
    stop_on_first_error: bool = False
    max_errors: int = 1000
    context: tuple[ContextRule, ...] = ()
    mode: str = "reference"

    def add_rule(self, rule: Rule) -> Validator:
        return replace(self, rules=(*self.rules, rule))

    def add_rules(self, rules: list[Rule]) -> Validator:
        return replace(self, rules=(*self.rules, *rules))

    def add_context(self, *rules: ContextRule) -> Validator:
        return replace(self, context=(*self.context, *rules))

    def errors_of(self) -> Column:
        """Array of (error_type, message) of a bar."""
        each = F.array(*[F.struct(F.lit(name).alias("error_type"), message.alias("message")) for name, message in self.rules]) if self.rules else F.array().cast("array<struct<error_type: string, message: string>>")
        found = F.filter(each, lambda x: x["message"].isNotNull())
        return F.slice(found, 1, 1) if self.stop_on_first_error else found

    def errors(self, bars: DataFrame) -> DataFrame:
        """(symbol, row_idx, error_type, message) of the bars that were read."""
        found = bars.select("symbol", "row_idx", self.errors_of().alias("e")).where(F.size("e") > 0)
        if self.mode == "standard" and self.context:
            for k, (name, check) in enumerate(self.context):
                own = F.array(F.struct(F.lit(name).alias("error_type"), F.lit(f"{name} failed").alias("message")))
                found = found.withColumn("k", F.lit(-1)) if not k else found
                found = found.unionByName(check(bars).select("symbol", "row_idx", own.alias("e"), F.lit(k).alias("k")))
            found = found.groupBy("symbol", "row_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "e"))), lambda x: x["e"])).alias("e"))
            found = found.withColumn("e", F.slice("e", 1, 1)) if self.stop_on_first_error else found
        before = Window.partitionBy("symbol").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
        read = found.withColumn("before", F.coalesce(F.sum(F.size("e")).over(before), F.lit(0))).where(F.col("before") < self.max_errors)
        return read.select("symbol", "row_idx", F.explode("e").alias("x")).select("symbol", "row_idx", "x.error_type", "x.message")

    def is_valid(self, bars: DataFrame) -> bool:
        return self.errors(bars).isEmpty()


def duplicate_timestamps(bars: DataFrame) -> DataFrame:
    """(symbol, row_idx, previous_idx) of each bar whose time an earlier row of its symbol has."""
    before = F.lag("row_idx").over(Window.partitionBy("symbol", "timestamp").orderBy("row_idx"))
    return bars.withColumn("previous_idx", before).where("previous_idx IS NOT NULL").select("symbol", "row_idx", "previous_idx")


def order_violations(bars: DataFrame) -> DataFrame:
    """(symbol, row_idx) of each bar that isn't later than the row before it."""
    before = F.lag("timestamp").over(Window.partitionBy("symbol").orderBy("row_idx"))
    return bars.withColumn("b", before).where(F.col("timestamp") <= F.col("b")).select("symbol", "row_idx")


def time_gaps(bars: DataFrame, longest_seconds: int) -> DataFrame:
    """(symbol, row_idx, gap_seconds) of each bar that comes more than longest_seconds after the one before it."""
    w = Window.partitionBy("symbol").orderBy("timestamp", "row_idx")
    gap = F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.lag("timestamp").over(w).cast("timestamp"))
    return bars.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > longest_seconds).select("symbol", "row_idx", "gap_seconds")


def price_cells(bars: DataFrame) -> DataFrame:
    """One row per price: symbol, row_idx, field, price."""
    return bars.select("symbol", "row_idx", F.stack(F.lit(4), *[x for p in PRICES for x in (F.lit(p), _c(p))]).alias("field", "price"))


def quantile_at(values: DataFrame, column: str, numerator: int, denominator: int) -> DataFrame:
    """(symbol, value at position n * numerator / denominator of the sorted values, n). Equal values are counted first,
    so only distinct values are ordered."""
    counts = values.groupBy("symbol", column).agg(F.count("*").alias("k"))
    w = Window.partitionBy("symbol")
    placed = counts.withColumn("n", F.sum("k").over(w)).withColumn("upto", F.sum("k").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.floor(F.col("n") * numerator / denominator)
    return placed.where(F.col("upto") > at).groupBy("symbol").agg(F.min(column).alias("value"), F.max("n").alias("n"))


def outliers_zscore(bars: DataFrame, threshold: float) -> DataFrame:
    """(symbol, row_idx, field, price, score) of prices whose distance from the mean of the symbol's pooled prices exceeds
    threshold population standard deviations."""
    cells = price_cells(bars)
    stats = cells.groupBy("symbol").agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("s"))
    scored = on_keys(cells, stats, "symbol").where("s > 0").withColumn("score", F.abs(F.col("price") - F.col("m")) / F.col("s"))
    return scored.where(F.col("score") > threshold).select("symbol", "row_idx", "field", "price", "score")


def outliers_iqr(bars: DataFrame, multiplier: float) -> DataFrame:
    """(symbol, row_idx, field, price, low, high): prices outside the quartiles, taken without interpolation at a quarter
    and three quarters of the sorted prices, by more than multiplier times their distance."""
    cells = price_cells(bars)
    q1 = quantile_at(cells, "price", 1, 4).select("symbol", F.col("value").alias("q1"))
    q3 = quantile_at(cells, "price", 3, 4).select("symbol", F.col("value").alias("q3"))
    bounds = on_keys(q1, q3, "symbol").select("symbol", (F.col("q1") - multiplier * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))).alias("high"))
    return on_keys(cells, bounds, "symbol").where("price < low OR price > high").select("symbol", "row_idx", "field", "price", "low", "high")


def outliers_modified_zscore(bars: DataFrame, threshold: float, mode: str = "reference") -> DataFrame:
    """(symbol, row_idx, field, price, score) with score 0.6745 * abs(price - median) / deviation above threshold. The
    median is the upper one. deviation: in mode "reference" the largest absolute deviation, in "standard" the median one."""
    cells = price_cells(bars)
    median = quantile_at(cells, "price", 1, 2).select("symbol", F.col("value").alias("median"))
    off = on_keys(cells, median, "symbol").withColumn("off", F.abs(F.col("price") - F.col("median")))
    if mode == "reference":
        mad = off.groupBy("symbol").agg(F.max("off").alias("mad"))
    else:
        mad = quantile_at(off.select("symbol", "off"), "off", 1, 2).select("symbol", F.col("value").alias("mad"))
    scored = on_keys(off, mad, "symbol").where("mad > 0").withColumn("score", F.lit(0.6745) * F.col("off") / F.col("mad"))
    return scored.where(F.col("score") > threshold).select("symbol", "row_idx", "field", "price", "score")


def medians(values: DataFrame, column: str) -> DataFrame:
    """(symbol, median): the mean of the middle two of the sorted values. Equal values are counted first."""
    counts = values.groupBy("symbol", column).agg(F.count("*").alias("k"))
    w = Window.partitionBy("symbol")
    placed = counts.withColumn("n", F.sum("k").over(w)).withColumn("upto", F.sum("k").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(column))).cast("double")
    return placed.groupBy("symbol").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def price_statistics(bars: DataFrame) -> DataFrame:
    """Of the pooled prices: symbol, n, min, max, mean, std_dev (population), median (mean of the middle two)."""
    cells = price_cells(bars)
    out = cells.groupBy("symbol").agg(F.count("*").alias("n"), F.min("price").alias("min"), F.max("price").alias("max"), F.avg("price").alias("mean"), F.stddev_pop("price").alias("std_dev"))
    return on_keys(out, medians(cells, "price"), "symbol")


def volume_statistics(bars: DataFrame) -> DataFrame:
    """As price_statistics; the median of an even number of volumes is a whole number, rounded down."""
    out = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("volume").alias("min"), F.max("volume").alias("max"), F.avg("volume").alias("mean"), F.stddev_pop("volume").alias("std_dev"))
    return on_keys(out, medians(bars, "volume"), "symbol").withColumn("median", F.floor("median").cast("long"))


def time_statistics(bars: DataFrame) -> DataFrame:
    """symbol, first and last (by row), total, average, smallest and largest seconds between neighbouring rows."""
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    gap = seconds - F.lag(seconds).over(Window.partitionBy("symbol").orderBy("row_idx"))
    rows = bars.withColumn("gap", gap)
    out = rows.groupBy("symbol").agg(F.min_by("timestamp", "row_idx").alias("first"), F.max_by("timestamp", "row_idx").alias("last"), F.coalesce(F.sum("gap"), F.lit(0)).alias("total_seconds"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_seconds"), F.coalesce(F.min("gap"), F.lit(0)).alias("min_seconds"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_seconds"))
    return out


def statistics(bars: DataFrame, mode: str = "standard") -> DataFrame:
    """One row per symbol: total, valid and invalid points, and the three statistics as structs. In mode "standard" bars that break a bar's logic
    are invalid; in "reference" all points count as valid, as the original has it."""
    good = bar_error().isNull() if mode == "standard" else F.lit(True)
    counts = bars.groupBy("symbol").agg(F.count("*").alias("total_points"), F.count_if(good).alias("valid_points"), F.count_if(~good).alias("invalid_points"))
    for name, part in (("prices", price_statistics(bars)), ("volumes", volume_statistics(bars)), ("times", time_statistics(bars))):
        counts = on_keys(counts, part.select("symbol", F.struct(*[c for c in part.columns if c != "symbol"]).alias(name)), "symbol")
    return counts


def suspicious(bars: DataFrame) -> DataFrame:
    """Bars with high below low, a negative open or close, or no volume."""
    return bars.where("high < low OR open < 0 OR close < 0 OR volume = 0")
