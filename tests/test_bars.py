import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import T3, bars
from tickloom import errors
from tickloom.functions import bars as fb
from tickloom.functions.numeric import finite, greater, ieee_div, larger, less, smaller
from tickloom.operators import validation as v
from tickloom.plans.chunks import chunk_order, looking_back, number_rows, running_sums


def test_candle(spark):
    r = bars(spark, [(100, 105, 98, 102, 1000)]).select(fb.price_range().alias("r"), fb.body_size().alias("b"), fb.upper_shadow().alias("u"), fb.lower_shadow().alias("l"), fb.typical_price().alias("t"), fb.weighted_close().alias("w"), fb.features_f11().alias("f"), fb.features_f5k().alias("k")).first()
    assert (r.r, r.b, r.u, r.l, r.t, r.w) == (7, 2, 3, 2, 305 / 3, 407 / 4)
    assert r.f[:5] == [100, 105, 98, 102, 1000] and len(r.f) == 11 and r.k[4] == 1.0


@pytest.mark.parametrize(("o", "c", "flags"), [(100, 102, (True, False, False)), (102, 100, (False, True, False)), (100, 100.1, (True, False, True))])
def test_flags(spark, o, c, flags):
    r = bars(spark, [(o, 105, 98, c, 1)]).select(fb.is_bullish().alias("a"), fb.is_bearish().alias("b"), fb.is_doji(0.2).alias("d")).first()
    assert tuple(r) == flags


def test_doubles(spark):
    inf, nan = math.inf, math.nan
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 2.0), (4.0, 2.0)]
    got = spark.createDataFrame(rows, "a double, b double").select(ieee_div(F.col("a"), F.col("b")).alias("d"), less(F.col("a"), F.col("b")).alias("l"), greater(F.col("a"), F.col("b")).alias("g"), larger(F.col("a"), F.col("b")).alias("x"), smaller(F.col("a"), F.col("b")).alias("n"), finite(F.col("a")).alias("f")).collect()
    assert [r.d if not math.isnan(r.d) else "nan" for r in got] == [inf, -inf, "nan", "nan", 2.0]
    assert [r.l for r in got] == [False, True, False, False, False] and [r.g for r in got] == [True, False, False, False, True]
    assert got[3].x == 2.0 and got[3].n == 2.0 and not got[3].f


@pytest.mark.parametrize(
    ("bar", "message"),
    [
        ((100, 105, 98, 102, 1), None),
        ((100, 95, 98, 102, 1), "High price cannot be less than low price"),
        ((-100, 105, 98, 102, 1), "All prices must be positive"),
        ((100, 101, 98, 102, 1), "High price must be >= open and close prices"),
        ((97, 105, 98, 102, 1), "Low price must be <= open and close prices"),
        ((float("nan"), 105, 98, 102, 1), None),
    ],
)
def test_logic(spark, bar, message):
    assert bars(spark, [bar]).select(v.bar_error().alias("e")).first().e == message


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(*[st.floats(1, 1000)] * 4, st.integers(1, 10**6)), min_size=1, max_size=8))
def test_logic_holds_on_random_bars(spark, rows):
    got = bars(spark, rows).select("row_idx", v.bar_error().isNull().alias("ok")).collect()
    for r in got:
        o, h, low, c, _ = rows[r.row_idx]
        assert r.ok == (h >= max(o, c, low) and low <= min(o, c))


def test_rules(spark):
    rows = bars(spark, [(-100, 105, 98, 102, 50), (100, 250, 98, 250, 1000), (float("inf"), float("inf"), 98, 102, 1000)])
    def run(*rules, **how):
        return sorted((r.row_idx, r.error_type) for r in v.Validator(tuple(rules), **how).errors(rows).collect())

    assert run(v.price_range(0, 1000)) == [(0, "PriceRange"), (2, "PriceRange")]
    assert run(v.volume_threshold(100)) == [(0, "VolumeThreshold")]
    assert run(v.custom(lambda: F.when(F.col("close") > 200, F.lit("high")))) == [(1, "Custom")]
    assert run(v.no_missing_values()) == [(2, "NoMissingValues")]
    every = (v.logical_consistency(), v.price_range(0, 1000), v.volume_threshold(100))
    assert run(*every) == [(0, "LogicalConsistency"), (0, "PriceRange"), (0, "VolumeThreshold"), (2, "PriceRange")]
    assert run(*every, stop_on_first_error=True) == [(0, "LogicalConsistency"), (2, "PriceRange")]
    assert run(*every, max_errors=2) == [(0, "LogicalConsistency"), (0, "PriceRange"), (0, "VolumeThreshold")]
    assert run() == [] and v.Validator().add_rule(v.volume_threshold(1)).add_rules([]).is_valid(rows)


def test_context(spark):
    rows = bars(spark, T3).withColumn("timestamp", F.col("timestamp") - F.make_dt_interval(hours=F.when(F.col("row_idx") == 1, 1).otherwise(0).cast("int")))
    assert [(r.row_idx, r.previous_idx) for r in v.duplicate_timestamps(rows).collect()] == [(1, 0)]
    assert [r.row_idx for r in v.order_violations(rows).collect()] == [1]
    assert [(r.row_idx, r.gap_seconds) for r in v.time_gaps(rows, 3600).collect()] == [(2, 7200)]


def test_outliers(spark):
    rows = bars(spark, [*T3[:2], (100000, 100005, 99998, 100002, 1)])
    assert {r.row_idx for r in v.outliers_zscore(rows, 1.4).collect()} == {2}
    assert {r.row_idx for r in v.outliers_modified_zscore(rows, 3.0, "standard").collect()} == {2}
    assert v.outliers_modified_zscore(rows, 0.6745).collect() == []


def test_statistics(spark):
    r = v.statistics(bars(spark, T3[:2])).first()
    assert (r.total_points, r.valid_points, r.invalid_points) == (2, 2, 0)
    assert (r.prices["min"], r.prices["max"], r.volumes["min"], r.volumes["max"]) == (98, 107, 1000, 1200)
    assert r.volumes["median"] == 1100 and r.times["total_seconds"] == 3600


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_chunks_change_nothing(spark, chunk):
    rows = bars(spark, [(k, k + 2, k - 1, k + 1, k % 5) for k in range(2, 60)])
    w = Window.partitionBy("symbol").orderBy("row_idx")
    want = rows.select("row_idx", F.sum("close").over(w.rowsBetween(-3, 0)).alias("s"), F.sum("volume").over(w).alias("r")).orderBy("row_idx").collect()
    got = looking_back(rows, 3, {"s": F.sum("close").over(chunk_order().rowsBetween(-3, 0))}, chunk).select("row_idx", "s").orderBy("row_idx").collect()
    assert [(r.row_idx, r.s) for r in got] == [(r.row_idx, r.s) for r in want]
    run = running_sums(rows, {"r": F.col("volume").cast("double")}, chunk).select("row_idx", "r").orderBy("row_idx").collect()
    assert [r.r for r in run] == [r.r for r in want]


def test_numbers_follow_time(spark):
    rows = bars(spark, [(1, 1, 1, 1, 1)] * 60).withColumnRenamed("row_idx", "want").repartition(5)
    assert number_rows(rows).where("row_idx <> want").count() == 0


def test_error_texts():
    assert str(errors.MissingColumn("volume")) == "Missing required column: volume"
    assert str(errors.InsufficientData(3, 1)) == "Insufficient data for clustering: need at least 3 points, got 1"
    assert str(errors.EmptyDataset()) == "Dataset is empty" and isinstance(errors.EmptyDataset(), errors.EngineError)
