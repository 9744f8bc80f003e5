import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T3, bars
from tickloom import errors
from tickloom.operators import analytics, monitor, strategy, validation
from tickloom.operators import signals as sig
from tickloom.operators import vwap as vwaps
from tickloom.plans.chunks import number_rows
from tickloom.streaming import bars as streams

BUY, SELL = [*T3, (110, 115, 108, 112, 1500)], [*T3, (90, 95, 88, 92, 1500)]


def test_scopes(spark):
    rows = bars(spark, T3)
    tp = [(h + low + c) / 3 for _, h, low, c, _ in T3]
    weigh = lambda k: sum(t * r[4] for t, r in zip(tp[k:], T3[k:], strict=True)) / sum(r[4] for r in T3[k:])
    r = vwaps.session(rows).first()
    assert math.isclose(r.vwap, weigh(0)) and r.data_points == 3 and r.total_volume == 3300
    r = vwaps.rolling(rows, 2).first()
    assert math.isclose(r.vwap, weigh(1)) and r.data_points == 2
    assert math.isclose(vwaps.anchored(rows, datetime(2024, 1, 1, 1)).first().vwap, weigh(1))
    assert math.isclose(vwaps.between(rows, datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 2)).first().vwap, tp[2])
    assert vwaps.anchored(rows, datetime(2030, 1, 1)).collect() == []
    with pytest.raises(errors.EmptyDataset):
        vwaps.rolling(rows, 0)
    assert [round(r.vwap, 9) for r in vwaps.incremental(rows).orderBy("row_idx").collect()] == [round(t, 9) for t in tp]
    assert vwaps.session(bars(spark, [(1, 1, 1, 1, 0)])).first().vwap == 0


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_series_do_not_depend_on_chunks(spark, chunk):
    rows = bars(spark, [(k, k + 2, k - 1, k + 1, k % 5) for k in range(2, 40)])
    want = vwaps.rolling_at_every_bar(rows, 4).orderBy("row_idx").collect()
    assert vwaps.rolling_at_every_bar(rows, 4, chunk).orderBy("row_idx").collect() == want
    run = vwaps.running(rows, chunk).orderBy("row_idx").collect()
    assert [round(r.vwap, 9) for r in run] == [round(r.vwap, 9) for r in vwaps.running(rows).orderBy("row_idx").collect()]
    assert math.isclose(run[-1].vwap, vwaps.session(rows).first().vwap)


def test_signals(spark):
    t = sig.SignalThresholds(vwap_buy_threshold=0.01, vwap_sell_threshold=0.01)
    r = sig.batch_signal(bars(spark, BUY), t).first()
    assert (r.signal, r.price, r.volume) == ("Buy", 112, 1500) and r.reason.endswith("above VWAP") and 0 <= r.confidence <= 1
    r = sig.batch_signal(bars(spark, SELL), t).first()
    assert r.signal == "Sell" and r.reason.endswith("below VWAP")
    r = sig.batch_signal(bars(spark, T3[:1]), sig.SignalThresholds(vwap_buy_threshold=1, vwap_sell_threshold=1)).first()
    assert r.signal == "Hold" and r.strength is None
    assert sig.batch_signal(bars(spark, [])).collect() == []


def test_without_volume_the_signal_is_a_sure_buy(spark):
    r = sig.incremental_signals(bars(spark, [(100, 105, 98, 102, 0)])).first()
    assert (r.signal, r.vwap, r.strength, r.confidence) == ("Buy", 0.0, math.inf, 0.9)


def test_counts(spark):
    emitted = spark.createDataFrame([("x", s) for s in ("Buy", "Sell", "Exit", "Hold", "Buy")], "symbol string, signal string")
    assert tuple(sig.signal_counts(emitted).first()) == ("x", 5, 2, 2, 1)


def test_config():
    for how in ({"name": ""}, {"max_position_size": 0}, {"stop_loss_pct": 0}, {"take_profit_pct": -1}):
        with pytest.raises(errors.ConfigError):
            strategy.StrategyConfig(**how).validate()
    assert strategy.StrategyConfig().validate().max_position_size == 10_000


def test_machine():
    m = strategy.Machine(strategy.StrategyConfig())
    assert m.step(0, 100, "Buy", 0.8, 0.8)["opened"] == "Long" and (m.stop, m.target, m.size) == (98, 104, 8000)
    assert m.step(30, 101, "Sell", 0.5, 0.9) is None
    assert m.step(60, 101, "Sell", 0.5, 0.9)["opened"] is None
    out = m.step(61, 104, "Buy", 0.5, 0.9)
    assert (out["signal"], out["closed"], out["pnl"], out["standard_pnl"], out["duration"]) == ("Exit", "Long", 3, 4, 1)
    assert m.step(120, 100, "Sell", 2.0, 0.9)["opened"] == "Short" and (m.stop, m.target, m.size) == (102, 96, 10_000)
    assert m.step(50, 100, "Sell", 1, 0.9) is None
    assert m.step(200, 100, "Buy", 1, 0.9)["opened"] is None
    assert m.step(300, 103, "Buy", 1, 0.9)["standard_pnl"] == -3
    assert m.step(400, 103, "Buy", 1, 0.1)["opened"] is None


def emitted(spark, rows):
    """(signal, price, pnl) in order."""
    data = [("x", k, datetime(2024, 1, 1) + timedelta(hours=k), s, float(p), None if g is None else float(g)) for k, (s, p, g) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, row_idx long, timestamp timestamp_ntz, signal string, price double, pnl double")


def test_metrics(spark):
    one = emitted(spark, [("Buy", 100, None), ("Exit", 105, 5)])
    r = monitor.trade_metrics(monitor.trades(one)).first()
    assert (r.total, r.winning, r.losing, r.win_rate, r.total_pnl) == (1, 1, 0, 1, 5)
    two = emitted(spark, [("Buy", 100, None), ("Exit", 105, 5), ("Sell", 100, None), ("Exit", 98, -2), ("Buy", 1, None), ("Exit", 1, 0)])
    r = monitor.metrics(monitor.trades(two)).first()
    assert (r.total, r.win_rate, r.total_pnl, r.avg_pnl, r.peak_equity, r.max_drawdown, r.current_drawdown) == (2, 0.5, 3, 1.5, 5, 0.4, 0.4)
    assert math.isclose(r.sharpe, 1 / math.sqrt(26 / 3)) and r.sortino == 0.5
    r = monitor.risk(monitor.trades(one)).first()
    assert (r.sharpe, r.sortino) == (0, 5)


def test_alerts(spark):
    rows = emitted(spark, [x for _ in range(5) for x in (("Buy", 100, None), ("Exit", 95, -5))])
    got = monitor.alerts(rows, monitor.MonitorConfig(drawdown_threshold=0.05, win_rate_threshold=0.6, pnl_threshold=-10)).collect()
    assert {r.alert_type for r in got} == {"PnLLow"} and len(got) == 5
    up = emitted(spark, [("Buy", 1, None), ("Exit", 1, 10), ("Buy", 1, None), ("Exit", 1, -5)])
    assert [(r.alert_type, r.current) for r in monitor.alerts(up).collect()] == [("DrawdownExceeded", 0.5)]
    assert [r.seq for r in monitor.recent(monitor.alerts(rows, monitor.MonitorConfig(pnl_threshold=0)), 3).orderBy("seq").collect()] == [1, 2, 3]
    assert [r.row_idx for r in monitor.history(rows, 2).orderBy("seq").collect()] == [8, 6]


def wave(spark, n=200):
    rows = []
    for k in range(n):
        p = 100 + 10 * math.sin(k / 5) + (k * 37 % 11)
        rows.append((p, p + 2 + k % 3, p - 2, p + math.cos(k) * 1.9, 100 + k % 17))
    return rows


def test_strategy_does_not_depend_on_partitions(spark):
    both = bars(spark, wave(spark), "a").union(bars(spark, wave(spark)[::-1], "b"))
    want = sorted(map(str, strategy.run_incremental(both).collect()))
    assert want == sorted(map(str, strategy.run_incremental(both.repartition(7)).collect())) and len(want) > 100
    alone = [r for r in want if "symbol='b'" in r]
    assert alone == sorted(map(str, strategy.run_incremental(bars(spark, wave(spark)[::-1], "b")).collect()))


def test_backtest(spark):
    rows = spark.createDataFrame([("x", k, "Exit", 100.0, 1000.0, g) for k, g in enumerate([10.0, 10.0, -5.0, 10.0])], "symbol string, row_idx long, signal string, price double, size double, standard_pnl double")
    r = analytics.backtest(rows).first()
    assert (r.trades, r.longest_wins, r.longest_losses, r.profit_factor) == (4, 2, 1, 6.0) and math.isclose(r.total_return, 0.025)


def test_sizing(spark):
    r = spark.range(1).select(analytics.position_size(F.lit(10_000.0), F.lit(0.01), F.lit(100.0), F.lit(98.0)).alias("n"), analytics.dynamic_stop(F.lit(100.0), F.lit(0.01)).alias("s")).first()
    assert (r.n, r.s) == (50.0, 98.0)


@pytest.fixture
def arriving(spark, tmp_path):
    """Bars as files that a stream reads one by one."""
    streams.use_rocksdb(spark)
    rows = bars(spark, wave(spark, 90)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for k in range(3):
        rows.where(F.floor(F.col("row_idx") / 30) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        return spark.table(name)

    return rows, stream, run


def test_streams_equal_batches(arriving):
    rows, stream, run = arriving
    want = vwaps.rolling_at_every_bar(rows, 5).select("row_idx", F.round("vwap", 9).alias("vwap"), "data_points")
    got = run(streams.rolling_vwap(stream, 5), "rolling_stream").select("row_idx", F.round("vwap", 9).alias("vwap"), "data_points")
    assert sorted(got.collect()) == sorted(want.collect())
    names = ["row_idx", "signal", "price", "opened", "closed", "pnl", "duration"]
    got = run(streams.strategy(stream), "strategy_stream").select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("pnl", "duration") else F.col(c) for c in names])
    assert sorted(map(str, got.collect())) == sorted(map(str, strategy.run_incremental(rows).select(*names).collect()))
    assert run(streams.signals(stream), "signal_stream").count() == 90


def test_bars_from_a_stream_of_ticks(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streams.bars_from_ticks(stream, "1 day", "1 hour").writeStream.format("memory").queryName("tick_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("tick_bars")
    from tickloom.sources.bars import bars_from_events

    want = bars_from_events(spark, "/root/testdata/sf0.001", "day")
    ours = {(r.symbol, str(r.timestamp)): (r.open, r.high, r.low, r.close, r.volume) for r in got.collect()}
    theirs = {(r.symbol, str(r.timestamp)): (r.open, r.high, r.low, r.close, r.volume) for r in want.collect()}
    assert ours and all(theirs[k] == v for k, v in ours.items()) and len(ours) >= len(theirs) - 5


def test_rows_without_symbol_or_time_stay(spark):
    """Null symbols are a symbol, null times come first, and no join loses them."""
    rows = bars(spark, T3).withColumn("symbol", F.lit(None).cast("string")).unionByName(bars(spark, T3)).withColumn("timestamp", F.when(F.col("row_idx") != 1, F.col("timestamp")))
    numbered = number_rows(rows.drop("row_idx"))
    assert sorted((r.symbol or "", r.row_idx) for r in numbered.collect()) == [("", 0), ("", 1), ("", 2), ("x", 0), ("x", 1), ("x", 2)]
    assert [r.open for r in numbered.where("row_idx = 0").collect()] == [102.0, 102.0]
    count = lambda df: df.where("symbol IS NULL").count()
    assert count(vwaps.running(numbered)) == count(vwaps.rolling_at_every_bar(numbered, 2)) == 3
    assert count(vwaps.rolling(numbered, 2)) == count(sig.batch_signal(numbered)) == count(validation.price_statistics(numbered)) == 1
    assert count(validation.outliers_zscore(numbered, 1.0)) == validation.outliers_zscore(numbered, 1.0).where("symbol = 'x'").count() > 0
    assert count(analytics.technical_features(numbered)) == count(analytics.market_quotes(numbered)) == 3


def test_retained_alerts(spark):
    """As a list that loses its oldest 50 whenever an event takes it beyond 100."""
    rnd = random.Random(2)
    for events in (5, 60, 200):
        held, rows = [], []
        for k in range(events):
            for place in range(rnd.randint(0, 3)):
                rows.append(("x", k, place, f"a{place}", 1.0, 0.0))
                held.append((k, place))
            held = held[50:] if len(held) > 100 else held
        got = monitor.retained(spark.createDataFrame(rows, "symbol string, row_idx int, place int, alert_type string, current double, threshold double")).orderBy("seq").collect()
        assert [(r.row_idx, int(r.alert_type[1:])) for r in got] == held and [r.seq for r in got] == list(range(1, len(held) + 1))


def test_latency_and_failures_alert(spark):
    rows = spark.createDataFrame([("x", 0, "Buy", None, 0.0001, None), ("x", 1, "Buy", None, 0.01, None), ("x", 2, "Hold", None, None, "no data")], "symbol string, row_idx long, signal string, pnl double, latency double, error string")
    assert sorted((r.row_idx, r.alert_type) for r in monitor.alerts(rows).collect()) == [(1, "LatencyHigh"), (2, "LatencyHigh"), (2, "SignalGenerationFailed")]
    assert monitor.latency_statistics(rows).collect()[0].calls == 2


def test_strategy_surface(spark):
    one = strategy.VWAPStrategy().with_name("n").with_vwap_type("rolling", 2).with_config(strategy.StrategyConfig(name="m"))
    assert one.config.name == "m" and one.vwap_type == ("rolling", 2) and one.real_time
    one.validate_config()
    rows = bars(spark, [*T3, (110, 115, 108, 112, 1500)])
    same = strategy.VWAPStrategy(mode="standard").with_vwap_type("rolling", 1).execute(rows).collect()[0]
    assert same.vwap == (115 + 108 + 112) / 3 and one.execute(rows).collect()[0].vwap != same.vwap
    emitted = one.execute_incremental(rows).collect()
    assert all(r.reason == strategy.EXIT_REASON and r.vwap is None for r in emitted if r.signal == "Exit") and all(r.vwap for r in emitted if r.signal != "Exit")
    assert one.get_position(rows).count() <= 1 and one.get_performance(rows).count() <= 1
