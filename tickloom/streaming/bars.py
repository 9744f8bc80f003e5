"""Streaming forms: bars from ticks, stateless signals, rolling VWAP and the strategy as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators import signals as sig
from tickloom.operators.strategy import EMITTED, NUMBERS, Machine, StrategyConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """The keyed operators here need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def bars_from_ticks(ticks: DataFrame, every: str, late: str, price: str = "value", symbol: str = "event_type", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Bars of windows of a fixed length; ticks that come more than `late` after the newest are dropped."""
    rows = ticks.select(F.col(symbol).alias("symbol"), F.col(time).cast("timestamp").alias("t"), F.col(price).alias("p"), F.struct(F.col(time), F.col(order)).alias("at")).withWatermark("t", late)
    out = rows.groupBy("symbol", F.window("t", every).alias("w")).agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count("*").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def signals(bars: DataFrame, thresholds: sig.SignalThresholds = sig.DEFAULT) -> DataFrame:
    """Incremental signals are a projection and need no state."""
    return sig.incremental_signals(bars, thresholds)


class RollingVWAP(StatefulProcessor):
    """Keeps a symbol's last n bars as (time, typical price * volume, volume). Bars of a batch come in order of time; late ones join in as they come."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", "v array<double>, q array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else ([], [])
        v, q = list(held[0]), list(held[1])
        out = []
        for r in pd.concat(list(rows)).sort_values(["timestamp", "row_idx"]).itertuples():
            v.append((r.high + r.low + r.close) / 3.0 * r.volume)
            q.append(float(r.volume))
            v, q = v[-self.n :], q[-self.n :]
            out.append((key[0], r.row_idx, r.timestamp, sum(v) / sum(q) if sum(q) else 0.0, len(v)))
        self.state.update((v, q))
        yield pd.DataFrame(out, columns=["symbol", "row_idx", "timestamp", "vwap", "data_points"])

    def close(self) -> None:
        pass


def rolling_vwap(bars: DataFrame, n: int) -> DataFrame:
    """symbol, row_idx, timestamp, vwap, data_points at every bar of a stream of bars."""
    keyed = bars.select("symbol", "row_idx", F.col("timestamp").cast("timestamp").alias("timestamp"), "high", "low", "close", "volume").groupBy("symbol")
    return keyed.transformWithStateInPandas(RollingVWAP(n), "symbol string, row_idx long, timestamp timestamp, vwap double, data_points long", "Append", "None")


_STATE = ("side", "entry_price", "entry_time", "size", "stop", "target", "last_signal", "record_price", "record_time")


class RunStrategy(StatefulProcessor):
    """Keeps a symbol's position, cooldown and latest record. A bar older than the last signal is within its cooldown."""

    def __init__(self, config: StrategyConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "side string, entry_price double, entry_time double, size double, stop double, target double, last_signal double, record_price double, record_time double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine = Machine(self.config)
        if self.state.exists():
            for name, value in zip(_STATE, self.state.get(), strict=True):
                setattr(machine, name, value)
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "row_idx"]).itertuples():
            got = machine.step(r.t, r.price, r.signal, None if pd.isna(r.strength) else r.strength, r.confidence)
            if got:
                held = got["signal"] != "Exit"
                out.append({"symbol": key[0], "row_idx": r.row_idx, "timestamp": r.timestamp, "price": r.price, "vwap": r.vwap if held else None, "strength": r.strength if held else None} | got | ({"reason": r.reason} if held else {}))
        self.state.update(tuple(getattr(machine, n) for n in _STATE))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in EMITTED.split(", ")])
        yield frame.astype({c: "float64" for c in NUMBERS})

    def close(self) -> None:
        pass


def strategy(bars: DataFrame, config: StrategyConfig | None = None) -> DataFrame:
    """What the strategy emits for a stream of bars; the batch form gives the same rows."""
    config = config or StrategyConfig()
    rows = sig.incremental_signals(bars, config.signal_thresholds)
    rows = rows.select("symbol", "row_idx", F.col("timestamp").cast("timestamp").alias("timestamp"), (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6).alias("t"), "price", "signal", "strength", "confidence", "reason", "vwap")
    return rows.groupBy("symbol").transformWithStateInPandas(RunStrategy(config), EMITTED, "Append", "None")
