"""The VWAP strategy: a state machine per symbol with stop loss, take profit and cooldown."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators import monitor
from tickloom.operators import signals as sig
from tickloom.operators import vwap as vwaps

COOLDOWN_SECONDS = 60.0
EXIT_REASON = "Stop loss or take profit hit"  # fixed value


@dataclass(frozen=True)
class StrategyConfig:
    name: str = "VWAP Strategy"
    max_position_size: float = 10_000.0
    stop_loss_pct: float = 0.02
    take_profit_pct: float = 0.04
    signal_thresholds: sig.SignalThresholds = field(default_factory=sig.SignalThresholds)
    cooldown_seconds: float = COOLDOWN_SECONDS

    def validate(self) -> StrategyConfig:
        if not self.name:
            raise errors.ConfigError("name", "Strategy name cannot be empty")
        if self.max_position_size <= 0:
            raise errors.ConfigError("max_position_size", "Max position size must be positive")
        if self.stop_loss_pct <= 0 or self.take_profit_pct <= 0:
            raise errors.ConfigError("stop_loss_pct/take_profit_pct", "Stop loss and take profit percentages must be positive")
        return self


@dataclass
class Machine:
    """State of one symbol. Times are seconds. step() takes a bar with its signal and returns what it emits, or None."""

    config: StrategyConfig
    side: str | None = None
    entry_price: float = 0.0
    entry_time: float = 0.0
    size: float = 0.0
    stop: float = 0.0
    target: float = 0.0
    last_signal: float | None = None
    record_price: float = 0.0
    record_time: float = 0.0

    def must_close(self, price: float) -> bool:
        if self.side == "Long":
            return price <= self.stop or price >= self.target
        return self.side == "Short" and (price >= self.stop or price <= self.target)

    def step(self, time: float, price: float, signal: str, strength: float | None, confidence: float) -> dict | None:
        """An exit closes the latest recorded signal (pnl, duration): its price subtracted from the exit's, for shorts too.
        standard_pnl is that of the position itself."""
        if self.side and self.must_close(price):
            sign = 1.0 if self.side == "Long" else -1.0
            out = {"signal": "Exit", "reason": EXIT_REASON, "closed": self.side, "opened": None, "size": self.size, "pnl": price - self.record_price, "duration": max(0.0, time - self.record_time), "standard_pnl": sign * (price - self.entry_price), "confidence": 1.0}
            self.side = None
            return out
        if self.last_signal is not None and max(0.0, time - self.last_signal) < self.config.cooldown_seconds:
            return None
        self.last_signal = self.record_time = time
        self.record_price = price
        opened = None
        if self.side is None and signal in ("Buy", "Sell") and confidence >= self.config.signal_thresholds.min_confidence:
            opened = self.side = "Long" if signal == "Buy" else "Short"
            up, down = (self.config.take_profit_pct, self.config.stop_loss_pct) if opened == "Long" else (self.config.stop_loss_pct, self.config.take_profit_pct)
            low, high = price * (1.0 - down), price * (1.0 + up)
            self.stop, self.target = (low, high) if opened == "Long" else (high, low)
            self.entry_price, self.entry_time, self.size = price, time, self.config.max_position_size * min(strength or 0.0, 1.0)
        return {"signal": signal, "reason": None, "closed": None, "opened": opened, "size": self.size if opened else None, "pnl": None, "duration": None, "standard_pnl": None, "confidence": confidence}


EMITTED = "symbol string, row_idx long, timestamp timestamp, signal string, price double, confidence double, opened string, closed string, size double, pnl double, duration double, standard_pnl double, reason string, vwap double, strength double"
_OUT = [x.split()[0] for x in EMITTED.split(", ")]
NUMBERS = [x.split()[0] for x in EMITTED.split(", ") if x.endswith(" double")]


def run_incremental(bars: DataFrame, config: StrategyConfig | None = None) -> DataFrame:
    """What the strategy emits for each symbol's bars in order of row_idx; bars that emit nothing have no row.

    The signals are a projection; only position, cooldown and latest record are state. Bars are dealt by symbol and
    sorted, and a task folds them as a stream: it never holds a symbol's bars at once. The order within a symbol is inherent.
    """
    config = config or StrategyConfig()
    rows = sig.incremental_signals(bars, config.signal_thresholds)
    rows = rows.select("symbol", "row_idx", F.col("timestamp").cast("timestamp").alias("timestamp"), (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6).alias("t"), "price", "signal", "strength", "confidence", "reason", "vwap")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, symbol, begun = Machine(config), None, False
        for part in parts:
            out = []
            for s, i, at, t, price, kind, power, sure, why, vwap in part.itertuples(index=False, name=None):
                if not begun or s != symbol:
                    machine, symbol, begun = Machine(config), s, True
                got = machine.step(t, price, kind, None if power is None or math.isnan(power) else power, sure)
                if got:
                    held = got["signal"] != "Exit"
                    out.append({"symbol": s, "row_idx": i, "timestamp": at, "price": price, "vwap": vwap if held else None, "strength": power if held else None} | got | ({"reason": why} if held else {}))
            yield pd.DataFrame(out, columns=_OUT).astype({c: "float64" for c in NUMBERS})

    dealt = rows.repartition("symbol").sortWithinPartitions("symbol", "row_idx")
    out = dealt.mapInPandas(fold, EMITTED)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in NUMBERS if c not in ("price", "confidence")}).withColumn("timestamp", F.col("timestamp").cast(bars.schema["timestamp"].dataType))


def execute(bars: DataFrame, config: StrategyConfig | None = None, scope=vwaps.vwap) -> DataFrame:
    """The one signal of each symbol's last bar, with the position that it opens (side, size, stop_loss, take_profit)."""
    config = config or StrategyConfig()
    rows = sig.batch_signal(bars, config.signal_thresholds, scope)
    return with_position(rows, config)


def with_position(rows: DataFrame, config: StrategyConfig) -> DataFrame:
    sure = F.col("confidence") >= config.signal_thresholds.min_confidence
    side = F.when(sure & (F.col("signal") == "Buy"), "Long").when(sure & (F.col("signal") == "Sell"), "Short")
    out = rows.withColumn("position", side)
    size = F.when(F.col("position").isNotNull(), F.lit(config.max_position_size) * F.least(F.col("strength"), F.lit(1.0)))
    move = lambda long, short: F.when(F.col("position") == "Long", F.col("price") * (1.0 + long)).when(F.col("position") == "Short", F.col("price") * (1.0 + short))
    return out.withColumns({"size": size, "stop_loss": move(-config.stop_loss_pct, config.stop_loss_pct), "take_profit": move(config.take_profit_pct, -config.take_profit_pct)})


class TradingStrategy(ABC):
    """What a strategy offers: signals of whole series, of bars one at a time, figures of its trades, and a check of its options."""

    @abstractmethod
    def execute(self, bars: DataFrame) -> DataFrame: ...

    @abstractmethod
    def execute_incremental(self, bars: DataFrame) -> DataFrame: ...

    @abstractmethod
    def get_performance(self, bars: DataFrame) -> DataFrame: ...

    @abstractmethod
    def validate_config(self) -> None: ...


@dataclass(frozen=True)
class VWAPStrategy(TradingStrategy):
    """The strategy with its options; each with_ method returns a changed copy. vwap_type ("session", "rolling", "anchored" or "custom", with its
    arguments) and real_time are kept; in mode "reference" signals use the session scope whatever vwap_type says, in "standard" the scope it names."""

    config: StrategyConfig = field(default_factory=StrategyConfig)
    vwap_type: tuple = ("session",)
    real_time: bool = True
    mode: str = "reference"

    def with_config(self, config: StrategyConfig) -> VWAPStrategy:
        return replace(self, config=config)

    def with_name(self, name: str) -> VWAPStrategy:
        return replace(self, config=replace(self.config, name=name))

    def with_vwap_type(self, kind: str, *arguments) -> VWAPStrategy:
        return replace(self, vwap_type=(kind, *arguments))

    def with_signal_thresholds(self, thresholds: sig.SignalThresholds) -> VWAPStrategy:
        return replace(self, config=replace(self.config, signal_thresholds=thresholds))

    def scope(self) -> Callable[[DataFrame], DataFrame]:
        kind, *arguments = self.vwap_type if self.mode == "standard" else ("session",)
        found = {"session": vwaps.session, "rolling": vwaps.rolling, "anchored": vwaps.anchored, "custom": vwaps.between}[kind]
        return lambda bars: found(bars, *arguments)

    def execute(self, bars: DataFrame) -> DataFrame:
        return execute(bars, self.config, self.scope())

    def execute_incremental(self, bars: DataFrame) -> DataFrame:
        return run_incremental(bars, self.config)

    def get_position(self, bars: DataFrame) -> DataFrame:
        """symbol, side, entry_price, size of the positions that are open after the last bar."""
        last = self.execute_incremental(bars).where("opened IS NOT NULL OR closed IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("opened", "price", "size"), "row_idx").alias("x"))
        return last.where("x.opened IS NOT NULL").select("symbol", F.col("x.opened").alias("side"), F.col("x.price").alias("entry_price"), "x.size")

    def get_performance(self, bars: DataFrame) -> DataFrame:
        return monitor.metrics(monitor.trades(self.execute_incremental(bars)))

    def validate_config(self) -> None:
        self.config.validate()
        if self.vwap_type[0] not in ("session", "rolling", "anchored", "custom"):
            raise errors.ConfigError("vwap_type", "must be session, rolling, anchored or custom")
