"""Scalar functions of a bar, as column expressions over open, high, low, close and volume."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import ieee_div, larger, smaller

_c = F.col


def price_range() -> Column:
    return _c("high") - _c("low")


def body_size() -> Column:
    return F.abs(_c("close") - _c("open"))


def upper_shadow() -> Column:
    return _c("high") - larger(_c("open"), _c("close"))


def lower_shadow() -> Column:
    return smaller(_c("open"), _c("close")) - _c("low")


def typical_price() -> Column:
    return (_c("high") + _c("low") + _c("close")) / F.lit(3.0)


def weighted_close() -> Column:
    return (_c("high") + _c("low") + _c("close") + _c("close")) / F.lit(4.0)


def is_bullish() -> Column:
    return _c("close") > _c("open")


def is_bearish() -> Column:
    return _c("close") < _c("open")


def is_doji(tolerance: float) -> Column:
    return body_size() <= F.lit(tolerance)


def features_f4() -> Column:
    return F.array("open", "high", "low", "close")


def features_f5() -> Column:
    return F.array("open", "high", "low", "close", _c("volume").cast("double"))


def features_f5k() -> Column:
    """As f5 with the volume in thousands."""
    return F.array("open", "high", "low", "close", _c("volume") / F.lit(1000.0))


def features_f11() -> Column:
    return F.array("open", "high", "low", "close", _c("volume").cast("double"), price_range(), body_size(), upper_shadow(), lower_shadow(), typical_price(), weighted_close())


def in_order() -> Window:
    """Bars of a symbol in time order; row_idx decides between equal times."""
    return Window.partitionBy("symbol").orderBy("timestamp", "row_idx")


def returns(order: Window | None = None) -> Column:
    """(close - previous close) / previous close; null for the first bar of a symbol."""
    before = F.lag("close").over(order or in_order())
    return F.when(before.isNotNull(), ieee_div(_c("close") - before, before))


def log_returns(order: Window | None = None) -> Column:
    before = F.lag("close").over(order or in_order())
    return F.when(before.isNotNull(), F.log(ieee_div(_c("close"), before)))
