"""Bars built from other tables, and regrouping of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.sources.schema import BAR


def _bars(ticks: DataFrame, unit: str, price: Column, symbol: Column, volume: Column, order: list[str]) -> DataFrame:
    """One bar a symbol and unit of time; one aggregation that sums up before rows are dealt."""
    rows = ticks.select(symbol.alias("symbol"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("timestamp"), price.alias("p"), volume.alias("v"), F.struct("ts", *order).alias("at"))
    return rows.groupBy("symbol", "timestamp").agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").cast("long").alias("volume")
    )


def bars_from_events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """symbol: the event's type; price: its value; volume: the number of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _bars(events, unit, F.col("value"), F.col("event_type"), F.lit(1), ["event_id"])


def bars_from_lineitem(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """symbol: the return flag; price: extended price per piece; volume: pieces."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ts", F.col("l_shipdate"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return _bars(items, unit, price, F.col("l_returnflag"), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


def resample(bars: DataFrame, every: str) -> DataFrame:
    """Coarser bars, on windows of a fixed length ("4 hours")."""
    at = F.struct("timestamp", *(["row_idx"] if "row_idx" in bars.columns else []))
    rows = bars.select("symbol", F.window(F.col("timestamp").cast("timestamp"), every)["start"].cast("timestamp_ntz").alias("w"), "open", "high", "low", "close", "volume", at.alias("at"))
    out = rows.groupBy("symbol", "w").agg(F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.sum("volume").cast("long").alias("volume"))
    return out.withColumnRenamed("w", "timestamp")


FORMATS = ("csv", "json", "parquet")


def write_bars(bars: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write bars in one of FORMATS; csv with a header."""
    if kind not in FORMATS:
        raise errors.ConfigError("kind", f"must be one of {', '.join(FORMATS)}")
    writer = bars.write.mode(mode)
    (writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ssXX") if kind == "csv" else writer).format(kind).save(path)


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", zone: str | None = None) -> DataFrame:
    """Bars (symbol, timestamp, prices, volume) of a JSON or Parquet table; missing columns are null. Times are taken as UTC, or, with
    zone, as that zone's wall clock and converted to UTC."""
    if kind not in ("json", "parquet"):
        raise errors.ConfigError("kind", "must be json or parquet; CSV has a loader of its own")
    fields = {f.name: f.dataType.simpleString() for f in BAR.fields if f.name != "row_idx"} | {"timestamp": "timestamp_ntz"}
    raw = spark.read.schema(", ".join(f"{n} {t}" for n, t in fields.items())).json(path) if kind == "json" else spark.read.parquet(path)
    out = raw.select(*[(F.col(n) if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in fields.items()])
    return out.withColumn("timestamp", F.convert_timezone(F.lit(zone), F.lit("UTC"), "timestamp")) if zone else out
