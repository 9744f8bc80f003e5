"""Windows over long series without one task per series.

row_idx numbers the rows of a symbol. Rows are grouped into chunks of consecutive numbers, so that a symbol with a third
of all rows is many groups; a window that looks back n rows gets the last n rows of the chunk before as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def on_keys(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, where null equals null, so that rows without a symbol or time stay."""
    keys = [keys] if isinstance(keys, str) else keys
    other = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return left.join(other, same, how).drop(*[f"__on_{k}" for k in keys])


def number_rows(rows: DataFrame, order: str = "timestamp", key: str = "symbol") -> DataFrame:
    """row_idx: 0, 1, ... by time within a symbol, null times first; rows without a symbol are a symbol. Days are counted and prefixed first, so a
    task numbers one day."""
    day = F.to_date(order)
    counts = rows.groupBy(key, day.alias("__day")).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(key, "__day").orderBy(order))
    out = on_keys(rows.withColumn("__day", day).withColumn("__at", inside), before.drop("__n"), [key, "__day"])
    return out.withColumn("row_idx", (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__day", "__at", "__before")


def chunked(rows: DataFrame, back: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows with __chunk and __copy: each chunk also has the `back` rows before it, marked as copies."""
    size = max(chunk_rows, back)
    chunk, at = F.floor(F.col("row_idx") / size), F.col("row_idx") % size
    own = F.struct(chunk.alias("c"), F.lit(False).alias("copy"))
    both = F.array(own, F.struct((chunk + 1).alias("c"), F.lit(True).alias("copy")))
    out = rows.withColumn("__x", F.explode(F.when(at >= size - back, both).otherwise(F.array(own)) if back else F.array(own)))
    return out.withColumns({"__chunk": F.col("__x.c"), "__copy": F.col("__x.copy")}).drop("__x")


def chunk_order() -> Window:
    return Window.partitionBy("symbol", "__chunk").orderBy("row_idx")


def looking_back(rows: DataFrame, back: int, columns: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows plus window columns over chunk_order() that look back at most `back` rows."""
    return chunked(rows, back, chunk_rows).withColumns(columns).where(~F.col("__copy")).drop("__chunk", "__copy")


def running_sums(rows: DataFrame, sums: dict[str, Column], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows plus, for each name, the sum of an expression over all rows of the symbol up to this one."""
    parts = chunked(rows, 0, chunk_rows).drop("__copy").withColumns({f"__v_{n}": e for n, e in sums.items()})
    totals = parts.groupBy("symbol", "__chunk").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    w = Window.partitionBy("symbol").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("symbol", "__chunk", *[F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0.0)).alias(f"__b_{n}") for n in sums])
    inside = chunk_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = on_keys(parts.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in sums}), before, ["symbol", "__chunk"])
    return out.withColumns({n: F.col(f"__b_{n}") + F.col(f"__r_{n}") for n in sums}).drop("__chunk", *[f"__{k}_{n}" for n in sums for k in "vrb"])
