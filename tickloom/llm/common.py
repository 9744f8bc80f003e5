"""Helpers shared by the corpus operators: reading and word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.storage import discard, materialise  # noqa: F401

#: The white space that separates words, as a Java regex class: blank and U+0009 to U+000D.
BLANKS = " \\t-\\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text (runs of anything but blanks) as an array; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def plain_words(text: Column) -> Column:
    """As words, of a text that isn't null; one pass by a plain blank, without regular expressions."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


#: Bits of a table at most, as a power of two; bits a key, as long as that allows.
TABLE_BITS, BITS_A_KEY = 28, 16


def table_bits(keys: int) -> int:
    return min(TABLE_BITS, max(16, int(keys * BITS_A_KEY).bit_length()))


def bit_table(hashes: DataFrame, column: str) -> tuple[int, bytes]:
    """(bits, table): a packed table of 2^bits bits in which the place of each hash (a long, by its leading bits) is set. Summed up on the
    executors; the driver gets the table, 32 MB at most."""
    bits = table_bits(hashes.count())
    place = F.call_function("shiftrightunsigned", F.col(column), F.lit(64 - bits)) + 1
    parts = hashes.select(F.call_function("bitmap_bucket_number", place).alias("k"), F.call_function("bitmap_bit_position", place).alias("p"))
    table = bytearray(max(1 << bits >> 3, 4096))
    for k, bitmap in parts.groupBy("k").agg(F.call_function("bitmap_construct_agg", F.col("p"))).toLocalIterator():
        table[(k - 1) * 4096 : k * 4096] = bitmap
    return bits, bytes(table)


def in_table(hashes: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a table (as bytes) of so many bits."""
    place = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
