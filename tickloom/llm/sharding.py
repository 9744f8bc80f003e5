"""Sharding with a k-d tree over metadata.

The rows' metadata (never their texts) go through one level of the tree at a time. A node that must still give k leaves is
split where k // 2 of its k-th parts of bytes lie below, along the dimension in which it is widest; each dimension is
scaled by its extent over all rows. A string's coordinate is the rank of its value among the distinct values, so all of it counts. Rows with equal
coordinates are ordered by a hash of their text and then by id, so a dimension with few values can be cut anywhere. The weighted median is exact and found
without gathering a node: the rows are range-partitioned by node and coordinate, the bytes of every range are summed and prefixed, and only the range in
which a node's cut falls is prefixed row by row. Nodes, sums and cuts are tables, joined to the rows: a tree of very many leaves is no long expression,
and nothing goes to the driver but the number of the nodes that are still open.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialise


def _ranks(docs: DataFrame, column: str) -> DataFrame:
    """(value, rank) of the distinct values in order, null first: counted per range of values, then within it."""
    values = docs.select(F.col(column).cast("string").alias("value")).distinct()
    dealt = materialise(values.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("pid", F.spark_partition_id()), "values")
    counts = dealt.groupBy("pid").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("value").asc_nulls_first()))
    return dealt.withColumn("at", inside).join(before, "pid").select("value", (F.col("before") + F.col("at")).cast("double").alias("rank"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, a hash of the text, and one coordinate a dimension: the size
    (logarithm) and the named columns, numbers as they are and strings by rank; null comes first."""
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    strings = [docs.schema[c].dataType.simpleString() == "string" for c in dims]
    named = [(F.col(c) if s else F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(f"d{k + 1}") for k, (c, s) in enumerate(zip(dims, strings, strict=True))]
    out = materialise(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.log2(size).alias("d0"), *named), "values")
    for k, s in enumerate(strings):
        if s:
            ranked = out.join(_ranks(out, f"d{k + 1}"), F.col(f"d{k + 1}").eqNullSafe(F.col("value")))
            out = ranked.withColumn(f"d{k + 1}", F.col("rank")).drop("value", "rank")
    return out


def _row_key(dim: str) -> list[Column]:
    return [F.col(dim), F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("size")]


def _at_most(upto: str) -> Column:
    """The row's key is at most the cut's (a struct v, h, doc_id, size), null ids first."""
    cut = {c: F.col(f"{upto}.{c}") for c in ("v", "h", "doc_id", "size")}
    own, theirs = F.col("doc_id"), cut["doc_id"]
    less = own.isNull() & theirs.isNotNull() | F.coalesce(own < theirs, F.lit(False))
    by_id = less | own.eqNullSafe(theirs) & (F.col("size") <= cut["size"])
    return (F.col("v") < cut["v"]) | (F.col("v") == cut["v"]) & ((F.col("h") < cut["h"]) | (F.col("h") == cut["h"]) & by_id)


def split(meta: DataFrame, leaves: int, dims: list[str]) -> DataFrame:
    """meta with columns leaf (0 to leaves - 1, from below), v (the coordinate of the last cut) and pid (the range of the last level).

    A node is (base, k): it gives leaves base to base + k - 1."""
    now = meta.withColumns({"base": F.lit(0).cast("long"), "k": F.lit(leaves).cast("long")})
    whole = meta.agg(*[(F.max(d) - F.min(d)).alias(f"e_{d}") for d in dims])  # one row
    extent = {d: float(e or 0) if abs(float(e or 0)) != float("inf") else 0.0 for d, e in zip(dims, whole.first(), strict=True)}
    for _ in range(ceil(log2(leaves)) if leaves > 1 else 0):
        node = ["base", "k"]
        width = lambda d: (F.max(d) - F.min(d)) / extent[d] if extent[d] else F.lit(0.0)
        widest = F.greatest(*[F.struct(width(d).alias("w"), F.lit(-n).alias("n")) for n, d in enumerate(dims)])
        nodes = now.where("k > 1").groupBy(*node).agg(F.sum("size").alias("bytes"), widest["n"].alias("dim"))
        nodes = materialise(nodes.withColumn("goal", F.col("bytes") * F.floor(F.col("k") / 2) / F.col("k")), "nodes")
        which = F.lit(0.0)
        for n, d in enumerate(dims):
            which = F.when(F.col("dim") == -n, F.col(d)).otherwise(which)
        named = now.drop("v", "pid").join(nodes.select(*node, "dim"), node, "left").withColumn("v", F.when(F.col("k") > 1, which).otherwise(0.0)).drop("dim")
        key = [F.col("base"), *_row_key("v")]
        now = materialise(named.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("pid", F.spark_partition_id()), "kd")
        sums = now.where("k > 1").groupBy(*node, "pid").agg(F.sum("size").alias("bytes"))  # a row a range and node
        run = F.sum("bytes").over(Window.partitionBy(*node).orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", run).join(nodes.select(*node, "goal"), node).where("upto >= goal")
        seek = sums.groupBy(*node).agg(F.min_by(F.struct("pid", (F.col("upto") - F.col("bytes")).alias("before"), "goal"), "pid").alias("s")).select(*node, "s.*")
        inside = F.sum("size").over(Window.partitionBy(*node).orderBy(*_row_key("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        near = now.join(seek, [*node, "pid"]).withColumn("off", F.abs(F.col("before") + inside - F.col("goal")))
        cuts = near.groupBy(*node).agg(F.min_by(F.struct("v", "h", "doc_id", "size"), F.struct("off", "v", "h", "doc_id", "size")).alias("cut"))
        cuts = materialise(cuts, "cuts")
        below = F.floor(F.col("k") / 2)
        now = now.join(cuts, node, "left").withColumn("low", _at_most("cut"))
        moved = {"base": F.when(F.col("cut").isNotNull() & ~F.col("low"), F.col("base") + below).otherwise(F.col("base")), "k": F.when(F.col("cut").isNull(), F.col("k")).when(F.col("low"), below).otherwise(F.col("k") - below)}
        now = now.withColumns(moved).drop("cut", "low")
    return now.withColumnRenamed("base", "leaf").drop("k")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot. Give the number of shards, or the bytes that a
    shard should have, from which the number follows.

    Shards' bytes differ by little more than one document. Slots count from 0 in each shard without gaps, in the order
    of the last cut. Equal texts of one language and source lie next to one another in that order, but where bytes must balance a cut may fall
    between two of them; equal texts with other metadata may lie anywhere. A null text has size 1 and the checksum of the empty text; null metadata
    come first; repeated rows are rows of their own and share a shard (equal keys aren't cut). An empty table gives an empty result. Extra columns
    are left out.
    """
    meta = materialise(metadata(docs, id_col, text_col, dims), "metadata")
    if shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 27)))
    tree = split(meta, shards, [f"d{k}" for k in range(len(dims) + 1)])
    if shards == 1:
        tree = tree.withColumns({"v": F.lit(0.0), "pid": F.spark_partition_id()})
    placed = materialise(tree.withColumn("shard", F.col("leaf").cast("int")).select("doc_id", "size", "text_crc32", "h", "v", "pid", "shard"), "placed")
    counts = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "pid").orderBy(*_row_key("v")))
    slots = placed.withColumn("at", inside).join(before, ["shard", "pid"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    out = shard(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs plus shard and slot (columns of docs with these names are replaced). Repeated rows share a shard and take
    its slots in turn."""
    placed = shard(docs, shards, target_bytes, id_col, text_col, dims)
    turn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    placed = placed.select(F.col("doc_id").alias("__tl_id"), F.col("text_crc32").alias("__tl_crc"), "shard", "slot")
    placed = placed.withColumn("__tl_turn", F.row_number().over(Window.partitionBy("__tl_id", "__tl_crc").orderBy("slot")))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    own = docs.select(*rest, F.col(id_col).alias("__tl_key"), crc.alias("__tl_sum"))
    own = own.withColumn("__tl_at", turn("__tl_key", "__tl_sum"))
    same = F.col("__tl_key").eqNullSafe(F.col("__tl_id")) & (F.col("__tl_sum") == F.col("__tl_crc")) & (F.col("__tl_at") == F.col("__tl_turn"))
    return own.join(placed, same).select(*rest, "shard", "slot")
