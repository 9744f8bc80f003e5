"""Mixing sources to target weights.

Sources in order of code point, null last, have the weights of a repeating list; they share `share` times all words, but
no source gives more than `epochs` times its own: what it lacks is shared by weight among the others until none is
above. Within a source, documents come in the order of a hash of their id. That order is cut into as many key ranges as
each range then has rows (the root of the source's rows), so a source with a third of all rows is many ranges; the words of each range are
summed and prefixed, and only inside a range are single documents prefixed. The mix takes whole epochs and then documents in order until the
source's exact budget, the last one in part.
"""

from __future__ import annotations

from fractions import Fraction
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, n_words

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), Fraction(3, 2), 2
SEED = "mix"
#: Sources whose sums (one row each) may go to the driver; more raise.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> list[Fraction]:
    """Target of each source, given its words."""
    goal, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    open_ = [k for k in range(len(sizes)) if sizes[k]]
    while open_:
        level = goal / sum(weight[k] for k in open_)
        full = [k for k in open_ if level * weight[k] > epochs * sizes[k]]
        for k in full or open_:
            out[k] = Fraction(epochs * sizes[k]) if full else level * weight[k]
            goal -= out[k]
        open_ = [k for k in open_ if k not in full] if full else []
    return out


def _key(doc: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, taken (words taken, repeats counted).

    Null texts have size 0 and take nothing; a null source is a source, the last. Repeated rows count each. An empty
    table gives an empty result; extra columns are left out. The sources' sums, one row each and MAX_SOURCES at most, go to the driver.
    """
    key = _key(F.col("doc_id"), seed)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    base = materialise(base.withColumn("key", key), "mix")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: sources are meant to be few, each with a target of its own")
    sums.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([x.source_size for x in sums], weights, share, epochs)
    plan = []
    for x, t in zip(sums, goal, strict=True):
        whole, rest = divmod(int(t), x.source_size) if x.source_size else (0, 0)
        plan.append((x.source, x.source_size, float(t), whole, rest, isqrt(x.n) + 1))
    spark = docs.sparkSession
    planned = spark.createDataFrame(plan, "p_source string, source_size long, target double, whole long, rest long, buckets long").coalesce(1)
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = base.join(planned, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("bucket", F.floor(head * F.col("buckets") / F.lit(2.0**32)).cast("long"))
    part = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = part.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixed = rows.withColumn("upto", F.sum("size").over(inside))
    joined = prefixed.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    left = F.col("rest") - (F.col("before") + F.col("upto") - F.col("size"))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents: every row of docs as often as the mix takes it, rounded to whole documents (a document of
    which the last epoch takes at least half counts once more), whole texts, all columns as they were. A row with a
    text of no words has no share in any budget and stays once.

    Ids may be null or repeated: a row's times are found by its id, words and source, and of rows that agree in all three, which the
    mix can't tell apart, each gets its own in turn."""
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).cast("int")
    row = ("__tl_id", "__tl_source", "__tl_size")
    counts = taken.select(F.col("doc_id").alias("__tl_id"), F.col("source").alias("__tl_source"), F.col("size").alias("__tl_size"), times.alias("__tl_times"))
    counts = counts.groupBy(*row, "__tl_times").agg(F.count("*").alias("__tl_rows"))  # (times, how many rows): a few per row
    counts = counts.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("__tl_times", "__tl_rows"))).alias("__tl_plan")).withColumnsRenamed({c: f"{c}2" for c in row})
    own = docs.withColumns({"__tl_id": F.col(id_col), "__tl_source": F.col(source_col), "__tl_size": n_words(F.col(text_col))})
    same = F.col("__tl_id").eqNullSafe(F.col("__tl_id2")) & F.col("__tl_source").eqNullSafe(F.col("__tl_source2")) & (F.col("__tl_size") == F.col("__tl_size2"))
    joined = own.join(counts, same)
    several = F.size("__tl_plan") > 1  # rows of one id, source and size that are taken unequally often
    plain = joined.where(~several).withColumn("__tl_times", F.col("__tl_plan")[0]["__tl_times"])
    turn = F.row_number().over(Window.partitionBy(*row).orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("times"))
    pick = F.aggregate("__tl_plan", start, lambda a, x: F.when(a["n"] >= F.col("__tl_turn"), a).otherwise(F.struct((a["n"] + x["__tl_rows"]).alias("n"), x["__tl_times"].alias("times"))))["times"]
    mixed = joined.where(several).withColumn("__tl_turn", turn).withColumn("__tl_times", pick).drop("__tl_turn")
    out = plain.unionByName(mixed).where("__tl_times > 0")
    return out.withColumn("__tl_copy", F.explode(F.sequence(F.lit(1), F.col("__tl_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) z, row_number() OVER (ORDER BY source NULLS LAST) - 1 i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END w, (SELECT sum(z) FROM s) t FROM s),
o AS (SELECT *, coalesce(sum(z) OVER (ORDER BY z * 1.0 / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) z0, sum(w) OVER (ORDER BY z * 1.0 / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) w0, row_number() OVER (ORDER BY z * 1.0 / w, i) p FROM w),
c AS (SELECT min(p) p FROM o WHERE (3 * t - 4 * z0) * w <= 4 * z * w0),
l AS (SELECT 3 * t - 4 * z0 a, 2 * w0 b FROM o JOIN c USING (p)),
g AS (SELECT source, z, CAST(CASE WHEN p < (SELECT p FROM c) THEN 2 * z ELSE (SELECT a FROM l) * w / CAST((SELECT b FROM l) AS DOUBLE) END AS DOUBLE) target, CAST(CASE WHEN p < (SELECT p FROM c) THEN 2 * z ELSE ((SELECT a FROM l) * w) // (SELECT b FROM l) END AS BIGINT) budget FROM o),
x AS (SELECT d.doc_id, d.size, g.z source_size, g.target, CASE WHEN g.z > 0 THEN budget // g.z ELSE 0 END whole, CASE WHEN g.z > 0 THEN budget % g.z ELSE 0 END rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - b)) AS BIGINT) taken FROM x
"""
