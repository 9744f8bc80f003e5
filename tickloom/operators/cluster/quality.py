"""Quality of a clustering: sizes, silhouette, and indices with and without known labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import ClusterResult, pair_distance

#: Rows of one call of the pairwise measures; their work grows with the square.
MAX_PAIRWISE = 20_000


def cluster_sizes(assignments: DataFrame, n_clusters: int) -> DataFrame:
    """cluster, size for 0 .. n_clusters - 1; other ids are left out."""
    ids = assignments.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias("cluster"))
    counts = assignments.groupBy("cluster").agg(F.count("*").alias("size"))
    return ids.join(counts, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))


def size_statistics(sizes: DataFrame) -> DataFrame:
    """min, max, mean, std_dev (population) and balanced (smallest over largest above 0.1); zeros without clusters."""
    s = F.col("size")
    out = sizes.agg(F.coalesce(F.min(s), F.lit(0)).alias("min_size"), F.coalesce(F.max(s), F.lit(0)).alias("max_size"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_size"), F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias("std_dev"))
    return out.withColumn("balanced", F.when(F.col("max_size") > 0, F.col("min_size") / F.nullif("max_size", F.lit(0)) > 0.1).otherwise(False))


def is_valid(result: ClusterResult) -> bool:
    """Has points and clusters, and all ids are below the number of clusters."""
    row = result.assignments.agg(F.count("*").alias("n"), F.bool_and(F.col("cluster") < result.n_clusters).alias("ok")).first()
    return bool(result.n_clusters and row.n and row.ok)


def overall_quality(silhouette: Column, converged: Column) -> Column:
    return F.when(~converged, "Poor").when(silhouette >= 0.7, "Excellent").when(silhouette >= 0.5, "Good").when(silhouette >= 0.25, "Fair").otherwise("Poor")


@dataclass(frozen=True)
class ValidationMetrics:
    silhouette: float
    calinski_harabasz: float
    davies_bouldin: float
    dunn: float

    def overall_score(self) -> float:
        return ((self.silhouette + 1) / 2 + self.calinski_harabasz / (self.calinski_harabasz + 1) + 1 / (1 + self.davies_bouldin) + self.dunn / (self.dunn + 1)) / 4

    def is_acceptable(self, threshold: float) -> bool:
        return self.overall_score() >= threshold


def overall_score(silhouette: Column, calinski_harabasz: Column, davies_bouldin: Column, dunn: Column) -> Column:
    return ((silhouette + 1) / 2 + calinski_harabasz / (calinski_harabasz + 1) + 1 / (1 + davies_bouldin) + dunn / (dunn + 1)) / 4


def silhouettes(assigned: DataFrame, metric: str = "euclidean", noise: int | None = None, singletons: str = "skip", max_rows: int = MAX_PAIRWISE) -> DataFrame:
    """id, cluster, a, b, s of rows (id, cluster, x): every point against all points, as sums per cluster.

    a: mean distance to the others of its cluster; b: smallest mean distance to another cluster. Points of cluster
    `noise` are left out. singletons: "skip" leaves out points alone in their cluster, "zero" gives them a = 0. Without another cluster
    s is 0. The work grows with the square of the rows, so more than max_rows raise.
    """
    rows = assigned if noise is None else assigned.where(F.col("cluster") != noise)
    n = rows.count()
    if n > max_rows:
        raise errors.TooManyPoints(f"{n} rows; the pairwise measures take {max_rows}")
    other = rows.select(F.col("id").alias("id2"), F.col("cluster").alias("c2"), F.col("x").alias("x2"))
    sums = rows.join(other).groupBy("id", "cluster", "c2").agg(F.sum(pair_distance(F.col("x"), F.col("x2"), metric)).alias("d"), F.count("*").alias("n"))
    own = F.col("cluster") == F.col("c2")
    mean = F.when(own & (F.col("n") > 1), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).when(~own, F.col("d") / F.col("n"))
    out = sums.withColumn("mean", mean).groupBy("id", "cluster").agg(F.max(F.when(own, F.col("n"))).alias("size"), F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    if singletons == "skip":
        out = out.where("size > 1")
    out = out.withColumn("a", F.coalesce("a", F.lit(0.0)))
    most = F.greatest("a", "b")
    return out.withColumn("s", F.when(F.col("b").isNull(), 0.0).when(most == 0, F.lit(float("nan"))).otherwise((F.col("b") - F.col("a")) / F.nullif(most, F.lit(0.0)))).drop("size")


def silhouette(assigned: DataFrame, metric: str = "euclidean", **how) -> DataFrame:
    """One row: silhouette, the mean over the points (0 if there are none)."""
    return silhouettes(assigned, metric, **how).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette"))


def dbscan_silhouette(assigned: DataFrame, **how) -> DataFrame:
    """Without noise (cluster 0); points alone have a = 0; negative values count as 0, and fewer than two clusters give 0."""
    per = silhouettes(assigned, noise=0, singletons="zero", **how)
    return per.agg(F.greatest(F.lit(0.0), F.coalesce(F.avg("s"), F.lit(0.0))).alias("silhouette"))


def _centered(assigned: DataFrame, width: int) -> DataFrame:
    centers = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", F.lit(k))) for k in range(width)]).alias("m"))
    return centers


def internal_indices(assigned: DataFrame, width: int) -> DataFrame:
    """One row: calinski_harabasz and davies_bouldin of rows (cluster, x). Aggregates; only centers are paired."""
    centers = _centered(assigned, width)
    whole = assigned.agg(F.array(*[F.avg(F.get("x", F.lit(k))) for k in range(width)]).alias("g"), F.count("*").alias("total"))
    spread = assigned.join(centers, "cluster").withColumn("d", pair_distance(F.col("x"), F.col("m")))
    per = spread.groupBy("cluster").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"), F.first("m").alias("m"), F.first("n").alias("n"))
    other = per.select(F.col("cluster").alias("c2"), F.col("s").alias("s2"), F.col("m").alias("m2"))
    gap = pair_distance(F.col("m"), F.col("m2"))
    worst = per.join(other, F.col("cluster") != F.col("c2")).groupBy("cluster").agg(F.max((F.col("s") + F.col("s2")) / F.nullif(gap, F.lit(0.0))).alias("r"))
    db = worst.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))
    between = per.join(whole).agg(F.sum(F.col("n") * F.pow(pair_distance(F.col("m"), F.col("g")), 2)).alias("b"), F.sum("w").alias("w"), F.count("*").alias("k"), F.max("total").alias("total"))
    ch = between.select(F.when((F.col("k") > 1) & (F.col("w") > 0), (F.col("b") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("w") / F.nullif(F.col("total") - F.col("k"), F.lit(0)), F.lit(0.0))).otherwise(0.0).alias("calinski_harabasz"))
    return ch.join(db)


def dunn(assigned: DataFrame, max_rows: int = MAX_PAIRWISE) -> DataFrame:
    """One row: the smallest distance between clusters over the largest within one (0 if that is 0), of rows (id, cluster, x)."""
    n = assigned.count()
    if n > max_rows:
        raise errors.TooManyPoints(f"{n} rows; the pairwise measures take {max_rows}")
    other = assigned.select(F.col("id").alias("id2"), F.col("cluster").alias("c2"), F.col("x").alias("x2"))
    d = pair_distance(F.col("x"), F.col("x2"))
    own = F.col("cluster") == F.col("c2")
    out = assigned.join(other, F.col("id") < F.col("id2")).agg(F.min(F.when(~own, d)).alias("between"), F.max(F.when(own, d)).alias("within"))
    return out.select(F.coalesce(F.col("between") / F.nullif("within", F.lit(0.0)), F.lit(0.0)).alias("dunn"))


def external_indices(pairs: DataFrame) -> DataFrame:
    """One row of rows (cluster, label): ari, nmi (arithmetic mean), homogeneity, completeness, v_measure. All from one
    table of counts."""
    table = pairs.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    rows = table.withColumn("a", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("b", F.sum("n").over(Window.partitionBy("label"))).join(table.agg(F.sum("n").alias("t")))
    two = lambda c: c * (c - 1) / 2
    n, a, b, t = (F.col(x).cast("double") for x in "nabt")
    sums = rows.agg(
        F.sum(two(n)).alias("nij"), F.sum(two(a) * n / a).alias("ai"), F.sum(two(b) * n / b).alias("bj"), F.max(two(t)).alias("all"),
        F.sum(n / t * F.log(n * t / (a * b))).alias("mi"), F.sum(-n / t * F.log(a / t)).alias("hc"), F.sum(-n / t * F.log(b / t)).alias("hl"),
    )
    expected = F.col("ai") * F.col("bj") / F.nullif("all", F.lit(0.0))
    room = (F.col("ai") + F.col("bj")) / 2 - expected
    share = lambda num, den: F.when(F.abs(den) < 1e-12, 1.0).otherwise(num / F.nullif(den, F.lit(0.0)))
    out = sums.select(share(F.col("nij") - expected, room).alias("ari"), share(F.col("mi"), (F.col("hc") + F.col("hl")) / 2).alias("nmi"), share(F.col("mi"), F.col("hl")).alias("homogeneity"), share(F.col("mi"), F.col("hc")).alias("completeness"))
    total = F.col("homogeneity") + F.col("completeness")
    return out.withColumn("v_measure", F.when(total > 0, 2 * F.col("homogeneity") * F.col("completeness") / F.nullif(total, F.lit(0.0))).otherwise(0.0))


def score_table(spark: SparkSession, metrics: list[ValidationMetrics], threshold: float) -> DataFrame:
    rows = [(m.silhouette, m.calinski_harabasz, m.davies_bouldin, m.dunn, m.overall_score(), m.is_acceptable(threshold)) for m in metrics]
    return spark.createDataFrame(rows, "silhouette double, calinski_harabasz double, davies_bouldin double, dunn double, overall_score double, acceptable boolean")
