"""DBSCAN as an epsilon join, degrees and connected components.

Points are put into cells of side epsilon along the first and last price; neighbours lie in the same or an adjoining cell, so the join is on
cells and the distance is a filter. Core points that are neighbours are one component; a component's number is its rank by
smallest row. Within the reference's order a point that was seen as noise before its cluster's first core point stays noise: a border
point belongs to the neighbouring component with the smallest first row, and only if that row comes before it. Mode "standard" labels it
anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import ClusterEstimator, ClusterResult, center_means, nearest, pair_distance, points, require
from tickloom.operators.graph import components
from tickloom.plans.storage import materialise

VARIANTS = ("Standard", "Parallel", "Incremental", "Approximate")


@dataclass(frozen=True)
class DBSCANConfig:
    """Parallel and Approximate give the same result as Standard; max_iterations, tolerance, adaptive_epsilon, num_threads and
    timeout are checked and have no effect. Incremental works on runs of buffer_size rows, which are never merged."""

    epsilon: float = 1.0
    min_points: int = 5
    variant: str = "Standard"
    max_iterations: int = 1000
    tolerance: float = 1e-6
    adaptive_epsilon: bool = False
    num_threads: int = 1
    buffer_size: int = 1000
    timeout: float | None = None
    mode: str = "reference"
    layout: str = "f4"

    def validate(self) -> None:
        require(self.epsilon > 0, "epsilon", "must be positive")
        require(self.min_points >= 2, "min_points", "must be at least 2")
        require(self.max_iterations > 0, "max_iterations", "must be greater than 0")
        require(self.tolerance > 0, "tolerance", "must be positive")
        require(self.num_threads > 0, "num_threads", "must be greater than 0")
        require(self.buffer_size > 0, "buffer_size", "must be greater than 0")
        require(self.variant in VARIANTS, "variant", f"must be one of {', '.join(VARIANTS)}")


def neighbours(rows: DataFrame, epsilon: float, others: DataFrame | None = None) -> DataFrame:
    """(part, i, j, distance) with distance at most epsilon, a point is its own neighbour; of rows (part, i, x)."""
    cell = lambda k: F.floor(F.get("x", F.lit(k)) / epsilon)
    right = (others if others is not None else rows).select("part", F.col("i").alias("j"), F.col("x").alias("y"), cell(0).alias("c0"), cell(3).alias("c1"))
    near = F.array(*map(F.lit, (-1, 0, 1)))
    left = rows.select("part", "i", "x", cell(0).alias("a"), cell(3).alias("b"))
    left = left.withColumn("d0", F.explode(near)).withColumn("d1", F.explode(near)).select("part", "i", "x", (F.col("a") + F.col("d0")).alias("c0"), (F.col("b") + F.col("d1")).alias("c1"))
    met = left.join(right, ["part", "c0", "c1"]).withColumn("distance", pair_distance(F.col("x"), F.col("y")))
    return met.where(F.col("distance") <= epsilon).select("part", "i", "j", "distance")


def cluster_points(rows: DataFrame, epsilon: float, min_points: int, mode: str = "reference") -> DataFrame:
    """(part, i, cluster, is_core, is_border, is_noise) of rows (part, i, x); each part is clustered on its own, i orders
    its rows and is unique overall. Clusters count from 1 in each part, noise is 0."""
    edges = materialise(neighbours(rows, epsilon).select("part", "i", "j"), "neighbours")
    core = edges.groupBy("part", "i").agg(F.count("*").alias("degree")).where(F.col("degree") >= min_points).select("part", "i")
    core = materialise(core, "cores")
    other = core.select("part", F.col("i").alias("j"))
    links = edges.join(core, ["part", "i"], "left_semi").join(other, ["part", "j"], "left_semi").where("i < j")
    found = components(links.select(F.col("i").alias("a"), F.col("j").alias("b")))
    rooted = core.join(found, core.i == found.node, "left").select("part", "i", F.coalesce("root", "i").alias("seed"))
    seeds = rooted.select("part", "seed").distinct()
    numbered = seeds.withColumn("cluster", F.row_number().over(Window.partitionBy("part").orderBy("seed")))
    rooted = rooted.join(numbered, ["part", "seed"])
    border = edges.join(core, ["part", "i"], "left_anti").join(rooted.select("part", F.col("i").alias("j"), "seed", "cluster"), ["part", "j"])
    border = border.groupBy("part", "i").agg(F.min(F.struct("seed", "cluster")).alias("s"))
    if mode == "reference":
        border = border.where(F.col("s.seed") < F.col("i"))
    border = border.select("part", "i", F.col("s.cluster").alias("b_cluster"))
    out = rows.select("part", "i").join(rooted.drop("seed"), ["part", "i"], "left").join(border, ["part", "i"], "left")
    label = F.coalesce("cluster", "b_cluster", F.lit(0)).cast("int")
    return out.select("part", "i", label.alias("cluster"), F.col("cluster").isNotNull().alias("is_core"), F.col("b_cluster").isNotNull().alias("is_border"), (label == 0).alias("is_noise"))


class DBSCAN(ClusterEstimator):
    algorithm_name = "DBSCAN"

    def __init__(self, config: DBSCANConfig | None = None) -> None:
        self.config = config or DBSCANConfig()
        self.centers: list[list[float]] = []

    def validate_config(self) -> None:
        self.config.validate()

    def fit(self, bars: DataFrame) -> ClusterResult:
        """All bars are one set, in the order of row_idx, which must be unique over them."""
        self.validate_config()
        c = self.config
        rows = points(bars, c.layout).withColumnRenamed("row_idx", "i")
        chunk = F.floor(F.col("i") / c.buffer_size) if c.variant == "Incremental" else F.lit(0)
        rows = materialise(rows.select(chunk.cast("long").alias("part"), "symbol", "i", "x"), "points")
        if rows.isEmpty():
            raise errors.EmptyDataset
        found = cluster_points(rows.select("part", "i", "x"), c.epsilon, c.min_points, c.mode)
        if c.variant == "Incremental":
            most = found.groupBy("part").agg(F.max("cluster").alias("n"))
            before = most.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            found = found.join(before.drop("n"), "part").withColumn("cluster", F.when(F.col("cluster") > 0, F.col("cluster") + F.col("before")).otherwise(0).cast("int")).drop("before")
        joined = materialise(found.join(rows.select("i", "symbol", "x"), "i"), "dbscan")
        means = center_means(joined.where("cluster > 0"), 4).orderBy("cluster").collect()
        self.centers = [list(r.m) for r in means]
        n = joined.agg(F.coalesce(F.max("cluster"), F.lit(0))).first()[0]
        out = joined.select("symbol", F.col("i").alias("row_idx"), "cluster", "is_noise", "is_core", "is_border")
        return ClusterResult(f"DBSCAN-{c.variant}", out, n, self.centers, None, None, 1, True)

    def predict(self, bars: DataFrame) -> DataFrame:
        """The cluster of the nearest center; 0 if there are none."""
        label = nearest(F.col("x"), self.centers) + 1 if self.centers else F.lit(0)
        return points(bars, self.config.layout).select("symbol", "row_idx", label.alias("cluster"))

    def get_cluster_centers(self) -> list[list[float]] | None:
        return self.centers


def range_search(bars: DataFrame, center: list[float], radius: float) -> DataFrame:
    """symbol, row_idx, distance of the bars within the closed ball around four prices. The box around it is a filter that
    reaches the scan."""
    box = F.lit(True)
    for name, value in zip(("open", "high", "low", "close"), center, strict=True):
        box = box & F.col(name).between(value - radius, value + radius)
    x = points(bars.where(box), "f4")
    target = F.array(*[F.lit(float(v)) for v in center])
    return x.withColumn("distance", pair_distance(F.col("x"), target)).where(F.col("distance") <= radius).select("symbol", "row_idx", "distance")


def nearest_neighbours(bars: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, rank, symbol, row_idx, distance) of the k bars nearest to each row (q, x) of queries, ties by symbol and row.

    queries is a stated set: its size is checked and it goes to every task, which keeps k bars a query."""
    if queries.count() > 10_000:
        raise errors.TooManyPoints("more than 10000 queries at once")
    pairs = points(bars, "f4").join(F.broadcast(queries.select("q", F.col("x").alias("y")))).withColumn("distance", pair_distance(F.col("x"), F.col("y")))
    order = ["distance", "symbol", "row_idx"]
    part = pairs.withColumn("salt", F.pmod(F.xxhash64("symbol", "row_idx"), F.lit(64)))
    some = part.withColumn("r", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("r") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("q", "rank", "symbol", "row_idx", "distance")
