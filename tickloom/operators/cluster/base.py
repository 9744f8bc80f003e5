"""What the clustering algorithms share: feature layouts, results, prediction by nearest center, the trait."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.functions import bars as fb
from tickloom.plans.chunks import on_keys

LAYOUTS = {"f4": fb.features_f4, "f5": fb.features_f5, "f5k": fb.features_f5k, "f11": fb.features_f11}


def points(bars: DataFrame, layout: str) -> DataFrame:
    """symbol, row_idx, x (array of doubles)."""
    return bars.select("symbol", "row_idx", LAYOUTS[layout]().alias("x"))


@dataclass(frozen=True)
class ClusterResult:
    """assignments: symbol, row_idx, cluster and what else the algorithm tells of a point."""

    algorithm: str
    assignments: DataFrame
    n_clusters: int
    centers: list[list[float]] = field(default_factory=list)
    inertia: float | None = None
    silhouette: float | None = None
    iterations: int = 0
    converged: bool = False
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def n_points(self) -> int:
        return self.assignments.count()

    def summary(self) -> DataFrame:
        spark = self.assignments.sparkSession
        schema = "algorithm string, n_clusters int, centers array<array<double>>, inertia double, silhouette double, iterations int, converged boolean, metadata map<string,string>"
        return spark.createDataFrame([(self.algorithm, self.n_clusters, [list(map(float, c)) for c in self.centers], self.inertia, self.silhouette, self.iterations, self.converged, self.metadata)], schema)


    def quality_assessment(self) -> DataFrame:
        """One row: silhouette, n_clusters, n_points, cluster_sizes, converged, level."""
        from tickloom.operators.cluster import quality

        sizes = quality.cluster_sizes(self.assignments, self.n_clusters)
        own = {"silhouette": F.lit(self.silhouette).cast("double"), "n_clusters": F.lit(self.n_clusters), "converged": F.lit(self.converged)}
        out = sizes.agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "size"))), lambda x: x["size"]).alias("cluster_sizes")).crossJoin(self.assignments.agg(F.count("*").alias("n_points")))
        out = out.withColumns(own)
        return out.select("silhouette", "n_clusters", "n_points", "cluster_sizes", "converged", quality.overall_quality(F.coalesce("silhouette", F.lit(-1.0)), F.col("converged")).alias("level"))


class ClusterEstimator(ABC):
    """fit() on bars, then predict() on others."""

    algorithm_name: str
    supports_incremental = False

    @abstractmethod
    def validate_config(self) -> None: ...

    @abstractmethod
    def fit(self, bars: DataFrame) -> ClusterResult: ...

    @abstractmethod
    def predict(self, bars: DataFrame) -> DataFrame: ...

    def get_cluster_centers(self) -> list[list[float]] | None:
        return None

    def update(self, bars: DataFrame) -> None:
        raise errors.ClusteringError(f"{self.algorithm_name} does not support incremental updates")


def require(ok: bool, name: str, message: str) -> None:
    if not ok:
        raise errors.ConfigError(name, message)


def distance(x: Column, center: list[float], metric: str = "euclidean") -> Column:
    """From an array column to a point, as plain arithmetic."""
    cells = [(F.get(x, F.lit(k)), F.lit(float(c))) for k, c in enumerate(center)]
    if metric == "manhattan":
        return sum((F.abs(a - b) for a, b in cells[1:]), F.abs(cells[0][0] - cells[0][1]))
    if metric == "cosine":
        dot, norm = F.lit(0.0), F.lit(0.0)
        for a, b in cells:
            dot, norm = dot + a * b, norm + a * a
        own = float(np.sqrt(sum(c * c for c in center)))
        whole = F.sqrt(norm) * F.lit(own)
        return F.when(whole == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot / F.nullif(whole, F.lit(0.0)))
    return F.sqrt(squared(x, center))


def squared(x: Column, center: list[float]) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(center):
        d = F.get(x, F.lit(k)) - F.lit(float(c))
        out = out + d * d
    return out


def nearest(x: Column, centers: list[list[float]], metric: str = "euclidean") -> Column:
    """Number of the nearest center from 0, the lowest of equals; 0 if no distance is a number."""
    d = F.transform(F.array(*[distance(x, c, metric) for c in centers]), lambda v: F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def group_means(rows: DataFrame) -> DataFrame:
    """symbol, cluster, m: the mean of each cluster of each symbol of rows (symbol, cluster, x)."""
    cells = rows.select("symbol", "cluster", F.posexplode("x").alias("j", "v")).groupBy("symbol", "cluster", "j").agg(F.avg("v").alias("m"))
    return cells.groupBy("symbol", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("m"))


def nearest_of_symbol(rows: DataFrame, centers: DataFrame, metric: str = "euclidean") -> DataFrame:
    """symbol, row_idx, cluster of rows (symbol, row_idx, x): the nearest of the symbol's centers (symbol, cluster, m), the lowest of equals; null for
    a symbol without any. The centers of a symbol, a few, are one joined row."""
    gathered = centers.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("cluster", "m"))).alias("centers"))
    far = lambda d: F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d)
    ranked = F.transform("centers", lambda c: F.struct(far(pair_distance(F.col("x"), c["m"], metric)).alias("d"), c["cluster"].alias("cluster")))
    return on_keys(rows, gathered, "symbol", "left").select("symbol", "row_idx", F.array_min(ranked)["cluster"].cast("int").alias("cluster"))


def inertia(rows: DataFrame, centers: DataFrame) -> float:
    """Sum of squared distances of rows (symbol, cluster, x) to the centers (symbol, cluster, m) of their own clusters."""
    joined = on_keys(rows, centers, ["symbol", "cluster"])
    return float(joined.agg(F.coalesce(F.sum(F.pow(pair_distance(F.col("x"), F.col("m")), 2)), F.lit(0.0))).first()[0])


def center_means(assigned: DataFrame, width: int) -> DataFrame:
    """cluster, n, m (array of means) of rows (cluster, x)."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("x", F.lit(k))) for k in range(width)]).alias("m"))


def pair_distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Between two array columns."""
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
        whole = norm(a) * norm(b)
        return F.when(whole == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot / F.nullif(whole, F.lit(0.0)))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
