"""K-Means (Lloyd): one aggregation per iteration; the driver holds k centers only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import ClusterEstimator, ClusterResult, nearest, points, require, squared

VARIANTS = ("Lloyd", "Elkan", "Hamerly", "MiniBatch")


@dataclass(frozen=True)
class KMeansConfig:
    """variant only names the result, parallel, simd and tolerance have no effect: the loop ends when no assignment changes.
    init: "first_k" rows, or "random" rows by a hash of their place and the seed."""

    k: int | None = None
    variant: str = "Lloyd"
    max_iterations: int = 100
    tolerance: float = 1e-8
    seed: int | None = None
    init: str = "random"
    layout: str = "f5k"
    parallel: bool = False
    simd: bool = False

    def validate(self) -> None:
        require(self.k is not None, "k", "number of clusters must be specified")
        require(self.k > 0, "k", "number of clusters must be greater than 0")
        require(self.variant in VARIANTS, "variant", f"must be one of {', '.join(VARIANTS)}")


class KMeans(ClusterEstimator):
    algorithm_name = "KMeans"

    def __init__(self, config: KMeansConfig) -> None:
        self.config = config
        self.centers: list[list[float]] = []

    def validate_config(self) -> None:
        self.config.validate()

    def _initial(self, rows: DataFrame) -> list[list[float]]:
        order = ["symbol", "row_idx"] if self.config.init == "first_k" else [F.xxhash64("symbol", "row_idx", F.lit(self.config.seed or 0)), "symbol", "row_idx"]
        return [list(r.x) for r in rows.orderBy(*order).limit(self.config.k).collect()]

    def fit(self, bars: DataFrame) -> ClusterResult:
        """Assignments start at 0; an empty cluster's center becomes the zero point. silhouette is a constant; quality.silhouette
        gives the real one."""
        self.validate_config()
        k = self.config.k
        rows = points(bars, self.config.layout).persist()
        n = rows.count()
        if n == 0:
            raise errors.EmptyDataset
        if n < k:
            raise errors.InsufficientData(k, n)
        centers, before = self._initial(rows), None
        width, converged, iterations = len(centers[0]), False, 0
        for iterations in range(1, self.config.max_iterations + 1):  # noqa: B007
            old = F.lit(0) if before is None else nearest(F.col("x"), before)
            moved = rows.select("x", nearest(F.col("x"), centers).alias("cluster"), old.alias("old"))
            got = moved.groupBy("cluster").agg(F.count_if(F.col("cluster") != F.col("old")).alias("moved"), *[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(width)]).collect()
            if not sum(r.moved for r in got):
                converged = True
                break
            before = centers
            found = {r.cluster: [r[f"m{j}"] for j in range(width)] for r in got}
            centers = [found.get(c, [0.0] * width) for c in range(k)]
        # assignments are those of the last comparison: by the centers before the last update, unless nothing moved
        last = centers if converged or before is None else before
        cluster = nearest(F.col("x"), last) if iterations else F.lit(0)
        self.centers = centers
        out = rows.select("symbol", "row_idx", cluster.alias("cluster"), "x")
        own = F.lit(0.0)
        for c, center in enumerate(centers):
            own = F.when(F.col("cluster") == c, squared(F.col("x"), center)).otherwise(own)
        inertia = out.agg(F.sum(own)).first()[0]
        return ClusterResult(f"KMeans-{self.config.variant}", out.drop("x"), k, centers, inertia, 0.5, iterations, converged, {"silhouette": "constant"})

    def predict(self, bars: DataFrame) -> DataFrame:
        return points(bars, self.config.layout).select("symbol", "row_idx", nearest(F.col("x"), self.centers).alias("cluster"))

    def get_cluster_centers(self) -> list[list[float]] | None:
        return self.centers
