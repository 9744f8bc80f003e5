"""Choosing among clusterings: how alike they are under resampling, and which algorithm does best on given bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.cluster import quality
from tickloom.operators.cluster.base import ClusterEstimator, points
from tickloom.plans.chunks import on_keys


def stability(make: Callable[[], ClusterEstimator], bars: DataFrame, runs: int = 3, share: float = 0.8, seed: int = 0) -> DataFrame:
    """run, ari, nmi: the clusters of all bars against those that a model fitted on a sample predicts for the same bars. A sample
    has `share` of the bars, by hash of symbol and row, so runs can be repeated."""
    whole = make().fit(bars).assignments.select("symbol", "row_idx", F.col("cluster").alias("label"))
    out = None
    for k in range(runs):
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "symbol", "row_idx"), F.lit(1_000_000))
        model = make()
        model.fit(bars.where(place < int(share * 1_000_000)))
        pairs = on_keys(whole, model.predict(bars).select("symbol", "row_idx", "cluster"), ["symbol", "row_idx"])
        one = quality.external_indices(pairs.select("cluster", "label")).select(F.lit(k).alias("run"), "ari", "nmi")
        out = one if out is None else out.unionByName(one)
    return out


def compare(makers: dict[str, Callable[[], ClusterEstimator]], bars: DataFrame, layout: str = "f5") -> DataFrame:
    """algorithm, calinski_harabasz, davies_bouldin, score (as quality.overall_score without its pairwise measures), rank (1: the best), of each
    algorithm fitted on the bars. Indices that need all pairs are left out, so any number of bars will do."""
    out = None
    for name, make in makers.items():
        found = make().fit(bars).assignments.select("symbol", "row_idx", "cluster")
        rows = on_keys(points(bars, layout), found, ["symbol", "row_idx"]).select(F.struct("symbol", "row_idx").alias("id"), "cluster", "x")
        one = quality.internal_indices(rows, len(points(bars, layout).first().x)).select(F.lit(name).alias("algorithm"), "calinski_harabasz", "davies_bouldin")
        out = one if out is None else out.unionByName(one)
    ch, db = F.coalesce("calinski_harabasz", F.lit(0.0)), F.col("davies_bouldin")
    score = (ch / (ch + 1) + F.coalesce(1 / (1 + db), F.lit(0.0))) / 2
    return out.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "algorithm")))  # a row an algorithm


def recommend(makers: dict[str, Callable[[], ClusterEstimator]], bars: DataFrame, layout: str = "f5") -> str:
    return compare(makers, bars, layout).where("rank = 1").first().algorithm


class Preprocessor:
    """Standard scores of features, learnt from some bars and applied to others."""

    def __init__(self, layout: str = "f5") -> None:
        self.layout = layout
        self.means: list[float] = []
        self.deviations: list[float] = []

    def fit(self, bars: DataFrame) -> Preprocessor:
        rows = points(bars, self.layout).select(F.posexplode("x").alias("j", "v")).where(~F.isnan("v"))
        got = rows.groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("j").collect()  # a row a feature
        self.means, self.deviations = [r.m for r in got], [r.s or 1.0 for r in got]
        return self

    def transform(self, bars: DataFrame) -> DataFrame:
        """symbol, row_idx, x: each feature less its mean over its deviation; NaN becomes 0, the mean."""
        scaled = F.transform("x", lambda v, j: (v - F.get(F.lit(self.means), j)) / F.get(F.lit(self.deviations), j))
        return points(bars, self.layout).select("symbol", "row_idx", F.transform(scaled, lambda v: F.when(F.isnan(v), 0.0).otherwise(v)).alias("x"))
