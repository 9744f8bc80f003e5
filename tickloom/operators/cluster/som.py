"""Self-organizing map of each symbol's bars: trained row by row, or in batches over all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import ClusterEstimator, ClusterResult, inertia, nearest, nearest_of_symbol, points, require
from tickloom.operators.cluster.grouped import per_symbol
from tickloom.plans.chunks import on_keys
from tickloom.plans.storage import materialise

TOPOLOGIES = ("rectangular", "hexagonal")
MAX_POINTS = 200_000


@dataclass(frozen=True)
class SOMConfig:
    """training "online" updates after each row in a shuffled order (one task a symbol), "batch" once an epoch from one aggregation over all
    rows of all symbols, without a bound on their number. seed 0 unless given."""

    width: int = 5
    height: int = 5
    topology: str = "rectangular"
    learning_rate: float = 0.1
    neighborhood_radius: float = 2.0
    epochs: int = 100
    seed: int = 0
    num_threads: int = 1
    timeout: float = 30.0
    training: str = "online"
    layout: str = "f5"
    max_points: int = MAX_POINTS

    def validate(self) -> None:
        require(self.width > 0 and self.height > 0, "width/height", "must be greater than 0")
        require(0 < self.learning_rate <= 1, "learning_rate", "must be in (0, 1]")
        require(self.neighborhood_radius > 0, "neighborhood_radius", "must be positive")
        require(self.epochs > 0, "epochs", "must be greater than 0")
        require(self.num_threads > 0, "num_threads", "must be greater than 0")
        require(self.topology in TOPOLOGIES, "topology", f"must be one of {', '.join(TOPOLOGIES)}")


def grid_distances(c: SOMConfig) -> np.ndarray:
    """Between neurons, row by row. Hexagonal: dx + dy + dx * dy."""
    row, column = np.divmod(np.arange(c.width * c.height), c.width)
    dx, dy = np.abs(row[:, None] - row[None, :]).astype(float), np.abs(column[:, None] - column[None, :]).astype(float)
    return np.sqrt(dx * dx + dy * dy) if c.topology == "rectangular" else dx + dy + dx * dy


def _kernel(grid: np.ndarray, radius: float) -> np.ndarray:
    if radius <= 0:
        return np.eye(len(grid))
    return np.where(grid <= radius, np.exp(-grid * grid / (2 * radius * radius)), 0.0)


def train(x: np.ndarray, c: SOMConfig) -> np.ndarray:
    """Weights of the neurons after online training."""
    rng = np.random.default_rng(c.seed)
    grid, weights = grid_distances(c), rng.uniform(-1, 1, (c.width * c.height, x.shape[1]))
    for epoch in range(c.epochs):
        left = 1 - epoch / c.epochs
        pull = c.learning_rate * left * _kernel(grid, c.neighborhood_radius * left)
        for i in rng.permutation(len(x)):
            winner = int(((weights - x[i]) ** 2).sum(1).argmin())
            weights += pull[winner][:, None] * (x[i] - weights)
    return weights


class SOM(ClusterEstimator):
    """Clusters are the neurons, row by row; many may be empty."""

    algorithm_name = "SOM"

    def __init__(self, config: SOMConfig | None = None) -> None:
        self.config = config or SOMConfig()
        self.weights: dict[None, list[list[float]]] = {}  # of the one map of batch training
        self.maps: DataFrame | None = None  # symbol, cluster, m of online training

    def validate_config(self) -> None:
        self.config.validate()

    def fit(self, bars: DataFrame) -> ClusterResult:
        self.validate_config()
        c = self.config
        if c.training == "batch":
            self._fit_batch(points(bars, c.layout))
        else:

            def run(x: np.ndarray) -> dict:
                return {"w": train(x, c).ravel().tolist()}

            learnt = per_symbol(bars, c.layout, c.max_points, run, "symbol string, w array<double>", single=True)
            self.maps = materialise(learnt.select("symbol", F.posexplode(F.expr(f"transform(sequence(0, {c.width * c.height - 1}), k -> slice(w, k * size(w) div {c.width * c.height} + 1, size(w) div {c.width * c.height}))")).alias("cluster", "m")), "maps")
        found = self.predict(bars)
        rows = on_keys(points(bars, c.layout), found, ["symbol", "row_idx"])
        centers = self.maps if self.maps is not None else rows.select("symbol").distinct().withColumn("cell", F.explode(F.array(*[F.struct(F.lit(k).alias("cluster"), F.array(*[F.lit(float(v)) for v in w]).alias("m")) for k, w in enumerate(self.weights[None])]))).select("symbol", "cell.*")
        return ClusterResult("SOM", found, c.width * c.height, [], inertia(rows, centers), None, c.epochs, c.epochs > 10)

    def _fit_batch(self, rows: DataFrame) -> None:
        """One map for all rows. An epoch sums the rows of each winner; a neuron moves to the mean of all winners' rows, weighted by
        the neighbourhood."""
        c = self.config
        rows = rows.persist()
        ranges = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        if not ranges[0]:
            raise errors.EmptyDataset
        width = ranges[1]
        low_high = rows.agg(*[f(F.get("x", F.lit(j))) for j in range(width) for f in (F.min, F.max)]).first()
        rng = np.random.default_rng(c.seed)
        weights = np.stack([rng.uniform(low_high[2 * j], low_high[2 * j + 1] + 1e-12, c.width * c.height) for j in range(width)], axis=1)
        grid = grid_distances(c)
        for epoch in range(c.epochs):
            h = _kernel(grid, c.neighborhood_radius * (1 - epoch / c.epochs))
            got = rows.groupBy(nearest(F.col("x"), weights.tolist()).alias("b")).agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(width)]).collect()
            sums, n = np.zeros((len(weights), width)), np.zeros(len(weights))
            for r in got:
                n[r.b], sums[r.b] = r.n, [r[f"s{j}"] for j in range(width)]
            mass = h.T @ n
            weights = np.where(mass[:, None] > 0, (h.T @ sums) / np.where(mass > 0, mass, 1)[:, None], weights)
        rows.unpersist()
        self.weights = {None: weights.tolist()}

    def predict(self, bars: DataFrame) -> DataFrame:
        """symbol, row_idx, cluster: the best matching neuron."""
        rows = points(bars, self.config.layout)
        if self.maps is not None:
            return nearest_of_symbol(rows, self.maps)
        return rows.select("symbol", "row_idx", nearest(F.col("x"), self.weights[None]).alias("cluster"))

    def get_cluster_centers(self) -> list[list[float]] | None:
        return self.weights.get(None)
