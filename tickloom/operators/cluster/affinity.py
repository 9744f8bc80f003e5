"""Affinity propagation on each symbol's bars."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import errors
from tickloom.operators.cluster.base import ClusterEstimator, ClusterResult, inertia, nearest_of_symbol, points, require
from tickloom.operators.cluster.grouped import per_symbol
from tickloom.plans.chunks import on_keys
from tickloom.plans.storage import materialise

MAX_POINTS = 2_000


@dataclass(frozen=True)
class AffinityPropagationConfig:
    """preference: "median" (the upper one), "minimum" or a number. In mode "standard" availabilities are capped at 0 from above, in
    "reference" from below. num_threads and timeout have no effect."""

    damping: float = 0.5
    max_iterations: int = 200
    tolerance: float = 1e-6
    preference: str | float = "median"
    num_threads: int = 1
    timeout: float = 30.0
    mode: str = "reference"
    layout: str = "f5"
    max_points: int = MAX_POINTS

    def validate(self) -> None:
        require(0 <= self.damping < 1, "damping", "must be in [0, 1)")
        require(self.max_iterations > 0, "max_iterations", "must be greater than 0")
        require(self.tolerance > 0, "tolerance", "must be positive")
        require(self.num_threads > 0, "num_threads", "must be greater than 0")


def propagate(x: np.ndarray, c: AffinityPropagationConfig) -> tuple[np.ndarray, list[int], int, bool]:
    """Labels (positions in the list of exemplars), exemplars, iterations, converged. Each round is a few operations on whole matrices:
    the largest other value comes from the best two of a row, and sums over others from column sums."""
    n = len(x)
    s = -np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0.0)
    off = s[~np.eye(n, dtype=bool)]
    if isinstance(c.preference, str):
        preference = 0.0 if not len(off) else float(np.sort(off)[len(off) // 2] if c.preference == "median" else off.min())
    else:
        preference = float(c.preference)
    np.fill_diagonal(s, preference)
    r, a, diagonal, rows = np.zeros((n, n)), np.zeros((n, n)), np.arange(n), np.arange(n)
    converged, iterations = False, 0
    for iterations in range(1, c.max_iterations + 1):  # noqa: B007
        v = s + a
        top = v.argmax(1)
        first = v[rows, top]
        v[rows, top] = -np.inf
        second = v.max(1) if n > 1 else np.full(n, -np.inf)
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - second
        pos = np.maximum(new, 0.0)
        column = pos.sum(0) - pos[diagonal, diagonal]
        inner = new[diagonal, diagonal][None, :] + column[None, :] - pos
        avail = np.minimum(inner, 0.0) if c.mode == "standard" else np.maximum(inner, 0.0)
        avail[diagonal, diagonal] = column
        new = c.damping * r + (1 - c.damping) * new
        a = c.damping * a + (1 - c.damping) * avail
        change = np.abs(new - r).max()
        r = new
        if change < c.tolerance:
            converged = True
            break
    exemplars = np.flatnonzero(r[diagonal, diagonal] + a[diagonal, diagonal] > 0).tolist()
    if not exemplars:
        raise errors.ClusteringError("no exemplar emerged")
    return s[:, exemplars].argmax(1), exemplars, iterations, converged


class AffinityPropagation(ClusterEstimator):
    """Each symbol is clustered on its own."""

    algorithm_name = "AffinityPropagation"

    def __init__(self, config: AffinityPropagationConfig | None = None) -> None:
        self.config = config or AffinityPropagationConfig()
        self.exemplars: DataFrame | None = None

    def validate_config(self) -> None:
        self.config.validate()

    def fit(self, bars: DataFrame) -> ClusterResult:
        self.validate_config()
        c = self.config

        def run(x: np.ndarray) -> dict:
            labels, exemplars, iterations, converged = propagate(x, c)
            return {"cluster": labels.astype(np.int32), "is_exemplar": np.isin(np.arange(len(x)), exemplars), "iterations": iterations, "converged": converged}

        out = per_symbol(bars, c.layout, c.max_points, run, "symbol string, row_idx long, cluster int, is_exemplar boolean, iterations int, converged boolean")
        out = materialise(out, "affinity")
        rows = on_keys(points(bars, c.layout), out, ["symbol", "row_idx"])
        self.exemplars = materialise(rows.where("is_exemplar").select("symbol", "cluster", F.col("x").alias("m")), "exemplars")
        told = out.agg(F.max("iterations"), F.bool_and("converged")).first()
        most = self.exemplars.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        return ClusterResult("AffinityPropagation", out, most or 0, [], inertia(rows, self.exemplars), None, told[0] or 0, bool(told[1]))

    def predict(self, bars: DataFrame) -> DataFrame:
        """The nearest exemplar of the bar's symbol; in mode "reference" always cluster 0."""
        rows = points(bars, self.config.layout)
        if self.config.mode == "standard":
            return nearest_of_symbol(rows, self.exemplars)
        return rows.select("symbol", "row_idx", F.lit(0).alias("cluster"))
