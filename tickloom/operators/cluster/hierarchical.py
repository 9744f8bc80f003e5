"""Agglomerative clustering of each symbol's bars."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tickloom.operators.cluster.base import ClusterEstimator, ClusterResult, group_means, inertia, nearest_of_symbol, points, require
from tickloom.operators.cluster.grouped import matrix, per_symbol
from tickloom.plans.chunks import on_keys
from tickloom.plans.storage import materialise

LINKAGES = ("ward", "single", "complete", "average", "centroid")
METRICS = ("euclidean", "manhattan", "cosine")
MAX_POINTS = 5_000


@dataclass(frozen=True)
class HierarchicalConfig:
    """Ward is average linkage unless mode is "standard". timeout and num_threads are checked and have no effect."""

    n_clusters: int = 3
    linkage: str = "ward"
    metric: str = "euclidean"
    num_threads: int = 1
    timeout: float = 30.0
    mode: str = "reference"
    layout: str = "f5"
    max_points: int = MAX_POINTS

    def validate(self) -> None:
        require(self.n_clusters > 0, "n_clusters", "must be greater than 0")
        require(self.num_threads > 0, "num_threads", "must be greater than 0")
        require(self.linkage in LINKAGES, "linkage", f"must be one of {', '.join(LINKAGES)}")
        require(self.metric in METRICS, "metric", f"must be one of {', '.join(METRICS)}")


def agglomerate(x: np.ndarray, k: int, linkage: str = "average", metric: str = "euclidean", standard: bool = False) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Labels by position in the final list of clusters, and the merges (i, j, distance) as positions in the list at that time.

    The closest pair is the first of the smallest in list order; the merged cluster goes to the end of the list. Distances
    between clusters are kept in a matrix by cluster id and updated for the merged one only; each id caches its nearest later neighbour."""
    n = len(x)
    total = 2 * n
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    d = np.full((total, total), np.inf)
    d[:n, :n] = matrix(x, x, metric)
    np.fill_diagonal(d, np.inf)
    ward = linkage == "ward" and standard
    if ward:
        d[:n, :n] = d[:n, :n] ** 2
    means = {i: x[i] for i in range(n)}
    order, merges = list(range(n)), []
    # ids grow along the list, as merged clusters get the next id and go to the end: list order is id order
    best = np.full(total, np.inf)
    to = np.full(total, -1)

    def refresh(i: int, alive: np.ndarray) -> None:
        later = alive[alive > i]
        if len(later):
            row = d[i, later]
            m = int(row.argmin())
            best[i], to[i] = row[m], later[m]
        else:
            best[i], to[i] = np.inf, -1

    alive = np.arange(n)
    for i in range(n):
        refresh(i, alive)
    fresh = n
    while len(order) > k:
        a = int(alive[best[alive].argmin()])
        b = int(to[a])
        distance = float(best[a])
        merges.append((order.index(a), order.index(b), float(np.sqrt(distance)) if ward else distance))
        na, nb = len(members[a]), len(members[b])
        rest = alive[(alive != a) & (alive != b)]
        if linkage == "single":
            new = np.minimum(d[a, rest], d[b, rest])
        elif linkage == "complete":
            new = np.maximum(d[a, rest], d[b, rest])
        elif linkage == "centroid":
            means[fresh] = (na * means[a] + nb * means[b]) / (na + nb)
            new = matrix(means[fresh][None, :], np.array([means[int(r)] for r in rest]), metric)[0] if len(rest) else np.zeros(0)
        elif ward:
            nr = np.array([len(members[int(r)]) for r in rest], float)
            new = ((na + nr) * d[a, rest] + (nb + nr) * d[b, rest] - nr * d[a, b]) / (na + nb + nr)
        else:
            new = (na * d[a, rest] + nb * d[b, rest]) / (na + nb)
        members[fresh] = members.pop(a) + members.pop(b)
        order = [o for o in order if o not in (a, b)] + [fresh]
        alive = np.append(rest, fresh)
        d[fresh, rest] = d[rest, fresh] = new
        best[[a, b]] = np.inf
        for r, value in zip(rest.tolist(), new.tolist(), strict=True):
            if to[r] in (a, b):
                refresh(r, alive)
            elif value < best[r]:
                best[r], to[r] = value, fresh
        refresh(fresh, alive)
        fresh += 1
    labels = np.zeros(n, np.int64)
    for place, c in enumerate(order):
        labels[members[c]] = place
    return labels, merges


class Hierarchical(ClusterEstimator):
    """Each symbol is clustered on its own."""

    algorithm_name = "Hierarchical"

    def __init__(self, config: HierarchicalConfig | None = None) -> None:
        self.config = config or HierarchicalConfig()
        self.centers: DataFrame | None = None

    def validate_config(self) -> None:
        self.config.validate()

    def fit(self, bars: DataFrame) -> ClusterResult:
        self.validate_config()
        c = self.config

        def run(x: np.ndarray) -> dict:
            labels, _ = agglomerate(x, c.n_clusters, c.linkage, c.metric, c.mode == "standard")
            return {"cluster": labels.astype(np.int32)}

        out = per_symbol(bars, c.layout, c.max_points, run, "symbol string, row_idx long, cluster int")
        out = materialise(out, "hierarchical")
        rows = on_keys(points(bars, c.layout), out, ["symbol", "row_idx"])
        self.centers = materialise(group_means(rows), "centers")
        return ClusterResult(f"Hierarchical-{c.linkage}", out, c.n_clusters, [], inertia(rows, self.centers), None, 1, True)

    def dendrogram(self, bars: DataFrame) -> DataFrame:
        """symbol, step, a, b, distance: positions in the list of clusters when they merged."""
        c = self.config
        rows = points(bars, c.layout)

        def group(key, pdf):
            import pandas as pd

            x = np.array(pdf.sort_values("row_idx")["x"].tolist(), float)
            _, merges = agglomerate(x, c.n_clusters, c.linkage, c.metric, c.mode == "standard")
            return pd.DataFrame([(key[0], s, *m) for s, m in enumerate(merges)], columns=["symbol", "step", "a", "b", "distance"])

        return rows.groupBy("symbol").applyInPandas(group, "symbol string, step long, a long, b long, distance double")

    def predict(self, bars: DataFrame) -> DataFrame:
        """The nearest center of the bar's symbol by the configured metric."""
        return nearest_of_symbol(points(bars, self.config.layout), self.centers, self.config.metric)
