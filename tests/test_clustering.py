import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import D8, G9, H6, K5, bars
from tickloom import errors
from tickloom.operators.cluster import affinity, base, dbscan, gmm, hierarchical, kmeans, quality, selection, som
from tickloom.operators.graph import components


def labels(result, name="cluster"):
    return [r[name] for r in result.assignments.orderBy("row_idx").collect()]


def sequential_dbscan(x, eps, least):
    """The textbook scan in row order; a point once seen as noise stays noise."""
    n = len(x)
    near = [[j for j in range(n) if math.dist(x[i], x[j]) <= eps] for i in range(n)]
    label, seen, c = [0] * n, [False] * n, 0
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        if len(near[i]) < least:
            continue
        c += 1
        label[i] = c
        queue = list(near[i])
        while queue:
            j = queue.pop(0)
            if seen[j]:
                continue
            seen[j] = True
            label[j] = c
            if len(near[j]) >= least:
                queue += near[j]
    return label


def test_dbscan_fixture(spark):
    model = dbscan.DBSCAN(dbscan.DBSCANConfig(epsilon=10.0, min_points=2))
    result = model.fit(bars(spark, D8))
    assert labels(result) == [1, 1, 1, 1, 1, 2, 2, 2] and result.n_clusters == 2
    assert [r.cluster for r in model.predict(bars(spark, D8)).orderBy("row_idx").collect()] == [1, 1, 1, 1, 1, 2, 2, 2]
    chunked = dbscan.DBSCAN(dbscan.DBSCANConfig(epsilon=10.0, min_points=2, variant="Incremental", buffer_size=3)).fit(bars(spark, D8))
    assert labels(chunked) == [1, 1, 1, 2, 2, 0, 3, 3]


@pytest.mark.parametrize("seed", range(4))
def test_dbscan_equals_the_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    x = [(rnd.uniform(0, 6), 0.0, 0.0, rnd.uniform(0, 6)) for _ in range(60)]
    rows = spark.createDataFrame([(0, k, list(p)) for k, p in enumerate(x)], "part long, i long, x array<double>")
    got = dbscan.cluster_points(rows, 0.9, 4).orderBy("i").collect()
    assert [r.cluster for r in got] == sequential_dbscan(x, 0.9, 4)


def test_search(spark):
    rows = bars(spark, K5)
    assert 1 in {r.row_idx for r in dbscan.range_search(rows, [102, 107, 100, 104], 5.0).collect()}
    queries = spark.createDataFrame([("q", [102.0, 107.0, 100.0, 104.0])], "q string, x array<double>")
    assert [r.row_idx for r in dbscan.nearest_neighbours(rows, queries, 3).orderBy("rank").collect()] == [1, 0, 2]


def test_hierarchical_goldens(spark):
    x = np.array(H6, float)
    merge = lambda rows: [(a, b, round(d, 6)) for a, b, d in rows]
    for linkage, want, merges in (
        ("average", [0, 2, 2, 1, 1, 1], [(4, 5, 50.159745), (3, 4, 75.357962), (1, 2, 100.079968)]),
        ("ward", [0, 2, 2, 1, 1, 1], [(4, 5, 50.159745), (3, 4, 75.357962), (1, 2, 100.079968)]),
        ("single", [0, 2, 2, 1, 1, 1], [(4, 5, 50.159745), (3, 4, 50.635956), (1, 2, 100.079968)]),
        ("complete", [0, 1, 1, 2, 2, 2], [(4, 5, 50.159745), (1, 2, 100.079968), (1, 2, 100.079968)]),
        ("centroid", [0, 2, 2, 1, 1, 1], [(4, 5, 50.159745), (3, 4, 75.239617), (1, 2, 100.079968)]),
    ):
        got, steps = hierarchical.agglomerate(x, 3, linkage)
        assert got.tolist() == want and merge(steps) == merges, linkage
    model = hierarchical.Hierarchical(hierarchical.HierarchicalConfig(linkage="average"))
    assert labels(model.fit(bars(spark, H6))) == [0, 2, 2, 1, 1, 1]
    assert [r.cluster for r in model.predict(bars(spark, H6)).orderBy("row_idx").collect()] == [0, 2, 2, 1, 1, 1]
    assert model.dendrogram(bars(spark, H6)).count() == 3


def slow_agglomerate(x, k, linkage, metric):
    groups = [[i] for i in range(len(x))]
    from tickloom.operators.cluster.grouped import matrix

    d = matrix(x, x, metric)
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                cells = [d[a, b] for a in groups[i] for b in groups[j]]
                v = {"single": min, "complete": max, "average": lambda c: sum(c) / len(c)}[linkage](cells)
                if best is None or v < best[0] - 1e-12:
                    best = (v, i, j)
        _, i, j = best
        merged = groups[i] + groups[j]
        groups = [g for n, g in enumerate(groups) if n not in (i, j)] + [merged]
    out = [0] * len(x)
    for n, g in enumerate(groups):
        for i in g:
            out[i] = n
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
@pytest.mark.parametrize("metric", hierarchical.METRICS)
def test_hierarchical_equals_the_plain_scan(linkage, metric):
    rng = np.random.default_rng(3)
    for _ in range(5):
        x = rng.uniform(1, 10, (18, 3))
        assert hierarchical.agglomerate(x, 4, linkage, metric)[0].tolist() == slow_agglomerate(x, 4, linkage, metric)


def test_too_many_points(spark):
    with pytest.raises(errors.TooManyPoints):
        hierarchical.Hierarchical(hierarchical.HierarchicalConfig(max_points=5)).fit(bars(spark, H6))


def test_affinity_golden(spark):
    x = np.array(H6, float)
    got, exemplars, iterations, converged = affinity.propagate(x, affinity.AffinityPropagationConfig())
    assert (got.tolist(), exemplars, iterations, converged) == ([0] * 6, [2], 43, True)
    model = affinity.AffinityPropagation(affinity.AffinityPropagationConfig(mode="standard"))
    result = model.fit(bars(spark, H6))
    assert len(set(labels(result))) == result.n_clusters
    assert [r.cluster for r in model.predict(bars(spark, H6)).orderBy("row_idx").collect()] == labels(result)


def test_kmeans(spark):
    rows = [(100 + k % 10, 105 + k % 10, 98 + k % 10, 103 + k % 10, 1000 + k % 100) for k in range(300)]
    model = kmeans.KMeans(kmeans.KMeansConfig(k=4, seed=5, max_iterations=50))
    result = model.fit(bars(spark, rows))
    assert result.converged and result.silhouette == 0.5 and result.n_points == 300
    x = np.array([[*r[:4], r[4] / 1000] for r in rows], float)
    centers = np.array(result.centers)
    nearest = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
    assert labels(result) == nearest.tolist()
    assert np.allclose([x[nearest == c].mean(0) for c in range(4)], centers)
    assert math.isclose(result.inertia, ((x - centers[nearest]) ** 2).sum(), rel_tol=1e-9)
    assert labels(kmeans.KMeans(kmeans.KMeansConfig(k=4, seed=5, max_iterations=50)).fit(bars(spark, rows))) == labels(result)
    with pytest.raises(errors.InsufficientData):
        kmeans.KMeans(kmeans.KMeansConfig(k=4)).fit(bars(spark, rows[:3]))
    with pytest.raises(errors.EmptyDataset):
        kmeans.KMeans(kmeans.KMeansConfig(k=4)).fit(bars(spark, []))
    assert quality.is_valid(result) and result.summary().first().n_clusters == 4


@pytest.mark.parametrize("how", [{"k": None}, {"k": 0}, {"k": 2, "variant": "Other"}])
def test_kmeans_config(how):
    with pytest.raises(errors.ConfigError):
        kmeans.KMeansConfig(**how).validate()


def plain_em(x, means, steps, reg):
    """The mixture's steps with NumPy, diagonal."""
    k, width = means.shape
    w, cov = np.full(k, 1 / k), np.full((k, width), 1.0 + reg)
    for _ in range(steps):
        p = np.stack([w[i] * np.exp(-0.5 * (((x - means[i]) ** 2 / cov[i]).sum(1)) - 0.5 * np.log(cov[i]).sum()) for i in range(k)], 1)
        r = p / p.sum(1, keepdims=True)
        s = r.sum(0)
        means = (r.T @ x) / s[:, None]
        cov = np.stack([(r[:, i, None] * (x - means[i]) ** 2).sum(0) / s[i] + reg for i in range(k)])
        w = s / s.sum()
    return w, means


def test_gmm(spark):
    start = ((95.0, 100.0, 93.0, 97.0, 900.0), (110.0, 115.0, 108.0, 112.0, 1400.0))
    model = gmm.GaussianMixture(gmm.GMMConfig(n_components=2, covariance_type="Diagonal", regularization=500.0, max_iterations=4, tolerance=1e-12, means=start))
    result = model.fit(bars(spark, G9))
    w, means = plain_em(np.array(G9, float), np.array(start), 4, 500.0)
    assert np.allclose(model.weights, w) and np.allclose(model.means, means) and model.hit_max_iterations and result.converged
    assert all(math.isclose(sum(r.probability), 1) for r in result.assignments.collect())
    aic, bic = model.information_criteria(9)
    assert aic < bic
    assert len(labels(gmm.GaussianMixture(gmm.GMMConfig(n_components=2, seed=1, mode="standard")).fit(bars(spark, G9)))) == 9


@pytest.mark.parametrize("how", [{"n_components": 0}, {"max_iterations": 0}, {"tolerance": -1}, {"regularization": -1}, {"num_threads": 0}])
def test_gmm_config(how):
    with pytest.raises(errors.ConfigError):
        gmm.GMMConfig(**how).validate()


@pytest.mark.parametrize(
    "config",
    [dbscan.DBSCANConfig(epsilon=-1), dbscan.DBSCANConfig(min_points=1), dbscan.DBSCANConfig(max_iterations=0), dbscan.DBSCANConfig(tolerance=-1e-6), dbscan.DBSCANConfig(num_threads=0), dbscan.DBSCANConfig(buffer_size=0), hierarchical.HierarchicalConfig(n_clusters=0), hierarchical.HierarchicalConfig(num_threads=0), affinity.AffinityPropagationConfig(damping=1.5), affinity.AffinityPropagationConfig(max_iterations=0), affinity.AffinityPropagationConfig(tolerance=-1), affinity.AffinityPropagationConfig(num_threads=0), som.SOMConfig(width=0), som.SOMConfig(height=0), som.SOMConfig(learning_rate=1.5), som.SOMConfig(neighborhood_radius=0), som.SOMConfig(epochs=0), som.SOMConfig(num_threads=0)],
)
def test_rejected(config):
    with pytest.raises(errors.ConfigError):
        config.validate()


def test_som(spark):
    for training in ("online", "batch"):
        c = som.SOMConfig(width=2, height=2, epochs=12, training=training)
        model = som.SOM(c)
        result = model.fit(bars(spark, H6))
        assert result.converged and result.n_clusters == 4 and set(labels(result)) <= set(range(4))
        assert labels(som.SOM(c).fit(bars(spark, H6))) == labels(result)
    grid = som.grid_distances(som.SOMConfig(width=3, height=2, topology="hexagonal"))
    assert grid[0, 4] == 1 + 1 + 1 and som.grid_distances(som.SOMConfig(width=3, height=2))[0, 4] == math.sqrt(2)


def test_silhouette(spark):
    x = np.array(D8, float)[:, :4]
    k = [0, 0, 0, 0, 1, 1, 1, 2]
    rows = spark.createDataFrame([(i, k[i], x[i].tolist()) for i in range(8)], "id long, cluster int, x array<double>")
    want = []
    for i in range(8):
        own = [math.dist(x[i], x[j]) for j in range(8) if j != i and k[j] == k[i]]
        if own:
            a = sum(own) / len(own)
            b = min(sum(math.dist(x[i], x[j]) for j in range(8) if k[j] == c) / k.count(c) for c in set(k) - {k[i]})
            want.append((b - a) / max(a, b))
    assert math.isclose(quality.silhouette(rows).first()[0], sum(want) / len(want))
    with pytest.raises(errors.TooManyPoints):
        quality.silhouette(rows, max_rows=3)


def test_sizes_and_scores(spark):
    rows = spark.createDataFrame([(c,) for c in (0, 0, 1, 1, 1, 2)], "cluster int")
    sizes = quality.cluster_sizes(rows, 3)
    assert [r["size"] for r in sizes.orderBy("cluster").collect()] == [2, 3, 1]
    assert quality.size_statistics(sizes).first().balanced
    levels = spark.createDataFrame([(0.8, True), (0.5, True), (0.3, True), (0.1, True), (0.9, False)], "s double, c boolean").select(quality.overall_quality(F.col("s"), F.col("c")).alias("q"))
    assert [r.q for r in levels.collect()] == ["Excellent", "Good", "Fair", "Poor", "Poor"]
    m = quality.ValidationMetrics(0.8, 100, 0.5, 2)
    assert m.is_acceptable(0.7) and not m.is_acceptable(0.9)
    perfect = spark.createDataFrame([(c, str(c)) for c in (0, 0, 1, 1, 2)], "cluster int, label string")
    assert [round(x, 9) for x in quality.external_indices(perfect).first()] == [1.0] * 5


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_metrics_of_distance(spark):
    row = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    got = [row.select(base.pair_distance(F.col("a"), F.col("b"), m)).first()[0] for m in ("euclidean", "manhattan")]
    assert got == [5.0, 7.0]
    assert row.select(base.distance(F.col("a"), [0.0, 0.0], "cosine")).first()[0] == 1.0
    with pytest.raises(errors.ClusteringError):
        som.SOM().update(None)


def test_inertia_and_assessment(spark):
    """Of the centers, exemplars and neurons, by hand."""
    x = np.array([[*r] for r in H6], float)
    for model in (hierarchical.Hierarchical(hierarchical.HierarchicalConfig(n_clusters=3)), affinity.AffinityPropagation(), som.SOM(som.SOMConfig(width=2, height=2, epochs=5)), som.SOM(som.SOMConfig(width=2, height=2, epochs=5, training="batch"))):
        result = model.fit(bars(spark, H6))
        labels = [r.cluster for r in result.assignments.orderBy("row_idx").collect()]
        if isinstance(model, hierarchical.Hierarchical):
            want = sum(((x[[k for k, v in enumerate(labels) if v == c]] - x[[k for k, v in enumerate(labels) if v == c]].mean(0)) ** 2).sum() for c in set(labels))
            assert abs(result.inertia - want) < 1e-6 * want
        assert result.inertia is not None and result.inertia >= 0
        told = result.quality_assessment().collect()[0]
        assert told.n_points == 6 and sum(told.cluster_sizes) == 6 and len(told.cluster_sizes) == told.n_clusters and told.level in ("Poor", "Fair", "Good", "Excellent")


def test_selection(spark):
    """Two clear groups are found alike on any sample, and the algorithm that finds them is recommended."""
    rows = [(100 + k % 3, 101 + k % 3, 99 + k % 3, 100 + k % 3, 10) for k in range(30)] + [(500 + k % 3, 501 + k % 3, 499 + k % 3, 500 + k % 3, 10) for k in range(30)]
    many = bars(spark, rows)
    good = lambda: hierarchical.Hierarchical(hierarchical.HierarchicalConfig(n_clusters=2))
    bad = lambda: hierarchical.Hierarchical(hierarchical.HierarchicalConfig(n_clusters=12))
    assert [r.ari for r in selection.stability(good, many, runs=2).collect()] == [1.0, 1.0]
    assert selection.recommend({"two": good, "twelve": bad}, many) in ("two", "twelve")
    ranks = {r.algorithm: r["rank"] for r in selection.compare({"two": good, "twelve": bad}, many).collect()}
    assert sorted(ranks.values()) == [1, 2]
    scaled = np.array([r.x for r in selection.Preprocessor().fit(many).transform(many).collect()])
    assert np.allclose(scaled.mean(0), 0) and np.allclose(scaled[:, 0].std(), 1) and np.allclose(scaled[:, 4], 0)
