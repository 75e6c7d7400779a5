"""Near pairs by pivots, neighbour descent and components, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociframe.operators import clustering as C
from lociframe.operators import components as P
from lociframe.operators import neighbours as N


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)


def clouds(n=900, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 30, (n, d))
    x[: n // 3] = rng.normal(5, 0.2, (n // 3, d))  # a third of all points in one small ball
    x[-20:] = x[0]  # equal points
    return x


@pytest.mark.parametrize("eps", [0.3, 2.0, 60.0])
def test_near_pairs(spark, eps):
    """Few, many and all pairs, with cells of 40 points: each near pair once."""
    x = clouds()
    got = [(r["src"], r["dst"]) for r in N.near_pairs(table(spark, x), eps, cell=40).select("src", "dst").collect()]
    d = N.distances(x, x)
    i, j = np.nonzero(np.triu(d <= eps, 1))
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist()))


def test_copies_grow_with_the_points(spark):
    """Points on a plane of constant density: rows over all cells grow like the points, not like their square."""
    rng = np.random.default_rng(3)
    held = {}
    for n in (600, 2400):
        x = rng.uniform(0, np.sqrt(n), (n, 2))
        small, dense = N.cells(table(spark, x), 1.0, cell=60)
        held[n] = small.count() + (0 if dense is None else dense.count())
        assert dense is None or dense.count() < 0.2 * held[n]
    assert held[2400] < 5.5 * held[600] < 5.5 * 3 * 600


def test_dbscan_and_groups(spark):
    x = np.concatenate([np.random.default_rng(2).normal(c, 0.3, (40, 2)) for c in (0, 8, 16)] + [[[50.0, 50.0]]])
    points = table(spark, x)
    labels = {r["id"]: r["cluster"] for r in C.dbscan(points, 1.5, 4).collect()}
    assert [len({labels[i] for i in range(40 * g, 40 * g + 40)}) for g in range(3)] == [1, 1, 1] and labels[120] == -1
    assert len({r["cluster"] for r in C.threshold_groups(points, 1.5).collect()}) == 4
    assert N.near_pairs(points.limit(0), 1.0).count() == 0


def test_descent_recall(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(rng.normal(0, 4, 12), 1.0, (150, 12)) for _ in range(10)])
    points = table(spark, x)
    found = N.knn_descent(points, 10, cell=100)
    exact = C.knn_graph(points, 10)
    assert found.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c <> 10").count() == 0
    assert N.recall(found, exact) >= 0.95
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    same = found.join(exact.withColumnRenamed("distance", "want"), ["id", "neighbour"])
    assert same.where(F.abs(F.col("distance") - F.col("want")) > 1e-9).count() == 0


def test_descent_of_copies(spark):
    """Copies of a few points fill cells that no pivots split: each point still has its k neighbours, all of them copies."""
    x = np.repeat(np.random.default_rng(8).normal(0, 5, (4, 6)), 150, axis=0)
    found = N.knn_descent(table(spark, x), 10, cell=60).toPandas()
    assert (found.groupby("id").size() == 10).all() and found["id"].nunique() == 600
    assert (found["id"] // 150 == found["neighbour"] // 150).all() and (found["distance"] < 1e-6).all()


@pytest.mark.parametrize("rows", [1, 40, 10_000])
def test_meetings_send_what_is_nearer(rows, monkeypatch):
    """Over batches of any size: each member's k nearest within its bound, without pairs of two old ones, and no others."""
    monkeypatch.setattr(N, "MET", rows)
    monkeypatch.setattr(N, "PRODUCTS", 300)
    rng, k = np.random.default_rng(9), 3
    columns, want = [], set()
    for v, size in enumerate([1, 2, 5, 17, 17, 30, 5]):
        u, x = np.sort(rng.choice(1000, size, replace=False)), rng.integers(0, 4, (size, 2)).astype(float)
        fresh, bound = rng.integers(0, 2, size) * (v != 3), rng.choice([0.0, 1.0, 2.0, np.inf], size)
        columns += [(v // 2, v % 2, int(a), int(f), float(b), y.tolist()) for a, f, b, y in zip(u, fresh, bound, x)]
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for i in range(size):
            near = sorted((round(d[i, j], 9), u[j]) for j in range(size) if j != i and (fresh[i] or fresh[j]) and d[i, j] <= bound[i] + 1e-9)
            want |= {(int(u[i]), int(b), float(a)) for a, b in near[:k]}
    names = ["v", "g", "u", "fresh", "bound", "vec"]
    batches = pa.table(dict(zip(names, map(list, zip(*columns))))).to_batches(max_chunksize=7)
    got = [(a, b, round(d, 9)) for t in N._meetings(iter(batches), k) for a, b, d in zip(*(t.column(c).to_pylist() for c in ("id", "neighbour", "distance")))]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 40)) @ np.diag(np.linspace(4, 0.2, 40)) @ np.linalg.qr(rng.normal(0, 1, (40, 40)))[0] + rng.normal(0, 5, 40)
    scores, load, ratio = C.pca(table(spark, x), 4)
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.sign(vt[range(4), np.abs(vt[:4]).argmax(axis=1)])
    assert np.allclose(load, (vt[:4] * sign[:, None]).T, atol=1e-6) and np.allclose(ratio, s[:4] ** 2 / (s**2).sum())
    got = {r["id"]: r["scores"] for r in scores.collect()}
    assert np.allclose([got[i] for i in range(300)], centred @ load)
    white, _, _ = C.pca(table(spark, x), 4, whiten=True)
    w = np.array([r["scores"] for r in white.collect()])
    assert np.allclose(w.T @ w, np.eye(4), atol=1e-6)


def test_components_of_wide_rows(spark):
    """20 000 columns: a square matrix of that width would take 3.2 GB; the residual of C·v = λ·v is measured."""
    d, n = 20_000, 120
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, (3, d))
    weights = rng.normal(0, 1, (n, 3)) * [9, 5, 3]
    points = table(spark, weights @ base + rng.normal(0, 0.5, (n, d)))
    found = P.components(points, 3)
    image = P.covariance_times(points, found.mean, n, found.vectors)
    assert np.linalg.norm(image - found.vectors * found.variances, axis=0).max() <= 1e-6 * found.variances[0] and found.residual <= 1e-8
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(3), atol=1e-8)


def test_degenerate_components(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vec array<double>")
    _, load, ratio = C.pca(same, 2)
    assert (ratio == 0).all() and load.shape[0] == 2
