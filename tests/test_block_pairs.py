"""Pairs of parts, and the queries on pairs of points that use them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociframe.operators import blocks as B
from lociframe.operators import clustering as C
from lociframe.operators import graph as G
from lociframe.operators import neighbours as N


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("block", [B.BLOCK, 1000])
def test_every_pair_meets_once(spark, block):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.bool_())])

    def work(a, b, same):
        yield from B.batches_of(out, np.array([len(a)]), np.array([len(b)]), np.array([same]))

    n = 9000
    met = B.block_pairs(spark.range(n), work, "a long, b long, same boolean", block).collect()
    assert sum(r["a"] * (r["a"] - 1) // 2 if r["same"] else r["a"] * r["b"] for r in met) == n * (n - 1) // 2
    # Copies of a row: the parts that four shuffle partitions need, or those that a block's size asks for.
    copies = sum(r["a"] if r["same"] else r["a"] + r["b"] for r in met) / n
    assert copies == (4 if block == B.BLOCK else 9)


def test_knn_takes_equal_distances_by_id(spark):
    x = np.zeros((40, 2))
    x[20:] = 5.0
    got = {}
    for r in C.knn_graph(table(spark, x), 3, block=6).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    for i in range(40):
        base = 0 if i < 20 else 20
        assert [n for _, n in sorted(got[i])] == [j for j in range(base, base + 20) if j != i][:3]


def test_links_are_fewer_than_points(spark):
    """A ball of points that are all near: the pairs are many, the links are not, and the groups are the same."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.normal(9, 0.01, (300, 3)), [[50.0, 50.0, 50.0]]])
    found = N.Cells(table(spark, x), 1.0, 40)
    assert found.dense is not None and found.pairs().count() == 2 * 300 * 299 // 2
    assert found.links().count() < 5 * len(x)
    want = {i: 0 if i < 300 else 300 if i < 600 else 600 for i in range(601)}
    assert {r["id"]: r["cluster"] for r in C.threshold_groups(table(spark, x), 1.0).collect()} == want
    degree = {r["id"]: r["c"] for r in found.degrees().collect()}
    assert degree == {i: 299 for i in range(600)}


def test_border_points_of_dense_cells(spark):
    """A line of points with steps of 1: the ends have one neighbour and join as border points, one far point is noise."""
    x = np.concatenate([np.arange(60.0), [200.0]])[:, None]
    lab = {r["id"]: r["cluster"] for r in C.dbscan(table(spark, x), 1.2, 3).collect()}
    assert [lab[i] for i in range(60)] == [1] * 60 and lab[60] == -1


def test_both_ways(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (2, 5), (None, 4)], "src long, dst long")
    assert sorted(map(tuple, G.both_ways(e).collect())) == [(1, 2), (2, 1), (2, 5), (5, 2)]
    assert {r["node"]: r["component"] for r in G.connected_components(e).collect()} == {1: 1, 2: 1, 5: 1}
    assert {r["node"]: r["degree"] for r in G.degrees(e.withColumn("score", F.lit(1))).collect()} == {1: 1, 2: 2, 5: 1}
