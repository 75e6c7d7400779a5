"""Paths of sampled pairs, against searches one by one, and the rows that the searches keep."""

from __future__ import annotations

import numpy as np
import pytest

from lociframe.operators import graph as G


def searched(edges, pairs):
    """Share of the pairs whose path passes through a node; of a node's nearer neighbours the smallest is its parent."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    hits = {}
    for source, target in pairs:
        dist, front = {source: 0}, [source]
        while front:
            front = list(dict.fromkeys(n for f in front for n in near.get(f, ()) if n not in dist and not dist.update({n: dist[f] + 1})))
        if source is None or target is None or target not in dist:
            continue
        node = target
        while dist[node] > 1:
            node = min(n for n in near[node] if dist.get(n, -1) == dist[node] - 1)
            hits[node] = hits.get(node, 0) + 1
    return {n: h / len(pairs) for n, h in hits.items()}


def shares(spark, edges, pairs, kind="long"):
    e = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], f"pair int, source {kind}, target {kind}")
    return {r["node"]: r["betweenness"] for r in G.sampled_betweenness(e, p).collect()}


def random_edges(rnd, nodes, n, first=0):
    return [(int(a) + first, int(b) + first) for a, b in rnd.integers(0, nodes, (n, 2))]


@pytest.mark.parametrize("sent", [G.SENT, 0])
def test_paths_are_those_of_single_searches(spark, monkeypatch, sent):
    monkeypatch.setattr(G, "SENT", sent)
    rnd = np.random.default_rng(11)
    # A dense part, a sparse one, a path, a star, nodes on their own; edges repeat, turned and unturned, and some have no end.
    edges = random_edges(rnd, 40, 150) + random_edges(rnd, 60, 75, 100) + [(i, i + 1) for i in range(200, 209)] + [(300, i) for i in range(301, 320)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(500, 500), (None, 3), (4, None)]
    names = [*range(40), *range(100, 160), *range(200, 210), *range(300, 320), 500, 999]
    pairs = [tuple(int(x) for x in rnd.choice(names, 2)) for _ in range(30)]
    pairs += [tuple(int(x) for x in rnd.choice(part, 2)) for part in (range(40), range(100, 160), range(200, 210), range(300, 320)) for _ in range(12)]
    pairs += [(5, 5), (None, 4), (4, None), (200, 209), (209, 200), (200, 209)]
    assert len(pairs) > 64
    assert shares(spark, edges, pairs) == pytest.approx(searched(edges, pairs))


def test_paths_between_text_nodes_and_none_at_all(spark):
    edges = [(str(a), str(b)) for a, b in random_edges(np.random.default_rng(3), 20, 30)]
    pairs = [(str(a), str(b)) for a in range(4) for b in range(10, 14)]
    assert shares(spark, edges, pairs, "string") == pytest.approx(searched(edges, pairs))
    assert shares(spark, [(1, 2), (3, 4)], [(1, 3), (1, 2), (9, 1), (2, 2)]) == {}
    assert shares(spark, [(1, 2)], []) == {} and shares(spark, [], [(1, 2)]) == {}


def test_searches_keep_no_row_for_each_pair_and_node(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    edges = random_edges(rnd, 300, 1200)
    pairs = [tuple(int(x) for x in rnd.choice(300, 2, replace=False)) for _ in range(120)]
    rows, cut = [], G.cut_lineage

    def counted(df):
        rows.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    assert shares(spark, edges, pairs) == pytest.approx(searched(edges, pairs))
    assert max(rows) <= 1200  # the edges; two words of 64 pairs at 300 nodes are fewer, a row for each pair there would be 36 000
