"""Graph measures over edge tables (src, dst, score), built from joins and aggregations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import ordinal_rank
from lociframe.session import cut_lineage

#: Counted rows up to which a table of nodes is sent to the edges, instead of both being shuffled.
SENT = 1 << 20


def build_graph(raw: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Undirected edges once each (src < dst) with scaled score, the larger one of repeated rows."""
    return (
        raw.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("score") / scale).alias("score"))
        .groupBy("src", "dst").agg(F.max("score").alias("score"))
    )


def _once(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _turned(one: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return one.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction; repeats are dropped before the turn, so half the rows are hashed."""
    return _turned(_once(edges))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Nodes with degree rank and a hub flag for the top fraction (at least one)."""
    ranked = ordinal_rank(degrees(edges), [], "degree", "node", "place", descending=True)
    n = degrees(edges).agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("is_hub", F.col("place") <= F.greatest(F.lit(1), F.floor(n * fraction)))


def network_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges and density in one row."""
    n = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.select("src", "dst").distinct().agg(F.count(F.lit(1))).scalar()
    nodes = F.col("n_nodes")
    return n.withColumn("n_edges", m).withColumn(
        "density", F.when(nodes > 1, 2 * F.col("n_edges") / (nodes * (nodes - 1))).otherwise(0.0))


def min_degree_subgraph(edges: DataFrame, min_degree: int) -> DataFrame:
    """Edges whose both ends have at least the degree in the whole graph."""
    keep = degrees(edges).where(F.col("degree") >= min_degree).select("node")
    return edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("node", "dst"), "dst", "left_semi")


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """Local clustering per node.

    Edges point from the lower to the higher degree, so that the two-step paths of one node number at
    most the root of the edge count squared, also for a hub.
    """
    deg = cut_lineage(degrees(edges))
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    e = e.join(deg.select(F.col("node").alias("u"), F.col("degree").alias("du")), "u").join(
        deg.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    arcs = cut_lineage(e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("lo"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("hi")))
    a, b = arcs.toDF("lo", "x"), arcs.toDF("lo", "y")
    wedges = a.join(b, "lo").where(F.col("x") < F.col("y"))
    closing = arcs.select(F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y"))
    tri = wedges.join(closing, ["x", "y"], "left_semi").select(F.explode(F.array("lo", "x", "y")).alias("node"))
    count = tri.groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    k = F.col("degree")
    return deg.join(count, "node", "left").select(
        "node", "degree", F.coalesce("t", F.lit(0)).alias("triangles"),
        F.when(k < 2, 0.0).otherwise(2 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).alias("clustering"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of the component as its name.

    Alternates two star rewritings: neighbours larger than a node move to its smallest neighbour, then
    smaller ones do, until nothing changes. The number of rounds grows with the logarithm of the longest path.
    """
    cur = cut_lineage(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    nodes = cur.select(F.col("a").alias("node")).unionByName(cur.select(F.col("b").alias("node"))).distinct()
    while True:
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = sym.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            floor.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = cut_lineage(small)
        same = nxt.exceptAll(cur).isEmpty() and cur.exceptAll(nxt).isEmpty()
        cur = nxt
        if same:
            break
    return nodes.join(cur.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def label_propagation(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Synchronous majority vote of neighbours from unique labels; ties go to the smallest label.

    Without a number of rounds the vote goes on until it settles. It can also come to swing between two states; each
    node then takes the smaller of its two labels.
    """
    sym = cut_lineage(both_ways(edges))
    labels = cut_lineage(sym.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    before = None
    done = 0
    while rounds is None or done < rounds:
        done += 1
        votes = sym.join(labels.toDF("dst", "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("c")).alias("k"), "label")).alias("b")).select(
            F.col("src").alias("node"), F.col("b.label").alias("label"))
        nxt = cut_lineage(best)
        if nxt.exceptAll(labels).isEmpty():
            return nxt
        if before is not None and nxt.exceptAll(before).isEmpty():
            return nxt.join(labels.withColumnRenamed("label", "__other"), "node").select("node", F.least("label", "__other").alias("label"))
        before, labels = labels, nxt
    return labels


def merge_small_communities(labels: DataFrame, edges: DataFrame, min_size: int = 3) -> DataFrame:
    """Members of communities under the size take the largest community among their neighbours (smallest name on a tie)."""
    labels = cut_lineage(labels)
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sized = cut_lineage(labels.join(size, "label"))
    small = sized.where(F.col("size") < min_size).select("node")
    near = both_ways(edges).join(small.toDF("src"), "src", "left_semi").join(
        sized.select(F.col("node").alias("dst"), "label", "size"), "dst")
    best = near.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("size")).alias("k"), "label")).alias("b"))
    return labels.join(best, "node", "left").select("node", F.coalesce("b.label", "label").alias("label"))


class _Side:
    """One side of the searches of all pairs: a table (node, word, mask) for each distance, with a bit for each pair, and
    of the last one the pairs and the rows by word."""

    def __init__(self, start: DataFrame):
        self.levels: list[DataFrame] = []
        self.add(start)

    def add(self, level: DataFrame) -> None:
        self.levels.append(cut_lineage(level))
        last = self.levels[-1].groupBy("word").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("n")).collect()
        self.masks, self.rows = {r["word"]: r["mask"] for r in last}, {r["word"]: r["n"] for r in last}

    def size(self, among: dict[int, int]) -> int:
        return sum(n for word, n in self.rows.items() if word in among)


def _masks(df: DataFrame) -> dict[int, int]:
    return {r["word"]: r["mask"] for r in df.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()}


def _shared(level: DataFrame, other: DataFrame, count: int | None = None) -> DataFrame:
    """The nodes of both, with the bits of both; the other is sent if it is counted and small."""
    other = other.withColumnRenamed("mask", "__other")
    met = level.join(F.broadcast(other) if count is not None and count <= SENT else other, ["node", "word"])
    return met.select("node", "word", F.col("mask").bitwiseAND(F.col("__other")).alias("mask")).where("mask <> 0")


def _among(level: DataFrame, masks: dict[int, int]) -> DataFrame:
    """The rows that belong to pairs of the masks, with the bits of those."""
    wanted = level.sparkSession.createDataFrame(list(masks.items()), "word long, __among long")
    mask = F.col("mask").bitwiseAND(F.col("__among"))
    return level.join(F.broadcast(wanted), "word").select("node", "word", mask.alias("mask")).where("mask <> 0")


def _neighbours(rows: DataFrame, count: int, sym: DataFrame) -> DataFrame:
    """The rows at every neighbour of their nodes."""
    ends = sym.toDF("node", "__next")
    met = ends.join(F.broadcast(rows) if count <= SENT else rows, "node")
    return met.drop("node").withColumnRenamed("__next", "node").select(rows.columns)


def sampled_betweenness(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of the given pairs (pair, source, target) whose one shortest path passes through a node.

    All searches advance together from both ends, one step of the side with fewer nodes in a round, until the sides of a
    pair meet or one of them has no more nodes. Pairs are bits, so a node has a row for 64 of them, and a new node needs
    to be compared with the last two distances only. The paths are then walked back from the targets, always to the
    smallest node that is nearer to the source; on the target's side these are the nodes from which the sides meet.
    """
    one = cut_lineage(_once(edges))
    sym = _turned(one)
    pairs = cut_lineage(pairs.select("pair", "source", "target").withColumn("__id", F.monotonically_increasing_id()))
    total = pairs.count()
    ends = cut_lineage(ordinal_rank(pairs, [], "__id", "__id", "__i").where("pair is not null and source <> target").select(
        "source", "target", F.expr("(__i - 1) div 64").alias("word"), F.expr("shiftleft(1L, cast((__i - 1) % 64 as int))").alias("mask")))
    start = lambda c: ends.groupBy(F.col(c).alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
    sides = near, far = _Side(start("source")), _Side(start("target"))
    searched, found, meets = _masks(ends), [], {}
    while searched:
        side = min(sides, key=lambda x: x.size(searched))
        at = side.levels
        new = _neighbours(_among(at[-1], searched), side.size(searched), sym).select("node", "word", "mask", F.lit(0).cast("long").alias("known"))
        for level in at[-2:]:
            new = new.union(level.select("node", "word", F.lit(0).cast("long"), "mask"))
        side.add(new.groupBy("node", "word").agg(F.bit_or("mask").bitwiseAND(F.bitwise_not(F.bit_or("known"))).alias("mask")).where("mask <> 0"))
        searched = {word: left for word, mask in searched.items() if (left := mask & side.masks.get(word, 0))}
        if not searched:
            break
        smaller, larger = sorted(sides, key=lambda x: x.size(searched))
        meet = cut_lineage(_shared(larger.levels[-1], smaller.levels[-1], smaller.size(searched)))
        if met := _masks(meet):
            ahead, back = len(near.levels) - 1, len(far.levels) - 1
            found += [(ahead, back, word, mask) for word, mask in met.items()]
            meets.setdefault(back, []).append(meet)
            searched = {word: left for word, mask in searched.items() if (left := mask & ~met.get(word, 0))}
    inner = [one.select(F.col("a").alias("node")).where(F.lit(False))]
    if found:
        # From where the sides meet to the targets: of each distance from a target, the nodes on shortest paths.
        onward, now = {}, None
        for dist in range(max(meets), 0, -1):
            parts = list(meets.get(dist, ()))
            if now is not None:
                parts.append(_shared(far.levels[dist], _neighbours(now, now.count(), sym).groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))))
            onward[dist] = now = cut_lineage(functools.reduce(DataFrame.union, parts))
        reached = edges.sparkSession.createDataFrame(found, "ahead int, back int, word long, __met long")
        walk = cut_lineage(ends.join(F.broadcast(reached), "word").where(F.col("mask").bitwiseAND(F.col("__met")) != 0).select(
            F.col("target").alias("node"), "word", "mask", "ahead", "back"))
        steps = [(F.col("back") >= dist, onward[dist], F.col("ahead") + F.col("back") > dist) for dist in sorted(onward)]
        steps += [(F.col("ahead") > dist, near.levels[dist], F.lit(True)) for dist in range(max(f[0] for f in found) - 1, 0, -1)]
        for goes, level, within in steps:
            at = _neighbours(walk.where(goes), total, sym).join(level.withColumnRenamed("mask", "__on"), ["node", "word"])
            moved = at.where(F.col("mask").bitwiseAND(F.col("__on")) != 0).groupBy("word", "mask", "ahead", "back").agg(F.min("node").alias("node"))
            walk = cut_lineage(moved.select(walk.columns).union(walk.where(~goes)))
            inner.append(walk.where(goes & within).select("node"))
    return functools.reduce(DataFrame.union, inner).groupBy("node").agg((F.count(F.lit(1)) / float(total)).alias("betweenness"))


def partner_rows(raw: DataFrame) -> DataFrame:
    """Partner table with plain score names, repeated rows once."""
    return raw.select(
        F.coalesce("preferredName_A", "stringId_A").alias("protein_a"), F.coalesce("preferredName_B", "stringId_B").alias("protein_b"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("escore", F.lit(0.0)).alias("score_coexp"),
        F.coalesce("ascore", F.lit(0.0)).alias("score_exp"), F.coalesce("dscore", F.lit(0.0)).alias("score_db"),
        F.coalesce("tscore", F.lit(0.0)).alias("score_textmine"),
    ).distinct()
