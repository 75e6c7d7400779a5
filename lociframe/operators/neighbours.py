"""Pairs of points within a known distance, and neighbour graphs without comparing all points.

Near pairs: a cell of many points is split by pivots drawn from it. A point's home is its nearest pivot; it is also
copied to a cell of a smaller number if it lies within eps of the border between the two, for only then can a point
there be near. Two points are compared in the smaller one of their homes, which has both, so every near pair is met once
and none is lost. Cells that copies don't let shrink, such as a ball smaller than eps, are compared by pairs of parts.

Neighbour descent: neighbours of neighbours are likely neighbours. From a first graph inside cells, each point brings
its neighbours and those it is a neighbour of together; new pairs among them are measured where they meet, and a point
keeps its k nearest, until hardly any change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.operators.blocks import CELLS, batches_of, block_pairs, distances, vectors
from lociframe.session import cut_lineage, spread

CELL = 1024
PIVOTS = 24
LEVELS = 24
#: A split is kept if its cells hold at most GROWTH times the points, and the largest at most SHRINK of them.
GROWTH, SHRINK = 3.0, 0.75
#: Rows of meetings, and products of points, that a task of a descent holds at a time.
MET, PRODUCTS = 1 << 15, 1 << 20


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a table that meets itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _uniform(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "id", "cell"), F.lit(1_000_003)) / 1_000_003.0


def _drawn_pivots(members: DataFrame, cell: int, seed: int) -> DataFrame:
    """cell and vectors of some of its members, two for each cell's worth of them within limits; `members` has size."""
    some = members.where(_uniform(seed) < F.lit(3.0 * PIVOTS) / F.col("size"))
    drawn = some.groupBy("cell").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "id").alias("h"), "vec"))).alias("p"))
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(4), F.ceil(2 * F.col("size") / cell))).cast("int")
    return drawn.select("cell", F.slice("p", 1, wanted).alias("p"))


def _split(members: DataFrame, eps: float | None, cell: int, level: int, seed: int) -> DataFrame:
    """Members of cells (cell, id, vec, mask, size) in the cells of their pivots; with eps also as guests in others."""
    parts = members.withColumn("part", F.floor(_uniform(seed + 1) * F.ceil(F.col("size") / (4 * CELL))).cast("int"))
    pivots = _drawn_pivots(members, cell, seed).join(parts.select("cell", "part").distinct(), "cell").select("cell", "part", F.col("p.vec").alias("p"))

    def assign(points: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(points["vec"])
        # Pivots that are the same point are one; a cell without two different ones stays as it is.
        p = np.unique(np.array([np.asarray(v) for v in drawn["p"].iloc[0]], float), axis=0) if len(drawn) else np.zeros((0, x.shape[1]))
        if len(p) < 2:
            return points.assign(child=points["cell"])[["cell", "child", "id", "vec", "mask"]]
        d = distances(x, p)
        home = d.argmin(axis=1)
        row, place = np.arange(len(x)), home
        guest = np.zeros(len(x), bool)
        if eps is not None:
            own = d[np.arange(len(x)), home]
            between = distances(p, p)[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = (d**2 - own[:, None] ** 2) / (2 * between)
            near = (border <= eps * (1 + 1e-9) + 1e-9) & (np.arange(len(p))[None] < home[:, None])
            r, j = np.nonzero(near)
            row, place, guest = np.concatenate([row, r]), np.concatenate([place, j]), np.concatenate([guest, np.ones(len(r), bool)])
        out = points.iloc[row].copy()
        out["child"] = [f"{c}/{j}" for c, j in zip(out["cell"], place)]
        out["mask"] = out["mask"].to_numpy() | (guest.astype(np.int64) << level)
        return out[["cell", "child", "id", "vec", "mask"]]

    return parts.groupBy("cell", "part").cogroup(_renewed(pivots).groupBy("cell", "part")).applyInPandas(
        assign, "cell string, child string, id long, vec array<double>, mask long")


def cells(points: DataFrame, eps: float | None, cell: int = CELL, seed: int = 17) -> tuple[DataFrame, DataFrame | None]:
    """Rows (cell, id, vec, mask) of cells up to the size, and those of larger ones that don't shrink, if there are any.

    Two members are to be compared if their masks have no bit in common: a bit marks a guest of that level.
    """
    open_cells = cut_lineage(points.select(F.lit("c").alias("cell"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(0).cast("long").alias("mask")))
    small, dense = [], []
    for level in range(LEVELS):
        sized = open_cells.join(open_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), "cell")
        small.append(sized.where(F.col("size") <= cell).drop("size"))
        large = cut_lineage(sized.where(F.col("size") > cell))
        if large.isEmpty():
            large = None
            break
        children = cut_lineage(_split(large, eps, cell, level, seed + 2 * level))
        sizes = children.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        judged = large.groupBy("cell").agg(F.first("size").alias("size")).join(sizes, "cell")
        good = cut_lineage(judged.where((F.col("all") <= GROWTH * F.col("size")) & (F.col("most") <= SHRINK * F.col("size"))).select("cell"))
        dense.append(large.drop("size").join(good, "cell", "left_anti"))
        open_cells = cut_lineage(children.join(good, "cell", "left_semi").select(F.col("child").alias("cell"), "id", "vec", "mask"))
        large = None
    else:
        dense.append(open_cells)
    join = lambda parts: None if not parts else parts[0] if len(parts) == 1 else join([parts[0].unionByName(parts[1]), *parts[2:]])
    return join(small), join(dense)


def _near_in(a: pa.Table, b: pa.Table, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b and distances of the near pairs to be compared here, some rows of a at a time."""
    (ia, ma, va), (ib, mb, vb) = ((t.column("id").to_numpy(), t.column("mask").to_numpy(), vectors(t)) for t in (a, b))
    step = max(16, CELLS // len(ib))
    for at in range(0, len(ia), step):
        d = distances(va[at:at + step], vb)
        i, j = np.nonzero(d <= eps)
        x, y = ia[at + i], ib[j]
        ok = ((ma[at + i] & mb[j]) == 0) & ((x < y) if same else (x != y))
        i, j = i[ok], j[ok]
        yield at + i, j, d[i, j]


def joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each node's group after the links are added; `root` has that before them."""
    root = root.copy()
    while True:
        u, v = root[u], root[v]
        open_links = u != v
        if not open_links.any():
            return root
        u, v = u[open_links], v[open_links]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, root[root]):
            root = root[root]


class Cells:
    """Points in cells that hold every pair within eps once; ids are distinct. Both kinds of cells are read by each method."""

    def __init__(self, points: DataFrame, eps: float, cell: int = CELL) -> None:
        self.eps = eps
        self.small, self.dense = cells(points, eps, cell)

    def _each(self, work: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, core: DataFrame | None = None) -> DataFrame:
        marked = lambda df: df if core is None else df.join(core.select("id", F.lit(True).alias("core")), "id", "left").na.fill(False, ["core"])

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            yield from work(table, table, True)

        out = marked(self.small).groupBy("cell").applyInArrow(alone, schema)
        return out if self.dense is None else out.unionByName(block_pairs(marked(self.dense), work, schema, group="cell"))

    def pairs(self) -> DataFrame:
        """src < dst and distance of each near pair."""
        out, eps = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("distance", pa.float64())]), self.eps

        def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
            ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
            for i, j, d in _near_in(a, b, eps, same):
                yield from batches_of(out, np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j]), d)

        return self._each(work, "src long, dst long, distance double")

    def degrees(self) -> DataFrame:
        """id and number c of the near others of each point that has one; pairs are counted where they meet."""
        out, eps = pa.schema([("id", pa.int64()), ("c", pa.int64())]), self.eps

        def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
            na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for i, j, _ in _near_in(a, b, eps, same):
                na += np.bincount(i, minlength=len(a))
                nb += np.bincount(j, minlength=len(b))
            for table, n in ((a, na), (b, nb)):
                yield from batches_of(out, table.column("id").to_numpy()[n > 0], n[n > 0])

        return self._each(work, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))

    def links(self, core: DataFrame | None = None) -> DataFrame:
        """Links (src, dst, border) whose components are those of the near pairs, fewer than the points of each meeting.

        With ``core`` (id) only pairs of two core points count, and each pair of another point and a core point is a row
        with border (src: the other point).
        """
        out, eps = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("border", pa.bool_())]), self.eps
        flagged = core is not None

        def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
            ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
            ids = np.unique(np.concatenate([ia, ib]))
            pa_, pb = np.searchsorted(ids, ia), np.searchsorted(ids, ib)
            ca, cb = ((t.column("core").to_numpy() if flagged else np.ones(len(t), bool)) for t in (a, b))
            root = np.arange(len(ids))
            for i, j, _ in _near_in(a, b, eps, same):
                both, first, second = ca[i] & cb[j], ~ca[i] & cb[j], ca[i] & ~cb[j]
                root = joined(root, pa_[i[both]], pb[j[both]])
                x = np.concatenate([ia[i[first]], ib[j[second]]])
                yield from batches_of(out, x, np.concatenate([ib[j[first]], ia[i[second]]]), np.ones(len(x), bool))
            far = np.flatnonzero(root != np.arange(len(ids)))
            yield from batches_of(out, ids[root[far]], ids[far], np.zeros(len(far), bool))

        return self._each(work, "src long, dst long, border boolean", core)


def near_pairs(points: DataFrame, eps: float, cell: int = CELL) -> DataFrame:
    """Pairs of points (src < dst) within eps, each once; ids are distinct."""
    return Cells(points, eps, cell).pairs()


# ---- neighbour graphs by descent


def _best(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Each member's k nearest others in a group."""
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    take = min(k, len(ids) - 1)
    at = np.argpartition(d, take - 1, axis=1)[:, :take] if take else np.zeros((len(ids), 0), int)
    i = np.repeat(np.arange(len(ids)), at.shape[1])
    j = at.ravel()
    ok = np.isfinite(d[i, j])
    return pd.DataFrame({"id": ids[i[ok]], "neighbour": ids[j[ok]], "distance": d[i, j][ok]})


NEAR = "id long, neighbour long, distance double"


def _nearer(met: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """Each member's k nearest others within its bound in whole meetings (v, g, u, fresh, bound, vec), in their order.

    Pairs of two that are both not fresh are left out. Meetings of one size are measured together.
    """
    out = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64())])
    v, g, u, bound = (met.column(c).to_numpy() for c in ("v", "g", "u", "bound"))
    fresh, x = met.column("fresh").to_numpy() == 1, vectors(met)
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (g[1:] != g[:-1])]))
    sizes = np.diff(starts, append=len(v))
    sizes[~np.logical_or.reduceat(fresh, starts)] = 0
    for size in np.unique(sizes[sizes > 1]):
        those = starts[sizes == size]
        step, place = max(1, PRODUCTS // int(size) ** 2), np.arange(size)
        for at in range(0, len(those), step):
            rows = those[at:at + step, None] + place
            d = x[rows] @ x[rows].transpose(0, 2, 1)
            # Squares from the same products, so that equal points are at distance 0.
            own = d[:, place, place]
            d *= -2
            d += own[:, :, None]
            d += own[:, None]
            d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            near = d <= bound[rows][:, :, None] + 1e-8
            near &= fresh[rows][:, :, None] | fresh[rows][:, None]
            near[:, place, place] = False
            m, i = np.nonzero(near.sum(axis=2) > k)
            if len(m):
                # Members are in the order of their ids, which a stable sort keeps among equal distances.
                best = np.where(near[m, i], np.round(d[m, i], 9), np.inf).argsort(axis=1, kind="stable")[:, :k]
                near[m, i] = False
                near[m[:, None], i[:, None], best] = True
            m, i, j = np.nonzero(near)
            yield from batches_of(out, u[rows[m, i]], u[rows[m, j]], d[m, i, j])


def _meetings(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """`_nearer` over rows in the order of their meetings, many at a time; the last one held waits for its other rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= MET:
            met = pa.Table.from_batches(held)
            v, g = met.column("v").to_numpy(), met.column("g").to_numpy()
            whole = int(np.argmax((v == v[-1]) & (g == g[-1])))
            if whole:
                yield from _nearer(met.slice(0, whole), k)
            held, n = met.slice(whole).to_batches(), n - whole
    if n:
        yield from _nearer(pa.Table.from_batches(held), k)


def knn_descent(points: DataFrame, k: int = 15, cell: int = 256, rounds: int = 12, settled: float = 0.001, group: int = 64, seed: int = 5) -> DataFrame:
    """Approximate k nearest other points (id, neighbour, distance, place), by descent from two splits into cells.

    A round reads the graph's edges, not the points' pairs: its work is the number of edges times the size of a meeting.
    A point without fresh edges calls no meeting, and a pair leaves its meeting only for the end whose k-th neighbour so
    far is not nearer, so what is sent on shrinks with each round.
    Points that very many others have as neighbour meet these in groups of `group`, chosen anew in each round. It ends
    when less than the share `settled` of all edges is new, or after `rounds`. tests/test_neighbours.py measures recall.
    """
    data = cut_lineage(points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    n = data.count()
    order = W.partitionBy("id").orderBy(F.round("distance", 9), "neighbour")

    def nearest(candidates: DataFrame) -> DataFrame:
        one = candidates.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"), F.min("old").alias("old"), F.max("old").alias("kept"))
        return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    first = None
    for s in (seed, seed + 100):
        small, dense = cells(data, None, cell, s)
        if dense is not None:
            # A cell that no pivots split, such as copies of one point, is cut into parts of the size of a cell.
            parts = dense.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell).alias("parts"))
            dense = dense.join(parts, "cell").withColumn("cell", F.concat_ws("/", "cell", F.pmod(F.xxhash64(F.lit(s), "id"), F.col("parts")).cast("string"))).drop("parts")
        whole = small if dense is None else small.unionByName(dense)
        found = whole.groupBy("cell").applyInPandas(lambda pdf: _best(pdf["id"].to_numpy(), _vectors(pdf["vec"]), k), NEAR)
        first = found if first is None else first.unionByName(found)
    graph = cut_lineage(nearest(first.withColumn("old", F.lit(0))).select("id", "neighbour", "distance", "place", F.lit(1).alias("fresh")))
    for r in range(rounds):
        ends = graph.select(F.col("id").alias("v"), F.col("neighbour").alias("u"), "fresh").unionByName(graph.select(F.col("neighbour").alias("v"), F.col("id").alias("u"), "fresh"))
        own = graph.select(F.col("id").alias("v"), F.col("id").alias("u"), F.lit(0).alias("fresh")).distinct()
        ends = ends.unionByName(own).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        counts = ends.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / group).alias("m"), F.max("fresh").alias("any")).where("any = 1").drop("any")
        placed = ends.join(counts, "v").withColumn("g", F.pmod(F.xxhash64(F.lit(r), "u"), F.col("m")))
        bounds = graph.where(F.col("place") == k).select(F.col("id").alias("u"), F.round("distance", 9).alias("bound"))
        members = data.withColumnRenamed("id", "u").join(bounds, "u", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        meet = spread(placed.join(members, "u").select("v", "g", "u", "fresh", "bound", "vec"), "v", "g").sortWithinPartitions("v", "g", "u")
        found = meet.mapInArrow(lambda batches: _meetings(batches, k), NEAR)
        both = graph.select("id", "neighbour", "distance", F.lit(1).alias("old")).unionByName(found.withColumn("old", F.lit(0)))
        graph = cut_lineage(nearest(both).select("id", "neighbour", "distance", "place", (1 - F.col("kept")).alias("fresh")))
        if graph.where("fresh = 1").count() <= settled * n * k:
            break
    return graph.drop("fresh")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact graph's edges that were found."""
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"]).count()
    return hit / max(1, exact.count())
