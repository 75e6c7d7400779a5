"""Neighbour graphs, clusterings and their quality over point tables (id, vec)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.operators.blocks import BLOCK, CELLS, batches_of, block_pairs, distances, vectors
from lociframe.operators.graph import connected_components
from lociframe.operators.components import components, scores
from lociframe.operators.kmeans import Model, best_fits, fit_models, label_bits, labels, mean_silhouettes, prepared
from lociframe.operators.neighbours import Cells, knn_descent, near_pairs
from lociframe.session import cut_lineage


def knn_graph(points: DataFrame, k: int = 15, block: int = BLOCK, method: str = "exact") -> DataFrame:
    """k nearest other points (id, neighbour, distance, place): exact by pairs of parts, or by ``descent``.

    Every pair of parts returns at most k candidates per point; the k best of those are kept. Descent never compares all
    points; it finds nearly all neighbours.
    """
    if method == "descent":
        return knn_descent(points, k)

    out = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64())])

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (ia, va), (ib, vb) = ((t.column("id").to_numpy(), vectors(t)) for t in (a.sort_by("id"), b.sort_by("id")))
        yield from batches_of(out, *_nearest(ia, va, ib, vb, k, same))
        if not same:
            yield from batches_of(out, *_nearest(ib, vb, ia, va, k, same))

    cand = block_pairs(_points(points), work, "id long, neighbour long, distance double", block)
    w = W.partitionBy("id").orderBy(F.round("distance", 9), "neighbour")
    return cand.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _points(points: DataFrame, *more: str) -> DataFrame:
    return points.select("id", F.col("vec").cast("array<double>").alias("vec"), *more)


def _nearest(ia: np.ndarray, va: np.ndarray, ib: np.ndarray, vb: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """The k nearest of the b side, which is in the order of its ids, for each of the a side, by rounded distance and id."""
    found = []
    step = max(16, CELLS // len(ib))
    take = min(k, len(ib))
    head = min(len(ib), max(1024, 4 * take))
    for at in range(0, len(ia), step):
        d = distances(va[at:at + step], vb)
        if same:
            d[ia[at:at + step, None] == ib[None]] = np.inf
        # The k-th distance among the first columns bounds that of the row; what passes is few.
        cut = np.partition(d[:, :head], take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero((d <= cut[:, None] + 1e-8) & np.isfinite(d))
        order = np.lexsort((j, np.round(d[i, j], 9), i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        found.append((ia[at + i], ib[j], d[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def shared_neighbours(knn: DataFrame) -> DataFrame:
    """Weight of each kNN edge: neighbours both ends have in common (lists hold k members)."""
    knn = cut_lineage(knn.select("id", "neighbour"))
    lists = knn.groupBy("id").agg(F.collect_list("neighbour").alias("near"))
    a, b = lists.toDF("id", "na"), lists.toDF("neighbour", "nb")
    pairs = knn.select("id", "neighbour").join(a, "id").join(b, "neighbour").select(
        F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst"),
        F.size(F.array_intersect("na", "nb")).alias("weight"))
    return pairs.distinct().where("weight > 0")


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Density clusters (id, cluster): the smallest core id of the cluster, -1 for noise.

    A border point joins the smallest of the clusters whose core points reach it.
    """
    found = Cells(points, eps)
    core = cut_lineage(found.degrees().where(F.col("c") + 1 >= min_samples).select("id"))
    links = cut_lineage(found.links(core))
    comp = connected_components(links.where(~F.col("border")).select("src", "dst")).toDF("id", "cluster")
    core_label = cut_lineage(core.join(comp, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")))
    border = links.where("border").select(F.col("src").alias("id"), "dst").join(core_label.toDF("dst", "cluster"), "dst").groupBy("id").agg(
        F.min("cluster").alias("cluster"))
    return points.select("id").join(core_label.unionByName(border), "id", "left").na.fill(-1, ["cluster"])


def threshold_groups(points: DataFrame, cut: float) -> DataFrame:
    """Single-linkage groups at a distance cut: components of the pairs within it."""
    comp = connected_components(Cells(points, cut).links().select("src", "dst")).toDF("id", "cluster")
    return points.select("id").join(comp, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def silhouette(points: DataFrame, label: str = "label", block: int = BLOCK) -> DataFrame:
    """Exact silhouette of each point; the own cluster's mean leaves the point itself out."""
    out = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("s", pa.float64()), ("c", pa.int64())])

    def sums_of(ia: np.ndarray, va: np.ndarray, ib: np.ndarray, vb: np.ndarray, xb: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        order = np.argsort(xb, kind="stable")
        ib, vb = ib[order], vb[order]
        labs, starts, counts = np.unique(xb[order], return_index=True, return_counts=True)
        step = max(16, CELLS // len(ib))
        for at in range(0, len(ia), step):
            ids = ia[at:at + step]
            d = distances(va[at:at + step], vb)
            if same:
                d[ids[:, None] == ib[None]] = 0.0
            s = np.add.reduceat(d, starts, axis=1)
            yield from batches_of(out, np.repeat(ids, len(labs)), np.tile(labs, len(ids)), s.ravel(), np.tile(counts, len(ids)))

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (ia, va, xa), (ib, vb, xb) = ((t.column("id").to_numpy(), vectors(t), t.column("label").to_numpy()) for t in (a, b))
        yield from sums_of(ia, va, ib, vb, xb, same)
        if not same:
            yield from sums_of(ib, vb, ia, va, xa, same)

    src = points.select("id", "vec", F.col(label).cast("long").alias("label"))
    sums = block_pairs(_points(src, "label"), work, "id long, other long, s double, c long", block)
    per = sums.groupBy("id", "other").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).join(src.select("id", "label"), "id")
    own = F.col("other") == F.col("label")
    agg = per.groupBy("id", "label").agg(
        F.max(F.when(own & (F.col("c") > 1), F.col("s") / (F.col("c") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("c"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return agg.select("id", "label", F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0).alias("silhouette"))


def kmeans(points: DataFrame, k: int, seed: int = 42, restarts: int = 10, max_iter: int = 100) -> tuple[DataFrame, float]:
    """Points with the cluster of the best of several seeded runs, and its inertia. All runs share the passes."""
    data = prepared(points)
    best = best_fits(fit_models(data, [Model(k, seed + r) for r in range(restarts)], max_iter=max_iter), lambda m: m.k)[k]
    return points.join(labels(data, [best]).select("id", "cluster"), "id"), best.inertia


def kmeans_summary(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    labelled, inertia = kmeans(points, k, seed)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("inertia", F.lit(inertia))


def choose_k(points: DataFrame, ks: Sequence[int] = range(2, 11), seed: int = 42, exact: bool = False,
             restarts: int = 10) -> DataFrame:
    """Inertia and mean silhouette of the best of the runs for each k (one row per k); `best` marks the largest silhouette.

    The runs of all k are fitted in one sequence of passes. The exact silhouette compares all points; otherwise the
    squared-distance form is used, which only needs cluster moments.
    """
    data = prepared(points)
    fits = best_fits(fit_models(data, [Model(k, seed + r) for k in ks for r in range(restarts)]), lambda m: m.k)
    chosen = [fits[k] for k in ks]
    if exact:
        labelled = cut_lineage(labels(data, chosen))
        scores = [silhouette(data.join(labelled.where(F.col("fit") == i), "id"), "cluster").agg(F.avg("silhouette")).first()[0] for i in range(len(chosen))]
    else:
        scores = mean_silhouettes(data, chosen)
    rows = [(k, f.inertia, float(s)) for k, f, s in zip(ks, chosen, scores)]
    top = max(rows, key=lambda r: (r[2], -r[0]))[0] if rows else None
    return points.sparkSession.createDataFrame([(*r, r[0] == top) for r in rows], "k int, inertia double, silhouette double, best boolean")


def consensus(points: DataFrame, k: int, iterations: int = 100, fraction: float = 0.8, seed: int = 42, restarts: int = 10) -> DataFrame:
    """Share of the runs on seeded subsamples in which two points (a < b) fall in one cluster.

    A run is the best of the restarts on its subsample; all of them are fitted in one sequence of passes.
    """
    data = prepared(points)
    models = [Model(k, seed + i * restarts + r, seed + i) for i in range(iterations) for r in range(restarts)]
    fits = best_fits(fit_models(data, models, fraction), lambda m: m.sample)
    found = label_bits(data, [fits[seed + i] for i in range(iterations)], fraction)
    # Bits of the (run, cluster) names of a point, rows of one id together; two points meet in as many runs as they have names in common.
    names = found.groupBy("id").agg(F.collect_set("bits").alias("bits"))
    width = sum(len(fits[seed + i].centres) for i in range(iterations))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("consensus", pa.float64())])

    def held(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(table.column("bits").chunks)
        packed = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint8).reshape(-1, -(-width // 8))
        starts = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()[:-1]))
        x = np.unpackbits(np.bitwise_or.reduceat(packed, starts, axis=0), axis=1, count=width)
        return table.column("id").to_numpy(), x.astype(np.float32)

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (ia, xa), (ib, xb) = held(a), held(b)
        step = max(16, CELLS // 4 // len(ib))
        for at in range(0, len(ia), step):
            n = xa[at:at + step] @ xb.T
            ids = ia[at:at + step]
            i, j = np.nonzero((n > 0) & (ids[:, None] < ib[None]) if same else n > 0)
            yield from batches_of(out, np.minimum(ids[i], ib[j]), np.maximum(ids[i], ib[j]), n[i, j] / float(iterations))

    return block_pairs(names, work, "a long, b long, consensus double")


def pca(points: DataFrame, k: int = 10, whiten: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores (id, scores ARRAY), loadings (features × k) and explained variance ratios.

    Scores are those of the centred data (U·S); ``whiten`` gives U. The sign of a component makes its
    largest loading positive.
    """
    data = prepared(points)
    found = components(data, k)
    out = scores(data, found, whiten, data.count() if whiten else None)
    return out, found.vectors, found.variances / found.total if found.total > 0 else found.variances * 0


def explained_variance(points: DataFrame, k: int = 10) -> DataFrame:
    """Ratio and cumulative ratio per component (k rows)."""
    _, _, ratio = pca(points, k)
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, np.cumsum(ratio)))]
    return points.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def top_loadings(points: DataFrame, k: int = 10, top: int = 10) -> DataFrame:
    """Features of the largest absolute loadings per component."""
    _, load, _ = pca(points, k)
    rows = [(c + 1, int(f), float(load[f, c]), i + 1) for c in range(load.shape[1]) for i, f in enumerate(np.argsort(-np.abs(load[:, c]))[:top])]
    return points.sparkSession.createDataFrame(rows, "component int, feature int, loading double, place int")


def cluster_means(lm: DataFrame, clusters: DataFrame, clusters_list: list | None = None) -> DataFrame:
    """Mean of each feature in each cluster, clusters as columns when they are listed."""
    rows = lm.join(clusters, "sample")
    if clusters_list is None:
        return rows.groupBy("cluster", "feature").agg(F.avg("value").alias("mean"))
    return rows.groupBy("feature").pivot("cluster", clusters_list).agg(F.avg("value"))
