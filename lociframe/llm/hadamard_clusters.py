"""Centroid clustering whose nearest-centroid search goes coarse to fine through Walsh-Hadamard coefficients.

A vector of 64 components becomes integers, floor(256 * x). The Walsh-Hadamard transform of integers is exact, and
squared distances of coefficients are 64 times those of vectors. Coefficients are taken by the number of sign changes
of their row, coarse ones first, in stages. After a stage a centroid whose sum so far is already larger than the whole
distance of a known one is strictly worse and is left; the rest go on, and what remains after all 64 has its exact
distance. Ties go to the smaller number.

A round is one pass over the vectors: each partition returns counts and component sums of its clusters, at most
k * 64 numbers, and Spark adds them up; the driver holds k centroids. The vectors are written once, as integers, to the
shared folder, and read again in each round.

Kept are vectors with exactly 64 components, none null and none infinite or not a number; others have no row in the
result. A null id is an id whose hash comes last. Repeated rows are vectors of their own. With fewer vectors than
centroids each vector starts one; an empty table gives an empty result. Other columns are not looked at. Components
beyond 65 536 stop the run with an error, because squared distances of such vectors need more than a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import drop_table, table_cut

WIDTH = 64
SCALE = 256
LARGEST = 65_536
#: Coefficients that are summed up after each stage.
STAGES = (4, 12, 28, WIDTH)
CHUNK = 2048
FAR = np.iinfo(np.int64).max


def sequency_order(width: int = WIDTH) -> np.ndarray:
    """Rows of the natural-ordered Hadamard matrix by their number of sign changes."""
    rows = walsh_hadamard(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Transform of each row, by sums and differences of halves."""
    n, width = x.shape
    out, half = x, 1
    while half < width:
        pair = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out


ORDER = sequency_order()


def coefficients(x: np.ndarray) -> np.ndarray:
    return walsh_hadamard(x)[:, ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many squared differences that took."""
    y, c = coefficients(x), coefficients(centroids)
    sums = np.zeros((len(y), len(c)), np.int64)
    rows, cols = (a.ravel() for a in np.indices(sums.shape))
    lo, work, known = 0, 0, None
    for hi in STAGES:
        diff = y[rows, lo:hi] - c[cols, lo:hi]
        sums[rows, cols] += np.einsum("ij,ij->i", diff, diff)
        work += diff.size
        if known is None:  # the whole distance of the centroid that leads after the first stage
            diff = y - c[sums.argmin(axis=1)]
            known = np.einsum("ij,ij->i", diff, diff)
            work += diff.size
        left = sums[rows, cols] <= known[rows]
        sums[rows[~left], cols[~left]] = FAR
        rows, cols, lo = rows[left], cols[left], hi
    number = sums.argmin(axis=1)
    return number, sums[np.arange(len(y)), number] // WIDTH, work


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the integers of the kept vectors."""
    x = F.col(vec_col).cast("array<double>")
    far = F.exists("x", lambda e: F.abs(e) > LARGEST)
    whole = F.transform("x", lambda e: F.floor(e * SCALE).cast("int"))
    fine = F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == WIDTH) & fine)
            .select("vec_id", F.when(far, F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).otherwise(whole).cast("array<int>").alias("v")))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order; ties by the vector."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, WIDTH)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at:at + CHUNK]
            yield part["vec_id"], np.array(part["v"].tolist(), np.int64).reshape(-1, WIDTH)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k = len(centroids)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, WIDTH + 1), np.int64)
        for _, x in _chunks(batches):
            number, _, _ = nearest(x, centroids)
            np.add.at(total, number, np.column_stack([x, np.ones(len(x), np.int64)]))
        cluster, place = np.nonzero(total)
        yield pd.DataFrame({"cluster": cluster, "place": place, "total": total[cluster, place]})

    sums = np.zeros((k, WIDTH + 1), np.int64)
    for r in vectors.mapInPandas(totals, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        sums[r["cluster"], r["place"]] = r["total"]
    count = sums[:, WIDTH:]
    return np.where(count > 0, sums[:, :WIDTH] // np.maximum(count, 1), centroids)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _chunks(batches):
            number, distance, _ = nearest(x, centroids)
            yield pd.DataFrame({"vec_id": ids.astype("Int64"), "cluster": number, "distance": distance})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector after `rounds` rounds."""
    spark = df.sparkSession
    vectors = table_cut(integer_vectors(df, id_col, vec_col), "vectors")
    centroids = first_centroids(vectors, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(vectors, centroids)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    assigned = table_cut(assign(vectors, centroids), "assigned")
    drop_table(vectors)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    # k rows at most
    clusters = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()],
                                     "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(*(f.split()[0] for f in schema.split(", ")))
