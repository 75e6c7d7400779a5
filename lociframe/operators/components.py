"""Principal components by a growing subspace: no d x d matrix anywhere.

A pass multiplies the covariance with a few new directions: each partition centres its rows, projects them on the
directions and returns the d x l product, in blocks of BLOCK columns of the data that Spark adds up. The driver holds the
basis so far, d x MAX_BASIS numbers at most, finds the best vectors inside it, and takes what the covariance makes of
them beyond it, the residual, as the next directions (a block Davidson iteration with thick restarts). The residual is
known without a further pass, and the iteration ends when it is below the tolerance for all wanted components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
MAX_BASIS = 8  # times the block of directions
ROWS = 512


@dataclass
class Components:
    mean: np.ndarray
    vectors: np.ndarray  # d x k, the largest loading of each positive
    variances: np.ndarray
    total: float
    residual: float
    passes: int


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield np.array(batch["vec"].iloc[at:at + ROWS].to_list(), float)


def covariance_times(points: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """C·q in one pass, for the covariance C of the points."""
    d, width = q.shape
    context = points.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, q = context.value
        total, seen = np.zeros((d, width)), False
        for x in _chunks(batches):
            x = x - mean
            total += x.T @ (x @ q)
            seen = True
        if seen:
            yield pd.DataFrame({"block": range(0, d, BLOCK), "part": [total[i:i + BLOCK].ravel() for i in range(0, d, BLOCK)]})

    rows = points.select("vec").mapInPandas(run, "block int, part array<double>").groupBy("block").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
    out = np.zeros((d, width))
    for r in rows.collect():
        block = r["s"].toArray().reshape(-1, width)
        out[r["block"]:r["block"] + len(block)] = block
    context.unpersist()
    return out / (n - 1)


def _orthonormal(new: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    for _ in range(2):
        if basis is not None:
            new = new - basis @ (basis.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-300] / size[size > 1e-300]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * s[0]]
    return new


def components(points: DataFrame, k: int, oversample: int = 8, tolerance: float = 1e-9, max_passes: int = 60, seed: int = 3) -> Components:
    """The k largest components of a point table (id, vec). `points` are read in every pass."""
    first = points.select(Summarizer.metrics("mean", "count", "normL2").summary(array_to_vector("vec")).alias("s")).select("s.mean", "s.count", "s.normL2").first()
    mean, n = first["mean"].toArray(), int(first["count"])
    d = len(mean)
    total = float((first["normL2"].toArray() ** 2 - n * mean**2).sum() / (n - 1))
    width = min(d, k + oversample)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, width)), None)
    image = covariance_times(points, mean, n, basis)
    passes = 1
    while True:
        values, inner = np.linalg.eigh(basis.T @ image)
        inner = inner[:, ::-1][:, :width]
        values = values[::-1][:width]
        vectors, moved = basis @ inner, image @ inner
        rest = moved - vectors * values
        k = min(k, len(values))
        residual = float(np.linalg.norm(rest[:, :k], axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or passes >= max_passes or basis.shape[1] >= d:
            break
        if basis.shape[1] + width > MAX_BASIS * width:
            basis, image = vectors, moved
        new = _orthonormal(rest, basis)
        if not new.shape[1]:
            break
        basis, image = np.hstack([basis, new]), np.hstack([image, covariance_times(points, mean, n, new)])
        passes += 1
    vectors = vectors[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    return Components(mean, vectors * np.where(sign == 0, 1, sign), np.maximum(values[:k], 0.0), total, residual, passes)


def scores(points: DataFrame, found: Components, whiten: bool = False, n: int | None = None) -> DataFrame:
    """id and the centred points' coordinates along the components; whitened ones have sum of squares 1."""
    context = points.sparkSession.sparkContext.broadcast((found.mean, found.vectors))
    scale = 1 / np.sqrt(np.maximum(found.variances * ((n or 2) - 1), 1e-300)) if whiten else np.ones(len(found.variances))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, vectors = context.value
        for batch in batches:
            if len(batch):
                x = np.array(batch["vec"].to_list(), float) - mean
                yield pd.DataFrame({"id": batch["id"], "scores": list((x @ vectors) * scale)})

    return points.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, f"id {points.schema['id'].dataType.simpleString()}, scores array<double>")
