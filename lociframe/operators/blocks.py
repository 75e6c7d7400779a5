"""All-pairs work on columns or points, cut into square blocks.

Members are packed into tiles of bounded width; every pair of tiles is one row, so the work of one hot
group is spread over many tasks and only reduced results leave a task, never the single pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import ordinal_rank
from lociframe.session import cut_lineage, spread

#: Most rows of a part, and the size below which rows are not cut further for the sake of more tasks.
BLOCK, SMALL = 32_768, 512
#: Products of points that a task holds at a time.
CELLS = 1 << 22

MOMENTS = "n double, sx double, sy double, sxx double, syy double, sxy double"


def column_moments(lm: DataFrame, row: str = "feature", col: str = "sample", value: str = "value",
                   block: int = 512, salts: int = 64) -> DataFrame:
    """Co-moments (n, Σx, Σy, Σx², Σy², Σxy) of every pair of columns over their shared rows, a < b.

    Rows are packed to one vector per (row, column block). Tasks own one block pair and one slice of
    the rows, multiply their vectors as matrices, and emit one partial sum per pair of columns.
    """
    dtype = dict(lm.dtypes)[col]
    cells = cut_lineage(lm.where(F.col(value).isNotNull()).select(row, col, F.col(value).cast("double").alias(value)))
    names = cells.select(col).distinct()
    numeric = dtype in {"bigint", "int", "smallint", "tinyint", "double", "float"}
    keyed = names.withColumn("__k", F.col(col).cast("double") if numeric else F.xxhash64(col).cast("double"))
    place = cut_lineage(ordinal_rank(keyed, [], "__k", col, "__i").select(col, (F.col("__i") - 1).alias("__i")))
    blocks = place.agg(F.floor(F.max("__i") / block) + 1).scalar()
    tiles = (
        cells.join(place, col)
        .withColumn("__b", F.floor(F.col("__i") / block))
        .groupBy(row, "__b")
        .agg(F.collect_list(F.struct((F.col("__i") % block).cast("int").alias("i"), F.col(value).alias("v"))).alias("cells"))
        .select(row, "__b", F.col("cells.i").alias("idx"), F.col("cells.v").alias("val"))
    )
    # Each tile goes to the block pairs it belongs to; there the two tiles of a row meet by grouping.
    sides = tiles.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))).select(
        row, F.least("__b", "__o").alias("ba"), F.greatest("__b", "__o").alias("bb"), "__b", "idx", "val",
    )
    paired = sides.groupBy(row, "ba", "bb").agg(
        F.max(F.when(F.col("__b") == F.col("ba"), F.struct("idx", "val"))).alias("left"),
        F.max(F.when(F.col("__b") == F.col("bb"), F.struct("idx", "val"))).alias("right"),
    ).where("left is not null and right is not null")
    salted = spread(paired.select(
        "ba", "bb", F.pmod(F.xxhash64(row), F.lit(salts)).alias("salt"), F.col("left.idx").alias("ia"),
        F.col("left.val").alias("va"), F.col("right.idx").alias("ib"), F.col("right.val").alias("vb"),
    ), "ba", "bb", "salt").sortWithinPartitions("ba", "bb")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(key: tuple[int, int], sums: np.ndarray) -> pd.DataFrame:
            i, j = np.nonzero(sums[0])
            keep = (key[0] != key[1]) | (i < j)
            i, j = i[keep], j[keep]
            out = {"ia": key[0] * block + i, "ib": key[1] * block + j}
            out.update({c: sums[k][i, j] for k, c in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))})
            return pd.DataFrame(out)

        current, sums = None, None
        for pdf in batches:
            for key, part in pdf.groupby(["ba", "bb"], sort=False):
                if key != current:
                    if sums is not None:
                        yield flush(current, sums)
                    current, sums = key, np.zeros((6, block, block))
                for start in range(0, len(part), 2048):
                    piece = part.iloc[start : start + 2048]
                    x, mx = _dense(piece["ia"], piece["va"], block)
                    y, my = _dense(piece["ib"], piece["vb"], block)
                    for k, (u, v) in enumerate(((mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y))):
                        sums[k] += u.T @ v
        if sums is not None:
            yield flush(current, sums)

    partial = salted.mapInPandas(multiply, f"ia long, ib long, {MOMENTS}")
    total = partial.groupBy("ia", "ib").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    named = total.join(place.select(F.col("__i").alias("ia"), F.col(col).alias("p")), "ia").join(
        place.select(F.col("__i").alias("ib"), F.col(col).alias("q")), "ib")
    # Names of text columns are placed by hash, so a pair may have to be turned round.
    turn = F.col("p") > F.col("q")

    def side(x: str, y: str) -> Column:
        return F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x)

    return named.select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("n").cast("long").alias("n"),
        side("sx", "sy"), side("sy", "sx"), side("sxx", "syy"), side("syy", "sxx"), "sxy")


def _dense(idx: pd.Series, val: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(idx), width)), np.zeros((len(idx), width))
    rows = np.repeat(np.arange(len(idx)), [len(v) for v in idx])
    cols = np.concatenate([np.asarray(v, dtype=int) for v in idx])
    x[rows, cols] = np.concatenate([np.asarray(v, dtype=float) for v in val])
    mask[rows, cols] = 1.0
    return x, mask


def vectors(table: pa.Table, name: str = "vec") -> np.ndarray:
    """A list column as the rows of a matrix; all lists have one length."""
    lists = pa.concat_arrays(table.column(name).chunks)
    widths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(widths) != 1 or widths[0] is None:
        raise ValueError(f"{name} must hold lists of one length, found {widths}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), widths[0])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a * a).sum(axis=1)[:, None]
    d += (b * b).sum(axis=1)[None]
    return np.sqrt(np.maximum(d, 0.0, out=d), out=d)


def batches_of(schema: pa.Schema, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrow batches of equally long columns, where NaN in a whole-number column is null."""
    arrays = [pa.array(c, from_pandas=pa.types.is_integer(f.type)).cast(f.type) for c, f in zip(columns, schema)]
    yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=1 << 16)


def block_pairs(
    rows: DataFrame, work: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK,
    key: str = "id", group: str | None = None,
) -> DataFrame:
    """Run ``work(a, b, same)`` on every unordered pair of parts of the rows, also of a part with itself, by group if given.

    Rows with equal keys share a part, by hash. A row is copied once for each part of its group, so parts are as few as the
    tasks need (the pairs of parts about twice the shuffle partitions) and hold at most about ``block`` rows: what is
    shuffled is the rows times the parts, which stay the same in number until a part is full.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(rows)
    count = F.count(F.lit(1))
    parts = F.greatest(F.lit(1), F.ceil(count / block), F.least(F.ceil(count / min(SMALL, block)), F.lit(math.ceil(2 * math.sqrt(tasks))))).cast("int")
    if group:
        placed = rows.join(rows.groupBy(group).agg(parts.alias("__n")), group)
    else:
        placed = rows.withColumn("__n", rows.agg(parts).scalar())
    part, other = F.col("__part"), F.col("__other")
    placed = placed.withColumn("__part", F.pmod(F.xxhash64(key), F.col("__n"))).withColumn(
        "__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n").cast("long") - 1)))
    keys = [*([group] if group else []), "__lo", "__hi"]
    sides = placed.select(*rows.columns, F.least(part, other).alias("__lo"), F.greatest(part, other).alias("__hi"), part.alias("__part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        lo, hi = table.column("__lo")[0].as_py(), table.column("__hi")[0].as_py()
        if lo == hi:
            yield from work(table, table, True)
            return
        first = pc.equal(table.column("__part"), lo)
        a, b = table.filter(first), table.filter(pc.invert(first))
        if len(a) and len(b):
            yield from work(a, b, False)

    return spread(sides, *keys).groupBy(*keys).applyInArrow(run, schema)
