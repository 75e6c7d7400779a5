"""Order statistics over sampled ranges, which stay even when one key, or one value, holds most of the rows.

A window ordered over a whole key puts that key into one task. Here rows are dealt by `repartitionByRange` over (keys,
value, tie): Spark samples them and cuts their total order into ranges of about equal size, wherever a key or a value
begins or ends. The sorted ranges are checkpointed in the shared folder, and each is scanned in its order. What a scan
can't know is the carry from range to range: the first and the last group of each range come to the driver, a few
numbers for each range whatever the rows, and go with the next scan to the rows of groups that cross a border. Nothing
is joined, and no row moves again.

A task holds its range as Arrow columns. The number of ranges is that of shuffle partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.session import ensure_checkpoint_dir

RANGE = "__range"


def sorted_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in checkpointed partitions that are ranges of their order, with the number of the range."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.withColumn(RANGE, F.spark_partition_id()).checkpoint()


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> tuple[int, pa.Table] | None:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts)
    return table.column(RANGE)[0].as_py(), table.drop_columns([RANGE])


def collect_ranges(ranges: DataFrame, cols: Sequence[str], summary: Callable[[int, pa.Table], Any]) -> dict[int, Any]:
    """The summary of each range that has rows, from some columns, by the number of the range and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _whole_ranges(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([whole[0]], pa.int32()), "s": pa.array([pickle.dumps(summary(*whole))], pa.binary())})

    rows = ranges.select(RANGE, *dict.fromkeys(cols)).mapInArrow(run, "r int, s binary").collect()
    return {r["r"]: pickle.loads(r["s"]) for r in sorted(rows, key=lambda r: r["r"])}


def emit_ranges(ranges: DataFrame, schema: T.StructType, work: Callable[[int, pa.Table], list[pa.Array]]) -> DataFrame:
    """Rows that `work` makes of each range, as the columns of the schema."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _whole_ranges(batches)) is not None:
            yield from pa.Table.from_arrays(work(*whole), names=names).to_batches(max_chunksize=10_000)

    return ranges.mapInArrow(run, schema)


def map_ranges(ranges: DataFrame, added: Sequence[T.StructField], work: Callable[[int, pa.Table], list[pa.Array]]) -> DataFrame:
    """Rows with the added columns that `work` makes of each range."""
    fields = [f for f in ranges.schema.fields if f.name != RANGE]
    return emit_ranges(ranges, T.StructType([*fields, *added]), lambda number, table: [*table.columns, *work(number, table)])


# ---- scans


@dataclass(frozen=True)
class Level:
    """What is wanted along the order inside the groups of some leading columns of the order.

    ``sums`` maps a name to a summed column, or to None for the number of rows: ``<name>_run``, up to and with the row,
    and ``<name>_all``, of the whole group. ``lags`` maps a name to a column whose value in the preceding row is wanted.
    """

    keys: tuple[str, ...]
    sums: dict[str, str | None] = field(default_factory=dict)
    lags: dict[str, str] = field(default_factory=dict)


def _plain(value: Any) -> Any:
    return "nan" if isinstance(value, float) and value != value else value


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal keys; null equals null, and what is not a number itself."""
    fresh = np.zeros(len(table), bool)
    fresh[0] = True
    for key in keys:
        column = pa.concat_arrays(table.column(key).chunks)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        other = other | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        if pa.types.is_floating(column.type):
            both = pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)
            other = other & ~both.to_numpy(zero_copy_only=False)
        fresh[1:] |= other
    return np.flatnonzero(fresh)


def _numbers(table: pa.Table, source: str | None) -> np.ndarray:
    if source is None:
        return np.ones(len(table), np.int64)
    column = pc.fill_null(table.column(source), 0)
    whole = pa.types.is_integer(column.type)
    return column.cast(pa.int64() if whole else pa.float64()).to_numpy().astype(np.int64 if whole else np.longdouble)


def _edge(table: pa.Table, level: Level) -> dict[str, Any]:
    """Keys and sums of the first and the last group of a range, whether they are one, and the last row's lag columns."""
    starts = group_starts(table, level.keys)
    n, end = len(table), starts[1] if len(starts) > 1 else len(table)
    key = lambda i: tuple(_plain(table.column(k)[i].as_py()) for k in level.keys)
    values = [_numbers(table, s) for s in level.sums.values()]
    return {"first": key(0), "last": key(n - 1), "single": len(starts) == 1, "head": [v[:end].sum() for v in values],
            "tail": [v[starts[-1]:].sum() for v in values], "row": [table.column(s)[n - 1].as_py() for s in level.lags.values()]}


def _carries(edges: Sequence[dict]) -> list[dict]:
    """For each range in order: what ranges before it hold of its first group, and those behind it of its last one."""
    before, behind, rows = [], [], []
    for i, e in enumerate(edges):
        prev = edges[i - 1] if i and edges[i - 1]["last"] == e["first"] else None
        before.append([t + b if prev["single"] else t for t, b in zip(prev["tail"], before[-1])] if prev else [0] * len(e["head"]))
        rows.append(prev["row"] if prev else None)
    for i in range(len(edges) - 1, -1, -1):
        after = edges[i + 1] if i + 1 < len(edges) and edges[i + 1]["first"] == edges[i]["last"] else None
        behind.append([h + b if after["single"] else h for h, b in zip(after["head"], behind[-1])] if after else [0] * len(edges[i]["head"]))
    return [{"before": b, "behind": a, "row": r} for b, a, r in zip(before, behind[::-1], rows)]


def carries(ranges: DataFrame, levels: Sequence[Level]) -> dict[int, list[dict]]:
    """The carry of each level for each range."""
    cols = [c for level in levels for c in [*level.keys, *(s for s in level.sums.values() if s), *level.lags.values()]]
    edges = collect_ranges(ranges, cols, lambda _, table: [_edge(table, level) for level in levels])
    each = [_carries([e[k] for e in edges.values()]) for k in range(len(levels))]
    return {r: [c[i] for c in each] for i, r in enumerate(edges)}


def running(values: np.ndarray, starts: np.ndarray, before: Any, behind: Any) -> tuple[np.ndarray, np.ndarray]:
    """Running sums inside the groups and the groups' totals at each row, with the carry of the border groups."""
    sizes = np.diff(np.append(starts, len(values)))
    whole = np.cumsum(values)
    base = np.concatenate([[0], whole[starts[1:] - 1]]).astype(whole.dtype)
    total = np.add.reduceat(values, starts)
    base[0] -= before
    total[0] += before
    total[-1] += behind
    return whole - np.repeat(base, sizes), np.repeat(total, sizes)


def scan(ranges: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """Rows with the running values of all levels."""
    carry = carries(ranges, levels)
    kinds = {f.name: f.dataType for f in ranges.schema.fields}
    whole = lambda s: s is None or isinstance(kinds[s], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    added = [f for level in levels for f in (
        *(T.StructField(f"{name}_{end}", T.LongType() if whole(s) else T.DoubleType()) for name, s in level.sums.items() for end in ("run", "all")),
        *(T.StructField(name, kinds[s]) for name, s in level.lags.items()))]

    def work(number: int, table: pa.Table) -> list[pa.Array]:
        out = []
        for level, c in zip(levels, carry[number]):
            starts = group_starts(table, level.keys)
            for s, before, behind in zip(level.sums.values(), c["before"], c["behind"]):
                out += [pa.array(x if x.dtype == np.int64 else x.astype(np.float64)) for x in running(_numbers(table, s), starts, before, behind)]
            fresh = np.zeros(len(table), bool)
            fresh[starts] = True
            for k, s in enumerate(level.lags.values()):
                column = pa.concat_arrays(table.column(s).chunks)
                first = pa.array([c["row"][k] if c["row"] else None], column.type)
                moved = pa.concat_arrays([first, column.slice(0, len(column) - 1)])
                fresh[0] = False
                out.append(pc.if_else(pa.array(fresh), pa.scalar(None, column.type), moved))
        return out

    return map_ranges(ranges, added, work)


def running_max(ranges: DataFrame, keys: Sequence[str], value: str) -> Callable[[int, pa.Table], np.ndarray]:
    """A function of (range, its table): the largest value, up to and with each row, of the rows of its keys.

    A null value counts as least. What ranges before hold of a range's first group is carried.
    """

    def values(table: pa.Table) -> np.ndarray:
        return pc.fill_null(table.column(value).cast(pa.float64()), -np.inf).to_numpy().copy()

    def edge(_: int, table: pa.Table) -> dict[str, Any]:
        starts, v = group_starts(table, keys), values(table)
        key = lambda i: tuple(_plain(table.column(k)[i].as_py()) for k in keys)
        return {"first": key(0), "last": key(len(table) - 1), "single": len(starts) == 1, "tail": v[starts[-1]:].max()}

    carry, prev = {}, None
    for number, e in collect_ranges(ranges, [*keys, value], edge).items():
        same = prev is not None and prev["last"] == e["first"]
        carry[number] = prev["most"] if same else -np.inf
        prev = {**e, "most": max(e["tail"], carry[number]) if e["single"] else e["tail"]}

    def run(number: int, table: pa.Table) -> np.ndarray:
        v = values(table)
        v[0] = max(v[0], carry[number])
        # Places in the sorted values, raised by the group, so that one running maximum restarts at each group.
        levels, place = np.unique(v, return_inverse=True)
        group = np.zeros(len(v), np.int64)
        group[group_starts(table, keys)[1:]] = 1
        group = np.cumsum(group)
        return levels[np.maximum.accumulate(place + group * len(levels)) - group * len(levels)]

    return run


def running_max_by(ranges: DataFrame, keys: Sequence[str], value: str, label: str, labels: Sequence[Any]) -> Callable[[int, pa.Table], Iterator[np.ndarray]]:
    """As `running_max`, one array for each of the labels: the largest value, up to and with each row, of those rows of its
    keys that carry the label. The work is that of one running maximum, whatever the number of labels."""

    def parts(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        v, held = table.column(value).cast(pa.float64()), table.column(label)
        some = pc.is_valid(v)
        at = [np.flatnonzero(pc.fill_null(pc.and_(some, pc.equal(held, pa.scalar(x, held.type))), False).to_numpy()) for x in labels]
        return pc.fill_null(v, -np.inf).to_numpy(), at

    def edge(_: int, table: pa.Table) -> dict[str, Any]:
        starts, (v, at) = group_starts(table, keys), parts(table)
        key = lambda i: tuple(_plain(table.column(k)[i].as_py()) for k in keys)
        tail = np.array([v[p[np.searchsorted(p, starts[-1]):]].max(initial=-np.inf) for p in at])
        return {"first": key(0), "last": key(len(table) - 1), "single": len(starts) == 1, "tail": tail}

    carry, prev = {}, None
    for number, e in collect_ranges(ranges, [*keys, value, label], edge).items():
        same = prev is not None and prev["last"] == e["first"]
        carry[number] = prev["most"] if same else np.full(len(labels), -np.inf)
        prev = {**e, "most": np.maximum(e["tail"], carry[number]) if e["single"] else e["tail"]}

    def run(number: int, table: pa.Table) -> Iterator[np.ndarray]:
        v, at = parts(table)
        fresh = np.zeros(len(table), np.int64)
        fresh[group_starts(table, keys)[1:]] = 1
        group = np.cumsum(fresh)
        for p, before in zip(at, carry[number]):
            levels, place = np.unique(v[p], return_inverse=True)
            up = group[p] * len(levels)
            # The last row with the label before each row, if it is of the same group; nothing stands for none.
            most = np.append(levels[np.maximum.accumulate(place + up) - up], -np.inf)
            last = np.searchsorted(p, np.arange(len(v)), "right") - 1
            last[(last < 0) | (np.append(group[p], -1)[last] != group)] = len(p)
            yield np.where(group == 0, np.maximum(most[last], before), most[last])

    return run


# ---- ranks, quantiles, adjusted p-values


def ranked_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, weight: str | None = None,
) -> DataFrame:
    """Distinct values of ``value`` per key with ``cnt``, ``cum`` (rows up to and with it) and ``n``.

    ``sums`` adds named aggregates per distinct value, for example a count per group. With ``weight``
    a row stands for that many equal rows.
    """
    keys = list(keys)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt"), *[c.alias(k) for k, c in (sums or {}).items()])
    placed = scan(sorted_ranges(distinct, [F.col(c) for c in [*keys, value]]), [Level(tuple(keys), {"cum": "cnt"})])
    return placed.withColumnsRenamed({"cum_run": "cum", "cum_all": "n"})


def running_sums(table: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """Running totals along ``order`` inside each key, for a table with one row per (keys, order).

    Adds ``<name>_run`` (up to and with the row) and ``<name>_all`` (whole key) for each name in ``sums``.
    """
    out = scan(sorted_ranges(table, [F.col(c) for c in [*keys, order]]), [Level(tuple(keys), {c: c for c in sums})])
    return out.select(*table.columns, *[f"{c}_run" for c in sums], *[f"{c}_all" for c in sums])


def previous_value(df: DataFrame, keys: Sequence[str], order: str, out: str = "previous") -> DataFrame:
    """Rows with the preceding value of ``order`` in their key."""
    return scan(sorted_ranges(df, [F.col(c) for c in [*keys, order]]), [Level(tuple(keys), {}, {out: order})])


def mid_rank(cum: str = "cum", cnt: str = "cnt") -> Column:
    return F.col(cum) - (F.col(cnt) - 1) / 2.0


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation per key, one column per name in ``probs``."""
    keys = list(keys)
    ranked = ranked_counts(df, keys, value)
    prev = F.col("cum") - F.col("cnt")
    aggs: list[Column] = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((prev <= at) & (at < F.col("cum")), F.col(value))).alias(f"{name}__{tag}"))
    out = ranked.groupBy(*keys).agg(F.first("n").alias("n__"), *aggs)
    cols = [*keys]
    exprs = [F.col(k) for k in cols]
    for name, p in probs.items():
        pos = (F.col("n__") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        exprs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*exprs)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def _row_tie(df: DataFrame) -> list[Column]:
    """Splits rows that are equal in all that is ordered: by a hash of the row, and equal rows by where they come from."""
    return [F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]), F.spark_partition_id()]


def _with_tie(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(("__tie_hash", "__tie_part"), _row_tie(df))))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with their tie-averaged rank of ``value`` inside each key; a null value has no rank."""
    rows = _with_tie(df).withColumn("__held", F.col(value).isNotNull().cast("int"))
    ranges = sorted_ranges(rows, [F.col(c) for c in [*keys, value, "__tie_hash", "__tie_part"]])
    placed = scan(ranges, [Level(tuple(keys), {"__i": "__held"}), Level((*keys, value), {"__j": None})])
    rank = F.when(F.col("__held") == 1, F.col("__i_run") - F.col("__j_run") + (F.col("__j_all") + 1) / 2.0)
    return placed.select(*df.columns, rank.alias(out))


def ordinal_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str = "rank", descending: bool = False) -> DataFrame:
    """1-based order of ``value`` inside each key, ties by the unique column ``tie``. Nulls are smallest."""
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    ranges = sorted_ranges(df, [*[F.col(k) for k in keys], by, F.col(tie)])
    return scan(ranges, [Level(tuple(keys), {"__i": None})]).select(*df.columns, F.col("__i_run").alias(out))


def bh_adjust(df: DataFrame, p: str, out: str = "padj", family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: p·n/rank with a running minimum from the largest p, capped at 1. A null p stays out.

    Among equal p the last rank has the smallest p·n/rank, so the minimum from behind needs no ranks of ties. It is
    carried like a sum: each range tells the least value of its first group.
    """
    rows = _with_tie(df).withColumn("__held", F.col(p).isNotNull().cast("int"))
    ranges = sorted_ranges(rows, [F.col(c) for c in [*family, p, "__tie_hash", "__tie_part"]])
    level = Level(tuple(family), {"n": "__held"})
    carry = carries(ranges, [level])

    def raw(number: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        starts = group_starts(table, level.keys)
        c = carry[number][0]
        place, n = running(_numbers(table, "__held"), starts, c["before"][0], c["behind"][0])
        values = pc.fill_null(table.column(p).cast(pa.float64()), np.inf).to_numpy()
        return np.where(np.isinf(values), np.inf, values * n / np.maximum(place, 1)), starts

    def least(number: int, table: pa.Table) -> dict[str, Any]:
        value, starts = raw(number, table)
        key = lambda i: tuple(_plain(table.column(k)[i].as_py()) for k in family)
        return {"first": key(0), "last": key(len(table) - 1), "single": len(starts) == 1, "least": value[:starts[1] if len(starts) > 1 else None].min()}

    edges = collect_ranges(ranges, [*family, p, "__held"], least)
    behind, after = {}, None
    for number, e in reversed(edges.items()):
        same = after is not None and after["first"] == e["last"]
        behind[number] = min(after["least"], after["behind"] if after["single"] else np.inf) if same else np.inf
        after = {**e, "behind": behind[number]}

    def work(number: int, table: pa.Table) -> list[pa.Array]:
        value, starts = raw(number, table)
        value[-1] = min(value[-1], behind[number])
        for lo, hi in zip(starts, np.append(starts[1:], len(value))):
            value[lo:hi] = np.minimum.accumulate(value[lo:hi][::-1])[::-1]
        held = table.column("__held").to_numpy() == 1
        return [pa.array(np.minimum(value, 1.0), mask=~held)]

    return map_ranges(ranges, [T.StructField(out, T.DoubleType())], work).select(*df.columns, out)
