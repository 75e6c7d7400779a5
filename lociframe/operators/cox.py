"""Cox models by Newton steps that all models share.

Rows are dealt once to ranges of descending time and checkpointed. The risk sums of a time are then sums over the rows
before it in that order, and a step is two passes over the ranges for all models that still move, univariate or not:
the first returns each range's totals, whose prefix sums on the driver are the carries, the second returns each range's
part of likelihood, gradient and information. Sums of exp(xβ) are kept as logarithms and added with the larger one
taken out, so that neither an outlier overflows nor the last risk sets lose their digits. A time whose rows lie in
several ranges is finished by the last of them. A step that lowers the likelihood is halved.

Indicator columns of many levels are no columns at all here: `level_fits` solves the univariate model of each level from
the number of its rows at risk, in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import Level, carries, collect_ranges, group_starts, sorted_ranges
from lociframe.session import cut_lineage

#: Times up to which the table of times goes to every task of level_fits; it is counted first.
TIMES = 1_000_000
#: Levels that are columns at a time where there are more times.
WIDE = 32
MAX_ITER = 20
HALVINGS = 20


@dataclass
class CoxFit:
    """Columns of one model, its coefficients and their covariance (NaN where the information is singular)."""

    columns: list[int]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float = -np.inf
    converged: bool = False
    steps: int = 0


def risk_ranges(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict]:
    """Ranges of descending time with time, event, x0, x1, ...; and what ranges before and behind hold of border times."""
    x = [f"x{i}" for i in range(len(names))]
    rows = df.where("time is not null and event is not null").select(
        F.col("time").cast("double").alias("time"), F.col("event").cast("long").alias("event"),
        *[F.col(f"`{n}`").cast("double").alias(c) for n, c in zip(names, x)]).na.drop()
    rows = rows.withColumns({f"e{c}": F.when(F.col("event") == 1, F.col(c)).otherwise(0.0) for c in x})
    rows = rows.withColumns({"__tie_hash": F.xxhash64(*rows.columns), "__tie_part": F.spark_partition_id()})
    ranges = sorted_ranges(rows, [F.col("time").desc(), F.col("__tie_hash"), F.col("__tie_part")])
    found = carries(ranges, [Level(("time",), {"n": None, "d": "event", **{f"e{c}": f"e{c}" for c in x}})])
    return ranges, {r: c[0] for r, c in found.items()}


def _matrix(table: pa.Table, prefix: str, p: int) -> np.ndarray:
    return np.column_stack([table.column(f"{prefix}{i}").to_numpy() for i in range(p)]) if p else np.zeros((len(table), 0))


def _terms(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Logarithms of what is summed over risk sets: e, then positive and negative parts of x·e and of x·xᵀ·e."""
    p = x.shape[1]
    lp = x @ beta
    with np.errstate(divide="ignore"):
        products = [x[:, i] for i in range(p)] + [x[:, i] * x[:, j] for i in range(p) for j in range(i, p)]
        parts = [lp + np.log(np.maximum(s * v, 0.0)) for v in products for s in (1, -1)]
    return np.column_stack([lp, *parts])


def _means(logs: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of x and of x·xᵀ over risk sets, from rows of summed _terms."""
    flat = np.exp(logs[:, 1::2] - logs[:, :1]) - np.exp(logs[:, 2::2] - logs[:, :1])
    second = np.zeros((len(logs), p, p))
    i, j = np.triu_indices(p)
    second[:, i, j] = flat[:, p:]
    second[:, j, i] = flat[:, p:]
    return flat[:, :p], second


def _finished(table: pa.Table, carry: dict, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last rows of the times that end in this range, with their events and event sums of x over all ranges."""
    starts = group_starts(table, ["time"])
    ends = np.append(starts[1:], len(table)) - 1
    d = np.add.reduceat(table.column("event").to_numpy().astype(float), starts)
    ex = np.add.reduceat(_matrix(table, "ex", p), starts, axis=0)
    d[0] += carry["before"][1]
    ex[0] += np.array(carry["before"][2:], float)
    if carry["behind"][0]:
        ends, d, ex = ends[:-1], d[:-1], ex[:-1]
    live = d > 0
    return ends[live], d[live], ex[live]


def _carried(totals: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """For each range the log sums of the ranges before it."""
    out, run = {}, None
    for r, logs in totals.items():
        run = [np.full_like(v, -np.inf) for v in logs] if run is None else run
        out[r] = run
        run = [np.logaddexp(a, b) for a, b in zip(run, logs)]
    return out


def _log_sums(terms: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.logaddexp.accumulate(np.vstack([before, terms]), axis=0)[1:]


def evaluate(ranges: DataFrame, border: dict, p: int, models: Sequence[tuple[list[int], np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and information of each model (columns, β), in two passes for all of them."""
    cols = ["time", "event", *[f"x{i}" for i in range(p)], *[f"ex{i}" for i in range(p)]]

    def totals(_: int, table: pa.Table) -> list[np.ndarray]:
        x = _matrix(table, "x", p)
        return [np.logaddexp.reduce(_terms(x[:, c], b), axis=0) for c, b in models]

    before = _carried(collect_ranges(ranges, cols, totals))

    def parts(number: int, table: pa.Table) -> list[tuple[float, np.ndarray, np.ndarray]]:
        x = _matrix(table, "x", p)
        ends, d, ex = _finished(table, border[number], p)
        out = []
        for (c, b), carry in zip(models, before[number]):
            logs = _log_sums(_terms(x[:, c], b), carry)[ends]
            mean, second = _means(logs, len(c))
            own = ex[:, c]
            out.append((float((own @ b).sum() - (d * logs[:, 0]).sum()), (own - d[:, None] * mean).sum(axis=0),
                        (d[:, None, None] * (second - mean[:, :, None] * mean[:, None, :])).sum(axis=0)))
        return out

    found = collect_ranges(ranges, cols, parts)
    zero = [(0.0, np.zeros(len(c)), np.zeros((len(c), len(c)))) for c, _ in models]
    return [tuple(sum((part[i][k] for part in found.values()), zero[i][k]) for k in range(3)) for i in range(len(models))]


def fit_models(df: DataFrame, names: Sequence[str], models: Sequence[Sequence[int]], max_iter: int = MAX_ITER) -> list[CoxFit]:
    """Breslow fits of all models, each a list of places in ``names``. A singular information stops a model."""
    p = len(names)
    ranges, border = risk_ranges(df, names)
    fits = [CoxFit(list(c), np.zeros(len(c)), np.full((len(c), len(c)), np.nan)) for c in models]
    tried = [f.beta for f in fits]
    moves, halved = [np.zeros(len(f.columns)) for f in fits], [0] * len(fits)
    moving = list(range(len(fits)))
    while moving:
        again = []
        for i, (ll, grad, info) in zip(moving, evaluate(ranges, border, p, [(fits[i].columns, tried[i]) for i in moving])):
            f = fits[i]
            if f.steps and not ll >= f.log_likelihood - 1e-9 * abs(f.log_likelihood) and halved[i] < HALVINGS:
                halved[i] += 1
                moves[i] = moves[i] / 2
                tried[i] = f.beta + moves[i]
                again.append(i)
                continue
            f.beta, f.log_likelihood, halved[i] = tried[i], ll, 0
            try:
                moves[i] = np.linalg.solve(info, grad)
                f.covariance = np.linalg.inv(info)
            except np.linalg.LinAlgError:
                f.covariance = np.full_like(info, np.nan)
                continue
            f.converged = bool(np.linalg.norm(grad) < 1e-6 or np.max(np.abs(moves[i]), initial=0.0) < 1e-6)
            if not f.converged and f.steps < max_iter:
                f.steps += 1
                tried[i] = f.beta + moves[i]
                again.append(i)
        moving = again
    return fits


def risk_means(df: DataFrame, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """time and m0, m1, ...: mean of each column over the risk set of each event time."""
    p, b = len(names), np.array(beta, float)
    ranges, border = risk_ranges(df, names)
    cols = ["time", "event", *[f"x{i}" for i in range(p)], *[f"ex{i}" for i in range(p)]]
    before = _carried(collect_ranges(ranges, cols, lambda _, table: [np.logaddexp.reduce(_terms(_matrix(table, "x", p), b), axis=0)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [v for v in batches if v.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            number = table.column("__range")[0].as_py()
            ends, _, _ = _finished(table, border[number], p)
            mean, _ = _means(_log_sums(_terms(_matrix(table, "x", p), b), before[number][0])[ends], p)
            yield pa.RecordBatch.from_arrays([table.column("time").combine_chunks().take(pa.array(ends)), *[pa.array(m) for m in mean.T]], names=["time", *[f"m{i}" for i in range(p)]])

    return ranges.mapInArrow(run, ", ".join(["time double", *[f"m{i} double" for i in range(p)]]))


# ---- levels


def level_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, covariate) for each row and column with a level other than the column's first; nulls have none."""
    cells = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("c"))
    cells = cells.select(key, "c.column", "c.level").where("level is not null")
    first = cells.groupBy("column").agg(F.min("level").alias("first"))  # a row for each column
    return cells.join(F.broadcast(first), "column").where("level <> first").select(key, F.concat_ws("_", "column", "level").alias("covariate"))


def _solve_level(at: np.ndarray, m: np.ndarray, e: np.ndarray, times: np.ndarray, n: np.ndarray, d: np.ndarray, max_iter: int) -> tuple[float, float, bool]:
    """β, its standard error and convergence of an indicator with m rows and e events at some times."""
    order = np.argsort(-at)
    risk = np.concatenate([[0], np.cumsum(m[order])])
    held = risk[np.searchsorted(-at[order], -times, side="right")].astype(float)  # rows of the level at risk
    live = held > 0
    held, n, d, events = held[live], n[live], d[live], float(e.sum())

    def at_beta(beta: float) -> tuple[float, float, float]:
        # share of the level in the risk, from the logarithm of its odds
        with np.errstate(divide="ignore", over="ignore"):
            odds = beta + np.log(held) - np.log(n - held)
        share = np.where(odds > 0, 1 / (1 + np.exp(-np.abs(odds))), np.exp(-np.abs(odds)) / (1 + np.exp(-np.abs(odds))))
        with np.errstate(divide="ignore"):
            total = np.logaddexp(beta + np.log(held), np.log(n - held))
        return events * beta - (d * total).sum(), events - (d * share).sum(), (d * share * (1 - share)).sum()

    beta, move = 0.0, 0.0
    ll, grad, info = at_beta(beta)
    for _ in range(max_iter):
        if info <= 0 or not np.isfinite(info):
            return beta, float("nan"), False
        move = grad / info
        if abs(grad) < 1e-6 or abs(move) < 1e-6:
            return beta, info**-0.5, True
        for _ in range(HALVINGS):
            new = at_beta(beta + move)
            if new[0] >= ll - 1e-9 * abs(ll):
                break
            move /= 2
        beta, (ll, grad, info) = beta + move, new
    return beta, info**-0.5 if info > 0 else float("nan"), False


def level_fits(df: DataFrame, key: str, columns: Sequence[str], max_iter: int = MAX_ITER) -> DataFrame:
    """covariate, beta, se, converged of the univariate model of every level but the first of each column.

    A level's likelihood needs its rows at risk and the table of event times, which goes to the tasks while it has at
    most TIMES rows; beyond, levels become columns of `fit_models`, WIDE at a time.
    """
    rows = cut_lineage(df.where("time is not null and event is not null").select(
        key, F.col("time").cast("double").alias("time"), F.col("event").cast("long").alias("event"), *columns))
    levels = level_rows(rows, key, columns)
    schema = "covariate string, beta double, se double, converged boolean"
    per_time = cut_lineage(rows.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d")))
    if per_time.count() > TIMES:
        return _wide_level_fits(rows, key, cut_lineage(levels), schema, max_iter)
    table = per_time.toPandas().sort_values("time", ascending=False)
    n, d, times = np.cumsum(table["n"].to_numpy()).astype(float), table["d"].to_numpy().astype(float), table["time"].to_numpy()
    live = d > 0
    given = rows.sparkSession.sparkContext.broadcast((times[live], n[live], d[live]))
    counts = levels.join(rows.select(key, "time", "event"), key).groupBy("covariate", "time").agg(F.count(F.lit(1)).alias("m"), F.sum("event").alias("e"))
    lists = counts.groupBy("covariate").agg(F.collect_list(F.struct("time", "m", "e")).alias("c"))  # at most TIMES each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_solve_level(np.asarray(t), np.asarray(m), np.asarray(e), *given.value, max_iter) for t, m, e in zip(batch["t"], batch["m"], batch["e"])]
            yield pd.DataFrame([(c, *f) for c, f in zip(batch["covariate"], found)], columns=["covariate", "beta", "se", "converged"])

    return lists.select("covariate", F.col("c.time").alias("t"), F.col("c.m").alias("m"), F.col("c.e").alias("e")).mapInPandas(run, schema)


def _wide_level_fits(rows: DataFrame, key: str, levels: DataFrame, schema: str, max_iter: int) -> DataFrame:
    names = [r[0] for r in levels.select("covariate").distinct().orderBy("covariate").collect()]
    found = []
    for at in range(0, len(names), WIDE):
        some = names[at:at + WIDE]
        wide = rows.select(key, "time", "event").join(levels.where(F.col("covariate").isin(some)).groupBy(key).pivot("covariate", some).agg(F.lit(1.0)), key, "left").na.fill(0.0, some)
        for f in fit_models(wide, some, [[i] for i in range(len(some))], max_iter):
            found.append((some[f.columns[0]], float(f.beta[0]), float(np.sqrt(f.covariance[0, 0])), f.converged))
    return rows.sparkSession.createDataFrame(found, schema)
