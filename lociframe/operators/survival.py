"""Survival curves, tests, proportional-hazards models and clinical endpoints.

Rows are reduced to one row per (key, time) first. Risk sets then are totals minus running sums, so no
event rescans the rows after it, and the running sums stay distributed over time buckets.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import average_rank, exact_quantiles, running_sums
from lociframe.functions.special import chi2_sf, normal_two_sided
from lociframe.operators import cox
from lociframe.operators.correlate import correlation_p
from lociframe.session import cut_lineage


def time_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, events and the number at risk per (keys, time)."""
    keys = list(keys)
    per = df.where(F.col("time").isNotNull() & F.col("event").isNotNull()).groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("m"), F.sum("event").cast("long").alias("d"))
    out = running_sums(per, keys, "time", ["m"])
    return out.select(*keys, "time", "m", "d", (F.col("m_all") - F.col("m_run") + F.col("m")).alias("at_risk"))


def kaplan_meier(df: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Survival at each event time with a log-log 95 % interval (lower below upper)."""
    keys = list(keys)
    ev = time_table(df, keys).where("d > 0")
    ratio = 1 - F.col("d") / F.col("at_risk")
    ev = ev.withColumn("ls", F.when(ratio > 0, F.ln(ratio)).otherwise(0.0)).withColumn(
        "dead", F.when(ratio > 0, 0).otherwise(1)
    ).withColumn("gw", F.coalesce(F.try_divide(F.col("d"), F.col("at_risk").cast("double") * (F.col("at_risk") - F.col("d"))), F.lit(0.0)))
    out = running_sums(ev, keys, "time", ["ls", "dead", "gw"])
    s = F.when(F.col("dead_run") > 0, 0.0).otherwise(F.exp("ls_run"))
    out = out.withColumn("survival", s)
    half = 1.96 * F.sqrt("gw_run") / F.abs(F.ln("survival"))
    ll = F.ln(-F.ln("survival"))
    alive = F.col("survival") > 0
    return out.select(
        *keys, "time", "at_risk", "d", "survival",
        F.when(alive, F.exp(-F.exp(ll + half))).otherwise(0.0).alias("ci_lower"),
        F.when(alive, F.exp(-F.exp(ll - half))).otherwise(0.0).alias("ci_upper"),
    )


def survival_summary(df: DataFrame, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """n, events and median survival per key (infinite when the curve stays over one half)."""
    keys = list(keys)
    n = df.where("time is not null and event is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("n_events"))
    med = kaplan_meier(df, keys).where(F.col("survival") <= 0.5 + 1e-12).groupBy(*keys).agg(F.min("time").alias("median_survival"))
    return n.join(med, keys, "left").na.fill(float("inf"), ["median_survival"])


def at_risk_counts(df: DataFrame, times: Sequence[float], keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Number at risk of each key at the chosen times, in one conditional aggregation."""
    aggs = [F.count_if(F.col("time") >= float(t)).alias(f"t{i}") for i, t in enumerate(times)]
    wide = df.groupBy(*keys).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("time"), F.col(f"t{i}").alias("n_at_risk")) for i, t in enumerate(times)])
    return wide.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.time", "r.n_at_risk")


def time_counts_by_group(df: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Per (keys, group, event time): events and number at risk of the group and of all groups.

    Every group of a key has a row at every event time of the key, also where it has none of its own.
    """
    keys = list(keys)
    df = cut_lineage(df.where("time is not null and event is not null").select(*keys, "time", "event", F.col(group).alias("g")))
    times = df.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("m"), F.sum("event").cast("long").alias("d"))
    total = running_sums(times, keys, "time", ["m"])
    total = total.select(*keys, "time", F.col("d").alias("d_t"), (F.col("m_all") - F.col("m_run") + F.col("m")).alias("n_t")).where("d_t > 0")
    groups = df.groupBy(*keys).agg(F.sort_array(F.collect_set("g")).alias("gs"))
    spine = (total.join(groups, keys) if keys else total.withColumn("gs", groups.scalar())).withColumn(
        "g", F.explode("gs")).drop("gs")
    per = df.groupBy(*keys, "g", "time").agg(F.count(F.lit(1)).alias("m"), F.sum("event").cast("long").alias("d"))
    full = spine.join(per, [*keys, "g", "time"], "full_outer").na.fill(0, ["m", "d"])
    run = running_sums(full, [*keys, "g"], "time", ["m"])
    return run.where("d_t is not null").select(
        *keys, "g", "time", F.col("d").alias("d_g"), (F.col("m_all") - F.col("m_run") + F.col("m")).alias("n_g"), "d_t", "n_t")


def _risk_numbers() -> tuple[Column, Column, Column]:
    """n_g, n_t and d_t as doubles: products of four of them pass the largest long from some 10^5 rows at risk."""
    return tuple(F.col(c).cast("double") for c in ("n_g", "n_t", "d_t"))


def logrank_two(df: DataFrame, group: str, first: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two-group log-rank: observed minus expected of ``first`` over its hypergeometric variance."""
    keys = list(keys)
    t = time_counts_by_group(df, keys, group).where((F.col("g") == first) & (F.col("n_t") > 1))
    r, n, d = _risk_numbers()
    var = r * (n - r) * d * (n - d) / (n * n * (n - 1))
    agg = t.groupBy(*keys).agg(F.sum("d_g").alias("observed"), F.sum(d * r / n).alias("expected"), F.sum(var).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    chi2 = F.when(F.col("variance") > 0, gap * gap / F.col("variance")).otherwise(0.0)
    return agg.withColumn("chi2", chi2).withColumn("pvalue", normal_two_sided(F.sqrt("chi2")))


def logrank_groups(df: DataFrame, group: str = "grp", keys: Sequence[str] = ()) -> DataFrame:
    """k-group log-rank: sum of (O - E)²/E over groups with k - 1 degrees of freedom."""
    keys = list(keys)
    t = time_counts_by_group(df, keys, group)
    per = t.groupBy(*keys, "g").agg(F.sum("d_g").alias("o"), F.sum(F.col("d_t").cast("double") * F.col("n_g") / F.col("n_t")).alias("e"))
    gap = F.col("o") - F.col("e")
    agg = per.groupBy(*keys).agg(
        F.sum(F.when(F.col("e") > 0, gap * gap / F.col("e")).otherwise(0.0)).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return agg.withColumn("pvalue", chi2_sf(F.col("chi2"), F.col("df")))


def weighted_logrank(df: DataFrame, group: str = "grp", keys: Sequence[str] = (), weight: str = "group") -> DataFrame:
    """Gehan-Wilcoxon form: terms weighted by the number at risk, of the group or of all (``total``)."""
    keys = list(keys)
    t = time_counts_by_group(df, keys, group)
    r, n, d = _risk_numbers()
    w = r if weight == "group" else n
    var = F.when(n > 1, d * (n - d) * r * (n - r) / (n * n * (n - 1))).otherwise(0.0)
    per = t.groupBy(*keys, "g").agg(
        F.sum(w * F.col("d_g")).alias("o"), F.sum(w * d * r / n).alias("e"), F.sum(w * w * var).alias("v"))
    agg = per.groupBy(*keys).agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e"))).alias("ss"), F.sum("v").alias("v"),
        (F.count(F.lit(1)) - 1).alias("df"))
    stat = F.when(F.col("v") > 0, F.col("ss") / F.col("v")).otherwise(F.col("ss"))
    return agg.select(*keys, stat.alias("statistic"), "df").withColumn("pvalue", chi2_sf(F.col("statistic"), F.col("df")))


# ---- proportional hazards ------------------------------------------------------------------------

def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def prepare_covariates(
    df: DataFrame, covariates: Sequence[str], categorical: Sequence[str] = (), interactions: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Design columns: dummies without the first level, standardised numbers with nulls at the mean, products.

    Columns that are not numeric count as categorical. Their levels become columns of the plan, so their names are read
    to the driver; a column of very many levels is for `cox_levels`, where levels are rows.
    """
    types = dict(df.dtypes)
    names: list[str] = []
    out = df
    numeric = [c for c in covariates if c not in categorical and types[c] != "string"]
    # A null at the mean adds nothing to the sum of squares, so one pass gives mean and deviation of the filled column.
    stats = df.agg(*[a for i, c in enumerate(numeric) for a in (
        F.avg(c).alias(f"m{i}"), F.sqrt(F.var_pop(c) * F.count(c) / F.count(F.lit(1))).alias(f"s{i}"))]).first() if numeric else None
    for c in covariates:
        if c in numeric:
            i = numeric.index(c)
            mean, sd = F.lit(stats[f"m{i}"]).cast("double"), F.lit(stats[f"s{i}"]).cast("double")
            out = out.withColumn(f"{c}_z", (F.coalesce(F.col(c).cast("double"), mean) - mean) / (sd + 1e-10))
            names.append(f"{c}_z")
        else:
            levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
            for level in levels[1:]:
                out = out.withColumn(f"{c}_{level}", F.coalesce((F.col(c) == level).cast("double"), F.lit(0.0)))
                names.append(f"{c}_{level}")
    for pair in interactions:
        a, b = (f"{p}_z" if f"{p}_z" in names else p for p in pair.split(":"))
        if a in names and b in names:
            out = out.withColumn(pair, F.col(f"`{a}`") * F.col(f"`{b}`"))
            names.append(pair)
    return out, names


def cox_fit(df: DataFrame, names: Sequence[str], max_iter: int = cox.MAX_ITER) -> tuple[np.ndarray, np.ndarray]:
    """Breslow partial likelihood by Newton steps; returns β and its covariance.

    A singular information matrix gives a covariance of NaN; a fit that hasn't settled after ``max_iter`` steps gives a
    warning.
    """
    fit = cox.fit_models(df, names, [range(len(names))], max_iter)[0]
    if not fit.converged and fit.steps >= max_iter:
        warnings.warn(f"the fit has not settled after {max_iter} steps", stacklevel=2)
    return fit.beta, fit.covariance


def _cox_table(rows: DataFrame, alpha: float) -> DataFrame:
    """Hazard ratio, interval, z and p from covariate, beta, se, converged."""
    z = F.col("beta") / (F.col("se") + 1e-10)
    return rows.select(
        "covariate", F.exp("beta").alias("hr"), F.exp(F.col("beta") - 1.96 * F.col("se")).alias("ci_lower"),
        F.exp(F.col("beta") + 1.96 * F.col("se")).alias("ci_upper"), z.alias("z"), "converged",
    ).withColumn("pvalue", normal_two_sided(F.col("z"))).withColumn("significant", F.col("pvalue") < alpha)


def _fit_rows(df: DataFrame, names: Sequence[str], fits: Sequence[cox.CoxFit]) -> DataFrame:
    rows = [(names[c], float(f.beta[i]), float(np.sqrt(f.covariance[i, i])), f.converged) for f in fits for i, c in enumerate(f.columns)]
    return df.sparkSession.createDataFrame(rows, "covariate string, beta double, se double, converged boolean")


def cox_univariate(df: DataFrame, names: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One model per design column, all of them in the same passes."""
    return _cox_table(_fit_rows(df, names, cox.fit_models(df, names, [[i] for i in range(len(names))])), alpha)


def cox_multivariate(df: DataFrame, names: Sequence[str], alpha: float = 0.05) -> DataFrame:
    return _cox_table(_fit_rows(df, names, cox.fit_models(df, names, [range(len(names))])), alpha)


def cox_levels(df: DataFrame, key: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """One univariate model per level, but the first, of categorical columns with any number of levels."""
    return _cox_table(cox.level_fits(df, key, columns), alpha)


def risk_scores(df: DataFrame, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """Linear predictor and its split at the median (below: low, else high)."""
    lp = F.lit(0.0)
    for n, b in zip(names, beta):
        lp = lp + float(b) * F.col(f"`{n}`")
    scored = df.withColumn("linear_predictor", lp)
    med = exact_quantiles(scored, [], "linear_predictor", {"m": 0.5}).select("m").scalar()
    return scored.withColumn("risk_group", F.when(F.col("linear_predictor") < med, "low").otherwise("high"))


def schoenfeld_test(df: DataFrame, names: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """Rank correlation of Schoenfeld residuals with ln(time), one row per design column."""
    base = df.where("time is not null and event = 1").select(
        F.col("time").cast("double").alias("time"),
        *[F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)]).na.drop()
    ev = base.join(cox.risk_means(df, names, beta), "time")
    cols = F.array(*[F.struct(F.lit(n).alias("covariate"), (F.col(f"x{i}") - F.col(f"m{i}")).alias("residual"))
                     for i, n in enumerate(names)])
    long = ev.select("time", F.explode(cols).alias("r")).select("time", "r.covariate", F.round("r.residual", 12).alias("residual"))
    ranked = average_rank(average_rank(long, ["covariate"], "residual", "rr"), ["covariate"], "time", "rt")
    out = ranked.groupBy("covariate").agg(F.corr("rr", "rt").alias("correlation"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("pvalue", correlation_p(F.col("correlation"), F.col("n")))
    return out.withColumn("ph_violated", F.col("pvalue") < 0.05)


# ---- cohorts -------------------------------------------------------------------------------------


def stratify(df: DataFrame, value: str, method: str = "median", cutoff: float | None = None,
             keys: Sequence[str] = ()) -> DataFrame:
    """Adds High / Low: at the median, by outer quartiles (the middle is null), or at a fixed cutoff."""
    keys = list(keys)
    v = F.col(value)
    if method == "custom":
        return df.withColumn("stratum", F.when(v >= cutoff, "High").when(v.isNotNull(), "Low"))
    df = cut_lineage(df)
    probs = {"q_lo": 0.5, "q_hi": 0.5} if method == "median" else {"q_lo": 0.25, "q_hi": 0.75}
    q = exact_quantiles(df, keys, value, probs)
    if keys:
        out = df.join(q, keys)
    else:
        out = df.withColumn("q_lo", q.select("q_lo").scalar()).withColumn("q_hi", q.select("q_hi").scalar())
    high, low = v >= F.col("q_hi"), (v < F.col("q_lo") if method == "median" else v <= F.col("q_lo"))
    return out.withColumn("stratum", F.when(high, "High").when(low, "Low")).drop("q_lo", "q_hi")


def cohort_survival(df: DataFrame, cohort: str, value: str, method: str = "median") -> DataFrame:
    """High/Low survival of every cohort: sizes, events, chi-square, p and the direction of the event rates."""
    split = stratify(df, value, method, keys=[cohort]).where("stratum is not null")
    split = cut_lineage(split.select(cohort, "time", "event", "stratum"))
    high = F.col("stratum") == "High"
    rates = split.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(high, F.col("event")).otherwise(0)).cast("long").alias("high_events"),
        F.sum(F.when(~high, F.col("event")).otherwise(0)).cast("long").alias("low_events"),
        F.coalesce(F.avg(F.when(high, F.col("event"))), F.lit(0.0)).alias("hr"),
        F.coalesce(F.avg(F.when(~high, F.col("event"))), F.lit(0.0)).alias("lr"),
    )
    test = logrank_two(split, "stratum", "High", [cohort]).select(cohort, "chi2", "pvalue")
    return rates.join(test, cohort, "left").select(
        cohort, "n", "high_events", "low_events", F.coalesce("chi2", F.lit(0.0)).alias("chi2"),
        F.coalesce("pvalue", F.lit(1.0)).alias("pvalue"),
        F.when(F.col("hr") > F.col("lr"), "high worse").otherwise("high better/equal").alias("direction"))


def alteration_flags(patients: DataFrame, mutated: DataFrame, copy_number: DataFrame) -> DataFrame:
    """Four altered-or-not rows per patient: mutation, amplification (2), gain (>= 1), deletion (<= -1)."""
    m = mutated.select("patient").distinct().withColumn("mut", F.lit(True))
    cn = copy_number.groupBy("patient").agg(F.max_by("value", F.abs("value")).cast("int").alias("cn"))
    joined = patients.join(m, "patient", "left").join(cn, "patient", "left")
    kinds = F.array(
        F.struct(F.lit("mutation").alias("kind"), F.coalesce("mut", F.lit(False)).alias("altered")),
        F.struct(F.lit("amplification").alias("kind"), F.coalesce(F.col("cn") == 2, F.lit(False)).alias("altered")),
        F.struct(F.lit("gain_or_amplification").alias("kind"), F.coalesce(F.col("cn") >= 1, F.lit(False)).alias("altered")),
        F.struct(F.lit("deletion").alias("kind"), F.coalesce(F.col("cn") <= -1, F.lit(False)).alias("altered")),
    )
    return joined.withColumn("k", F.explode(kinds)).select(*patients.columns, "k.kind", "k.altered")


def alteration_survival(flags: DataFrame, cohort: str, min_n: int = 3) -> DataFrame:
    """Log-rank of altered against other patients per cohort and kind; too few patients give ``insufficient``."""
    flags = cut_lineage(flags.select(cohort, "kind", "altered", "time", "event"))
    a = F.col("altered")
    counts = flags.groupBy(cohort, "kind").agg(
        F.count_if(a).alias("n_altered"), F.count_if(~a).alias("n_unaltered"),
        F.sum(F.when(a, F.col("event")).otherwise(0)).cast("long").alias("altered_events"),
        F.sum(F.when(~a, F.col("event")).otherwise(0)).cast("long").alias("unaltered_events"),
    )
    test = logrank_two(flags.withColumn("side", F.when(a, "Altered").otherwise("Other")), "side", "Altered", [cohort, "kind"])
    enough = (F.col("n_altered") >= min_n) & (F.col("altered_events") >= 1) & (F.col("n_unaltered") >= min_n)
    worse = F.col("altered_events") / F.col("n_altered") > F.col("unaltered_events") / F.col("n_unaltered")
    return counts.join(test.select(cohort, "kind", F.col("pvalue").alias("p")), [cohort, "kind"], "left").select(
        cohort, "kind", "n_altered", "n_unaltered", "altered_events", "unaltered_events",
        F.when(enough, F.col("p")).alias("pvalue"),
        F.when(~enough, "insufficient").when(worse, "altered worse").otherwise("altered better/equal").alias("direction"))


# ---- endpoints -----------------------------------------------------------------------------------

# Answers that mean a progression.
PROGRESSION_WORDS = ("yes", "yes, progression", "yes, recurrence")


def overall_survival(df: DataFrame) -> DataFrame:
    """os_event and os_time from vital status, days to death and last follow-up."""
    dead = (F.lower(F.coalesce("vital_status", F.lit(""))) == "dead") & F.col("days_to_death").isNotNull()
    follow = F.col("days_to_last_follow_up")
    return df.withColumn("os_event", F.when(dead, 1).when(follow.isNotNull(), 0)).withColumn(
        "os_time", F.when(dead, F.col("days_to_death")).otherwise(follow))


def disease_free_survival(df: DataFrame) -> DataFrame:
    """dfs_event and dfs_time: earliest of new event, recurrence and death, else last follow-up."""
    first = F.least("days_to_new_tumor_event", "days_to_recurrence", "days_to_death")
    prog = F.lower(F.coalesce("progression_or_recurrence", F.lit("")))
    happened = (
        prog.isin(*PROGRESSION_WORDS) | F.col("days_to_new_tumor_event").isNotNull() | F.col("days_to_recurrence").isNotNull()
        | (F.lower(F.coalesce("vital_status", F.lit(""))) == "dead")
    )
    t = F.when(happened, F.coalesce(first, F.col("days_to_last_follow_up"))).otherwise(F.col("days_to_last_follow_up"))
    return df.withColumn("dfs_time", t).withColumn("dfs_event", F.when(F.col("dfs_time").isNotNull(), happened.cast("int")))
