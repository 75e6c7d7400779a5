"""Filters, normalisation, imputation and scaling of long matrices (feature, sample, value).

Per-group totals are aggregated (with map-side partial sums) and joined back, never taken over a
window, so one heavy feature or sample is not pulled into one task. Spark itself decides from the
measured size whether such a totals table is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import Level, exact_median, ordinal_rank, ranked_counts, running_sums, scan, sorted_ranges
from lociframe.session import cut_lineage


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add aggregates of each key group to every row of the group."""
    table = df.groupBy(*keys).agg(*[c.alias(k) for k, c in stats.items()])
    return df.join(table, list(keys))


# ---- filters -------------------------------------------------------------------------------------


def filter_low_expression(lm: DataFrame, min_count: float = 10, min_samples: int = 2) -> DataFrame:
    """Keep features with at least ``min_samples`` values of at least ``min_count``."""
    keep = (
        lm.where(F.col("value") >= min_count)
        .groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_samples)
    )
    return lm.join(keep.select("feature"), "feature", "left_semi")


def filter_valid_fraction(lm: DataFrame, min_fraction: float = 0.7) -> DataFrame:
    """Keep features with non-null values in at least a fraction of all samples."""
    samples = lm.agg(F.count_distinct("sample").alias("s")).scalar()
    keep = lm.groupBy("feature").agg(F.count("value").alias("n")).where(F.col("n") >= min_fraction * samples)
    return lm.join(keep.select("feature"), "feature", "left_semi")


def cell_metrics(lm: DataFrame, mito: Column) -> DataFrame:
    """Per cell: genes seen, total, and percentage of the total in mitochondrial genes."""
    total = F.sum("value")
    return lm.groupBy("sample").agg(
        F.count_if(F.col("value") > 0).alias("n_genes"),
        total.alias("total_counts"),
        F.coalesce(F.sum(F.when(mito, F.col("value"))) / total * 100, F.lit(0.0)).alias("pct_mito"),
    )


def cell_qc(
    lm: DataFrame, mito: Column, min_genes: int = 200, max_genes: int = 6000, max_mito: float = 20.0,
    min_cells: int = 3,
) -> DataFrame:
    """Keep good cells, then genes seen in at least ``min_cells`` of the kept cells."""
    good = cell_metrics(lm, mito).where(
        F.col("n_genes").between(min_genes, max_genes) & (F.col("pct_mito") <= max_mito)
    )
    kept = lm.join(good.select("sample"), "sample", "left_semi")
    genes = (
        kept.where(F.col("value") > 0).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_cells)
    )
    return kept.join(genes.select("feature"), "feature", "left_semi")


def top_variance(lm: DataFrame, max_rows: int | None = None, min_variance: float | None = None) -> DataFrame:
    """Sample-variance filter: variance at least ``min_variance``, then the ``max_rows`` largest."""
    var = lm.groupBy("feature").agg(F.var_samp("value").alias("variance"))
    if min_variance is not None:
        var = var.where(F.col("variance") >= min_variance)
    if max_rows is not None:
        var = var.orderBy(F.desc_nulls_last("variance"), "feature").limit(max_rows)
    return lm.join(var, "feature")


def top_variance_fraction(lm: DataFrame, fraction: float) -> DataFrame:
    """Keep the top fraction of features by population variance (at least one)."""
    var = lm.groupBy("feature").agg(F.var_pop("value").alias("variance")).where("variance is not null")
    ranked = ordinal_rank(var, [], "variance", "feature", "place", descending=True)
    n = var.agg(F.count(F.lit(1))).scalar()
    keep = ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(n * fraction)))
    return lm.join(keep.select("feature"), "feature", "left_semi")


def variable_features(lm: DataFrame, min_variance: float = 0.01) -> DataFrame:
    """Variance pre-filter used before correlation screens."""
    keep = lm.groupBy("feature").agg(F.var_samp("value").alias("v")).where(F.col("v") > min_variance)
    return lm.join(keep.select("feature"), "feature", "left_semi")


def match_terms(df: DataFrame, column: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose text contains any of the terms, ignoring case."""
    low = F.lower(F.col(column).cast("string"))
    return df.where(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)))


def lookup_feature(lm: DataFrame, symbol: str) -> DataFrame:
    """Rows of one feature: exact name, else case-insensitive, else first name that contains it."""
    name = F.col("feature").cast("string")
    level = (
        F.when(name == symbol, 1).when(F.upper(name) == symbol.upper(), 2).when(F.contains(name, F.lit(symbol)), 3)
    )
    best = (
        lm.select("feature").distinct().withColumn("level", level).where("level is not null")
        .orderBy("level", "feature").limit(1)
    )
    return lm.join(best.select("feature"), "feature", "left_semi")


# ---- normalisation -------------------------------------------------------------------------------


def cpm(lm: DataFrame, log2: bool = False, pseudocount: float = 1.0) -> DataFrame:
    """Counts per million of the sample total; optionally log2(x + pseudocount)."""
    out = with_group_stats(lm, ["sample"], total=F.sum("value"))
    v = F.when(F.col("total") == 0, F.col("value")).otherwise(F.col("value") * 1e6 / F.col("total"))
    v = F.log2(v + pseudocount) if log2 else v
    return out.select("feature", "sample", v.alias("value"))


def cell_normalize(lm: DataFrame, target: float = 10000.0) -> DataFrame:
    """Scale each cell to ``target`` and take ln(1 + x)."""
    out = with_group_stats(lm, ["sample"], total=F.sum("value"))
    return out.select("feature", "sample", F.log1p(F.col("value") / F.col("total") * target).alias("value"))


def size_factor_normalize(lm: DataFrame, method: str = "median") -> DataFrame:
    """Screen totals: divide by total / median of totals, or scale to a million."""
    if method == "total":
        return cpm(lm)
    totals = lm.groupBy("sample").agg(F.sum("value").alias("total"))
    middle = exact_median(totals, [], "total").select("median").scalar()
    factors = totals.select("sample", (F.col("total") / middle).alias("factor"))
    return lm.join(factors, "sample").select("feature", "sample", (F.col("value") / F.col("factor")).alias("value"))


def median_center(lm: DataFrame) -> DataFrame:
    med = exact_median(lm, ["sample"], "value")
    return lm.join(med, "sample").select("feature", "sample", (F.col("value") - F.col("median")).alias("value"))


def quantile_normalize(lm: DataFrame) -> DataFrame:
    """Give every sample the same distribution: the mean over samples of the r-th smallest value.

    Nulls are left out. Tied values share the mean of their ranks' targets.

    A sample is a step function of the rank, with one step for each distinct value, so there are no rows of single
    ranks: steps begin and end at places of a line, running sums give the mean of all samples between two places, and
    its integral gives the mean over the ranks of a value.
    """
    steps = cut_lineage(ranked_counts(lm, ["sample"], "value").select("sample", F.col("value").cast("double").alias("value"), (F.col("cum") - F.col("cnt")).alias("lo"), F.col("cum").alias("hi")))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("value").alias("dv"), F.lit(1).cast("long").alias("dn")),
                             F.struct(F.col("hi").alias("at"), (-F.col("value")).alias("dv"), F.lit(-1).cast("long").alias("dn"))))
    places = steps.select(ends.alias("e")).groupBy("e.at").agg(F.sum("e.dv").alias("dv"), F.sum("e.dn").alias("dn"))
    line = scan(sorted_ranges(places, [F.col("at")]), [Level((), {"v": "dv", "n": "dn"}, {"before": "at"})])
    # The mean of the samples on the way to a place, from the place before it.
    mean = F.coalesce(F.try_divide(F.col("v_run") - F.col("dv"), F.col("n_run") - F.col("dn")), F.lit(0.0))
    line = line.select("at", "before", mean.alias("mean"), (mean * F.coalesce(F.col("at") - F.col("before"), F.lit(0))).alias("area"))
    line = cut_lineage(running_sums(line, [], "at", ["area"]).select("at", "before", "mean", "area_run"))
    start = line.select(F.col("at").alias("lo"), F.col("area_run").alias("area_lo"))
    table = steps.join(line.withColumnRenamed("at", "hi"), "hi").join(start, "lo")
    whole = (F.col("area_run") - F.col("area_lo")) / (F.col("hi") - F.col("lo"))
    table = table.select("sample", F.col("value").alias("__v"), F.when(F.col("before") == F.col("lo"), F.col("mean")).otherwise(whole).alias("target"))
    return lm.withColumn("__v", F.col("value").cast("double")).join(table, ["sample", "__v"]).select("feature", "sample", F.col("target").alias("value"))


def detect_log_scale(lm: DataFrame) -> Column:
    """True when the largest value is at most 20 or values under 1 outnumber a tenth of the features."""
    return lm.agg(
        ((F.max("value") <= 20) | (F.count_if(F.col("value") < 1) > F.count_distinct("feature") * 0.1)).alias("is_log")
    ).scalar()


def log2_if_needed(lm: DataFrame) -> DataFrame:
    v = F.col("value")
    return lm.withColumn("value", F.when(detect_log_scale(lm), v).otherwise(F.log2(F.nullif(v, F.lit(0.0)) + 1)))


def log2_median(lm: DataFrame) -> DataFrame:
    return median_center(log2_if_needed(lm).where("value is not null"))


def asinh_transform(lm: DataFrame) -> DataFrame:
    return lm.withColumn("value", F.asinh(F.col("value") / 2) * 2)


NORMALIZERS = {
    "median": median_center,
    "quantile": quantile_normalize,
    "log2_median": log2_median,
    "vsn": asinh_transform,
    "none": lambda lm: lm,
}


def normalize(lm: DataFrame, method: str = "median") -> DataFrame:
    return NORMALIZERS[method](lm)


def batch_center(lm: DataFrame, meta: DataFrame, add_back_mean: bool = False) -> DataFrame:
    """Subtract each feature's mean inside each batch; optionally restore the feature's grand mean."""
    joined = lm.join(meta.select("sample", "batch"), "sample")
    out = with_group_stats(joined, ["feature", "batch"], centre=F.avg("value"))
    v = F.col("value") - F.col("centre")
    if add_back_mean:
        out = out.join(lm.groupBy("feature").agg(F.avg("value").alias("grand")), "feature")
        v = v + F.col("grand")
    return out.select("feature", "sample", v.alias("value"))


def zscore(lm: DataFrame, by: str = "feature", clip: float | None = None, population: bool = True) -> DataFrame:
    """Centre and scale by feature or by sample; a zero deviation counts as one."""
    sd = F.stddev_pop("value") if population else F.stddev_samp("value")
    out = with_group_stats(lm, [by], mean=F.avg("value"), sd=sd)
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return out.select("feature", "sample", z.alias("value"))


def zscore_both(lm: DataFrame, clip: float | None = None) -> DataFrame:
    """Scale rows, then columns."""
    return zscore(zscore(lm, "feature"), "sample", clip)


def min_max(lm: DataFrame, by: str = "feature") -> DataFrame:
    out = with_group_stats(lm, [by], lo=F.min("value"), hi=F.max("value"))
    span = F.col("hi") - F.col("lo")
    v = (F.col("value") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0)
    return out.select("feature", "sample", v.alias("value"))


# ---- completion and imputation -------------------------------------------------------------------


def complete_grid(lm: DataFrame) -> DataFrame:
    """Every feature with every sample; cells that are absent become null.

    The sample names are carried as one array per feature, so the grid is built row by row without
    a product of two tables. The number of samples is the width of the matrix.
    """
    names = lm.select("sample").distinct().agg(F.sort_array(F.collect_list("sample")).alias("names")).scalar()
    grid = lm.select("feature").distinct().withColumn("sample", F.explode(names))
    return grid.join(lm, ["feature", "sample"], "left")


def impute_min_prob(lm: DataFrame, jitter: float = 0.0, seed: int = 42) -> DataFrame:
    """Fill nulls with the sample's mean minus 1.8 sample deviations; optional seeded noise."""
    out = with_group_stats(lm, ["sample"], mean=F.avg("value"), sd=F.stddev_samp("value"))
    sd = F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    fill = F.col("mean") - 1.8 * sd
    if jitter:
        u = [(F.pmod(F.xxhash64(F.lit(seed + i), "feature", "sample"), F.lit(1 << 30)) + 1) / float(1 << 30)
             for i in (0, 1)]
        fill = fill + jitter * F.sqrt(-2 * F.ln(u[0])) * F.cos(6.283185307179586 * u[1])
    return out.select("feature", "sample", F.coalesce("value", fill).alias("value"))


def impute_constant(lm: DataFrame, how: str = "zero") -> DataFrame:
    """Fill nulls with zero, or with the feature's median or mean; all-null features are dropped."""
    if how == "zero":
        return lm.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if how == "mean":
        fill = lm.groupBy("feature").agg(F.avg("value").alias("fill")).where("fill is not null")
    else:
        fill = exact_median(lm, ["feature"], "value", "fill")
    return lm.join(fill, "feature").select("feature", "sample", F.coalesce("value", "fill").alias("value"))


# ---- variable genes ------------------------------------------------------------------------------


def highly_variable(lm: DataFrame, top: int = 2000, bins: int = 10) -> DataFrame:
    """Dispersion z-scored inside equal-count bins of the mean; the ``top`` features by that score."""
    per = lm.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    per = per.withColumn("dispersion", F.col("variance") / (F.col("mean") + 1e-10))
    n = per.agg(F.count(F.lit(1))).scalar()
    ranked = ordinal_rank(per, [], "mean", "feature", "place")
    width = F.greatest(F.lit(1), F.floor(n / bins))
    ranked = ranked.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("place") - 1) / width)))
    stats = ranked.groupBy("bin").agg(
        F.avg("dispersion").alias("bin_mean"), (F.stddev_pop("dispersion") + 1e-10).alias("bin_sd")
    )
    return (
        ranked.join(stats, "bin")
        .withColumn("normalized_dispersion", (F.col("dispersion") - F.col("bin_mean")) / F.col("bin_sd"))
        .select("feature", "mean", "variance", "dispersion", "bin", "normalized_dispersion")
        .orderBy(F.desc("normalized_dispersion"), "feature")
        .limit(top)
    )


# ---- quality tables ------------------------------------------------------------------------------


def sample_summary(lm: DataFrame) -> DataFrame:
    """Per sample: n, mean, median, population and sample deviation, CV percent."""
    base = lm.groupBy("sample").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd_pop"),
        (F.stddev_samp("value") / F.abs(F.avg("value")) * 100).alias("cv_pct"),
    )
    return base.join(exact_median(lm, ["sample"], "value"), "sample")


def missing_table(lm: DataFrame, by: str = "sample") -> DataFrame:
    return lm.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg(F.col("value").isNull().cast("int")).alias("missing_fraction"),
    )


def histogram(lm: DataFrame, keys: Sequence[str], lo: float, hi: float, bins: int = 100) -> DataFrame:
    """Equal-width counts per key; a value equal to ``hi`` falls in the last bin. Bin -1 has the values under ``lo``, bin
    ``bins`` those over ``hi``."""
    v = F.col("value")
    b = F.when(v < lo, F.lit(-1)).when(v > hi, F.lit(bins)).otherwise(F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)))
    return lm.where(v.isNotNull()).withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))


def screen_sample_qc(lm: DataFrame, min_reads: float = 30) -> DataFrame:
    """Per sample read depth, represented and missing guides, and the Gini index of positive counts."""
    v = F.col("value")
    pos = F.when(v > 0, v)
    base = lm.groupBy("sample").agg(
        F.sum(v).alias("total_reads"), F.count(F.lit(1)).alias("num_guides"),
        F.count_if(v >= min_reads).alias("represented_guides"),
        F.avg((v >= min_reads).cast("int")).alias("representation_fraction"),
        F.coalesce(F.avg(pos), F.lit(0.0)).alias("mean_reads"),
        F.coalesce(F.min(pos), F.lit(0.0)).alias("min_reads"), F.max(v).alias("max_reads"),
        F.count_if(v == 0).alias("missing_guides"), F.avg((v == 0).cast("int")).alias("missing_fraction"),
    )
    positive = lm.where(v > 0)
    med = exact_median(positive, ["sample"], "value", "median_reads")
    return base.join(med, "sample", "left").join(gini(positive), "sample", "left")


def gini(lm: DataFrame, keep_zeros: bool = False, key: str = "sample") -> DataFrame:
    """Gini index 2Σ i·x_i / (nΣx) − (n+1)/n, not under 0. With ``keep_zeros`` it is taken on x + 1."""
    src = lm.withColumn("value", F.col("value") + 1) if keep_zeros else lm.where("value > 0")
    ranked = ranked_counts(src, [key], "value")
    first, last, c = F.col("cum") - F.col("cnt") + 1, F.col("cum"), F.col("cnt")
    index_sum = (first + last) * c / 2.0
    n = F.max("n")
    g = 2 * F.sum(index_sum * F.col("value")) / (n * F.sum(c * F.col("value"))) - (n + 1) / n
    return ranked.groupBy(key).agg(F.greatest(F.lit(0.0), g).alias("gini_index"))


def control_stats(lm: DataFrame, is_control: Column) -> DataFrame:
    """Positive mean and CV (population deviation over positive mean) of control and other guides."""
    v = F.col("value")
    out = []
    for tag, cond in (("control", is_control), ("targeting", ~is_control)):
        mean = F.coalesce(F.avg(F.when(cond & (v > 0), v)), F.lit(0.0))
        out += [mean.alias(f"{tag}_mean"), F.when(mean > 0, F.stddev_pop(F.when(cond, v)) / mean).alias(f"{tag}_cv"),
                F.count_if(cond).alias(f"num_{tag}")]
    return lm.groupBy("sample").agg(*out)


def guide_cv(lm: DataFrame) -> DataFrame:
    mean = F.avg("value")
    return lm.groupBy("feature").agg(
        mean.alias("mean_reads"), (F.stddev_pop("value") / (mean + 1e-6)).alias("cv"),
        F.min("value").alias("min_reads"), F.max("value").alias("max_reads"),
    )


def empirical_cdf(lm: DataFrame, key: str = "sample") -> DataFrame:
    """Cumulative fraction of rows at or below each distinct value."""
    return ranked_counts(lm, [key], "value").select(key, "value", (F.col("cum") / F.col("n")).alias("cdf"))

