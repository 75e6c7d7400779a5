"""Group summaries, two-group and k-group tests, and rank aggregation on long matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.functions.ordering import (
    bh_adjust,
    exact_median,
    mid_rank,
    ordinal_rank,
    ranked_counts,
)
from lociframe.session import cut_lineage
from lociframe.functions.special import (
    beta_cdf_int,
    betainc,
    chi2_sf,
    normal_two_sided,
    student_t_two_sided,
)


def missing_samples(lm: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata samples that the matrix does not have."""
    return meta.join(lm.select("sample").distinct(), "sample", "left_anti")


def labelled(lm: DataFrame, meta: DataFrame, ref: str, alt: str | None = None) -> DataFrame:
    """Matrix rows with ``is_alt``; without ``alt`` every group other than ``ref`` is the other side."""
    groups = meta.select("sample", (F.col("grp") != ref).alias("is_alt"), "grp")
    if alt is not None:
        groups = groups.where(F.col("grp").isin(ref, alt))
    return lm.join(groups, "sample")


def group_moments(rows: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """n, mean and sample variance of both sides per key, in one aggregation."""
    a, b = F.when(~F.col("is_alt"), F.col("value")), F.when(F.col("is_alt"), F.col("value"))
    return rows.groupBy(*keys).agg(
        F.count(a).alias("n_ref"), F.avg(a).alias("mean_ref"), F.var_samp(a).alias("var_ref"),
        F.count(b).alias("n_alt"), F.avg(b).alias("mean_alt"), F.var_samp(b).alias("var_alt"),
    ).withColumn("delta", F.col("mean_alt") - F.col("mean_ref"))


def welch(moments: DataFrame) -> DataFrame:
    """Welch t, Welch-Satterthwaite df and two-sided p for keys with two values on both sides."""
    qa, qb = F.col("var_ref") / F.col("n_ref"), F.col("var_alt") / F.col("n_alt")
    se2 = qa + qb
    t = F.when(se2 == 0, 0.0).otherwise(F.col("delta") / F.sqrt(se2))
    df = F.when(se2 > 0, se2 * se2 / (qa * qa / (F.col("n_ref") - 1) + qb * qb / (F.col("n_alt") - 1)))
    out = moments.where((F.col("n_ref") >= 2) & (F.col("n_alt") >= 2)).withColumn("t", t).withColumn("df", df)
    return out.withColumn("pvalue", F.coalesce(student_t_two_sided(F.col("t"), F.col("df")), F.lit(1.0)))


def differential_test(
    lm: DataFrame, meta: DataFrame, ref: str, alt: str | None = None, method: str = "ttest",
) -> DataFrame:
    """Differential table: delta, means, p and adjusted p per feature."""
    rows = labelled(lm, meta, ref, alt)
    tested = welch(group_moments(rows)) if method == "ttest" else mann_whitney(rows)
    return bh_adjust(tested, "pvalue", "padj")


def _tie_term(c: Column) -> Column:
    """c³ - c as a double, since the cube passes the largest long from some two million rows."""
    c = c.cast("double")
    return c * c * c - c


def mann_whitney(rows: DataFrame, keys: Sequence[str] = ("feature",), min_n: int = 2) -> DataFrame:
    """Rank-sum U with mid-ranks; normal p with tie correction and continuity 0.5."""
    keys = list(keys)
    ranked = ranked_counts(
        rows, keys, "value", sums={"c_alt": F.sum(F.col("is_alt").cast("long"))}
    )
    c = F.col("cnt")
    agg = ranked.groupBy(*keys).agg(
        F.sum("c_alt").alias("n_alt"), (F.max("n") - F.sum("c_alt")).alias("n_ref"),
        F.sum(F.col("c_alt") * mid_rank()).alias("rank_sum"),
        F.sum(_tie_term(c)).alias("ties"),
        (F.sum(F.col("c_alt") * F.col("value")) / F.sum("c_alt")).alias("mean_alt"),
        (F.sum((c - F.col("c_alt")) * F.col("value")) / F.sum(c - F.col("c_alt"))).alias("mean_ref"),
    )
    n1, n2 = F.col("n_alt"), F.col("n_ref")
    n = n1 + n2
    out = agg.where((n1 >= min_n) & (n2 >= min_n)).withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2.0)
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    gap = F.greatest(F.lit(0.0), F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5)
    z = F.when(sigma > 0, gap / sigma).otherwise(0.0)
    return (
        out.withColumn("delta", F.col("mean_alt") - F.col("mean_ref")).withColumn("z", z)
        .withColumn("pvalue", normal_two_sided(F.col("z")))
        .select(*keys, "n_ref", "n_alt", "mean_ref", "mean_alt", "delta", "u", "z", "pvalue")
    )


def marker_tests(lm: DataFrame, clusters: DataFrame) -> DataFrame:
    """One-versus-rest rank-sum markers per (cluster, feature) with fold change, adjusted p and score.

    Ranks are taken once per feature; each cluster only needs its rank sum and value sum.
    """
    rows = cut_lineage(lm.join(clusters.select("sample", "cluster"), "sample"))
    ranked = ranked_counts(rows, ["feature"], "value").withColumn("mid", mid_rank())
    c = F.col("cnt")
    per_feature = ranked.groupBy("feature").agg(
        F.max("n").alias("n"), F.sum(_tie_term(c)).alias("ties"), F.sum(c * F.col("value")).alias("total"),
    )
    per_cell = rows.groupBy("feature", "cluster", "value").agg(F.count(F.lit(1)).alias("k"))
    sums = (
        per_cell.join(ranked.select("feature", "value", "mid"), ["feature", "value"])
        .groupBy("feature", "cluster")
        .agg(F.sum("k").alias("n_in"), F.sum(F.col("k") * F.col("mid")).alias("rank_sum"),
             F.sum(F.col("k") * F.col("value")).alias("sum_in"))
        .join(per_feature, "feature")
    )
    n1 = F.col("n_in")
    n2 = F.col("n") - n1
    n = F.col("n")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when((n2 > 0) & (sigma > 0), F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2.0) - 0.5) / sigma).otherwise(0.0)
    out = sums.select(
        "cluster", "feature", (F.col("sum_in") / n1).alias("mean_cluster"),
        F.coalesce(F.try_divide(F.col("total") - F.col("sum_in"), n2), F.lit(0.0)).alias("mean_other"), z.alias("z"),
    ).where((F.col("mean_cluster") != 0) | (F.col("mean_other") != 0))
    ratio = F.col("mean_cluster") / (F.col("mean_other") + 1e-10) + 1e-10
    out = out.withColumn("log2fc", F.log2(ratio)).withColumn("pvalue", normal_two_sided(F.col("z")))
    out = bh_adjust(out, "pvalue", "fdr")
    return out.withColumn("score", -F.log10(F.col("pvalue") + 1e-300) * F.col("log2fc"))


def bonferroni(df: DataFrame, p: str, out: str = "padj") -> DataFrame:
    n = df.agg(F.count(p)).scalar()
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))


def kruskal(rows: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kruskal-Wallis H with mid-ranks and tie correction, df = groups - 1."""
    keys = list(keys)
    rows = cut_lineage(rows.select(*keys, group, value))
    ranked = ranked_counts(rows, keys, value).withColumn("mid", mid_rank())
    c = F.col("cnt")
    totals = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(_tie_term(c)).alias("ties")
    )
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("k"))
    per_group = (
        cells.join(ranked.select(*keys, value, "mid"), [*keys, value])
        .groupBy(*keys, group)
        .agg(F.sum("k").alias("ng"), F.sum(F.col("k") * F.col("mid")).alias("rg"))
    )
    agg = per_group.groupBy(*keys).agg(
        F.sum(F.col("rg") * F.col("rg") / F.col("ng")).alias("ss"), (F.count(F.lit(1)) - 1).alias("df")
    )
    joined = agg.join(totals, keys) if keys else agg.withColumn("n", totals.select("n").scalar()).withColumn(
        "ties", totals.select("ties").scalar())
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("ties") / _tie_term(n))
    return joined.withColumn("h", h).select(*keys, "n", "df", "h", chi2_sf(F.col("h"), F.col("df")).alias("pvalue"))


def group_describe(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """n, mean, median, population deviation per group."""
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop")
    )
    return base.join(exact_median(rows, keys, value), list(keys))


def group_error_bars(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean with sample deviation, standard error and 1.96·sem half-width per group."""
    sem = F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), sem.alias("sem"), (1.96 * sem).alias("ci95")
    )


def _group_pairs(groups: DataFrame, group: str, comparison: str, cols: Sequence[str]) -> DataFrame:
    """Pairs of group rows: all pairs, or each group against the first or the last by name.

    ``groups`` is the aggregated table with one row per group.
    """
    a = groups.select(*[F.col(c).alias(f"{c}_a") for c in [group, *cols]])
    b = groups.select(*[F.col(c).alias(f"{c}_b") for c in [group, *cols]])
    if comparison == "first":
        a = a.orderBy(f"{group}_a").limit(1)
    if comparison == "last":
        b = b.orderBy(F.desc(f"{group}_b")).limit(1)
    return a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b"))


def pairwise_ttest(rows: DataFrame, value: str, group: str, comparison: str = "all") -> DataFrame:
    """Welch test of every group pair from the groups' moments; adjusted by BH and Bonferroni."""
    stats = rows.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )
    pairs = _group_pairs(stats, group, comparison, ["n", "mean", "var"]).select(
        F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b"),
        F.col("n_a").alias("n_ref"), F.col("mean_a").alias("mean_ref"), F.col("var_a").alias("var_ref"),
        F.col("n_b").alias("n_alt"), F.col("mean_b").alias("mean_alt"), F.col("var_b").alias("var_alt"),
        (F.col("mean_b") - F.col("mean_a")).alias("delta"),
    )
    return bonferroni(bh_adjust(welch(pairs), "pvalue", "fdr"), "pvalue", "bonferroni")


def pairwise_rank_test(rows: DataFrame, value: str, group: str, comparison: str = "all") -> DataFrame:
    """Mann-Whitney test of every group pair from counts per (group, value), not from raw row pairs.

    U only needs, for each distinct value of one group, how many values of the other lie below it.
    """
    names = rows.select(group).distinct()
    pairs = _group_pairs(names, group, comparison, []).select(
        F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b")
    )
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    sides = pairs.select("group_a", "group_b", F.explode(F.array(
        F.struct(F.col("group_a").alias(group), F.lit(False).alias("is_alt")),
        F.struct(F.col("group_b").alias(group), F.lit(True).alias("is_alt")),
    )).alias("s")).select("group_a", "group_b", f"s.{group}", "s.is_alt")
    stacked = counts.join(sides, group).withColumnRenamed(value, "value")
    return bh_adjust(mann_whitney_counts(stacked, ["group_a", "group_b"]), "pvalue", "fdr")


def mann_whitney_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann-Whitney from rows (keys, value, is_alt, k) that stand for k equal values."""
    keys = list(keys)
    ranked = ranked_counts(counts, keys, "value", weight="k",
                           sums={"c_alt": F.sum(F.when(F.col("is_alt"), F.col("k")).otherwise(0))})
    c = F.col("cnt")
    agg = ranked.groupBy(*keys).agg(
        F.sum("c_alt").alias("n_alt"), F.sum(c - F.col("c_alt")).alias("n_ref"),
        F.sum(F.col("c_alt") * mid_rank()).alias("rank_sum"), F.sum(_tie_term(c)).alias("ties"),
    )
    n1, n2 = F.col("n_alt"), F.col("n_ref")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.when(sigma > 0, F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2.0) - 0.5) / sigma).otherwise(0.0)
    return agg.select(*keys, "n_ref", "n_alt", u.alias("u"), z.alias("z")).withColumn(
        "pvalue", normal_two_sided(F.col("z")))


def two_group_test(rows: DataFrame, value: str, group: str, first: str, second: str, method: str = "auto") -> DataFrame:
    """One comparison with the name of the test that was used (rank test for auto)."""
    side = rows.where(F.col(group).isin(first, second)).select(
        F.lit("all").alias("feature"), F.col(value).alias("value"), (F.col(group) == second).alias("is_alt")
    )
    if method == "ttest":
        out, label = welch(group_moments(side)), "Welch t-test"
    else:
        out, label = mann_whitney(side), "Mann-Whitney U"
    return out.select(F.lit(label).alias("method"), "n_ref", "n_alt", "pvalue")


def anova_f(rows: DataFrame, group: str, k: int | None = None) -> DataFrame:
    """One-way ANOVA F and p per feature; with ``k`` only the k best features."""
    per = rows.where("value is not null").groupBy("feature", group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    agg = per.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
    )
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    d1, d2 = (F.col("g") - 1).cast("double"), (F.col("n") - F.col("g")).cast("double")
    f = F.when((d1 > 0) & (d2 > 0) & (within > 0), (between / d1) / (within / d2))
    out = agg.select("feature", d1.alias("df_between"), d2.alias("df_within"), f.alias("f")).where("f is not null")
    d1, d2 = F.col("df_between"), F.col("df_within")
    out = out.withColumn("pvalue", betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * F.col("f"))))
    return out.orderBy(F.desc("f"), "feature").limit(k) if k else out


# ---- lineage style summaries ---------------------------------------------------------------------


def median_summary(df: DataFrame, key: str, value: str, min_n: int = 1) -> DataFrame:
    base = df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= min_n)
    return base.join(exact_median(df, [key], value), key)


def threshold_fractions(df: DataFrame, keys: Sequence[str], **conds: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c.cast("int")).alias(k) for k, c in conds.items()])


def expression_pattern(
    df: DataFrame, key: str, value: str, detect: float = 1.0, specific_max: float = 5.0, specific_fold: float = 5.0,
    specific_fraction: float = 0.30, universal_fraction: float = 0.80, universal_median: float = 1.0,
) -> DataFrame:
    """Class of a gene over tissues from the maximum, median and detected fraction of log2(x + 1).

    The limits are given on the raw scale.
    """
    rows = df.withColumn("__x", F.log2(F.col(value) + 1))

    def scale(limit: float) -> Column:
        return F.log2(F.lit(limit + 1.0))

    base = rows.groupBy(key).agg(
        F.max("__x").alias("top"), F.avg((F.col("__x") >= scale(detect)).cast("int")).alias("detected_fraction")
    ).join(exact_median(rows, [key], "__x"), key)
    specific = (
        (F.col("top") >= scale(specific_max))
        & (F.col("top") / (F.col("median") + 1e-6) >= specific_fold)
        & (F.col("detected_fraction") <= specific_fraction)
    )
    universal = (F.col("detected_fraction") >= universal_fraction) & (F.col("median") >= scale(universal_median))
    return base.withColumn("pattern", F.when(F.col("top") < scale(detect), "non-expressed")
                           .when(specific, "tissue-specific").when(universal, "universally-expressed").otherwise("mixed"))


def tissue_means(df: DataFrame, key: str, tissue: str, value: str) -> DataFrame:
    """Mean of repeated tissue rows with log2(x + 1)."""
    return df.groupBy(key, tissue).agg(F.avg(value).alias("expression")).withColumn(
        "log2_expression", F.log2(F.col("expression") + 1))


# ---- screens -------------------------------------------------------------------------------------


def guide_lfc(lm: DataFrame, treat: Column, control: Column, pseudocount: float = 1.0) -> DataFrame:
    """log2 of mean treated over mean control counts per guide, both plus a pseudocount."""
    agg = lm.groupBy("feature").agg(
        F.avg(F.when(treat, F.col("value"))).alias("mt"), F.avg(F.when(control, F.col("value"))).alias("mc")
    )
    return agg.where("mt is not null and mc is not null").select(
        "feature", F.log2((F.col("mt") + pseudocount) / (F.col("mc") + pseudocount)).alias("lfc")
    )


def gene_lfc(guides: DataFrame, method: str = "median") -> DataFrame:
    """Gene fold change from its guides (gene, feature, lfc): median, or trimmed mean.

    The trimmed mean keeps sorted positions floor(n/5) up to n - ceil(n/5), all of them when nothing is cut.
    """
    if method == "median":
        return exact_median(guides, ["gene"], "lfc", "lfc")
    ranked = ordinal_rank(guides, ["gene"], "lfc", "feature", "place")
    n = guides.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = F.floor(F.col("n") / 5), F.col("n") + F.floor(-F.col("n") / 5)
    return (
        ranked.join(n, "gene")
        .where((F.col("place") > lo) & (F.col("place") <= hi))
        .groupBy("gene").agg(F.avg("lfc").alias("lfc"))
    )


def rra_scores(guides: DataFrame, alpha: float | None = None) -> DataFrame:
    """Rank aggregation score per gene in both directions with adjusted values.

    Normalised tie-averaged ranks of all guides; per gene the smallest Beta(i, k-i+1) probability of its
    i-th smallest rank. With ``alpha`` only ranks up to alpha count (score 1 when none).
    """
    guides = cut_lineage(guides)
    ranked = ranked_counts(guides, [], "lfc")
    n = F.col("n")
    table = ranked.select(
        "lfc", (mid_rank() / n).alias("neg"), ((n - F.col("cum") + 1 + (F.col("cnt") - 1) / 2.0) / n).alias("pos")
    )
    rows = guides.join(table, "lfc").select(
        "gene", "feature",
        F.explode(F.array(F.struct(F.lit("neg").alias("arm"), F.col("neg").alias("r")),
                          F.struct(F.lit("pos").alias("arm"), F.col("pos").alias("r")))).alias("s"),
    ).select("gene", "feature", "s.arm", "s.r")
    placed = ordinal_rank(rows, ["gene", "arm"], "r", "feature", "i")
    size = guides.groupBy("gene").agg(F.count(F.lit(1)).alias("k"))
    probs = placed.join(size, "gene").withColumn("p", beta_cdf_int(F.col("r"), F.col("i"), F.col("k") - F.col("i") + 1))
    if alpha is not None:
        probs = probs.withColumn("p", F.when(F.col("r") <= alpha, F.col("p")).otherwise(1.0))
    score = probs.groupBy("gene", "arm").agg(F.first("k").alias("num_sgrna"), F.min("p").alias("score"))
    return bh_adjust(score, "score", "fdr", ["arm"])


def screen_hits(scores: DataFrame, cut: float = 0.25) -> DataFrame:
    """Genes whose adjusted score is under the cut in any arm."""
    hits = scores.where(F.col("fdr") < cut).select("gene").distinct()
    return scores.join(hits, "gene", "left_semi")


def significance(df: DataFrame, fc: str, p: str, max_p: float = 0.05, min_fc: float = 1.0) -> DataFrame:
    return df.where((F.col(p) <= max_p) & (F.abs(F.col(fc)) >= min_fc))


def direction_counts(df: DataFrame, fc: str, p: str, max_p: float = 0.05, min_fc: float = 1.0) -> DataFrame:
    sig = (F.col(p) <= max_p) & (F.abs(F.col(fc)) >= min_fc)
    return df.agg(
        F.count(F.lit(1)).alias("tested"), F.count_if(sig).alias("significant"),
        F.count_if(sig & (F.col(fc) > 0)).alias("up"), F.count_if(sig & (F.col(fc) < 0)).alias("down"),
    )


def volcano_category(fc: Column, p: Column, fc_cut: float = 1.0, p_cut: float = 0.05) -> Column:
    return (
        F.when((fc >= fc_cut) & (p < p_cut), "up").when((fc <= -fc_cut) & (p < p_cut), "down").otherwise("ns")
    )


def ma_category(df: DataFrame, a: str, m: str, p: str, fc_cut: float = 1.0, p_cut: float = 0.05) -> DataFrame:
    """MA table: log2(A + 1) when A goes over 100, and an up/down/ns class."""
    top = df.agg(F.max(a)).scalar()
    av = F.when(top > 100, F.log2(F.col(a) + 1)).otherwise(F.col(a))
    sig = (F.col(p) < p_cut) & (F.abs(F.col(m)) > fc_cut)
    cls = F.when(sig & (F.col(m) > 0), "up").when(sig & (F.col(m) < 0), "down").otherwise("ns")
    return df.withColumn("a_value", av).withColumn("category", cls)


def volcano_labels(
    df: DataFrame, key: str, fc: str, p: str, top_up: int = 10, top_down: int = 10, top_overall: int = 0,
    highlight: DataFrame | None = None, max_labels: int = 20, fc_cut: float = 1.0, p_cut: float = 0.05,
) -> DataFrame:
    """Features to label: the best of each direction and overall by -log10(p)·|fc|, any highlighted
    ones (a table with the key column), then the ``max_labels`` best of those."""
    score = -F.log10(F.greatest(F.col(p), F.lit(1e-300))) * F.abs(F.col(fc))
    scored = df.withColumn("category", volcano_category(F.col(fc), F.col(p), fc_cut, p_cut)).withColumn("score", score)
    w = W.partitionBy("category").orderBy(F.desc("score"), key)
    limit = F.when(F.col("category") == "up", top_up).when(F.col("category") == "down", top_down).otherwise(0)
    best = scored.where("category <> 'ns'").withColumn("place", F.row_number().over(w))
    chosen = best.where(F.col("place") <= max(top_up, top_down)).where(F.col("place") <= limit).drop("place")
    if top_overall:
        chosen = chosen.unionByName(scored.orderBy(F.desc("score"), key).limit(top_overall))
    if highlight is not None:
        chosen = chosen.unionByName(scored.join(highlight.select(key).distinct(), key, "left_semi").select(chosen.columns))
    return chosen.dropDuplicates([key]).orderBy(F.desc("score"), key).limit(max_labels)


def quadrant_counts(df: DataFrame, fc: str, p: str, fc_cut: float = 1.0, p_cut: float = 0.05) -> DataFrame:
    """Features beyond both cuts on either side (p inclusive, as drawn on the plot)."""
    hit = F.col(p) <= p_cut
    return df.agg(
        F.count_if(hit & (F.col(fc) >= fc_cut)).alias("up"), F.count_if(hit & (F.col(fc) <= -fc_cut)).alias("down")
    )


def annotate_points(df: DataFrame, key: str, fc: str, p: str, highlight: DataFrame, labels: DataFrame) -> DataFrame:
    """All points with category, highlight flag and label flag."""
    h = highlight.select(key).distinct().withColumn("highlighted", F.lit(True))
    lab = labels.select(key).distinct().withColumn("labelled", F.lit(True))
    return (
        df.withColumn("category", volcano_category(F.col(fc), F.col(p)))
        .withColumn("neg_log10_p", -F.log10(F.greatest(F.col(p), F.lit(1e-300))))
        .join(h, key, "left").join(lab, key, "left")
        .na.fill(False, ["highlighted", "labelled"])
    )
