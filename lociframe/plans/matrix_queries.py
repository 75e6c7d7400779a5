"""Queries over long matrices: filters, normalisation, imputation, quality tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import matrix as M
from lociframe.plans.inputs import (
    KIND_MATRIX,
    NATION_MATRIX,
    PART_MATRIX,
    SUPPLIER_META,
    kind_matrix,
    nation_matrix,
    part_matrix,
    supplier_meta,
)
from lociframe.plans.registry import query


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("filter_low_expression", f"""WITH lm AS ({PART_MATRIX}) SELECT * FROM lm WHERE feature IN (
SELECT feature FROM lm WHERE value >= 40 GROUP BY feature HAVING count(*) >= 10)""")
def _(spark, sf):
    return M.filter_low_expression(part_matrix(spark, sf), 40, 10)


@query("filter_valid_fraction", f"""WITH lm AS ({NATION_MATRIX}) SELECT * FROM lm WHERE feature IN (
SELECT feature FROM lm GROUP BY feature HAVING count(value) >= 0.7 * (SELECT count(DISTINCT sample) FROM lm))""")
def _(spark, sf):
    return M.filter_valid_fraction(nation_matrix(spark, sf), 0.7)


@query("cell_qc_metrics", f"""WITH lm AS ({KIND_MATRIX}) SELECT sample, count(CASE WHEN value > 0 THEN 1 END) AS n_genes,
sum(value) AS total_counts, round(coalesce(sum(CASE WHEN starts_with(feature, 'Brand#1') THEN value END) / sum(value) * 100, 0), 6)
AS pct_mito FROM lm GROUP BY sample""")
def _(spark, sf):
    return r6(M.cell_metrics(kind_matrix(spark, sf), F.col("feature").startswith("Brand#1")), "pct_mito")


@query("cell_qc_filter", f"""WITH lm AS ({KIND_MATRIX}), good AS (SELECT sample FROM lm GROUP BY sample
HAVING count(CASE WHEN value > 0 THEN 1 END) BETWEEN 100 AND 6000
AND coalesce(sum(CASE WHEN starts_with(feature, 'Brand#1') THEN value END) / sum(value) * 100, 0) <= 45),
kept AS (SELECT * FROM lm WHERE sample IN (SELECT sample FROM good))
SELECT * FROM kept WHERE feature IN (SELECT feature FROM kept WHERE value > 0 GROUP BY feature HAVING count(*) >= 3)""")
def _(spark, sf):
    return M.cell_qc(kind_matrix(spark, sf), F.col("feature").startswith("Brand#1"), 100, 6000, 45.0, 3)


@query("top_variance_features", f"""WITH lm AS ({PART_MATRIX}), v AS (SELECT feature, var_samp(value) AS variance FROM lm
GROUP BY feature HAVING var_samp(value) >= 50 ORDER BY variance DESC NULLS LAST, feature LIMIT 100)
SELECT lm.feature, sample, value, round(variance, 6) AS variance FROM lm JOIN v ON lm.feature = v.feature""")
def _(spark, sf):
    return r6(M.top_variance(part_matrix(spark, sf), 100, 50.0), "variance")


@query("top_variance_fraction", f"""WITH lm AS ({PART_MATRIX}), v AS (SELECT feature, var_pop(value) AS variance FROM lm GROUP BY feature),
r AS (SELECT feature, row_number() OVER (ORDER BY round(variance, 9) DESC, feature) AS place, count(*) OVER () AS n FROM v)
SELECT * FROM lm WHERE feature IN (SELECT feature FROM r WHERE place <= greatest(1, floor(n * 0.25)))""")
def _(spark, sf):
    return M.top_variance_fraction(part_matrix(spark, sf), 0.25)


@query("variable_features", f"""WITH lm AS ({PART_MATRIX}) SELECT * FROM lm WHERE feature IN (
SELECT feature FROM lm GROUP BY feature HAVING var_samp(value) > 200)""")
def _(spark, sf):
    return M.variable_features(part_matrix(spark, sf), 200)


@query("match_terms", f"""WITH lm AS ({KIND_MATRIX}) SELECT * FROM lm
WHERE contains(lower(feature), 'brand#7') OR contains(lower(feature), '/12')""")
def _(spark, sf):
    return M.match_terms(kind_matrix(spark, sf), "feature", ["Brand#7", "/12"])


@query("lookup_feature", f"""WITH lm AS ({KIND_MATRIX}), c AS (SELECT DISTINCT feature,
CASE WHEN feature = 'brand#3/1' THEN 1 WHEN upper(feature) = 'BRAND#3/1' THEN 2 WHEN contains(feature, 'brand#3/1') THEN 3 END AS lvl FROM lm)
SELECT * FROM lm WHERE feature = (SELECT feature FROM c WHERE lvl IS NOT NULL ORDER BY lvl, feature LIMIT 1)""")
def _(spark, sf):
    return M.lookup_feature(kind_matrix(spark, sf), "brand#3/1")


CPM_LOG2 = "SELECT feature, sample, log2(value * 1e6 / sum(value) OVER (PARTITION BY sample) + 1) AS value FROM lm"


@query("log2_cpm", f"WITH lm AS ({PART_MATRIX}) SELECT feature, sample, round(value, 6) AS value FROM ({CPM_LOG2})")
def _(spark, sf):
    return r6(M.cpm(part_matrix(spark, sf), log2=True), "value")


@query("cell_normalize", f"""WITH lm AS ({KIND_MATRIX}) SELECT feature, sample,
round(ln(1 + value / sum(value) OVER (PARTITION BY sample) * 10000), 6) AS value FROM lm""")
def _(spark, sf):
    return r6(M.cell_normalize(kind_matrix(spark, sf)), "value")


@query("size_factor_normalize", f"""WITH lm AS ({PART_MATRIX}), t AS (SELECT sample, sum(value) AS total FROM lm GROUP BY sample),
m AS (SELECT quantile_cont(total, 0.5) AS middle FROM t)
SELECT feature, lm.sample, round(value / (total / middle), 6) AS value FROM lm JOIN t ON lm.sample = t.sample, m""")
def _(spark, sf):
    return r6(M.size_factor_normalize(part_matrix(spark, sf)), "value")


@query("median_center", f"""WITH lm AS ({PART_MATRIX}), m AS (SELECT sample, quantile_cont(value, 0.5) AS med FROM lm GROUP BY sample)
SELECT feature, lm.sample, value - med AS value FROM lm JOIN m ON lm.sample = m.sample""")
def _(spark, sf):
    return M.normalize(part_matrix(spark, sf), "median")


@query("quantile_normalize", f"""WITH lm AS ({NATION_MATRIX}), o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS r FROM lm),
t AS (SELECT r, avg(value) AS target FROM o GROUP BY r),
g AS (SELECT sample, value, avg(target) AS target FROM o JOIN t ON o.r = t.r GROUP BY sample, value)
SELECT lm.feature, lm.sample, round(target + 1e-9, 6) AS value FROM lm JOIN g ON lm.sample = g.sample AND lm.value = g.value""")
def _(spark, sf):
    # Means of whole numbers often end in a 5 at the seventh place; both sides are moved off it before rounding.
    return r6(M.normalize(nation_matrix(spark, sf), "quantile").withColumn("value", F.col("value") + 1e-9), "value")


LOGGED = f"""WITH lm AS ({PART_MATRIX}), f AS (SELECT max(value) <= 20 OR count(CASE WHEN value < 1 THEN 1 END) > count(DISTINCT feature) * 0.1 AS is_log FROM lm),
g AS (SELECT feature, sample, CASE WHEN is_log THEN value ELSE log2(nullif(value, 0) + 1) END AS value FROM lm, f)"""


@query("log2_if_needed", f"{LOGGED} SELECT feature, sample, round(value, 6) AS value FROM g")
def _(spark, sf):
    return r6(M.log2_if_needed(part_matrix(spark, sf)), "value")


@query("log2_median", f"""{LOGGED}, m AS (SELECT sample, quantile_cont(value, 0.5) AS med FROM g GROUP BY sample)
SELECT feature, g.sample, round(value - med, 6) AS value FROM g JOIN m ON g.sample = m.sample""")
def _(spark, sf):
    return r6(M.normalize(part_matrix(spark, sf), "log2_median"), "value")


@query("asinh_transform", f"WITH lm AS ({PART_MATRIX}) SELECT feature, sample, round(2 * asinh(value / 2), 6) AS value FROM lm")
def _(spark, sf):
    return r6(M.normalize(part_matrix(spark, sf), "vsn"), "value")


@query("batch_center", f"""WITH lm AS ({PART_MATRIX}), j AS (SELECT lm.*, batch FROM lm JOIN ({SUPPLIER_META}) m ON lm.sample = m.sample)
SELECT feature, sample, round(value - avg(value) OVER (PARTITION BY feature, batch), 6) AS value FROM j""")
def _(spark, sf):
    return r6(M.batch_center(part_matrix(spark, sf), supplier_meta(spark, sf)), "value")


@query("zscore_clipped", f"""WITH lm AS ({PART_MATRIX}), s AS (SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM lm)
SELECT feature, sample, round(greatest(-2.5, least(2.5, (value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 6) AS value FROM s""")
def _(spark, sf):
    return r6(M.zscore(part_matrix(spark, sf), clip=2.5), "value")


@query("zscore_both_ways", f"""WITH lm AS ({KIND_MATRIX}), s AS (SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM lm),
z AS (SELECT feature, sample, (value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS value FROM s),
s2 AS (SELECT *, avg(value) OVER (PARTITION BY sample) AS m, stddev_pop(value) OVER (PARTITION BY sample) AS sd FROM z)
SELECT feature, sample, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS value FROM s2""")
def _(spark, sf):
    return r6(M.zscore_both(kind_matrix(spark, sf)), "value")


@query("min_max_scale", f"""WITH lm AS ({PART_MATRIX}), s AS (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM lm)
SELECT feature, sample, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS value FROM s""")
def _(spark, sf):
    return r6(M.min_max(part_matrix(spark, sf)), "value")


GRID = f"""lm AS ({NATION_MATRIX}), grid AS (SELECT f.feature, s.sample, lm.value FROM (SELECT DISTINCT feature FROM lm) f
CROSS JOIN (SELECT DISTINCT sample FROM lm) s LEFT JOIN lm ON lm.feature = f.feature AND lm.sample = s.sample)"""


@query("impute_min_prob", f"""WITH {GRID}, st AS (SELECT sample, avg(value) AS m, stddev_samp(value) AS sd FROM grid GROUP BY sample)
SELECT feature, grid.sample, round(coalesce(value, m - 1.8 * CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END), 6) AS value
FROM grid JOIN st ON grid.sample = st.sample""")
def _(spark, sf):
    return r6(M.impute_min_prob(M.complete_grid(nation_matrix(spark, sf))), "value")


@query("impute_zero", f"WITH {GRID} SELECT feature, sample, coalesce(value, 0.0) AS value FROM grid")
def _(spark, sf):
    return M.impute_constant(M.complete_grid(nation_matrix(spark, sf)), "zero")


@query("impute_median", f"""WITH {GRID}, m AS (SELECT feature, quantile_cont(value, 0.5) AS med FROM grid GROUP BY feature)
SELECT grid.feature, sample, coalesce(value, med) AS value FROM grid JOIN m ON grid.feature = m.feature""")
def _(spark, sf):
    return M.impute_constant(M.complete_grid(nation_matrix(spark, sf)), "median")


@query("missing_by_sample", f"""WITH {GRID} SELECT sample, count(*) AS cells, count(*) - count(value) AS missing,
round((count(*) - count(value)) / count(*), 6) AS missing_fraction FROM grid GROUP BY sample""")
def _(spark, sf):
    return r6(M.missing_table(M.complete_grid(nation_matrix(spark, sf))), "missing_fraction")


@query("highly_variable", f"""WITH lm AS ({PART_MATRIX}), p AS (SELECT feature, avg(value) AS mean, var_pop(value) AS variance FROM lm GROUP BY feature),
d AS (SELECT *, variance / (mean + 1e-10) AS dispersion, row_number() OVER (ORDER BY mean, feature) AS place, count(*) OVER () AS n FROM p),
b AS (SELECT *, least(9, floor((place - 1) / greatest(1, floor(n / 10)))) AS bin FROM d),
z AS (SELECT *, (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / (stddev_pop(dispersion) OVER (PARTITION BY bin) + 1e-10) AS nd FROM b)
SELECT feature, round(mean, 6) AS mean, round(variance, 6) AS variance, round(dispersion, 6) AS dispersion, CAST(bin AS BIGINT) AS bin,
round(nd, 6) AS normalized_dispersion FROM z ORDER BY nd DESC, feature LIMIT 200""")
def _(spark, sf):
    return r6(M.highly_variable(part_matrix(spark, sf), 200), "mean", "variance", "dispersion", "normalized_dispersion")


@query("sample_summary", f"""WITH lm AS ({PART_MATRIX}) SELECT sample, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop,
round(stddev_samp(value) / abs(avg(value)) * 100, 6) AS cv_pct, quantile_cont(value, 0.5) AS median FROM lm GROUP BY sample""")
def _(spark, sf):
    return r6(M.sample_summary(part_matrix(spark, sf)), "mean", "sd_pop", "cv_pct")


@query("value_histogram", f"""WITH lm AS ({PART_MATRIX}) SELECT sample, CAST(CASE WHEN value < 5 THEN -1 WHEN value > 45 THEN 20 ELSE least(floor((value - 5) / 2.0), 19) END AS BIGINT) AS bin, count(*) AS count
FROM lm WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return M.histogram(part_matrix(spark, sf), ["sample"], 5.0, 45.0, 20)


SCREEN_QC = """SELECT sample, sum(value) AS total_reads, count(*) AS num_guides, count(CASE WHEN value >= 30 THEN 1 END) AS represented_guides,
round(count(CASE WHEN value >= 30 THEN 1 END) / count(*), 6) AS representation_fraction,
round(coalesce(avg(CASE WHEN value > 0 THEN value END), 0), 6) AS mean_reads, coalesce(min(CASE WHEN value > 0 THEN value END), 0) AS min_reads,
max(value) AS max_reads, count(CASE WHEN value = 0 THEN 1 END) AS missing_guides, round(count(CASE WHEN value = 0 THEN 1 END) / count(*), 6) AS missing_fraction,
quantile_cont(CASE WHEN value > 0 THEN value END, 0.5) AS median_reads FROM lm GROUP BY sample"""
GINI = """SELECT sample, greatest(0.0, 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*)) AS gini_index FROM (
SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value) AS i FROM lm WHERE value > 0) GROUP BY sample"""


@query("screen_sample_qc", f"""WITH {GRID.replace('lm AS', 'base AS').replace('FROM lm', 'FROM base').replace('JOIN lm ON lm.feature = f.feature AND lm.sample', 'JOIN base ON base.feature = f.feature AND base.sample').replace('lm.value', 'base.value')},
lm AS (SELECT feature, sample, coalesce(value, 0.0) AS value FROM grid), q AS ({SCREEN_QC}), g AS ({GINI})
SELECT q.*, round(gini_index, 6) AS gini_index FROM q LEFT JOIN g ON q.sample = g.sample""")
def _(spark, sf):
    lm = M.impute_constant(M.complete_grid(nation_matrix(spark, sf)), "zero")
    return r6(M.screen_sample_qc(lm), "representation_fraction", "mean_reads", "missing_fraction", "gini_index")


@query("gini_with_zeros", f"""WITH {GRID}, x AS (SELECT sample, coalesce(value, 0) + 1 AS value FROM grid)
SELECT sample, round(2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*), 6) AS gini_index FROM (
SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value) AS i FROM x) GROUP BY sample""")
def _(spark, sf):
    return r6(M.gini(M.impute_constant(M.complete_grid(nation_matrix(spark, sf)), "zero"), keep_zeros=True), "gini_index")


@query("control_guide_stats", f"""WITH lm AS ({KIND_MATRIX}), c AS (SELECT *, starts_with(feature, 'Brand#1/') AS ctl FROM lm), a AS (SELECT sample,
coalesce(avg(CASE WHEN ctl AND value > 0 THEN value END), 0) AS control_mean, stddev_pop(CASE WHEN ctl THEN value END) AS cs, count(CASE WHEN ctl THEN 1 END) AS num_control,
coalesce(avg(CASE WHEN NOT ctl AND value > 0 THEN value END), 0) AS targeting_mean, stddev_pop(CASE WHEN NOT ctl THEN value END) AS ts, count(CASE WHEN NOT ctl THEN 1 END) AS num_targeting
FROM c GROUP BY sample) SELECT sample, round(control_mean, 6) AS control_mean, round(CASE WHEN control_mean > 0 THEN cs / control_mean END, 6) AS control_cv, num_control,
round(targeting_mean, 6) AS targeting_mean, round(CASE WHEN targeting_mean > 0 THEN ts / targeting_mean END, 6) AS targeting_cv, num_targeting FROM a""")
def _(spark, sf):
    out = M.control_stats(kind_matrix(spark, sf), F.col("feature").startswith("Brand#1/"))
    return r6(out, "control_mean", "control_cv", "targeting_mean", "targeting_cv")


@query("guide_variation", f"""WITH lm AS ({PART_MATRIX}) SELECT feature, round(avg(value), 6) AS mean_reads, round(stddev_pop(value) / (avg(value) + 1e-6), 6) AS cv,
min(value) AS min_reads, max(value) AS max_reads FROM lm GROUP BY feature""")
def _(spark, sf):
    return r6(M.guide_cv(part_matrix(spark, sf)), "mean_reads", "cv")


@query("empirical_cdf", f"""WITH lm AS ({PART_MATRIX}) SELECT DISTINCT sample, value, round(count(*) OVER (PARTITION BY sample ORDER BY value
RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY sample), 6) AS cdf FROM lm""")
def _(spark, sf):
    return r6(M.empirical_cdf(part_matrix(spark, sf)), "cdf")
