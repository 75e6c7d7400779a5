"""Queries for group tests, adjusted p-values, screens and volcano tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions.ordering import bh_adjust, exact_quantiles
from lociframe.operators import matrix as M
from lociframe.operators import stats as S
from lociframe.plans.inputs import (
    BRAND_MATRIX,
    CUSTOMER_META,
    KIND_MATRIX,
    PART_MATRIX,
    SUPPLIER_META,
    brand_matrix,
    customer_meta,
    kind_matrix,
    part_matrix,
    supplier_meta,
    table,
)
from lociframe.plans.matrix_queries import CPM_LOG2, r6
from lociframe.plans.registry import query
from lociframe.plans.sqltext import betainc, bh, midrank, norm_two_sided, t_two_sided

LOGGED = f"lm AS ({PART_MATRIX}), x AS ({CPM_LOG2}), r AS (SELECT x.*, grp = 'treatment' AS is_alt FROM x JOIN ({SUPPLIER_META}) m ON x.sample = m.sample WHERE grp IN ('control', 'treatment'))"
MOMENTS = """SELECT feature, count(value) FILTER (WHERE NOT is_alt) AS n_ref, avg(value) FILTER (WHERE NOT is_alt) AS mean_ref,
var_samp(value) FILTER (WHERE NOT is_alt) AS var_ref, count(value) FILTER (WHERE is_alt) AS n_alt, avg(value) FILTER (WHERE is_alt) AS mean_alt,
var_samp(value) FILTER (WHERE is_alt) AS var_alt FROM r GROUP BY feature"""
WELCH = f"""SELECT *, mean_alt - mean_ref AS delta, CASE WHEN var_ref / n_ref + var_alt / n_alt = 0 THEN 0.0 ELSE (mean_alt - mean_ref) / sqrt(var_ref / n_ref + var_alt / n_alt) END AS t,
CASE WHEN var_ref / n_ref + var_alt / n_alt > 0 THEN pow(var_ref / n_ref + var_alt / n_alt, 2) / (pow(var_ref / n_ref, 2) / (n_ref - 1) + pow(var_alt / n_alt, 2) / (n_alt - 1)) END AS df FROM (MOM)
WHERE n_ref >= 2 AND n_alt >= 2"""
WELCH_P = f"SELECT *, CASE WHEN df IS NULL THEN 1.0 ELSE {t_two_sided('t', 'df')} END AS pvalue FROM (WEL)"


def welch_sql(moments: str) -> str:
    return WELCH_P.replace("WEL", WELCH.replace("MOM", moments))


DIFF_SQL = f"""WITH {LOGGED}, w AS ({welch_sql(MOMENTS)}), d AS ({bh('SELECT * FROM w', 'pvalue')})"""


def logged(spark, sf):
    return M.cpm(part_matrix(spark, sf), log2=True)


def differential(spark, sf):
    return S.differential_test(logged(spark, sf), supplier_meta(spark, sf), "control", "treatment")


@query("differential_ttest", f"""{DIFF_SQL} SELECT feature, n_ref, n_alt, round(mean_ref, 6) AS mean_ref, round(mean_alt, 6) AS mean_alt,
round(delta, 6) AS delta, round(t, 6) AS t, round(df, 6) AS df, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj FROM d""")
def _(spark, sf):
    out = differential(spark, sf).select("feature", "n_ref", "n_alt", "mean_ref", "mean_alt", "delta", "t", "df", "pvalue", "padj")
    return r6(out, "mean_ref", "mean_alt", "delta", "t", "df", "pvalue", "padj")


@query("group_moments", f"""WITH {LOGGED} SELECT feature, n_ref, round(mean_ref, 6) AS mean_ref, round(var_ref, 6) AS var_ref, n_alt,
round(mean_alt, 6) AS mean_alt, round(var_alt, 6) AS var_alt, round(mean_alt - mean_ref, 6) AS delta FROM ({MOMENTS})""")
def _(spark, sf):
    rows = S.labelled(logged(spark, sf), supplier_meta(spark, sf), "control", "treatment")
    return r6(S.group_moments(rows), "mean_ref", "var_ref", "mean_alt", "var_alt", "delta")


@query("missing_samples", f"""SELECT sample, grp, batch FROM ({SUPPLIER_META}) m WHERE sample NOT IN (SELECT l_suppkey * 2 FROM lineitem)""")
def _(spark, sf):
    # Samples of twice the supplier's key: every supplier of an odd key is missing.
    li = table(spark, sf, "lineitem")
    lm = li.select(F.col("l_partkey").alias("feature"), (F.col("l_suppkey") * 2).alias("sample"), F.col("l_quantity").alias("value"))
    return S.missing_samples(lm, supplier_meta(spark, sf))


def rank_test_sql(rows: str, keys: str, min_n: int = 2) -> str:
    return f"""SELECT *, mean_alt - mean_ref AS delta, {norm_two_sided('z')} AS pvalue FROM (SELECT *,
CASE WHEN sigma > 0 THEN greatest(0.0, abs(u - n_alt * n_ref / 2.0) - 0.5) / sigma ELSE 0.0 END AS z FROM (SELECT *, rank_sum - n_alt * (n_alt + 1) / 2.0 AS u,
sqrt(n_alt * n_ref / 12.0 * ((n_alt + n_ref + 1) - ties / ((n_alt + n_ref) * (n_alt + n_ref - 1)))) AS sigma FROM (
SELECT {keys}, count(*) FILTER (WHERE is_alt) AS n_alt, count(*) FILTER (WHERE NOT is_alt) AS n_ref, sum(mid) FILTER (WHERE is_alt) AS rank_sum,
sum(CAST(c * c - 1 AS DOUBLE)) AS ties, avg(value) FILTER (WHERE is_alt) AS mean_alt, avg(value) FILTER (WHERE NOT is_alt) AS mean_ref FROM (
SELECT *, {midrank(keys, 'value')} AS mid, count(*) OVER (PARTITION BY {keys}, value) AS c FROM ({rows})) GROUP BY {keys}) WHERE n_alt >= {min_n} AND n_ref >= {min_n}))"""


RAW_ROWS = f"SELECT lm.*, grp = 'treatment' AS is_alt FROM ({PART_MATRIX}) lm JOIN ({SUPPLIER_META}) m ON lm.sample = m.sample WHERE grp IN ('control', 'treatment')"


@query("mann_whitney", f"""WITH w AS ({rank_test_sql(RAW_ROWS, 'feature')}), d AS ({bh('SELECT * FROM w', 'pvalue')})
SELECT feature, n_ref, n_alt, round(mean_ref, 6) AS mean_ref, round(mean_alt, 6) AS mean_alt, round(delta, 6) AS delta, u, round(z, 6) AS z,
round(pvalue, 6) AS pvalue, round(padj, 6) AS padj FROM d""")
def _(spark, sf):
    out = S.differential_test(part_matrix(spark, sf), supplier_meta(spark, sf), "control", "treatment", "mannwhitney")
    return r6(out, "mean_ref", "mean_alt", "delta", "z", "pvalue", "padj")


@query("marker_tests", f"""WITH lm AS ({KIND_MATRIX}), r AS (SELECT lm.*, n_regionkey AS cluster FROM lm JOIN supplier ON sample = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT *, {midrank('feature', 'value')} AS mid, count(*) OVER (PARTITION BY feature, value) AS c FROM r),
f AS (SELECT feature, count(*) AS n, sum(CAST(c * c - 1 AS DOUBLE)) AS ties, sum(value) AS total FROM m GROUP BY feature),
g AS (SELECT feature, cluster, count(*) AS n1, sum(mid) AS rs, sum(value) AS s1 FROM m GROUP BY feature, cluster),
z AS (SELECT cluster, g.feature, s1 / n1 AS mean_cluster, CASE WHEN n > n1 THEN (total - s1) / (n - n1) ELSE 0 END AS mean_other,
CASE WHEN n > n1 AND (n + 1) - ties / (n * (n - 1)) > 0 THEN greatest(0.0, abs(rs - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) - 0.5) / sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - ties / (n * (n - 1)))) ELSE 0.0 END AS z
FROM g JOIN f ON g.feature = f.feature), p AS (SELECT *, log2(mean_cluster / (mean_other + 1e-10) + 1e-10) AS log2fc, {norm_two_sided('z')} AS pvalue FROM z),
d AS ({bh('SELECT * FROM p', 'pvalue', 'fdr')}) SELECT cluster, feature, round(mean_cluster, 6) AS mean_cluster, round(mean_other, 6) AS mean_other, round(z, 6) AS z, round(log2fc, 6) AS log2fc,
round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr, round(-log10(pvalue + 1e-300) * log2fc, 4) AS score FROM d""")
def _(spark, sf):
    sup, nat = table(spark, sf, "supplier"), table(spark, sf, "nation")
    clusters = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("sample"), F.col("n_regionkey").alias("cluster"))
    out = S.marker_tests(kind_matrix(spark, sf), clusters)
    return r6(out, "mean_cluster", "mean_other", "z", "log2fc", "pvalue", "fdr").withColumn("score", F.round("score", 4))


@query("bh_adjust", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag AS fam, l_partkey, l_suppkey,
(l_quantity * l_discount + 0.01) / 6 AS p FROM lineitem), d AS ({bh('SELECT * FROM p', 'p', 'padj', 'fam')})
SELECT fam, round(p, 9) AS p, round(padj, 6) AS padj, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("fam"), ((F.col("l_quantity") * F.col("l_discount") + 0.01) / 6).alias("p"))
    out = bh_adjust(li, "p", "padj", ["fam"])
    return out.groupBy("fam", F.round("p", 9).alias("p"), F.round("padj", 6).alias("padj")).agg(F.count(F.lit(1)).alias("n"))


VOLC = f"{DIFF_SQL}, v AS (SELECT feature, delta, pvalue FROM d)"


def volcano_input(spark, sf):
    return differential(spark, sf).select("feature", "delta", "pvalue")


@query("significant_features", f"""{DIFF_SQL} SELECT feature, round(delta, 6) AS delta, round(padj, 6) AS padj FROM d WHERE padj <= 0.999 AND abs(delta) >= 0.2""")
def _(spark, sf):
    out = S.significance(differential(spark, sf), "delta", "padj", 0.999, 0.2).select("feature", "delta", "padj")
    return r6(out, "delta", "padj")


@query("direction_counts", f"""{DIFF_SQL} SELECT count(*) AS tested, count(*) FILTER (WHERE pvalue <= 0.1 AND abs(delta) >= 0.2) AS significant,
count(*) FILTER (WHERE pvalue <= 0.1 AND delta >= 0.2) AS up, count(*) FILTER (WHERE pvalue <= 0.1 AND delta <= -0.2) AS down FROM d""")
def _(spark, sf):
    return S.direction_counts(differential(spark, sf), "delta", "pvalue", 0.1, 0.2)


CAT = "CASE WHEN delta >= 0.5 AND pvalue < 0.1 THEN 'up' WHEN delta <= -0.5 AND pvalue < 0.1 THEN 'down' ELSE 'ns' END"


@query("volcano_category", f"{VOLC} SELECT {CAT} AS category, count(*) AS n FROM v GROUP BY 1")
def _(spark, sf):
    c = S.volcano_category(F.col("delta"), F.col("pvalue"), 0.5, 0.1).alias("category")
    return volcano_input(spark, sf).groupBy(c).agg(F.count(F.lit(1)).alias("n"))


@query("volcano_labels", f"""{VOLC}, s AS (SELECT feature, {CAT} AS category, round(-log10(greatest(pvalue, 1e-300)) * abs(delta), 9) AS score FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, feature) AS i, row_number() OVER (ORDER BY score DESC, feature) AS o FROM s),
h AS (SELECT * FROM k WHERE (category <> 'ns' AND i <= 10) OR o <= 5)
SELECT feature, category, round(score, 6) AS score FROM h ORDER BY h.score DESC, feature LIMIT 20""")
def _(spark, sf):
    out = S.volcano_labels(volcano_input(spark, sf), "feature", "delta", "pvalue", 10, 10, 5, fc_cut=0.5, p_cut=0.1)
    return r6(out.select("feature", "category", "score"), "score")


@query("annotated_points", f"""{VOLC}, c AS (SELECT feature, CASE WHEN delta >= 1 AND pvalue < 0.05 THEN 'up' WHEN delta <= -1 AND pvalue < 0.05 THEN 'down' ELSE 'ns' END AS category,
-log10(greatest(pvalue, 1e-300)) AS y, delta FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(y * abs(delta), 9) DESC, feature) AS i FROM c)
SELECT feature, category, round(y, 6) AS neg_log10_p, feature IN (SELECT p_partkey FROM part WHERE p_size = 7) AS highlighted, (category <> 'ns' AND i <= 5) AS labelled FROM k""")
def _(spark, sf):
    pts = volcano_input(spark, sf)
    labels = S.volcano_labels(pts, "feature", "delta", "pvalue", 5, 5)
    hl = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("feature"))
    out = S.annotate_points(pts, "feature", "delta", "pvalue", hl, labels)
    return r6(out.select("feature", "category", "neg_log10_p", "highlighted", "labelled"), "neg_log10_p")


@query("quadrant_counts", f"{VOLC} SELECT count(*) FILTER (WHERE pvalue <= 0.1 AND delta >= 0.5) AS up, count(*) FILTER (WHERE pvalue <= 0.1 AND delta <= -0.5) AS down FROM v")
def _(spark, sf):
    return S.quadrant_counts(volcano_input(spark, sf), "delta", "pvalue", 0.5, 0.1)


@query("ma_category", f"""{DIFF_SQL}, b AS (SELECT feature, sum(value) AS a, any_value(0) AS z FROM lm GROUP BY feature),
j AS (SELECT d.feature, a, delta, pvalue, max(a) OVER () AS top FROM d JOIN b ON d.feature = b.feature)
SELECT feature, round(CASE WHEN top > 100 THEN log2(a + 1) ELSE a END, 6) AS a_value,
CASE WHEN pvalue < 0.1 AND delta > 0.5 THEN 'up' WHEN pvalue < 0.1 AND delta < -0.5 THEN 'down' ELSE 'ns' END AS category FROM j""")
def _(spark, sf):
    a = part_matrix(spark, sf).groupBy("feature").agg(F.sum("value").alias("a"))
    out = S.ma_category(differential(spark, sf).join(a, "feature"), "a", "delta", "pvalue", 0.5, 0.1)
    return r6(out.select("feature", "a_value", "category"), "a_value")


LINES = "SELECT p_brand AS grp, l_quantity AS q, l_extendedprice AS price, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey"


def brand_lines(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    pt = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(pt, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("grp"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"))


@query("group_describe", f"SELECT grp, count(price) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS sd_pop, round(quantile_cont(price, 0.5), 4) AS median FROM ({LINES}) GROUP BY grp")
def _(spark, sf):
    out = S.group_describe(brand_lines(spark, sf), "price", ["grp"])
    return out.select("grp", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd_pop", "median")])


@query("group_error_bars", f"""SELECT grp, flag, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd, round(stddev_samp(q) / sqrt(count(q)), 6) AS sem,
round(1.96 * stddev_samp(q) / sqrt(count(q)), 6) AS ci95 FROM ({LINES}) GROUP BY grp, flag""")
def _(spark, sf):
    return r6(S.group_error_bars(brand_lines(spark, sf), "q", ["grp", "flag"]), "mean", "sd", "sem", "ci95")


@query("median_summary", f"SELECT grp, round(avg(q), 6) AS mean, count(q) AS n, quantile_cont(q, 0.5) AS median FROM ({LINES}) GROUP BY grp HAVING count(q) >= 3")
def _(spark, sf):
    return r6(S.median_summary(brand_lines(spark, sf), "grp", "q", 3), "mean")


@query("threshold_fractions", f"""SELECT grp, round(avg(CASE WHEN q > 25 THEN 1 ELSE 0 END), 6) AS detected, round(avg(CASE WHEN price >= 50000 THEN 1 ELSE 0 END), 6) AS amplified,
round(avg(CASE WHEN price <= 10000 THEN 1 ELSE 0 END), 6) AS deleted FROM ({LINES}) GROUP BY grp""")
def _(spark, sf):
    out = S.threshold_fractions(brand_lines(spark, sf), ["grp"], detected=F.col("q") > 25,
                                amplified=F.col("price") >= 50000, deleted=F.col("price") <= 10000)
    return r6(out, "detected", "amplified", "deleted")


@query("tissue_means", f"""SELECT feature, sample % 10 AS tissue, round(avg(value), 6) AS expression, round(log2(avg(value) + 1), 6) AS log2_expression FROM ({PART_MATRIX}) GROUP BY 1, 2""")
def _(spark, sf):
    lm = part_matrix(spark, sf).withColumn("tissue", F.col("sample") % 10)
    return r6(S.tissue_means(lm, "feature", "tissue", "value"), "expression", "log2_expression")


@query("expression_pattern", f"""WITH x AS (SELECT feature, log2(value + 1) AS x FROM ({PART_MATRIX})), a AS (SELECT feature, max(x) AS top,
avg(CASE WHEN x >= log2(31.0) THEN 1 ELSE 0 END) AS fr, quantile_cont(x, 0.5) AS med FROM x GROUP BY feature) SELECT feature,
round(top, 6) AS top, round(fr, 6) AS detected_fraction, CASE WHEN top < log2(31.0) THEN 'non-expressed' WHEN top >= log2(81.0) AND top / (med + 1e-6) >= 1.3 AND fr <= 0.3 THEN 'tissue-specific'
WHEN fr >= 0.6 AND med >= log2(26.0) THEN 'universally-expressed' ELSE 'mixed' END AS pattern FROM a""")
def _(spark, sf):
    out = S.expression_pattern(part_matrix(spark, sf), "feature", "value", detect=30, specific_max=80, specific_fold=1.3,
                               universal_fraction=0.6, universal_median=25)
    return r6(out.select("feature", "top", "detected_fraction", "pattern"), "top", "detected_fraction")


@query("kruskal_groups", f"""WITH m AS (SELECT *, {midrank('', 'q')} AS mid, count(*) OVER (PARTITION BY q) AS c, count(*) OVER () AS n FROM ({LINES})),
g AS (SELECT grp, sum(mid) AS rg, count(*) AS ng FROM m GROUP BY grp), t AS (SELECT max(n) AS n, sum(CAST(c * c - 1 AS DOUBLE)) AS ties FROM m)
SELECT any_value(n) AS n, count(*) - 1 AS df, round((12.0 / (any_value(n) * (any_value(n) + 1)) * sum(rg * rg / ng) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (CAST(any_value(n) AS DOUBLE) * any_value(n) * any_value(n) - any_value(n))), 4) AS h FROM g, t""")
def _(spark, sf):
    return S.kruskal(brand_lines(spark, sf), "q", "grp").select("n", "df", F.round("h", 4).alias("h"))


PAIRS = f"""WITH l AS ({LINES}), s AS (SELECT grp, count(q) AS n, avg(q) AS m, var_samp(q) AS v FROM l GROUP BY grp), mom AS (SELECT a.grp AS group_a, b.grp AS group_b, a.n AS n_ref, a.m AS mean_ref, a.v AS var_ref,
b.n AS n_alt, b.m AS mean_alt, b.v AS var_alt FROM s a JOIN s b ON a.grp < b.grp)"""


@query("pairwise_ttest", f"""{PAIRS}, w AS ({WELCH.replace('(MOM)', 'mom')}) SELECT group_a, group_b, n_ref, n_alt, round(delta, 6) AS delta, round(t, 6) AS t, round(df, 3) AS df FROM w""")
def _(spark, sf):
    out = S.pairwise_ttest(brand_lines(spark, sf), "q", "grp").select("group_a", "group_b", "n_ref", "n_alt", "delta", "t", "df")
    return r6(out, "delta", "t").withColumn("df", F.round("df", 3))


@query("pairwise_vs_first", f"""{PAIRS}, f AS (SELECT * FROM mom WHERE group_a = (SELECT min(grp) FROM s)), w AS ({WELCH.replace('(MOM)', 'f')}), p AS (SELECT *, {norm_two_sided('t')} AS pn FROM w)
SELECT group_a, group_b, round(t, 6) AS t, round(least(1.0, pn * count(*) OVER ()), 6) AS bonferroni FROM p""")
def _(spark, sf):
    out = S.pairwise_ttest(brand_lines(spark, sf), "q", "grp", "first").select("group_a", "group_b", "t")
    out = S.bonferroni(out.withColumn("pn", S.normal_two_sided(F.col("t"))), "pn", "bonferroni").drop("pn")
    return r6(out, "t", "bonferroni")


@query("pairwise_rank_test", f"""WITH l AS ({LINES}), g AS (SELECT DISTINCT flag FROM l), pr AS (SELECT a.flag AS group_a, b.flag AS group_b FROM g a JOIN g b ON a.flag < b.flag),
r AS (SELECT group_a, group_b, q AS value, flag = group_b AS is_alt FROM l JOIN pr ON flag IN (group_a, group_b)),
w AS ({rank_test_sql('SELECT * FROM r', 'group_a, group_b')}), d AS ({bh('SELECT * FROM w', 'pvalue', 'fdr')}) SELECT group_a, group_b, n_ref, n_alt, u, round(z, 6) AS z, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr FROM d""")
def _(spark, sf):
    return r6(S.pairwise_rank_test(brand_lines(spark, sf), "q", "flag"), "z", "pvalue", "fdr")


@query("two_group_test", f"""WITH r AS (SELECT 'all' AS feature, q AS value, flag = 'R' AS is_alt FROM ({LINES}) WHERE flag IN ('A', 'R')), w AS ({rank_test_sql('SELECT * FROM r', 'feature')})
SELECT 'Mann-Whitney U' AS method, n_ref, n_alt, round(pvalue, 6) AS pvalue FROM w""")
def _(spark, sf):
    return r6(S.two_group_test(brand_lines(spark, sf), "q", "flag", "A", "R"), "pvalue")


@query("anova_select", f"""WITH r AS (SELECT lm.feature, value, n_regionkey AS grp FROM ({PART_MATRIX}) lm JOIN supplier ON sample = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT feature, grp, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM r GROUP BY 1, 2), a AS (SELECT feature, sum(n) AS n, count(*) AS g, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c GROUP BY 1),
f AS (SELECT feature, CAST(g - 1 AS DOUBLE) AS d1, CAST(n - g AS DOUBLE) AS d2, ((b - s * s / n) / (g - 1)) / ((q - b) / (n - g)) AS f FROM a WHERE g > 1 AND n > g AND q - b > 0)
SELECT feature, d1 AS df_between, d2 AS df_within, round(f, 6) AS f, round({betainc('d2 / 2.0', 'd1 / 2.0', 'd2 / (d2 + d1 * f)', 800)}, 6) AS pvalue FROM f ORDER BY f.f DESC, feature LIMIT 50""")
def _(spark, sf):
    sup, nat = table(spark, sf, "supplier"), table(spark, sf, "nation")
    grp = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample"), F.col("n_regionkey").alias("grp"))
    return r6(S.anova_f(part_matrix(spark, sf).join(grp, "sample"), "grp", 50), "f", "pvalue")


GUIDES = f"""WITH lm AS ({PART_MATRIX}), g0 AS (SELECT feature, avg(CASE WHEN sample % 2 = 0 THEN value END) AS mt, avg(CASE WHEN sample % 2 = 1 THEN value END) AS mc FROM lm GROUP BY feature),
g AS (SELECT p_brand || '-' || CAST(p_size AS VARCHAR) AS gene, feature, round(log2((mt + 1) / (mc + 1)), 9) AS lfc FROM g0 JOIN part ON feature = p_partkey WHERE mt IS NOT NULL AND mc IS NOT NULL)"""


def guides(spark, sf):
    lfc = S.guide_lfc(part_matrix(spark, sf), F.col("sample") % 2 == 0, F.col("sample") % 2 == 1)
    pt = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"),
                                         F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("gene"))
    return lfc.join(pt, "feature").select("gene", "feature", F.round("lfc", 9).alias("lfc"))


@query("guide_lfc", f"{GUIDES} SELECT gene, feature, round(lfc, 6) AS lfc FROM g")
def _(spark, sf):
    return r6(guides(spark, sf), "lfc")


@query("gene_lfc_median", f"{GUIDES} SELECT gene, round(quantile_cont(lfc, 0.5), 6) AS lfc FROM g GROUP BY gene")
def _(spark, sf):
    return r6(S.gene_lfc(guides(spark, sf)), "lfc")


@query("gene_lfc_trimmed", f"""{GUIDES}, o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY lfc, feature) AS i, count(*) OVER (PARTITION BY gene) AS n FROM g)
SELECT gene, round(avg(lfc), 6) AS lfc FROM o WHERE i > floor(n / 5.0) AND i <= n + floor(-n / 5.0) GROUP BY gene""")
def _(spark, sf):
    return r6(S.gene_lfc(guides(spark, sf), "alphamedian"), "lfc")


TAIL = """least(1.0, list_sum(list_transform(range(CAST(i AS BIGINT), CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(k + 1.0) - lgamma(j + 1.0) - lgamma(k - j + 1.0)) * pow(r, j) * pow(1 - r, k - j))))"""
RRA = f"""{GUIDES}, n AS (SELECT gene, feature, rank() OVER (ORDER BY lfc) + (count(*) OVER (PARTITION BY lfc) - 1) / 2.0 AS ra,
rank() OVER (ORDER BY lfc DESC) + (count(*) OVER (PARTITION BY lfc) - 1) / 2.0 AS rd, count(*) OVER () AS total FROM g),
u AS (SELECT gene, feature, 'neg' AS arm, ra / total AS r FROM n UNION ALL SELECT gene, feature, 'pos', rd / total FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY gene, arm ORDER BY r, feature) AS i, count(*) OVER (PARTITION BY gene, arm) AS k FROM u),
s AS (SELECT gene, arm, max(k) AS num_sgrna, min({TAIL}) AS score FROM o GROUP BY gene, arm), d AS ({bh('SELECT * FROM s', 'score', 'fdr', 'arm')})"""


@query("rra_scores", f"{RRA} SELECT gene, arm, num_sgrna, round(score, 8) AS score, round(fdr, 8) AS fdr FROM d")
def _(spark, sf):
    out = S.rra_scores(guides(spark, sf))
    return out.withColumn("score", F.round("score", 8)).withColumn("fdr", F.round("fdr", 8))


@query("screen_hits", f"""{RRA} SELECT gene, arm, num_sgrna, round(score, 6) AS score FROM d WHERE gene IN (SELECT gene FROM d WHERE fdr < 0.95)""")
def _(spark, sf):
    return r6(S.screen_hits(S.rra_scores(guides(spark, sf)), 0.95).drop("fdr"), "score")


@query("group_quantiles", f"SELECT grp, " + ", ".join(f"round(quantile_cont(price, {q}), 4) AS q{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f" FROM ({LINES}) GROUP BY grp")
def _(spark, sf):
    probs = {f"q{int(q * 100)}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    out = exact_quantiles(brand_lines(spark, sf), ["grp"], "price", probs)
    return out.select("grp", *[F.round(c, 4).alias(c) for c in probs])


@query("differential_by_customer", f"""{DIFF_SQL.replace(PART_MATRIX, BRAND_MATRIX).replace(SUPPLIER_META, CUSTOMER_META)} SELECT feature, n_ref, n_alt, round(mean_ref, 6) AS mean_ref, round(mean_alt, 6) AS mean_alt,
round(delta, 6) AS delta, round(t, 6) AS t, round(df, 5) AS df FROM d""")
def _(spark, sf):
    """Flagship: matrix, log2 CPM, groups, Welch test, adjusted p, with every customer as a sample."""
    out = S.differential_test(M.cpm(brand_matrix(spark, sf), log2=True), customer_meta(spark, sf), "control")
    out = r6(out, "mean_ref", "mean_alt", "delta", "t").withColumn("df", F.round("df", 5))
    return out.select("feature", "n_ref", "n_alt", "mean_ref", "mean_alt", "delta", "t", "df")
