"""Queries for correlation screens and matrices, distances, regression and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import correlate as C
from lociframe.operators import matrix as M
from lociframe.plans.inputs import (
    KIND_MATRIX,
    NATION_MATRIX,
    PART_MATRIX,
    kind_matrix,
    nation_matrix,
    part_matrix,
    table,
)
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query
from lociframe.plans.sqltext import bh, midrank, t_two_sided


def target(spark, sf):
    """Supplier balance as the query vector."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("y"))


VARIES = "feature IN (SELECT feature FROM lm GROUP BY feature HAVING var_samp(value) > 0.01)"
PAIRS = f"WITH lm AS ({KIND_MATRIX}), p AS (SELECT feature, value, s_acctbal AS y FROM lm JOIN supplier ON sample = s_suppkey WHERE {VARIES})"
R_P = f"CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {t_two_sided('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2.0)', 400)} END"


@query("correlate_pearson", f"""{PAIRS}, s AS (SELECT feature, corr(value, y) AS r, count(*) AS n FROM p GROUP BY feature HAVING count(*) >= 10 AND stddev_pop(value) >= 0.01),
q AS (SELECT *, {R_P} AS pvalue FROM s), d AS ({bh('SELECT * FROM q', 'pvalue', 'fdr')}) SELECT feature, round(r, 6) AS r, n, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr FROM d""")
def _(spark, sf):
    out = C.correlate_with(kind_matrix(spark, sf), target(spark, sf)).select("feature", "r", "n", "pvalue", "fdr")
    return r6(out, "r", "pvalue", "fdr")


@query("correlate_spearman", f"""{PAIRS}, k AS (SELECT feature, {midrank('feature', 'value')} AS value, {midrank('feature', 'y')} AS y, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM p),
s AS (SELECT feature, corr(value, y) AS r, count(*) AS n FROM k WHERE sd >= 0.01 GROUP BY feature HAVING count(*) >= 30) SELECT feature, round(r, 6) AS r, n, round({R_P}, 6) AS pvalue FROM s""")
def _(spark, sf):
    out = C.correlate_with(kind_matrix(spark, sf), target(spark, sf), "spearman", min_pairs=30)
    return r6(out.select("feature", "r", "n", "pvalue"), "r", "pvalue")


@query("comoment_correlation", f"""WITH lm AS ({PART_MATRIX}), s AS (SELECT feature, count(*) AS n, corr(value, s_acctbal) AS r FROM lm JOIN supplier ON sample = s_suppkey GROUP BY feature)
SELECT feature, n, round(CASE WHEN n < 3 THEN 0.0 ELSE greatest(-1.0, least(1.0, r)) END, 6) AS r FROM s""")
def _(spark, sf):
    m = C.comoments(part_matrix(spark, sf), target(spark, sf))
    r = C.pearson_from_sums(*[F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    return m.select("feature", "n", F.round(r, 6).alias("r"))


def corr_sql(src: str) -> str:
    return f"""WITH lm AS ({src}), j AS (SELECT a.sample AS a, b.sample AS b, a.value AS x, b.value AS y FROM lm a JOIN lm b ON a.feature = b.feature AND a.sample < b.sample)"""


@query("correlation_matrix", f"{corr_sql(NATION_MATRIX)} SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS r FROM j GROUP BY a, b")
def _(spark, sf):
    return r6(C.correlation_matrix(nation_matrix(spark, sf)), "r")


@query("correlation_matrix_spearman", f"""{corr_sql(f"SELECT feature, sample, {midrank('sample', 'value')} AS value FROM ({NATION_MATRIX})")} SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS r FROM j GROUP BY a, b""")
def _(spark, sf):
    return r6(C.correlation_matrix(nation_matrix(spark, sf), "spearman"), "r")


@query("distance_euclidean", f"{corr_sql(NATION_MATRIX)} SELECT a, b, round(sqrt(sum((x - y) * (x - y))), 6) AS distance FROM j GROUP BY a, b")
def _(spark, sf):
    return r6(C.pairwise_distance(nation_matrix(spark, sf)), "distance")


@query("distance_cosine", f"{corr_sql(NATION_MATRIX)} SELECT a, b, round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS distance FROM j GROUP BY a, b")
def _(spark, sf):
    return r6(C.pairwise_distance(nation_matrix(spark, sf), "cosine"), "distance")


@query("distance_correlation", f"{corr_sql(NATION_MATRIX)} SELECT a, b, round(1 - corr(x, y), 6) AS distance FROM j GROUP BY a, b")
def _(spark, sf):
    return r6(C.pairwise_distance(nation_matrix(spark, sf), "correlation"), "distance")


@query("impute_knn", f"""WITH lm AS ({KIND_MATRIX.replace('l_suppkey AS sample', 'l_suppkey % 40 AS sample')}), grid AS (SELECT f.feature, s.sample, lm.value FROM (SELECT DISTINCT feature FROM lm) f CROSS JOIN (SELECT DISTINCT sample FROM lm) s LEFT JOIN lm ON lm.feature = f.feature AND lm.sample = s.sample),
j AS (SELECT a.feature AS a, b.feature AS b, a.value AS x, b.value AS y FROM lm a JOIN lm b ON a.sample = b.sample AND a.feature <> b.feature WHERE a.feature IN (SELECT feature FROM grid WHERE value IS NULL)),
d AS (SELECT a, b, round(1 - corr(x, y), 9) AS d FROM j GROUP BY a, b HAVING count(*) >= 2 AND var_pop(x) * count(*) * count(*) > 1e-9 AND var_pop(y) * count(*) * count(*) > 1e-9),
n AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM d) WHERE i <= 5),
f AS (SELECT g.feature, g.sample, avg(lm.value) AS fill FROM grid g JOIN n ON n.a = g.feature JOIN lm ON lm.feature = n.b AND lm.sample = g.sample WHERE g.value IS NULL GROUP BY 1, 2)
SELECT grid.feature, grid.sample, round(coalesce(value, fill), 6) AS value FROM grid LEFT JOIN f ON f.feature = grid.feature AND f.sample = grid.sample""")
def _(spark, sf):
    lm = kind_matrix(spark, sf).groupBy("feature", (F.col("sample") % 40).alias("sample")).agg(F.sum("value").alias("value"))
    return r6(C.impute_knn(M.complete_grid(lm)), "value")


SCREEN = f"""{PAIRS}, s AS (SELECT feature, round(corr(value, y), 9) AS r, count(*) AS n FROM p GROUP BY feature HAVING count(*) >= 10 AND stddev_pop(value) >= 0.01)"""


def screen(spark, sf):
    return C.correlate_with(kind_matrix(spark, sf), target(spark, sf)).select("feature", F.round("r", 9).alias("r"))


@query("top_both_signs", f"""{SCREEN}, pos AS (SELECT feature, r, row_number() OVER (ORDER BY r DESC, feature) AS i, count(*) OVER () AS n FROM s WHERE r > 0),
neg AS (SELECT feature, r, row_number() OVER (ORDER BY r, feature) AS i, count(*) OVER () AS n FROM s WHERE r < 0)
SELECT feature, r FROM pos WHERE i <= 20 UNION ALL SELECT feature, r FROM neg WHERE i <= 20""")
def _(spark, sf):
    return C.top_both_signs(screen(spark, sf), 40)


@query("similarity_edges", f"""{SCREEN}, t AS (SELECT feature, r FROM s ORDER BY abs(r) DESC, feature LIMIT 60)
SELECT a.feature AS src, b.feature AS dst, round(1 - abs(a.r - b.r), 6) AS weight FROM t a JOIN t b ON a.feature < b.feature AND abs(a.r - b.r) < 0.3""")
def _(spark, sf):
    return r6(C.similarity_edges(screen(spark, sf), 60), "weight")


@query("linear_fit", """WITH s AS (SELECT l_returnflag AS flag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_quantity, l_extendedprice) AS r,
regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY 1)
SELECT flag, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 6) AS se, round(slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 3) AS t FROM s""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = C.linear_fit(li, "l_quantity", "l_extendedprice", ["flag"])
    return out.select("flag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r", 6).alias("r"), F.round("se", 6).alias("se"), F.round("t", 3).alias("t"))


@query("fit_line_grid", """WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT CAST(i AS INTEGER) AS i, round(lo + (hi - lo) * i / 99, 6) AS x, round(a + b * (lo + (hi - lo) * i / 99), 3) AS fit FROM s, range(0, 100) t(i)""")
def _(spark, sf):
    out = C.fit_line_grid(C.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))
    return out.select("i", F.round("x", 6).alias("x"), F.round("fit", 3).alias("fit"))


@query("loess_curve", """WITH p AS (SELECT l_quantity AS px, count(*) AS c, sum(l_discount * 100) AS sy FROM lineitem GROUP BY 1), s AS (SELECT min(px) AS lo, max(px) AS hi, sum(c) AS n FROM p),
g AS (SELECT i, lo + (hi - lo) * i / 99 AS x, greatest(3, floor(n * 0.3)) AS k FROM s, range(0, 100) t(i)),
d AS (SELECT i, x, k, px, c, sy, abs(px - x) AS d FROM g, p), m AS (SELECT i, d, sum(sum(c)) OVER (PARTITION BY i ORDER BY d) AS cum, any_value(k) AS k FROM d GROUP BY i, d),
h AS (SELECT i, min(d) AS h FROM m WHERE cum >= k GROUP BY i), w AS (SELECT d.i, d.x, c, px - x AS px, sy, pow(1 - pow(CASE WHEN h > 0 THEN d / h ELSE 0 END, 3), 3) AS w FROM d JOIN h ON d.i = h.i WHERE d <= h),
q AS (SELECT i, x, sum(w * c) AS sw, sum(w * c * px) AS swx, sum(w * sy) AS swy, sum(w * c * px * px) AS swxx, sum(w * px * sy) AS swxy FROM w GROUP BY i, x)
SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, round((swxx * swy - swx * swxy) / (sw * swxx - swx * swx), 5) AS fit FROM q""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("disc", F.col("l_discount") * 100)
    out = C.loess(li, "l_quantity", "disc", 0.3, 100)
    return out.select("i", F.round("x", 6).alias("x"), F.round("fit", 5).alias("fit"))
