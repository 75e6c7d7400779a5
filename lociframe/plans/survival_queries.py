"""Queries for survival curves, tests, models and endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import survival as V
from lociframe.plans.inputs import ORDER_SURVIVAL, order_survival, table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query
from lociframe.plans.sqltext import betainc, norm_two_sided

KM = f"""WITH s AS ({ORDER_SURVIVAL}), t AS (SELECT grp, time, count(*) AS m, sum(event) AS d FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(m) OVER (PARTITION BY grp ORDER BY time DESC) AS n FROM t), e AS (SELECT * FROM r WHERE d > 0),
k AS (SELECT grp, time, n AS at_risk, d, sum(CASE WHEN n > d THEN ln(1 - d / n) ELSE 0 END) OVER w AS ls, sum(CASE WHEN n > d THEN 0 ELSE 1 END) OVER w AS z,
sum(coalesce(d / nullif(CAST(n AS DOUBLE) * (n - d), 0), 0)) OVER w AS g FROM e WINDOW w AS (PARTITION BY grp ORDER BY time)),
c AS (SELECT *, CASE WHEN z > 0 THEN 0.0 ELSE exp(ls) END AS surv FROM k)"""


@query("kaplan_meier", f"""{KM} SELECT grp, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS d, round(surv, 6) AS survival,
round(CASE WHEN surv > 0 THEN exp(-exp(ln(-ln(surv)) + 1.96 * sqrt(g) / abs(ln(surv)))) ELSE 0 END, 6) AS ci_lower,
round(CASE WHEN surv > 0 THEN exp(-exp(ln(-ln(surv)) - 1.96 * sqrt(g) / abs(ln(surv)))) ELSE 0 END, 6) AS ci_upper FROM c""")
def _(spark, sf):
    return r6(V.kaplan_meier(order_survival(spark, sf)), "survival", "ci_lower", "ci_upper")


@query("survival_summary", f"""{KM}, n AS (SELECT grp, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events FROM s GROUP BY 1), m AS (SELECT grp, min(time) AS med FROM c WHERE surv <= 0.5 + 1e-12 GROUP BY 1)
SELECT n.grp, n, n_events, coalesce(med, CAST('inf' AS DOUBLE)) AS median_survival FROM n LEFT JOIN m ON n.grp = m.grp""")
def _(spark, sf):
    return V.survival_summary(order_survival(spark, sf))


@query("at_risk_counts", f"WITH s AS ({ORDER_SURVIVAL}) SELECT grp, CAST(t AS DOUBLE) AS time, count(*) FILTER (WHERE s.time >= t) AS n_at_risk FROM s, (VALUES (0), (30), (60), (90), (120)) v(t) GROUP BY 1, 2")
def _(spark, sf):
    return V.at_risk_counts(order_survival(spark, sf), [0, 30, 60, 90, 120])


def terms(src: str, keys: str, group: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else ""
    cross = f"JOIN gs {using}" if keys else "CROSS JOIN gs"
    return f"""s AS ({src}), tt AS (SELECT {k}time, count(*) AS m, sum(event) AS d FROM s GROUP BY {k}time), rt AS (SELECT *, sum(m) OVER ({part} ORDER BY time DESC) AS n_t FROM tt),
gs AS (SELECT DISTINCT {k}{group} AS g FROM s), sp AS (SELECT rt.*, gs.g FROM rt {cross}), pg AS (SELECT {k}{group} AS g, time, count(*) AS m, sum(event) AS d FROM s GROUP BY {k}g, time),
j AS (SELECT {", ".join("sp." + x for x in keys.split(", ")) + ", " if keys else ""}sp.g, sp.time, sp.d AS d_t, n_t, coalesce(pg.m, 0) AS m_g, coalesce(pg.d, 0) AS d_g FROM sp LEFT JOIN pg ON {" AND ".join(f"sp.{x} = pg.{x}" for x in keys.split(", ")) + " AND " if keys else ""}sp.g = pg.g AND sp.time = pg.time),
q AS (SELECT *, sum(m_g) OVER (PARTITION BY {k}g ORDER BY time DESC) AS n_g FROM j), u AS (SELECT * FROM q WHERE d_t > 0)"""


@query("logrank_two", f"""WITH {terms(f"SELECT *, CASE WHEN price >= 250000 THEN 'High' ELSE 'Low' END AS lvl FROM ({ORDER_SURVIVAL})", "grp", "lvl")},
a AS (SELECT grp, sum(d_g) AS observed, sum(d_t * n_g / n_t) AS expected, sum(CAST(n_g AS DOUBLE) * (n_t - n_g) * d_t * (n_t - d_t) / (CAST(n_t AS DOUBLE) * n_t * (n_t - 1))) AS variance FROM u WHERE g = 'High' AND n_t > 1 GROUP BY grp),
c AS (SELECT *, CASE WHEN variance > 0 THEN (observed - expected) * (observed - expected) / variance ELSE 0 END AS chi2 FROM a)
SELECT grp, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(chi2, 6) AS chi2, round({norm_two_sided('sqrt(chi2)')}, 6) AS pvalue FROM c""")
def _(spark, sf):
    df = order_survival(spark, sf).withColumn("lvl", F.when(F.col("price") >= 250000, "High").otherwise("Low"))
    return r6(V.logrank_two(df, "lvl", "High", ["grp"]), "expected", "variance", "chi2", "pvalue")


@query("logrank_groups", f"""WITH {terms(ORDER_SURVIVAL, "", "grp")}, p AS (SELECT g, sum(d_g) AS o, sum(d_t * n_g / n_t) AS e FROM u GROUP BY g)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, count(*) - 1 AS df, round(exp(-sum((o - e) * (o - e) / e) / 2) * (1 + sum((o - e) * (o - e) / e) / 2), 6) AS pvalue FROM p""")
def _(spark, sf):
    return r6(V.logrank_groups(order_survival(spark, sf)), "chi2", "pvalue")


@query("weighted_logrank", f"""WITH {terms(ORDER_SURVIVAL, "", "grp")}, p AS (SELECT g, sum(n_g * d_g) AS o, sum(CAST(n_g AS DOUBLE) * d_t * n_g / n_t) AS e,
sum(CASE WHEN n_t > 1 THEN CAST(n_g AS DOUBLE) * n_g * d_t * (n_t - d_t) * n_g * (n_t - n_g) / (CAST(n_t AS DOUBLE) * n_t * (n_t - 1)) ELSE 0 END) AS v FROM u GROUP BY g),
x AS (SELECT sum((o - e) * (o - e)) / sum(v) AS st, count(*) - 1 AS df FROM p) SELECT round(st, 6) AS statistic, df, round(exp(-st / 2) * (1 + st / 2), 6) AS pvalue FROM x""")
def _(spark, sf):
    return r6(V.weighted_logrank(order_survival(spark, sf)), "statistic", "pvalue")


STRAT = f"""WITH s AS ({ORDER_SURVIVAL}), q AS (SELECT grp, quantile_cont(units, 0.25) AS a, quantile_cont(units, 0.5) AS b, quantile_cont(units, 0.75) AS c FROM s GROUP BY grp)"""


@query("stratify_quartile", f"{STRAT} SELECT id, CASE WHEN units >= c THEN 'High' WHEN units <= a THEN 'Low' END AS stratum FROM s JOIN q ON s.grp = q.grp")
def _(spark, sf):
    return V.stratify(order_survival(spark, sf), "units", "quartile", keys=["grp"]).select("id", "stratum")


@query("stratify_median", f"WITH s AS ({ORDER_SURVIVAL}) SELECT id, CASE WHEN price >= (SELECT quantile_cont(price, 0.5) FROM s) THEN 'High' ELSE 'Low' END AS stratum FROM s")
def _(spark, sf):
    return V.stratify(order_survival(spark, sf), "price").select("id", "stratum")


@query("stratify_custom", f"WITH s AS ({ORDER_SURVIVAL}) SELECT id, CASE WHEN price >= 200000 THEN 'High' ELSE 'Low' END AS stratum FROM s")
def _(spark, sf):
    return V.stratify(order_survival(spark, sf), "price", "custom", 200000.0).select("id", "stratum")


@query("cohort_survival", f"""WITH {terms(f"SELECT s.*, CASE WHEN units >= b THEN 'High' ELSE 'Low' END AS lvl FROM ({ORDER_SURVIVAL}) s JOIN (SELECT grp, quantile_cont(units, 0.5) AS b FROM ({ORDER_SURVIVAL}) GROUP BY grp) q ON s.grp = q.grp", "grp", "lvl")},
a AS (SELECT grp, sum(d_g) - sum(d_t * n_g / n_t) AS gap, sum(CAST(n_g AS DOUBLE) * (n_t - n_g) * d_t * (n_t - d_t) / (CAST(n_t AS DOUBLE) * n_t * (n_t - 1))) AS v FROM u WHERE g = 'High' AND n_t > 1 GROUP BY grp),
c AS (SELECT grp, CASE WHEN v > 0 THEN gap * gap / v ELSE 0 END AS chi2 FROM a),
n AS (SELECT grp, count(*) AS n, CAST(sum(CASE WHEN lvl = 'High' THEN event ELSE 0 END) AS BIGINT) AS high_events, CAST(sum(CASE WHEN lvl = 'Low' THEN event ELSE 0 END) AS BIGINT) AS low_events, avg(event) FILTER (WHERE lvl = 'High') AS hr, avg(event) FILTER (WHERE lvl = 'Low') AS lr FROM s GROUP BY grp)
SELECT n.grp, n, high_events, low_events, round(chi2, 6) AS chi2, round({norm_two_sided('sqrt(chi2)')}, 6) AS pvalue, CASE WHEN hr > lr THEN 'high worse' ELSE 'high better/equal' END AS direction FROM n JOIN c ON n.grp = c.grp""")
def _(spark, sf):
    return r6(V.cohort_survival(order_survival(spark, sf), "grp", "units"), "chi2", "pvalue")


@query("alteration_survival", f"""WITH o AS ({ORDER_SURVIVAL}), l AS (SELECT l_orderkey, max(CASE WHEN l_discount = 0.1 THEN 1 ELSE 0 END) AS mut FROM lineitem GROUP BY 1),
f AS (SELECT o.*, mut = 1 AS m, (id % 5) - 2 AS cn FROM o JOIN l ON id = l_orderkey), k AS (SELECT grp, time, event, 'mutation' AS kind, m AS alt FROM f UNION ALL SELECT grp, time, event, 'amplification', cn = 2 FROM f
UNION ALL SELECT grp, time, event, 'gain_or_amplification', cn >= 1 FROM f UNION ALL SELECT grp, time, event, 'deletion', cn <= -1 FROM f), {terms("SELECT *, CASE WHEN alt THEN 'Altered' ELSE 'Other' END AS side FROM k", "grp, kind", "side")},
a AS (SELECT grp, kind, sum(d_g) - sum(d_t * n_g / n_t) AS gap, sum(CAST(n_g AS DOUBLE) * (n_t - n_g) * d_t * (n_t - d_t) / (CAST(n_t AS DOUBLE) * n_t * (n_t - 1))) AS v FROM u WHERE g = 'Altered' AND n_t > 1 GROUP BY grp, kind),
c AS (SELECT grp, kind, CASE WHEN v > 0 THEN gap * gap / v ELSE 0 END AS chi2 FROM a), n AS (SELECT grp, kind, count(*) FILTER (WHERE alt) AS n_altered, count(*) FILTER (WHERE NOT alt) AS n_unaltered,
CAST(sum(CASE WHEN alt THEN event ELSE 0 END) AS BIGINT) AS altered_events, CAST(sum(CASE WHEN alt THEN 0 ELSE event END) AS BIGINT) AS unaltered_events FROM k GROUP BY grp, kind)
SELECT n.grp, n.kind, n_altered, n_unaltered, altered_events, unaltered_events, round({norm_two_sided('sqrt(chi2)')}, 6) AS pvalue,
CASE WHEN altered_events / n_altered > unaltered_events / n_unaltered THEN 'altered worse' ELSE 'altered better/equal' END AS direction FROM n JOIN c ON n.grp = c.grp AND n.kind = c.kind""")
def _(spark, sf):
    pats = order_survival(spark, sf).withColumnRenamed("id", "patient")
    mut = table(spark, sf, "lineitem").where("l_discount = 0.1").select(F.col("l_orderkey").alias("patient"))
    cn = pats.select("patient", (F.col("patient") % 5 - 2).alias("value"))
    return r6(V.alteration_survival(V.alteration_flags(pats, mut, cn), "grp"), "pvalue")


def covariates(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    df = order_survival(spark, sf).join(cust, F.col("custkey") == F.col("c_custkey"))
    return V.prepare_covariates(df, ["price", "units", "segment"], interactions=["price:units"])


@query("prepare_covariates", f"""WITH s AS ({ORDER_SURVIVAL}), j AS (SELECT s.*, c_mktsegment AS segment FROM s JOIN customer ON custkey = c_custkey),
z AS (SELECT id, segment, (price - avg(price) OVER ()) / (stddev_pop(price) OVER () + 1e-10) AS p, (units - avg(units) OVER ()) / (stddev_pop(units) OVER () + 1e-10) AS u FROM j)
SELECT id, round(p, 6) AS price_z, round(u, 6) AS units_z, CAST(CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS DOUBLE) AS segment_BUILDING, CAST(CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS DOUBLE) AS segment_FURNITURE,
CAST(CASE WHEN segment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS DOUBLE) AS segment_HOUSEHOLD, CAST(CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END AS DOUBLE) AS segment_MACHINERY, round(p * u, 6) AS interaction FROM z""")
def _(spark, sf):
    df, names = covariates(spark, sf)
    out = df.select("id", *[f"`{n}`" for n in names]).withColumnRenamed("price:units", "interaction")
    return r6(out, "price_z", "units_z", "interaction")


@query("complete_cases", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND o_totalprice IS NOT NULL")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return V.complete_cases(df, ["status", "o_totalprice"]).agg(F.count(F.lit(1)).alias("n"))


@query("cox_univariate")
def _(spark, sf):
    df, names = covariates(spark, sf)
    return r6(V.cox_univariate(df, names), "hr", "ci_lower", "ci_upper", "z", "pvalue")


@query("cox_multivariate")
def _(spark, sf):
    df, names = covariates(spark, sf)
    return r6(V.cox_multivariate(df, names), "hr", "ci_lower", "ci_upper", "z", "pvalue")


@query("cox_levels")
def _(spark, sf):
    return r6(V.cox_levels(order_survival(spark, sf), "id", ["custkey", "grp"]), "hr", "ci_lower", "ci_upper", "z", "pvalue")


# Given coefficients, so that SQL can follow, for all seven columns.
BETA = [0.2, -0.1, 0.05, -0.05, 0.1, 0.15, 0.02]
SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
DUMMIES = ", ".join(f"CASE WHEN c_mktsegment = '{x}' THEN 1.0 ELSE 0.0 END AS x{i + 2}" for i, x in enumerate(SEGMENTS))
COX = f"""WITH s AS ({ORDER_SURVIVAL}), z AS (SELECT id, time, event, (price - avg(price) OVER ()) / (stddev_pop(price) OVER () + 1e-10) AS x0, (units - avg(units) OVER ()) / (stddev_pop(units) OVER () + 1e-10) AS x1, {DUMMIES} FROM s JOIN customer ON custkey = c_custkey),
x AS (SELECT *, x0 * x1 AS x6 FROM z), lp AS (SELECT *, {' + '.join(f'({b}) * x{i}' for i, b in enumerate(BETA))} AS lp FROM x)"""


@query("risk_scores", f"{COX}, m AS (SELECT quantile_cont(lp, 0.5) AS m FROM lp) SELECT id, round(lp, 6) AS linear_predictor, CASE WHEN lp < m THEN 'low' ELSE 'high' END AS risk_group FROM lp, m")
def _(spark, sf):
    df, names = covariates(spark, sf)
    return r6(V.risk_scores(df, names, BETA).select("id", "linear_predictor", "risk_group"), "linear_predictor")


SEVEN = range(len(BETA))
NAMES = ["price_z", "units_z", *[f"segment_{x}" for x in SEGMENTS], "price:units"]


@query("schoenfeld_test", f"""{COX}, t AS (SELECT time, sum(exp(lp)) AS s0, {', '.join(f'sum(x{i} * exp(lp)) AS s1_{i}' for i in SEVEN)} FROM lp GROUP BY time),
c AS (SELECT time, {', '.join(f'sum(s1_{i}) OVER w / sum(s0) OVER w AS m{i}' for i in SEVEN)} FROM t WINDOW w AS (ORDER BY time DESC)),
l AS ({' UNION ALL '.join(f"SELECT '{n}' AS covariate, lp.time, round(x{i} - m{i}, 12) AS res FROM lp JOIN c ON lp.time = c.time WHERE event = 1" for i, n in enumerate(NAMES))}),
k AS (SELECT covariate, rank() OVER (PARTITION BY covariate ORDER BY res) + (count(*) OVER (PARTITION BY covariate, res) - 1) / 2.0 AS x, rank() OVER (PARTITION BY covariate ORDER BY time) + (count(*) OVER (PARTITION BY covariate, time) - 1) / 2.0 AS y FROM l),
r AS (SELECT covariate, corr(x, y) AS r, count(*) AS n FROM k GROUP BY covariate), q AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM r)
SELECT covariate, round(r, 5) AS correlation, n, round(greatest(0, 1 - {betainc('0.5', '(n - 2) / 2.0', '(t * t / (n - 2 + t * t))', 3000)}), 5) AS pvalue FROM q""")
def _(spark, sf):
    df, names = covariates(spark, sf)
    out = V.schoenfeld_test(df, names, BETA)
    return out.select("covariate", F.round("correlation", 5).alias("correlation"), "n", F.round("pvalue", 5).alias("pvalue"))


@query("overall_survival", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN 1 WHEN o_orderkey % 11 <> 0 THEN 0 END AS os_event,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN o_totalprice WHEN o_orderkey % 11 <> 0 THEN o_totalprice + 5 END AS os_time FROM orders""")
def _(spark, sf):
    return V.overall_survival(clinical(spark, sf)).select("o_orderkey", "os_event", "os_time")


def clinical(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Dead").otherwise("Alive").alias("vital_status"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("days_to_death"),
        F.when(k % 11 != 0, F.col("o_totalprice") + 5).alias("days_to_last_follow_up"),
        F.when(k % 13 == 0, F.col("o_totalprice") - 50).alias("days_to_new_tumor_event"),
        F.when(k % 17 == 0, F.col("o_totalprice") - 60).alias("days_to_recurrence"),
        F.when(k % 19 == 0, "Yes, Progression").alias("progression_or_recurrence"))


@query("disease_free_survival", """WITH c AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS dead, CASE WHEN k % 7 <> 0 THEN o_totalprice END AS dd, CASE WHEN k % 11 <> 0 THEN o_totalprice + 5 END AS fu, CASE WHEN k % 13 = 0 THEN o_totalprice - 50 END AS nt,
CASE WHEN k % 17 = 0 THEN o_totalprice - 60 END AS rc, k % 19 = 0 AS prog FROM orders), h AS (SELECT *, dead OR prog OR nt IS NOT NULL OR rc IS NOT NULL AS ev FROM c),
t AS (SELECT k, ev, CASE WHEN ev THEN coalesce(least(nt, rc, dd), fu) ELSE fu END AS dfs_time FROM h)
SELECT k AS o_orderkey, dfs_time, CASE WHEN dfs_time IS NOT NULL THEN CAST(ev AS INTEGER) END AS dfs_event FROM t""")
def _(spark, sf):
    return V.disease_free_survival(clinical(spark, sf)).select("o_orderkey", "dfs_time", "dfs_event")
