"""Queries for interval joins, peak annotation and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import intervals as I
from lociframe.plans.inputs import EVENT_INTERVALS, event_intervals, event_second, table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query

E = f"WITH e AS ({EVENT_INTERVALS})"
OV = 'least(a."end", b."end") - greatest(a."start", b."start")'
HALF = f'({OV}) / (a."end" - a."start") > 0.5'
TOUCH = 'a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"'
ROW = 'chrom, "start", "end", name, score, cond'


@query("interval_overlap", f"""{E} SELECT a.name AS left_name, b.name AS right_name, {OV} AS overlap FROM e a JOIN e b ON {TOUCH} AND {HALF} WHERE a.cond = 'click' AND b.cond = 'view'""")
def _(spark, sf):
    ev = event_intervals(spark, sf)
    out = I.overlap_join(ev.where("cond = 'click'"), ev.where("cond = 'view'"), F.expr(I.OVER_HALF_OF_LEFT))
    return out.select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), "overlap")


@query("interval_semi", f"""{E} SELECT {ROW} FROM e a WHERE cond = 'click' AND EXISTS (SELECT 1 FROM e b WHERE b.cond = 'view' AND {TOUCH} AND {HALF})""")
def _(spark, sf):
    ev = event_intervals(spark, sf)
    return I.interval_semi(ev.where("cond = 'click'"), ev.where("cond = 'view'"))


@query("interval_anti", f"""{E} SELECT {ROW} FROM e a WHERE cond = 'click' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.cond = 'view' AND {TOUCH} AND {HALF})""")
def _(spark, sf):
    ev = event_intervals(spark, sf)
    return I.interval_anti(ev.where("cond = 'click'"), ev.where("cond = 'view'"))


@query("unique_peaks", f"""{E} SELECT {ROW} FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.cond <> a.cond AND {TOUCH} AND {HALF})""")
def _(spark, sf):
    return I.unique_peaks(event_intervals(spark, sf))


# Users in two groups, so that some clicks do match an event of every other type.
GROUPED = EVENT_INTERVALS.replace("user_id AS chrom", "user_id % 2 AS chrom")


@query("shared_peaks", f"""WITH e AS ({GROUPED}), h AS (SELECT a.name FROM e a JOIN e b ON {TOUCH} AND {HALF} WHERE a.cond = 'click' AND b.cond <> 'click' GROUP BY 1
HAVING count(DISTINCT b.cond) = (SELECT count(DISTINCT cond) - 1 FROM e)) SELECT {ROW} FROM e WHERE cond = 'click' AND name IN (SELECT name FROM h)""")
def _(spark, sf):
    return I.shared_peaks(event_intervals(spark, sf).withColumn("chrom", F.col("chrom") % 2), "click")


@query("peak_similarity", f"""{E}, h AS (SELECT DISTINCT a.name, a.cond, b.cond AS other FROM e a JOIN e b ON {TOUCH} AND a.cond <> b.cond AND ({OV}) / least(a."end" - a."start", b."end" - b."start") >= 0.5),
m AS (SELECT cond, other, count(*) AS matched FROM h GROUP BY 1, 2), n AS (SELECT cond, count(*) AS n FROM e GROUP BY 1)
SELECT x.cond, y.cond AS other, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / (x.n + y.n - coalesce(matched, 0)), 6) AS similarity FROM n x JOIN n y ON x.cond <> y.cond LEFT JOIN m ON m.cond = x.cond AND m.other = y.cond""")
def _(spark, sf):
    return r6(I.peak_similarity(event_intervals(spark, sf)), "similarity")


@query("filter_peaks", f"{E} SELECT {ROW} FROM e WHERE score >= 50 ORDER BY score DESC, name LIMIT 500")
def _(spark, sf):
    return I.filter_peaks(event_intervals(spark, sf), 50, 500)


@query("peak_qc", f"""{E}, w AS (SELECT *, "end" - "start" AS width FROM e) SELECT count(*) AS total_peaks, CAST(floor(avg(width)) AS BIGINT) AS mean_peak_width, min(width) AS min_peak_width, max(width) AS max_peak_width,
round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, CAST(floor(quantile_cont(width, 0.5)) AS BIGINT) AS median_peak_width, round(quantile_cont(score, 0.5), 6) AS median_score FROM w""")
def _(spark, sf):
    return r6(I.peak_qc(event_intervals(spark, sf)), "mean_score", "std_score", "median_score")


GENES = """SELECT user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS "start", CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) + 1 AS "end", event_id AS gene, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM events WHERE event_type = 'purchase'"""


def genes(spark, sf):
    ev = table(spark, sf, "events").where("event_type = 'purchase'")
    s = event_second()
    return ev.select(F.col("user_id").alias("chrom"), s.alias("start"), (s + F.floor(F.col("value") * 600) + 1).alias("end"),
                     F.col("event_id").alias("gene"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("strand"))


ANNOT = f"""{E}, g AS ({GENES}), p AS (SELECT * FROM e WHERE cond <> 'purchase'),
j AS (SELECT p.name, abs(CAST(floor((p."start" + p."end") / 2.0) AS BIGINT) - CASE WHEN strand = 1 THEN g."start" ELSE g."end" END) AS dist, gene, g."start" AS gs, g."end" AS ge FROM p JOIN g ON p.chrom = g.chrom AND p."start" - 10000 < g."end" + 1 AND g."start" < p."end" + 10000),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, gene) AS i FROM j) WHERE i = 1),
a AS (SELECT p.name, CASE WHEN dist IS NULL THEN 'intergenic' WHEN dist <= 2000 THEN 'promoter' WHEN "start" BETWEEN gs AND ge OR "end" BETWEEN gs AND ge THEN 'exonic' WHEN "start" < gs AND "end" > ge THEN 'intronic' ELSE 'intergenic' END AS annotation,
coalesce(CAST(gene AS VARCHAR), '.') AS nearest_gene, coalesce(dist, -1) AS distance_to_tss FROM p LEFT JOIN n ON p.name = n.name)"""


def annotated(spark, sf):
    return I.annotate_peaks(event_intervals(spark, sf).where("cond <> 'purchase'"), genes(spark, sf))


@query("annotate_peaks", f"{ANNOT} SELECT name, annotation, nearest_gene, distance_to_tss FROM a")
def _(spark, sf):
    return annotated(spark, sf).select("name", "annotation", "nearest_gene", "distance_to_tss")


@query("annotation_counts", f"{ANNOT} SELECT annotation, count(*) AS count FROM a GROUP BY 1")
def _(spark, sf):
    return annotated(spark, sf).groupBy("annotation").agg(F.count(F.lit(1)).alias("count"))


@query("promoter_share", f"{ANNOT} SELECT count(*) FILTER (WHERE annotation = 'promoter') AS promoter_peaks, round(avg(CASE WHEN annotation = 'promoter' THEN 1 ELSE 0 END), 6) AS tss_enrichment FROM a")
def _(spark, sf):
    return r6(I.promoter_share(annotated(spark, sf)), "tss_enrichment")


@query("build_regions", f"""{E}, p AS (SELECT chrom, "start" AS pos, score / 100 AS delta, score / 1000 AS fdr FROM e), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 7200 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS region FROM f)
SELECT chrom, min(pos) AS "start", max(pos) AS "end", count(*) AS n_sites, round(avg(delta), 6) AS mean_delta, round(avg(fdr), 6) AS mean_fdr FROM r GROUP BY chrom, region HAVING count(*) >= 3""")
def _(spark, sf):
    sites = event_intervals(spark, sf).select("chrom", F.col("start").alias("pos"), (F.col("score") / 100).alias("delta"), (F.col("score") / 1000).alias("fdr"))
    return r6(I.build_regions(sites, 7200), "mean_delta", "mean_fdr")
