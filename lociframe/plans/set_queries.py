"""Queries for set overlap, enrichment, regulators and ranked-list enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.operators import sets as S
from lociframe.plans.inputs import SEGMENT_SETS, segment_sets, table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query
from lociframe.plans.sqltext import bh


def tail(a: str, n: str, k: str, t: str) -> str:
    """Hypergeometric upper tail through lgamma."""
    def ch(u: str, v: str) -> str:
        return f"lgamma({u} + 1.0) - lgamma({v} + 1.0) - lgamma(({u}) - ({v}) + 1.0)"
    return (f"CASE WHEN {a} <= 0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(range(CAST(greatest({a}, {n} + {k} - {t}) AS BIGINT), CAST(least({n}, {k}) AS BIGINT) + 1), "
            f"lambda i: exp({ch(k, 'i')} + {ch(f'({t} - {k})', f'({n} - i)')} - ({ch(t, n)})))), 0.0)) END")


OVERLAP = f"""WITH s AS ({SEGMENT_SETS}), z AS (SELECT set_id, count(*) AS size FROM s GROUP BY 1), bg AS (SELECT count(*) AS t FROM part),
p AS (SELECT a.set_id AS a, b.set_id AS b, a.size AS size_a, b.size AS size_b FROM z a JOIN z b ON a.set_id < b.set_id),
i AS (SELECT x.set_id AS a, y.set_id AS b, count(*) AS intersection FROM s x JOIN s y ON x.item = y.item AND x.set_id < y.set_id GROUP BY 1, 2),
o AS (SELECT p.*, coalesce(intersection, 0) AS intersection, t FROM p LEFT JOIN i ON p.a = i.a AND p.b = i.b, bg)"""


@query("pairwise_overlap", f"""{OVERLAP}, q AS (SELECT *, {tail('intersection', 'size_a', 'size_b', 't')} AS pvalue FROM o), d AS ({bh('SELECT * FROM q', 'pvalue', 'fdr')})
SELECT a, b, size_a, size_b, intersection, size_a + size_b - intersection AS "union", round(intersection / (size_a + size_b - intersection), 6) AS jaccard,
round(intersection / least(size_a, size_b), 6) AS overlap_coefficient, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr,
round(CASE WHEN size_a = intersection OR size_b = intersection THEN CASE WHEN intersection * (t - size_a - size_b + intersection) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END
ELSE intersection * (t - size_a - size_b + intersection) / CAST((size_a - intersection) * (size_b - intersection) AS DOUBLE) END, 6) AS odds_ratio FROM d""")
def _(spark, sf):
    bg = table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    out = S.pairwise_overlap(segment_sets(spark, sf), bg)
    return r6(out, "jaccard", "overlap_coefficient", "pvalue", "fdr", "odds_ratio")


@query("jaccard_matrix", f"""{OVERLAP}, j AS (SELECT a, b, intersection / (size_a + size_b - intersection) AS j FROM o)
SELECT a, b, round(j, 6) AS jaccard FROM j UNION ALL SELECT b, a, round(j, 6) FROM j UNION ALL SELECT set_id, set_id, 1.0 FROM z""")
def _(spark, sf):
    return r6(S.jaccard_matrix(segment_sets(spark, sf)), "jaccard")


@query("similar_sets", f"""{OVERLAP}, j AS (SELECT *, intersection / (size_a + size_b - intersection) AS j FROM o) SELECT a, b, size_a, size_b, intersection, round(j, 6) AS jaccard FROM j WHERE j >= 0.42""")
def _(spark, sf):
    return r6(S.similar_sets(segment_sets(spark, sf), 0.42), "jaccard")


@query("shared_members", f"""WITH s AS ({SEGMENT_SETS}) SELECT x.set_id AS a, y.set_id AS b, x.item FROM s x JOIN s y ON x.item = y.item AND y.set_id = x.set_id + 1""")
def _(spark, sf):
    sets = segment_sets(spark, sf)
    ids = sets.select(F.col("set_id").alias("a")).distinct()
    return S.set_members(sets, ids.withColumn("b", F.col("a") + 1))


STATUS_SETS = "SELECT DISTINCT l_returnflag || l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS set_id, l_partkey AS item FROM lineitem"


def status_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string")).alias("set_id"),
        F.col("l_partkey").alias("item")).distinct()


FLAG_SETS = "SELECT DISTINCT l_returnflag AS set_id, l_orderkey AS item FROM lineitem"


def flag_sets(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_orderkey").alias("item")).distinct()


@query("global_intersection", f"WITH s AS ({FLAG_SETS}) SELECT item FROM s GROUP BY item HAVING count(DISTINCT set_id) = (SELECT count(DISTINCT set_id) FROM s)")
def _(spark, sf):
    return S.global_intersection(flag_sets(spark, sf))


@query("unique_items", f"SELECT min(set_id) AS set_id, item FROM ({FLAG_SETS}) GROUP BY item HAVING count(DISTINCT set_id) = 1")
def _(spark, sf):
    return S.unique_items(flag_sets(spark, sf))


@query("membership_cells", f"""SELECT combination, count(*) AS count FROM (SELECT item, string_agg(set_id, ',' ORDER BY set_id) AS combination FROM ({FLAG_SETS}) GROUP BY item) GROUP BY 1""")
def _(spark, sf):
    out = S.membership_cells(flag_sets(spark, sf))
    return out.select(F.array_join("combination", ",").alias("combination"), "count")


ENRICH = f"""WITH lib AS ({STATUS_SETS}), qr AS (SELECT p_partkey AS item FROM part WHERE p_size <= 10), t AS (SELECT count(DISTINCT item) AS t FROM lib),
nq AS (SELECT count(*) AS n FROM qr WHERE item IN (SELECT item FROM lib)), z AS (SELECT set_id, count(*) AS size, count(*) FILTER (WHERE item IN (SELECT item FROM qr)) AS hits FROM lib GROUP BY 1 HAVING hits > 0),
q AS (SELECT z.*, n, t, {tail('hits', 'n', 'size', 't')} AS pvalue FROM z, nq, t), d AS ({bh('SELECT * FROM q', 'pvalue', 'fdr')})"""


def enrichment(spark, sf):
    q = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item"))
    return S.library_enrichment(q, status_sets(spark, sf))


@query("library_enrichment", f"""{ENRICH} SELECT set_id, size, hits, CAST(hits AS VARCHAR) || '/' || CAST(size AS VARCHAR) AS overlap, round(hits / size, 6) AS gene_ratio, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr,
round(CASE WHEN n = hits OR size = hits THEN CASE WHEN hits * (t - n - size + hits) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE hits * (t - n - size + hits) / CAST((n - hits) * (size - hits) AS DOUBLE) END, 6) AS odds_ratio FROM d""")
def _(spark, sf):
    return r6(enrichment(spark, sf), "gene_ratio", "pvalue", "fdr", "odds_ratio")


@query("enrichment_members", f"""WITH lib AS ({STATUS_SETS}) SELECT set_id, string_agg(CAST(item AS VARCHAR), ';' ORDER BY item) AS genes FROM lib WHERE item IN (SELECT p_partkey FROM part WHERE p_size <= 2) GROUP BY set_id""")
def _(spark, sf):
    q = table(spark, sf, "part").where("p_size <= 2").select(F.col("p_partkey").alias("item"))
    return S.enrichment_members(q, status_sets(spark, sf))


@query("clean_enrichment", f"""{ENRICH} SELECT set_id AS term_clean, hits AS hit_count, size AS bg_count, round(hits / size, 6) AS gene_ratio, round(-log10(greatest(fdr, 5e-324)), 5) AS minus_log10_fdr FROM d""")
def _(spark, sf):
    e = enrichment(spark, sf).withColumn("term", F.concat("set_id", F.lit(" (GO:0001234) ")))
    out = S.clean_enrichment(e.drop("gene_ratio"))
    return out.select("term_clean", F.col("hit_count").cast("long").alias("hit_count"), F.col("bg_count").cast("long").alias("bg_count"),
                      F.round("gene_ratio", 6).alias("gene_ratio"), F.round("minus_log10_fdr", 5).alias("minus_log10_fdr"))


@query("top_terms", f"""{ENRICH} SELECT set_id, round(fdr, 6) AS fdr FROM d WHERE fdr <= 0.05 OR (SELECT min(fdr) FROM d) > 0.05 ORDER BY round(d.fdr, 9), hits DESC, set_id LIMIT 10""")
def _(spark, sf):
    e = enrichment(spark, sf)
    out = S.top_terms(e, 0.05, 10, [F.round("fdr", 9), F.desc("hits"), F.col("set_id")])
    return r6(out.select("set_id", "fdr"), "fdr")


@query("regulator_merge", f"""WITH l AS (SELECT upper(p_type) AS tf, (p_size % 50 + 1) / 100.0 AS p, p_brand AS library, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
lists AS (SELECT tf, avg(p) AS mean_p, string_agg(DISTINCT library, ';' ORDER BY library) AS sources FROM l WHERE i <= 50 GROUP BY tf),
lib AS (SELECT DISTINCT upper(p_name) AS set_id, p_size AS item FROM part UNION SELECT DISTINCT upper(p_type), p_size FROM part), qr AS (SELECT DISTINCT p_size AS item FROM part WHERE p_retailprice > 950),
z AS (SELECT set_id AS tf, count(*) AS size, count(*) FILTER (WHERE item IN (SELECT item FROM qr)) AS hits FROM lib GROUP BY 1 HAVING hits > 0), n AS (SELECT count(*) AS n FROM qr),
e AS (SELECT tf, hits, size, n, {tail('hits', 'n', 'size', '1000')} AS rp FROM z, n),
m AS (SELECT coalesce(lists.tf, e.tf) AS tf, least(coalesce(mean_p, 1.0), coalesce(rp, 1.0)) AS pvalue, coalesce(hits, 0) AS overlap_count, coalesce(sources, '') AS sources, mean_p IS NOT NULL AS from_lists, rp IS NOT NULL AS from_regulons
FROM lists FULL JOIN e ON lists.tf = e.tf), d AS ({bh('SELECT * FROM m', 'pvalue', 'fdr')}) SELECT tf, round(pvalue, 6) AS pvalue, overlap_count, sources, from_lists, from_regulons, round(fdr, 6) AS fdr FROM d""")
def _(spark, sf):
    from pyspark.sql import Window as W

    part = table(spark, sf, "part")
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    best = part.withColumn("i", F.row_number().over(w)).where("i <= 50").groupBy(F.col("p_brand").alias("library")).agg(
        F.sort_array(F.collect_list(F.struct("i", F.col("p_type").alias("tf"), ((F.col("p_size") % 50 + 1) / 100.0).alias("p")))).alias("ranking"))
    lists = S.evidence_lists(best.select("library", F.transform("ranking", lambda r: F.struct(r["tf"].alias("tf"), r["p"].alias("p"))).alias("ranking")))
    regulons = part.select(F.upper("p_name").alias("tf"), F.col("p_size").alias("target")).unionByName(
        part.select(F.upper("p_type").alias("tf"), F.col("p_size").alias("target"))).distinct()
    q = part.where("p_retailprice > 950").select(F.col("p_size").alias("item"))
    out = S.merge_regulators(lists, regulons, q, 1000).drop("odds_ratio")
    return r6(out, "pvalue", "fdr")


RANKED = "SELECT l_partkey AS item, round(sum(l_quantity * (l_discount - 0.05)), 6) AS score FROM lineitem GROUP BY 1"


def ranked_parts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(
        F.round(F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05)), 6).alias("score"))


@query("dedup_by_abs", """SELECT l_partkey AS item, arg_max(s, [abs(s), s]) AS score FROM (SELECT l_partkey, round(l_quantity * (l_discount - 0.05), 6) AS s FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"),
                                             F.round(F.col("l_quantity") * (F.col("l_discount") - 0.05), 6).alias("score"))
    return S.dedup_by_abs(li)


PERMS = 1000


def es_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN max(up) >= -min(down) THEN max(up) ELSE min(down) END AS es, any_value(k) AS size FROM (SELECT {keys}, k, hit - (place - j) / (n - k) AS up, hit - share - (place - j) / (n - k) AS down FROM (
SELECT *, sum(share) OVER (PARTITION BY {keys} ORDER BY place) AS hit FROM (SELECT *, CASE WHEN aw > 0 THEN weight / aw ELSE 1.0 / k END AS share FROM (
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS j, sum(weight) OVER (PARTITION BY {keys}) AS aw, count(*) OVER (PARTITION BY {keys}) AS k FROM ({src}))))) GROUP BY {keys}"""


def beyond(side: str, op: str) -> str:
    """GSEA's q on one side of zero: share of the pooled null over the share of the sets."""
    return (f"least(1.0, (SELECT sum(w) FILTER (WHERE x {op} s.nes) / sum(w) FROM pool WHERE x {side} 0) / "
            f"((SELECT count(*) FILTER (WHERE t.nes {op} s.nes) / count(*) FROM s t WHERE t.nes {side} 0)))")


GSEA = f"""WITH r AS ({RANKED}), b AS (SELECT item, abs(score) AS weight, row_number() OVER (ORDER BY score DESC, item) AS place, count(*) OVER () AS n FROM r),
lib AS (SELECT p_name || '/' || p_brand AS set_id, p_partkey AS item FROM part WHERE p_partkey IN (SELECT item FROM b)), ok AS (SELECT set_id FROM lib GROUP BY 1 HAVING count(*) BETWEEN 3 AND 500),
m AS (SELECT * FROM lib WHERE set_id IN (SELECT set_id FROM ok)), o AS ({es_sql('SELECT set_id, place, weight, n FROM m JOIN b ON m.item = b.item', 'set_id')}),
kz AS (SELECT max(size) AS k, (SELECT max(n) FROM b) AS n FROM o), sq AS (SELECT n, k, unnest(range(1, 2 * k + 65)) AS j FROM kz),
dr AS (SELECT draw, k, place, min(j) AS j FROM (SELECT t.draw, k, j, CAST('0x' || substr(md5('123:' || CAST(t.draw AS VARCHAR) || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) % n + 1 AS place FROM range(1, {PERMS + 1}) t(draw), sq) GROUP BY ALL),
dj AS (SELECT draw, place, row_number() OVER (PARTITION BY draw ORDER BY j) AS i FROM dr QUALIFY i <= k),
u AS ({es_sql('SELECT z.size AS z, draw, dj.place, weight, n FROM (SELECT DISTINCT size FROM o) z JOIN dj ON dj.i <= z.size JOIN b ON b.place = dj.place', 'z, draw')}),
mz AS (SELECT size, avg(es) FILTER (WHERE es >= 0) AS up, avg(-es) FILTER (WHERE es < 0) AS down, count(*) FILTER (WHERE es >= 0) AS n_up, count(*) FILTER (WHERE es < 0) AS n_down FROM u GROUP BY 1),
s AS (SELECT o.set_id, o.size, o.es, coalesce(o.es / CASE WHEN o.es >= 0 THEN up ELSE down END, 0) AS nes,
coalesce((SELECT count(*) FROM u WHERE u.size = o.size AND (u.es >= 0) = (o.es >= 0) AND abs(u.es) >= abs(o.es)) / nullif(CASE WHEN o.es >= 0 THEN n_up ELSE n_down END, 0), 1) AS pvalue FROM o JOIN mz ON o.size = mz.size),
w AS (SELECT size, count(*) AS w FROM o GROUP BY 1), pool AS (SELECT coalesce(u.es / CASE WHEN u.es >= 0 THEN up ELSE down END, 0) AS x, w FROM u JOIN mz ON u.size = mz.size JOIN w ON w.size = u.size),
d AS (SELECT *, CASE WHEN nes >= 0 THEN {beyond('>=', '>=')} ELSE {beyond('<', '<=')} END AS fdr FROM s)"""


def gsea(spark, sf):
    lib = table(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("set_id"), F.col("p_partkey").alias("item"))
    return S.preranked_enrichment(ranked_parts(spark, sf), lib, PERMS, 3, 500)


@query("preranked_enrichment", f"{GSEA} SELECT set_id, CAST(size AS INTEGER) AS size, round(es, 6) AS es, round(nes, 6) AS nes, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr, CASE WHEN nes >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM d")
def _(spark, sf):
    return r6(gsea(spark, sf).drop("minus_log10_fdr"), "es", "nes", "pvalue", "fdr")


@query("top_terms_by_direction", f"""{GSEA}, f AS (SELECT set_id, round(nes, 6) AS nes, round(fdr, 6) AS fdr FROM d), g AS (SELECT * FROM f WHERE fdr <= 0.2 OR (SELECT min(fdr) FROM f) > 0.2)
(SELECT * FROM g WHERE nes > 0 ORDER BY fdr, nes DESC, set_id LIMIT 10) UNION ALL (SELECT * FROM g WHERE nes < 0 ORDER BY fdr, nes, set_id LIMIT 10)""")
def _(spark, sf):
    e = r6(gsea(spark, sf).select("set_id", "nes", "fdr"), "nes", "fdr")
    return S.top_terms_by_direction(e, 0.2, 10)
