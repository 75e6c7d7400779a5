"""Queries for mutations, lineages, manifests and annotation records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import text as T
from lociframe.operators import annotate as A
from lociframe.plans.inputs import table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query

CONS = ["missense_variant", "stop_gained", "Silent", "frame_shift_del", "odd_name", "Splice_Region"]
M = f"""WITH m AS (SELECT l_orderkey, 'TCGA-' || p_brand AS project, l_suppkey AS model, [list_extract({CONS}, CAST(l_partkey % 6 + 1 AS BIGINT)), list_extract({CONS}, CAST(l_suppkey % 6 + 1 AS BIGINT))] AS ct,
'p.V' || CAST(l_partkey % 300 + 1 AS VARCHAR) || list_extract(['E', 'K', '*'], CAST(l_linenumber % 3 + 1 AS BIGINT)) AS aa, l_partkey % 300 + 1 AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, list_transform(ct, lambda x: CASE x WHEN 'missense_variant' THEN 'Missense_Mutation' WHEN 'stop_gained' THEN 'Nonsense_Mutation' WHEN 'frame_shift_del' THEN 'Frameshift' WHEN 'Splice_Region' THEN 'Splice_Site' ELSE x END) AS nt FROM m),
c AS (SELECT *, CASE WHEN r1 <= r2 THEN nt[1] ELSE nt[2] END AS type FROM (SELECT *, CASE nt[1] WHEN 'Nonsense_Mutation' THEN 1 WHEN 'Frameshift' THEN 2 WHEN 'Splice_Site' THEN 3 WHEN 'Missense_Mutation' THEN 4 WHEN 'Silent' THEN 8 ELSE 90 END AS r1,
CASE nt[2] WHEN 'Nonsense_Mutation' THEN 1 WHEN 'Frameshift' THEN 2 WHEN 'Splice_Site' THEN 3 WHEN 'Missense_Mutation' THEN 4 WHEN 'Silent' THEN 8 ELSE 90 END AS r2 FROM n))"""


def mutations(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    names = F.array(*[F.lit(c) for c in CONS])
    alt = F.get(F.array(*[F.lit(c) for c in "EK*"]), F.col("l_linenumber") % 3)
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("TCGA-"), "p_brand").alias("project"), F.col("l_suppkey").alias("model"),
        F.array(F.get(names, (F.col("l_partkey") % 6).cast("int")), F.get(names, (F.col("l_suppkey") % 6).cast("int"))).alias("consequence_types"),
        F.array(F.concat(F.lit("p.V"), (F.col("l_partkey") % 300 + 1).cast("string"), alt)).alias("aa_changes"))


@query("mutation_types", f"{M} SELECT type, count(*) AS count FROM c GROUP BY 1")
def _(spark, sf):
    return A.type_counts(mutations(spark, sf))


@query("mutation_hotspots", f"{M} SELECT pos AS position, count(*) AS count, string_agg(DISTINCT substr(aa, 3), ';' ORDER BY substr(aa, 3)) AS aa_changes, string_agg(DISTINCT type, ';' ORDER BY type) AS types FROM c WHERE type IN ('Missense_Mutation', 'Nonsense_Mutation') GROUP BY 1")
def _(spark, sf):
    return A.mutation_hotspots(mutations(spark, sf), ["Missense_Mutation", "Nonsense_Mutation"])


@query("mutation_frequency", f"""{M}, t AS (SELECT pos, count(*) AS total FROM c GROUP BY 1), s AS (SELECT DISTINCT project, pos FROM c), k AS (SELECT project, s.pos, row_number() OVER (PARTITION BY project ORDER BY total DESC, s.pos) AS i FROM s JOIN t ON s.pos = t.pos),
h AS (SELECT project, string_agg(CAST(pos AS VARCHAR), ';' ORDER BY i) AS top_hotspots FROM k WHERE i <= 5 GROUP BY 1), pf AS (SELECT 'TCGA-' || p_brand AS project, count(*) * 40 AS n_profiled FROM part GROUP BY 1)
SELECT substr(c.project, 6) AS cancer_type, count(*) AS n_mutations, any_value(n_profiled) AS n_profiled, round(count(*) / any_value(n_profiled), 4) AS frequency, any_value(top_hotspots) AS top_hotspots FROM c JOIN pf ON pf.project = c.project JOIN h ON h.project = c.project GROUP BY c.project""")
def _(spark, sf):
    prof = table(spark, sf, "part").groupBy(F.concat(F.lit("TCGA-"), "p_brand").alias("project")).agg((F.count(F.lit(1)) * 40).alias("n_profiled"))
    return A.mutation_frequency(mutations(spark, sf), prof)


@query("aa_change_parse", f"{M} SELECT DISTINCT aa AS raw, substr(aa, 3) AS aa_change, pos AS position FROM m")
def _(spark, sf):
    return mutations(spark, sf).select(F.explode("aa_changes").alias("raw")).distinct().select("raw", A.aa_change(F.col("raw")).alias("h")).select(
        "raw", "h.aa_change", "h.position")


@query("distinct_models", f"{M} SELECT count(*) AS records, count(DISTINCT model) AS models FROM m")
def _(spark, sf):
    return A.distinct_models(mutations(spark, sf))


CN = "SELECT c_custkey AS model, (c_acctbal - 4500) / 2000 AS cn, c_acctbal / 1000 AS expr, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS lineage FROM customer"


def models(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("model"), ((b - 4500) / 2000).alias("cn"), (b / 1000).alias("expr"))


def model_meta(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("lineage"), F.col("c_name").alias("cell_line"))


@query("copy_number_class", f"SELECT CASE WHEN cn >= 1 THEN 'amplified' WHEN cn <= -1 THEN 'deleted' ELSE 'neutral' END AS status, count(*) AS count FROM ({CN}) GROUP BY 1")
def _(spark, sf):
    return models(spark, sf).groupBy(A.copy_number_class(F.col("cn")).alias("status")).agg(F.count(F.lit(1)).alias("count"))


@query("top_and_bottom", f"WITH m AS ({CN}) (SELECT model, round(cn, 6) AS cn, 'top' AS \"end\" FROM m ORDER BY m.cn DESC, model LIMIT 20) UNION ALL (SELECT model, round(cn, 6), 'bottom' FROM m ORDER BY m.cn, model LIMIT 20)")
def _(spark, sf):
    return r6(A.top_and_bottom(models(spark, sf).select("model", "cn"), "cn", "model", 20), "cn")


@query("join_models", f"SELECT model, coalesce(lineage, 'Unknown') AS lineage, CASE WHEN lineage IS NULL THEN CAST(model AS VARCHAR) ELSE c_name END AS cell_line FROM ({CN}) JOIN customer ON c_custkey = model")
def _(spark, sf):
    return A.join_models(models(spark, sf), model_meta(spark, sf)).select("model", "lineage", "cell_line")


@query("lineage_appendix", f"""WITH m AS (SELECT model, coalesce(lineage, 'Unknown') AS lineage, expr, cn FROM ({CN})), x AS (SELECT DISTINCT o_custkey AS model FROM orders WHERE o_orderstatus = 'P')
SELECT lineage, count(expr) AS n, round(quantile_cont(expr, 0.5), 6) AS median_expr, round(quantile_cont(cn, 0.5), 6) AS median_cn, count(*) FILTER (WHERE model IN (SELECT model FROM x)) AS mutated_models FROM m GROUP BY 1 HAVING count(expr) >= 3""")
def _(spark, sf):
    m = A.join_models(models(spark, sf), model_meta(spark, sf))
    mut = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("model"))
    return r6(A.lineage_appendix(m.select("model", "lineage", "expr", "cn"), mut), "median_expr", "median_cn")


@query("top_share_counts", f"WITH m AS ({CN}) SELECT coalesce(lineage, 'Unknown') AS lineage, count(*) AS count FROM m WHERE cn >= (SELECT quantile_cont(cn, 0.95) FROM m) GROUP BY 1")
def _(spark, sf):
    return A.top_share_counts(A.join_models(models(spark, sf), model_meta(spark, sf)), "cn")


@query("disjoint_groups", """WITH t AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderpriority = '1-URGENT'), n AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 300000)
SELECT case_id, 'Tumor' AS "group" FROM t WHERE case_id NOT IN (SELECT case_id FROM n) UNION ALL SELECT case_id, 'Normal' FROM n WHERE case_id NOT IN (SELECT case_id FROM t)""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "case_id")
    return A.disjoint_groups(o.where("o_orderpriority = '1-URGENT'").select("case_id").distinct(),
                             o.where("o_orderpriority = '5-LOW' and o_totalprice > 300000").select("case_id").distinct())


@query("first_sample_per_patient", """SELECT o_custkey AS patient, min(o_orderkey) AS sample, arg_min(o_totalprice, o_orderkey) AS value FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def _(spark, sf):
    expr = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("value"), F.col("o_custkey").alias("patient"))
    surv = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sample")).distinct()
    return A.first_sample_per_patient(expr, surv)


@query("cohort_expression", "SELECT c_mktsegment AS cohort, round(avg(o_totalprice), 4) AS mean, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("cohort"))
    expr = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("value"))
    return A.cohort_expression(cases, expr).select("cohort", F.round("mean", 4).alias("mean"), "n", F.round("median", 4).alias("median"))


@query("choose_release", "SELECT p_name AS name FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 1")
def _(spark, sf):
    rel = table(spark, sf, "part").select(F.col("p_name").alias("name"), (F.col("p_size") == 7).alias("is_latest"), F.col("p_partkey").alias("ordinal"))
    return A.choose_release(rel).select("name")


@query("best_file", """WITH f AS (SELECT DISTINCT p_brand AS dataset, p_type AS release, p_name AS file_name, p_name AS url FROM part), s AS (SELECT *, CASE WHEN regexp_matches(lower(file_name), '^red') THEN 100 WHEN regexp_matches(lower(file_name), 'ring$') THEN 99 ELSE CASE WHEN contains(file_name, 'widget') THEN 30 ELSE 0 END + CASE WHEN contains(file_name, 'big') THEN 20 ELSE 0 END END AS score FROM f)
SELECT dataset, file_name, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, file_name, url) AS i FROM s WHERE score > 0) WHERE i = 1""")
def _(spark, sf):
    files = table(spark, sf, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("release"), F.col("p_name").alias("file_name"), F.col("p_name").alias("url"))
    files = files.dropDuplicates(["dataset", "release", "file_name"])
    w = files.withColumn("release", F.concat("release", "dataset"))
    return A.best_file(w, ["^RED", "ring$"], {"widget": 30, "big": 20}).select("dataset", "file_name", "score")


@query("symbol_choice", """SELECT p_brand AS gene, coalesce(min(CASE WHEN upper(p_brand) = upper(s) THEN s END), arg_min(s, k)) AS resolved FROM (SELECT p_brand, CASE WHEN p_size = 5 AND p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_name END AS s, p_partkey AS k FROM part) GROUP BY 1""")
def _(spark, sf):
    hits = table(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.when((F.col("p_size") == 5) & (F.col("p_partkey") % 2 == 0), F.lower("p_brand")).otherwise(F.col("p_name")).alias("symbol"), F.col("p_partkey").alias("ordinal"))
    return A.symbol_choice(hits)


def gene_records(spark, sf):
    """Records as JSON text, one per document, parsed with the declared schema."""
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    go = F.transform(F.split(F.col("source"), ""), lambda c: F.struct(c.alias("term")))
    rec = F.struct(
        F.col("source").alias("symbol"), F.concat(F.lit("gene "), "lang").alias("name"), F.array("lang", "source", "lang").alias("alias"), F.col("text").alias("summary"),
        F.struct(F.lit("7").alias("chr"), k.alias("start"), (k + 100).alias("end")).alias("genomic_pos"), F.struct(F.concat(F.lit("ENSG"), k.cast("string")).alias("gene")).alias("ensembl"),
        F.struct(go.alias("BP"), F.array(F.struct(F.lit("binding").alias("term"))).alias("MF")).alias("go"),
        F.struct(F.array(F.struct(F.concat(F.lit(" way "), "lang").alias("name"))).alias("reactome")).alias("pathway"))
    raw = d.select("doc_id", "lang", F.to_json(rec).alias("json"))
    return raw.select("doc_id", "lang", F.from_json("json", A.GENE_RECORD).alias("rec"))


@query("gene_record_columns", """SELECT doc_id, 'gene ' || lang AS full_name, lang || '; ' || source AS aliases, 'ENSG' || CAST(doc_id AS VARCHAR) AS ensembl_id, 'chr7:' || CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + 100 AS VARCHAR) AS location, 'binding' AS molecular_function,
array_to_string(list_transform(list_slice(list_filter(list_transform(range(1, length(source) + 1), lambda i: CASE WHEN instr(source, substr(source, i, 1)) = i THEN substr(source, i, 1) END), lambda c: c IS NOT NULL), 1, 5), lambda c: c), '; ') AS biological_process, 'Reactome: way ' || lang AS pathway_summary FROM documents""")
def _(spark, sf):
    out = A.flatten_gene_record(gene_records(spark, sf))
    return out.select("doc_id", "full_name", "aliases", "ensembl_id", "location", "molecular_function", "biological_process", "pathway_summary")


@query("choose_hit", """WITH h AS (SELECT c_mktsegment AS gene, CASE WHEN c_custkey % 500 = 3 AND c_mktsegment <> 'MACHINERY' THEN lower(c_mktsegment) ELSE c_name END AS symbol, CASE WHEN c_custkey % 90 = 1 THEN c_mktsegment ELSE 'x' END AS al, c_acctbal AS s FROM customer)
SELECT gene, symbol, CASE WHEN upper(symbol) = gene THEN 'exact_symbol' WHEN al = gene THEN 'alias_match' ELSE 'best_match' END AS mapping_status FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN upper(symbol) = gene THEN 1 ELSE 0 END DESC, CASE WHEN al = gene THEN 1 ELSE 0 END DESC, s DESC, symbol) AS i FROM h) WHERE i = 1""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    hits = c.select(F.col("c_mktsegment").alias("gene"), F.when((F.col("c_custkey") % 500 == 3) & (F.col("c_mktsegment") != "MACHINERY"), F.lower("c_mktsegment")).otherwise(F.col("c_name")).alias("symbol"),
                    F.array(F.when(F.col("c_custkey") % 90 == 1, F.lower("c_mktsegment")).otherwise("x")).alias("alias"), F.col("c_acctbal").alias("hit_score"))
    return A.choose_hit(hits).select("gene", "symbol", "mapping_status")


def protein_records(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    feats = F.array(
        F.struct(F.lit("Domain").alias("type"), F.concat(F.lit("Protein kinase "), "lang").alias("description"), F.struct(F.struct(k.cast("int").alias("value")).alias("start"), F.struct((k + 50).cast("int").alias("value")).alias("end")).alias("location")),
        F.struct(F.when(k % 2 == 0, "Zinc finger").otherwise("Chain").alias("type"), F.lit("").alias("description"), F.struct(F.struct(F.lit(5).alias("value")).alias("start"), F.struct(F.lit(9).alias("value")).alias("end")).alias("location")))
    rec = F.struct(
        F.struct(F.struct(F.struct(F.concat(F.lit("protein "), "source").alias("value")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"),
        F.struct(F.col("n_chars").cast("int").alias("length")).alias("sequence"), F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit("Receptor").alias("name"))).alias("keywords"), feats.alias("features"),
        F.array(F.struct(F.lit("DISEASE").alias("commentType"), F.struct(F.concat(F.lit("Illness "), "lang", F.lit(". More.")).alias("description")).alias("disease"))).alias("comments"))
    return d.select("doc_id", F.from_json(F.to_json(rec), A.PROTEIN_RECORD).alias("rec"))


@query("protein_record_columns", """SELECT doc_id, 'protein ' || source AS protein_name, CAST(n_chars AS INTEGER) AS protein_length, 'Illness ' || lang AS diseases, source || '; Receptor' AS keyword_text, 'Protein kinase ' || lang || CASE WHEN doc_id % 2 = 0 THEN '; Zinc finger' ELSE '' END AS domains,
'Protein kinase ' || lang || ': ' || CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + 50 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '; Zinc finger: 5-9' ELSE '' END AS domain_spans, CASE WHEN doc_id % 2 = 0 THEN 'kinase; transcription factor' ELSE 'kinase' END AS domain_class, 'kinase' AS protein_class, 'potentially_druggable' AS druggability FROM documents""")
def _(spark, sf):
    out = A.flatten_protein_record(protein_records(spark, sf))
    return out.select("doc_id", "protein_name", "protein_length", "diseases", "keyword_text", "domains", "domain_spans", "domain_class", "protein_class", "druggability")


@query("reported_function")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("cls", F.lit("kinase"))
    return A.reported_function(d, "text", "source", "cls").select("doc_id", "reported_function")


@query("merge_candidates", """WITH p AS (SELECT p_partkey AS k, 'G' || CAST(p_partkey AS VARCHAR) AS s, p_name, p_brand, p_type FROM part WHERE p_partkey % 3 <> 0), g AS (SELECT p_partkey AS k, 'g' || CAST(p_partkey AS VARCHAR) AS s, p_brand, p_type FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(p.s, g.s) AS gene_name, coalesce(p.p_name, '') AS protein_id, CASE WHEN p.k % 5 <> 0 THEN p.p_type ELSE coalesce(g.p_type || ' gene', '') END AS evidence, CASE WHEN p.s IS NULL THEN g.p_type || ' gene' END AS only_gene, coalesce(p.p_brand, '') AS accession,
concat_ws(';', CASE WHEN p.s IS NOT NULL THEN 'UniProt:' || p.p_brand END, CASE WHEN g.s IS NOT NULL THEN 'NCBI_Gene:' || CAST(g.k AS VARCHAR) END) AS "references", concat_ws('; ', CASE WHEN p.s IS NOT NULL THEN 'aliases=' || p.p_type END, CASE WHEN g.s IS NOT NULL AND g.k % 4 = 0 THEN 'ncbi_aliases=' || g.p_brand END) AS notes FROM p FULL JOIN g ON upper(p.s) = upper(g.s)""".replace(
    "CASE WHEN p.k % 5 <> 0 THEN p.p_type ELSE coalesce(g.p_type || ' gene', '') END AS evidence, CASE WHEN p.s IS NULL THEN g.p_type || ' gene' END AS only_gene,", "CASE WHEN p.s IS NOT NULL AND p.k % 5 <> 0 THEN p.p_type ELSE coalesce(g.p_type || ' gene', '') END AS evidence,"))
def _(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    p = part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("G"), k.cast("string")).alias("symbol"), F.col("p_name").alias("protein_name"), F.col("p_brand").alias("accession"),
                                                F.when(k % 5 != 0, F.col("p_type")).otherwise("").alias("function_text"), F.array("p_type").alias("synonyms"), F.array().cast("array<string>").alias("pmids"))
    g = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("g"), k.cast("string")).alias("symbol"), k.cast("string").alias("gene_id"), F.concat("p_type", F.lit(" gene")).alias("description"),
                                               F.when(k % 4 == 0, F.col("p_brand")).otherwise("").alias("other_aliases"))
    return A.merge_candidates(p, g, "c", "human").select("gene_name", "protein_id", "evidence", "accession", "references", "notes")


@query("p_labels", """SELECT DISTINCT CAST(l_quantity AS INTEGER) AS q, CASE WHEN p < 1e-4 THEN '****' WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN p < 1e-4 THEN 'p = ' || printf('%.1e', p) ELSE 'p = ' || printf('%.4f', p) END AS label, round(-log10(greatest(p, 1e-300)), 6) AS y FROM (SELECT l_quantity, pow(l_quantity / 51.0, 8) AS p FROM lineitem)""")
def _(spark, sf):
    p = F.pow(F.col("l_quantity") / 51.0, 8.0)
    q = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), p.alias("p")).distinct()
    return q.select("q", T.stars(F.col("p")).alias("stars"), T.p_label(F.col("p")).alias("label"), F.round(T.neg_log10(F.col("p")), 6).alias("y"))


@query("symbol_text", """SELECT p_partkey, upper(replace(p_name, ' ', '')) AS symbol, upper(regexp_extract(p_name || ' (' || CAST(p_partkey AS VARCHAR) || ')', '^([A-Za-z0-9_.-]+)', 1)) AS lead FROM part""")
def _(spark, sf):
    col = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", T.normalize_symbol(F.col("p_name")).alias("symbol"), T.extract_symbol(col).alias("lead"))
