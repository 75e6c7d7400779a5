"""Queries for parsers and streams: text lines and records that Spark derives from the tables are parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.plans.inputs import (
    KIND_MATRIX,
    digest_proteins,
    event_intervals,
    event_second,
    kind_matrix,
    part_matrix,
    table,
)
from lociframe.plans.literature_queries import SPACE
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query
from lociframe.sources import lines as L
from lociframe.sources import records as R
from lociframe.session import shared_path
from lociframe.sources import tables as S
from lociframe.streaming import jobs as J

def wide(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = [F.sum(F.when(F.col("l_suppkey") % 3 == i, F.col("l_quantity"))).alias(f"s{i}") for i in range(3)]
    w = li.groupBy(F.col("l_partkey").alias("id")).agg(*agg)
    return w.select("id", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("NA")).alias(f"s{i}") for i in range(3)])


@query("melt_matrix", "WITH w AS (SELECT l_partkey AS feature, 's' || CAST(l_suppkey % 3 AS VARCHAR) AS sample, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), f AS (SELECT DISTINCT feature FROM w), s AS (SELECT 's' || CAST(i AS VARCHAR) AS sample FROM range(0, 3) t(i)) SELECT f.feature, s.sample, w.value FROM f CROSS JOIN s LEFT JOIN w ON w.feature = f.feature AND w.sample = s.sample")
def _(spark, sf):
    return S.melt(wide(spark, sf))


@query("to_beta", "SELECT l_partkey AS feature, l_suppkey AS sample, round(pow(2, sum(l_quantity) - 40) / (1 + pow(2, sum(l_quantity) - 40)), 6) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return r6(S.to_beta(part_matrix(spark, sf).withColumn("value", F.col("value") - 40)), "value")


@query("screen_counts", "SELECT CAST(l_partkey AS VARCHAR) AS guide, 'g' || CAST(l_partkey AS VARCHAR) AS gene, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (WHERE l_suppkey % 3 = {i}), 0.0) AS s{i}" for i in range(3)) + " FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    w = wide(spark, sf).select(F.col("id").cast("string").alias("sgRNA"), F.concat(F.lit("g"), "id").alias("Gene"), "s0", "s1", "s2")
    return S.screen_counts(w)


@query("sample_metadata", "SELECT s_suppkey AS sample, CAST(s_nationkey AS VARCHAR) AS grp FROM supplier")
def _(spark, sf):
    raw = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Sample_ID"), F.col("s_nationkey").cast("string").alias("GROUP"))
    return S.sample_metadata(raw)


@query("ranked_table", "SELECT upper(replace(p_name, ' ', '')) AS item, arg_max(s, [abs(s), s]) AS score FROM (SELECT p_name, round(p_retailprice - 950, 2) AS s FROM part) GROUP BY 1")
def _(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_name").alias("Symbol"), F.round(F.col("p_retailprice") - 950, 2).cast("string").alias("logFC"))
    return S.ranked_table(raw)


@query("join_labels", "SELECT vec_id AS sample, l.quality AS label FROM embeddings JOIN labels l ON vec_id = doc_id")
def _(spark, sf):
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"))
    return S.join_labels(feats, table(spark, sf, "labels").select(F.col("doc_id").alias("sample"), F.col("quality").alias("label")))


@query("assert_no_nulls", f"SELECT count(*) AS n, sum(value) AS total FROM ({KIND_MATRIX})")
def _(spark, sf):
    return S.assert_no_nulls(kind_matrix(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("merge_columns", "SELECT l_partkey AS feature, l_suppkey AS sample, arg_min(l_quantity, l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("value"),
                                               (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"))
    return S.merge_columns(rows)


@query("union_files", "SELECT l_orderkey AS k, l_quantity AS a, NULL AS b FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def _(spark, sf):
    return S.union_files([table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("a")),
                          table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("b"))])


@query("maf_mutations", "SELECT 'TCGA-' || p_type AS project, p_name AS gene, CASE WHEN p_size % 5 = 0 THEN 'p.?' ELSE 'p.V' || CAST(p_size AS VARCHAR) || 'E' END AS c, count(*) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY 1, 2, 3")
def _(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_name").alias("Hugo_Symbol"), F.concat(F.lit("TCGA-"), "p_type", F.lit("-AB12")).alias("Tumor_Sample_Barcode"), F.col("p_brand").alias("Variant_Classification"),
        F.when(F.col("p_size") % 5 == 0, "p.?").otherwise(F.concat(F.lit("p.V"), F.col("p_size").cast("string"), F.lit("E"))).alias("HGVSp_Short"))
    return S.maf_mutations(raw).select("project", "gene", F.explode("aa_changes").alias("c")).groupBy("project", "gene", "c").agg(F.count(F.lit(1)).alias("n"))


@query("domain_table", 'SELECT p_brand AS name, p_partkey AS "start", p_partkey + p_size AS "end" FROM part')
def _(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_brand").alias("Domain"), F.col("p_partkey").cast("string").alias("Start"), (F.col("p_partkey") + F.col("p_size")).cast("string").alias("STOP"))
    return S.domain_table(raw)


@query("survival_table", "SELECT 'TCGA-AB-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS sample, substr('TCGA-AB-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 12) AS patient, o_totalprice AS time, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS event FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, sf):
    s = F.col("o_orderstatus")
    raw = table(spark, sf, "orders").select(F.concat(F.lit("TCGA-AB-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("sample"),
                                            F.col("o_totalprice").cast("string").alias("OS.time"), F.when(s == "F", "1.0").when(s == "P", "bad").otherwise("0").alias("OS"))
    return S.survival_table(raw)


@query("expression_by_case", "SELECT o_custkey AS case_id, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("sample"), F.col("o_totalprice").alias("value"))
    return S.expression_by_case(raw)


@query("model_metadata", "SELECT c_custkey AS model, c_name AS cell_line, CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END AS lineage, 'Unknown' AS disease, c_mktsegment AS subtype FROM customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("ModelID"), F.col("c_name").alias("CellLineName"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("OncotreeLineage"),
                                              F.lit(None).cast("string").alias("OncotreePrimaryDisease"), F.col("c_mktsegment").alias("OncotreeSubtype"))
    return S.model_metadata(raw)


@query("default_entries", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_size % 2 = 0")
def _(spark, sf):
    raw = table(spark, sf, "part").withColumn("IsDefaultEntryForModel", F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("No")).withColumnRenamed("p_brand", "HugoSymbol")
    return S.default_entries(raw, "Brand#3").select("p_partkey")


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("tissue_pivot", "SELECT p_brand AS gene, " + ", ".join(f"coalesce(avg(p_retailprice) FILTER (WHERE p_type = '{t}'), 0) AS \"{t}\"" for t in PART_TYPES) + " FROM part GROUP BY 1")
def _(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_type").alias("tissue"), F.col("p_retailprice").alias("value"))
    return S.tissue_pivot(raw, PART_TYPES)


@query("first_values_wide", "SELECT l_partkey AS feature, " + ", ".join(f'arg_min(l_quantity, l_orderkey * 100 + l_linenumber) FILTER (WHERE l_returnflag = \'{c}\') AS "{c}"' for c in "ANR") + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_returnflag").alias("sample"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"))
    return S.first_values_wide(rows, ["A", "N", "R"])


# ---- lines ---------------------------------------------------------------------------------------


@query("gene_list_lines", "SELECT DISTINCT p_type AS set_id, upper(split_part(p_name, ' ', 1)) AS item FROM part")
def _(spark, sf):
    return L.gene_list(table(spark, sf, "part").select(F.col("p_type").alias("set_id"), F.col("p_name").alias("line")))


@query("labelled_lists", "SELECT DISTINCT p_partkey, p_type AS set_id, upper(unnest(string_split(p_name, ' '))) AS item FROM part UNION SELECT p_partkey, 'Z', upper(p_brand) FROM part")
def _(spark, sf):
    text = F.concat("p_type", F.lit(":"), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(",Z:"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.explode(L.labelled_lists(text)).alias("s")).select("p_partkey", "s.set_id", "s.item")


@query("interval_lines", 'SELECT CAST(user_id AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS "start", CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) + 1 AS "end", CASE WHEN event_id % 2 = 0 THEN \'e\' || CAST(event_id AS VARCHAR) ELSE \'peak_\' || CAST(event_id AS VARCHAR) END AS name, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS score, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS signal FROM events')
def _(spark, sf):
    bed3 = F.concat_ws("\t", F.col("chrom").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    bed6 = F.concat_ws("\t", bed3, F.concat(F.lit("e"), F.col("name").cast("string")), F.col("score").cast("string"), F.lit("+"))
    lines = event_intervals(spark, sf).select(F.col("name").alias("ordinal"), F.when(F.col("name") % 2 == 0, bed6).otherwise(bed3).alias("line"))
    return L.intervals(lines).select("chrom", "start", "end", "name", "score", "signal")


@query("fasta_records", None)
def _(spark, sf):
    p = digest_proteins(spark, sf)
    rec = F.concat(F.lit("p"), F.col("protein").cast("string"), F.lit("\n"), F.lower(F.substring("seq", 1, 60)), F.lit("\n"), F.substring("seq", 61, 1000), F.lit("\n"))
    return L.fasta_records(p.select(rec.alias("value")))


@query("stockholm_lines", "SELECT source AS family, 's' || CAST(doc_id AS VARCHAR) AS name, md5(text) || md5(source) AS seq FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("n", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    a = d.select(F.col("source").alias("family"), F.lit(1).alias("ordinal"), F.concat("n", F.lit("   "), F.md5("text")).alias("line"))
    b = d.select(F.col("source").alias("family"), F.lit(2).alias("ordinal"), F.concat("n", F.lit(" "), F.md5("source")).alias("line"))
    c = d.select(F.col("source").alias("family"), F.lit(0).alias("ordinal"), F.lit("# STOCKHOLM 1.0").alias("line"))
    return L.stockholm(a.unionByName(b).unionByName(c))


@query("gct_lines", "SELECT CAST(p_partkey AS VARCHAR) AS feature, unnest(['S1', 'S2']) AS sample, unnest([p_retailprice, CAST(p_size AS DOUBLE)]) AS value FROM part")
def _(spark, sf):
    part = table(spark, sf, "part")
    body = part.select(F.col("p_brand").alias("file"), F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("d"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")).alias("line"))
    head = part.select(F.col("p_brand").alias("file")).distinct().withColumn("line", F.explode(F.array(F.lit("#1.2"), F.lit("10\t2"), F.lit("Name\tDescription\tS1\tS2"))))
    return L.gct(body.unionByName(head).withColumn("ordinal", F.lit(0)))


def series_lines(spark, sf):
    part = table(spark, sf, "part")
    body = part.select(F.col("p_brand").alias("file"), F.concat_ws("\t", F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('"')), F.col("p_retailprice").cast("string"), F.lit("null")).alias("line"))
    heads = ['!Series_title = "T"', "!Sample_title\t\"a\"\t\"b\"", "!Sample_ch1\t\"x\"\t\"y\"", "!Sample_ch1\t\"z\"\t\"w\"", "!series_matrix_table_begin", '"ID_REF"\t"G1"\t"G2"', "!series_matrix_table_end"]
    head = part.select(F.col("p_brand").alias("file")).distinct().select("file", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("ordinal", "line"))
    return L.series_matrix(body.withColumn("ordinal", F.lit(99)).select("file", "ordinal", "line").unionByName(head))


@query("series_matrix", "SELECT p_brand AS file, CAST(p_partkey AS VARCHAR) AS feature, unnest(['G1', 'G2']) AS sample, unnest([p_retailprice, NULL]) AS value FROM part")
def _(spark, sf):
    return series_lines(spark, sf)[0]


@query("series_attributes", "SELECT DISTINCT p_brand AS file, CAST(i AS INTEGER) AS place, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS title, CASE i WHEN 0 THEN 'x; z' ELSE 'y; w' END AS ch1 FROM part, range(0, 2) t(i)")
def _(spark, sf):
    return L.sample_attributes(series_lines(spark, sf)[2], ["title", "ch1"])


@query("series_summary", "SELECT DISTINCT p_brand AS file, 'T' AS title FROM part")
def _(spark, sf):
    return L.series_summary(series_lines(spark, sf)[1], ["title"])


@query("variant_tokens", "SELECT DISTINCT 'V' || CAST(p_size AS VARCHAR) || '*' AS raw, 'V' AS wt_aa, CAST(p_size AS BIGINT) AS pos, '*' AS mut_aa, 'stop' AS impact_class FROM part")
def _(spark, sf):
    tok = table(spark, sf, "part").select(F.explode(F.array(F.concat(F.lit("V"), F.col("p_size").cast("string"), F.lit("*")), F.col("p_name"))).alias("token"))
    return L.variants(tok).distinct()


@query("hotspot_variants", "SELECT 'V' || CAST(p_size AS VARCHAR) || 'E' AS raw, CAST(p_size AS BIGINT) AS pos, count(*) AS tcga_count, 'uncertain' AS impact_class FROM part GROUP BY p_size")
def _(spark, sf):
    hs = table(spark, sf, "part").groupBy(F.col("p_size").alias("position")).agg(F.count(F.lit(1)).alias("count")).select(
        "position", "count", F.concat(F.lit("V"), F.col("position").cast("string"), F.lit("E;V600"), F.lit("")).alias("aa_changes"), F.lit("Missense_Mutation").alias("types"))
    return L.hotspot_variants(hs).select("raw", "pos", "tcga_count", "impact_class")


# ---- records -------------------------------------------------------------------------------------


def xml_escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def articles(spark, sf):
    k = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"), k, F.lit("</PMID><Article><Journal><JournalIssue><Volume>3</Volume><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J "), "lang",
        F.lit("</Title></Journal><ArticleTitle>T "), "source", F.lit("</ArticleTitle><Abstract><AbstractText Label=\"A\">"), xml_escape(F.col("text")),
        F.lit("</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><Initials>"), F.upper("lang"), F.lit("</Initials><AffiliationInfo><Affiliation>Lab "), "source",
        F.lit("</Affiliation></AffiliationInfo></Author><Author><LastName>Roe</LastName></Author></AuthorList><PublicationTypeList><PublicationType UI=\"x\">Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName UI=\"d\">M "), "lang",
        F.lit("</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"pubmed\">1</ArticleId><ArticleId IdType=\"doi\">10.2/"), k, F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"))
    return R.parse_articles(table(spark, sf, "documents").select(xml.alias("xml")), "xml").drop("xml")


@query("article_rows", "SELECT CAST(doc_id AS VARCHAR) AS pmid, 'T ' || source AS title, 'Doe ' || upper(lang) || ';Roe' AS authors, 'J ' || lang AS journal, '2020' AS year, '10.2/' || CAST(doc_id AS VARCHAR) AS doi, 'Review' AS types, 'M ' || lang AS mesh FROM documents")
def _(spark, sf):
    out = R.article_rows(articles(spark, sf))
    return out.select("pmid", "title", F.array_join("authors", ";").alias("authors"), "journal", "year", "doi", F.array_join("publication_types", ";").alias("types"), F.array_join("mesh_terms", ";").alias("mesh"))


@query("article_authors", "SELECT CAST(doc_id AS VARCHAR) AS pmid, 'J ' || lang AS journal, unnest(['Doe ' || upper(lang), 'Roe']) AS author, unnest(['Lab ' || source, 'N/A']) AS affiliation FROM documents")
def _(spark, sf):
    return R.article_authors(articles(spark, sf))


@query("crossref_rows", f"""SELECT '10.1/' || CAST(doc_id AS VARCHAR) AS doi, {SPACE.format("split_part(text, chr(10), 1)")} AS title, make_date(2001, doc_id % 12 + 1, 1) AS pub_date, array_to_string(list_transform(range(1, 13), lambda i: 'G' || CAST(i AS VARCHAR) || ' ' || lang), '; ') AS authors, n_chars AS citation_count FROM documents""")
def _(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    people = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.struct(F.concat(F.lit("G"), i.cast("string")).alias("given"), F.col("lang").alias("family")))
    rec = F.struct(F.concat(F.lit("10.1/"), k.cast("string")).alias("DOI"), F.array(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), people.alias("author"),
                   F.struct(F.array(F.array(F.lit(2001), (k % 12 + 1).cast("int"))).alias("date-parts")).alias("published-online"), F.col("n_chars").alias("is-referenced-by-count"))
    out = R.crossref_rows(R.parse_json(d.select(F.to_json(rec).alias("json")), "json", R.CROSSREF))
    return out.select("doi", "title", "pub_date", "authors", "citation_count")


@query("preprint_rows", "SELECT CAST(doc_id AS VARCHAR) AS doi, 'Unknown' AS category, source || '|' || lang AS authors, 'x' AS server FROM documents")
def _(spark, sf):
    rec = F.struct(F.col("doc_id").cast("string").alias("doi"), F.concat("source", F.lit("; "), "lang", F.lit(", ")).alias("authors"))
    out = R.preprint_rows(R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.PREPRINT), "x")
    return out.select("doi", "category", F.array_join("authors", "|").alias("authors"), "server")


@query("atom_rows", "SELECT 'x' || CAST(doc_id AS VARCHAR) AS id, 'A ' || lang AS title, '2019' AS year, source || ';B' AS authors FROM documents")
def _(spark, sf):
    xml = F.concat(F.lit("<entry><id>x"), F.col("doc_id").cast("string"), F.lit("</id><title>A\n  "), "lang", F.lit("</title><summary>s</summary><published>2019-03-04</published><author><name>"), "source", F.lit("</name></author><author><name>B</name></author></entry>"))
    return R.atom_rows(table(spark, sf, "documents").select(xml.alias("xml")), "xml").select("id", "title", "year", F.array_join("authors", ";").alias("authors"))


def feature_records(spark, sf):
    k = F.col("doc_id").cast("int")

    def feat(kind, desc, a, b):
        return F.struct(F.lit(kind).alias("type"), desc.alias("description"), F.struct(F.struct(a.alias("value")).alias("start"), F.struct(b.alias("value")).alias("end")).alias("location"))

    rec = F.struct(F.concat(F.lit("P"), k.cast("string")).alias("primaryAccession"), F.array(
        feat("Domain", F.col("lang"), k, k + 9), feat("Natural variant", F.when(k % 2 == 0, "V -> E (in disease)").otherwise("polymorphism"), k + 5, F.lit(None).cast("int"))).alias("features"))
    return R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.FEATURES)


@query("protein_features", "SELECT 'P' || CAST(doc_id AS VARCHAR) AS accession, 'Domain' AS type, CAST(doc_id AS INTEGER) AS \"start\", CAST(doc_id + 9 AS INTEGER) AS \"end\", lang AS description, 10 AS length FROM documents")
def _(spark, sf):
    return R.protein_features(feature_records(spark, sf))


@query("natural_variants", "SELECT 'P' || CAST(doc_id AS VARCHAR) AS accession, doc_id + 5 AS pos, CASE WHEN doc_id % 2 = 0 THEN 'V' ELSE '?' END AS wt_aa, CASE WHEN doc_id % 2 = 0 THEN 'E' ELSE '?' END AS mut_aa, CASE WHEN doc_id % 2 = 0 THEN 'pathogenic' ELSE 'benign' END AS impact_class FROM documents")
def _(spark, sf):
    return R.natural_variants(feature_records(spark, sf)).drop("description")


@query("structure_rows", "SELECT 'X' || CAST(doc_id AS VARCHAR) AS pdb_id, lang AS title, round((doc_id % 400) / 100.0, 2) AS resolution, 'a; b; c et al. (+2)' AS authors, doc_id AS pubmed_id FROM documents")
def _(spark, sf):
    k = F.col("doc_id")
    people = F.array(*[F.struct(F.lit(c).alias("name")) for c in "abcde"])
    rec = F.struct(F.concat(F.lit("x"), k.cast("string")).alias("rcsb_id"), F.struct(F.col("lang").alias("title")).alias("struct"), F.struct(F.array((k % 400 / 100.0)).alias("resolution_combined")).alias("rcsb_entry_info"),
                   F.struct(k.alias("pubmed_id")).alias("rcsb_entry_container_identifiers"), people.alias("audit_author"))
    out = R.structure_rows(R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.PDB_ENTRY))
    return out.select("pdb_id", "title", "resolution", "authors", "pubmed_id")


@query("prediction_rows", "SELECT source AS accession, CAST(max(doc_id) AS INTEGER) AS version FROM documents GROUP BY 1")
def _(spark, sf):
    rec = F.struct(F.col("source").alias("uniprotAccession"), F.col("doc_id").cast("int").alias("latestVersion"), F.col("lang").alias("gene"))
    return R.prediction_rows(R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.PREDICTION)).select("accession", "version")


@query("choose_protein", "SELECT p_brand AS gene, arg_min(p_name, CASE WHEN p_size > 40 THEN 0 ELSE 1 END * 100000000 + p_partkey) AS accession, arg_min(p_size, CASE WHEN p_size > 40 THEN 0 ELSE 1 END * 100000000 + p_partkey) AS length FROM part GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_brand").alias("gene"), F.col("p_name").alias("accession"), (F.col("p_size") > 40).alias("reviewed"), F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("length"))
    return R.choose_protein(e)


@query("curated_rows", "SELECT 'Q' || CAST(doc_id AS VARCHAR) AS accession, lang AS symbol, source AS synonyms, '0;1;2;3;4' AS pmids, 'f ' || lang AS function_text FROM documents")
def _(spark, sf):
    refs = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.lit("PubMed").alias("database"), i.cast("string").alias("id")))
    gene = F.struct(F.struct(F.col("lang").alias("value")).alias("geneName"), F.array(F.struct(F.col("source").alias("value"))).alias("synonyms"))
    rec = F.struct(F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("primaryAccession"), F.array(gene).alias("genes"), refs.alias("uniProtKBCrossReferences"),
                   F.array(F.struct(F.lit("FUNCTION").alias("commentType"), F.array(F.struct(F.concat(F.lit("f "), "lang").alias("value"))).alias("texts"))).alias("comments"))
    out = R.curated_rows(R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.CURATED))
    return out.select("accession", "symbol", F.array_join("synonyms", ";").alias("synonyms"), F.array_join("pmids", ";").alias("pmids"), "function_text")


def cases(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    diag = F.struct(F.when(k % 2 == 0, "Alive").otherwise("Dead").alias("vital_status"), p.alias("days_to_last_follow_up"), F.when(k % 5 == 0, p - 90).alias("days_to_recurrence"))
    fu = F.array(F.struct((p - 50).alias("days_to_follow_up"), F.when(k % 3 == 0, "Yes").otherwise("No").alias("progression_or_recurrence"), F.lit("x").alias("disease_response")),
                 F.struct((p - 70).alias("days_to_follow_up"), F.lit("").alias("progression_or_recurrence"), F.when(k % 7 == 0, "Progressive Disease").otherwise("none").alias("disease_response")))
    rec = F.struct(k.cast("string").alias("case_id"), F.struct(F.when(k % 4 == 0, "").alias("vital_status")).alias("demographic"), F.array(diag).alias("diagnoses"), fu.alias("follow_ups"),
                   F.array(F.struct(F.col("o_orderpriority").alias("sample_type")), F.struct(F.lit("Blood").alias("sample_type")), F.struct(F.lit("Blood").alias("sample_type"))).alias("samples"))
    return R.parse_json(table(spark, sf, "orders").select(F.to_json(rec).alias("json")), "json", R.CASE)


@query("clinical_rows", """WITH c AS (SELECT o_orderkey AS k, o_totalprice AS p, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice - 70 WHEN o_orderkey % 3 = 0 THEN o_totalprice - 50 END AS e, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice - 90 END AS rc FROM orders)
SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN k % 2 = 0 THEN 'Alive' ELSE 'Dead' END AS vital_status, round(least(e, rc), 4) AS days_to_new_tumor_event, CASE WHEN rc IS NOT NULL OR e IS NOT NULL THEN 'yes' END AS progression_or_recurrence FROM c""")
def _(spark, sf):
    out = R.clinical_rows(cases(spark, sf))
    return out.select("case_id", "vital_status", F.round("days_to_new_tumor_event", 4).alias("days_to_new_tumor_event"), "progression_or_recurrence")


@query("case_sample_types", "SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_orderpriority || ';Blood' AS sample_types FROM orders")
def _(spark, sf):
    return R.case_sample_types(cases(spark, sf))


@query("study_mutations", "SELECT 'TCGA-' || upper(p_type) AS project, CAST(p_partkey AS VARCHAR) AS patient, CASE WHEN p_size % 3 = 0 THEN 'SOMATIC' ELSE 'Missense' END AS kind, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'p.V' || CAST(p_size AS VARCHAR) || 'E' END AS change FROM part")
def _(spark, sf):
    s = F.col("p_size")
    rec = F.struct(F.concat(F.lower("p_type"), F.lit("_tcga_pan_can_atlas_2018")).alias("study"), F.col("p_partkey").cast("string").alias("patientId"),
                   F.when(s % 4 == 0, "MUTATED").when(s % 2 == 0, F.concat(F.lit("p.V"), s.cast("string"), F.lit("E"))).otherwise(F.concat(F.lit("V"), s.cast("string"), F.lit("E"))).alias("proteinChange"),
                   F.when(s % 3 != 0, "Missense").alias("mutationType"), F.lit("SOMATIC").alias("mutationStatus"))
    out = R.study_mutations(R.parse_json(table(spark, sf, "part").select(F.to_json(rec).alias("json")), "json", R.STUDY_MUTATION))
    return out.select("project", "patient", F.col("consequence_types")[0].alias("kind"), F.array_join("aa_changes", ";").alias("change"))


@query("profiled_counts", "SELECT p_brand AS project, count(DISTINCT p_size) AS n_profiled FROM part GROUP BY 1")
def _(spark, sf):
    return R.profiled_counts(table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.col("p_size").alias("sample")))


@query("molecular_rows", "SELECT c_mktsegment AS study, CAST(c_custkey AS VARCHAR) AS patient, c_acctbal AS value FROM customer WHERE c_custkey % 6 <> 0")
def _(spark, sf):
    rec = F.struct(F.col("c_mktsegment").alias("study"), F.col("c_custkey").cast("string").alias("patientId"), F.when(F.col("c_custkey") % 6 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("value"))
    return R.molecular_rows(R.parse_json(table(spark, sf, "customer").select(F.to_json(rec).alias("json")), "json", R.MOLECULAR)).drop("sample")


@query("series_rows", "SELECT 'GSE' || CAST(doc_id AS VARCHAR) AS accession, lang AS title, '' AS organism, '' AS type, CAST(doc_id % 9 AS INTEGER) AS n_samples, 'a;b' AS pubmed_ids FROM documents")
def _(spark, sf):
    rec = F.struct(F.concat(F.lit("GSE"), F.col("doc_id").cast("string")).alias("accession"), F.col("lang").alias("title"), (F.col("doc_id") % 9).cast("int").alias("n_samples"), F.array(F.lit("a"), F.lit("b")).alias("pubmedids"))
    return R.series_rows(R.parse_json(table(spark, sf, "documents").select(F.to_json(rec).alias("json")), "json", R.SERIES).drop("json"))


# ---- streams -------------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return raw.withColumn("ts", F.timestamp_micros(micros))


@query("stream_dedup", "SELECT DISTINCT lower(event_type) || '-' || CAST(user_id AS VARCHAR) AS dedup_key FROM events")
def _(spark, sf):
    key = F.concat(F.lower("event_type"), F.lit("-"), F.col("user_id").cast("string"))
    return J.run_available(J.dedup_stream(event_stream(spark, sf), key, "ts", "400 days")).select("dedup_key")


def late_events(spark, sf):
    """Events as they arrive, in eight files: one of thirteen comes three days late."""
    second = event_second()
    rows = table(spark, sf, "events").select(
        F.concat(F.lower("event_type"), F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("k"), second.cast("long").alias("s"),
        (second.cast("long") + F.when(F.col("event_id") % 13 == 0, 259200).otherwise(0)).alias("arrived"))
    lo, hi = rows.agg(F.min("arrived"), F.max("arrived")).first()
    rows = rows.withColumn("b", F.expr(f"(arrived - {lo}L) * 8 div {hi - lo + 1}L")).withColumn("ts", F.timestamp_seconds("s"))
    path = shared_path(spark, "arrivals")
    for b in range(8):  # one file after the other, as a feed lands
        rows.where(F.col("b") == b).select("k", "ts").coalesce(1).write.mode("append").parquet(f"{path}/{b}")
    return spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@query("stream_first_records", """WITH RECURSIVE ev AS (SELECT lower(event_type) || '-' || CAST(user_id % 50 AS VARCHAR) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % 13 = 0 THEN 259200 ELSE 0 END AS arr FROM events),
lim AS (SELECT min(arr) AS lo, max(arr) AS hi FROM ev), r AS (SELECT k, s, (arr - lo) * 8 // (hi - lo + 1) AS b FROM ev, lim), mx AS (SELECT b, max(s) AS m FROM r GROUP BY b),
wm AS (SELECT t.b, coalesce((SELECT max(m) FROM mx WHERE mx.b < t.b) - 86400, 0) AS w FROM range(0, 8) t(b)), per AS (SELECT r.b, k, min(s) AS s FROM r JOIN wm ON wm.b = r.b WHERE s >= w GROUP BY 1, 2),
st AS (SELECT CAST(-1 AS BIGINT) AS b, k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS emit FROM (SELECT DISTINCT k FROM r) UNION ALL
SELECT st.b + 1, st.k, CASE WHEN coalesce(st.e, per.s + 172800) <= w THEN NULL ELSE coalesce(st.e, per.s + 172800) END, CASE WHEN st.e IS NULL THEN per.s END
FROM st JOIN wm ON wm.b = st.b + 1 LEFT JOIN per ON per.b = st.b + 1 AND per.k = st.k WHERE st.b < 7)
SELECT k AS dedup_key, emit AS at FROM st WHERE emit IS NOT NULL""")
def _(spark, sf):
    out = J.run_available(J.first_records(late_events(spark, sf), F.col("k"), "ts", "1 day", 2))
    return out.select("dedup_key", F.expr("at div 1000").alias("at"))


@query("stream_window_counts", """WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 604800) * 604800)::TIMESTAMP AS s, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events)
SELECT strftime(s, '%Y-%m-%d') AS week, event_type, count(*) AS count FROM w, m WHERE s + INTERVAL 7 DAY <= wm GROUP BY 1, 2""")
def _(spark, sf):
    out = J.run_available(J.window_counts(event_stream(spark, sf), "ts", "7 days", "1 day", ("event_type",)))
    return out.select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window_start") / 86400).cast("int")).cast("string").alias("week"), "event_type", "count")


@query("stream_comoments", "SELECT event_type, count(*) AS n, round(corr(value, user_id), 6) AS r FROM events GROUP BY 1")
def _(spark, sf):
    out = J.run_available(J.comoment_stream(event_stream(spark, sf), "event_type", "value", "user_id"), "complete")
    return r6(out.select("event_type", "n", "r"), "r")
