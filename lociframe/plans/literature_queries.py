"""Queries over publication-like tables made from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import text as T
from lociframe.operators import literature as L
from lociframe.plans.inputs import table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query

JOURNALS = ["Nature", "Science", "Cell", "Nature Methods", "Cell Systems", "Plant Notes", "PNAS", "eLife"]
TYPES = ["article", "preprint", "review", "dataset", "editorial"]
TERMS = ["the", "dans", "machine", "ther"]


def papers(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    return d.select(
        k.alias("ordinal"), F.concat(F.lit("10.1/"), F.col("source"), F.lit("."), (k % 400).cast("string")).alias("doi"), k.alias("pmid"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), pick(JOURNALS, k).alias("journal"),
        F.concat(F.lit("spatial atlas "), "lang").alias("subjects"), pick(TYPES, k).alias("type"), F.concat("lang", F.lit(" biology")).alias("category"),
        (F.col("n_chars") % 97).alias("citation_count"), (k % 16 + 2010).cast("int").alias("year"),
        F.when(k % 10 == 9, "unknown").otherwise(F.concat((k % 16 + 2010).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-15"))).alias("pub_date"),
        F.array(F.col("source"), F.concat(F.lit("a"), (k % 37).cast("string")), F.concat(F.lit("b"), (k % 11).cast("string"))).alias("authors"),
        F.array(pick(["Journal Article", "Review", "Clinical Trial", "Meta-Analysis"], k)).alias("publication_types"))


def lst(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def pick(xs, n="doc_id"):
    return f"list_extract({lst(xs)}, CAST({n} % {len(xs)} + 1 AS BIGINT))"


P = f"""WITH p AS (SELECT doc_id AS ordinal, '10.1/' || source || '.' || CAST(doc_id % 400 AS VARCHAR) AS doi, doc_id AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract, {pick(JOURNALS)} AS journal, 'spatial atlas ' || lang AS subjects,
{pick(TYPES)} AS type, lang || ' biology' AS category, n_chars % 97 AS citation_count, CAST(doc_id % 16 + 2010 AS INTEGER) AS year, CASE WHEN doc_id % 10 = 9 THEN 'unknown' ELSE CAST(doc_id % 16 + 2010 AS VARCHAR) || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS pub_date,
[source, 'a' || CAST(doc_id % 37 AS VARCHAR), 'b' || CAST(doc_id % 11 AS VARCHAR)] AS authors, [{pick(["Journal Article", "Review", "Clinical Trial", "Meta-Analysis"])}] AS publication_types FROM documents)"""


def has(x, terms):
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


@query("publication_window", f"{P} SELECT ordinal, pub_date FROM p WHERE try_cast(pub_date AS DATE) BETWEEN DATE '2013-03-01' AND DATE '2019-06-30'")
def _(spark, sf):
    return L.in_window(papers(spark, sf), "2013-03-01", "2019-06-30").select("ordinal", "pub_date")


@query("primary_articles", f"{P} SELECT ordinal FROM p WHERE NOT {has(chr(108) + 'ower(title || chr(32) || type || chr(32) || abstract)', T.NON_PRIMARY_TERMS)}")
def _(spark, sf):
    return L.primary_articles(papers(spark, sf)).select("ordinal")


@query("keyword_filter", f"{P} SELECT ordinal FROM p WHERE {has('lower(title || chr(32) || abstract)', ['ther', 'queaux'])}")
def _(spark, sf):
    return L.with_keywords(papers(spark, sf), "THER queaux").select("ordinal")


@query("category_filter", f"{P} SELECT ordinal FROM p WHERE contains(lower(category), 'es bio')")
def _(spark, sf):
    return L.in_category(papers(spark, sf), "ES bio").select("ordinal")


@query("paper_filter", f"{P} SELECT ordinal FROM p WHERE list_contains(publication_types, 'Review') AND {has('lower(journal)', ['science', 'cell'])}")
def _(spark, sf):
    return L.filter_papers(papers(spark, sf), "review", ["Science", "Cell"]).select("ordinal")


@query("affiliation_filter", f"{P} SELECT ordinal FROM p WHERE NOT contains(lower(category), 'de ') AND contains(lower(category), 'biology')")
def _(spark, sf):
    return L.affiliation_filter(papers(spark, sf).withColumn("affiliation", F.col("category")), "Biology", "DE ").select("ordinal")


@query("sorted_papers", f"{P} SELECT ordinal, citation_count AS citations FROM p")
def _(spark, sf):
    return L.sort_papers(papers(spark, sf).withColumn("citations", F.col("citation_count")), "citations").select("ordinal", "citations")


@query("attach_citations", f"{P} SELECT p.ordinal, coalesce(l.quality * 10 + l.toxic, 0) AS citations FROM p LEFT JOIN labels l ON l.doc_id = p.pmid")
def _(spark, sf):
    counts = table(spark, sf, "labels").select(F.col("doc_id").alias("pmid"), (F.col("quality") * 10 + F.col("toxic")).alias("citations"))
    return L.attach_citations(papers(spark, sf), counts).select("ordinal", "citations")


CACHE = "c AS (SELECT lower(doi) AS doi, min(title) AS abstract FROM p WHERE ordinal % 3 = 0 GROUP BY 1)"


def enriched(spark, sf):
    p = papers(spark, sf).withColumnRenamed("abstract", "abstract_own").withColumn("doi", F.upper("doi"))
    cache = papers(spark, sf).where("ordinal % 3 = 0").groupBy("doi").agg(F.min("title").alias("abstract"))
    return L.enrich_abstracts(p, cache)


SPACE = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("enrich_abstracts", f"{P}, {CACHE} SELECT ordinal, md5({SPACE.format('coalesce(c.abstract, p.abstract)')}) AS digest FROM p LEFT JOIN c ON c.doi = lower(p.doi)")
def _(spark, sf):
    return enriched(spark, sf)[0].select("ordinal", F.md5("abstract").alias("digest"))


@query("new_cache_rows", f"{P}, {CACHE} SELECT DISTINCT lower(doi) AS doi FROM p WHERE lower(doi) NOT IN (SELECT doi FROM c)")
def _(spark, sf):
    return enriched(spark, sf)[1].select("doi")


LOW = "lower(title || ' ' || abstract || ' ' || subjects)"
FIELD = " + ".join(f"CASE WHEN contains(low, '{k}') THEN {w} ELSE 0 END" for k, w in {**T.FIELD_KEYWORDS, **T.NEGATIVE_KEYWORDS}.items())
JOUR = "CASE journal " + " ".join(f"WHEN '{j}' THEN {w}" for j, w in T.JOURNAL_WEIGHTS.items()) + " ELSE 5.0 END"
MATCH = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{k}' END" for k in T.FIELD_KEYWORDS) + "], lambda x: x IS NOT NULL), '; ')"
SCORED = f"""{P}, l AS (SELECT *, {LOW} AS low, lower(title) AS tl FROM p), s AS (SELECT *, {MATCH} AS matched, CAST({FIELD} AS DOUBLE) AS field_score, CAST({JOUR} AS DOUBLE) AS journal_score, least(citation_count, 50) * 0.03 AS cb,
CASE WHEN abstract <> '' THEN 1.0 ELSE 0.0 END AS ab, CASE WHEN contains(tl, 'benchmark') THEN 1.5 ELSE 0 END + CASE WHEN contains(tl, 'atlas') THEN 1 ELSE 0 END + CASE WHEN contains(tl, 'resource') THEN 1 ELSE 0 END AS bs,
CASE WHEN contains(low, 'ther') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'spatial') THEN 1 ELSE 0 END AS ni FROM l),
t AS (SELECT *, round(CAST(journal_score + field_score + ni * 2 + cb + ab + bs AS DOUBLE), 3) AS impact_score FROM s)"""


def scored(spark, sf):
    return L.score_papers(papers(spark, sf), ["ther", "spatial"])


@query("score_papers", f"{SCORED} SELECT ordinal, matched, round(field_score, 3) AS field_score, journal_score, impact_score FROM t")
def _(spark, sf):
    return scored(spark, sf).select("ordinal", F.array_join("matched_field_keywords", "; ").alias("matched"), "field_score", "journal_score", "impact_score")


@query("paper_candidates", f"{SCORED} SELECT ordinal FROM t WHERE field_score >= 5 OR impact_score >= 16")
def _(spark, sf):
    return L.candidates(scored(spark, sf), 5.0, 16.0).select("ordinal")


@query("top_papers", f"{SCORED} SELECT doi, journal, impact_score, ordinal FROM t ORDER BY impact_score DESC, citation_count DESC, journal, pub_date DESC, doi LIMIT 25")
def _(spark, sf):
    return L.top_papers(scored(spark, sf), 25).select("doi", "journal", "impact_score", "ordinal")


@query("paper_summaries")
def _(spark, sf):
    out = L.summarize_papers(scored(spark, sf), [("the", "article"), ("ing", "doing"), ("tion", "noun")])
    return out.select("ordinal", F.md5("why_it_matters").alias("why"), F.md5("major_discoveries").alias("major"), "significance")


@query("value_counts", f"{P} SELECT journal, count(*) AS count FROM p GROUP BY 1")
def _(spark, sf):
    return L.value_counts(papers(spark, sf), "journal")


TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


@query("token_counts", f"SELECT token, count(*) AS count FROM (SELECT unnest({TOK}) AS token FROM documents) WHERE length(token) > 3 AND token NOT IN ({lst(T.STOPWORDS)[1:-1]}) GROUP BY 1 ORDER BY count DESC, token LIMIT 40")
def _(spark, sf):
    return L.token_counts(table(spark, sf, "documents"), F.col("text"), 40)


MIX = r"""regexp_replace(w, '^[.,!?;:"''()\[\]{}]+|[.,!?;:"''()\[\]{}]+$', '', 'g')"""


@query("mixed_term_counts", rf"""WITH w AS (SELECT unnest(regexp_split_to_array(trim(lower(text)), '[ \t\n\x0B\f\r]+')) AS w FROM documents), t AS (SELECT {MIX} AS term FROM w), k AS (SELECT term FROM t WHERE length(term) > 3 AND term NOT IN ({lst(T.TERM_STOPWORDS)[1:-1]})
UNION ALL SELECT trim(unnest(string_split(source || '; ' || lang, ';'))) FROM documents) SELECT term, count(*) AS count FROM k GROUP BY 1 ORDER BY count DESC, term LIMIT 40""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("mesh", F.concat("source", F.lit("; "), "lang"))
    return L.mixed_term_counts(d, "text", "mesh", 40)


@query("prolific_authors", f"{P} SELECT author, count(*) AS count FROM (SELECT unnest(authors) AS author FROM p) GROUP BY 1 ORDER BY count DESC, author LIMIT 20")
def _(spark, sf):
    return L.prolific_authors(papers(spark, sf))


@query("keyword_titles", f"""{P}, h AS (SELECT k AS keyword, title, row_number() OVER (PARTITION BY k ORDER BY ordinal) AS i FROM p, (VALUES ('ther'), ('eaux'), ('heit')) v(k) WHERE contains(lower(title || ' ' || abstract), k))
SELECT keyword, string_agg(title, ' | ' ORDER BY i) AS top_papers FROM h WHERE i <= 3 GROUP BY 1""")
def _(spark, sf):
    return L.keyword_titles(papers(spark, sf), ["ther", "eaux", "heit"])


@query("coauthor_pairs", f"""{P}, a AS (SELECT DISTINCT ordinal, unnest(authors) AS m FROM p) SELECT x.m AS a, y.m AS b, count(*) AS count FROM a x JOIN a y ON x.ordinal = y.ordinal AND x.m < y.m GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    return L.pair_counts(papers(spark, sf).select("ordinal", F.explode("authors").alias("author")), "ordinal", "author", 2)


LINK = f"""{P}, k AS (SELECT unnest(authors) AS author, lang AS topic, pmid, journal FROM p JOIN documents ON doc_id = pmid)"""


def links(spark, sf):
    p = papers(spark, sf).select("pmid", "journal", F.transform("authors", lambda a: F.struct(a.alias("name"), F.lit("x").alias("affiliation"))).alias("authors"))
    topics = table(spark, sf, "documents").select(F.col("doc_id").alias("pmid"), F.col("lang").alias("topic"))
    return L.author_topic_links(p, topics)


@query("collaborators", f"""{LINK}, b AS (SELECT author, count(*) AS n_papers, count(DISTINCT topic) AS topics_covered FROM k GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT author, journal, row_number() OVER (PARTITION BY author ORDER BY count(DISTINCT pmid) DESC, journal) AS i FROM k GROUP BY 1, 2),
t AS (SELECT author, string_agg(journal, '; ' ORDER BY i) AS top_journals FROM j WHERE i <= 3 GROUP BY 1) SELECT b.author, n_papers, topics_covered, round(topics_covered * 10 + ln(1 + n_papers), 6) AS rank_score, top_journals FROM b JOIN t ON b.author = t.author""")
def _(spark, sf):
    return r6(L.collaborators(links(spark, sf).select("author", "topic", "pmid", "journal")), "rank_score")


@query("author_topic_matrix", f"""{LINK} SELECT author, count(*) FILTER (WHERE topic = 'en') AS en, count(*) FILTER (WHERE topic = 'fr') AS fr, count(*) FILTER (WHERE topic = 'de') AS de, count(*) FILTER (WHERE topic = 'es') AS es FROM k GROUP BY 1""")
def _(spark, sf):
    return L.author_topic_matrix(links(spark, sf), ["en", "fr", "de", "es"])


NOW = 2025


def works(spark, sf):
    k = F.col("ordinal")

    def author(name, pos, inst):
        return F.struct(name.alias("author_id"), F.concat(F.lit("Dr "), name).alias("author_name"), F.lit(pos).alias("position"), inst.alias("institution"))

    p = papers(spark, sf)
    return p.select(
        k.alias("work_id"), "title", "abstract", F.col("category").alias("topics"), "year", F.col("citation_count").alias("cited_by_count"), "doi", "type",
        F.array(author(F.concat(F.lit("a"), (k % 37).cast("string")), "first", F.concat(F.lit("inst"), (k % 5).cast("string"))),
                author(F.concat(F.lit("b"), (k % 11).cast("string")), "middle", F.lit("")),
                author(F.concat(F.lit("a"), (k % 23).cast("string")), "last", F.concat(F.lit("inst"), (k % 3).cast("string")))).alias("authorships"))


REL = "round(" + " + ".join(f"CASE WHEN contains(lower({SPACE.format('title')}), '{t}') THEN 4.0 ELSE 0 END + CASE WHEN contains(lower(abstract), '{t}') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(category), '{t}') THEN 2.0 ELSE 0 END" for t in TERMS) + \
    f" + least(citation_count, 1000) / 100.0 + CASE WHEN {NOW} - year <= 1 THEN 2.0 WHEN {NOW} - year <= 3 THEN 1.0 ELSE 0 END, 3)"
WORK = f"{P}, w AS (SELECT ordinal AS work_id, title, abstract, category AS topics, year, citation_count AS cited_by_count, doi, type, CAST({REL} AS DOUBLE) AS score, lower(title || ' ' || abstract || ' ' || category) AS low FROM p)"


@query("relevant_works", f"{WORK} SELECT work_id, score FROM w WHERE score > 0")
def _(spark, sf):
    return L.relevant_works(works(spark, sf), TERMS, NOW).select("work_id", "score")


@query("select_works", f"{WORK}, k AS (SELECT work_id, year, row_number() OVER (PARTITION BY year ORDER BY cited_by_count DESC, work_id) AS place FROM w WHERE type IN ('article', 'preprint', 'review')) SELECT * FROM k WHERE place <= 5")
def _(spark, sf):
    return L.select_works(works(spark, sf), "year", 5).select("work_id", "year", "place")


NT = " + ".join(f"max(CASE WHEN contains(low, '{t}') THEN 1 ELSE 0 END)" for t in TERMS)
MT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN max(CASE WHEN contains(low, '{t}') THEN 1 ELSE 0 END) = 1 THEN '{t}' END" for t in sorted(TERMS)) + "], lambda x: x IS NOT NULL), '; ')"
ROLL = f"""{WORK}, r AS (SELECT w.*, 'a' || CAST(work_id % 37 AS VARCHAR) AS author_id, 'first' AS position, 'inst' || CAST(work_id % 5 AS VARCHAR) AS institution FROM w UNION ALL SELECT w.*, 'b' || CAST(work_id % 11 AS VARCHAR), 'middle', '' FROM w
UNION ALL SELECT w.*, 'a' || CAST(work_id % 23 AS VARCHAR), 'last', 'inst' || CAST(work_id % 3 AS VARCHAR) FROM w),
b AS (SELECT author_id, 'Dr ' || author_id AS author_name, count(*) AS works, CAST(sum(cited_by_count) AS BIGINT) AS citations, round(sum(score), 3) AS relevance_score, count(*) FILTER (WHERE position IN ('first', 'last')) AS first_last, count(*) FILTER (WHERE position = 'first') AS "first",
count(*) FILTER (WHERE position = 'last') AS "last", count(*) FILTER (WHERE position = 'middle') AS middle, {MT} AS matched_terms, CAST({NT} AS BIGINT) AS n_terms FROM r GROUP BY 1),
i AS (SELECT author_id, institution, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, institution) AS k FROM r WHERE institution <> '' GROUP BY 1, 2),
o AS (SELECT author_id, work_id, row_number() OVER (PARTITION BY author_id ORDER BY score DESC, cited_by_count DESC, work_id) AS k FROM r), t AS (SELECT author_id, string_agg(CAST(work_id AS VARCHAR), ';' ORDER BY k) AS top_works FROM o WHERE k <= 10 GROUP BY 1),
f AS (SELECT b.*, coalesce(institution, '') AS institution, top_works FROM b LEFT JOIN i ON i.author_id = b.author_id AND i.k = 1 JOIN t ON t.author_id = b.author_id)"""


def rollup(spark, sf):
    return L.author_rollup(works(spark, sf), TERMS, NOW)


@query("author_rollup", f"{ROLL} SELECT * FROM f")
def _(spark, sf):
    return rollup(spark, sf)


@query("senior_authors", f'{ROLL} SELECT author_id, "last", first_last FROM f WHERE "last" >= 2 OR first_last >= 3')
def _(spark, sf):
    return L.senior_authors(rollup(spark, sf)).select("author_id", "last", "first_last")


FINAL = f"""{ROLL}, g AS (SELECT *, round(CAST(relevance_score + least(citations * 100.0, 300000) / 3000 + least(works * 10.0, 2000) / 200 + 3.0 * "last" + 1.5 * "first" + first_last + 0.5 * n_terms AS DOUBLE), 3) AS final_score FROM f)"""


def finals(spark, sf):
    return L.final_author_score(rollup(spark, sf), F.col("citations") * 100, F.col("works") * 10)


@query("final_author_score", f"{FINAL} SELECT author_id, final_score FROM g")
def _(spark, sf):
    return finals(spark, sf).select("author_id", "final_score")


@query("candidate_short_list", f'{ROLL} SELECT author_id, relevance_score FROM f ORDER BY f.relevance_score DESC, citations DESC, "last" DESC, works DESC, author_id LIMIT 24')
def _(spark, sf):
    return L.candidate_short_list(rollup(spark, sf), 8).select("author_id", "relevance_score")


@query("cap_per_institution", f"""{FINAL} SELECT author_id, institution, final_score FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN trim(institution) = '' THEN 'UNKNOWN' ELSE trim(institution) END ORDER BY final_score DESC, author_id) AS i FROM g) WHERE i <= 2""")
def _(spark, sf):
    return L.cap_per_institution(finals(spark, sf)).select("author_id", "institution", "final_score")


def flat_works(spark, sf):
    return works(spark, sf).select(F.explode("authorships.author_id").alias("author_id"), "work_id", "title", "abstract", "topics", "year", "cited_by_count", "doi")


@query("author_profiles", f"""{WORK}, r AS (SELECT w.*, 'a' || CAST(work_id % 37 AS VARCHAR) AS author_id FROM w UNION ALL SELECT w.*, 'b' || CAST(work_id % 11 AS VARCHAR) FROM w UNION ALL SELECT w.*, 'a' || CAST(work_id % 23 AS VARCHAR) FROM w),
y AS (SELECT author_id, string_agg(CAST(year AS VARCHAR) || ':' || CAST(c AS VARCHAR), '; ' ORDER BY year DESC) AS year_distribution FROM (SELECT author_id, year, count(*) AS c, row_number() OVER (PARTITION BY author_id ORDER BY year DESC) AS i FROM r WHERE year >= {NOW} - 9 GROUP BY 1, 2) WHERE i <= 10 GROUP BY 1)
SELECT r.author_id, {', '.join(f'count(*) FILTER (WHERE year >= {NOW} - {s - 1}) AS papers_{s}y, count(*) FILTER (WHERE year >= {NOW} - {s - 1} AND score > 0) AS relevant_{s}y' for s in (10, 5, 3))}, any_value(year_distribution) AS year_distribution FROM r JOIN y ON y.author_id = r.author_id GROUP BY 1""")
def _(spark, sf):
    out = L.author_profiles(flat_works(spark, sf), TERMS, NOW)
    return out.select("author_id", *[f"{k}_{s}y" for s in (10, 5, 3) for k in ("papers", "relevant")], "year_distribution")


@query("diverse_authors")
def _(spark, sf):
    prof = L.author_profiles(flat_works(spark, sf), TERMS, NOW).select("author_id", "dois")
    short = L.candidate_short_list(finals(spark, sf), 20)
    rows = short.join(prof, "author_id").withColumn("query", F.lit("q"))
    return L.diversify(rows, 10).select("author_id", "place", "final_score")


# ---- text functions ------------------------------------------------------------------------------


@query("strip_markup", None)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.strip_markup(F.col("html"))).alias("n"), F.md5(T.strip_markup(F.col("html"))).alias("digest"))


@query("normalize_space", f"SELECT doc_id, md5({SPACE.format('text')}) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


SENT = r"list_filter(string_split(regexp_replace({0}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')".format(SPACE.format("text"))


@query("split_sentences", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def _(spark, sf):
    s = T.split_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("sentence_excerpt")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sentence_excerpt(F.col("text")).alias("excerpt"))


@query("publication_dates", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN make_date(2000 + doc_id % 20, doc_id % 12 + 1, doc_id % 28 + 1) WHEN doc_id % 3 = 1 THEN make_date(2000 + doc_id % 20, doc_id % 12 + 1, 1) ELSE make_date(2000 + doc_id % 20, 1, 1) END AS day FROM documents""")
def _(spark, sf):
    k = F.col("doc_id").cast("int")
    y, m, d = k % 20 + 2000, k % 12 + 1, k % 28 + 1
    none = F.lit(None).cast("array<int>")
    return table(spark, sf, "documents").select("doc_id", T.publication_date(
        F.when(k % 3 == 0, F.array(y, m, d)), F.when(k % 3 == 1, F.array(y, m)).otherwise(F.when(k % 3 == 0, F.array(y))), F.when(k % 3 == 2, F.array(y)).otherwise(none)).alias("day"))


@query("abstract_sections")
def _(spark, sf):
    s = T.abstract_sections(F.col("text"))
    out = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return out.select("doc_id", *[F.md5(f"s.{c}").alias(c) for c in ("background", "methods", "results", "conclusions")])


@query("entity_mentions", r"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[nN][ \t\n\x0B\f\r]*[=:][ \t\n\x0B\f\r]*([0-9]+)', 1)), lambda x: x <> '')) AS n_sizes FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(T.sample_sizes(F.col("text")))).cast("long").alias("n_sizes"))


@query("gene_mentions")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.gene_mentions(t), ";").alias("genes"), F.array_join(T.p_values(t), ";").alias("p_values"),
                                                F.array_join(T.fold_changes(t), ";").alias("folds"))


@query("paper_impact", f"""{P} SELECT ordinal, {has('lower(journal)', [j.lower() for j in T.HIGH_TIER_JOURNALS])} AS high_tier, CASE WHEN contains(publication_types[1], 'Review') OR contains(publication_types[1], 'Meta') THEN 'Review/Meta-analysis' WHEN contains(publication_types[1], 'Clinical Trial') THEN 'Clinical Trial' ELSE 'Original Research' END AS category FROM p""")
def _(spark, sf):
    return papers(spark, sf).select("ordinal", T.is_high_tier(F.col("journal")).alias("high_tier"), T.publication_category(F.col("publication_types")).alias("category"))


@query("lab_types", f"""SELECT doc_id, CASE WHEN {has('t', T.COMPUTATIONAL_TERMS)} AND {has('t', T.EXPERIMENTAL_TERMS)} THEN 'hybrid' WHEN {has('t', T.COMPUTATIONAL_TERMS)} THEN 'computational' WHEN {has('t', T.EXPERIMENTAL_TERMS)} THEN 'experimental' ELSE 'unknown' END AS lab_type FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.lab_type(F.col("text")).alias("lab_type"))


@query("rebuild_abstract", f"SELECT doc_id, md5({SPACE.format('text')}) AS digest FROM documents")
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.split(T.normalize_space(F.col("text")), " ").alias("w"))
    pairs = F.transform("w", lambda x, i: F.struct(F.concat(x, F.lit("\u0001"), i.cast("string")).alias("k"), F.array(i).alias("p")))
    index = F.map_from_entries(pairs)
    out = words.select("doc_id", T.rebuild_abstract(index).alias("t"))
    return out.select("doc_id", F.md5(F.regexp_replace("t", "\u0001[0-9]+", "")).alias("digest"))


@query("topic_text", """SELECT doc_id, lang || ' (' || printf('%.2f', (doc_id % 100) / 100.0) || '); ' || source AS topics FROM documents""")
def _(spark, sf):
    none = F.lit(None).cast("double")
    t = F.array(F.struct(F.col("lang").alias("name"), (F.col("doc_id") % 100 / 100.0).alias("score")), F.struct(F.col("source").alias("name"), none.alias("score")), F.struct(F.lit("").alias("name"), none.alias("score")))
    return table(spark, sf, "documents").select("doc_id", L.flatten_topics(t).alias("topics"))
