"""Publication tables: filters, scores, counts, author roll-ups and diverse short lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.functions import text as T
from lociframe.functions.ordering import Level, scan, sorted_ranges
from lociframe.operators.sets import co_members
from lociframe.session import cut_lineage

# ---- filters -------------------------------------------------------------------------------------


def in_window(df: DataFrame, first: str, last: str, date: str = "pub_date") -> DataFrame:
    d = F.expr(f"try_cast({date} AS DATE)")
    return df.where(d.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def primary_articles(df: DataFrame) -> DataFrame:
    return df.where(~T.is_non_primary(F.col("title"), F.col("type"), F.col("abstract")))


def with_keywords(df: DataFrame, keywords: str) -> DataFrame:
    """Rows whose title or abstract holds any of the white-space separated words."""
    return df.where(T.contains_any(F.lower(F.concat_ws(" ", "title", "abstract")), keywords.lower().split()))


def in_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.contains(F.lower("category"), F.lit(category.lower())))


# Publication types behind the filter names.
PAPER_TYPES = {
    "review": ["Review"], "clinical_trial": ["Clinical Trial"], "meta_analysis": ["Meta-Analysis"], "original": ["Journal Article"],
}


def filter_papers(df: DataFrame, kind: str | None = None, journals: Sequence[str] | None = None) -> DataFrame:
    if kind:
        df = df.where(F.arrays_overlap("publication_types", F.array(*[F.lit(t) for t in PAPER_TYPES.get(kind, [])])))
    if journals:
        df = df.where(T.contains_any(F.lower("journal"), [j.strip().lower() for j in journals]))
    return df


def affiliation_filter(df: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    low = F.lower("affiliation")
    if exclude:
        df = df.where(~F.contains(low, F.lit(exclude.lower())))
    if include:
        df = df.where(F.contains(low, F.lit(include.lower())))
    return df


def sort_papers(df: DataFrame, by: str = "relevance") -> DataFrame:
    """By date or citations, newest or most cited first; relevance keeps the given ordinal."""
    keys = {"date": [F.desc("pub_date"), F.col("ordinal")], "citations": [F.desc("citations"), F.col("ordinal")]}
    return df.orderBy(*keys.get(by, [F.col("ordinal")]))


# ---- enrichment and scores -----------------------------------------------------------------------


def enrich_abstracts(df: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached abstracts by lower-cased DOI, else the row's own; and the pairs that the cache lacks."""
    keyed = df.withColumn("__k", F.lower(F.trim("doi")))
    table = cache.select(F.lower("doi").alias("__k"), F.col("abstract").alias("__a")).dropDuplicates(["__k"])
    out = keyed.join(table, "__k", "left").withColumn("abstract", T.normalize_space(F.coalesce("__a", "abstract_own")))
    new = keyed.join(table, "__k", "left_anti").select(F.col("__k").alias("doi"), T.normalize_space(F.col("abstract_own")).alias("abstract"))
    return out.drop("__k", "__a"), new.dropDuplicates(["doi"])


def attach_citations(df: DataFrame, counts: DataFrame, key: str = "pmid") -> DataFrame:
    return df.join(counts.select(key, F.col("citations").alias("__c")), key, "left").withColumn(
        "citations", F.coalesce("__c", F.lit(0))).drop("__c")


def score_papers(df: DataFrame, interest: Sequence[str] = (), field_weight: float = 1.0, interest_weight: float = 2.0) -> DataFrame:
    """Score columns and matched keywords from title, abstract, subjects, journal and citations.

    Interest keywords are expected in lower case.
    """
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("subjects", F.lit(""))))
    title = F.lower("title")
    bonus = (F.when(F.contains(title, F.lit("benchmark")), 1.5).otherwise(0.0) + F.when(F.contains(title, F.lit("atlas")), 1.0).otherwise(0.0)
             + F.when(F.contains(title, F.lit("resource")), 1.0).otherwise(0.0))
    out = (
        df.withColumn("matched_field_keywords", T.found_terms(low, list(T.FIELD_KEYWORDS)))
        .withColumn("matched_interest_keywords", T.found_terms(low, list(interest)) if interest else F.array().cast("array<string>"))
        .withColumn("field_score", F.round(T.field_score(low), 3))
        .withColumn("journal_score", T.journal_score(F.col("journal")))
        .withColumn("citation_bonus", F.round(F.least(F.coalesce("citation_count", F.lit(0)).cast("double"), F.lit(50.0)) * 0.03, 3))
        .withColumn("abstract_bonus", F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", 1.0).otherwise(0.0))
        .withColumn("bonus_score", bonus)
    )
    total = (F.col("journal_score") + F.col("field_score") * field_weight + F.size("matched_interest_keywords") * interest_weight
             + F.col("citation_bonus") + F.col("abstract_bonus") + F.col("bonus_score"))
    return out.withColumn("impact_score", F.round(total, 3))


def candidates(scored: DataFrame, min_field: float = 2.0, min_impact: float = 11.0) -> DataFrame:
    return scored.where((F.col("field_score") >= min_field) | (F.col("impact_score") >= min_impact))


def top_papers(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("impact_score"), F.desc("citation_count"), "journal", F.desc("pub_date"), "doi").limit(n)


def summarize_papers(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Why it matters and major discoveries from the abstract, and the remarks of a rule table (term, remark)."""
    s = T.split_sentences(F.col("abstract"))
    out = df.withColumn("__s", s)
    first = F.get("__s", F.lit(0))
    rest = F.array_join(F.slice("__s", 2, 2), " ")
    unknown = F.lit("(no abstract)")
    return (
        out.withColumn("why_it_matters", F.coalesce(first, F.concat_ws(" ", unknown, "journal")))
        .withColumn("major_discoveries", F.when(first.isNull(), unknown).when(F.size("__s") > 1, rest).otherwise(first))
        .withColumn("significance", T.significance_text(F.lower(F.concat_ws(" ", "title", "abstract")), F.array_join("matched_field_keywords", "; "), rules))
        .drop("__s")
    )


# ---- counts --------------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def token_counts(df: DataFrame, text: Column, top: int = 20, stopwords: Sequence[str] = T.STOPWORDS) -> DataFrame:
    """Most frequent lower-case letter runs of more than three letters that stand between word boundaries."""
    tokens = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))).alias("token"))
    kept = tokens.where((F.length("token") > 3) & ~F.col("token").isin(*stopwords))
    return kept.groupBy("token").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "token").limit(top)


def mixed_term_counts(df: DataFrame, abstract: str, terms: str, top: int = 15, stopwords: Sequence[str] = T.TERM_STOPWORDS) -> DataFrame:
    """Counts of listed terms (separated by semicolons) and abstract words without edge punctuation."""
    strip = lambda w: F.regexp_replace(w, r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$", "")
    words = df.select(F.explode(F.split(F.lower(F.trim(abstract)), r"\s+")).alias("w")).select(strip(F.col("w")).alias("term"))
    words = words.where((F.length("term") > 3) & ~F.col("term").isin(*stopwords))
    listed = df.where(F.col(terms) != "").select(F.explode(F.split(terms, ";")).alias("t")).select(F.trim("t").alias("term"))
    both = words.unionByName(listed)
    return both.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(top)


def prolific_authors(df: DataFrame, authors: str = "authors", top: int = 20) -> DataFrame:
    rows = df.select(F.explode(authors).alias("author"))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "author").limit(top)


def keyword_titles(df: DataFrame, keywords: Sequence[str], per_keyword: int = 3) -> DataFrame:
    """First titles, by ordinal, that mention each keyword."""
    low = F.lower(F.concat_ws(" ", "title", "abstract"))
    hits = df.select("ordinal", "title", F.explode(T.found_terms(low, list(keywords))).alias("keyword"))
    w = W.partitionBy("keyword").orderBy("ordinal")
    first = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_keyword)
    return first.groupBy("keyword").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]), " | ").alias("top_papers"))


def pair_counts(df: DataFrame, group: str, member: str, min_count: int = 1, tile: int = 64) -> DataFrame:
    """Number of groups that hold both members, for member pairs (a < b).

    Members under ``min_count`` groups cannot reach it in a pair and go first. A large group is cut into
    tiles, and each pair of tiles is one row, so its pairs are formed and pre-counted in many tasks.
    """
    rows = df.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    if min_count > 1:
        rows = cut_lineage(rows)
        often = rows.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_count)
        rows = rows.join(often.select("m"), "m", "left_semi")
    rows = cut_lineage(rows)
    parts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    tiled = rows.join(parts, "g").withColumn("t", F.pmod(F.xxhash64("m"), F.col("parts")))
    packs = tiled.groupBy("g", "t").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list("m")).alias("ms"))
    sides = packs.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "g", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "ms")
    met = sides.groupBy("g", "ta", "tb").agg(
        F.max(F.when(F.col("t") == F.col("ta"), F.col("ms"))).alias("x"), F.max(F.when(F.col("t") == F.col("tb"), F.col("ms"))).alias("y"))
    met = met.where("x is not null and y is not null").withColumn("same", F.col("ta") == F.col("tb"))
    exploded = met.select("same", "y", F.explode("x").alias("p")).select("same", "p", F.explode("y").alias("q"))
    pairs = exploded.where((~F.col("same") & (F.col("p") != F.col("q"))) | (F.col("p") < F.col("q"))).select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    return out.where(F.col("count") >= min_count) if min_count > 1 else out


def collaborators(df: DataFrame, min_papers: int = 2) -> DataFrame:
    """Authors by 10·topics + ln(1 + papers) with their three main journals.

    df: author, topic, pmid, journal; a paper counts once per topic, as the pairs are given.
    """
    df = cut_lineage(df)
    base = df.groupBy("author").agg(F.count(F.lit(1)).alias("n_papers"), F.count_distinct("topic").alias("topics_covered"))
    base = base.where(F.col("n_papers") >= min_papers).withColumn(
        "rank_score", F.col("topics_covered") * 10 + F.log1p(F.col("n_papers").cast("double")))
    papers = df.select("author", "pmid", "journal").distinct()
    counts = papers.groupBy("author", "journal").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("author").orderBy(F.desc("c"), "journal")
    best = counts.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("author").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "journal"))), lambda s: s["journal"]), "; ").alias("top_journals"))
    return base.join(best, "author", "left")


def author_topic_matrix(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    return df.groupBy("author").pivot("topic", list(topics)).agg(F.count(F.lit(1))).na.fill(0)


def author_topic_links(authors: DataFrame, topics: DataFrame) -> DataFrame:
    """Author rows (pmid, authors ARRAY<STRUCT<name, affiliation>>, ...) joined to the topics of each paper."""
    rows = authors.withColumn("a", F.explode("authors")).select("pmid", "journal", F.col("a.name").alias("author"), F.col("a.affiliation").alias("affiliation"))
    return rows.join(topics.select("pmid", "topic"), "pmid")


# ---- works and authors ---------------------------------------------------------------------------

# Work types that count.
WORK_TYPES = ("article", "preprint", "review")


def small_collaborations(works: DataFrame, max_authors: int = 20) -> DataFrame:
    return works.where(F.size("authorships") <= max_authors)


def select_works(works: DataFrame, key: str, n: int, max_authors: int = 20) -> DataFrame:
    """The most cited works of allowed types and team size per key."""
    ok = small_collaborations(works.where(F.lower("type").isin(*WORK_TYPES)), max_authors)
    w = W.partitionBy(key).orderBy(F.desc("cited_by_count"), "work_id")
    return ok.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def relevant_works(works: DataFrame, terms: Sequence[str], this_year: int) -> DataFrame:
    """Works with a positive relevance score (title, abstract, topics, cited_by_count, year)."""
    score = T.work_relevance(F.col("title"), F.col("abstract"), F.col("topics"), F.col("cited_by_count"), F.col("year"), terms, this_year)
    return works.withColumn("score", score).where(F.col("score") > 0)


def author_rollup(works: DataFrame, terms: Sequence[str], this_year: int, top: int = 10) -> DataFrame:
    """Authors over scored works: counts by position, citations, matched terms, main institution, best works."""
    low = F.lower(F.concat_ws(" ", "title", "abstract", "topics"))
    score = T.work_relevance(F.col("title"), F.col("abstract"), F.col("topics"), F.col("cited_by_count"), F.col("year"), terms, this_year)
    rows = works.withColumn("score", score).withColumn("terms", T.found_terms(low, list(terms))).withColumn(
        "a", F.explode("authorships")).where(F.coalesce(F.col("a.author_id"), F.lit("")) != "").select(
        "work_id", "title", "year", "cited_by_count", "doi", "score", "terms", "a.author_id", "a.author_name", "a.position", "a.institution")
    rows = cut_lineage(rows)
    pos = F.col("position")
    base = rows.groupBy("author_id").agg(
        F.min("author_name").alias("author_name"), F.count(F.lit(1)).alias("works"), F.sum("cited_by_count").alias("citations"),
        F.round(F.sum("score"), 3).alias("relevance_score"), F.count_if(pos.isin("first", "last")).alias("first_last"),
        F.count_if(pos == "first").alias("first"), F.count_if(pos == "last").alias("last"),
        F.count_if(~pos.isin("first", "last")).alias("middle"))
    seen = rows.select("author_id", F.explode("terms").alias("t")).groupBy("author_id").agg(
        F.array_join(F.sort_array(F.collect_set("t")), "; ").alias("matched_terms"), F.count_distinct("t").alias("n_terms"))
    inst = modal_value(rows.where("institution <> ''"), "author_id", "institution")
    w = W.partitionBy("author_id").orderBy(F.desc("score"), F.desc("cited_by_count"), "work_id")
    best = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top).groupBy("author_id").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "work_id"))), lambda s: s["work_id"].cast("string")), ";").alias("top_works"))
    return base.join(seen, "author_id", "left").join(inst, "author_id", "left").join(best, "author_id", "left").na.fill(
        {"matched_terms": "", "n_terms": 0, "institution": ""})


def modal_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("c")).alias("k"), F.col(value).alias("v"))).alias("b")).select(
        key, F.col("b.v").alias(value))


def senior_authors(rolled: DataFrame, min_last: int = 2, min_first_last: int = 3) -> DataFrame:
    return rolled.where((F.col("last") >= min_last) | (F.col("first_last") >= min_first_last))


def final_author_score(rolled: DataFrame, total_citations: Column, total_works: Column) -> DataFrame:
    s = (F.col("relevance_score") + F.least(total_citations.cast("double"), F.lit(300000.0)) / 3000.0
         + F.least(total_works.cast("double"), F.lit(2000.0)) / 200.0 + 3.0 * F.col("last") + 1.5 * F.col("first")
         + 1.0 * F.col("first_last") + 0.5 * F.col("n_terms"))
    return rolled.withColumn("final_score", F.round(s, 3))


def candidate_short_list(rolled: DataFrame, top: int) -> DataFrame:
    return rolled.orderBy(F.desc("relevance_score"), F.desc("citations"), F.desc("last"), F.desc("works"), "author_id").limit(3 * top)


def author_profiles(works: DataFrame, terms: Sequence[str], this_year: int, top: int = 5) -> DataFrame:
    """Per author: papers and relevant papers of 10, 5 and 3 years, year distribution, tags and best-work lists.

    works: author_id, work_id, title, abstract, topics, year, cited_by_count, doi.
    """
    score = T.work_relevance(F.col("title"), F.col("abstract"), F.col("topics"), F.col("cited_by_count"), F.col("year"), terms, this_year)
    rows = cut_lineage(works.withColumn("score", score))
    y = F.col("year")
    aggs = []
    for span in (10, 5, 3):
        recent = y >= this_year - span + 1
        aggs += [F.count_if(recent).alias(f"papers_{span}y"), F.count_if(recent & (F.col("score") > 0)).alias(f"relevant_{span}y")]
    low = F.lower(F.concat_ws(" ", "title", "abstract", "topics"))
    tags = [F.array_compact(F.array(*[F.when(F.max(F.contains(low, F.lit(t))), F.lit(t)) for t in group])).alias(name)
            for name, group in (("methods", T.METHOD_TAGS), ("topics_found", T.TOPIC_TAGS))]
    base = rows.groupBy("author_id").agg(*aggs, *tags)
    recent10, recent5 = rows.where(y >= this_year - 9), rows.where(y >= this_year - 4)
    years = recent10.groupBy("author_id", "year").agg(F.count(F.lit(1)).alias("c")).groupBy("author_id").agg(
        F.sort_array(F.collect_list(F.struct("year", "c")), False).alias("ys"))
    dist = years.select("author_id", F.array_join(F.transform(F.slice("ys", 1, 10), lambda s: F.concat_ws(":", s["year"].cast("string"), s["c"].cast("string"))), "; ").alias("year_distribution"))

    def best(src: DataFrame, order: list[Column], name: str) -> DataFrame:
        w = W.partitionBy("author_id").orderBy(*order, "work_id")
        text = F.concat("title", F.lit(" ["), F.col("year").cast("string"), F.lit("; cites="), F.col("cited_by_count").cast("string"),
                        F.when(F.coalesce(F.col("doi"), F.lit("")) != "", F.concat(F.lit("; doi="), "doi")).otherwise(""), F.lit("]"))
        rowsb = src.withColumn("i", F.row_number().over(w)).where(F.col("i") <= top)
        listed = F.sort_array(F.collect_list(F.struct("i", text.alias("t"), F.coalesce("doi", F.lit("")).alias("d"))))
        out = rowsb.groupBy("author_id").agg(listed.alias("l"))
        dois = F.array_distinct(F.filter(F.transform("l", lambda s: F.lower(s["d"])), lambda d: d != ""))
        return out.select("author_id", F.array_join(F.transform("l", lambda s: s["t"]), " | ").alias(name), dois.alias(f"{name}_dois"))

    out = base.join(dist, "author_id", "left")
    for src, order, name in (
        (recent10, [F.desc("cited_by_count")], "overall"), (rows.where("score > 0"), [F.desc("score"), F.desc("cited_by_count")], "relevant"),
        (recent5, [F.desc("year"), F.desc("cited_by_count")], "recent"),
    ):
        out = out.join(best(src, order, name), "author_id", "left")
    empty = F.array().cast("array<string>")
    dois = F.array_distinct(F.concat(*[F.coalesce(f"{n}_dois", empty) for n in ("overall", "relevant", "recent")]))
    text = F.concat_ws(" ", F.array_join("methods", "; "), F.array_join("topics_found", "; "))
    return out.withColumn("dois", dois).withColumn("lab_type", T.lab_type(text)).drop("overall_dois", "relevant_dois", "recent_dois")


def cap_per_institution(rows: DataFrame, cap: int = 2, score: str = "final_score") -> DataFrame:
    inst = F.when(F.coalesce(F.trim("institution"), F.lit("")) == "", "UNKNOWN").otherwise(F.trim("institution"))
    w = W.partitionBy("__inst").orderBy(F.desc(score), "author_id")
    return rows.withColumn("__inst", inst).withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= cap).drop("__inst", "__i")


def diversify(rows: DataFrame, top: int, max_overlap: int = 2, score: str = "final_score") -> DataFrame:
    """Keep rows by falling score, leaving out those that share more than the overlap with a kept one.

    The greedy choice is the first independent set, in the order of the scores, of the graph of rows that share too
    many DOIs. In each round a row without an earlier open rival is kept, and its later rivals go; the rounds follow the
    longest chain of rivals that decide each other and not the number of rows. rows: query, author_id, dois, score.
    """
    order = [F.col("query"), F.desc(score), F.col("author_id")]
    placed = scan(sorted_ranges(rows.select("query", "author_id", score, "dois"), order), [Level(("query",), {"__i": None})]).withColumnRenamed("__i_run", "__at")
    name = F.struct("query", F.col("__at").alias("at"))
    placed = cut_lineage(placed.select("query", "author_id", "__at", "dois", F.to_json(name).alias("__k")))
    members = placed.select(F.col("__k").alias("set_id"), F.explode("dois").alias("d"), "query").select("set_id", F.to_json(F.struct("query", "d")).alias("item")).distinct()
    met = co_members(members).where(F.col("intersection") > max_overlap)
    at = placed.select("__k", "__at")
    ends = met.join(at.toDF("a", "at_a"), "a").join(at.toDF("b", "at_b"), "b")
    first = F.col("at_a") < F.col("at_b")
    rivals = cut_lineage(ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")))
    open_rows, kept = placed.select("__k"), None
    while True:
        chosen = cut_lineage(open_rows.join(rivals.select(F.col("late").alias("__k")), "__k", "left_anti"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        gone = rivals.join(chosen.withColumnRenamed("__k", "early"), "early", "left_semi").select(F.col("late").alias("__k")).distinct()
        if rivals.isEmpty():
            break
        open_rows = cut_lineage(open_rows.join(chosen, "__k", "left_anti").join(gone, "__k", "left_anti"))
        still = open_rows.select("__k")
        rivals = cut_lineage(rivals.join(still.withColumnRenamed("__k", "early"), "early", "left_semi").join(still.withColumnRenamed("__k", "late"), "late", "left_semi"))
    best = placed.join(kept, "__k")
    w = W.partitionBy("query").orderBy("__at")  # at most top rows of a query stay
    found = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("query", "author_id", "place")
    return rows.join(found, ["query", "author_id"])


def flatten_topics(topics: Column, n: int = 5) -> Column:
    """'name (0.12)' of the first topics (ARRAY<STRUCT<name, score>>)."""
    one = lambda t: F.when(t["score"].isNotNull(), F.concat(t["name"], F.lit(" ("), F.format_string("%.2f", t["score"]), F.lit(")"))).otherwise(t["name"])
    return F.array_join(F.transform(F.filter(F.slice(topics, 1, n), lambda t: F.coalesce(t["name"], F.lit("")) != ""), one), "; ")
