"""JSON and XML records of web services, read from landed dumps with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import text as T

EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(EMPTY)


def parse_json(df: DataFrame, column: str, schema: str, out: str = "rec") -> DataFrame:
    return df.withColumn(out, F.from_json(column, schema))


# ---- publications --------------------------------------------------------------------------------

ARTICLE = """
MedlineCitation STRUCT<
  PMID: STRUCT<_VALUE: STRING, _Version: STRING>,
  Article: STRUCT<
    Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<Volume: STRING, PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>,
    ArticleTitle: STRING, Pagination: STRUCT<MedlinePgn: STRING>,
    Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>,
    AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, Initials: STRING, Affiliation: STRING, AffiliationInfo: STRUCT<Affiliation: STRING>>>>,
    PublicationTypeList: STRUCT<PublicationType: ARRAY<STRUCT<_VALUE: STRING, _UI: STRING>>>>,
  MeshHeadingList: STRUCT<MeshHeading: ARRAY<STRUCT<DescriptorName: STRUCT<_VALUE: STRING, _UI: STRING>>>>,
  KeywordList: STRUCT<Keyword: ARRAY<STRUCT<_VALUE: STRING, _MajorTopicYN: STRING>>>>,
PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>
"""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """PubMed XML dumps as one struct column ``rec`` per article."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path)
    return raw.select(F.struct("MedlineCitation", "PubmedData").alias("rec"))


def parse_articles(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("rec", F.from_xml(F.col(column), ARTICLE))


def article_rows(df: DataFrame) -> DataFrame:
    """Publication rows of parsed articles; those without an id are left out."""
    c = F.col("rec.MedlineCitation")
    a = c["Article"]
    values = lambda x: F.filter(F.transform(F.coalesce(x, F.array()), lambda v: F.trim(v["_VALUE"])), lambda v: v.isNotNull() & (v != ""))
    names = F.transform(F.filter(a["AuthorList"]["Author"], lambda x: F.coalesce(x["LastName"], F.lit("")) != ""),
                        lambda x: F.trim(F.concat_ws(" ", x["LastName"], x["Initials"])))
    doi = F.get(F.filter(F.col("rec.PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    date = a["Journal"]["JournalIssue"]["PubDate"]
    parts = F.transform(F.filter(a["Abstract"]["AbstractText"], lambda t: t["_VALUE"].isNotNull()), lambda t: F.trim(t["_VALUE"]))
    rest = [x for x in df.columns if x != "rec"]
    blank = lambda x: F.coalesce(F.trim(x), F.lit(""))
    out = df.select(
        *rest, c["PMID"]["_VALUE"].alias("pmid"), blank(a["ArticleTitle"]).alias("title"), F.coalesce(names, _empty()).alias("authors"),
        blank(a["Journal"]["Title"]).alias("journal"), F.coalesce(date["Year"], F.substring(date["MedlineDate"], 1, 4), F.lit("")).alias("year"),
        blank(a["Journal"]["JournalIssue"]["Volume"]).alias("volume"), blank(a["Pagination"]["MedlinePgn"]).alias("pages"), blank(doi).alias("doi"),
        F.coalesce(F.array_join(parts, " "), F.lit("")).alias("abstract"), values(a["PublicationTypeList"]["PublicationType"]).alias("publication_types"),
        F.coalesce(F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: m["DescriptorName"]["_VALUE"]), _empty()).alias("mesh_terms"),
        values(c["KeywordList"]["Keyword"]).alias("keywords"))
    return out.where(F.coalesce("pmid", F.lit("")) != "")


def article_authors(df: DataFrame) -> DataFrame:
    """(pmid, journal, author, affiliation) rows."""
    c = F.col("rec.MedlineCitation")
    rows = df.select(c["PMID"]["_VALUE"].alias("pmid"), c["Article"]["Journal"]["Title"].alias("journal"), F.explode(c["Article"]["AuthorList"]["Author"]).alias("x"))
    return rows.where(F.coalesce("x.LastName", F.lit("")) != "").select(
        "pmid", "journal", F.trim(F.concat_ws(" ", "x.LastName", "x.Initials")).alias("author"),
        F.coalesce("x.Affiliation", "x.AffiliationInfo.Affiliation", F.lit("N/A")).alias("affiliation"))


DATE_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF = f"""
DOI STRING, title ARRAY<STRING>, `container-title` ARRAY<STRING>, abstract STRING, author ARRAY<STRUCT<given: STRING, family: STRING>>,
subject ARRAY<STRING>, URL STRING, `is-referenced-by-count` BIGINT, type STRING,
`published-print` {DATE_PARTS}, `published-online` {DATE_PARTS}, published {DATE_PARTS}
"""


def crossref_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Flat publication rows of parsed Crossref items."""
    r = F.col(rec)
    first = lambda x: T.normalize_space(F.get(x, F.lit(0)))
    names = F.filter(F.transform(r["author"], lambda a: T.normalize_space(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    part = lambda k: F.get(r[k]["date-parts"], F.lit(0))
    rest = [x for x in df.columns if x != rec]
    return df.select(
        *rest, T.normalize_space(r["DOI"]).alias("doi"), first(r["title"]).alias("title"), first(r["container-title"]).alias("journal"),
        T.publication_date(part("published-print"), part("published-online"), part("published")).alias("pub_date"), T.strip_markup(r["abstract"]).alias("abstract"),
        F.coalesce(F.array_join(F.slice(names, 1, 12), "; "), F.lit("")).alias("authors"), T.normalize_space(r["URL"]).alias("url"),
        F.coalesce(F.array_join(F.transform(r["subject"], T.normalize_space), "; "), F.lit("")).alias("subjects"),
        F.coalesce(r["is-referenced-by-count"], F.lit(0)).alias("citation_count"), T.normalize_space(r["type"]).alias("type"))


PREPRINT = "doi STRING, title STRING, authors STRING, category STRING, date STRING, abstract STRING"


def preprint_rows(df: DataFrame, server: str, rec: str = "rec") -> DataFrame:
    """Preprint rows with the first ten authors."""
    r = F.col(rec)
    names = F.slice(F.filter(F.transform(F.split(r["authors"], "[;,]"), lambda a: F.trim(a)), lambda a: a != ""), 1, 10)
    blank = lambda x: F.coalesce(x, F.lit(""))
    rest = [x for x in df.columns if x != rec]
    return df.select(*rest, blank(r["doi"]).alias("doi"), blank(r["title"]).alias("title"), F.coalesce(names, _empty()).alias("authors"),
                     F.coalesce(r["category"], F.lit("Unknown")).alias("category"), blank(r["date"]).alias("date"), blank(r["abstract"]).alias("abstract"), F.lit(server).alias("server"))


ATOM = "id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name: STRING>>"


def atom_rows(df: DataFrame, column: str) -> DataFrame:
    """Atom entries (XML text) as publication rows."""
    rest = [x for x in df.columns if x != column]
    e = df.withColumn("__e", F.from_xml(F.col(column), ATOM))
    return e.select(*rest, F.col("__e.id").alias("id"), T.normalize_space(F.col("__e.title")).alias("title"), T.normalize_space(F.col("__e.summary")).alias("abstract"),
                    F.substring("__e.published", 1, 4).alias("year"), F.transform("__e.author", lambda a: a["name"]).alias("authors"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines as a struct column ``rec``."""
    raw = spark.read.schema(schema).json(path)
    return raw.select(F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("rec"))


# ---- proteins ------------------------------------------------------------------------------------

FEATURES = "primaryAccession STRING, features ARRAY<STRUCT<type: STRING, description: STRING, location: STRUCT<start: STRUCT<value: INT>, end: STRUCT<value: INT>>>>"


def protein_features(df: DataFrame, rec: str = "rec") -> DataFrame:
    """(accession, type, start, end, description, length) of features with both ends."""
    rows = df.select(F.col(f"{rec}.primaryAccession").alias("accession"), F.explode(f"{rec}.features").alias("f"))
    s, e = F.col("f.location.start.value"), F.col("f.location.end.value")
    return rows.where(s.isNotNull() & e.isNotNull()).select("accession", "f.type", s.alias("start"), e.alias("end"),
                                                           F.coalesce("f.description", F.lit("")).alias("description"), (e - s + 1).alias("length"))


def natural_variants(df: DataFrame, rec: str = "rec") -> DataFrame:
    """(accession, pos, wt_aa, mut_aa, impact_class, description) of variant and mutagenesis features."""
    rows = df.select(F.col(f"{rec}.primaryAccession").alias("accession"), F.explode(f"{rec}.features").alias("f")).where(
        F.col("f.type").isin("Natural variant", "Mutagenesis") & F.col("f.location.start.value").isNotNull())
    d = F.coalesce("f.description", F.lit(""))
    low = F.lower(d)
    letter = lambda i: F.coalesce(F.nullif(F.regexp_extract(d, r"([A-Z])\s*->\s*([A-Z*])", i), F.lit("")), F.lit("?"))
    impact = F.when(low.rlike("pathogenic|disease|associated with"), "pathogenic").when(low.rlike("benign|polymorphism|no effect"), "benign").otherwise("uncertain")
    return rows.select("accession", F.col("f.location.start.value").cast("long").alias("pos"), letter(1).alias("wt_aa"), letter(2).alias("mut_aa"),
                       impact.alias("impact_class"), d.alias("description"))


PDB_ENTRY = """
rcsb_id STRING, struct STRUCT<title: STRING>, rcsb_entry_info STRUCT<resolution_combined: ARRAY<DOUBLE>, experimental_method: STRING, deposited_atom_count: BIGINT,
polymer_entity_count_protein: INT>, rcsb_entry_container_identifiers STRUCT<pubmed_id: BIGINT>, audit_author ARRAY<STRUCT<name: STRING>>,
pdbx_audit_revision_history ARRAY<STRUCT<revision_date: STRING>>
"""


def structure_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Structure catalogue rows; more than three authors become 'et al. (+n)'."""
    r = F.col(rec)
    info = r["rcsb_entry_info"]
    n = F.coalesce(F.size(r["audit_author"]), F.lit(0))
    lead = F.coalesce(F.array_join(F.transform(F.slice(r["audit_author"], 1, 3), lambda a: F.coalesce(a["name"], F.lit(""))), "; "), F.lit(""))
    authors = F.when(n > 3, F.concat(lead, F.lit(" et al. (+"), (n - 3).cast("string"), F.lit(")"))).otherwise(lead)
    rest = [x for x in df.columns if x != rec]
    return df.select(
        *rest, F.upper(r["rcsb_id"]).alias("pdb_id"), F.coalesce(r["struct"]["title"], F.lit("")).alias("title"), F.coalesce(info["experimental_method"], F.lit("")).alias("method"),
        F.round(F.get(info["resolution_combined"], F.lit(0)), 2).alias("resolution"), info["polymer_entity_count_protein"].alias("n_protein_chains"),
        info["deposited_atom_count"].alias("n_atoms"), r["rcsb_entry_container_identifiers"]["pubmed_id"].alias("pubmed_id"), authors.alias("authors"),
        F.coalesce(F.get(r["pdbx_audit_revision_history"], F.lit(0))["revision_date"], F.lit("")).alias("deposition_date"))


PREDICTION = """entryId STRING, uniprotAccession STRING, gene STRING, organismScientificName STRING, sequenceLength INT, modelCreatedDate STRING,
latestVersion INT, pdbUrl STRING, cifUrl STRING, paeImageUrl STRING"""


def prediction_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Predicted structure rows; the latest version of each accession."""
    r = F.col(rec)
    flat = df.select(r["uniprotAccession"].alias("accession"), F.struct(r["latestVersion"].alias("version"), r["entryId"].alias("entry_id"), r["gene"].alias("gene"),
                     r["organismScientificName"].alias("organism"), r["sequenceLength"].alias("seq_length"), r["pdbUrl"].alias("pdb_url")).alias("s"))
    best = flat.groupBy("accession").agg(F.max("s").alias("s"))
    return best.select("accession", "s.*")


def choose_protein(entries: DataFrame) -> DataFrame:
    """Per gene the first reviewed entry, else the first (gene, accession, reviewed, ordinal, length)."""
    best = entries.groupBy("gene").agg(F.min(F.struct(F.when(F.col("reviewed"), 0).otherwise(1).alias("k"), "ordinal", "accession", "length")).alias("b"))
    return best.select("gene", F.col("b.accession").alias("accession"), F.coalesce("b.length", F.lit(0)).alias("length"))


CURATED = """
primaryAccession STRING, genes ARRAY<STRUCT<geneName: STRUCT<value: STRING>, synonyms: ARRAY<STRUCT<value: STRING>>>>,
proteinDescription STRUCT<recommendedName: STRUCT<fullName: STRUCT<value: STRING>>>, organism STRUCT<scientificName: STRING>,
comments ARRAY<STRUCT<commentType: STRING, texts: ARRAY<STRUCT<value: STRING>>>>, keywords ARRAY<STRUCT<name: STRING>>,
uniProtKBCrossReferences ARRAY<STRUCT<database: STRING, id: STRING>>
"""


def curated_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Candidate rows of protein entries: first gene name, synonyms, function text, first five references."""
    r = F.col(rec)
    names = F.filter(F.transform(r["genes"], lambda g: g["geneName"]["value"]), lambda v: F.coalesce(v, F.lit("")) != "")
    syn = F.filter(F.flatten(F.transform(r["genes"], lambda g: F.coalesce(F.transform(g["synonyms"], lambda s: s["value"]), _empty()))), lambda v: F.coalesce(v, F.lit("")) != "")
    func = F.get(F.get(F.filter(r["comments"], lambda c: c["commentType"] == "FUNCTION"), F.lit(0))["texts"], F.lit(0))["value"]
    refs = F.transform(F.filter(r["uniProtKBCrossReferences"], lambda x: (x["database"] == "PubMed") & (F.coalesce(x["id"], F.lit("")) != "")), lambda x: x["id"])
    rest = [x for x in df.columns if x != rec]
    return df.select(
        *rest, r["primaryAccession"].alias("accession"), F.coalesce(F.get(names, F.lit(0)), F.get(syn, F.lit(0)), F.lit("")).alias("symbol"),
        F.coalesce(syn, _empty()).alias("synonyms"), F.coalesce(r["proteinDescription"]["recommendedName"]["fullName"]["value"], F.lit("")).alias("protein_name"),
        F.coalesce(r["organism"]["scientificName"], F.lit("")).alias("organism_name"), F.coalesce(F.substring(func, 1, 250), F.lit("")).alias("function_text"),
        F.coalesce(F.slice(refs, 1, 5), _empty()).alias("pmids"))


# ---- clinical ------------------------------------------------------------------------------------

CASE = """
case_id STRING, submitter_id STRING, demographic STRUCT<vital_status: STRING, days_to_death: DOUBLE>,
diagnoses ARRAY<STRUCT<vital_status: STRING, days_to_death: DOUBLE, days_to_last_follow_up: DOUBLE, days_to_recurrence: DOUBLE, progression_or_recurrence: STRING>>,
follow_ups ARRAY<STRUCT<days_to_follow_up: DOUBLE, progression_or_recurrence: STRING, disease_response: STRING>>,
samples ARRAY<STRUCT<sample_type: STRING>>
"""


def clinical_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """One row per case: first diagnosis, first non-empty status, earliest progression with recurrence as fallback."""
    r = F.col(rec)
    d = F.get(r["diagnoses"], F.lit(0))
    text = lambda x: F.nullif(F.trim(x), F.lit(""))

    def progressed(f: Column) -> Column:
        prog, resp = F.lower(F.trim(F.coalesce(f["progression_or_recurrence"], F.lit("")))), F.lower(F.coalesce(f["disease_response"], F.lit("")))
        hit = prog.isin("yes", "yes, progression", "yes, recurrence") | F.contains(resp, F.lit("progressive")) | F.contains(resp, F.lit("recurrence"))
        return hit & f["days_to_follow_up"].isNotNull()

    earliest = F.array_min(F.transform(F.filter(r["follow_ups"], progressed), lambda f: f["days_to_follow_up"]))
    by_diag = d["days_to_recurrence"].isNotNull() & (earliest.isNull() | (d["days_to_recurrence"] < earliest))
    flag = F.when(by_diag, F.coalesce(text(d["progression_or_recurrence"]), F.lit("yes"))).when(earliest.isNotNull(), "yes").otherwise(d["progression_or_recurrence"])
    rest = [x for x in df.columns if x != rec]
    return df.select(
        *rest, r["case_id"].alias("case_id"), r["submitter_id"].alias("submitter_id"), F.coalesce(text(r["demographic"]["vital_status"]), text(d["vital_status"])).alias("vital_status"),
        F.coalesce(r["demographic"]["days_to_death"], d["days_to_death"]).alias("days_to_death"), d["days_to_last_follow_up"].alias("days_to_last_follow_up"),
        d["days_to_recurrence"].alias("days_to_recurrence"), flag.alias("progression_or_recurrence"), F.least(earliest, d["days_to_recurrence"]).alias("days_to_new_tumor_event"))


def case_sample_types(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Distinct sample types of each case, sorted and joined."""
    r = F.col(rec)
    return df.select(r["case_id"].alias("case_id"), F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.transform(r["samples"], lambda s: s["sample_type"]))), ";"), F.lit("")).alias("sample_types"))


STUDY_MUTATION = "study STRING, patientId STRING, proteinChange STRING, aminoAcidChange STRING, mutationType STRING, mutationStatus STRING"


def study_mutations(df: DataFrame, rec: str = "rec", suffix: str = "_tcga_pan_can_atlas_2018") -> DataFrame:
    """(project, patient, consequence_types, aa_changes): 'p.' prefix, project code, status when the type is Other."""
    r = F.col(rec)
    change = F.coalesce(F.nullif(r["proteinChange"], F.lit("")), F.nullif(r["aminoAcidChange"], F.lit("")))
    change = F.when(~change.isin("NA", "N/A", "MUTATED"), change)
    change = F.when(change.startswith("p."), change).otherwise(F.concat(F.lit("p."), change))
    kind = F.coalesce(F.nullif(r["mutationType"], F.lit("")), F.lit("Other"))
    kind = F.when(kind == "Other", F.coalesce(r["mutationStatus"], F.lit("Other"))).otherwise(kind)
    return df.select(F.concat(F.lit("TCGA-"), F.upper(F.replace(r["study"], F.lit(suffix), F.lit("")))).alias("project"), r["patientId"].alias("patient"),
                     F.array(kind).alias("consequence_types"), F.array_compact(F.array(change)).alias("aa_changes"))


def profiled_counts(samples: DataFrame) -> DataFrame:
    """Profiled samples per project (project, sample)."""
    return samples.groupBy("project").agg(F.count_distinct("sample").alias("n_profiled"))


MOLECULAR = "study STRING, sampleId STRING, patientId STRING, value STRING"


def molecular_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    """(study, sample, patient, value) of protein levels or copy numbers; values that do not parse are left out."""
    r = F.col(rec)
    v = r["value"].try_cast("double")
    return df.select(r["study"].alias("study"), F.coalesce(r["sampleId"], F.lit("")).alias("sample"), F.coalesce(r["patientId"], F.lit("")).alias("patient"),
                     v.alias("value")).where("value is not null and not isnan(value)")


SERIES = "accession STRING, title STRING, summary STRING, taxon STRING, gdstype STRING, n_samples INT, pdat STRING, pubmedids ARRAY<STRING>"


def series_rows(df: DataFrame, rec: str = "rec") -> DataFrame:
    r = F.col(rec)
    rest = [x for x in df.columns if x != rec]
    return df.select(*rest, r["accession"].alias("accession"), F.coalesce(r["title"], F.lit("")).alias("title"), F.coalesce(r["taxon"], F.lit("")).alias("organism"),
                     F.coalesce(r["gdstype"], F.lit("")).alias("type"), F.coalesce(r["n_samples"], F.lit(0)).alias("n_samples"),
                     F.coalesce(F.array_join(r["pubmedids"], ";"), F.lit("")).alias("pubmed_ids"))
