"""Mutations, lineages, gene annotation records and curated candidate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociframe.functions import text as T
from lociframe.functions.ordering import exact_median, exact_quantiles
from lociframe.session import cut_lineage

# Names that stand for one mutation class.
MUTATION_NAMES = {
    "missense": "Missense_Mutation", "missense_mutation": "Missense_Mutation", "missense_variant": "Missense_Mutation",
    "nonsense_mutation": "Nonsense_Mutation", "nonsense": "Nonsense_Mutation", "stop_gained": "Nonsense_Mutation",
    "frame_shift_del": "Frameshift", "frame_shift_ins": "Frameshift", "frameshift_variant": "Frameshift",
    "frameshift": "Frameshift", "frameshift_deletion": "Frameshift", "frameshift_insertion": "Frameshift",
    "splice_site": "Splice_Site", "splice_donor_variant": "Splice_Site", "splice_acceptor_variant": "Splice_Site",
    "splice_region": "Splice_Site", "in_frame_del": "In_Frame", "in_frame_ins": "In_Frame", "inframe_deletion": "In_Frame",
    "inframe_insertion": "In_Frame", "silent": "Silent", "synonymous_variant": "Silent",
}

# Rank of a class, the lowest wins; unknown names rank 90.
MUTATION_RANK = {
    "Nonsense_Mutation": 1, "Frameshift": 2, "Frame_Shift_Del": 2, "Frame_Shift_Ins": 2, "Splice_Site": 3, "Splice_Region": 3,
    "Missense_Mutation": 4, "Missense": 4, "In_Frame_Del": 5, "In_Frame_Ins": 5, "In_Frame": 5, "Nonstop_Mutation": 6,
    "Translation_Start_Site": 7, "Silent": 8,
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def mutation_class(types: Column) -> Column:
    """Class of the highest priority among consequence names; the first of equal ranks, Other for none."""
    def rank(t: Column, i: Column) -> Column:
        name = F.coalesce(_lookup(MUTATION_NAMES, F.lower(F.trim(t))), t)
        return F.struct(F.coalesce(_lookup(MUTATION_RANK, name), F.lit(90)).alias("r"), i.alias("i"), name.alias("n"))

    return F.coalesce(F.array_min(F.transform(types, rank))["n"], F.lit("Other"))


def aa_change(text: Column) -> Column:
    """STRUCT<aa_change, position> of p.V600E-like text; null when it does not parse."""
    rx = r"(?i)p\.([A-Z*])(\d+)([A-Z*_].*)?"
    ref, pos, alt = (F.regexp_extract(text, rx, i) for i in (1, 2, 3))
    new = F.substring(F.upper(F.when(alt == "", "?").otherwise(F.regexp_replace(alt, "^_+", ""))), 1, 5)
    return F.when(ref != "", F.struct(F.concat(F.upper(ref), pos, new).alias("aa_change"), pos.try_cast("long").alias("position")))


def mutation_hotspots(muts: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Mutations per protein position with distinct changes and classes. muts: project, consequence_types, aa_changes."""
    rows = classified(muts, types).withColumn("c", F.explode("aa_changes")).withColumn("h", aa_change(F.col("c"))).where("h is not null")
    agg = rows.groupBy(F.col("h.position").alias("position")).agg(
        F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_set("h.aa_change")), ";").alias("aa_changes"),
        F.array_join(F.sort_array(F.collect_set("type")), ";").alias("types"))
    return agg


def classified(muts: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    out = muts.withColumn("type", mutation_class(F.col("consequence_types")))
    return out.where(F.col("type").isin(*types)) if types else out


def mutation_frequency(muts: DataFrame, profiled: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Mutations per project over profiled samples, with its five most mutated positions (over all projects)."""
    rows = cut_lineage(classified(muts, types))
    base = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n_mutations"))
    spots = rows.withColumn("c", F.explode("aa_changes")).withColumn("h", aa_change(F.col("c"))).where("h is not null").select(
        "project", F.col("h.position").alias("position"))
    per = cut_lineage(spots.groupBy("project", "position").agg(F.count(F.lit(1)).alias("k")))
    total = per.groupBy("position").agg(F.sum("k").alias("total"))
    w = W.partitionBy("project").orderBy(F.desc("total"), "position")
    top = per.join(total, "position").withColumn("i", F.row_number().over(w)).where("i <= 5").groupBy("project").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "position"))), lambda s: s["position"].cast("string")), ";").alias("top_hotspots"))
    n = F.coalesce("n_profiled", F.lit(0))
    return base.join(profiled, "project", "left").join(top, "project", "left").select(
        F.regexp_replace("project", "^TCGA-", "").alias("cancer_type"), "n_mutations", n.alias("n_profiled"),
        F.round(F.when(n > 0, F.col("n_mutations") / n).otherwise(0.0), 4).alias("frequency"), F.coalesce("top_hotspots", F.lit("")).alias("top_hotspots"))


def type_counts(muts: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    return classified(muts, types).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def copy_number_class(value: Column, amp: float = 1.0, dele: float = -1.0) -> Column:
    return F.when(value.isNull(), "NA").when(value >= amp, "amplified").when(value <= dele, "deleted").otherwise("neutral")


def top_and_bottom(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n largest and the n smallest rows, marked by end."""
    hi = df.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("top"))
    lo = df.orderBy(value, key).limit(n).withColumn("end", F.lit("bottom"))
    return hi.unionByName(lo)


def join_models(df: DataFrame, meta: DataFrame, key: str = "model") -> DataFrame:
    """Left join of model metadata; a missing lineage is Unknown and a missing name the model itself."""
    return df.join(meta, key, "left").withColumn("lineage", F.coalesce(F.nullif("lineage", F.lit("")), F.lit("Unknown"))).withColumn(
        "cell_line", F.coalesce("cell_line", F.col(key).cast("string")))


def distinct_models(df: DataFrame, key: str = "model") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("models"))


def lineage_appendix(models: DataFrame, mutated: DataFrame, min_n: int = 3) -> DataFrame:
    """Per lineage: n with expression, medians of expression and copy number, distinct mutated models.

    models: model, lineage, expr, cn. mutated: model.
    """
    models = cut_lineage(models)
    n = models.groupBy("lineage").agg(F.count("expr").alias("n")).where(F.col("n") >= min_n)
    mut = mutated.select("model").distinct().join(models.select("model", "lineage"), "model").groupBy("lineage").agg(
        F.count_distinct("model").alias("mutated_models"))
    out = n.join(exact_median(models, ["lineage"], "expr", "median_expr"), "lineage", "left")
    out = out.join(exact_median(models, ["lineage"], "cn", "median_cn"), "lineage", "left").join(mut, "lineage", "left")
    return out.na.fill(0, ["mutated_models"])


def top_share_counts(models: DataFrame, value: str, share: float = 0.95, key: str = "lineage") -> DataFrame:
    """Lineage counts of the models at or over a quantile of the value."""
    models = cut_lineage(models)
    cut = exact_quantiles(models, [], value, {"q": share}).select("q").scalar()
    return models.where(F.col(value) >= cut).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def disjoint_groups(tumor: DataFrame, normal: DataFrame, key: str = "case_id") -> DataFrame:
    """Tumor and normal rows without the cases that both have, stacked with a group name."""
    t = tumor.join(normal.select(key), key, "left_anti").withColumn("group", F.lit("Tumor"))
    n = normal.join(tumor.select(key), key, "left_anti").withColumn("group", F.lit("Normal"))
    return t.unionByName(n)


def first_sample_per_patient(expr: DataFrame, surv: DataFrame) -> DataFrame:
    """Expression joined to survival on sample, then the lowest sample of each patient."""
    joined = expr.join(surv, "sample")
    rest = [c for c in joined.columns if c not in {"patient", "sample"}]
    return joined.groupBy("patient").agg(F.min(F.struct("sample", *rest)).alias("r")).select("patient", "r.sample", *[f"r.{c}" for c in rest])


def cohort_expression(cases: DataFrame, expr: DataFrame) -> DataFrame:
    """Cases joined to their value, over all cohorts at once, with median, mean and n per cohort."""
    joined = cut_lineage(cases.join(expr, "case_id").where("value is not null").select("cohort", "value"))
    base = joined.groupBy("cohort").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return base.join(exact_median(joined, ["cohort"], "value"), "cohort")


# ---- manifests -----------------------------------------------------------------------------------


def choose_release(releases: DataFrame, requested: str | None = None) -> DataFrame:
    """The requested release, else the latest by its flag, else the first by ordinal (name, is_latest, ordinal)."""
    if requested:
        return releases.where(F.col("name") == requested).limit(1)
    return releases.orderBy(F.when(F.coalesce("is_latest", F.lit(False)), 0).otherwise(1), "ordinal").limit(1)


def best_file(files: DataFrame, patterns: Sequence[str], keywords: dict[str, int], key: str = "dataset") -> DataFrame:
    """Best file per dataset: 100 minus the position of the first matching pattern, else keyword points."""
    name = F.col("file_name")
    score = None
    for i, p in enumerate(patterns):
        hit = name.rlike(f"(?i){p}")
        score = F.when(hit, 100 - i) if score is None else score.when(hit, 100 - i)
    points = F.lit(0)
    for k, v in keywords.items():
        points = points + F.when(F.contains(F.lower(name), F.lit(k)), v).otherwise(0)
    total = points if score is None else score.otherwise(points)
    ranked = files.dropDuplicates(["release", "file_name", "url"]).withColumn("score", total).where("score > 0")
    w = W.partitionBy(key).orderBy(F.desc("score"), "file_name", "url")
    return ranked.withColumn("i", F.row_number().over(w)).where("i = 1").drop("i")


# ---- gene records --------------------------------------------------------------------------------


def join_unique(values: Column, limit: int | None = None, sep: str = "; ") -> Column:
    kept = F.filter(F.array_distinct(values), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.array_join(F.slice(kept, 1, limit) if limit else kept, sep), F.lit(""))


def choose_hit(hits: DataFrame) -> DataFrame:
    """Best record per asked gene: exact symbol, then alias, then search score; with mapping status.

    hits: gene, symbol, alias ARRAY, hit_score and any annotation columns.
    """
    g = F.upper("gene")
    exact = F.upper("symbol") == g
    alias = F.coalesce(F.exists("alias", lambda a: F.upper(a) == g), F.lit(False))
    w = W.partitionBy("gene").orderBy(F.desc(exact.cast("int")), F.desc(alias.cast("int")), F.desc("hit_score"), "symbol")
    best = hits.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")
    return best.withColumn("mapping_status", F.when(exact, "exact_symbol").when(alias, "alias_match").otherwise("best_match"))


GENE_RECORD = """
symbol STRING, name STRING, alias ARRAY<STRING>, entrezgene STRING, type_of_gene STRING, map_location STRING, summary STRING,
genomic_pos STRUCT<chr: STRING, start: BIGINT, end: BIGINT, strand: INT>, ensembl STRUCT<gene: STRING>,
go STRUCT<BP: ARRAY<STRUCT<term: STRING>>, MF: ARRAY<STRUCT<term: STRING>>, CC: ARRAY<STRUCT<term: STRING>>>,
pathway STRUCT<reactome: ARRAY<STRUCT<name: STRING>>, kegg: ARRAY<STRUCT<name: STRING>>>
"""

PROTEIN_RECORD = """
primaryAccession STRING, proteinDescription STRUCT<recommendedName: STRUCT<fullName: STRUCT<value: STRING>>>, sequence STRUCT<length: INT>,
comments ARRAY<STRUCT<commentType: STRING, texts: ARRAY<STRUCT<value: STRING>>, subcellularLocations: ARRAY<STRUCT<location: STRUCT<value: STRING>>>,
  disease: STRUCT<description: STRING, acronym: STRING, diseaseId: STRING>>>,
keywords ARRAY<STRUCT<name: STRING>>,
features ARRAY<STRUCT<type: STRING, description: STRING, location: STRUCT<start: STRUCT<value: INT>, end: STRUCT<value: INT>>>>
"""

# Feature types that describe a domain.
DOMAIN_TYPES = (
    "Domain", "Region", "Repeat", "Zinc finger", "DNA binding", "Motif", "Coiled coil", "Transmembrane", "Intramembrane",
    "Topological domain", "Compositional bias", "Active site", "Binding site",
)


def flatten_gene_record(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Flat annotation columns of a parsed gene record (GENE_RECORD)."""
    r = F.col(rec)
    terms = lambda branch: join_unique(F.transform(r[f"go"][branch], lambda t: t["term"]), 5)
    ways = lambda src: join_unique(F.transform(r["pathway"][src], lambda t: F.trim(t["name"])), 5)
    pos = r["genomic_pos"]
    loc = F.when(pos["chr"].isNotNull() & pos["start"].isNotNull() & pos["end"].isNotNull(), F.concat(
        F.lit("chr"), pos["chr"], F.lit(":"), pos["start"].cast("string"), F.lit("-"), pos["end"].cast("string"))).otherwise("")
    out = df.withColumns({
        "full_name": F.coalesce(r["name"], F.lit("")), "aliases": join_unique(r["alias"]), "ensembl_id": F.coalesce(r["ensembl"]["gene"], F.lit("")),
        "location": loc, "molecular_function": terms("MF"), "biological_process": terms("BP"), "cellular_component": terms("CC"),
        "reactome": ways("reactome"), "kegg": ways("kegg"),
    })
    parts = F.array_compact(F.array(F.when(F.col("reactome") != "", F.concat(F.lit("Reactome: "), "reactome")),
                                    F.when(F.col("kegg") != "", F.concat(F.lit("KEGG: "), "kegg"))))
    return out.withColumn("pathway_summary", F.array_join(parts, " | "))


def flatten_protein_record(df: DataFrame, rec: str = "rec") -> DataFrame:
    """Flat protein columns: name, length, function, places, diseases, keywords, domains, class, druggability."""
    r = F.col(rec)
    of = lambda kind: F.filter(r["comments"], lambda c: c["commentType"] == kind)
    texts = F.flatten(F.transform(of("FUNCTION"), lambda c: F.coalesce(F.transform(c["texts"], lambda t: t["value"]), F.array().cast("array<string>"))))
    places = F.flatten(F.transform(of("SUBCELLULAR LOCATION"), lambda c: F.coalesce(
        F.transform(c["subcellularLocations"], lambda s: F.trim(s["location"]["value"])), F.array().cast("array<string>"))))
    ill = F.transform(of("DISEASE"), lambda c: F.when(
        F.coalesce(c["disease"]["description"], F.lit("")) != "", F.split_part(T.normalize_space(c["disease"]["description"]), F.lit("."), F.lit(1))
    ).otherwise(F.coalesce(c["disease"]["acronym"], c["disease"]["diseaseId"])))
    domains = F.filter(r["features"], lambda f: f["type"].isin(*DOMAIN_TYPES))
    names = F.transform(domains, lambda f: F.trim(F.coalesce(F.nullif(f["description"], F.lit("")), f["type"])))
    spans = F.transform(F.filter(domains, lambda f: f["location"]["start"]["value"].isNotNull() | f["location"]["end"]["value"].isNotNull()),
                        lambda f: F.concat(F.trim(F.coalesce(F.nullif(f["description"], F.lit("")), f["type"])), F.lit(": "),
                                           F.coalesce(f["location"]["start"]["value"].cast("string"), F.lit("")), F.lit("-"),
                                           F.coalesce(f["location"]["end"]["value"].cast("string"), F.lit(""))))
    out = df.withColumns({
        "protein_name": F.coalesce(r["proteinDescription"]["recommendedName"]["fullName"]["value"], F.lit("")), "protein_length": r["sequence"]["length"],
        "function_text": T.shorten(join_unique(texts), 600), "places": join_unique(places, 5), "diseases": join_unique(ill, 5),
        "keyword_text": join_unique(F.transform(r["keywords"], lambda k: F.trim(k["name"])), 8), "domains": join_unique(names),
        "domain_spans": join_unique(spans), "domain_class": join_unique(F.flatten(F.transform(names, lambda d: T.domain_classes(d)))),
    })
    cls = T.protein_class(F.concat_ws(" ", "keyword_text", "domain_class"))
    return out.withColumn("__c", cls).withColumn("protein_class", F.col("__c.protein_class")).withColumn(
        "druggability", F.col("__c.druggability")).drop("__c")


def reported_function(df: DataFrame, summary: str, function: str, cls: str) -> DataFrame:
    return df.withColumn("reported_function", T.with_domain_class(T.concise_summary(F.col(summary), F.col(function)), F.col(cls)))


def merge_candidates(proteins: DataFrame, genes: DataFrame, category: str, organism: str) -> DataFrame:
    """Full outer merge by upper-cased symbol: protein fields first, gene fields fill in, notes appended.

    proteins: symbol, protein_name, accession, function_text, synonyms ARRAY, pmids ARRAY.
    genes: symbol, gene_id, description, other_aliases.
    """
    p = proteins.where(F.trim("symbol") != "").select(
        F.upper(F.trim("symbol")).alias("k"), F.trim("symbol").alias("ps"), "protein_name", "accession", F.substring("function_text", 1, 250).alias("pf"),
        F.array_join("synonyms", ",").alias("syn"), F.array_join("pmids", ";").alias("pmid"))
    g = genes.where(F.trim("symbol") != "").select(
        F.upper(F.trim("symbol")).alias("k"), F.trim("symbol").alias("gs"), "gene_id", F.substring("description", 1, 250).alias("gd"), "other_aliases")
    j = p.join(g, "k", "full_outer")
    has_p, has_g = F.col("ps").isNotNull(), F.col("gs").isNotNull()
    blank = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    notes = F.array_compact(F.array(F.when(blank("syn") != "", F.concat(F.lit("aliases="), "syn")),
                                    F.when(blank("other_aliases") != "", F.concat(F.lit("ncbi_aliases="), "other_aliases"))))
    refs = F.array_compact(F.array(F.when(has_p, F.concat(F.lit("UniProt:"), blank("accession"))), F.when(has_g, F.concat(F.lit("NCBI_Gene:"), blank("gene_id")))))
    return j.select(
        F.coalesce("ps", "gs").alias("gene_name"), blank("protein_name").alias("protein_id"), F.lit(organism).alias("organism"),
        F.lit(category).alias("functional_class"), F.when(blank("pf") != "", F.col("pf")).otherwise(blank("gd")).alias("evidence"),
        blank("accession").alias("accession"), blank("pmid").alias("pmid"), F.array_join(refs, ";").alias("references"),
        F.lit("Candidate").alias("tier"), F.array_join(notes, "; ").alias("notes"))


def symbol_choice(hits: DataFrame) -> DataFrame:
    """Per asked gene the hit with the same symbol, ignoring case, else the first (gene, symbol, ordinal)."""
    same = (F.upper("symbol") == F.upper("gene")).cast("int")
    best = hits.groupBy("gene").agg(F.min(F.struct((-same).alias("k"), "ordinal", "symbol")).alias("b"))
    return best.select("gene", F.col("b.symbol").alias("resolved"))
