"""Delimited tables: matrices, metadata, ranked lists, manifests; and the table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def separator(path: str) -> str:
    """Tab for .tsv and .txt (also gzipped), else comma."""
    base = path[:-3] if path.endswith(".gz") else path
    return "\t" if base.endswith((".tsv", ".txt")) else ","


def read_table(spark: SparkSession, path: str, sep: str | None = None, comment: str | None = None) -> DataFrame:
    """Every column as text; types are cast where they are needed."""
    reader = spark.read.option("header", True).option("sep", sep or separator(path)).option("maxColumns", 200000)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate that is a column, by exact name and then ignoring case."""
    for c in candidates:
        if c in df.columns:
            return c
    lower = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    if required:
        raise ValueError(f"none of {list(candidates)} among {df.columns}")
    return None


def number(c: Column) -> Column:
    """Text to double; what does not parse, and NaN, become null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def melt(df: DataFrame, feature: str | None = None, samples: Sequence[str] | None = None) -> DataFrame:
    """Wide table to (feature, sample, value); features without any number are dropped."""
    key = feature or df.columns[0]
    cols = [c for c in (samples or df.columns) if c != key and c in df.columns]
    numbers = [number(F.col(f"`{c}`").cast("string")).alias(c) for c in cols]
    rows = df.select(F.col(f"`{key}`").alias("feature"), *numbers)
    rows = rows.where(F.coalesce(*[F.col(f"`{c}`") for c in cols]).isNotNull())
    return rows.unpivot(["feature"], [F.col(f"`{c}`") for c in cols], "sample", "value")


def read_matrix(spark: SparkSession, path: str, samples: Sequence[str] | None = None, orient: str = "feature") -> DataFrame:
    """Numeric matrix file as a long matrix. ``orient="sample"`` when the rows are samples."""
    lm = melt(read_table(spark, path), samples=samples)
    return lm if orient == "feature" else lm.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")


def guess_orientation(rows: int, cols: int, cells: bool = True) -> str:
    """Rows are samples unless a cell matrix is more than twice as wide as high, or another one is higher than wide and over 100 rows."""
    if cells:
        return "feature" if cols > 2 * rows else "sample"
    return "feature" if rows > cols and rows > 100 else "sample"


def to_beta(lm: DataFrame) -> DataFrame:
    """M-values to beta (2^m / (1 + 2^m)) when the values leave ±20 and are no beta values."""
    lo, hi = lm.agg(F.min("value")).scalar(), lm.agg(F.max("value")).scalar()
    is_m = ~((lo >= 0) & (hi <= 1)) & ((lo < -20) | (hi > 20))
    two = F.pow(F.lit(2.0), F.col("value"))
    return lm.withColumn("value", F.when(is_m, 1 - 1 / (1 + two)).otherwise(F.col("value")))


def read_beta_matrix(spark: SparkSession, path: str, samples: Sequence[str]) -> DataFrame:
    """Only the samples of the metadata count as values, so position columns are left alone."""
    return to_beta(read_matrix(spark, path, samples))


def screen_counts(df: DataFrame, guide: str = "sgRNA", gene: str = "Gene", samples: Sequence[str] | None = None) -> DataFrame:
    """Guide rows (guide, gene, sample counts) with at least one positive count."""
    cols = [c for c in df.columns if c not in (guide, gene) and (samples is None or c in samples)]
    if not cols:
        raise ValueError("no sample columns")
    values = [F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)) for c in cols]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return df.where(top > 0).select(F.col(guide).alias("guide"), F.col(gene).alias("gene"), *[v.alias(c) for v, c in zip(values, cols)])


def sample_metadata(df: DataFrame, group: str = "group") -> DataFrame:
    """Lower-case header, sample from sample or sample_id, group required."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    sample = resolve_column(out, ["sample", "sample_id"])
    if group.lower() not in out.columns:
        raise ValueError(f"metadata needs a {group} column")
    return out.withColumnRenamed(sample, "sample").withColumnRenamed(group.lower(), "grp")


def ranked_table(df: DataFrame, item: str | None = None, score: str | None = None) -> DataFrame:
    """(item, score) with normalised symbols, best absolute score per item."""
    from lociframe.functions.text import normalize_symbol
    from lociframe.operators.sets import dedup_by_abs

    i = item or resolve_column(df, ["gene", "symbol", "GeneSymbol", "gene_symbol"])
    s = score or resolve_column(df, ["score", "rank", "log2FC", "logFC", "stat", "Statistic", "t", "wald", "correlation"])
    out = df.select(normalize_symbol(F.col(i)).alias("item"), number(F.col(s).cast("string")).alias("score"))
    return dedup_by_abs(out.where("item <> ''"))


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels.select("sample", "label"), "sample")


def assert_no_nulls(lm: DataFrame) -> DataFrame:
    """The matrix itself; the job fails when it meets a null value."""
    return lm.withColumn("value", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(
        F.raise_error(F.lit("matrix has missing values")).cast("double")))


def cached_copy(spark: SparkSession, source: DataFrame, folder: str, refresh: bool = False) -> DataFrame:
    """Parquet copy of a table, written when it is absent or a refresh is asked for."""
    if not refresh:
        try:
            return spark.read.parquet(folder)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    source.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


# ---- landed directories --------------------------------------------------------------------------


def merge_columns(rows: DataFrame) -> DataFrame:
    """Long rows (file, feature, value, ordinal) of many files: the first row of a repeated feature per file."""
    best = rows.groupBy("file", "feature").agg(F.min(F.struct("ordinal", "value")).alias("b"))
    return best.select("feature", F.col("file").alias("sample"), F.col("b.value").alias("value"))


def read_expression_dir(spark: SparkSession, path: str, feature: str, value: str, sep: str = "\t") -> DataFrame:
    """All files of a folder, one sample per file named by the file, comments skipped."""
    raw = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\.[A-Za-z0-9]+)+$", "")
    rows = raw.select(name.alias("file"), F.col(feature).alias("feature"), number(F.col(value)).alias("value"),
                      F.monotonically_increasing_id().alias("ordinal"))
    return merge_columns(rows)


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union of tables with different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_mutation_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return union_files([read_table(spark, p, "\t", "#") for p in paths])


def maf_mutations(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """(gene, project, consequence_types, aa_changes) from MAF columns found by name; project from a barcode's second part."""
    gene = resolve_column(df, ["Hugo_Symbol", "HugoSymbol", "gene"])
    prot = resolve_column(df, ["HGVSp_Short", "Protein_Change", "AAChange"], False)
    cons = resolve_column(df, ["Variant_Classification", "Consequence"], False)
    proj = resolve_column(df, ["project_id", "Tumor_Sample_Barcode"], False)
    change = F.coalesce(F.col(prot), F.lit("")) if prot else F.lit("")
    project = F.coalesce(F.col(proj), F.lit("Unknown")) if proj else F.lit("Unknown")
    if proj and "Barcode" in proj:
        project = F.when(project.rlike("^TCGA-[^-]*-"), F.concat(F.lit("TCGA-"), F.split_part(project, F.lit("-"), F.lit(2)))).otherwise(project)
    out = df.select(
        F.col(gene).alias("gene"), project.alias("project"), F.array(F.coalesce(F.col(cons), F.lit("Other")) if cons else F.lit("Other")).alias("consequence_types"),
        F.when(change.isin("", "nan", "p.?"), F.array().cast("array<string>")).otherwise(F.array(change)).alias("aa_changes"))
    return out.where(F.upper("gene") == symbol.upper()) if symbol else out


def domain_table(df: DataFrame) -> DataFrame:
    """(name, start, end) with the usual other names."""
    name, start, end = (resolve_column(df, c) for c in (["name", "domain", "description"], ["start", "begin"], ["end", "stop"]))
    return df.select(F.col(name).alias("name"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))


def survival_table(df: DataFrame) -> DataFrame:
    """(sample, patient, time, event): rows that do not parse are left out, patient from the sample when absent."""
    patient = resolve_column(df, ["_PATIENT", "patient"], False)
    p = F.coalesce(F.col(patient), F.substring("sample", 1, 12)) if patient else F.substring("sample", 1, 12)
    return df.select("sample", p.alias("patient"), number(F.col("`OS.time`")).alias("time"), number(F.col("OS")).cast("int").alias("event")).where(
        "time is not null and event is not null")


def gene_row(df: DataFrame, gene: str) -> DataFrame:
    """(sample, value) of the row whose id starts with the gene."""
    key = df.columns[0]
    return melt(df.where(F.col(f"`{key}`").startswith(gene))).where("value is not null").select("sample", "value")


def expression_by_case(df: DataFrame, key: str = "sample") -> DataFrame:
    """Long values without nulls, one per case (the lowest sample)."""
    return df.where("value is not null").groupBy("case_id").agg(F.min_by("value", key).alias("value"))


def model_metadata(df: DataFrame) -> DataFrame:
    unknown = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown"))
    return df.select(F.col("ModelID").alias("model"), F.coalesce("CellLineName", F.lit("")).alias("cell_line"), unknown("OncotreeLineage").alias("lineage"),
                     unknown("OncotreePrimaryDisease").alias("disease"), unknown("OncotreeSubtype").alias("subtype"))


def default_entries(df: DataFrame, symbol: str, flag: str = "IsDefaultEntryForModel", gene: str = "HugoSymbol") -> DataFrame:
    """Rows of one symbol that are the default entry of their model."""
    ok = F.lower(F.col(flag).cast("string")).isin("true", "yes", "1")
    return df.where(ok & (F.col(gene) == symbol))


def tissue_pivot(df: DataFrame, tissues: Sequence[str] | None = None) -> DataFrame:
    """Gene by tissue means, absent cells 0 (gene, tissue, value)."""
    g = df.groupBy("gene")
    return (g.pivot("tissue", list(tissues)) if tissues else g.pivot("tissue")).agg(F.avg("value")).na.fill(0.0)


def first_values_wide(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Feature by sample table of the first value of each cell (feature, sample, value, ordinal)."""
    first = df.groupBy("feature", "sample").agg(F.min_by("value", "ordinal").alias("value"))
    return first.groupBy("feature").pivot("sample", list(samples)).agg(F.first("value"))


# ---- sinks ---------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_fasta(df: DataFrame, path: str, key: str, seq: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)
