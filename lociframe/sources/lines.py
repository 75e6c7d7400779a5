"""Line formats: gene lists, intervals, FASTA, alignments, expression text formats, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.text import normalize_symbol
from lociframe.sources.tables import number


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, line). The ordinal grows along each file."""
    return spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"), F.col("value").alias("line"))


def gene_list(lines: DataFrame) -> DataFrame:
    """Distinct upper-case first tokens of the lines, with their set when there is one."""
    token = normalize_symbol(F.split(F.trim("line"), r"[\t,; ]+")[0])
    keys = [c for c in lines.columns if c == "set_id"]
    return lines.select(*keys, token.alias("item")).where("item <> ''").distinct()


def labelled_lists(text: Column) -> Column:
    """'A:x,y,B:z' to ARRAY<STRUCT<set_id, item>>: a part with a colon starts a list."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))

    def add(acc: Column, p: Column) -> Column:
        starts = F.contains(p, F.lit(":"))
        label = F.when(starts, F.trim(F.split_part(p, F.lit(":"), F.lit(1)))).otherwise(acc["label"])
        item = F.upper(F.trim(F.when(starts, F.regexp_replace(p, "^[^:]*:", "")).otherwise(p)))
        return F.struct(label.alias("label"), F.concat(acc["out"], F.array(F.struct(label.alias("set_id"), item.alias("item")))).alias("out"))

    start = F.struct(F.lit("").alias("label"), F.array().cast("array<struct<set_id:string,item:string>>").alias("out"))
    return F.array_distinct(F.filter(F.aggregate(parts, start, add, lambda a: a["out"]), lambda s: s["item"] != ""))


def read_gene_lists(spark: SparkSession, path: str) -> DataFrame:
    """One set per file, named by the file."""
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return gene_list(read_lines(spark, path).withColumn("set_id", name))


def intervals(lines: DataFrame) -> DataFrame:
    """BED3, BED6, BED9 and narrowPeak lines: missing score 0, signal from the score, generated names."""
    f = F.split("line", "\t")
    n = F.size("f")
    src = lines.where(~F.col("line").rlike("^#|^track|^browser|^\\s*$")).withColumn("f", f)
    at = lambda i: F.get("f", F.lit(i))
    score = F.coalesce(number(at(4)), F.lit(0.0))
    return src.select(
        at(0).alias("chrom"), at(1).try_cast("long").alias("start"), at(2).try_cast("long").alias("end"),
        F.when(n >= 6, at(3)).otherwise(F.concat(F.lit("peak_"), F.col("ordinal").cast("string"))).alias("name"), F.when(n >= 6, score).otherwise(0.0).alias("score"),
        F.when(n >= 6, at(5)).alias("strand"), F.when(n >= 9, F.coalesce(number(at(6)), F.lit(0.0))).when(n >= 6, score).otherwise(0.0).alias("signal"),
        F.when(n >= 9, number(at(7))).alias("pvalue"), F.when(n >= 9, number(at(8))).alias("qvalue"), F.when(n >= 10, at(9).try_cast("int")).alias("peak"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return intervals(read_lines(spark, path))


def fasta_records(records: DataFrame) -> DataFrame:
    """Records without their leading '>' (value) to (header, seq): upper-case, white space removed."""
    ok = records.where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\n]*)", 1)
    return ok.select(F.trim(head).alias("header"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(spark.read.option("lineSep", ">").text(path))


def stockholm(lines: DataFrame) -> DataFrame:
    """Alignment lines (family, ordinal, line) to (family, name, seq), fragments joined in order."""
    rows = lines.where(~F.col("line").rlike(r"^#|^//|^\s*$")).withColumn("p", F.split(F.trim("line"), r"\s+")).where(F.size("p") == 2)
    rows = rows.select("family", "ordinal", F.col("p")[0].alias("name"), F.col("p")[1].alias("part"))
    return rows.groupBy("family", "name").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ordinal", "part"))), lambda s: s["part"]), "").alias("seq"))


def tail(array: str, first: int) -> Column:
    """Elements from a place (from 1) to the end."""
    return F.slice(array, first, F.greatest(F.size(array) - first + 1, F.lit(0)))


def gct(lines: DataFrame) -> DataFrame:
    """GCT lines (file, ordinal, line) to a long matrix: version and size lines and the description are left out.

    The header is the line of each file that starts with Name; it is joined to the rows of its file.
    """
    head = lines.where(F.col("line").rlike("(?i)^name\t")).select("file", F.split("line", "\t").alias("h"))
    body = lines.where(~F.col("line").rlike(r"(?i)^name\t|^#1\.|^\d+\t\d+\s*$|^\s*$")).select("file", F.split("line", "\t").alias("v"))
    rows = body.join(head, "file").select(F.col("v")[0].alias("feature"), F.explode(F.arrays_zip(tail("h", 3), tail("v", 3))).alias("c"))
    return rows.select("feature", F.col("c")["0"].alias("sample"), number(F.col("c")["1"]).alias("value"))


def series_matrix(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series text (file, ordinal, line) to a long matrix, series fields, and sample attributes (long).

    Table rows are the lines without a leading mark; tab-separated sample lines hold one value per sample.
    """
    clean = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    ok = lines.where(~F.col("line").rlike(r"^#|^\s*$"))
    series = ok.where(F.col("line").startswith("!Series_")).select(
        "file", F.lower(F.regexp_extract("line", r"^!Series_([A-Za-z0-9_]+)", 1)).alias("field"),
        clean(F.regexp_replace("line", r"^!Series_[A-Za-z0-9_]+\s*(=|\t)\s*", "")).alias("value"))
    attrs = ok.where(F.col("line").startswith("!Sample_")).select(
        "file", F.regexp_extract("line", r"^!Sample_([A-Za-z0-9_]+)", 1).alias("attr"), "ordinal",
        F.posexplode(F.split("line", "\t")).alias("place", "value")).where("place > 0").withColumns({"place": F.col("place") - 1, "value": clean(F.col("value"))})
    table = ok.where(~F.col("line").startswith("!"))
    head = table.where(F.col("line").rlike('^"?ID_REF')).select("file", F.split("line", "\t").alias("h"))
    body = table.where(~F.col("line").rlike('^"?ID_REF')).select("file", F.split("line", "\t").alias("v"))
    cells = body.join(head, "file").select("file", clean(F.col("v")[0]).alias("feature"),
                                           F.explode(F.arrays_zip(tail("h", 2), tail("v", 2))).alias("c"))
    matrix = cells.select("file", "feature", clean(F.col("c")["0"]).alias("sample"), number(F.col("c")["1"]).alias("value"))
    return matrix, series, attrs


def sample_attributes(attrs: DataFrame, names: list[str]) -> DataFrame:
    """One row per sample place with the named attributes; repeated values joined by '; '."""
    joined = attrs.groupBy("file", "place", "attr").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ordinal", "value"))), lambda s: s["value"]), "; ").alias("value"))
    return joined.groupBy("file", "place").pivot("attr", names).agg(F.first("value"))


def series_summary(series: DataFrame, fields: list[str]) -> DataFrame:
    """One row per series with the named fields; repeated lines joined by a space."""
    joined = series.groupBy("file", "field").agg(F.array_join(F.sort_array(F.collect_list("value")), " ").alias("value"))
    return joined.groupBy("file").pivot("field", fields).agg(F.first("value"))


# ---- variants ------------------------------------------------------------------------------------


def variants(tokens: DataFrame, token: str = "token") -> DataFrame:
    """A123V tokens to (raw, wt_aa, pos, mut_aa, impact_class); what does not parse is left out."""
    rx = r"^([A-Za-z])(\d+)([A-Za-z*=])$"
    t = F.trim(token)
    rest = [c for c in tokens.columns if c != token]
    mut = F.upper(F.regexp_extract(t, rx, 3))
    impact = F.when(mut.isin("*", "X"), "stop").otherwise("custom")
    if "impact_class" in rest:
        impact = F.coalesce(F.lower("impact_class"), impact)
        rest.remove("impact_class")
    return tokens.where(t.rlike(rx)).select(*rest, t.alias("raw"), F.upper(F.regexp_extract(t, rx, 1)).alias("wt_aa"),
                                            F.regexp_extract(t, rx, 2).cast("long").alias("pos"), mut.alias("mut_aa"), impact.alias("impact_class"))


def hotspot_variants(hotspots: DataFrame, top: int = 0) -> DataFrame:
    """Distinct changes of hotspot rows (position, count, aa_changes, types), each with the count of its best position."""
    src = hotspots.orderBy(F.desc("count"), "position").limit(top) if top else hotspots
    low = F.lower("types")
    impact = F.when(low.rlike("nonsense|stop|frameshift"), "pathogenic").when(F.contains(low, F.lit("missense")), "uncertain").otherwise("custom")
    rows = src.select("position", "count", impact.alias("impact_class"), F.explode(F.split("aa_changes", ";")).alias("token"))
    parsed = variants(rows)
    best = parsed.groupBy("raw", "wt_aa", "pos", "mut_aa").agg(F.min(F.struct((-F.col("count")).alias("k"), "position", "impact_class")).alias("b"))
    return best.select("raw", "wt_aa", "pos", "mut_aa", F.col("b.impact_class").alias("impact_class"), (-F.col("b.k")).alias("tcga_count"))
