"""Operator inputs derived from the given tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions.special import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature = part, sample = supplier, value = units shipped."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("sample")).agg(
        F.sum("l_quantity").alias("value")
    )


PART_MATRIX = """SELECT l_partkey AS feature, l_suppkey AS sample, sum(l_quantity) AS value
FROM lineitem GROUP BY 1, 2"""


def kind_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature = brand and size, sample = supplier: a dense, fixed-height matrix."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("feature"),
                 F.col("l_suppkey").alias("sample"))
        .agg(F.sum("l_quantity").alias("value"))
    )


KIND_MATRIX = """SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS feature, l_suppkey AS sample,
sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature = part, sample = supplier nation: few samples, many features."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_partkey").alias("feature"), F.col("s_nationkey").cast("long").alias("sample"))
        .agg(F.sum("l_quantity").alias("value"))
    )


NATION_MATRIX = """SELECT l_partkey AS feature, CAST(s_nationkey AS BIGINT) AS sample,
sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""


def supplier_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample = supplier, grp = control / treatment / other by region, batch = nation."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = F.col("n_regionkey")
    return sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("sample"),
        F.when(region == 0, "control").when(region == 1, "treatment").otherwise("other").alias("grp"),
        F.col("s_nationkey").alias("batch"),
    )


SUPPLIER_META = """SELECT s_suppkey AS sample, CASE n_regionkey WHEN 0 THEN 'control' WHEN 1 THEN 'treatment'
ELSE 'other' END AS grp, s_nationkey AS batch FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def order_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with lines: days to the last shipment, event = any returned line."""
    orders = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("event"),
        F.sum("l_quantity").alias("units"),
    )
    return orders.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"),
        F.greatest(F.datediff("last_ship", "o_orderdate"), F.lit(0)).cast("double").alias("time"),
        "event",
        F.col("o_orderpriority").alias("grp"),
        F.col("o_totalprice").alias("price"),
        "units",
        F.col("o_custkey").alias("custkey"),
    )


ORDER_SURVIVAL = """SELECT o_orderkey AS id,
CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)), 0) AS DOUBLE) AS time,
event, o_orderpriority AS grp, o_totalprice AS price, units, o_custkey AS custkey
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship,
max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS event, sum(l_quantity) AS units
FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def event_second():
    """Second of the event since 1970, whatever the session time zone is."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom = user, start = second of the event, end = start + 60 * value + 1."""
    ev = table(spark, sf_dir, "events")
    start = event_second()
    return ev.select(
        F.col("user_id").alias("chrom"),
        start.alias("start"),
        (start + F.floor(F.col("value") * 60) + 1).alias("end"),
        F.col("event_id").alias("name"),
        F.col("value").alias("score"),
        F.col("event_type").alias("cond"),
    )


EVENT_INTERVALS = """SELECT user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS "start",
CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) + 1 AS "end",
event_id AS name, value AS score, event_type AS cond FROM events"""


def segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id = customer nation, item = part bought there."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("c_nationkey").alias("set_id"), F.col("l_partkey").alias("item"))
        .distinct()
    )


SEGMENT_SETS = """SELECT DISTINCT c_nationkey AS set_id, l_partkey AS item FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers that ship consecutive lines of one order."""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (
        li.withColumn("nxt", F.lead("l_partkey").over(w))
        .where(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("l_partkey")))
        .select(F.least("l_partkey", "nxt").alias("src"), F.greatest("l_partkey", "nxt").alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("score"))
    )


BASKET_EDGES = """SELECT least(l_partkey, nxt) AS src, greatest(l_partkey, nxt) AS dst, count(*) AS score FROM (
SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt
FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey GROUP BY 1, 2"""


def digest_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 256-base sequence per document: eight digests of the text, spelled with four letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = [F.md5(F.concat(F.lit(f"{i}:"), F.col("text"))) for i in range(8)]
    return docs.select(
        F.col("doc_id").alias("gene"),
        F.translate(F.concat(*digests), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"),
    )


DIGEST_SEQUENCES = (
    "SELECT doc_id AS gene, translate("
    + " || ".join(f"md5('{i}:' || text)" for i in range(8))
    + ", '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents"
)


def digest_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 128-residue protein per document over the twenty amino acids (each hex pair picks one)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = F.concat(*[F.md5(F.concat(F.lit(f"p{i}:"), F.col("text"))) for i in range(8)])
    letters = F.array(*[F.lit(c) for c in "ACDEFGHIKLMNPQRSTVWY"])

    def spell(d):
        pairs = F.regexp_extract_all(d, F.lit(".."), F.lit(0))
        return F.array_join(F.transform(pairs, lambda h: F.get(letters, F.conv(h, 16, 10).cast("int") % 20)), "")

    return docs.select(F.col("doc_id").alias("protein"), let(digests, spell).alias("seq"))



DIGEST_PROTEINS = (
    "SELECT doc_id AS protein, list_aggregate(list_transform(range(0, 128), lambda i: substr('ACDEFGHIKLMNPQRSTVWY', "
    "CAST(CAST('0x' || substr(d, i * 2 + 1, 2) AS INTEGER) % 20 + 1 AS BIGINT), 1)), 'string_agg', '') AS seq FROM (SELECT doc_id, "
    + " || ".join(f"md5('p{i}:' || text)" for i in range(8))
    + " AS d FROM documents)"
)


def brand_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature = brand, sample = customer, value = units bought."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("feature"), F.col("o_custkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    )


BRAND_MATRIX = """SELECT p_brand AS feature, o_custkey AS sample, sum(l_quantity) AS value FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def customer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample = customer, grp = control for region 0, treatment for the others, batch = nation."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return cust.join(nat, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sample"), F.when(F.col("n_regionkey") == 0, "control").otherwise("treatment").alias("grp"),
        F.col("c_nationkey").alias("batch"))


CUSTOMER_META = """SELECT c_custkey AS sample, CASE n_regionkey WHEN 0 THEN 'control' ELSE 'treatment' END AS grp,
c_nationkey AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey"""
