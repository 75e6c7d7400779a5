"""One query for each operator here, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import (
    bagminhash, byte_bpe, hadamard_clusters, html_text, infill, licenses, pseudo_likelihood, quality, rollup, secrets_cnn, semi_crf, slots, spaced_seeds,
)
from lociframe.llm.common import shared_path, table_cut, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = 8


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_digests(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, and all spans, from the arrays `base` and `spans`."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(of_kind(k) for k in kinds), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


@_query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@_query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("detections")


ROLLUP_SQL = r"""
with counted as (
  select doc_id, source, lang, tokenizer,
         case tokenizer when 'space-1' then len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) else len(regexp_extract_all(t, '[0-9A-Za-z]+')) end as tokens
  from (
    select d.doc_id, d.source, d.lang,
           case when exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 0)
                then regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]', '', 'g') else coalesce(d.text, '') end as t
    from documents d
    where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)
  ) cross join (select unnest(['space-1', 'alnum-1']) as tokenizer)
)
select source, lang, tokenizer, count(*)::bigint as docs, sum(tokens)::bigint as tokens
from counted group by source, lang, tokenizer
"""


@_query("op3_token_rollup", ROLLUP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents, revises those of low quality without their symbols, deletes the toxic ones, and commits a batch twice."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    # Tokens are counted in the scan, so that the joins move ids and numbers and no texts. An inner join with distinct
    # ids stays above the counting, where a semi join would be pushed below it.
    ids = lambda which: labels.filter(which).select("doc_id").distinct()
    cleaned = docs.withColumn("text", F.regexp_replace(whole_text(), r"[#*$%&|<>]", ""))
    table = rollup.TokenRollup(spark)
    table.commit(0, rollup.changes(docs, "insert"))
    revised = table_cut(rollup.changes(cleaned, "revise").join(ids("quality = 0"), "doc_id"), "revised")
    table.commit(1, revised)
    table.commit(2, rollup.changes(docs, "delete").join(ids("toxic = 1"), "doc_id"))
    table.commit(1, revised)
    return table.totals()


@_query("op4_bag_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op5_quality_divergence")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


@_query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = byte_bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True)
    return byte_bpe.digests(encoded)


@_query("op7_virtual_slots")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `key` law: the shard follows from doc_id and the number of shards; a ninth shard only takes rows in."""
    path = shared_path(spark, "slot-map")
    first = slots.initial_map(spark, SHARDS)
    slots.store_map(first, path)
    slots.store_map(slots.add_shard(slots.load_map(spark, path, 1), SHARDS), path)
    placed = slots.assign(_table(spark, sf_dir, "documents"), slots.load_map(spark, path, 1), slots.load_map(spark, path, 2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "slot_bytes", "map_version")


@_query("virtual_slots_rebalanced")
def rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot map of eight shards edited by the bytes that the slots hold, and every document's place under it."""
    docs, path = _table(spark, sf_dir, "documents"), shared_path(spark, "slot-map")
    slots.store_map(slots.initial_map(spark, SHARDS), path)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    slots.store_map(slots.rebalance(slots.load_map(spark, path, 1), slots.slot_totals(docs, F.col("doc_id"), size)), path)
    placed = slots.assign(docs, slots.load_map(spark, path, 1), slots.load_map(spark, path, 2))
    return placed.select("doc_id", "size", "vslot", F.col("shard").alias("first_shard"), F.col("grown_shard").alias("shard"), "slot_bytes")


@_query("op8_spaced_seeds")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op9_pseudo_likelihood")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights, counts = pseudo_likelihood.train(docs)
    return pseudo_likelihood.score_texts(docs, weights, counts)


@_query("op10_semi_crf_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(semi_crf.find_spans(_table(spark, sf_dir, "documents")), semi_crf.KINDS)


CLUSTER_SQL = """
with kept as (
  select vec_id, [floor(x::double * 256)::bigint for x in embedding] as v
  from embeddings
  where len(embedding) = 64 and len([x for x in embedding if x is not null and isfinite(x)]) = 64
),
c0 as (
  select c, v from (select v, (row_number() over (order by sha256('2:' || vec_id::varchar) nulls last, v) - 1)::int as c from kept) where c < 40
)
""" + "".join(f"""
, a{r} as (
  select vec_id, v, min({{'d': d, 'c': c}}) as best
  from (select k.vec_id, k.v, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)])::bigint as d from kept k cross join c{r} c)
  group by vec_id, v
)
, m{r} as (
  select c, list(m order by i) as v
  from (select best.c as c, i, floor_mean(sum(v[i])::bigint, count(*)) as m from a{r} cross join (select unnest(range(1, 65)) as i) group by best.c, i)
  group by c
)
, c{r + 1} as (select c.c, coalesce(m.v, c.v) as v from c{r} c left join m{r} m using (c))
""".replace("floor_mean(sum(v[i])::bigint, count(*))", "(sum(v[i])::bigint - ((sum(v[i])::bigint % count(*)) + count(*)) % count(*)) // count(*)") for r in range(5)) + """
, final as (
  select vec_id, min({'d': d, 'c': c}) as best
  from (select k.vec_id, k.v, c.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)])::bigint as d from kept k cross join c5 c)
  group by vec_id, v
)
select vec_id, best.c as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia,
       (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256
from final join c5 on c5.c = best.c
"""


@_query("op11_hadamard_clusters", CLUSTER_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_clusters.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


INFILL_SQL = """
with h as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u
  from documents
),
g as (
  select doc_id, t, u, len(u)::bigint as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3,
         ('0x' || x[25:32])::bigint as h4
  from h
),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from g
),
parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:n], ''), '') as s
  from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""


@_query("op12_displacement_infill", INFILL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.infill(_table(spark, sf_dir, "documents"), restored=True)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@_query("op13_secrets_cnn")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secrets_cnn.find_secrets(_table(spark, sf_dir, "documents")), secrets_cnn.BASE_KINDS)


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
