"""Delta-maintained token counts by source, language and tokenizer version.

A change feed inserts, deletes and revises documents' counts in numbered batches. A commit turns its batch into signed
rows: what stands for a touched document is taken back with a minus sign, what is new is added. The signed rows are
the ledger; their sums by (source, lang, tokenizer) are the batch's totals, and the totals of all batches add up to
the roll-up. Both are Parquet tables with one folder for each batch, which a commit overwrites as a whole: a batch that
is committed again, after a crash or by mistake, reads only the batches before it and replaces its own folder, also
when it has no rows now, so that nothing is counted twice.

Nulls: a null source, language or text is a group of its own or has no tokens; a null id is an id like others.
Repeated changes of a document in one batch: the last by `seq` counts, ties by the largest row. A delete of what is
not there changes nothing. Other columns of the feed are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import shared_path, whole_text

LEDGER = "doc_id long, tokenizer string, source string, lang string, docs long, tokens long, batch_id int"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, batch_id int"
KEYS = ["source", "lang", "tokenizer"]

#: Tokenizer versions with native counters: pattern of one token.
TOKENIZERS = {"space-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[0-9A-Za-z]+"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKENIZERS[tokenizer]), F.lit(0))).cast("long")


def changes(df: DataFrame, op: str, seq: int = 0) -> DataFrame:
    """Feed rows for every document and tokenizer version: doc_id, tokenizer, source, lang, op, tokens, seq."""
    counts = [F.struct(F.lit(name).alias("tokenizer"), (F.lit(0).cast("long") if op == "delete" else count_tokens(whole_text(), name)).alias("tokens")) for name in TOKENIZERS]
    return (df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.explode(F.array(*counts)).alias("__c"))
            .select("doc_id", "__c.tokenizer", "source", "lang", F.lit(op).alias("op"), "__c.tokens", F.lit(seq).alias("seq")))


class TokenRollup:
    """The two tables at a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "token-rollup")

    def _read(self, table: str, schema: str, before: int | None) -> DataFrame:
        """Committed batches, those before a batch if one is given. Before the first commit there is no table."""
        if before is not None and before <= 0:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        return stored if before is None else stored.filter(F.col("batch_id") < before)

    def commit(self, batch_id: int, feed: DataFrame) -> None:
        """Commit batch 0, 1, 2, ...; the same id and feed may be committed any number of times."""
        last = (feed.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("seq", "op", "source", "lang", "tokens")).alias("c"))
                .select("doc_id", "tokenizer", "c.op", "c.source", "c.lang", "c.tokens"))
        added = last.filter("op <> 'delete'").select("doc_id", "tokenizer", "source", "lang", F.lit(1).cast("long").alias("docs"), "tokens")
        signed = added
        if batch_id > 0:
            touched = last.select(F.col("doc_id").alias("__d"), F.col("tokenizer").alias("__t"))
            old = self._read("ledger", LEDGER, batch_id)
            old = old.join(touched, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("tokenizer") == F.col("__t")), "left_semi")
            back = (old.groupBy("doc_id", "tokenizer", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                    .filter("docs <> 0 or tokens <> 0").withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
            signed = back.unionByName(added)
        self._write(signed, "ledger", batch_id)
        own = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger").filter(F.col("batch_id") == batch_id)
        self._write(own.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "totals", batch_id)

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches, without groups that were emptied."""
        return (self._read("totals", TOTALS, None).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .filter("docs <> 0 or tokens <> 0"))
