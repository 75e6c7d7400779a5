"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are cut into lower-case words. A seed is a fixed mask over a window of words that looks at some places and ignores
the others, so that a passage with replaced words still has windows whose seeds agree. Benchmark seeds are joined with
the seeds of every window of every document. A hit fixes an alignment of a document with an item; around it the words
are compared place by place, and the document is contaminated if in some stretch of MIN_OVERLAP aligned words, or of the
whole item if that is shorter, at least MIN_SHARE of the words are equal.

No allowed set of replaced words hides a passage: a stretch of 10 to 13 words may have two replaced, and for every two of
10 places one of MASKS, at some place, ignores both; an item of 5 to 9 words may have one replaced, and one of three
masks, which ignore every third place, ignores it; shorter items must stand as they are. The tests enumerate this.

Inside a long run of one word all windows are alike. Only those at the ends of a run are looked up: an alignment that
starts or ends with the run has as many equal words as any inside it.

The benchmark's seeds are sent to all tasks while there are at most BROADCAST_SEEDS of them, a size that is counted
first; beyond, both sides are shuffled on the seed and nothing else changes.

Nulls: a null text has no words; a null item matches nothing; items of null id count as one, without a name in `items`. A text of fewer words than an item's shortest stretch
has no hit. Rows of one doc_id and text share the verdict, and null ids are rows like others. An empty benchmark
leaves every document clean. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import free_name, row_key, table_cut, whole_text

#: Masks for items of SPAN words or more, with six places that count in each, found by search.
MASKS = ("1111011", "11001111", "110110011", "110101011", "10111101")
SPAN = 10
MIN_OVERLAP = 13
MIN_SHARE = 0.8
#: Items of so many words or fewer have no word that may be replaced.
EXACT = 4
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the text's words: runs of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def short_masks(size: int) -> list[str]:
    """Masks over a whole item of fewer than SPAN words."""
    if size <= EXACT:
        return ["1" * size]
    return ["".join("0" if i % 3 == k else "1" for i in range(size)) for k in range(3)]


def seed_at(words: Column, at: Column, mask: str, kind: str) -> Column:
    """Hash of the places that a mask counts, from a 0-based place on."""
    return F.xxhash64(F.lit(f"{kind}:{mask}"), *(F.get(words, at + i) for i, c in enumerate(mask) if c == "1"))


def inside_run(words: Column, at: Column) -> Column:
    """Whether the window at a place lies inside a run of one word, with that word before and behind it."""
    same = lambda i: F.get(words, at + i) == F.get(words, at)
    out = same(1) & same(-1)
    for i in range(2, SPAN + 1):
        out = out & same(i)
    return F.coalesce(out, F.lit(False))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, item_id, item_at (place of the window in the item)."""
    items = benchmark.select("item_id", word_hashes(whole_text()).alias("words")).withColumn("size", F.size("words"))
    words, at = F.col("words"), F.col("at")
    long = items.filter(F.col("size") >= SPAN).select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.col("size") - min(map(len, MASKS)))).alias("at"))
    seeds = F.array(*(F.when(at + len(m) <= F.col("size"), seed_at(words, at, m, "long")) for m in MASKS))
    out = long.filter(~inside_run(words, at)).select("item_id", at.alias("item_at"), F.explode(seeds).alias("seed")).filter("seed is not null")
    whole = F.lit(None).cast("array<long>")
    for size in range(1, SPAN):
        whole = F.when(F.col("size") == size, F.array(*(seed_at(words, F.lit(0), m, f"short {size}") for m in short_masks(size)))).otherwise(whole)
    short = items.filter(F.col("size").between(1, SPAN - 1)).select("item_id", F.lit(0).alias("item_at"), F.explode(whole).alias("seed"))
    return out.unionByName(short).select("seed", "item_id", "item_at").distinct()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Alignments to verify: __id, __hash, item_id, shift (place in the document of the item's first word)."""
    seeds = table_cut(item_seeds(benchmark), "item-seeds")
    sizes = benchmark.select(F.size(word_hashes(whole_text())).alias("size")).filter(F.col("size").between(1, SPAN - 1)).distinct()
    short = sorted(r["size"] for r in sizes.collect())  # at most SPAN - 1 numbers
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    words, at = F.col("words"), F.col("at")
    window = docs.select(*row_key(), word_hashes(whole_text()).alias("words"))
    least = min([*map(len, MASKS), *short])
    window = window.filter(F.size("words") >= least).select("__id", "__hash", "words", F.explode(F.sequence(F.lit(0), F.size("words") - least)).alias("at"))
    masks = [(m, "long") for m in MASKS] + [(m, f"short {n}") for n in short for m in short_masks(n)]
    looks = F.array(*(F.when(at + len(m) <= F.size(words), seed_at(words, at, m, kind)) for m, kind in masks))
    looked = window.filter(~inside_run(words, at)).select("__id", "__hash", "at", F.explode(looks).alias("seed"))
    return looked.join(seeds, "seed").select("__id", "__hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: __id, __hash, item_id, shift, matched (most equal words in a stretch) and stretch (its length)."""
    found = table_cut(hits(docs, benchmark), "seed-hits")
    items = benchmark.select("item_id", word_hashes(whole_text()).alias("item"))
    wanted = found.select(F.col("__id").alias("w_id"), F.col("__hash").alias("w_hash")).distinct()
    texts = docs.select(*row_key(), whole_text().alias("text"))
    texts = (texts.join(wanted, F.col("__id").eqNullSafe(F.col("w_id")) & (F.col("__hash") == F.col("w_hash")), "left_semi")
             .dropDuplicates(["__id", "__hash"]).select(F.col("__id").alias("d_id"), F.col("__hash").alias("d_hash"), word_hashes(F.col("text")).alias("doc")))
    found = found.withColumnRenamed("item_id", "f_item")
    both = found.join(items, F.col("f_item").eqNullSafe(F.col("item_id"))).join(texts, F.col("__id").eqNullSafe(F.col("d_id")) & (F.col("__hash") == F.col("d_hash")))
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("doc") - F.col("shift"))
    stretch = F.least(F.lit(MIN_OVERLAP), F.size("item"))
    equal = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1), lambda i: (F.get("item", i) == F.get("doc", i + F.col("shift"))).cast("int"))
    both = both.withColumns({"lo": lo, "hi": hi, "stretch": stretch}).filter(F.col("hi") - F.col("lo") >= F.col("stretch")).withColumn("equal", equal)
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("stretch") + 1), lambda i: F.aggregate(F.slice("equal", i, F.col("stretch")), F.lit(0), lambda a, x: a + x))
    return (both.withColumn("matched", F.array_max(sums)).filter(F.col("matched") >= F.ceil(F.col("stretch") * MIN_SHARE))
            .select("__id", "__hash", "item_id", "shift", "matched", "stretch"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each contaminated document: __id, __hash, n_items, items (ids, sorted), best (largest share of equal words)."""
    return (overlaps(docs, benchmark).groupBy("__id", "__hash")
            .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("matched") / F.col("stretch")).alias("best"), F.max(F.col("item_id").isNull().cast("long")).alias("unnamed"))
            .withColumn("n_items", F.size("items") + F.col("unnamed")).drop("unnamed"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined) and best for every row."""
    found = contaminated(docs, benchmark).withColumnsRenamed({"__id": "c_id", "__hash": "c_hash"})
    rows = docs.select(*row_key())
    joined = rows.join(found, F.col("__id").eqNullSafe(F.col("c_id")) & (F.col("__hash") == F.col("c_hash")), "left")
    return joined.select(F.col("__id").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                         F.coalesce(F.concat_ws(",", F.col("items").cast("array<string>")), F.lit("")).alias("items"), F.coalesce("best", F.lit(0.0)).alias("best"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows, with all columns as they were."""
    found = contaminated(docs, benchmark).select(F.col("__id").alias("c_id"), F.col("__hash").alias("c_hash"))
    own, digest = free_name(docs, "__id"), free_name(docs, "__hash")
    keyed = docs.withColumns({own: F.col("doc_id"), digest: F.xxhash64(whole_text())})
    found = found.withColumnsRenamed({"c_id": (c_id := free_name(keyed, "c_id")), "c_hash": (c_hash := free_name(keyed, "c_hash"))})
    return keyed.join(found, F.col(own).eqNullSafe(F.col(c_id)) & (F.col(digest) == F.col(c_hash)), "left_anti").drop(own, digest)
