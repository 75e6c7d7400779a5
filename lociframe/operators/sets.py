"""Set overlap, enrichment and ranked-list enrichment over tables (set_id, item)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.functions.ordering import Level, bh_adjust, ordinal_rank, scan, sorted_ranges
from lociframe.functions.special import hypergeom_sf
from lociframe.session import cut_lineage


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ad / bc; infinite when b or c is zero and ad is not, else 0."""
    return F.when((b == 0) | (c == 0), F.when(a * d > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(
        a * d / (b * c).cast("double"))


#: About as many sets of an item are one chunk of its list.
CHUNK = 1024


def _tiles(rows: DataFrame, keys: list[str], name: str, chunks: Column) -> tuple[DataFrame, DataFrame]:
    """The two sides of all pairs of `name` inside the keys, as rows that meet by equality in tiles of hashed chunks.

    Tile (s, t) with s <= t holds pairs of a member of chunk s and one of chunk t, so that a key with any number of
    members is many tasks.
    """
    cut = rows.withColumn("__n", chunks.cast("int")).withColumn("__c", F.pmod(F.xxhash64(name), F.col("__n")).cast("int"))
    low = cut.withColumn("__s", F.col("__c")).withColumn("__t", F.explode(F.sequence("__c", F.col("__n") - 1)))
    high = cut.withColumn("__t", F.col("__c")).withColumn("__s", F.explode(F.sequence(F.lit(0), "__c")))
    rest = [c for c in rows.columns if c not in {*keys, name}]
    side = lambda df, tag: df.select(*keys, "__s", "__t", F.col(name).alias(f"__{tag}"), *[F.col(c).alias(f"__{c}_{tag}") for c in rest])
    return side(low, "a"), side(high, "b")


def _met(sides: tuple[DataFrame, DataFrame], keys: list[str], rest: list[str], where: Column | None = None) -> DataFrame:
    """Pairs a < b of two sides from _tiles, with the other columns of both."""
    both = sides[0].join(sides[1], [*keys, "__s", "__t"]).where((F.col("__a") < F.col("__b")) | ((F.col("__s") < F.col("__t")) & (F.col("__a") > F.col("__b"))))
    if where is not None:
        both = both.where(where)
    turn = F.col("__a") > F.col("__b")
    pick = lambda x, y, to: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(to)
    return both.select(*keys, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"),
                       *[pick(f"__{c}_{x}", f"__{c}_{y}", f"{c}_{x}") for c in rest for x, y in (("a", "b"), ("b", "a"))])


def with_frequency(sets: DataFrame) -> DataFrame:
    """Rows (set_id, item) with the number of sets that have the item."""
    return sets.join(sets.groupBy("item").agg(F.count(F.lit(1)).alias("frequency")), "item")


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs inside the lists x of a batch, or between x and y where y is given, with their numbers."""
    for batch in batches:
        lists = [*batch["x"], *(v for v in batch["y"] if v is not None)]
        names, codes = np.unique(np.concatenate([np.asarray(v) for v in lists]), return_inverse=True)
        coded = np.split(codes, np.cumsum([len(v) for v in lists])[:-1])
        y = iter(coded[len(batch):])
        inner: dict[int, list[np.ndarray]] = {}
        met: list[np.ndarray] = []
        for x, other in zip(coded, batch["y"]):
            if other is None:
                inner.setdefault(len(x), []).append(x)
            else:
                z = next(y)
                met.append((np.minimum(x[:, None], z) * len(names) + np.maximum(x[:, None], z)).ravel())
        for size, same in inner.items():
            i, j = np.triu_indices(size, 1)
            for at in range(0, len(same), rows := max(1, (1 << 22) // max(1, len(i)))):
                m = np.sort(np.stack(same[at:at + rows]), axis=1)
                met.append((m[:, i] * len(names) + m[:, j]).ravel())
            if sum(map(len, met)) > 1 << 22:
                yield _decoded(met, names)
                met = []
        if met:
            yield _decoded(met, names)


def _decoded(met: list[np.ndarray], names: np.ndarray) -> pd.DataFrame:
    pair, count = np.unique(np.concatenate(met), return_counts=True)
    return pd.DataFrame({"a": names[pair // len(names)], "b": names[pair % len(names)], "n": count})


def co_members(sets: DataFrame) -> DataFrame:
    """Number of shared items of every pair of sets that share any (a < b), from distinct (set_id, item).

    An inverted index: each item has the list of its sets, cut into chunks of about CHUNK by a hash of the set, so that
    an item of very many sets is many rows. Pairs inside a chunk and between two chunks of an item are counted in a
    task before they are exchanged; sets without common items never meet.
    """
    kind = sets.schema["set_id"].dataType.simpleString()
    chunks = -(-sets.agg(F.approx_count_distinct("set_id")).first()[0] // CHUNK) or 1
    lists = sets.groupBy("item", F.pmod(F.xxhash64("set_id"), F.lit(chunks)).alias("c")).agg(F.collect_list("set_id").alias("x"))
    met = lists.where(F.size("x") > 1).select("x", F.lit(None).cast(f"array<{kind}>").alias("y"))
    if chunks > 1:  # else no item has a second chunk
        lists = cut_lineage(lists)
        wide = lists.join(lists.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("item"), "item", "left_semi")
        across = wide.join(wide.select("item", F.col("c").alias("d"), F.col("x").alias("y")), "item").where("c < d")
        met = met.unionByName(across.select("x", "y"))
    return met.mapInPandas(_pair_counts, f"a {kind}, b {kind}, n long").groupBy("a", "b").agg(F.sum("n").alias("intersection"))


def all_pairs_of_sets(sizes: DataFrame) -> DataFrame:
    """Pairs of set names (a < b) with both sizes, by tiles: as many rows as pairs, for results that ask for all."""
    n = sizes.agg(F.ceil(F.count(F.lit(1)) / CHUNK)).scalar()
    rows = sizes.select(F.lit(0).alias("__k"), "set_id", "size")
    return _met(_tiles(rows, ["__k"], "set_id", F.greatest(n, F.lit(1))), ["__k"], ["size"]).drop("__k")


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))


def _sized_pairs(sets: DataFrame, empty_pairs: bool) -> DataFrame:
    """Pairs with both sizes and the intersection; with or without those that share nothing."""
    sizes, shared = set_sizes(sets), co_members(sets)
    if empty_pairs:
        return all_pairs_of_sets(sizes).join(shared, ["a", "b"], "left").na.fill(0, ["intersection"])
    side = lambda x: sizes.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"))
    return shared.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "intersection")


def similar_sets(sets: DataFrame, min_jaccard: float) -> DataFrame:
    """Pairs (a < b) of Jaccard index `min_jaccard` (over 0) or more, with sizes and intersection; nothing is missed.

    Sets with that index share an item among the rarest n - ceil(t·n) + 1 of each, so only these are indexed, and only
    sizes within the factor t meet. Candidates are counted over their whole sets.
    """
    t = min_jaccard
    sets = cut_lineage(sets.select("set_id", "item").distinct())
    sizes = set_sizes(sets)
    placed = ordinal_rank(with_frequency(sets), ["set_id"], "frequency", "item", "place").join(sizes, "set_id")
    prefix = cut_lineage(placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1).select("set_id", "item", "size"))
    listed = prefix.join(prefix.groupBy("item").agg(F.count(F.lit(1)).alias("__f")).where("__f > 1"), "item")
    sides = _tiles(listed.select("item", "set_id", "size", "__f"), ["item"], "set_id", F.ceil(F.col("__f") / CHUNK))
    near = (F.col("__size_a") >= F.col("__size_b") * t - 1e-9) & (F.col("__size_b") >= F.col("__size_a") * t - 1e-9)
    found = _met(sides, ["item"], ["size"], near).select("a", "b", "size_a", "size_b").distinct()
    shared = set_members(sets, cut_lineage(found)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("intersection"))
    jaccard = F.col("intersection") / (F.col("size_a") + F.col("size_b") - F.col("intersection"))
    return found.join(shared, ["a", "b"]).withColumn("jaccard", jaccard).where(F.col("jaccard") >= t - 1e-12)


def pairwise_overlap(sets: DataFrame, background: int | Column, empty_pairs: bool = True) -> DataFrame:
    """Intersection, union, Jaccard, overlap coefficient, hypergeometric p, odds ratio and adjusted p.

    Without ``empty_pairs`` there are rows for pairs with common items only, and p is adjusted over these.
    """
    sets = cut_lineage(sets.select("set_id", "item").distinct())
    i, na, nb = F.col("intersection"), F.col("size_a"), F.col("size_b")
    bg = background if isinstance(background, Column) else F.lit(background)
    out = (
        _sized_pairs(sets, empty_pairs).withColumn("background", bg.cast("long")).withColumn("union", na + nb - i)
        .withColumn("jaccard", i / F.col("union")).withColumn("overlap_coefficient", i / F.least(na, nb))
        .withColumn("pvalue", hypergeom_sf(i, na, nb, F.col("background")))
        .withColumn("odds_ratio", odds_ratio(i, na - i, nb - i, F.col("background") - na - nb + i))
    )
    return bh_adjust(out, "pvalue", "fdr").drop("background")


def jaccard_matrix(sets: DataFrame, empty_pairs: bool = True) -> DataFrame:
    """Symmetric Jaccard table with ones on the diagonal, in long form; without ``empty_pairs`` without its zeros."""
    sets = cut_lineage(sets.select("set_id", "item").distinct())
    j = F.col("intersection") / (F.col("size_a") + F.col("size_b") - F.col("intersection"))
    cells = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = _sized_pairs(sets, empty_pairs).select(F.explode(cells).alias("c"), j.alias("jaccard")).select("c.a", "c.b", "jaccard")
    same = set_sizes(sets).select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("jaccard"))
    return both.unionByName(same)


def set_members(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members shared by each wanted pair (a, b), as rows (a, b, item)."""
    x = sets.select(F.col("set_id").alias("a"), "item")
    y = sets.select(F.col("set_id").alias("b"), "item")
    return wanted.select("a", "b").join(x, "a").join(y, ["b", "item"]).select("a", "b", "item")


def global_intersection(sets: DataFrame) -> DataFrame:
    """Items that every set has."""
    n = sets.agg(F.count_distinct("set_id")).scalar()
    return sets.groupBy("item").agg(F.count_distinct("set_id").alias("k")).where(F.col("k") == n).select("item")


def unique_items(sets: DataFrame) -> DataFrame:
    """Items found in exactly one set, with that set."""
    one = sets.groupBy("item").agg(F.count_distinct("set_id").alias("k"), F.min("set_id").alias("set_id"))
    return one.where("k = 1").select("set_id", "item")


def membership_cells(sets: DataFrame) -> DataFrame:
    """Number of items for each exact combination of sets. The combination is as long as the number of sets."""
    combo = sets.groupBy("item").agg(F.sort_array(F.collect_set("set_id")).alias("combination"))
    return combo.groupBy("combination").agg(F.count(F.lit(1)).alias("count"))


# ---- enrichment ----------------------------------------------------------------------------------


def library_enrichment(query: DataFrame, library: DataFrame, background: int | None = None) -> DataFrame:
    """Each library set against one query list: overlap k/K, hypergeometric p, odds ratio, adjusted p.

    Without ``background`` the universe is all items of the library.
    """
    library = cut_lineage(library.select("set_id", "item").distinct())
    query = cut_lineage(query.select("item").distinct())
    total = F.lit(background) if background else library.agg(F.count_distinct("item")).scalar()
    n_query = (query if background else query.join(library.select("item").distinct(), "item", "left_semi")).agg(
        F.count(F.lit(1))).scalar()
    sizes = library.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    hits = library.join(query, "item", "left_semi").groupBy("set_id").agg(F.count(F.lit(1)).alias("hits"))
    out = sizes.join(hits, "set_id").withColumn("n_query", n_query).withColumn("total", total.cast("long"))
    a, k, n, t = (F.col(c) for c in ("hits", "size", "n_query", "total"))
    out = (
        out.withColumn("overlap", F.concat_ws("/", a, k)).withColumn("gene_ratio", a / k)
        .withColumn("pvalue", hypergeom_sf(a, n, k, t)).withColumn("odds_ratio", odds_ratio(a, n - a, k - a, t - n - k + a))
    )
    return bh_adjust(out, "pvalue", "fdr").drop("n_query", "total")


def enrichment_members(query: DataFrame, library: DataFrame) -> DataFrame:
    """Shared items of the query and each library set as one sorted text per set."""
    shared = library.join(query.select("item").distinct(), "item", "left_semi").distinct()
    return shared.groupBy("set_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda i: i.cast("string")), ";").alias("genes"))


def clean_enrichment(df: DataFrame, term: str = "term", overlap: str = "overlap", fdr: str = "fdr") -> DataFrame:
    """Parsed overlap counts, gene ratio, -log10 FDR and the term without its trailing accession."""
    part = F.split(F.col(overlap), "/")
    hit, bg = part[0].try_cast("int"), part[1].try_cast("int")
    return (
        df.where(F.col(fdr).isNotNull()).withColumn("hit_count", hit).withColumn("bg_count", bg)
        .withColumn("gene_ratio", F.try_divide(F.col("hit_count"), F.col("bg_count")))
        .withColumn("minus_log10_fdr", -F.log10(F.greatest(F.col(fdr), F.lit(5e-324))))
        .withColumn("term_clean", F.regexp_replace(F.col(term), r"\s*\(GO:\d+\)\s*$", ""))
        .orderBy(fdr, F.desc("hit_count"), F.desc("gene_ratio"), "term_clean")
    )


def top_terms(df: DataFrame, cutoff: float, top: int, order: list[Column], fdr: str = "fdr") -> DataFrame:
    """First ``top`` significant rows in the given order; all rows compete when none is significant."""
    best = df.agg(F.min(fdr)).scalar()
    return df.where((F.col(fdr) <= cutoff) | (best > cutoff)).orderBy(*order).limit(top)


def top_terms_by_direction(df: DataFrame, cutoff: float, top: int, score: str = "nes", fdr: str = "fdr",
                           key: str = "set_id") -> DataFrame:
    """``top`` terms of each sign of the score, smallest FDR and then largest |score| first."""
    df = cut_lineage(df)
    best = df.agg(F.min(fdr)).scalar()
    ok = df.where((F.col(fdr) <= cutoff) | (best > cutoff))
    pos = ok.where(F.col(score) > 0).orderBy(fdr, F.desc(score), key).limit(top)
    neg = ok.where(F.col(score) < 0).orderBy(fdr, score, key).limit(top)
    return pos.unionByName(neg)


# ---- regulators ----------------------------------------------------------------------------------


def evidence_lists(df: DataFrame, top: int = 50) -> DataFrame:
    """Mean p and number of sources per regulator from ranked lists (library, ranking ARRAY<STRUCT<tf, p>>)."""
    rows = df.select("library", F.explode(F.slice("ranking", 1, top)).alias("r"))
    return rows.groupBy(F.upper("r.tf").alias("tf")).agg(
        F.avg(F.coalesce(F.col("r.p"), F.lit(1.0))).alias("mean_p"), F.count(F.lit(1)).alias("n_lists"),
        F.array_join(F.sort_array(F.collect_set("library")), ";").alias("sources"))


def merge_regulators(lists: DataFrame, regulons: DataFrame, query: DataFrame, background: int) -> DataFrame:
    """Full outer merge of list evidence (tf, mean_p, sources) and regulon enrichment (tf, target).

    The combined p is the smaller of the two, adjusted over all regulators.
    """
    enriched = library_enrichment(query, regulons.select(F.col("tf").alias("set_id"), F.col("target").alias("item")),
                                  background)
    enriched = enriched.select(F.col("set_id").alias("tf"), F.col("hits").alias("overlap_count"),
                               F.col("pvalue").alias("regulon_p"), "odds_ratio")
    out = lists.join(enriched, "tf", "full_outer").select(
        "tf", F.least(F.coalesce("mean_p", F.lit(1.0)), F.coalesce("regulon_p", F.lit(1.0))).alias("pvalue"),
        F.coalesce("overlap_count", F.lit(0)).alias("overlap_count"), F.coalesce("odds_ratio", F.lit(0.0)).alias("odds_ratio"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.col("mean_p").isNotNull().alias("from_lists"),
        F.col("regulon_p").isNotNull().alias("from_regulons"),
    )
    return bh_adjust(out, "pvalue", "fdr")


# ---- ranked lists --------------------------------------------------------------------------------


def dedup_by_abs(df: DataFrame, item: str = "item", score: str = "score") -> DataFrame:
    """One row per item: the score with the largest absolute value, the larger one on a tie."""
    return df.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(item).agg(
        F.max_by(F.col(score), F.struct(F.abs(score), F.col(score))).alias(score))


def enrichment_scores(places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Enrichment score of each row of ascending places among n, with their weights: the running sum turns only there.

    Where all weights of a row are zero, members count equally.
    """
    k = places.shape[1]
    total = weights.sum(axis=1, keepdims=True)
    share = np.where(total > 0, weights / np.where(total > 0, total, 1), 1 / k)
    hit = np.cumsum(share, axis=1)
    miss = (places - np.arange(1, k + 1)) / (n - k)
    hi, lo = (hit - miss).max(axis=1), (hit - share - miss).min(axis=1)
    return np.where(hi >= -lo, hi, lo)


def _set_scores(members: DataFrame, n: int) -> DataFrame:
    """set_id, size and score of sets from rows (set_id, place, weight)."""
    kind = members.schema["set_id"].dataType.simpleString()
    lists = members.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["place"].str.len()
            for k, part in batch.groupby(sizes):
                es = enrichment_scores(np.stack(part["place"].to_list()), np.stack(part["weight"].to_list()), n)
                yield pd.DataFrame({"set_id": part["set_id"], "size": int(k), "es": es})

    return lists.select("set_id", F.col("m.place").alias("place"), F.col("m.weight").alias("weight")).mapInPandas(run, f"set_id {kind}, size int, es double")


def draw_places(spark: SparkSession, n: int, k: int, draws: int, seed: int) -> DataFrame:
    """For each draw (from 1) k distinct places among 1 to n, in the order drawn: rows (draw, places ARRAY).

    A draw is a seeded sequence of hashed places without its repetitions, so nothing is sorted, and the first places of
    a draw are a draw of fewer. The sequence is lengthened until every draw has k.
    """
    if k > n:
        raise ValueError(f"{k} distinct places out of {n}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = 2 * k + 64
    while True:
        place = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw"), j)), 1, 13), 16, 10).cast("long") % n + 1
        drawn = spark.range(1, draws + 1, numPartitions=min(parts, draws)).select(
            F.col("id").alias("draw"), F.slice(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(length)), place)), 1, k).alias("places"))
        drawn = cut_lineage(drawn)
        if drawn.where(F.size("places") < k).isEmpty():
            return drawn
        length *= 2


def null_scores(base: DataFrame, n: int, sizes: Sequence[int], permutations: int, seed: int) -> DataFrame:
    """Scores (size, draw, es) of random sets: one draw of the largest size serves all sizes by its first places.

    ``base`` has each place and its weight. The rows of the draws are permutations times the largest size, whatever n is.
    """
    sizes = sorted(sizes)
    drawn = draw_places(base.sparkSession, n, sizes[-1], permutations, seed).select("draw", F.posexplode("places").alias("j", "place"))
    weighed = drawn.join(base.select("place", "weight"), "place")
    lists = weighed.groupBy("draw").agg(F.sort_array(F.collect_list(F.struct("j", "place", "weight"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, weights = np.stack(batch["place"].to_list()), np.stack(batch["weight"].to_list())
            for k in sizes:
                order = np.argsort(places[:, :k], axis=1)
                es = enrichment_scores(np.take_along_axis(places[:, :k], order, 1), np.take_along_axis(weights[:, :k], order, 1), n)
                yield pd.DataFrame({"size": k, "draw": batch["draw"], "es": es})

    return lists.select("draw", F.col("m.place").alias("place"), F.col("m.weight").alias("weight")).mapInPandas(run, "size int, draw long, es double")


def pooled_q(sets: DataFrame, null: DataFrame, out: str = "fdr") -> DataFrame:
    """Share of the null's scores at least as extreme over that share of the sets' own, on the side of the score.

    ``sets`` has nes; ``null`` has nes and w, the number of sets a row stands for. Both go through one ordered scan.
    """
    zero = F.lit(0).cast("long")
    rows = sets.select(F.struct(*sets.columns).alias("row"), "nes", F.lit(1).cast("long").alias("own"), zero.alias("other")).unionByName(
        null.select(F.lit(None).cast(sets.select(F.struct(*sets.columns)).schema[0].dataType).alias("row"), "nes", zero.alias("own"), F.col("w").alias("other")))
    rows = rows.select("*", (F.col("nes") >= 0).alias("up"), F.abs("nes").alias("far"))
    ranges = sorted_ranges(rows.withColumns(dict(zip(("__h", "__p"), (F.xxhash64("row"), F.spark_partition_id())))), [F.col(c) for c in ("up", "far", "__h", "__p")])
    run = scan(ranges, [Level(("up",), {"own": "own", "other": "other"}), Level(("up", "far"), {"tie": "own", "other_tie": "other"})])
    beyond = lambda x, tie: F.col(f"{x}_all") - F.col(f"{x}_run") + F.col(f"{tie}_run")
    q = F.try_divide(beyond("other", "other_tie") / F.col("other_all"), beyond("own", "tie") / F.col("own_all"))
    return run.where("own = 1").select("row.*", F.least(F.lit(1.0), F.coalesce(F.when(F.col("other_all") > 0, q), F.lit(1.0))).alias(out))


def preranked_enrichment(
    ranked: DataFrame, library: DataFrame, permutations: int = 1000, min_size: int = 5, max_size: int = 500,
    seed: int = 123,
) -> DataFrame:
    """Running-sum enrichment of each set in a ranked list against random sets of its size.

    Weights are |score|. Sets of one size share their null, ``permutations`` draws of that many places. The normalised
    score divides by the mean of the null's scores of its sign, p is the share of those at least as extreme, and fdr
    compares the normalised scores of all sets with the pooled normalised null. Sets of fewer than ``min_size`` or more
    than ``max_size`` items of the list, or of the whole list, are left out.
    """
    base = ordinal_rank(ranked.select("item", "score"), [], "score", "item", "place", descending=True)
    base = cut_lineage(base.select("item", F.col("place").cast("long").alias("place"), F.abs("score").cast("double").alias("weight")))
    n = base.count()
    members = library.select("set_id", "item").distinct().join(base, "item")
    sized = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(min_size, max_size) & (F.col("k") < n))
    observed = cut_lineage(_set_scores(members.join(sized.select("set_id"), "set_id", "left_semi"), n))
    # at most max_size - min_size + 1 sizes
    counts = {r["size"]: r["w"] for r in observed.groupBy("size").agg(F.count(F.lit(1)).alias("w")).collect()}
    if not counts:
        zero = F.lit(0.0)
        return observed.select("*", zero.alias("nes"), zero.alias("pvalue"), zero.alias("fdr"), zero.alias("minus_log10_fdr"), F.lit("").alias("direction"))
    null = cut_lineage(null_scores(base, n, list(counts), permutations, seed))
    up = F.col("es") >= 0
    per_size = null.groupBy("size").agg(F.avg(F.when(up, F.col("es"))).alias("mean_up"), F.avg(F.when(~up, -F.col("es"))).alias("mean_down"),
                                        F.collect_list("es").alias("null"))
    scale = F.when(up, F.col("mean_up")).otherwise(F.col("mean_down"))
    nes = F.coalesce(F.try_divide("es", scale), F.lit(0.0))
    same = F.size(F.filter("null", lambda x: (x >= 0) == up))
    beyond = F.size(F.filter("null", lambda x: ((x >= 0) == up) & (F.abs(x) >= F.abs(F.col("es")))))
    scored = cut_lineage(observed.join(per_size, "size").select("set_id", "size", "es", nes.alias("nes"), F.coalesce(F.try_divide(beyond, same), F.lit(1.0)).alias("pvalue")))
    weights = ranked.sparkSession.createDataFrame(list(counts.items()), "size int, w long")
    pool = null.join(per_size.select("size", "mean_up", "mean_down"), "size").join(F.broadcast(weights), "size").select(nes.alias("nes"), "w")
    out = pooled_q(scored, pool)
    return out.withColumn("minus_log10_fdr", -F.log10(F.greatest(F.col("fdr"), F.lit(5e-324)))).withColumn(
        "direction", F.when(F.col("nes") >= 0, "positive").otherwise("negative"))
