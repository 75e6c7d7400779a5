"""Interval joins, peak annotation, peak quality and region building.

An interval of length up to 2^L is kept in at most two bins of width 2^L. The shorter interval of a
pair looks the longer one up at the longer one's level, where it covers at most two bins itself, so
neither very long nor very short intervals are copied many times, and a chromosome is spread over
its bins. A pair that meets in two bins is kept in the bin of the later start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.functions.ordering import emit_ranges, exact_quantiles, previous_value, running_max, running_max_by, running_sums, sorted_ranges
from lociframe.session import cut_lineage


def _level(start: Column, end: Column) -> Column:
    """Smallest L with end - start <= 2^L, counted in binary digits."""
    return F.length(F.bin(F.greatest(end - start, F.lit(1)) - 1))


def _bins(start: Column, end: Column, level: Column) -> Column:
    lo = F.floor(start / F.pow(F.lit(2.0), level)).cast("long")
    hi = F.floor((F.greatest(end, start + 1) - 1) / F.pow(F.lit(2.0), level)).cast("long")
    return F.sequence(lo, hi)


def _side(df: DataFrame, tag: str) -> DataFrame:
    packed = df.select(
        F.col("chrom"), F.col("start").alias(f"s{tag}"), F.col("end").alias(f"e{tag}"),
        F.struct(*df.columns).alias(tag),
    )
    return packed.withColumn(f"l{tag}", _level(F.col(f"s{tag}"), F.col(f"e{tag}")))


def _meet(short: DataFrame, long: DataFrame, ts: str, tl: str, strict: bool) -> DataFrame:
    levels = long.select(f"l{tl}").distinct().agg(F.collect_set(f"l{tl}")).scalar()  # at most 64 numbers
    own = F.col(f"l{ts}")
    usable = (F.col("level") > own) if strict else (F.col("level") >= own)
    probe = short.withColumn("level", F.explode(levels)).where(usable).withColumn(
        "bin", F.explode(_bins(F.col(f"s{ts}"), F.col(f"e{ts}"), F.col("level"))))
    placed = long.withColumn("level", F.col(f"l{tl}")).withColumn(
        "bin", F.explode(_bins(F.col(f"s{tl}"), F.col(f"e{tl}"), F.col("level"))))
    later = F.greatest(F.col(f"s{ts}"), F.col(f"s{tl}"))
    hit = later < F.least(F.col(f"e{ts}"), F.col(f"e{tl}"))
    own_bin = F.floor(later / F.pow(F.lit(2.0), F.col("level"))).cast("long") == F.col("bin")
    return probe.join(placed, ["chrom", "level", "bin"]).where(hit & own_bin)


def overlap_join(left: DataFrame, right: DataFrame, min_overlap: Column | None = None) -> DataFrame:
    """Every overlapping pair once, as structs ``a`` and ``b`` with ``overlap``.

    ``min_overlap`` is a condition over ``overlap``, ``len_a`` and ``len_b``.
    """
    a, b = cut_lineage(_side(left, "a")), cut_lineage(_side(right, "b"))
    pairs = _meet(a, b, "a", "b", strict=False).select("a", "b", "sa", "ea", "sb", "eb").unionByName(
        _meet(b, a, "b", "a", strict=True).select("a", "b", "sa", "ea", "sb", "eb"))
    out = pairs.select(
        "a", "b", (F.least("ea", "eb") - F.greatest("sa", "sb")).alias("overlap"),
        (F.col("ea") - F.col("sa")).alias("len_a"), (F.col("eb") - F.col("sb")).alias("len_b"),
    )
    return out.where(min_overlap) if min_overlap is not None else out


OVER_HALF_OF_LEFT = "overlap / len_a > 0.5"
HALF_OF_SHORTER = "overlap / least(len_a, len_b) >= 0.5"


# ---- is there a match: no pairs ------------------------------------------------------------------

def _length_level(length: Column) -> Column:
    """Whole binary logarithm of a positive whole length."""
    return F.length(F.bin(length.cast("long"))) - 1


def _row(t, at, pos, kind: int, v=None, tau=None) -> Column:
    as_double = lambda x: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.struct((t if isinstance(t, Column) else F.lit(t)).cast("int").alias("t"), (at if isinstance(at, Column) else F.lit(at)).cast("long").alias("bin"),
                    as_double(pos).alias("pos"), F.lit(kind).alias("kind"), as_double(v).alias("v"), as_double(tau).alias("tau"))


def _bin_at(x: Column, level: Column) -> Column:
    """Bin of width 2^(level - 1)."""
    return F.floor(x / F.pow(F.lit(2.0), level - 1))


def _window(level: Column, lo: Column, hi: Column, kind: int, tau: Column) -> Column:
    """Probes of a window that is longer than a bin: the end of its first bin, the whole bins between, the start of its
    last bin."""
    first, last = _bin_at(lo, level), _bin_at(hi, level)
    bins = F.transform(F.sequence(first + 1, last), lambda b: _row(2 * level, b, F.when(b == last, hi.cast("double")).otherwise(float("inf")), kind, tau=tau))
    return F.concat(F.array(_row(2 * level + 1, first, -lo, kind, tau=tau)), bins)


def _reach_rows(left: DataFrame, right: DataFrame, rule: str, key: str) -> DataFrame:
    """Points of the right side with a value v, and probes of the left side with what v must exceed (tau), such that a
    left interval has a match if the largest v before one of its probes, in its bin, does.

    Over half of the left interval a, of length n: b starts before a and ends beyond start + n/2; or b ends after a and
    starts before end - n/2; or b lies inside a and is longer than n/2, so that its length is of a's binary order or
    the one below, and the longest start in (start, end - n/2) tells. At least half of the shorter: b covers a's middle,
    or b is no longer than a and its own middle lies in a, so that the shortest middle in a tells.
    """
    s, e = F.col("start"), F.col("end")
    n = e - s
    if rule == OVER_HALF_OF_LEFT:
        level = _length_level(n)
        points = F.concat(F.array(_row(-1, 0, s, 0, v=e), _row(-2, 0, -e, 0, v=-s)),
                          F.when(n > 0, F.array(_row(2 * level, _bin_at(s, level), s, 1, v=n), _row(2 * level + 1, _bin_at(s, level), -s, 1, v=n))).otherwise(F.array().cast(F_ROWS)))
        half = n / 2.0
        inside = lambda order: F.when(order >= 0, _window(order, s, e - half, 0, half)).otherwise(F.array().cast(F_ROWS))
        probes = F.concat(F.array(_row(-1, 0, s, 1, tau=s + half), _row(-2, 0, -e, 1, tau=half - e)), inside(level), inside(level - 1))
        right = right.where("end >= start")
    else:
        top = left.where("end > start").agg(F.coalesce(F.max(_length_level(n)), F.lit(0))).scalar()
        level, middle = _length_level(n), (s + e) / 2.0
        orders = F.when(level <= F.col("top"), F.sequence(level, F.col("top"))).otherwise(F.array().cast("array<int>"))
        each = lambda k: F.array(_row(2 * k, _bin_at(middle, k), middle, 0, v=-n), _row(2 * k + 1, _bin_at(middle, k), -middle, 0, v=-n))
        points = F.concat(F.array(_row(-1, 0, s, 0, v=e)), F.flatten(F.transform(orders, each)))
        probes = F.concat(F.array(_row(-1, 0, middle, 1, tau=middle)), _window(level, s, e, 1, -n))
        right = right.where("end > start").withColumn("top", top.cast("int"))
    a = left.where("end > start").select("chrom", "other", F.col(key).alias("id"), F.explode(probes).alias("r")).select("chrom", "other", "id", "r.*")
    b = right.select("chrom", F.col("cond").alias("other"), F.lit(None).cast(left.schema[key].dataType).alias("id"), F.explode(points).alias("r"))
    return a.unionByName(b.select("chrom", "other", "id", "r.*"))


F_ROWS = "array<struct<t:int,bin:bigint,pos:double,kind:int,v:double,tau:double>>"
_GROUP = ["chrom", "other", "t", "bin"]


def reach_hits(left: DataFrame, right: DataFrame, rule: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    """(key, other) for each interval of the left side and each condition of ``other`` in which the right side has a match.

    ``left`` has chrom, start, end, the key and other; ``right`` chrom, start, end and cond. One ordered scan of a few
    rows for each interval, whatever the number of overlaps.
    """
    rows = _reach_rows(left, right, rule, key)
    ranges = sorted_ranges(rows, [F.col(c) for c in [*_GROUP, "pos", "kind", "v", "id"]])
    most = running_max(ranges, _GROUP, "v")
    beyond = np.greater if rule == OVER_HALF_OF_LEFT else np.greater_equal

    def work(number: int, table: pa.Table) -> list[pa.Array]:
        tau = pc.fill_null(table.column("tau"), np.inf).to_numpy()
        found = table.filter(pa.array(beyond(most(number, table), tau) & np.isfinite(tau)))
        return [found.column("id"), found.column("other")]

    fields = [T.StructField(key, left.schema[key].dataType), T.StructField("other", left.schema["other"].dataType)]
    return emit_ranges(ranges, T.StructType(fields), work).distinct()


def _reach_across(left: DataFrame, right: DataFrame, rule: str, key: str) -> DataFrame:
    """As `reach_hits`, with every condition of the right side but ``other``, which is the interval's own one here.

    A probe stands in the order once and is answered by each condition's running maximum, so the rows don't grow with
    the number of conditions.
    """
    left = left.where(F.col("other").isNotNull())
    conds = [r[0] for r in right.select("cond").where(F.col("cond").isNotNull()).distinct().collect()]  # the few conditions
    keys = [c for c in _GROUP if c != "other"]
    ranges = sorted_ranges(_reach_rows(left, right, rule, key), [F.col(c) for c in [*keys, "pos", "kind", "v", "id"]])
    most = running_max_by(ranges, keys, "v", "other", conds)
    beyond = np.greater if rule == OVER_HALF_OF_LEFT else np.greater_equal
    kind = left.schema["other"].dataType

    def work(number: int, table: pa.Table) -> list[pa.Array]:
        tau = pc.fill_null(table.column("tau"), np.inf).to_numpy()
        own, ids = table.column("other"), table.column("id")
        found = []
        for cond, value in zip(conds, most(number, table)):
            hit = beyond(value, tau) & np.isfinite(tau)
            some = ids.filter(pc.and_(pa.array(hit), pc.not_equal(own, pa.scalar(cond, own.type)))).unique()
            found.append((some, pa.array([cond], own.type).take(pa.array(np.zeros(len(some), np.int64)))))
        return [pa.concat_arrays([pa.array([], c.type), *[f[k].cast(c.type) for f in found]]) for k, c in enumerate((ids, own))]

    fields = [T.StructField(key, left.schema[key].dataType), T.StructField("other", kind)]
    return emit_ranges(ranges, T.StructType(fields), work).distinct()


RULES = (OVER_HALF_OF_LEFT, HALF_OF_SHORTER)


def matched_ids(left: DataFrame, right: DataFrame, condition: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    """Keys of the left intervals that have a match; conditions other than the two RULES go through pairs."""
    if condition in RULES:
        one = F.lit(0)
        return reach_hits(left.select("chrom", "start", "end", key, one.alias("other")), right.select("chrom", "start", "end", one.alias("cond")), condition, key).select(key)
    return overlap_join(left, right, F.expr(condition)).select(F.col(f"a.{key}").alias(key)).distinct()


def interval_semi(left: DataFrame, right: DataFrame, condition: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    return left.join(matched_ids(left, right, condition, key), key, "left_semi")


def interval_anti(left: DataFrame, right: DataFrame, condition: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    return left.join(matched_ids(left, right, condition, key), key, "left_anti")


def _cross_condition_hits(peaks: DataFrame, condition: str, key: str, of: str | None = None) -> DataFrame:
    """(key, other condition) for each peak (of one condition, if given) and each other condition in which it has a match."""
    own = peaks if of is None else peaks.where(F.col("cond") == of)
    if condition in RULES:
        return _reach_across(own.select("chrom", "start", "end", key, F.col("cond").alias("other")), peaks.select("chrom", "start", "end", "cond"), condition, key)
    pairs = overlap_join(own, peaks, F.expr(condition)).where(F.col("a.cond") != F.col("b.cond"))
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("b.cond").alias("other")).distinct()


def unique_peaks(peaks: DataFrame, condition: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    """Peaks of each condition without a match in any other condition."""
    return peaks.join(_cross_condition_hits(peaks, condition, key).select(key), key, "left_anti")


def shared_peaks(peaks: DataFrame, first: str, condition: str = OVER_HALF_OF_LEFT, key: str = "name") -> DataFrame:
    """Peaks of the condition ``first`` with a match in every other condition."""
    others = peaks.agg(F.count_distinct("cond")).scalar() - 1
    hits = _cross_condition_hits(peaks, condition, key, first)
    full = hits.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == others)
    return peaks.where(F.col("cond") == first).join(full.select(key), key, "left_semi")


def peak_similarity(peaks: DataFrame, key: str = "name", condition: str = HALF_OF_SHORTER) -> DataFrame:
    """Matched peaks of one condition in another over the union, for every ordered pair of conditions."""
    hits = _cross_condition_hits(peaks, condition, key)
    matched = hits.join(peaks.select(key, "cond"), key).groupBy("cond", "other").agg(F.count(F.lit(1)).alias("matched"))
    sizes = peaks.groupBy("cond").agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.toDF("cond", "n1"), sizes.toDF("other", "n2")
    grid = a.join(b, F.col("cond") != F.col("other")).join(matched, ["cond", "other"], "left").na.fill(0, ["matched"])
    return grid.select("cond", "other", "matched", (F.col("matched") / (F.col("n1") + F.col("n2") - F.col("matched"))).alias("similarity"))


def filter_peaks(peaks: DataFrame, min_score: float = 0.0, top: int | None = None) -> DataFrame:
    out = peaks.where(F.col("score") >= min_score) if min_score > 0 else peaks
    return out.orderBy(F.desc("score"), "name").limit(top) if top else out


def annotate_peaks(peaks: DataFrame, genes: DataFrame, tss_window: int = 2000, reach: int = 10000) -> DataFrame:
    """Nearest transcription start within reach, its distance from the peak centre, and a class.

    genes: chrom, start, end, gene, strand (1 or -1). The class comes from the nearest gene: promoter
    within ``tss_window``, exonic when the peak starts or ends inside the gene, intronic when it covers it.
    """
    peaks = cut_lineage(peaks)
    wide = peaks.select("chrom", (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"), "name",
                        F.col("start").alias("ps"), F.col("end").alias("pe"))
    pairs = overlap_join(wide, genes.withColumn("end", F.col("end") + 1))
    tss = F.when(F.col("b.strand") == 1, F.col("b.start")).otherwise(F.col("b.end") - 1)
    dist = F.abs(F.floor((F.col("a.ps") + F.col("a.pe")) / 2) - tss)
    near = pairs.select(
        F.col("a.name").alias("name"), dist.cast("long").alias("dist"), F.col("b.gene").alias("gene"), F.col("b.start").alias("gs"),
        (F.col("b.end") - 1).alias("ge"),
    ).groupBy("name").agg(F.min(F.struct("dist", "gene", "gs", "ge")).alias("g"))
    out = peaks.join(near, "name", "left")
    gs, ge, ps, pe = F.col("g.gs"), F.col("g.ge"), F.col("start"), F.col("end")
    cls = (
        F.when(F.col("g").isNull(), "intergenic").when(F.col("g.dist") <= tss_window, "promoter")
        .when(ps.between(gs, ge) | pe.between(gs, ge), "exonic").when((ps < gs) & (pe > ge), "intronic")
        .when((gs <= ps) & (ps < ge) & (ge < pe), "downstream").otherwise("intergenic")
    )
    return out.select(
        *peaks.columns, cls.alias("annotation"), F.coalesce(F.col("g.gene").cast("string"), F.lit(".")).alias("nearest_gene"),
        F.coalesce(F.col("g.dist"), F.lit(-1)).alias("distance_to_tss"))


def peak_qc(peaks: DataFrame) -> DataFrame:
    """Counts, widths and scores in one row."""
    w = peaks.withColumn("width", F.col("end") - F.col("start"))
    base = w.agg(
        F.count(F.lit(1)).alias("total_peaks"), F.floor(F.avg("width")).alias("mean_peak_width"),
        F.min("width").alias("min_peak_width"), F.max("width").alias("max_peak_width"), F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
    )
    mw = exact_quantiles(w, [], "width", {"m": 0.5}).select(F.floor("m")).scalar()
    ms = exact_quantiles(w, [], "score", {"m": 0.5}).select("m").scalar()
    return base.withColumn("median_peak_width", mw).withColumn("median_score", ms)


def promoter_share(annotated: DataFrame) -> DataFrame:
    is_promoter = F.col("annotation") == "promoter"
    return annotated.agg(F.count_if(is_promoter).alias("promoter_peaks"), F.avg(is_promoter.cast("int")).alias("tss_enrichment"))


def build_regions(sites: DataFrame, window: int = 1000, min_sites: int = 3) -> DataFrame:
    """Runs of sites (chrom, pos, delta, fdr) with gaps up to ``window``: bounds, size and means."""
    per = sites.groupBy("chrom", "pos").agg(
        F.count(F.lit(1)).alias("k"), F.sum("delta").alias("sum_delta"), F.sum("fdr").alias("sum_fdr"))
    prev = previous_value(per, ["chrom"], "pos")
    flagged = prev.withColumn("fresh", F.when(F.col("pos") - F.col("previous") <= window, 0).otherwise(1)).drop("previous")
    placed = running_sums(flagged, ["chrom"], "pos", ["fresh"])
    return (
        placed.groupBy("chrom", F.col("fresh_run").alias("region"))
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("k").alias("n_sites"),
             (F.sum("sum_delta") / F.sum("k")).alias("mean_delta"), (F.sum("sum_fdr") / F.sum("k")).alias("mean_fdr"))
        .where(F.col("n_sites") >= min_sites).drop("region")
    )
