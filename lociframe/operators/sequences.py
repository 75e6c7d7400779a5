"""Guide scans and designs over sequence tables, and per-protein tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import sequence as Q
from lociframe.functions.ordering import ordinal_rank
from lociframe.functions.special import let
from lociframe.session import cut_lineage, spread

PIECE = 1024


def windows(df: DataFrame, spacer_len: int, pam: str, seq: str = "seq") -> DataFrame:
    """Windows of a spacer and a PAM that may hold a site of either strand, with their 0-based start ``at`` and the
    sequence length ``n``.

    A long sequence is first cut, in one pass, into pieces that overlap by a window less one letter. The pieces
    are shuffled, so that one chromosome is not scanned by one task. A piece is split in front of each window with
    a PAM; the starts of its parts are those windows, and its own start, which needn't be one.
    """
    width = spacer_len + len(pam)
    keep = [c for c in df.columns if c != seq]
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    joined = F.transform(F.col("parts"), lambda p, i: F.concat(
        p, F.coalesce(F.substring(F.get(F.col("parts"), i + 1), 1, width - 1), F.lit(""))))
    pieces = (
        df.select(*keep, F.length(seq).alias("n"), parts.alias("parts"))
        .select(*keep, "n", F.posexplode(joined).alias("k", "piece"))
        .where(F.length("piece") >= width)
    )
    pieces = spread(pieces, *keep, "k")
    front = f"(?={Q.iupac_regex_reverse(pam)}.{{{spacer_len}}}|.{{{spacer_len}}}{Q.iupac_regex(pam)})"
    starts = let(F.split(F.regexp_replace("piece", "[^ACGT]", "N"), front, -1), lambda cut: F.transform(
        cut, lambda _, i: F.length(F.array_join(F.slice(cut, F.lit(1), i), ""))))
    return pieces.withColumn("i", F.explode(starts)).select(
        *keep, "n", (F.col("k") * PIECE + F.col("i")).alias("at"), F.substr("piece", F.col("i") + 1, F.lit(width)).alias("window"))


def both_strands(wins: DataFrame, spacer_len: int, pam: str) -> DataFrame:
    """Sites of both strands: spacer, PAM and spacer start on the forward frame.

    The PAM of the reverse strand is looked for as its reverse complement at the front of the window, so
    only the few windows that have one are turned round.
    """
    n, w = len(pam), F.col("window")
    rc = Q.reverse_complement(w)
    plus = F.substring(w, spacer_len + 1, n).rlike(f"^{Q.iupac_regex(pam)}$")
    minus = F.substring(w, 1, n).rlike(f"^{Q.iupac_regex_reverse(pam)}$")
    sides = F.array_compact(F.array(
        F.when(plus, F.struct(F.lit("+").alias("strand"), F.col("at").alias("position"), w.alias("w"))),
        F.when(minus, F.struct(F.lit("-").alias("strand"), (F.col("at") + n).alias("position"), rc.alias("w"))),
    ))
    keep = [c for c in wins.columns if c != "window"]
    out = wins.where(plus | minus).select(*keep, F.explode(sides).alias("s"))
    return out.select(*keep, "s.strand", "s.position", F.substring("s.w", 1, spacer_len).alias("spacer"),
                      F.substring("s.w", spacer_len + 1, n).alias("pam"))


def find_sites(df: DataFrame, pam: str = "NGG", spacer_len: int = 20, clean: bool = True) -> DataFrame:
    """All spacers next to a PAM on both strands, also overlapping ones; no N, optionally no problem motifs."""
    sites = both_strands(windows(df, spacer_len, pam), spacer_len, pam).drop("at", "n")
    sites = sites.where(~F.contains(F.col("spacer"), F.lit("N")))
    return sites.where(~Q.is_problematic(F.col("spacer"))) if clean else sites


def _site_key() -> Column:
    return F.col("position") * 2 + F.when(F.col("strand") == "-", 1).otherwise(0)


def design_guides(df: DataFrame, pam: str = "NGG", gc_min: float = 0.3, gc_max: float = 0.8) -> DataFrame:
    """Scored guides of each gene in the GC range, ranked by score (then position, plus strand first)."""
    sites = find_sites(df, pam).withColumn("gc_content", Q.gc_fraction(F.col("spacer"))).where(
        F.col("gc_content").between(gc_min, gc_max))
    scored = sites.withColumn("efficiency_score", F.round(Q.spacer_score(F.col("spacer")), 9)).withColumn("site", _site_key())
    # The ranges are sampled before they are dealt; the table keeps that from being a second scan of the sequences.
    ranked = ordinal_rank(cut_lineage(scored), ["gene"], "efficiency_score", "site", "guide_rank", descending=True)
    return ranked.drop("site")


def assemble_oligos(guides: DataFrame, prefix: str, suffix: str, library: str, per_gene: int | None = None) -> DataFrame:
    """Guide ids and full oligos; optionally only the best guides of each gene."""
    out = guides.where(F.col("guide_rank") <= per_gene) if per_gene else guides
    return out.select(
        F.format_string("%s_guide%d", F.col("gene").cast("string"), F.col("guide_rank").cast("int")).alias("guide_id"), "gene",
        F.col("spacer").alias("spacer_sequence"), F.concat(F.lit(prefix), "spacer", F.lit(suffix)).alias("full_oligo"),
        "strand", "position", F.round("gc_content", 3).alias("gc_content"),
        F.round("efficiency_score", 3).alias("efficiency_score"), "guide_rank", F.lit(library).alias("library"))


def library_summary(guides: DataFrame) -> DataFrame:
    """Guides per gene (min, max, mean) and the GC and score ranges."""
    per = guides.groupBy("gene").agg(
        F.count(F.lit(1)).alias("k"), F.min("gc_content").alias("g0"), F.max("gc_content").alias("g1"),
        F.min("efficiency_score").alias("s0"), F.max("efficiency_score").alias("s1"))
    return per.agg(
        F.count(F.lit(1)).alias("genes"), F.min("k").alias("min_guides"), F.max("k").alias("max_guides"), F.avg("k").alias("mean_guides"),
        F.min("g0").alias("min_gc"), F.max("g1").alias("max_gc"), F.min("s0").alias("min_score"), F.max("s1").alias("max_score"))


def non_targeting_controls(spark: SparkSession, n: int, spacer_len: int = 20, gc_min: float = 0.3, gc_max: float = 0.8,
                           seed: int = 42) -> DataFrame:
    """The first n seeded spacers that pass the guide filters; more are drawn until there are n."""
    letters = [F.substr(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(i)), F.lit(4)) + 1).cast("int"), F.lit(1))
               for i in range(spacer_len)]
    drawn = 10 * n
    while True:
        ok = spark.range(drawn).withColumn("spacer", F.concat(*letters)).where(~Q.is_problematic(F.col("spacer"))).withColumn(
            "gc_content", Q.gc_fraction(F.col("spacer"))).where(F.col("gc_content").between(gc_min, gc_max))
        best = cut_lineage(ok.orderBy("id").limit(n))
        if best.count() >= n:
            break
        if drawn > 4**spacer_len:
            raise ValueError("the filters leave too few spacers")
        drawn *= 4
    placed = ordinal_rank(best, [], "id", "id", "guide_rank")
    return placed.select(
        F.format_string("non-targeting_%04d", (F.col("guide_rank") - 1).cast("int")).alias("gene"), "spacer", F.lit("+").alias("strand"),
        F.lit(0).alias("position"), "gc_content", F.round(Q.spacer_score(F.col("spacer")), 9).alias("efficiency_score"), "guide_rank")


def filter_guide_table(guides: DataFrame, genes: DataFrame, top: int | None = None, drop_duplicates: bool = True) -> DataFrame:
    """Rows (gene, guide, score) of the listed genes, ignoring case; best ``top`` per gene."""
    from pyspark.sql import Window as W

    wanted = genes.select(F.upper("gene").alias("__g")).distinct()
    out = guides.withColumn("__g", F.upper("gene")).join(wanted, "__g", "left_semi").drop("__g")
    if drop_duplicates:
        out = out.groupBy("gene", "guide").agg(F.max("score").alias("score"))
    if top:
        w = W.partitionBy("gene").orderBy(F.desc_nulls_last("score"), "guide")
        out = out.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= top).drop("__i")
    return out


def guide_table_summary(found: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows, genes asked, genes found."""
    asked = genes.select(F.upper("gene").alias("g")).agg(F.count_distinct("g")).scalar()
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.upper("gene")).alias("genes_found")).withColumn(
        "genes_requested", asked)


# ---- base editing --------------------------------------------------------------------------------


def base_editor_scan(exons: DataFrame, pam: str = "NGG", window: tuple[int, int] = (4, 8), target: str = "C",
                     allow_bystander: bool = True, max_bystander: int = 99) -> DataFrame:
    """Guides with editable bases in the window, with bystanders (editable minus one) and scores.

    Exons are rows (exon_id, seq, start). As in the source scan, a strand stops 23 letters before its end.
    """
    pam_len = len(pam)
    wins = windows(exons, 20, pam)
    sites = both_strands(wins, 20, pam)
    own = F.when(F.col("strand") == "+", F.col("at")).otherwise(F.col("n") - F.col("at") - (20 + pam_len))
    pos = Q.window_positions(F.col("spacer"), window[0], window[1], target)
    out = (
        sites.where(own < F.col("n") - 23)
        .where(F.col("spacer").rlike("^[ACGT]+$"))
        .withColumn("positions", pos).where(F.size("positions") > 0)
        .withColumn("bystander_count", F.size("positions") - 1)
        .where(F.col("bystander_count") <= (max_bystander if allow_bystander else 0))
    )
    eff = Q.editing_efficiency(F.col("spacer"))
    penalty = F.round(F.col("bystander_count") * 0.15, 3)
    return out.select(
        "exon_id", F.col("spacer").alias("sgrna_seq"), "pam", "strand", (F.col("start") + F.col("position")).alias("start"),
        (F.col("start") + F.col("position") + 20).alias("end"), F.lit(target).alias("target_base"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("window_positions"), F.size("positions").alias("n_editable"),
        "bystander_count", F.round(Q.gc_fraction(F.col("spacer")), 3).alias("gc_content"), eff.alias("efficiency_score"),
        penalty.alias("bystander_penalty"), F.round(eff - penalty, 3).alias("final_score"),
        Q.edit_outcomes(F.col("spacer"), F.col("positions"), target).alias("edit_outcomes"))


def first_by_sequence(guides: DataFrame) -> DataFrame:
    """One row per spacer: its first site by exon and start (plus strand first)."""
    rest = [c for c in guides.columns if c not in {"sgrna_seq", "exon_id", "start", "strand"}]
    best = guides.groupBy("sgrna_seq").agg(F.min(F.struct("exon_id", "start", "strand", *rest)).alias("g"))
    return best.select("sgrna_seq", "g.exon_id", "g.start", "g.strand", *[f"g.{c}" for c in rest])


def dual_editor_scan(exons: DataFrame, pam: str = "NGG", window: tuple[int, int] = (4, 8)) -> DataFrame:
    """Spacers that both editor types can use, first site of each: those of the C scan with an A in the window.

    Both scans accept a site by the same rules but for the base, so one scan gives their intersection.
    """
    c = base_editor_scan(exons, pam, window, "C")
    has_a = F.size(Q.window_positions(F.col("sgrna_seq"), window[0], window[1], "A")) > 0
    return first_by_sequence(c.where(has_a)).withColumn("target_base", F.lit("CA"))


def near_codon(guides: DataFrame, cds_start: Column | int, aa_position: int, buffer: int = 23) -> DataFrame:
    """Guides whose span reaches the codon of a residue, with the protospacer length as buffer."""
    codon = (cds_start if isinstance(cds_start, Column) else F.lit(cds_start)) + (aa_position - 1) * 3
    return guides.where((F.col("start") <= codon + 3 + buffer) & (F.col("end") >= codon - buffer))


def longest_transcript_exons(genes: DataFrame) -> DataFrame:
    """Exon rows of each gene's transcript with the largest sum of exon lengths.

    genes: gene, transcripts ARRAY<STRUCT<id, exons ARRAY<STRUCT<id, start, end>>>>.
    """
    size = lambda t: F.aggregate(t["exons"], F.lit(0).cast("long"), lambda acc, e: acc + e["end"].cast("long") - e["start"].cast("long"))
    ranked = F.array_sort(F.transform("transcripts", lambda t, i: F.struct((-size(t)).alias("k"), i.alias("i"), t.alias("t"))))
    best = genes.select("gene", ranked[0]["t"].alias("t"))
    return best.select("gene", F.col("t.id").alias("transcript_id"), F.explode("t.exons").alias("e")).select(
        "gene", "transcript_id", F.col("e.id").alias("exon_id"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))


# ---- prime editing -------------------------------------------------------------------------------


def prime_guides(targets: DataFrame, pam: str = "NGG", max_distance: int = 30, nick_range: tuple[int, int] = (40, 100),
                 top: int = 20, with_nick: bool = True) -> DataFrame:
    """Prime-editing guides near each target's edit, with primer site, template, score and nick guide.

    targets: gene, seq, edit_pos, edit_seq. Positions of both strands are on the forward frame. The nick is
    the first opposite-strand spacer, by position, whose start lies within the range.
    """
    from pyspark.sql import Window as W

    sites = cut_lineage(find_sites(targets.select("gene", "seq"), pam, clean=False).select("gene", "strand", "position", "spacer"))
    info = targets.select("gene", "edit_pos", "edit_seq")
    near = sites.join(info, "gene").withColumn("edit_distance", F.abs(F.col("position") + 10 - F.col("edit_pos"))).where(
        (F.col("edit_distance") <= max_distance) & ~F.contains(F.col("spacer"), F.lit("TTTT")))
    site = Q.primer_binding_site(F.col("spacer"))
    rt_len = F.least(F.lit(30), F.length("edit_seq") + 10)
    near = near.withColumn("p", site).select(
        "gene", "spacer", "strand", "position", "edit_distance", F.col("p.pbs").alias("pbs"), F.col("p.tm").alias("pbs_tm"),
        F.substr("edit_seq", F.lit(1), rt_len).alias("rt_template"), Q.gc_fraction(F.col("spacer")).alias("gc_content"))
    near = near.withColumn("efficiency_score", F.round(Q.prime_guide_score(F.col("spacer"), F.col("pbs_tm")), 9))
    w = W.partitionBy("gene").orderBy(F.desc("efficiency_score"), "position", "strand")
    best = near.withColumn("guide_rank", F.row_number().over(w)).where(F.col("guide_rank") <= top)
    if not with_nick:
        return best
    best = cut_lineage(best)
    cell = 64
    reach = nick_range[1] // cell + 1
    probe = best.select("gene", "strand", F.col("position").alias("p0"), F.explode(F.sequence(
        F.floor(F.col("position") / cell) - reach, F.floor(F.col("position") / cell) + reach)).alias("cell"))
    other = sites.select("gene", F.when(F.col("strand") == "+", "-").otherwise("+").alias("strand"), F.col("position").alias("p1"),
                         F.col("spacer").alias("nick"), F.floor(F.col("position") / cell).alias("cell"))
    hits = probe.join(other, ["gene", "strand", "cell"]).where(F.abs(F.col("p1") - F.col("p0")).between(*nick_range))
    nick = hits.groupBy("gene", "strand", F.col("p0").alias("position")).agg(F.min(F.struct("p1", "nick")).alias("k"))
    return best.join(nick, ["gene", "strand", "position"], "left").withColumn("nick_sgrna", F.col("k.nick")).drop("k")


# ---- proteins ------------------------------------------------------------------------------------


def protein_properties(df: DataFrame, key: str = "protein", seq: str = "seq") -> DataFrame:
    """Mass, hydropathy, isoelectric point, instability and helix propensity per protein; no shuffle."""
    s = F.col(seq)
    return df.where(Q.is_protein(s)).select(
        key, F.length(s).alias("length"), Q.molecular_weight(s).alias("molecular_weight"), Q.gravy(s).alias("gravy"),
        Q.isoelectric_point(s).alias("isoelectric_point"), Q.instability_index(s).alias("instability_index"),
        Q.helix_propensity(s).alias("helix_propensity"))


def residue_composition(df: DataFrame, key: str = "protein", seq: str = "seq") -> DataFrame:
    letters = "ACDEFGHIKLMNPQRSTVWY"
    pairs = F.array(*[F.struct(F.lit(c).alias("aa"), Q.count_char(F.col(seq), c).alias("count")) for c in letters])
    return df.select(key, F.length(seq).alias("n"), F.explode(pairs).alias("p")).where("p.count > 0").select(
        key, "p.aa", "p.count", (F.col("p.count") / F.col("n")).alias("fraction"))


def scan_motifs(df: DataFrame, key: str = "protein", seq: str = "seq", motifs: dict[str, str] = Q.MOTIFS) -> DataFrame:

    def named(name: str, pattern: str) -> Column:
        return F.transform(Q.motif_hits(F.col(seq), pattern), lambda h: F.struct(
            F.lit(name).alias("motif"), h["start"].alias("start"), h["end"].alias("end"), h["hit"].alias("hit")))

    hits = F.concat(*[named(name, pattern) for name, pattern in motifs.items()])
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.motif", "h.start", "h.end", "h.hit")


def disorder(df: DataFrame, key: str = "protein", seq: str = "seq", window: int = 20) -> DataFrame:
    """Disordered residues and their fraction per protein."""
    flags = Q.disorder_flags(F.col(seq), window)
    n = F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    return df.select(key, F.length(seq).alias("length"), n.alias("disordered")).withColumn(
        "fraction", F.col("disordered") / F.col("length"))
