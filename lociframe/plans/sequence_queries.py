"""Queries for guide scans, designs and protein tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import sequence as Q
from lociframe.operators import sequences as S
from lociframe.plans.inputs import (
    DIGEST_PROTEINS,
    DIGEST_SEQUENCES,
    digest_proteins,
    digest_sequences,
    table,
)
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


@query("reverse_complement", f"SELECT gene, {RC.format('seq')} AS rc, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) AS gc FROM ({DIGEST_SEQUENCES})")
def _(spark, sf):
    return digest_sequences(spark, sf).select("gene", Q.reverse_complement(F.col("seq")).alias("rc"), F.round(Q.gc_fraction(F.col("seq")), 6).alias("gc"))


def site_sql(pam: str, clean: bool = True, src: str = DIGEST_SEQUENCES) -> str:
    rx = Q.iupac_regex(pam)
    keep = "AND NOT regexp_matches(spacer, 'TTTT|CACCG|A{5}|C{5}|G{5}|T{5}')" if clean else ""
    w = 20 + len(pam)
    return f"""SELECT * FROM (SELECT gene, '+' AS strand, i AS position, substr(seq, i + 1, 20) AS spacer, substr(seq, i + 21, {len(pam)}) AS pam, i AS own, length(seq) AS n FROM ({src}) q, LATERAL (SELECT unnest(range(0, length(seq) - {w} + 1)) AS i)
UNION ALL SELECT gene, '-', i + {len(pam)}, substr(r, 1, 20), substr(r, 21, {len(pam)}), n - i - {w}, n FROM (SELECT gene, i, length(seq) AS n, {RC.format(f'substr(seq, i + 1, {w})')} AS r FROM ({src}) q, LATERAL (SELECT unnest(range(0, length(seq) - {w} + 1)) AS i)))
WHERE regexp_full_match(pam, '{rx}') AND NOT contains(spacer, 'N') {keep}"""


@query("find_sites", f"SELECT gene, strand, position, spacer, pam FROM ({site_sql('NGG')})")
def _(spark, sf):
    return S.find_sites(digest_sequences(spark, sf))


def score_sql(sp: str = "spacer") -> str:
    gc = f"(length(regexp_replace({sp}, '[^GC]', '', 'g')) / 20.0)"
    seed = f"(length(regexp_replace(substr({sp}, 17, 4), '[^GC]', '', 'g')) / 4.0)"
    t = [str(Q.SPACER_INTERCEPT)]
    t += [f"CASE WHEN substr({sp}, {p}, 1) = '{c}' THEN {w} ELSE 0 END" for p, d in Q.SPACER_WEIGHTS.items() for c, w in d.items()]
    t += [f"CASE WHEN substr({sp}, {p}, 2) = '{c}' THEN {w} ELSE 0 END" for (p, c), w in Q.SPACER_PAIR_WEIGHTS.items()]
    t += [f"(-0.2026 * abs({gc} - 0.55))", f"CASE WHEN {gc} < 0.3 OR {gc} > 0.75 THEN -0.15 ELSE 0 END",
          f"CASE WHEN {seed} > 0.75 THEN -0.15 WHEN {seed} < 0.25 THEN -0.08 ELSE 0 END"]
    t += [f"CASE WHEN contains({sp}, '{c * 4}') THEN -0.1 ELSE 0 END" for c in "ACGT"]
    return f"1.0 / (1.0 + exp(-CAST({' + '.join(t)} AS DOUBLE)))"


DESIGN = f"""WITH g AS (SELECT gene, strand, position, spacer, pam, length(regexp_replace(spacer, '[^GC]', '', 'g')) / 20.0 AS gc, round({score_sql()}, 9) AS score FROM ({site_sql('NGG')})),
d AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, position * 2 + CASE WHEN strand = '-' THEN 1 ELSE 0 END) AS guide_rank FROM g WHERE gc BETWEEN 0.3 AND 0.8)"""


def designed(spark, sf):
    return S.design_guides(digest_sequences(spark, sf))


@query("design_guides", f"{DESIGN} SELECT gene, strand, position, spacer, pam, round(gc, 6) AS gc_content, score AS efficiency_score, guide_rank FROM d")
def _(spark, sf):
    return r6(designed(spark, sf), "gc_content")


@query("assemble_oligos", f"""{DESIGN} SELECT CAST(gene AS VARCHAR) || '_guide' || CAST(guide_rank AS VARCHAR) AS guide_id, gene, spacer AS spacer_sequence, 'CACCG' || spacer || 'GTTT' AS full_oligo, strand, position,
round(gc, 3) AS gc_content, round(score, 3) AS efficiency_score, guide_rank, 'custom' AS library FROM d WHERE guide_rank <= 4""")
def _(spark, sf):
    return S.assemble_oligos(designed(spark, sf), "CACCG", "GTTT", "custom", 4)


@query("library_summary", f"""{DESIGN}, p AS (SELECT gene, count(*) AS k FROM d GROUP BY 1), a AS (SELECT min(gc) AS g0, max(gc) AS g1, min(score) AS s0, max(score) AS s1 FROM d)
SELECT count(*) AS genes, min(k) AS min_guides, max(k) AS max_guides, round(avg(k), 6) AS mean_guides, any_value(round(g0, 6)) AS min_gc, any_value(round(g1, 6)) AS max_gc, any_value(round(s0, 6)) AS min_score, any_value(round(s1, 6)) AS max_score FROM p, a""")
def _(spark, sf):
    return r6(S.library_summary(designed(spark, sf)), "mean_guides", "min_gc", "max_gc", "min_score", "max_score")


@query("filter_guide_table", """WITH t AS (SELECT p_brand AS gene, p_name AS guide, max(p_retailprice) AS score FROM part WHERE upper(p_brand) IN ('BRAND#1', 'BRAND#12', 'BRAND#25') GROUP BY 1, 2)
SELECT gene, guide, score FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, guide) AS i FROM t) WHERE i <= 5""")
def _(spark, sf):
    part = table(spark, sf, "part")
    guides = part.select(F.col("p_brand").alias("gene"), F.col("p_name").alias("guide"), F.col("p_retailprice").alias("score"))
    genes = part.where("p_brand in ('Brand#1', 'Brand#12', 'Brand#25')").select(F.lower("p_brand").alias("gene"))
    return S.filter_guide_table(guides, genes, 5)


@query("guide_table_summary", """WITH t AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#12')) SELECT count(*) AS rows, count(DISTINCT p_brand) AS genes_found, 2 AS genes_requested FROM t""")
def _(spark, sf):
    part = table(spark, sf, "part")
    guides = part.select(F.col("p_brand").alias("gene"), F.col("p_name").alias("guide"), F.col("p_retailprice").alias("score"))
    genes = part.where("p_brand in ('Brand#1', 'Brand#12')").select(F.lower("p_brand").alias("gene"))
    return S.guide_table_summary(S.filter_guide_table(guides, genes), genes)


def exons(spark, sf):
    return digest_sequences(spark, sf).select(F.col("gene").alias("exon_id"), "seq", (F.col("gene") * 1000).alias("start"))


def eff_sql(p: str = "spacer") -> str:
    gc = f"(length(regexp_replace({p}, '[^GC]', '', 'g')) / 20.0)"
    runs = " ".join(f"- CASE WHEN contains({p}, '{c * 4}') THEN 0.08 ELSE 0 END" for c in "ACGT")
    return f"""round(CAST(greatest(0.0, least(1.0, CAST(0.5 + CASE WHEN substr({p}, 1, 1) = 'G' THEN 0.05 ELSE 0 END - CASE WHEN contains({p}, 'TTTT') THEN 0.20 WHEN contains({p}, 'TTT') THEN 0.10 ELSE 0 END
+ CASE WHEN {gc} BETWEEN 0.40 AND 0.70 THEN 0.10 WHEN {gc} < 0.20 OR {gc} > 0.80 THEN -0.15 ELSE 0 END - CASE WHEN substr({p}, 20, 1) <> 'G' THEN 0.03 ELSE 0 END {runs}
- CASE WHEN substr({p}, 9, 6) = {RC.format(f'substr({p}, 15, 6)')} THEN 0.05 ELSE 0 END AS DOUBLE))) AS DOUBLE), 3)"""


def editor_sql(target: str) -> str:
    flags = [f"CASE WHEN substr(spacer, {p}, 1) = '{target}' THEN {p} END" for p in range(4, 9)]
    return f"""SELECT *, list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL) AS pos FROM ({site_sql('NGG', False)}) WHERE own < n - 23 AND len(pos) > 0"""


@query("base_editor_scan", f"""SELECT gene AS exon_id, spacer AS sgrna_seq, pam, strand, gene * 1000 + position AS "start", gene * 1000 + position + 20 AS "end", 'C' AS target_base, array_to_string(pos, ',') AS window_positions, len(pos) AS n_editable, len(pos) - 1 AS bystander_count,
round(length(regexp_replace(spacer, '[^GC]', '', 'g')) / 20.0, 3) AS gc_content, {eff_sql()} AS efficiency_score, round(CAST((len(pos) - 1) * 0.15 AS DOUBLE), 3) AS bystander_penalty, round({eff_sql()} - round(CAST((len(pos) - 1) * 0.15 AS DOUBLE), 3), 3) AS final_score,
array_to_string(list_transform(pos, lambda p: 'pos' || p || ':C>T'), '; ') AS edit_outcomes FROM ({editor_sql('C')})""")
def _(spark, sf):
    return S.base_editor_scan(exons(spark, sf), max_bystander=99)


@query("dual_editor_guides", f"""WITH c AS ({editor_sql('C')}), k AS (SELECT * FROM c WHERE spacer IN (SELECT spacer FROM ({editor_sql('A')})))
SELECT spacer AS sgrna_seq, gene AS exon_id, gene * 1000 + position AS "start", strand FROM (SELECT *, row_number() OVER (PARTITION BY spacer ORDER BY gene, position, strand) AS i FROM k) WHERE i = 1""")
def _(spark, sf):
    return S.dual_editor_scan(exons(spark, sf)).select("sgrna_seq", "exon_id", "start", "strand")


@query("guides_near_codon", f"""SELECT gene AS exon_id, spacer AS sgrna_seq, strand, gene * 1000 + position AS "start" FROM ({editor_sql('A')}) WHERE position <= 57 + 3 + 23 AND position + 20 >= 57 - 23""")
def _(spark, sf):
    g = S.base_editor_scan(exons(spark, sf), target="A")
    return S.near_codon(g, F.col("exon_id") * 1000, 20).select("exon_id", "sgrna_seq", "strand", "start")


@query("longest_transcript_exons", """WITH t AS (SELECT p_partkey AS gene, p_size AS s, p_retailprice AS p FROM part), x AS (SELECT gene, CASE WHEN (s % 7) * 10 + 5 >= (gene % 60) THEN 't1' ELSE 't2' END AS transcript_id, s, gene AS g FROM t)
SELECT gene, transcript_id, transcript_id || 'e' || CAST(i AS VARCHAR) AS exon_id, CAST(i * 100 AS BIGINT) AS "start", CAST(i * 100 + CASE WHEN transcript_id = 't1' THEN CASE WHEN i = 1 THEN 5 ELSE (s % 7) * 10 END ELSE CASE WHEN i = 1 THEN g % 60 ELSE 0 END END AS BIGINT) AS "end" FROM x, (VALUES (1), (2)) v(i)""")
def _(spark, sf):
    g, s = F.col("p_partkey"), F.col("p_size")

    def exon(t, i, length):
        return F.struct(F.lit(f"{t}e{i}").alias("id"), F.lit(i * 100).cast("long").alias("start"), (F.lit(i * 100) + length).cast("long").alias("end"))

    t1 = F.struct(F.lit("t1").alias("id"), F.array(exon("t1", 1, F.lit(5)), exon("t1", 2, s % 7 * 10)).alias("exons"))
    t2 = F.struct(F.lit("t2").alias("id"), F.array(exon("t2", 1, g % 60), exon("t2", 2, F.lit(0))).alias("exons"))
    genes = table(spark, sf, "part").select(g.alias("gene"), F.array(t1, t2).alias("transcripts"))
    return S.longest_transcript_exons(genes)


def tm_sql(s: str, n: int) -> str:
    nn = " + ".join("CASE substr({0}, {1}, 2) {2} ELSE 12.0 END".format(s, i, " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.PAIR_TM.items())) for i in range(1, n))
    gc = f"length(regexp_replace(substr({s}, 1, {n}), '[^GC]', '', 'g'))"
    return f"CAST((4.0 * {gc} + 2.0 * ({n} - {gc}) + ({nn})) / 2.0 AS DOUBLE)"


PRIME = f"""WITH st AS ({site_sql('NGG', False)}), nr AS (SELECT gene, strand, position, spacer, abs(position + 10 - 120) AS dist, {RC.format('spacer')} AS rc FROM st WHERE abs(position + 10 - 120) <= 30 AND NOT contains(spacer, 'TTTT')),
o AS (SELECT *, list_min([{', '.join(f"{{'gap': abs({tm_sql('rc', n)} - 33.0), 'len': {n}, 'tm': {tm_sql('rc', n)}}}" for n in range(8, 18))}]) AS b, length(regexp_replace(spacer, '[^GC]', '', 'g')) / 20.0 AS gc FROM nr),
s AS (SELECT *, b.tm AS tm, substr(rc, 1, b.len) AS pbs FROM o), e AS (SELECT *, round(least(1.0, greatest(0.0, CASE WHEN gc BETWEEN 0.4 AND 0.7 THEN 1.0 ELSE 0.5 END * 0.3 + CASE WHEN abs(tm - 33.0) < 5 THEN 1.0 ELSE greatest(0.3, 1.0 - abs(tm - 33.0) / 20.0) END * 0.3
+ CASE WHEN regexp_matches(spacer, 'TTTT|AAAA') THEN -0.1 ELSE 0.2 END + least(1.0, length(regexp_replace(substr(spacer, 4, 17), '[^GC]', '', 'g')) / 17.0) * 0.2)), 9) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, position, strand) AS guide_rank FROM e), t AS (SELECT * FROM k WHERE guide_rank <= 10),
h AS (SELECT t.gene, t.strand, t.position, st.spacer AS nick, row_number() OVER (PARTITION BY t.gene, t.strand, t.position ORDER BY st.position) AS i FROM t JOIN st ON st.gene = t.gene AND st.strand <> t.strand AND abs(st.position - t.position) BETWEEN 40 AND 100)
SELECT t.gene, t.spacer, t.strand, t.position, dist AS edit_distance, pbs, round(tm, 6) AS pbs_tm, 'ACGTTGCA' AS rt_template, round(gc, 6) AS gc_content, round(score, 6) AS efficiency_score, guide_rank, nick AS nick_sgrna
FROM t LEFT JOIN h ON h.gene = t.gene AND h.strand = t.strand AND h.position = t.position AND h.i = 1"""


@query("prime_guides", PRIME)
def _(spark, sf):
    targets = digest_sequences(spark, sf).select("gene", "seq", F.lit(120).alias("edit_pos"), F.lit("ACGTTGCA").alias("edit_seq"))
    return r6(S.prime_guides(targets, top=10), "pbs_tm", "gc_content", "efficiency_score")


def letters_sql(weights: dict, s: str = "seq") -> str:
    return " + ".join(f"(length({s}) - length(replace({s}, '{c}', ''))) * {w}" for c, w in weights.items())


@query("protein_properties", f"""SELECT protein, length(seq) AS length, round(CAST({letters_sql(Q.RESIDUE_MASS)} AS DOUBLE) - (length(seq) - 1) * 18.015, 5) AS molecular_weight, round(CAST({letters_sql(Q.HYDROPATHY)} AS DOUBLE) / length(seq), 9) AS gravy,
round(CAST({' + '.join(f"(length(seq) - length(replace(seq, '{k}', ''))) / 2 * {v}" for k, v in Q.INSTABILITY.items())} AS DOUBLE) / (length(seq) - 1) * 100, 9) AS instability_index,
round(CAST({letters_sql(Q.HELIX)} AS DOUBLE) / length(seq), 9) AS helix_propensity FROM ({DIGEST_PROTEINS})""")
def _(spark, sf):
    out = S.protein_properties(digest_proteins(spark, sf)).drop("isoelectric_point")
    for c, digits in (("gravy", 9), ("instability_index", 9), ("helix_propensity", 9), ("molecular_weight", 5)):
        out = out.withColumn(c, F.round(c, digits))
    return out


@query("isoelectric_point")
def _(spark, sf):
    return S.protein_properties(digest_proteins(spark, sf)).select("protein", F.round("isoelectric_point", 6).alias("isoelectric_point"))


@query("residue_composition", f"""SELECT protein, aa, count(*) AS count, round(count(*) / 128.0, 6) AS fraction FROM (SELECT protein, unnest(string_split(seq, '')) AS aa FROM ({DIGEST_PROTEINS})) GROUP BY 1, 2""")
def _(spark, sf):
    return r6(S.residue_composition(digest_proteins(spark, sf)), "fraction")


@query("scan_motifs", f"""WITH p AS ({DIGEST_PROTEINS}), m AS (SELECT * FROM (VALUES ('NLS', 'K[KR]{{2}}|KR'), ('NES', 'L.{{2,3}}[LIVMF].{{2,3}}[LIVMF].L'), ('RGD', 'RGD'), ('CAAX', 'C[AVILM]{{2}}[AVILM]$'), ('N-glycosylation', 'N[^P][ST]'), ('SH2 binding', 'Y[A-Z]{{2}}[LIVMF]'), ('SH3 binding', 'P.{{2}}P')) v(motif, rx)),
h AS (SELECT protein, motif, regexp_extract_all(seq, rx) AS hs FROM p, m) SELECT protein, motif, unnest(hs) AS hit FROM h""")
def _(spark, sf):
    return S.scan_motifs(digest_proteins(spark, sf)).select("protein", "motif", "hit")


@query("non_targeting_controls")
def _(spark, sf):
    # One control for every ten guides' worth of parts.
    n = table(spark, sf, "part").count() // 10
    return r6(S.non_targeting_controls(spark, n), "gc_content", "efficiency_score")


@query("motif_positions")
def _(spark, sf):
    return S.scan_motifs(digest_proteins(spark, sf))


def mean_sql(weights: dict, piece: str) -> str:
    return f"CAST({letters_sql(weights, piece)} AS DOUBLE) / length({piece})"


@query("disorder", f"""WITH w AS (SELECT protein, seq, substr(seq, greatest(1, i - 10), least(length(seq), i + 9) - greatest(1, i - 10) + 1) AS piece FROM ({DIGEST_PROTEINS}) q, LATERAL (SELECT unnest(range(1, length(seq) + 1)) AS i)),
f AS (SELECT protein, CASE WHEN {mean_sql(Q.HYDROPATHY, 'piece')} < -0.5 AND abs({mean_sql(Q.RESIDUE_CHARGE, 'piece')}) > 0.3 THEN 1 ELSE 0 END AS d FROM w)
SELECT protein, count(*) AS length, CAST(sum(d) AS BIGINT) AS disordered, round(avg(d), 6) AS fraction FROM f GROUP BY protein""")
def _(spark, sf):
    return r6(S.disorder(digest_proteins(spark, sf)), "fraction")
