"""Operators against brute force and hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import annotate as A
from lociframe.operators import clustering as C
from lociframe.operators import correlate as R
from lociframe.operators import graph as G
from lociframe.operators import intervals as I
from lociframe.operators import literature as L
from lociframe.operators import matrix as M
from lociframe.operators import residues as P
from lociframe.operators import sequences as Q
from lociframe.operators import sets as S
from lociframe.operators import stats as T
from lociframe.operators import survival as V


def lm(spark, cells):
    return spark.createDataFrame(cells, "feature string, sample string, value double")


def test_differential_finds_the_shifted_features(spark):
    rnd = np.random.default_rng(7)
    samples = [f"c{i}" for i in range(6)] + [f"t{i}" for i in range(6)]
    cells = [(f"g{g}", s, float(rnd.normal(5, 1) + (4 if g < 5 and s[0] == "t" else 0))) for g in range(60) for s in samples]
    meta = spark.createDataFrame([(s, "control" if s[0] == "c" else "treatment", "b") for s in samples], "sample string, grp string, batch string")
    out = T.differential_test(lm(spark, cells), meta, "control")
    hits = {r["feature"] for r in T.significance(out, "delta", "padj", 0.05, 2.0).collect()}
    assert hits == {f"g{i}" for i in range(5)}


def test_constant_feature_has_p_one(spark):
    cells = [("g", s, 3.0) for s in "abcd"]
    meta = spark.createDataFrame([("a", "x", "b"), ("b", "x", "b"), ("c", "y", "b"), ("d", "y", "b")], "sample string, grp string, batch string")
    r = T.differential_test(lm(spark, cells), meta, "x").first()
    assert (r["t"], r["pvalue"]) == (0.0, 1.0)


def test_quantile_normalised_samples_share_one_sorted_vector(spark):
    rnd = random.Random(1)
    cells = [(f"g{g}", f"s{s}", rnd.random() * (s + 1)) for g in range(30) for s in range(4)]
    got = {}
    for r in M.quantile_normalize(lm(spark, cells)).collect():
        got.setdefault(r["sample"], []).append(round(r["value"], 9))
    assert len({tuple(sorted(v)) for v in got.values()}) == 1


def test_min_prob_jitter_is_seeded(spark):
    cells = [("a", "s", 1.0), ("b", "s", 3.0), ("c", "s", None)]
    a = M.impute_min_prob(lm(spark, cells), 0.1, 1).where("feature = 'c'").first()["value"]
    b = M.impute_min_prob(lm(spark, cells), 0.1, 1).where("feature = 'c'").first()["value"]
    base = M.impute_min_prob(lm(spark, cells)).where("feature = 'c'").first()["value"]
    assert a == b and a != base and base == pytest.approx(2 - 1.8 * math.sqrt(2))


def test_overlap_join_meets_each_pair_once(spark):
    rnd = random.Random(2)
    def make(n, tag):
        return [("chr1" if rnd.random() < 0.8 else "chr2", s, s + rnd.choice([1, 5, 60, 1000, 20000]), f"{tag}{i}") for i in range(n) for s in [rnd.randrange(0, 30000)]]
    a, b = make(80, "a"), make(80, "b")
    schema = "chrom string, start long, end long, name string"
    got = sorted((r["a"]["name"], r["b"]["name"]) for r in I.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_regions_split_at_gaps(spark):
    sites = [("c", p, 0.5, 0.01) for p in (1, 500, 900, 5000, 5100, 9000, 9500, 9900, 10000)]
    rows = I.build_regions(spark.createDataFrame(sites, "chrom string, pos long, delta double, fdr double"), 1000).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n_sites"]) for r in rows] == [(1, 900, 3), (9000, 10000, 4)]


def test_kaplan_meier_and_logrank_expectation(spark):
    data = [(1, 1, "a"), (2, 0, "a"), (3, 1, "a"), (4, 1, "a"), (1, 1, "b"), (2, 1, "b"), (2, 1, "b"), (5, 0, "b")]
    df = spark.createDataFrame([(float(t), e, g) for t, e, g in data], "time double, event int, grp string")
    km = {(r["grp"], r["time"]): r["survival"] for r in V.kaplan_meier(df).collect()}
    assert km[("a", 1.0)] == pytest.approx(0.75) and km[("a", 3.0)] == pytest.approx(0.375) and km[("a", 4.0)] == 0.0
    assert km[("b", 2.0)] == pytest.approx(0.25)
    terms = V.time_counts_by_group(df, [], "grp").agg(
        F.sum("d_g").alias("o"), F.sum(F.col("d_t") * F.col("n_g") / F.col("n_t")).alias("e")).first()
    assert terms["o"] == pytest.approx(terms["e"])


def cox_numpy(t, e, x):
    beta = np.zeros(x.shape[1])
    for _ in range(20):
        g, h = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            w = np.exp(x[risk] @ beta)
            w /= w.sum()
            mu = w @ x[risk]
            g += x[i] - mu
            h += (x[risk] - mu).T @ ((x[risk] - mu) * w[:, None])
        beta = beta + np.linalg.solve(h, g)
    return beta, np.linalg.inv(h)


def test_cox_matches_direct_newton(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(120, 2))
    t = np.round(rnd.exponential(np.exp(-0.7 * x[:, 0])) * 50) + 1
    e = (rnd.random(120) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "time double, event int, u double, w double")
    beta, cov = V.cox_fit(df, ["u", "w"])
    want, wcov = cox_numpy(t, e, x)
    assert beta == pytest.approx(want, abs=1e-5) and np.diag(cov) == pytest.approx(np.diag(wcov), rel=1e-4)


def test_column_moments_over_several_blocks(spark):
    rnd = random.Random(9)
    cells = [(f"g{g}", f"s{s}", rnd.random()) for g in range(20) for s in range(11) if rnd.random() < 0.8]
    from lociframe.operators.blocks import column_moments
    got = {(r["a"], r["b"]): (r["n"], r["sxy"]) for r in column_moments(lm(spark, cells), block=4, salts=3).collect()}
    by = {(g, s): v for g, s, v in cells}
    seen = set()
    for (a, b), (n, sxy) in got.items():
        both = [g for g in {c[0] for c in cells} if (g, a) in by and (g, b) in by]
        assert n == len(both) and sxy == pytest.approx(sum(by[g, a] * by[g, b] for g in both))
        seen.add(frozenset((a, b)))
    assert len(seen) == len(got) == 11 * 10 // 2


def test_set_overlap_and_unique(spark):
    sets = [("A", i) for i in range(10)] + [("B", i) for i in range(5, 20)] + [("C", 100)]
    df = spark.createDataFrame(sets, "set_id string, item int")
    rows = {(r["a"], r["b"]): r for r in S.pairwise_overlap(df, 200).collect()}
    assert rows["A", "B"]["intersection"] == 5 and rows["A", "B"]["jaccard"] == pytest.approx(0.25)
    assert rows["A", "C"]["intersection"] == 0 and rows["A", "C"]["pvalue"] == 1.0
    assert S.unique_items(df).where("set_id = 'A'").count() == 5
    j = {(r["a"], r["b"]): r["jaccard"] for r in S.jaccard_matrix(df).collect()}
    assert all(j[a, b] == j[b, a] for a, b in j) and j["A", "A"] == 1.0


def test_components_propagation_and_betweenness(spark):
    path = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102)]
    e = spark.createDataFrame(path, "src long, dst long")
    comp = {r["node"]: r["component"] for r in G.connected_components(e).collect()}
    assert {comp[i] for i in range(31)} == {0} and comp[102] == 100
    cc = {r["node"]: r["clustering"] for r in G.clustering_coefficient(e).collect()}
    assert cc[100] == 1.0 and cc[5] == 0.0
    pairs = spark.createDataFrame([(1, 0, 4), (2, 100, 102)], "pair int, source long, target long")
    b = {r["node"]: r["betweenness"] for r in G.sampled_betweenness(e, pairs).collect()}
    assert b == {1: 0.5, 2: 0.5, 3: 0.5}


def test_knn_and_dbscan_over_several_tiles(spark):
    rnd = np.random.default_rng(3)
    pts = np.vstack([rnd.normal(c, 0.1, size=(20, 2)) for c in ((0, 0), (5, 5))] + [np.array([[50.0, 50.0]])])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, vec array<double>")
    knn = {}
    for r in C.knn_graph(df, 3, block=8).collect():
        knn.setdefault(r["id"], set()).add(r["neighbour"])
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    for i in range(len(pts)):
        assert knn[i] == {int(j) for j in np.argsort(d[i])[1:4]}
    lab = {r["id"]: r["cluster"] for r in C.dbscan(df, 1.0, 4).collect()}
    assert {lab[i] for i in range(20)} == {0} and {lab[i] for i in range(20, 40)} == {20} and lab[40] == -1
    scores, load, ratio = C.pca(df, 2)
    centred = pts - pts.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert ratio == pytest.approx(s**2 / (s**2).sum())
    got = np.array([r["scores"] for r in scores.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u * s), abs=1e-6)


def test_superposition_undoes_a_rotation(spark):
    rnd = np.random.default_rng(8)
    a = rnd.normal(size=(12, 3)) * 10
    c, s = math.cos(0.7), math.sin(0.7)
    b = a @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + np.array([3.0, -2.0, 9.0])
    mk = lambda m: spark.createDataFrame([("p", "A", i, "ALA", *map(float, r)) for i, r in enumerate(m)], "pair string, chain string, resseq int, resname string, x double, y double, z double")
    pairs = P.pair_residues(mk(a), mk(b))
    moves = P.superposition(pairs)
    assert moves.first()["rmsd"] == pytest.approx(0.0, abs=1e-6)
    assert P.residue_distances(pairs, moves).agg(F.max("distance")).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_site_scan_across_piece_borders(spark):
    rnd = random.Random(6)
    seq = "".join(rnd.choice("ACGT") for _ in range(2500))
    got = sorted((r["strand"], r["position"], r["spacer"]) for r in Q.find_sites(spark.createDataFrame([("g", seq)], "gene string, seq string"), clean=False).collect())
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = [("+", i - 20, seq[i - 20:i]) for i in range(20, len(seq) - 2) if seq[i + 1:i + 3] == "GG"]
    want += [("-", len(seq) - i, rc[i - 20:i]) for i in range(20, len(seq) - 2) if rc[i + 1:i + 3] == "GG"]
    assert got == sorted(want)


def test_controls_pass_the_guide_filters(spark):
    rows = Q.non_targeting_controls(spark, 40).collect()
    assert len(rows) == 40 and all(0.3 <= r["gc_content"] <= 0.8 and "TTTT" not in r["spacer"] for r in rows)
    assert rows == Q.non_targeting_controls(spark, 40).collect()


def test_motif_positions_and_isoelectric_point(spark):
    df = spark.createDataFrame([("p", "MKKRRGDANSTPAAP")], "protein string, seq string")
    hits = {(r["motif"], r["start"], r["hit"]) for r in Q.scan_motifs(df).collect()}
    assert {("NLS", 1, "KKR"), ("RGD", 4, "RGD"), ("N-glycosylation", 8, "NST"), ("SH3 binding", 11, "PAAP")} <= hits
    assert 2.0 <= Q.protein_properties(df).first()["isoelectric_point"] <= 12.0


def test_pair_counts_split_a_large_group(spark):
    rows = [("big", i) for i in range(50)] + [("small", i) for i in (1, 2, 3)]
    got = {(r["a"], r["b"]): r["count"] for r in L.pair_counts(spark.createDataFrame(rows, "g string, m long"), "g", "m", tile=8).collect()}
    assert len(got) == 50 * 49 // 2 and got[1, 2] == 2 and got[1, 40] == 1
    assert L.pair_counts(spark.createDataFrame(rows, "g string, m long"), "g", "m", 2).count() == 3


def test_diversify_is_greedy_and_bounded(spark):
    rows = [("q", f"a{i}", 10.0 - i, [f"d{j}" for j in range(i // 2, i // 2 + 4)]) for i in range(8)]
    df = spark.createDataFrame(rows, "query string, author_id string, final_score double, dois array<string>")
    kept, sets = [], []
    for _, a, _, d in rows:
        if all(len(set(d) & s) <= 2 for s in sets):
            kept.append(a)
            sets.append(set(d))
    assert [r["author_id"] for r in L.diversify(df, 3).orderBy("place").collect()] == kept[:3]
    many = [(f"q{i % 2}", f"a{i:04d}", float(i * 37 % 101), [f"d{(i * 7 + j * j) % 90}" for j in range(6)]) for i in range(300)]
    got = {}
    for r in L.diversify(spark.createDataFrame(many, "query string, author_id string, final_score double, dois array<string>"), 1000).collect():
        got.setdefault(r["query"], []).append((r["place"], r["author_id"]))
    for q in ("q0", "q1"):
        kept, sets = [], []
        for _, a, _, d in sorted((r for r in many if r[0] == q), key=lambda r: (-r[2], r[1])):
            if all(len(set(d) & s) <= 2 for s in sets):
                kept.append(a)
                sets.append(set(d))
        assert [a for _, a in sorted(got[q])] == kept and len(kept) < 150


def test_aa_change(spark):
    df = spark.createDataFrame([("p.V600E",), ("p.r12*",), ("c.1A>G",), ("p.K5",)], "t string").select("t", A.aa_change(F.col("t")).alias("h"))
    got = {r["t"]: r["h"] and (r["h"]["aa_change"], r["h"]["position"]) for r in df.collect()}
    assert got == {"p.V600E": ("V600E", 600), "p.r12*": ("R12*", 12), "c.1A>G": None, "p.K5": ("K5?", 5)}


def test_loess_matches_direct_fit(spark):
    rnd = np.random.default_rng(2)
    x, y = rnd.integers(0, 40, 150).astype(float), rnd.normal(size=150)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = [r["fit"] for r in R.loess(df, "x", "y", 0.4, 7).orderBy("i").collect()]
    k = int(150 * 0.4)
    for g, at in zip(got, np.linspace(x.min(), x.max(), 7)):
        d = np.abs(x - at)
        h = np.sort(d)[k - 1]
        w = np.where(d <= h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
        a = np.column_stack([np.ones(150), x - at])
        assert g == pytest.approx(np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * y))[0], abs=1e-8)


def test_connected_components_of_all_lines(spark, tmp_path):
    """The query over the whole table equals brute force, also for lines of small quantities."""
    from lociframe.plans import QUERIES

    lines = [(k, k * 7 % 23 if k % 3 else k % 5, k % 2, 1, float(k % 50)) for k in range(90)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["node"]: r["component"] for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()}
    label = {k: k for k, *_ in lines}
    groups = {}
    for k, part, supplier, *_ in lines:
        groups.setdefault((part, supplier), []).append(k)
    for _ in lines:
        for own in groups.values():
            least = min(label[k] for k in own)
            label.update({k: least for k in own})
    assert got == {k: label[k] for own in groups.values() if len(own) > 1 for k in own}
