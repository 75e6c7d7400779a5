"""Queries for graphs, point clusterings, classifiers and residue tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lociframe.operators import classify as K
from lociframe.operators import clustering as C
from lociframe.operators import graph as G
from lociframe.operators import residues as R
from lociframe.plans.inputs import BASKET_EDGES, KIND_MATRIX, basket_edges, kind_matrix, table
from lociframe.plans.matrix_queries import r6
from lociframe.plans.registry import query
from lociframe.session import cut_lineage

E = f"WITH e AS ({BASKET_EDGES})"
SYM = "sy AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
DEG = f"{SYM}, dg AS (SELECT src AS node, count(*) AS degree FROM sy GROUP BY 1)"


@query("build_graph", f"{E} SELECT src, dst, score / 1000.0 AS score FROM e")
def _(spark, sf):
    return G.build_graph(basket_edges(spark, sf))


@query("degrees", f"{E}, {DEG} SELECT node, degree FROM dg")
def _(spark, sf):
    return G.degrees(basket_edges(spark, sf))


@query("hubs", f"{E}, {DEG}, r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS place, count(*) OVER () AS n FROM dg) SELECT node, degree, place, place <= greatest(1, floor(n * 0.1)) AS is_hub FROM r")
def _(spark, sf):
    return G.hubs(basket_edges(spark, sf))


@query("network_summary", f"{E}, {DEG} SELECT (SELECT count(*) FROM dg) AS n_nodes, count(*) AS n_edges, round(2 * count(*) / (CAST((SELECT count(*) FROM dg) AS DOUBLE) * ((SELECT count(*) FROM dg) - 1)), 9) AS density FROM e")
def _(spark, sf):
    return G.network_summary(basket_edges(spark, sf)).withColumn("density", F.round("density", 9))


@query("min_degree_subgraph", f"{E}, {DEG} SELECT src, dst, score FROM e WHERE src IN (SELECT node FROM dg WHERE degree >= 48) AND dst IN (SELECT node FROM dg WHERE degree >= 48)")
def _(spark, sf):
    return G.min_degree_subgraph(basket_edges(spark, sf), 48)


@query("clustering_coefficient", f"""{E}, {DEG}, t AS (SELECT a.src AS node, count(*) AS t FROM sy a JOIN sy b ON a.src = b.src AND a.dst < b.dst JOIN sy c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT dg.node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0 ELSE 2 * coalesce(t, 0) / CAST(degree * (degree - 1) AS DOUBLE) END, 6) AS clustering FROM dg LEFT JOIN t ON dg.node = t.node""")
def _(spark, sf):
    return r6(G.clustering_coefficient(basket_edges(spark, sf)), "clustering")


def order_links(lineitem):
    """src, dst: orders that follow each other in the lines of one part and supplier."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return lineitem.withColumn("o", F.lag("l_orderkey").over(w)).where("o is not null and o <> l_orderkey").select(
        F.col("l_orderkey").alias("src"), F.col("o").alias("dst"))


@query("connected_components")
def _(spark, sf):
    # All of lineitem, where a recursive SQL is too slow; tests/test_operators.py compares it with a search.
    return G.connected_components(order_links(table(spark, sf, "lineitem")))


def propagate_sql(rounds: int) -> str:
    parts = ["l0 AS (SELECT node, node AS label FROM dg)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS (SELECT node, label FROM (SELECT src AS node, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM sy JOIN l{i} ON l{i}.node = sy.dst GROUP BY src, label) WHERE k = 1)")
    return ", ".join(parts)


#: Rounds after which the votes have settled, or swing between two states, on the tables that the SQL is run on.
ROUNDS = 40
SETTLED = f"{propagate_sql(ROUNDS)}, lx AS (SELECT a.node, least(a.label, b.label) AS label FROM l{ROUNDS} a JOIN l{ROUNDS - 1} b ON a.node = b.node)"


@query("label_propagation", f"{E}, {DEG}, {SETTLED} SELECT node, label FROM lx")
def _(spark, sf):
    return G.label_propagation(basket_edges(spark, sf))


@query("merge_small_communities", f"""{E}, {DEG}, {SETTLED}, z AS (SELECT label, count(*) AS size FROM lx GROUP BY 1), s AS (SELECT node, lx.label, size FROM lx JOIN z ON lx.label = z.label),
b AS (SELECT sy.src AS node, s.label, row_number() OVER (PARTITION BY sy.src ORDER BY s.size DESC, s.label) AS k FROM sy JOIN s ON s.node = sy.dst WHERE sy.src IN (SELECT node FROM s WHERE size < 3))
SELECT lx.node, coalesce(b.label, lx.label) AS label FROM lx LEFT JOIN b ON b.node = lx.node AND b.k = 1""")
def _(spark, sf):
    e = basket_edges(spark, sf)
    return G.merge_small_communities(G.label_propagation(e), e)


@query("sampled_betweenness")
def _(spark, sf):
    # The edges and the sample are read many times below.
    e = cut_lineage(basket_edges(spark, sf))
    nodes = G.degrees(e).select("node")
    key = F.xxhash64(F.lit(42), "node")
    ends = cut_lineage(nodes.orderBy(key).limit(200))
    # A hundred pairs of the nodes first in a seeded order; the sample is the operator's own.
    from lociframe.functions.ordering import ordinal_rank

    placed = ordinal_rank(ends.withColumn("h", key.cast("double")), [], "h", "node", "i").drop("h")
    src = placed.where("i % 2 = 1").select(F.floor(F.col("i") / 2).alias("pair"), F.col("node").alias("source"))
    dst = placed.where("i % 2 = 0").select((F.floor(F.col("i") / 2) - 1).alias("pair"), F.col("node").alias("target"))
    return r6(G.sampled_betweenness(e, src.join(dst, "pair")), "betweenness")


@query("partner_rows", "SELECT DISTINCT p_name AS protein_a, p_brand AS protein_b, CAST(p_size AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS score_coexp, CAST(p_size AS DOUBLE) / 2 AS score_exp, CAST(0 AS DOUBLE) AS score_db, CAST(0 AS DOUBLE) AS score_textmine FROM part")
def _(spark, sf):
    s = F.col("p_size").cast("double")
    none = F.lit(None).cast("double")
    raw = table(spark, sf, "part").select(
        F.col("p_name").alias("preferredName_A"), F.lit("x").alias("stringId_A"), F.lit(None).cast("string").alias("preferredName_B"),
        F.col("p_brand").alias("stringId_B"), s.alias("score"), none.alias("escore"), (s / 2).alias("ascore"), none.alias("dscore"), none.alias("tscore"))
    return G.partner_rows(raw)


# ---- points --------------------------------------------------------------------------------------

P = "WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
PAIRS = "d AS (SELECT a.id AS ia, b.id AS ib, b.label AS lb, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.id <> b.id)"


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


KNN = f"{P}, {PAIRS}, k AS (SELECT ia AS id, ib AS neighbour, round(d, 6) AS distance, row_number() OVER (PARTITION BY ia ORDER BY round(d, 9), ib) AS place FROM d)"


@query("knn_graph", f"{KNN} SELECT * FROM k WHERE place <= 15")
def _(spark, sf):
    return r6(C.knn_graph(points(spark, sf), 15), "distance")


@query("knn_graph_descent")
def _(spark, sf):
    return r6(C.knn_graph(points(spark, sf), 15, method="descent"), "distance")


@query("shared_neighbours", f"""{KNN}, n AS (SELECT * FROM k WHERE place <= 15), l AS (SELECT id, list(neighbour) AS near FROM n GROUP BY 1)
SELECT DISTINCT least(n.id, n.neighbour) AS src, greatest(n.id, n.neighbour) AS dst, CAST(len(list_intersect(a.near, b.near)) AS INTEGER) AS weight FROM n JOIN l a ON a.id = n.id JOIN l b ON b.id = n.neighbour WHERE len(list_intersect(a.near, b.near)) > 0""")
def _(spark, sf):
    return C.shared_neighbours(C.knn_graph(points(spark, sf), 15))


@query("silhouette", f"""{P}, {PAIRS}, m AS (SELECT ia, lb, avg(d) AS m FROM d GROUP BY 1, 2), j AS (SELECT p.id, p.label, coalesce(max(m) FILTER (WHERE lb = label), 0) AS a, coalesce(min(m) FILTER (WHERE lb <> label), 0) AS b FROM p JOIN m ON p.id = m.ia GROUP BY 1, 2)
SELECT id, CAST(label AS BIGINT) AS label, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM j""")
def _(spark, sf):
    return r6(C.silhouette(points(spark, sf)), "silhouette")


EPS = 1.15
NEAR = f"""{P.replace('WITH', 'WITH RECURSIVE')}, {PAIRS}, nb AS (SELECT ia AS src, ib AS dst FROM d WHERE d <= {EPS})"""


@query("near_pairs", f"{NEAR} SELECT src, dst FROM nb WHERE src < dst")
def _(spark, sf):
    return C.near_pairs(points(spark, sf), EPS).select("src", "dst")


@query("dbscan", f"""{NEAR}, cr AS (SELECT src AS id FROM nb GROUP BY 1 HAVING count(*) + 1 >= 5), ce AS (SELECT src, dst FROM nb WHERE src IN (SELECT id FROM cr) AND dst IN (SELECT id FROM cr)),
w AS (SELECT id AS node, id AS c FROM cr UNION SELECT ce.dst, w.c FROM w JOIN ce ON ce.src = w.node AND w.c < ce.dst), lab AS (SELECT node AS id, min(c) AS cluster FROM w GROUP BY 1),
bd AS (SELECT nb.src AS id, min(lab.cluster) AS cluster FROM nb JOIN lab ON lab.id = nb.dst WHERE nb.src NOT IN (SELECT id FROM cr) GROUP BY 1)
SELECT p.id, coalesce(lab.cluster, bd.cluster, -1) AS cluster FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN bd ON bd.id = p.id""")
def _(spark, sf):
    return C.dbscan(points(spark, sf), EPS, 5)


@query("threshold_groups", f"""{NEAR}, w AS (SELECT id AS node, id AS c FROM p UNION SELECT nb.dst, w.c FROM w JOIN nb ON nb.src = w.node AND w.c < nb.dst) SELECT node AS id, min(c) AS cluster FROM w GROUP BY 1""")
def _(spark, sf):
    return C.threshold_groups(points(spark, sf), EPS)


@query("kmeans_summary")
def _(spark, sf):
    return C.kmeans_summary(points(spark, sf), 5)


@query("choose_k")
def _(spark, sf):
    return C.choose_k(points(spark, sf))


@query("consensus_matrix")
def _(spark, sf):
    return C.consensus(points(spark, sf), 4)


@query("pca_explained")
def _(spark, sf):
    return r6(C.explained_variance(points(spark, sf), 5), "ratio", "cumulative")


@query("pca_scores")
def _(spark, sf):
    s, _, _ = C.pca(points(spark, sf), 5)
    return s.select("id", F.transform("scores", lambda v: F.round(v, 6)).alias("scores"))


@query("pca_top_loadings")
def _(spark, sf):
    return r6(C.top_loadings(points(spark, sf), 5, 10), "loading")


@query("cluster_means", f"""SELECT feature, round(avg(value) FILTER (WHERE sample % 3 = 0), 6) AS "0", round(avg(value) FILTER (WHERE sample % 3 = 1), 6) AS "1", round(avg(value) FILTER (WHERE sample % 3 = 2), 6) AS "2" FROM ({KIND_MATRIX}) GROUP BY feature""")
def _(spark, sf):
    clusters = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 3).alias("cluster"))
    return r6(C.cluster_means(kind_matrix(spark, sf), clusters, [0, 1, 2]), "0", "1", "2")


# ---- classifiers ---------------------------------------------------------------------------------


def labelled(spark, sf, binary=False):
    lab = (F.col("label") % 2 if binary else F.col("label")).cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), lab.alias("label"))


ORDER = "o AS (SELECT vec_id AS id, CAST(label AS DOUBLE) AS label, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 13) AS BIGINT), vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query("train_test_split", f"WITH {ORDER} SELECT id, label, i <= greatest(1, floor(n * 0.2)) AS is_test FROM o")
def _(spark, sf):
    return K.train_test_split(labelled(spark, sf)).select("id", "label", "is_test")


@query("assign_folds", f"WITH {ORDER} SELECT id, label, CAST(i % 5 AS INTEGER) AS fold FROM o")
def _(spark, sf):
    return K.assign_folds(labelled(spark, sf)).select("id", "label", "fold")


@query("class_weights", "SELECT vec_id AS id, round((SELECT count(*) FROM embeddings) / CAST((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label) AS DOUBLE), 6) AS weight FROM embeddings")
def _(spark, sf):
    return r6(K.class_weights(labelled(spark, sf)).select("id", "weight"), "weight")


PRED = "p AS (SELECT l_returnflag AS flag, CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END AS label, CASE WHEN l_quantity < 15 THEN 0.0 WHEN l_quantity < 30 THEN 1.0 ELSE 2.0 END AS prediction, l_extendedprice AS score FROM lineitem)"


def predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    return li.select(F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label"),
                     F.when(q < 15, 0.0).when(q < 30, 1.0).otherwise(2.0).alias("prediction"),
                     F.col("l_extendedprice").alias("score"), (flag == "R").alias("is_positive"))


@query("confusion_matrix", f"WITH {PRED} SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS count FROM p GROUP BY 1, 2")
def _(spark, sf):
    return K.confusion_matrix(predictions(spark, sf))


@query("classification_report", f"""WITH {PRED}, c AS (SELECT x.c AS label, count(*) FILTER (WHERE p.label = x.c) AS t, count(*) FILTER (WHERE prediction = x.c) AS pr, count(*) FILTER (WHERE prediction = x.c AND p.label = x.c) AS h FROM p, (VALUES (0.0), (1.0), (2.0)) x(c) GROUP BY 1),
r AS (SELECT *, h / (pr + 1e-10) AS precision, h / (t + 1e-10) AS recall FROM c) SELECT CAST(label AS DOUBLE) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-10), 6) AS f1, t AS support, round((SELECT avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) FROM p), 6) AS accuracy FROM r""")
def _(spark, sf):
    return r6(K.classification_report(predictions(spark, sf)), "precision", "recall", "f1", "accuracy")


@query("roc_curve", f"""WITH {PRED}, g AS (SELECT score, count(*) AS c, count(*) FILTER (WHERE flag = 'R') AS pos FROM p GROUP BY 1), r AS (SELECT score, sum(c) OVER (ORDER BY score DESC) AS n, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(c) OVER () AS an, sum(pos) OVER () AS ap FROM g)
SELECT score AS threshold, round((n - tp) / CAST(an - ap AS DOUBLE), 6) AS fpr, round(tp / CAST(ap AS DOUBLE), 6) AS tpr FROM r""")
def _(spark, sf):
    return r6(K.roc_curve(predictions(spark, sf)), "fpr", "tpr")


@query("auc", f"""WITH {PRED}, m AS (SELECT flag, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p), a AS (SELECT count(*) FILTER (WHERE flag = 'R') AS n_pos, count(*) FILTER (WHERE flag <> 'R') AS nn, sum(r) FILTER (WHERE flag = 'R') AS rs FROM m)
SELECT round((rs - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * nn), 6) AS auc, n_pos FROM a""")
def _(spark, sf):
    return r6(K.auc(predictions(spark, sf)), "auc")


@query("cross_validate_logistic")
def _(spark, sf):
    return K.cross_validate(labelled(spark, sf), "logistic")


@query("classifier_importance")
def _(spark, sf):
    data = K.class_weights(labelled(spark, sf, True))
    model = K.build_classifier("random_forest", 16, trees=500).fit(data)
    return K.feature_importance(model, [f"f{i}" for i in range(64)], spark)


# ---- residues ------------------------------------------------------------------------------------

RES = """r AS (SELECT vec_id AS rid, CAST(label AS VARCHAR) AS structure, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, vec_id AS resseq, list_extract(['ALA', 'GLY', 'TRP', 'LYS', 'UNK'], CAST(vec_id % 5 + 1 AS BIGINT)) AS resname,
CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z, abs(CAST(embedding[4] AS DOUBLE)) * 400 AS sasa, CASE vec_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'E' ELSE 'T' END AS ss, 20.0 AS bfactor FROM embeddings)"""


def residues(spark, sf):
    v = F.col("vec_id")
    e = F.col("embedding").cast("array<double>")
    names = F.array(*[F.lit(x) for x in ("ALA", "GLY", "TRP", "LYS", "UNK")])
    return table(spark, sf, "embeddings").select(
        v.alias("rid"), F.col("label").cast("string").alias("structure"), F.when(v % 2 == 0, "A").otherwise("B").alias("chain"), v.alias("resseq"),
        F.get(names, (v % 5).cast("int")).alias("resname"), *[(e[i] * 40).alias(c) for i, c in enumerate("xyz")], (F.abs(e[3]) * 400).alias("sasa"),
        F.when(v % 3 == 0, "H").when(v % 3 == 1, "E").otherwise("T").alias("ss"), F.lit(20.0).alias("bfactor"))


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
CON = f"c AS (SELECT a.structure, a.rid AS a, b.rid AS b, sqrt({D2}) AS distance FROM r a JOIN r b ON a.structure = b.structure AND a.rid < b.rid AND {D2} <= 64)"


@query("contacts", f"WITH {RES}, {CON} SELECT structure, a, b, round(distance, 6) AS distance FROM c")
def _(spark, sf):
    return r6(R.contacts(residues(spark, sf)), "distance")


POCK = f"{RES.replace('r AS', 'r0 AS')}, r AS (SELECT * FROM r0 WHERE sasa < 25), {CON}, sy AS (SELECT a AS src, b AS dst FROM c UNION SELECT b, a FROM c), w AS (SELECT rid AS node, rid AS k FROM r UNION SELECT sy.dst, w.k FROM w JOIN sy ON sy.src = w.node AND w.k < sy.dst), pk AS (SELECT node AS rid, min(k) AS pocket FROM w GROUP BY 1)"


@query("pockets", f"WITH RECURSIVE {POCK} SELECT r.rid, pocket FROM r JOIN pk ON r.rid = pk.rid")
def _(spark, sf):
    return R.pockets(residues(spark, sf)).select("rid", "pocket")


@query("pocket_summary", f"""WITH RECURSIVE {POCK}, s AS (SELECT structure, pocket, count(*) AS n_residues, round(avg(sasa), 6) AS mean_sasa, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, round(avg(z), 6) AS centroid_z, string_agg(DISTINCT chain, ';' ORDER BY chain) AS chains,
string_agg(CAST(resseq AS VARCHAR), ';' ORDER BY resseq) AS residues FROM r JOIN pk ON r.rid = pk.rid GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY structure ORDER BY n_residues DESC, pocket) AS pocket_rank FROM s""")
def _(spark, sf):
    return r6(R.pocket_summary(R.pockets(residues(spark, sf))), "mean_sasa", "centroid_x", "centroid_y", "centroid_z")


@query("annotate_variants", f"""WITH {RES}, v AS (SELECT structure, rid AS vid, list_extract(['A', 'C', 'W', '?', 'X'], CAST(rid % 4 + 1 AS BIGINT)) AS wt_aa, resseq AS pos FROM r), pk AS (SELECT structure, x, y, z FROM r WHERE sasa < 25),
j AS (SELECT vid, wt_aa, chain, resname, sasa, ss, a.x, a.y, a.z, a.structure FROM v JOIN r a ON a.structure = v.structure AND a.resseq = v.pos), d AS (SELECT a.vid, min(sqrt({D2})) AS pd FROM j a JOIN pk b ON a.structure = b.structure GROUP BY 1),
s AS (SELECT *, CASE resname WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'TRP' THEN 'W' WHEN 'LYS' THEN 'K' ELSE 'X' END AS aa FROM j)
SELECT s.vid, chain, aa AS structure_aa, CASE WHEN wt_aa <> '?' THEN aa = wt_aa END AS wt_matches, CASE WHEN sasa < 25 THEN 'buried' WHEN sasa < 100 THEN 'intermediate' ELSE 'exposed' END AS solvent_exposure,
CASE ss WHEN 'H' THEN 'Helix' WHEN 'E' THEN 'Strand' ELSE 'Coil' END AS secondary_structure, round(pd, 6) AS pocket_distance, coalesce(pd < 8, false) AS near_pocket FROM s LEFT JOIN d ON s.vid = d.vid""")
def _(spark, sf):
    res = residues(spark, sf)
    aa = F.get(F.array(*[F.lit(x) for x in ("A", "C", "W", "?", "X")]), (F.col("rid") % 4).cast("int"))
    variants = res.select("structure", F.col("rid").alias("vid"), aa.alias("wt_aa"), F.col("resseq").alias("pos"))
    out = R.annotate_variants(variants, res, res.where("sasa < 25"))
    return r6(out.select("vid", "chain", "structure_aa", "wt_matches", "solvent_exposure", "secondary_structure", "pocket_distance", "near_pocket"), "pocket_distance")


MSA = "m AS (SELECT source AS family, doc_id AS name, substr(translate(md5(text), '0123456789abcdef', 'ACDEFGHIKLMN-PQR'), 1, 32) AS seq FROM documents)"
CONS = f"""ch AS (SELECT family, i AS col, substr(seq, i + 1, 1) AS ch, count(*) AS c FROM m, LATERAL (SELECT unnest(range(0, 32)) AS i) GROUP BY 1, 2, 3),
cs AS (SELECT family, col, CAST(sum(c) AS BIGINT) AS n, 1 - (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(21) AS s FROM ch GROUP BY 1, 2)"""


def msa(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("family"), F.col("doc_id").alias("name"),
        F.translate(F.md5("text"), "0123456789abcdef", "ACDEFGHIKLMN-PQR").alias("seq"))


@query("column_conservation", f"WITH {MSA}, {CONS} SELECT family, CAST(col AS INTEGER) AS col, n, round(s, 6) AS conservation, CAST(greatest(1, least(9, floor(round(s * 8, 9)) + 1)) AS BIGINT) AS grade FROM cs")
def _(spark, sf):
    return r6(R.column_conservation(msa(spark, sf)), "conservation")


@query("columns_to_residues", f"""WITH {MSA}, {CONS}, f AS (SELECT family, arg_min(seq, name) AS seq FROM m GROUP BY 1), p AS (SELECT family, i AS col, row_number() OVER (PARTITION BY family ORDER BY i) - 1 AS ordinal FROM f, LATERAL (SELECT unnest(range(0, 32)) AS i) WHERE substr(seq, i + 1, 1) <> '-')
SELECT p.family, 'A' AS chain, ordinal + 10 AS resseq, 'ALA' AS resname, round(s, 4) AS conservation_score FROM p JOIN cs ON cs.family = p.family AND cs.col = p.col""")
def _(spark, sf):
    m = msa(spark, sf)
    first = m.groupBy("family").agg(F.min_by("seq", "name").alias("seq"))
    res = first.select("family", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("ordinal")).select(
        "family", "ordinal", F.lit("A").alias("chain"), (F.col("ordinal") + 10).cast("long").alias("resseq"), F.lit("ALA").alias("resname"))
    return R.map_columns_to_residues(first, R.column_conservation(m), res).drop("grade")


def structure_pairs(spark, sf):
    e = F.col("embedding").cast("array<double>")
    base = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("pair"), F.lit("A").alias("chain"), F.col("vec_id").alias("resseq"),
                                                 F.lit("ALA").alias("resname"), *[(e[i] * 40).alias(c) for i, c in enumerate("xyz")], *[(e[i + 3] * 40).alias(f"{c}b") for i, c in enumerate("xyz")])
    a = base.select("pair", "chain", "resseq", "resname", "x", "y", "z")
    b = base.select("pair", "chain", "resseq", "resname", *[F.col(f"{c}b").alias(c) for c in "xyz"])
    return R.pair_residues(a, b)


@query("pair_residues", "SELECT CAST(label AS VARCHAR) AS pair, vec_id AS resseq, round(CAST(embedding[1] AS DOUBLE) * 40, 6) AS x1, round(CAST(embedding[4] AS DOUBLE) * 40, 6) AS x2 FROM embeddings")
def _(spark, sf):
    return r6(structure_pairs(spark, sf).select("pair", "resseq", "x1", "x2"), "x1", "x2")


@query("superposition")
def _(spark, sf):
    return r6(R.superposition(structure_pairs(spark, sf)).select("pair", "n", "rmsd"), "rmsd")


@query("residue_distances")
def _(spark, sf):
    p = structure_pairs(spark, sf)
    return r6(R.residue_distances(p, R.superposition(p)), "distance")


@query("filter_residues", "SELECT rid, chain, resseq FROM (SELECT vec_id AS rid, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, vec_id AS resseq, label FROM embeddings) WHERE chain = 'A' AND resseq BETWEEN 50 AND 300 AND label <> 0")
def _(spark, sf):
    atoms = residues(spark, sf).withColumn("hetflag", F.when(F.col("structure") == "0", "H_GOL").otherwise(" ")).withColumn("atom", F.lit("CA"))
    return R.filter_residues(atoms, "A", 50, 300).select("rid", "chain", "resseq")
