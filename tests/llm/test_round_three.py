"""Operators 11 to 13 against brute force, on small tables and held-out findings; repeated ids, seeds and hot slots."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociframe.llm import hadamard_clusters as clusters
from lociframe.llm import bagminhash, html_text, infill, licenses, queries, secrets_cnn, slots, spaced_seeds

# ---- 11


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centers)]
    return [(i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centers[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (5, 64))
    return [(i, [float(x) for x in np.float32(base[i % 5] + rng.normal(0, 0.1, 64))]) for i in range(n)]


def test_transform():
    x = np.arange(128).reshape(2, 64) % 11 - 5
    h = np.array([[1]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    assert (clusters.walsh_hadamard(x) == x @ h.T).all()
    changes = (np.diff(h[clusters.ORDER], axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))


def test_nearest_is_exact_and_saves_work():
    rng = np.random.default_rng(2)
    centers = rng.integers(-300, 300, (40, 64))
    x = centers[rng.integers(0, 40, 500)] + rng.integers(-30, 30, (500, 64))
    x[:40], centers[7] = centers, centers[3]  # ties go to the smaller number
    number, distance, work = clusters.nearest(x, centers)
    every = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert work < every.size * 64 / 3
    far = np.full((3, 64), 256 * clusters.LARGEST)
    assert (clusters.nearest(far, -far[:1])[1] == 64 * (2 * 256 * clusters.LARGEST) ** 2).all()


def test_clusters(spark):
    rows = vectors(120)
    rows += [rows[3], rows[3], (None, rows[4][1]), (200, None), (201, [1.0] * 63), (202, [1.0] * 63 + [None]), (203, [1.0] * 63 + [float("nan")]), (204, [float("inf")] * 64), (205, [0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    for k in (7, 400):
        got = clusters.cluster(df, k=k, rounds=3).collect()
        assert sorted([(r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got], key=str) == sorted(brute_clusters(rows, k, 3), key=str)
        assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
        assert all(r["cluster_inertia"] == sum(x["distance"] for x in got if x["cluster"] == r["cluster"]) for r in got)
    assert clusters.cluster(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


# ---- 12

PIECES = ["abc", "Zz", "é", "ß", " ", "\n", "\t", "7", "<", ">", "<P", "P>", "<S", "M>", "漢字", "😀", "a" * 50, "", "\0", "<M"]


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(f"<{x}>" in text for x in "PSM") or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def infill_rows():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, "one <P> mark"), (1003, "<S>"), (1004, "word " * 100_000), (3, texts[3]), (None, "no id, all the same"), (-5, "minus")]


@pytest.mark.parametrize("window,size", [(infill.WINDOW, infill.SLICE), (7, 100)])
def test_infill_by_brute_force(window, size, monkeypatch):
    """Windows of seven bytes cut units, characters and marks; slices of a hundred bytes cut batches."""
    monkeypatch.setattr(infill, "WINDOW", window)
    for at in range(0, 400, 50):
        rows = [r for r in infill_rows() if r[0] != 1004][at:at + 50]
        texts = pa.array([t or "" for _, t in rows], pa.string())
        want = [brute_infill(*r) for r in rows]
        for lo, hi in infill.slices(texts, size):
            digests = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i, _ in rows[lo:hi]]
            h = np.array([[int(d[8 * k:8 * k + 8], 16) for k in range(4)] for d in digests])
            got = infill.transform(*infill._bytes(texts.slice(lo, hi - lo)), h)
            back = infill.restore(got["data"], got["offsets"], got["form"])
            assert infill._texts(got["data"], got["offsets"]).to_pylist() == [w[5] for w in want[lo:hi]]
            assert infill._texts(*back).to_pylist() == [w[6] for w in want[lo:hi]]
            assert got["n"].tolist() == [w[1] for w in want[lo:hi]]


def test_infill(spark):
    rows = infill_rows()
    df = spark.createDataFrame([(*r, 9, "f") for r in rows], "doc_id long, text string, n int, form string")
    got = infill.infill(df, restored=True)
    by = lambda rows: sorted(map(tuple, rows), key=str)
    assert by(got.collect()) == by(brute_infill(*r) for r in rows)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    again = infill.restore_texts(infill.infill(df))
    assert by(again.collect()) == by(got.collect())
    nulls = infill.restore_texts(spark.createDataFrame([("x", "plain"), (None, "psm"), ("y", None)], "output string, form string"))
    assert [r["restored"] for r in nulls.collect()] == ["x", None, None]
    assert infill.infill(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="three marks"):
        infill.restore_texts(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")).collect()


# ---- 13

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
MIX = ["password", "PassWord", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc12345", "x", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "ſecret", "toKen", "\n", "a.b", "é"]


def brute_base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets_cnn.BASE_KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(MIX) for _ in range(rng.randint(0, 14)))
        assert secrets_cnn.base_spans(text) == brute_base(text), text


def test_gradients():
    rows = secrets_cnn.findings(12, 5)
    arrays, labels = secrets_cnn.windows_of(rows).arrays(), np.array([r[4] for r in rows], float)
    w = secrets_cnn.new_weights(3, np.float64)
    w["shift"] += 0.05
    _, grad = secrets_cnn.gradients(w, labels, *arrays)
    rng = np.random.default_rng(0)
    for name in w:
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w[name].shape)
            if name == "chars":
                at = (int(rng.choice(np.unique(arrays[0]))), at[1])
            kept = w[name][at]
            w[name][at] = kept + 1e-6
            up = secrets_cnn.gradients(w, labels, *arrays)[0]
            w[name][at] = kept - 1e-6
            down = secrets_cnn.gradients(w, labels, *arrays)[0]
            w[name][at] = kept
            assert abs((up - down) / 2e-6 - grad[name][at]) < 1e-5, name


def test_windows_do_not_mix(monkeypatch):
    """A window's score is the same alone, among others, and folded in pieces of a few characters."""
    model, rows = secrets_cnn.train(), secrets_cnn.findings(60, 21)
    together = secrets_cnn.probabilities(model, secrets_cnn.windows_of(rows))
    alone = [secrets_cnn.probabilities(model, secrets_cnn.windows_of([r]))[0] for r in rows]
    assert np.allclose(together, alone, atol=1e-5)
    monkeypatch.setattr(secrets_cnn, "FLAT", 50)
    assert np.allclose(together, secrets_cnn.probabilities(model, secrets_cnn.windows_of(rows)), atol=1e-5)


def test_held_out_findings():
    model, rows = secrets_cnn.train(), secrets_cnn.findings(3000, 77)
    p = secrets_cnn.probabilities(model, secrets_cnn.windows_of(rows))
    labels, forms = np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
    found = p >= np.array(model["thresholds"])[forms]
    for form in range(len(secrets_cnn.FORMS)):
        assert found[(forms == form) & (labels == 1)].mean() > 0.96
    assert found[labels == 0].mean() < 0.02
    for lo, hi in ((0.0, 0.1), (0.9, 1.01)):  # calibration
        part = (p >= lo) & (p < hi)
        assert abs(p[part].mean() - labels[part].mean()) < 0.04


def test_thresholds_and_overlaps():
    assert secrets_cnn.recall_threshold(np.array([0.9, 0.2, 0.3, 0.4]), np.array([0, 1, 1, 1]), 0.6) == 0.3
    assert secrets_cnn.recall_threshold(np.array([0.9]), np.array([0]), 0.9) == 0.5
    got = secrets_cnn.chosen([("hex", 10, 50), ("assign", 4, 52)], [(0, 4, 3, 0.9), (3, 6, 3, 0.99), (51, 60, 2, 0.8), (52, 60, 2, 0.8), (55, 61, 3, 0.9), (70, 80, 3, 0.1)], [0.5] * 4)
    assert got == [("bare", 0, 4, 0.9), ("assign", 4, 52, None), ("hex", 10, 50, None), ("bare", 55, 61, 0.9)]


def test_secrets(spark):
    key = "ghp_" + "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5"
    texts = [f"word {key} and more", "db url postgres://joe:s3cr3tPass!9@db.local/x", "password: Tr0ub4dor&3xyz", None, "", "plain words only, nothing here", "see www.example-site12.com/page-3.html", "x" * 300_000 + f" token = {key}",
             "deadbeef" * 5, 'api_key = "your_key_goes_here"']
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[0])]], "doc_id long, text string, start int, base string")
    got = secrets_cnn.find_secrets(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12
    found = {i: [(s["kind"], texts[i][s["start"]:s["end"]]) for s in by[i]["spans"]] for i in range(10)}
    assert found[0] == [("bare", key)] and ("login", "s3cr3tPass!9") in found[1] and found[3] == found[4] == found[5] == found[6] == []
    assert found[7] == [("assign", f"token = {key}")] and found[8] == [("hex", "deadbeef" * 5)]
    assert found[2] == [("assign", "password: Tr0ub4dor")]
    assert [tuple(s)[:3] for s in by[0]["spans"]] == [tuple(s)[:3] for s in by[None]["spans"]]
    assert all({tuple(s) for s in r["base"]} <= {tuple(s)[:3] for s in r["spans"]} for r in got)
    assert secrets_cnn.find_secrets(df.limit(0)).count() == 0


def test_queries(spark, tmp_path):
    spark.createDataFrame([(1, "token = abcdefgh1 deadbeef"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_secrets_cnn"](spark, str(tmp_path)).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"], got[1]["spans"]) == (1, 0, 0, "assign:0:17")
    assert got[1]["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest() and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["spans"] == ""
    out = queries.QUERIES["op12_displacement_infill"](spark, str(tmp_path)).withColumn("same", F.col("restored_sha256").isNotNull()).collect()
    assert all(r["same"] for r in out) and len(out) == 2


# ---- repeated ids in near-duplicates


def test_an_id_with_two_texts(spark):
    """Both texts of id 1 have links of their own, whatever the order of rows, and join all four in one class."""
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words), " ".join(f"x{i}" for i in range(120))
    near = lambda t, k: t.replace(t.split()[60], f"new{k}")
    rows = [(1, a), (1, b), (2, near(a, 2)), (3, near(b, 3)), (4, "quite different words stand in here alone"), (1, None), (5, None), (2, near(a, 2))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted((r["doc_id"], r["class_id"], r["n_links"] > 0) for r in bagminhash.near_duplicates(df).collect())
        assert [(i, c) for i, c, _ in got] == [(1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
        assert [x for i, _, x in got if i in (2, 3)] == [True] * 3
        kept = sorted(r["doc_id"] for r in bagminhash.keep_one(df).collect())
        assert kept == [1, 4, 5]


# ---- spaced seeds


def test_masks_leave_a_seed_for_every_allowed_set():
    """Every set of places that may be replaced, in a stretch of every length, leaves a mask that ignores it."""
    for size in range(1, spaced_seeds.MIN_OVERLAP + 1):
        wrong = size - int(np.ceil(round(size * spaced_seeds.MIN_SHARE, 9)))
        masks = list(spaced_seeds.MASKS) if size >= spaced_seeds.SPAN else spaced_seeds.short_masks(size)
        seen = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(size - len(m) + 1)]
        for places in itertools.combinations(range(size), wrong):
            assert any(not s & set(places) for s in seen), (size, places)


def brute_items(text, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    doc, out = cut(text), set()
    for name, item in items:
        words = cut(item)
        stretch = min(spaced_seeds.MIN_OVERLAP, len(words))
        need = int(np.ceil(round(stretch * spaced_seeds.MIN_SHARE, 9)))
        for shift in range(-len(words), len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(words)]
            inside = [0 <= i + shift < len(doc) for i in range(len(words))]
            if stretch and any(all(inside[k:k + stretch]) and sum(same[k:k + stretch]) >= need for k in range(len(words) - stretch + 1)):
                out.add(name)
                break
    return out


def test_decontamination_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(14)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in range(1, 22)] + [(100, "same " * 40), (101, None), (102, "")]
    texts = []
    for i in range(150):
        words = [rng.choice([*vocabulary, "z1", "z2", "z3"]) for _ in range(rng.randint(0, 30))]
        n, item = items[rng.randrange(3, 21)]
        piece = item.split()
        for k in rng.sample(range(n), rng.randint(0, 3) if n > 3 else 0):
            piece[k] = "other"
        texts.append((i, " ".join([*words, *piece, *words[::-1]])))
    texts += [(500, "same " * 12), (501, "same " * 300 + "end"), (502, "x " + "same " * 11 + "y z"), (503, None), (504, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["items"].split(","))) for r in spaced_seeds.decontamination_report(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: {str(x) for x in brute_items(t, items)} for i, t in texts}
    assert got == want and sum("100" in w for w in want.values()) >= 1


def test_null_item_and_repeated_words(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "nothing of it"), (3, "la " * 20_000)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three four five six"), (7, "la " * 400)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["items"]) for r in spaced_seeds.decontamination_report(docs, items).collect()}
    assert got == {1: (True, 1, ""), 2: (False, 0, ""), 3: (True, 1, "7")}
    found = spaced_seeds.hits(docs, items)
    assert found.count() < 2000  # not one for each place of the text and of the item


# ---- slots


def test_a_key_with_most_rows(spark):
    """Twenty thousand rows of one null key lie in one slot, but in many parts of it; places have no gaps."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    out = slots.assign(df, slots.initial_map(spark, 8))
    got = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("top")).collect()
    assert all(r["n"] == r["d"] == r["top"] + 1 for r in got)
    plan = out._jdf.queryExecution().toString()
    assert "part" in plan
    largest = df.filter("doc_id is null").select(F.pmod(F.xxhash64(F.crc32(F.encode("text", "UTF-8")), (F.octet_length("text") + 1).cast("long")), F.lit(slots.PARTS)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert largest < 3 * 18_000 / slots.PARTS


def test_rebalanced_documents(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 8 == 0, 900).otherwise(30).cast("int")).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["virtual_slots_rebalanced"](spark, str(tmp_path))
    load = lambda c: [r["b"] for r in rows.groupBy(c).agg(F.sum("size").alias("b")).collect()]
    before, after = load("first_shard"), load("shard")
    assert rows.count() == 3000 and sum(before) == sum(after) and max(after) - min(after) < max(before) - min(before)


# ---- pages and licences


def test_article_text_is_kept():
    """Inside an article: a history of promotions and a list of two references stay, adverts, comments and menus go."""
    page = """<body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>First paragraph, with enough words, to count as text here.</p>
      <div class="promotion-history"><p>The promotion history of the officer, told at some length, is here.</p></div>
      <ul><li><a href=1>A reference</a></li><li><a href=2>Another one</a></li></ul>
      <div class="ad">Buy this</div><div class="ad-slot"><p>Buy that, too, at once, and more of it.</p></div><div class="social-share"><a href=f>Post it</a> <a href=g>Send it</a></div>
      <section id="post-comments"><p>A reader comments on this, at length, and on that.</p></section><p>no\u00a0break &nbsp; here,   it stays.</p><p>&nbsp;</p></article>
      <ul><li><a href=3>Elsewhere</a></li><li><a href=4>Others</a></li></ul></body>"""
    assert html_text.extract(page).split("\n\n") == [
        "Title of it", "First paragraph, with enough words, to count as text here.", "The promotion history of the officer, told at some length, is here.",
        "A reference", "Another one", "no\u00a0break \u00a0 here, it stays."]


def test_link_lists_within_lists_all_go():
    inner = "<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>"
    page = f"<body><div><div><div>{inner}x</div>{inner}</div><div>{inner}</div></div><div><p>The text of the page, which is long enough to be one.</p></div></body>"
    assert html_text.extract(page) == "The text of the page, which is long enough to be one."


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_text.main_text(empty).count() == 0


def test_written_out_licence_names():
    scanner = licenses.Scanner()
    for text, label in {
        "GPLv3": "gpl", "GNU GPL version 2": "gpl", "BSD-3-Clause": "bsd", "3-clause BSD": "bsd", "LGPL-2.1+": "lgpl", "AGPLv3 or later": "agpl", "Apache-2.0": "apache", "CC BY-SA 4.0": "cc-by-sa",
        "CC0 1.0 Universal": "cc0", "MPL-2.0": "mpl", "SPDX: MIT": "mit", "SPDX-License-Identifier: EPL-2.0": "epl", "MIT licensed": "mit", "WTFPL": "wtfpl", "Boost Software License 1.0": "boost",
        "provided as is without warranty of any kind": "warranty", "In no event shall the authors be liable for any": "liability", "Redistribution and use in source and binary forms": "redistribution",
        "you must give appropriate credit": "attribution", "for non-commercial use only": "non-commercial",
    }.items():
        assert label in scanner.scan(f"some words {text} and more")[5].split(","), text
    for clean in ("er kam mit dem Zug", "the apache tribe", "a warranty claim", "they redistribute wealth", "boost the signal", "it was a patent lie", "cc me by mail"):
        assert scanner.scan(clean)[5] == "", clean
    written = len(licenses._SHORT) + len(licenses._TEXTS) + len(licenses._FAMILIES)
    assert written > 160


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["cc", "by", "CC BY", "cc-by", "general", "public", "License", "General Public License", "all rights reserved", "ALL RIGHTS", "reserved", "x", "é", ".", "1", "gpl", "cc by nc"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (None, texts[0]), (3, texts[3])], "doc_id long, text string")
    got = licenses.license_scan(df).collect()
    by = {i: t for i, t in [*enumerate(texts), (900, None), (None, texts[0])]}
    assert len(got) == 303 and all((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(by[r["doc_id"]]) for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.license_scan(df.limit(0)).count() == 0
