"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm import bagminhash, byte_bpe, html_text, licenses, pseudo_likelihood, quality, rollup, semi_crf, slots, spaced_seeds

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id int, node int, ids int, kept string, class_id int, words int"
STORY = " ".join(f"word{i} and story{i * 7 % 31}" for i in range(60))
NEAR = STORY.replace("word30", "changed").replace("word3 ", "w3 ")
PASSAGE = " ".join(f"bench{i}" for i in range(30))
OTHER = " ".join(f"other{i} thing" for i in range(40))


def rows():
    texts = [STORY, STORY, NEAR, None, "", "one two three", OTHER + " " + PASSAGE.replace("bench7", "x") + " end", OTHER, "mail a.b@c.org or +1 (826) 555-4081",
             "long " * 50_000, "  \n ", "one two three"]
    out = [(i, t, "en" if i % 3 else None, "s", len(t or ""), 1, 2, 3, "x", 5, 6) for i, t in enumerate(texts)]
    return [*out, out[0], (None, OTHER + " null id", None, None, None, 1, 2, 3, "x", 5, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (3, "", 0), (4, "far away from all of this", 0)], "item_id long, text string, doc_id int")


def test_quality(docs, empty):
    got = quality.quality_rules(docs).collect()
    assert len(got) == 14
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_words"] == by[4]["n_words"] == 0 and not by[3]["kept"]
    assert by[9]["base_failed"] and by[9]["n_repeat_words"] == 50_000 and by[0]["n_words"] == 180
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_rules(empty).count() == 0 and quality.keep(empty).count() == 0


def test_quality_of_rare_languages(spark):
    """Clean texts of languages far below 1 % of all words are kept, and other languages' rows change no verdict."""
    rng = np.random.default_rng(3)
    letters = {"en": "abcdefghijklmnop", "ru": "абвгдежзиклмнопр", "zh": "天地人你我他上下山水火木金土日月"}
    text = lambda lang, n: " ".join("".join(rng.choice([*letters[lang]], 4)) for _ in range(n))
    few = [(i, text("ru" if i % 2 else "zh", 100), "ru" if i % 2 else "zh") for i in range(60)] + [(100, text("ru", 100), "tt"), (101, text("zh", 100), None), (102, "#&7 " * 20 + text("ru", 20), "ru")]
    many = [(i, text("en", 20_000), "en") for i in range(1000, 1040)]
    alone, all_rows = (spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (few, few + many))
    got = {r["doc_id"]: r for r in quality.quality_rules(all_rows).collect()}
    assert all(got[i]["kept"] and got[i]["char_distance"] < 0.1 and got[i]["word_distance"] is not None for i in range(60))
    assert all(got[i]["kept"] and got[i]["char_distance"] is None and got[i]["word_distance"] is None for i in (100, 101))
    assert not got[102]["kept"] and got[102]["char_distance"] > 0.22
    assert {i: got[i] for i, *_ in few} == {r["doc_id"]: r for r in quality.quality_rules(alone).collect()}
    assert {r["doc_id"] for r in quality.keep(all_rows).collect()} == {i for i, r in got.items() if r["kept"]}


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[5] == got[11] == 5 and got[3] == 3 and got[4] == 4 and got[10] == 10
    assert got[6] == 6  # shares the most of its words with 7, but less than the limit
    assert sum(k >= 1 << 62 for k in got) == 1
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert bagminhash.near_duplicates(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


def test_near_duplicate_family(spark):
    """Copies of one text, each with words of its own: classes equal those of all pairs."""
    base = [f"t{i}" for i in range(200)]
    texts = {}
    for i in range(60):
        words = list(base)
        for k in range(i % 4):
            words[(i * 37 + k * 53) % 200] = f"own{i}x{k}"
        texts[i] = " ".join(words)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    bags = {i: {tuple(t.split()[k:k + 5]) for k in range(196)} for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in range(a):
            if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in texts}


@pytest.mark.parametrize("tile", [bagminhash.TILE, 7])
def test_every_pair_of_a_bucket(spark, monkeypatch, tile):
    """Fifteen similar pairs of texts that share one band only, and three that share another: every pair is met."""
    monkeypatch.setattr(bagminhash, "TILE", tile)
    texts, bands = {}, {}
    for i in range(36):
        words = [f"f{i // 2}w{k}" for k in range(100)]
        words[50] += "ab"[i % 2]
        texts[i] = " ".join(words)
        bands[i] = [7 if i < 30 else -i - 1, -i - 1 if i < 30 else 8]
    nodes = spark.createDataFrame([(i, 96, bands[i]) for i in texts], "node long, n long, bands array<long>")
    links = bagminhash._links(nodes, spark.createDataFrame(list(texts.items()), "node long, text string"))
    assert {(r["a"], r["b"]) for r in links.collect()} == {(i, i + 1) for i in range(0, 36, 2)}


def test_similar_pairs(monkeypatch):
    monkeypatch.setattr(bagminhash, "COLUMNS", 16)
    rng = np.random.default_rng(5)
    bags = [np.unique(rng.choice(40 + 60 * (i % 3), 35)) for i in range(50)] + [np.arange(1000 + i, 1020 + i) for i in range(6)]
    classes = np.array([i % 11 for i in range(len(bags))])
    i, j = bagminhash.similar_pairs(bags[:30] + bags[50:53], bags[30:50] + bags[53:], np.r_[classes[:30], classes[50:53]], np.r_[classes[30:50], classes[53:]])
    left, right = [*range(30), *range(50, 53)], [*range(30, 50), *range(53, 56)]
    want = {(a, b) for a in left for b in right if classes[a] != classes[b] and len({*bags[a]} & {*bags[b]}) >= 0.8 * len({*bags[a]} | {*bags[b]})}
    assert {(left[x], right[y]) for x, y in zip(i, j)} == want and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["class"] for r in bagminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{200 + i: 200 for i in range(30)}}


def test_decontamination(docs, empty, benchmark):
    got = {r["doc_id"]: r for r in spaced_seeds.decontamination_report(docs, benchmark).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {6} and got[6]["items"] == "1"
    left = spaced_seeds.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and left.count() == 13
    assert spaced_seeds.drop_contaminated(empty, benchmark).count() == 0
    assert spaced_seeds.decontamination_report(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_decontamination_without_broadcast(docs, benchmark, monkeypatch):
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert [r["doc_id"] for r in spaced_seeds.decontamination_report(docs, benchmark).filter("contaminated").collect()] == [6]


def test_short_items(spark, docs):
    items = spark.createDataFrame([(9, "w3 and story21 word4 and")], "item_id long, text string")
    found = {r["doc_id"]: r["best"] for r in spaced_seeds.decontamination_report(docs, items).filter("contaminated").collect()}
    assert found == {2: 1.0, 0: 0.8, 1: 0.8}  # as it stands, and with one word of five replaced


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in semi_crf.find_spans(docs).collect()}
    assert [(s["kind"], s["start"]) for s in got[8]["base"]] == [("email", 5), ("phone", 18)] and got[3]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in semi_crf.redact(docs).collect()}
    assert clean[8] == "mail [email] or [phone]" and clean[3] is None and clean[9] == "long " * 50_000
    assert semi_crf.redact(docs).columns == docs.columns and semi_crf.redact(empty).count() == semi_crf.find_spans(empty).count() == 0


def test_bpe(docs, empty):
    got = {r["doc_id"]: r for r in byte_bpe.digests(byte_bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN, decoded=True)).collect()}
    assert got[3]["n_tokens"] == 0 and got[3]["ids_sha256"] == got[4]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[9]["decoded_sha256"] == hashlib.sha256(("long " * 50_000).encode()).hexdigest()
    both = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())
    assert byte_bpe.encode_texts(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_slots(spark, docs, empty):
    first = slots.initial_map(spark, 8)
    second = slots.add_shard(first, 8)
    got = slots.assign(docs, first, second).collect()
    assert len(got) == 14
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    texts = {i: t for i, t, *_ in rows()}
    assert all(r["grown_shard"] in (r["shard"], 8) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in got)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)
    moved = first.join(second.withColumnRenamed("shard", "now"), "vslot").filter("shard <> now")
    assert abs(moved.count() - slots.SLOTS / 9) <= 8 and moved.filter("now <> 8").count() == 0
    assert slots.assign(empty, first).count() == 0
    assert {r["grown_shard"] for r in slots.assign(docs, first).collect()} == {None}


def test_slot_map_versions(spark, tmp_path):
    first = slots.initial_map(spark, 4, 64)
    path = str(tmp_path / "map")
    slots.store_map(first, path)
    totals = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.when(F.col("id") % 4 == 0, 100).otherwise(10).alias("slot_bytes"), F.lit(1).alias("slot_rows"))
    slots.store_map(slots.rebalance(slots.load_map(spark, path), totals), path)
    load = lambda m: [r["b"] for r in m.join(totals, "vslot").groupBy("shard").agg(F.sum("slot_bytes").alias("b")).collect()]
    assert max(load(slots.load_map(spark, path, 1))) == 1600
    assert slots.load_map(spark, path).first()["version"] == 2 and max(load(slots.load_map(spark, path))) <= 600 and slots.load_map(spark, path).count() == 64


def test_rebalance_with_a_hot_slot(spark):
    """A slot larger than its shard's excess stays, and the shard gives the smaller ones that fit: 20 and 6 of 27, not 8."""
    sizes = [60, 20, 8, 6] + [11, 11, 11, 7] + [40, 11, 10, 6]
    held = spark.createDataFrame([(1, i, i // 4) for i in range(12)], "version int, vslot int, shard int")
    totals = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "vslot int, slot_bytes long, slot_rows long")
    got = {r["vslot"]: r["shard"] for r in slots.rebalance(held, totals).collect()}
    assert got == {i: 1 if i in (1, 3) else i // 4 for i in range(12)}


def test_rollup(spark, docs, tmp_path):
    table = rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    feed = rollup.changes(docs.dropDuplicates(["doc_id"]), "insert")
    table.commit(0, feed)
    before = {tuple(r) for r in table.totals().collect()}
    revised = rollup.changes(docs.filter("doc_id = 5").withColumn("text", F.lit("a b")), "revise")
    table.commit(1, revised)
    table.commit(2, rollup.changes(docs.filter("doc_id in (0, 77)"), "delete"))
    after = {tuple(r) for r in table.totals().collect()}
    total = lambda rows, i: sum(r[i] for r in rows if r[2] == "space-1")
    assert total(after, 3) == total(before, 3) - 1 and total(after, 4) == total(before, 4) - 1 - 180
    table.commit(1, revised)
    table.commit(0, feed)
    assert {tuple(r) for r in table.totals().collect()} == after
    table.commit(2, feed.limit(0))  # a batch without rows replaces the deletes it had
    assert total({tuple(r) for r in table.totals().collect()}, 4) == total(before, 4) - 1


def test_scores(docs, empty):
    weights, counts = pseudo_likelihood.train(docs)
    got = {r["doc_id"]: r for r in pseudo_likelihood.score_texts(docs, weights, counts).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[3]["log_likelihood"] == 0.0 and got[0]["n_tokens"] == 180 and got[0]["log_likelihood"] < 0
    weights, counts = pseudo_likelihood.train(empty)
    assert counts.sum() == 0 and pseudo_likelihood.score_texts(empty, weights, counts).count() == 0


def test_sum_of_changes(spark):
    """Levels of partial sums over more partitions than one level takes give the plain sums."""
    import numpy as np

    rows = [(b, i, np.full(3, b + i, np.float32).tobytes()) for b in range(2) for i in range(1, 12)]
    changes = spark.createDataFrame(rows, pseudo_likelihood.CHANGE).repartition(11)
    got = {r["block"]: (r["seen"], np.frombuffer(r["change"], np.float32).tolist()) for r in pseudo_likelihood.sum_changes(changes, fan_in=2).collect()}
    assert got == {b: (66, [66.0 + 11 * b] * 3) for b in range(2)}


def test_pages_and_licenses(spark, docs, empty):
    pages = spark.createDataFrame([(1, "u", "<p>Some text, here it is.</p>", 1), (2, None, None, 1), (None, "v", "", 1)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()}
    assert got == {1: ("Some text, here it is.", 22), 2: ("", 0), None: ("", 0)}
    assert licenses.license_scan(docs).count() == 14 and licenses.license_scan(empty).count() == 0


def test_pipeline_stages(spark, docs, benchmark, tmp_path):
    """Decisions of each stage follow those of its operator on its own input."""
    docs.filter("doc_id is null or doc_id <> 9").write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {0} <= {r["doc_id"] for r in out} <= {0, 7} and len(out) == len({r["doc_id"] for r in out})
    text = {i: t for i, t, *_ in rows()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)
