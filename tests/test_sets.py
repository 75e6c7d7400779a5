"""Set overlap by inverted lists and ranked-list enrichment, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import sets as S


def library(seed=2, n=40, items=60):
    rnd = random.Random(seed)
    out = {f"s{i:02d}": {0, *rnd.sample(range(items), rnd.randint(1, 25))} if i % 5 else {1000 + i} for i in range(n)}
    out["s01"], out["s02"] = set(range(30)), set(range(28))
    return out


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame([(k, i) for k, v in library().items() for i in v], "set_id string, item long").cache()


@pytest.mark.parametrize("chunk", [1024, 6])
def test_common_items(sets, monkeypatch, chunk):
    """With chunks of six sets the item that nearly every set has is many lists."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    lib = library()
    want = {(a, b): len(lib[a] & lib[b]) for a in lib for b in lib if a < b}
    got = {(r["a"], r["b"]): r["intersection"] for r in S.co_members(sets).collect()}
    assert got == {k: v for k, v in want.items() if v}
    every = {(r["a"], r["b"]): r for r in S.pairwise_overlap(sets, 2000).collect()}
    assert {k: r["intersection"] for k, r in every.items()} == want
    some = {(r["a"], r["b"]): r for r in S.pairwise_overlap(sets, 2000, empty_pairs=False).collect()}
    assert set(some) == set(got) and all(some[k]["pvalue"] == pytest.approx(every[k]["pvalue"]) for k in some)
    assert all(r["pvalue"] == 1.0 for k, r in every.items() if k not in got)


@pytest.mark.parametrize("t", [0.2, 0.5, 0.93, 1.0])
def test_similar_sets(sets, t):
    lib = library()
    want = {(a, b): len(lib[a] & lib[b]) / len(lib[a] | lib[b]) for a in lib for b in lib if a < b and len(lib[a] & lib[b]) >= t * len(lib[a] | lib[b])}
    assert {(r["a"], r["b"]): r["jaccard"] for r in S.similar_sets(sets, t).collect()} == pytest.approx(want)
    assert want or t == 1.0


def test_drawn_places(spark):
    """Distinct places, prefixes that are uniform, and lengthening where nearly all places are wanted."""
    rows = {r["draw"]: r["places"] for r in S.draw_places(spark, 50, 20, 400, 7).collect()}
    assert sorted(rows) == list(range(1, 401)) and all(len(set(p)) == 20 and min(p) >= 1 and max(p) <= 50 for p in rows.values())
    assert max(abs(np.bincount([p[j] for p in rows.values() for j in range(5)], minlength=51)[1:] - 40)) < 25
    assert all(sorted(r["places"]) == list(range(1, 301)) for r in S.draw_places(spark, 300, 300, 3, 7).collect())
    with pytest.raises(ValueError):
        S.draw_places(spark, 3, 4, 1, 7)


def brute_es(places, weights, n):
    run, best, total, k = 0.0, 0.0, sum(weights), len(places)
    at, hi, lo = dict(zip(places, weights)), -2.0, 2.0
    for p in range(1, n + 1):
        if p in at:
            lo = min(lo, run)
            run += at[p] / total if total else 1 / k
            hi = max(hi, run)
        else:
            run -= 1 / (n - k)
            lo = min(lo, run) if p < n and any(q > p for q in at) else lo
    return hi if hi >= -lo else lo


def test_enrichment_scores():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, k = 40, int(rng.integers(1, 12))
        places = np.sort(rng.choice(np.arange(1, n + 1), k, replace=False))
        weights = rng.random(k) * (rng.random() > 0.1)
        assert S.enrichment_scores(places[None], weights[None], n)[0] == pytest.approx(brute_es(places.tolist(), weights.tolist(), n))


def test_preranked_enrichment(spark):
    """Scores, p and pooled q from the same draws in plain Python."""
    rnd = random.Random(9)
    scores = {i: rnd.gauss(0, 1) + (1.5 if i < 15 else 0) for i in range(120)}
    lib = {"top": set(range(12)), "rand8": set(rnd.sample(range(120), 8)), "mix8": {*range(4), 60, 70, 80, 90}, "rand12": set(rnd.sample(range(120), 12)), "small": {1, 2}, "all": set(range(120)), "far": set(range(500, 510))}
    ranked = spark.createDataFrame(list(scores.items()), "item long, score double")
    sets = spark.createDataFrame([(k, i) for k, v in lib.items() for i in v], "set_id string, item long")
    got = {r["set_id"]: r for r in S.preranked_enrichment(ranked, sets, 200, 5, 500, seed=4).collect()}
    order = sorted(scores, key=lambda i: (-scores[i], i))
    place = {i: p for p, i in enumerate(order, 1)}
    weight = {place[i]: abs(scores[i]) for i in scores}
    used = {k: v for k, v in lib.items() if k in ("top", "rand8", "mix8", "rand12")}
    assert set(got) == set(used)
    draws = [r["places"] for r in S.draw_places(spark, 120, 12, 200, 4).collect()]
    null = {k: [brute_es(sorted(d[:k]), [weight[p] for p in sorted(d[:k])], 120) for d in draws] for k in (8, 12)}
    mean = {k: {up: np.mean([abs(x) for x in v if (x >= 0) == up]) for up in (True, False)} for k, v in null.items()}
    es = {k: brute_es(sorted(place[i] for i in v), [weight[p] for p in sorted(place[i] for i in v)], 120) for k, v in used.items()}
    nes = {k: es[k] / mean[len(v)][es[k] >= 0] for k, v in used.items()}
    pool = [x / mean[len(v)][x >= 0] for v in used.values() for x in null[len(v)]]
    for k, v in used.items():
        up = es[k] >= 0
        same = [x for x in null[len(v)] if (x >= 0) == up]
        assert got[k]["es"] == pytest.approx(es[k]) and got[k]["nes"] == pytest.approx(nes[k])
        assert got[k]["pvalue"] == pytest.approx(np.mean([abs(x) >= abs(es[k]) for x in same]))
        side = [x for x in pool if (x >= 0) == up]
        own = [x for x in nes.values() if (x >= 0) == up]
        q = np.mean([abs(x) >= abs(nes[k]) for x in side]) / np.mean([abs(x) >= abs(nes[k]) - 1e-12 for x in own])
        assert got[k]["fdr"] == pytest.approx(min(1.0, q))
    assert got["top"]["pvalue"] < 0.05 and got["top"]["direction"] == "positive"
    assert S.preranked_enrichment(ranked, sets.where("set_id = 'small'"), 20).count() == 0
