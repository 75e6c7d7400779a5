"""Order statistics against brute force, also with one key and one value holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [("hot", float(rnd.choice([1, 1, 1, 2, -3, 0.5, 1e6, 7.25])), i) for i in range(900)]
    data += [(f"k{i % 7}", rnd.gauss(0, 100), 1000 + i) for i in range(300)]
    return spark.createDataFrame(data, "k string, v double, id long"), data


def groups(data):
    out = {}
    for k, v, i in data:
        out.setdefault(k, []).append((v, i))
    return out


def test_quantiles(rows):
    df, data = rows
    got = {r["k"]: (r["lo"], r["mid"]) for r in O.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
    for k, vs in groups(data).items():
        s = sorted(v for v, _ in vs)
        for q, have in zip((0.1, 0.5), got[k]):
            pos = (len(s) - 1) * q
            i = int(pos)
            want = s[i] + (s[min(i + 1, len(s) - 1)] - s[i]) * (pos - i)
            assert have == pytest.approx(want)


def test_average_and_ordinal_rank(rows):
    df, data = rows
    avg = {r["id"]: r["rank"] for r in O.average_rank(df, ["k"], "v").collect()}
    order = {r["id"]: r["rank"] for r in O.ordinal_rank(df, ["k"], "v", "id", descending=True).collect()}
    for vs in groups(data).values():
        s = sorted(v for v, _ in vs)
        for v, i in vs:
            assert avg[i] == s.index(v) + 1 + (s.count(v) - 1) / 2
        for place, (_, i) in enumerate(sorted(vs, key=lambda t: (-t[0], t[1])), 1):
            assert order[i] == place


def test_bh_matches_the_step_up_rule_and_is_monotone(spark):
    rnd = random.Random(3)
    ps = [round(rnd.random() ** 3, 3) for _ in range(200)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r["i"]: r["padj"] for r in O.bh_adjust(df, "p").collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    best, want = 1.0, {}
    for place in range(len(ps), 0, -1):
        i = order[place - 1]
        best = min(best, ps[i] * len(ps) / place)
        want[i] = best
    assert all(got[i] == pytest.approx(want[i]) for i in got)
    pairs = sorted((ps[i], got[i]) for i in got)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:]))


def test_running_sums(spark):
    df = spark.createDataFrame([("a", float(t), t) for t in range(1, 200)], "k string, t double, m int")
    rows = O.running_sums(df, ["k"], "t", ["m"]).collect()
    assert all(r["m_run"] == r["m"] * (r["m"] + 1) // 2 and r["m_all"] == 199 * 100 for r in rows)


def sizes(spark, df, order):
    ranges = O.sorted_ranges(df, order)
    return [r["n"] for r in ranges.groupBy(O.RANGE).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_ranges_are_even(spark):
    """Seconds of a year, a value that nine tenths of the rows have, and ties in text: no range over three times the mean."""
    n, parts = 40_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = spark.range(n, numPartitions=8)
    year = base.select(F.col("id"), (F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(31_536_000))).cast("double").alias("v"))
    hot = base.select("id", F.when(F.col("id") % 10 == 0, F.rand(1)).otherwise(0.5).alias("v"))
    same = base.select(F.lit(1.0).alias("v"))
    text = base.select(F.concat(F.lit("feature-"), F.col("id").cast("string")).alias("t"), F.lit(1.0).alias("v"))
    tied = lambda df: O._with_tie(df)
    for df, order in ((year, ["v", "id"]), (tied(hot.drop("id")), ["v", "__tie_hash", "__tie_part"]), (tied(same), ["v", "__tie_hash", "__tie_part"]), (text, ["v", "t"])):
        got = sizes(spark, df, [F.col(c) for c in order])
        assert len(got) > 1 and max(got) <= 3 * n / parts
    ranks = [r["rank"] for r in O.ordinal_rank(text, [], "v", "t").orderBy("t").collect()]
    assert ranks == list(range(1, n + 1))
    assert {r["rank"] for r in O.average_rank(same, [], "v").collect()} == {(n + 1) / 2}


def test_groups_over_many_ranges(spark):
    """One key over all ranges, keys inside one, nulls, a value that is not a number: running sums, ranks and lags."""
    rnd = random.Random(8)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 11}", rnd.choice([1.0, 2.0, 3.5, float("nan"), None]), i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double, id long, w double").repartition(6)
    order = [F.col(c) for c in ("k", "v", "id")]
    levels = [O.Level(("k",), {"c": None, "s": "w", "ids": "id"}, {"prev": "id"}), O.Level(("k", "v"), {"t": None})]
    got = {r["id"]: r for r in O.scan(O.sorted_ranges(df, order), levels).collect()}
    key = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (key(d[1]), d[2]))
        run, last = 0.0, None
        for place, d in enumerate(own, 1):
            r = got[d[2]]
            run += d[3]
            tie = [x[2] for x in own if key(x[1]) == key(d[1])]
            assert (r["c_run"], r["c_all"], r["prev"], r["t_run"], r["t_all"]) == (place, len(own), last, tie.index(d[2]) + 1, len(tie))
            assert r["s_run"] == pytest.approx(run) and r["s_all"] == pytest.approx(sum(x[3] for x in own)) and r["ids_all"] == sum(x[2] for x in own)
            last = d[2]
    avg = {r["id"]: r["rank"] for r in O.average_rank(df.where("not isnan(v) or v is null"), ["k"], "v").collect()}
    for i, v in ((d[2], d) for d in data if d[1] is None or d[1] == d[1]):
        own = sorted(x[1] for x in data if x[0] == v[0] and x[1] is not None and x[1] == x[1])
        assert avg[i] is None if v[1] is None else avg[i] == own.index(v[1]) + 1 + (own.count(v[1]) - 1) / 2


def test_bh_families_over_ranges(spark):
    rnd = random.Random(12)
    data = [("hot" if i % 4 else f"f{i % 13}", rnd.choice([0.01, 0.2, 1.0, None, rnd.random()]), i) for i in range(2500)]
    got = {r["i"]: r["q"] for r in O.bh_adjust(spark.createDataFrame(data, "f string, p double, i long"), "p", "q", ["f"]).collect()}
    for f in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == f and d[1] is not None), key=lambda d: d[1])
        best = 1.0
        for place in range(len(own), 0, -1):
            best = min(best, own[place - 1][1] * len(own) / place)
            assert got[own[place - 1][2]] == pytest.approx(best)
    assert all(got[d[2]] is None for d in data if d[1] is None)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double, id long")
    assert O.bh_adjust(df, "v").count() == O.average_rank(df, ["k"], "v").count() == O.ordinal_rank(df, [], "v", "id").count() == O.exact_median(df, ["k"], "v").count() == 0
    one = spark.createDataFrame([("a", None, 1)], "k string, v double, id long")
    assert O.bh_adjust(one, "v").collect()[0]["padj"] is None and O.ranked_counts(one, [], "v").count() == 0


def test_quantile_normalisation_of_a_flat_sample(spark):
    """A sample half full of one value, samples of other lengths and nulls, against ranks one by one; no arrays."""
    from lociframe.operators.matrix import quantile_normalize

    rnd = random.Random(4)
    data = {s: [None if rnd.random() < 0.05 else 7.0 if s == "flat" and rnd.random() < 0.5 else round(rnd.gauss(i, 3), 1) for _ in range(400 - 30 * i)] for i, s in enumerate(["flat", "b", "c"])}
    rows = [(f"f{i}", s, v) for s, vs in data.items() for i, v in enumerate(vs)]
    ranks = {s: sorted(v for v in vs if v is not None) for s, vs in data.items()}
    target = [sum(r[i] for r in ranks.values() if i < len(r)) / sum(i < len(r) for r in ranks.values()) for i in range(max(map(len, ranks.values())))]
    out = quantile_normalize(spark.createDataFrame(rows, "feature string, sample string, value double"))
    got = {(r["feature"], r["sample"]): r["value"] for r in out.collect()}
    assert len(got) == sum(map(len, ranks.values()))
    for f, s, v in rows:
        if v is not None:
            at = [i for i, x in enumerate(ranks[s]) if x == v]
            assert got[f, s] == pytest.approx(sum(target[i] for i in at) / len(at))
    plan = out._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "collect_list" not in plan
