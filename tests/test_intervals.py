"""Interval yes/no answers by reach, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import intervals as I

RULES = {
    I.OVER_HALF_OF_LEFT: lambda o, a, b: o / a > 0.5,
    I.HALF_OF_SHORTER: lambda o, a, b: o / min(a, b) >= 0.5,
}


def intervals(kind, n=260, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        length = {"mixed": rnd.choice([1, 2, 3, 4, 7, 8, 16, 33, 100, 257]), "short": rnd.randint(1, 4), "long": rnd.choice([50, 64, 1000])}[kind]
        start = rnd.randint(-40, 300 if kind != "long" else 900)
        out.append((f"c{rnd.randint(0, 1)}", start, start + length, i, rnd.choice("xyz")))
    out += [("c0", 10, 20, n + k, "x") for k in range(30)]  # a pile of equal intervals
    return out


def match(rule, a, b):
    overlap = min(a[2], b[2]) - max(a[1], b[1])
    return a[0] == b[0] and overlap > 0 and RULES[rule](overlap, a[2] - a[1], b[2] - b[1])


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("kind", ["mixed", "short", "long"])
def test_reach_equals_pairs(spark, rule, kind):
    rows = intervals(kind)
    df = spark.createDataFrame(rows, "chrom string, start long, end long, name long, cond string")
    want = {(a[3], b[4]) for a in rows for b in rows if a[4] != b[4] and match(rule, a, b)}
    got = {(r["name"], r["other"]) for r in I._cross_condition_hits(df, rule, "name").collect()}
    assert got == want and want
    x, y = df.where("cond = 'x'"), df.where("cond = 'y'")
    semi = {r["name"] for r in I.interval_semi(x, y, rule).collect()}
    assert semi == {n for n, o in want if o == "y" and next(r for r in rows if r[3] == n)[4] == "x"}
    assert {r["name"] for r in I.interval_anti(x, y, rule).collect()} == {r[3] for r in rows if r[4] == "x"} - semi
    assert {r["name"] for r in I.unique_peaks(df, rule).collect()} == {r[3] for r in rows} - {n for n, _ in want}
    every = {r["name"] for r in I.shared_peaks(df, "x", rule).collect()}
    assert every == {r[3] for r in rows if r[4] == "x" and {(r[3], "y"), (r[3], "z")} <= want}


def test_other_conditions_go_through_pairs(spark):
    rows = intervals("mixed", 80)
    df = spark.createDataFrame(rows, "chrom string, start long, end long, name long, cond string")
    want = {a[3] for a in rows for b in rows if a[4] == "x" and b[4] == "y" and a[0] == b[0] and min(a[2], b[2]) - max(a[1], b[1]) >= 3}
    assert {r["name"] for r in I.interval_semi(df.where("cond = 'x'"), df.where("cond = 'y'"), "overlap >= 3").collect()} == want


def test_empty_sides_and_points(spark):
    df = spark.createDataFrame([("c", 5, 9, 1, "x"), ("c", 7, 7, 2, "y"), ("c", 3, 3, 3, "x")], "chrom string, start long, end long, name long, cond string")
    for rule in RULES:
        assert I.interval_semi(df.where("cond = 'x'"), df.where("cond = 'y'"), rule).count() == 0
        assert I.interval_semi(df, df.limit(0), rule).count() == 0 and I.interval_anti(df.limit(0), df, rule).count() == 0


def test_rows_grow_with_the_input_alone(spark):
    """A thousand equal intervals make a million pairs, but only some rows for each interval here."""
    df = spark.range(1000).select(F.lit("c").alias("chrom"), F.lit(100).cast("long").alias("start"), F.lit(200).cast("long").alias("end"), F.col("id").alias("name"), F.lit(0).alias("other"))
    rows = I._reach_rows(df, df.withColumn("cond", F.lit(0)), I.OVER_HALF_OF_LEFT, "name")
    assert rows.count() <= 20 * 2000
    assert I.interval_semi(df.drop("other"), df.drop("other")).count() == 1000
