"""Statistics whose products of counts pass the largest long."""

import pytest
from pyspark.sql import functions as F

from lociframe.operators import stats as S
from lociframe.operators import survival as V

N = 400_000


@pytest.fixture(scope="module")
def rows(spark):
    """Two groups of one size; a fourth of all has its event at time 1, the rest leaves at time 2, all of it from group 1."""
    i = F.col("id")
    return spark.range(N).select(
        F.lit("k").alias("k"), F.when(i % 4 == 0, 1.0).otherwise(2.0).alias("time"), (i % 4 == 0).cast("int").alias("event"),
        F.when(i % 2 == 0, "High").otherwise("Low").alias("lvl"), (i % 4).alias("value"))


def expected():
    r, n, d = N / 2, float(N), N / 4
    return d * r / n, r * (n - r) * d * (n - d) / (n * n * (n - 1))


def test_logrank_two(spark, rows):
    e, v = expected()
    row = V.logrank_two(rows, "lvl", "High", ["k"]).first()
    assert row["observed"] == N / 4
    assert (row["expected"], row["variance"]) == (pytest.approx(e), pytest.approx(v))
    assert row["chi2"] == pytest.approx((N / 4 - e) ** 2 / v)


def test_weighted_logrank(spark, rows):
    e, v = expected()
    w = N / 2
    row = V.weighted_logrank(rows, "lvl").first()
    assert row["statistic"] == pytest.approx(((w * (N / 4 - e)) ** 2 + (w * e) ** 2) / (2 * w * w * v))


def test_cohort_and_alteration_survival(spark, rows):
    e, v = expected()
    cohort = V.cohort_survival(rows.withColumn("value", (F.col("lvl") == "High").cast("int")), "k", "value").first()
    assert (cohort["n"], cohort["high_events"]) == (N, N // 4)
    assert cohort["chi2"] == pytest.approx((N / 4 - e) ** 2 / v)
    flags = rows.select("k", F.lit("mutation").alias("kind"), (F.col("lvl") == "High").alias("altered"), "time", "event")
    assert V.alteration_survival(flags, "k").first()["pvalue"] == pytest.approx(0.0, abs=1e-12)


def test_kruskal(spark):
    n = 2_400_000
    rows = spark.range(n).select((F.col("id") % 2).alias("value"), (F.col("id") % 3).alias("grp"))
    row = S.kruskal(rows, "value", "grp").first()
    assert (row["n"], row["df"]) == (n, 2)
    # Every group has the same mean rank.
    assert row["h"] == pytest.approx(0.0, abs=1e-3)
    assert row["pvalue"] == pytest.approx(1.0, abs=1e-3)
