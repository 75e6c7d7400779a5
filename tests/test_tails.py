"""Distribution tails against exact sums and known values."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lociframe.functions.special import chi2_sf, hypergeom_sf, normal_two_sided


def exact_hypergeom(a, n, k, t):
    return float(sum(Fraction(math.comb(k, i) * math.comb(t - k, n - i), math.comb(t, n)) for i in range(max(a, 0, n + k - t), min(n, k) + 1)))


def test_hypergeometric_tail(spark):
    cases = [(1, 2000, 2000, 4000), (1000, 2000, 2000, 4000), (1100, 2000, 2000, 4000), (0, 5, 5, 10), (5, 5, 5, 10), (6, 5, 5, 10), (3, 8, 6, 10), (4, 8, 6, 10), (2, 30, 40, 500),
             (12, 30, 40, 500), (1, 1, 1, 1), (30, 30, 40, 500)]
    rows = spark.createDataFrame(cases, "a long, n long, k long, t long").select("a", "n", "k", "t", hypergeom_sf(F.col("a"), F.col("n"), F.col("k"), F.col("t")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(exact_hypergeom(r["a"], r["n"], r["k"], r["t"]), rel=1e-6, abs=1e-300)
    big = spark.createDataFrame([(250_000, 500_000, 500_000, 1_000_000)], "a long, n long, k long, t long")
    assert 0.5 < big.select(hypergeom_sf(F.col("a"), F.col("n"), F.col("k"), F.col("t"))).first()[0] < 0.51


def test_chi_square_tail(spark):
    """Even degrees of freedom: a Poisson sum, here from logs of exact factorials."""
    cases = [(2000.0, 1000), (2500.0, 2002), (3000.0, 2000), (5100.0, 5000), (10.0, 4), (0.5, 2), (900.0, 1000)]
    rows = spark.createDataFrame(cases, "x double, k int").select("x", "k", chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()
    for r in rows:
        y = r["x"] / 2
        want = math.fsum(math.exp(i * math.log(y) - y - math.lgamma(i + 1)) for i in range(r["k"] // 2))
        assert r["p"] == pytest.approx(want, rel=1e-5)
    odd = spark.createDataFrame([(2500.0, 2001), (3.841458820694124, 1), (11.0705, 5)], "x double, k int").select(chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()
    assert 0 < odd[0]["p"] < 1e-12 and odd[1]["p"] == pytest.approx(0.05, abs=1e-6) and odd[2]["p"] == pytest.approx(0.05, abs=1e-5)


def test_normal_tail(spark):
    cases = [(z,) for z in (0.0, 1.0, 1.959963985, 3.0, 6.0, 8.0, 8.5, 15.0, 37.0, -10.0)]
    for r in spark.createDataFrame(cases, "z double").select("z", normal_two_sided(F.col("z")).alias("p")).collect():
        far = abs(r["z"]) > 7.1
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9 if far else 0.06, abs=0 if far else 3e-7)
