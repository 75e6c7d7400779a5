"""The guide scan looks at windows with a PAM alone, and finds what a look at every window finds."""

import random
import re

from pyspark.sql import functions as F

from lociframe.functions import sequence as Q
from lociframe.operators import sequences as S


def brute(seq):
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    out = set()
    for i in range(len(seq) - 22):
        w = seq[i:i + 23]
        rc = "".join(pair.get(c, "N") for c in reversed(w))
        for strand, at, x in (("+", i, w), ("-", i + 3, rc)):
            if re.fullmatch("[ACGT]GG", x[20:]) and "N" not in x[:20]:
                out.add((strand, at, x[:20], x[20:]))
    return out


def test_sites_equal_every_window(spark):
    rnd = random.Random(4)
    rows = [("long", "".join(rnd.choice("ACGT") for _ in range(2 * S.PIECE + 300))), ("odd", "".join(rnd.choice("ACGGCTN\né😀") for _ in range(1500))),
            ("runs", "G" * 60 + "C" * 60), ("short", "A" * 20 + "GG"), ("one", "CCA" + "ACGT" * 5), ("none", None)]
    df = spark.createDataFrame(rows, "gene string, seq string")
    got = {(r["gene"], r["strand"], r["position"], r["spacer"], r["pam"]) for r in S.find_sites(df, clean=False).collect()}
    assert got == {(g, *s) for g, seq in rows if seq for s in brute(seq)} and len(got) > 200


def test_windows_without_a_site_make_no_rows(spark):
    df = spark.createDataFrame([("a", "AT" * 5000), ("b", "AT" * 2000 + "AGG")], "gene string, seq string")
    found = S.windows(df, 20, "NGG")
    assert found.count() <= -(-10000 // S.PIECE) + -(-4003 // S.PIECE) + 1
    assert found.where(F.col("gene") == "b").agg(F.max("at")).first()[0] == 4003 - 23


def test_primer_site_is_the_prefix_nearest_the_optimum(spark):
    rnd = random.Random(5)
    rows = [("".join(rnd.choice("ACGTN") for _ in range(n)),) for n in [20] * 30 + [0, 1, 2, 9, 16, 17, 30]] + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    rc = Q.reverse_complement(F.col("s"))
    tms = [Q.melting_temperature(F.substring(rc, 1, n)) for n in range(8, 18)]
    got = df.select("s", rc.alias("rc"), Q.primer_binding_site(F.col("s")).alias("p"), F.array(*tms).alias("t")).collect()
    for r in got:
        if r["s"] is not None:
            gap, n, tm = min((abs(t - 33.0), n, t) for n, t in zip(range(8, 18), r["t"]))
            assert tuple(r["p"]) == (gap, n, r["rc"][:n], tm)
    steps = df.select(Q.primer_binding_site(F.col("s")).alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert steps == 1
