"""Pockets from links, and peaks of many conditions, without rows for each pair."""

import numpy as np
from pyspark.sql import functions as F

from lociframe.operators import intervals as I
from lociframe.operators import residues as R


def test_pockets_come_from_few_links(spark):
    """A ball of residues makes a contact of nearly every pair, but fewer links than copies of the residues."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 3, (250, 3)), rng.normal(60, 14, (60, 3)), rng.uniform(-90, 90, (60, 3))])
    rows = [(i, "s" if i % 2 else "t", *map(float, p), 1.0) for i, p in enumerate(x)] + [(900, "s", None, 0.0, 0.0, 1.0), (901, None, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "rid long, structure string, x double, y double, z double, sasa double")
    assert R.contacts(df).count() > 10_000 and R.contact_links(df).count() < 14 * len(rows)
    root = {r[0]: r[0] for r in rows}
    for a, b in sorted((r["a"], r["b"]) for r in R.contacts(df).collect()):
        lo, hi = sorted((root[a], root[b]))
        root = {k: lo if v == hi else v for k, v in root.items()}
    assert {r["rid"]: r["pocket"] for r in R.pockets(df).collect()} == root


def test_probes_do_not_grow_with_the_conditions(spark, monkeypatch):
    seen = []
    whole = I.sorted_ranges
    monkeypatch.setattr(I, "sorted_ranges", lambda df, order: seen.append(df.count()) or whole(df, order))
    for conds in (2, 8):
        df = spark.range(400).select(F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 20).alias("end"),
                                     F.col("id").alias("name"), (F.col("id") % conds).alias("cond"))
        assert I.unique_peaks(df).count() == 0
    assert seen[0] == seen[1]
