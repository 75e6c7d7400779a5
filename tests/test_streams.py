"""Timed state of the stream of first records: late records, freed state, a key that comes back."""

from pyspark.sql import functions as F

from lociframe.streaming import jobs as J

DAY = 86_400


def test_first_records(spark, tmp_path):
    feeds = [
        [("a", 10), ("b", 11), ("a", 12)],
        [("a", 40), ("c", 60)],  # the watermark is day 5: the state of a (until day 30) is still there
        [("a", 61), ("b", 20), ("d", 20)],  # the watermark is day 53: days 20 are late, and a's timer fires after this feed
        [("a", 62), ("e", 100), (None, 61)],
    ]
    for b, rows in enumerate(feeds):
        (spark.createDataFrame([(k, d * DAY) for k, d in rows], "k string, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
         .write.parquet(f"{tmp_path}/in/{b}"))
    stream = spark.readStream.schema("k string, s long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = sorted(((r["dedup_key"] or "", r["at"] // (DAY * 1000)) for r in J.run_available(J.first_records(stream, F.col("k"), "ts", "7 days", 20)).collect()))
    assert got == [("", 61), ("a", 10), ("a", 62), ("b", 11), ("c", 60), ("e", 100)]
