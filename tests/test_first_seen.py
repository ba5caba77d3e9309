"""A URL is admitted once ever, and none is late."""

from pyspark.sql import functions as F

from sitelens.streaming import frontier


def test_first_seen_is_for_ever(spark, tmp_path):
    day = 86_400
    (tmp_path / "in").mkdir()
    stream = frontier.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(f"{tmp_path}/in"))
    # a repeat after days, and a new URL that comes days late
    for rows in ([("http://a.com/1", 0)], [("http://a.com/2", 9 * day)], [("http://a.com/3", 20 * day)], [("http://a.com/1", 21 * day), ("http://b.com/late", day)]):
        data = spark.createDataFrame(rows, "url string, at long").select("url", F.timestamp_seconds("at").alias("ts"))
        data.write.mode("append").parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
    got = sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == ["http://a.com/1", "http://a.com/2", "http://a.com/3", "http://b.com/late"]
