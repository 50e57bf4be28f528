from datetime import datetime, timedelta

from splitwright.streaming.sessions import streaming_sessions


def test_closed_sessions_equal_the_batch_ones(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("a", t0 + timedelta(seconds=s)) for s in (0, 15, 31, 40)] + [("b", t0), (None, t0), ("a", t0 + timedelta(days=1))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = (
        streaming_sessions(stream, "key", "ts", 15, 0).writeStream.format("memory").queryName("closed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = sorted((r["key"], (r["start"] - t0).seconds, (r["end"] - t0).seconds, r["n"]) for r in spark.sql("select * from closed").collect())
    assert got == [("a", 0, 15, 2), ("a", 31, 40, 2), ("b", 0, 0, 1)]
