"""Sessions of the run log over micro-batches: repeated, late and closing rows."""

import datetime as dt

from lorebase.streaming import runlog

SCHEMA = "trace_id string, user_id string, ts timestamp, latency_ms long, refused boolean"


def at(hour, minute):
    return dt.datetime(2024, 5, 1, hour, minute)


BATCHES = [
    [("x1", "a", at(10, 0), 10, False), ("x2", "a", at(10, 5), 20, True), ("x1", "a", at(10, 0), 10, False)],
    # x2 again; x3 joins the session; x0 is late, but not too late; b moves the watermark to 11:50
    [("x2", "a", at(10, 5), 20, True), ("x3", "a", at(10, 34), 30, False), ("x0", "a", at(9, 58), 40, False), ("y1", "b", at(12, 0), 5, False)],
    # too late, and another session of a; the watermark closes what ended before 13:50
    [("x4", "a", at(10, 40), 99, True), ("x5", "a", at(12, 10), 7, False), ("z1", "c", at(14, 0), 1, False)],
    [("z2", "c", at(18, 0), 1, False)],
]


def test_sessions_over_micro_batches(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "all" / f"{i}"))
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for i in range(len(BATCHES)):
        file = next((tmp_path / "all" / f"{i}").glob("*.parquet"))
        file.rename(source / f"{i}.parquet")
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        query = runlog.sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.user_id, r.start.hour, r.start.minute, r.end.hour, r.end.minute, r.runs, r.mean_ms, r.refused) for r in spark.read.parquet(out).collect())
    assert got == [("a", 9, 58, 11, 4, 4, 25.0, 1), ("a", 12, 10, 12, 40, 1, 7.0, 0), ("b", 12, 0, 12, 30, 1, 5.0, 0), ("c", 14, 0, 14, 30, 1, 1.0, 0)]
