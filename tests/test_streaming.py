"""Event-time windows over a stream of files: late rows within the watermark count, later ones do not."""

from __future__ import annotations

import datetime as dt

from lexigrid.streaming import trends


def test_late_rows(spark, tmp_path):
    def batch(*times):
        rows = [(dt.datetime(2024, 1, 1, h, m), kind) for h, m, kind in times]
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    source = lambda: spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))

    def advance():
        counted = trends.windowed_counts(source(), "ts", "1 hour", "30 minutes", ["kind"])
        query = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert query.exception() is None

    batch((9, 5, "a"), (9, 10, "a"), (9, 20, "b"))
    advance()
    batch((9, 55, "a"), (11, 0, "a"))  # 9:55 is within half an hour of the latest time so far
    advance()
    batch((9, 59, "a"), (13, 0, "b"))  # the window of 9:59 was closed at 10:30
    advance()
    found = {(r.period.hour, r.kind): r.sequential_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(9, "a"): 3, (9, "b"): 1, (11, "a"): 1}
