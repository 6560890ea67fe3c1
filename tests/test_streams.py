"""Structured Streaming: late rows behind the watermark are dropped; the
on-time rows equal the batch twin."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.streaming import streams as V


def _events(spark, day, n, start_id):
    rows = [(start_id + i, dt.datetime(2024, 1, day, 10, i), 1, "view", float(i), "{}") for i in range(n)]
    return spark.createDataFrame(rows, V.EVENT_SCHEMA)


def test_late_rows_are_dropped(spark, tmp_path):
    # Late input is filtered against the watermark of the previous batch
    # (Spark >= 3.4), so the late file is the third micro-batch.
    src = str(tmp_path / "src")
    _events(spark, 10, 4, 0).coalesce(1).write.mode("append").parquet(src)
    _events(spark, 11, 2, 200).coalesce(1).write.mode("append").parquet(src)
    _events(spark, 1, 3, 100).coalesce(1).write.mode("append").parquet(src)
    out = V.event_window_means(spark, src, size="1 day", slide="1 day", watermark="1 day", files_per_batch=1)
    got = {r["window_start"].day: r["n"] for r in out.collect()}
    assert got == {10: 4, 11: 2}          # the day-1 rows arrived after the watermark passed day 9


def test_run_log_stream_matches_batch(spark, tmp_path):
    logs = str(tmp_path / "logs")
    lines = ["2024-01-02 10:00:00 | INFO | r | m:1 | PERFORMANCE | req-1 | Optimized execution: 1.50s",
             "2024-01-02 11:00:00 | INFO | r | m:1 | PERFORMANCE | req-2 | Fallback execution: 70.25s",
             "2024-01-02 12:00:00 | INFO | r | m:1 | other line",
             "2024-01-03 09:00:00 | INFO | r | m:1 | PERFORMANCE | req-3 | Optimized execution: 2.50s"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(logs)
    out = {(r["window_start"].day, r["level"]): (r["runs"], r["mean_seconds"], r["slow_runs"])
           for r in V.run_log_stream(spark, logs).collect()}
    assert out == {(2, "optimized"): (1, 1.5, 0), (2, "fallback"): (1, 70.25, 1), (3, "optimized"): (1, 2.5, 0)}
    from quarry.operators.answers import run_log_metrics
    batch = {r["level"]: r["runs"] for r in run_log_metrics(spark.read.text(logs)).collect()}
    assert batch == {"optimized": 2, "fallback": 1}
    assert F is not None


def test_stream_windows_ignore_session_time_zone(spark, tmp_path):
    src = str(tmp_path / "src")
    _events(spark, 10, 3, 0).coalesce(1).write.mode("append").parquet(src)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = V.event_window_means(spark, src, size="1 day", slide="1 day").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [(r["window_start"], r["n"]) for r in out] == [(dt.datetime(2024, 1, 10), 3)]
