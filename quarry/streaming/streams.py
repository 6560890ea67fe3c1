"""Structured Streaming operators.

Both are event-time windowed aggregates with a watermark. A run uses the
``availableNow`` trigger (process what is there, in several micro-batches,
then stop); results leave through ``foreachBatch`` in update mode, each
batch appended to a parquet folder with its batch id, and the final
answer keeps the latest version of every (window, key). Checkpoints and
outputs live in the shared checkpoint folder, so a lost executor costs no
state. A call is a run of its own unless it names a ``run_id``: with the id
of an earlier run it goes on from that run's last committed batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import instant_to_ntz, ntz_to_instant
from quarry.operators.answers import PERF_LINE
from quarry.session import shared_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _run(agg: DataFrame, keys: list[str], name: str, run_id: str | None = None) -> DataFrame:
    spark = agg.sparkSession
    run = run_id or uuid.uuid4().hex[:12]
    out = shared_path(spark, "streams", name, run, "out")
    ckpt = shared_path(spark, "streams", name, run, "checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    res = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return res.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id")


def event_window_means(spark: SparkSession, source_dir: str, size: str = "1 day", slide: str = "12 hours",
                       watermark: str = "1 day", files_per_batch: int = 2, run_id: str | None = None) -> DataFrame:
    """V2: sliding-window count and mean of event values per type.

    ``ts`` becomes a TIMESTAMP read as UTC first (a watermark rejects
    TIMESTAMP_NTZ); results go back to naive wall-clock values, so the
    answer does not depend on the session time zone.
    """
    ev = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
          .withColumn("ts", ntz_to_instant("ts")))
    agg = (ev.withWatermark("ts", watermark)
           .groupBy(F.window("ts", size, slide).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))
    out = _run(agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "event_type", "n", "mean_value"), ["window_start", "event_type"], "event_window_means", run_id)
    return out.select(instant_to_ntz("window_start").alias("window_start"),
                      instant_to_ntz("window_end").alias("window_end"), "event_type", "n", "mean_value")


def parse_perf_lines(lines: DataFrame) -> DataFrame:
    """Timestamp prefix + PERFORMANCE fields of a run-log line."""
    ts = ntz_to_instant(F.to_timestamp_ntz(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))
    return lines.select(ts.alias("ts"), F.lower(F.regexp_extract("value", PERF_LINE, 2)).alias("level"),
                        F.regexp_extract("value", PERF_LINE, 3).try_cast("double").alias("seconds")) \
                .filter(F.col("seconds").isNotNull())


def run_log_stream(spark: SparkSession, log_dir: str, size: str = "1 day", watermark: str = "1 day",
                   slow_seconds: float = 60.0, files_per_batch: int = 2, run_id: str | None = None) -> DataFrame:
    """V1: O6 on a text stream: tumbling-window run counts, mean seconds
    and slow runs per level; rows later than the watermark are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(log_dir)
    p = parse_perf_lines(lines)
    agg = (p.withWatermark("ts", watermark).groupBy(F.window("ts", size).alias("w"), "level")
           .agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean_seconds"),
                F.count_if(F.col("seconds") > slow_seconds).alias("slow_runs"), F.max("seconds").alias("max_seconds")))
    out = _run(agg.select(F.col("w.start").alias("window_start"), "level", "runs", "mean_seconds", "slow_runs",
                          "max_seconds"), ["window_start", "level"], "run_log_stream", run_id)
    return out.withColumn("window_start", instant_to_ntz("window_start"))
