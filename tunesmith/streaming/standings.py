"""Live standings over an appended trial log (Structured Streaming).

Benchmark jobs append trial rows to one Parquet log while they run (S3). This module keeps a
per-run and per-method standing up to date from that log as a streaming query: the log folder
is a file source with the fixed trial-log schema, the aggregation is a stateful streaming
``groupBy`` (state = one row per run, partially aggregated per micro-batch), and each batch
of results is written to a Parquet folder (``foreachBatch``) or a memory table.

Per run: trials seen, best score so far, latest cumulative time, failures.
Per method: mean of the runs' best scores, runs, trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunesmith.sources.trial_log import RUN_KEYS, TRIAL_LOG_SCHEMA


def trial_stream(spark: SparkSession, log_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TRIAL_LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(log_path)


def run_standings(trials: DataFrame) -> DataFrame:
    """Streaming aggregation: one row per run (complete output mode)."""
    return trials.groupBy(*RUN_KEYS).agg(
        F.count(F.lit(1)).alias("trials"),
        F.max("best_score").alias("best_score"),
        F.max("cumulative_time").alias("cumulative_time"),
        F.sum((~F.col("success")).cast("long")).alias("failures"),
    )


def method_standings(runs: DataFrame) -> DataFrame:
    """Per method over the current run standings (batch: applied to each micro-batch result)."""
    return runs.groupBy("method").agg(
        F.avg("best_score").alias("mean_best_score"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("trials").alias("trials"),
    )


def start_standings(spark: SparkSession, log_path: str, out_path: str, checkpoint: str,
                    available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Keep ``out_path/runs`` and ``out_path/methods`` (Parquet) current with the log.

    ``checkpoint`` must be on shared storage (streaming state and offsets survive a restart).
    """
    runs = run_standings(trial_stream(spark, log_path))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/runs")
        method_standings(batch).write.mode("overwrite").parquet(f"{out_path}/methods")

    w = runs.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
