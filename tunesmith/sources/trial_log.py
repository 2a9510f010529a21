"""The trial log: one row per evaluated setting (S3 sink, S4 filtered scan).

The reference inserts one document per iteration into a document store and reads it back
with one query per (method, task, seed). Here the log is a Parquet table partitioned by
``task``; a filtered scan is a lazy ``spark.read.parquet(...).where(...)`` so Catalyst prunes
partitions, pushes the other predicates into the row-group statistics and reads only the
columns a query needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.sources.tables import table

TRIAL_LOG_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("seed", T.LongType()),
    T.StructField("iteration", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("best_score", T.DoubleType()),
    T.StructField("evaluation_time", T.DoubleType()),
    T.StructField("maximize_time", T.DoubleType()),
    T.StructField("cumulative_time", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("method_name", T.StringType()),
    T.StructField("time_regressor", T.StringType()),
    T.StructField("score_regressor", T.StringType()),
    # what a search needs to go on from its log; null in rows of other origin
    T.StructField("grid_id", T.LongType()),
    T.StructField("draw_seed", T.LongType()),
    T.StructField("draw", T.LongType()),
    T.StructField("phase", T.StringType()),
    T.StructField("model_ord", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

RUN_KEYS = ("method", "task", "seed")


def conform(df: DataFrame) -> DataFrame:
    """Select the trial-log columns in schema order, casting; missing optional columns become NULL."""
    cols = []
    for f in TRIAL_LOG_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_trials(trials: DataFrame, path: str) -> None:
    """S3: append trial rows to the log (one write per trial of a running search, or per batch)."""
    conform(trials).write.mode("append").partitionBy("task").parquet(path)


def log_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def compact_trials(spark: SparkSession, path: str, out: str) -> None:
    """The log once more at ``out``, with few files for each task instead of one for each trial."""
    spark.read.schema(TRIAL_LOG_SCHEMA).parquet(path).repartitionByRange("task", "method", "seed", "iteration") \
        .sortWithinPartitions("method", "seed", "iteration").write.partitionBy("task").parquet(out)


@dataclass(frozen=True)
class RunLog:
    """One run (method, task, seed) of the log at ``path``: each trial is appended when it ends, and read to go on."""

    path: str
    task: str
    method: str
    seed: int
    method_name: str = ""
    time_regressor: str = ""
    score_regressor: str = ""

    def append(self, spark: SparkSession, trials: list[dict]) -> None:
        """Rows given as {trial-log column: value}; the run's own columns are filled in."""
        own = dict(task=self.task, method=self.method, seed=int(self.seed), method_name=self.method_name,
                   time_regressor=self.time_regressor, score_regressor=self.score_regressor)
        rows = [tuple((own | t).get(f.name) for f in TRIAL_LOG_SCHEMA.fields) for t in trials]
        append_trials(spark.createDataFrame(rows, TRIAL_LOG_SCHEMA).coalesce(1), self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The run's stored trials; none where there is no log yet."""
        if not log_exists(spark, self.path):
            return spark.createDataFrame([], TRIAL_LOG_SCHEMA)
        return scan_trials(spark, self.path, {"task": self.task, "method": self.method, "seed": int(self.seed)})


def scan_trials(spark: SparkSession, path: str, where: Mapping[str, object] | None = None) -> DataFrame:
    """The log filtered by a key-equality document (``None`` = all rows), e.g. ``{"task": "12"}``."""
    df = spark.read.schema(TRIAL_LOG_SCHEMA).parquet(path)
    for k, v in (where or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    return df


# --------------------------------------------------------------------------------------
# Stand-in input for the driver tables: raw trials taken from `events` (FIXTURES.md).
# Only builds rows of the trial schema; running best, iteration and cumulative time are
# computed by operators.trials.record_trials, not here.

# Fixed mapping event_type -> benchmark configuration (method name, score model, time model),
# chosen for the fixture; the five configurations are those of the reference's multi-run harness.
FIXTURE_CONFIGS = [
    ("click", "RANDOMIZED", "gp", "gp"),
    ("error", "NORMAL", "gp", "gp"),
    ("purchase", "NORMAL", "forest", "gp"),
    ("signup", "EI_PER_SECOND", "forest", "linear"),
    ("view", "EI_PER_SECOND", "forest", "forest"),
]


def raw_trials_from_events(spark: SparkSession, sf_dir: str, more: Sequence[str] = ()) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("method"),
        (F.col("user_id") % 4).cast("string").alias("task"),
        (F.col("user_id") % 3).alias("seed"),
        "event_id",
        "ts",
        ((F.col("event_id") % 7) + 1).cast("double").alias("evaluation_time"),
        ((F.col("event_id") % 3).cast("double") / 4).alias("maximize_time"),
        F.when(F.col("event_id") % 17 == 0, F.lit(0.0)).otherwise(F.col("value") / (1 + F.col("value"))).alias("score"),
        (F.col("event_id") % 17 != 0).alias("success"),
        F.col("props"),
        *more,
    )


def fixture_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_CONFIGS, "event_type string, method_name string, score_regressor string, time_regressor string")
