"""Live standings follow appends to the trial log (two appends, availableNow triggers)."""

import tempfile

from pyspark.sql import functions as F

from tunesmith.plans.catalog_trials import trial_log
from tunesmith.sources.trial_log import append_trials, scan_trials
from tunesmith.streaming.standings import start_standings

from .conftest import SF001


def test_standings_follow_appends(spark):
    root = tempfile.mkdtemp(prefix="tunesmith-stream-", dir="/tmp")
    log, out, ckpt = f"{root}/log", f"{root}/out", f"{root}/ckpt"
    tl = trial_log(spark, SF001)
    append_trials(tl.where(F.col("iteration") < 3), log)
    start_standings(spark, log, out, ckpt).awaitTermination()
    first = {r["method"]: r["trials"] for r in spark.read.parquet(f"{out}/methods").collect()}
    append_trials(tl.where(F.col("iteration") >= 3), log)
    start_standings(spark, log, out, ckpt).awaitTermination()
    runs = spark.read.parquet(f"{out}/runs")
    assert runs.count() == tl.select("method", "task", "seed").distinct().count()
    want = {r["method"]: r["n"] for r in tl.groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["method"]: r["trials"] for r in spark.read.parquet(f"{out}/methods").collect()}
    assert got == want and all(first[m] < got[m] for m in first)
    best = {(r["method"], r["task"], r["seed"]): r["best_score"] for r in runs.collect()}
    exp = {(r["method"], r["task"], r["seed"]): r["b"] for r in
           tl.groupBy("method", "task", "seed").agg(F.max("best_score").alias("b")).collect()}
    assert best == exp
    # A filtered scan of the log prunes to one task partition
    assert scan_trials(spark, log, {"task": "1"}).where(F.col("task") != "1").count() == 0
