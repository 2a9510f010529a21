"""Averaged step curves from changes equal the averages of curves written out point by point."""

import numpy as np
from pyspark.sql import functions as F

from tunesmith.operators import trials as T

SCHEMA = "method string, task string, seed long, iteration int, cumulative_time double, best_score double"


def random_log(spark, n=400):
    rng = np.random.default_rng(11)
    rows, state = [], {}
    for _ in range(n):
        key = (f"m{rng.integers(3)}", f"t{rng.integers(2)}", int(rng.integers(3)))
        i, t, s = state.get(key, (0, 0.0, -0.5))
        t, s = t + float(rng.exponential(3.0)), max(s, float(rng.normal(0.3, 0.2)))
        state[key] = (i + 1, t, s)
        rows.append((*key, i, t, s))
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_point_by_point(spark):
    log = random_log(spark)
    runs = log.select("method", "task", "seed").distinct().union(spark.createDataFrame([("m0", "t0", 99), ("m9", "t0", 0)], "method string, task string, seed long"))
    points, step = 45, 1.5
    got = {(r.method, r.p): r.score for r in T.averaged_curves(log, runs, points, step, "cumulative_time", "best_score").collect()}
    by_run = T.step_fill(log, runs, points, step)
    by_task = by_run.groupBy("method", "task", "p").agg(F.avg("score").alias("score"))
    want = {(r.method, r.p): r.score for r in by_task.groupBy("method", "p").agg(F.avg("score").alias("score")).collect()}
    assert got.keys() == want.keys() and len(got) == 4 * points
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_only_methods_are_written_out(spark):
    log = random_log(spark, 60)
    runs = log.select("method", "task", "seed").distinct()
    plan = T.averaged_curves(log, runs, 50, 1.0, "cumulative_time", "best_score")._jdf.queryExecution().optimizedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate explode(" in line]
    assert len(generates) == 1 and "task" not in generates[0].split("Generate")[1].split("], ")[-1]


def test_equal_scores_give_no_change(spark):
    log = spark.createDataFrame([("m", "t", 0, i, float(i), 0.5) for i in range(20)], SCHEMA)
    assert [(r.p, r.delta) for r in T.step_changes(log, 30, 1.0).collect()] == [(0, 0.5)]
