"""Trial-log analytics: running best, cumulative time, start-up removal, time buckets,
seed/task averages, ranks and running means (SURVEY P1-P4, S5, S6, E7, T1-T19).

All operators take and return DataFrames. Runs are identified by ``RUN_KEYS``
(method, task, seed). Nothing is collected except scalar bounds (the global max time).
Prefix computations go through ``operators.scan.running`` so a hot run is split into
chunks instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunesmith.functions.stats import avg_tie_rank
from tunesmith.operators.quantiles import grouped_quantiles, pivoted
from tunesmith.operators.scan import running
from tunesmith.session import materialize
from tunesmith.sources.trial_log import RUN_KEYS

NUMERIC_TRIAL_COLUMNS = ("score", "best_score", "evaluation_time", "maximize_time", "cumulative_time")


# ---- T1-T4, E7: per-trial bookkeeping --------------------------------------------------

def record_trials(raw: DataFrame, order: Sequence[str] = ("ts", "event_id"), by: Sequence[str] = RUN_KEYS,
                  timeout_sentinel: bool = True) -> DataFrame:
    """Number the trials of each run and add the incumbent columns.

    iteration        0-based position in ``order``
    best_score       running max of ``score`` (failed trials count with their score, as in the
                     reference's sentinel mode, K7)
    best_time        running min of ``evaluation_time`` (E7)
    total_time       maximize_time + evaluation_time (missing maximise time = 0, T2/T4)
    cumulative_time  running sum of total_time (T3)
    """
    df = raw.withColumn("maximize_time", F.coalesce(F.col("maximize_time"), F.lit(0.0)))
    df = df.withColumn("total_time", F.col("evaluation_time") + F.col("maximize_time"))
    score = F.col("score") if timeout_sentinel else F.when(F.col("success"), F.col("score"))
    out = running(df, by, list(order), [
        ("__rn", "count", None),
        ("best_score", "max", score),
        ("best_time", "min", "evaluation_time"),
        ("cumulative_time", "sum", "total_time"),
    ])
    return out.withColumn("iteration", (F.col("__rn") - 1).cast("int")).drop("__rn")


def valid_trials(df: DataFrame, timeout_score: float | None = 0.0) -> DataFrame:
    """Drop timed-out trials. ``timeout_score=None`` uses the ``success`` flag instead of the
    sentinel (a genuine score equal to the sentinel is then kept, K6)."""
    if timeout_score is None:
        return df.where(F.col("success"))
    return df.where(F.col("score") != F.lit(float(timeout_score)))


def remove_startup(df: DataFrame, nr: int = 5, time_col: str = "cumulative_time", by: Sequence[str] = RUN_KEYS,
                   order: str = "iteration", recalculate_time: bool = True) -> DataFrame:
    """Drop the first ``nr`` trials of each run (by ``order``) and, optionally, subtract the
    time of the ``nr``-th trial from the remaining ones. Runs with fewer than ``nr`` trials keep
    no rows (K14)."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(F.col(order), F.col(time_col))
    # row_number() <= nr is planned as a partial WindowGroupLimit: only nr rows per run and
    # map partition reach the shuffle, so a hot run costs nothing here.
    head = df.select(*by, order, time_col).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= nr)
    cut = head.where(F.col("__rn") == nr).select(
        *[F.col(c).alias(f"__cut_{c}") for c in by], F.col(order).alias("__cut_order"), F.col(time_col).alias("__cut_time"))
    same_run = [F.col(c).eqNullSafe(F.col(f"__cut_{c}")) for c in by]  # a NULL key names a run like any other
    out = df.join(cut, on=same_run, how="inner").where(
        F.struct(F.col(order), F.col(time_col)) > F.struct(F.col("__cut_order"), F.col("__cut_time"))) \
        .drop(*[f"__cut_{c}" for c in by])
    if recalculate_time:
        out = out.withColumn(time_col, F.col(time_col) - F.col("__cut_time"))
    return out.drop("__cut_order", "__cut_time")


def distinct_keys(df: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Distinct key combinations (methods; tasks of a method; seeds of a task)."""
    return df.select(*keys).distinct()


def global_max(df: DataFrame, col: str = "cumulative_time") -> DataFrame:
    """Max of a time key over the (filtered) log, as an aggregate rather than sort+limit."""
    return df.agg(F.max(col).alias(f"max_{col}"))


def best_trial(df: DataFrame, by: Sequence[str] = RUN_KEYS) -> DataFrame:
    """First trial with the maximum score per run (ties -> smallest iteration).
    ``max_by`` is partially aggregated map-side, so a hot run is one small state per task."""
    key = F.struct(F.col("score"), (-F.col("iteration")).alias("neg_it"))
    return df.groupBy(*by).agg(
        F.max_by(F.col("iteration"), key).alias("iteration"),
        F.max("score").alias("score"),
    )


# ---- T8-T12: per-iteration statistics ---------------------------------------------------

def iteration_stats(df: DataFrame, statistic: str = "mean", columns: Sequence[str] = NUMERIC_TRIAL_COLUMNS,
                    by: Sequence[str] = ("method", "iteration")) -> DataFrame:
    """Group by (method, iteration) and take mean / median / max of every numeric column. Medians are exact and
    keep no group in one buffer."""
    if statistic == "median":
        found = pivoted(grouped_quantiles(df, by, columns, [0.5]), by, columns)
        # groups whose columns are all missing have no quantile
        groups = df.select(*by).distinct()
        same = [F.col(f"g.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
        return groups.alias("g").join(found.alias("q"), same, "left").select(*[f"g.{c}" for c in by], *[f"q.{c}" for c in columns])
    fn = {"mean": F.avg, "max": F.max}[statistic]
    return df.groupBy(*by).agg(*[fn(c).alias(c) for c in columns])


def rank_within_iteration(stats: DataFrame, digits: int = 9) -> DataFrame:
    """Ascending rank with averaged ties of best_score and score among methods per iteration.
    Values are rounded to ``digits`` first so floating noise cannot split ties."""
    r = stats.withColumn("__bs", F.round("best_score", digits)).withColumn("__s", F.round("score", digits))
    r = r.withColumn("best_rank", avg_tie_rank("__bs", ["iteration"], ascending=True))
    r = r.withColumn("rank", avg_tie_rank("__s", ["iteration"], ascending=True))
    return r.drop("__bs", "__s")


def method_curve(stats: DataFrame, x: str = "cumulative_evaluation_time", y: str = "best_score",
                 averaged: bool = False) -> DataFrame:
    """Per method, in iteration order: cumulative evaluation time (T10) and, when
    ``averaged``, the running mean of ``y`` (T11). Emits (method, iteration, x, y)."""
    specs = [("cumulative_evaluation_time", "sum", "evaluation_time")]
    if averaged:
        specs.append(("avg_" + y, "mean", y))
    out = running(stats, ["method"], ["iteration"], specs)
    ycol = "avg_" + y if averaged else y
    return out.select("method", "iteration", F.col(x).alias(x), F.col(ycol).alias(ycol))


# ---- T13-T19: time buckets and the leaderboard ------------------------------------------

def bucket_index(t: Column, step: float) -> Column:
    """Smallest p >= 0 with p*step >= t: the first time point at which a trial at time t counts."""
    s = F.lit(float(step))
    b0 = F.ceil(t / s)
    b = (F.when((b0 > 0) & ((b0 - 1) * s >= t), b0 - 1)
         .when(b0 * s < t, b0 + 1)
         .otherwise(b0))
    return F.greatest(b, F.lit(0)).cast("long")


def n_points(max_time: float, step: float, rule: str = "per_run") -> int:
    """Number of time points (K13): per-run path ``arange(0, int(max)+2*step, step)``,
    log-wide path ``arange(0, max+step, step)``."""
    import math
    end = int(max_time) + 2 * step if rule == "per_run" else max_time + step
    return max(0, math.ceil(end / step - 1e-12))


def step_fill(trials: DataFrame, runs: DataFrame, npoints: int, step: float, time_col: str = "cumulative_time",
              score_col: str = "best_score", by: Sequence[str] = RUN_KEYS, order: str = "iteration") -> DataFrame:
    """T13/T14 as-of step fill: for every run in ``runs`` and point p in [0, npoints), the score of
    the last trial (by time, then ``order``) with time <= p*step, else 0.

    1. Trials are reduced to the last one per (run, bucket) with a partially aggregated
       ``max_by`` (map-side combine): a run keeps <= npoints rows however many trials it has.
    2. Each run gets a score-0 row at p = 0 (ranked below a real trial in bucket 0).
    3. ``lead(p)`` over a run's bucket rows (bounded by npoints) gives the span each bucket row
       holds, and ``explode(sequence(p, next - 1))`` emits the points: no points grid, no join.
    """
    by = list(by)
    b = trials.select(*by, bucket_index(F.col(time_col), step).alias("p"), time_col, order, score_col)
    b = b.where(F.col("p") < npoints)
    last = b.groupBy(*by, "p").agg(
        F.max_by(F.col(score_col), F.struct(F.col(time_col), F.col(order))).alias("score")
    ).withColumn("__prio", F.lit(1))
    start = runs.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("p"), F.lit(0.0).alias("score"),
                                               F.lit(0).alias("__prio"))
    rows = last.unionByName(start)
    w = Window.partitionBy(*by).orderBy("p", "__prio")  # <= npoints + 1 rows per run
    spans = rows.withColumn("__end", F.coalesce(F.lead("p").over(w), F.lit(npoints).cast("long")))
    spans = spans.where(F.col("__end") > F.col("p"))
    pts = spans.select(*by, "score", F.explode(F.sequence(F.col("p"), F.col("__end") - 1)).alias("p"))
    return pts.select(*by, "p", (F.col("p") * F.lit(float(step))).alias("t"), "score")


def step_changes(trials: DataFrame, npoints: int, step: float, time_col: str = "cumulative_time", score_col: str = "best_score",
                 by: Sequence[str] = RUN_KEYS, order: str = "iteration") -> DataFrame:
    """(by..., p, delta): the changes of every run's step curve (T13/T14), which starts at 0: one row for each point at
    which the score of the last trial so far differs from the one before."""
    by = list(by)
    b = trials.select(*by, bucket_index(F.col(time_col), step).alias("p"), time_col, order, score_col).where(F.col("p") < npoints)
    last = b.groupBy(*by, "p").agg(F.max_by(F.col(score_col), F.struct(F.col(time_col), F.col(order))).alias("score"))
    return curve_changes(last, by)


def curve_changes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., p, delta) of step curves given by their values (by..., p, score); at most one row a point of the horizon."""
    before = F.lag("score", 1, 0.0).over(Window.partitionBy(*by).orderBy("p"))
    return points.select(*by, "p", (F.coalesce("score", F.lit(0.0)) - F.coalesce(before, F.lit(0.0))).alias("delta")).where("delta <> 0")


def mean_curve(changes: DataFrame, members: DataFrame, by: Sequence[str], digits: int | None = None) -> DataFrame:
    """(by..., p, score): the mean of the step curves of each group, at the points where one of them changes.

    Changes of all members are added up by point and then along the points; the mean divides by the group's number of
    ``members`` (by..., more), those without any change included.
    """
    by = list(by)
    size = members.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__members"))
    sums = changes.groupBy(*by, "p").agg(F.sum("delta").alias("delta"))
    total = running(sums, by, ["p"], [("total", "sum", "delta")])
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    score = F.col("total") / F.col("__members")
    out = total.alias("s").join(size.alias("m"), same).select(*[f"s.{c}" for c in by], "p", score.alias("score"))
    return out.withColumn("score", F.round("score", digits)) if digits else out


def along_points(curves: DataFrame, members: DataFrame, by: Sequence[str], npoints: int, step: float) -> DataFrame:
    """(by..., p, t, score): the curves at every point of the horizon, 0 before their first one."""
    by = list(by)
    start = members.select(*by).distinct().select(*by, F.lit(-1).cast("long").alias("p"), F.lit(0.0).alias("score"))
    spans = curves.select(*by, "p", "score").unionByName(start)
    until = F.coalesce(F.lead("p").over(Window.partitionBy(*by).orderBy("p")), F.lit(npoints).cast("long"))
    spans = spans.select(*by, "score", F.greatest("p", F.lit(0).cast("long")).alias("from"), until.alias("until")).where("until > from")
    points = spans.select(*by, F.explode(F.sequence(F.col("from"), F.col("until") - 1)).alias("p"), "score")
    return points.select(*by, "p", (F.col("p") * F.lit(float(step))).alias("t"), "score")


def averaged_curves(trials: DataFrame, runs: DataFrame, npoints: int, step: float, time_col: str, score_col: str,
                    digits: int | None = None) -> DataFrame:
    """(method, p, t, score): per method the mean over tasks of the mean over seeds of the runs' step curves.

    All is done on changes: only the methods' curves are written out point by point.
    """
    task_runs = runs.select("method", "task", "seed")
    tasks = runs.select("method", "task")
    by_task = mean_curve(step_changes(trials, npoints, step, time_col, score_col), task_runs, ["method", "task"], digits)
    by_method = mean_curve(curve_changes(by_task, ["method", "task"]), tasks, ["method"], digits)
    return along_points(by_method, runs.select("method"), ["method"], npoints, step)


def rank_methods(curves: DataFrame, ascending: bool = False) -> DataFrame:
    """Rank methods at every time point; ties averaged. ``ascending=False`` = best is 1
    (per-run path); the log-wide report ranks ascending (K10)."""
    return curves.withColumn("rank", avg_tie_rank("score", ["p"], ascending=ascending))


def running_mean(df: DataFrame, value: str, out: str, by: Sequence[str] = ("method",), order: str = "p") -> DataFrame:
    """Mean of the first i+1 values in ``order``."""
    return running(df, list(by), [order], [(out, "mean", value)])


def leaderboard(trials: DataFrame, step: float = 1.0, startup: int = 5, time_key: str = "cumulative_time",
                score_key: str = "best_score", digits: int = 9) -> DataFrame:
    """T19 flagship: start-up removal -> changes of each run's step curve -> seed mean -> task mean -> rank
    (best = 1, ties averaged) -> running mean of the rank. Emits (method, t, score, rank, avg_rank).

    The time horizon is the global max of ``time_key`` over the whole log (before start-up
    removal), as in the reference; it is the one scalar pulled to the driver.
    """
    max_time = trials.agg(F.max(time_key)).first()[0]
    if max_time is None:
        return trials.sparkSession.createDataFrame([], "method string, t double, score double, rank double, avg_rank double")
    npts = n_points(max_time, step, "per_run")
    runs = trials.select(*RUN_KEYS).distinct()
    kept = remove_startup(trials, nr=startup, time_col=time_key)
    # methods x points rows: bounded by the horizon, cheap to write, read twice below
    by_method = materialize(averaged_curves(kept, runs, npts, step, time_key, score_key, digits), "method-curves")
    ranked = rank_methods(by_method, ascending=False)
    smoothed = running_mean(ranked, "rank", "avg_rank")
    return smoothed.select("method", "t", "score", "rank", "avg_rank")


def time_buckets_logwide(trials: DataFrame, step: float = 1.0, time_key: str = "cumulative_time",
                         score_key: str = "best_score", digits: int = 9) -> DataFrame:
    """T13 + T15-T17 (log-wide variant): no start-up removal, horizon int(max time), points
    [0, max+step); absent task/seed combinations are skipped (K11). Emits (method, t, score)."""
    max_time = trials.agg(F.max(time_key)).first()[0]
    if max_time is None:
        return trials.sparkSession.createDataFrame([], "method string, t double, score double")
    npts = n_points(float(int(max_time)), step, "logwide")
    runs = trials.select(*RUN_KEYS).distinct()
    return averaged_curves(trials, runs, npts, step, time_key, score_key, digits).select("method", "t", "score")
