"""Trial-log queries (plane P-C) over the `events`-backed trial log (FIXTURES.md).

Doubles are rounded to 6 decimals on both sides; means are rounded to 9 decimals before
ranking so floating noise cannot split ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.functions import readable as R
from tunesmith.operators import trials as T
from tunesmith.plans.registry import query
from tunesmith.session import materialize, rows_per_chunk
from tunesmith.sources.trial_log import FIXTURE_CONFIGS, RUN_KEYS, fixture_configs, raw_trials_from_events

D = 6  # output rounding

# ---- shared SQL (DuckDB) ------------------------------------------------------------------

RAW_SQL = """b AS (
  SELECT event_type AS method, CAST(user_id % 4 AS VARCHAR) AS task, user_id % 3 AS seed, event_id, ts,
         CAST(event_id % 7 + 1 AS DOUBLE) AS evaluation_time,
         CAST(event_id % 3 AS DOUBLE) / 4 AS maximize_time,
         CASE WHEN event_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE value / (1 + value) END AS score,
         event_id % 17 <> 0 AS success, props
  FROM events)"""

TRIAL_LOG_SQL = "WITH " + RAW_SQL + """,
trial_log AS (
  SELECT method, task, seed, event_id, success, score, evaluation_time, maximize_time, props,
         CAST(ROW_NUMBER() OVER w - 1 AS INT) AS iteration,
         MAX(score) OVER w AS best_score,
         MIN(evaluation_time) OVER w AS best_time,
         evaluation_time + maximize_time AS total_time,
         SUM(evaluation_time + maximize_time) OVER w AS cumulative_time
  FROM b
  WINDOW w AS (PARTITION BY method, task, seed ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _step_fill_sql(kept: str, runs: str, npoints_sql: str, step: float) -> str:
    """Union + LAST_VALUE IGNORE NULLS formulation of the as-of step fill (independent of the Spark plan)."""
    return f"""pts AS (
  SELECT method, task, seed, unnest(range(0, ({npoints_sql}))) AS p FROM {runs}),
ev AS (
  SELECT method, task, seed, p * {step!r} AS t, 1 AS is_point, CAST(NULL AS INT) AS iteration, CAST(NULL AS DOUBLE) AS s FROM pts
  UNION ALL
  SELECT method, task, seed, t, 0 AS is_point, iteration, s FROM {kept}),
filled AS (
  SELECT method, task, seed, t, is_point,
         LAST_VALUE(s IGNORE NULLS) OVER (PARTITION BY method, task, seed ORDER BY t, is_point, iteration
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
  FROM ev),
curve AS (SELECT method, task, seed, t, COALESCE(v, 0.0) AS score FROM filled WHERE is_point = 1),
seedavg AS (SELECT method, task, t, round(avg(score), 9) AS score FROM curve GROUP BY method, task, t),
taskavg AS (SELECT method, t, round(avg(score), 9) AS score FROM seedavg GROUP BY method, t)"""


# ---- Spark-side inputs --------------------------------------------------------------------

_LOGS: dict[tuple, DataFrame] = {}


def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trials from `events` numbered and tracked by the library (record_trials), written to the
    checkpoint folder like the stored log the sink produces: once for a source and session, for all queries."""
    key = (spark.sparkContext.applicationId, sf_dir, rows_per_chunk(spark))
    if key not in _LOGS:
        _LOGS[key] = materialize(T.record_trials(raw_trials_from_events(spark, sf_dir)), "trial-log")
    return _LOGS[key]


def labelled_trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log whose method is the benchmark label built from the run configuration."""
    tl = trial_log(spark, sf_dir).withColumnRenamed("method", "event_type")
    cfg = F.broadcast(fixture_configs(spark))  # 5 fixed rows
    tl = tl.join(cfg, "event_type", "inner")
    return tl.withColumn("method", R.method_label(F.col("method_name"), F.col("score_regressor"), F.col("time_regressor")))


def _r(c: str, d: int = D):
    return F.round(F.col(c), d).alias(c)


# ---- queries ------------------------------------------------------------------------------

LEADERBOARD_SQL = TRIAL_LOG_SQL + """,
mx AS (SELECT CAST(floor(max(cumulative_time)) AS BIGINT) AS m FROM trial_log),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method, task, seed ORDER BY iteration) AS rn FROM trial_log),
cut AS (SELECT method, task, seed, cumulative_time AS st FROM numbered WHERE rn = 5),
kept AS (SELECT n.method, n.task, n.seed, n.iteration, n.cumulative_time - c.st AS t, n.best_score AS s
         FROM numbered n JOIN cut c ON n.method = c.method AND n.task = c.task AND n.seed = c.seed WHERE n.rn > 5),
runs AS (SELECT DISTINCT method, task, seed FROM trial_log),
""" + _step_fill_sql("kept", "runs", "(SELECT m FROM mx) + 2", 1.0) + """,
ranked AS (
  SELECT method, t, score,
         CAST(rank() OVER (PARTITION BY t ORDER BY score DESC) AS DOUBLE)
           + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0 AS rank
  FROM taskavg)
SELECT method, t, round(score, 6) AS score, rank,
       round(avg(rank) OVER (PARTITION BY method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS avg_rank
FROM ranked"""


@query("leaderboard_ranked", LEADERBOARD_SQL)
def leaderboard_ranked(spark, sf_dir):
    """Flagship (T19): rank of each method over time, averaged ranks over time."""
    lb = T.leaderboard(trial_log(spark, sf_dir), step=1.0, startup=5)
    return lb.select("method", "t", _r("score"), "rank", _r("avg_rank"))


LOGWIDE_STEP = 5.0
LOGWIDE_SQL = TRIAL_LOG_SQL + f""",
mx AS (SELECT CAST(floor(max(cumulative_time)) AS BIGINT) AS m FROM trial_log),
kept AS (SELECT method, task, seed, iteration, cumulative_time AS t, best_score AS s FROM trial_log),
runs AS (SELECT DISTINCT method, task, seed FROM trial_log),
""" + _step_fill_sql("kept", "runs", f"CAST(ceil(((SELECT m FROM mx) + {LOGWIDE_STEP!r}) / {LOGWIDE_STEP!r}) AS BIGINT)", LOGWIDE_STEP) + """
SELECT method, t, round(score, 6) AS score FROM taskavg"""


@query("time_buckets_logwide", LOGWIDE_SQL)
def time_buckets_logwide(spark, sf_dir):
    out = T.time_buckets_logwide(trial_log(spark, sf_dir), step=LOGWIDE_STEP)
    return out.select("method", "t", _r("score"))


PIVOT_STEP = 10.0
_NAMES = [n for _, n in R.METHOD_DISPLAY_NAMES]
_CFG_VALUES = ", ".join(f"('{e}', '{m}', '{s}', '{t}')" for e, m, s, t in FIXTURE_CONFIGS)
_NAME_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in R.METHOD_DISPLAY_NAMES)
PIVOT_SQL = TRIAL_LOG_SQL + f""",
cfg(event_type, method_name, score_regressor, time_regressor) AS (VALUES {_CFG_VALUES}),
names(label, display_name) AS (VALUES {_NAME_VALUES}),
tl AS (
  SELECT n.display_name AS method, l.task, l.seed, l.iteration, l.cumulative_time, l.best_score
  FROM trial_log l JOIN cfg c ON l.method = c.event_type
  JOIN names n ON n.label = c.method_name || ' (EI: ' || c.score_regressor || ', RT: ' || c.time_regressor || ')'),
mx AS (SELECT CAST(floor(max(cumulative_time)) AS BIGINT) AS m FROM trial_log),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method, task, seed ORDER BY iteration) AS rn FROM tl),
cut AS (SELECT method, task, seed, cumulative_time AS st FROM numbered WHERE rn = 5),
kept AS (SELECT n.method, n.task, n.seed, n.iteration, n.cumulative_time - c.st AS t, n.best_score AS s
         FROM numbered n JOIN cut c ON n.method = c.method AND n.task = c.task AND n.seed = c.seed WHERE n.rn > 5),
runs AS (SELECT DISTINCT method, task, seed FROM tl),
""" + _step_fill_sql("kept", "runs", f"CAST(ceil(((SELECT m FROM mx) + 2 * {PIVOT_STEP!r}) / {PIVOT_STEP!r}) AS BIGINT)", PIVOT_STEP) + """
SELECT t, """ + ", ".join(f"round(max(CASE WHEN method = '{n}' THEN score END), 6) AS \"{n}\"" for n in _NAMES) + """
FROM taskavg GROUP BY t"""


@query("leaderboard_pivot", PIVOT_SQL)
def leaderboard_pivot(spark, sf_dir):
    """T17 + P9: per-method curves (per-run variant) under display names, one column per method."""
    log = labelled_trial_log(spark, sf_dir)
    max_time = log.agg(F.max("cumulative_time")).first()[0]
    named = R.rename_methods(log).drop("method").withColumnRenamed("display_name", "method")
    runs = named.select(*RUN_KEYS).distinct()
    kept = T.remove_startup(named, nr=5)
    avg = T.averaged_curves(kept, runs, T.n_points(max_time, PIVOT_STEP, "per_run"), PIVOT_STEP, "cumulative_time", "best_score", 9)
    wide = avg.groupBy("t").pivot("method", _NAMES).agg(F.max("score"))
    return wide.select("t", *[F.round(F.col(f"`{n}`"), D).alias(n) for n in _NAMES])


RUNNING_SQL = TRIAL_LOG_SQL + """
SELECT method, task, seed, iteration, round(score, 6) AS score, round(best_score, 6) AS best_score, best_time FROM trial_log"""


@query("running_best", RUNNING_SQL)
def running_best(spark, sf_dir):
    """Running max score and running min evaluation time per run."""
    return trial_log(spark, sf_dir).select("method", "task", "seed", "iteration", _r("score"), _r("best_score"), "best_time")


CUMTIME_SQL = TRIAL_LOG_SQL + """
SELECT method, task, seed, iteration, total_time, cumulative_time FROM trial_log"""


@query("cumulative_time", CUMTIME_SQL)
def cumulative_time(spark, sf_dir):
    """Total time per trial and its running sum."""
    return trial_log(spark, sf_dir).select("method", "task", "seed", "iteration", "total_time", "cumulative_time")


READABLE_SQL_EXPR = ("array_to_string(list_transform(json_keys(props), "
                     "lambda k: k || ' = ' || json_extract_string(props, '$.\"' || k || '\"')), ', ')")
CV_RESULTS_SQL = TRIAL_LOG_SQL + f"""
SELECT method, task, seed, iteration, {READABLE_SQL_EXPR} AS readable_params,
       round(score, 6) AS mean_test_score, evaluation_time, maximize_time, round(best_score, 6) AS best_score,
       total_time, cumulative_time
FROM trial_log"""


@query("cv_results", CV_RESULTS_SQL)
def cv_results(spark, sf_dir):
    """The results table of a search (readable setting, score, times, incumbent)."""
    tl = trial_log(spark, sf_dir)
    return tl.select(
        "method", "task", "seed", "iteration",
        R.readable_parameters(R.params_from_json(F.col("props"))).alias("readable_params"),
        F.round("score", D).alias("mean_test_score"), "evaluation_time", "maximize_time", _r("best_score"),
        "total_time", "cumulative_time")


BEST_TRIAL_SQL = TRIAL_LOG_SQL + """
SELECT method, task, seed, iteration, round(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY method, task, seed ORDER BY score DESC, iteration) AS rn FROM trial_log)
WHERE rn = 1"""


@query("best_trial", BEST_TRIAL_SQL)
def best_trial(spark, sf_dir):
    """First index of the best score per run."""
    return T.best_trial(trial_log(spark, sf_dir)).select(*RUN_KEYS, "iteration", _r("score"))


def _iteration_stats_sql(fn: str) -> str:
    cols = ", ".join(f"round({fn}({c}), 6) AS {c}" for c in T.NUMERIC_TRIAL_COLUMNS)
    return TRIAL_LOG_SQL + f"\nSELECT method, iteration, {cols} FROM trial_log GROUP BY method, iteration"


def _iteration_stats(statistic):
    def build(spark, sf_dir):
        st = T.iteration_stats(trial_log(spark, sf_dir), statistic)
        return st.select("method", "iteration", *[_r(c) for c in T.NUMERIC_TRIAL_COLUMNS])
    build.__doc__ = f"T8: {statistic} of every numeric column per (method, iteration)."
    return build


query("iteration_stats_mean", _iteration_stats_sql("avg"))(_iteration_stats("mean"))
query("iteration_stats_median", _iteration_stats_sql("median"))(_iteration_stats("median"))
query("iteration_stats_max", _iteration_stats_sql("max"))(_iteration_stats("max"))


RANK_ITER_SQL = TRIAL_LOG_SQL + """,
st AS (SELECT method, iteration, round(avg(score), 9) AS score, round(avg(best_score), 9) AS best_score
       FROM trial_log GROUP BY method, iteration)
SELECT method, iteration, round(score, 6) AS score, round(best_score, 6) AS best_score,
       CAST(rank() OVER (PARTITION BY iteration ORDER BY score) AS DOUBLE)
         + (count(*) OVER (PARTITION BY iteration, score) - 1) / 2.0 AS rank,
       CAST(rank() OVER (PARTITION BY iteration ORDER BY best_score) AS DOUBLE)
         + (count(*) OVER (PARTITION BY iteration, best_score) - 1) / 2.0 AS best_rank
FROM st"""


@query("rank_within_iteration", RANK_ITER_SQL)
def rank_within_iteration(spark, sf_dir):
    """Ascending rank (ties averaged) of the mean score / best score among methods per iteration."""
    st = T.iteration_stats(trial_log(spark, sf_dir), "mean", ["score", "best_score"])
    r = T.rank_within_iteration(st)
    return r.select("method", "iteration", _r("score"), _r("best_score"), "rank", "best_rank")


METHOD_CURVE_SQL = TRIAL_LOG_SQL + """,
st AS (SELECT method, iteration, avg(evaluation_time) AS evaluation_time, avg(best_score) AS best_score
       FROM trial_log GROUP BY method, iteration)
SELECT method, iteration,
       round(sum(evaluation_time) OVER (PARTITION BY method ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS cumulative_evaluation_time,
       round(best_score, 6) AS best_score
FROM st"""


@query("method_curve", METHOD_CURVE_SQL)
def method_curve(spark, sf_dir):
    """Per method, mean best score against cumulative mean evaluation time."""
    st = T.iteration_stats(trial_log(spark, sf_dir), "mean", ["evaluation_time", "best_score"])
    c = T.method_curve(st, x="cumulative_evaluation_time", y="best_score")
    return c.select("method", "iteration", _r("cumulative_evaluation_time"), _r("best_score"))


RUNNING_MEAN_SQL = TRIAL_LOG_SQL + """,
st AS (SELECT method, iteration, avg(evaluation_time) AS evaluation_time, avg(score) AS score
       FROM trial_log GROUP BY method, iteration)
SELECT method, iteration,
       round(sum(evaluation_time) OVER w, 6) AS cumulative_evaluation_time,
       round(avg(score) OVER w, 6) AS avg_score
FROM st
WINDOW w AS (PARTITION BY method ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("running_mean", RUNNING_MEAN_SQL)
def running_mean(spark, sf_dir):
    """Running mean of the per-iteration mean score, per method."""
    st = T.iteration_stats(trial_log(spark, sf_dir), "mean", ["evaluation_time", "score"])
    c = T.method_curve(st, x="cumulative_evaluation_time", y="score", averaged=True)
    return c.select("method", "iteration", _r("cumulative_evaluation_time"), _r("avg_score"))


STARTUP_SQL = TRIAL_LOG_SQL + """,
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method, task, seed ORDER BY iteration) AS rn FROM trial_log),
cut AS (SELECT method, task, seed, cumulative_time AS st FROM numbered WHERE rn = 5)
SELECT n.method, n.task, n.seed, n.iteration, n.cumulative_time - c.st AS cumulative_time, round(n.best_score, 6) AS best_score
FROM numbered n JOIN cut c ON n.method = c.method AND n.task = c.task AND n.seed = c.seed WHERE n.rn > 5"""


@query("startup_removed", STARTUP_SQL)
def startup_removed(spark, sf_dir):
    """Drop the first 5 trials of every run and re-base time on the 5th."""
    out = T.remove_startup(trial_log(spark, sf_dir), nr=5)
    return out.select(*RUN_KEYS, "iteration", "cumulative_time", _r("best_score"))


VALID_SQL = TRIAL_LOG_SQL + """
SELECT method, task, seed, iteration, round(score, 6) AS score FROM trial_log WHERE score <> 0"""


@query("valid_trials", VALID_SQL)
def valid_trials(spark, sf_dir):
    """Trials whose score differs from the timeout sentinel (0)."""
    return T.valid_trials(trial_log(spark, sf_dir), 0.0).select(*RUN_KEYS, "iteration", _r("score"))


@query("distinct_keys", TRIAL_LOG_SQL + "\nSELECT DISTINCT method, task, seed FROM trial_log")
def distinct_keys(spark, sf_dir):
    """Distinct (method, task, seed); needs no trial numbers, so it reads the raw trials."""
    return T.distinct_keys(raw_trials_from_events(spark, sf_dir))


@query("global_max_time", TRIAL_LOG_SQL + "\nSELECT max(cumulative_time) AS max_cumulative_time FROM trial_log")
def global_max_time(spark, sf_dir):
    """Max cumulative time over the log."""
    return T.global_max(trial_log(spark, sf_dir), "cumulative_time")


READABLE_PARAMS_SQL = "WITH " + RAW_SQL + f"""
SELECT method, task, seed, event_id, {READABLE_SQL_EXPR} AS readable_params,
       CAST(json_keys(props)[1] AS VARCHAR) AS first_param
FROM b"""


@query("readable_params", READABLE_PARAMS_SQL)
def readable_params(spark, sf_dir):
    """A stored setting (JSON) as a readable map and as a "k = v" string."""
    raw = raw_trials_from_events(spark, sf_dir)
    params = R.params_from_json(F.col("props"))
    return raw.select("method", "task", "seed", "event_id", R.readable_parameters(params).alias("readable_params"),
                      F.map_keys(params)[0].alias("first_param"))


METHOD_LABELS_SQL = f"""WITH cfg(event_type, method_name, score_regressor, time_regressor) AS (VALUES {_CFG_VALUES}),
names(label, display_name) AS (VALUES {_NAME_VALUES}),
used AS (SELECT DISTINCT event_type FROM events),
lab AS (SELECT c.method_name || ' (EI: ' || c.score_regressor || ', RT: ' || c.time_regressor || ')' AS method,
               c.method_name, c.score_regressor, c.time_regressor
        FROM cfg c JOIN used u ON c.event_type = u.event_type)
SELECT l.method, l.method_name, l.score_regressor, l.time_regressor, n.display_name
FROM lab l LEFT JOIN names n ON n.label = l.method"""


@query("method_labels", METHOD_LABELS_SQL)
def method_labels(spark, sf_dir):
    """Benchmark labels of the runs in the log and their display names (NULL when unlisted)."""
    log = labelled_trial_log(spark, sf_dir).select("method", "method_name", "score_regressor", "time_regressor").distinct()
    names = F.broadcast(R.display_names(spark).withColumnRenamed("method", "label"))
    return log.join(names, log["method"] == names["label"], "left").drop("label")


PARAM_COLUMNS_SQL = TRIAL_LOG_SQL + """
SELECT method, task, seed, iteration, json_extract_string(props, '$.k') AS param_k FROM trial_log"""


MAX_PARAM_COLUMNS = 2_000


@query("param_columns", PARAM_COLUMNS_SQL)
def param_columns(spark, sf_dir):
    """T5: one ``param_<name>`` column per parameter key present in the log (absent -> NULL)."""
    tl = trial_log(spark, sf_dir).withColumn("__params", R.params_from_json(F.col("props")))
    # the distinct parameter names become columns, so the driver has to know them; so many columns are the most
    names = tl.select(F.explode(F.map_keys("__params"))).distinct().limit(MAX_PARAM_COLUMNS + 1).collect()
    if len(names) > MAX_PARAM_COLUMNS:
        raise ValueError(f"over {MAX_PARAM_COLUMNS} parameter names; select them from the params map instead")
    keys = sorted(r[0] for r in names)
    return tl.select(*RUN_KEYS, "iteration", *[F.col("__params")[k].alias(f"param_{k}") for k in keys])


LOGWIDE_RANKED_SQL = LOGWIDE_SQL.rsplit("SELECT method, t, round(score, 6) AS score FROM taskavg", 1)[0] + """,
ranked AS (
  SELECT method, t, score,
         CAST(rank() OVER (PARTITION BY t ORDER BY score) AS DOUBLE)
           + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0 AS rank
  FROM taskavg)
SELECT method, t, round(score, 6) AS score, rank,
       round(avg(rank) OVER (PARTITION BY method ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS avg_rank
FROM ranked"""


@query("logwide_ranked", LOGWIDE_RANKED_SQL)
def logwide_ranked(spark, sf_dir):
    """T13 + T15-T18 + T11, log-wide report with ranking and averaging: curves without start-up
    removal, methods ranked ascending at each point (K10), then the running mean of the rank."""
    curves = T.time_buckets_logwide(trial_log(spark, sf_dir), step=LOGWIDE_STEP)
    curves = curves.withColumn("p", (F.col("t") / LOGWIDE_STEP).cast("long"))
    ranked = T.rank_methods(curves, ascending=True)
    smoothed = T.running_mean(ranked, "rank", "avg_rank")
    return smoothed.select("method", "t", _r("score"), "rank", _r("avg_rank"))


FILTERED_SQL = TRIAL_LOG_SQL + """,
st AS (SELECT method, iteration, avg(evaluation_time) AS evaluation_time, avg(best_score) AS best_score
       FROM trial_log WHERE task = '1' GROUP BY method, iteration)
SELECT method, iteration,
       round(sum(evaluation_time) OVER (PARTITION BY method ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS cumulative_evaluation_time,
       round(best_score, 6) AS best_score
FROM st"""


@query("filtered_curve", FILTERED_SQL)
def filtered_curve(spark, sf_dir):
    """S3 + S4 + P1 + T8/T10/T12: the log is appended through the sink (Parquet partitioned by
    task) under the checkpoint folder, read back with the filter document {"task": "1"} (partition
    pruning), and drawn as the per-method curve of mean best score vs cumulative evaluation time."""
    import uuid

    from tunesmith.session import ensure_checkpoint_dir
    from tunesmith.sources.trial_log import append_trials, scan_trials

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tunesmith-logs/log-{uuid.uuid4().hex}"
    append_trials(trial_log(spark, sf_dir), path)
    log = scan_trials(spark, path, {"task": "1"})
    st = T.iteration_stats(log, "mean", ["evaluation_time", "best_score"])
    c = T.method_curve(st, x="cumulative_evaluation_time", y="best_score")
    return c.select("method", "iteration", _r("cumulative_evaluation_time"), _r("best_score"))
