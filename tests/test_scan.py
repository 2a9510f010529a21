"""The chunked prefix scan equals a plain per-group window, for every kind, with many chunks."""

from pyspark.sql import functions as F

from tunesmith.operators.scan import plain_running, running
from tunesmith.sources.trial_log import raw_trials_from_events

from .conftest import SF01

def specs():
    return [
        ("rn", "count", None),
        ("best", "max", "score"),
        ("low", "min", "evaluation_time"),
        ("cum", "sum", "evaluation_time"),
        ("avg", "mean", "score"),
        ("last_ok", "last", F.when(F.col("event_id") % 5 == 0, F.col("score"))),
    ]


def _rows(df):
    return sorted(tuple(None if v is None else (round(v, 9) if isinstance(v, float) else v) for v in r)
                  for r in df.select("event_id", "rn", "best", "low", "cum", "avg", "last_ok").collect())


def test_chunked_equals_plain(spark):
    raw = raw_trials_from_events(spark, SF01)
    # a NULL group key must stay its own group
    raw = raw.withColumn("task", F.when(F.col("task") == "3", F.lit(None)).otherwise(F.col("task")))
    by = ["method", "task", "seed"]
    order = ["ts", "event_id"]
    chunked = running(raw, by, order, specs(), rows_per_chunk=13)
    plain = plain_running(raw, by, order, specs())
    assert _rows(chunked) == _rows(plain)


def test_single_global_group(spark):
    raw = raw_trials_from_events(spark, SF01)
    chunked = running(raw, [], ["event_id"], specs(), rows_per_chunk=500)
    plain = plain_running(raw.withColumn("g", F.lit(1)), ["g"], ["event_id"], specs())
    assert _rows(chunked) == _rows(plain)


def _chunks(spark, df, order, target):
    from tunesmith.operators.scan import _cut
    return [r["n"] for r in _cut(df, ["g"], order, target).groupBy("g", "__chunk").agg(F.count(F.lit(1)).alias("n")).collect()]


def test_no_key_fills_a_chunk(spark):
    rows = spark.range(40_000).withColumn("g", F.lit("hot"))
    keys = {
        "outlier": F.when(F.col("id") == 7, 1e300).otherwise(F.col("id").cast("double")),
        "null": F.lit(None).cast("double"),
        "nan": F.lit(float("nan")),
        "text": F.concat(F.lit("k"), F.col("id")),
        "skewed": F.when(F.col("id") % 10 > 0, 5.0).otherwise(F.col("id").cast("double")),
    }
    for name, key in keys.items():
        sizes = _chunks(spark, rows.withColumn("v", key), ["v"], 4_000)
        assert sum(sizes) == 40_000 and len(sizes) == 10 and max(sizes) <= 2 * 4_000, (name, sizes)


def test_small_groups_have_one_chunk(spark):
    rows = spark.range(900).withColumn("g", F.concat(F.lit("g"), F.col("id") % 9))
    assert _chunks(spark, rows, ["id"], 100) == [100] * 9


def test_rows_in_text_order(spark):
    rows = spark.range(3_000).select(F.md5(F.col("id").cast("string")).alias("t"), F.lit(1).alias("g"))
    got = running(rows, ["g"], ["t"], [("n", "count", None)], rows_per_chunk=250).collect()
    assert [r["t"] for r in sorted(got, key=lambda r: r["n"])] == sorted(r["t"] for r in got)
    assert sorted(r["n"] for r in got) == list(range(1, 3_001))
