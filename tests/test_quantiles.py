"""Grouped exact quantiles equal numpy, whatever the groups look like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunesmith.operators.quantiles import ACCURACY, grouped_quantiles


def test_groups_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    rows = [(None if g == 2 else f"g{g}", int(rng.integers(0, 7)), float(rng.normal())) for g in range(5) for _ in range([1, 2, 400, 3, 6000][g])]
    rows += [("holes", None, float("nan")), ("holes", 4, None), ("empty", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, a int, b double")
    got = {(r.g, r.column, r.prob): r.value for r in grouped_quantiles(df, ["g"], ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, c in ((1, "a"), (2, "b")):
            v = [r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]]
            for p in (0.0, 0.25, 0.5, 0.9, 1.0):
                if v:
                    want[g, c, p] = np.quantile(v, p)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_many_rows_and_probabilities_without_groups(spark):
    df = spark.range(200_000).select((F.hash("id") % 100_003).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    x = np.array([r.x for r in df.select("x").collect()])
    got = {(r.column, r.prob): r.value for r in grouped_quantiles(df, [], ["x", "y"], [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got["x", p] == np.quantile(x, p)
    assert (got["y", 0.25], got["y", 0.5], got["y", 0.75]) == (0.0, 1.0, 2.0)


def test_a_group_of_ten_million_equal_values(spark):
    df = spark.range(10_000_000).select(F.lit("hot").alias("g"), F.lit(5.0).alias("x")).union(
        spark.range(1001).select(F.lit("small").alias("g"), F.col("id").cast("double").alias("x")))
    got = {r.g: r.value for r in grouped_quantiles(df, ["g"], ["x"], [0.5]).collect()}
    assert got == {"hot": 5.0, "small": 500.0}


def test_only_the_brackets_are_kept(spark, monkeypatch):
    from tunesmith import session
    kept = []
    real = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name="table": kept.append((name, out := real(df, name))) or out)
    df = spark.range(1_000_000).select(F.xxhash64("id").cast("double").alias("x"))
    grouped_quantiles(df, [], ["x"], [0.5]).collect()
    counts, = [t for n, t in kept if n == "quantile-counts"]
    assert counts.count() < 1_000_000 * 8 / ACCURACY


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert grouped_quantiles(df, ["g"], ["x"], [0.5]).count() == 0
    assert grouped_quantiles(df, [], ["x"], [0.5]).count() == 0
