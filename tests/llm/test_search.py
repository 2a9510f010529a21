import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("id", T.StringType()), T.StructField("score", T.StringType())])


def brute(rows, k):
    vectors = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        vectors.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for q in {i for i, _ in vectors if i % 20 == 0}:  # all rows of an id ask together; every row of another id is a candidate
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for asks, a in vectors if asks == q for i, b in vectors if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, **more)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_rows_that_share_an_id_are_candidates_each(spark):
    rows = [(20, [1.0]), (7, [5.0]), (7, [2.0]), (7, [2.0])]
    assert run(spark, rows) == [(20, 1, 7, 64 * 320), (20, 2, 7, 64 * 128), (20, 3, 7, 64 * 128)] == brute(rows, 5)


def test_against_brute_force_over_many_ranges_and_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(900)]  # many ties
    rows += [(5, None), (None, [1.0] * 6), (901, [float("nan")] * 6), (902, [float("inf")] + [0.0] * 5), (903, [None] * 6),
             (904, []), (906, [1.0]), *rows[:40]]
    assert run(spark, rows, range_rows=150, query_rows=16) == brute(rows, 5)


def test_few_candidates_and_empty_table(spark):
    assert run(spark, [(0, [1.0]), (20, [2.0])]) == [(0, 1, 20, 64 * 128), (20, 1, 0, 64 * 128)]
    assert run(spark, []) == []


def test_blocks_whose_bound_is_too_low_are_skipped():
    d = np.zeros((1000, 4), np.int64)
    d[:10] = 100
    ids = np.arange(1000)
    (q, i, s), scored = topk.search_range(np.array([-1]), np.ones((1, 4), np.int64), ids, d, 5, block_rows=10)
    assert i.tolist() == [0, 1, 2, 3, 4] and scored == 1


def test_large_weights_stay_exact():
    d = np.array([[1 << 30, 1], [1 << 30, 0]], np.int64)
    (q, i, s), _ = topk.search_range(np.array([-1]), np.array([[1 << 30, 1]], np.int64), np.array([7, 8]), d, 2)
    assert s.tolist() == [(1 << 60) + 1, 1 << 60] and i.tolist() == [7, 8]
