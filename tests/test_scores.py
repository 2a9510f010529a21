"""Scores equal their definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunesmith.operators import scores
from tunesmith.plans.evaluation import scorer


def auc(positive, negative):
    """Share of pairs in the right order, ties as half."""
    return float(np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(positive, negative)]))


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        p = np.round(rng.dirichlet([1, 1, 1]), 1)  # many ties
        rows.append((float(rng.choice(3, p=[0.2, 0.5, 0.3])), float(np.argmax(p)), p.tolist()))
    return rows, spark.createDataFrame(rows, "label double, prediction double, probability array<double>")


def test_auc_of_every_class(spark, predictions):
    rows, df = predictions
    got = {r["class"]: r.auc for r in scores.auc_by_class(df, F.col("label"), F.col("probability")).collect()}
    want = {c: auc([p[c] for y, _, p in rows if y == c], [p[c] for y, _, p in rows if y != c]) for c in range(3)}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want)
    support = [sum(y == c for y, _, _ in rows) for c in range(3)]
    assert scorer("roc_auc_ovr", "label")(df) == pytest.approx(np.mean(list(want.values())))
    assert scorer("roc_auc_ovr_weighted", "label")(df) == pytest.approx(np.average([want[c] for c in range(3)], weights=support))


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(0.0, [0.5, None]), (0.0, [float("nan"), 0.1]), (None, [0.1, 0.2]), (0.0, None)], "label double, probability array<double>")
    got = {r["class"]: (r.positives, r.rows, r.auc) for r in scores.auc_by_class(df, F.col("label"), F.col("probability")).collect()}
    assert got == {0: (2, 2, None), 1: (0, 2, None)}
    with pytest.raises(ValueError):
        scores.mean_auc(df, "label")


def test_rates(predictions):
    rows, df = predictions
    y, z = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = {c: np.mean(y[z == c] == c) for c in range(3)}
    r = {c: np.mean(z[y == c] == c) for c in range(3)}
    f = {c: 2 * p[c] * r[c] / (p[c] + r[c]) for c in range(3)}
    n = [np.sum(y == c) for c in range(3)]
    want = {"accuracy": np.mean(y == z), "precision_macro": np.mean(list(p.values())), "recall_macro": np.mean(list(r.values())),
            "f1_macro": np.mean(list(f.values())), "f1_weighted": np.average(list(f.values()), weights=n), "f1_micro": np.mean(y == z),
            "balanced_accuracy": np.mean(list(r.values())), "precision": p[1], "recall": r[1], "f1": f[1]}
    for name, value in want.items():
        assert scorer(name, "label")(df) == pytest.approx(value), name


def test_every_name_is_a_scorer():
    assert all(callable(scorer(n, "label")) for n in scores.names())
    with pytest.raises(ValueError):
        scorer("no such", "label")
