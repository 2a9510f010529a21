"""Surrogate invariants: forest mu equals the model prediction, sigma is not identically 0,
and mis-paired leaf indices break the identity (negative control)."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tunesmith.operators import space as G
from tunesmith.operators import surrogate as M


def _history(spark):
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(8)), "b": list(range(6))}), "m")
    grid = G.enumerate_grid(spark, sp)
    feats = grid.withColumn("features", array_to_vector(F.transform("ix", lambda x: x.cast("double"))))
    hist = feats.withColumn("label", F.sin(F.col("grid_id").cast("double")) + (F.col("grid_id") % 5) * 0.1)
    return sp, feats, hist


def test_forest_mu_sigma_invariants(spark):
    sp, grid, hist = _history(spark)
    model = M.forest_regressor(num_trees=20, max_depth=6, min_instances=2).fit(hist)
    scorer = M.ForestScorer(model)
    pred = model.transform(grid).select("grid_id", "prediction")
    j = scorer.mu_sigma(grid).join(pred, "grid_id")
    assert j.count() == sp.size
    assert j.agg(F.max(F.abs(F.col("mu") - F.col("prediction")))).first()[0] < 1e-9
    assert j.agg(F.max("sigma")).first()[0] > 0
    # negative control: mis-paired leaf indices break mu == prediction
    start, mean, square = scorer.shared.value
    scorer.shared = spark.sparkContext.broadcast((start, np.roll(mean, 1), np.roll(square, 1)))
    wrong = scorer.mu_sigma(grid).join(pred, "grid_id")
    assert wrong.agg(F.max(F.abs(F.col("mu") - F.col("prediction")))).first()[0] > 1e-3


def test_forest_scoring_is_map_only(spark):
    _, grid, hist = _history(spark)
    scorer = M.ForestScorer(M.forest_regressor(num_trees=5, max_depth=3).fit(hist))
    plan = scorer.mu_sigma(grid)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_time_models_fit(spark):
    _, grid, hist = _history(spark)
    lm = M.time_model("linear").fit(hist)
    assert lm.transform(grid).count() == grid.count()


def test_extra_trees_mu_sigma(spark):
    sp, grid, hist = _history(spark)
    model = M.fit_score_surrogate("extra forest", hist, "label")
    ms = model.mu_sigma(grid)
    assert ms.count() == sp.size
    lo, hi = hist.agg(F.min("label"), F.max("label")).first()
    st = ms.agg(F.min("mu"), F.max("mu"), F.max("sigma")).first()
    assert lo - 1e-9 <= st[0] and st[1] <= hi + 1e-9 and st[2] > 0


def test_gaussian_process_interpolates(spark):
    sp, grid, hist = _history(spark)
    small = hist.where(F.col("grid_id") % 4 == 0)
    model = M.fit_score_surrogate("gp", small, "label")
    at_train = model.mu_sigma(small).join(small.select("grid_id", "label"), "grid_id")
    err = at_train.agg(F.max(F.abs(F.col("mu") - F.col("label"))), F.max("sigma")).first()
    assert err[0] < 1e-3 and err[1] < 1e-3
    away = model.mu_sigma(grid.where(F.col("grid_id") % 4 == 1)).agg(F.max("sigma")).first()[0]
    assert away > 1e-3


def test_adaboost_time_model(spark):
    _, grid, hist = _history(spark)
    model = M.fit_time_surrogate("adaboost", hist, "label")
    pred = model.predict(grid, "grid_id", "seconds")
    lo, hi = hist.agg(F.min("label"), F.max("label")).first()
    st = pred.agg(F.count("seconds"), F.min("seconds"), F.max("seconds")).first()
    assert st[0] == grid.count() and lo - 1e-9 <= st[1] and st[2] <= hi + 1e-9


def test_boxes_give_the_leaves_of_the_trees(spark, monkeypatch):
    sp, grid, hist = _history(spark)
    scorer = M.ForestScorer(M.forest_regressor(num_trees=30, max_depth=8, min_instances=1).fit(hist))
    assert scorer.boxes is not None
    by_boxes = {r["grid_id"]: (r["mu"], r["sigma"]) for r in scorer.mu_sigma(grid).collect()}
    scorer.boxes = None
    by_trees = {r["grid_id"]: (r["mu"], r["sigma"]) for r in scorer.mu_sigma(grid).collect()}
    assert by_boxes == by_trees and len(by_boxes) == sp.size
    # values between and beyond the splits, and equal to them
    odd = grid.select("grid_id", F.transform("ix", lambda x: x + F.when(F.col("grid_id") % 3 == 0, 0.5).when(F.col("grid_id") % 3 == 1, -20.0).otherwise(0.0)).alias("v"))
    odd = odd.withColumn("features", array_to_vector("v"))
    again = M.ForestScorer(scorer.model)
    got = {r["grid_id"]: r["mu"] for r in again.mu_sigma(odd).collect()}
    want = {r["grid_id"]: r["prediction"] for r in scorer.model.transform(odd).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(M, "BOX_WORDS", 0)
    assert M.ForestScorer(scorer.model).boxes is None


def test_a_forest_of_stumps_without_a_split(spark):
    _, grid, hist = _history(spark)
    flat = hist.withColumn("label", F.lit(0.25))
    scorer = M.ForestScorer(M.forest_regressor(num_trees=3).fit(flat))
    assert {(r["mu"], r["sigma"]) for r in scorer.mu_sigma(grid).collect()} == {(0.25, 0.0)}


def test_adaboost_losses(spark):
    from tunesmith.operators.boosting import AdaBoostR2
    _, grid, hist = _history(spark)
    for loss in ("linear", "square", "exponential"):
        model = AdaBoostR2(n_estimators=12, loss=loss).fit(hist)
        err = model.predict(hist).join(hist, "grid_id").agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
        assert len(model.trees) >= 2 and err < 0.5


def test_a_held_history_is_computed_once_by_its_own_tasks(spark):
    """The history's plan ran twice, and a second time as a whole inside the task of the one partition."""
    ran = spark.sparkContext.accumulator(0)

    def where(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "task": pa.array([TaskContext.get().partitionId()] * b.num_rows, pa.int32())})

    hist = spark.range(100).repartition(4).mapInArrow(where, "id long, task int")
    kept = M.held(hist)
    assert kept.rdd.getNumPartitions() == 1
    assert sorted(r["id"] for r in kept.collect()) == list(range(100))
    assert kept.select("task").distinct().count() == 4
    assert ran.value == 100
    kept.unpersist()
