"""Search loop behaviour on sf0.001: timeouts are captured, incumbents are monotone, refit predicts."""

from pyspark.sql import functions as F

from tunesmith.plans.catalog_search import document_data, embedding_data, live_config
from tunesmith.plans.registry_ml import ModelConfig
from tunesmith.plans.evaluation import in_order, run_with_limit
from tunesmith.plans.search import Method, ModelSearch, MultiModelSearch, Search, benchmark

from .conftest import SF001


def test_timeout_cancels_job_group(spark):
    slow = spark.range(0, 10**12).select(F.sum(F.sqrt("id")))
    ok, value, err = run_with_limit(spark, lambda: slow.first(), 2.0)
    assert not ok and err == "timeout"
    ok, value, err = run_with_limit(spark, lambda: spark.range(10).count(), 30.0)  # later groups run normally
    assert ok and value == 10


def test_evaluation_failure_scores_sentinel(spark):
    df, spec = embedding_data(spark, SF001)
    cfg = ModelConfig("RandomForestClassifier", {"n_estimators": [4], "max_depth": [3]})
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=1, random_search=True, n_classes=10, max_eval_time=0.01).setup(df)
    t = s.evaluate(0)
    assert not t.success and t.score == 0.0 and t.evaluation_time == 0.01


def test_benchmark_run_invariants(spark):
    df, spec = document_data(spark, SF001)
    cfg = live_config(spark, df, spec)
    assert len(cfg.params["@preprocessor"]) == 3  # missing + categorical -> [DI], [DI, OHE], [DI, PCA]
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=2, n_classes=2, draw_samples=20)
    rows = benchmark(s, df, Method.EI_PER_SECOND, seed=1, starting_points=2, task="docs",
                     score_regressor="forest", time_regressor="linear").orderBy("iteration").collect()
    assert [r["iteration"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["method"] == "EI_PER_SECOND (EI: forest, RT: linear)"
    best = [r["best_score"] for r in rows]
    cum = [r["cumulative_time"] for r in rows]
    assert best == sorted(best) and cum == sorted(cum)
    assert best[-1] == max(r["score"] for r in rows)
    assert len({tuple(sorted(r["params"].items())) for r in rows[2:]}) == 2  # Bayesian picks untried settings


def test_refit_and_predict(spark):
    df, spec = embedding_data(spark, SF001)
    cfg = ModelConfig("RandomForestClassifier", {"n_estimators": [8, 16], "max_depth": [3, 5]})
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=2, random_search=True, n_classes=10).fit(df)
    out = s.predict(df)
    assert {"prediction", "probability"} <= set(out.columns) and out.count() == df.count()


def test_neural_network_config(spark):
    """The network entry of the registry fits and scores through the same CV path."""
    df, spec = embedding_data(spark, SF001)
    cfg = ModelConfig("NeuralNetwork", {"layer_size": [16], "n_layers": [1], "epochs": [2]})
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=1, random_search=True, n_classes=10).setup(df)
    t = s.evaluate(0)
    assert t.success and 0.0 <= t.score <= 1.0


def test_grid_sample_is_seeded_and_untried(spark):
    from tunesmith.plans.registry import QUERIES, load_all
    load_all()
    a = [r["grid_id"] for r in QUERIES["grid_sample"](spark, SF001).collect()]
    b = [r["grid_id"] for r in QUERIES["grid_sample"](spark, SF001).collect()]
    assert a == b and len(set(a)) == len(a) == 150


def test_multi_model_fit_predict(spark):
    """Two models, preparation then EI-driven rounds; refit best predicts."""
    df, spec = embedding_data(spark, SF001)
    configs = [ModelConfig("RandomForestClassifier", {"n_estimators": [4, 8], "max_depth": [3, 5]}),
               ModelConfig("LogisticRegression", {"C": [0.1, 1.0]})]
    m = MultiModelSearch(configs, spec, n_rounds=1, inner_cv=3, n_prep_rounds=1, n_classes=10).fit(df)
    res = m.cv_results(spark).collect()
    assert len(res) == 3 and {r["param_model"] for r in res[:2]} == {"RandomForestClassifier", "LogisticRegression"}
    out = m.predict(df)
    assert {"prediction", "probability"} <= set(out.columns) and out.count() == df.count()


def small_search(spark, **more):
    df, spec = embedding_data(spark, SF001)
    cfg = ModelConfig("RandomForestClassifier", {"n_estimators": [2, 3], "max_depth": [2, 3]})
    return df, ModelSearch(cfg, spec, inner_cv=2, n_classes=10, **more)


def planted(search, values):
    """Replaces the evaluation by given scores, so that a test needs no model fits."""
    search.objective = lambda grid_id, setting: values(grid_id)


def test_folds_read_the_stored_table(spark):
    df, s = small_search(spark)
    s.setup(df)
    assert s.cv.data is s.data and "Window" not in s.data._jdf.queryExecution().executedPlan().toString()


def test_predefined_splits_do_not_leak(spark):
    from tunesmith.operators.features import predefined_splits
    df, s = small_search(spark)
    splits = predefined_splits(df, "row_id", F.col("row_id") % 4, 4)
    s.setup(df, splits)
    assert s.cv.folds == [0, 1, 2, 3]
    for f in s.cv.folds:
        train, test = s.cv.sides(f)
        a, b = ({r["row_id"] for r in x.select("row_id").collect()} for x in (train, test))
        assert not a & b and len(a) + len(b) == df.count() and all(i % 4 == f for i in b)


def test_random_search_goes_on_where_it_stopped(spark):
    df, s = small_search(spark)
    s.setup(df)
    planted(s, lambda g: 0.1 * g)
    s.run_random(2, seed=7)
    s.run_random(2, seed=7)
    assert sorted(t.grid_id for t in s.trials) == [0, 1, 2, 3]


def test_used_up_grid_ends_the_search_and_nothing_is_tried_twice(spark):
    df, s = small_search(spark)
    s.setup(df)
    planted(s, lambda g: 0.2 + 0.1 * g)
    s.run_random(1)
    s.run_bayesian(10)
    assert sorted(t.grid_id for t in s.trials) == [0, 1, 2, 3]
    assert s.maximize() is None


def test_unknown_scorer_is_an_error_at_setup(spark):
    import pytest
    df, s = small_search(spark, scoring="no_such_metric")
    with pytest.raises(ValueError):
        s.setup(df)
    df, s = small_search(spark, scoring=lambda pred, label: pred.count() * 1.0)
    s.setup(df)
    assert s.evaluate(0).score > 1


def test_text_labels_come_back_in_predictions(spark):
    from tunesmith.sources.features import labelled_table
    raw = spark.createDataFrame([(i, float(i % 2), "yes" if i % 2 else "no") for i in range(40)], "id long, x double, y string")
    df, spec = labelled_table(raw, "y", "id")
    cfg = ModelConfig("RandomForestClassifier", {"n_estimators": [3], "max_depth": [2]})
    s = ModelSearch(cfg, spec, inner_cv=2, n_iter=1, random_search=True).fit(df)
    assert {(r["x"], r["predicted_label"]) for r in s.predict(df).collect()} == {(0.0, "no"), (1.0, "yes")}
    assert s.cv_results().first()["mean_test_score"] == 1.0


# ---- settings side by side ---------------------------------------------------------------------

def test_in_order_is_bounded_lazy_and_in_order():
    import threading
    import time
    now, most, lock, given = [0], [0], threading.Lock(), []

    def task(k):
        def run():
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.3 if k == 0 else 0.02)
            with lock:
                now[0] -= 1
            return k
        given.append(k)
        return run

    out = in_order((task(k) for k in range(40)), 3)
    assert next(out) == 0 and len(given) <= 8  # an endless generator would do
    assert list(out) == list(range(1, 40)) and most[0] == 3


def test_a_failing_task_is_raised_at_its_turn():
    import pytest

    def bad():
        raise KeyError("x")

    out = in_order([lambda: 1, bad, lambda: 3], 2)
    assert next(out) == 1
    with pytest.raises(KeyError):
        next(out)


def test_cancelling_one_setting_leaves_the_others(spark):
    def objective(grid_id, setting):
        if grid_id == 5:  # far over the limit, on one core: Spark does not take running tasks back
            return float(spark.range(0, 10**12, 1, 1).select(F.sum(F.sqrt("id"))).first()[0])
        return float(spark.range(0, 3_000_000).where(F.col("id") % 7 == grid_id % 7).count() % 1000) / 1000

    from tunesmith.operators import space as G
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(8))}), "m")
    s = Search(objective=objective, random_search=True, n_iter=8, parallel=4, max_eval_time=4.0).open(spark, sp).run()
    assert [t.draw for t in s.trials] == list(range(8)) and sorted(t.grid_id for t in s.trials) == list(range(8))
    assert [t.grid_id for t in s.trials if not t.success] == [5]
    late, = [t for t in s.trials if t.grid_id == 5]
    assert late.error == "timeout" and late.evaluation_time == 4.0 and late.score == 0.0


def test_an_evaluation_that_does_not_end_does_not_hold_up_the_search(spark):
    import time
    began = time.time()
    ok, _, error = run_with_limit(spark, lambda: time.sleep(30), 0.2, grace=1.0)
    assert not ok and error == "timeout" and time.time() - began < 5


def test_settings_side_by_side_are_faster(spark):
    from tunesmith.operators import space as G
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(16))}), "m")
    # a setting's jobs use one of eight cores, as small fits do
    data = spark.range(0, 300_000, 1, 1)

    def objective(grid_id, setting):
        total = 0
        for k in range(5):
            total += data.select(F.sum(F.crc32(F.sha2(F.concat("id", F.lit(grid_id)), 512).cast("binary")))).first()[0]
        return float(total % 1000)

    import time
    took, scores = {}, {}
    for parallel in (1, 4):
        s = Search(objective=objective, random_search=True, n_iter=16, parallel=parallel).open(spark, sp)
        began = time.time()
        s.run()
        took[parallel] = time.time() - began
        scores[parallel] = [(t.grid_id, t.score, t.best_score) for t in s.trials]
    assert scores[1] == scores[4] and took[4] * 2 <= took[1]


# ---- searches that go on from their log ------------------------------------------------------------

def part_space_of(spark, n=60):
    from tunesmith.operators import space as G
    return G.load_space(G.space_from_dict(spark, "m", {"a": list(range(n // 6)), "b": list(range(6))}), "m")


def bumpy(grid_id, setting):
    return round(1 - (setting["a"] - 6) ** 2 / 100 - (setting["b"] - 2) ** 2 / 25 + (grid_id % 3) / 50, 6)


class Killed(Exception):
    pass


def search_on(spark, log, stop_after=None, **more):
    """A search that is killed when its trial number ``stop_after`` ends, before that is stored."""
    calls = []

    def objective(grid_id, setting):
        calls.append(grid_id)
        return bumpy(grid_id, setting)

    s = Search(objective=objective, seed=3, parallel=1, **more).open(spark, part_space_of(spark), log)
    if stop_after is not None:
        stored = s.record

        def record(found, *args, **about):
            if len(s.trials) == stop_after:
                raise Killed
            return stored(found, *args, **about)
        s.record = record
    return s


def picks(s):
    return [(t.iteration, t.grid_id, t.score, t.best_score, t.phase) for t in s.trials]


def test_a_killed_search_goes_on_with_the_same_picks(spark, tmp_path):
    import pytest

    from tunesmith.sources.trial_log import RunLog, compact_trials, scan_trials
    options = dict(n_iter=4, random_search=False, local_search=False)
    whole = search_on(spark, None, **options)
    whole.run(starting_points=4, start_seed=11)
    for k in (2, 6):  # among the starting points, and among the steps of the model
        log = RunLog(str(tmp_path / f"log{k}"), "task", "method", 11)
        first = search_on(spark, log, k, **options)
        with pytest.raises(Killed):
            first.run(starting_points=4, start_seed=11)
        again = search_on(spark, log, **options)
        assert len(again.trials) == k and again.current_best_score == max(t.score for t in first.trials)
        again.run(starting_points=4, start_seed=11)
        assert picks(again) == picks(whole)
        assert [r["iteration"] for r in log.rows(spark).orderBy("iteration").collect()] == list(range(8))
        # a search that is done does nothing more
        third = search_on(spark, log, **options)
        third.run(starting_points=4, start_seed=11)
        assert picks(third) == picks(whole)
    out = str(tmp_path / "few")
    compact_trials(spark, log.path, out)
    assert scan_trials(spark, out).count() == 8
    # another run of the same log is not this one
    assert RunLog(log.path, "task", "method", 12).rows(spark).count() == 0


def test_a_stored_run_counts_its_time(spark, tmp_path):
    from tunesmith.sources.trial_log import RunLog
    log = RunLog(str(tmp_path / "log"), "t", "m", 1)
    s = search_on(spark, log, n_iter=3, random_search=True, max_run_time=100.0)
    s.run()
    spent = sum(t.evaluation_time for t in s.trials)
    again = search_on(spark, log, n_iter=3, random_search=True, max_run_time=spent / 2)
    assert again._remaining() < 0
    again.run_random(2)
    assert len(again.trials) == 3


def test_multi_model_trace_goes_on(spark, tmp_path):
    df, spec = embedding_data(spark, SF001)
    configs = [ModelConfig("RandomForestClassifier", {"n_estimators": [2, 3], "max_depth": [2, 3]}),
               ModelConfig("LogisticRegression", {"C": [0.1, 1.0]})]
    options = dict(inner_cv=2, n_prep_rounds=1, n_classes=10, seed=5)
    whole = MultiModelSearch(configs, spec, n_rounds=1, **options).fit(df, refit=False)
    path = str(tmp_path / "log")
    MultiModelSearch(configs, spec, n_rounds=0, **options).fit(df, refit=False, log_path=path)  # ends after the preparation
    again = MultiModelSearch(configs, spec, n_rounds=1, **options).fit(df, refit=False, log_path=path)
    assert [(k, t.grid_id, t.score, p) for k, t, p in again.trace] == [(k, t.grid_id, t.score, p) for k, t, p in whole.trace]
    stored = again.log.rows(spark).orderBy("iteration").collect()
    assert [r["iteration"] for r in stored] == [0, 1, 2] and stored[-1]["best_score"] == again.global_best_score


# ---- the surrogate earns its keep ---------------------------------------------------------------------

def test_bayesian_search_beats_random_search_on_a_planted_optimum(spark):
    """SURVEY section 5, item 5: median best score over ten seeds, same number of trials."""
    from statistics import median

    from tunesmith.operators import space as G
    sp = G.load_space(G.space_from_dict(spark, "m", {"a": list(range(30)), "b": list(range(30))}), "m")

    def objective(grid_id, setting):
        return 1.0 - ((setting["a"] - 21) / 30) ** 2 - ((setting["b"] - 7) / 30) ** 2

    best = {True: [], False: []}
    for seed in range(10):
        for random in (True, False):
            s = Search(objective=objective, seed=seed, n_iter=4, random_search=random, parallel=1, timeout_score=-1.0).open(spark, sp)
            s.run(starting_points=8, start_seed=100 + seed)
            best[random].append(s.best_trial().score)
    assert median(best[False]) > median(best[True])
