"""Hand-computed cases (FIXTURES.md) for semantics an oracle would merely repeat."""

import math

import pytest
from pyspark.sql import functions as F

from tunesmith.functions import stats as S
from tunesmith.operators import features as FE
from tunesmith.operators import trials as T


def test_normal_cdf_against_erfc(spark):
    zs = [-8.0, -6.0, -5.6, -1.0, -0.5, 0.0, 0.3, 0.6629, 0.6630, 1.0, 5.7, 8.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(S.normal_cdf(F.col("z"))).collect()]
    for z, g in zip(zs, got):
        assert g == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-13)


def test_degenerate_sigma_gives_minus_one(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 1e-5), (0.5, 0.2)], "mu double, sigma double")
    got = [r[0] for r in df.select(S.expected_improvement(F.col("mu"), F.col("sigma"), 0.6)).collect()]
    assert got[0] == -1.0 and got[1] == -1.0
    d = 0.5 - (0.6 - 0.01)
    z = d / 0.2
    want = d * 0.5 * math.erfc(-z / math.sqrt(2)) + 0.2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    assert got[2] == pytest.approx(want, rel=1e-12)


def test_nonpositive_seconds_fall_back_to_min_time(spark):
    df = spark.createDataFrame([(1.0, -2.0), (1.0, 0.0), (1.0, 4.0)], "ei double, seconds double")
    got = [r[0] for r in df.select(S.ei_per_second(F.col("ei"), F.col("seconds"), 0.5)).collect()]
    assert got == [2.0, 2.0, 0.25]
    root = [r[0] for r in df.select(S.ei_per_second(F.col("ei"), F.col("seconds"), 0.25, root=True)).collect()]
    assert root == [2.0, 2.0, 0.5]


def test_average_tie_rank(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 2.0)], "p int, v double")
    got = sorted(r[0] for r in df.select(S.avg_tie_rank("v", ["p"], ascending=True)).collect())
    assert got == [1.5, 1.5, 3.0]


def test_step_fill_hand_case(spark):
    trials = spark.createDataFrame([("m", "t", 0, 0, 1.0, 0.5), ("m", "t", 0, 1, 3.0, 0.7)],
                                   "method string, task string, seed long, iteration int, cumulative_time double, best_score double")
    runs = trials.select("method", "task", "seed").distinct()
    out = T.step_fill(trials, runs, 5, 1.0).orderBy("p").select("score").collect()
    assert [r[0] for r in out] == [0.0, 0.5, 0.5, 0.7, 0.7]


def test_startup_removal_runs_of_4_5_6(spark):
    rows = []
    for n, task in [(4, "a"), (5, "b"), (6, "c")]:
        for i in range(n):
            rows.append(("m", task, 0, i, float(i + 1) * 2, 0.1 * i))
    df = spark.createDataFrame(rows, "method string, task string, seed long, iteration int, cumulative_time double, best_score double")
    out = {r["task"]: r for r in T.remove_startup(df, nr=5).collect()}
    assert set(out) == {"c"}  # 4 -> nothing (K14), 5 -> nothing, 6 -> one row
    assert out["c"]["iteration"] == 5 and out["c"]["cumulative_time"] == pytest.approx(12.0 - 10.0)


def test_mode_tie_and_median(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (2.0,), (2.0,), (9.0,)], "x double")
    assert FE.fill_values(df, ["x"], "most_frequent") == {"x": 2.0}
    df2 = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert FE.fill_values(df2, ["x"], "median") == {"x": 2.5}
    q = {r["prob"]: r["value"] for r in FE.exact_quantiles(df2, ["x"], [0.25, 0.75]).collect()}
    assert q == {0.25: 1.75, 0.75: 4.75}  # numpy linear interpolation


def test_dual_imputer_keeps_order_and_types(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, 7, None), (None, 7, 1.0), (2, 1, 2.0)], "a int, b int, c double")
    out = FE.DualImputer(categorical=["a", "b"], numerical=["c"]).fit(df).transform(df)
    assert out.columns == ["a", "b", "c"]
    assert [tuple(r) for r in out.collect()] == [(1, 7, 3.0), (2, 7, 2.0), (2, 7, 1.0), (2, 1, 2.0)]


def test_stratified_fold_sizes(spark):
    df = spark.range(0, 103).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    f = FE.stratified_folds(df, "label", 4, ["id"])
    sizes = f.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in sizes:
        by_label.setdefault(r["label"], []).append(r["count"])
    for counts in by_label.values():
        assert len(counts) == 4 and max(counts) - min(counts) <= 1


def test_readable_values_of_null_and_booleans(spark):
    from tunesmith.functions import readable as R
    df = spark.createDataFrame([('{"a":"1","max_depth":null,"bootstrap":true,"name":"true","l":[1,null]}',)], "p string")
    text = df.select(R.readable_parameters(R.params_from_json(F.col("p")))).first()[0]
    assert text == 'a = 1, max_depth = None, bootstrap = True, name = true, l = [1,null]'
    vals = spark.createDataFrame([("x", "str"), ("true", "bool"), (None, "none"), ("null", "none"), ("0.5", "float")], "v string, t string")
    assert [r[0] for r in vals.select(R.python_str(F.col("v"), F.col("t"))).collect()] == ["x", "True", "None", "None", "0.5"]


def test_startup_removal_keeps_runs_with_null_keys(spark):
    rows = [("m", None, 0, i, float(i + 1), 0.1) for i in range(7)]
    df = spark.createDataFrame(rows, "method string, task string, seed long, iteration int, cumulative_time double, best_score double")
    out = T.remove_startup(df, nr=5)
    assert out.columns == df.columns and sorted(r["cumulative_time"] for r in out.collect()) == [1.0, 2.0]


def test_dual_imputer_on_strings_saves_and_loads(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0), ("a", 5.0), ("b", 2.0)], "s string, x double")
    model = Pipeline(stages=[FE.DualImputer(categorical=["s"], numerical=["x"])]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [tuple(r) for r in again.transform(df).collect()] == [("b", 1.0), ("a", 2.5), ("a", 3.0), ("a", 5.0), ("b", 2.0)]


def test_labelled_table_types(spark):
    import datetime
    from tunesmith.sources.features import labelled_table
    df = spark.createDataFrame([(1, True, datetime.date(1970, 1, 3), datetime.datetime(1970, 1, 1, 0, 1), "no"),
                                (2, False, None, None, "yes")], "id long, flag boolean, d date, t timestamp, y string")
    out, spec = labelled_table(df, "y", "id")
    assert spec.numeric == ["flag", "d", "t"] and spec.classes == ["no", "yes"]
    first = out.orderBy("row_id").first()
    assert (first["flag"], first["d"], first["t"], first["label"]) == (1.0, 2.0, 60.0, 0.0)


def test_dictionary_of_five_million_categories(spark):
    df = spark.range(5_000_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"))
    dictionary = FE.categories(df, ["c"])
    st = dictionary.agg(F.count(F.lit(1)), F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(st) == (5_000_000, 0, 4_999_999, 5_000_000)
    few = df.where("id % 1000003 = 5")
    ones = FE.one_hot_sparse(few, ["id"], ["c"], dictionary).collect()
    place = {r["value"]: r["position"] for r in dictionary.where(F.col("value").isin([f"v{r['id']}" for r in ones])).collect()}
    assert len(ones) == 5 and all(place[f"v{r['id']}"] == r["position"] for r in ones)
    # positions follow the order of the values
    assert [r["value"] for r in dictionary.where("position < 4").orderBy("position").collect()] == ["v0", "v1", "v10", "v100"]


def test_one_hot_of_unknown_and_missing_values(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "b")], "k int, c string")
    dictionary = FE.categories(fit, ["c"])
    assert sorted((r["k"], r["column"], r["position"]) for r in FE.one_hot_sparse(df, ["k"], ["c"], dictionary).collect()) == [(1, "c", 0), (4, "c", 1)]
    dense = sorted((r["k"], r["feature"], r["value"]) for r in FE.one_hot_long(df, ["k"], ["c"], dictionary).collect())
    assert dense == [(k, f"c={v}", 1.0 if (k, v) in ((1, "a"), (4, "b")) else 0.0) for k in (1, 2, 3, 4) for v in "ab"]
