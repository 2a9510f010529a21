"""Specs decode into whitelisted stages, or fail with the place at which they go wrong."""

import json

import pytest
from pyspark.ml import Pipeline

from tunesmith.plans import spec as S
from tunesmith.plans.registry_ml import FeatureSpec, ModelConfig, build_pipeline

DI = ["extra.dual_imputer.DualImputer", {"strategy_numerical": "mean"}]
SPEC = {"estimator": ["sklearn.ensemble.RandomForestClassifier", {"random_state": 3}],
        "params": {"n_estimators": [2, 4], "max_depth": [2, None], "!@preprocessor": [None, DI, [DI, ["PCA", {"n_components": 2}]]]}}


def test_decode_and_rows():
    estimator, params = S.decode_spec(json.dumps(SPEC))
    di = S.Stage("DualImputer", {"strategy_numerical": "mean"})
    assert estimator == S.Stage("RandomForestClassifier", {"random_state": 3})
    assert params == {"n_estimators": [2, 4], "max_depth": [2, None], "@preprocessor": [None, di, [di, S.Stage("PCA", {"n_components": 2})]]}
    assert S.spec_rows(SPEC) == [
        ("$.estimator", "RandomForestClassifier", "random_state", "3"),
        ("$.params.n_estimators[0]", None, None, "2"), ("$.params.n_estimators[1]", None, None, "4"),
        ("$.params.max_depth[0]", None, None, "2"), ("$.params.max_depth[1]", None, None, "null"),
        ("$.params.@preprocessor[0]", None, None, "null"),
        ("$.params.@preprocessor[1]", "DualImputer", "strategy_numerical", '"mean"'),
        ("$.params.@preprocessor[2][0]", "DualImputer", "strategy_numerical", '"mean"'),
        ("$.params.@preprocessor[2][1]", "PCA", "n_components", "2")]


def test_prefixes():
    assert S.decode_params({"!a": ["PCA", {}], "b": ["PCA", {}]}) == {"a": S.Stage("PCA", {}), "b": ["PCA", {}]}
    assert set(S.decode_params({"!a": ["PCA", {}]}, remove_prefixes=False)) == {"!a"}
    assert S.decode_params({"?a": ["PCA", {}]}, prefix="?") == {"a": S.Stage("PCA", {})}
    assert S.decode_value([["PCA", {}], 3, [["PCA", {}]]]) == [S.Stage("PCA", {}), 3, [S.Stage("PCA", {})]]


def test_encode_is_the_inverse():
    for pair in (["PCA", {}], ["RobustScaler", {"quantile_range": [10, 90]}]):
        assert S.encode_stage(S.decode_source(*pair)) == pair
    assert S.encode_stage(S.decode_source("sklearn.decomposition.PCA", {})) == ["PCA", {}]


@pytest.mark.parametrize("bad, where", [
    ({"params": {}}, "$"),
    ({"estimator": "RandomForestClassifier"}, "$.estimator"),
    ({"estimator": ["os.system", {}]}, "$.estimator"),
    ({"estimator": ["PCA", {}]}, "$.estimator"),
    ({"estimator": ["RandomForestClassifier", {"trees": 3}]}, "$.estimator"),
    ({"estimator": ["RandomForestClassifier", {}], "params": {"!@preprocessor": [["Nope", {}]]}}, "$.params.@preprocessor[0]"),
    ({"estimator": ["RandomForestClassifier", {}], "params": {"!@preprocessor": [[["PCA", {"!x": {"a": 1}}]]]}}, "$.params.@preprocessor[0][0].x"),
    ({"estimator": ["RandomForestClassifier", {}], "params": {"n_estimators": []}}, "$.params.n_estimators"),
    ({"estimator": ["RandomForestClassifier", {}], "params": {"n_estimators": 8}}, "$.params.n_estimators"),
    ({"estimator": ["RandomForestClassifier", {}], "param": {}}, "$"),
    ({"estimator": ["RandomForestClassifier", {}], "params": {"a": [1], "!a": [1]}}, "$.params.a"),
])
def test_what_cannot_be_decoded_says_where(bad, where):
    with pytest.raises(S.SpecError) as e:
        S.decode_spec(bad)
    assert str(e.value).startswith(f"{where}:")


def test_a_bad_spec_fails_the_job(spark):
    df = spark.createDataFrame([(1, json.dumps(SPEC)), (2, '{"estimator": ["Nope", {}]}')], "k int, spec string")
    assert S.decoded(df.where("k = 1"), ["k"]).count() == 9
    with pytest.raises(Exception, match="unknown stage"):
        S.decoded(df, ["k"]).count()


def test_config_and_pipeline_of_a_spec(spark):
    cfg = ModelConfig.from_spec(SPEC)
    assert cfg.estimator == "RandomForestClassifier" and cfg.params["@preprocessor"][2] == [["DualImputer", {"strategy_numerical": "mean"}], ["PCA", {"n_components": 2}]]
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label double")
    features = FeatureSpec(numeric=["a", "b"])
    pipe = build_pipeline(cfg, {"n_estimators": 2, "max_depth": 2, "@preprocessor": cfg.params["@preprocessor"][2]}, features, 1)
    assert [type(s).__name__ for s in pipe.getStages()] == ["DualImputer", "VectorAssembler", "StandardScaler", "PCA", "RandomForestClassifier"]
    assert pipe.fit(df).transform(df).select("prediction").count() == 60
    order = build_pipeline(cfg, {"@preprocessor": ["DualImputer", ["PolynomialFeatures", {"degree": 3}], "RobustScaler"]}, features, 1).getStages()
    assert [type(s).__name__ for s in order] == ["DualImputer", "VectorAssembler", "PolynomialExpansion", "RobustScaler", "RandomForestClassifier"]


def test_a_search_is_a_stage(spark, tmp_path):
    from pyspark.ml.feature import SQLTransformer

    from tunesmith.plans.search import TunedClassifier
    rows = [(i, float(i % 9), float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, a double, label double")
    tuned = TunedClassifier(config={"estimator": "RandomForestClassifier", "params": {"n_estimators": [2, 3], "max_depth": [2]}},
                            features={"numeric": ["a", "twice"]}, options={"n_iter": 2, "random_search": True, "inner_cv": 2})
    pipe = Pipeline(stages=[SQLTransformer(statement="select *, a * 2 as twice from __THIS__"), tuned])
    pipe.write().overwrite().save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p"))
    model = again.fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert model.transform(df).select("prediction").count() == 80
