"""Declarative model configs -> Spark ML pipelines.

A config names entries of a whitelist registry (``plans.spec``); settings use the parameter names that users know,
translated to Spark ML ``Params``. ``@preprocessor`` is a list of steps (names, or names with parameters; or null)
that come before the estimator.

Parameters without a Spark ML counterpart are listed in ``UNSUPPORTED`` and removed from the
searched space (``min_samples_split`` of the forest, ``dual`` of logistic regression).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import (PCA, OneHotEncoder, PolynomialExpansion, RobustScaler, StandardScaler, StringIndexer,
                                VectorAssembler, VectorSizeHint)

from tunesmith.operators.features import DualImputer
from tunesmith.plans.spec import decode_spec, plain, steps_of

SPARK_MAX_DEPTH = 30  # "no limit" in the reference; Spark ML rejects depth 31


def _rf(p: Mapping, seed: int) -> RandomForestClassifier:
    # cacheNodeIds / maxMemoryInMB only change how many tree nodes a pass splits (speed), not the model
    est = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed,
                                 cacheNodeIds=True, maxMemoryInMB=1024)
    if "n_estimators" in p:
        est.setNumTrees(int(p["n_estimators"]))
    if "criterion" in p:
        est.setImpurity(str(p["criterion"]))
    if "max_features" in p:
        est.setFeatureSubsetStrategy(repr(float(p["max_features"])))
    if "max_depth" in p:
        est.setMaxDepth(SPARK_MAX_DEPTH if p["max_depth"] is None else int(p["max_depth"]))
    if "min_samples_leaf" in p:
        est.setMinInstancesPerNode(int(p["min_samples_leaf"]))
    if "bootstrap" in p:
        est.setBootstrap(bool(p["bootstrap"]))
    return est


def _logreg(p: Mapping, seed: int) -> LogisticRegression:
    est = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0)
    if "C" in p:
        est.setRegParam(1.0 / float(p["C"]))
    return est


def _mlp(p: Mapping, seed: int, n_features: int = 0, n_classes: int = 2) -> MultilayerPerceptronClassifier:
    """Dense network; sigmoid hidden units, no dropout (Spark ML limits)."""
    size, n = int(p.get("layer_size", 100)), int(p.get("n_layers", 1))
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", seed=seed,
                                          layers=[n_features, *([size] * n), n_classes],
                                          maxIter=int(p.get("epochs", 5)) * 10)


ESTIMATORS = {
    "RandomForestClassifier": _rf,
    "LogisticRegression": _logreg,
    "NeuralNetwork": _mlp,
}
UNSUPPORTED = {
    "RandomForestClassifier": {"min_samples_split"},
    "LogisticRegression": {"dual", "penalty"},
}


@dataclass
class ModelConfig:
    """One model of a search: registry name and its finite parameter lists."""
    estimator: str
    params: dict
    init: dict = field(default_factory=dict)

    def searchable(self) -> dict:
        drop = UNSUPPORTED.get(self.estimator, set())
        return {k: v for k, v in self.params.items() if k not in drop}

    @classmethod
    def from_spec(cls, spec: Mapping | str) -> "ModelConfig":
        """The config of a JSON model spec."""
        estimator, params = decode_spec(spec)
        return cls(estimator.name, {k: plain(v) for k, v in params.items()}, dict(estimator.params))


@dataclass
class FeatureSpec:
    """Scalar numeric columns, categorical columns, vector columns (used as given) and the label."""
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    vectors: Mapping[str, int] = field(default_factory=dict)  # vector column -> size
    label: str = "label"
    row_id: str = "row_id"
    classes: Sequence[str] | None = None  # names of the label codes 0, 1, ..., if the label was text
    n_features: int = 0  # width of the assembled vector; needed by PCA (all components)

    def width(self) -> int:
        return self.n_features or (len(self.numeric) + len(self.categorical) + sum(self.vectors.values()))


def decode_value(text: str | None, vtype: str):
    """Inverse of operators.space.value_text."""
    if vtype == "none" or text is None:
        return None
    if vtype == "str":
        return text
    if vtype == "int":
        return int(text)
    if vtype == "float":
        return float(text)
    if vtype == "bool":
        return text == "true"
    return json.loads(text)


def _scaled(p: Mapping, spec: FeatureSpec, last: str, out: str):
    return [StandardScaler(inputCol=last, outputCol=out, withMean=bool(p.get("with_mean", True)), withStd=bool(p.get("with_std", True)))], out


def _robust(p: Mapping, spec: FeatureSpec, last: str, out: str):
    low, high = p.get("quantile_range", (25.0, 75.0))
    return [RobustScaler(inputCol=last, outputCol=out, withCentering=bool(p.get("with_centering", True)),
                         withScaling=bool(p.get("with_scaling", True)), lower=low / 100, upper=high / 100)], out


def _polynomial(p: Mapping, spec: FeatureSpec, last: str, out: str):
    return [PolynomialExpansion(inputCol=last, outputCol=out, degree=int(p.get("degree", 2)))], out


def _pca(p: Mapping, spec: FeatureSpec, last: str, out: str):
    k = int(p.get("n_components") or max(1, spec.width()))
    centred = f"{out}_centred"
    return [StandardScaler(inputCol=last, outputCol=centred, withMean=True, withStd=False), PCA(k=k, inputCol=centred, outputCol=out)], out


#: Steps on the assembled vector.
VECTOR_STEPS = {"StandardScaler": _scaled, "RobustScaler": _robust, "PolynomialFeatures": _polynomial, "PCA": _pca}


def build_pipeline(cfg: ModelConfig, setting: Mapping, spec: FeatureSpec, seed: int,
                   n_classes: int = 2) -> Pipeline:
    """``@preprocessor`` steps, then the estimator with the setting applied.

    DualImputer fills numeric columns with the median and categorical ones, before they are coded,
    with their most frequent value. Categorical columns then enter as value codes (StringIndexer; a
    missing or unseen value has a code of its own); OneHotEncoder expands the codes, where that code
    is all zeros; PCA keeps all components of the assembled vector.
    """
    setting = dict(setting)
    steps = steps_of(setting.pop("@preprocessor", None), "@preprocessor")
    by_name = {s.name: s.params for s in steps}
    stages = []
    if "DualImputer" in by_name:
        p = by_name["DualImputer"]
        stages.append(DualImputer(categorical=list(spec.categorical), numerical=list(spec.numeric),
                                  strategy_categorical=p.get("strategy_categorical", "most_frequent"),
                                  strategy_numerical=p.get("strategy_numerical", "median")))
    codes = [f"__code_{c}" for c in spec.categorical]
    for c, out in zip(spec.categorical, codes):
        stages.append(StringIndexer(inputCol=c, outputCol=out, handleInvalid="keep", stringOrderType="alphabetAsc"))
    cat_features = codes
    if "OneHotEncoder" in by_name and codes:
        onehot = [f"__ohe_{c}" for c in spec.categorical]
        # the indexer's code for unknown values is the last category: dropping it leaves zeros
        stages.append(OneHotEncoder(inputCols=codes, outputCols=onehot, dropLast=True, handleInvalid="error"))
        cat_features = onehot
    for v, size in spec.vectors.items():
        stages.append(VectorSizeHint(inputCol=v, size=size, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[*spec.numeric, *spec.vectors, *cat_features], outputCol="__assembled",
                                  handleInvalid="keep"))
    last = "__assembled"
    for k, step in enumerate(s for s in steps if s.name in VECTOR_STEPS):  # in the order given
        made, last = VECTOR_STEPS[step.name](step.params, spec, last, f"__step{k}")
        stages += made
    params = {**cfg.init, **setting}
    if cfg.estimator == "NeuralNetwork":
        est = _mlp(params, seed, spec.width(), n_classes)
    else:
        est = ESTIMATORS[cfg.estimator](params, seed)
    est.setFeaturesCol(last)
    stages.append(est)
    return Pipeline(stages=stages)
