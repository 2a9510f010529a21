"""Declarative specs of models and preprocessing: JSON trees -> whitelisted Spark ML stages.

A spec names stages by a pair ``[source, {params}]``. Values are decoded where the key starts with a prefix (``!``): a pair becomes
a stage, a list is decoded item by item (lists may nest), anything else stays as it is. Params of a pair are decoded by the
same rules, so stages may hold stages. Sources are names of the registry below, or dotted paths of the library that users come
from, which stand for them. Nothing is imported or executed by name: what the registry does not know is an error.

    {"estimator": ["RandomForestClassifier", {"seed": 1}],
     "params": {"n_estimators": [8, 16], "!@preprocessor": [null, [["DualImputer", {}], ["PCA", {}]]]}}
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PREFIX = "!"

# Stage names with the parameters that they take.
STAGES = {
    "DualImputer": ("categorical", "numerical", "strategy_categorical", "strategy_numerical"),
    "OneHotEncoder": ("categorical_features", "handle_unknown", "sparse"),
    "StandardScaler": ("with_mean", "with_std"),
    "RobustScaler": ("with_centering", "with_scaling", "quantile_range"),
    "PCA": ("n_components",),
    "PolynomialFeatures": ("degree",),
    "RandomForestClassifier": ("n_estimators", "criterion", "max_features", "max_depth", "min_samples_split", "min_samples_leaf",
                               "bootstrap", "n_jobs", "random_state"),
    "LogisticRegression": ("C", "dual", "penalty", "n_jobs", "random_state"),
    "NeuralNetwork": ("layer_size", "n_layers", "epochs", "random_state"),
}

# Dotted paths that stand for stages.
ALIASES = {
    "extra.dual_imputer.DualImputer": "DualImputer",
    "sklearn.preprocessing.OneHotEncoder": "OneHotEncoder",
    "sklearn.preprocessing.StandardScaler": "StandardScaler",
    "sklearn.preprocessing.RobustScaler": "RobustScaler",
    "sklearn.preprocessing.PolynomialFeatures": "PolynomialFeatures",
    "sklearn.decomposition.PCA": "PCA",
    "sklearn.ensemble.RandomForestClassifier": "RandomForestClassifier",
    "sklearn.linear_model.LogisticRegression": "LogisticRegression",
}

ESTIMATOR_STAGES = ("RandomForestClassifier", "LogisticRegression", "NeuralNetwork")


class SpecError(ValueError):
    """A spec that cannot be decoded, with the path at which it goes wrong."""

    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")


@dataclass(frozen=True)
class Stage:
    """A decoded pair."""

    name: str
    params: Mapping

    def plain(self):
        """The JSON form: the name alone where there are no params."""
        return self.name if not self.params else [self.name, {k: plain(v) for k, v in self.params.items()}]


def plain(value):
    if isinstance(value, Stage):
        return value.plain()
    return [plain(v) for v in value] if isinstance(value, list) else value


def is_pair(value) -> bool:
    return isinstance(value, (list, tuple)) and len(value) == 2 and isinstance(value[0], str) and isinstance(value[1], Mapping)


def stage_name(source: str, path: str = "$") -> str:
    """The registry's name of a source."""
    name = ALIASES.get(source, source)
    if name not in STAGES:
        raise SpecError(path, f"unknown stage {source!r}; known: {', '.join(STAGES)}")
    return name


def decode_source(source: str, params: Mapping, path: str = "$", prefix: str = PREFIX) -> Stage:
    name = stage_name(source, path)
    decoded = decode_params(params, path, prefix)
    if unknown := sorted(set(decoded) - set(STAGES[name])):
        raise SpecError(path, f"{name} has no parameter {', '.join(unknown)}; known: {', '.join(STAGES[name])}")
    return Stage(name, decoded)


def decode_value(value, path: str = "$", prefix: str = PREFIX):
    """What stands under a prefixed key."""
    if is_pair(value):
        return decode_source(value[0], value[1], path, prefix)
    if isinstance(value, (list, tuple)):
        return [decode_value(v, f"{path}[{i}]", prefix) for i, v in enumerate(value)]
    if isinstance(value, Mapping):
        raise SpecError(path, "an object that no source names")
    return value


def decode_params(params: Mapping, path: str = "$", prefix: str = PREFIX, remove_prefixes: bool = True) -> dict:
    """``params`` with the values of prefixed keys decoded; prefixes are removed from the keys if ``remove_prefixes``."""
    if not isinstance(params, Mapping):
        raise SpecError(path, "parameters must be an object")
    out = {}
    for key, value in params.items():
        special = key.startswith(prefix)
        name = key[len(prefix):] if special and remove_prefixes else key
        if name in out:
            raise SpecError(f"{path}.{name}", "given twice")
        out[name] = decode_value(value, f"{path}.{key[len(prefix):] if special else key}", prefix) if special else value
    return out


def decode_spec(spec: Mapping | str) -> tuple[Stage, dict]:
    """(estimator, {parameter: its finite list of values}) of a model spec; values of prefixed parameters are stages."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec, Mapping) or "estimator" not in spec:
        raise SpecError("$", "a model spec has an estimator")
    if unknown := sorted(set(spec) - {"estimator", "params"}):
        raise SpecError("$", f"unknown key {', '.join(unknown)}")
    if not is_pair(spec["estimator"]):
        raise SpecError("$.estimator", "must be a pair of source and parameters")
    estimator = decode_source(*spec["estimator"], path="$.estimator")
    if estimator.name not in ESTIMATOR_STAGES:
        raise SpecError("$.estimator", f"{estimator.name} is no estimator")
    params = decode_params(spec.get("params") or {}, "$.params")
    for key, values in params.items():
        if not isinstance(values, list) or not values:
            raise SpecError(f"$.params.{key}", "a searched parameter needs a list of values")
    return estimator, params


def steps_of(item, path: str = "$") -> list[Stage]:
    """The stages of one ``@preprocessor`` value, in either form: null, a stage or name, or a list of them."""
    if item is None:
        return []
    if isinstance(item, Stage):
        return [item]
    if isinstance(item, str):
        return [Stage(stage_name(item, path), {})]
    if is_pair(item):
        return [decode_source(item[0], item[1], path)]
    if isinstance(item, (list, tuple)):
        return [s for i, x in enumerate(item) for s in steps_of(x, f"{path}[{i}]")]
    raise SpecError(path, f"{item!r} is no preprocessing step")


def encode_stage(stage) -> list:
    """A stage or Spark ML object as a pair that ``decode_source`` reads."""
    if isinstance(stage, Stage):
        return [stage.name, {k: plain(v) for k, v in stage.params.items()}]
    name = type(stage).__name__
    spark_names = {"PolynomialExpansion": "PolynomialFeatures", "MultilayerPerceptronClassifier": "NeuralNetwork"}
    return [stage_name(spark_names.get(name, name)), {}]


# ---- specs as rows ---------------------------------------------------------------------------

def _rows(value, path: str) -> Iterator[tuple]:
    if isinstance(value, Stage):
        if not value.params:
            yield path, value.name, None, None
        for k, v in value.params.items():
            if isinstance(v, (Stage, list)) and _has_stage(v):
                yield from _rows(v, f"{path}.{k}")
            else:
                yield path, value.name, k, json.dumps(v)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _rows(v, f"{path}[{i}]")
    else:
        yield path, None, None, json.dumps(value)


def _has_stage(value) -> bool:
    return isinstance(value, Stage) or isinstance(value, list) and any(map(_has_stage, value))


def spec_rows(spec: Mapping | str) -> list[tuple]:
    """(path, stage, param, value as JSON) of a model spec: a row for each parameter of a stage (one without, for a stage without any) and for
    each value of a searched list."""
    estimator, params = decode_spec(spec)
    rows = list(_rows(estimator, "$.estimator"))
    for key, values in params.items():
        rows += _rows(values, f"$.params.{key}")
    return rows


def decoded(specs: DataFrame, keys: Sequence[str], spec_col: str = "spec") -> DataFrame:
    """(keys..., path, stage, param, value) of a table of specs, a few at a time; a spec that cannot be decoded fails the job."""
    keys = list(keys)
    schema = T.StructType([*[specs.schema[k] for k in keys], *[T.StructField(c, T.StringType()) for c in ("path", "stage", "param", "value")]])

    def run(frames):
        for frame in frames:
            rows = [(*own, *r) for *own, text in frame[[*keys, spec_col]].itertuples(index=False, name=None) for r in spec_rows(text)]
            yield pd.DataFrame(rows, columns=[*keys, "path", "stage", "param", "value"])

    return specs.select(*keys, spec_col).mapInPandas(run, schema)
