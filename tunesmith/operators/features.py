"""Feature-table preprocessing and fold assignment.

Statistics that need the whole column (median, quantiles, most frequent value) are computed
without pulling a column into one task:

* quantiles: bracketed by a sketch, then counted (``operators.quantiles``) -> exact, linear
  interpolation (numpy/SQL ``quantile_cont`` semantics). MLlib's Imputer/RobustScaler are approximate.
* most frequent: counts per (column, value), then ``min_by(value, (-count, value))`` per
  column (ties -> smallest value), both partially aggregated.

The fitted fill/scale values (one number per column) are the only things on the driver.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.operators.quantiles import grouped_quantiles
from tunesmith.operators.scan import running
from tunesmith.session import materialize


def missing_as_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and NULL both mean missing; normalise NaN to NULL in floating columns."""
    for c in cols:
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(c, F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)))
    return df


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (column, prob, value)."""
    return grouped_quantiles(df, [], cols, probs)


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, number, text): the most frequent non-missing value, ties -> smallest in the column's own order.
    Values of numeric columns are in ``number``, of all others in ``text``."""
    df = missing_as_null(df, cols)
    cells = []
    for c in cols:
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        cells.append(F.struct(F.lit(c).alias("column"), (F.col(c) if numeric else F.lit(None)).cast("double").alias("number"),
                              (F.lit(None) if numeric else F.col(c)).cast("string").alias("text")))
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("number is not null or text is not null") \
        .groupBy("column", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("low"), "number", "text")).alias("best")
    return counts.groupBy("column").agg(best).select("column", "best.number", "best.text")


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str) -> dict[str, float | str]:
    """learn one fill value per column (mean | median | most_frequent)."""
    if not cols:
        return {}
    if strategy == "mean":
        row = missing_as_null(df, cols).agg(*[F.avg(c).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        return {r["column"]: r["value"] for r in exact_quantiles(df, cols, [0.5]).collect()}  # one row per column
    if strategy == "most_frequent":
        return {r["column"]: r["number"] if r["text"] is None else r["text"] for r in most_frequent(df, cols).collect()}
    raise ValueError(f"unknown strategy {strategy!r}")


def apply_fill(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    """replace NULL/NaN by the learned value, keeping each column's type and position."""
    df = missing_as_null(df, list(fills))
    out = []
    for f in df.schema.fields:
        if f.name in fills and fills[f.name] is not None:
            out.append(F.coalesce(F.col(f.name), F.lit(fills[f.name]).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


class DualImputerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Learned fill values (param ``fills``: JSON object column -> value)."""

    fills = Param(Params._dummy(), "fills", "fill value of each column, as JSON", TypeConverters.toString)

    def __init__(self, fills: dict[str, float | str] | None = None):
        super().__init__()
        self._set(fills=json.dumps(fills or {}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_fill(dataset, json.loads(self.getOrDefault(self.fills)))


class DualImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """one strategy for categorical columns (of any type), another for numeric ones (defaults
    most_frequent / median); an empty group is skipped. A Pipeline stage that can be saved and loaded."""

    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    numerical = Param(Params._dummy(), "numerical", "numeric columns", TypeConverters.toListString)
    strategy_categorical = Param(Params._dummy(), "strategy_categorical", "strategy of categorical columns", TypeConverters.toString)
    strategy_numerical = Param(Params._dummy(), "strategy_numerical", "strategy of numeric columns", TypeConverters.toString)

    def __init__(self, categorical: Sequence[str] = (), numerical: Sequence[str] = (),
                 strategy_categorical: str = "most_frequent", strategy_numerical: str = "median"):
        super().__init__()
        self._set(categorical=list(categorical), numerical=list(numerical), strategy_categorical=strategy_categorical,
                  strategy_numerical=strategy_numerical)

    def _fit(self, dataset: DataFrame) -> DualImputerModel:
        of = self.getOrDefault
        fills = fill_values(dataset, of(self.categorical), of(self.strategy_categorical))
        fills.update(fill_values(dataset, of(self.numerical), of(self.strategy_numerical)))
        return DualImputerModel(fills)


# ---- scalers -------------------------------------------------------------------------------

def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std (a zero std scales by 1), one aggregation pass."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        s = st[f"s_{c}"]
        out = out.withColumn(c, (F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(s if s else 1.0))
    return out


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F8: (x - median) / (q75 - q25), exact quantiles (a zero range scales by 1)."""
    q = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
    out = df
    for c in cols:
        iqr = q[(c, 0.75)] - q[(c, 0.25)]
        out = out.withColumn(c, (F.col(c) - F.lit(q[(c, 0.5)])) / F.lit(iqr if iqr else 1.0))
    return out


def polynomial_terms(cols: Sequence[str], degree: int = 2, include_bias: bool = True) -> list[tuple[str, Column]]:
    """all monomials up to ``degree`` (bias first, then by degree, in column order)."""
    terms: list[tuple[str, Column]] = [("bias", F.lit(1.0))] if include_bias else []
    for d in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(cols, d):
            name = "_x_".join(f"{c}_pow{combo.count(c)}" if combo.count(c) > 1 else c for c in dict.fromkeys(combo))
            expr = F.lit(1.0)
            for c in combo:
                expr = expr * F.col(c)
            terms.append((name, expr))
    return terms


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """the stored dictionary (column, value, position, n): the distinct present values of each column as text, numbered
    from 0 in their order, with their counts. Nothing of it is on the driver, so a column may have millions."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(cells.alias("c")).select("c.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(materialize(counts, "category-counts"), ["column"], ["value"], [("position", "count", None)])
    return materialize(placed.select("column", "value", (F.col("position") - 1).alias("position"), "n"), "categories")


def one_hot_sparse(df: DataFrame, key: Sequence[str], cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """the ones of a one-hot encoding, (key..., column, position): one row for each present value that the
    dictionary knows; missing and unknown values have none (all zeros)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    rows = df.select(*key, cells.alias("__c")).select(*key, "__c.*").where("value is not null")
    known = dictionary.select(F.col("column").alias("__column"), F.col("value").alias("__value"), "position")
    return rows.join(known, (F.col("column") == F.col("__column")) & (F.col("value") == F.col("__value"))).select(*key, "column", "position")


def one_hot_long(df: DataFrame, key: Sequence[str], cols: Sequence[str], dictionary: DataFrame | None = None) -> DataFrame:
    """dense one-hot of categorical columns with unknown -> all zeros, long: (key…, feature 'col=value', value 0/1).

    The ones come from the dictionary; each row then meets the dictionary of its columns, so the output has rows x
    categories rows. ``one_hot_sparse`` is the form for many categories.
    """
    dictionary = categories(df, cols) if dictionary is None else dictionary
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in cols]))
    rows = df.select(*key, cells.alias("__c")).select(*key, "__c.*")
    names = dictionary.select(F.col("column").alias("__column"), F.col("value").alias("__value"))
    one = F.coalesce(F.col("text") == F.col("__value"), F.lit(False)).cast("double")
    return rows.join(names, F.col("column") == F.col("__column")) \
        .select(*key, F.concat_ws("=", "column", "__value").alias("feature"), one.alias("value"))


def pca_project(df: DataFrame, cols_or_vector: str, k: int, out_prefix: str = "pc_") -> DataFrame:
    """centre (StandardScaler withMean, no scaling) then project on the top-k components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    sc = StandardScaler(inputCol=cols_or_vector, outputCol="__centred", withMean=True, withStd=False)
    pca = PCA(k=k, inputCol="__centred", outputCol="__pca")
    out = Pipeline(stages=[sc, pca]).fit(df).transform(df)
    arr = vector_to_array(F.col("__pca"))
    return out.select(*[c for c in df.columns if c != cols_or_vector], *[arr[i].alias(f"{out_prefix}{i}") for i in range(k)])


# ---- E2 / S2 folds -----------------------------------------------------------------------

def stratified_folds(df: DataFrame, label: str, k: int, order: Sequence[str]) -> DataFrame:
    """Within each label, rows in ``order`` are cut into k contiguous, near-equal folds
    (NTILE semantics: the first n mod k folds get one extra row). The position inside a label
    is a chunked prefix count, so a dominant class is not one task. Adds ``fold`` (0-based)."""
    ranked = running(df, [label], list(order), [("__i", "count", None)])
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    r = ranked.join(n, label)
    q = F.floor(F.col("__n") / k)
    rem = F.col("__n") - q * k
    i = F.col("__i")
    big = rem * (q + 1)
    fold = F.when(i <= big, F.floor((i - 1) / (q + 1))).otherwise(rem + F.floor((i - 1 - big) / F.when(q > 0, q)))
    return r.withColumn("fold", fold.cast("int")).drop("__i", "__n")


def predefined_splits(df: DataFrame, row_id: str, test_fold: Column, k: int) -> DataFrame:
    """An explicit split table (row_id, fold, role): each row is 'test' in its own fold and
    'train' in the k-1 others (generated per row, no join)."""
    f = df.select(F.col(row_id), test_fold.cast("int").alias("__tf"))
    f = f.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return f.select(row_id, "fold", F.when(F.col("fold") == F.col("__tf"), F.lit("test")).otherwise(F.lit("train")).alias("role"))
