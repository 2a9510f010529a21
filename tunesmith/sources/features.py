"""Labelled feature tables for a search.

A task table has a row id, feature columns and a label. The categorical mask is taken from
the schema (string columns) unless given by name; booleans become 0/1, dates days and timestamps
seconds; array columns become vector features of their (fixed) length. A text label is coded
0, 1, ... in alphabetical order, and the spec carries the names for predictions. Returns the table
with the label as DOUBLE and the FeatureSpec the pipelines use. The driver sees the class names,
and for array columns one row to read their length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled_table(df: DataFrame, label: str, row_id: str, categorical: Sequence[str] | None = None,
                   exclude: Sequence[str] = ()):
    from tunesmith.plans.registry_ml import FeatureSpec

    skip = {label, row_id, *exclude}
    fields = [f for f in df.schema.fields if f.name not in skip]
    if categorical is None:
        categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    arrays = [f.name for f in fields if isinstance(f.dataType, T.ArrayType)]
    numbers = {}
    for f in fields:
        if f.name in categorical or f.name in arrays:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            numbers[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.DateType):
            numbers[f.name] = F.unix_date(f.name).cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            numbers[f.name] = F.unix_micros(F.col(f.name).cast("timestamp")) / 1e6
        else:
            raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} cannot be a feature; exclude it")
    vectors, classes = {}, None
    if isinstance(df.schema[label].dataType, (T.StringType, T.BooleanType)):
        df = df.withColumn(label, F.col(label).cast("string")).where(F.col(label).isNotNull())
        coder = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(df)
        df, classes = coder.transform(df).drop(label).withColumnRenamed("__label", label), list(coder.labels)
    numeric = list(numbers)
    out = df.select(F.col(row_id).alias("row_id"), *[x.alias(c) for c, x in numbers.items()],
                    *[F.col(c).cast("string").alias(c) for c in categorical], *[array_to_vector(c).alias(c) for c in arrays],
                    F.col(label).cast("double").alias("label"))
    if arrays:
        first = df.select(*[F.size(c).alias(c) for c in arrays]).first()  # fixed-length vectors
        vectors = {c: int(first[c]) for c in arrays}
    return out, FeatureSpec(numeric=numeric, categorical=list(categorical), vectors=vectors, label="label",
                            row_id="row_id", classes=classes)
