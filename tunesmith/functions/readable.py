"""Readable forms of settings and method labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of the benchmark method labels (label -> name), as in the reference report.
METHOD_DISPLAY_NAMES = [
    ("RANDOMIZED (EI: gp, RT: gp)", "Randomized"),
    ("NORMAL (EI: gp, RT: gp)", "Normal (gp)"),
    ("NORMAL (EI: forest, RT: gp)", "Normal (forest)"),
    ("EI_PER_SECOND (EI: forest, RT: extra forest)", "EI/s (forest / extra forest)"),
    ("EI_PER_SECOND (EI: forest, RT: forest)", "EI/s (forest / forest)"),
    ("EI_PER_SECOND (EI: forest, RT: linear)", "EI/s (forest / linear)"),
    ("EI_PER_SECOND (EI: gp, RT: gp)", "EI/s (gp / gp)"),
]


def method_label(method_name: Column, score_regressor: Column, time_regressor: Column) -> Column:
    """``"{NAME} (EI: {score model}, RT: {time model})"``."""
    return F.format_string("%s (EI: %s, RT: %s)", method_name, score_regressor, time_regressor)


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHOD_DISPLAY_NAMES, "method string, display_name string")


def rename_methods(df: DataFrame, method_col: str = "method") -> DataFrame:
    """Map labels to display names, dropping unlisted labels (inner join with a 7-row table)."""
    names = F.broadcast(display_names(df.sparkSession).withColumnRenamed("method", "__label"))
    return df.join(names, df[method_col] == names["__label"], "inner").drop("__label")


def readable_value(value: Column) -> Column:
    """P5 for one JSON value (VARIANT): null as None, booleans as True/False, strings unquoted, numbers and
    lists as written."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(value.cast("string"))) \
        .otherwise(value.cast("string"))


def params_from_json(props: Column) -> Column:
    """A setting stored as a JSON object -> MAP<STRING,STRING> of readable values."""
    return F.transform_values(F.from_json(props, "map<string,variant>"), lambda _, v: readable_value(v))


def readable_parameters(params: Column) -> Column:
    """``"k = v, k = v"`` in key order."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")


def python_str(value: Column, value_type: Column) -> Column:
    """P5 for the value text and type of a space table: booleans True/False, null None, all others as written."""
    return (F.when(value_type == "bool", F.initcap(value))
            .when((value_type == "none") | value.isNull(), F.lit("None"))
            .otherwise(value))
