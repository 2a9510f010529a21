"""Search-space operators.

A search space is a small dimension table

    space(model STRING, dim INT, param STRING, ix INT, value STRING, value_type STRING)

one row per (parameter, allowed value). A setting is the vector of value positions ``ix``;
its ``grid_id`` is the mixed-radix number of those digits (dimension 0 most significant).
The grid itself is never materialised by joins: ``spark.range(N)`` is decoded with
``(id div stride) % len`` per dimension, so enumerating or scoring 1.7 M settings is one
distributed, map-only pass. The driver holds the length and stride of each dimension only; the
values stay a table that is joined on (dimension, position), and Spark broadcasts the small ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.operators.scan import running
from tunesmith.session import materialize

SPACE_SCHEMA = "model string, dim int, param string, ix int, value string, value_type string"


def value_type(v) -> str:
    if v is None:
        return "none"
    if isinstance(v, (bool, np.bool_)):
        return "bool"
    if isinstance(v, (int, np.integer)):
        return "int"
    if isinstance(v, (float, np.floating)):
        return "float"
    if isinstance(v, str):
        return "str"
    if isinstance(v, (list, tuple)):
        return "list"
    return "object"


def value_text(v) -> str:
    """Machine text of a value: JSON for scalars/lists, the class name for other objects."""
    t = value_type(v)
    if t == "str":
        return v
    if t == "object":
        return type(v).__name__
    if t == "float":
        return repr(float(v))
    if t == "int":
        return str(int(v))
    if t == "bool":
        return "true" if v else "false"
    return json.dumps(v, default=lambda o: type(o).__name__)


def space_from_dict(spark: SparkSession, model: str, params: Mapping[str, Sequence]) -> DataFrame:
    """Build the space table from a ``{param: [values]}`` definition (dimension order = key order)."""
    rows = []
    for d, (p, values) in enumerate(params.items()):
        for i, v in enumerate(values):
            rows.append((model, d, p, i, value_text(v), value_type(v)))
    return spark.createDataFrame(rows, SPACE_SCHEMA)


def positions(values: DataFrame, key: Column) -> DataFrame:
    """``values`` with ``ix``, the 0-based position in the order of the unique ``key`` (a prefix count, so no task
    sorts all values)."""
    ranked = running(values.withColumn("__key", key), [], ["__key"], [("__n", "count", None)])
    return ranked.withColumn("ix", (F.col("__n") - 1).cast("int")).drop("__key", "__n")


def space_from_columns(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """A space whose dimensions are the distinct values of ``columns`` (ordered by value:
    numerically for numeric columns, byte-wise for strings). One pass over ``df`` for all columns."""
    cells, kinds = [], []
    for d, c in enumerate(columns):
        dtype = df.schema[c].dataType
        whole, numeric = isinstance(dtype, T.IntegralType), isinstance(dtype, T.NumericType)
        kinds.append("int" if whole else "float" if numeric else "str")
        cells.append(F.struct(
            F.lit(d).alias("dim"), F.when(F.lit(whole), F.col(c)).cast("long").alias("whole") if whole else F.lit(None).cast("long").alias("whole"),
            (F.col(c).cast("double") if numeric and not whole else F.lit(None).cast("double")).alias("real"), F.col(c).cast("string").alias("value")))
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("value is not null").distinct()
    order = ["whole", "real", F.when(F.col("whole").isNull() & F.col("real").isNull(), F.col("value"))]
    ranked = running(materialize(values, "space-values"), ["dim"], order, [("__n", "count", None)])
    names, types = (F.array(*[F.lit(x) for x in xs]) for xs in (columns, kinds))
    return ranked.select(F.lit(model).alias("model"), "dim", F.get(names, "dim").alias("param"), (F.col("__n") - 1).cast("int").alias("ix"),
                         "value", F.get(types, "dim").alias("value_type"))


def dims(space: DataFrame) -> DataFrame:
    """Per (model, dim): param, len and stride (product of the lengths of later dimensions)."""
    d = space.groupBy("model", "dim", "param").agg(F.count(F.lit(1)).alias("len"))
    w = Window.partitionBy("model").orderBy("dim").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list("len").over(w)
    return d.withColumn("stride", F.aggregate(later, F.lit(1).cast("long"), lambda a, x: a * x))


def grid_size(space: DataFrame) -> DataFrame:
    """G1: number of settings per model (product of the list lengths, exact in LONG)."""
    d = space.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("len"))
    return d.groupBy("model").agg(
        F.aggregate(F.collect_list("len"), F.lit(1).cast("long"), lambda a, x: a * x).alias("grid_size"),
        F.count(F.lit(1)).alias("n_dims"))


def caps(sizes: DataFrame, draw_samples: int = 150, n_iter: int = 100) -> DataFrame:
    """``draw_samples <= grid`` and ``n_iter <= grid``."""
    return sizes.withColumn("draw_samples", F.least(F.lit(draw_samples).cast("long"), F.col("grid_size"))) \
                .withColumn("n_iter", F.least(F.lit(n_iter).cast("long"), F.col("grid_size")))


@dataclass
class Dim:
    dim: int
    param: str
    length: int
    stride: int


@dataclass
class Space:
    """Driver-side handle of one model's space: its dimensions; the values are a stored table."""
    model: str
    dims: list[Dim]
    table: DataFrame  # (dim, ix, value, value_type)

    @property
    def size(self) -> int:
        n = 1
        for d in self.dims:
            n *= d.length
        return n

    @property
    def params(self) -> list[str]:
        return [d.param for d in self.dims]

    def values(self, d: Dim) -> DataFrame:
        return self.table.where(F.col("dim") == d.dim)

    def setting(self, grid_id: int) -> dict[str, tuple[str | None, str]]:
        """param -> (value text, type) of one setting: one row per dimension."""
        wanted = None
        for d in self.dims:
            here = (F.col("dim") == d.dim) & (F.col("ix") == (grid_id // d.stride) % d.length)
            wanted = here if wanted is None else wanted | here
        got = {r["dim"]: (r["value"], r["value_type"]) for r in self.table.where(wanted).collect()}
        return {d.param: got[d.dim] for d in self.dims}

    # ---- Column expressions -----------------------------------------------------------
    def digit(self, grid_id: Column, d: Dim) -> Column:
        place = F.call_function("div", grid_id, F.lit(d.stride).cast("long"))  # integer division: exact for every long
        return (place % F.lit(d.length).cast("long")).cast("int")

    def digits(self, grid_id: Column) -> Column:
        """G6 inverse: grid_id -> ARRAY<INT> of value positions."""
        return F.array(*[self.digit(grid_id, d) for d in self.dims])

    def grid_id(self, ix: Column) -> Column:
        """ARRAY<INT> of positions -> grid_id."""
        acc = F.lit(0).cast("long")
        for k, d in enumerate(self.dims):
            acc = acc + ix[k].cast("long") * F.lit(d.stride).cast("long")
        return acc


def load_space(space: DataFrame, model: str) -> Space:
    """Store one model's space and pull its dimensions (one row each) to the driver."""
    stored = materialize(space.where(F.col("model") == model).select("dim", "param", "ix", "value", "value_type"), "space")
    rows = stored.groupBy("dim", "param").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("dim")).collect()
    out, stride = [], 1
    for r in rows:
        out.append(Dim(r["dim"], r["param"], r["n"], stride))
        stride *= r["n"]
    return Space(model, list(reversed(out)), stored.drop("param"))


def enumerate_grid(spark: SparkSession, sp: Space, num_partitions: int | None = None) -> DataFrame:
    """Every setting as (grid_id, ix ARRAY<INT>), generated by ``spark.range`` (no n-way crossJoin)."""
    n = sp.size
    parts = num_partitions or max(1, min(n // 200_000 + 1, spark.sparkContext.defaultParallelism * 4))
    g = spark.range(0, n, 1, parts).withColumnRenamed("id", "grid_id")
    return g.withColumn("ix", sp.digits(F.col("grid_id")))


def decode(df: DataFrame, sp: Space, ix_col: str = "ix") -> DataFrame:
    """Add one column per parameter with the value text of each position."""
    for k, d in enumerate(sp.dims):
        df = df.join(sp.values(d).select(F.col("ix").alias(f"__ix{k}"), F.col("value").alias(d.param)),
                     F.col(ix_col)[k] == F.col(f"__ix{k}")).drop(f"__ix{k}")
    return df


def encode(settings: DataFrame, sp: Space, columns: Sequence[str] | None = None) -> DataFrame:
    """Settings with one column per parameter -> ix ARRAY<INT> and grid_id
    (NULL grid_id when a value is not in the space)."""
    cols = list(columns or sp.params)
    out = settings
    for k, (d, c) in enumerate(zip(sp.dims, cols)):
        out = out.join(sp.values(d).select(F.col("value").alias(f"__v{k}"), F.col("ix").alias(f"__ix{k}")),
                       F.col(c).cast("string").eqNullSafe(F.col(f"__v{k}")), "left").drop(f"__v{k}")
    places = [f"__ix{k}" for k in range(len(cols))]
    out = out.withColumn("ix", F.array(*places)).drop(*places)
    valid = F.forall(F.col("ix"), lambda x: x.isNotNull())
    return out.withColumn("grid_id", F.when(valid, sp.grid_id(F.col("ix"))))


ROUNDS = 6


def _round(seed: int, k: int, value: Column) -> Column:
    """Key of round k for one half: the first 60 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:{k}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of [0, a * b): the halves x mod a and x div a change in turn, each keyed by the other."""
    def bind(value, body):  # one evaluation however often the body reads it
        return F.transform(F.array(value), lambda v: body(v))[0]

    def step(k):
        def left(h):
            return F.struct(((h["l"] + _round(seed, k, h["r"])) % F.lit(a).cast("long")).alias("l"), h["r"].alias("r"))

        def right(h):
            return F.struct(h["l"].alias("l"), ((h["r"] + _round(seed, k, h["l"])) % F.lit(b).cast("long")).alias("r"))

        return right if k % 2 else left

    halves = F.struct((x % F.lit(a).cast("long")).alias("l"), F.call_function("div", x, F.lit(a).cast("long")).alias("r"))
    for k in range(ROUNDS):
        halves = bind(halves, step(k))
    return bind(halves, lambda h: h["r"] * F.lit(a).cast("long") + h["l"])


def nth_draw(counter: Column, size: int, seed: int) -> Column:
    """The setting that draw ``counter`` (0 <= counter < size) hits: draws 0, 1, 2, ... are all settings once each.

    A Feistel network permutes a domain of a * b >= size; what falls outside goes through it again (cycle
    walking). At most a - 1 numbers lie outside, so a walk of a steps always ends inside; of 64 and more such steps the
    first 16 are taken, of which more are needed with a chance under 64**-16.
    """
    a = max(1, math.isqrt(max(size - 1, 0)) + 1)
    b = max(1, -(-size // a))
    once = _feistel(counter.cast("long"), a, b, seed)
    walks = a if a < 64 else 16
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once, lambda x, _: F.when(x < size, x).otherwise(_feistel(x, a, b, seed)))


def draws(spark: SparkSession, sp: Space, first: int, n: int, seed: int) -> DataFrame:
    """(grid_id, draw): draws first .. first + n - 1 of a seed, as far as the grid has settings; nothing is enumerated."""
    i = spark.range(first, max(first, min(first + n, sp.size))).withColumnRenamed("id", "draw")
    return i.select(nth_draw(F.col("draw"), sp.size, seed).alias("grid_id"), "draw")


def draw(spark: SparkSession, sp: Space, n: int, seed: int, tried: DataFrame | None = None) -> DataFrame:
    """The first ``n`` settings of the seeded draws (all that are left, if fewer) in the order of their draw,
    as (grid_id, draw, ix); ``tried`` settings are passed over (G5).

    Draws never repeat, so n plus the number of tried settings are enough, also when few settings are left.
    """
    if tried is None:
        found = draws(spark, sp, 0, n, seed)
    else:
        tried = tried.select("grid_id").distinct()
        found = untried(draws(spark, sp, 0, n + tried.count(), seed), tried)
    return found.orderBy("draw").limit(n).withColumn("ix", sp.digits(F.col("grid_id")))


def untried(grid: DataFrame, tried: DataFrame) -> DataFrame:
    """Settings not yet evaluated (anti join on grid_id; AQE broadcasts a small tried set)."""
    return grid.join(tried.select("grid_id").distinct(), "grid_id", "left_anti")


NEIGHBOR_ROWS = 1_000  # positions that one row stands for at most while neighbours are generated


def neighbors(settings: DataFrame, sp: Space) -> DataFrame:
    """Every setting that differs in exactly one parameter, as (…, param, neighbor_id).

    Generated per row from the space definition (count = sum(len - 1)); no self-join of the grid. Dimensions are cut
    into stretches of positions first, so that a row never carries an array of a whole long dimension.
    """
    def stretches(k: int, length: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1), F.lit(NEIGHBOR_ROWS)), lambda at: F.struct(F.lit(k).alias("k"), at.alias("from")))

    parts = [stretches(k, d.length) for k, d in enumerate(sp.dims)]
    of = {name: F.array(*[F.lit(x) for x in xs]) for name, xs in (
        ("length", [d.length for d in sp.dims]), ("param", sp.params))}
    stride = F.array(*[F.lit(d.stride).cast("long") for d in sp.dims])
    out = settings.withColumn("__part", F.explode(F.concat(*parts)))
    k, start = F.col("__part.k"), F.col("__part.from")
    ends = F.least(F.get(of["length"], k), start + NEIGHBOR_ROWS) - 1
    out = out.select("*", F.get("ix", k).alias("__own"), F.explode(F.sequence(start, ends)).alias("__other")).where("__other <> __own")
    move = (F.col("__other") - F.col("__own")).cast("long") * F.get(stride, k)
    return out.withColumns({"param": F.get(of["param"], k), "neighbor_id": F.col("grid_id") + move}).drop("__part", "__own", "__other")


def experiment_matrix(spark: SparkSession, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """All combinations of a few small key tables (tasks x seeds x methods) as a grid
    enumeration: each key table becomes a dimension and the product is decoded from
    ``spark.range`` (no crossJoin)."""
    parts = []
    for d, (name, df) in enumerate(dimensions.items()):
        col = df.columns[0]
        parts.append(space_from_columns(df.select(F.col(col).alias(name)), "experiment", [name])
                     .withColumn("dim", F.lit(d)))
    space = parts[0]
    for p in parts[1:]:
        space = space.unionByName(p)
    sp = load_space(space, "experiment")
    return decode(enumerate_grid(spark, sp), sp).drop("ix")


# ---- G8-G10: configuration from table meta-features --------------------------------------

def meta_features(df: DataFrame, categorical: Sequence[str] | None = None) -> DataFrame:
    """One pass over the table: any missing cell (NULL or NaN) and any categorical column.
    Categorical columns default to the string columns of the schema (S1 mask from schema)."""
    if categorical is None:
        categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    missing = []
    for f in df.schema.fields:
        c = F.col(f.name)
        miss = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        missing.append(miss.cast("long"))
    n_missing = missing[0]
    for m in missing[1:]:
        n_missing = n_missing + m
    return df.agg(
        (F.sum(n_missing) > 0).alias("any_missing"),
        F.lit(len(categorical) > 0).alias("any_categorical"),
        F.sum(n_missing).alias("n_missing"),
        F.count(F.lit(1)).alias("n_rows"),
    )


# Preprocessing steps and the random-forest search space of the reference config.
DUAL_IMPUTER = "DualImputer"
ONE_HOT = "OneHotEncoder"
PCA_STEP = "PCA"
RF_PARAMS = {
    "n_estimators": [8, 16, 32, 64, 128, 256, 512],
    "criterion": ["gini", "entropy"],
    "max_features": np.arange(0.05, 0.5, 0.05).tolist(),
    "max_depth": [8, 9, 10, 11, 12, None],
    "min_samples_split": list(range(2, 21)),
    "min_samples_leaf": list(range(1, 21)),
    "bootstrap": [True, False],
}


@dataclass(frozen=True)
class Rule:
    """An item of a conditional list: kept where ``condition`` (SQL over the meta-features) holds, else its alternative, if any."""
    item: object
    condition: str
    alternatives: tuple = ()  # of one: () is no alternative, (None,) the null item


# The preprocessing alternatives of the reference config.
PREPROCESSOR_RULES = (
    Rule([DUAL_IMPUTER], "any_missing", (None,)),
    Rule([ONE_HOT], "not any_missing and any_categorical"),
    Rule([DUAL_IMPUTER, ONE_HOT], "any_missing and any_categorical"),
    Rule([DUAL_IMPUTER, PCA_STEP], "any_missing", ([PCA_STEP],)),
)


def rule_table(meta: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., position, item, condition, alternative): the rules with their conditions evaluated against every row
    of ``meta`` (a few flags or counts of a table; ``keys`` name the table). A condition that is NULL does not hold."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(json.dumps(r.item)).alias("item"),
                     F.coalesce(F.expr(r.condition).cast("boolean"), F.lit(False)).alias("condition"),
                     F.lit(json.dumps(r.alternatives[0]) if r.alternatives else None).cast("string").alias("alternative"))
            for i, r in enumerate(rules)]
    return meta.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def conditional_items(meta: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., ix, value, value_type): for each row of ``meta`` the items whose condition holds and the alternatives of
    the others, in the order of the rules. Items are JSON; ``null`` stands for no step."""
    kept = rule_table(meta, rules, keys).select(*keys, "position", F.when(F.col("condition"), F.col("item")).otherwise(F.col("alternative")).alias("value"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1  # at most len(rules) rows each
    kept = kept.where("value is not null").select(*keys, place.cast("int").alias("ix"), "value")
    return kept.withColumn("value_type", F.when(F.col("value") == "null", F.lit("none")).otherwise(F.lit("list")))


def conditional_preprocessors(meta: DataFrame) -> DataFrame:
    """The ``@preprocessor`` alternatives of one table: (ix, value, value_type)."""
    return conditional_items(meta, PREPROCESSOR_RULES)


def config_space(spark: SparkSession, meta: DataFrame, model: str = "RandomForestClassifier") -> DataFrame:
    """The live random-forest space plus the conditional ``@preprocessor`` dimension."""
    fixed = space_from_dict(spark, model, RF_PARAMS)
    pre = conditional_preprocessors(meta).select(
        F.lit(model).alias("model"), F.lit(len(RF_PARAMS)).alias("dim"), F.lit("@preprocessor").alias("param"),
        "ix", "value", "value_type")
    return fixed.unionByName(pre)
