"""Surrogate models: history (setting -> score / seconds) to (mu, sigma, seconds) for candidates
(SURVEY M1, M2, M5, M6, M8).

History is small (one row per trial); candidates can be the whole grid. So models are fit
with Spark ML on the history and *applied* to candidates as a distributed transform.

Forest sigma (M2) uses the law of total variance over trees,
``sigma^2 = mean_t(var_t(leaf) + mean_t(leaf)^2) - mu^2``: the fitted forest is saved to the
shared checkpoint folder and its leaves are read back (tree, leaf_ix, mean, var) from
``impurityStats = [n, sum y, sum y^2]`` (``impurity`` is stripped on leaves). Scoring is map-only: no row is exploded and
no candidate is shuffled.

A candidate's leaves are found for whole Arrow batches without walking trees: a leaf is a box of intervals, so each value of
a feature leaves a set of possible leaves of a tree, kept as bits; the sets of all features have one leaf in
common. Forests with too many leaves a tree for that take Spark ML's leaf indices (``leafCol``) instead.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.session import ensure_checkpoint_dir


def forest_regressor(seed: int = 42, num_trees: int = 100, max_depth: int = 20, min_instances: int = 3,
                     features: str = "features", label: str = "label") -> RandomForestRegressor:
    """M1: the reference's score forest (100 trees, depth 20, min leaf 3, all features per split)."""
    return RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                 minInstancesPerNode=min_instances, featureSubsetStrategy="all", seed=seed,
                                 leafCol="leaf", bootstrap=True, cacheNodeIds=True, maxMemoryInMB=1024)


def linear_regressor(features: str = "features", label: str = "label") -> LinearRegression:
    """M5: ordinary least squares with standardised features (no penalty)."""
    return LinearRegression(featuresCol=features, labelCol=label, solver="normal", standardization=True, regParam=0.0)


def boosted_regressor(seed: int = 42, features: str = "features", label: str = "label") -> GBTRegressor:
    """M6: gradient-boosted trees, 100 rounds, depth 20, min leaf 3."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=100, maxDepth=20, minInstancesPerNode=3, seed=seed,
                        cacheNodeIds=True, maxMemoryInMB=1024)


def saved_nodes(spark, model) -> DataFrame:
    """(treeID, id, prediction, impurityStats, leftChild, rightChild, split): the nodes of a fitted random-forest regressor."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tunesmith-models/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def leaf_table(nodes: DataFrame, min_variance: float = 0.0) -> DataFrame:
    """(tree, leaf_ix, leaf_mean, leaf_var) for every leaf of ``saved_nodes``."""
    leaves = nodes.where(F.col("leftChild") == -1)
    w = Window.partitionBy("treeID").orderBy("id")  # one tree's leaves (bounded by history size)
    s = F.col("impurityStats")
    n = F.when(s[0] > 0, s[0])  # a leaf can carry zero bootstrap weight: variance 0 then
    var = F.coalesce(s[2] / n - (s[1] / n) * (s[1] / n), F.lit(0.0))
    return leaves.select(
        F.col("treeID").alias("tree"),
        (F.row_number().over(w) - 1).alias("leaf_ix"),
        F.col("prediction").alias("leaf_mean"),
        F.greatest(var, F.lit(float(min_variance))).alias("leaf_var"))


#: Words of 64 leaves a tree, and megabytes of sets, up to which leaves are found by sets.
BOX_WORDS, BOX_MB = 8, 64


@dataclass
class Boxes:
    """For every feature its sorted split values, and for every interval between them and every tree the leaves that a
    candidate with such a value may be in, as bits."""

    splits: list[np.ndarray]
    sets: list[np.ndarray]  # (intervals, trees, words) each

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of every row (rows x features) in every tree."""
        left = None
        for f, (splits, sets) in enumerate(zip(self.splits, self.sets)):
            if len(splits):
                here = sets[np.searchsorted(splits, x[:, f], side="left")]  # a value goes left up to and with the split
                left = here if left is None else left & here
        if left is None:
            return np.zeros((len(x), self.sets[0].shape[1]), np.int64)
        # one bit is left in one word; a power of two is exact as a double
        number = np.frexp(left.astype(np.float64))[1] - 1
        return np.where(left != 0, number + 64 * np.arange(left.shape[2]), 0).sum(axis=2)


def forest_boxes(nodes: DataFrame, n_features: int) -> Boxes | None:
    """The boxes of a forest's leaves, numbered by node id within their tree; None if there are too many for ``Boxes``.

    The driver holds the nodes of all trees, fewer than 2 x trees x history rows.
    """
    columns = nodes.select("treeID", "id", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                           F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("value")).orderBy("treeID", "id").toArrow()
    tree, node, left, right, feature, value = (columns.column(k).to_numpy() for k in range(6))
    inner = left != -1
    splits = [np.unique(value[inner & (feature == f)]) for f in range(n_features)]
    starts = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    most = max((int((~inner[a:b]).sum()) for a, b in zip(starts, [*starts[1:], len(tree)])), default=1)
    words = -(-most // 64)
    size = sum(len(x) + 1 for x in splits) * len(starts) * words * 8
    if words > BOX_WORDS or size > BOX_MB << 20:
        return None
    sets = [np.zeros((len(x) + 1, len(starts), words), np.uint64) for x in splits]
    for t, (a, b) in enumerate(zip(starts, [*starts[1:], len(tree)])):
        at = {int(n): i for i, n in enumerate(node[a:b], a)}
        number = {int(n): k for k, n in enumerate(node[a:b][~inner[a:b]])}
        todo = [(int(node[a]), [(0, len(x)) for x in splits])]
        while todo:
            n, box = todo.pop()
            i = at[n]
            if not inner[i]:
                word, bit = divmod(number[n], 64)
                for f, (low, high) in enumerate(box):
                    sets[f][low:high + 1, t, word] |= np.uint64(1 << bit)
                continue
            f = int(feature[i])
            cut = int(np.searchsorted(splits[f], value[i]))
            low, high = box[f]
            todo.append((int(left[i]), [*box[:f], (low, min(high, cut)), *box[f + 1:]]))
            todo.append((int(right[i]), [*box[:f], (max(low, cut + 1), high), *box[f + 1:]]))
    return Boxes(splits, sets)


def shared_leaves(leaves: DataFrame, n_trees: int):
    """A leaf table (tree, leaf_ix, leaf_mean, leaf_var; numbers from 0 without gaps) as arrays for all tasks: where each
    tree starts, means, and variances plus squared means. At most trees x history rows."""
    table = leaves.orderBy("tree", "leaf_ix").select("tree", "leaf_mean", "leaf_var").toArrow()
    tree, mean, var = (table.column(k).to_numpy() for k in range(3))
    start = np.searchsorted(tree, np.arange(n_trees))
    return leaves.sparkSession.sparkContext.broadcast((start, mean, var + mean * mean))


def _moments(at: np.ndarray, leaves) -> tuple[np.ndarray, np.ndarray]:
    start, mean, square = leaves
    at = at + start
    mu = mean[at].mean(axis=1)
    return mu, np.sqrt(np.maximum(square[at].mean(axis=1) - mu * mu, 0.0))


def _mu_sigma(rows: DataFrame, key: str, moments) -> DataFrame:
    """(key, mu, sigma) of rows (key, numbers) by ``moments(matrix)``, map-only."""
    def score(batches):
        of = moments()
        for batch in batches:
            if batch.num_rows:
                mu, sigma = of(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mu), pa.array(sigma)], names=[key, "mu", "sigma"])

    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("mu", T.DoubleType()),
                           T.StructField("sigma", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def mu_sigma_of_leaves(assigned: DataFrame, shared, key: str = "grid_id") -> DataFrame:
    """M2, map-only: (key, mu, sigma) of rows (key, leaf: the number of the row's leaf in every tree): the mean of the leaf
    means, and the spread of a draw from a random tree's leaf."""
    def moments():
        leaves = shared.value
        return lambda x: _moments(x.astype(np.int64), leaves)

    return _mu_sigma(assigned.select(key, "leaf"), key, moments)


BOX_ROWS = 512  # candidates at a time: their sets stay in a core's cache


def mu_sigma_of_boxes(rows: DataFrame, boxes, shared, key: str = "grid_id") -> DataFrame:
    """M2, map-only: (key, mu, sigma) of rows (key, x: the features)."""
    def moments():
        found, leaves = boxes.value, shared.value

        def of(x):
            parts = [_moments(found.leaves(x[i:i + BOX_ROWS]), leaves) for i in range(0, len(x), BOX_ROWS)]
            return tuple(np.concatenate(p) for p in zip(*parts))

        return of

    return _mu_sigma(rows.select(key, "x"), key, moments)


class ForestScorer:
    """M2 for a fitted forest: its leaves (at most trees x history rows, 16 bytes each) and their boxes are read once
    per fit and reused for every candidate set of the step (pool, neighbours, realize)."""

    def __init__(self, model, min_variance: float = 0.0):
        spark = SparkSession.getActiveSession()
        self.model = model
        nodes = saved_nodes(spark, model).cache()
        try:
            self.shared = shared_leaves(leaf_table(nodes, min_variance), model.getNumTrees)
            boxes = forest_boxes(nodes, model.numFeatures)
        finally:
            nodes.unpersist()
        self.boxes = None if boxes is None else spark.sparkContext.broadcast(boxes)

    def mu_sigma(self, candidates: DataFrame, key: str = "grid_id", features: str = "features") -> DataFrame:
        """(key, mu, sigma) per candidate."""
        if self.boxes is not None:
            return mu_sigma_of_boxes(candidates.select(key, vector_to_array(features).alias("x")), self.boxes, self.shared, key)
        # leaf indices only: computing the unused prediction column would walk every tree twice
        leafer = self.model.copy().setLeafCol("leaf").setPredictionCol("").setFeaturesCol(features)
        assigned = leafer.transform(candidates.select(key, features)).select(key, vector_to_array("leaf", "float32").alias("leaf"))
        return mu_sigma_of_leaves(assigned, self.shared, key)


def forest_mu_sigma(model, candidates: DataFrame, key: str = "grid_id", features: str = "features",
                    min_variance: float = 0.0) -> DataFrame:
    """M2: (key, mu, sigma) for every candidate row."""
    return ForestScorer(model, min_variance).mu_sigma(candidates, key, features)


# ---- M8 registry ---------------------------------------------------------------------------

SCORE_MODELS = ("forest", "extra forest", "gp")
TIME_MODELS = ("forest", "extra forest", "gp", "linear", "gradient", "adaboost")


def score_model(name: str, seed: int = 42):
    """The regressor behind a score surrogate name (estimator with ``fit``)."""
    if name == "forest":
        return forest_regressor(seed)
    if name == "extra forest":
        from tunesmith.operators.extra_trees import ExtraTreesRegressor
        return ExtraTreesRegressor(seed=seed)
    if name == "gp":
        from tunesmith.operators.gaussian_process import GaussianProcessRegressor
        return GaussianProcessRegressor(seed=seed)
    raise ValueError(f"no score surrogate {name!r}; known: {', '.join(SCORE_MODELS)}")


def time_model(name: str, seed: int = 42):
    if name in ("forest", "extra forest", "gp"):
        return score_model(name, seed)
    if name == "linear":
        return linear_regressor()
    if name == "gradient":
        return boosted_regressor(seed)
    if name == "adaboost":
        from tunesmith.operators.boosting import AdaBoostR2
        return AdaBoostR2(seed=seed)
    raise ValueError(f"no time surrogate {name!r}; known: {', '.join(TIME_MODELS)}")


SMALL_HISTORY = 100_000  # rows up to which a history is fitted from one partition


def held(hist: DataFrame) -> DataFrame:
    """A cached history, in one partition if it is small: boosting runs hundreds of jobs over it, whose tasks would
    otherwise each hold a few rows.

    The history is computed once, by as many tasks as its plan asks for; only its finished rows go to the one partition.
    (``coalesce`` would run the last stage of the plan, all its hash tables included, in a single task.)
    """
    rows = hist.cache()
    if rows.limit(SMALL_HISTORY + 1).count() > SMALL_HISTORY:
        return rows
    one = rows.repartition(1).cache()
    one.count()  # filled from the cached rows, which then can go
    rows.unpersist()
    return one


def fit_score_surrogate(name: str, hist: DataFrame, label: str, seed: int = 42):
    """Fit a score surrogate; the result has ``mu_sigma(candidates, key, features)``."""
    hist = held(hist)
    try:
        model = score_model(name, seed).setLabelCol(label).fit(hist)
    finally:
        hist.unpersist()
    return ForestScorer(model) if name == "forest" else model


class _SparkPredictor:
    def __init__(self, model):
        self.model = model

    def predict(self, df: DataFrame, key: str = "grid_id", out: str = "prediction") -> DataFrame:
        m = self.model.copy().setPredictionCol(out)
        return m.transform(df.select(key, m.getFeaturesCol())).select(key, out)


def fit_time_surrogate(name: str, hist: DataFrame, label: str, seed: int = 42):
    """Fit a running-time model; the result has ``predict(candidates, key, out)``."""
    hist = held(hist)
    try:
        model = time_model(name, seed).setLabelCol(label).fit(hist)
    finally:
        hist.unpersist()
    return model if hasattr(model, "predict") and not hasattr(model, "transform") else _SparkPredictor(model)
