"""Extra-trees regressor with standard deviation.

MLlib has no extremely randomised trees, so each tree is grown in a pandas function on its
own group: the (small) trial history is replicated once per tree id with ``explode`` and
``groupBy(tree).applyInPandas`` grows one tree per task (no bootstrap, all features tried,
one uniform random threshold per feature, best variance reduction, min leaf / min split 3,
depth 20). The fitted trees (arrays of at most 2n nodes each) are the model. Candidates are
routed through all trees batch-wise in ``mapInPandas`` and reduced to (mu, sigma) with the
same law of total variance as the forest (M2): map-only, no shuffle of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
               "value array<double>, var array<double>")


def grow_tree(X: np.ndarray, y: np.ndarray, rng: np.random.Generator, max_depth: int = 20,
              min_split: int = 3, min_leaf: int = 3) -> dict:
    """One extremely randomised regression tree; leaves carry mean and variance of y."""
    feature, threshold, left, right, value, var = [], [], [], [], [], []

    def new_node(idx):
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(float(y[idx].mean()))
        var.append(float(y[idx].var()))
        return len(feature) - 1

    root = new_node(np.arange(len(y)))
    stack = [(root, np.arange(len(y)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if depth >= max_depth or len(idx) < min_split or var[node] <= 0.0:
            continue
        best = None
        for f in rng.permutation(X.shape[1]):
            col = X[idx, f]
            lo, hi = col.min(), col.max()
            if lo == hi:
                continue
            thr = rng.uniform(lo, hi)
            mask = col <= thr
            nl = int(mask.sum())
            nr = len(idx) - nl
            if nl < min_leaf or nr < min_leaf:
                continue
            sse = y[idx][mask].var() * nl + y[idx][~mask].var() * nr
            if best is None or sse < best[0]:
                best = (sse, int(f), float(thr), mask)
        if best is None:
            continue
        _, f, thr, mask = best
        feature[node], threshold[node] = f, thr
        li, ri = idx[mask], idx[~mask]
        left[node] = new_node(li)
        right[node] = new_node(ri)
        stack.append((left[node], li, depth + 1))
        stack.append((right[node], ri, depth + 1))
    return dict(feature=feature, threshold=threshold, left=left, right=right, value=value, var=var)


class ExtraTreesModel:
    def __init__(self, trees: list[dict], features: str, min_variance: float = 0.0):
        self.trees = trees
        self.features = features
        self.min_variance = min_variance

    def mu_sigma(self, candidates: DataFrame, key: str = "grid_id", features: str | None = None) -> DataFrame:
        feats = features or self.features
        trees = [{k: np.asarray(v) for k, v in t.items()} for t in self.trees]
        min_var = self.min_variance

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                X = np.stack(pdf["__x"].to_numpy()) if len(pdf) else np.zeros((0, 1))
                s1 = np.zeros(len(pdf))
                s2 = np.zeros(len(pdf))
                rows = np.arange(len(pdf))
                for t in trees:
                    node = np.zeros(len(pdf), dtype=np.int64)
                    while True:
                        f = t["feature"][node]
                        inner = f >= 0
                        if not inner.any():
                            break
                        go_left = X[rows[inner], f[inner]] <= t["threshold"][node[inner]]
                        node[inner] = np.where(go_left, t["left"][node[inner]], t["right"][node[inner]])
                    m = t["value"][node]
                    v = np.maximum(t["var"][node], min_var)
                    s1 += m
                    s2 += v + m * m
                mu = s1 / len(trees)
                sigma = np.sqrt(np.maximum(s2 / len(trees) - mu * mu, 0.0))
                yield pd.DataFrame({key: pdf[key].to_numpy(), "mu": mu, "sigma": sigma})

        src = candidates.select(key, vector_to_array(feats).alias("__x"))
        key_type = candidates.schema[key].dataType.simpleString()
        return src.mapInPandas(route, f"{key} {key_type}, mu double, sigma double")

    def predict(self, df: DataFrame, key: str = "grid_id", out: str = "prediction") -> DataFrame:
        return self.mu_sigma(df, key).select(key, F.col("mu").alias(out))


class ExtraTreesRegressor:
    """M3: 100 trees, depth 20, min leaf 3, min split 3 (the reference's configuration)."""

    def __init__(self, n_estimators: int = 100, max_depth: int = 20, min_split: int = 3, min_leaf: int = 3,
                 seed: int = 42, features: str = "features", label: str = "label"):
        self.n_estimators, self.max_depth, self.min_split, self.min_leaf = n_estimators, max_depth, min_split, min_leaf
        self.seed, self.features, self.label = seed, features, label

    def setLabelCol(self, label: str) -> "ExtraTreesRegressor":
        self.label = label
        return self

    def fit(self, hist: DataFrame) -> ExtraTreesModel:
        params = (self.max_depth, self.min_split, self.min_leaf, self.seed)
        rows = hist.select(vector_to_array(self.features).alias("__x"), F.col(self.label).cast("double").alias("__y"))
        per_tree = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            max_depth, min_split, min_leaf, seed = params
            tree_id = int(pdf["tree"].iloc[0])
            # history order must not depend on the shuffle: sort rows before growing
            order = np.lexsort(np.vstack([np.stack(pdf["__x"].to_numpy()).T, pdf["__y"].to_numpy()])[::-1])
            X = np.stack(pdf["__x"].to_numpy())[order]
            y = pdf["__y"].to_numpy()[order]
            t = grow_tree(X, y, np.random.default_rng([seed, tree_id]), max_depth, min_split, min_leaf)
            return pd.DataFrame({"tree": [tree_id], **{k: [v] for k, v in t.items()}})

        fitted = per_tree.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)
        trees = [r.asDict() for r in fitted.orderBy("tree").collect()]  # the model: n_estimators small trees
        for t in trees:
            t.pop("tree")
        return ExtraTreesModel(trees, self.features)
