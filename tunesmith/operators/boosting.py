"""AdaBoost.R2 time model as a loop of Spark ML regression trees.

Each round fits a depth-3 ``DecisionTreeRegressor`` on the (small) history with the current
sample weights as ``weightCol`` (the reference resamples by weight; weighting is the
deterministic equivalent), measures the largest error and the weighted loss on the history, and updates the weights
with a Column expression. Weights are normalised in that expression by the round's sums, so a round takes one action (two
with the exponential loss) beside the fit. The weighted history is cached, and every ``CUT`` rounds it is
written to the checkpoint folder, which cuts the lineage.

Prediction is the weighted median of the round predictions (first prediction whose cumulative
weight reaches half the total), computed per candidate with array functions: no shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesmith.session import materialize, release

CUT = 10


class AdaBoostR2Model:
    def __init__(self, trees, weights, features: str):
        self.trees = trees
        self.weights = weights
        self.features = features

    def predict(self, df: DataFrame, key: str = "grid_id", out: str = "prediction") -> DataFrame:
        cur = df.select(key, self.features)
        for t, tree in enumerate(self.trees):
            cur = tree.copy().setFeaturesCol(self.features).setPredictionCol(f"__p{t}").transform(cur)
        pairs = F.array(*[F.struct(F.col(f"__p{t}").alias("p"), F.lit(float(w)).alias("w"))
                          for t, w in enumerate(self.weights)])
        ordered = F.array_sort(pairs)  # by prediction, then weight
        half = 0.5 * float(sum(self.weights))
        acc = F.aggregate(ordered, F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("med")),
                          lambda a, x: F.struct((a["cum"] + x["w"]).alias("cum"),
                                                F.coalesce(a["med"], F.when(a["cum"] + x["w"] >= F.lit(half), x["p"])).alias("med")))
        return cur.select(key, acc["med"].alias(out))


class AdaBoostR2:
    """M7: 50 rounds, learning rate 1, linear loss, depth-3 trees (the reference's defaults)."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, loss: str = "linear", max_depth: int = 3,
                 seed: int = 42, features: str = "features", label: str = "label"):
        self.n_estimators, self.learning_rate, self.loss = n_estimators, learning_rate, loss
        self.max_depth, self.seed, self.features, self.label = max_depth, seed, features, label

    def setLabelCol(self, label: str) -> "AdaBoostR2":
        self.label = label
        return self

    def _loss(self, err: F.Column, emax: float) -> F.Column:
        e = err / F.lit(emax)
        if self.loss == "square":
            return e * e
        if self.loss == "exponential":
            return 1 - F.exp(-e)
        return e

    def fit(self, hist: DataFrame) -> AdaBoostR2Model:
        h = materialize(hist.select(self.features, F.col(self.label).alias("__y")).withColumn("__w", F.lit(1.0)), "adaboost")
        stored, cached = h, None
        trees, weights = [], []
        for i in range(self.n_estimators):
            tree = DecisionTreeRegressor(featuresCol=self.features, labelCol="__y", weightCol="__w",
                                         maxDepth=self.max_depth, seed=self.seed + i).fit(h)
            p = tree.transform(h).withColumn("__err", F.abs(F.col("prediction") - F.col("__y")))
            total, emax, plain, square = p.agg(F.sum("__w"), F.max("__err"), F.sum(F.col("__w") * F.col("__err")),
                                               F.sum(F.col("__w") * F.col("__err") * F.col("__err"))).first()
            if not emax:
                trees.append(tree)
                weights.append(1.0)
                break
            p = p.withColumn("__e", self._loss(F.col("__err"), emax))
            if self.loss == "exponential":  # needs the largest error first
                avg = p.agg(F.sum(F.col("__w") * F.col("__e"))).first()[0] / total
            else:
                avg = (square / emax / emax if self.loss == "square" else plain / emax) / total
            if avg <= 0:
                trees.append(tree)
                weights.append(1.0)
                break
            if avg >= 0.5:
                if not trees:  # keep a first weak tree rather than an empty model
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = avg / (1.0 - avg)
            trees.append(tree)
            weights.append(self.learning_rate * math.log(1.0 / beta))
            w = F.col("__w") / F.lit(total) * F.pow(F.lit(beta), (1 - F.col("__e")) * self.learning_rate)
            h = p.select(self.features, "__y", w.alias("__w"))
            if (i + 1) % CUT == 0:
                h = materialize(h, "adaboost")
                release(stored)
                stored = h
            h.cache()
            if cached is not None:
                h.count()  # filled from the round before, which then can go
                cached.unpersist()
            cached = h
        if cached is not None:
            cached.unpersist()
        return AdaBoostR2Model(trees, weights, self.features)
