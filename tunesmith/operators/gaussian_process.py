"""Gaussian-process surrogate with standard deviation.

Kernel: constant (bounds 0.01-1000) x Matern nu=5/2 with one length scale per dimension
(bounds 0.01-100); targets centred on their mean (normalize_y); no added noise (alpha 0; a
1e-10 jitter keeps the Cholesky factor defined when settings repeat).

Fitting maximises the log marginal likelihood from the initial hyper-parameters and
``n_restarts`` log-uniform random starts. The starts are rows of a DataFrame optimised in
parallel by ``mapInPandas`` (projected gradient ascent in log space); the best start is picked
with ``max_by``. Prediction is a ``mapInPandas`` over the candidates: every task rebuilds the
small n x n factor from the history and scores its batches (map-only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JITTER = 1e-10
C_BOUNDS = (0.01, 1000.0)
L_BOUNDS = (0.01, 100.0)
SQRT5 = np.sqrt(5.0)


def matern52(A: np.ndarray, B: np.ndarray, c: float, ls: np.ndarray) -> np.ndarray:
    d = (A[:, None, :] - B[None, :, :]) / ls
    r = np.sqrt(np.maximum((d * d).sum(-1), 0.0))
    return c * (1.0 + SQRT5 * r + 5.0 / 3.0 * r * r) * np.exp(-SQRT5 * r)


def log_marginal_likelihood(theta: np.ndarray, X: np.ndarray, y: np.ndarray) -> float:
    c, ls = np.exp(theta[0]), np.exp(theta[1:])
    K = matern52(X, X, c, ls) + JITTER * np.eye(len(X))
    try:
        L = np.linalg.cholesky(K)
    except np.linalg.LinAlgError:
        return -np.inf
    alpha = np.linalg.solve(L.T, np.linalg.solve(L, y))
    return float(-0.5 * y @ alpha - np.log(np.diag(L)).sum() - 0.5 * len(X) * np.log(2 * np.pi))


def optimise(theta0: np.ndarray, X: np.ndarray, y: np.ndarray, iters: int = 150, lr: float = 0.1) -> tuple[float, np.ndarray]:
    lo = np.log(np.r_[C_BOUNDS[0], np.full(X.shape[1], L_BOUNDS[0])])
    hi = np.log(np.r_[C_BOUNDS[1], np.full(X.shape[1], L_BOUNDS[1])])
    theta = np.clip(theta0.astype(float), lo, hi)
    best = (log_marginal_likelihood(theta, X, y), theta.copy())
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    for it in range(1, iters + 1):
        g = np.zeros_like(theta)
        for k in range(len(theta)):  # central differences: len(theta) <= dims + 1
            e = np.zeros_like(theta)
            e[k] = 1e-4
            g[k] = (log_marginal_likelihood(np.clip(theta + e, lo, hi), X, y)
                    - log_marginal_likelihood(np.clip(theta - e, lo, hi), X, y)) / 2e-4
        g = np.nan_to_num(g, nan=0.0, posinf=0.0, neginf=0.0)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = np.clip(theta + lr * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.999 ** it)) + 1e-8), lo, hi)
        val = log_marginal_likelihood(theta, X, y)
        if val > best[0]:
            best = (val, theta.copy())
    return best


class GaussianProcessModel:
    def __init__(self, X: np.ndarray, y: np.ndarray, theta: np.ndarray, features: str):
        self.X, self.y_mean = X, float(y.mean())
        self.yc = y - self.y_mean
        self.theta = theta
        self.features = features

    def mu_sigma(self, candidates: DataFrame, key: str = "grid_id", features: str | None = None) -> DataFrame:
        X, yc, ymean, theta = self.X, self.yc, self.y_mean, self.theta

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c, ls = np.exp(theta[0]), np.exp(theta[1:])
            L = np.linalg.cholesky(matern52(X, X, c, ls) + JITTER * np.eye(len(X)))
            alpha = np.linalg.solve(L.T, np.linalg.solve(L, yc))
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                Xs = np.stack(pdf["__x"].to_numpy())
                Ks = matern52(Xs, X, c, ls)
                mu = Ks @ alpha + ymean
                V = np.linalg.solve(L, Ks.T)
                var = np.maximum(c - (V * V).sum(0), 0.0)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "mu": mu, "sigma": np.sqrt(var)})

        src = candidates.select(key, vector_to_array(features or self.features).alias("__x"))
        key_type = candidates.schema[key].dataType.simpleString()
        return src.mapInPandas(score, f"{key} {key_type}, mu double, sigma double")

    def predict(self, df: DataFrame, key: str = "grid_id", out: str = "prediction") -> DataFrame:
        return self.mu_sigma(df, key).select(key, F.col("mu").alias(out))


class GaussianProcessRegressor:
    """M4: constant x Matern-5/2 (ARD) kernel, normalize_y, alpha 0, 2 optimiser restarts."""

    def __init__(self, n_restarts: int = 2, seed: int = 42, features: str = "features", label: str = "label"):
        self.n_restarts, self.seed, self.features, self.label = n_restarts, seed, features, label

    def setLabelCol(self, label: str) -> "GaussianProcessRegressor":
        self.label = label
        return self

    def fit(self, hist: DataFrame) -> GaussianProcessModel:
        spark = hist.sparkSession
        pdf = hist.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).toPandas()
        X = np.stack(pdf["x"].to_numpy())  # the history: one row per trial
        y = pdf["y"].to_numpy()
        yc = y - y.mean()
        dims = X.shape[1]
        rng = np.random.default_rng(self.seed)
        starts = [np.zeros(dims + 1)]  # constant 1, length scales 1
        for _ in range(self.n_restarts):
            starts.append(np.r_[rng.uniform(*np.log(C_BOUNDS)), rng.uniform(*np.log(L_BOUNDS), size=dims)])
        start_df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(starts)], "start int, theta0 array<double>")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, t0 in zip(b["start"], b["theta0"]):
                    lml, th = optimise(np.asarray(t0), X, yc)
                    out.append((int(i), float(lml), th.tolist()))
                yield pd.DataFrame(out, columns=["start", "lml", "theta"])

        fits = start_df.repartition(len(starts)).mapInPandas(run, "start int, lml double, theta array<double>")
        best = fits.agg(F.max_by("theta", F.struct("lml", (-F.col("start")).alias("s"))).alias("theta")).first()["theta"]
        return GaussianProcessModel(X, y, np.asarray(best), self.features)
