"""Search-loop queries.

Picks and scores that do not depend on model fits are checked by SQL:

* random_search_trace  random search over the part grid; a setting's score is an aggregate of `part`
* resumed_trace        the same search, ended after seven trials and opened again on its log

The others are rows-only (scores depend on model fits and wall time). They run on the live spaces:

* random_search        random search over the live forest space on the embeddings (10 classes)
* bayes_search         benchmark run (NORMAL, forest surrogate, 5 shared starting points, refit) on the labelled
                       documents: imbalanced binary target, a numeric column with holes and two categorical
                       columns, so the space gets DualImputer / OneHotEncoder / PCA
* multi_model_search   forest and logistic regression competing by EI on the embeddings
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.operators import space as G
from tunesmith.plans.catalog_space import PART_DIMS, SPACE_SQL, draws_sql, part_space
from tunesmith.plans.registry import query
from tunesmith.plans.registry_ml import FeatureSpec, ModelConfig
from tunesmith.plans.search import Method, ModelSearch, MultiModelSearch, Search, benchmark
from tunesmith.session import ensure_checkpoint_dir
from tunesmith.sources.features import labelled_table
from tunesmith.sources.tables import table
from tunesmith.sources.trial_log import RunLog

SEED = 2589731706  # first seed of the reference's cluster run

# Sizes of the registered runs: trials of a random search, steps of the others. The library's defaults are larger.
RANDOM_TRIALS, TRACE_TRIALS, STARTING_POINTS, BAYES_STEPS, MULTI_ROUNDS = 16, 16, 5, 3, 2


def embedding_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FeatureSpec]:
    """The embeddings as a 10-class task (64-dim vector feature)."""
    return labelled_table(table(spark, sf_dir, "embeddings"), label="label", row_id="vec_id")


def document_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FeatureSpec]:
    """Labelled documents; n_chars with punched holes, lang/source categorical from the schema."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = d.join(lab, "doc_id").select(
        "doc_id",
        F.when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("n_chars").cast("double")).alias("n_chars"),
        "lang", "source", "quality")
    return labelled_table(df, label="quality", row_id="doc_id")


def live_config(spark: SparkSession, df: DataFrame, spec: FeatureSpec) -> ModelConfig:
    """G9/G10 at run time: the forest space plus the @preprocessor alternatives of this table."""
    cols = [*spec.numeric, *spec.categorical]
    meta = G.meta_features(df.select(*cols), categorical=list(spec.categorical)) if cols else \
        spark.createDataFrame([(False, False)], "any_missing boolean, any_categorical boolean")
    pre = [None if r["value_type"] == "none" else json.loads(r["value"])
           for r in G.conditional_preprocessors(meta).orderBy("ix").collect()]  # <= 4 alternatives
    return ModelConfig("RandomForestClassifier", {**G.RF_PARAMS, "@preprocessor": pre}, init={})


def _trial_frame(rows: DataFrame) -> DataFrame:
    return rows.select("task", "method", "seed", "iteration", "score", "best_score", "success", "model", "params", "phase")


@query("random_search")
def random_search(spark, sf_dir):
    """E8 (+E1-E5, E10-E12): random settings of the live forest space, 3-fold stratified CV, four settings at a time."""
    df, spec = embedding_data(spark, sf_dir)
    cfg = live_config(spark, df, spec)
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=RANDOM_TRIALS, random_search=True, seed=SEED, n_classes=10).fit(df, refit=False)
    rows = _trial_frame(s.trial_rows("embeddings", "RANDOMIZED", SEED, "RANDOMIZED", "", "forest"))
    s.close()
    return rows


def part_objective(spark: SparkSession, sf_dir: str):
    """Score of a (brand, type, size) setting: the mean price of the parts that share at least one of the three."""
    part = table(spark, sf_dir, "part")

    def score(grid_id: int, setting: dict) -> float:
        shared = F.lit(False)
        for c in PART_DIMS:
            shared = shared | (F.col(c) == F.lit(setting[c]))
        return round(part.where(shared).agg(F.avg("p_retailprice")).first()[0] / 1000, 9)

    return score


TRACE_SQL = "WITH " + SPACE_SQL + """,
n AS (SELECT CAST(product(len) AS BIGINT) AS size FROM lens),
""" + draws_sql("(SELECT size FROM n)", f"(SELECT least(size, {TRACE_TRIALS}) FROM n)", SEED) + """,
picks AS (
  SELECT g.draw, g.grid_id, b.value AS p_brand, t.value AS p_type, s.value AS p_size
  FROM firsts g
  JOIN strides sb ON sb.dim = 0 JOIN sp b ON b.dim = 0 AND b.ix = (g.grid_id // sb.stride) % sb.len
  JOIN strides st ON st.dim = 1 JOIN sp t ON t.dim = 1 AND t.ix = (g.grid_id // st.stride) % st.len
  JOIN strides ss ON ss.dim = 2 JOIN sp s ON s.dim = 2 AND s.ix = (g.grid_id // ss.stride) % ss.len),
scored AS (
  SELECT k.draw, k.grid_id, avg(p.p_retailprice) / 1000 AS score FROM picks k JOIN part p
    ON p.p_brand = k.p_brand OR p.p_type = k.p_type OR CAST(p.p_size AS VARCHAR) = k.p_size
  GROUP BY k.draw, k.grid_id)
SELECT CAST(draw AS INT) AS iteration, grid_id, draw, round(score, 6) AS score,
       round(max(score) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_score
FROM scored"""


def _part_search(spark, sf_dir) -> tuple[Search, G.Space]:
    search = Search(objective=part_objective(spark, sf_dir), n_iter=TRACE_TRIALS, random_search=True, seed=SEED, name="part")
    return search, G.load_space(part_space(spark, sf_dir), "part")


def _trace(rows: DataFrame) -> DataFrame:
    return rows.select("iteration", "grid_id", "draw", F.round("score", 6).alias("score"), F.round("best_score", 6).alias("best_score"))


@query("random_search_trace", TRACE_SQL)
def random_search_trace(spark, sf_dir):
    """E8 + E7 + G3: settings evaluated side by side, recorded in the order of their draws."""
    search, space = _part_search(spark, sf_dir)
    return _trace(search.open(spark, space).run().trial_rows("part", "RANDOMIZED", SEED))


@query("resumed_trace", TRACE_SQL)
def resumed_trace(spark, sf_dir):
    """E16 + S3: a search that ends after seven trials; another one opened on its log does the rest."""
    log = RunLog(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tunesmith-logs/log-{uuid.uuid4().hex}", "part", "RANDOMIZED", SEED)
    first, space = _part_search(spark, sf_dir)
    first.open(spark, space, log).run_random(7)
    second, _ = _part_search(spark, sf_dir)
    second.open(spark, space, log).run()
    return _trace(log.rows(spark))


@query("bayes_search")
def bayes_search(spark, sf_dir):
    """E9/E19/E20 + A7-A10: benchmark run NORMAL (forest EI) after the shared random starting points; every trial is
    appended to the log, whose rows are returned; the best setting is refitted."""
    df, spec = document_data(spark, sf_dir)
    cfg = live_config(spark, df, spec)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tunesmith-logs/log-{uuid.uuid4().hex}"
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=BAYES_STEPS, seed=SEED, n_classes=2)
    benchmark(s, df, Method.NORMAL, seed=SEED, starting_points=STARTING_POINTS, task="documents", score_regressor="forest",
              time_regressor="gp", log_path=path, refit=True)
    return _trial_frame(s.log.rows(spark))


@query("dense_classifier")
def dense_classifier(spark, sf_dir):
    """Two dense networks of one hidden layer on the embeddings, cross-validated like any other model."""
    df, spec = embedding_data(spark, sf_dir)
    cfg = ModelConfig("NeuralNetwork", {"layer_size": [16, 32], "n_layers": [1], "epochs": [5]})
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=2, random_search=True, seed=SEED, n_classes=10).fit(df, refit=False)
    rows = _trial_frame(s.trial_rows("embeddings", "RANDOMIZED", SEED, "RANDOMIZED"))
    s.close()
    return rows


@query("multi_model_search")
def multi_model_search(spark, sf_dir):
    """The live forest space and logistic regression; 1 preparation round each, then rounds where the
    model with the highest EI against the global best is evaluated; the best one is refitted."""
    df, spec = embedding_data(spark, sf_dir)
    configs = [
        live_config(spark, df, spec),
        # The regularisation strengths of the reference's logistic regression.
        ModelConfig("LogisticRegression", {"C": [1e-4, 1e-3, 1e-2, 1e-1, 0.5, 1., 5., 10., 15., 20., 25.]}),
    ]
    m = MultiModelSearch(configs, spec, n_rounds=MULTI_ROUNDS, inner_cv=3, n_prep_rounds=1, seed=SEED, n_classes=10).fit(df)
    return m.cv_results(spark)
