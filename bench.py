"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints one JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {name: sec, ...}, "sf": ...,
   "candidates_per_sec": ..., "sec_per_trial": ...}

grid, seconds per trial):
* trial-log queries from the catalog (flagship leaderboard first), each forced to completion
  with a no-op write;
* full_grid_scoring: forest surrogate (100 trees) fit on a 200-trial history (mean scores of the
  whole log's iterations, on 200 seeded settings), then mu, sigma and
  EI for all 1,723,680 settings of the live random-forest space and the argmax;
* one_trial: one cross-validated evaluation of a forest setting on the embeddings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tunesmith.session import local_session  # noqa: E402

HEADLINE = [
    "leaderboard_ranked", "time_buckets_logwide", "running_best", "cumulative_time", "best_trial",
    "iteration_stats_median", "rank_within_iteration", "running_mean", "startup_removed",
    "grid_neighbors", "expected_improvement", "ei_argmax", "impute_median", "robust_scale",
    "stratified_folds", "local_search_paths",
]


def _run(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def full_grid_scoring(spark, sf_dir):
    """Forest surrogate on a 200-trial history, scored over the whole live grid; returns (#candidates, argmax)."""
    from tunesmith.operators import acquisition as A
    from tunesmith.operators import space as G
    from tunesmith.operators import surrogate as M
    from tunesmith.plans.catalog_models import ix_features
    from tunesmith.plans.catalog_space import _meta
    from tunesmith.plans.catalog_trials import trial_log

    sp = G.load_space(G.config_space(spark, _meta(spark, sf_dir)), "RandomForestClassifier")
    grid = G.enumerate_grid(spark, sp)
    # history: 200 seeded settings; the k-th has the mean score of all iterations that leave remainder k
    hist_scores = trial_log(spark, sf_dir).groupBy((F.col("iteration") % 200).alias("k")).agg(F.avg("score").alias("score"))
    picks = G.draw(spark, sp, 200, 7).select("grid_id", F.col("ix").alias("digits"), "draw")
    picks = G.positions(picks, F.col("draw")).withColumnRenamed("ix", "k")
    hist = ix_features(picks.join(hist_scores, "k").select("grid_id", F.col("digits").alias("ix"), F.col("score").alias("label")))
    scorer = M.fit_score_surrogate("forest", hist, "label")
    scored = A.score(scorer.mu_sigma(ix_features(grid)), 0.8)
    best = A.argmax(scored, "ei", "grid_id").first()
    return sp.size, best


def one_trial(spark, sf_dir):
    from tunesmith.plans.catalog_search import embedding_data
    from tunesmith.plans.registry_ml import ModelConfig
    from tunesmith.plans.search import ModelSearch

    df, spec = embedding_data(spark, sf_dir)
    cfg = ModelConfig("RandomForestClassifier", {"n_estimators": [64], "max_depth": [10], "criterion": ["gini"]})
    s = ModelSearch(cfg, spec, inner_cv=3, n_iter=1, random_search=True, n_classes=10).setup(df)
    t = s.evaluate(0)
    return t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    from tunesmith.plans import registry
    registry.load_all()

    # warm the JVM once (class loading, codegen caches) so the first query is not penalised
    _run(spark.read.parquet(os.path.join(sf_dir, "events.parquet")).groupBy("event_type").count())

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        _run(registry.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)

    t0 = time.time()
    n_cands, _ = full_grid_scoring(spark, sf_dir)
    grid_sec = time.time() - t0
    times["full_grid_scoring"] = round(grid_sec, 3)

    t0 = time.time()
    trial = one_trial(spark, sf_dir)
    times["one_trial"] = round(time.time() - t0, 3)

    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "candidates_per_sec": round(n_cands / grid_sec, 1),
        "grid_size": n_cands,
        "sec_per_trial": round(trial.evaluation_time, 3),
        "flagship_sec": times["leaderboard_ranked"],
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
