"""Acquisition over candidate tables.

Candidates are rows ``(…, mu, sigma[, seconds])``; scoring is a Column expression, the
argmax is a ``max_by`` aggregate (partial per task, so scoring the full grid needs no sort
and no shuffle of candidates), and the hill climb walks the grid with neighbour rows
generated from the space definition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunesmith.functions.stats import DEFAULT_XI, ei_per_second, expected_improvement
from tunesmith.operators.scan import running
from tunesmith.operators.space import Space
from tunesmith.session import materialize, release


def score(cands: DataFrame, best, mode: str = "ei", min_time=None, xi: float = DEFAULT_XI,
          mu: str = "mu", sigma: str = "sigma", seconds: str = "seconds", out: str = "ei") -> DataFrame:
    """Add the acquisition value. ``mode``: ei | ei_per_second | ei_per_root_second.
    ``best`` is a number or a Column (a foreign incumbent, e.g. the best over all models)."""
    ei = expected_improvement(F.col(mu), F.col(sigma), best, xi)
    if mode == "ei":
        return cands.withColumn(out, ei)
    if min_time is None:
        raise ValueError("per-second modes need the smallest observed evaluation time")
    return cands.withColumn(out, ei_per_second(ei, F.col(seconds), min_time, root=(mode == "ei_per_root_second")))


def argmax(cands: DataFrame, value: str = "ei", key: str = "grid_id", by: Sequence[str] = (),
           carry: Sequence[str] = ()) -> DataFrame:
    """The candidate with the highest value per group; ties -> smallest ``key``. NaN values
    (which Spark orders above every number) never win."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    order = F.struct(v.alias("__v"), (-F.col(key)).alias("__neg"))
    payload = F.struct(*[F.col(c) for c in (key, value, *carry)])
    best = cands.groupBy(*by).agg(F.max_by(payload, order).alias("__best"))
    return best.select(*by, "__best.*")


def cross_model_argmax(per_model_best: DataFrame, model_order: str = "model_ord",
                       value: str = "ei") -> DataFrame:
    """Among the per-model best candidates (one row per model configuration, a handful),
    the highest value; the first model (smallest ``model_order``) wins ties. Adds ``chosen``."""
    w = Window.orderBy(F.col(value).desc(), F.col(model_order).asc())  # rows = model configurations
    return per_model_best.withColumn("chosen", F.row_number().over(w) == 1)


def failed_prep_rounds(log: DataFrame, by: Sequence[str], order: str = "iteration", n_rounds: int = 8,
                       max_retries: int = 3) -> DataFrame:
    """E13 on a trial log: a model's preparation runs ``n_rounds`` rounds of up to
    ``max_retries`` attempts each, stopping at the first success; a round without success drops
    the model. Attempt i belongs to round s_i = number of successes before it, so round k
    failed iff at least ``max_retries`` failures carry s = k. Emits (by…, dropped, failed_round)."""
    by = list(by)
    succ = F.col("success").cast("long")
    r = running(log.withColumn("__succ", succ), by, [order], [("__upto", "sum", "__succ")])
    r = r.withColumn("__round", F.col("__upto") - F.col("__succ"))
    fails = r.where(~F.col("success") & (F.col("__round") < n_rounds)) \
             .groupBy(*by, "__round").agg(F.count(F.lit(1)).alias("__fails"))
    bad = fails.where(F.col("__fails") >= max_retries).groupBy(*by).agg(F.min("__round").alias("failed_round"))
    models = log.select(*by).distinct()
    return models.join(bad, by, "left").withColumn("dropped", F.col("failed_round").isNotNull())


def better_neighbors(scored: DataFrame, sp: Space, value: str = "ei") -> DataFrame:
    """(grid_id, to, to_value): for every point of ``scored`` (grid_id, value) with a better Hamming-1 neighbour, the best one
    (ties -> smallest grid_id).

    A point's neighbours along a dimension are the other points of its line; a better one exists just if the line's
    best point is better than the point itself. So each dimension takes one maximum over lines; no neighbour pairs.
    """
    known = F.when(~F.isnan(value), F.col(value).cast("double"))
    best = scored.select("grid_id", known.alias("own"), F.struct(known.alias("v"), (-F.col("grid_id")).alias("neg")).alias("best"))
    for d in sp.dims:
        line = F.col("grid_id") - sp.digit(F.col("grid_id"), d).cast("long") * F.lit(d.stride).cast("long")
        top = F.max(F.struct(F.col("own").alias("v"), (-F.col("grid_id")).alias("neg"))).over(Window.partitionBy(line))
        best = best.select("grid_id", "own", F.greatest("best", top).alias("best"))
    return best.where(F.col("best.v") > F.col("own")).select("grid_id", (-F.col("best.neg")).alias("to"), F.col("best.v").alias("to_value"))


def local_search(starts: DataFrame, scored: DataFrame, sp: Space, max_steps: int | None = None,
                 value: str = "ei") -> DataFrame:
    """From every start setting move to the best Hamming-1 neighbour (ties -> smallest
    grid_id) while that strictly improves ``value``; returns every visited step as
    (start_id, step, grid_id, value). ``scored`` holds (grid_id, value) for the grid.

    Every point has one pointer to its best neighbour. Round k joins the steps found so far with the pointers
    2**k moves long, and these with themselves: paths of n steps take log2(n) rounds. A value that is NULL or NaN is
    never moved to or from.
    """
    jump = materialize(better_neighbors(scored, sp, value), "ls-jumps")
    path = materialize(starts.select(F.col("grid_id").alias("start_id"), F.lit(0).alias("step"), "grid_id", F.col(value).cast("double").alias(value)), "ls-path")
    k = 0
    while max_steps is None or (1 << k) <= max_steps:
        pointers = jump.select(F.col("grid_id").alias("__at"), "to", "to_value")
        moved = path.join(pointers, F.col("grid_id") == F.col("__at")) \
            .select("start_id", (F.col("step") + (1 << k)).alias("step"), F.col("to").alias("grid_id"), F.col("to_value").alias(value))
        moved = materialize(moved if max_steps is None else moved.where(F.col("step") <= max_steps), "ls-path")
        if moved.isEmpty():
            break
        path = path.unionByName(moved)
        onward = jump.select(F.col("grid_id").alias("__at"), F.col("to").alias("__to"), F.col("to_value").alias("__value"))
        longer = jump.join(onward, F.col("to") == F.col("__at")).select("grid_id", F.col("__to").alias("to"), F.col("__value").alias("to_value"))
        longer = materialize(longer, "ls-jumps")
        release(jump)
        jump, k = longer, k + 1
    return path
