"""Evaluation of settings: scores, cross-validation, limits, settings side by side.

* Folds of one setting fit in parallel driver threads, every Spark job of a setting in one job group.
* Settings run side by side (``in_order``): a bounded number at a time, each in a job group and a
  scheduler pool of its own, so that under ``spark.scheduler.mode=FAIR`` each gets its share of the cluster.
  A setting that ends late, fails or is cancelled leaves the others alone; results come in the settings' order.
"""

from __future__ import annotations

import itertools
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.operators import scores

R = TypeVar("R")

#: Seconds for which a search waits for a cancelled evaluation to end; longer ones go on being cancelled beside it.
GRACE = 10.0


# ---- E4 / E5 limits ------------------------------------------------------------------------

def run_with_limit(spark: SparkSession, fn: Callable, limit: float | None, grace: float = GRACE):
    """Run ``fn`` with all its Spark jobs in a fresh job group and pool. Returns (finished, value, error).

    Past ``limit`` seconds the group is cancelled, again and again, as a fit is many short jobs. An evaluation that
    has not ended ``grace`` seconds later no longer holds up the caller; it is cancelled on in the background.
    """
    sc = spark.sparkContext
    group = f"tunesmith-eval-{uuid.uuid4().hex}"
    box: dict = {}

    def work():
        sc.setJobGroup(group, "tunesmith evaluation", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", group)
        try:
            box["value"] = fn()
        except BaseException as e:  # E5: any failure is captured and scored as a timeout
            box["error"] = f"{type(e).__name__}: {e}"

    worker = InheritableThread(target=work, daemon=True)
    worker.start()
    worker.join(None if limit is None else max(0.0, float(limit)))
    if worker.is_alive():
        def cancel(until: float):
            while worker.is_alive() and time.monotonic() < until:
                sc.cancelJobGroup(group)
                worker.join(0.5)

        cancel(time.monotonic() + grace)
        if worker.is_alive():
            threading.Thread(target=cancel, args=(float("inf"),), daemon=True).start()
        return False, None, "timeout"
    if "error" in box:
        return False, None, box["error"]
    return True, box.get("value"), None


# ---- E1 / E8 settings side by side ---------------------------------------------------------

def in_order(tasks: Iterable[Callable[[], R]], running: int) -> Iterator[R]:
    """The tasks' results in the tasks' order, up to ``running`` tasks at a time.

    A free place takes the next task at once, also while an earlier one still runs; at most ``running`` results
    wait for an earlier one, so the tasks may come from a generator of any length. A task's exception is raised at
    its turn. Closing the iterator starts no further task.
    """
    todo: queue.Queue = queue.Queue()
    done: dict[int, tuple[bool, object]] = {}
    ready, stop = threading.Condition(), threading.Event()

    def work():
        while (item := todo.get()) is not None:
            k, task = item
            try:
                result = (True, None if stop.is_set() else task())
            except BaseException as e:
                result = (False, e)
            with ready:
                done[k] = result
                ready.notify_all()

    numbered = enumerate(tasks)
    workers = [InheritableThread(target=work, daemon=True) for _ in range(max(1, running))]
    for w in workers:
        w.start()
    try:
        given = 0
        for k, task in itertools.islice(numbered, 2 * len(workers)):
            todo.put((k, task))
            given = k + 1
        turn = 0
        while turn < given:
            with ready:
                ready.wait_for(lambda: turn in done)
                ok, value = done.pop(turn)
            for k, task in itertools.islice(numbered, 1):
                todo.put((k, task))
                given = k + 1
            if not ok:
                raise value
            yield value
            turn += 1
    finally:
        stop.set()
        for _ in workers:
            todo.put(None)


# ---- E3 scores -----------------------------------------------------------------------------

def scorer(scoring: str | Callable, label: str) -> Callable[[DataFrame], float]:
    """Predictions -> score, from a metric name or a callable ``(predictions, label) -> float``.

    An unknown name is an error here, not a failed trial. Losses are negated: higher is better.
    """
    if callable(scoring):
        return lambda pred: float(scoring(pred, label))
    if scoring in scores.RATES:
        return lambda pred: scores.rate(pred, label, scoring)
    if scoring in scores.RANKING:
        return lambda pred: scores.mean_auc(pred, label, weighted=scores.RANKING[scoring])
    if scoring in scores.BINARY:
        ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", metricName=scores.BINARY[scoring])
        return ev.evaluate
    if scoring in scores.LOSSES:
        ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=scores.LOSSES[scoring])
        return lambda pred: -ev.evaluate(pred)
    raise ValueError(f"no metric {scoring!r}; known: {', '.join(scores.names())}")


class CrossValidator:
    """Mean of per-fold scores; the folds of one evaluation are fit concurrently.

    Folds come from a ``fold`` column of the data (E2), or from a split table (row id, fold, role)
    whose rows say which rows train and which test in each fold (S2): a row may be in any number of
    folds, and in neither role.
    """

    def __init__(self, data: DataFrame, label: str = "label", fold_col: str = "fold", scoring: str | Callable = "accuracy",
                 splits: DataFrame | None = None, row_id: str = "row_id"):
        self.data, self.splits = data, splits
        self.label, self.fold_col, self.row_id = label, fold_col, row_id
        self.measure = scorer(scoring, label)
        self.folds = sorted(r[0] for r in (data if splits is None else splits).select(fold_col).distinct().collect())  # k values

    def sides(self, f) -> tuple[DataFrame, DataFrame]:
        """Training and test rows of one fold."""
        if self.splits is None:
            return self.data.where(F.col(self.fold_col) != f), self.data.where(F.col(self.fold_col) == f)
        own = self.splits.where(F.col(self.fold_col) == f)
        train, test = (self.data.join(own.where(F.col("role") == role).select(self.row_id), self.row_id, "left_semi")
                       for role in ("train", "test"))
        return train, test

    def _fold_score(self, pipeline, f) -> float:
        train, test = self.sides(f)
        return self.measure(pipeline.fit(train).transform(test))

    def score(self, pipeline) -> float:
        """Unweighted mean over folds; the first fold's failure is the evaluation's."""
        found = list(in_order([lambda f=f: self._fold_score(pipeline, f) for f in self.folds], len(self.folds)))
        return float(sum(found) / len(found))
