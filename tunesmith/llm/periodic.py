"""Periodic runs in texts by maximal pairs: the LCP-interval tree, bottom up, with the left words of its leaves.

A run (a maximal stretch of period q, at least ``exponent`` times q long) starts at the first and second place of a
maximal pair: two equal stretches, q apart, that neither the words before nor the words behind prolong. So no
stretch is ever extended. A node of depth l of the LCP-interval tree joins its children's places; two places of
different children have a common prefix of just l words, and if their left words differ too, they are a maximal
pair. Only pairs at most l / (exponent - 1) apart can be runs. Places of a node that are so close to each other lie
one period apart, all but the first with one left word, so each place has to meet its neighbours only; pairs
at a multiple of the period have equal left words or are not neighbours.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.words import Words, byte_groups, next_alike, split_words

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _candidates(words: Words, gram: int, exponent: int) -> np.ndarray:
    """Places that may belong to a pair of a run: a superset.

    Both places of a pair of distance q start l >= (exponent - 1) q equal words, so each window of ``gram``
    words from there on comes again (or came before), next at most q away.
    """
    n = len(words.ids)
    here, there = next_alike(words, gram)
    keep = np.zeros(n, bool)
    for at, other in ((here, there), (there, here)):
        gap = np.zeros(n, np.int64)
        gap[at] = np.abs(other - at)
        ends = np.append(np.flatnonzero(gap == 0), n)
        long = ends[np.searchsorted(ends, at)] - at  # windows in a row that come again
        keep[at[long >= (exponent - 1) * gap[at] - gram + 1]] = True
    return np.flatnonzero(keep)


def _suffix_order(ids: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``places`` in order of the suffixes (to the text's end) that start there, and the LCP of each with the next one.

    Prefix doubling; texts are told apart by their number. Ranks of all doublings stay, 4 bytes a word
    each, until the common prefixes are read from them.
    """
    n = len(ids)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    _, rank = np.unique(owner * (int(ids.max()) + 1) + ids, return_inverse=True)
    ranks, step = [rank.astype(np.int32)], 1
    while True:
        mine = np.sort(rank[places])
        if not (mine[1:] == mine[:-1]).any():
            break
        behind = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + step < end)
        behind[inside] = rank[inside + step] + 1
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + behind, return_inverse=True)
        ranks.append(rank.astype(np.int32))
        step *= 2
    order = places[np.argsort(rank[places], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # equal ranks of different places are 2**k equal words
        ok = (a < n) & (b < n)
        ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        ok &= (a < end[order[:-1]]) & (b < end[order[1:]])
        a[ok] += 1 << k
        b[ok] += 1 << k
        common[ok] += 1 << k
    return order, common


def _maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, exponent: int, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs that are runs; ``left`` is the word before each place.

    Intervals are closed bottom up. A node keeps its places in order, each with its left word's class; the
    smaller child's places look for their neighbours in the larger one's and are then put in.
    """
    found = []
    open_nodes: list[tuple[int, list[int]]] = []
    for at, below in zip(order, [*common, 0]):
        node = [at]
        while open_nodes and open_nodes[-1][0] >= below:
            depth, big = open_nodes.pop()
            if len(big) < len(node):
                big, node = node, big
            furthest = depth // (exponent - 1)
            for p in node:
                i = bisect_left(big, p)
                for q in big[max(i - 1, 0):i + 1]:
                    gap = abs(p - q)
                    if gap <= furthest and depth + gap >= min_length and left[p] != left[q]:
                        found.append((min(p, q), depth + gap, gap))
            for p in node:
                big.insert(bisect_left(big, p), p)
            node = big
        if below >= least:
            open_nodes.append((below, node))
        else:
            open_nodes.clear()  # nothing below this depth can be a run
    return found


def runs_of(texts: list[bytes], min_length: int = 6, exponent: int = 4) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs (start, length, period), by start, then period."""
    if exponent < 3 or min_length < 1:
        raise ValueError("runs of fewer than three periods, or of no words, are not supported")
    words = split_words(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # the shortest common prefix that the pair of a run can have
    gram = min(max((exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))
    places = _candidates(words, gram, exponent)
    if len(places):
        owner = words.owner
        of = np.unique(owner[places])
        sizes = np.diff(words.first)[of]
        # only texts with candidates are sorted
        first = np.concatenate([[0], np.cumsum(sizes)])
        shift = words.first[of] - first[:-1]
        ids = np.concatenate([words.ids[words.first[k]:words.first[k + 1]] for k in of])
        places = places - shift[np.searchsorted(of, owner[places])]
        order, common = _suffix_order(ids, first, places)
        left = np.empty(len(ids), np.int64)
        left[1:] = ids[:-1]
        left[first[:-1]] = -1
        best: dict[tuple[int, int], int] = {}
        for start, length, period in _maximal_pairs(order.tolist(), common.tolist(), left.tolist(), gram, exponent, min_length):
            key = (start, length)
            best[key] = min(period, best.get(key, period))
        starts = np.array([s for s, _ in best], np.int64)
        texts_of = np.searchsorted(first, starts, side="right") - 1
        for k, ((start, length), period) in zip(texts_of.tolist(), best.items()):
            found[of[k]].append((start - int(first[k]), length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return list(zip(words.texts, found))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame, min_length: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period; by start, then period), collapsed text.

    A run is a stretch of consecutive words with smallest period q, at least ``min_length`` and
    ``exponent * q`` words long, that no neighbouring word extends. Words are separated by ASCII white space.
    Null, empty and blank texts have no words and no runs and collapse to an empty text. A whole
    text is sorted in one piece, so a task holds a text's words and, only if it has places that may start
    a run, some 4 bytes for each word and doubling. Rows that repeat stay rows, null ids stay
    null, other columns are not read, an empty table gives no rows.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for at, texts in byte_groups(batch.column(1)):
                rows = runs_of(texts, min_length, exponent)
                flat = [r for _, runs in rows for r in runs]
                ends = np.cumsum([0] + [len(runs) for _, runs in rows]).astype(np.int32)
                parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(run_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(w) for w, _ in rows], pa.int64()), runs,
                     pa.array([collapse(w, r) for w, r in rows], pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")) \
        .mapInArrow(run, schema).withColumnRenamed("id", id_col)
