"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's symbols are its white-space words (lower-cased) and their shapes (runs of capitals, small
letters, digits and each other character). The features are hashed n-grams of words and of shapes,
n = 1 and 2; a word that repeats the one before enters as one shared symbol. Each family of n-grams is
averaged over the text, so the length of a text is no feature and a score is a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.features import WordHasher, mix, segments, text_groups

BUCKETS_LOG2 = 18
FAMILIES = 4
#: The fit uses at most so many labelled rows of either class: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 4_000
SHARDS, EPOCHS = 6, 3

_SAME = np.uint64(0x5851F42D4C957F2D)
_FAMILY = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("0"):ord("9") + 1] = ord("9")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Extractor:
    """Bucket indices of all n-grams of many texts; one per task."""

    def __init__(self, buckets_log2: int = BUCKETS_LOG2) -> None:
        self.hasher, self.shift = WordHasher(), np.uint64(64 - buckets_log2)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each family the (bucket, text number) of every n-gram.

        A text of more than about a million characters goes through in segments; the pairs of words
        across their ends are the only n-grams not seen.
        """
        found = [self._segment(owner, parts, len(texts)) for owner, parts in segments(texts)]
        return [tuple(map(np.concatenate, zip(*family))) for family in zip(*found)]

    def _segment(self, owner: list[int], parts: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        encoded = [t.encode("utf-8") for t in parts]
        data = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
        ends_of_part = np.cumsum([len(t) + 1 for t in encoded])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return [(np.empty(0, np.int64), np.empty(0, np.int64))] * FAMILIES
        part = np.searchsorted(ends_of_part, starts, side="right")
        text = np.array(owner)[part]
        word = self.hasher.ranges(_LOWER[data], starts, ends)
        shape = _SHAPE[data]
        keep = np.concatenate(([True], (shape[1:] != shape[:-1]))) & ~space
        keep[starts] = True
        at = np.concatenate(([0], np.cumsum(keep)))
        shape = self.hasher.ranges(shape[keep], at[starts], at[ends])
        joined = part[1:] == part[:-1]
        out = []
        for family, h in ((0, word), (2, shape)):
            first, second = h[:-1], h[1:]
            if family == 0:
                repeats = first == second
                first, second = np.where(repeats, _SAME, first), np.where(repeats, _SAME, second)
            two = mix(first * np.uint64(3) + second)[joined]
            out.append(((mix(h + _FAMILY[family]) >> self.shift).astype(np.int64), text))
            out.append(((mix(two + _FAMILY[family + 1]) >> self.shift).astype(np.int64), text[1:][joined]))
        return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, epochs: int = EPOCHS, alpha: float = 2.0,
         beta: float = 0.1, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) after passes of follow-the-regularised-leader (proximal) updates."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(buckets + 1)).astype(np.float32)


@dataclass
class QualityModel:
    """Weights of the hashed n-grams and the bias; 1 MB, broadcast to score."""

    weights: np.ndarray
    buckets_log2: int

    def scores(self, extract: Extractor, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), float(self.weights[-1]))
        for index, owner in extract(texts):
            n = np.bincount(owner, minlength=len(texts)).clip(1)
            total += np.bincount(owner, self.weights[index], minlength=len(texts)) / n
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trainable, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most ``per_class`` labelled rows of either class, those with the smallest id hashes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).where(trainable(F.col("id"))).distinct()
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most 2 x per_class rows of two numbers
    return texts.join(F.broadcast(picked), "id")


def fit(docs: DataFrame, labels: DataFrame, label: str, trainable, id_col: str = "doc_id", text_col: str = "text",
        per_class: int = SAMPLE_PER_CLASS, buckets_log2: int = BUCKETS_LOG2, shards: int = SHARDS) -> QualityModel:
    """Train on the rows whose id satisfies ``trainable``; the text is the only input of a score.

    Each shard of the bounded sample runs its updates in the order of the id hashes, and the shards'
    weights are averaged. With no labelled rows, or one class only, all scores lean to that class.
    """
    buckets = 1 << buckets_log2
    sample = labelled_sample(docs, labels, label, trainable, per_class, id_col, text_col)
    sample = sample.select("y", "text", F.xxhash64("id", "text").alias("at"))
    dealt = sample.repartition(shards, F.pmod("at", F.lit(shards))).sortWithinPartitions("at", "y")

    def train(batches):
        extract, examples = Extractor(buckets_log2), []
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                families = [index for index, _ in extract([t.as_py() or ""])]
                value = np.concatenate([np.full(len(f), 1 / max(len(f), 1)) for f in families])
                i, where = np.unique(np.concatenate(families), return_inverse=True)
                x = np.bincount(where, value, minlength=len(i))
                examples.append((np.append(i, buckets), np.append(x, 1.0), y))
        if examples:
            w = ftrl(examples, buckets)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(examples)], pa.int64()), pa.array([i.astype(np.int32).tobytes()], pa.binary()),
                 pa.array([w[i].tobytes()], pa.binary())], names=["n", "i", "w"])

    total, seen = np.zeros(buckets + 1), 0
    for r in dealt.mapInArrow(train, "n long, i binary, w binary").collect():
        np.add.at(total, np.frombuffer(r.i, np.int32), np.frombuffer(r.w, np.float32) * r.n)
        seen += r.n
    return QualityModel((total / max(seen, 1)).astype(np.float32), buckets_log2)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text: the probability of label 1.

    Null texts count as empty; an empty text has the bias alone. Rows that repeat stay rows, null ids stay
    null, other columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        extract = Extractor(m.buckets_log2)
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(m.scores(extract, texts))], names=["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema).withColumnRenamed("id", id_col)
