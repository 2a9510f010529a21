"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts the common subsequences of three characters of two spans, each weighted down by
the characters it skips, so an insult with inserted characters still shares most subsequences with
the plain one. Spans are the words of a sentence (letters and digits only, accents folded), and runs
of single characters read as one word ("i d i o t"). Only documents are labelled, so training is
multiple-instance: the highest-scoring span of a toxic document's sentences is its witness, and the
highest-scoring spans of clean documents are the hard negatives. A document scores as its worst span.

With landmarks l_j the Nyström decision function is a sum of a_j k(x, l_j), which is linear in the
subsequences of x: training folds it into one weight per subsequence, and a span scores by lookups.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.features import text_groups
from tunesmith.llm.quality import labelled_sample
from tunesmith.session import materialize, release

DECAY = 0.6          # weight of each skipped character
SPAN = 8             # longest stretch that a subsequence may cover
WINDOW, STRIDE = 24, 12  # longer words are read in overlapping windows
CLASSES = 65         # 26 letters, 10 digits, 28 classes of other letters, and the end of a span
LANDMARKS = 384
#: The fit uses at most so many labelled documents of either class: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 4_000
ROUNDS = 4
REMEMBERED = 250_000  # span scores that a task remembers
NO_SPAN = -3.0       # margin of a text without spans

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def letters(word: str) -> str:
    """Lower case, accents folded, letters and digits only."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low)
    return low if low.isalnum() else "".join(c for c in low if c.isalnum())


def windows(span: str) -> list[str]:
    if len(span) <= WINDOW:
        return [span]
    return [span[i:i + WINDOW] for i in range(0, len(span) - WINDOW + STRIDE, STRIDE)]


def words_of(text: str) -> set[str]:
    """The distinct raw words of a text and its runs of single characters, joined."""
    out = set(text.split())
    out.update(m.group().replace(" ", "").replace("\t", "") for m in SPACED.finditer(text))
    return out


def spans(text: str) -> set[str]:
    """All distinct spans of a text; those under three characters have no subsequence."""
    return {w for raw in words_of(text) for w in windows(letters(raw)) if len(w) >= 3}


def _codes(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 97
    if "0" <= c <= "9":
        return ord(c) - 48 + 26
    return 36 + ord(c) % 28


_ASCII = np.array([_codes(chr(i)) for i in range(128)], np.int64)


def _flat(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all spans with SPAN - 1 end marks after each, and where each span starts."""
    joined = ("|" * (SPAN - 1)).join(items) + "|" * (SPAN - 1)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.where(points < 128, _ASCII[np.minimum(points, 127)], 36 + points.astype(np.int64) % 28)
    flat[points == ord("|")] = CLASSES - 1
    size = np.fromiter(map(len, items), np.int64, len(items)) + SPAN - 1
    return flat, np.concatenate(([0], np.cumsum(size)[:-1]))


OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
#: Each span's kernel is divided by the norm of a span of its length whose subsequences all differ.
NORM = np.sqrt(np.array([max(sum(max(n - j, 0) * DECAY ** (2 * (j - 2)) for _, j in OFFSETS), 1.0) for n in range(WINDOW + 1)]))


def _norms(items: list[str]) -> np.ndarray:
    return NORM[np.fromiter(map(len, items), np.int64, len(items))]


def subsequences(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, span number, weight / norm) of every subsequence, by span."""
    flat, starts = _flat(items)
    owner = np.repeat(np.arange(len(items)), np.diff(np.append(starts, len(flat))))
    norms = _norms(items)
    code, who, weight = [], [], []
    n = len(flat)
    for i, j in OFFSETS:
        a, b, c = flat[:n - j], flat[i:n - j + i], flat[j:]
        ok = np.flatnonzero((a != CLASSES - 1) & (b != CLASSES - 1) & (c != CLASSES - 1))
        code.append((a[ok] * CLASSES + b[ok]) * CLASSES + c[ok])
        who.append(owner[ok])
        weight.append(DECAY ** (j - 2) / norms[owner[ok]])
    code, who, weight = np.concatenate(code), np.concatenate(who), np.concatenate(weight)
    order = np.argsort(who, kind="stable")
    return code[order], who[order], weight[order]


def kernel(items: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of all items with all landmarks."""
    code, who, weight = subsequences(landmarks)
    known, row = np.unique(code, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    np.add.at(table, (row, who), weight)
    out = np.zeros((len(items), len(landmarks)), np.float32)
    for at in range(0, len(items), 256):
        code, who, weight = subsequences(items[at:at + 256])
        where = np.searchsorted(known, code)
        where[(where == len(known)) | (known[np.minimum(where, len(known) - 1)] != code)] = len(known)
        hit = np.flatnonzero(where < len(known))
        if len(hit):
            who, vals = who[hit], table[where[hit]] * weight[hit, None].astype(np.float32)
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            out[at + who[first]] = np.add.reduceat(vals, first, axis=0)
    return out


@dataclass
class ToxicityModel:
    """A weight for every subsequence, the bias, and the calibration of a document's worst margin."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES ** 3, np.float32))
    bias: float = NO_SPAN
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, items: list[str]) -> np.ndarray:
        """The decision value of every span."""
        flat, starts = _flat(items)
        n = len(flat)
        total = np.zeros(n, np.float32)
        for i, j in OFFSETS:  # a subsequence with an end mark has weight zero
            total[:n - j] += np.float32(DECAY ** (j - 2)) * self.weights[(flat[:n - j] * CLASSES + flat[i:n - j + i]) * CLASSES + flat[j:]]
        return np.add.reduceat(total, starts) / _norms(items) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


class Scorer:
    """The worst span of whole texts; remembers the margins of words in a bounded table."""

    def __init__(self, model: ToxicityModel, remembered: int = REMEMBERED) -> None:
        self.model, self.remembered = model, remembered
        self.known: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> tuple[list[float], list[str]]:
        """(margin, word) of the worst span of each text; of equal ones the smallest word."""
        bags = [words_of(t) for t in texts]
        new = list(set().union(*bags).difference(self.known))
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list(set().union(*bags))
        for at in range(0, len(new), 4096):
            self._learn(new[at:at + 4096])
        known, margins, worst = self.known, [], []
        for bag in bags:
            top = max(map(known.__getitem__, bag), default=NO_SPAN)
            margins.append(top)
            worst.append(min((w for w in bag if known[w] == top), default="") if top > NO_SPAN else "")
        return margins, worst

    def _learn(self, words: list[str]) -> None:
        items, owner = [], []
        for k, raw in enumerate(words):
            for w in windows(letters(raw)):
                if len(w) >= 3:
                    items.append(w)
                    owner.append(k)
        best = np.full(len(words), NO_SPAN, np.float32)
        if items:
            np.maximum.at(best, owner, self.model.margins(items))
        self.known.update(zip(words, best.tolist()))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps on the support vectors."""
    x = np.column_stack((z, np.ones(len(z)))).astype(np.float64)
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1])
    reg[-1, -1] = 1e-3

    def loss(w):
        return 0.5 * w @ reg @ w + c * np.sum(weight * np.maximum(0, 1 - y * (x @ w)) ** 2)

    for _ in range(30):
        slack = 1 - y * (x @ w)
        sv = slack > 0
        grad = reg @ w - 2 * c * x[sv].T @ (weight[sv] * y[sv] * slack[sv])
        step = np.linalg.solve(reg + 2 * c * (x[sv] * weight[sv, None]).T @ x[sv], grad)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _train(positive: Counter, negative: Counter, landmarks: int) -> ToxicityModel:
    """A machine that tells apart two bounded sets of spans (with their numbers of sentences)."""
    pos = sorted(positive, key=lambda s: (-positive[s], s))
    neg = sorted(negative, key=lambda s: (-negative[s], s))
    spread = lambda items, n: [items[int(i)] for i in np.unique(np.linspace(0, len(items) - 1, min(n, len(items))).astype(int))]
    chosen = pos[:landmarks // 3] + spread(pos[landmarks // 3:], landmarks // 3) if len(pos) > landmarks // 3 else pos
    chosen = list(dict.fromkeys(chosen + spread(neg, landmarks - len(chosen))))
    items = pos + neg
    y = np.concatenate((np.ones(len(pos)), -np.ones(len(neg))))
    weight = np.log1p([positive[s] for s in pos] + [negative[s] for s in neg])
    for sign in (1, -1):
        weight[y == sign] /= weight[y == sign].mean()
    values, vectors = np.linalg.eigh(kernel(chosen, chosen).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    w, bias = _svm(kernel(items, chosen) @ root, y, weight)
    a = root @ w
    code, who, share = subsequences(chosen)
    folded = np.zeros(CLASSES ** 3)
    np.add.at(folded, code, a[who] * share)
    return ToxicityModel(folded.astype(np.float32), bias)


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through documents' worst margins (a weak prior keeps it finite)."""
    x = np.column_stack((margin, np.ones(len(margin))))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, trainable, id_col: str = "doc_id", text_col: str = "text",
        per_class: int = SAMPLE_PER_CLASS, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """Train on the labelled rows whose id satisfies ``trainable``; the text is the only input of a score.

    The executors count the spans of the bounded sample's sentences and find its witnesses; the driver
    holds only spans that are significant, or one per sampled document. With no labelled rows, or no
    span that tells the classes apart, every score is the share of toxic labels.
    """
    sample = materialize(labelled_sample(docs, labels, label, trainable, per_class, id_col, text_col), "toxicity-sample")
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1)) \
        .where(trainable(F.col("id"))).groupBy("y").count().collect()
    share = {int(r["y"]): r["count"] for r in known}

    def count(batches):
        for batch in batches:
            t, c = Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for sentence in SENTENCE.split(text.as_py() or ""):
                    (t if y else c).update(spans(sentence))
            keys = list(t.keys() | c.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([t[k] for k in keys], pa.int64()), pa.array([c[k] for k in keys], pa.int64())],
                names=["span", "t", "c"])

    counts = materialize(sample.select("y", "text").mapInArrow(count, "span string, t long, c long")
                         .groupBy("span").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-spans")
    size, toxic, clean = counts.agg(F.count(F.lit(1)), F.sum("t"), F.sum("c")).first()
    model = ToxicityModel()
    positive, negative = Counter(), Counter()
    if toxic and clean:
        # so many sentences that less than one span of this many is expected to be one-sided by chance
        least = max(2, int(np.ceil(np.log(max(size, 2)) / np.log((toxic + clean) / toxic))))
        seeds = counts.where((F.col("t") >= least) & (F.col("c") * 50 <= F.col("t"))).orderBy(F.desc("t"), "span").limit(500)
        positive.update({r.span: r.t for r in seeds.collect()})
        common = counts.where("c > 0 and t * 50 >= c").orderBy(F.desc("c"), "span").limit(1000)
        some = counts.where("c > 0 and t = 0").orderBy(F.xxhash64("span"), "span").limit(3000)
        negative.update({r.span: r.c for r in common.union(some).collect() if r.span not in positive})
    found = []

    def worst(model):
        shared = sample.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            scorer = Scorer(shared.value)
            for batch in batches:
                for at, texts in text_groups(batch.column(1)):
                    margins, words = scorer(texts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(texts)), pa.array(margins, pa.float64()), pa.array(words, pa.string())],
                        names=["y", "margin", "word"])

        return sample.select("y", "text").mapInArrow(run, "y int, margin double, word string").collect()

    if positive and negative:
        for turn in range(rounds):
            model = _train(positive, negative, landmarks)
            found = worst(model)
            if turn == rounds - 1:
                break
            margins = np.array([r.margin for r in found if not r.y])
            bar = max(float(np.quantile(margins, 0.995)) if len(margins) else -1.0, -1.0)
            witnesses = Counter(_best_window(model, r.word) for r in found if r.y and r.word and r.margin > bar)
            hard = Counter(_best_window(model, r.word) for r in found if not r.y and r.word)
            negative.update({s: n for s, n in hard.items() if n and s not in witnesses and s not in positive})
            positive.update({s: n for s, n in witnesses.items() if s not in negative})
    release(sample, counts)
    y = np.array([r.y for r in found], float)
    prior = share.get(1, 0) / max(sum(share.values()), 1)
    if len(set(y)) < 2:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        model.slope, model.shift, model.bias = 1e-3, float(np.log(p / (1 - p))), NO_SPAN
        model.weights = np.zeros(CLASSES ** 3, np.float32)
        return model
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.slope, model.shift = _calibrate(np.array([r.margin for r in found]), y, weight)
    return model


def _best_window(model: ToxicityModel, word: str) -> str:
    items = [w for w in windows(letters(word)) if len(w) >= 3]
    return items[int(np.argmax(model.margins(items)))]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) of every row's whole text: the probability of label 1 and the worst word.

    Null and empty texts, and texts without a word of three letters or digits, have the lowest margin
    and no evidence. Rows that repeat stay rows, null ids stay null, other columns are not read, an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                margins, words = scorer(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(m.probability(np.array(margins, np.float64))),
                     pa.array([w[:200] for w in words], pa.string())], names=["id", "score", "evidence"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("evidence", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, bar: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``bar``, all columns kept.

    Map-only: rows pass through Python a few at a time, so a task holds one Arrow batch and the texts of one group.
    Null and empty texts are clean, whatever the rest of the row. Rows that repeat stay or go
    together; an empty table gives no rows.
    """
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            for at, texts in text_groups(batch.column(at_text).cast(pa.string())):
                clean = m.probability(np.array(scorer(texts)[0], np.float64)) < bar
                yield batch.slice(at, len(texts)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
