"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

No labels are used. Each rule reads a few counts of a text and votes good, bad or not at all. The votes of all
documents are counted by pattern, and EM finds, for each rule, how often it votes rightly on good and on bad
documents, and the share of good ones. A document's quality is its posterior probability given its votes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.words import byte_groups, next_alike, split_words
from tunesmith.session import materialize

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WHITE = bytes([0x20, *range(0x09, 0x0E)])
WINDOW = 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_short_words",
          "n_distinct_words", "n_plain_words", "n_ends", "n_capitals", "n_letters", "n_exclaims"]


def _flag(chars) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(chars)] = 1
    return table


#: Byte counts read from one pass over the bytes. A code point is counted at its first byte.
BYTES = {
    "word_chars": _flag(b for b in range(256) if b & 0xC0 != 0x80 and b not in WHITE),
    "n_symbols": _flag(SYMBOLS),
    "n_capitals": _flag(range(65, 91)),
    "n_letters": _flag([*range(65, 91), *range(97, 123)]),
    "n_exclaims": _flag(b"!"),
}


#: Letters (or bytes of other scripts) with at most one capital, the first, inner hyphens or apostrophes, and at most one mark behind.
_PLAIN = re.compile(rb"[A-Za-z\x80-\xff][a-z\x80-\xff]*(?:['-][A-Za-z\x80-\xff][a-z\x80-\xff]*)*[.,;:?!]?")
#: Closed by one full stop, question or exclamation mark.
_END = re.compile(rb"(?s:.*)[^.?!][.?!]")

#: Tests of a word; each distinct word is looked at once.
KINDS = {
    "n_short_words": lambda w: len(w) < 4,
    "n_plain_words": lambda w: _PLAIN.fullmatch(w) is not None,
    "n_ends": lambda w: _END.fullmatch(w) is not None,
}


def _repeat_words(words) -> np.ndarray:
    """Words of each text that lie in a window of three words which the text has twice or more."""
    n = len(words.ids)
    here, there = next_alike(words, WINDOW)
    covered = np.zeros(n, bool)
    if len(here):
        same = np.ones(len(here), bool)
        for k in range(WINDOW):
            same &= words.ids[here + k] == words.ids[there + k]
        same &= words.owner[here] == words.owner[there]
        if same.all():
            again = np.concatenate([here, there])
        else:  # two windows share a hash: tell all windows with such a hash apart by their words
            places = np.unique(np.concatenate([here, there]))
            keys = np.stack([words.owner[places], *[words.ids[places + k] for k in range(WINDOW)]], axis=1)
            _, which, count = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
            again = places[count[which.ravel()] > 1]
        for k in range(WINDOW):
            covered[again + k] = True
    return _sums(covered, words.first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, by name."""
    words = split_words(texts)
    out = {"n_words": np.diff(words.first)}
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for name, table in BYTES.items():
        out[name] = _sums(table[data], ends)
    lines = [[line for line in t.split(b"\n") if line.strip(WHITE)] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    kinds = words.kinds.to_pylist()
    for name, test in KINDS.items():
        out[name] = _sums(np.fromiter(map(test, kinds), bool, len(kinds))[words.ids], words.first)
    out["n_distinct_words"] = np.array([len(set(ws)) for ws in words.texts], np.int64)
    out["n_repeat_words"] = _repeat_words(words)
    return out


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS) of every row's whole text; null as empty. Rows that repeat stay rows."""
    def run(batches):
        for batch in batches:
            for at, texts in byte_groups(batch.column(1)):
                found = counts_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=["id", *COUNTS])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")) \
        .mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) where ``bad`` holds, else good (1) where ``good`` holds, else abstains (null)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), 0).when(F.expr(self.good), 1)


#: Conditions over COUNTS. Between the bars, and on texts too short to tell, a rule abstains.
RULES = [
    Rule("plain_words", "n_words >= 10 and n_plain_words < 0.70 * n_words", "n_words >= 10 and n_plain_words >= 0.90 * n_words"),
    Rule("symbols", "n_symbols > 0.10 * n_words", "n_words >= 20 and n_symbols <= 0.02 * n_words"),
    Rule("capitals", "n_letters >= 40 and n_capitals > 0.40 * n_letters", "n_letters >= 40 and n_capitals <= 0.15 * n_letters"),
    Rule("exclaims", "n_words >= 10 and n_exclaims > 0.25 * n_words", "n_words >= 20 and n_exclaims <= 0.05 * n_words"),
    Rule("ends", "n_words >= 50 and (n_ends < 0.01 * n_words or n_ends > 0.6 * n_words)", "n_words >= 20 and n_ends between 0.03 * n_words and 0.4 * n_words"),
    Rule("repeat_words", "n_words >= 20 and n_repeat_words > 0.35 * n_words", "n_words >= 20 and n_repeat_words <= 0.15 * n_words"),
    Rule("dup_lines", "n_lines >= 3 and n_dup_lines > 0.30 * n_lines", "n_lines >= 3 and n_dup_lines <= 0.05 * n_lines"),
    Rule("word_length", "n_words >= 20 and (word_chars < 3 * n_words or word_chars > 12 * n_words)", "n_words >= 20 and word_chars between 4 * n_words and 7 * n_words"),
    Rule("short_words", "n_words >= 50 and n_short_words < 0.02 * n_words", "n_words >= 20 and n_short_words >= 0.10 * n_words"),
    Rule("distinct", "n_words between 50 and 2000 and n_distinct_words < 0.15 * n_words", "n_words between 20 and 2000 and n_distinct_words > 0.35 * n_words"),
]

#: What is taken of a rule before any vote is seen, as votes: on a good document 19 of 20 are right; on a bad one 4 of 10
#: are, as it is bad in some respects only. EM starts from these rates and is held by them.
PRIOR = {1: (19.0, 1.0), 0: (4.0, 6.0)}
PRIOR_SHARE = 0.5


@dataclass
class LabelModel:
    """``right[y][j]``: how often rule j votes y on documents that are y (bad 0, good 1); ``share`` of good ones."""

    right: np.ndarray
    share: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes: 1 good, 0 bad, -1 abstained."""
        odds = np.full(len(votes), np.log(self.share) - np.log1p(-self.share))
        for j in range(votes.shape[1]):
            odds += np.where(votes[:, j] == 1, self.weight(j, 1), np.where(votes[:, j] == 0, self.weight(j, 0), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def weight(self, j: int, vote: int) -> float:
        """Log odds that a vote adds."""
        on_good = self.right[1][j] if vote else 1 - self.right[1][j]
        on_bad = 1 - self.right[0][j] if vote else self.right[0][j]
        return float(np.log(on_good) - np.log(on_bad))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, close: float = 1e-10) -> LabelModel:
    """EM over vote patterns (rows of ``votes``: 1, 0 or -1) and how many documents have each.

    Starts from PRIOR, whose votes are added to each rule's own in every round, so rates stay inside (0, 1) and the
    classes cannot change places. Abstaining says nothing.
    """
    cast, good = votes >= 0, votes == 1
    right = np.repeat([[a / (a + b)] for a, b in (PRIOR[0], PRIOR[1])], votes.shape[1], axis=1)
    model = LabelModel(right, PRIOR_SHARE)
    p = model.posterior(votes)
    for _ in range(rounds):
        right = np.empty((2, votes.shape[1]))
        for y, weight in ((1, counts * p), (0, counts * (1 - p))):
            hit = (weight[:, None] * (cast & (good == bool(y)))).sum(0)
            right[y] = (hit + PRIOR[y][0]) / ((weight[:, None] * cast).sum(0) + sum(PRIOR[y]))
        share = ((counts * p).sum() + 1) / (counts.sum() + 2)
        model = LabelModel(right, float(share))
        after = model.posterior(votes)
        moved = np.abs(after - p).max(initial=0)
        p = after
        if moved < close:
            break
    return model


def fit(counts: DataFrame, rules: list[Rule] = RULES) -> LabelModel:
    """The label model of a stored table of counts: all documents are counted, by pattern of votes.

    The driver gets one row a pattern, at most 3 to the power of the number of rules (59,049 for ten), whatever
    the size of the corpus. An empty table gives the prior.
    """
    names = [f"_v{j}" for j in range(len(rules))]
    voted = counts.select(*[F.coalesce(r.vote(), F.lit(-1)).alias(c) for r, c in zip(rules, names)])
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    votes = np.array([[r[c] for c in names] for r in rows], np.int64).reshape(len(rows), len(rules))
    return estimate(votes, np.array([r["n"] for r in rows], float))


def posterior(model: LabelModel, rules: list[Rule] = RULES) -> Column:
    """P(good) of a row of counts, as a column."""
    odds = F.lit(float(np.log(model.share) - np.log1p(-model.share)))
    for j, r in enumerate(rules):
        vote = r.vote()
        odds = odds + F.when(vote == 1, model.weight(j, 1)).when(vote == 0, model.weight(j, 0)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: id, COUNTS, votes (rule -> good, for those that voted), quality (the posterior).

    Null, empty and blank texts count nothing; no rule votes on them and their quality is the share of good
    documents. Texts are read whole; equal texts have equal results. Rows that repeat stay rows, null ids stay
    null, other columns are not read, an empty table gives no rows.
    """
    counts = materialize(text_counts(docs, id_col, text_col), "rule-counts")
    model = fit(counts, rules)
    votes = F.map_filter(F.create_map(*[c for r in rules for c in (F.lit(r.name), r.vote() == 1)]), lambda _, v: v.isNotNull())
    return counts.select(id_col, *COUNTS, votes.alias("votes"), posterior(model, rules).alias("quality"))
