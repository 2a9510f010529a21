import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF01
from tests.llm.conftest import EDGE_ROWS
from tunesmith.llm import catalog, rules

WHITE = r"[\x20\x09-\x0D]+"


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain loops."""
    words = [w for w in re.split(WHITE, text or "") if w]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.sub(WHITE, "", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(repeat)


def test_query_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    rows = catalog.QUERIES["op12_quality_rules"](spark, SF01).collect()
    want = {r.doc_id: plain_counts(r.text) for r in docs}
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want and len(rows) == len(docs)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_verdict_agrees_with_labels_it_never_saw(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    rows = catalog.QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.y == 1], [r.kept for r in rows if r.y == 0]
    assert len(bad) > 200 and np.mean(good) > 0.995 and np.mean(bad) < 0.02


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té😀#|\x0b\x1c", max_size=40), min_size=1, max_size=5))
def test_counts_of_any_texts(texts):
    got = rules.counts_of([t.encode() for t in texts])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(got[c][k]) for c in names) for k in range(len(texts))] == [plain_counts(t) for t in texts]


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    real = rules.next_alike

    def all_alike(words, gram):
        at, _ = real(rules.split_words([b"x " * len(words.ids)]), gram)
        return at, at + 1
    monkeypatch.setattr(rules, "next_alike", all_alike)
    text = "a b c d a b c e f a b c"
    assert int(rules.counts_of([text.encode()])["n_repeat_words"][0]) == plain_counts(text)[4]


def plain_em(votes, counts, rounds):
    """The same model by loops over patterns and rules."""
    m = len(votes[0])
    right = {y: [rules.PRIOR[y][0] / sum(rules.PRIOR[y])] * m for y in (0, 1)}
    share = rules.PRIOR_SHARE

    def post(v):
        like = {}
        for y in (0, 1):
            like[y] = share if y else 1 - share
            for j in range(m):
                if v[j] >= 0:
                    like[y] *= right[y][j] if v[j] == y else 1 - right[y][j]
        return like[1] / (like[0] + like[1])

    p = [post(v) for v in votes]
    for _ in range(rounds):
        for y in (0, 1):
            w = [c * (q if y else 1 - q) for c, q in zip(counts, p)]
            for j in range(m):
                hit = sum(x for x, v in zip(w, votes) if v[j] == y)
                cast = sum(x for x, v in zip(w, votes) if v[j] >= 0)
                right[y][j] = (hit + rules.PRIOR[y][0]) / (cast + sum(rules.PRIOR[y]))
        share = (sum(c * q for c, q in zip(counts, p)) + 1) / (sum(counts) + 2)
        p = [post(v) for v in votes]
    return right, share, p


@pytest.mark.parametrize("rounds", [1, 2, 7])
def test_em_equals_plain_loops(rounds):
    rng = np.random.default_rng(5)
    votes = np.unique(rng.integers(-1, 2, (40, 5)), axis=0)
    counts = rng.integers(1, 50, len(votes)).astype(float)
    model = rules.estimate(votes, counts, rounds=rounds, close=0)
    right, share, p = plain_em(votes.tolist(), counts.tolist(), rounds)
    assert np.allclose(model.right, [right[0], right[1]]) and np.isclose(model.share, share)
    assert np.allclose(model.posterior(votes), p)


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(7)
    n, share, right = 20_000, 0.8, np.array([[0.6, 0.5, 0.7, 0.4, 0.6], [0.97, 0.95, 0.99, 0.9, 0.6]])
    y = (rng.random(n) < share).astype(int)
    votes = np.where(rng.random((n, 5)) < right[y], y[:, None], 1 - y[:, None])
    votes[rng.random((n, 5)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.estimate(patterns, counts.astype(float))
    assert abs(model.share - share) < 0.05
    assert np.abs(model.right - right).max() < 0.12
    assert np.mean((model.posterior(votes) > 0.5) == y) > np.mean((np.where(votes < 0, 0, 2 * votes - 1).sum(1) > 0) == y)


def test_column_equals_model(spark):
    counts = rules.text_counts(spark.read.parquet(f"{SF01}/documents.parquet")).cache()
    model = rules.fit(counts)
    rows = counts.select(rules.posterior(model).alias("p"), *[F.coalesce(r.vote(), F.lit(-1)) for r in rules.RULES]).collect()
    assert np.allclose([r.p for r in rows], model.posterior(np.array([r[1:] for r in rows])))


def test_edge_rows(edge, empty):
    rows = rules.judge(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    want = sorted((str(i), *plain_counts(t)) for i, t, *_ in EDGE_ROWS)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    blank = {(r.quality, tuple(r.votes)) for r in rows if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1 and blank.pop()[1] == ()
    assert rules.judge(empty).count() == 0
