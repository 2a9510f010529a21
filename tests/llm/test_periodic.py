import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF01
from tests.llm.conftest import EDGE_ROWS
from tunesmith.llm import catalog, periodic


def brute(words, min_length=6, exponent=4):
    """Every period by a plain scan, longest stretches, smallest period of each."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if doc_id is not None:
        words = planted(doc_id, words)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    rows = catalog.QUERIES["op11_periodic_runs"](spark, SF01).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert len(rows) == len(docs) and got == want
    assert sum(r[0] > 0 for r in want.values()) > 50


words_of_few = st.lists(st.sampled_from("ab"), max_size=12).flatmap(
    lambda unit: st.tuples(st.just(unit), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=15)))


@settings(max_examples=200, deadline=None)
@given(st.lists(words_of_few, min_size=1, max_size=4), st.sampled_from([(6, 4), (1, 3), (20, 5)]))
def test_runs_of_made_up_texts(parts, bars):
    texts = [" ".join(unit * times + tail) for unit, times, tail in parts]
    texts.append(" ".join(texts))
    for text, (words, runs) in zip(texts, periodic.runs_of([t.encode() for t in texts], *bars)):
        assert runs == brute(text.split(), *bars)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodic.collapse(words, runs).decode().split() == [w for i, w in enumerate(text.split()) if i not in dropped]


def test_nested_runs_and_multiples_of_a_period():
    text = " ".join((["a", "b"] * 6 + ["c"]) * 5)
    (_, runs), = periodic.runs_of([text.encode()])
    assert runs == brute(text.split()) and {q for *_, q in runs} == {2, 13}
    assert periodic.runs_of([b"a " * 24])[0][1] == [(0, 24, 1)]  # once, not for every multiple


@pytest.mark.parametrize("text", ["w " * 60_000, "a b c " * 20_000, " ".join(f"x{i} a a a a a a" for i in range(8_000))])
def test_hostile_texts_end(text):
    (words, runs), = periodic.runs_of([text.encode()])
    if text[0] == "x":
        assert len(runs) == 8_000
    else:
        assert [r[:2] for r in runs] == [(0, len(words))]


def test_many_texts_do_not_mix():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text, (_, runs) in zip(texts, periodic.runs_of([t.encode() for t in texts])):
        assert runs == brute(text.split())


def test_edge_rows(edge, empty):
    rows = periodic.find_runs(edge).collect()
    assert len(rows) == len(EDGE_ROWS)
    want = sorted((str(i), len((t or "").split()), len(brute((t or "").split()))) for i, t, *_ in EDGE_ROWS if i != 6)
    assert sorted((str(r.doc_id), r.n_words, len(r.runs)) for r in rows if r.doc_id != 6) == want
    long, = [r for r in rows if r.doc_id == 6]
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    assert {r.collapsed for r in rows if r.doc_id in (3, 4, 5)} == {""}
    assert periodic.find_runs(empty).count() == 0


def test_planting_keeps_null_and_empty_texts(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(10, None), (10, ""), (10, "  "), (10, "a b c d e f g"), (11, "a  b"), (None, "x y")], "h long, text string")
    got = [r.t for r in rows.select(catalog.with_planted_period(F.col("text"), F.col("h")).alias("t")).collect()]
    # h = 10: g = 1, n = 7, a = 1, p = 1 + 6 // 4 = 2
    assert got == [None, "", "", "a b c b c b c", "a  b", "x y"]


def test_short_exponents_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of([b"a a"], 2, 2)
