import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tests.conftest import SF01
from tunesmith.llm import bpe, catalog, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(catalog.TOKENIZER))
TOKENIZER.no_truncation()
TOKENIZER.no_padding()
VOCABULARY = catalog.vocabulary()


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def digests(text):
    ids = ids_of(text)
    raw = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = {r.doc_id: digests(r.text) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in catalog.QUERIES["op9_bpe_round_trip"](spark, SF01).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"])) | st.text(alphabet="aAbΣσς é̈\x1c\x1f\x85 'strevmld<|>0½"))
def test_any_text_equals_the_library(text):
    got = np.frombuffer(bpe.Encoder(VOCABULARY).encode(text), "<u4").tolist()
    assert got == ids_of(text)


@pytest.mark.parametrize("text", [
    "aaaaaaaaa", "x" * 3000, "<|endoftext|>hi<|startoftext|> <|x", "don't we'll", "İstanbul ǅ", "ab\x1cc\x1fd", "q̣̇ Å", "  "])
def test_odd_texts(text):
    assert np.frombuffer(bpe.Encoder(VOCABULARY).encode(text), "<u4").tolist() == ids_of(text)


def test_the_table_of_known_chunks_only_bounds_memory():
    small = bpe.Encoder(VOCABULARY, remembered=3)
    texts = ["one two three four five six", "seven one eight two", "nine"]
    for t in texts * 2:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == ids_of(t)
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(texts)] == [ids_of(t) for t in texts]


def test_encode_and_decode_tables(edge, empty):
    coded = bpe.encode(edge, VOCABULARY)
    rows = {r.doc_id: r.ids for r in coded.collect()}
    assert rows[3] == [] and rows[4] == [] and rows[9] == ids_of("Größe ñandú 日本語 😀 line\nline\nline two")
    back = {r.doc_id: r.decoded for r in bpe.decode_table(coded, VOCABULARY).collect()}
    assert back[9] == TOKENIZER.decode(rows[9], skip_special_tokens=False) and back[3] == ""
    assert bpe.round_trip_digests(edge, VOCABULARY).count() == 11
    assert bpe.encode(empty, VOCABULARY).count() == 0 and bpe.round_trip_digests(empty, VOCABULARY).count() == 0


def check_packing(rows, docs):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = ids_of(text) + [0]
        cuts = [ids[i:i + 2048] for i in range(0, len(ids), 2048)]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (k, 2048 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cuts)]
    fill(rows)


def fill(rows, capacity=2048):
    """Sequences are gapless from 0 and no longer than the capacity; returns how many there are."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    rows = catalog.QUERIES["op10_best_fit_packing"](spark, SF01).collect()
    check_packing(rows, docs)
    total = sum(r.length for r in rows)
    assert fill(rows) <= 1.01 * -(-total // 2048)


def test_packing_edge_rows(edge, empty):
    rows = packing.pack_documents(edge, VOCABULARY).collect()
    fill(rows)
    assert sum(r.doc_id == 2 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(s, i) for i, s in enumerate(room) if s >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_over_counts_is_best_fit_decreasing(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(histogram, capacity)
    used, ranks = {}, set()
    for length, rank, slots, first, offset in runs:
        for k in range(slots):
            assert (length, rank + k) not in ranks
            ranks.add((length, rank + k))
            used.setdefault(first + k, []).append((offset, length))
    assert ranks == {(n, k) for n, c in histogram.items() for k in range(c)}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_decreasing(lengths, capacity)


def test_one_length_with_most_rows(spark):
    df = spark.createDataFrame([(i, 0, 0, 700 if i % 3 else 10 + i % 7, i) for i in range(3000)],
                               "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df, 2048).collect()
    assert len(rows) == 3000
    fill(rows)


def test_a_long_run_of_equal_slots_is_cut_before_it_becomes_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 7)
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, 3).otherwise(10).cast("long").alias("length"))
    rows = packing.pack(pieces, 10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (a, o, n), (b, p, _) in zip(places, places[1:]):
        assert p == (o + n if a == b else 0)
    assert len({r.sequence_id for r in rows}) == 400 + 34
