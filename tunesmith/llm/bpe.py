"""Byte-pair encoding and decoding with a public word-level vocabulary (end-of-word symbols).

Texts split at white space into chunks, and a chunk's ids do not depend on its neighbours. So a
task encodes each chunk it has not met in batches: the symbols of all words of all new chunks lie
in one flat array, and each round merges, in every word at once, its lowest-rank pair, found by
binary search over the sorted pair keys (after the first round only for pairs with a new symbol).
Chunks met before are looked up in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.features import text_groups

# Fixed values of the vocabulary's format: its white space class and its word pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the vocabulary

#: Chunks of a generation that a worker remembers (two generations at most). Bounds memory, not results.
REMEMBERED = 250_000
_NO_PAIR = np.iinfo(np.int64).max


@cache
def word_pattern() -> re.Pattern:
    """The vocabulary's word pattern, with its letter and number classes as ranges of code points."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in runs:
            r = runs[kind]
            if r and r[-1][1] == c - 1:
                r[-1][1] = c
            else:
                r.append([c, c])
    letter, number = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k]) for k in "LN")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own if printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """Ids and merge ranks of a tokenizer file (JSON text), as plain arrays that travel to tasks."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *specials.values()]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made  # made: by rank
        symbols = _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbols], np.int64)
        self.specials = specials
        self.token = [b""] * self.size
        for t, i in (vocab | specials).items():
            self.token[i] = t.encode("utf-8")


class Encoder:
    """Encodes whole texts; one per worker process."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.v, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}   # chunks met lately
        self.before: dict[str, bytes] = {}  # the generation before; what is met again moves over
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, by binary search over the sorted pair keys."""
        v = self.v
        key = left * v.size + right
        at = np.searchsorted(v.keys, key)
        at[at == len(v.keys)] = 0
        return np.where(v.keys[at] == key, v.ranks[at], _NO_PAIR)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and each word's number of ids."""
        v, n = self.v, len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = v.inner[flat]
        ends = np.cumsum(size)
        sym[ends - 1] = v.last[flat[ends - 1]]
        word = np.repeat(np.arange(n), size)
        rank = np.full(len(sym), _NO_PAIR)  # of each symbol and the next one of its word
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            low = np.repeat(best, np.diff(np.append(first, len(sym))))
            over = low == _NO_PAIR
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                left = ~over
                sym, word, rank, low = sym[left], word[left], rank[left], low[left]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            # in a run of overlapping pairs every other one merges, from the left
            run = np.concatenate(([True], (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])))
            if not run.all():
                start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = v.made[low[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            # only pairs with a new symbol have another rank now
            at = hit - np.arange(len(hit))
            fresh = np.concatenate((at, at[at > 0] - 1))
            rank[fresh] = _NO_PAIR
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self._ranks(sym[fresh], sym[fresh + 1])
        if not done_sym:
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=n)

    def _words(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return word_pattern().findall(low)

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks together and remember their ids as little-endian 32-bit bytes."""
        words, counts = [], []
        for c in chunks:
            found = self._words(c)
            words += found
            counts.append(len(found))
        ids, per_word = self._merge([w.encode("utf-8") for w in words]) if words else (np.empty(0), np.empty(0, np.int64))
        ends = np.concatenate(([0], np.cumsum(per_word)))[np.cumsum(counts)] * 4
        raw, at = ids.astype("<u4").tobytes(), 0
        for c, end in zip(chunks, ends.tolist()):
            self.known[c] = raw[at:end]
            at = end

    def _lookup(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of chunks; what is new in all of them is learned in one batch."""
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set()
        for chunks in lists:
            new.update(set(chunks).difference(known))
        again = [c for c in new if c in before]
        known.update((c, before[c]) for c in again)
        new.difference_update(again)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in lists]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, little-endian unsigned 32-bit."""
        parts: list[str] = []
        recipe: list[list[int | bytes]] = []
        for t in texts:
            if self.special and "<|" in t:
                pieces = self.special.split(t)
                of: list[int | bytes] = []
                for i, p in enumerate(pieces):
                    if i % 2:
                        of.append(int(self.v.specials[p]).to_bytes(4, "little"))
                    else:
                        of.append(len(parts))
                        parts.append(p)
                recipe.append(of)
            else:
                recipe.append([len(parts)])
                parts.append(t)
        lists = [p.split() if p.isprintable() or not _ODD.search(p) else [c for c in _SPLIT.split(p) if c] for p in parts]
        found = self._lookup(lists)
        return [found[of[0]] if len(of) == 1 else b"".join(found[x] if isinstance(x, int) else x for x in of) for of in recipe]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder kept with a broadcast vocabulary, so that a reused worker keeps what it has learned."""
    if getattr(vocabulary, "_encoder", None) is None:
        vocabulary._encoder = Encoder(vocabulary)
    return vocabulary._encoder


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The text of ids (UTF-8): the vocabulary has no decoder, so its tokens stand joined by spaces."""
    token = vocabulary.token
    return b" ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def vocabulary_from(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text as an array of ints, special strings as their own ids.

    Null texts count as empty and give an empty array. Rows that repeat stay rows, null ids stay
    null, other columns are not read, an empty table gives no rows. The vocabulary (a fixed file of a few
    MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        enc = encoder_of(shared.value)
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in enc.encode_all(texts)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), values], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _keyed(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of each row's ids; null and empty arrays give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, np.array(x or [], "<u4").tobytes()).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("decoded", T.StringType())])
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode its ids, digest both.

    Ids never leave the task that made them, however long the text. Nulls, repeated rows and empty
    tables as in ``encode``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        enc = encoder_of(v)
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                n, a, b = [], [], []
                for ids in enc.encode_all(texts):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(decode(v, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return _keyed(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut into pieces of ``capacity``.

    A document of at most ``capacity`` tokens is one piece; of a longer one all pieces but the last are full.
    A null or empty text is one piece that holds ``end_id`` alone. ``with_ids`` adds the ids themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder_of(shared.value)
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                row, piece, length, crc, ids = [], [], [], [], []
                for i, raw in enumerate(enc.encode_all(texts)):
                    raw += end
                    for k, lo in enumerate(range(0, len(raw), capacity * 4)):
                        cut = raw[lo:lo + capacity * 4]
                        row.append(at + i)
                        piece.append(k)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [("id", docs.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()),
              ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    names = [n for n, _ in fields]
    return _keyed(docs, id_col, text_col).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])) \
        .withColumnRenamed("id", id_col)
