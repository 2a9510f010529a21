"""Words of many texts at once: runs of bytes other than ASCII white space, numbered by their content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Word ids of a few texts, one after another; text k has the words ``first[k]`` to ``first[k + 1]``, ``kinds[id]`` each."""

    ids: np.ndarray
    kinds: pa.Array
    first: np.ndarray
    texts: list[list[bytes]]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))


def byte_groups(column, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of an Arrow binary column, about ``limit`` bytes at a time; null as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py() or b""
        if held and size + len(t) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def split_words(texts: list[bytes]) -> Words:
    """bytes.split() parts at exactly ``[\\x20\\x09-\\x0D]+``."""
    words = [t.split() for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    flat = [w for ws in words for w in ws]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), coded.dictionary, first, words)


def next_alike(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (p, q): word windows of ``gram`` words from p and from q have one hash and one text, q next after p.

    The hash keeps as many bits as fit beside a place; different windows may share one, which callers
    have to bear or to look at.
    """
    n = len(words.ids)
    starts = np.ones(n, bool)
    for k in range(1, gram):  # the last gram - 1 words of a text start no window
        at = words.first[1:] - k
        starts[at[at >= words.first[:-1]]] = False
    places = np.flatnonzero(starts)
    if not len(places):
        return places, places
    with np.errstate(over="ignore"):
        h = (words.owner[places].astype(np.uint64) + np.uint64(1)) * _ODD
        for k in range(gram):
            h = (h ^ (h >> np.uint64(29))) * _ODD + words.ids[places + k].astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * _ODD
    bits = np.uint64(max(int(n).bit_length(), 1))
    packed = np.sort((h >> bits << bits) | places.astype(np.uint64))
    place = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = (packed[1:] >> bits) == (packed[:-1] >> bits)
    return place[:-1][same], place[1:][same]
