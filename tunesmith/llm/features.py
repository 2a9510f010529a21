"""Hashes of all words of many texts at once, on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base**done times what is there
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (uint64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Polynomial hashes of byte ranges by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.inverse = pow(_ODD, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            n = max(len(data) + 1, 1 << 16)
            self.up, self.down = _powers(_ODD, n), _powers(self.inverse, n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def segments(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (text number, segment) of about ``limit`` characters, so that arrays stay small.

    A longer text is cut after white space (or, where there is none, anywhere); nothing is left out.
    """
    owner, parts, held = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = at + limit
            if end < len(t):
                cut = max(t.rfind(" ", at, end), t.rfind("\n", at, end))
                end = cut + 1 if cut > at else end
            part = t[at:end]
            if held and held + len(part) > limit:
                yield owner, parts
                owner, parts, held = [], [], 0
            owner.append(i)
            parts.append(part)
            held += len(part)
            at = end
            if at >= len(t):
                break
    if parts:
        yield owner, parts


def text_groups(column, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of an Arrow text column, a few rows at a time; null as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if held and size + len(t) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` as column names that clash with none of ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in used:
            w = f"{w}_"
        used.add(w.lower())
        out.append(w)
    return out
