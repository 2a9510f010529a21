"""The hill climb by pointer doubling equals a climb step by step."""

import math

import numpy as np
import pytest

from tunesmith.operators import acquisition as A
from tunesmith.operators import space as G


def climb(values, dims, start, max_steps=None):
    """Steps of one climb over a dict grid_id -> value."""
    strides = [int(np.prod(dims[k + 1:])) for k in range(len(dims))]
    path, at = [start], start
    while max_steps is None or len(path) <= max_steps:
        own = values[at]
        around = [at + (j - (at // s) % n) * s for n, s in zip(dims, strides) for j in range(n) if j != (at // s) % n]
        around = [g for g in around if g in values and values[g] is not None and not math.isnan(values[g])]
        best = min(around, key=lambda g: (-values[g], g), default=None)
        if best is None or own is None or math.isnan(own) or not values[best] > own:
            return path
        at = best
        path.append(at)
    return path


def paths(spark, values, dims, starts, max_steps=None):
    sp = G.load_space(G.space_from_dict(spark, "m", {f"d{k}": list(range(n)) for k, n in enumerate(dims)}), "m")
    scored = spark.createDataFrame(list(values.items()), "grid_id long, ei double")
    first = scored.where(scored["grid_id"].isin(starts))
    rows = A.local_search(first, scored, sp, max_steps).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["start_id"], r["step"])):
        out.setdefault(r["start_id"], []).append(r["grid_id"])
        assert len(out[r["start_id"]]) == r["step"] + 1
    return out


@pytest.mark.parametrize("max_steps", [None, 0, 1, 2, 3])
def test_equals_single_steps(spark, max_steps):
    rng = np.random.default_rng(2)
    dims = [5, 4, 6]
    values = {g: float(np.round(rng.normal(), 1)) for g in range(120) if g % 11}  # ties, and points without a score
    values[3], values[17] = float("nan"), None
    starts = [g for g in values if g % 3 == 0]
    assert paths(spark, values, dims, starts, max_steps) == {g: climb(values, dims, g, max_steps) for g in starts}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    # a staircase in a 40 x 40 grid: the only way up goes right, up, right, up ...
    values, at, step = {}, (0, 0), 0
    while at[0] < 40 and at[1] < 40:
        values[at[0] * 40 + at[1]] = float(step)
        at = (at[0], at[1] + 1) if step % 2 == 0 else (at[0] + 1, at[1])
        step += 1
    written = []
    real = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name="table": written.append(name) or real(df, name))
    got = paths(spark, values, [40, 40], [0])
    assert got[0] == climb(values, [40, 40], 0) and len(got[0]) == len(values) == 79
    assert written.count("ls-path") - 1 <= math.ceil(math.log2(len(values))) + 1
