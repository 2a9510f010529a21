"""SQL-expressible operators equal DuckDB at sf0.01."""

import pytest

from tests.conftest import SF01
from tests.oracle import compare, duck
from tunesmith.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, name):
    got = catalog.QUERIES[name](spark, SF01).toPandas()
    want = duck(SF01).execute(catalog.ORACLES[name]).fetchdf()
    assert compare(got, want) is None, compare(got, want)


def test_thirteen_operators():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
