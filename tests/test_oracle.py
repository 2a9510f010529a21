"""Every query with an oracle equals its DuckDB SQL at sf0.01 (row count, columns, values)."""

import pytest

from tunesmith.plans import registry

from .conftest import SF01
from .oracle import compare, duck

registry.load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, SF01).toPandas()
    want = con.execute(registry.ORACLES[name]).fetchdf()
    assert compare(got, want) is None, compare(got, want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
