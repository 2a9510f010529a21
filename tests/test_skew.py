"""Hot groups: with a tiny chunk size every prefix scan runs in its chunked form; the whole
flagship pipeline and the trial bookkeeping must give exactly the unchunked results."""

import pytest

from tunesmith.plans import registry
from tunesmith.session import ROWS_PER_CHUNK_KEY

from .conftest import SF001
from .oracle import compare

registry.load_all()


@pytest.mark.parametrize("name", ["leaderboard_ranked", "running_best", "method_curve", "stratified_folds",
                                  "impute_median", "drop_failed_models"])
def test_chunked_equals_unchunked(spark, name):
    base = registry.QUERIES[name](spark, SF001).toPandas()
    spark.conf.set(ROWS_PER_CHUNK_KEY, "7")
    try:
        chunked = registry.QUERIES[name](spark, SF001).toPandas()
    finally:
        spark.conf.unset(ROWS_PER_CHUNK_KEY)
    assert compare(chunked, base) is None, compare(chunked, base)
