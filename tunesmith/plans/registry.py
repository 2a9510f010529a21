"""Registry of named queries: Spark builder + (optional) equivalent DuckDB SQL.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the driver tables.
Oracle SQL runs in DuckDB over the same Parquet tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so their queries register."""
    from tunesmith.plans import catalog_trials  # noqa: F401
    from tunesmith.plans import catalog_space  # noqa: F401
    from tunesmith.plans import catalog_features  # noqa: F401
    from tunesmith.plans import catalog_models  # noqa: F401
    from tunesmith.plans import catalog_search  # noqa: F401
