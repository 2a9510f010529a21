"""Driver contract: entry() runs, queries() and oracle_sql() agree on names."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.columns == ["method", "t", "score", "rank", "avg_rank"]
    assert df.count() > 0


def test_names_agree():
    mod = _entry()
    assert set(mod.oracle_sql()) <= set(mod.queries())
