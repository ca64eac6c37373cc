import importlib
import sys

import pytest

from ffspark.plans import registry
from oracle import assert_same

SQL = registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
    assert set(registry.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(spark, registry.queries()[name], SQL[name], sf_dir)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_survives_what_is_not_installed(monkeypatch):
    """Without something that the llm package needs, its queries are left out with a warning, and the others stay."""
    for name in [n for n in sys.modules if n == "__spark_entry__" or n == "corpus_pipeline" or n.startswith("ffspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    with pytest.MonkeyPatch.context() as context:
        context.setattr("warnings.warn", lambda *a, **k: None)
        e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    for name in [n for n in sys.modules if n.startswith("ffspark.llm")]:
        sys.modules.pop(name)
