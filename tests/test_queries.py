"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import SF

from tidewatch.queries import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    rows, ours, theirs = differences(registry.queries()[name](spark, SF), SQL[name], con)
    assert not ours and not theirs, (rows, ours[:3], theirs[:3])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_without_optional_parts(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, *a, **k):
        if name.split(".")[0] in ("llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named '{name}'", name=name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.split(".")[0] in ("llm", "corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries())
    sys.modules.pop("__spark_entry__", None)
