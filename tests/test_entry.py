import importlib.util
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import queries as base

DATA = "/root/testdata/sf0.001"


def rows(df):
    def cell(x):
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = base.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({base.ORACLES[name]})").fetchall()
    assert rows(got.select(*columns).collect()) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden", [("corpus_pipeline", "lodestrata.llm"), ("zstandard",), ("public_tokenizers",)])
def test_entry_imports_without_the_corpus_operators(monkeypatch, hidden):
    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(hidden):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("lodestrata.llm") or m.startswith(hidden)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("lodestrata.llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("bare_entry", entry.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.queries()) == set(base.QUERIES)
    assert set(module.oracle_sql()) == set(base.ORACLES)
