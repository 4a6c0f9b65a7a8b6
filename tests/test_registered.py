"""Every registered query against its SQL counterpart over whole tables."""

import importlib.util
from pathlib import Path

import pytest
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location(
    "entry_module", Path(__file__).resolve().parent.parent / "__spark_entry__.py"
)
entry_module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_module)
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert not {name for name in set(QUERIES) - set(SQL) if name != "pipeline" and not name.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
