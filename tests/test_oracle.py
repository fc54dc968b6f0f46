"""Every query with SQL against DuckDB at the smallest size."""

import pytest

import __spark_entry__ as e
from tests.oracle import DATA, compare

CORE = {name: f for p in e._plans() if not p.__name__.startswith("cardloom.llm") for name, f in p.QUERIES.items()}


@pytest.mark.parametrize("name", [n for n in CORE if n in e.oracle_sql()])
def test_same_as_sql(spark, name):
    assert compare(spark, name, CORE[name], e.oracle_sql()[name], f"{DATA}/sf0.001") == ""


@pytest.mark.parametrize("name", [n for n in CORE if n not in e.oracle_sql()])
def test_runs(spark, name):
    assert CORE[name](spark, f"{DATA}/sf0.001").count() >= 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
