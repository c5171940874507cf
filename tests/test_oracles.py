"""Every registered query of the library that has SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from brasswork.plans import registry

NAMES = sorted(registry.oracle_sql())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return float(x) if not isinstance(x, (str, bool)) else x


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, sf, duck, name):
    frame = registry.queries()[name](spark, sf)
    found = frame.collect()
    asked = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    wanted = asked.fetchall()
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, found) == rows(columns, wanted)


def test_every_query_has_a_name_once():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    with pytest.raises(ValueError):
        registry.register(NAMES[0], lambda s, d: None)


def test_missing_tables_fail(spark):
    with pytest.raises(Exception):
        registry.queries()["kpis"](spark, os.devnull)
