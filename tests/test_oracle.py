"""Every registered query against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from factorlab.plans import factor_queries  # noqa: F401  (registers the queries)
from factorlab.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return db


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        found = tables.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        assert table(df.columns, rows) == table(names, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_there", lambda name: False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
