"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from granary.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        if isinstance(v, str) or hasattr(v, "year") or isinstance(v, bool):
            return str(v)
        return f"{float(v):.10g}"

    return sorted(repr([one(v) for v in row]) for row in df[sorted(df.columns)].values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    expected = oracle.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
