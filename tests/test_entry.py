import os

import duckdb
import pytest

import __spark_entry__
from clipgrain.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    keep = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted(repr([keep(v) for v in row]) for row in rows)


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def test_entry(spark):
    assert "verdict" in __spark_entry__.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, small, sql, name):
    df = __spark_entry__.queries()[name](spark, small)
    rows = df.collect()
    assert rows or os.environ.get("ALLOW_EMPTY")
    text = oracles.oracle_sql().get(name)
    if text is None:
        return
    columns = sorted(df.columns)
    want = sql.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({text})").fetchall()
    assert shown([tuple(r[c] for c in columns) for r in rows]) == shown(want)
