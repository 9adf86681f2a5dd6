"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trajlab.plans import clusters, files, model, relational, trajectories

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = trajectories.SQL | clusters.SQL | relational.SQL | model.SQL | files.SQL
QUERIES = trajectories.QUERIES | clusters.QUERIES | relational.QUERIES | model.QUERIES | files.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, (str, bool)) else repr(round(float(v), 6) + 0.0)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(theirs) > 0
    assert told(ours) == told(theirs)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_seeded_features(spark):
    import numpy as np

    rows = {r.doc_id: r for r in clusters.seeded_features(spark, DATA).collect()}
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    for d, t in zip(docs.doc_id[:20], docs.text[:20]):
        v = np.random.RandomState(sum(map(ord, t)) % (1 << 32)).rand(256)
        assert (rows[d]["first"], rows[d]["last"]) == (round(v[0], 6), round(v[255], 6))
