"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from quaver.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_empty_tables(spark, empty, name):
    QUERIES[name](spark, empty).collect()
