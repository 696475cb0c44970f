"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from phrasewell.plans import catalog, catalog_sql

DIR = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(r[k] for k in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    if not DIR.exists():
        pytest.skip("the test tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(catalog_sql.oracle_sql()) == set(catalog.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DIR))
    cursor = duck.execute(catalog_sql.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark, duck):
    assert contract.entry(spark).columns == ["doc_id", "score"]


def test_filters_reach_the_scan(spark, duck, capsys):
    catalog.exact_phrase(spark, str(DIR)).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(token" in plan.replace("[", "") or "EqualTo(token" in plan or "In(token, " in plan
