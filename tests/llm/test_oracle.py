"""The operators that have SQL against it, on the smallest tables and on odd rows."""

import os
from pathlib import Path

import duckdb
import pytest

from phrasewell.llm import oracle, queries

DIR = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001"))


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(r[k] for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query_equals_its_sql(spark, name):
    if not DIR.exists():
        pytest.skip("the test tables aren't here")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, str(DIR))
    cursor = con.execute(oracle.oracle_sql()[name])
    got = rows(df.columns, map(tuple, df.collect()))
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got == want and want[1]


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_suffix_array_dedup", "op9_decontamination"])
def test_odd_rows(spark, full, odd, prose, tmp_path, name):
    base = [(100 + k, prose.text(120)) for k in range(30)]
    docs = odd + base + [(300, base[3][1]), (301, f"{prose.text(9)} {base[4][1]} {base[4][1]}"), (302, "junk spam " * 40), (303, base[5][1] + " ätna " + base[6][1])]
    items = [(1, base[7][1]), (2, prose.text(6)), (None, None), (3, ""), (4, " ".join(base[8][1].split()[5:10]))]
    labels = [(100 + k, 1, 0) for k in range(20)] + [(302, 0, 0), (None, 1, 0), (5, None, 1)]
    full(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    cursor = con.execute(oracle.oracle_sql()[name])
    got, want = rows(df.columns, map(tuple, df.collect())), rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want and want[1]
