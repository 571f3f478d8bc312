"""Corpus queries against their SQL, on the smallest tables and on tables of odd rows."""

import os

import duckdb
import pytest

from dekadal.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark, sf, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'' if os.path.isfile(f'{sf}/{t}.parquet') else '/*.parquet'}'")
    df = queries.QUERIES[name](spark, sf)
    got = list(map(tuple, df.collect()))
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, SF, name, "documents", "labels", "benchmark", "conversations")


def test_audit_of_odd_rows_equals_sql(spark, tmp_path, texts):
    rows = [(i % 37 if i % 5 else None, t, (None, "", "web", "books")[i % 4]) for i, t in enumerate([*texts, *texts[:30]])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (2, None, 1), (2, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(same(spark, str(tmp_path), "op12_filter_audit", "documents", "labels")) == 3 * 600


def test_trie_of_odd_rows_equals_sql(spark, tmp_path):
    rows = [(c, t if t != 2 else None, None if t == 1 else "user", None if c % 7 == 3 else f"text {t} {c % 3}") for c in [*range(-30, 60), 140, 155] if c != 20 for t in range(1 + c % 5)]
    rows += [(0, 0, "user", "a tie"), (0, 0, "assistant", "a tie"), (0, 0, "user", "a tie"), (None, 0, "user", "no id")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert same(spark, str(tmp_path), "op11_prefix_trie", "conversations")
