"""Every query that SQL can express against DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from codelode.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: ("nan" if math.isnan(x) else repr(round(x, 6))) if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got, expected = plain([tuple(r) for r in df.collect()], df.columns), plain(sql.fetchall(), sql.columns)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_pieces_keep_their_limits(spark):
    assert not QUERIES["ch3_pieces_in_lines"](spark, SF).filter("misplaced > 0").count()
    cut = QUERIES["ch2_split_documents"](spark, SF)
    assert not cut.filter("tokens > 400").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() and set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture
def few(spark, tmp_path):
    """What makes a folder whose documents are the rows (doc_id, text) of a source, beside SQL on them."""

    def make(rows):
        docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        return str(tmp_path), con

    return make


def same_as_sql(spark, name, folder, con):
    df, sql = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(sql.fetchall(), sql.columns)


def test_large_notebooks_have_a_cap_of_their_own(spark, few):
    rows = [(80 + i, "word " * 5_000) for i in range(2)] + [(20 + i, f"short {i}") for i in range(12)]
    same_as_sql(spark, "fil4_guarded", *few(rows))


def test_embedder_words_and_documents(spark, few):
    """Words part at the SQL's white space; texts without a word have no row, rows that share a doc_id, or have none, one together."""
    odd = ["", " \t\n\f\r", "abc\x0bdef ghi", "abc\x1cdef", "abc\x85def", "abc\xa0def\u2028ghi\u3000jkl mno", "\xa0", "e\u0301a\u0308o 👩‍👩‍👧 日本語", "a\0b"]
    folder, con = few([*enumerate(odd), (50, "two two"), (50, "six"), (50, ""), (None, "six"), (None, "ten")])
    spark.sql("SELECT 60L AS doc_id, CAST(NULL AS STRING) AS text, 'en' AS lang, 'src1' AS source, 0L AS n_chars").write.mode("append").parquet(f"{folder}/documents.parquet")
    same_as_sql(spark, "ud1_with_embedder", folder, con)
