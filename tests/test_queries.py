"""Every query with SQL gives the rows of DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    want = con.execute(entry.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    assert sorted(df.columns) == names
    order = [c[0] for c in want.description]
    rows = sorted(repr([dict(zip(order, r, strict=True))[n] for n in names]) for r in want.fetchall())
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == rows


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Queries of operators that leave rows out or change them: the rows they would give if the operator did nothing.
NOTHING_DONE = {
    "exact_url_dedup": "SELECT (SELECT count(*) FROM pages) + (SELECT sum(len(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) FROM pages)",
    "unresolved_links": "SELECT 2 * count(*) FROM pages",
    "due_notices": "SELECT count(DISTINCT user_id) FROM events",
    "url_list_by_source": "SELECT count(*) FROM documents",
    "run_notices": "SELECT 2 * count(*) FROM events",
    "raw_lines_kept_once": "SELECT count(*) + count(*) FILTER (event_id < 1000) FROM events",
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(NOTHING_DONE))
def test_the_query_would_show_an_operator_that_does_nothing(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    [(n,)] = con.execute(NOTHING_DONE[name]).fetchall()
    assert 0 < con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()[name]})").fetchone()[0] < n


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_queries_meet_every_case(spark):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER.replace('0.001', '0.01')}/{t}.parquet'")
    of = lambda name, column: {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({entry.oracle_sql()[name]})").fetchall()}
    assert of("migrated_pages", "skip_reason") == {"markup", "theme", "breadcrumb", None}
    assert of("document_tool_lines", "line LIKE '%...' AND length(line) > 100") == {True, False}
