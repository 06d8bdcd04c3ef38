"""Every registered query of the clipboard engine against its SQL, and the driver's contract."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quillon import hard_queries, oracles, queries, state_queries  # noqa: F401

QUERIES, ORACLE_SQL = queries.QUERIES | state_queries.QUERIES, oracles.ORACLE_SQL | state_queries.ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    got = Counter(tuple(rounded(r[c]) for c in sorted(columns)) for r in found.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert got == Counter(tuple(rounded(r[i]) for i in order) for r in result.fetchall())


def test_every_query_is_registered_and_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["id", "destination", "ok", "reason", "kind", "label", "html", "text", "changed", "notes"]
    found = rows.collect()
    assert len({r["id"] for r in found}) == len(found) > 0
    assert all(r["text"] for r in found if r["ok"]) and not any("<script" in (r["html"] or "") for r in found)


def test_page_blocks_keep_their_tags_and_numbers(spark, tmp_path):
    html = "<div><h2>One &amp;</h2><h4>Two</h4><pre>three</pre></div><table><tr><th>four</th><td>five</td></tr></table><blockquote>six</blockquote>"
    spark.createDataFrame([(1, html), (2, "<h3>Seven &amp")], "page_id bigint, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    found = [tuple(r) for r in QUERIES["q_page_blocks"](spark, f"file://{tmp_path}").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(found) == sorted(con.execute(ORACLE_SQL["q_page_blocks"]).fetchall())
    tags = {text: tag for _, _, tag, text in found}
    assert tags == {"One &": "h2", "Two": "h4", "three": "pre", "four": "th", "five": "td", "six": "blockquote", "Seven &amp": "h3"}


@pytest.mark.parametrize("name", ["q_inline", "q_nested_marks", "q_line_blocks"])
def test_tables_of_one_split_are_dealt_out(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(4)" in plan
