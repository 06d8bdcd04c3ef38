"""Blocks of pages against their SQL, with elements that the given pages lack."""

import duckdb

from quillon import oracles, queries


def test_texts_of_controls_and_fallbacks_are_blocks_too(spark, tmp_path):
    html = "<title>no</title><p>a <button>b</button></p><noscript><p>c</p></noscript><svg><text>d</text></svg><select><option>e</option></select><video>f</video><script>g</script><textarea>h</textarea>"
    spark.createDataFrame([(1, html)], "page_id bigint, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    found = sorted(tuple(r) for r in queries.QUERIES["q_page_blocks"](spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert found == sorted(con.execute(oracles.ORACLE_SQL["q_page_blocks"]).fetchall())
    assert "".join(r[3].replace(" ", "") for r in sorted(found, key=lambda r: r[1])) == "abcdefh"
