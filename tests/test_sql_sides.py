"""Queries against their SQL where the tables are folders of files, or hold marks that rarely come."""

import os

import pytest

import __spark_entry__ as entry_point
from reefline.plans.fixtures import Fixtures
from reefline.plans.stream_side import _landed
from reefline.session import work_folder

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@needs_tables
def test_streams_read_a_table_that_is_a_folder(spark):
    root = work_folder(spark, "folder").removeprefix("file:")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3).write.parquet(f"{root}/documents.parquet")
    query = _landed(Fixtures(spark, root)).writeStream.format("memory").queryName("landed_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("landed_rows").count() == spark.read.parquet(f"{root}/documents.parquet").count() > 0


def test_titles_with_character_references(spark):
    root = work_folder(spark, "pages").removeprefix("file:")
    pages = [(i, f"https://s.example.org/en/{i}", f"<html><title>{t}</title><article>a shark bite on the reef</article></html>")
             for i, t in enumerate(["A &quot;long&quot; title &amp;amp; more", "&nbsp; Another title&nbsp;", "&lt;&lt;&gt;&gt; &#39;x"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    got = sorted(r["title"] for r in entry_point.queries()["A03_whole_harvest"](spark, root).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{root}/pages.parquet/*.parquet'")
    assert got == sorted(r[2] for r in con.sql(entry_point.oracle_sql()["A03_whole_harvest"]).fetchall())
    assert got == ['A "long" title &amp; more', "Another title"]


def test_equal_positions_of_one_report_are_ordered(spark):
    con = duckdb.connect()
    sql = entry_point.oracle_sql()["I08_attach_audit"]
    views = "(SELECT 17 AS submission_id, 1 AS position, 'u' AS source_url, t AS source_title, p AS source_publisher FROM (VALUES %s) v(t, p))"
    body = "WITH " + sql[sql.index("c AS (SELECT submission_id, position"):].replace(
        "FROM sources_v", "FROM (SELECT 0 AS incident_id, '' AS source_url)")
    notes = {con.sql(body.replace("submission_sources_v", views % rows)).fetchall()[0][3]
             for rows in ("('a', 'Paper 1'), ('b', 'Paper 2')", "('b', 'Paper 2'), ('a', 'Paper 1')")}
    assert notes == {"Merged duplicate coverage: Paper 1"}
