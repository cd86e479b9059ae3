"""Evidence of documents that are empty or missing, against the checking SQL."""

import pytest

import __spark_entry__ as entry_point
from reefline.session import work_folder

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", ["A07_evidence_shape", "A07_whole_content"])
def test_empty_and_missing_contents(spark, name):
    root = work_folder(spark, "contents").removeprefix("file:")
    texts = ["a shark bite", "", None, " ", "x" * 12_001, "\U0001f988" * 2_001]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{root}/documents.parquet")
    got = entry_point.queries()[name](spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    want = con.sql(entry_point.oracle_sql()[name])
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
