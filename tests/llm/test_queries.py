"""Registered queries against DuckDB, and the pipeline against plain Python, on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry_point
from reefline.llm import quality, queries
from reefline.llm.common import stored
from test_dedup import near_components
from test_operators import check_pack

duckdb = pytest.importorskip("duckdb")


def test_all_are_registered():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_point.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sample_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sample_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, sample_dir).toArrow()
    columns = sorted(want.column_names)
    rows = lambda t: Counter(zip(*[t.column(c).to_pylist() for c in columns]))
    assert rows(got) == rows(want) and got.num_rows == want.num_rows


def test_pipeline(spark, sample_dir):
    docs = [spark.read.parquet(f"{sample_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], sample_dir), name))
    assert all(d.columns == docs[0].columns for d in docs[:-1])
    rows = [[(r.doc_id, r.text, r.source) for r in d.collect()] for d in docs[:-1]]
    labels = spark.read.parquet(f"{sample_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scores = quality.score(docs[0].select("doc_id", "text"), quality.fit(docs[0], labels))
    good = {r.doc_id for r in scores.filter(F.col("score") >= quality.THRESHOLD).collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r[0] in good)
    largest = {}
    for i, text, _ in rows[1]:
        largest[text] = max(i, largest.get(text, -1))
    assert Counter(rows[2]) == Counter(r for r in rows[1] if largest[r[1]] == r[0])
    kept = {i for i, _, component, _ in near_components([r[:2] for r in rows[2]], 5, 80) if i == component}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if r[0] in kept)
    times = Counter(rows[4])
    assert set(times) <= set(rows[3]) and max(times.values()) <= 2
    words = lambda t: len(t.encode().split())
    assert abs(sum(n * words(r[1]) for r, n in times.items()) / sum(words(r[1]) for r in rows[3]) - 1.5) < 0.1
    check_pack(docs[4], [r[:2] for r in rows[4]], 4096)
    assert docs[5].agg(F.sum("length")).first()[0] == sum(
        r.length for r in corpus_pipeline.packed_sequences(spark, docs[4], sample_dir).collect())
    direct = corpus_pipeline.run(spark, sample_dir)
    assert Counter(map(tuple, direct.select("doc_id", "length").collect())).total() == docs[5].count()
