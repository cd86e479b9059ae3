"""Every registered query against its checking SQL at the smallest scale, and plan rules."""

import os

import pytest

import __spark_entry__ as entry_point
from reefline.plans import catalog
from reefline.plans.fixtures import BASE_TABLES, Fixtures
from reefline.session import work_folder

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def _sortable(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else v for v in r))


@pytest.mark.parametrize("name", catalog.names())
def test_query(spark, database, name):
    got = entry_point.queries()[name](spark, SF_DIR).toArrow()
    sql = entry_point.oracle_sql()[name]  # every query of this library has its SQL
    want = database.sql(sql).to_arrow_table()

    def plain(table):
        names = sorted(table.column_names)
        rows = zip(*[table.column(n).to_pylist() for n in names])
        return names, _sortable([tuple(None if v is None else str(v) for v in r) for r in rows])
    assert plain(got) == plain(want)


def test_stream_equals_batch(spark):
    run = lambda name: sorted(map(tuple, catalog.run(name, Fixtures(spark, SF_DIR)).select(
        "source_document_id", "status", "attempts", "available_at").collect()), key=str)
    assert run("J01_job_state") == run("J01_job_state_stream")


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["country", "count", "fatal"]


# The streams and the batches that cut lineage run to plan.
@pytest.mark.parametrize("name", catalog.names())
def test_no_cross_join(spark, name):
    df = catalog.run(name, Fixtures(spark, SF_DIR))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from reefline.operators import browse, mapview
    from reefline.schemas import INCIDENTS
    from pyspark.sql import functions as F
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = work_folder(spark, "pushdown")
    spark.createDataFrame([], INCIDENTS).write.parquet(path)
    rows = spark.read.schema(INCIDENTS).parquet(path)
    boxed = mapview.map_rows(rows, "-10,-10,10,10", classification="provoked").select("id", F.col("fatal"))
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(verification_status,verified)", "GreaterThan(longitude,-10.0)", "classification"):
        assert part in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "description" not in scan and "victim_name" not in scan
    searched = browse.filter_incidents(rows, date_from="2020-01-01", fatal=True)
    assert "GreaterThanOrEqual(incident_date" in searched._jdf.queryExecution().executedPlan().toString()


def test_a_merge_builds_its_map_once(spark):
    from reefline.operators import resolve
    from reefline.schemas import AUDIT, CANDIDATES, INCIDENTS, NEWS, SOURCES
    empty = [spark.createDataFrame([], schema) for schema in (INCIDENTS, SOURCES, NEWS, AUDIT, CANDIDATES)]
    merge_map = resolve.guarded_merge_map(resolve.exact_clusters(spark.createDataFrame([], INCIDENTS)))
    done = resolve.merge(*empty, merge_map, "backfill:")
    # the outputs start from the stored map: no plan has the clustering in it
    for name in ("sources", "news", "audit", "candidates", "touched"):
        assert "date_precision" not in done[name]._jdf.queryExecution().optimizedPlan().toString()
