"""Matching reads the reports' sources once; headlines of plain titles need no pattern."""

import pytest
from pyspark.sql import functions as F

from reefline.functions.text import headline_text, plain_blanks, squash
from reefline.operators import resolve
from reefline.schemas import INCIDENTS, SOURCES, conform

TITLE = "Teenager bitten at popular surfing beach"


@pytest.fixture
def stored(spark):
    incidents = spark.createDataFrame([(n, f"CASE-{n}", "verified") for n in range(1, 7)],
                                      "id long, case_number string, verification_status string")
    sources = spark.createDataFrame(
        [(1, 1, "u1", None), (2, 2, "u1", TITLE), (3, 3, None, TITLE.replace("at ", "at\t")), (4, 3, None, f"{TITLE} and more"),
         (5, 4, None, f" {TITLE} two"), (6, 5, None, f"{TITLE} two - Outlet"), (7, 6, "u6", "short")],
        "id long, incident_id long, source_url string, source_title string")
    return conform(sources, SOURCES), conform(incidents, INCIDENTS)


def test_each_report_source_is_read_once(spark, stored):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    given = spark.createDataFrame(
        [(1, "u1", "nothing"), (2, "none", f"{TITLE} - A"), (3, "none", f"{TITLE} two"), (4, "u6", TITLE), (4, "u6", TITLE), (5, None, None)],
        "submission_id long, source_url string, source_title string")
    reports = spark.createDataFrame([(n,) for n in range(1, 6)], "submission_id long").select(
        "submission_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("incident_date", "date"), ("date_precision", "string"), ("classification", "string"), ("longitude", "double"),
            ("latitude", "double"), ("victim_age", "int"), ("victim_sex", "string"))])
    rows = resolve.match_cascade(reports, given.mapInArrow(counted, given.schema), *stored).collect()
    assert {r["submission_id"]: (r["incident_id"], r["matched_by"]) for r in rows} == {
        1: (1, "url"), 2: (2, "headline"), 3: (5, "headline"), 4: (6, "url"), 5: (None, None)}
    assert read.value == 6


def test_headline_of_plain_and_odd_titles(column):
    titles = ["A Plain  - title - Outlet", " Blank before - and after - X", "Tab\there", "Line\r\nbreak\x0b\x0c", "Ünder wäter  Hai",
              "no break", "one two", " one two ", " - Outlet", "", "a - b", "next\u0085line", "\x1cunit"]
    assert column(headline_text, titles) == column(lambda t: F.lower(squash(F.when(
        F.contains(t, F.lit(" - ")), F.left(t, F.length(t) - F.length(F.substring_index(t, " - ", -1)) - 3)).otherwise(t))), titles)
    assert column(plain_blanks, ["one two", "one  two", "one\ttwo", "Hai im Wässer", " one "]) == [True, False, False, False, True]
