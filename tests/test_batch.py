"""Submission batches against a walk in plain Python, one report after the other."""

import random
from datetime import date, datetime, timedelta

import pytest

from reefline.operators import lifecycle
from reefline.schemas import INCIDENTS, SOURCES, conform

from test_brute_force import haversine

REPORTS = ("submission_id long, incident_date date, date_precision string, classification string, longitude double, latitude double, "
           "victim_age int, victim_sex string, role string, submitted_at timestamp_ntz, fatal boolean")
REPORT_SOURCES = "submission_id long, position int, source_url string, source_title string, source_publisher string, source_type string"
STORED = ("id long, case_number string, incident_date date, classification string, longitude double, latitude double, victim_age int, "
          "victim_sex string, verification_status string")
STORED_SOURCES = "id long, incident_id long, source_url string, source_title string"
DAY = date(2024, 5, 1)


def headline(title):
    text = " ".join((title or "").rsplit(" - ", 1)[0].split()).lower()
    return text if len(text) >= 30 and not text.startswith(("a full list of", "latest articles", "recent articles")) else None


def walk(reports, report_sources, stored, stored_sources, floor):
    """What the reports become, in order; the rules one by one, without any index."""
    held = {i: {"case": c, "place": (d, k, x, y, a, s), "live": v != "rejected", "sources": []} for i, c, d, k, x, y, a, s, v in stored}
    for _, i, url, title in stored_sources:
        held[i]["sources"].append((url, title))
    floor = max([floor, *(int(c.split("-")[2]) for _, c, *_ in stored if c.startswith("CASE-2024-"))])
    made, out, count = [], {}, 0

    def least(test):
        hits = [(row["case"], i) for i, row in held.items() if row["live"] and test(row)]
        return min(hits)[1] if hits else None
    for r in sorted(reports, key=lambda r: (r[9], r[0])):
        sid, day, precision, kind, x, y, age, sex = r[:8]
        mine = [(u, t) for s, _, u, t, _, _ in sorted(report_sources, key=lambda q: q[:2]) if s == sid]
        urls = {u for u, _ in mine if u}
        heads = {headline(t) for _, t in mine} - {None}
        hit, how = least(lambda row: any(u in urls for u, _ in row["sources"])), "url"
        if hit is None:
            hit, how = least(lambda row: any(headline(t) in heads and t.lower().startswith(headline(t)[:80]) for _, t in row["sources"] if t)), "headline"
        if hit is None and precision == "exact" and day is not None and x is not None:
            def near(row):
                d, k, lon, lat, a, s = row["place"]
                return (d == day and k == kind and lon is not None and haversine(lat, lon, y, x) * 1000 <= 150
                        and not (a is not None and age is not None and a != age) and not (s is not None and sex is not None and s != sex))
            hit, how = least(near), "place"
        if hit is None:
            count += 1
            hit, how = sid, "created"
            held[sid] = {"case": f"CASE-2024-{floor + count:04d}", "place": (day, kind, x, y, age, sex), "live": True, "sources": list(mine)}
            made += [(sid, u, t) for u, t in mine]
        else:
            for u, t in mine:
                if u and any(u == v for v, _ in held[hit]["sources"]):
                    continue
                held[hit]["sources"].append((u, t))
                made.append((hit, u, t))
        out[sid] = (hit, held[hit]["case"], how)
    return out, sorted(made, key=str)


def check(spark, reports, report_sources, stored=(), stored_sources=(), last=0):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    result = lifecycle.submit(
        frame(reports, REPORTS), frame(report_sources, REPORT_SOURCES), conform(frame(stored, STORED), INCIDENTS),
        conform(frame(stored_sources, STORED_SOURCES), SOURCES), frame([(2024, last)], "year int, last_value int"), 2024)
    got = {r["submission_id"]: (r["incident_id"], r["case_number"], r["matched_by"]) for r in result["outcome"].collect()}
    want, made = walk(reports, report_sources, stored, stored_sources, last)
    assert got == want
    added = result["sources"].collect()
    assert sorted(((r["incident_id"], r["source_url"], r["source_title"]) for r in added), key=str) == made
    assert {r["id"]: r["case_number"] for r in result["incidents"].collect()} == {i: c for i, c, how in want.values() if how == "created"}
    return want


def report(sid, x=None, y=None, age=None, sex=None, minute=None, precision="exact", day=DAY, kind="unprovoked"):
    return (sid, day, precision, kind, x, y, age, sex, "public", datetime(2024, 6, 1) + timedelta(minutes=sid if minute is None else minute), False)


def source(sid, url=None, title=None, position=1):
    return (sid, position, url, title, "Paper", "news_article")


TITLE = "A swimmer was bitten at the long beach of the bay"


def test_victims_that_contradict_stay_apart(spark):
    got = check(spark, [report(1, 10.0, 5.0, 20), report(2, 10.0, 5.0, 60), report(3, 10.0, 5.0, None, "male"), report(4, 10.0, 5.0, 60, "female")], [source(9)])
    assert [got[i][0] for i in (1, 2, 3, 4)] == [1, 2, 1, 2]


def test_points_across_a_rounding_border_are_one(spark):
    got = check(spark, [report(1, 10.00049, 5.0), report(2, 10.00051, 5.0), report(3, 10.0025, 5.0)], [source(9)])
    assert got[2][0] == 1 and got[3][0] == 3


def test_a_report_joins_a_stored_incident_through_one_of_its_batch(spark):
    stored = [(500, "CASE-2020-0001", DAY, "unprovoked", 0.0, 0.0, None, None, "verified")]
    got = check(spark, [report(1), report(2), report(3)], [source(1, "u1"), source(1, "u2", None, 2), source(2, "u2"), source(2, "u3", TITLE, 2), source(3, "u4", TITLE + " - X")],
                stored, [(1, 500, "u1", "Old")])
    assert {i: r[0] for i, r in got.items()} == {1: 500, 2: 500, 3: 500} and got[3][2] == "headline"


def test_only_founders_have_a_place_and_arrival_decides(spark):
    # 3 joins 1 by URL from far away: its own place counts for nobody; 0 arrives last
    reports = [report(1, 10.0, 5.0), report(3, 20.0, 5.0), report(4, 20.0, 5.0), report(0, 10.001, 5.0, minute=90), report(5, 10.0012, 5.0, precision="month")]
    got = check(spark, reports, [source(1, "a"), source(3, "a")])
    assert got[3][0] == 1 and got[4][0] == 4 and got[0][0] == 1 and got[5][2] == "created"


def test_a_left_out_source_does_not_give_its_headline(spark):
    # 2 joins 1 by URL; its title is not stored, as 1 holds the URL already
    got = check(spark, [report(1), report(2), report(3)], [source(1, "a", "Short"), source(2, "a", TITLE), source(3, "b", TITLE)])
    assert got[3] == (3, "CASE-2024-0002", "created")


def test_cases_compare_as_text(spark):
    # the second new case is CASE-2024-10000, which stands before CASE-2024-9999 as text
    got = check(spark, [report(1), report(2), report(3)], [source(1, "a"), source(2, "b"), source(3, "a"), source(3, "b", None, 2)], last=9998)
    assert got[3] == (2, "CASE-2024-10000", "url")


def test_a_key_of_all_reports_takes_few_rounds(spark):
    n = 300
    reports = [report(i, 10.0 + i * 0.0011, 5.0) for i in range(n)]
    got = check(spark, reports, [source(i, "hot" if i % 3 else f"own{i}", f"{TITLE} number {i // 50} - P{i}") for i in range(n)])
    assert sum(how == "created" for _, _, how in got.values()) > 2


@pytest.mark.parametrize("seed", range(4))
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    some = lambda values, chance=0.5: rnd.choice(values) if rnd.random() < chance else None
    url = lambda: some([f"u{i}" for i in range(25)], 0.8)
    title = lambda: some([f"{TITLE} number {i} - Paper {j}" for i in range(20) for j in range(3)] + ["Short", f"  {TITLE}  twice"], 0.6)
    stored = [(1000 + i, f"CASE-{rnd.choice([2020, 2024])}-{i:04d}", rnd.choice([DAY, None]), "unprovoked", 10 + rnd.randrange(8) * 0.001, 5.0,
               some([20, 30]), some(["male", "female"]), rnd.choice(["verified", "pending", "rejected"])) for i in range(12)]
    stored_sources = [(i, 1000 + rnd.randrange(12), some([f"u{j}" for j in range(40)], 0.7), title()) for i in range(20)]
    reports = [report(i, 10 + rnd.randrange(40) * 0.0007, 5.0 + rnd.randrange(2) * 0.01, some([20, 30]), some(["male", "female"]), rnd.randrange(60),
                      rnd.choice(["exact", "exact", "month"]), rnd.choice([DAY, DAY + timedelta(1), None]), rnd.choice(["unprovoked", "provoked"])) for i in range(70)]
    report_sources = [source(rnd.randrange(70), url(), title(), p) for p in range(75)]
    check(spark, reports, report_sources, stored, stored_sources, rnd.choice([0, 9970]))


def test_reports_follow_chains(spark):
    rows = [(1, "u1"), (2, "u1"), (2, "u2"), (3, "u2"), (3, "u3"), (4, "u3"), (5, "u9"), (6, None)]
    got = check(spark, [report(i, day=None, kind="provoked") for i in range(1, 7)], [source(i, u, None, n) for n, (i, u) in enumerate(rows)])
    assert {i: r[0] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


@pytest.mark.parametrize("block", [3, 7])
def test_prefix_sums_by_blocks(spark, monkeypatch, block):
    from reefline.functions import frames
    rnd = random.Random(block)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(4)}", i, rnd.randrange(99) if rnd.random() < 0.6 else None) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "key string, pos long, v int")
    monkeypatch.setattr(frames, "BLOCK", block)
    got = {r["pos"]: r["low"] for r in frames.least_before(df, "key", "pos", "v", "low", 79).collect()}
    assert got == {p: min((w for j, q, w in rows if j == k and q < p and w is not None), default=None) for k, p, _ in rows}
    some = df.filter("v > 20")
    counted = {r["pos"]: r["n"] for r in frames.count_up_to(some, "pos", "n", 79).collect()}
    assert counted == {p: sum(w is not None and w > 20 and q <= p for _, q, w in rows) for _, p, v in rows if v is not None and v > 20}


def test_empty_batch(spark):
    result = lifecycle.submit(
        spark.createDataFrame([], REPORTS), spark.createDataFrame([], REPORT_SOURCES), spark.createDataFrame([], INCIDENTS),
        spark.createDataFrame([], SOURCES), spark.createDataFrame([], "year int, last_value int"), 2024)
    assert all(df.count() == 0 for df in result.values())
