"""Literal cases of the rules, one small DataFrame each."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reefline.constants import ACTIVITIES, CLASSIFICATIONS, SEVERITIES
from reefline.functions.text import best_option, headline_key, title_case
from reefline.operators import browse, candidates, capture, coast, jobs, lifecycle, mapview
from reefline.operators import normalize, places, stats
from reefline.schemas import INCIDENTS, conform
from reefline.sources import pages, register


def test_relevance(spark):
    cases = [
        ("Great white shark spotted off Bondi", "", False, True),
        ("Mako breaches near boat", "fishermen stunned", False, True),
        ("New documentary about the ocean", "whales and dolphins", False, False),
        ("", "A wobbegong rested on the reef", False, True),
        (None, "A tiger shark was spotted", False, True),
        ("Swimmer Mauled Near Esperance", "", True, True),
        ("Swimmer Mauled Near Esperance", "", False, False),
        ("Why you need to look at everything", "", True, False),
        ("Cyber attacks increased this year", "", False, False),
    ]
    df = spark.createDataFrame(cases, "title string, content string, trusted boolean, want boolean")
    got = df.select("want", capture.is_relevant().alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


@pytest.mark.parametrize("options,cases", [
    (CLASSIFICATIONS, {"provoked": "provoked", "Provoked": "provoked", "unprovoked": "unprovoked",
                       "Unprovoked attack": "unprovoked", "boat bite": "boat_bite",
                       "gibberish": None, "": None}),
    (SEVERITIES, {"severe injuries": "severe", "no injury": "no_injury"}),
    (ACTIVITIES, {"spearfishing": "spearfishing", "went fishing": "fishing"}),
])
def test_enumeration_repair(column, options, cases):
    assert column(lambda c: best_option(c, options), list(cases)) == list(cases.values())
    assert column(lambda c: best_option(c, options), [(None,)]) == [None]


def test_country_species_bool(column):
    countries = {"USA": "United States", "U.S.": "United States", "UK": "United Kingdom",
                 "RSA": "South Africa", "Australia": "Australia", "  Fiji ": "Fiji"}
    assert column(normalize.canonical_country, list(countries)) == list(countries.values())
    species = {"Great White Shark": "Carcharodon carcharias", "scalloped hammerhead": "Sphyrna mokarran",
               "Galeus melastomus": "Galeus melastomus", "some big fish": "some big fish", "": None}
    assert column(normalize.canonical_species, list(species)) == list(species.values())
    truth = {"true": True, "FALSE": False, "unknown": False, "1": True}
    assert column(lambda c: normalize.to_bool(c, F.lit(False)), list(truth)) == list(truth.values())


def test_answer_forms(column):
    cases = {
        '{"a": 1}': '{"a": 1}', '  {"a": 1}\n': '{"a": 1}',
        'x\n```json\n{"a": 2}\n```': '{"a": 2}', "```\n{}\n```": "{}",
        'so {"a": {"b": 3}} ok': '{"a": {"b": 3}}', "[1, 2]": None, "null": None,
        "no": None, "": None, '{"broken": ': None, '} {': None,
    }
    assert column(normalize.json_object, list(cases)) == list(cases.values())


def test_vague_places(column):
    cases = {
        ("South Africa", "South Africa", None): True, ("Florida", "United States", "Florida"): True,
        ("", "United States", "Florida"): True, (None, "Australia", None): True,
        (" south africa ", "South Africa", None): True,
        ("New Smyrna Beach", "United States", "Florida"): False, ("Coral Sea", "Australia", None): False,
        ("California beach", "United States", "California"): True,
        ("Northern California", "United States", "California"): True,
        ("off Calif. Coast", "United States", "California"): True,
        ("NorCal", "United States", "California"): True, ("Qld island", "Australia", "Queensland"): True,
        ("near a pier", "United States", "California"): True,
        ("Long Beach", "United States", "California"): False,
    }
    assert column(coast.is_vague, list(cases)) == list(cases.values())


def test_search_variants(spark):
    rows = [(1, "Maine", "United States", "Maine"),
            (2, "near Ossabaw Island, Georgia", "United States", "Georgia"),
            (3, "Point Plomber North of Port Macquarie", "Australia", "NSW"),
            (4, "Cooee Beach west of Burnie", "Australia", "Tasmania"),
            (5, "Newport", "United States", "California")]
    df = spark.createDataFrame(rows, "id long, location_description string, country string, state_province string")
    got = {}
    for r in places.ranked_queries(df).orderBy("id", "query_rank").collect():
        got.setdefault(r["id"], []).append(r["query"])
    assert got[1] == ["Maine, United States"]
    assert "Ossabaw Island, Georgia, United States" in got[2]
    assert got[3][0] == "Point Plomer North of Port Macquarie, New South Wales, Australia"
    assert "Cooee Beach, Tasmania, Australia" in got[4]
    assert got[5][0] == "Newport Beach, California, United States"


def test_links(column):
    base = F.lit("https://site.example")
    links = {"https://site.example/a-bite/": "https://site.example/a-bite/",
             "/x/": "https://site.example/x/", "javascript:pin();": None, "#top": None, "": None}
    assert column(lambda c: pages.absolute_url(c, base), list(links)) == list(links.values())
    paths = {"https://s.example/man-loses-arm/": True, "https://s.example/": False,
             "https://s.example/recent-articles/": False, "https://s.example/2026-shark-attack-map/": False,
             "https://s.example/all-2024-fatal-shark-attacks/": False}
    assert column(pages.is_article, list(paths)) == list(paths.values())


def test_off_site_links_are_dropped(spark):
    html = ('<article><a href="/real-story/">A real story here</a></article><h2><a '
            'href="https://share.example/?u=https://site.example/x">Share this story</a></h2>')
    index = spark.createDataFrame([(1, "https://site.example/", html)], "page_id long, url string, html string")
    assert [r["url"] for r in pages.article_links(index).collect()] == ["https://site.example/real-story/"]
    assert pages.article_links(index, ["other.example"]).count() == 0


@pytest.mark.parametrize("html, want", [
    ('<div class="entry-content"><div>first</div><p>second</p></div><p>out</p>', "first\nsecond"),
    ('<section class="x post-content"><section><section>a</section>b</section> c <br> d</section>e', "a\nb\nc\nd"),
    ('<article><div class=content>in<div class="social-share">share<div>x</div></div><p>it &amp; more</div>out</article>', "in\nit & more"),
    ('<div class="content">not in an article</div>', None), ("<article>no body class</article>", None),
    ('<div class="article-body"><article>a</article><nav><div>n</div></nav><script>"</div>"</script>b<!-- </div> -->c</div>d', "a\nb\nc"),
    ('<div class="entry-content">never closed <p>one<p>two', "never closed\none\ntwo"),
    ('<div class="post-content">first</div><div class="entry-content">second</div>', "first"), ("", None), (None, None),
    ('<article><article><p class="content">inner</p></article></article>', "inner"),
    ('<div class="comments"><div class="entry-content">kept</div></div>', "kept")])
def test_article_bodies_end_at_their_own_tag(spark, html, want):
    page = spark.createDataFrame([(1, "https://site.example/a", html)], "page_id long, url string, html string")
    got = [r["body"] for r in pages.article_bodies(page).collect()]
    assert got == ([] if want is None else [want])


def test_links_come_from_elements(spark):
    html = ('<nav><a href="/nav/">navigation link</a></nav><article class="post"><div><a href="/first/">The <b>first</b> story</a></div>'
            '<a href="/second/">not the first of its article</a><h2><a href=/third/>Third <i>story</i></a></h2></article>'
            '<div class="entry-content"><div><a>no target</a></div><p><a href="/fourth/">Fourth story</a></div><a href="/fifth/">outside</a>'
            '<h3>text</h3><a href="/sixth/">after a heading</a><article><h2>no link</h2></article><h3><a href="/first/">again</a></h3>')
    index = spark.createDataFrame([(1, "https://site.example/", html)], "page_id long, url string, html string")
    got = {r["url"].split("/")[-2]: (r["position"]["at"], r["title"]) for r in pages.article_links(index).collect()}
    assert {k: t for k, (_, t) in got.items()} == {"first": "Thefirststory", "third": "Thirdstory", "fourth": "Fourth story"}
    assert sorted(got, key=got.get) == ["first", "third", "fourth"]


def test_match_key(column):
    key = lambda d, c, p, k: candidates.match_key(d, c, p, k)
    rows = [("2026-07-12", "United States", "  Test   Beach ", "unprovoked"),
            ("2026-07-12", "", "Test Beach", "unprovoked"), (None, "Fiji", "x", "y")]
    assert column(key, rows) == ["2026-07-12|united states|test beach|unprovoked", None, None]


def test_headlines(column):
    same = "Teenager bitten at popular surfing beach"
    cases = {f"{same} - Yahoo": same.lower(), f"{same.upper()}  -  x - Local": None or (same.lower() + " - x"),
             "A full list of incidents in the whole year - Paper": None, "Too short - Paper": None}
    assert column(headline_key, list(cases)) == list(cases.values())


def test_title_case(column):
    assert column(title_case, ["NEW ZEALAND", "guinea-bissau", "o'neil"]) == [
        "New Zealand", "Guinea-Bissau", "O'Neil"]


def test_register_dates(spark):
    rows = [(1, "18th March", "1999"), (2, "March 18", "1999"), (3, "30 Feb", "1999"),
            (4, "Late August", "1950"), (5, "Summer", "1950"), (6, "1 Jan", "1850"), (7, None, "1960")]
    df = spark.createDataFrame(rows, "id long, date_text string, year_text string")
    got = {r["id"]: (r["incident_date"], r["date_precision"])
           for r in register.import_register(df).select("id", "incident_date", "date_precision").collect()}
    assert got == {1: (date(1999, 3, 18), "exact"), 2: (date(1999, 3, 18), "exact"),
                   3: (date(1999, 2, 1), "month"), 4: (date(1950, 8, 1), "month"),
                   5: (date(1950, 1, 1), "year"), 7: (None, "year")}


def test_box():
    assert mapview.parse_box(" -82, 28,-79,30") == (-82.0, 28.0, -79.0, 30.0)
    with pytest.raises(ValueError):
        mapview.parse_box("1,2,3")


def test_box_edge_is_outside(spark):
    df = spark.createDataFrame([(1, -82.0, 29.0), (2, -81.0, 29.0)], "id long, longitude double, latitude double")
    assert [r["id"] for r in df.filter(mapview.inside_box("-82,28,-79,30")).collect()] == [2]


def test_retry_schedule(column):
    waits = column(lambda c: jobs.retry_seconds(c.cast("int")), ["0", "1", "2", "7", "8", "40"])
    assert waits == [300, 300, 600, 19200, 21600, 21600]


def test_null_order_and_unknown_sort(spark):
    df = spark.createDataFrame([(1, None), (2, date(2020, 1, 1)), (3, date(2021, 1, 1))],
                               "id long, incident_date date")
    ids = lambda *a: [r["id"] for r in df.orderBy(*browse.incident_order(*a)).collect()]
    assert ids("nonsense", "desc") == [1, 3, 2]
    assert ids("incident_date", "up") == [2, 3, 1]


def test_keyset_pages_equal_offset_pages(spark):
    df = spark.createDataFrame(
        [(i, None if i % 5 == 0 else date(2020, 1, 1 + i % 7)) for i in range(40)], "id long, incident_date date")
    for order in ("asc", "desc"):
        want = [r["id"] for r in df.orderBy(*browse.incident_order("incident_date", order)).collect()]
        got, rows = [], df.orderBy(*browse.incident_order("incident_date", order)).limit(7).collect()
        while rows:
            got += [r["id"] for r in rows]
            rows = browse.page_after(df, "incident_date", order, rows[-1]["incident_date"], rows[-1]["id"], 7).collect()
        assert got == want


def _incidents(spark, rows):
    names = list(rows[0])
    schema = ", ".join(f"{n} {INCIDENTS[n].dataType.simpleString()}" for n in names)
    return conform(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), INCIDENTS)


def test_statistics_count_attacks_only_and_ignore_status(spark):
    kinds = ["unprovoked", "provoked", "sighting", "sighting", "near_miss"]
    rows = [dict(id=i, classification=k, country="Fiji", fatal=i == 0, verification_status="pending",
                 incident_date=date(2020, 1, 1), shark_species_confirmed=None,
                 shark_species_suspected="Carcharodon carcharias") for i, k in enumerate(kinds)]
    df = _incidents(spark, rows)
    assert stats.overview(df).collect()[0].asDict() == {
        "total_incidents": 2, "total_fatal": 1, "fatality_rate": 50.0, "most_active_country": "Fiji",
        "most_common_species": "Carcharodon carcharias", "year_range": "2020-2020"}
    assert stats.overview(df.filter("false")).collect()[0].asDict() == {
        "total_incidents": 0, "total_fatal": 0, "fatality_rate": 0.0, "most_active_country": None,
        "most_common_species": None, "year_range": None}
    assert stats.by_year(df).collect()[0]["count"] == 2


def test_public_view_hides_and_coarsens(spark):
    rows = [dict(id=1, verification_status="verified", location_precision="exact", longitude=-80.92749,
                 latitude=29.02651, victim_name="A", victim_age=25, description="text"),
            dict(id=2, verification_status="verified", location_precision="approximate", longitude=-80.92749,
                 latitude=29.02651, victim_name="B", victim_age=26, description="text"),
            dict(id=3, verification_status="pending", location_precision="exact", longitude=1.0,
                 latitude=1.0, victim_name="C", victim_age=1, description="text")]
    shown = browse.public_view(_incidents(spark, rows))
    assert not {"victim_name", "victim_age", "description"} & set(shown.columns)
    assert {r["id"]: (r["longitude"], r["latitude"]) for r in shown.collect()} == {
        1: (-80.927, 29.027), 2: (-80.93, 29.03)}


def test_case_numbers_never_return_and_keep_four_digits(spark):
    incidents = _incidents(spark, [dict(id=1, case_number="CASE-2026-0007"), dict(id=2, case_number="CASE-2026-odd")])
    counters = spark.createDataFrame([(2026, 11), (2025, 9999)], "year int, last_value int")
    new = spark.createDataFrame([(5, 2026, 2), (6, 2026, 1), (7, 2025, 1), (8, 2024, 1)], "k long, year int, at int")
    got = lifecycle.allocate_case_numbers(new, incidents, counters, ["at", "k"])
    assert {r["k"]: r["case_number"] for r in got.collect()} == {
        6: "CASE-2026-0012", 5: "CASE-2026-0013", 7: "CASE-2025-10000", 8: "CASE-2024-0001"}


def test_patch_presence(spark):
    incidents = _incidents(spark, [dict(id=1, country="Fiji", description="old", victim_age=3)])
    patches = spark.createDataFrame(
        [(1, 0, {"description": None, "country": "Tonga"}), (1, 1, {"country": "Palau", "id": "9"})],
        "incident_id long, seq int, patch map<string,string>")
    row = lifecycle.partial_update(incidents, patches).collect()[0]
    assert (row["id"], row["country"], row["description"], row["victim_age"]) == (1, "Palau", None, 3)


def test_search_needs_every_word_or_the_case(spark):
    df = spark.createDataFrame(
        [(1, "Surfing at Bells Beach", "bitten while surfing", "CASE-1"), (2, "Bells", "swimming", "CASE-2")],
        "id long, location_description string, description string, case_number string").withColumns(
        {"country": F.lit("Australia"), "victim_name": F.lit(None).cast("string")})
    ids = lambda q: sorted(r["id"] for r in df.filter(browse.incident_search(q)).collect())
    assert ids("surfed at the bells") == [1]
    assert ids("bells") == [1, 2]
    assert ids("case-2") == [2]
    assert ids("the of") == []
    assert ids("100%") == []


def test_news_end_date_is_midnight(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 9)), (2, datetime(2024, 1, 9, 0, 0, 1))],
                               "id long, captured_at timestamp_ntz")
    got = df.filter(browse.captured_range("captured_at", None, "2024-01-09")).collect()
    assert [r["id"] for r in got] == [1]
