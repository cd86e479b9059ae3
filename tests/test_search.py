"""The stemmer's published sample vocabulary, and search through the index against search by scan."""

import pytest
from pyspark.sql import functions as F

from reefline.functions.stemming import stem
from reefline.operators import search

# words of the algorithm's published sample vocabulary, with their stems
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight
knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
# what the rules of the steps say
RULES = {"ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "caresses": "caress", "luxuriated": "luxuri",
         "hopping": "hop", "hoping": "hope", "by": "by", "say": "say", "cry": "cri", "generate": "generat", "generously": "generous",
         "communism": "communism", "skis": "ski", "skies": "sky", "dying": "die", "early": "earli", "news": "news", "innings": "inning",
         "outing": "outing", "proceeds": "proceed", "agreed": "agre", "feed": "feed", "youth": "youth", "boyish": "boyish", "sailing": "sail",
         "bitten": "bitten", "bites": "bite", "biting": "bite", "attacks": "attack", "attacked": "attack", "swimmers": "swimmer", "fatally": "fatal",
         "relational": "relat", "rational": "ration", "hesitanci": "hesit", "analogi": "analog", "hopefulness": "hope", "adoption": "adopt", "": "",
         "être": "être", "roll": "roll", "controll": "control", "a": "a", "of": "of"}


def test_published_vocabulary(column):
    cases = dict(zip(PUBLISHED[::2], PUBLISHED[1::2])) | RULES
    got = dict(zip(cases, column(stem, list(cases))))
    assert {w: (got[w], s) for w, s in cases.items() if got[w] != s} == {}


@pytest.mark.parametrize("query", ["biting swimmers", "the", "", "attacked surfers at reefs", "skies", "dying", "happy", "Unknown-words biting", "a bite"])
def test_index_equals_scan(spark, query):
    texts = ["A swimmer was bitten; bites on the leg", "Biting sharks and two swimmers", "Surfer attacks reef", "surfers attacking a reef at night", "",
             None, "happiness under the sky", "He dies", "it was dying", "happy", "unknown words bite", "BITE"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = search.token_index(rows, F.col("text"))
    got = {r["id"] for r in search.search_index(index, query).collect()}
    assert got == {r["id"] for r in rows.filter(search.matches_all_tokens(F.col("text"), query)).collect()}
    if query == "biting swimmers":
        assert got == {0, 1}


def test_a_word_begins_as_its_token_tells(spark):
    from reefline.functions.stemming import KEPT, OWN_STEMS
    texts = [*PUBLISHED, *RULES, *OWN_STEMS, *KEPT, *[f"{a}{b}" for a in ("t", "fl", "why", "enti", "hop", "a", "o") for b in (
        "y", "ied", "ies", "ying", "eed", "eedly", "ing", "ization", "ational", "bli", "ogi", "li", "ement", "ys", "ly", "ll", "ed", "s")]]
    rows = spark.createDataFrame([(w,) for w in texts], "w string").select("w", stem(F.col("w")).alias("t")).collect()
    assert [r for r in rows if r["w"] and not any(r["w"].startswith(b) for b in search.beginnings(r["t"]))] == []


def test_only_words_that_can_match_are_shuffled(spark):
    rows = spark.createDataFrame([(1, "biting swimmers"), (2, "other words")], "id long, text string")
    found = search.search_index(search.token_index(rows, F.col("text")), "biting swimmers")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    left, right = plan[plan.index("Join Inner"):].split("Generate explode")[:2]
    for side in (left, right):  # both the words of the rows and the distinct words to be stemmed
        assert "IN (bi,sw)" in side, plan
    # a scan looks at the query's tokens as given values
    scan = rows.filter(search.matches_all_tokens(F.col("text"), "biting swimmers"))
    assert "[bite,swimmer]" in scan._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_of_words_that_begin_otherwise(spark):
    rows = spark.createDataFrame([(1, "tys tie"), (2, "aed a1"), (3, "tying ox"), (4, None), (5, "")], "id long, text string")
    index = search.token_index(rows, F.col("text"))
    for query in ("tie", "aed"):
        got = {r["id"] for r in search.search_index(index, query).collect()}
        assert got == {r["id"] for r in rows.filter(search.matches_all_tokens(F.col("text"), query)).collect()}, query
        wanted = set(rows.select(search.search_tokens(F.lit(query)).alias("t")).first()["t"])
        each = {r["id"]: set(r["t"] or []) for r in rows.select("id", search.search_tokens(F.col("text")).alias("t")).collect()}
        assert got == {i for i, t in each.items() if wanted and wanted <= t}, query
