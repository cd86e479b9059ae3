"""Feed files, register files and streams over landed files."""

import csv

import pytest
from pyspark.sql import functions as F

from reefline.operators import normalize
from reefline.schemas import RAW_ITEMS, conform
from reefline.sources import feeds, register
from reefline.streaming import capture_stream, collector, store

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Wire</title>{items}</channel></rss>"""
ITEM = """<item><title>Bite {n}</title><link>https://n.example/{n}</link><description>text {n}</description>
<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><source url="https://p.example">Paper</source></item>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>new</title>
<entry><author><name>/u/diver</name></author><category term="sharks" label="r/sharks"/>
<content type="html">&lt;p&gt;Recent &lt;b&gt;attack&lt;/b&gt; discussion&lt;/p&gt;</content><id>t3_1</id>
<link href="https://f.example/r/sharks/1/"/><updated>2024-01-02T08:00:00+00:00</updated>
<published>2024-01-02T07:00:00+00:00</published><title>What happened</title></entry>
<entry><author><name>/u/cook</name></author><category term="ocean"/><content type="html">soup</content>
<link href="https://f.example/r/ocean/2/"/><updated>2024-01-02T08:00:00+00:00</updated><title>Recipe</title></entry></feed>"""


def test_news_feed_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.format(items="".join(ITEM.format(n=n) for n in range(20))))
    rows = feeds.ingest_feeds(spark, str(tmp_path), "news_rss").orderBy("position").collect()
    assert len(rows) == 15 and rows[0]["title"] == "Bite 0"
    assert rows[0]["content"] == "Bite 0\n\ntext 0\n\nPublisher: Paper"
    assert str(rows[0]["published_at"]) == "2024-01-02 10:00:00" and rows[0]["feed_name"] == "Wire"


def test_forum_feed_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    rows = feeds.ingest_feeds(spark, str(tmp_path), "reddit").collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["source_name"], row["author"], row["trusted"]) == ("r/sharks", "diver", True)
    assert row["content"].startswith("What happened\n\nRecent") and "<" not in row["content"]
    assert str(row["published_at"]) == "2024-01-02 07:00:00"


def test_register_file_drops_short_rows(spark, tmp_path):
    full = ["18 March", "1999", "Unprovoked", "USA", "Florida", "Pier", "Surfing", "Ann", "F", "31", "Minor cut",
            "N", "1715hrs", "White shark, 3.5m", "paper"]
    with open(tmp_path / "r.csv", "w", newline="") as out:
        w = csv.writer(out)
        w.writerow(register.COLUMNS)
        w.writerow(full)
        w.writerow(full[:5])
        w.writerow(full[:14])
    rows = register.import_register(register.read_register(spark, str(tmp_path / "r.csv"))).collect()
    assert len(rows) == 2
    row = next(r for r in rows if r["source_notes"] != "Imported from GSAF5.xls")
    assert (row["country"], row["incident_time"], row["victim_injury_severity"], row["shark_size_estimate"]) == (
        "United States", "17:15:00", "minor", "3.5m")
    assert row["shark_species_suspected"] == "Carcharodon carcharias" and row["fatal"] is False


def _land(spark, path, rows):
    df = spark.createDataFrame(rows, "source_platform string, source_url string, title string, content string, seen_at string, trusted boolean")
    conform(df.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")), RAW_ITEMS).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def landed(spark, tmp_path):
    path = str(tmp_path / "landing")
    _land(spark, path, [("reddit", "u1", "Shark one", "first", "2024-01-01 10:00:00", False),
                        ("reddit", "u1", "Shark one", "first", "2024-01-01 10:00:00", False),
                        ("reddit", "u2", "Soup", "nothing", "2024-01-01 10:05:00", False)])
    return path


def test_capture_stream_restarts_without_loss(spark, tmp_path, landed):
    root, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    run = lambda: capture_stream.start_capture(
        capture_stream.landed_items(spark, landed, 1), root, progress).awaitTermination()
    run()
    _land(spark, landed, [("reddit", "u1", "Shark one, edited", "second", "2024-01-01 12:00:00", False),
                          ("reddit", "u3", "Shark three", "third", "2024-01-01 12:00:00", False)])
    run()
    rows = {r["dedup_key"]: r for r in capture_stream.evidence(spark, root).collect()}
    assert set(rows) == {"reddit:u1", "reddit:u2", "reddit:u3"}
    assert rows["reddit:u1"]["title"] == "Shark one"
    assert str(rows["reddit:u1"]["captured_at"]) == "2024-01-01 10:00:00"
    assert str(rows["reddit:u1"]["last_seen_at"]) == "2024-01-01 12:00:00"


def test_replayed_batch_is_a_no_op(spark, tmp_path, landed):
    root = str(tmp_path / "store")
    batch = capture_stream.shape_evidence(spark.read.parquet(landed)).withColumn("_at", F.col("seen_at"))
    run = capture_stream.capture_batch(root)
    run(batch, 0)
    before = capture_stream.evidence(spark, root).collect()
    run(batch, 0)
    assert sorted(capture_stream.evidence(spark, root).collect()) == sorted(before)


def test_collector_routes(spark, tmp_path, landed):
    root = str(tmp_path / "store")
    responses = spark.createDataFrame(
        [("reddit:u1", '{"is_relevant": true, "classification": "provoked", "country": "USA", "confidence": 0.8}')],
        "dedup_key string, response_text string")
    verifications = spark.createDataFrame(
        [("reddit:u1", False, False, 0.3, {"description": "fixed"})],
        "dedup_key string, is_valid boolean, is_duplicate_likely boolean, verification_confidence double, corrections map<string,string>")
    collector.start_collector(capture_stream.landed_items(spark, landed), responses, verifications, root,
                              str(tmp_path / "progress")).awaitTermination()
    routes = {r["dedup_key"]: r["route"] for r in store.get(spark, root, "routes", collector.ROUTES).collect()}
    assert routes == {"reddit:u1": "candidate", "reddit:u2": "not_relevant"}
    news = collector.collected_news(spark, root).collect()
    assert [(n["dedup_key"], n["event_type"], n["country"]) for n in news] == [("reddit:u1", "attack", "United States")]
    seen = {r["source_document_id"]: r["payload"] for r in store.get(
        spark, root, "observations", collector.OBSERVATIONS).filter("event_type = 'attack'").collect()}
    (payload,) = seen.values()
    assert '"classification":"unverified_report"' in payload and '"description":"fixed"' in payload


def test_rejects_keep_their_text(spark):
    df = spark.createDataFrame([(1, "nothing"), (2, "{}")], "response_id long, response_text string")
    assert [r["response_id"] for r in normalize.rejected(normalize.parse_responses(df)).collect()] == [1]
