"""Feed files to raw items: RSS items, video-channel entries and forum Atom entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reefline.constants import FEED_CAPS
from reefline.functions.text import blank_to_null, strip_tags
from reefline.operators.capture import is_relevant

S = T.StringType()


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


_LINK = _fields(("_href", S), ("_rel", S))
_TEXT = _fields(("_VALUE", S), ("_type", S))
RSS_ITEM = _fields(
    ("title", S), ("link", S), ("description", S), ("pubDate", S),
    ("source", _fields(("_VALUE", S), ("_url", S))))
VIDEO_ENTRY = _fields(
    ("title", S), ("link", _LINK), ("published", S), ("summary", S),
    ("group", _fields(("description", S))))
FORUM_ENTRY = _fields(
    ("title", S), ("link", _LINK), ("content", _TEXT), ("published", S), ("updated", S),
    ("author", _fields(("name", S))), ("category", T.ArrayType(_fields(("_term", S)))))

# kind -> (row tag of the file, element holding the entries, entry schema)
FEED_KINDS = {
    "news_rss": ("channel", "item", RSS_ITEM),
    "youtube": ("feed", "entry", VIDEO_ENTRY),
    "reddit": ("feed", "entry", FORUM_ENTRY),
}
XML_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true",
               "attributePrefix": "_", "valueTag": "_VALUE"}


def read_feed_files(spark: SparkSession, path: str, kind: str, cap: int | None = None) -> DataFrame:
    """feed_name, position, entry: the first entries of every landed feed file, in feed order.

    A file is one row; `slice` before `explode` keeps the cap inside the scan.
    """
    tag, element, entry = FEED_KINDS[kind]
    schema = _fields(("title", S), (element, T.ArrayType(entry)))
    reader = spark.read.format("xml").schema(schema).option("rowTag", tag)
    for key, value in XML_OPTIONS.items():
        reader = reader.option(key, value)
    feeds = reader.load(path)
    limit = FEED_CAPS[kind] if cap is None else cap
    return feeds.select(
        F.col("title").alias("feed_name"), F.input_file_name().alias("feed_file"),
        F.posexplode(F.slice(F.col(element), 1, limit)).alias("position", "entry"))


def parse_entries(entries: DataFrame, kind: str, column: str = "entry_xml") -> DataFrame:
    """Entries that arrive as XML text in a column instead of as files."""
    schema = FEED_KINDS[kind][2]
    return entries.withColumn("entry", F.from_xml(F.col(column), schema, XML_OPTIONS)).drop(column)


def _rfc822(text: Column) -> Column:
    """`Mon, 01 Jan 2024 10:00:00 GMT` as a UTC time."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"(GMT|UTC|UT|Z)$", "+0000")
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx"))


def _iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _as_ntz(moment: Column) -> Column:
    return moment.cast("timestamp_ntz")


def _item(platform: str, name: Column, url: Column, title: Column, content: Column,
          published: Column, author: Column, trusted: Column) -> list[Column]:
    return [
        F.lit(platform).alias("source_platform"), name.alias("source_name"),
        F.coalesce(url, F.lit("")).alias("source_url"),
        F.coalesce(title, F.lit("")).alias("title"), content.alias("content"),
        _as_ntz(published).alias("published_at"), author.alias("author"),
        trusted.alias("trusted"),
    ]


def news_items(entries: DataFrame) -> DataFrame:
    """RSS entries; the publisher, when given, is appended to the text."""
    e = F.col("entry")
    publisher = blank_to_null(e["source"]["_VALUE"])
    title = F.coalesce(e["title"], F.lit(""))
    content = F.concat(title, F.lit("\n\n"), F.coalesce(e["description"], F.lit("")),
                       F.coalesce(F.concat(F.lit("\n\nPublisher: "), publisher), F.lit("")))
    return entries.select("feed_name", "position", *_item(
        "news_rss", F.col("feed_name"), e["link"], title, content, _rfc822(e["pubDate"]),
        publisher, F.lit(False)))


def video_items(entries: DataFrame) -> DataFrame:
    """Channel entries; channels are curated, hence trusted, and gated for relevance."""
    e = F.col("entry")
    title = F.coalesce(e["title"], F.lit(""))
    text = F.coalesce(e["group"]["description"], e["summary"], F.lit(""))
    items = entries.select("feed_name", "position", *_item(
        "youtube", F.col("feed_name"), e["link"]["_href"], title,
        F.concat(title, F.lit("\n\n"), text), _iso(e["published"]), F.col("feed_name"),
        F.lit(True)))
    return items.filter(is_relevant())


def forum_items(entries: DataFrame) -> DataFrame:
    """Forum entries: tag-stripped body, group from the category or else from the link."""
    e = F.col("entry")
    link = e["link"]["_href"]
    terms = F.filter(F.transform(e["category"], lambda c: c["_term"]),
                     lambda t: F.length(t) > 0)
    group = F.coalesce(F.get(terms, 0), blank_to_null(F.regexp_extract(link, r"/r/([^/]+)", 1)))
    body = strip_tags(strip_entities(F.coalesce(e["content"]["_VALUE"], F.lit(""))))
    author = blank_to_null(F.regexp_replace(e["author"]["name"], r"^/u/", ""))
    items = entries.filter((F.length(e["title"]) > 0) & (F.length(link) > 0)).select(
        "feed_name", "position", *_item(
            "reddit", F.coalesce(F.concat(F.lit("r/"), group), F.lit("reddit")), link,
            e["title"], F.concat(e["title"], F.lit("\n\n"), body),
            F.coalesce(_iso(e["published"]), _iso(e["updated"])), author,
            F.coalesce(F.lower(group) == "sharks", F.lit(False))))
    return items.filter(is_relevant())


def strip_entities(text: Column) -> Column:
    """Undo one level of markup escaping, as feeds carry escaped HTML in a text node."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


ITEM_BUILDERS = {"news_rss": news_items, "youtube": video_items, "reddit": forum_items}


def ingest_feeds(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return ITEM_BUILDERS[kind](read_feed_files(spark, path, kind))
