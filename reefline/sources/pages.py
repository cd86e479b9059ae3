"""Web pages to raw items: links on index pages, then the text of the linked articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefline.constants import (
    PAGE_BODY_CHARS, PAGE_BODY_TERMS, PAGE_ITEM_CAP, PAGE_TITLE_CHARS, PAGE_URL_CAP,
)
from reefline.functions.frames import top_per_key
from reefline.functions.text import any_term, named_characters

# fixed values: index, map and yearly roundup pages that list many incidents
ARCHIVE_PATH = r"^/(?:recent-articles|(?:all-)?20\d{2}(?:-fatal)?-shark-attack(?:s|-map)[^/]*)/?$"
# fixed values: what holds a link to an article, what holds its text, and what is cut out of that
LINK_BOXES, LINK_BOX_CLASS = ["article"], "post"
LINK_PLACES, LINK_PLACE_CLASS = ["h2", "h3"], "entry-content"
BODY_CLASSES, BODY_CLASS_IN_ARTICLE = ["entry-content", "post-content", "article-body"], "content"
CUT_TAGS, CUT_CLASSES = ["script", "style", "nav"], ["social-share", "comments"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# A comment or declaration, a script or style with its text, a tag, or text.
TOKEN = (r"(?is)(<!--.*?(?:-->|$)|<![^>]*>|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|$)"
         r"|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+)")
ATTRIBUTE = r"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def absolute_url(href: Column, base: Column) -> Column:
    """Absolute form of a link; null for fragments, scripts and mail addresses."""
    return F.when(F.startswith(href, F.lit("http")), href).when(
        F.startswith(href, F.lit("/")), F.concat(base, href))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)


def is_article(url: Column) -> Column:
    path = F.regexp_replace(
        F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return (F.length(path) > 0) & ~path.rlike(ARCHIVE_PATH)


def _attribute(token: Column, name: str) -> Column:
    pattern = ATTRIBUTE.replace("{name}", name)
    values = [F.nullif(F.regexp_extract(token, pattern, i), F.lit("")) for i in (1, 2, 3)]
    return F.coalesce(*values)


def elements(pages: DataFrame) -> DataFrame:
    """Pages (url, html, page_id) cut into tokens, each opening tag with the token that closes its element.

    A running count of the openings and closings of its name gives each tag its depth; an element
    ends at the first later closing tag of its own name and depth, or with the page.  Tags of other
    names in between may nest badly or stay open.
    """
    tokens = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(1))).alias("n", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][^\s/>]*)", 1))
    closing, raw = F.startswith("token", F.lit("</")), F.col("tag").isin("script", "style")
    marked = tokens.withColumn("tag", name).withColumns({
        "is_text": ~F.startswith("token", F.lit("<")) | (F.col("token") == "<"),
        "opens": (F.col("tag") != "") & ~closing & ~raw & ~F.col("tag").isin(VOID_TAGS),
        "closes": (F.col("tag") != "") & closing,
        "classes": F.when((F.col("tag") != "") & ~closing, F.split(F.coalesce(_attribute(F.col("token"), "class"), F.lit("")), r"\s+"))})
    step = F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)
    so_far = W.partitionBy("page_id", "url", "tag").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    # openings and closings of one name and level alternate
    level = F.sum(step).over(so_far) + F.when(F.col("closes"), 1).otherwise(0)
    nested = W.partitionBy("page_id", "url", "tag", "opens_or_closes", "level").orderBy("n")
    ends = F.when(F.col("opens"), F.coalesce(F.when(F.lead("closes").over(nested), F.lead("n").over(nested)), F.lit(1 << 30)))
    return marked.withColumns({"level": level, "opens_or_closes": F.col("opens") | F.col("closes")}).withColumn("end", ends).drop(
        "level", "opens_or_closes")


def _open_at(condition: Column) -> Column:
    """True inside an element that an earlier token meeting the condition opened."""
    before = W.partitionBy("page_id", "url").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(condition, F.col("end"))).over(before) > F.col("n"), F.lit(False))


def _has_class(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap("classes", F.array(*[F.lit(n) for n in names])), F.lit(False)) & F.col("opens")


def _joined(separator: str) -> Column:
    """The texts of the tokens in order, each stripped, empty ones left out."""
    strip = lambda t: F.regexp_replace(named_characters(t), r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("is_text"), F.struct("n", "token")))), lambda r: strip(r["token"]))
    return F.array_join(F.filter(parts, lambda t: t != ""), separator)


def article_links(index_pages: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """site, position, url, title: first appearance of each allowed article link per site.

    Links are the first one of every article or post, and all inside headings and entry contents,
    in the order of the elements that give them.  `hosts` is the allow-list; without one a link must
    stay on the page's own host.
    """
    linked = F.col("opens") & (F.col("tag") == "a")
    page = W.partitionBy("page_id", "url").orderBy("n")
    onward, so_far = page.rowsBetween(1, W.unboundedFollowing), page.rowsBetween(W.unboundedPreceding, 0)
    box = F.col("opens") & (F.col("tag").isin(LINK_BOXES) | _has_class(LINK_BOX_CLASS))
    rows = elements(index_pages).withColumn("href", F.when(linked, _attribute(F.col("token"), "href"))).withColumns({
        "placed": linked & _open_at(F.col("opens") & (F.col("tag").isin(LINK_PLACES) | _has_class(LINK_PLACE_CLASS))),
        "boxed": F.when(box, F.min(F.when(F.col("href").isNotNull(), F.col("n"))).over(onward)),
        "anchor": F.max(F.when(linked, F.struct("n", "end"))).over(so_far)})
    keys = ["page_id", "url"]
    given = rows.filter("placed").select(*keys, F.col("n").alias("at"), F.col("n").alias("anchor")).unionByName(
        rows.filter(F.col("boxed") < F.col("end")).select(*keys, F.col("n").alias("at"), F.col("boxed").alias("anchor")))
    texts = rows.filter(F.col("n") < F.col("anchor.end")).groupBy(*keys, F.col("anchor.n").alias("anchor")).agg(
        F.max(F.when(F.col("n") == F.col("anchor.n"), F.col("href"))).alias("href"), _joined("").alias("title"))
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    links = given.join(texts, [*keys, "anchor"]).select(
        _host(F.col("url")).alias("site"), F.struct(F.col("page_id").alias("index_id"), "at").alias("position"),
        absolute_url(F.col("href"), base).alias("url"), "title")
    host = _host(F.col("url"))
    allowed = host.isin(hosts) if hosts else host == F.col("site")
    kept = links.filter(F.col("url").isNotNull() & allowed & is_article(F.col("url")))
    return kept.groupBy("site", "url").agg(
        F.min(F.struct("position", "title")).alias("_first")
    ).select("site", "url", "_first.position", "_first.title")


def article_bodies(pages: DataFrame) -> DataFrame:
    """url, body, published_at of the pages that have an article body.

    The body is the first element, in the order of the page, with one of the body classes (one of
    them only inside an article), without scripts, navigation, sharing buttons and comments.
    """
    in_article = _open_at(F.col("opens") & (F.col("tag") == "article"))
    starts = _has_class(*BODY_CLASSES) | (_has_class(BODY_CLASS_IN_ARTICLE) & in_article)
    whole = W.partitionBy("page_id", "url")
    rows = elements(pages).withColumn("starts", starts).withColumn(
        "body", F.min(F.when(F.col("starts"), F.struct("n", "end"))).over(whole)).filter(
        (F.col("n") > F.col("body.n")) & (F.col("n") < F.col("body.end")))
    cut = F.col("opens") & (F.col("tag").isin(CUT_TAGS) | _has_class(*CUT_CLASSES))
    body = rows.withColumn("cut", _open_at(cut)).filter(F.col("is_text") & ~F.col("cut"))
    times = pages.select("page_id", "url", F.try_to_timestamp(
        F.nullif(F.regexp_extract("html", r"(?is)<time\b[^>]*datetime=[\"']([^\"']+)[\"']", 1), F.lit(""))).cast("timestamp_ntz")
        .alias("published_at"))
    return body.groupBy("page_id", "url").agg(_joined("\n").alias("body")).join(times, ["page_id", "url"]).drop("page_id")


def harvest(index_pages: DataFrame, pages: DataFrame, hosts: list[str] | None = None,
            source_name: str = "tracker", terms: list[str] = PAGE_BODY_TERMS,
            url_cap: int | None = PAGE_URL_CAP, item_cap: int | None = PAGE_ITEM_CAP,
            body_chars: int | None = PAGE_BODY_CHARS) -> DataFrame:
    """Items of the linked articles: titled, with a body that mentions the subject.

    Per site at most `item_cap` items; reading stops once an item has been kept at or after the
    `url_cap`-th link, so an item survives only if the kept item before it came earlier than that.
    None lifts a cap.
    """
    links = article_links(index_pages, hosts)
    bodies = article_bodies(pages)
    items = links.filter(F.length("title") >= PAGE_TITLE_CHARS).join(bodies, "url").filter(
        any_term(F.lower(F.col("body")), terms))
    kept = items if item_cap is None else top_per_key(items, ["site"], [F.asc("position")], item_cap)
    if url_cap is not None:
        early = top_per_key(links, ["site"], [F.asc("position")], url_cap, rank="seen").select(
            "site", "url", "seen")
        before = F.lag("seen").over(W.partitionBy("site").orderBy("position"))
        numbered = kept.join(early, ["site", "url"], "left").withColumn(
            "seen", F.coalesce("seen", F.lit(url_cap + 1)))
        kept = numbered.withColumn("_before", F.coalesce(before, F.lit(0))).filter(
            F.col("_before") < url_cap)
    return kept.select(
        F.lit("web_scrape").alias("source_platform"), F.lit(source_name).alias("source_name"),
        "site", F.col("url").alias("source_url"), "title",
        F.concat(F.col("title"), F.lit("\n\n"), F.col("body") if body_chars is None else F.substring("body", 1, body_chars))
        .alias("content"), "published_at", F.lit(source_name).alias("author"))
