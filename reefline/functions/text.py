"""Text expressions, all JVM side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from reefline.constants import GENERIC_HEADLINES, HEADLINE_MIN_CHARS


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def squash(value: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def normal_part(value: Column) -> Column:
    return F.lower(squash(value.cast("string")))


def title_case(value: Column) -> Column:
    """Capital after every non-letter, as in a printed title (`initcap` splits on blanks only)."""
    words = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def csv_values(text: str | Iterable[str]) -> list[str]:
    """`"a, b"` -> `["a", "b"]`; a ready list passes through."""
    parts = text.split(",") if isinstance(text, str) else text
    return [part.strip() for part in parts]


def contains_ci(value: Column, needle: str) -> Column:
    """Literal, case-insensitive containment: there are no wildcards to escape."""
    return F.contains(F.lower(value), F.lower(F.lit(needle)))


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """True when one of the literal terms occurs; one regex pass over the text."""
    def quoted(term: str) -> str:
        return "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in term)
    return text.rlike("|".join(quoted(t) for t in terms))


def first_contained(text: Column, pairs: Mapping[str, str]) -> Column:
    """Value of the first listed key contained in the text, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in pairs.items()])


def best_option(value: Column, options: list[str]) -> Column:
    """Allowed option equal to, else the longest one contained in, the value.

    An equal option is also the longest contained one, so one ordered test is enough.
    """
    tidy = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    by_length = sorted(options, key=len, reverse=True)
    return let(tidy, lambda text: first_contained(text, {o: o for o in by_length}))


def lookup(value: Column, table: Mapping[str, str]) -> Column:
    """Constant map lookup; null when the key is unknown."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), value)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body mentions it.

    Plain column expressions are substituted at every mention, which repeats costly text
    work; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def plain_blanks(value: Column) -> Column:
    """True for ASCII text whose only white space is single blanks, which needs no pattern to be squashed.

    Byte searches, many times cheaper than a pattern; other text may be plain too.
    """
    plain = (F.octet_length(value) == F.length(value)) & ~F.contains(value, F.lit("  "))
    for blank in "\t\n\x0b\f\r":
        plain = plain & ~F.contains(value, F.lit(blank))
    return plain


def headline_text(title: Column) -> Column:
    """The title without its outlet suffix, lower-cased and squashed."""
    suffix = F.substring_index(title, " - ", -1)
    head = F.when(F.contains(title, F.lit(" - ")),
                  F.left(title, F.length(title) - F.length(suffix) - 3)).otherwise(title)
    return F.lower(F.when(plain_blanks(title), F.trim(head)).otherwise(squash(head)))


def is_specific(headline: Column) -> Column:
    keep = F.length(headline) >= HEADLINE_MIN_CHARS
    for prefix in GENERIC_HEADLINES:
        keep = keep & ~F.startswith(headline, F.lit(prefix))
    return F.coalesce(keep, F.lit(False))


def headlines(title: Column) -> Column:
    """Array with the headline without its outlet suffix; empty when too short or generic."""
    return F.filter(F.array(headline_text(title)), is_specific)


def headline_key(title: Column) -> Column:
    return F.get(headlines(title), 0)


def named_characters(text: Column) -> Column:
    """The commonest character references of markup as the characters they name."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    """Visible text of markup: drop non-content blocks and comments, then tags and entities."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    text = F.regexp_replace(named_characters(text), r"(?U)\s*\n\s*", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- search tokens ---------------------------------------------------------------
# fixed values: words that carry no meaning in a query
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has",
    "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "no", "not",
    "of", "on", "or", "our", "she", "so", "such", "that", "the", "their", "then", "there",
    "these", "they", "this", "to", "was", "we", "were", "will", "with", "you",
]
