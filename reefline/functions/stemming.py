"""The English (Porter2) stemming algorithm as a column expression.

Region R1 starts after the first consonant that follows a vowel, R2 likewise inside R1; most endings
only go where they lie in one of them.  A `y` that counts as a consonant is written `Y` on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reefline.functions.text import let, lookup

# fixed values: words with a stem of their own, and words that keep their form
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# fixed values: prefixes after which R1 starts
R1_PREFIX = r"^(gener|commun|arsen)"
# fixed values: endings and what replaces them
STEP_2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
          "al", "er", "ic"]
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_END = f"(^{VOWEL}{OTHER}$)|({OTHER}{VOWEL}[^aeiouywxY]$)"


def _without(word: Column, letters: int) -> Column:
    return F.left(word, F.length(word) - letters)


def _region(text: Column) -> Column:
    """Length of the text up to where its region starts."""
    start = F.length(F.regexp_extract(text, f"^(.*?{VOWEL}{OTHER})", 1))
    return F.when(start > 0, start).otherwise(F.length(text))


def _first_ending(word: Column, endings: dict[str, str], allowed) -> Column:
    """The longest ending found is replaced where allowed; shorter ones are not tried after it."""
    out = None
    for ending, new in sorted(endings.items(), key=lambda e: -len(e[0])):
        body = _without(word, len(ending))
        value = F.when(allowed(ending, body), F.concat(body, F.lit(new))).otherwise(word)
        test = F.endswith(word, F.lit(ending))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return (F.when(F.endswith(w, F.lit("sses")), _without(w, 2))
            .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
            .when(w.rlike("(us|ss)$"), w)
            .when(w.rlike(f"{VOWEL}.+s$"), _without(w, 1)).otherwise(w))


def _past(w: Column, r1: Column) -> Column:
    eed = F.regexp_extract(w, "(eedly|eed)$", 1)
    cut = F.regexp_extract(w, "(ingly|edly|ing|ed)$", 1)

    def mended(base: Column) -> Column:
        return (F.when(~base.rlike(VOWEL), w).when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e")))
                .when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(base, 1))
                .when((F.length(base) <= r1) & base.rlike(SHORT_END), F.concat(base, F.lit("e"))).otherwise(base))
    return (F.when(F.length(eed) > 0, F.when(F.length(w) - F.length(eed) >= r1, F.concat(F.left(w, F.length(w) - F.length(eed)), F.lit("ee"))).otherwise(w))
            .when(F.length(cut) > 0, let(F.left(w, F.length(w) - F.length(cut)), mended)).otherwise(w))


def _last_letter(w: Column, r1: Column, r2: Column) -> Column:
    body = _without(w, 1)
    silent = (F.length(body) >= r2) | ((F.length(body) >= r1) & ~body.rlike(SHORT_END))
    return (F.when(F.endswith(w, F.lit("e")) & silent, body)
            .when(F.endswith(w, F.lit("ll")) & (F.length(body) >= r2), body).otherwise(w))


def stem(word: Column) -> Column:
    """Stem of a lower-case word; words of one or two letters and words of other scripts keep their form."""
    def regions(w: Column) -> Column:
        r1 = F.when(w.rlike(R1_PREFIX), F.length(F.regexp_extract(w, R1_PREFIX, 1))).otherwise(_region(w))
        return let(r1, lambda a: let(a + _region(F.substring(w, a + 1, F.length(w))), lambda b: ended(w, a, b)))

    def ended(w: Column, r1: Column, r2: Column) -> Column:
        def in_2(ending: str, body: Column) -> Column:
            extra = {"ogi": body.rlike("l$"), "li": body.rlike("[cdeghkmnrt]$")}.get(ending, F.lit(True))
            return (F.length(body) >= r1) & extra
        steps = [
            lambda x: _past(x, r1), lambda x: F.regexp_replace(x, f"^(.+{OTHER})[yY]$", "$1i"),
            lambda x: _first_ending(x, STEP_2, in_2),
            lambda x: _first_ending(x, STEP_3, lambda e, body: F.length(body) >= (r2 if e == "ative" else r1)),
            lambda x: _first_ending(x, dict.fromkeys(STEP_4, ""), lambda e, body: (F.length(body) >= r2) & (
                body.rlike("[st]$") if e == "ion" else F.lit(True))),
            lambda x: _last_letter(x, r1, r2)]

        def chain(x: Column, left: list) -> Column:
            return let(left[0](x), lambda y: chain(y, left[1:])) if left else x
        return let(_plural(w), lambda x: F.when(x.isin(KEPT), x).otherwise(chain(x, steps)))
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    return F.coalesce(lookup(word, OWN_STEMS), F.when(F.length(word) <= 2, word),
                      F.replace(let(marked, regions), F.lit("Y"), F.lit("y")))
