"""Text normalisation as Spark columns.

Everything runs in the JVM except Unicode NFKC, which Spark lacks: rows whose
characters are all known to be NFKC-stable are sent to the Arrow UDF as nulls.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sightline import constants as K

# White space as Unicode sees it. Patterns spell it out: quicker than a property lookup per character.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
ODD_SPACES = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # all but the blank
WS = rf"[\x20{ODD_SPACES}]"
SEP = "\x1f"  # joins array elements for one NFKC call; white space, so it never survives a clean text
_HAN = "[一-鿿]"  # holds every character of the script tables
_STABLE = r"^[\x00-\x7FÀ-ÿ一-鿿、。〈-】]*$"
_TERM_SPLIT = "[" + re.escape(K.TERM_SEPARATORS) + "]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(col: Column) -> Column:
    return F.coalesce(_nfkc(F.when(~col.rlike(_STABLE), col)), col)


def simplify(col: Column) -> Column:
    return let(col, lambda x: F.when(x.rlike(_HAN), F.translate(x, K.TRAD, K.SIMP)).otherwise(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A Python UDF may stand in ``value`` but not in ``body``.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def known(value: Column) -> Column:
    """``blank_to_null`` of a value that is worth computing once."""
    return let(value, blank_to_null)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def key_of_nfkc(col: Column) -> Column:
    """Comparison key of a text that is NFKC already: one pass simplifies and drops white space and punctuation."""
    return F.lower(F.translate(col, K.TRAD + SPACE_CHARS + K.PUNCTUATION, K.SIMP))


def squeeze(col: Column) -> Column:
    """Single blanks for all white space; the pattern passes over blanks that are single already."""
    return F.trim(F.regexp_replace(col, f"{WS}{{2,}}|[{ODD_SPACES}]", " "))


def loose_of_nfkc(col: Column) -> Column:
    return squeeze(simplify(col))


def normalize_text(col: Column) -> Column:
    """Comparison key: NFKC, simplified script, lower case, no white space or punctuation; null gives ''."""
    return key_of_nfkc(nfkc(F.coalesce(col, F.lit(""))))


def normalize_loose(col: Column) -> Column:
    """Readable form: NFKC, simplified script, single spaces, trimmed; null gives ''."""
    return loose_of_nfkc(nfkc(F.coalesce(col, F.lit(""))))


def fold_term(term: str) -> str:
    """``normalize_text`` of one job parameter, on the driver."""
    text = unicodedata.normalize("NFKC", term).translate(str.maketrans(K.TRAD, K.SIMP)).lower()
    return re.sub(rf"[\s{re.escape(K.PUNCTUATION)}]+", "", text)


def stable_hash(col: Column, length: int = 16) -> Column:
    return F.left(F.sha1(col.cast("binary")), F.lit(length))


def parse_int(col: Column) -> Column:
    """First integer of a text; thousands commas allowed."""
    digits = F.regexp_extract(F.replace(col, F.lit(" "), F.lit("")), "([0-9][0-9,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("int")


def _digit(col: Column) -> Column:
    names = "".join(K.CHINESE_DIGITS)
    values = "".join(str(v) for v in K.CHINESE_DIGITS.values())
    return let(col, lambda x: F.when(x.rlike(f"^[{names}]$"), F.translate(x, names, values).try_cast("int")))


def _chinese_int(key: Column) -> Column:
    def value(k: Column) -> Column:
        tens = F.coalesce(_digit(F.substring_index(k, "十", 1)), F.lit(1))
        ones = F.coalesce(_digit(F.substr(k, F.locate("十", k) + 1)), F.lit(0))
        return (
            F.when(k.rlike("^[0-9]+$"), k.try_cast("int"))
            .when(k == "十", F.lit(10))
            .when(k.contains("十"), tens * 10 + ones)
            .otherwise(_digit(k))
        )

    return let(key, value)


def parse_chinese_int(col: Column) -> Column:
    return _chinese_int(normalize_text(col))


def bedrooms_of_loose(loose: Column) -> Column:
    rooms, words = K.ROOM_WORDS_CN, "|".join(K.ENGLISH_DIGITS)
    numbers = F.array(*[F.lit(w) for w in K.ENGLISH_DIGITS])

    def in_digits(low: Column) -> Column:
        return F.regexp_extract(low, rf"(?U)(\d+)[\s-]*(?:{rooms}|bedrooms?|beds?|br\b)", 1).try_cast("int")

    def in_english(low: Column) -> Column:
        word = F.regexp_extract(low, rf"(?U)\b({words})[\s-]*(?:bedrooms?|beds?|br)\b", 1)
        return F.array_position(numbers, known(word)).cast("int") - 1

    def in_chinese(text: Column) -> Column:
        return _chinese_int(key_of_nfkc(F.regexp_extract(text, rf"(?U)([{K.CHINESE_ROOM_DIGITS}]+)\s*(?:{rooms})", 1)))

    def count(x: Column) -> Column:
        studio = any_of(x["low"].contains(word) for word in K.STUDIO_WORDS)
        return F.when(studio, F.lit(0)).otherwise(
            F.coalesce(in_digits(x["low"]), in_english(x["low"]), in_chinese(x["text"]))
        )

    return let(F.struct(F.lower(loose).alias("low"), loose.alias("text")), count)


def canonical_of_loose(loose: Column) -> Column:
    def layout(x: Column) -> Column:
        count, text = x["count"], x["text"]
        rooms = F.concat(count.cast("string"), F.lit(K.ROOM))
        return F.when(count == 0, F.lit(K.STUDIO)).otherwise(F.coalesce(rooms, text))

    return let(loose, lambda t: let(F.struct(bedrooms_of_loose(t).alias("count"), t.alias("text")), layout))


def layout_bedroom_count(col: Column) -> Column:
    """Bedrooms named by a free text: studio words, then digits, English words, Chinese numerals."""
    return bedrooms_of_loose(normalize_loose(col))


def canonical_layout(col: Column) -> Column:
    return canonical_of_loose(normalize_loose(col))


def text_variants(col: Column) -> Column:
    """Distinct non-empty script variants of a term, in a fixed order."""
    return let(strip(nfkc(F.coalesce(col, F.lit("")))), _variants)


def _variants(base: Column) -> Column:
    stem = F.left(base, F.length(base) - 2)
    forms = [
        base,
        simplify(base),
        F.translate(base, K.BACK_FROM, K.BACK_TO),
        F.when(base.endswith("新区"), F.concat(stem, F.lit("新區"))),
        F.when(base.endswith("新區"), F.concat(stem, F.lit("新区"))),
    ]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def _nfkc_elements(arr: Column) -> Column:
    return F.split(nfkc(F.array_join(arr, SEP)), SEP)


def area_terms(area: Column, aliases: Column) -> Column:
    """Ordered distinct variants of an area name and its aliases (array column)."""
    names = _nfkc_elements(F.concat(F.array(F.coalesce(area, F.lit(""))), F.coalesce(aliases, F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(F.transform(names, lambda x: let(strip(x), _variants))))


def split_terms(col: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), _TERM_SPLIT), strip)
    return F.filter(parts, lambda x: x != "")


def normalize_layout_terms(col: Column) -> Column:
    """Ordered distinct canonical layouts of a term list."""
    layouts = F.transform(_nfkc_elements(split_terms(col)), lambda x: canonical_of_loose(loose_of_nfkc(x)))
    return F.array_distinct(F.filter(layouts, lambda x: x != ""))


def compact_money(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(col, 0)), F.lit("-"))


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def key_contains_any(key: Column, terms: Iterable[str]) -> Column:
    return any_of(key.contains(fold_term(t)) for t in terms if t)


def contains_any(col: Column, terms: Iterable[str]) -> Column:
    return let(normalize_text(col), lambda key: key_contains_any(key, terms))


def unit_text(*parts: Column) -> Column:
    """Non-empty unit parts joined by a space."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts])


def unit_label(block: Column, floor: Column, flat: Column) -> Column:
    return F.coalesce(blank_to_null(unit_text(block, floor, flat)), F.lit("-"))


def display_name(site: Column) -> Column:
    out = site
    for key, value in K.SITES.items():
        out = F.when(site == key, F.lit(value["name"])).otherwise(out)
    return out


def _escape(col: Column) -> Column:
    one_line = F.replace(F.replace(col, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.coalesce(blank_to_null(strip(one_line)), F.lit("-"))


def source_links(summary: Column) -> Column:
    """Links of the active sources of a ``map<site, struct<url, active, ...>>``, ordered by site."""

    def link(e: Column) -> Column:
        url = F.replace(F.replace(e["value"]["url"], F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
        return F.concat(F.lit("["), _escape(display_name(e["key"])), F.lit("]("), url, F.lit(")"))

    entries = F.array_sort(
        F.filter(F.map_entries(summary), lambda e: e["value"]["active"] & (e["value"]["url"] != "")),
        lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
    )
    return F.coalesce(blank_to_null(F.array_join(F.transform(entries, link), ", ")), F.lit("-"))
