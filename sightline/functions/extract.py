"""Fields of a card text as Spark columns.

The ``text`` argument is a text that went through ``normalize_loose``, so its only
white space is the plain blank; word boundaries and digits are those of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.text import (
    any_of, blank_to_null, canonical_of_loose, fold_term, key_of_nfkc, known, let, loose_of_nfkc, parse_int, stable_hash,
    strip,
)


def _first(text: Column, patterns: list[str], flags: str = "") -> Column:
    return F.coalesce(*[known(F.regexp_extract(text, flags + p, 1)) for p in patterns])


def _last(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(text, F.lit(flags + p), F.lit(1)), F.lit(-1)) for p in patterns])


def _sites(site: Column, value) -> Column:
    out = F.lit(None)
    for name, entry in K.SITES.items():
        out = F.when(site == name, value(entry)).otherwise(out)
    return out


def base_url(site: Column) -> Column:
    return _sites(site, lambda e: F.lit(e["base"]))


def source_listing_id(site: Column, url: Column, text: Column) -> Column:
    """Listing id found by the patterns of the site in URL and text, else a hash of the URL."""
    combined = F.concat_ws(" ", url, F.coalesce(text, F.lit("")))
    found = let(combined, lambda c: _sites(site, lambda e: F.upper(_first(c, e["ids"], "(?iU)"))))
    return F.coalesce(found, stable_hash(F.coalesce(blank_to_null(url), text), 20))


def looks_like_listing_url(url: Column, site: Column) -> Column:
    part = any_of(F.lower(url).contains(p) for p in K.DETAIL_URL_PARTS)
    by_id = _sites(site, lambda e: any_of(url.rlike("(?U)" + p) for p in e["ids"]))
    return part | F.coalesce(by_id, F.lit(False))


def has_listing_hint(text: Column) -> Column:
    return any_of(text.contains(h) for h in K.LISTING_HINTS)


def parse_rent(text: Column) -> Column:
    return parse_int(_last(text, K.RENT_PATTERNS))


def parse_area(text: Column) -> Column:
    return parse_int(_first(text, K.AREA_PATTERNS, "(?U)"))


def parse_price_per_sqft(text: Column) -> Column:
    return parse_int(_first(text, K.PSF_PATTERNS)).cast("double")


def parse_layout(text: Column) -> Column:
    def layout(phrase: Column) -> Column:
        rooms = known(F.regexp_extract(phrase, r"^([0-9一二两兩三四五六七八九十]房)", 1))
        return F.when(phrase.rlike("厅|廳"), phrase).otherwise(F.coalesce(rooms, phrase))

    phrase = F.regexp_replace(_first(text, K.LAYOUT_PATTERNS), r"\s+", "")
    return canonical_of_loose(let(phrase, layout))


def parse_floor(text: Column) -> Column:
    return loose_of_nfkc(_first(text, [K.FLOOR_PATTERN]))


def parse_flat(text: Column) -> Column:
    return loose_of_nfkc(F.upper(_first(text, [K.FLAT_PATTERN], "(?iU)")))


def parse_block(text: Column) -> Column:
    return loose_of_nfkc(_last(text, [K.BLOCK_PATTERN]))


def remove_leading_tags(text: Column) -> Column:
    tags = "|".join(K.MARKETING_TAGS)
    return strip(F.regexp_replace(strip(text), rf"^(?:(?:{tags})\s*)+", ""))


def estate_head(text: Column, layout: Column) -> Column:
    """Part of the text in front of the first stop token, without tags."""

    def after_bookmark(work: Column) -> Column:
        return F.when(work.contains("bookmark"), strip(F.substr(work, F.locate("bookmark", work) + 8))).otherwise(work)

    def before_stop(work: Column) -> Column:
        stops = [F.locate(token, work) for token in K.ESTATE_STOPS] + [F.coalesce(F.position(layout, work), F.lit(0))]
        first = F.array_min(F.filter(F.array(*stops), lambda p: p > 0))
        return F.coalesce(F.left(work, first - 1), work)

    return let(let(remove_leading_tags(text), after_bookmark), before_stop)


def estate_of_head(head: Column, terms: list[str]) -> Column:
    def unit_or_words(work: Column) -> Column:
        unit = known(strip(F.regexp_extract(work, "(?i)^" + K.UNIT_PATTERN, 1)))  # a match starts at the first word
        return F.coalesce(unit, F.array_join(F.slice(F.split(work, " "), 1, 4), " "))

    name = let(F.trim(F.regexp_replace(F.regexp_replace(head, r"(?U)\b(?:VR|AI)\b", " "), r"\s+", " ")), unit_or_words)
    for term in sorted((t for t in terms if t), key=len, reverse=True):
        name = strip(F.regexp_replace(name, rf"\s+\Q{term}\E$", ""))
    name = strip(F.regexp_replace(name, K.ESTATE_PREFIX_PATTERN, ""))
    return known(loose_of_nfkc(name))


def parse_estate(text: Column, layout: Column, terms: list[str]) -> Column:
    return estate_of_head(estate_head(text, layout), terms)


def parse_district(text: Column, terms: list[str]) -> Column:
    """First of ``terms`` that the text contains."""

    def first(key: Column) -> Column:
        found = [F.when(key.contains(fold_term(t)), F.lit(t)) for t in terms if t]
        return reduce(lambda a, b: F.coalesce(a, b), found, F.lit(None).cast("string"))

    return let(key_of_nfkc(text), first)
