"""Structured observations out of landed pages, cards and JSON items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import extract as X
from sightline.functions import html as H
from sightline.functions import keys, numeric
from sightline.functions import text as T

LOOSE_FIELDS = ["title", "estate_name", "building", "block", "floor", "flat", "address", "district"]
OBSERVATION = {
    "source_site": "string", "source_url": "string", "source_listing_id": "string", "title": "string",
    "estate_name": "string", "building": "string", "block": "string", "floor": "string", "flat": "string",
    "layout": "string", "district": "string", "address": "string", "rent_hkd": "int", "usable_area_sqft": "int",
    "gross_area_sqft": "int", "building_age_years": "int", "price_per_sqft": "double",
}


def clean_observations(df: DataFrame) -> DataFrame:
    """Clean-up projection: loose texts, canonical layout, derived price per area, source key.

    Only the columns of the data model are kept, so raw payloads and personal
    columns cannot pass. Empty texts become null.
    """
    have = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in OBSERVATION.items()]
    extra = [c for c in ("page_id", "page", "pos", "run_id", "fetched_at", "updated_at_text", "tags") if c in df.columns]
    out = df.select(*extra, *have)
    return out.withColumns(
        {f: T.known(T.normalize_loose(F.col(f))) for f in LOOSE_FIELDS}
        | {
            "layout": T.known(T.canonical_layout(F.col("layout"))),
            "price_per_sqft": numeric.derived_psf(F.col("price_per_sqft"), F.col("rent_hkd"), F.col("usable_area_sqft")),
            "source_key": keys.source_key(F.col("source_site"), F.col("source_listing_id"), F.col("source_url")),
        }
    )


def observation_identity(df: DataFrame) -> Column:
    def col(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return keys.identity_key(
        col("estate_name"), col("block"), col("building"), col("floor"), col("flat"), col("usable_area_sqft"),
        col("title"), col("layout"), col("rent_hkd"),
    )


def _page_columns(pages: DataFrame) -> list[str]:
    """Columns that name the page an observation came from; the run is one where pages have it."""
    return [c for c in ("page_id", "run_id", "fetched_at", "source_site") if c in pages.columns]


def page_links(pages: DataFrame) -> DataFrame:
    """Anchors of pages (page_id, source_site, source_url, html) that may be listings."""
    found = pages.select(*_page_columns(pages), "source_url", F.posexplode(H.anchors(F.col("html"))).alias("pos", "anchor"))
    raw = found.select(
        *_page_columns(pages), "source_url", "pos",
        H.anchor_href(F.col("anchor")).alias("href"),
        H.clean_card_text(H.anchor_inner(F.col("anchor"))).alias("text"),
    ).where((F.col("href") != "") & (F.col("text") != ""))
    base = F.coalesce(X.base_url(F.col("source_site")), F.col("source_url"))
    links = raw.withColumn("href", H.resolve_url(base, F.col("href")))
    return links.where(X.has_listing_hint(F.col("text")) | X.looks_like_listing_url(F.col("href"), F.col("source_site")))


def parse_cards(cards: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (source_site, source_url, text, ...) to observations; dropped if rent, area and layout are all missing."""
    t = F.col("_t")
    df = cards.withColumn("_t", T.normalize_loose(F.col("text"))).drop("text")
    found = F.struct(X.parse_rent(t).alias("rent_hkd"), X.parse_area(t).alias("usable_area_sqft"), X.parse_layout(t).alias("layout"))
    some = F.filter(F.array(found), lambda f: F.coalesce(f["rent_hkd"].cast("string"), f["usable_area_sqft"].cast("string"), f["layout"]).isNotNull())
    df = df.select("*", F.inline(some))  # a filter would be pushed below the parsing and repeat it
    df = df.withColumns(
        {
            "source_listing_id": X.source_listing_id(F.col("source_site"), F.col("source_url"), t),
            "title": F.left(t, F.lit(K.TITLE_CHARS)),
            "_head": X.estate_head(t, F.col("layout")),
            "block": X.parse_block(t),
            "floor": X.parse_floor(t),
            "flat": X.parse_flat(t),
            "price_per_sqft": numeric.derived_psf(X.parse_price_per_sqft(t), F.col("rent_hkd"), F.col("usable_area_sqft")),
            "district": X.parse_district(t, terms),
        }
    )
    df = df.withColumn("estate_name", X.estate_of_head(F.col("_head"), terms)).drop("_head", "_t")
    return df.withColumn(
        "source_key", keys.source_key(F.col("source_site"), F.col("source_listing_id"), F.col("source_url"))
    )


def script_texts(pages: DataFrame) -> DataFrame:
    """Property texts of the JSON scripts of pages."""
    payload = pages.select(*_page_columns(pages), "source_url", F.posexplode(H.script_payloads(F.col("html"))).alias("s", "payload"))
    texts = payload.select(*_page_columns(pages), "source_url", "s", F.posexplode(H.property_texts(F.col("payload"))).alias("i", "text"))
    pos = F.struct(F.col("s"), F.col("i"))
    return texts.select(*_page_columns(pages), "source_url", pos.alias("pos"), "text")


def _fallback_texts(pages: DataFrame) -> DataFrame:
    text = pages.select(*_page_columns(pages), "source_url", H.strip_tags(F.col("html")).alias("page"))
    found = text.withColumn("ctx", H.rent_contexts(F.col("page")))
    pieces = F.when(X.has_listing_hint(F.col("page")), F.split(F.col("page"), "(?U)" + K.BOOKMARK_SPLIT))
    chunks = F.when(F.size("ctx") > 0, F.col("ctx")).otherwise(pieces)
    return found.select(*_page_columns(pages), "source_url", F.posexplode(chunks).alias("i", "text")).select(
        *_page_columns(pages), "source_url", F.struct(F.lit(0).alias("s"), F.col("i")).alias("pos"), "text"
    )


def page_observations(pages: DataFrame, terms: list[str], places: bool = False) -> DataFrame:
    """Observations of whole pages: anchors, else text around rents or bookmarks, then JSON; first of a source key wins.

    A page is one landed page of a run, where pages have one. Parsed rows, not pages, are shuffled by page. With ``places`` the
    rows keep ``strategy`` and ``pos``, their order within the page.
    """
    link = F.struct(F.lit(0).alias("s"), F.col("pos").alias("i"))
    anchors = page_links(pages).select(*_page_columns(pages), F.col("href").alias("source_url"), link.alias("pos"), "text")
    tagged = [df.withColumn("strategy", F.lit(n)) for n, df in enumerate([anchors, _fallback_texts(pages), script_texts(pages)])]
    parsed = parse_cards(tagged[0].unionByName(tagged[1]).unionByName(tagged[2]), terms)
    page = [c for c in ("run_id", "page_id") if c in pages.columns]
    by_page = Window.partitionBy(*page)
    kept = parsed.withColumn("_first", F.min("strategy").over(by_page)).where(
        (F.col("strategy") != 1) | (F.col("_first") != 0)
    )
    by_key = Window.partitionBy(*page, "source_key").orderBy("strategy", "pos")
    return kept.withColumn("_rn", F.row_number().over(by_key)).where("_rn = 1").drop("_rn", "_first", *([] if places else ["pos"]))


# Items of the three JSON source families. Scalars are read as strings, so that
# a number keeps its spelling in the title; a literal 0 counts as missing where
# another field can stand in.
FAMILY_1 = """serial_no string, url_desc string, estate struct<name:string>, phase struct<name:string>,
building struct<name:string,first_op_date:string>, floor_level struct<name:string>, flat string, bedroom string,
district struct<name:string>, sm_district struct<name:string>, int_sm_district struct<name:string>, rent_hkd string,
rent string, net_area string, area string, rent_over_net_area string"""
FAMILY_2 = """postNo string, aliasV4 string, alias string, publicLocationNamesHk array<string>, displayTextHk string,
displayText string, floorZoneTextHk string, floorZoneText string, flatZoneTextHk string, flatZoneText string,
room string, marketPrice string, saleableArea string, grossArea string, opDate string, unitPrice string"""
FAMILY_3 = """refNo string, detailUrl string, bigEstateName string, estateName string, buildingName string,
bedroomCount string, rentPrice string, priceInfo struct<rent:string>, nSize string,
areaInfo struct<nSize:string,size:string>, size string, buildingAge string, nUnitRent string,
unitPriceInfo struct<nUnitRent:string>, districtName string"""


def _loose(col: Column) -> Column:
    return T.known(T.normalize_loose(col))


def _given(*cols: Column) -> Column:
    """First value that is neither missing, empty nor zero, else the last one."""
    return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols[:-1]], cols[-1])


def _whole(col: Column) -> Column:
    return numeric.int_or_none(col)


def _title(parts: list[Column], area: Column, gross: Column, rent: Column) -> Column:
    def label(before: str, value: Column, after: str) -> Column:
        return F.when(~value.isin("", "0"), F.concat(F.lit(before), value, F.lit(after)))

    amounts = [label("实用 ", area, " 呎"), label("建筑 ", gross, " 呎"), label("租 $ ", rent, "")]
    return F.concat_ws(" ", *[T.blank_to_null(p) for p in parts], *amounts)


def items_family_1(items: DataFrame, as_of: Column) -> DataFrame:
    """Items with named objects (one struct column ``item``, plus ``source_site``)."""
    i = F.col("item")
    df = items.where((i["serial_no"] != "") & (i["url_desc"] != "")).withColumns(
        {
            "estate_name": _loose(i["estate"]["name"]),
            "building": _loose(i["phase"]["name"]),
            "block": _loose(i["building"]["name"]),
            "floor": _loose(i["floor_level"]["name"]),
            "_flat": _loose(i["flat"]),
            "layout": numeric.layout_from_bedroom(i["bedroom"]),
            "district": F.coalesce(*[_loose(i[d]["name"]) for d in ("district", "sm_district", "int_sm_district")]),
            "_rent": _given(i["rent_hkd"], i["rent"]),
        }
    )
    df = df.withColumn("flat", F.when(F.col("_flat").endswith("室"), F.col("_flat")).otherwise(F.concat("_flat", F.lit("室"))))
    parts = [F.col(c) for c in ("estate_name", "building", "block", "floor", "flat", "layout", "district")]
    return clean_observations(
        df.withColumns(
            {
                "source_url": i["url_desc"],
                "source_listing_id": i["serial_no"],
                "rent_hkd": _whole(F.col("_rent")),
                "usable_area_sqft": _whole(i["net_area"]),
                "gross_area_sqft": _whole(i["area"]),
                "building_age_years": numeric.age_from_iso_date(i["building"]["first_op_date"], as_of),
                "price_per_sqft": i["rent_over_net_area"].try_cast("double"),
                "title": _title(parts, i["net_area"], i["area"], F.col("_rent")),
            }
        )
    )


def _quote_path(col: Column) -> Column:
    out = F.url_encode(col)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def items_family_2(items: DataFrame, as_of: Column) -> DataFrame:
    """Items that name their location by position."""
    i = F.col("item")
    names = F.coalesce(i["publicLocationNamesHk"], F.array().cast("array<string>"))
    alias = F.coalesce(T.blank_to_null(i["aliasV4"]), i["alias"])
    shown = F.coalesce(T.blank_to_null(i["displayTextHk"]), i["displayText"])
    df = items.where((i["postNo"] != "") & (alias != "")).withColumns(
        {
            "estate_name": F.when(F.size(names) >= 5, _loose(F.get(names, F.lit(4)))).otherwise(_loose(shown)),
            "district": F.when(F.size(names) >= 4, _loose(F.get(names, F.lit(3)))),
            "block": F.when(F.size(names) >= 6, _loose(F.get(names, F.size(names) - 1))),
            "floor": _loose(F.coalesce(T.blank_to_null(i["floorZoneTextHk"]), i["floorZoneText"])),
            "flat": _loose(F.coalesce(T.blank_to_null(i["flatZoneTextHk"]), i["flatZoneText"])),
            "layout": numeric.layout_from_bedroom(i["room"]),
        }
    )
    parts = [shown, *[F.col(c) for c in ("floor", "flat", "layout", "district")]]
    return clean_observations(
        df.withColumns(
            {
                "source_url": F.concat(F.lit(K.STATE_DETAIL_URL), _quote_path(alias)),
                "source_listing_id": i["postNo"],
                "rent_hkd": _whole(i["marketPrice"]),
                "usable_area_sqft": _whole(i["saleableArea"]),
                "gross_area_sqft": _whole(i["grossArea"]),
                "building_age_years": numeric.age_from_millis(i["opDate"], as_of),
                "price_per_sqft": i["unitPrice"].try_cast("double"),
                "title": _title(parts, i["saleableArea"], i["grossArea"], i["marketPrice"]),
            }
        )
    )


def items_family_3(items: DataFrame) -> DataFrame:
    """Items whose amounts are flat or nested."""
    i = F.col("item")
    df = items.where((i["refNo"] != "") & (i["detailUrl"] != "")).withColumns(
        {
            "estate_name": _loose(F.concat_ws(" ", T.blank_to_null(i["bigEstateName"]), T.blank_to_null(i["estateName"]))),
            "block": _loose(i["buildingName"]),
            "layout": numeric.layout_from_bedroom(i["bedroomCount"]),
            "district": _loose(i["districtName"]),
            "_rent": _given(i["rentPrice"], i["priceInfo"]["rent"]),
            "_area": _given(i["nSize"], i["areaInfo"]["nSize"]),
            "_gross": _given(i["size"], i["areaInfo"]["size"]),
        }
    )
    parts = [F.col(c) for c in ("estate_name", "block", "layout", "district")]
    return clean_observations(
        df.withColumns(
            {
                "source_url": i["detailUrl"],
                "source_listing_id": i["refNo"],
                "rent_hkd": _whole(F.col("_rent")),
                "usable_area_sqft": _whole(F.col("_area")),
                "gross_area_sqft": _whole(F.col("_gross")),
                "building_age_years": _whole(i["buildingAge"]),
                "price_per_sqft": _given(i["nUnitRent"], i["unitPriceInfo"]["nUnitRent"]).try_cast("double"),
                "title": _title(parts, F.col("_area"), F.col("_gross"), F.col("_rent")),
            }
        )
    )


def state_json(html: Column) -> Column:
    """Application state embedded in a page, with its own entities decoded."""
    raw = F.regexp_extract(html, r'(?s)<script id="serverApp-state" type="application/json">(.*?)</script>', 1)
    for a, b in (("&q;", '"'), ("&a;", "&"), ("&l;", "<"), ("&g;", ">")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return T.blank_to_null(H.unescape(raw))
