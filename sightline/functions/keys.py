"""Keys that identify a source record and a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import blank_to_null, let, normalize_text, stable_hash


def source_key(site: Column, listing_id: Column, url: Column) -> Column:
    return F.when(blank_to_null(listing_id).isNotNull(), F.concat(site, F.lit(":"), listing_id)).otherwise(
        F.concat(site, F.lit(":url:"), stable_hash(url, 20))
    )


def _number(col: Column) -> Column:
    return F.coalesce(F.when(col != 0, col.cast("string")), F.lit(""))


def identity_key(
    estate: Column, block: Column, building: Column, floor: Column, flat: Column, area: Column,
    title: Column, layout: Column, rent: Column,
) -> Column:
    """Hash of estate, unit and area; where one of them is unknown, of estate or title, layout, area and rent."""
    either = F.coalesce(blank_to_null(block), building)
    name = F.coalesce(blank_to_null(estate), title)
    parts = F.struct(
        normalize_text(estate).alias("estate"), normalize_text(either).alias("block"), normalize_text(floor).alias("floor"),
        normalize_text(flat).alias("flat"), _number(area).alias("area"), normalize_text(name).alias("name"),
        normalize_text(layout).alias("layout"), _number(rent).alias("rent"),
    )

    def text(p: Column) -> Column:
        unit_known = F.concat(p["block"], p["floor"], p["flat"]) != ""
        primary = F.concat_ws("|", *[p[f] for f in ("estate", "block", "floor", "flat", "area")])
        fallback = F.concat_ws("|", *[p[f] for f in ("name", "layout", "area", "rent")])
        return F.when((p["estate"] != "") & unit_known & (p["area"] != ""), primary).otherwise(fallback)

    return stable_hash(let(parts, text), 20)


def canonical_id(identity: Column, source: Column) -> Column:
    return stable_hash(F.concat_ws("|", identity, source), 20)
