"""Search filters over observations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import text as T


@dataclass
class Filters:
    """Bounds and term lists of a search; an unset field does not restrict."""

    min_rent: int | None = None
    max_rent: int | None = None
    min_area: int | None = None
    max_area: int | None = None
    min_gross_area: int | None = None
    max_gross_area: int | None = None
    min_building_age: int | None = None
    max_building_age: int | None = None
    min_psf: float | None = None
    max_psf: float | None = None
    layouts: list[str] = field(default_factory=list)
    estates: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    excluded_estates: list[str] = field(default_factory=list)
    excluded_keywords: list[str] = field(default_factory=list)


def in_range(col: Column, low: float | None, high: float | None, missing_passes: bool = False) -> Column:
    """Inclusive range with open ends; a missing value passes an unset range, and a set one only if told so."""
    checks = [col >= low] if low is not None else []
    checks += [col <= high] if high is not None else []
    return F.coalesce(reduce(Column.__and__, checks), F.lit(missing_passes)) if checks else F.lit(True)


def _known(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def with_search_keys(df: DataFrame) -> DataFrame:
    """Comparison keys the text filters read."""
    c = {n: T.blank_to_null(_known(df, n, "string")) for n in ("title", "estate_name", "address", "district", "layout")}
    both = F.concat_ws(" ", c["estate_name"], c["title"])
    layout = F.coalesce(c["layout"], c["title"], F.lit(""))
    return df.withColumns(
        {
            "_hay": T.normalize_text(F.concat_ws(" ", *c.values())),
            "_estate": T.normalize_text(F.coalesce(c["estate_name"], c["title"])),
            "_estates": T.normalize_text(both),
            "_layout": T.normalize_text(layout),
            "_rooms": T.layout_bedroom_count(layout),
        }
    )


def area_filter(terms: list[str]) -> Column:
    return T.key_contains_any(F.col("_hay"), terms) if terms else F.lit(True)


def layout_filter(layouts: list[str], counts: list[int]) -> Column:
    """Bedroom count in ``counts``; only where no wanted layout has a count, a substring match."""
    if not layouts:
        return F.lit(True)
    return F.coalesce(F.col("_rooms").isin(counts), F.lit(False)) if counts else T.key_contains_any(F.col("_layout"), layouts)


def allowed_estates(terms: list[str]) -> Column:
    return T.key_contains_any(F.col("_estate"), terms) if terms else F.lit(True)


def required_keywords(terms: list[str]) -> Column:
    return reduce(Column.__and__, [F.col("_hay").contains(T.fold_term(t)) for t in terms], F.lit(True))


def excluded_estates(terms: list[str]) -> Column:
    return ~T.key_contains_any(F.col("_estates"), terms)


def excluded_keywords(terms: list[str]) -> Column:
    return ~T.key_contains_any(F.col("_hay"), terms)


def wanted_bedrooms(spark: SparkSession, layouts: list[str]) -> list[int]:
    """Bedroom counts of the wanted layouts: a handful of job parameters."""
    if not layouts:
        return []
    terms = spark.createDataFrame([(t,) for t in layouts], "t string")
    rows = terms.select(T.layout_bedroom_count(F.col("t")).alias("n")).where("n is not null").distinct().collect()
    return sorted(r.n for r in rows)


def conditions(df: DataFrame, f: Filters, terms: list[str]) -> dict[str, Column]:
    """One never-null condition per filter, in the order they are checked; needs ``with_search_keys``."""
    counts = wanted_bedrooms(df.sparkSession, f.layouts)
    return {
        "area": area_filter(terms),
        "rent": in_range(F.col("rent_hkd"), f.min_rent, f.max_rent, missing_passes=True),
        "usable_area": in_range(F.col("usable_area_sqft"), f.min_area, f.max_area),
        "gross_area": in_range(_known(df, "gross_area_sqft", "int"), f.min_gross_area, f.max_gross_area),
        "building_age": in_range(_known(df, "building_age_years", "int"), f.min_building_age, f.max_building_age),
        "price_per_sqft": in_range(F.col("price_per_sqft"), f.min_psf, f.max_psf),
        "layout": layout_filter(f.layouts, counts),
        "estate": allowed_estates(f.estates),
        "keyword": required_keywords(f.keywords),
        "excluded_estate": excluded_estates(f.excluded_estates),
        "excluded_keyword": excluded_keywords(f.excluded_keywords),
    }


_KEYS = ["_hay", "_estate", "_estates", "_layout", "_rooms"]


def filter_observations(df: DataFrame, f: Filters, terms: list[str]) -> DataFrame:
    keyed = with_search_keys(df)
    return keyed.where(reduce(Column.__and__, conditions(keyed, f, terms).values())).drop(*_KEYS)


def with_rejection(df: DataFrame, f: Filters, terms: list[str]) -> DataFrame:
    """Adds ``rejected_by``: the first filter a row fails, null if it passes all."""
    keyed = with_search_keys(df)
    reasons = [F.when(~ok, F.lit(name)) for name, ok in conditions(keyed, f, terms).items()]
    return keyed.withColumn("rejected_by", F.coalesce(*reasons)).drop(*_KEYS)


def rejection_audit(df: DataFrame, f: Filters, terms: list[str]) -> DataFrame:
    """Raw, kept and rejected rows per source, and rows per first failing filter."""
    marked = with_rejection(df, f, terms)
    names = list(conditions(with_search_keys(df), Filters(), terms))
    return marked.groupBy("source_site").agg(
        F.count("*").alias("raw_observations"),
        F.count_if(F.col("rejected_by").isNull()).alias("filtered_observations"),
        F.count_if(F.col("rejected_by").isNotNull()).alias("rejected_observations"),
        *[F.count_if(F.col("rejected_by") == n).alias(f"rejected_{n}") for n in names],
    )


def source_capabilities(sites: DataFrame, table: Mapping[str, list[str]] = K.PUSHABLE) -> DataFrame:
    """One row per site and filter: whether the source may apply it; unknown sites may apply none."""
    pushable = F.array().cast("array<string>")
    for site, names in table.items():
        pushable = F.when(F.col("source_site") == site, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(pushable)
    every = F.array(*[F.lit(n) for n in K.NUMERIC_FILTERS + K.TEXT_FILTERS])
    return sites.select("source_site", F.explode(every).alias("filter"), pushable.alias("_p")).select(
        "source_site", "filter", F.array_contains("_p", F.col("filter")).alias("pushable")
    )
