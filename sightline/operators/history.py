"""Rent history and the merged current state of listings, derived from the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import keys
from sightline.functions.text import blank_to_null
from sightline.operators import lifecycle
from sightline.operators.extraction import observation_identity
from sightline.session import shuffled

SEGMENT = 1 << 18
DESCRIPTIVE = ["title", "estate_name", "building", "block", "floor", "flat", "layout", "district", "address"]


def _order() -> Column:
    return F.struct("run_id", "obs_id")


def previous_rent(observations: DataFrame, key: str = "listing_id", initial: DataFrame | None = None) -> DataFrame:
    """Adds ``prev_rent``: the last non-zero rent of ``key`` before each row, in run and row order.

    A key may hold any share of the log, so no window spans a whole key: rows are
    windowed within (key, run, block of row ids), which holds at most ``SEGMENT``
    rows; the last rent of each segment is then carried over the few segments of
    the key. ``initial`` (key, rent) seeds the rent before the first row.
    """
    rent = F.when(F.col("rent_hkd") != 0, F.col("rent_hkd"))
    seg = ["run_id", "_block"]
    rows = observations.withColumn("_block", F.floor(F.col("obs_id") / SEGMENT))
    inside = Window.partitionBy(key, *seg).orderBy("obs_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.last(rent, ignorenulls=True).over(inside))

    last = rows.groupBy(key, *seg).agg(F.max_by(rent, F.when(rent.isNotNull(), F.col("obs_id"))).alias("_last"))
    if initial is not None:
        before = {c: F.lit(-1).cast(last.schema[c].dataType).alias(c) for c in seg}
        last = last.unionByName(initial.select(key, *before.values(), F.col("rent").alias("_last")))
    across = Window.partitionBy(key).orderBy(*seg).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(key, *seg, F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    return (
        rows.join(shuffled(carry), [key, *seg], "left")
        .withColumn("prev_rent", F.coalesce("_inside", "_carry"))
        .drop("_block", "_inside", "_carry")
    )


def rent_decreases(observations: DataFrame, key: str = "listing_id", initial: DataFrame | None = None) -> DataFrame:
    """Observations whose rent is lower than the previous one of ``key``."""
    return previous_rent(observations, key, initial).where(F.col("rent_hkd") < F.col("prev_rent"))


def rent_history(observations: DataFrame) -> DataFrame:
    """Lowest and highest rent, and first and last decrease, per listing."""
    down = F.col("rent_hkd") < F.col("prev_rent")
    slim = observations.select("listing_id", "run_id", "obs_id", "seen_at", "rent_hkd")
    return previous_rent(slim).groupBy("listing_id").agg(
        F.min("rent_hkd").alias("min_seen_rent_hkd"),
        F.max("rent_hkd").alias("max_seen_rent_hkd"),
        F.coalesce(F.bool_or(down), F.lit(False)).alias("ever_rent_decreased"),
        F.min(F.when(down, F.col("seen_at"))).alias("first_rent_decrease_at"),
        F.max(F.when(down, F.col("seen_at"))).alias("last_rent_decrease_at"),
    )


def first_known(name: str) -> Column:
    """Earliest non-empty value of a descriptive field."""
    return F.min_by(name, F.when(blank_to_null(F.col(name)).isNotNull(), _order())).alias(name)


def latest_nonzero(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name) != 0, _order()))


def descriptive_fields(observations: DataFrame) -> DataFrame:
    area = F.min_by("usable_area_sqft", F.when(F.col("usable_area_sqft") != 0, _order()))
    return observations.groupBy("listing_id").agg(
        *[first_known(n) for n in DESCRIPTIVE if n in observations.columns], area.alias("usable_area_sqft")
    )


def latest_prices(observations: DataFrame) -> DataFrame:
    return observations.groupBy("listing_id").agg(
        latest_nonzero("rent_hkd").alias("last_rent_hkd"), latest_nonzero("price_per_sqft").alias("last_price_per_sqft")
    )


def with_identity(merged: DataFrame) -> DataFrame:
    """Identity of a listing, hashed once per listing from the observation that created it (struct ``created``)."""
    first = merged.select("listing_id", "created.*")
    ids = first.select(
        "listing_id", observation_identity(first).alias("identity_key"), F.col("source_key").alias("_key")
    )
    named = ids.withColumn("canonical_id", keys.canonical_id(F.col("identity_key"), F.col("_key"))).drop("_key")
    return merged.drop("created").join(shuffled(named), "listing_id")


def listings(observations: DataFrame, state: DataFrame) -> DataFrame:
    """Merged current state per listing. All parts are aggregated by listing first, so they join in place."""
    raw = ["estate_name", "block", "building", "floor", "flat", "usable_area_sqft", "title", "layout", "rent_hkd", "source_key"]
    created = F.min_by(F.struct(*[c for c in raw if c in observations.columns]), _order())
    area = F.min_by("usable_area_sqft", F.when(F.col("usable_area_sqft") != 0, _order()))
    merged = observations.groupBy("listing_id").agg(
        created.alias("created"),
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        *[first_known(n) for n in DESCRIPTIVE if n in observations.columns],
        area.alias("usable_area_sqft"),
        latest_nonzero("rent_hkd").alias("last_rent_hkd"),
        latest_nonzero("price_per_sqft").alias("last_price_per_sqft"),
    )
    return (
        with_identity(merged)
        .join(shuffled(rent_history(observations)), "listing_id", "left")
        .join(shuffled(lifecycle.first_delisted(state)), "listing_id", "left")
        .join(shuffled(lifecycle.source_summary(state)), "listing_id", "left")
    )


