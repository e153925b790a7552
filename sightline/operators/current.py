"""Queries over the current state of listings and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import constants as K


def summary_counts(listings: DataFrame) -> DataFrame:
    return listings.agg(
        F.count("*").alias("total"),
        F.count_if("active").alias("active"),
        F.count("first_delisted_at").alias("with_delist"),
        F.count_if("ever_rent_decreased").alias("with_rent_decrease"),
        F.min("last_rent_hkd").alias("min_rent"),
        F.avg("last_rent_hkd").alias("avg_rent"),
        F.max("last_rent_hkd").alias("max_rent"),
        F.avg("last_price_per_sqft").alias("avg_psf"),
    )


def active_sites(state: DataFrame) -> DataFrame:
    """Distinct sites with an active record per listing; one row per site is shuffled, however many copies it has."""
    pairs = state.where("active").groupBy("listing_id", "source_site").agg(F.min("source_url").alias("url"))
    return pairs.groupBy("listing_id").agg(
        F.count("*").alias("distinct_sites"), F.min("source_site").alias("sample_source_site"), F.min("url").alias("sample_source_url")
    )


def with_site_counts(listings: DataFrame, state: DataFrame) -> DataFrame:
    counts = active_sites(state).select("listing_id", "distinct_sites")
    return listings.join(counts, "listing_id", "left").withColumn("distinct_sites", F.coalesce("distinct_sites", F.lit(0)))


def active_by_estate(listings: DataFrame, state: DataFrame, limit: int = 30) -> DataFrame:
    rows = with_site_counts(listings.where("active"), state)
    name = F.coalesce("estate_name", F.lit(K.UNKNOWN_ESTATE)).alias("estate_name")
    out = rows.groupBy(name).agg(
        F.count("*").alias("count"),
        F.min("last_rent_hkd").alias("min_rent"),
        F.avg("last_rent_hkd").alias("avg_rent"),
        F.min("last_price_per_sqft").alias("min_psf"),
        F.avg("last_price_per_sqft").alias("avg_psf"),
        F.avg("usable_area_sqft").alias("avg_area"),
        F.count_if(F.col("distinct_sites") >= 2).alias("cross_source_count"),
    )
    return out.orderBy(F.desc("count"), F.asc_nulls_first("min_rent"), "estate_name").limit(limit)


def active_by_source(state: DataFrame) -> DataFrame:
    out = state.where("active").groupBy("source_site").agg(F.count("*").alias("active_count"))
    return out.orderBy(F.desc("active_count"), "source_site")


def active_listings(listings: DataFrame, limit: int | None = None) -> DataFrame:
    out = listings.where("active").orderBy(F.asc_nulls_first("last_rent_hkd"), F.desc("last_seen_at"), "listing_id")
    return out.limit(limit) if limit else out


def all_listings(listings: DataFrame, limit: int | None = None) -> DataFrame:
    out = listings.orderBy(F.desc("active"), F.desc("last_seen_at"), "listing_id")
    return out.limit(limit) if limit else out


def latest_changes(observations: DataFrame, listings: DataFrame, limit: int = 100) -> DataFrame:
    """Last observations by id with the listing they belong to; the limit is applied before the join."""
    last = observations.orderBy(F.desc("obs_id")).limit(limit)
    return listings.select("listing_id", "canonical_id").join(F.broadcast(last), "listing_id").orderBy(F.desc("obs_id"))


def changes_with_listing(observations: DataFrame, listings: DataFrame) -> DataFrame:
    """Every observation with the canonical id of its listing."""
    return observations.join(listings.select("listing_id", "canonical_id"), "listing_id")


def recently_delisted(state: DataFrame, listings: DataFrame, limit: int = 30) -> DataFrame:
    gone = state.where("first_missing_at is not null").select("source_key", "listing_id", "source_site", "first_missing_at", "source_url")
    last = gone.orderBy(F.desc("first_missing_at"), "source_key").limit(limit)
    rows = listings.select("listing_id", "estate_name", "block", "floor", "flat", "last_rent_hkd", "usable_area_sqft")
    return rows.join(F.broadcast(last), "listing_id").orderBy(F.desc("first_missing_at"), "source_key")


def reconcile_sources(filtered: DataFrame, state: DataFrame) -> DataFrame:
    """Distinct records seen now per source against active records of the state."""
    web = filtered.groupBy("source_site", "source_key").agg(F.count("*")).groupBy("source_site").agg(F.count("*").alias("web_total"))
    db = state.where("active").groupBy("source_site").agg(F.count("*").alias("db_total"))
    out = web.join(db, "source_site", "full_outer").withColumn("db_total", F.coalesce("db_total", F.lit(0)))
    return out.withColumn("matched", F.coalesce(F.col("web_total") == F.col("db_total"), F.lit(False)))


def site_validation(marked: DataFrame, site_runs: DataFrame, missing: DataFrame) -> DataFrame:
    """Per run and source: raw, kept and rejected rows, the missing gate and the records it marked.

    ``marked``: observations with ``rejected_by``; ``missing``: missing events (run_id, source_site).
    """
    rows = marked.groupBy("run_id", "source_site").agg(
        F.count("*").alias("raw_observations"),
        F.count_if(F.col("rejected_by").isNull()).alias("filtered_observations"),
    )
    events = missing.groupBy("run_id", "source_site").agg(F.count("*").alias("missing_sources_marked"))
    out = site_runs.join(rows, ["run_id", "source_site"], "left").join(events, ["run_id", "source_site"], "left")
    zero = ["raw_observations", "filtered_observations", "missing_sources_marked"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    return out.select(
        "run_id", "source_site", *zero, (F.col("raw_observations") - F.col("filtered_observations")).alias("rejected_observations"),
        F.col("eligible").alias("missing_marking_enabled"),
    )


def run_totals(validation: DataFrame) -> DataFrame:
    return validation.groupBy("run_id").agg(
        F.sum("filtered_observations").alias("inserted_observations"),
        F.sum("missing_sources_marked").alias("missing_sources_marked"),
    )


def page_completeness(pages: DataFrame) -> DataFrame:
    """Pages seen against pages due, from (run_id, source_site, page, total, page_size) or declared ``pages_total``."""
    due = F.greatest(F.lit(1), F.max(F.ceil(F.col("total") / F.col("page_size"))))
    out = pages.groupBy("run_id", "source_site").agg(due.alias("pages_due"), F.countDistinct("page").alias("pages_seen"))
    return out.withColumn("complete", F.col("pages_seen") >= F.col("pages_due"))
