"""Presence of source records over runs, derived from the observation log without a loop.

``observations``: obs_id, run_id, seen_at (start of the run), source_site,
source_key, listing_id, source_url, source_listing_id and the descriptive fields.
``site_runs``: source_site, run_id, started_at, eligible; one row per site and run.
Runs are ordered by ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import lookup_join


def missing_gate(mode: Column, errors: Column, filtered: Column, safe: bool = True) -> Column:
    """Whether a source may mark records missing in a run."""
    enough = (filtered >= 1) if safe else F.lit(True)
    return F.coalesce((mode != "initial") & (errors == 0) & enough, F.lit(False))


def next_eligible(site_runs: DataFrame) -> DataFrame:
    """For each site and run, the first later run in which the site may mark records missing.

    A window holds the runs of one site, a dimension that does not grow with the log.
    """
    later = Window.partitionBy("source_site").orderBy("run_id").rowsBetween(1, Window.unboundedFollowing)
    run = F.struct("run_id", "started_at")
    return site_runs.select(
        "source_site", "run_id", F.min(F.when(F.col("eligible"), run)).over(later).alias("next_eligible")
    )


def sightings(observations: DataFrame) -> DataFrame:
    """One row per source record and run: pre-aggregated, so a record has at most as many rows as there are runs."""
    last = F.max_by(F.struct("listing_id", "source_url", "source_listing_id"), "obs_id")
    return (
        observations.groupBy("source_site", "source_key", "run_id")
        .agg(F.min("seen_at").alias("seen_at"), last.alias("_rec"))
        .select("source_site", "source_key", "run_id", "seen_at", "_rec.*")
    )


def next_sighting(seen: DataFrame) -> DataFrame:
    per_key = Window.partitionBy("source_key").orderBy("run_id")
    return seen.withColumn("next_run", F.lead("run_id").over(per_key))


def missing_events(seen: DataFrame, site_runs: DataFrame) -> DataFrame:
    """Sightings with ``missing``: the run that marks the record missing before its next sighting, if any."""
    joined = lookup_join(seen, next_eligible(site_runs), ["source_site", "run_id"], "left", "source_key")
    gone = F.col("next_eligible").isNotNull() & (
        F.col("next_run").isNull() | (F.col("next_eligible.run_id") < F.col("next_run"))
    )
    return next_sighting(joined).withColumn("missing", F.when(gone, F.col("next_eligible"))).drop("next_eligible")


def presence_intervals(events: DataFrame) -> DataFrame:
    """Maximal presence intervals of ``missing_events``; open ones have no end. Grouped within the partitions of the window."""
    before = Window.partitionBy("source_key").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    island = F.coalesce(F.sum(F.col("missing").isNotNull().cast("int")).over(before), F.lit(0))
    return (
        events.withColumn("island", island)
        .groupBy("source_key", "island")
        .agg(
            F.min("source_site").alias("source_site"),
            F.max_by(F.struct("listing_id", "source_url"), "run_id").alias("_rec"),
            F.min("run_id").alias("start_run"),
            F.min("seen_at").alias("start_at"),
            F.max("run_id").alias("last_run"),
            F.max("missing").alias("end"),
        )
        .select(
            "source_site", "source_key", "island", "_rec.*", "start_run", "start_at", "last_run",
            F.col("end.run_id").alias("end_run"), F.col("end.started_at").alias("end_at"),
        )
    )


def source_state(events: DataFrame) -> DataFrame:
    """Current lifecycle of every source record."""
    return (
        events.groupBy("source_key")
        .agg(
            F.min("source_site").alias("source_site"),
            F.max_by(F.struct("listing_id", "source_url", "source_listing_id"), "run_id").alias("_rec"),
            F.min("seen_at").alias("first_seen_at"),
            F.max("seen_at").alias("last_seen_at"),
            F.min("missing").alias("first_missing"),
            F.count("missing").alias("missing_count"),
            F.max("run_id").alias("last_run_id"),
            F.max_by(F.col("missing").isNull(), "run_id").alias("active"),
        )
        .select(
            "source_key", "source_site", "_rec.*", "first_seen_at", "last_seen_at",
            F.col("first_missing.started_at").alias("first_missing_at"), "missing_count", "active", "last_run_id",
        )
    )


def merge_state(old: DataFrame, observations: DataFrame, site_runs: DataFrame) -> DataFrame:
    """State after further runs: active records of ``old`` enter as a sighting in their last run.

    Equal to rebuilding the state from the whole log, as long as the new runs
    come after every run already merged.
    """
    carried = old.where("active").select(
        "source_site", "source_key", F.col("last_run_id").alias("run_id"), F.col("last_seen_at").alias("seen_at"),
        "listing_id", "source_url", "source_listing_id",
    )
    seen = sightings(observations).unionByName(carried)
    carried_runs = carried.select("source_site", "run_id").distinct()
    dims = site_runs.select("source_site", "run_id", "started_at", "eligible").unionByName(
        carried_runs.withColumn("started_at", F.lit(None).cast("timestamp")).withColumn("eligible", F.lit(False))
    )
    dims = dims.groupBy("source_site", "run_id").agg(F.max("started_at").alias("started_at"), F.max("eligible").alias("eligible"))
    new = source_state(missing_events(seen, dims))
    n, o = new.alias("n"), old.alias("o")
    latest = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns}
    latest["first_seen_at"] = F.coalesce("o.first_seen_at", "n.first_seen_at").alias("first_seen_at")
    latest["first_missing_at"] = F.coalesce("o.first_missing_at", "n.first_missing_at").alias("first_missing_at")
    count = F.coalesce("o.missing_count", F.lit(0)) + F.coalesce("n.missing_count", F.lit(0))
    latest["missing_count"] = count.alias("missing_count")
    return n.join(o, F.col("n.source_key") == F.col("o.source_key"), "full_outer").select(*latest.values())


def first_delisted(state: DataFrame) -> DataFrame:
    return state.groupBy("listing_id").agg(F.min("first_missing_at").alias("first_delisted_at"))


def source_summary(state: DataFrame) -> DataFrame:
    """Sources of a listing: record count, any active, and a map with the most recently seen record of each site."""
    rec = F.struct(
        F.col("source_url").alias("url"), F.col("source_listing_id").alias("id"), "first_seen_at", "last_seen_at",
        "first_missing_at", "active",
    )
    by_site = state.groupBy("listing_id", "source_site").agg(
        F.max_by(rec, F.struct("last_seen_at", "source_key")).alias("_rec"),
        F.count("*").alias("n"),
        F.bool_or("active").alias("any_active"),
    )
    entries = F.array_sort(F.collect_list(F.struct("source_site", "_rec")))
    return by_site.groupBy("listing_id").agg(
        F.sum("n").alias("sources_count"),
        F.bool_or("any_active").alias("active"),
        F.map_from_entries(entries).alias("source_summary"),
    )


def unseen_keys(state: DataFrame, seen: DataFrame) -> DataFrame:
    """Active records that a run did not see."""
    return state.where("active").join(seen.select("source_key"), "source_key", "left_anti")


def first_occurrences(observations: DataFrame) -> DataFrame:
    """The first observation of every source record: its number, run and time."""
    return observations.groupBy("source_key").agg(
        F.min("obs_id").alias("obs_id"), F.min("run_id").alias("run_id"), F.min("seen_at").alias("seen_at")
    )


def distinct_keys(observations: DataFrame) -> DataFrame:
    """Number of different records per source. Keys are made distinct first, so that a large source is spread over tasks."""
    keys = observations.select("source_site", "source_key").distinct()
    return keys.groupBy("source_site").agg(F.count("source_key").alias("keys"))


def run_status(blocked: Column, failed: Column, errors: Column) -> Column:
    return (
        F.when(blocked, F.lit("blocked")).when(failed, F.lit("failed")).when(errors > 0, F.lit("partial")).otherwise(F.lit("ok"))
    )
