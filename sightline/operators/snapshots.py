"""Active listings as of one or many points in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATEST = ["title", "estate_name", "block", "floor", "flat", "layout", "district", "rent_hkd", "usable_area_sqft", "price_per_sqft"]
CURRENT = {"rent_hkd": "last_rent_hkd", "price_per_sqft": "last_price_per_sqft"}
KEPT = [
    "canonical_id", "first_seen_at", "first_delisted_at", "ever_rent_decreased", "first_rent_decrease_at",
    "last_rent_decrease_at", "max_seen_rent_hkd", "min_seen_rent_hkd",
]


def active_by_state(cutoff: Column) -> Column:
    """Active at ``cutoff`` by the current lifecycle row, which forgets earlier absences."""
    return (F.col("first_seen_at") <= cutoff) & (
        F.col("first_missing_at").isNull()
        | (F.col("first_missing_at") > cutoff)
        | (F.col("active") & (F.col("last_seen_at") <= cutoff))
    )


def active_by_interval(cutoff: Column) -> Column:
    """Active at ``cutoff`` by presence intervals, right for any past time."""
    return (F.col("start_at") <= cutoff) & (F.col("end_at").isNull() | (F.col("end_at") > cutoff))


def _cutoffs(cutoffs: list[datetime]) -> Column:
    return F.array(*[F.lit(c).cast("timestamp") for c in sorted(set(cutoffs))])


def active_sources(rows: DataFrame, cutoffs: list[datetime]) -> DataFrame:
    """Distinct active sites and a sample source per listing and cutoff, from source state or presence intervals.

    Cutoffs are start times of chosen runs. Rows are reduced per site before they
    are shuffled, so that copies of a listing cost one row per site.
    """
    active = active_by_interval if "start_at" in rows.columns else active_by_state
    hits = rows.withColumn("cutoff", F.explode(F.filter(_cutoffs(cutoffs), active)))
    by_site = hits.groupBy("cutoff", "listing_id", "source_site").agg(F.min("source_url").alias("url"))
    return by_site.groupBy("cutoff", "listing_id").agg(
        F.count("*").alias("active_source_count"),
        F.min("source_site").alias("sample_source_site"),
        F.min("url").alias("sample_source_url"),
    )


def latest_observation(observations: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Last observation of every listing at ``cutoff``, an aggregation with partial results per task."""
    at = cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("timestamp")
    cols = [c for c in LATEST if c in observations.columns]
    last = F.max_by(F.struct("obs_id", *cols), F.struct("seen_at", "obs_id"))
    return observations.where(F.col("seen_at") <= at).groupBy("listing_id").agg(last.alias("_latest")).select("listing_id", "_latest.*")


def latest_per_cutoff(observations: DataFrame, cutoffs: list[datetime]) -> DataFrame:
    """Last observation of every listing at each cutoff after it was first seen.

    The log is reduced once to one row per listing and gap between cutoffs; these
    are carried forward over at most as many rows as there are cutoffs.
    """
    cols = [c for c in LATEST if c in observations.columns]
    due = F.array_min(F.filter(_cutoffs(cutoffs), lambda c: F.col("seen_at") <= c))
    last = F.max_by(F.struct("obs_id", *cols), F.struct("seen_at", "obs_id"))
    gaps = observations.withColumn("cutoff", due).where("cutoff is not null").groupBy("listing_id", "cutoff").agg(last.alias("_latest"))
    following = Window.partitionBy("listing_id").orderBy("since")
    held = gaps.select("listing_id", F.col("cutoff").alias("since"), "_latest.*").withColumn("until", F.lead("since").over(following))
    valid = F.filter(_cutoffs(cutoffs), lambda c: (c >= F.col("since")) & (F.col("until").isNull() | (c < F.col("until"))))
    return held.withColumn("cutoff", F.explode(valid)).drop("since", "until")


def snapshots(observations: DataFrame, listings: DataFrame, sources: DataFrame, cutoffs: list[datetime]) -> DataFrame:
    """Active listings with their latest values at every cutoff: one row per cutoff and listing.

    ``sources`` is the source state (as the current lifecycle tells) or the
    presence intervals (exact for any past time).
    """
    active = active_sources(sources, cutoffs)
    latest = latest_per_cutoff(observations, cutoffs).drop("obs_id")
    values = [c for c in latest.columns if c not in ("cutoff", "listing_id")]
    current = listings.select("listing_id", *KEPT, *[F.col(CURRENT.get(v, v)).alias(f"_{v}") for v in values])
    rows = active.join(latest, ["listing_id", "cutoff"], "left").join(current, "listing_id")
    return rows.select(
        "cutoff", "listing_id", *KEPT, *[F.coalesce(v, f"_{v}").alias(v) for v in values],
        "active_source_count", "sample_source_site", "sample_source_url",
    )


def _spans(sources: DataFrame) -> DataFrame:
    """listing_id, start, end (null: open) of the times at which a source of a listing is active. A record's state is one or two spans."""
    if "start_at" in sources.columns:
        return sources.select("listing_id", F.col("start_at").alias("start"), F.col("end_at").alias("end"))
    until = sources.select("listing_id", F.col("first_seen_at").alias("start"), F.col("first_missing_at").alias("end"))
    back = sources.where(F.col("active") & F.col("first_missing_at").isNotNull())
    return until.unionByName(back.select("listing_id", F.col("last_seen_at").alias("start"), F.lit(None).cast("timestamp").alias("end")))


def activity_changes(sources: DataFrame) -> DataFrame:
    """(at, change): by how much the number of active listings changes at each time.

    Spans are starts and ends of runs, so a listing has few different ones however many copies it has; these are merged where they
    overlap, and only the ends of what is left count.
    """
    spans = _spans(sources).where("start is not null and (end is null or end > start)").distinct()
    order = Window.partitionBy("listing_id").orderBy("start")
    far = F.lit("9999-12-31").cast("timestamp")
    reach = F.max(F.coalesce("end", far)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= reach, 0).otherwise(1)
    rows = spans.withColumn("opens", opens).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("listing_id", "part").agg(F.min("start").alias("start"), F.max(F.coalesce("end", far)).alias("end"))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change")))
    return merged.select(F.inline(ends)).where(F.col("at") < far).groupBy("at").agg(F.sum("change").alias("change"))


def active_counts(sources: DataFrame, cutoffs: list[datetime] | DataFrame) -> DataFrame:
    """Number of active listings at every cutoff, zeros included, by a sweep over the times at which it changes.

    ``cutoffs`` may be a table with a column ``cutoff``. The last window holds one row per time and cutoff, none per listing.
    """
    if not isinstance(cutoffs, DataFrame):
        cutoffs = sources.sparkSession.range(1).select(F.explode(_cutoffs(cutoffs)).alias("cutoff"))
    asked = cutoffs.select(F.col("cutoff").alias("at"), F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("asked")).distinct()
    events = activity_changes(sources).withColumn("asked", F.lit(False)).unionByName(asked)
    upto = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("n", F.sum("change").over(upto)).where("asked").select(F.col("at").alias("cutoff"), F.col("n").alias("active_count"))
