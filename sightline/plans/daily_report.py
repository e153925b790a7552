"""All tables of the daily report, for one date or a range of dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sightline.operators import reports as R
from sightline.operators import runs as runs_
from sightline.operators import snapshots as S


def periods(runs: DataFrame, report_date: date | None = None) -> dict[str, runs_.RunRef]:
    """Runs behind the current, day and week snapshot; a baseline without a successful run is left out."""
    target = runs_.target_run(runs, report_date)
    wanted = {"day": target.local_date - timedelta(days=1), "week": target.local_date - timedelta(days=7)}
    found = runs_.baseline_runs(runs, list(wanted.values()))
    return {"current": target} | {p: found[d] for p, d in wanted.items() if d in found}


def period_snapshots(observations: DataFrame, listings: DataFrame, sources: DataFrame, refs: dict[str, runs_.RunRef]) -> DataFrame:
    """Snapshots of all periods in one pass over the log, labelled in ``period``."""
    rows = S.snapshots(observations, listings, sources, [r.started_at for r in refs.values()])
    names = F.lit(None).cast("string")
    for period, ref in refs.items():
        names = F.when(F.col("cutoff") == F.lit(ref.started_at), F.lit(period)).otherwise(names)
    return rows.withColumn("period", names)


def velocity(listings: DataFrame, state: DataFrame, sources: DataFrame, runs: DataFrame, target: date) -> DataFrame:
    refs = runs_.baseline_runs(runs, [target - timedelta(days=n) for n in range(7)])
    spark = runs.sparkSession
    counts = S.active_counts(sources, [r.started_at for r in refs.values()])
    dates = spark.createDataFrame([(r.started_at, d) for d, r in refs.items()], "cutoff timestamp, run_date date")
    return R.daily_velocity(listings, state, counts.join(F.broadcast(dates), "cutoff"), target)


def daily_report(
    observations: DataFrame, runs: DataFrame, listings: DataFrame, state: DataFrame, layouts: list[str],
    report_date: date | None = None, sources: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of the report of one date. The labelled snapshots are persisted; call ``unpersist`` on ``snapshots`` when done."""
    refs = periods(runs, report_date)
    target = refs["current"]
    sources = state if sources is None else sources
    snap = period_snapshots(observations, listings, sources, refs).persist(StorageLevel.MEMORY_AND_DISK)
    cur, prev, week = (snap.where(F.col("period") == p) for p in ("current", "day", "week"))
    cutoff = F.lit(target.started_at)
    start = F.lit(target.local_date).cast("timestamp")
    new = R.first_seen_between(listings, state, start, cutoff)
    removed = R.with_age(R.removed_listings(cur, prev), cutoff)
    reference = R.rent_reference(listings, cur)
    low = R.rent_percentile(reference)
    overview = R.market_overview(snap)
    speed = velocity(listings, state, sources, runs, target.local_date)
    return {
        "snapshots": snap,
        "overview": overview,
        "market_heat": R.market_heat(overview, new, removed),
        "layout_stats": R.layout_comparison(cur, prev, week),
        "estate_stats": R.estate_comparison(cur, prev),
        "velocity": speed,
        "velocity_signal": R.velocity_signal(speed),
        "new_listings": R.with_age(R.new_listings(listings, state, start, cutoff), cutoff),
        "removed_listings": removed,
        "source_disappeared": R.source_missing(state, listings, start, cutoff),
        "rent_changes": R.rent_changes(cur, prev, cutoff),
        "rent_decreases": R.rent_decreases(cur, prev, cutoff),
        "watchlist": R.value_watchlist(cur, cutoff, low),
        "fresh_value_watchlist": R.fresh_watchlist(new, cur, cutoff, low),
        "stale_value_watchlist": R.stale_watchlist(cur, cutoff, low),
        "budget_stats": R.budget_stats(cur, prev if "day" in refs else None, new, removed, reference, layouts),
        "withdrawals": R.withdrawals(state, listings, cutoff),
        "withdrawal_lag_stats": R.withdrawal_lag_stats(R.withdrawn(state, listings, cutoff)),
    }


def layout_history(observations: DataFrame, listings: DataFrame, sources: DataFrame, runs: DataFrame, first: date, last: date) -> DataFrame:
    """Layout statistics of every report date in a range, from one pass over the log."""
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    refs = runs_.baseline_runs(runs, days)
    snap = S.snapshots(observations, listings, sources, [r.started_at for r in refs.values()])
    stats = snap.groupBy("cutoff", R.label("layout").alias("layout")).agg(*R.stats_columns())
    dates = runs.sparkSession.createDataFrame([(r.started_at, d) for d, r in refs.items()], "cutoff timestamp, report_date date")
    return stats.join(F.broadcast(dates), "cutoff").drop("cutoff")
