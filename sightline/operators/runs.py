"""Choice of runs and report dates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.numeric import date_in_range


@dataclass(frozen=True)
class RunRef:
    run_id: int
    started_at: datetime
    local_date: date


def ok_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "ok")


def latest_run_per_date(runs: DataFrame) -> DataFrame:
    """Last successful run of every local date."""
    last = F.max_by(F.struct("run_id", "started_at"), F.struct("started_at", "run_id"))
    return ok_runs(runs).groupBy("run_date").agg(last.alias("_run")).select("run_date", "_run.*")


def run_bounds(runs: DataFrame) -> DataFrame:
    """First and last successful run."""
    order = F.struct("started_at", "run_id")
    run = F.struct("run_id", "started_at", "run_date")
    return ok_runs(runs).agg(F.min_by(run, order).alias("first"), F.max_by(run, order).alias("last"))


def baseline_runs(runs: DataFrame, dates: list[date]) -> dict[date, RunRef]:
    """Last successful run of each of a few report dates; a date without one is left out."""
    rows = latest_run_per_date(runs).where(F.col("run_date").isin(dates)).collect()
    return {r.run_date: RunRef(r.run_id, r.started_at, r.run_date) for r in rows}


def target_run(runs: DataFrame, report_date: date | None = None) -> RunRef:
    """Run a report is based on: the last successful one, of ``report_date`` if given."""
    pool = latest_run_per_date(runs)
    if report_date is not None:
        pool = pool.where(F.col("run_date") == F.lit(report_date))
    rows = pool.orderBy(F.desc("started_at"), F.desc("run_id")).take(1)
    if not rows:
        raise ValueError("no successful run to report on")
    return RunRef(rows[0].run_id, rows[0].started_at, rows[0].run_date)


def tracking_days(runs: DataFrame, report_dates: DataFrame) -> DataFrame:
    """For each report date (text): 1 + the report dates after the first successful run up to it.

    Dates are distinct before they are counted, so the window holds one row per day.
    """
    first = ok_runs(runs).agg(F.min("run_date").alias("first_date")).scalar()
    days = report_dates.select("report_date").distinct().withColumn("first_date", first)
    counted = days.where(date_in_range(F.col("report_date"), F.col("first_date"), F.to_date(F.lit("9999-12-31"))))
    upto = Window.partitionBy("first_date").orderBy("report_date")
    later = counted.withColumn("n", F.row_number().over(upto)).select("report_date", "n")
    return days.join(later, "report_date", "left").select(
        "report_date", (F.lit(1) + F.coalesce("n", F.lit(0))).alias("tracking_days")
    )


def known_dates(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Dates with a successful run or with observations."""
    return ok_runs(runs).select("run_date").unionByName(observations.select("run_date").distinct()).distinct()


def latest_run(runs: DataFrame) -> DataFrame:
    """run_id of the last run that started, whatever came of it."""
    return runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
