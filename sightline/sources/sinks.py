"""Writers of the observation log, run snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from sightline import constants as K


def append_log(observations: DataFrame, path: str) -> None:
    """Append to the log; rebalancing keeps files large and splits the partition of a hot source over tasks."""
    rows = observations.hint("rebalance", "run_date", "source_site")
    rows.write.mode("append").partitionBy("run_date", "source_site").parquet(path)


def write_run_snapshot(validation: DataFrame, marked: DataFrame, path: str) -> None:
    """Run snapshot as JSON lines: validation rows, and observation rows by run and source.

    A source is not folded into one nested document, as it may hold any share of a run.
    """
    validation.write.mode("overwrite").json(f"{path}/validation")
    marked.write.mode("overwrite").partitionBy("run_id", "source_site").json(f"{path}/observations")


def export(df: DataFrame, columns: list[str]) -> DataFrame:
    """Export columns in order, missing ones as null; maps as JSON text, booleans as 0 and 1."""
    out = []
    for name in columns:
        source = "source_summary" if name == "source_summary_json" else name
        if source not in df.columns:
            out.append(F.lit(None).cast("string").alias(name))
        elif isinstance(df.schema[source].dataType, MapType):
            out.append(F.to_json(source).alias(name))
        elif df.schema[source].dataType.typeName() == "boolean":
            out.append(F.col(source).cast("int").alias(name))
        else:
            out.append(F.col(source).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    export(df, columns).write.mode("overwrite").option("header", True).csv(path)


REPORT_COLUMNS = {
    "new_listings": K.REPORT_LISTING_EXPORT,
    "removed_listings": K.REPORT_LISTING_EXPORT,
    "source_disappeared": K.MISSING_EXPORT,
    "rent_changes": K.CHANGE_EXPORT,
    "rent_decreases": K.CHANGE_EXPORT,
    "watchlist": K.REPORT_LISTING_EXPORT,
    "fresh_value_watchlist": K.REPORT_LISTING_EXPORT,
    "budget_stats": K.BUDGET_EXPORT,
    "withdrawal_lag_stats": K.LAG_EXPORT,
    "stale_value_watchlist": K.REPORT_LISTING_EXPORT,
}


def write_report(tables: dict[str, DataFrame], report_date: str, path: str) -> dict[str, str]:
    """The CSV datasets of a daily report, each under its name and date."""
    paths = {}
    for name, columns in REPORT_COLUMNS.items():
        df = tables[name]
        extra = sorted(c for c in df.columns if c.startswith("layout_")) if name == "budget_stats" else []
        paths[name] = f"{path}/{name}/report_date={report_date}"
        write_csv(df, columns + extra, paths[name])
    return paths
