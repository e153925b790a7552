"""Flagship query: value watchlist over the presence intervals at the last successful run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from checks.fixtures import Tables
from sightline.operators import reports as R
from sightline.operators import snapshots as S
from sightline.operators.runs import target_run

WATCH = ["listing_id", "estate_name", "layout", "rent_hkd", "price_per_sqft", "active_source_count", "psf_vs_layout_avg_pct", "local_age_days", "action_note"]


def value_watchlist(t: Tables) -> DataFrame:
    at = target_run(t.runs).started_at
    current = S.snapshots(t.obs, t.listings, t.intervals, [at])
    return R.value_watchlist(current, at, R.rent_percentile(R.known_rents(t.listings))).select(*WATCH)
