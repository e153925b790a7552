"""Report tables over snapshots: comparisons, price bands, watchlists and withdrawals.

Snapshots have one row per active listing (see ``snapshots``). Layout averages are
written once and looked up by ``session.lookup_join``, as a layout may hold any
share of the listings. Other group tables are joined without a hint: adaptive
execution broadcasts them once their real size is known to be small.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import numeric as N
from sightline.functions.text import blank_to_null, compact_money
from sightline.session import cut, lookup_join

STATS = ["count", "avg_rent", "median_rent", "min_rent", "avg_psf", "median_psf", "avg_area"]


def label(name: str, missing: str = K.UNLABELLED) -> Column:
    return F.coalesce(blank_to_null(F.col(name)), F.lit(missing))


def stats_columns(approximate: bool = False) -> list[Column]:
    """Basic statistics. The exact median keeps one counter per distinct value of a group;
    ``approximate`` bounds that for groups with very many distinct values."""
    median = F.percentile_approx if approximate else F.percentile
    return [
        F.count("*").alias("count"),
        F.avg("rent_hkd").alias("avg_rent"),
        median("rent_hkd", 0.5).cast("double").alias("median_rent"),
        F.min("rent_hkd").alias("min_rent"),
        F.avg("price_per_sqft").alias("avg_psf"),
        median("price_per_sqft", 0.5).alias("median_psf"),
        F.avg("usable_area_sqft").alias("avg_area"),
    ]


def basic_stats(rows: DataFrame, approximate: bool = False) -> DataFrame:
    return rows.agg(*stats_columns(approximate))


def stats_by_layout(rows: DataFrame, approximate: bool = False) -> DataFrame:
    return rows.groupBy(label("layout").alias("layout")).agg(*stats_columns(approximate))


def _prefixed(df: DataFrame, key: str, cols: list[str], suffix: str) -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{c}_{suffix}") for c in cols])


def layout_comparison(current: DataFrame, previous: DataFrame, week: DataFrame) -> DataFrame:
    """Layout statistics with differences to the day and the week before; null where there is no such layout."""
    cols = ["count", "avg_rent", "avg_psf"]
    out = stats_by_layout(current)
    for df, suffix in ((previous, "day"), (week, "week")):
        out = out.join(_prefixed(stats_by_layout(df), "layout", cols, suffix), "layout", "left")
    deltas = [N.delta(F.col(c), F.col(f"{c}_{s}")).alias(f"{c}_delta_{s}") for s in ("day", "week") for c in cols]
    return out.select("layout", *STATS, *deltas).orderBy(F.desc("count"), "layout")


def estate_comparison(current: DataFrame, previous: DataFrame, limit: int = K.ESTATE_ROWS) -> DataFrame:
    """Estates with the largest change in active listings; an estate new today counts from 0."""
    name = label("estate_name").alias("estate_name")
    before = previous.groupBy(name).agg(F.count("*").alias("_before"))
    rows = current.groupBy(name).agg(*stats_columns()).join(before, "estate_name", "left")
    change = F.col("count") - F.coalesce("_before", F.lit(0))
    out = rows.withColumn("count_delta_day", change).drop("_before")
    return out.orderBy(F.desc(F.abs("count_delta_day")), F.desc("count"), "estate_name").limit(limit)


def market_overview(labelled: DataFrame) -> DataFrame:
    """Current statistics with day and week differences, from snapshots labelled current, day and week in ``period``.

    Differences are null where a period has no rows.
    """
    stats = labelled.groupBy("period").agg(F.count("*").alias("count"), F.avg("rent_hkd").alias("avg_rent"), F.avg("price_per_sqft").alias("avg_psf"))

    def of(period: str, c: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(c)))

    cols = ["count", "avg_rent", "avg_psf"]
    wide = stats.agg(*[of(p, c).alias(f"{c}_{p}") for p in ("current", "day", "week") for c in cols])
    now = [F.coalesce("count_current", F.lit(0)).alias("count"), F.col("avg_rent_current").alias("avg_rent"), F.col("avg_psf_current").alias("avg_psf")]
    wide = wide.select(*now, *[f"{c}_{p}" for p in ("day", "week") for c in cols])
    return wide.select(*cols, *[N.delta(F.col(c), F.col(f"{c}_{p}")).alias(f"{c}_delta_{p}") for p in ("day", "week") for c in cols])


def market_heat(overview: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """Heat flags of one overview row and the counts behind them."""
    flags = overview.withColumns(
        {
            "new_count": new.agg(F.count("*")).scalar(),
            "removed_count": removed.agg(F.count("*")).scalar(),
        }
    )
    return flags.select(
        "count", "new_count", "removed_count",
        F.coalesce(F.col("count_delta_day") < 0, F.lit(False)).alias("supply_shrinking"),
        F.coalesce(F.col("avg_rent_delta_day") > 0, F.lit(False)).alias("rents_rising"),
        (F.col("removed_count") > F.col("new_count")).alias("removals_exceed_additions"),
        F.col("count_delta_day").isNotNull().alias("has_baseline"),
    )


def changed_rents(current: DataFrame, previous: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Listings whose rent differs from the previous snapshot."""
    end = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    before = previous.select("listing_id", F.col("rent_hkd").alias("previous_rent_hkd"))
    delta = F.col("rent_hkd") - F.col("previous_rent_hkd")
    joined = current.join(before, "listing_id").where(F.col("rent_hkd") != F.col("previous_rent_hkd"))
    return joined.withColumns(
        {
            "rent_delta_hkd": delta,
            "rent_delta_pct": F.try_divide(delta, F.col("previous_rent_hkd")) * 100,
            "local_age_days": N.age_days(F.col("first_seen_at"), end),
        }
    )


def rent_changes(current: DataFrame, previous: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Changed rents, largest change first."""
    return changed_rents(current, previous, cutoff).orderBy(F.desc(F.abs("rent_delta_hkd")), "listing_id")


def rent_decreases(current: DataFrame, previous: DataFrame, cutoff: datetime | Column) -> DataFrame:
    """Lowered rents, largest decrease first."""
    return rent_changes(current, previous, cutoff).where("rent_delta_hkd < 0")


def removed_listings(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("listing_id"), "listing_id", "left_anti")


def with_age(rows: DataFrame, cutoff: datetime | Column) -> DataFrame:
    end = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return rows.withColumn("local_age_days", N.age_days(F.col("first_seen_at"), end))


def known_rents(listings: DataFrame) -> DataFrame:
    """Listings with a current rent."""
    return listings.where("last_rent_hkd is not null").select(
        "listing_id", "layout", F.col("last_rent_hkd").alias("rent_hkd"), "usable_area_sqft",
        F.col("last_price_per_sqft").alias("price_per_sqft"),
    )


def rent_reference(listings: DataFrame, current: DataFrame) -> DataFrame:
    """Rents that bands and cutoffs refer to: those of all listings, or of the current rows where no listing has one."""
    known = known_rents(listings)
    none = F.lit(True) & (known.agg(F.count("*")).scalar() == 0)
    return known.unionByName(current.where(none & F.col("rent_hkd").isNotNull()).select(*known.columns))


def rent_distribution(listings: DataFrame) -> DataFrame:
    """Non-null current rents of all listings, ascending."""
    return known_rents(listings).orderBy("rent_hkd", "listing_id")


def rent_percentile(rows: DataFrame, p: float = K.LOW_RENT_PERCENTILE) -> DataFrame:
    """Nearest-rank percentile of the non-null rents, one row."""
    return rows.agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY rent_hkd)").cast("int").alias("low_rent_cutoff"))


def rent_thresholds(rows: DataFrame, target: int = K.BAND_TARGET) -> DataFrame:
    """One row: lowest and highest rent and the ascending upper bounds of the bands between them.

    Bounds are the nearest-rank quantiles rounded up to a nice step, strictly
    increasing; if none fits, the rounded midpoint.
    """
    ranks = F.array(*[F.expr(f"percentile_disc({i / target}) WITHIN GROUP (ORDER BY rent_hkd)") for i in range(1, target)])
    known = rows.where("rent_hkd is not null").agg(
        F.min("rent_hkd").alias("low"), F.max("rent_hkd").alias("high"), ranks.alias("ranks")
    )
    low, high, step = F.col("low"), F.col("high"), F.col("step")

    def up(x: Column) -> Column:
        return (F.ceil(x / step) * step).cast("int")

    out = known.where("low is not null").withColumn("step", N.nice_step((high - low) / F.lit(float(target))))
    fits = F.array_sort(F.array_distinct(F.filter(F.transform("ranks", up), lambda t: (t >= low) & (t < high))))
    middle = up((low + high) / F.lit(2.0))
    out = out.withColumns({"fits": fits, "middle": F.when((middle >= low) & (middle < high), F.array(middle))})
    none = F.array().cast("array<int>")
    bounds = F.when(low == high, none).when(F.size("fits") > 0, F.col("fits")).otherwise(F.coalesce("middle", none))
    return out.select("low", "high", bounds.alias("bounds"))


def rent_bands(rows: DataFrame, target: int = K.BAND_TARGET) -> DataFrame:
    """Rent bands of the distribution of ``rows``: band number, label, inclusive bounds (null if open)."""
    t = rent_thresholds(rows, target)
    n = F.size("bounds")
    below = F.get("bounds", F.col("band") - 1)
    lower = F.when(n == 0, F.col("low")).otherwise(below + 1)
    upper = F.when(n == 0, F.col("high")).otherwise(F.get("bounds", F.col("band")))
    bands = t.withColumn("band", F.explode(F.sequence(F.lit(0), n))).select(
        "band", lower.alias("rent_lower"), upper.alias("rent_upper"), (F.col("low") == F.col("high")).alias("one")
    )
    lo, hi = F.col("rent_lower"), F.col("rent_upper")
    name = (
        F.when(F.col("one"), compact_money(lo))
        .when(lo.isNull(), F.concat(F.lit("<="), compact_money(hi)))
        .when(hi.isNull(), F.concat(F.lit(">"), compact_money(lo - 1)))
        .otherwise(F.concat(compact_money(lo), F.lit("-"), compact_money(hi)))
    )
    return bands.select("band", name.alias("rent_band"), "rent_lower", "rent_upper")


def in_rent_band(rent: Column, lower: int | Column | None, upper: int | Column | None) -> Column:
    """Inclusive membership with open ends; a missing rent belongs to none."""
    lo = F.lit(lower).cast("int") if not isinstance(lower, Column) else lower
    hi = F.lit(upper).cast("int") if not isinstance(upper, Column) else upper
    return rent.isNotNull() & (lo.isNull() | (rent >= lo)) & (hi.isNull() | (rent <= hi))


def with_band(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``band`` by counting the bounds below the rent; rows outside every band get none.

    The bounds are one value of at most ``BAND_TARGET`` numbers, read as a scalar subquery.
    """
    t = rent_thresholds(reference).select(F.struct("low", "high", "bounds").alias("t")).scalar()
    out = rows.withColumn("_t", t)
    one = F.size("_t.bounds") == 0
    inside = F.when(one, (F.col("rent_hkd") >= F.col("_t.low")) & (F.col("rent_hkd") <= F.col("_t.high"))).otherwise(F.lit(True))
    index = F.size(F.filter("_t.bounds", lambda b: b < F.col("rent_hkd")))
    return out.withColumn("band", F.when(F.col("rent_hkd").isNotNull() & inside, index)).drop("_t")


def budget_stats(
    current: DataFrame, previous: DataFrame | None, new: DataFrame, removed: DataFrame, reference: DataFrame,
    layouts: list[str],
) -> DataFrame:
    """Per rent band: active, change, new and removed listings, averages, and a column per layout.

    The column list is an argument, so no extra job looks for layouts.
    """
    parts = {"now": current, "before": previous, "new": new, "removed": removed}
    rows = [
        df.select(F.lit(part).alias("_part"), "rent_hkd", "price_per_sqft", label("layout").alias("_layout"))
        for part, df in parts.items() if df is not None
    ]
    banded = with_band(reduce(DataFrame.unionByName, rows), reference).where("band is not null")
    of = {part: F.col("_part") == part for part in parts}
    by_band = banded.groupBy("band").agg(
        F.count_if(of["now"]).alias("active_count"),
        F.avg(F.when(of["now"], F.col("rent_hkd"))).alias("avg_rent"),
        F.avg(F.when(of["now"], F.col("price_per_sqft"))).alias("avg_psf"),
        *[F.count_if(of["now"] & (F.col("_layout") == v)).alias(f"layout_{v}") for v in layouts],
        F.count_if(of["new"]).alias("new_count"),
        F.count_if(of["removed"]).alias("removed_count"),
        F.count_if(of["before"]).alias("_before"),
    )
    out = rent_bands(reference).join(by_band, "band", "left")
    zero = ["active_count", "new_count", "removed_count", *[f"layout_{v}" for v in layouts]]
    if previous is None:
        change = F.lit(None).cast("bigint")
    else:
        any_before = F.lit(True) & (previous.agg(F.count("*")).scalar() > 0)
        change = F.when(any_before, F.coalesce("active_count", F.lit(0)) - F.coalesce("_before", F.lit(0)))
    out = out.withColumn("active_delta_day", change).drop("_before")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    cols = [c for c in K.BUDGET_EXPORT if c in out.columns]
    return out.select("band", *cols, *[f"layout_{v}" for v in layouts]).orderBy("band")


def first_seen_between(listings: DataFrame, state: DataFrame, start: Column, cutoff: Column) -> DataFrame:
    """Listings first seen in [start, cutoff] with a sample of their active sources."""
    fresh = listings.where((F.col("first_seen_at") >= start) & (F.col("first_seen_at") <= cutoff))
    active = state.where("active").groupBy("listing_id").agg(
        F.min("source_site").alias("sample_source_site"), F.min("source_url").alias("sample_source_url")
    )
    return fresh.join(active, "listing_id", "left").withColumnsRenamed(
        {"last_rent_hkd": "rent_hkd", "last_price_per_sqft": "price_per_sqft", "sources_count": "active_source_count"}
    )


def new_listings(listings: DataFrame, state: DataFrame, start: Column, cutoff: Column) -> DataFrame:
    """New listings, cheapest per area first."""
    rows = first_seen_between(listings, state, start, cutoff)
    return rows.orderBy(F.asc_nulls_last("price_per_sqft"), F.asc_nulls_first("rent_hkd"), F.desc("first_seen_at"), "listing_id")


_MISSING = ["first_seen_at", "canonical_id", "ever_rent_decreased", "first_rent_decrease_at", "last_rent_decrease_at",
            "max_seen_rent_hkd", "min_seen_rent_hkd", "estate_name", "block", "floor", "flat", "layout",
            "usable_area_sqft", "active"]


def missing_rows(state: DataFrame, listings: DataFrame, start: Column, cutoff: Column) -> DataFrame:
    """Source records first missing in [start, cutoff], with their listing."""
    gone = state.where((F.col("first_missing_at") >= start) & (F.col("first_missing_at") <= cutoff)).select(
        "source_key", "listing_id", "source_site", "source_listing_id", "source_url", "first_missing_at"
    )
    rows = listings.select(
        "listing_id", *[c for c in _MISSING if c in listings.columns],
        F.col("last_rent_hkd").alias("rent_hkd"), F.col("last_price_per_sqft").alias("price_per_sqft"),
    )
    return gone.join(rows, "listing_id")


def source_missing(state: DataFrame, listings: DataFrame, start: Column, cutoff: Column) -> DataFrame:
    return missing_rows(state, listings, start, cutoff).orderBy(
        F.desc("first_missing_at"), F.asc_nulls_first("rent_hkd"), "source_key"
    )


def withdrawn(state: DataFrame, listings: DataFrame, cutoff: Column, days: int = K.WITHDRAWAL_DAYS) -> DataFrame:
    """Source records that went missing in the days before ``cutoff``, with age and age bucket."""
    rows = missing_rows(state, listings, cutoff - F.make_dt_interval(F.lit(days)), cutoff)
    age = N.age_days(F.col("first_seen_at"), F.col("first_missing_at"))
    return rows.withColumn("local_age_days", age).withColumn("withdrawal_lag_bucket", N.lag_bucket(F.col("local_age_days")))


def withdrawals(
    state: DataFrame, listings: DataFrame, cutoff: Column, days: int = K.WITHDRAWAL_DAYS, sample_limit: int | None = None
) -> DataFrame:
    """Withdrawn records, newest first. All events by default; ``sample_limit`` keeps the newest ones only."""
    rows = withdrawn(state, listings, cutoff, days).orderBy(F.desc("first_missing_at"), F.asc_nulls_first("price_per_sqft"), "source_key")
    return rows.limit(sample_limit) if sample_limit is not None else rows


def withdrawal_lag_stats(events: DataFrame) -> DataFrame:
    """Count, share and averages per age bucket in fixed order; the bucket of unknown ages only if it has rows."""
    spark = events.sparkSession
    order = F.array(*[F.lit(b) for b in K.LAG_BUCKETS])
    dims = spark.range(1).select(F.posexplode(order).alias("pos", "lag_bucket"))
    by = events.groupBy(F.col("withdrawal_lag_bucket").alias("lag_bucket")).agg(
        F.count("*").alias("n"), F.avg("rent_hkd").alias("avg_rent"), F.avg("price_per_sqft").alias("avg_psf")
    )
    out = dims.join(by, "lag_bucket", "left").withColumn("source_missing_count", F.coalesce("n", F.lit(0)))
    total = F.sum("source_missing_count").over(Window.partitionBy(F.lit(1)))
    out = out.withColumn("share_pct", F.try_divide(F.col("source_missing_count"), total) * 100)
    kept = out.where((F.col("source_missing_count") > 0) | (F.col("lag_bucket") != K.LAG_BUCKETS[-1]))
    return kept.orderBy("pos").select("lag_bucket", "source_missing_count", "share_pct", "avg_rent", "avg_psf")


def with_discount(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds the price per area against the average of the same layout in ``baseline``, in percent."""
    avg = baseline.groupBy(label("layout").alias("_layout")).agg(F.avg("price_per_sqft").alias("_avg_psf"))
    joined = lookup_join(rows.withColumn("_layout", label("layout")), cut(avg, "layout-averages"), ["_layout"], "left", salt="listing_id")
    return joined.withColumn("psf_vs_layout_avg_pct", N.discount_pct(F.col("price_per_sqft"), F.col("_avg_psf"))).drop("_layout", "_avg_psf")


def _low_rent(low_rent: int | Column | DataFrame | None) -> Column:
    if isinstance(low_rent, DataFrame):
        return low_rent.scalar()
    return low_rent if isinstance(low_rent, Column) else F.lit(low_rent).cast("int")


def _noted(rows: DataFrame, cutoff: datetime | Column, low_rent, fresh: bool = False) -> DataFrame:
    note = N.action_note(
        F.col("psf_vs_layout_avg_pct"), F.col("rent_hkd"), F.col("active_source_count"), F.col("local_age_days"),
        F.col("_low"), fresh,
    )
    return with_age(rows, cutoff).withColumn("_low", _low_rent(low_rent)).withColumn("action_note", note)


def _by_price() -> list[Column]:
    return [
        F.coalesce(F.when(F.col("price_per_sqft") != 0, F.col("price_per_sqft")), F.lit(9999.0)),
        F.coalesce(F.when(F.col("rent_hkd") != 0, F.col("rent_hkd")), F.lit(999999)),
        F.col("listing_id"),
    ]


def value_watchlist(current: DataFrame, cutoff, low_rent, limit: int = K.WATCHLIST_ROWS) -> DataFrame:
    """Cheapest active listings well below their layout's average or seen on two sites at least."""
    rows = with_discount(current, current).where("psf_vs_layout_avg_pct is not null")
    picked = rows.where((F.col("psf_vs_layout_avg_pct") <= K.VALUE_DISCOUNT_PCT) | (F.col("active_source_count") >= 2))
    return _noted(picked, cutoff, low_rent).drop("_low").orderBy(*_by_price()).limit(limit)


def fresh_watchlist(new: DataFrame, current: DataFrame, cutoff, low_rent, limit: int = K.WATCHLIST_ROWS) -> DataFrame:
    """Cheapest new listings, compared with the layouts active now."""
    rows = _noted(with_discount(new, current), cutoff, low_rent, fresh=True)
    return rows.drop("_low").orderBy(*_by_price()).limit(limit)


def stale_watchlist(
    current: DataFrame, cutoff, low_rent, min_age: int = K.STALE_MIN_AGE_DAYS, limit: int = K.WATCHLIST_ROWS
) -> DataFrame:
    """Oldest listings that are still cheap: well below their layout's average or of low rent."""
    rows = _noted(with_discount(current, current), cutoff, low_rent).where(F.col("local_age_days") >= min_age)
    cheap = (F.col("psf_vs_layout_avg_pct") <= K.STALE_DISCOUNT_PCT) | (F.col("rent_hkd") <= F.col("_low"))
    note = F.when(F.col("action_note") == "-", F.lit(K.NOTE_CONFIRM)).otherwise(
        F.concat("action_note", F.lit(K.NOTE_JOIN + K.NOTE_CONFIRM))
    )
    return (
        rows.where(cheap).withColumn("action_note", note).drop("_low")
        .orderBy(F.desc("local_age_days"), _by_price()[0], "listing_id").limit(limit)
    )


def daily_velocity(listings: DataFrame, state: DataFrame, counts: DataFrame, target: date, days: int = 7) -> DataFrame:
    """New listings, records gone missing and active listings for each of the last days.

    ``counts`` (run_date, active_count) comes from the last successful run of a day; days without one have null.
    """
    spark = listings.sparkSession
    first = target - timedelta(days=days - 1)
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(target))).alias("date"))

    def per_day(df: DataFrame, col: str, name: str) -> DataFrame:
        day = F.to_date(col)
        return df.where(day.between(first, target)).groupBy(day.alias("date")).agg(F.count("*").alias(name))

    out = dates.join(per_day(listings, "first_seen_at", "new"), "date", "left")
    out = out.join(per_day(state, "first_missing_at", "source_missing"), "date", "left")
    out = out.join(counts.select(F.col("run_date").alias("date"), F.col("active_count").alias("active")), "date", "left")
    return out.select("date", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("source_missing", F.lit(0)).alias("source_missing"), "active").orderBy("date")


def velocity_signal(velocity: DataFrame) -> DataFrame:
    """New listings of the last day against the mean of the days before."""
    before = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-6, -1)
    rows = velocity.withColumn("avg_new", F.avg("new").over(before)).orderBy(F.desc("date")).limit(1)
    pct = F.when(F.col("avg_new") != 0, (F.col("new") - F.col("avg_new")) / F.col("avg_new") * 100)
    above = (F.col("avg_new") == 0) & (F.col("new") > 0)
    return rows.select("date", "new", "avg_new", pct.alias("change_pct"), F.coalesce(above, F.lit(False)).alias("above_quiet_days"))
