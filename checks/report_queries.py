"""Sections F, G and I over snapshots and the current state, and the report columns of C and E."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import EARLY_DATE, LAYOUTS, Tables
from checks.flagship import WATCH
from checks.oracle import CTES, label
from checks.registry import at_date, register
from sightline.operators import current as C
from sightline.operators import reports as R
from sightline.operators.filters import in_range
from sightline.operators.runs import target_run, tracking_days
from sightline.plans import daily_report as D


class Report:
    """Snapshots of the last run (of a date), the day and the week before, and new listings of the last 29 days."""

    def __init__(self, t: Tables, day: date | None = None):
        refs = D.periods(t.runs, day)
        at = refs["current"].started_at
        self.t, self.at = t, F.lit(at)
        self.start = F.lit(at - timedelta(days=29))
        self.snap = t.stored(f"period-snapshots-{day or 'last'}", lambda: D.period_snapshots(t.obs, t.listings, t.state, refs))
        self.cur, self.prev, self.week = (self.snap.where(F.col("period") == p) for p in ("current", "day", "week"))
        self.day = refs["current"].local_date

    @property
    def new(self) -> DataFrame:
        return R.first_seen_between(self.t.listings, self.t.state, self.start, self.at)

    @property
    def removed(self) -> DataFrame:
        return R.removed_listings(self.cur, self.prev)

    @property
    def reference(self) -> DataFrame:
        return R.known_rents(self.t.listings)

    @property
    def low(self) -> DataFrame:
        return R.rent_percentile(self.reference)

    @property
    def gone(self) -> DataFrame:
        return R.withdrawn(self.t.state, self.t.listings, self.at)


def report(name: str, build, oracle: str) -> None:
    register(name, lambda t: build(Report(t)), oracle)


def early_report(name: str, build, oracle: str) -> None:
    """A report on a date at which listings have gone since the day before."""
    register(name, lambda t: build(Report(t, EARLY_DATE)), at_date(oracle, EARLY_DATE))


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_STATS = """count(*) AS count, round(avg(rent_hkd), 6) AS avg_rent, median(rent_hkd) AS median_rent, min(rent_hkd) AS min_rent, round(avg(price_per_sqft), 6) AS avg_psf,
    round(median(price_per_sqft), 6) AS median_psf, round(avg(usable_area_sqft), 6) AS avg_area"""
_RAW = "count(*) AS count, avg(rent_hkd) AS avg_rent, avg(price_per_sqft) AS avg_psf"
for _name, _src in (("lc", "cur"), ("lp", "prv"), ("lw", "wk")):
    CTES[_name] = f"SELECT {label('layout')} AS layout, {_RAW} FROM {_src} GROUP BY 1"
_AGE = "greatest(0.0, epoch(tgt.c - first_seen_at) / 86400.0)"
_PCT = "(price_per_sqft - avg_psf) / avg_psf * 100"


def _note(pct: str, age: str, fresh: bool = False) -> str:
    return f"""coalesce(nullif(concat_ws('、', {"'新增'" if fresh else 'NULL'}, CASE WHEN {pct} <= -5 THEN '尺租低同户型均值 ' || printf('%.0f', abs({pct})) || '%' END,
        CASE WHEN rent_hkd <= (SELECT low FROM low) THEN '预算友好' END, CASE WHEN active_source_count >= 2 THEN '跨来源确认' END, CASE WHEN {age} <= 1 THEN '刚出现' END), ''), '-')"""


CTES["disc"] = f"SELECT s.*, a.avg_psf, {_PCT} AS pct, {_AGE} AS age FROM cur s LEFT JOIN lc a ON a.layout = {label('s.layout')}, tgt"
CTES["nlm"] = f"SELECT s.*, a.avg_psf, {_PCT} AS pct, {_AGE} AS age FROM newl s LEFT JOIN lc a ON a.layout = {label('s.layout')}, tgt"
_PRICE = "coalesce(nullif(price_per_sqft, 0), 9999), coalesce(nullif(rent_hkd, 0), 999999), listing_id"
_WATCH = """SELECT listing_id, estate_name, layout, rent_hkd, round(price_per_sqft, 6) AS price_per_sqft, active_source_count, round(pct, 6) AS psf_vs_layout_avg_pct,
    round(age, 6) AS local_age_days, {note} AS action_note FROM {src} {where} ORDER BY {order} LIMIT 25"""

# C9, E15
report("c9_discount_to_layout_average", lambda r: R.with_discount(r.cur, r.cur).select("listing_id", "psf_vs_layout_avg_pct"), "SELECT listing_id, round(pct, 6) AS psf_vs_layout_avg_pct FROM disc")
report("e15_rent_band_membership", lambda r: r.cur.select("listing_id", R.in_rent_band(F.col("rent_hkd"), 9000, 12000).alias("both"), R.in_rent_band(F.col("rent_hkd"), None, 12000).alias("upper")),
       "SELECT listing_id, coalesce(rent_hkd BETWEEN 9000 AND 12000, false) AS both, coalesce(rent_hkd <= 12000, false) AS upper FROM cur")
report("e15_rows_per_band", lambda r: R.with_band(r.cur, r.reference).groupBy("band").agg(F.count("*").alias("n")),
       "SELECT i.band, count(*) AS n FROM cur LEFT JOIN bands i ON rent_hkd >= coalesce(i.rent_lower, 0) AND rent_hkd <= coalesce(i.rent_upper, 999999999) GROUP BY i.band")

# F: joins
register("f6_changes_with_listing", lambda t: C.changes_with_listing(t.obs, t.listings).select("obs_id", "canonical_id", "source_key", "rent_hkd"),
         "SELECT o.obs_id, l.canonical_id, o.source_key, o.rent_hkd FROM obs o JOIN listings l USING (listing_id)")
register("f7_listings_with_site_counts", lambda t: C.with_site_counts(t.listings, t.state).select("listing_id", "distinct_sites"),
         "SELECT l.listing_id, coalesce(n, 0) AS distinct_sites FROM listings l LEFT JOIN (SELECT listing_id, count(DISTINCT source_site) AS n FROM state WHERE active GROUP BY 1) USING (listing_id)")
_GONE = ["source_key", "first_missing_at", "listing_id", "canonical_id", "estate_name", "layout", "rent_hkd", "price_per_sqft", "active"]
_GONE_SQL = "source_key, CAST(first_missing_at AS VARCHAR) AS first_missing_at, listing_id, canonical_id, estate_name, layout, rent_hkd, round(price_per_sqft, 6) AS price_per_sqft, active"
report("f8_missing_with_listing", lambda r: R.missing_rows(r.t.state, r.t.listings, r.start, r.at).select(*_GONE),
       f"SELECT {_GONE_SQL} FROM gone, tgt WHERE first_missing_at >= tgt.c - INTERVAL 29 DAY AND first_missing_at <= tgt.c")
register("f9_period_snapshots", lambda t: D.period_snapshots(t.obs, t.listings, t.state, D.periods(t.runs)).select("period", "listing_id", "rent_hkd", "layout", "active_source_count", "sample_source_site"),
       "SELECT period, listing_id, rent_hkd, layout, active_source_count, sample_source_site FROM snap")
_NEW = ["listing_id", "rent_hkd", "price_per_sqft", "active_source_count", "sample_source_site", "sample_source_url"]
report("f10_new_with_sources", lambda r: r.new.select(*_NEW), "SELECT listing_id, rent_hkd, round(price_per_sqft, 6) AS price_per_sqft, active_source_count, sample_source_site, sample_source_url FROM newl")
CTES["chg"] = f"""SELECT c.*, p.rent_hkd AS previous_rent_hkd, c.rent_hkd - p.rent_hkd AS delta, {_AGE.replace('first_seen_at', 'c.first_seen_at')} AS age
    FROM cur c JOIN prv p ON p.listing_id = c.listing_id, tgt WHERE c.rent_hkd <> p.rent_hkd"""
_CHG = ["listing_id", "previous_rent_hkd", "rent_hkd", "rent_delta_hkd", "rent_delta_pct", "local_age_days"]
_CHG_SQL = """listing_id, previous_rent_hkd, rent_hkd, delta AS rent_delta_hkd, round(CASE WHEN previous_rent_hkd <> 0 THEN delta / previous_rent_hkd * 100 END, 6) AS rent_delta_pct,
    round(age, 6) AS local_age_days"""
report("f11_rent_changes", lambda r: R.rent_changes(r.cur, r.prev, r.at).select(*_CHG), f"SELECT {_CHG_SQL} FROM chg")
early_report("f12_removed_listings", lambda r: r.removed.select("listing_id", "rent_hkd"), "SELECT listing_id, rent_hkd FROM remv")
report("f13_rows_with_layout_stats", lambda r: R.with_discount(r.new, r.cur).select("listing_id", "psf_vs_layout_avg_pct"), "SELECT listing_id, round(pct, 6) AS psf_vs_layout_avg_pct FROM nlm")
_G7 = f"""SELECT g.*, {", ".join(f"round(lc.{c} - {a}.{c}, 6) AS {c}_delta_{s}" for s, a in (("day", "lp"), ("week", "lw")) for c in ("count", "avg_rent", "avg_psf"))}
    FROM (SELECT {label('layout')} AS layout, {_STATS} FROM cur GROUP BY 1) g JOIN lc ON lc.layout = g.layout LEFT JOIN lp ON lp.layout = g.layout LEFT JOIN lw ON lw.layout = g.layout"""
report("f14_layout_stats_joined", lambda r: R.layout_comparison(r.cur, r.prev, r.week).select("layout", "count_delta_day", "count_delta_week"),
       "SELECT lc.layout, lc.count - lp.count AS count_delta_day, lc.count - lw.count AS count_delta_week FROM lc LEFT JOIN lp ON lp.layout = lc.layout LEFT JOIN lw ON lw.layout = lc.layout")
register("f15_source_reconciliation", lambda t: C.reconcile_sources(t.obs.join(F.broadcast(t.runs.agg(F.max("run_id").alias("run_id"))), "run_id"), t.state),
         """SELECT source_site, web_total, coalesce(db_total, 0) AS db_total, coalesce(web_total = coalesce(db_total, 0), false) AS matched
            FROM (SELECT source_site, count(DISTINCT source_key) AS web_total FROM obs WHERE run_id = (SELECT max(run_id) FROM runs) GROUP BY 1)
            FULL JOIN (SELECT source_site, count(*) AS db_total FROM state WHERE active GROUP BY 1) USING (source_site)""")
register("f16_log_at_cutoff", lambda t: _log_at(t), "SELECT o.obs_id, r.status FROM obs o JOIN runs r USING (run_id) WHERE r.started_at <= TIMESTAMP '2024-01-15'")


def _log_at(t: Tables) -> DataFrame:
    from sightline.sources.landed import with_run

    past = t.runs.where(F.col("started_at") <= F.lit("2024-01-15").cast("timestamp"))
    return with_run(t.obs, past).select("obs_id", "status")


# G: aggregations
register("g1_summary_counts", lambda t: C.summary_counts(t.listings),
         """SELECT count(*) AS total, count(*) FILTER (WHERE active) AS active, count(first_delisted_at) AS with_delist, count(*) FILTER (WHERE ever_rent_decreased) AS with_rent_decrease,
            min(last_rent_hkd) AS min_rent, round(avg(last_rent_hkd), 6) AS avg_rent, max(last_rent_hkd) AS max_rent, round(avg(last_price_per_sqft), 6) AS avg_psf FROM listings""")
register("g2_active_by_estate", lambda t: C.active_by_estate(t.listings, t.state),
         """SELECT coalesce(estate_name, '(unknown)') AS estate_name, count(*) AS count, min(last_rent_hkd) AS min_rent, round(avg(last_rent_hkd), 6) AS avg_rent,
            round(min(last_price_per_sqft), 6) AS min_psf, round(avg(last_price_per_sqft), 6) AS avg_psf, round(avg(usable_area_sqft), 6) AS avg_area,
            count(*) FILTER (WHERE n >= 2) AS cross_source_count
            FROM listings l LEFT JOIN (SELECT listing_id, count(DISTINCT source_site) AS n FROM state WHERE active GROUP BY 1) USING (listing_id)
            WHERE active GROUP BY 1 ORDER BY count DESC, min_rent NULLS FIRST, estate_name LIMIT 30""")
register("g3_active_by_source", lambda t: C.active_by_source(t.state), "SELECT source_site, count(*) AS active_count FROM state WHERE active GROUP BY 1")
register("g4_active_sites_per_listing", lambda t: C.active_sites(t.state),
         """SELECT listing_id, count(DISTINCT source_site) AS distinct_sites, min(source_site) AS sample_source_site, min(source_url) AS sample_source_url FROM state WHERE active GROUP BY 1""")
report("g5_basic_stats", lambda r: R.basic_stats(r.cur), f"SELECT {_STATS} FROM cur")
report("g6_stats_by_layout", lambda r: R.stats_by_layout(r.cur), f"SELECT {label('layout')} AS layout, {_STATS} FROM cur GROUP BY 1")
report("g7_layout_comparison", lambda r: R.layout_comparison(r.cur, r.prev, r.week), _G7)
report("g8_estate_comparison", lambda r: R.estate_comparison(r.cur, r.week),
       f"""SELECT g.*, g.count - coalesce(b.n, 0) AS count_delta_day FROM (SELECT {label('estate_name')} AS estate_name, {_STATS} FROM cur GROUP BY 1) g
           LEFT JOIN (SELECT {label('estate_name')} AS estate_name, count(*) AS n FROM wk GROUP BY 1) b USING (estate_name)
           ORDER BY abs(g.count - coalesce(b.n, 0)) DESC, count DESC, estate_name LIMIT 15""")
report("g9_rent_percentile", lambda r: R.rent_percentile(r.reference), "SELECT low AS low_rent_cutoff FROM low")


def _m(x: str) -> str:
    return "'$' || format('{:,}', " + x + ")"


_BAND_NAME = f"CASE WHEN rent_lower IS NULL THEN '<=' || {_m('rent_upper')} WHEN rent_upper IS NULL THEN '>' || {_m('rent_lower - 1')} ELSE {_m('rent_lower')} || '-' || {_m('rent_upper')} END"
report("g10_rent_bands", lambda r: R.rent_bands(r.reference), f"SELECT CAST(band AS INT) AS band, {_BAND_NAME} AS rent_band, rent_lower, rent_upper FROM bands")


def _inband(src: str) -> str:
    return f"(SELECT i.band, s.* FROM {src} s JOIN bands i ON rent_hkd >= coalesce(i.rent_lower, -1) AND rent_hkd <= coalesce(i.rent_upper, 999999999))"


def _per_band(src: str, name: str) -> str:
    return f"LEFT JOIN (SELECT band, count(*) AS {name} FROM {_inband(src)} GROUP BY 1) USING (band)"


_G11 = f"""SELECT CAST(band AS INT) AS band, {_BAND_NAME} AS rent_band, rent_lower, rent_upper, coalesce(a, 0) AS active_count, coalesce(a, 0) - coalesce(p, 0) AS active_delta_day,
           coalesce(n, 0) AS new_count, coalesce(d, 0) AS removed_count, avg_rent, avg_psf, {", ".join(f'coalesce("layout_{v}", 0) AS "layout_{v}"' for v in LAYOUTS)} FROM bands
           LEFT JOIN (SELECT band, count(*) AS a, round(avg(rent_hkd), 6) AS avg_rent, round(avg(price_per_sqft), 6) AS avg_psf,
             {", ".join(f'''count(*) FILTER (WHERE {label('layout')} = '{v}') AS "layout_{v}"''' for v in LAYOUTS)} FROM {_inband('cur')} GROUP BY 1) USING (band)
           {_per_band('prv', 'p')} {_per_band('newl', 'n')} {_per_band('remv', 'd')}"""
for _build, _name in ((report, "g11_budget_stats"), (early_report, "g11_budget_stats_early")):
    _build(_name, lambda r: R.budget_stats(r.cur, r.prev, r.new, r.removed, r.reference, LAYOUTS), _G11)
report("g12_withdrawal_lag_stats", lambda r: R.withdrawal_lag_stats(r.gone),
       """SELECT b AS lag_bucket, coalesce(n, 0) AS source_missing_count, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM wd), 6) AS share_pct, avg_rent, avg_psf
          FROM (SELECT unnest(['0-7天', '8-14天', '15-30天', '30天以上', '未知']) AS b) LEFT JOIN (SELECT bucket AS b, count(*) AS n, round(avg(rent_hkd), 6) AS avg_rent,
          round(avg(price_per_sqft), 6) AS avg_psf FROM wd GROUP BY 1) USING (b) WHERE b <> '未知' OR n > 0""")
CTES["velo"] = """SELECT d.day, (SELECT count(*) FROM listings WHERE CAST(first_seen_at AS DATE) = d.day) AS n, (SELECT count(*) FROM state WHERE CAST(first_missing_at AS DATE) = d.day) AS gonen,
    r.started_at AS at_ FROM (SELECT DISTINCT run_date AS day FROM runs, tgt WHERE run_date BETWEEN tgt.d - 22 AND tgt.d - 16) d LEFT JOIN runs r ON r.run_date = d.day AND r.status = 'ok'"""


def _velocity(t: Tables) -> DataFrame:
    """Velocity of an early week, when there are new listings, with a failed run in it."""
    return D.velocity(t.listings, t.state, t.state, t.runs, target_run(t.runs).local_date - timedelta(days=16))


register("g13_daily_velocity", _velocity,
         """SELECT CAST(day AS VARCHAR) AS date, n AS new, gonen AS source_missing, CASE WHEN at_ IS NOT NULL THEN (SELECT count(DISTINCT listing_id) FROM state WHERE first_seen_at <= at_
            AND (first_missing_at IS NULL OR first_missing_at > at_ OR (active AND last_seen_at <= at_))) END AS active FROM velo""")
register("g14_velocity_signal", lambda t: R.velocity_signal(_velocity(t)),
         """SELECT CAST(day AS VARCHAR) AS date, n AS new, round(a, 6) AS avg_new, round(CASE WHEN a <> 0 THEN (n - a) / a * 100 END, 6) AS change_pct, a = 0 AND n > 0 AS above_quiet_days
            FROM (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a FROM velo) ORDER BY day DESC LIMIT 1""")
CTES["over"] = f"""SELECT a.count, a.avg_rent, a.avg_psf, {", ".join(f"a.{c} - nullif({p}.{c}, 0) AS {c}_delta_{s}" for s, p in (("day", "b"), ("week", "w")) for c in ("count", "avg_rent", "avg_psf"))}
    FROM (SELECT {_RAW} FROM cur) a, (SELECT {_RAW} FROM prv) b, (SELECT {_RAW} FROM wk) w"""
report("g15_market_overview", lambda r: R.market_overview(r.snap),
       f"""SELECT count, {r6('avg_rent', 'avg_psf')}, count_delta_day, count_delta_week, {r6('avg_rent_delta_day', 'avg_psf_delta_day', 'avg_rent_delta_week', 'avg_psf_delta_week')} FROM over""")
_G16 = """SELECT count, (SELECT count(*) FROM newl) AS new_count, (SELECT count(*) FROM remv) AS removed_count, count_delta_day < 0 AS supply_shrinking, avg_rent_delta_day > 0 AS rents_rising,
          (SELECT count(*) FROM remv) > (SELECT count(*) FROM newl) AS removals_exceed_additions, count_delta_day IS NOT NULL AS has_baseline FROM over"""
for _build, _name in ((report, "g16_market_heat"), (early_report, "g16_market_heat_early")):
    _build(_name, lambda r: R.market_heat(R.market_overview(r.snap), r.new, r.removed), _G16)
register("g17_tracking_days", lambda t: tracking_days(t.runs, t.obs.select(F.when(F.col("obs_id") % 900 == 0, F.lit("latest")).otherwise(F.date_format("run_date", "yyyy-MM-dd")).alias("report_date"))),
         """SELECT d AS report_date, CASE WHEN d > f THEN 1 + (SELECT count(DISTINCT CAST(run_date AS VARCHAR)) FROM obs WHERE obs_id % 900 <> 0 AND CAST(run_date AS VARCHAR) > f AND CAST(run_date AS VARCHAR) <= d) ELSE 1 END AS tracking_days
            FROM (SELECT DISTINCT CAST(run_date AS VARCHAR) AS d FROM obs WHERE obs_id % 900 <> 0), (SELECT CAST(min(run_date) AS VARCHAR) AS f FROM runs WHERE status = 'ok')
            UNION ALL SELECT DISTINCT 'latest', 1 FROM obs WHERE obs_id % 900 = 0""")


def _validation(t: Tables) -> DataFrame:
    reason = F.when(~in_range(F.col("rent_hkd"), 6000, None, True), F.lit("rent"))
    events = t.events.where("missing is not null").select("source_site", F.col("missing.run_id").alias("run_id"))
    return C.site_validation(t.obs.withColumn("rejected_by", reason), t.site_runs, events)


CTES["valid"] = """SELECT s.run_id, s.source_site, coalesce(raw, 0) AS raw_observations, coalesce(kept, 0) AS filtered_observations, coalesce(gonen, 0) AS missing_sources_marked,
    coalesce(raw, 0) - coalesce(kept, 0) AS rejected_observations, s.eligible AS missing_marking_enabled FROM site_runs s
    LEFT JOIN (SELECT run_id, source_site, count(*) AS raw, count(*) FILTER (WHERE coalesce(rent_hkd >= 6000, true)) AS kept FROM obs GROUP BY 1, 2) USING (run_id, source_site)
    LEFT JOIN (SELECT missing_run AS run_id, source_site, count(*) AS gonen FROM ev WHERE missing_run IS NOT NULL GROUP BY 1, 2) USING (run_id, source_site)"""
register("g20_site_validation", _validation, "SELECT * FROM valid")
register("g20_run_totals", lambda t: C.run_totals(_validation(t)),
         "SELECT run_id, CAST(sum(filtered_observations) AS BIGINT) AS inserted_observations, CAST(sum(missing_sources_marked) AS BIGINT) AS missing_sources_marked FROM valid GROUP BY run_id")

# I: sorts and limits
register("i1_active_listings", lambda t: C.active_listings(t.listings, 50).select("listing_id", "last_rent_hkd", "last_seen_at"),
         "SELECT listing_id, last_rent_hkd, CAST(last_seen_at AS VARCHAR) AS last_seen_at FROM listings WHERE active ORDER BY last_rent_hkd NULLS FIRST, listings.last_seen_at DESC, listing_id LIMIT 50")
register("i2_all_listings", lambda t: C.all_listings(t.listings, 80).select("listing_id", "active"),
         "SELECT listing_id, active FROM listings ORDER BY active DESC, last_seen_at DESC, listing_id LIMIT 80")
register("i1_active_listings_all", lambda t: C.active_listings(t.listings).select("listing_id", "last_rent_hkd", "last_seen_at"),
         "SELECT listing_id, last_rent_hkd, CAST(last_seen_at AS VARCHAR) AS last_seen_at FROM listings WHERE active")
register("i2_all_listings_all", lambda t: C.all_listings(t.listings).select("listing_id", "active"), "SELECT listing_id, active FROM listings")
register("i3_latest_changes", lambda t: C.latest_changes(t.obs, t.listings).select("obs_id", "canonical_id", "source_site", "rent_hkd"),
         "SELECT o.obs_id, l.canonical_id, o.source_site, o.rent_hkd FROM obs o JOIN listings l USING (listing_id) ORDER BY obs_id DESC LIMIT 100")
register("i4_recently_delisted", lambda t: C.recently_delisted(t.state, t.listings).select("source_key", "first_missing_at", "estate_name", "last_rent_hkd"),
         "SELECT source_key, CAST(first_missing_at AS VARCHAR) AS first_missing_at, estate_name, rent_hkd AS last_rent_hkd FROM gone WHERE first_missing_at IS NOT NULL ORDER BY gone.first_missing_at DESC, source_key LIMIT 30")
report("i5_new_listings", lambda r: R.new_listings(r.t.listings, r.t.state, r.start, r.at).select("listing_id", "price_per_sqft"),
       "SELECT listing_id, round(price_per_sqft, 6) AS price_per_sqft FROM newl")
report("i6_source_missing", lambda r: R.source_missing(r.t.state, r.t.listings, r.start, r.at).select("source_key", "first_missing_at", "rent_hkd"),
       """SELECT source_key, CAST(first_missing_at AS VARCHAR) AS first_missing_at, rent_hkd FROM gone, tgt WHERE first_missing_at >= tgt.c - INTERVAL 29 DAY AND first_missing_at <= tgt.c""")
report("i7_rent_decreases", lambda r: R.rent_decreases(r.cur, r.prev, r.at).select(*_CHG), f"SELECT {_CHG_SQL} FROM chg WHERE delta < 0")
report("i8_value_watchlist", lambda r: R.value_watchlist(r.cur, r.at, r.low).select(*WATCH),
       _WATCH.format(note=_note("pct", "age"), src="disc", where="WHERE pct IS NOT NULL AND (pct <= -5 OR active_source_count >= 2)", order=_PRICE))
report("i9_fresh_watchlist", lambda r: R.fresh_watchlist(r.new, r.cur, r.at, r.low).select(*WATCH),
       _WATCH.format(note=_note("pct", "age", True), src="nlm", where="", order=_PRICE))
report("i10_stale_watchlist", lambda r: R.stale_watchlist(r.cur, r.at, r.low).select(*WATCH),
       _WATCH.format(note="CASE WHEN nt = '-' THEN '先确认仍可约看' ELSE nt || '、先确认仍可约看' END", src=f"(SELECT *, {_note('pct', 'age')} AS nt FROM disc)",
                     where="WHERE age >= 14 AND (pct <= -8 OR rent_hkd <= (SELECT low FROM low))", order="age DESC, coalesce(nullif(price_per_sqft, 0), 9999), listing_id"))
_WD = ["source_key", "first_missing_at", "local_age_days", "withdrawal_lag_bucket", "rent_hkd"]
_WD_SQL = "source_key, CAST(first_missing_at AS VARCHAR) AS first_missing_at, round(local_age_days, 6) AS local_age_days, bucket AS withdrawal_lag_bucket, rent_hkd"
report("i11_withdrawals", lambda r: R.withdrawals(r.t.state, r.t.listings, r.at).select(*_WD), f"SELECT {_WD_SQL} FROM wd")
report("i11_withdrawals_newest", lambda r: R.withdrawals(r.t.state, r.t.listings, r.at, sample_limit=100).select(*_WD),
       f"SELECT {_WD_SQL} FROM wd ORDER BY wd.first_missing_at DESC, price_per_sqft NULLS FIRST, source_key LIMIT 100")
report("i12_rent_distribution", lambda r: R.rent_distribution(r.t.listings), """SELECT listing_id, layout, last_rent_hkd AS rent_hkd, usable_area_sqft, round(last_price_per_sqft, 6) AS price_per_sqft
    FROM listings WHERE last_rent_hkd IS NOT NULL""")
