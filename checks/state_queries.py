"""Sections H, K and the state parts of A, F, G and J: lifecycle, history and entity matching."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import EARLY_DATE, LAYOUTS, Tables
from checks.oracle import CTES, STRICT, identity, sha
from checks.registry import at_date, register
from sightline.functions import keys
from sightline.functions import numeric as N
from sightline.operators import history as H
from sightline.operators import lifecycle as L
from sightline.operators import matching as M
from sightline.operators import runs as R
from sightline.operators import snapshots as S
from sightline.operators.extraction import observation_identity
from sightline.plans import daily_report as D
from sightline.session import shuffled

PRICE = ["listing_id", "rent_hkd", "usable_area_sqft", "price_per_sqft", "layout", "estate_name"]


def cutoff(t: Tables):
    return F.lit(R.target_run(t.runs).started_at)


# H: windows
register("h1_latest_observation", lambda t: S.latest_observation(t.obs, cutoff(t)).select("obs_id", *PRICE),
         "SELECT obs_id, listing_id, rent_hkd, usable_area_sqft, round(price_per_sqft, 6) AS price_per_sqft, layout, estate_name FROM lobs WHERE period = 'current'")
register("h2_previous_rent", lambda t: H.previous_rent(t.obs).select("obs_id", "listing_id", "rent_hkd", "prev_rent"),
         "SELECT obs_id, listing_id, rent_hkd, prev_rent FROM prevr")
register("h3_best_candidate", lambda t: _candidates(t).select("obs_id", "candidate_id"),
         f"""SELECT a.id AS obs_id, arg_min(b.id, (b.id % 2) * 100000000000 + (b.id % 5) * 10000000000 + b.id) FILTER (WHERE b.id IS NOT NULL) AS candidate_id
             FROM nu a LEFT JOIN nu b ON {STRICT} GROUP BY a.id""")
register("h4_first_descriptive_value", lambda t: H.descriptive_fields(t.obs).drop("building", "address"),
         "SELECT listing_id, title, estate_name, block, floor, flat, layout, district, usable_area_sqft FROM merged")
register("h5_latest_nonzero_price", lambda t: H.latest_prices(t.obs),
         "SELECT listing_id, last_rent_hkd, round(last_price_per_sqft, 6) AS last_price_per_sqft FROM merged")
register("h6_next_sighting", lambda t: L.next_sighting(t.seen).select("source_key", "run_id", "next_run"),
         "SELECT source_key, run_id, next_run FROM seen2")
register("h7_next_eligible_run", lambda t: L.next_eligible(t.site_runs).select("source_site", "run_id", F.col("next_eligible.run_id").alias("next_elig")),
         "SELECT source_site, run_id, next_elig FROM nexte")
register("h8_latest_ok_run_per_date", lambda t: R.latest_run_per_date(t.runs),
         "SELECT CAST(run_date AS VARCHAR) AS run_date, run_id, CAST(started_at AS VARCHAR) AS started_at FROM runs WHERE status = 'ok'")
register("h8_run_bounds", lambda t: R.run_bounds(t.runs).select(F.col("first.run_id").alias("first_run"), F.col("last.run_id").alias("last_run")),
         "SELECT arg_min(run_id, started_at) AS first_run, arg_max(run_id, started_at) AS last_run FROM runs WHERE status = 'ok'")


# F1-F5: matching
def _units(t: Tables) -> DataFrame:
    return M.with_fields(t.units)


def _listing_side(t: Tables) -> DataFrame:
    """Every unit as a listing: active by the last bit of its id, seen last by a small remainder."""
    seen = F.timestamp_seconds(F.lit(1_700_000_000) - (F.col("id") % 5) * 86400)
    return M.with_fields(t.units.select("*", F.col("id").alias("listing_id"), (F.col("id") % 2 == 0).alias("active"), seen.alias("last_seen_at")))


def _candidates(t: Tables) -> DataFrame:
    return M.best_candidate(_units(t).withColumnRenamed("id", "obs_id"), _listing_side(t))


def _with_identity(df: DataFrame) -> DataFrame:
    return df.withColumn("identity_key", observation_identity(df))


register("f1_known_source", lambda t: M.known_source(t.obs.select("obs_id", "source_key"), t.state).select("obs_id", "listing_id"),
         "SELECT o.obs_id, s.listing_id FROM obs o LEFT JOIN state s USING (source_key)")
register("f2_same_identity", lambda t: M.same_identity(
            _with_identity(_units(t)).withColumn("rent", F.when(F.col("rent") % 2 == 0, F.col("rent") + 300).otherwise(F.col("rent") + 600)),
            _with_identity(_listing_side(t))).select("id", "exact_id"),
         f"""SELECT a.id, CASE WHEN abs(a.rent + CASE WHEN a.rent % 2 = 0 THEN 300 ELSE 600 END - b.rent) <= 500 AND {STRICT.split(' AND ', 1)[1]} THEN b.id END AS exact_id
             FROM (SELECT nu.*, k.ik FROM nu JOIN (SELECT u.id, {identity('u.').replace('u.title', 'NULL')} AS ik FROM units u) k USING (id)) a
             JOIN (SELECT k.ik, nu.* FROM nu JOIN (SELECT u.id, {identity('u.').replace('u.title', 'NULL')} AS ik FROM units u) k USING (id)
                   QUALIFY row_number() OVER (PARTITION BY k.ik ORDER BY nu.id) = 1) b USING (ik)""")
register("f3_candidate_match", lambda t: _candidates(t).where("candidate_id is not null").select("obs_id", "candidate_id"),
         f"""SELECT a.id AS obs_id, arg_min(b.id, (b.id % 2) * 100000000000 + (b.id % 5) * 10000000000 + b.id) AS candidate_id
             FROM nu a JOIN nu b ON {STRICT} GROUP BY a.id""")
# each unit with the next ones of its estate, block, floor, flat and layout: two partners per field, no pairs of a whole group
_PARTNERS = ["f1", "f2", "f3", "f4", "f5"]
register("f4_strict_match", lambda t: _neighbours(t),
         f"""SELECT DISTINCT a.id, b.id AS other, {STRICT.replace("a.rent - b.rent", "coalesce(a.rent, 0) - coalesce(b.rent, 0)").replace("abs(", "a.rent IS NOT NULL AND b.rent IS NOT NULL AND abs(")} AS strict
             FROM ({" UNION ".join(f"SELECT id, unnest([lead(id) OVER w, lead(id, 2) OVER w]) AS other FROM nu WHERE {f} IS NOT NULL WINDOW w AS (PARTITION BY {f} ORDER BY coalesce(rent, 0), id)" for f in _PARTNERS)}) p
             JOIN nu a ON a.id = p.id JOIN nu b ON b.id = p.other""")
register("f5_match_summary", lambda t: M.match_summary(_units(t), "id").select("id", "matches", "first_match"),
         f"SELECT a.id, count(b.id) FILTER (WHERE b.id <> a.id) AS matches, coalesce(min(b.id), a.id) AS first_match FROM nu a LEFT JOIN nu b ON {STRICT} GROUP BY a.id")


def _neighbours(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    units = _units(t)
    pairs = None
    for field in M.FIELDS[:5]:
        order = Window.partitionBy(field).orderBy(F.coalesce("rent", F.lit(0)), "id")
        near = units.where(F.col(field).isNotNull()).select("id", F.lead("id").over(order).alias("one"), F.lead("id", 2).over(order).alias("two"))
        found = near.select("id", F.explode(F.array("one", "two")).alias("other"))
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.where("other is not null").distinct()
    a, b = shuffled(units).alias("a"), shuffled(units).alias("b")
    both = pairs.join(a, F.col("a.id") == pairs["id"]).join(b, F.col("b.id") == pairs["other"])
    return both.select(pairs["id"], pairs["other"], M.strict_match("a", "b").alias("strict"))


# K: lifecycle
INTERVAL = ["source_site", "source_key", "listing_id", "start_run", "start_at", "last_run", "end_run", "end_at"]
register("k1_active_snapshot", lambda t: S.snapshots(t.obs, t.listings, t.state, [R.target_run(t.runs).started_at]).drop("cutoff"),
         """SELECT listing_id, canonical_id, CAST(first_seen_at AS VARCHAR) AS first_seen_at, CAST(first_delisted_at AS VARCHAR) AS first_delisted_at,
            ever_rent_decreased, CAST(first_rent_decrease_at AS VARCHAR) AS first_rent_decrease_at, CAST(last_rent_decrease_at AS VARCHAR) AS last_rent_decrease_at,
            max_seen_rent_hkd, min_seen_rent_hkd, title, estate_name, block, floor, flat, layout, district, rent_hkd, usable_area_sqft,
            round(price_per_sqft, 6) AS price_per_sqft, active_source_count, sample_source_site, sample_source_url FROM cur""")
register("k2_presence_intervals", lambda t: t.build_intervals().select(*INTERVAL),
         "SELECT source_site, source_key, listing_id, start_run, CAST(start_at AS VARCHAR) AS start_at, last_run, end_run, CAST(end_at AS VARCHAR) AS end_at FROM iv")
register("k2_missing_events", lambda t: t.events.where("missing is not null").select("source_key", "run_id", F.col("missing.run_id").alias("missing_run")),
         "SELECT source_key, run_id, missing_run FROM ev WHERE missing_run IS NOT NULL")
register("k3_snapshot_counts", lambda t: S.active_counts(t.intervals, [r.started_at for r in R.baseline_runs(t.runs, [date(2024, 1, d) for d in range(1, 31)]).values()]),
         """SELECT CAST(r.started_at AS VARCHAR) AS cutoff, count(DISTINCT iv.listing_id) AS active_count FROM runs r
            LEFT JOIN iv ON iv.start_at <= r.started_at AND (iv.end_at IS NULL OR iv.end_at > r.started_at) WHERE r.status = 'ok' GROUP BY r.started_at""")
register("k3_snapshots", lambda t: S.snapshots(t.obs, t.listings, t.intervals, [r.started_at for r in D.periods(t.runs).values()]).select("cutoff", *PRICE, "active_source_count", "sample_source_url"),
         """SELECT CAST(a.c AS VARCHAR) AS cutoff, a.listing_id, coalesce(o.rent_hkd, l.last_rent_hkd) AS rent_hkd, coalesce(o.usable_area_sqft, l.usable_area_sqft) AS usable_area_sqft,
            round(coalesce(o.price_per_sqft, l.last_price_per_sqft), 6) AS price_per_sqft, coalesce(o.layout, l.layout) AS layout, coalesce(o.estate_name, l.estate_name) AS estate_name,
            a.n AS active_source_count, a.u AS sample_source_url
            FROM (SELECT c, period, listing_id, count(DISTINCT source_site) AS n, min(source_url) AS u FROM iv JOIN cuts ON start_at <= c AND (end_at IS NULL OR end_at > c) GROUP BY ALL) a
            JOIN listings l USING (listing_id) LEFT JOIN lobs o ON o.period = a.period AND o.listing_id = a.listing_id""")
register("k4_missing_gate", lambda t: _gate(t),
         """SELECT s.source_site, s.run_id, coalesce(n.n, 0) AS filtered,
            s.mode <> 'initial' AND (s.run_id + length(s.source_site)) % 6 <> 0 AND coalesce(n.n, 0) >= 1 AS gate
            FROM site_runs s LEFT JOIN (SELECT source_site, run_id, count(*) AS n FROM obs WHERE rent_hkd < 6000 GROUP BY ALL) n USING (source_site, run_id)""")


def _gate(t: Tables) -> DataFrame:
    n = t.obs.where("rent_hkd < 6000").groupBy("source_site", "run_id").agg(F.count("*").alias("n"))
    rows = t.site_runs.join(n, ["source_site", "run_id"], "left").withColumn("filtered", F.coalesce("n", F.lit(0)))
    errors = ((F.col("run_id") + F.length("source_site")) % 6 == 0).cast("int")
    return rows.select("source_site", "run_id", "filtered", L.missing_gate(F.col("mode"), errors, F.col("filtered")).alias("gate"))


_STATE_SQL = """SELECT source_key, source_site, listing_id, source_url, source_listing_id, CAST(first_seen_at AS VARCHAR) AS first_seen_at,
    CAST(last_seen_at AS VARCHAR) AS last_seen_at, CAST(first_missing_at AS VARCHAR) AS first_missing_at, missing_count, active, last_run_id FROM state"""
register("k5_source_state", lambda t: t.build_state(), _STATE_SQL)


def _incremental(t: Tables) -> DataFrame:
    """State of the first 15 runs, then the others merged into it."""
    early, late = t.obs.where("run_id <= 15"), t.obs.where("run_id > 15")
    first = L.source_state(L.missing_events(L.sightings(early), t.site_runs.where("run_id <= 15")))
    return L.merge_state(first, late, t.site_runs.where("run_id > 15"))


register("k5_incremental_state", _incremental, _STATE_SQL)
register("k6_listings", lambda t: t.build_listings().select("listing_id", "canonical_id", "identity_key", "first_seen_at", "last_seen_at", "active", "estate_name", "layout",
            "last_rent_hkd", "last_price_per_sqft", "ever_rent_decreased", "max_seen_rent_hkd", "min_seen_rent_hkd", "sources_count", "first_delisted_at"),
         """SELECT listing_id, canonical_id, identity_key, CAST(first_seen_at AS VARCHAR) AS first_seen_at, CAST(last_seen_at AS VARCHAR) AS last_seen_at, active, estate_name, layout,
            last_rent_hkd, round(last_price_per_sqft, 6) AS last_price_per_sqft, ever_rent_decreased, max_seen_rent_hkd, min_seen_rent_hkd, sources_count,
            CAST(first_delisted_at AS VARCHAR) AS first_delisted_at FROM listings""")
register("k7_first_delisted", lambda t: L.first_delisted(t.state),
         "SELECT listing_id, CAST(min(first_missing_at) AS VARCHAR) AS first_delisted_at FROM state GROUP BY listing_id")


def _resolved(t: Tables) -> DataFrame:
    """One half of the units as known listings, the other as a batch; a tenth of the batch comes from known sources."""
    key = F.concat(F.lit("s:"), (F.col("id") - F.when(F.col("id") % 10 == 1, 1).otherwise(0)).cast("string"))
    keyed = t.units.withColumn("source_key", key)
    keyed = _with_identity(keyed)
    old = keyed.where("id % 2 = 0").withColumn("listing_id", F.col("id")).withColumn("active", F.lit(True)).withColumn(
        "last_seen_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    batch = keyed.where("id % 2 = 1").withColumnRenamed("id", "obs_id")
    return M.resolve_batch(batch, old.select("source_key", "listing_id"), old).select("obs_id", "listing_id", "resolved_by")


CTES["k8key"] = f"SELECT n.*, {identity('u.').replace('u.title', 'NULL')} AS ik FROM nu n JOIN units u USING (id)"
CTES["k8new"] = "SELECT * FROM k8key WHERE id % 2 = 1 AND NOT (id % 10 = 1 AND id - 1 IN (SELECT id FROM units))"
CTES["k8same"] = f"""SELECT a.id, b.id AS listing_id FROM k8new a JOIN (SELECT * FROM k8key WHERE id % 2 = 0
    QUALIFY row_number() OVER (PARTITION BY ik ORDER BY id) = 1) b ON a.ik = b.ik AND {STRICT}"""
CTES["k8cand"] = f"SELECT a.id, min(b.id) AS listing_id FROM k8new a JOIN (SELECT * FROM k8key WHERE id % 2 = 0) b ON {STRICT} GROUP BY a.id"
CTES["k8open"] = """SELECT *, row_number() OVER (ORDER BY id) AS n FROM k8new
    WHERE id NOT IN (SELECT id FROM k8same) AND id NOT IN (SELECT id FROM k8cand)"""
# one step per open row in the order of ids: it joins the lowest leader that it matches, else it becomes one
register("k8_resolve_batch", _resolved,
         f"""SELECT id AS obs_id, id - 1 AS listing_id, 'source' AS resolved_by FROM units WHERE id % 10 = 1 AND id - 1 IN (SELECT id FROM units)
             UNION ALL SELECT id, listing_id, 'identity' FROM k8same
             UNION ALL SELECT id, listing_id, 'candidate' FROM k8cand WHERE id NOT IN (SELECT id FROM k8same)
             UNION ALL SELECT id, leader, 'batch' FROM (
               WITH RECURSIVE row_ AS MATERIALIZED (
                 SELECT o.n, o.id, e.before FROM k8open o LEFT JOIN (
                   SELECT b.id, list(a.id) AS before FROM k8open a JOIN k8open b ON a.id < b.id AND {STRICT} GROUP BY b.id) e ON e.id = o.id
               ), walk AS (
                 SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
                 UNION ALL
                 SELECT r.n, r.id, coalesce(r.found, r.id), CASE WHEN r.found IS NULL THEN list_append(r.leaders, r.id) ELSE r.leaders END
                 FROM (SELECT row_.n, row_.id, walk.leaders, list_min(list_intersect(row_.before, walk.leaders)) AS found
                       FROM walk JOIN row_ ON row_.n = walk.n + 1) r
               ) SELECT id, leader FROM walk WHERE n > 0)""")
register("k9_run_status", lambda t: t.runs.select("run_id", L.run_status(F.col("run_id") % 11 == 0, F.col("run_id") % 13 == 0, F.col("run_id") % 10 - 6).alias("run_status")),
         "SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'blocked' WHEN run_id % 13 = 0 THEN 'failed' WHEN run_id % 10 > 6 THEN 'partial' ELSE 'ok' END AS run_status FROM runs")


def _report(t: Tables) -> DataFrame:
    """Row counts of every table of the report."""
    tables = D.daily_report(t.obs, t.runs, t.listings, t.state, LAYOUTS)
    parts = [df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("k11_layout_history", lambda t: D.layout_history(t.obs, t.listings, t.intervals, t.runs, date(2024, 1, 5), date(2024, 1, 30)).select(
            "report_date", "layout", "count", "avg_rent", "median_rent", "avg_psf"),
         """SELECT CAST(a.run_date AS VARCHAR) AS report_date, coalesce(nullif(coalesce(o.layout, l.layout), ''), '未标明') AS layout, count(*) AS count,
            round(avg(coalesce(o.rent_hkd, l.last_rent_hkd)), 6) AS avg_rent, round(median(coalesce(o.rent_hkd, l.last_rent_hkd)), 6) AS median_rent,
            round(avg(coalesce(o.price_per_sqft, l.last_price_per_sqft)), 6) AS avg_psf
            FROM (SELECT DISTINCT r.run_date, r.started_at, iv.listing_id FROM runs r JOIN iv ON iv.start_at <= r.started_at AND (iv.end_at IS NULL OR iv.end_at > r.started_at)
                  WHERE r.status = 'ok' AND r.run_date >= DATE '2024-01-05') a
            JOIN listings l USING (listing_id)
            LEFT JOIN (SELECT r.started_at, o.* FROM runs r JOIN obs o ON o.seen_at <= r.started_at
                       QUALIFY row_number() OVER (PARTITION BY r.started_at, listing_id ORDER BY seen_at DESC, obs_id DESC) = 1) o
              ON o.started_at = a.started_at AND o.listing_id = a.listing_id
            GROUP BY 1, 2""")

# G18, G19, J2, J4 and the hash keys
register("g18_rent_history", lambda t: H.rent_history(t.obs),
         """SELECT listing_id, min_seen_rent_hkd, max_seen_rent_hkd, ever_rent_decreased, CAST(first_rent_decrease_at AS VARCHAR) AS first_rent_decrease_at,
            CAST(last_rent_decrease_at AS VARCHAR) AS last_rent_decrease_at FROM hist""")
register("g18_rent_history_per_source", lambda t: H.rent_decreases(t.obs, "source_key").groupBy("source_key").agg(F.count("*").alias("decreases")),
         """SELECT source_key, count(*) AS decreases FROM (SELECT source_key, rent_hkd, last_value(nullif(rent_hkd, 0) IGNORE NULLS) OVER (PARTITION BY source_key ORDER BY ord
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM obs) WHERE rent_hkd < p GROUP BY source_key""")
register("g19_source_summary", lambda t: L.source_summary(t.state).select(
            "listing_id", "sources_count", "active", F.array_join(F.map_keys("source_summary"), ",").alias("sites"),
            F.array_join(F.transform(F.map_values("source_summary"), lambda r: r["url"]), ",").alias("urls")),
         """SELECT listing_id, count(*) AS sources_count, bool_or(active) AS active, string_agg(source_site, ',' ORDER BY source_site) AS sites,
            string_agg(source_url, ',' ORDER BY source_site) AS urls FROM state GROUP BY listing_id""")
register("j1_removed_ids", lambda t: _removed(t), at_date("SELECT listing_id FROM remv", EARLY_DATE))
register("j2_unseen_keys", lambda t: L.unseen_keys(t.state, t.seen.join(F.broadcast(R.latest_run(t.runs)), "run_id")).select("source_key"),
         "SELECT source_key FROM state WHERE active AND source_key NOT IN (SELECT source_key FROM seen WHERE run_id = (SELECT arg_max(run_id, started_at) FROM runs))")
register("j3_first_occurrence", lambda t: L.first_occurrences(t.obs),
         "SELECT source_key, min(obs_id) AS obs_id, min(run_id) AS run_id, CAST(min(obs.seen_at) AS VARCHAR) AS seen_at FROM obs GROUP BY source_key")
register("j4_distinct_keys_per_source", lambda t: L.distinct_keys(t.obs),
         "SELECT source_site, count(DISTINCT source_key) AS keys FROM obs GROUP BY source_site")
register("j5_report_dates", lambda t: R.known_dates(t.runs, t.obs),
         "SELECT CAST(run_date AS VARCHAR) AS run_date FROM (SELECT run_date FROM runs WHERE status = 'ok' UNION SELECT run_date FROM obs)")


def _removed(t: Tables) -> DataFrame:
    refs = D.periods(t.runs, EARLY_DATE)
    snap = D.period_snapshots(t.obs, t.listings, t.state, refs)
    from sightline.operators.reports import removed_listings

    return removed_listings(snap.where("period = 'current'"), snap.where("period = 'day'")).select("listing_id")


register("b11_stable_hash", lambda t: t.obs.select("obs_id", keys.stable_hash(F.col("source_url"), 16).alias("hash")),
         f"SELECT obs_id, {sha('source_url', 16)} AS hash FROM obs")
register("b12_source_key", lambda t: t.obs.select("obs_id", keys.source_key(F.col("source_site"), F.when(F.col("obs_id") % 3 > 0, F.col("source_listing_id")), F.col("source_url")).alias("source_key")),
         f"SELECT obs_id, CASE WHEN obs_id % 3 > 0 THEN source_site || ':' || source_listing_id ELSE source_site || ':url:' || {sha('source_url')} END AS source_key FROM obs")
register("b13_identity_key", lambda t: t.obs.select("obs_id", observation_identity(t.obs).alias("identity_key")),
         "SELECT i.identity_key, o.obs_id FROM ident i JOIN obs o USING (ord)")
register("b14_canonical_id", lambda t: t.obs.select("obs_id", keys.canonical_id(observation_identity(t.obs), F.col("source_key")).alias("canonical_id")),
         f"SELECT o.obs_id, {sha('''i.identity_key || '|' || o.source_key''')} AS canonical_id FROM ident i JOIN obs o USING (ord)")
register("c8_start_of_local_day", lambda t: t.runs.select("run_id", N.start_of_local_day(F.col("started_at"), F.col("run_date")).alias("day_start")),
         "SELECT run_id, CAST(date_trunc('day', started_at) AS VARCHAR) AS day_start FROM runs")
