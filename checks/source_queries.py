"""Sections A and L: landed files, sinks and streams. Files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import LAYOUTS, TERMS, Tables
from checks.oracle import label, psf
from checks.registry import register
from checks.scan_queries import scan_oracle, scanned
from checks.state_queries import _STATE_SQL, _report
from checks.text_queries import _ASOF, _FOUND, _OUT, _OUT_SQL, card_pages, items_1, items_2, items_3
from sightline import constants as K
from sightline.operators import current as C
from sightline.operators import extraction as E
from sightline.operators import lifecycle as L
from sightline.operators.filters import Filters
from sightline.plans import daily_report as D
from sightline.plans import scan as S
from sightline.session import new_path
from sightline.sources import landed, sinks
from sightline.streaming import jobs


def landed_copy(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    path = new_path(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return path


# A1-A5: landed pages
def _html(t: Tables) -> DataFrame:
    return landed.scan_html(landed.read_pages(t.spark, landed_copy(card_pages(t), "pages")), TERMS)


register("a1_html_pages", lambda t: _html(t).select(*[c for c in _OUT if c not in ("title", "district")]),
         "SELECT " + _OUT_SQL.replace("district,\n    left(t, 500) AS title", "").rstrip().rstrip(",") + f""" FROM cardobs WHERE {_FOUND} AND (card_id % 2 = 0 OR regexp_matches(t, '租\\s*\\$?\\s*[0-9]')
             OR {" OR ".join(f"contains(t, '{h}')" for h in K.LISTING_HINTS)}) QUALIFY row_number() OVER (PARTITION BY source_site, source_listing_id ORDER BY card_id) = 1""")


def _json_pages(items: DataFrame, rows: str) -> DataFrame:
    """Pages of eight items and the page size of ten, so that the last pages of a source are never seen."""
    page = items.withColumn("page", F.floor(F.col("id") / 32).cast("int"))
    return page.groupBy("source_site", "page").agg(F.collect_list("item").alias(rows)).select(
        F.lit(1).alias("run_id"), "source_site", "page", (F.lit(10) * F.col("page")).alias("count"), rows)


def _result_pages(t: Tables) -> DataFrame:
    return landed.read_result_pages(t.spark, landed_copy(_json_pages(items_1(t), "result"), "result", "json"))


def _data_pages(t: Tables) -> DataFrame:
    return landed.read_data_pages(t.spark, landed_copy(_json_pages(items_3(t), "data"), "data", "json"))


_SHORT = ["source_key", "rent_hkd", "usable_area_sqft", "gross_area_sqft", "price_per_sqft"]
_SHORT_SQL = f"rent AS rent_hkd, area AS usable_area_sqft, gross AS gross_area_sqft, round(coalesce(psf, {psf('rent', 'area')}), 6) AS price_per_sqft FROM props"
register("a2_result_pages", lambda t: E.items_family_1(landed.items(_result_pages(t)), _ASOF()).select(*_SHORT), f"SELECT site || ':' || num AS source_key, {_SHORT_SQL}")
register("a3_data_pages", lambda t: E.items_family_3(landed.items(_data_pages(t))).select(*_SHORT), f"SELECT 'centanet:' || num AS source_key, {_SHORT_SQL}")


def _state_html(t: Tables) -> DataFrame:
    """State pages of one post each; every fifth post is on a second page again."""
    copies = items_2(t).withColumn("copy", F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    state = F.to_json(F.struct(F.array("item").alias("POSTS"), F.lit(36).alias("POSTSNUMPAGES"), F.lit(358).alias("POSTSTOTAL")))
    for a, b in (("&", "&a;"), ('"', "&q;"), ("<", "&l;"), (">", "&g;")):
        state = F.replace(state, F.lit(a), F.lit(b))
    html = F.concat(F.lit('<body><script id="serverApp-state" type="application/json">\n'), state, F.lit("\n</script></body>"))
    return copies.select((F.col("id") * 2 + F.col("copy")).alias("page_id"), F.lit(1).alias("run_id"), "source_site", F.lit("u").alias("source_url"), html.alias("html"))


register("a4_state_pages", lambda t: E.items_family_2(landed.state_items(landed.read_pages(t.spark, landed_copy(_state_html(t), "state"))), _ASOF()).select(*_SHORT),
         f"SELECT 'ricacorp:' || num AS source_key, {_SHORT_SQL}")
register("a5_page_completeness", lambda t: C.page_completeness(_result_pages(t).select("run_id", "source_site", "page", F.col("count").alias("total"), F.lit(10).alias("page_size"))),
         """SELECT 1 AS run_id, site AS source_site, greatest(1, max(id // 32)) AS pages_due, count(DISTINCT id // 32) AS pages_seen, count(DISTINCT id // 32) >= greatest(1, max(id // 32)) AS complete
            FROM props GROUP BY site""")


# A6-A11: the log and the exports
def _log(t: Tables) -> str:
    path = new_path(t.spark, "log")
    sinks.append_log(t.obs.where("run_id <= 20"), path)
    sinks.append_log(t.obs.where("run_id > 20"), path)
    return path


def _dated(t: Tables) -> DataFrame:
    from datetime import date

    return landed.with_run(landed.read_log(t.spark, _log(t), date(2024, 1, 5), date(2024, 1, 24)), t.runs)


register("a6_log_with_runs", lambda t: _dated(t).select("obs_id", "source_site", "mode", "status", "started_at"),
         "SELECT o.obs_id, o.source_site, r.mode, r.status, CAST(r.started_at AS VARCHAR) AS started_at FROM obs o JOIN runs r USING (run_id) WHERE o.run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'")
register("a7_append_log", lambda t: landed.read_log(t.spark, _log(t)).select("obs_id", "run_date", "source_site", "rent_hkd", "title"),
         "SELECT obs_id, CAST(run_date AS VARCHAR) AS run_date, source_site, rent_hkd, title FROM obs")


def _snapshot(t: Tables) -> DataFrame:
    path = new_path(t.spark, "snapshot")
    marked = t.obs.withColumn("rejected_by", F.when(F.col("rent_hkd") < 6000, F.lit("rent")))
    events = t.events.where("missing is not null").select("source_site", F.col("missing.run_id").alias("run_id"))
    sinks.write_run_snapshot(C.site_validation(marked, t.site_runs, events), marked.select("run_id", "source_site", "obs_id", "rejected_by"), path)
    rows = t.spark.read.schema("obs_id bigint, rejected_by string, run_id int, source_site string").json(f"{path}/observations")
    counts = rows.groupBy("run_id", "source_site").agg(F.count("*").alias("rows"), F.count("rejected_by").alias("rejected"))
    valid = t.spark.read.schema("run_id int, source_site string, rejected_observations bigint, missing_sources_marked bigint").json(f"{path}/validation")
    return valid.join(counts, ["run_id", "source_site"])


register("a8_run_snapshot", _snapshot,
         """SELECT o.run_id, o.source_site, count(*) AS rows, count(*) FILTER (WHERE rent_hkd < 6000) AS rejected, count(*) FILTER (WHERE rent_hkd < 6000) AS rejected_observations,
            coalesce(any_value(e.n), 0) AS missing_sources_marked FROM obs o LEFT JOIN (SELECT source_site, missing_run AS run_id, count(*) AS n FROM ev WHERE missing_run IS NOT NULL GROUP BY 1, 2) e
            ON e.run_id = o.run_id AND e.source_site = o.source_site GROUP BY 1, 2""")


def _snapshot_rows(t: Tables) -> DataFrame:
    """Every observation of the snapshot with what its source's validation says, errors included."""
    path = new_path(t.spark, "snapshot")
    S.read(t.spark, scanned(t), "rejected").select("run_id", "source_site", "obs_id", "source_key", "rejected_by").write.parquet(path + "-marked")
    kept = S.read(t.spark, scanned(t), "observations").select("run_id", "source_site", "obs_id", "source_key", F.lit(None).cast("string").alias("rejected_by"))
    sinks.write_run_snapshot(S.validation(t.spark, scanned(t)), kept.unionByName(t.spark.read.parquet(path + "-marked")), path)
    rows = t.spark.read.schema("obs_id bigint, source_key string, rejected_by string, run_id int, source_site string").json(f"{path}/observations")
    valid = t.spark.read.schema("run_id int, source_site string, ok boolean, errors bigint, missing_sources_marked bigint").json(f"{path}/validation")
    # one row per source and run goes to the rows; those of no row are added
    of = ["run_id", "source_site"]
    empty = valid.join(F.broadcast(rows.select(*of).distinct()), of, "left_anti").withColumns({c: F.lit(None).cast("string") for c in ("source_key", "rejected_by")})
    return rows.drop("obs_id").join(F.broadcast(valid), of).unionByName(empty).select("run_id", "source_site", "ok", "errors", "missing_sources_marked", "source_key", "rejected_by")


register("a8_snapshot_rows", _snapshot_rows,
         scan_oracle("""SELECT gate.run_id, gate.source_site, ok, errors, coalesce(m.n, 0) AS missing_sources_marked, raw.source_key, CASE WHEN raw.rent < 9200 THEN 'rent' END AS rejected_by
    FROM gate LEFT JOIN (SELECT missing AS run_id, source_site, count(*) AS n FROM ev WHERE missing IS NOT NULL GROUP BY ALL) m USING (run_id, source_site) LEFT JOIN raw ON raw.run_id = gate.run_id AND raw.source_site = gate.source_site"""))


def _csv(df: DataFrame, columns: list[str], types: str, keep: list[str]) -> DataFrame:
    path = new_path(df.sparkSession, "csv")
    sinks.write_csv(df, columns, path)
    read = df.sparkSession.read.option("header", True).csv(path)
    assert read.columns == columns, read.columns
    casts = dict(p.strip().split(" ") for p in types.split(","))
    return read.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in keep])


register("a9_listings_csv", lambda t: _csv(C.active_listings(t.listings), K.LISTING_EXPORT, "active int, last_rent_hkd int, sources_count bigint, last_price_per_sqft double",
                                             ["canonical_id", "active", "estate_name", "last_rent_hkd", "last_price_per_sqft", "sources_count"]),
         "SELECT canonical_id, CAST(active AS INT) AS active, estate_name, last_rent_hkd, round(last_price_per_sqft, 6) AS last_price_per_sqft, sources_count FROM listings WHERE active")
register("a10_changes_csv", lambda t: _csv(C.latest_changes(t.obs, t.listings), K.CHANGES_EXPORT, "rent_hkd int", ["canonical_id", "source_url", "rent_hkd", "layout"]),
         "SELECT l.canonical_id, o.source_url, o.rent_hkd, o.layout FROM obs o JOIN listings l USING (listing_id) ORDER BY obs_id DESC LIMIT 100")


def _report_files(t: Tables) -> DataFrame:
    """Rows of every CSV dataset of the report, read back."""
    tables = D.daily_report(t.obs, t.runs, t.listings, t.state, LAYOUTS)
    paths = sinks.write_report(tables, "2024-01-30", new_path(t.spark, "report"))
    tables["snapshots"].unpersist()
    out = None
    for name, path in paths.items():
        # an empty dataset has no file with a header to infer from
        rows = t.spark.read.option("header", True).schema("first string").csv(path).agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


_REPORT_ROWS = """SELECT 'new_listings' AS dataset, count(*) AS rows FROM listings, tgt WHERE first_seen_at >= tgt.c UNION ALL SELECT 'removed_listings', count(*) FROM remv
    UNION ALL SELECT 'source_disappeared', count(*) FROM state, tgt WHERE first_missing_at = tgt.c UNION ALL SELECT 'rent_changes', count(*) FROM chg
    UNION ALL SELECT 'rent_decreases', count(*) FROM chg WHERE delta < 0 UNION ALL SELECT 'fresh_value_watchlist', least(25, count(*)) FROM listings, tgt WHERE first_seen_at >= tgt.c
    UNION ALL SELECT 'watchlist', least(25, count(*)) FROM disc WHERE pct IS NOT NULL AND (pct <= -5 OR active_source_count >= 2) UNION ALL SELECT 'budget_stats', count(*) FROM bands
    UNION ALL SELECT 'withdrawal_lag_stats', 4 UNION ALL SELECT 'stale_value_watchlist', least(25, count(*)) FROM disc WHERE age >= 14 AND (pct <= -8 OR rent_hkd <= (SELECT low FROM low))"""
register("a11_report_csv", _report_files, _REPORT_ROWS)
register("k10_daily_report", _report, f"""{_REPORT_ROWS}
    UNION ALL SELECT 'snapshots', count(*) FROM snap UNION ALL SELECT 'layout_stats', count(*) FROM lc UNION ALL SELECT 'withdrawals', count(*) FROM wd
    UNION ALL SELECT 'estate_stats', least(15, count(DISTINCT {label('estate_name')})) FROM cur UNION ALL SELECT 'velocity', 7 UNION ALL SELECT 'velocity_signal', 1
    UNION ALL SELECT 'overview', 1 UNION ALL SELECT 'market_heat', 1""")


_ROW_FILES = ["new_listings", "removed_listings", "source_disappeared", "rent_changes", "rent_decreases", "budget_stats", "withdrawal_lag_stats"]


def _report_rows(t: Tables) -> DataFrame:
    """Key and value of every row of the CSV datasets that no limit cuts, read back."""
    tables = D.daily_report(t.obs, t.runs, t.listings, t.state, LAYOUTS)
    paths = sinks.write_report(tables, "2024-01-30", new_path(t.spark, "report"))
    tables["snapshots"].unpersist()
    out = None
    for name in _ROW_FILES:
        columns = sinks.REPORT_COLUMNS[name]
        schema = ", ".join(f"`{c}` string" for c in columns)
        key = {"budget_stats": "rent_lower", "withdrawal_lag_stats": "lag_bucket"}.get(name, "canonical_id")
        value = {"budget_stats": "rent_upper", "withdrawal_lag_stats": "source_missing_count"}.get(name, "rent_hkd")
        rows = t.spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(paths[name])
        rows = rows.select(F.lit(name).alias("dataset"), F.col(key).alias("key"), F.col(value).cast("bigint").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


register("a11_report_rows", _report_rows, """SELECT 'new_listings' AS dataset, canonical_id AS key, CAST(last_rent_hkd AS BIGINT) AS value FROM listings, tgt WHERE first_seen_at >= tgt.c
    UNION ALL SELECT 'removed_listings', canonical_id, rent_hkd FROM remv UNION ALL SELECT 'source_disappeared', canonical_id, rent_hkd FROM gone, tgt WHERE first_missing_at = tgt.c
    UNION ALL SELECT 'rent_changes', canonical_id, rent_hkd FROM chg UNION ALL SELECT 'rent_decreases', canonical_id, rent_hkd FROM chg WHERE delta < 0
    UNION ALL SELECT 'budget_stats', CAST(rent_lower AS VARCHAR), rent_upper FROM bands
    UNION ALL SELECT 'withdrawal_lag_stats', b.l, (SELECT count(*) FROM wd WHERE wd.bucket = b.l) FROM (SELECT unnest(['0-7天', '8-14天', '15-30天', '30天以上']) AS l) b""")


def _bundle_rows(t: Tables) -> DataFrame:
    """Key and value of every row of the bundle's tables of listings and records."""
    tables = D.daily_report(t.obs, t.runs, t.listings, t.state, LAYOUTS)
    keys = {"snapshots": F.concat_ws(":", "period", "listing_id"), "new_listings": F.col("listing_id").cast("string"), "removed_listings": F.col("listing_id").cast("string"),
            "rent_changes": F.col("listing_id").cast("string"), "rent_decreases": F.col("listing_id").cast("string"), "source_disappeared": F.col("source_key"), "withdrawals": F.col("source_key")}
    out = None
    for name, key in keys.items():
        rows = tables[name].select(F.lit(name).alias("dataset"), key.alias("key"), F.col("rent_hkd").cast("bigint").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


register("k10_report_rows", _bundle_rows, """SELECT 'snapshots' AS dataset, period || ':' || listing_id AS key, CAST(rent_hkd AS BIGINT) AS value FROM snap
    UNION ALL SELECT 'new_listings', CAST(listing_id AS VARCHAR), last_rent_hkd FROM listings, tgt WHERE first_seen_at >= tgt.c
    UNION ALL SELECT 'removed_listings', CAST(listing_id AS VARCHAR), rent_hkd FROM remv
    UNION ALL SELECT 'rent_changes', CAST(listing_id AS VARCHAR), rent_hkd FROM chg UNION ALL SELECT 'rent_decreases', CAST(listing_id AS VARCHAR), rent_hkd FROM chg WHERE delta < 0
    UNION ALL SELECT 'source_disappeared', source_key, rent_hkd FROM gone, tgt WHERE first_missing_at = tgt.c UNION ALL SELECT 'withdrawals', source_key, rent_hkd FROM wd""")


# L: streams over landed files
def _stream(t: Tables, df: DataFrame, name: str) -> DataFrame:
    return t.spark.readStream.schema(df.schema).parquet(landed_copy(df, name))


def _ingested(t: Tables, *files: DataFrame) -> DataFrame:
    """Log after files that land one after the other."""
    out, late, checkpoint = jobs.folders(t.spark, "ingest")
    path = new_path(t.spark, "obs")
    for file in files:
        file.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(t.obs.schema).parquet(path)
        jobs.ingest(stream, Filters(min_rent=6000, max_area=800), ["estate1", "near view"], out, late, checkpoint).awaitTermination()
    return t.spark.read.schema(t.obs.schema).parquet(f"{out}/batch=*")


def _ingest(t: Tables) -> DataFrame:
    return _ingested(t, t.obs).select("source_key", "run_id")


register("l1_stream_ingest", _ingest,
         """SELECT DISTINCT source_key, run_id FROM obs WHERE coalesce(rent_hkd >= 6000, true) AND usable_area_sqft <= 800 AND (contains(replace(coalesce(title, ''), ' ', ''), 'nearview')
            OR estate_name LIKE 'estate1%')""")


_WHOLE = ["obs_id", "run_id", "source_key", "listing_id", "estate_name", "rent_hkd", "usable_area_sqft"]
register("l1_stream_ingest_late", lambda t: _ingested(t, t.obs.where("listing_id % 5 <> 0 OR run_id > 20"), t.obs.where("listing_id % 5 = 0 AND run_id <= 20")).select(*_WHOLE),
         f"""SELECT {", ".join(_WHOLE)} FROM obs WHERE coalesce(rent_hkd >= 6000, true) AND usable_area_sqft <= 800 AND (contains(replace(coalesce(title, ''), ' ', ''), 'nearview')
            OR estate_name LIKE 'estate1%') QUALIFY row_number() OVER (PARTITION BY source_key, run_id ORDER BY obs_id) = 1""")


def _decreases(t: Tables) -> DataFrame:
    out, state, checkpoint = jobs.folders(t.spark, "rents")
    jobs.rent_decrease_stream(_stream(t, t.obs, "obs"), out, state, checkpoint).awaitTermination()
    return t.spark.read.schema("obs_id bigint, listing_id bigint, rent_hkd int, prev_rent int").parquet(f"{out}/batch=*")


register("l2_stream_rent_decreases", _decreases, "SELECT obs_id, listing_id, rent_hkd, prev_rent FROM prevr WHERE rent_hkd < prev_rent")


def _missing(t: Tables) -> DataFrame:
    """Completed runs arrive in one file; the log is read as far as it goes."""
    _, state, checkpoint = jobs.folders(t.spark, "missing")
    runs = t.site_runs.select("source_site", "run_id", "started_at", "eligible").coalesce(1)
    path = landed_copy(t.obs, "log")
    query = jobs.missing_stream(_stream(t, runs, "runs"), lambda spark: spark.read.parquet(path), state, checkpoint)
    query.awaitTermination()
    return jobs.latest_version(t.spark, state, query, jobs.STATE)


register("l3_missing_on_completion", _missing, _STATE_SQL)


def _late(t: Tables) -> DataFrame:
    """State built without a late file, then rebuilt for the keys of that file."""
    late = t.obs.where("obs_id % 50 = 0")
    state = L.source_state(L.missing_events(L.sightings(t.obs.where("obs_id % 50 <> 0")), t.site_runs))
    return jobs.rebuild_late(state, late, t.obs, t.site_runs)


register("l3_late_file", _late, _STATE_SQL)
