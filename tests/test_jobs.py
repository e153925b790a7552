"""Streams over several batches, sinks, the daily report and registered queries against their oracles."""

import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from sightline.operators import history as H
from sightline.operators import lifecycle as L
from sightline.session import new_path
from sightline.sources import sinks
from sightline.streaming import jobs


def landed(spark, df, spans, name):
    """One file per span of runs, each landed later than the one before."""
    path = new_path(spark, name)
    for low, high in spans:
        df.where(f"run_id > {low} and run_id <= {high}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


SPANS = [(0, 11), (11, 12), (12, 30)]


def test_rent_stream_over_batches(spark, tables):
    out, state, checkpoint = jobs.folders(spark, "rents")
    stream, _ = landed(spark, tables.obs, SPANS, "obs")
    jobs.rent_decrease_stream(stream, out, state, checkpoint).awaitTermination()
    got = {(r.obs_id, r.prev_rent) for r in spark.read.parquet(f"{out}/batch=*").collect()}
    assert len(os.listdir(out)) == 3
    assert got == {(r.obs_id, r.prev_rent) for r in H.rent_decreases(tables.obs).collect()}


def test_missing_stream_over_batches(spark, tables):
    _, state, checkpoint = jobs.folders(spark, "missing")
    _, path = landed(spark, tables.obs, SPANS[:1] + [(11, 30)], "log")
    stream, _ = landed(spark, tables.site_runs.select("source_site", "run_id", "started_at", "eligible"), SPANS, "runs")
    query = jobs.missing_stream(stream, lambda s: s.read.parquet(path), state, checkpoint)
    query.awaitTermination()
    got = jobs.latest_version(spark, state, query, jobs.STATE)
    want = L.source_state(L.missing_events(L.sightings(tables.obs), tables.site_runs))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_a_batch_writes_the_parts_it_touches(spark):
    from sightline.session import new_path

    held = jobs.PartedState(spark, new_path(spark, "state"), jobs.RENTS, "listing_id")
    first = spark.createDataFrame([(i, i) for i in range(300)], jobs.RENTS)
    held.write(0, first, held.touched(first))
    change = spark.createDataFrame([(7, 70), (300, 5)], jobs.RENTS)
    parts = held.touched(change)
    assert len(parts) <= 2 and held.read(1, parts).count() < 30
    for _ in range(2):  # a repeated batch
        old = held.read(1, parts)
        held.write(1, old.join(change, "listing_id", "left_anti").unionByName(change), parts)
    got = {r.listing_id: r.rent for r in held.read(2).collect()}
    assert got == {**{i: i for i in range(300)}, 7: 70, 300: 5}
    assert set(held.versions(2).values()) == {0, 1}
    held.write(2, first.limit(0), parts)
    assert not set(parts) & set(held.versions(3)) and held.read(3, parts).count() == 0


def test_repeated_batch_gives_the_same_state(spark, tables):
    out, state, checkpoint = jobs.folders(spark, "again")
    stream, path = landed(spark, tables.obs, SPANS[:1], "obs")
    jobs.rent_decrease_stream(stream, out, state, checkpoint).awaitTermination()
    first = spark.read.parquet(f"{out}/batch=0").count()
    again = spark.readStream.schema(tables.obs.schema).parquet(path)
    jobs.rent_decrease_stream(again, out, state, checkpoint + "-new").awaitTermination()
    assert spark.read.parquet(f"{out}/batch=*").count() == first


def test_ingest_keeps_late_rows(spark, tables):
    from sightline.operators.filters import Filters

    out, late, checkpoint = jobs.folders(spark, "ingest")
    early, behind = tables.obs.where("listing_id % 5 > 0 or run_id > 20"), tables.obs.where("listing_id % 5 = 0 and run_id <= 20")
    path = new_path(spark, "obs")
    for file in (early.unionByName(early), behind.unionByName(early.where("run_id = 3"))):
        file.repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(tables.obs.schema).parquet(path)
        jobs.ingest(stream, Filters(), [], out, late, checkpoint).awaitTermination()
    first = {}
    for r in sorted(tables.obs.collect(), key=lambda r: r.obs_id):
        first.setdefault((r.source_key, r.run_id), r)
    log = spark.read.schema(tables.obs.schema).parquet(f"{out}/batch=*").collect()
    assert sorted(log, key=lambda r: r.obs_id) == sorted(first.values(), key=lambda r: r.obs_id)
    got = {r.obs_id for r in spark.read.schema(tables.obs.schema).parquet(f"{late}/batch=*").collect()}
    last = max(r.seen_at for r in early.collect())
    assert got == {r.obs_id for r in first.values() if r.listing_id % 5 == 0 and r.run_id <= 20 and (last - r.seen_at).days > 2} and got


def test_a_batch_reads_the_keys_of_its_own_runs(spark, tables):
    from sightline.operators.filters import Filters

    out, late, checkpoint = jobs.folders(spark, "pruned")
    stream, _ = landed(spark, tables.obs, SPANS, "obs")
    jobs.ingest(stream, Filters(), [], out, late, checkpoint).awaitTermination()
    keys = jobs.known_keys(spark, out, 2, [11, 12])
    assert {r._run for r in keys.select("_run").distinct().collect()} == {11, 12}
    files = keys._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in files[files.index("PartitionFilters") :].split("]")[0]


@pytest.mark.parametrize("name", ["l1_stream_ingest", "l1_stream_ingest_late"])
def test_ingest_oracle(spark, name):
    test_oracle(spark, name)


def test_log_partitions_are_pruned(spark, tables):
    from sightline.sources.landed import read_log

    path = new_path(spark, "log")
    sinks.append_log(tables.obs, path)
    plan = read_log(spark, path, date(2024, 1, 5), date(2024, 1, 6)).select("obs_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan


def test_report_of_a_date_without_baseline(spark, tables):
    from checks.fixtures import LAYOUTS
    from sightline.plans.daily_report import daily_report

    report = daily_report(tables.obs, tables.runs, tables.listings, tables.state, LAYOUTS, report_date=date(2024, 1, 1))
    assert report["overview"].first().count_delta_day is None
    assert report["removed_listings"].count() == 0
    assert {r.active_delta_day for r in report["budget_stats"].collect()} == {None}
    assert report["new_listings"].count() == report["overview"].first()["count"] > 0
    assert report["market_heat"].first().has_baseline is False
    report["snapshots"].unpersist()


def test_source_side_filters_reach_the_scan(spark, tables):
    plan = tables.obs.where("source_site = 'view'").select("obs_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


SAMPLE = ["a2_result_pages", "b9_layout_terms", "c12_nice_step", "d16_card_observations", "e13_rejection_audit", "f3_candidate_match",
          "f5_match_summary", "g11_budget_stats", "g18_rent_history", "h1_latest_observation", "i8_value_watchlist", "j2_unseen_keys",
          "k1_active_snapshot", "k2_presence_intervals", "k3_snapshots", "k5_incremental_state", "l1_stream_ingest"]


def _names():
    import __spark_entry__ as entry

    return sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.mark.parametrize("name", _names())
def test_oracle(spark, name):
    import __spark_entry__ as entry
    from checks.compare import canonical, connect

    sf = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
