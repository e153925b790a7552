"""Lifecycle, history and matching against plain folds written from the rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.operators import current as C
from sightline.operators import filters as FL
from sightline.operators import history as H
from sightline.operators import lifecycle as L
from sightline.operators import matching as M
from sightline.operators import reports as R
from sightline.operators import snapshots as S
from sightline.session import cut

DAY = datetime(2026, 5, 1)
OBS = """obs_id bigint, run_id int, seen_at timestamp, source_site string, source_key string, listing_id bigint, source_url string,
source_listing_id string, rent_hkd int, usable_area_sqft int, price_per_sqft double, title string, estate_name string, block string,
floor string, flat string, layout string, district string"""


def log(seed=1, keys=40, runs=25):
    """A random log: one key holds about a third of all rows."""
    rng, rows = random.Random(seed), []
    for run in range(1, runs + 1):
        for k in range(keys):
            for _ in range(rng.choice([0, 0, 1, 2]) if k else keys // 2):
                rent = rng.choice([None, 0, 9000, 9500, 10000, 8000])
                rows.append((len(rows) + 1, run, DAY + timedelta(days=run), f"s{k % 3}", f"s{k % 3}:{k}", k // 2, f"u{k}", str(k), rent, 300, None,
                             rng.choice(["", "t%d" % k]), None, rng.choice([None, "1座"]), None, "", "1房", None))
    return rows


def gates(runs=25, seed=2):
    rng = random.Random(seed)
    return [(f"s{s}", r, DAY + timedelta(days=r), r > 1 and rng.random() < 0.7) for s in range(3) for r in range(1, runs + 1)]


@pytest.fixture(scope="module")
def data(spark):
    rows, dims = log(), gates()
    obs = spark.createDataFrame(rows, OBS).repartition(5).cache()
    return rows, dims, obs, spark.createDataFrame(dims, "source_site string, run_id int, started_at timestamp, eligible boolean")


def fold(rows, dims):
    state = {}
    for run in sorted({d[1] for d in dims}):
        for r in (r for r in rows if r[1] == run):
            s = state.setdefault(r[4], {"first": r[2], "missing": None, "count": 0, "site": r[3]})
            s.update(active=True, last=r[2], run=run)
        for site, _, at, eligible in (d for d in dims if d[1] == run and d[3]):
            for key, s in state.items():
                if s["site"] == site and s["active"] and s["run"] != run:
                    s.update(active=False, missing=s["missing"] or at, count=s["count"] + 1)
    return {k: (s["first"], s["last"], s["missing"], s["count"], s["active"]) for k, s in state.items()}


def collected(df):
    return {r.source_key: (r.first_seen_at, r.last_seen_at, r.first_missing_at, r.missing_count, r.active) for r in df.collect()}


def test_state_equals_fold(data):
    rows, dims, obs, site_runs = data
    assert collected(L.source_state(L.missing_events(L.sightings(obs), site_runs))) == fold(rows, dims)


def test_incremental_state_equals_rebuild(data):
    rows, dims, obs, site_runs = data
    state = L.source_state(L.missing_events(L.sightings(obs.where("run_id <= 8")), site_runs.where("run_id <= 8")))
    for low, high in ((8, 9), (9, 17), (17, 25)):
        span = f"run_id > {low} and run_id <= {high}"
        state = L.merge_state(state, obs.where(span), site_runs.where(span))
    assert collected(state) == fold(rows, dims)


def test_late_file(data):
    from sightline.streaming.jobs import rebuild_late

    rows, dims, obs, site_runs = data
    early = L.source_state(L.missing_events(L.sightings(obs.where("obs_id % 7 > 0")), site_runs))
    assert collected(rebuild_late(early, obs.where("obs_id % 7 = 0"), obs, site_runs)) == fold(rows, dims)


def test_intervals_give_presence(data):
    rows, dims, obs, site_runs = data
    events = L.missing_events(L.sightings(obs), site_runs)
    cuts = [DAY + timedelta(days=d) for d in (3, 10, 18, 25)]
    got = {(r.cutoff, r.listing_id) for r in S.active_sources(L.presence_intervals(events), cuts).collect()}
    want = set()
    for c in cuts:
        past = fold([r for r in rows if r[2] <= c], [d for d in dims if d[2] <= c])
        want |= {(c, int(k.split(":")[1]) // 2) for k, s in past.items() if s[4]}
    assert got == want
    counts = {r.cutoff: r.active_count for r in S.active_counts(L.presence_intervals(events), cuts).collect()}
    assert counts == {c: sum(1 for w in want if w[0] == c) for c in cuts}


def test_lookup_join_falls_back_to_salting(data):
    from sightline.session import lookup_join

    _, _, obs, site_runs = data
    plain = lookup_join(obs, site_runs, ["source_site", "run_id"], "left", "obs_id")
    salted = lookup_join(obs, site_runs, ["source_site", "run_id"], "left", "obs_id", rows=3)
    assert sorted(plain.collect(), key=str) == sorted(salted.collect(), key=str)


def rents(rows):
    last, down = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[8] is not None and last.get(r[5]) is not None and r[8] < last[r[5]]:
            down.append((r[0], last[r[5]]))
        last[r[5]] = r[8] or last.get(r[5])
    return down


@pytest.mark.parametrize("segment", [1, 3, 1 << 18])
def test_rent_decreases_equal_fold(data, monkeypatch, segment):
    monkeypatch.setattr(H, "SEGMENT", segment)
    rows, _, obs, _ = data
    assert sorted((r.obs_id, r.prev_rent) for r in H.rent_decreases(obs).collect()) == sorted(rents(rows))


def test_rent_history_literal(spark):
    rows = [(i, i, DAY + timedelta(days=i), "a", "a:1", 1, "u", "1", r, 306, None, "", None, None, None, None, None, None) for i, r in ((1, 18000), (2, 17500))]
    r = H.rent_history(spark.createDataFrame(rows, OBS)).first()
    assert (r.ever_rent_decreased, r.max_seen_rent_hkd, r.min_seen_rent_hkd, r.first_rent_decrease_at) == (True, 18000, 17500, DAY + timedelta(days=2))


def test_listings_keep_first_known_and_latest_nonzero(data):
    rows, _, obs, site_runs = data
    state = L.source_state(L.missing_events(L.sightings(obs), site_runs))
    got = {r.listing_id: r for r in H.listings(obs, state).collect()}
    for lid in {r[5] for r in rows}:
        mine = [r for r in rows if r[5] == lid]
        assert got[lid].block == next((r[13] for r in mine if r[13]), None)
        assert got[lid].title == next((r[11] for r in mine if r[11]), None)
        assert got[lid].last_rent_hkd == next((r[8] for r in reversed(mine) if r[8]), None)
        assert got[lid].sources_count == len({r[4] for r in mine})


UNIT = "id bigint, estate_name string, block string, floor string, flat string, layout string, usable_area_sqft int, rent_hkd int"


def units(seed, n):
    rng = random.Random(seed)

    def some(*xs):
        return rng.choice([None, *xs, *xs])

    base = [(some("甲苑", "乙苑"), some("1座", "2座"), some("高層", "低层"), some("A室", "B室"), some("1房", "2房"), some(300, 400), some(0, 9000, 9400, 9900, 10350, 20000)) for _ in range(n)]
    return [(i, *(base[i % max(1, n // 3)] if i % 3 == 0 else base[i])) for i in range(n)]


def strict(a, b):
    if not a[7] or not b[7] or abs(a[7] - b[7]) > 500:
        return False
    both = [(x, y) for x, y in zip(a[1:7], b[1:7]) if x and y]
    return len(both) >= 3 and all(x == y for x, y in both)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    rows = units(seed, 150)
    got = {r.id: r for r in M.match_summary(M.with_fields(spark.createDataFrame(rows, UNIT)), "id").collect()}
    for a in rows:
        others = [b[0] for b in rows if b[0] != a[0] and strict(a, b)]
        own = [a[0]] if strict(a, a) else []
        assert (got[a[0]].matches, got[a[0]].first_match) == (len(others), min(others + own, default=a[0]))


def test_best_candidate_prefers_active_then_recent(spark):
    rows = units(5, 120)
    old = [(*r, r[0], r[0] % 3 > 0, DAY + timedelta(days=r[0] % 4)) for r in units(6, 120)]
    listing = M.with_fields(spark.createDataFrame(old, UNIT + ", listing_id bigint, active boolean, last_seen_at timestamp"))
    got = {r.id: r.candidate_id for r in M.best_candidate(M.with_fields(spark.createDataFrame(rows, UNIT)), listing).collect()}
    for a in rows:
        found = [b for b in old if strict(a, b)]
        best = min(found, key=lambda b: (not b[9], -b[10].timestamp(), b[8]), default=None)
        assert got[a[0]] == (best[8] if best else None)


def test_leaders_equal_greedy(spark):
    rows = units(7, 150) + [(1000 + i, "甲苑", "9座", "高層", "Z室", "1房", 300, 9000 + 400 * i) for i in range(6)]
    got = {r.id: r.leader for r in M.leaders(M.with_fields(spark.createDataFrame(rows, UNIT)), "id").collect()}
    leaders = []
    for a in rows:
        found = next((b for b in leaders if strict(a, b)), None)
        if found is None:
            leaders.append(a)
        assert got[a[0]] == (found or a)[0]


def observation(key, rent, block="12座", flat="K室", area=488):
    return (key, "河岸轩", block, "低层", flat, "2房", area, rent)


CASES = [
    (observation("p:4", 21000), observation("q:9", 21500), True),
    (observation("p:4", 21000), observation("q:9", 20499), False),
    (observation("p:4", 21000, "12座"), observation("q:9", 21000, "14座"), False),
    (observation("p:4", 21000), observation("q:9", 21000, area=480), False),
    (observation("p:4", 21000, flat=None), observation("p:5", 20700), True),
    (observation("p:4", 21000), observation("p:4", 9000, "14座"), True),
]


def test_resolution_literals(spark):
    """All cases at once, each with an estate and sources of its own: first in one batch, then over two."""
    from sightline.operators.extraction import observation_identity

    rows = []
    for n, (first, second, _) in enumerate(CASES):
        for side, (key, estate, *rest) in enumerate((first, second)):
            rows.append((2 * n + side, f"{key}-{n}", f"{estate}{n}号", *rest))
    schema = "obs_id bigint, source_key string, estate_name string, block string, floor string, flat string, layout string, usable_area_sqft int, rent_hkd int"
    both = spark.createDataFrame(rows, schema)
    both = both.withColumn("identity_key", observation_identity(both))
    shape = both.withColumn("listing_id", F.col("obs_id")).withColumn("active", F.lit(True)).withColumn("last_seen_at", F.lit(DAY))
    no_state = spark.createDataFrame([], "source_key string, listing_id bigint")
    got = {r.obs_id: r.listing_id for r in M.resolve_batch(both, no_state, shape.limit(0)).collect()}
    old = shape.where("obs_id % 2 = 0")
    later = M.resolve_batch(both.where("obs_id % 2 = 1"), old.select("source_key", "listing_id"), old)
    later = {r.obs_id: r.listing_id for r in later.collect()}
    for n, (_, _, same) in enumerate(CASES):
        assert (got[2 * n] == got[2 * n + 1]) is same, n
        assert (later[2 * n + 1] == 2 * n) is same, n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matching_broadcasts_no_side_that_grows(spark):
    rows = M.with_fields(spark.createDataFrame(units(5, 60), UNIT))
    listing = rows.withColumns({"listing_id": F.col("id"), "active": F.lit(True), "last_seen_at": F.lit(DAY)})
    keyed = rows.withColumns({"source_key": F.col("id").cast("string"), "identity_key": F.col("f_estate")})
    found = [
        M.match_summary(rows, "id"), M.best_candidate(rows, listing), M.known_source(keyed, keyed.withColumn("listing_id", F.col("id"))),
        M.same_identity(keyed, listing.withColumn("identity_key", F.col("f_estate"))),
    ]
    for df in found:
        assert "Broadcast" not in _plan(df)


def test_neighbours_broadcast_no_side_that_grows(spark):
    from types import SimpleNamespace

    from checks.state_queries import _neighbours

    rows = units(7, 80)
    want = set()
    for field in range(1, 6):
        for value in {r[field] for r in rows} - {None}:
            near = sorted((r for r in rows if r[field] == value), key=lambda r: (r[7] or 0, r[0]))
            want |= {(a[0], b[0], strict(a, b)) for n, a in enumerate(near) for b in near[n + 1 : n + 3]}
    found = _neighbours(SimpleNamespace(units=cut(spark.createDataFrame(rows, UNIT))))  # files have a size to guess from
    assert "Broadcast" not in _plan(found)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want and {True, False} == {r[2] for r in got}
    assert "Broadcast" not in _plan(found)  # as it ran


def test_rents_and_listings_broadcast_no_side_that_grows(spark):
    obs = cut(spark.createDataFrame(log(), OBS))  # files have a size to guess from
    named = obs.groupBy("listing_id").agg(F.struct(F.min("estate_name").alias("estate_name"), F.min("source_key").alias("source_key")).alias("created"))
    for df in (H.previous_rent(obs), H.with_identity(named)):
        assert "Broadcast" not in _plan(df)


def test_missing_gate(spark):
    rows = [("initial", 0, 5), ("daily", 1, 5), ("daily", 0, 0), ("daily", 0, 1)]
    df = spark.createDataFrame(rows, "mode string, errors int, n int")
    gate = [r[0] for r in df.select(L.missing_gate(F.col("mode"), F.col("errors"), F.col("n"))).collect()]
    assert gate == [False, False, False, True]
    assert df.select(L.missing_gate(F.col("mode"), F.col("errors"), F.col("n"), safe=False)).collect()[2][0] is True


SEARCH = "source_site string, title string, estate_name string, district string, layout string, rent_hkd int, usable_area_sqft int, gross_area_sqft int, building_age_years int, price_per_sqft double"


def kept(spark, filters, terms=("河畔区",), **changes):
    row = {"source_site": "hkp", "title": "河畔区 湖景台 7座 中层 F室 2房", "estate_name": "湖景台", "district": "河畔区", "layout": "2房",
           "rent_hkd": 23500, "usable_area_sqft": 430, "gross_area_sqft": 560, "building_age_years": 12, "price_per_sqft": 54.65} | changes
    df = spark.createDataFrame([row], SEARCH)
    return FL.filter_observations(df, filters, list(terms)).count() == 1


def test_filters(spark):
    area = FL.Filters(max_rent=26000, min_area=420, max_area=600, layouts=["2房"])
    assert kept(spark, area)
    assert not any(kept(spark, area, usable_area_sqft=v) for v in (419, 601, None))
    psf = FL.Filters(min_psf=50, max_psf=58)
    assert kept(spark, psf) and not any(kept(spark, psf, price_per_sqft=v) for v in (49.99, 58.01, None))
    assert kept(spark, FL.Filters(max_rent=9000), rent_hkd=None)
    words = FL.Filters(keywords=["中层", "F室"])
    assert kept(spark, words) and not kept(spark, words, title="河畔区 湖景台 7座 中层 G室 2房")
    assert not kept(spark, FL.Filters(excluded_estates=["湖景台"]))
    assert kept(spark, FL.Filters(layouts=["开放式"]), terms=["屯门", "屯門"], title="屯門 湖景台", district="屯門", layout="开放式")


def market(spark, rents):
    return spark.createDataFrame([(r,) for r in rents], "rent_hkd int")


def test_percentile_and_bands(spark):
    five = market(spark, [12000, 19500, 27000, 41000, 76000])
    assert R.rent_percentile(five).first()[0] == 19500
    bands = R.rent_bands(five).orderBy("band").collect()
    assert [(b.rent_lower, b.rent_upper) for b in bands] == [(None, 20000), (20001, 40000), (40001, 60000), (60001, None)]
    assert [b.rent_band for b in bands] == ["<=$20,000", "$20,001-$40,000", "$40,001-$60,000", ">$60,000"]
    one = R.rent_bands(market(spark, [9000, 9000])).collect()
    assert [(b.rent_band, b.rent_lower, b.rent_upper) for b in one] == [("$9,000", 9000, 9000)]
    close = R.rent_bands(market(spark, [9001, 9002])).collect()
    assert [(b.rent_band, b.rent_lower, b.rent_upper) for b in close] == [("$9,001-$9,002", 9001, 9002)]
    assert R.rent_bands(market(spark, [None])).count() == 0
    placed = R.with_band(market(spark, [12000, 25000, 900000, None]), five)
    assert {r.rent_hkd: r.band for r in placed.collect()} == {12000: 0, 25000: 1, 900000: 3, None: None}


def test_rent_reference_falls_back_to_current_rows(spark):
    cols = "listing_id bigint, layout string, {}rent_hkd int, usable_area_sqft int, {}price_per_sqft double"
    listings = spark.createDataFrame([(1, "1房", 9000, 300, 30.0), (2, "2房", None, 400, None)], cols.format("last_", "last_"))
    current = spark.createDataFrame([(1, "1房", 9500, 300, 31.7), (2, "2房", 14000, 400, 35.0), (3, "2房", None, 400, None)], cols.format("", ""))
    assert [r.rent_hkd for r in R.rent_reference(listings, current).collect()] == [9000]
    assert sorted(r.rent_hkd for r in R.rent_reference(listings.where("listing_id = 2"), current).collect()) == [9500, 14000]
    assert R.rent_reference(listings.limit(0), current.limit(0)).count() == 0


def test_stale_watchlist_literal(spark):
    row = [(7, 11800, 38.0, "3房", datetime(2025, 3, 3), 2)]
    df = spark.createDataFrame(row, "listing_id bigint, rent_hkd int, price_per_sqft double, layout string, first_seen_at timestamp, active_source_count bigint")
    got = R.stale_watchlist(df, datetime(2025, 4, 20), 12500).collect()
    assert len(got) == 1 and "预算友好" in got[0].action_note


def test_completeness(spark):
    rows = [(1, "a", 1, 250, 100), (1, "a", 2, 250, 100), (1, "b", 1, 0, 100)]
    got = {r.source_site: (r.pages_due, r.pages_seen, r.complete) for r in C.page_completeness(
        spark.createDataFrame(rows, "run_id int, source_site string, page int, total bigint, page_size int")).collect()}
    assert got == {"a": (3, 2, False), "b": (1, 1, True)}


def test_counts_by_sweep_against_brute_force(spark):
    import random
    from datetime import datetime, timedelta

    from sightline.operators import snapshots as S

    rng, day = random.Random(9), datetime(2024, 1, 1)
    at = [day + timedelta(days=n) for n in range(12)]
    rows = []
    for _ in range(300):
        a, b = sorted(rng.sample(range(12), 2))
        rows.append((rng.randrange(25), "s", "u", at[a], at[b] if rng.random() < 0.8 else None))
    spans = spark.createDataFrame(rows, "listing_id long, source_site string, source_url string, start_at timestamp, end_at timestamp")
    cutoffs = [day + timedelta(hours=12 * n) for n in range(-1, 26)]
    want = {c: len({r[0] for r in rows if r[3] <= c and (r[4] is None or r[4] > c)}) for c in cutoffs}
    assert {r.cutoff: r.active_count for r in S.active_counts(spans, cutoffs).collect()} == want
    table = spark.createDataFrame([(c,) for c in cutoffs], "cutoff timestamp")
    assert {r.cutoff: r.active_count for r in S.active_counts(spans, table).collect()} == want
    state = [(i % 9, at[i % 5], at[5 + i % 3] if i % 2 else None, at[8 + i % 3], i % 4 != 1) for i in range(40)]
    frame = spark.createDataFrame(state, "listing_id long, first_seen_at timestamp, first_missing_at timestamp, last_seen_at timestamp, active boolean")
    want = {c: len({r[0] for r in state if r[1] <= c and (r[2] is None or r[2] > c or r[4] and r[3] <= c)}) for c in cutoffs}
    assert {r.cutoff: r.active_count for r in S.active_counts(frame, cutoffs).collect()} == want
