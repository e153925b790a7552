"""Source-run ledger and the scan of landed pages, on small runs written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import extraction as E
from sightline.operators import ledger as G
from sightline.operators.filters import Filters
from sightline.plans import scan as S
from sightline.session import new_path
from sightline.sources import landed


def test_ledger_counts_lost_broken_and_barred_pages(spark):
    facts = [
        (1, "a", 1, 10, 25, 10, None, None), (1, "a", 2, 0, None, None, None, G.NOT_FETCHED), (1, "a", 2, 10, 25, 10, None, None),
        (1, "a", 3, 5, 25, 10, None, None),  # complete, the second page at the second attempt
        (1, "b", 1, 3, None, 10, 3, None), (1, "b", 3, 0, None, 10, 3, G.NO_ROWS),  # the second page is lost, the third one empty
        (1, "c", 1, 4, 0, 0, None, None),
    ]
    facts = spark.createDataFrame(facts, G.FACTS)
    planned = spark.createDataFrame([(1, s, s != "d", 1) for s in "abcde"], "run_id int, source_site string, allowed boolean, pages_planned bigint")
    rows = spark.createDataFrame([(1, "a", 25, 20), (1, "b", 3, 3), (1, "c", 4, 0)], "run_id int, source_site string, raw_observations bigint, filtered_observations bigint")
    runs = spark.createDataFrame([(1, "2024-01-02 00:00:00", "daily")], "run_id int, started_at string, mode string")
    book = G.source_runs(planned, facts, rows, runs)
    got = {r.source_site: (r.pages_due, r.pages_seen, r.pages_broken, r.pages_lost, r.errors, r.ok, r.eligible) for r in book.collect()}
    assert got == {
        "a": (3, 3, 0, 0, 0, True, True), "b": (3, 1, 1, 1, 2, True, False), "c": (1, 1, 0, 0, 0, True, False),
        "d": (0, 0, 0, 0, 1, False, False), "e": (1, 0, 0, 1, 1, False, False),
    }
    assert {r.source_site: r.eligible for r in G.source_runs(planned, facts, rows, runs, safe=False).collect()}["c"]
    problems = {tuple(r) for r in G.problem_counts(facts, book).collect()}
    assert problems == {(1, "b", G.NO_ROWS, 1), (1, "b", G.LOST, 1), (1, "e", G.LOST, 1), (1, "d", G.NOT_ALLOWED, 1)}
    result = G.run_results(book).first()
    assert (result.errors, result.status, result.filtered_observations) == (4, "partial", 23)


def test_a_row_without_room_for_its_number_stops_the_job(spark):
    rows = spark.createDataFrame([(3, 2, 5, 7), (3, 2, 5, 8), (4, 0, 1, 0)], "run_id int, site_no int, page bigint, pos int")
    ids = [r[0] for r in rows.select(S.obs_id()).collect()]
    assert ids == sorted(set(ids)) and ids[0] == ((3 << 7 | 2) << 24 | 5) << 14 | 7
    with pytest.raises(Exception, match="no obs_id"):
        spark.createDataFrame([(1, 0, 1 << 24, 0)], rows.schema).select(S.obs_id()).collect()


def _item(number, rent, area=400, name="Garden"):
    return {
        "serial_no": number, "url_desc": f"https://a.example/{number}", "estate": {"name": f"{name} {number}"}, "building": {"name": f"{number}座"},
        "floor_level": {"name": "中層"}, "flat": "C", "bedroom": "2", "rent": str(rent), "net_area": str(area),
    }


def _land(spark, rows):
    path = new_path(spark, "landing")
    spark.createDataFrame(rows, landed.LANDED).write.partitionBy("run_id").parquet(path)
    return landed.read_landing(spark, path)


def _page(run, site, number, items, total, **odd):
    row = {"run_id": run, "source_site": site, "family": landed.RESULT, "page": number, "source_url": "u", "error": None,
           "body": json.dumps({"count": total, "result": items}), **odd}
    return tuple(row[c.split(" ")[0]] for c in landed.LANDED.split(", "))


def test_scan_of_runs_with_errors(spark):
    card = '<a href="/findproperty/detail/foo_ABC123?theme=rent">Sky Court 1座 高層 G室 1房 实用 380 呎 租 $ 19,500</a>'
    landing = _land(spark, [
        _page(1, "hkp", 1, [_item("H1", 18000), _item("H2", 9000), _item("H3", 30000, 500)], 3),
        (1, "centanet", landed.HTML, 1, "https://hk.centanet.com/x", None, card),
        _page(2, "hkp", 1, [_item("H1", 17500)], 12),  # a second page was declared and never landed
        (2, "centanet", landed.HTML, 1, "https://hk.centanet.com/x", None, card.replace("19,500", "18,500")),
        _page(3, "hkp", 1, [_item("H3", 30000, 500)], 1),
        (3, "centanet", landed.HTML, 1, "https://hk.centanet.com/x", "timed out", None),
    ])
    folder = new_path(spark, "scan")
    scope = S.Scope(Filters(min_rent=10000), page_size=10)
    runs = [S.Run(n, f"2024-03-0{n} 00:00:00", "initial" if n == 1 else "daily", ("hkp", "centanet")) for n in (1, 2, 3)]
    with pytest.raises(ValueError, match="no run has finished"):
        S.read(spark, folder, "state")
    assert S.scan(spark, landing, runs[0], scope, folder)
    spark.range(3).write.parquet(f"{folder}/state/run-000002-left-behind")  # by an attempt that failed
    assert [S.scan(spark, landing, r, scope, folder) for r in (runs[1], runs[1], runs[2], runs[0])] == [True, False, True, False]

    log = S.read(spark, folder, "observations").select("run_id", "source_listing_id", "rent_hkd", "listing_id", "obs_id").collect()
    seen = sorted((r.run_id, r.source_listing_id, r.rent_hkd) for r in log)
    assert seen == [(1, "ABC123", 19500), (1, "H1", 18000), (1, "H3", 30000), (2, "ABC123", 18500), (2, "H1", 17500), (3, "H3", 30000)]
    assert len({r.obs_id for r in log}) == 6 and len({r.listing_id for r in log}) == 3
    state = {r.source_listing_id: (r.active, r.missing_count, r.last_run_id) for r in S.read(spark, folder, "state").collect()}
    # run 2 lost a page of hkp, so H3 was not marked; run 3 marked H1, and centanet landed nothing
    assert state == {"H1": (False, 1, 2), "H3": (True, 0, 3), "ABC123": (True, 0, 2)}
    listings = {r.listing_id: r for r in S.read(spark, folder, "listings").collect()}
    by_source = {r.source_listing_id: listings[r.listing_id] for r in log}
    assert by_source["H1"].ever_rent_decreased and not by_source["H1"].active and by_source["H1"].last_rent_hkd == 17500
    assert by_source["H3"].active and by_source["ABC123"].min_seen_rent_hkd == 18500
    valid = {(r.run_id, r.source_site): (r.ok, r.errors, r.raw_observations, r.rejected_observations, r.missing_sources_marked) for r in S.validation(spark, folder).collect()}
    assert valid == {
        (1, "hkp"): (True, 0, 3, 1, 0), (1, "centanet"): (True, 0, 1, 0, 0), (2, "hkp"): (True, 1, 1, 0, 0), (2, "centanet"): (True, 0, 1, 0, 0),
        (3, "hkp"): (True, 0, 1, 0, 1), (3, "centanet"): (False, 1, 0, 0, 0),
    }
    assert {r.run_id: r.status for r in S.manifests(spark, folder).collect()} == {1: "ok", 2: "partial", 3: "partial"}


def test_a_page_seen_again_in_a_later_run_keeps_its_rows(spark):
    rows = [(1, run, "hkp", "https://h.example/", f"<a href='/property/hABC1'>Sky 2房 实用 300 呎 租 ${rent}</a>") for run, rent in ((1, "10,000"), (2, "9,000"))]
    pages = spark.createDataFrame(rows, "page_id bigint, run_id int, source_site string, source_url string, html string")
    assert sorted((r.run_id, r.rent_hkd) for r in landed.scan_html(pages, []).collect()) == [(1, 10000), (2, 9000)]


def test_a_script_nested_too_deeply_is_left_out(spark):
    deep = '<script>{"a":' + "[" * 100_000 + "]" * 100_000 + "}</script><script>{\"price\": 5, \"rent\": 8000, \"area\": \"租 $8,000 300呎\"}</script>"
    pages = spark.createDataFrame([(1, 1, "hkp", "u", deep)], "page_id bigint, run_id int, source_site string, source_url string, html string")
    assert all(len(r.text) < 1000 for r in E.script_texts(pages).collect())


def test_broken_json_pages_are_named(spark, tmp_path):
    good = json.dumps({"run_id": 1, "source_site": "hkp", "page": 1, "count": 1, "result": [_item("H1", 9000)]})
    (tmp_path / "pages.json").write_text("\n".join([good, good[:-9], '{"run_id": 1, "source_site": "hkp", "page": 3, "count": 1}']))
    pages = landed.read_result_pages(spark, str(tmp_path)).select("page", "problem").cache()
    assert sorted(map(str, (r.problem for r in pages.collect()))) == sorted(map(str, (None, G.UNREADABLE, G.NO_LIST)))
    assert landed.items(landed.read_result_pages(spark, str(tmp_path))).select(F.col("item.serial_no")).first()[0] == "H1"


def test_contexts_of_many_rents(spark):
    from sightline import constants as K
    from sightline.functions import html as H

    text = "".join(f"unit {i} 租 ${8000 + i} near the park " for i in range(3000))
    found = spark.createDataFrame([(text,)], "t string").select(H.rent_contexts(F.col("t")).alias("c")).first().c
    assert len(found) == 3000
    at = text.index("租 $8100")
    mine = next(c for c in found if "租 $8100" in c[K.CONTEXT_CHARS : K.CONTEXT_CHARS + 12])
    assert mine[: K.CONTEXT_CHARS] == text[at - K.CONTEXT_CHARS : at]
