"""Literal expectations for text, numbers and extraction."""

import json

from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import extract as X
from sightline.functions import html as H
from sightline.functions import numeric as N
from sightline.functions import text as T
from sightline.operators import extraction as E


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_layout_terms(spark):
    text = "三房,四室,3 bedrooms,開放式,五居室,four beds,Studio,3房"
    assert values(spark, [text], T.normalize_layout_terms) == [["3房", "4房", "开放式", "5房"]]


def test_canonical_layout(spark):
    texts = ["一房", "兩房一廳", "三房", "四房", "2 bedroom", "two-bedroom", "three bedrooms", "两居室", "十二房", "Loft  X", None]
    assert values(spark, texts, T.canonical_layout) == ["1房", "2房", "3房", "4房", "2房", "2房", "3房", "2房", "12房", "Loft X", ""]
    assert values(spark, ["open-plan", "STUDIO", "garden", None], T.layout_bedroom_count) == [0, 0, None, None]


def test_area_names_match_across_scripts(spark):
    pairs = [("屯门", "屯門"), ("长洲", "長洲"), ("大屿山", "大嶼山"), ("赤鱲角", "赤鱲角"), ("南丫岛", "南丫島"), ("铜锣湾", "銅鑼灣"), ("启德", "啟德")]
    left = values(spark, [a for a, _ in pairs], T.normalize_text)
    assert left == values(spark, [b for _, b in pairs], T.normalize_text)
    for (a, b), variants in zip(pairs, values(spark, [a for a, _ in pairs], T.text_variants)):
        assert b in variants and a in variants
    assert values(spark, ["粉岭新区"], T.text_variants) == [["粉岭新区", "粉嶺新區", "粉岭新區"]]


def test_normalize_uses_nfkc_and_unicode_space(spark):
    texts = ["ＡＢ１　Ｃ", "ﬁne ½", "a\u001fb c", "（樓）·【層】"]
    assert values(spark, texts, T.normalize_text) == ["ab1c", "fine1⁄2", "abc", "楼层"]
    assert values(spark, texts[:1], T.normalize_loose) == ["AB1 C"]
    assert T.fold_term("（樓） ·ＡＢ") == "楼ab"


def test_numbers(spark):
    assert values(spark, ["租 $ 17,000 x", "none", "1 234"], T.parse_int) == [17000, None, 1234]
    assert values(spark, ["十", "二十", "十五", "三十二", "九", "壹", "12", "百", ""], T.parse_chinese_int) == [10, 20, 15, 32, 9, 1, 12, None, None]
    assert values(spark, ["1,2，3+4＋5/6、7\n 8 ,,"], T.split_terms) == [list("12345678")]
    assert values(spark, ["12", "3.9", "-2.5", "x", None], N.int_or_none) == [12, 3, -2, None, None]


def test_rounding_follows_the_binary_value(spark):
    pairs = [(r, a) for r in range(5000, 30000, 7) for a in range(200, 900, 41)]
    df = spark.createDataFrame(pairs, "r int, a int")
    got = df.select("r", "a", N.derived_psf(F.lit(None).cast("double"), F.col("r"), F.col("a")).alias("p")).collect()
    assert [x for x in got if x.p != round(x.r / x.a, 2)] == []


def test_years_by_birthday(spark):
    texts = ["2000-02-29", "2000-02-28T00:00:00Z", "2030-01-01", "2000-13-01", "soon", None]
    as_of = F.to_date(F.lit("2024-02-28"))
    assert values(spark, texts, lambda c: N.age_from_iso_date(c, as_of)) == [23, 24, 0, None, None, None]


def test_steps_and_notes(spark):
    steps = spark.createDataFrame([(v,) for v in (-1.0, 0.5, 300.0, 600.0, 41000.0, 1000.0)], "v double")
    assert [r[0] for r in steps.select(N.nice_step(F.col("v"))).collect()] == [1000, 500, 500, 1000, 50000, 1000]
    assert values(spark, ["11800", "31000"], lambda c: N.action_note(
        F.lit(None).cast("double"), c.cast("int"), F.lit(1), F.lit(5.0), F.lit(12500))) == ["预算友好", "-"]


TERMS = ["河畔区"]
CARDS = [
    ("centanet", "https://hk.centanet.com/findproperty/detail/crest_QWE777",
     "Harbour Crest 5座 中层 B室 3房 河畔区 15年楼龄 实用 612 呎 @ $41 /呎 租 $ 25,100"),
    ("centanet", "https://hk.centanet.com/findproperty/detail/lake_QWE778", "湖景台 7座 高层 F室 三房 河畔区 实用 588 呎 租 $ 19,800"),
    ("midland", "https://www.midland.com.hk/zh-cn/property/oak-M300900700", "枫林阁 4C座 高层 H室 河畔区 租 $15,125 实用 275呎 $55/呎 开放式 楼盘编号: M300900700"),
    ("midland", "https://www.midland.com.hk/branches", "Opening hours"),
]


def test_cards(spark):
    df = spark.createDataFrame(CARDS, "source_site string, source_url string, text string")
    rows = {r.source_url[-6:]: r for r in E.parse_cards(df, TERMS).collect()}
    assert len(rows) == 3
    a, b, c = rows["QWE777"], rows["QWE778"], rows["900700"]
    assert (a.rent_hkd, a.usable_area_sqft, a.layout, a.district, a.source_listing_id) == (25100, 612, "3房", "河畔区", "QWE777")
    assert "Harbour Crest" in a.estate_name and a.price_per_sqft == 41.0
    assert b.layout == "3房" and b.estate_name == "湖景台"
    assert (c.rent_hkd, c.usable_area_sqft, c.block, c.floor, c.flat, c.source_listing_id) == (15125, 275, "4C座", "高层", "H室", "M300900700")
    assert c.layout == "开放式"


def test_pages(spark):
    anchor = '<ul><li><a href="/findproperty/zh-cn/detail/pier_QWE900?theme=rent">枫林阁 8座 低层 A室 2房 <b>河畔区</b> 实用 455 呎 租 $ 18,200</a></li></ul>'
    text = "<p>示例苑 2座 租 $9,000</p>" + "<p>填充</p>" * 200 + "<p>另一 3座 租 $8,000</p>"
    script = '<script>{"list":[{"estate":"示例苑","rent":"租 $7,000 2房","x":{"Price":"租 $6,000"}}]}</script>'
    site, url = "centanet", "https://hk.centanet.com/findproperty/zh-cn/list/rent"
    pages = [(1, site, url, anchor), (2, "midland", url + "/2", text), (3, "hkp", url + "/3", script), (4, site, url + "/4", "<p>nothing</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, source_site string, source_url string, html string")
    rows = E.page_observations(df, TERMS).orderBy("page_id", "rent_hkd").collect()
    assert [(r.page_id, r.rent_hkd, r.strategy) for r in rows] == [(1, 18200, 0), (2, 9000, 1), (3, 7000, 2)]
    assert rows[0].source_listing_id == "QWE900"
    assert rows[0].source_url == "https://hk.centanet.com/findproperty/zh-cn/detail/pier_QWE900?theme=rent"


def test_strip_tags(spark):
    html = "a<script>x</script>b<style>y</style><br/>c</p> <i>d</i>&nbsp;&lt;e&gt; &amp;amp; \v f</div>\n\n  g"
    assert values(spark, [html], H.strip_tags) == ["a b \nc\nd \xa0<e> &amp; f\ng"]
    assert values(spark, ["<b>x</b>  &amp;amp;y"], H.clean_card_text) == ["x &y"]


def test_state_page(spark):
    post = {"postNo": "CO10020030", "aliasV4": "松濤閣-co10020030-5-hk", "displayTextHk": "松濤閣", "marketPrice": 14200, "saleableArea": 371, "room": 2,
            "publicLocationNamesHk": ["甲行", "村屋", "新界", "大埔", "松濤閣"]}
    body = json.dumps({"POSTS": [post], "POSTSNUMPAGES": 4, "POSTSTOTAL": 37}, ensure_ascii=False).replace('"', "&q;")
    html = f'<p>x</p><script id="serverApp-state" type="application/json">{body}</script>'
    from sightline.sources import landed

    pages = spark.createDataFrame([(1, 1, "ricacorp", "u", html)], landed.PAGE)
    state = landed.state_pages(pages).first()
    assert (state.POSTSNUMPAGES, state.POSTSTOTAL) == (4, 37)
    row = E.items_family_2(landed.state_items(pages), F.to_date(F.lit("2025-02-11"))).first()
    assert (row.source_listing_id, row.rent_hkd, row.usable_area_sqft, row.layout) == ("CO10020030", 14200, 371, "2房")
    assert row.estate_name == "松濤閣" and row.district == "大埔"


def test_objects_with_a_property_key(spark):
    payload = json.dumps({"page": 1, "list": [{"Rent": 7000, "x": {"estate": "松濤閣", "empty": "", "no": None}}, {"z": [["a"], {"price": 5}]}]})
    df = spark.createDataFrame([(payload,), ("{broken",), (None,)], "p string")
    assert [r[0] for r in df.select(H.property_texts("p")).collect()] == [["7000", "松濤閣", "5"], None, None]


def test_personal_columns_are_dropped(spark):
    df = spark.createDataFrame([("demo", "u", "D1", "t", "someone")], "source_site string, source_url string, source_listing_id string, title string, agent_name string")
    assert "agent_name" not in E.clean_observations(df.withColumn("raw", F.lit("{}"))).columns


def test_district_and_ids(spark):
    assert values(spark, ["位於 屯門 x"], lambda c: X.parse_district(c, ["长洲", "屯门"])) == ["屯门"]
    assert values(spark, ["x"], lambda c: X.source_listing_id(F.lit("other"), F.lit("http://a"), c))[0] != ""
    assert set(K.PUSHABLE) == set(K.SITES)


def test_bedroom_numbers(spark):
    assert values(spark, ["2.0", "0", "0.0", "3", "2.5", "x", None], N.layout_from_bedroom) == ["2房", "开放式", "开放式", "3房", None, None, None]


def test_rent_contexts_keep_their_surroundings(spark):
    text = "甲" * 300 + "租 $ 8,100" + "乙" * 300 + "租9000"
    first, second = values(spark, [text], H.rent_contexts)[0]
    assert first == text[40:569] and second == text[349:] and values(spark, ["none", ""], H.rent_contexts) == [[], []]


def test_every_run_of_a_record_is_kept(spark):
    from sightline.sources import landed

    card = '<a href="https://www.midland.com.hk/zh-cn/property/bar-M700000001">河岸轩 5座 低层 C室 2房 实用 412呎 租 $%s</a>'
    rows = [(1, 1, "midland", "u", card % "10,000"), (2, 2, "midland", "u", card % "9,000"), (3, 2, "midland", "u", card % "8,000")]
    got = landed.scan_html(spark.createDataFrame(rows, landed.PAGE), TERMS).collect()
    assert sorted((r.run_id, r.rent_hkd) for r in got) == [(1, 10000), (2, 9000)]


def test_removed_listings_are_those_that_went(spark):
    from sightline.operators import reports

    now, before = (spark.createDataFrame([(i,) for i in ids], "listing_id bigint") for ids in ([2, 3], [1, 2]))
    assert [r.listing_id for r in reports.removed_listings(now, before).collect()] == [1]


def test_parts_are_parsed_in_as_many_tasks_as_there_are_cores(spark, tables):
    """The file of parts is one split, however many of its narrow rows there are."""
    cores = spark.sparkContext.defaultParallelism
    assert tables.table("part").rdd.getNumPartitions() < cores
    for df in (tables.cards, tables.props, tables.units):
        sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= cores and max(sizes) <= sum(sizes) / 3
