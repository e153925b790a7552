"""Sections B, C, D and E: text, numbers, extraction and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixtures import FILTERS, TERMS, Tables
from checks.oracle import canonical, cn_int, key, loose, psf, rooms, sha
from checks.registry import register
from sightline import constants as K
from sightline.functions import extract as X
from sightline.functions import html as H
from sightline.functions import numeric as N
from sightline.functions import text as T
from sightline.operators import extraction as E
from sightline.operators import filters as FL


def _cards(col):
    return lambda t: t.cards.select("card_id", col())


def c(name: str):
    return F.col(name)


# B: normalisation. Documents and derived cards hold no character that NFKC changes.
register("b1_normalize_text", lambda t: t.table("documents").select("doc_id", F.sha1(T.normalize_text(c("text")).cast("binary")).alias("key")),
         f"SELECT doc_id, sha1({key('text')}) AS key FROM documents")
register("b1_normalize_card_text", _cards(lambda: T.normalize_text(c("text")).alias("key")), f"SELECT card_id, {key('text')} AS key FROM cards")
register("b2_normalize_loose", lambda t: t.table("documents").select("doc_id", F.sha1(T.normalize_loose(c("text")).cast("binary")).alias("text_hash")),
         f"SELECT doc_id, sha1({loose('text')}) AS text_hash FROM documents")
register("b2_normalize_loose_cards", _cards(lambda: T.normalize_loose(c("text")).alias("loose")), f"SELECT card_id, {loose('text')} AS loose FROM cards")
_AREA = lambda: F.when(c("id") % 3 == 0, F.concat(c("district"), F.lit("新区"))).otherwise(c("district"))
_AREA_SQL = "CASE WHEN id % 3 = 0 THEN district || '新区' ELSE district END"


def _distinct(listing: str) -> str:
    """Ordered distinct non-empty elements of a list."""
    return f"array_to_string(list_filter({listing}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({listing}, x) = i), ',')"


def _variants_sql(x: str) -> str:
    forms = [x, f"translate({x}, '{K.TRAD}', '{K.SIMP}')", f"translate({x}, '{K.BACK_FROM}', '{K.BACK_TO}')",
             f"CASE WHEN {x} LIKE '%新区' THEN left({x}, length({x}) - 2) || '新區' END",
             f"CASE WHEN {x} LIKE '%新區' THEN left({x}, length({x}) - 2) || '新区' END"]
    return "[" + ", ".join(forms) + "]"


register("b3_text_variants", lambda t: t.props.select("id", F.array_join(T.text_variants(_AREA()), ",").alias("variants")),
         f"SELECT id, {_distinct('v')} AS variants FROM (SELECT id, {_variants_sql('a')} AS v FROM (SELECT id, coalesce({_AREA_SQL}, '') AS a FROM props))")
register("b4_area_terms", lambda t: t.props.select("id", F.array_join(T.area_terms(_AREA(), F.array(F.coalesce("estate", F.lit("")), F.lit("灣仔"))), ",").alias("terms")),
         f"""SELECT id, {_distinct('v')} AS terms FROM (SELECT id, list_concat(list_concat({_variants_sql('a')}, {_variants_sql('e')}), {_variants_sql("'灣仔'")}) AS v
             FROM (SELECT id, coalesce({_AREA_SQL}, '') AS a, coalesce(estate, '') AS e FROM props))""")
_LIST = lambda: F.concat_ws("", F.lit(" 一房,"), c("phase"), F.lit("＋"), c("floor"), F.lit("/ /"), c("bedroom"), F.lit("房、studio\n"), c("num"), F.lit(" bedrooms,兩房"))
_LIST_SQL = "concat_ws('', ' 一房,', phase, '＋', floor, '/ /', bedroom, '房、studio', chr(10), num, ' bedrooms,兩房')"
_SPLIT_SQL = "list_filter(list_transform(regexp_split_to_array(x, '[,，+＋/、\\n]+'), lambda s: trim(s)), lambda s: s <> '')"
register("b5_split_terms", lambda t: t.props.select("id", F.array_join(T.split_terms(_LIST()), "|").alias("terms")),
         f"SELECT id, array_to_string({_SPLIT_SQL}, '|') AS terms FROM (SELECT id, {_LIST_SQL} AS x FROM props)")
_NUMERAL = lambda: F.translate(F.concat(F.when(c("id") % 3 == 0, F.lit("十")).otherwise(F.lit("")), F.when(c("id") % 7 > 0, (c("id") % 10).cast("string")).otherwise("")), "0123456789", "零一二兩四五陆七八九")
_NUMERAL_SQL = "translate(CASE WHEN id % 3 = 0 THEN '十' ELSE '' END || CASE WHEN id % 7 > 0 THEN CAST(id % 10 AS VARCHAR) ELSE '' END, '0123456789', '零一二兩四五陆七八九')"
register("b6_parse_chinese_int", lambda t: t.props.select("id", _NUMERAL().alias("numeral"), T.parse_chinese_int(_NUMERAL()).alias("value")),
         f"SELECT id, n AS numeral, {cn_int('n')} AS value FROM (SELECT id, {_NUMERAL_SQL} AS n FROM props)")
register("b7_bedroom_count", _cards(lambda: T.layout_bedroom_count(c("text")).alias("rooms")), f"SELECT card_id, {rooms('t')} AS rooms FROM loosec")
_LAYOUT = lambda: F.when(c("id") % 4 == 0, F.concat_ws("", c("bedroom"), F.lit(" bedrooms"))).when(c("id") % 4 == 1, F.concat(_NUMERAL(), F.lit("房一廳"))).when(
    c("id") % 4 == 2, F.lit("two-bedroom flat")).otherwise(F.concat_ws(" ", F.lit("Open  Plan"), c("floor")))
_LAYOUT_SQL = f"""CASE id % 4 WHEN 0 THEN concat_ws('', bedroom, ' bedrooms') WHEN 1 THEN {_NUMERAL_SQL} || '房一廳' WHEN 2 THEN 'two-bedroom flat'
    ELSE concat_ws(' ', 'Open  Plan', floor) END"""
register("b8_canonical_layout", lambda t: t.props.select("id", T.canonical_layout(_LAYOUT()).alias("layout")),
         f"SELECT id, {canonical('x')} AS layout FROM (SELECT id, {loose(_LAYOUT_SQL)} AS x FROM props)")
register("b9_layout_terms", lambda t: t.props.select("id", F.array_join(T.normalize_layout_terms(_LIST()), ",").alias("layouts")),
         f"""SELECT id, string_agg(l, ',' ORDER BY i) AS layouts FROM (SELECT id, l, min(i) AS i FROM (SELECT id, i, {canonical('y')} AS l FROM
             (SELECT id, i, {loose('s[i]')} AS y FROM (SELECT id, {_SPLIT_SQL} AS s FROM (SELECT id, {_LIST_SQL} AS x FROM props)), range(1, 12) r(i) WHERE i <= len(s)))
             WHERE l <> '' GROUP BY id, l) GROUP BY id""")
register("b10_parse_int", _cards(lambda: T.parse_int(c("text")).alias("value")),
         "SELECT card_id, TRY_CAST(replace(regexp_extract(replace(text, ' ', ''), '([0-9][0-9,]*)', 1), ',', '') AS INT) AS value FROM cards")
register("b15_derived_psf", lambda t: t.props.select("id", N.derived_psf(F.when(c("id") % 5 == 0, c("psf")), c("rent"), c("area")).alias("price_per_sqft")),
         f"SELECT id, round(coalesce(CASE WHEN id % 5 = 0 THEN psf END, {psf('rent', 'area')}), 6) AS price_per_sqft FROM props")
register("b16_clean_observations", lambda t: E.clean_observations(t.props.select(
            F.col("site").alias("source_site"), F.col("num").alias("source_listing_id"), F.concat(F.lit("u"), "num").alias("source_url"), F.concat_ws("  ", "estate", "district").alias("title"),
            F.col("estate").alias("estate_name"), F.col("building").alias("block"), "floor", "flat", F.col("bedroom").alias("layout"), F.col("rent").alias("rent_hkd"), F.col("area").alias("usable_area_sqft"),
            F.lit("a person").alias("agent_name"))).drop("building", "address", "district", "gross_area_sqft", "building_age_years"),
         f"""SELECT site AS source_site, num AS source_listing_id, 'u' || num AS source_url, nullif({loose("concat_ws('  ', estate, district)")}, '') AS title, {loose('estate')} AS estate_name,
             {loose('building')} AS block, {loose('floor')} AS floor, nullif({loose('flat')}, '') AS flat, bedroom AS layout, rent AS rent_hkd, area AS usable_area_sqft,
             round({psf('rent', 'area')}, 6) AS price_per_sqft, site || ':' || num AS source_key FROM props""")
register("b17_unit_text", lambda t: t.props.select("id", T.unit_text(c("phase"), c("building"), c("floor"), c("flat")).alias("unit"), T.unit_label(c("phase"), c("building"), c("flat")).alias("label")),
         """SELECT id, concat_ws(' ', phase, building, floor, nullif(flat, '')) AS unit, coalesce(nullif(concat_ws(' ', phase, building, nullif(flat, '')), ''), '-') AS label FROM props""")
register("b18_contains_any", _cards(lambda: T.contains_any(c("text"), ["屯門", "BRAND 7", "二期"]).alias("found")),
         f"""SELECT card_id, contains(k, '屯门') OR contains(k, 'brand7') OR contains(k, '二期') AS found FROM (SELECT card_id, {key('text')} AS k FROM cards)""")
register("b19_ratio_close", lambda t: t.props.select("id", N.ratio_close(c("area"), c("gross"), 0.2).alias("close")),
         "SELECT id, coalesce(abs(CAST(area AS DOUBLE) - gross) / greatest(CAST(area AS DOUBLE), gross) <= 0.2, false) AS close FROM props")
_NAMES = " ".join(f"WHEN '{s}' THEN '{e['name']}'" for s, e in K.SITES.items())
register("b20_display_name", lambda t: t.props.select("id", T.display_name(F.when(c("id") % 5 == 0, F.lit("other")).otherwise(c("site"))).alias("name")),
         f"SELECT id, CASE CASE WHEN id % 5 = 0 THEN 'other' ELSE site END {_NAMES} ELSE 'other' END AS name FROM props")
register("b21_source_links", lambda t: t.listings.select("listing_id", T.source_links(c("source_summary")).alias("links")),
         """SELECT listing_id, coalesce(string_agg('[' || source_site || '](' || source_url || ')', ', ' ORDER BY source_site) FILTER (WHERE active), '-') AS links
            FROM state GROUP BY listing_id""")

# C: dates and numbers
register("c1_age_days", lambda t: t.obs.withColumn("started_at", t.runs.where("run_id = 15").select("started_at").scalar()).select("obs_id", N.age_days(c("seen_at"), c("started_at")).alias("age")),
         "SELECT obs_id, round(greatest(0.0, epoch(r.started_at - seen_at) / 86400.0), 6) AS age FROM obs, (SELECT started_at FROM runs WHERE run_id = 15) r")
register("c2_with_age", lambda t: _age(t).select("listing_id", "local_age_days"),
         "SELECT listing_id, round(greatest(0.0, epoch(tgt.c - first_seen_at) / 86400.0), 6) AS local_age_days FROM listings, tgt")
register("c3_lag_bucket", lambda t: t.obs.select("obs_id", N.lag_bucket(F.when(c("obs_id") % 9 > 0, (c("obs_id") % 41).cast("double"))).alias("bucket")),
         "SELECT obs_id, CASE WHEN obs_id % 9 = 0 THEN '未知' WHEN obs_id % 41 <= 7 THEN '0-7天' WHEN obs_id % 41 <= 14 THEN '8-14天' WHEN obs_id % 41 <= 30 THEN '15-30天' ELSE '30天以上' END AS bucket FROM obs")
_ASOF = lambda: F.to_date(F.lit("2024-02-28"))
_YEARS = "greatest(0, 2024 - year({0}) - CAST((2 < month({0}) OR (2 = month({0}) AND 28 < day({0}))) AS INT))"
register("c4_age_from_iso_date", lambda t: t.table("orders").select("o_orderkey", N.age_from_iso_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), _ASOF()).alias("years")),
         f"SELECT o_orderkey, {_YEARS.format('o_orderdate')} AS years FROM orders")
register("c5_age_from_millis", lambda t: t.table("orders").select("o_orderkey", N.age_from_millis(F.unix_millis(c("o_orderdate").cast("timestamp")).cast("string"), _ASOF()).alias("years")),
         f"SELECT o_orderkey, {_YEARS.format('o_orderdate')} AS years FROM orders")
register("c6_int_or_none", lambda t: t.props.select("id", N.int_or_none(c("age_text")).alias("value")),
         "SELECT id, CAST(trunc(TRY_CAST(age_text AS DOUBLE)) AS INT) AS value FROM props")
register("c7_layout_from_bedroom", lambda t: t.props.select("id", N.layout_from_bedroom(c("bedroom")).alias("layout")),
         "SELECT id, CASE WHEN bedroom = '0' THEN '开放式' ELSE bedroom || '房' END AS layout FROM props")
_DISC = "((psf - 45.0) / 45.0 * 100)"
register("c10_action_note", lambda t: t.props.select("id", N.action_note(N.discount_pct(c("psf"), F.lit(45.0)), c("rent"), c("id") % 4, (c("id") % 30).cast("double"), F.lit(9300)).alias("note")),
         f"""SELECT id, coalesce(nullif(concat_ws('、', CASE WHEN {_DISC} <= -5 THEN '尺租低同户型均值 ' || printf('%.0f', abs({_DISC})) || '%' END, CASE WHEN rent <= 9300 THEN '预算友好' END,
             CASE WHEN id % 4 >= 2 THEN '跨来源确认' END, CASE WHEN id % 30 <= 1 THEN '刚出现' END), ''), '-') AS note FROM props""")
register("c11_delta", lambda t: t.props.select("id", N.delta(c("area"), c("gross")).alias("delta")), "SELECT id, area - gross AS delta FROM props")
register("c12_nice_step", lambda t: t.table("orders").select("o_orderkey", N.nice_step(F.when(c("o_orderkey") % 10 > 0, c("o_totalprice") / 7).otherwise(0)).alias("step")),
         """SELECT o_orderkey, CASE WHEN v <= 0 THEN 1000 ELSE CAST(greatest(500, CASE WHEN u >= v THEN u WHEN 2 * u >= v THEN 2 * u WHEN 5 * u >= v THEN 5 * u ELSE 10 * u END) AS BIGINT) END AS step
            FROM (SELECT *, CASE WHEN v > 0 THEN pow(10, floor(log10(v))) END AS u FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_totalprice / 7 ELSE 0 END AS v FROM orders))""")
register("c13_compact_money", lambda t: t.props.select("id", T.compact_money(c("rent")).alias("money")),
         "SELECT id, coalesce('$' || format('{:,}', rent), '-') AS money FROM props")


def _age(t: Tables) -> DataFrame:
    from sightline.operators.reports import with_age
    from sightline.operators.runs import target_run

    return with_age(t.listings, target_run(t.runs).started_at)


# D: extraction from cards and pages
_NOWORD = r"(?:$|[^\p{L}\p{N}_])"
_D = {
    "rent": "coalesce(" + ", ".join(f"regexp_extract_all(t, '(?i){p}', 1)[-1]" for p in K.RENT_PATTERNS) + ")",
    "area": "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in K.AREA_PATTERNS) + ")",
    "psf": "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in K.PSF_PATTERNS) + ")",
    "phrase": "regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in K.LAYOUT_PATTERNS) + r"), '\s+', '', 'g')",
    "floor": f"nullif(regexp_extract(t, '{K.FLOOR_PATTERN}', 1), '')",
    "flat": rf"upper(nullif(concat(regexp_extract(t, '(?i)(?:([A-Z][0-9]?室|[0-9]{{1,3}}室)|([A-Z][0-9]?){_NOWORD})', 1), regexp_extract(t, '(?i)(?:([A-Z][0-9]?室|[0-9]{{1,3}}室)|([A-Z][0-9]?){_NOWORD})', 2)), ''))",
    "block": f"regexp_extract_all(t, '(?i){K.BLOCK_PATTERN}', 1)[-1]",
}


def _num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS INT)"


_LAY = canonical("coalesce(CASE WHEN NOT regexp_matches(ph, '厅|廳') THEN nullif(regexp_extract(ph, '^([0-9一二两兩三四五六七八九十]房)', 1), '') END, ph)")
_TAGS = "|".join(K.MARKETING_TAGS)
_STOPS = ", ".join([f"nullif(strpos(w1, '{s}'), 0)" for s in K.ESTATE_STOPS] + ["nullif(strpos(w1, layout), 0)"])
_IDS = " ".join(
    f"WHEN '{s}' THEN coalesce({', '.join(f'''nullif(upper(regexp_extract(both_, '(?i){p}', 1)), '')''' for p in e['ids'])})" for s, e in K.SITES.items()
)
_strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".format
_ESTATE = {
    "p0": f"SELECT *, {_D['phrase']} AS ph, t AS both0 FROM loosec",
    "p1": f"SELECT *, CASE WHEN ph IS NOT NULL THEN {_LAY} END AS layout, source_url || ' ' || t AS both_, {_num(_D['rent'])} AS rent_hkd, {_num(_D['area'])} AS usable_area_sqft, CAST({_num(_D['psf'])} AS DOUBLE) AS psf0, {_D['floor']} AS floor, {_D['flat']} AS flat, {_D['block']} AS block FROM p0",
    "p2": f"SELECT *, {_strip(f'''regexp_replace(t, '^(?:(?:{_TAGS})\\s*)+', '')''')} AS w0 FROM p1",
    "p3": f"SELECT *, CASE WHEN contains(w0, 'bookmark') THEN {_strip('''substr(w0, strpos(w0, 'bookmark') + 8)''')} ELSE w0 END AS w1 FROM p2",
    "p4": f"SELECT *, list_min([{_STOPS}]) AS stop FROM p3",
    "p5": "SELECT *, CASE WHEN stop IS NOT NULL THEN left(w1, stop - 1) ELSE w1 END AS w2 FROM p4",
    "p6": rf"SELECT *, trim(regexp_replace(regexp_replace(w2, '\b(?:VR|AI)\b', ' ', 'g'), '\s+', ' ', 'g')) AS w3 FROM p5",
    "p7": rf"SELECT *, coalesce(nullif(trim(regexp_extract(w3, '(?i){K.UNIT_PATTERN}', 1)), ''), array_to_string(list_slice(string_split(w3, ' '), 1, 4), ' ')) AS cand FROM p6",
    "p8": r"SELECT *, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cand, '\s+示例区$', ''), '\s+屯门$', ''), '\s+屯門$', ''), '^(?:主页|主頁|网上找房|網上搵樓)\s+', '')), '') AS estate_name FROM p7",
    "cardobs": f"""SELECT card_id, source_site, source_url, t, rent_hkd, usable_area_sqft, layout, floor, flat, block, estate_name,
        coalesce(psf0, {psf('rent_hkd', 'usable_area_sqft')}) AS price_per_sqft, coalesce(CASE source_site {_IDS} END, {sha('source_url')}) AS source_listing_id,
        CASE WHEN contains({key('t')}, '示例区') THEN '示例区' WHEN contains({key('t')}, '屯门') THEN '屯门' END AS district FROM p8""",
}
from checks.oracle import CTES  # noqa: E402

CTES.update(_ESTATE)

_T = lambda: T.normalize_loose(c("text"))


def _field(name, col, sql_col=None):
    register(name[0], lambda t: t.cards.withColumn("t", _T()).select("card_id", col().alias(name[1])), f"SELECT card_id, {sql_col or name[1]} AS {name[1]} FROM cardobs")


register("d1_strip_tags", lambda t: t.table("pages").select("page_id", F.sha1(H.strip_tags(c("html")).cast("binary")).alias("text_hash")),
         r"""SELECT page_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'),
             '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h1|h2|h3|section|article)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g'), '&amp\b;?', chr(1), 'g'),
             '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), chr(1), '&'), '[ \t\r\f\v]+', ' ', 'g'), '\n[\s\v\x{85}\x{A0}]+', chr(10), 'g'), '\n{2,}', chr(10), 'g'),
             '^[\s\v\x{85}\x{A0}]+|[\s\v\x{85}\x{A0}]+$', '', 'g')) AS text_hash FROM pages""")
register("d2_clean_card_text", lambda t: t.cards.select("card_id", H.clean_card_text(F.concat(F.lit("<div><b>"), "text", F.lit("</b><br/>&nbsp;tail &amp; more</div>"))).alias("clean")),
         f"SELECT card_id, {loose('text').replace('translate(text', 'translate(text').replace(f''', '{K.TRAD}', '{K.SIMP}')''', ', chr(0), chr(0))')} || ' tail & more' AS clean FROM cards"
         .replace("translate(text, chr(0), chr(0))", "text"))
_LINKS = r"""SELECT page_id, a, regexp_extract(regexp_extract(a, '(?is)<a\b([^>]*)>', 1), '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) AS h,
    trim(regexp_replace(replace(regexp_replace(regexp_extract(a, '(?is)<a\b[^>]*>(.*?)</a>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS text, url
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS a FROM pages)"""


def _site_pages(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", F.lit("centanet").alias("source_site"), F.col("url").alias("source_url"), F.regexp_replace("html", 'href="/', 'href="/detail/').alias("html"))


register("d3_page_links", lambda t: E.page_links(_site_pages(t)).groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"), F.max("text").alias("last_text")),
         f"SELECT page_id, count(*) AS links, min('https://hk.centanet.com/detail' || h) AS first_href, max(text) AS last_text FROM ({_LINKS}) WHERE h <> '' AND text <> '' GROUP BY page_id")
register("d4_looks_like_listing_url", _cards(lambda: X.looks_like_listing_url(F.regexp_replace("source_url", "/(property|detail)/", "/x/"), c("source_site")).alias("listing")),
         "SELECT card_id, " + "CASE source_site " + " ".join(f"WHEN '{s}' THEN contains(u, '/property/') OR contains(u, '/detail/') OR " + " OR ".join(f"regexp_matches(u, '{p}')" for p in e["ids"]) for s, e in K.SITES.items())
         + " END AS listing FROM (SELECT card_id, source_site, regexp_replace(source_url, '/(property|detail)/', '/x/', 'g') AS u FROM cards)")
register("d5_source_listing_id", lambda t: t.cards.withColumn("t", _T()).select("card_id", X.source_listing_id(c("source_site"), c("source_url"), c("t")).alias("source_listing_id")),
         "SELECT card_id, source_listing_id FROM cardobs")
_field(("d6_rent", "rent_hkd"), lambda: X.parse_rent(c("t")))
_field(("d7_area", "usable_area_sqft"), lambda: X.parse_area(c("t")))
register("d8_price_per_sqft", lambda t: t.cards.withColumn("t", _T()).select("card_id", X.parse_price_per_sqft(c("t")).alias("psf")), "SELECT card_id, psf0 AS psf FROM p1")
_field(("d9_layout", "layout"), lambda: X.parse_layout(c("t")))
_field(("d10_floor", "floor"), lambda: X.parse_floor(c("t")))
_field(("d11_flat", "flat"), lambda: X.parse_flat(c("t")))
_field(("d12_block", "block"), lambda: X.parse_block(c("t")))
register("d13_leading_tags", lambda t: t.cards.withColumn("t", _T()).select("card_id", X.remove_leading_tags(c("t")).alias("rest")), "SELECT card_id, w0 AS rest FROM p2")
register("d14_estate", lambda t: t.cards.withColumn("t", _T()).withColumn("layout", X.parse_layout(c("t"))).select("card_id", X.parse_estate(c("t"), c("layout"), TERMS).alias("estate_name")),
         "SELECT card_id, estate_name FROM cardobs")
_field(("d15_district", "district"), lambda: X.parse_district(c("t"), TERMS))
_OUT = ["source_key", "rent_hkd", "usable_area_sqft", "price_per_sqft", "layout", "floor", "flat", "block", "estate_name", "district", "title"]
_OUT_SQL = """source_site || ':' || source_listing_id AS source_key, rent_hkd, usable_area_sqft, round(price_per_sqft, 6) AS price_per_sqft, layout, floor, flat, block, estate_name, district,
    left(t, 500) AS title"""
_FOUND = "(rent_hkd IS NOT NULL OR usable_area_sqft IS NOT NULL OR layout IS NOT NULL)"
register("d16_card_observations", lambda t: E.parse_cards(t.cards, TERMS).select("card_id", *_OUT), f"SELECT card_id, {_OUT_SQL} FROM cardobs WHERE {_FOUND}")


def _script_pages(t: Tables) -> DataFrame:
    """One page per card whose text sits in a JSON script, once as the card and once nested."""
    inner = F.struct(F.lit("x").alias("Estate"), F.col("text").alias("note"))
    payload = F.to_json(F.struct(F.struct(F.lit(1).alias("n"), F.array(inner).alias("rows")).alias("data"), F.col("card_id")))
    html = F.concat(F.lit("<html><script>var a=1;</script><script type=\"application/ld+json\">"), payload, F.lit("</script></html>"))
    return t.cards.select(F.col("card_id").alias("page_id"), "source_site", "source_url", html.alias("html"))


register("d17_property_texts", lambda t: E.script_texts(_script_pages(t)).select("page_id", "text"), "SELECT card_id AS page_id, 'x ' || text AS text FROM cards")
register("d18_script_observations", lambda t: E.parse_cards(E.script_texts(_script_pages(t)), TERMS).select("page_id", "rent_hkd", "usable_area_sqft", "layout", "floor", "block"),
         f"SELECT card_id AS page_id, rent_hkd, usable_area_sqft, layout, floor, block FROM cardobs WHERE {_FOUND}")


def card_pages(t: Tables) -> DataFrame:
    """Pages of one card each, as an anchor or as plain text."""
    anchor = F.concat(F.lit('<ul><li><a class="c" href="'), "source_url", F.lit('"> <b>'), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</b></a></li></ul>"))
    plain = F.concat(F.lit("<div>"), "text", F.lit("</div><p>end</p>"))
    html = F.when(F.col("card_id") % 2 == 0, anchor).otherwise(plain)
    return t.cards.select(F.col("card_id").alias("page_id"), F.lit(1).alias("run_id"), "source_site", "source_url", html.alias("html"))


register("d19_page_observations", lambda t: E.page_observations(card_pages(t), TERMS).select("page_id", "source_key", "rent_hkd", "usable_area_sqft", "layout", "strategy"),
         f"""SELECT card_id AS page_id, source_site || ':' || source_listing_id AS source_key, rent_hkd, usable_area_sqft, layout, CAST(card_id % 2 AS INT) AS strategy FROM cardobs
             WHERE {_FOUND} AND (card_id % 2 = 0 OR regexp_matches(t, '租\\s*\\$?\\s*[0-9]') OR {" OR ".join(f"contains(t, '{h}')" for h in K.LISTING_HINTS)})""")


# D20-D22: JSON items; the texts go through JSON and back
def _props(t: Tables, site: str | None) -> DataFrame:
    return t.props if site is None else t.props.where(F.col("site") == site)


def items_1(t: Tables, site: str | None = None) -> DataFrame:
    def named(col: str):
        return F.struct(F.col(col).alias("name"))

    item = F.struct(
        F.col("num").alias("serial_no"), F.concat(F.lit("https://a.example/"), "num").alias("url_desc"), named("estate").alias("estate"), named("phase").alias("phase"),
        F.struct(F.col("building").alias("name"), F.col("op_date").alias("first_op_date")).alias("building"), named("floor").alias("floor_level"), "flat", "bedroom",
        named("district").alias("sm_district"), F.when(c("id") % 2 == 0, c("rent")).otherwise(0).alias("rent_hkd"), F.col("rent").alias("rent"),
        F.col("area").alias("net_area"), F.col("gross").alias("area"), F.col("psf").alias("rent_over_net_area"))
    return _props(t, site).select("id", F.col("site").alias("source_site"), F.from_json(F.to_json(item), E.FAMILY_1).alias("item"))


def items_2(t: Tables, site: str | None = None) -> DataFrame:
    names = F.when(c("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"), c("district"), c("estate"), c("building"))).when(
        c("id") % 3 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"), c("district"), c("estate")))
    item = F.struct(
        F.col("num").alias("postNo"), F.concat(F.lit("康城 - a/"), "num").alias("aliasV4"), names.alias("publicLocationNamesHk"), F.col("estate").alias("displayTextHk"),
        F.lit("Plain").alias("displayText"), F.col("floor").alias("floorZoneTextHk"), F.col("flat").alias("flatZoneText"), F.col("bedroom").alias("room"), F.col("rent").alias("marketPrice"),
        F.col("area").alias("saleableArea"), F.col("gross").alias("grossArea"), F.col("op_millis").alias("opDate"), F.col("psf").alias("unitPrice"))
    return _props(t, site).select("id", F.lit("ricacorp").alias("source_site"), F.from_json(F.to_json(item), E.FAMILY_2).alias("item"))


def items_3(t: Tables, site: str | None = None) -> DataFrame:
    item = F.struct(
        F.col("num").alias("refNo"), F.concat(F.lit("https://b.example/"), "num").alias("detailUrl"), F.col("phase").alias("bigEstateName"), F.col("estate").alias("estateName"),
        F.col("building").alias("buildingName"), F.col("bedroom").alias("bedroomCount"), F.when(c("id") % 2 == 0, c("rent")).alias("rentPrice"), F.struct(F.col("rent").alias("rent")).alias("priceInfo"),
        F.lit(0).alias("nSize"), F.struct(F.col("area").alias("nSize"), F.col("gross").alias("size")).alias("areaInfo"), F.col("age_text").alias("buildingAge"),
        F.struct(F.col("psf").alias("nUnitRent")).alias("unitPriceInfo"), F.col("district").alias("districtName"))
    return _props(t, site).select("id", F.lit("centanet").alias("source_site"), F.from_json(F.to_json(item), E.FAMILY_3).alias("item"))


_ITEM = ["source_key", "source_url", "title", "estate_name", "building", "block", "floor", "flat", "layout", "district", "rent_hkd", "usable_area_sqft", "gross_area_sqft", "building_age_years", "price_per_sqft"]
_L = {x: f"nullif({loose(x)}, '')" for x in ("estate", "phase", "building", "floor", "flat", "district")}
_BED = "CASE WHEN bedroom = '0' THEN '开放式' ELSE bedroom || '房' END"
_AMOUNTS = "'实用 ' || area || ' 呎', '建筑 ' || gross || ' 呎', '租 $ ' || rent"
_PSF = f"round(coalesce(psf, {psf('rent', 'area')}), 6) AS price_per_sqft"
_FLAT1 = f"CASE WHEN {_L['flat']} LIKE '%室' THEN {_L['flat']} ELSE {_L['flat']} || '室' END"
register("d20_named_items", lambda t: E.items_family_1(items_1(t), _ASOF()).select(*_ITEM),
         f"""SELECT site || ':' || num AS source_key, 'https://a.example/' || num AS source_url, {loose(f"concat_ws(' ', {_L['estate']}, {_L['phase']}, {_L['building']}, {_L['floor']}, {_FLAT1}, {_BED}, {_L['district']}, {_AMOUNTS})")} AS title,
             {_L['estate']} AS estate_name, {_L['phase']} AS building, {_L['building']} AS block, {_L['floor']} AS floor, {_FLAT1} AS flat, {_BED} AS layout, {_L['district']} AS district, rent AS rent_hkd,
             area AS usable_area_sqft, gross AS gross_area_sqft, {_YEARS.format('CAST(op_date AS DATE)')} AS building_age_years, {_PSF} FROM props""")
register("d21_positional_items", lambda t: E.items_family_2(items_2(t), _ASOF()).select(*_ITEM),
         f"""SELECT 'ricacorp:' || num AS source_key, 'https://www.ricacorp.com/zh-hk/property/detail/%E5%BA%B7%E5%9F%8E%20-%20a/' || num AS source_url,
             {loose(f"concat_ws(' ', coalesce(estate, 'Plain'), {_L['floor']}, {_L['flat']}, {_BED}, CASE WHEN id % 3 < 2 THEN {_L['district']} END, {_AMOUNTS})")} AS title,
             CASE WHEN id % 3 < 2 THEN {_L['estate']} ELSE coalesce({_L['estate']}, 'Plain') END AS estate_name, CAST(NULL AS VARCHAR) AS building, CASE WHEN id % 3 = 0 THEN {_L['building']} END AS block, {_L['floor']} AS floor,
             {_L['flat']} AS flat, {_BED} AS layout, CASE WHEN id % 3 < 2 THEN {_L['district']} END AS district, rent AS rent_hkd, area AS usable_area_sqft, gross AS gross_area_sqft,
             {_YEARS.format('CAST(epoch_ms(op_millis) AS DATE)')} AS building_age_years, {_PSF} FROM props""")
register("d22_flat_or_nested_items", lambda t: E.items_family_3(items_3(t)).select(*_ITEM),
         f"""SELECT 'centanet:' || num AS source_key, 'https://b.example/' || num AS source_url,
             {loose(f"concat_ws(' ', nullif(concat_ws(' ', {_L['phase']}, {_L['estate']}), ''), {_L['building']}, {_BED}, {_L['district']}, {_AMOUNTS})")} AS title,
             nullif(concat_ws(' ', {_L['phase']}, {_L['estate']}), '') AS estate_name, CAST(NULL AS VARCHAR) AS building, {_L['building']} AS block, CAST(NULL AS VARCHAR) AS floor, CAST(NULL AS VARCHAR) AS flat, {_BED} AS layout,
             {_L['district']} AS district, rent AS rent_hkd, area AS usable_area_sqft, gross AS gross_area_sqft, CAST(trunc(TRY_CAST(age_text AS DOUBLE)) AS INT) AS building_age_years, {_PSF} FROM props""")


# E: filters over observations built from the unit attributes
def _searchable(t: Tables) -> DataFrame:
    age = (F.col("id") % 60).cast("int")
    return t.props.select(
        "id", F.col("site").alias("source_site"), F.concat_ws(" ", F.lit("示例區"), "estate", "phase", "floor").alias("title"), F.col("estate").alias("estate_name"), "district",
        N.layout_from_bedroom(c("bedroom")).alias("layout"), F.col("rent").alias("rent_hkd"), F.when(c("id") % 13 > 0, c("area")).alias("usable_area_sqft"), F.col("gross").alias("gross_area_sqft"),
        F.when(c("id") % 17 > 0, age).alias("building_age_years"), F.col("psf").alias("price_per_sqft"))


CTES["search0"] = f"""SELECT id, site AS source_site, concat_ws(' ', '示例區', estate, phase, floor) AS title, estate AS estate_name, district, {_BED} AS layout, rent AS rent_hkd,
    CASE WHEN id % 13 > 0 THEN area END AS usable_area_sqft, gross AS gross_area_sqft, CASE WHEN id % 17 > 0 THEN id % 60 END AS building_age_years, psf AS price_per_sqft FROM props"""
CTES["search1"] = f"""SELECT *, {key("concat_ws(' ', title, estate_name, district, layout)")} AS hay, {key('coalesce(estate_name, title)')} AS est, {key("concat_ws(' ', estate_name, title)")} AS ests,
    {loose("coalesce(layout, title)")} AS lay FROM search0"""
CTES["search"] = f"SELECT *, {rooms('lay')} AS rooms FROM search1"


def _rng(col: str, lo, hi, null_ok: str = "false") -> str:
    return f"coalesce({col} >= {lo} AND {col} <= {hi}, {null_ok})"


_E = {
    "area": "(contains(hay, '湾仔区1') OR contains(hay, '湾仔区2') OR contains(hay, '湾仔区3') OR contains(hay, '高层'))",
    "rent": _rng("rent_hkd", FILTERS.min_rent, FILTERS.max_rent, "true"),
    "usable_area": _rng("usable_area_sqft", FILTERS.min_area, FILTERS.max_area),
    "gross_area": _rng("gross_area_sqft", FILTERS.min_gross_area, FILTERS.max_gross_area),
    "building_age": _rng("building_age_years", FILTERS.min_building_age, FILTERS.max_building_age),
    "price_per_sqft": _rng("price_per_sqft", FILTERS.min_psf, FILTERS.max_psf),
    "layout": "coalesce(rooms IN (0, 1, 2), false)",
    "estate": "true",
    "keyword": "true",
    "excluded_estate": "NOT contains(ests, 'brand3')",
    "excluded_keyword": "NOT contains(hay, 'brand4苑')",
}
_AREA_TERMS = ["灣仔區1", "湾仔区2", "灣仔区 3", "高層"]


def _predicate(name: str, column, oracle: str) -> None:
    register(name, lambda t: FL.with_search_keys(_searchable(t)).select("id", column(t).alias("passes")), f"SELECT id, {oracle} AS passes FROM search")


_predicate("e1_area_terms", lambda t: FL.area_filter(_AREA_TERMS), _E["area"])
_predicate("e2_rent_range", lambda t: FL.in_range(c("rent_hkd"), 9100, 9500, True), _rng("rent_hkd", 9100, 9500, "true"))
_predicate("e3_usable_area_range", lambda t: FL.in_range(c("usable_area_sqft"), 300, 500), _rng("usable_area_sqft", 300, 500))
_predicate("e4_gross_area_range", lambda t: FL.in_range(c("gross_area_sqft"), 400, None), "coalesce(gross_area_sqft >= 400, false)")
_predicate("e5_building_age_range", lambda t: FL.in_range(c("building_age_years"), 10, 25), _rng("building_age_years", 10, 25))
_predicate("e6_psf_range", lambda t: FL.in_range(c("price_per_sqft"), None, 55.5), "coalesce(price_per_sqft <= 55.5, false)")
_predicate("e7_layout", lambda t: FL.layout_filter(["一房", "studio"], FL.wanted_bedrooms(t.spark, ["一房", "studio"])), "coalesce(rooms IN (0, 1), false)")
_predicate("e7_layout_text", lambda t: FL.layout_filter(["期高", "中层"], FL.wanted_bedrooms(t.spark, ["期高", "中层"])), f"contains({key('coalesce(layout, title)')}, '期高') OR contains({key('coalesce(layout, title)')}, '中层')")
_predicate("e8_allowed_estates", lambda t: FL.allowed_estates(["Brand#7", "2期"]), "contains(est, 'brand7') OR contains(est, '2期')")
_predicate("e9_required_keywords", lambda t: FL.required_keywords(["高層", "brand"]), "contains(hay, '高层') AND contains(hay, 'brand')")
_predicate("e10_excluded_estates", lambda t: FL.excluded_estates(["Brand#1", "4期"]), "NOT (contains(ests, 'brand1') OR contains(ests, '4期'))")
_predicate("e11_excluded_keywords", lambda t: FL.excluded_keywords(["低層"]), "NOT contains(hay, '低层')")
register("e12_filter_observations", lambda t: FL.filter_observations(_searchable(t), FILTERS, _AREA_TERMS).select("id"), f"SELECT id FROM search WHERE {' AND '.join(_E.values())}")
_REASON = "CASE " + " ".join(f"WHEN NOT ({v}) THEN '{k}'" for k, v in _E.items()) + " END"
register("e13_rejection_audit", lambda t: FL.rejection_audit(_searchable(t), FILTERS, _AREA_TERMS),
         f"""SELECT source_site, count(*) AS raw_observations, count(*) FILTER (WHERE reason IS NULL) AS filtered_observations, count(reason) AS rejected_observations,
             {", ".join(f"count(*) FILTER (WHERE reason = '{k}') AS rejected_{k}" for k in _E)} FROM (SELECT source_site, {_REASON} AS reason FROM search) GROUP BY source_site""")
_PUSH = " OR ".join(f"(source_site = '{s}' AND filter IN ({', '.join(repr(n) for n in v)}))" for s, v in K.PUSHABLE.items() if v)
register("e14_source_capabilities", lambda t: FL.source_capabilities(t.props.select(F.when(c("id") % 50 == 0, F.lit("other")).otherwise(c("site")).alias("source_site")).distinct()),
         f"""SELECT source_site, filter, ({_PUSH}) AS pushable FROM (SELECT DISTINCT CASE WHEN id % 50 = 0 THEN 'other' ELSE site END AS source_site FROM props),
             (SELECT unnest([{', '.join(repr(n) for n in K.NUMERIC_FILTERS + K.TEXT_FILTERS)}]) AS filter)""")
register("e16_date_in_range", lambda t: t.table("orders").select("o_orderkey", N.date_in_range(F.when(c("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("latest")), F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1997-06-30"))).alias("inside")),
         "SELECT o_orderkey, o_orderkey % 7 > 0 AND CAST(o_orderdate AS DATE) > DATE '1996-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30' AS inside FROM orders")
