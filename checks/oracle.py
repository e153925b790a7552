"""Common table expressions of the oracle SQL; a query pulls in the ones it names."""

from __future__ import annotations

import re

from checks import fixtures as X
from sightline import constants as K

SPACE = r"[\s\x1c-\x1f\x0b\x85\x{A0}\x{2000}-\x{200A}\x{3000}]"


def loose(x: str) -> str:
    return rf"trim(regexp_replace(translate({x}, '{K.TRAD}', '{K.SIMP}'), '{SPACE}+', ' ', 'g'))"


def key(x: str) -> str:
    punct = r"·．.。,:：;；|｜/\\\-_()（）\[\]【】#"
    return rf"regexp_replace(lower(translate(coalesce({x}, ''), '{K.TRAD}', '{K.SIMP}')), '[\s\x0b{punct}]+', '', 'g')"


def rooms(x: str) -> str:
    """Bedroom count of a loose text."""
    low = f"lower({x})"
    studio = " OR ".join(f"contains({low}, '{w}')" for w in K.STUDIO_WORDS)
    digit = rf"TRY_CAST(nullif(regexp_extract({low}, '([0-9]+)[\s-]*(?:房|室|居室|居|bedrooms?|beds?|br\b)', 1), '') AS INT)"
    words = "|".join(K.ENGLISH_DIGITS)
    listing = ", ".join(f"'{w}'" for w in K.ENGLISH_DIGITS)
    english = rf"nullif(list_position([{listing}], regexp_extract({low}, '\b({words})[\s-]*(?:bedrooms?|beds?|br)\b', 1)), 0) - 1"
    cn = rf"regexp_extract({x}, '([{K.CHINESE_ROOM_DIGITS}]+)\s*(?:房|室|居室|居)', 1)"
    return f"CASE WHEN {studio} THEN 0 ELSE coalesce({digit}, {english}, {cn_int(key(cn))}) END"


def cn_digit(x: str) -> str:
    names = "".join(K.CHINESE_DIGITS)
    values = "".join(str(v) for v in K.CHINESE_DIGITS.values())
    return f"CASE WHEN regexp_full_match({x}, '[{names}]') THEN TRY_CAST(translate({x}, '{names}', '{values}') AS INT) END"


def cn_int(x: str) -> str:
    left, right = f"split_part({x}, '十', 1)", f"substr({x}, strpos({x}, '十') + 1)"
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN TRY_CAST({x} AS INT) WHEN {x} = '十' THEN 10 "
        f"WHEN contains({x}, '十') THEN coalesce({cn_digit(left)}, 1) * 10 + coalesce({cn_digit(right)}, 0) "
        f"ELSE {cn_digit(x)} END"
    )


def canonical(x: str) -> str:
    n = rooms(x)
    return f"CASE WHEN {n} = 0 THEN '开放式' WHEN {n} IS NOT NULL THEN CAST({n} AS VARCHAR) || '房' ELSE {x} END"


def sha(x: str, n: int = 20) -> str:
    return f"left(sha1({x}), {n})"


def psf(rent: str, area: str) -> str:
    """Exact half-even rounding of a ratio to two digits."""
    ratio = f"CAST({rent} AS DOUBLE) / {area}"
    return f"CASE WHEN {rent} <> 0 AND {area} <> 0 THEN CAST(printf('%.2f', {ratio}) AS DOUBLE) END"


def identity(t: str = "") -> str:
    num = lambda c: f"coalesce(CAST(nullif({c}, 0) AS VARCHAR), '')"
    parts = [key(f"{t}estate_name"), key(f"{t}block"), key(f"{t}floor"), key(f"{t}flat"), num(f"{t}usable_area_sqft")]
    name = key(f"coalesce(nullif({t}estate_name, ''), {t}title)")
    fallback = f"concat_ws('|', {name}, {key(f'{t}layout')}, {parts[4]}, {num(f'{t}rent_hkd')})"
    good = f"{parts[0]} <> '' AND ({parts[1]} <> '' OR {parts[2]} <> '' OR {parts[3]} <> '') AND {parts[4]} <> ''"
    return sha(f"CASE WHEN {good} THEN concat_ws('|', {', '.join(parts)}) ELSE {fallback} END")


_DESC = ["title", "estate_name", "block", "floor", "flat", "layout", "district"]
_FIRST = ",\n".join(f"arg_min({c}, ord) FILTER (WHERE {c} <> '') AS {c}" for c in _DESC)
_LATEST = ["title", "estate_name", "block", "floor", "flat", "layout", "district", "rent_hkd", "usable_area_sqft", "price_per_sqft"]
_ACTIVE_AT = "first_seen_at <= c AND (first_missing_at IS NULL OR first_missing_at > c OR (active AND last_seen_at <= c))"

CTES = {
    "obs": f"SELECT b.*, {psf('rent_hkd', 'usable_area_sqft')} AS price_per_sqft, run_id * 1000000000000 + obs_id AS ord FROM ({X.duck_sql(X.OBS)}) b",
    "runs": X.RUNS,
    "site_runs": """SELECT st.source_site, r.run_id, r.started_at, r.mode,
        (r.mode <> 'initial' AND (r.run_id * 7 + length(st.source_site) * 3) % 4 <> 0) AS eligible
        FROM (SELECT DISTINCT source_site FROM obs) st CROSS JOIN runs r""",
    "nexte": """SELECT source_site, run_id, min(CASE WHEN eligible THEN run_id END) OVER (PARTITION BY source_site
        ORDER BY run_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_elig FROM site_runs""",
    "seen": """SELECT source_site, source_key, run_id, min(seen_at) AS seen_at, arg_max(listing_id, obs_id) AS listing_id,
        arg_max(source_url, obs_id) AS source_url, arg_max(source_listing_id, obs_id) AS source_listing_id
        FROM obs GROUP BY ALL""",
    "seen2": """SELECT s.*, n.next_elig, lead(s.run_id) OVER (PARTITION BY s.source_key ORDER BY s.run_id) AS next_run
        FROM seen s JOIN nexte n USING (source_site, run_id)""",
    "ev": """SELECT *, CASE WHEN next_elig IS NOT NULL AND (next_run IS NULL OR next_elig < next_run) THEN next_elig END
        AS missing_run FROM seen2""",
    "iv0": """SELECT *, coalesce(count(missing_run) OVER (PARTITION BY source_key ORDER BY run_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ev""",
    "iv": """SELECT source_site, source_key, island, max(listing_id) AS listing_id, max(source_url) AS source_url,
        min(run_id) AS start_run, min(seen_at) AS start_at, max(run_id) AS last_run, max(missing_run) AS end_run,
        max(r.started_at) AS end_at
        FROM (SELECT iv0.*, runs.started_at FROM iv0 LEFT JOIN runs ON runs.run_id = iv0.missing_run) r GROUP BY 1, 2, 3""",
    "state": """SELECT e.source_key, min(e.source_site) AS source_site, arg_max(listing_id, e.run_id) AS listing_id,
        arg_max(source_url, e.run_id) AS source_url, arg_max(source_listing_id, e.run_id) AS source_listing_id,
        min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, min(r.started_at) AS first_missing_at,
        count(missing_run) AS missing_count, arg_max(missing_run IS NULL, e.run_id) AS active, max(e.run_id) AS last_run_id
        FROM ev e LEFT JOIN runs r ON r.run_id = e.missing_run GROUP BY e.source_key""",
    "prevr": """SELECT *, last_value(nullif(rent_hkd, 0) IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_rent FROM obs""",
    "hist": """SELECT listing_id, min(rent_hkd) AS min_seen_rent_hkd, max(rent_hkd) AS max_seen_rent_hkd,
        coalesce(bool_or(rent_hkd < prev_rent), false) AS ever_rent_decreased,
        min(seen_at) FILTER (WHERE rent_hkd < prev_rent) AS first_rent_decrease_at,
        max(seen_at) FILTER (WHERE rent_hkd < prev_rent) AS last_rent_decrease_at FROM prevr GROUP BY listing_id""",
    "ident": f"SELECT listing_id, source_key, ord, {identity()} AS identity_key FROM obs",
    "created": """SELECT listing_id, arg_min(identity_key, ord) AS identity_key, arg_min(source_key, ord) AS k
        FROM ident GROUP BY listing_id""",
    "summ": """SELECT listing_id, count(*) AS sources_count, bool_or(active) AS active,
        min(first_missing_at) AS first_delisted_at FROM state GROUP BY listing_id""",
    "merged": f"""SELECT listing_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, {_FIRST},
        arg_min(usable_area_sqft, ord) FILTER (WHERE usable_area_sqft <> 0) AS usable_area_sqft,
        arg_max(rent_hkd, ord) FILTER (WHERE rent_hkd <> 0) AS last_rent_hkd,
        arg_max(price_per_sqft, ord) FILTER (WHERE price_per_sqft <> 0) AS last_price_per_sqft
        FROM obs GROUP BY listing_id""",
    "listings": f"""SELECT m.*, c.identity_key, {sha("c.identity_key || '|' || c.k")} AS canonical_id, h.* EXCLUDE (listing_id),
        s.* EXCLUDE (listing_id) FROM merged m JOIN created c USING (listing_id) JOIN hist h USING (listing_id)
        JOIN summ s USING (listing_id)""",
    "tgt": "SELECT max(started_at) AS c, max(run_date) AS d FROM runs WHERE status = 'ok'",
    "cuts": """SELECT CASE r.run_date WHEN t.d THEN 'current' WHEN t.d - 1 THEN 'day' ELSE 'week' END AS period, r.started_at AS c
        FROM runs r, tgt t WHERE r.status = 'ok' AND r.run_date IN (t.d, t.d - 1, t.d - 7)""",
    "asrc": f"""SELECT period, c, listing_id, count(DISTINCT source_site) AS active_source_count,
        min(source_site) AS sample_source_site, min(source_url) AS sample_source_url
        FROM state JOIN cuts ON {_ACTIVE_AT} GROUP BY ALL""",
    "lobs": """SELECT period, o.* FROM obs o JOIN cuts ON o.seen_at <= c
        QUALIFY row_number() OVER (PARTITION BY period, listing_id ORDER BY seen_at DESC, obs_id DESC) = 1""",
    "snap": f"""SELECT a.period, a.c, a.listing_id, l.canonical_id, l.first_seen_at, l.first_delisted_at, l.ever_rent_decreased,
        l.first_rent_decrease_at, l.last_rent_decrease_at, l.max_seen_rent_hkd, l.min_seen_rent_hkd,
        {", ".join(f"coalesce(o.{c}, l.{ {'rent_hkd': 'last_rent_hkd', 'price_per_sqft': 'last_price_per_sqft'}.get(c, c)}) AS {c}" for c in _LATEST)},
        a.active_source_count, a.sample_source_site, a.sample_source_url
        FROM asrc a JOIN listings l USING (listing_id) LEFT JOIN lobs o ON o.period = a.period AND o.listing_id = a.listing_id""",
    "cur": "SELECT * FROM snap WHERE period = 'current'",
    "prv": "SELECT * FROM snap WHERE period = 'day'",
    "wk": "SELECT * FROM snap WHERE period = 'week'",
    "low": "SELECT CAST(quantile_disc(last_rent_hkd, 0.35) AS INT) AS low FROM listings",
    "newl": """SELECT l.* EXCLUDE (last_rent_hkd, last_price_per_sqft, sources_count), l.last_rent_hkd AS rent_hkd, l.last_price_per_sqft AS price_per_sqft,
        l.sources_count AS active_source_count, min(s.source_site) AS sample_source_site, min(s.source_url) AS sample_source_url
        FROM listings l LEFT JOIN state s ON s.listing_id = l.listing_id AND s.active, tgt
        WHERE l.first_seen_at >= NEWSTART AND l.first_seen_at <= tgt.c GROUP BY ALL""".replace("NEWSTART", "tgt.c - INTERVAL 29 DAY"),
    "remv": "SELECT * FROM prv WHERE listing_id NOT IN (SELECT listing_id FROM cur)",
    "gone": """SELECT s.source_key, s.source_site, s.source_listing_id, s.source_url, s.first_missing_at, l.listing_id, l.canonical_id,
        l.first_seen_at, l.ever_rent_decreased, l.max_seen_rent_hkd, l.min_seen_rent_hkd, l.estate_name, l.block, l.floor, l.flat,
        l.layout, l.last_rent_hkd AS rent_hkd, l.usable_area_sqft, l.last_price_per_sqft AS price_per_sqft, l.active
        FROM state s JOIN listings l USING (listing_id)""",
    "wd0": """SELECT g.*, greatest(0.0, epoch(first_missing_at - first_seen_at) / 86400.0) AS local_age_days FROM gone g, tgt
        WHERE first_missing_at >= tgt.c - INTERVAL 30 DAY AND first_missing_at <= tgt.c""",
    "wd": """SELECT *, CASE WHEN local_age_days IS NULL THEN '未知' WHEN local_age_days <= 7 THEN '0-7天' WHEN local_age_days <= 14 THEN '8-14天'
        WHEN local_age_days <= 30 THEN '15-30天' ELSE '30天以上' END AS bucket FROM wd0""",
    "th0": """SELECT min(last_rent_hkd) AS lo, max(last_rent_hkd) AS hi,
        quantile_disc(last_rent_hkd, [0.2, 0.4, 0.6, 0.8]) AS q FROM listings WHERE last_rent_hkd IS NOT NULL""",
    "th1": """SELECT lo, hi, q, (hi - lo) / 5.0 AS v, pow(10, floor(log10((hi - lo) / 5.0))) AS u FROM th0""",
    "th2": """SELECT lo, hi, q, greatest(500, CASE WHEN u >= v THEN u WHEN 2 * u >= v THEN 2 * u WHEN 5 * u >= v THEN 5 * u ELSE 10 * u END) AS step FROM th1""",
    "th": """SELECT lo, hi, list_sort(list_distinct(list_filter(list_transform(q, lambda x: CAST(ceil(x / step) * step AS INT)),
        lambda t: t >= lo AND t < hi))) AS b FROM th2""",
    "bands": """SELECT i AS band, CASE WHEN i > 0 THEN b[i] + 1 END AS rent_lower, CASE WHEN i < len(b) THEN b[i + 1] END AS rent_upper
        FROM th, range(0, 6) t(i) WHERE i <= len(b)""",
    "units": X.UNITS,
    "nu": f"""SELECT id, {', '.join(f"nullif({key(c)}, '') AS {f}" for c, f in zip(
        ['estate_name', 'block', 'floor', 'flat', 'layout', 'CAST(usable_area_sqft AS VARCHAR)'],
        ['f1', 'f2', 'f3', 'f4', 'f5', 'f6']))}, nullif(rent_hkd, 0) AS rent, rent_hkd FROM units""",
    "props": X.PROPS,
    "cards": X.CARDS,
    "loosec": f"SELECT card_id, source_site, source_url, {loose('text')} AS t FROM cards",
}

STRICT = (
    "abs(a.rent - b.rent) <= 500 AND "
    + " AND ".join(f"coalesce(a.f{i} = b.f{i}, true)" for i in range(1, 7))
    + " AND " + " + ".join(f"CAST(a.f{i} IS NOT NULL AND b.f{i} IS NOT NULL AS INT)" for i in range(1, 7)) + " >= 3"
)


def label(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '{K.UNLABELLED}')"


def sql(body: str) -> str:
    """``body`` with the common table expressions it needs, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in CTES and word not in need:
                need.append(word)
                visit(CTES[word])

    visit(body)
    order = [n for n in CTES if n in need]
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head}\n{body}" if order else body
