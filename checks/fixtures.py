"""Views over the given tables that the registered queries run on, in SQL that both engines read.

``DAYNO(`` stands for the day number of a date, which the engines name differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.numeric import derived_psf
from sightline.operators import history, lifecycle
from sightline.operators.filters import Filters
from sightline.session import cut, spread

_STORED: dict[tuple[str, str, str], DataFrame] = {}

OBS = """
SELECT event_id AS obs_id,
       CAST(ts AS DATE) AS run_date,
       CAST(DAYNO(CAST(ts AS DATE)) AS INT) AS run_id,
       CAST(date_trunc('day', ts) AS TIMESTAMP) AS seen_at,
       event_type AS source_site,
       CAST(user_id AS VARCHAR(20)) AS source_listing_id,
       'https://example.com/' || event_type || '/' || CAST(user_id AS VARCHAR(20)) AS source_url,
       event_type || ':' || CAST(user_id AS VARCHAR(20)) AS source_key,
       user_id AS listing_id,
       CASE WHEN event_id % 13 = 0 THEN '' ELSE 'Unit ' || CAST(user_id AS VARCHAR(20)) || ' near ' || event_type END AS title,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'estate' || CAST(user_id % 12 AS VARCHAR(20)) END AS estate_name,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id % 7 AS VARCHAR(20)) || 'A座' END AS block,
       CASE user_id % 4 WHEN 0 THEN '高層' WHEN 1 THEN '中层' WHEN 2 THEN '低層' ELSE NULL END AS floor,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(user_id % 9 AS VARCHAR(20)) || '室' END AS flat,
       CASE user_id % 5 WHEN 0 THEN 'studio' WHEN 4 THEN NULL ELSE CAST(user_id % 5 AS VARCHAR(20)) || 'br' END AS layout,
       'district' || CAST(user_id % 3 AS VARCHAR(20)) AS district,
       CAST(CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 0 ELSE 5000 + floor(value * 100) END AS INT) AS rent_hkd,
       CAST(200 + (user_id * 37) % 700 AS INT) AS usable_area_sqft
FROM events
"""

RUNS = """
SELECT run_id, min(run_date) AS run_date, min(seen_at) AS started_at,
       CASE WHEN run_id = 1 THEN 'initial' ELSE 'daily' END AS mode,
       CASE WHEN run_id % 10 = 7 THEN 'partial' ELSE 'ok' END AS status
FROM obs GROUP BY run_id
"""

UNITS = """
SELECT p_partkey AS id,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS estate_name,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS block,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size % 10 AS VARCHAR(20)) END AS floor,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS flat,
       CAST(p_partkey % 4 AS VARCHAR(20)) || 'br' AS layout,
       CAST(300 + p_size % 8 * 50 AS INT) AS usable_area_sqft,
       CAST(floor(p_retailprice * 10) AS INT) AS rent_hkd
FROM part
"""

PROPS = """
SELECT p_partkey AS id,
       CASE p_partkey % 4 WHEN 0 THEN 'midland' WHEN 1 THEN 'ricacorp' WHEN 2 THEN 'centanet' ELSE 'hkp' END AS site,
       CAST(1000000 + p_partkey AS VARCHAR(20)) AS num,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '示例' || p_brand || '苑' END AS estate,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 4 + 1 AS VARCHAR(20)) || '期' END AS phase,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR(20)) || '座' END AS building,
       CASE p_partkey % 3 WHEN 0 THEN '高層' WHEN 1 THEN '中層' ELSE '低层' END AS floor,
       CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'B室' ELSE 'C' END AS flat,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS VARCHAR(20)) END AS bedroom,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE '灣仔區' || CAST(p_partkey % 6 AS VARCHAR(20)) END AS district,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 10) AS INT) END AS rent,
       CAST(200 + p_size * 11 AS INT) AS area,
       CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(260 + p_size * 13 AS INT) END AS gross,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(20 + p_size AS DOUBLE) END AS psf,
       CAST(1975 + p_size AS VARCHAR(20)) || '-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR(20)), 2, '0') || '-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR(20)), 2, '0') AS op_date,
       CAST(p_partkey % 20000 AS BIGINT) * 86400000 + 5 AS op_millis,
       CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR(20)) || '.5' END AS age_text
FROM part
"""

CARDS = """
SELECT id AS card_id, site AS source_site,
       CASE site WHEN 'midland' THEN 'https://www.midland.com.hk/zh-hk/property/x-M' || num
                 WHEN 'ricacorp' THEN 'https://www.ricacorp.com/zh-hk/property/detail/rc' || num || '-5-hk'
                 WHEN 'centanet' THEN 'https://hk.centanet.com/findproperty/detail/foo_ABC' || num || '?theme=rent'
                 ELSE 'https://www.hkp.com.hk/zh-hk/property/h' || num END AS source_url,
       CASE id % 6
         WHEN 0 THEN '中原地产 装修及讲房 獨家 bookmark Example  Residence 1期 ' || coalesce(estate, 'Sky Court') || ' ' || coalesce(building, '3座') || ' ' || floor || ' ' || CAST(id % 4 + 1 AS VARCHAR(20)) || '房 (1套房) 示例區 2年楼龄 實用 ' || CAST(area AS VARCHAR(20)) || ' 呎 ' || CAST(area AS VARCHAR(20)) || '呎 @ $' || CAST(30 + id % 50 AS VARCHAR(20)) || ' /呎 租 $ ' || CAST(10 + id % 90 AS VARCHAR(20)) || ',' || lpad(CAST(id * 17 % 1000 AS VARCHAR(20)), 3, '0')
         WHEN 1 THEN coalesce(estate, '示例苑') || ' 1B座 低层 E室 location 示例区 示例道21号 租 $' || CAST(12000 + id % 9000 AS VARCHAR(20)) || ' 实用 330呎 $48/呎 同小区 1房 楼盘编号: M' || num
         WHEN 2 THEN 'VR  笋盘 ' || coalesce(phase, '二期') || '花園 十二座 中層 12室 開放式 示例区 ' || CAST(area AS VARCHAR(20)) || '呎 @$' || CAST(40 + id % 20 AS VARCHAR(20)) || '/呎 租 8,000 減 租 $7,' || lpad(CAST(id % 1000 AS VARCHAR(20)), 3, '0')
         WHEN 3 THEN 'Tower ' || CAST(id % 9 AS VARCHAR(20)) || ' ground floor, rent $' || CAST(9000 + id % 700 AS VARCHAR(20)) || ' for two friends in 屯門'
         WHEN 4 THEN 'About us ' || coalesce(estate, '') || ' contact'
         ELSE '利嘉閣 連租約 ' || coalesce(estate, '豪園') || ' 示例區 兩房一廳 大厦第三座 ' || CAST(id % 30 + 1 AS VARCHAR(20)) || '樓 ' || chr(65 + CAST(id % 6 AS INT)) || '室 实 ' || CAST(area AS VARCHAR(20)) || ' 呎 $' || CAST(15000 + id % 500 AS VARCHAR(20)) || ' 租' END AS text
FROM props
"""

TERMS = ["示例区", "屯门", "屯門"]
LAYOUTS = [K.STUDIO, "1房", "2房", "3房", K.UNLABELLED]
# A report date at which listings have gone since the day before.
EARLY_DATE = date(2024, 1, 9)
FILTERS = Filters(
    min_rent=6000, max_rent=30000, min_area=210, max_area=900, min_gross_area=250, max_gross_area=1200,
    min_building_age=1, max_building_age=48, min_psf=5, max_psf=90, layouts=["一房", "两房", "studio"],
    excluded_estates=["Brand#3"], excluded_keywords=["Brand#4 苑"],
)


def spark_sql(text: str) -> str:
    return re.sub(r"DAYNO\((CAST\(ts AS DATE\))\)", r"datediff(\1, DATE '2023-12-31')", text)


def duck_sql(text: str) -> str:
    return re.sub(r"DAYNO\((CAST\(ts AS DATE\))\)", r"datediff('day', DATE '2023-12-31', \1)", text)


class Tables:
    """Fixture views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _view(self, text: str, **tables: DataFrame) -> DataFrame:
        sql = spark_sql(text)
        for name in tables:
            sql = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", sql)
        return self.spark.sql(sql, **tables)

    @cached_property
    def obs(self) -> DataFrame:
        psf = derived_psf(F.lit(None).cast("double"), F.col("rent_hkd"), F.col("usable_area_sqft"))
        return self._view(OBS, events=self.table("events")).withColumn("price_per_sqft", psf)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Derived table, written once per application and data folder and read back, as a run would leave it."""
        at = (self.spark.sparkContext.applicationId, self.dir, name)
        if at not in _STORED:
            _STORED[at] = cut(build(), name)
        return _STORED[at]

    @cached_property
    def runs(self) -> DataFrame:
        return self.stored("runs", lambda: self._view(RUNS, obs=self.obs))

    @cached_property
    def site_runs(self) -> DataFrame:
        return self.stored("site-runs", self._site_runs)

    def _site_runs(self) -> DataFrame:
        every = self.runs.agg(F.collect_list(F.struct("run_id", "run_date", "started_at", "mode"))).scalar()
        rows = self.obs.select("source_site").distinct().withColumn("r", F.explode(every)).select("source_site", "r.*")
        turn = (F.col("run_id") * 7 + F.length("source_site") * 3) % 4
        return rows.withColumn("eligible", (F.col("mode") != "initial") & (turn != 0))

    # Computed from the log in the query itself.
    @cached_property
    def seen(self) -> DataFrame:
        return lifecycle.sightings(self.obs)

    @cached_property
    def events(self) -> DataFrame:
        return lifecycle.missing_events(self.seen, self.site_runs)

    def build_intervals(self) -> DataFrame:
        return lifecycle.presence_intervals(self.events)

    def build_state(self) -> DataFrame:
        return lifecycle.source_state(self.events)

    def build_listings(self) -> DataFrame:
        return history.listings(self.obs, self.state)

    # The derived tables that reports read.
    @cached_property
    def intervals(self) -> DataFrame:
        return self.stored("intervals", self.build_intervals)

    @cached_property
    def state(self) -> DataFrame:
        return self.stored("state", self.build_state)

    @cached_property
    def listings(self) -> DataFrame:
        return self.stored("listings", self.build_listings)

    @cached_property
    def part(self) -> DataFrame:
        """Few bytes a row: a file of a million rows would be parsed in one task."""
        return spread(self.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), "p_partkey")

    @cached_property
    def units(self) -> DataFrame:
        return self._view(UNITS, part=self.part)

    @cached_property
    def props(self) -> DataFrame:
        return self._view(PROPS, part=self.part)

    @cached_property
    def cards(self) -> DataFrame:
        return self._view(CARDS, props=self.props)


def flat(df: DataFrame) -> DataFrame:
    """Output form of a registered query: times as text, decimals to six digits."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz", "date"):
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif kind in ("double", "float"):
            out.append(F.round(F.col(f.name), 6).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
