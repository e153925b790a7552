"""Readers of landed files and of the observation log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators import extraction as E
from sightline.operators import ledger as G
from sightline.session import lookup_join

#: One fetched page as it landed: ``body`` is the response as it came, ``error`` says why there is none.
LANDED = "run_id int, source_site string, family string, page bigint, source_url string, error string, body string"
RESULT, DATA, STATE, HTML = "result", "data", "state", "html"
_BROKEN = "_corrupt_record"
PAGE = "page_id bigint, run_id int, source_site string, source_url string, html string"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed HTML pages (page_id, run_id, source_site, source_url, html)."""
    return spark.read.schema(PAGE).format(fmt).load(path)


def read_html_files(spark: SparkSession, path: str, source_site: str) -> DataFrame:
    """One page per HTML file; the file name stands for the URL."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("source_url"))
    return raw.select(F.xxhash64("source_url").alias("page_id"), F.lit(source_site).alias("source_site"), "source_url", "html")


def scan_html(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Observations of a source's pages; a record found on several pages of a run is kept from the first."""
    rows = E.page_observations(pages, terms)
    order = F.struct("page_id", "strategy")
    keys = [c for c in ("run_id", "source_key") if c in rows.columns]
    cols = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_first"))
    return first.select(*keys, "_first.*").drop("strategy")


def _paged(spark: SparkSession, path: str, item: str, rows: str) -> DataFrame:
    schema = f"run_id int, source_site string, page int, {_PAGED.format(rows=rows, item=_struct(item))}, {_BROKEN} string"
    pages = spark.read.schema(schema).json(path).withColumnRenamed(rows, "items")
    return pages.withColumn("problem", _problem(F.col(_BROKEN), F.col("items"))).drop(_BROKEN)


_PAGED = "count bigint, {rows} array<struct<{item}>>"


def _problem(broken: Column, rows: Column) -> Column:
    """What is wrong with a parsed page: text that is no JSON or does not fit, or no list of rows."""
    return F.when(broken.isNotNull(), F.lit(G.UNREADABLE)).when(rows.isNull(), F.lit(G.NO_LIST))


def _struct(ddl: str) -> str:
    """Field list of a table schema in the colon form a struct type wants."""
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def read_result_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages ``{count, result: [...]}`` of the first JSON family, one row per page."""
    return _paged(spark, path, E.FAMILY_1, "result")


def read_data_pages(spark: SparkSession, path: str) -> DataFrame:
    """Offset pages ``{count, data: [...]}`` of the third JSON family, one row per page."""
    return _paged(spark, path, E.FAMILY_3, "data")


def items(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "source_site", "page", F.explode("items").alias("item"))


def state_pages(pages: DataFrame) -> DataFrame:
    """Embedded application state of HTML pages: declared page and post totals, and the posts."""
    state = f"struct<POSTS: array<struct<{_struct(E.FAMILY_2)}>>, POSTSNUMPAGES: int, POSTSTOTAL: bigint>"
    parsed = pages.withColumn("state", F.from_json(E.state_json(F.col("html")), state))
    return parsed.drop("html").select("*", "state.*").drop("state")


def state_items(pages: DataFrame) -> DataFrame:
    """Posts of state pages, the first of a post number within a run."""
    posts = state_pages(pages).select("page_id", "run_id", "source_site", F.posexplode("POSTS").alias("pos", "item"))
    keyed = posts.withColumn("_no", F.coalesce("item.postNo", F.lit("")))
    numbered = keyed.where("_no <> ''").groupBy("run_id", "_no").agg(
        F.min_by(F.struct("source_site", "item"), F.struct("page_id", "pos")).alias("_rec")
    )
    return numbered.select("run_id", "_rec.*")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of all sources, as rows of ``LANDED``; a folder per run prunes the others."""
    return spark.read.schema(LANDED).parquet(path)


def _bodies(landing: DataFrame, family: str) -> DataFrame:
    return landing.where(F.col("family") == family)


def _fetched(problem: Column) -> Column:
    missing = F.col("error").isNotNull() | F.col("body").isNull()
    return F.when(missing, F.lit(G.NOT_FETCHED)).otherwise(problem)


def landed_pages(landing: DataFrame, family: str) -> DataFrame:
    """Pages of one of the paged families: items (null if broken), the totals that the source declares, and the problem."""
    fields = {
        RESULT: (E.FAMILY_1, "count bigint, result array<struct<{item}>>"),
        DATA: (E.FAMILY_3, "count bigint, data array<struct<{item}>>"),
        STATE: (E.FAMILY_2, "POSTS array<struct<{item}>>, POSTSNUMPAGES bigint, POSTSTOTAL bigint"),
    }
    item, ddl = fields[family]
    body = E.state_json(F.col("body")) if family == STATE else F.col("body")
    rows = "POSTS" if family == STATE else family
    parsed = F.from_json(body, f"{ddl.format(item=_struct(item))}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    pages = _bodies(landing, family).withColumn("_page", parsed)
    items = F.col(f"_page.{rows}")
    problem = _problem(F.col(f"_page.{_BROKEN}"), items)
    if family == STATE:
        problem = F.coalesce(problem, F.when(F.size(items) == 0, F.lit(G.NO_ROWS)))
    declared = F.col("_page.POSTSNUMPAGES") if family == STATE else F.lit(None).cast("bigint")
    total = F.lit(None).cast("bigint") if family == STATE else F.col("_page.count")
    return pages.select(
        "run_id", "source_site", "page", "source_url", items.alias("items"), total.alias("declared_rows"),
        declared.alias("declared_pages"), _fetched(problem).alias("problem"),
    )


def html_pages(landing: DataFrame) -> DataFrame:
    """HTML pages as ``page_observations`` reads them, with the problem of pages that were not fetched."""
    return _bodies(landing, HTML).select(
        F.col("page").alias("page_id"), "run_id", "source_site", "source_url", F.col("body").alias("html"),
        _fetched(F.lit(None).cast("string")).alias("problem"),
    )


def facts(landing: DataFrame, page_size: int) -> DataFrame:
    """Page facts (``ledger.FACTS``) of all landed pages."""
    none = F.lit(None).cast("bigint")
    out = html_pages(landing).select("run_id", "source_site", F.col("page_id").alias("page"), none.alias("rows"), none.alias("declared_rows"),
                                     F.lit(page_size).alias("page_size"), none.alias("declared_pages"), "problem")
    for family in (RESULT, DATA, STATE):
        pages = landed_pages(landing, family)
        out = out.unionByName(pages.select("run_id", "source_site", "page", F.size("items").cast("bigint").alias("rows"), "declared_rows",
                                           F.lit(page_size).alias("page_size"), "declared_pages", "problem"))
    return out


def landed_items(pages: DataFrame) -> DataFrame:
    """Items of the pages with their place."""
    return pages.select("run_id", "source_site", "page", F.posexplode("items").alias("pos", "item"))


def read_log(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Observation log; the date bounds prune partitions."""
    log = spark.read.parquet(path)
    if first is not None:
        log = log.where(F.col("run_date") >= F.lit(first))
    if last is not None:
        log = log.where(F.col("run_date") <= F.lit(last))
    return log


def with_run(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Log rows with the metadata of their run."""
    dims = runs.select("run_id", "started_at", "mode", "status")
    return lookup_join(log, dims, ["run_id"], "inner", "obs_id")
