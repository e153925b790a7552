"""From landed pages of a run to the log, the state and the validation of its sources.

A run's results are tables in folders of its own: ``observations`` (kept rows), ``rejected``, ``facts``, ``ledger``, ``missing``, ``state`` and
``listings``. Its manifest, one row, is written last and names the folders; readers see only what manifests name, so that all tables of a
run appear together, and the leavings of a run that failed are never read. A run that has a manifest is not scanned again. Runs
are scanned in the order of their numbers.

``obs_id`` is made of the run, the number of the source in the run, the page and the place on the page (``BITS``), so a scan that is
repeated gives every row the same one. A row that would not fit stops the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators import extraction as E
from sightline.operators import history, ledger, lifecycle, matching
from sightline.operators.filters import Filters, with_rejection
from sightline.session import cut, shuffled
from sightline.sources import landed

#: Bits of an obs_id for the source, the page and the place; the run has those above.
BITS = {"site_no": 7, "page": 24, "pos": 14}
RUN_BITS = 18
TABLES = ["observations", "rejected", "facts", "ledger", "missing", "state", "listings"]
MANIFEST = "run_id int, started_at timestamp, mode string, status string, errors bigint, inserted bigint, missing_marked bigint, attempt string"


@dataclass(frozen=True)
class Run:
    """One run: its number, start and mode, and the sources it was to read, in order."""

    run_id: int
    started_at: str
    mode: str
    sources: tuple[str, ...]
    not_allowed: tuple[str, ...] = ()
    pages_planned: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Scope:
    """What a task looks for."""

    filters: Filters
    terms: tuple[str, ...] = ()
    page_size: int = 100
    safe_missing: bool = True


def obs_id() -> Column:
    """Number of a row by run_id, site_no, page and pos."""
    number, fits = F.col("run_id").cast("bigint"), F.col("run_id").between(0, (1 << RUN_BITS) - 1)
    for name, bits in BITS.items():
        number = F.shiftleft(number, bits).bitwiseOR(F.col(name).cast("bigint"))
        fits = fits & F.col(name).between(0, (1 << bits) - 1)
    broken = F.raise_error(F.concat_ws(" ", F.lit("no obs_id for run, source, page, place"), "run_id", *BITS)).cast("bigint")
    return F.when(fits, number).otherwise(broken)


def collected(landing: DataFrame, planned: DataFrame, started_at: Column, terms: list[str]) -> DataFrame:
    """Observations of the landed pages of allowed sources, with run, page and place.

    Rows of HTML pages are those of ``landed.scan_html``: a record found on several pages of a run is kept from the first. Only
    families that have landed are part of the plan.
    """
    allowed = F.broadcast(planned.where("allowed").select("run_id", "source_site", "site_no"))  # one row per source of a run
    pages = landing.join(allowed, ["run_id", "source_site"], "left_semi")
    present = {r.family for r in landing.select("family").distinct().collect()}  # of the four that there are
    parts = [rows(pages, started_at, terms) for family, rows in _FAMILIES.items() if family in present]
    rows = reduce(DataFrame.unionByName, parts or [_named(pages.limit(0), started_at, terms)])
    return rows.join(allowed, ["run_id", "source_site"])


def _html(pages: DataFrame, started_at: Column, terms: list[str]) -> DataFrame:
    rows = E.page_observations(landed.html_pages(pages).where("problem is null").drop("problem"), terms, places=True)
    by_page = Window.partitionBy("run_id", "page_id", "source_site").orderBy("strategy", "pos")
    rows = rows.withColumn("pos", (F.row_number().over(by_page) - 1).cast("int")).withColumnRenamed("page_id", "page")
    return E.clean_observations(_first_of(rows.drop("strategy"), "source_key"))


def _named(pages: DataFrame, started_at: Column, terms: list[str]) -> DataFrame:
    return E.items_family_1(landed.landed_items(landed.landed_pages(pages, landed.RESULT)), started_at)


def _posts(pages: DataFrame, started_at: Column, terms: list[str]) -> DataFrame:
    rows = E.items_family_2(landed.landed_items(landed.landed_pages(pages, landed.STATE)), started_at)
    return _first_of(rows, "source_listing_id")


def _nested(pages: DataFrame, started_at: Column, terms: list[str]) -> DataFrame:
    return E.items_family_3(landed.landed_items(landed.landed_pages(pages, landed.DATA)))


_FAMILIES = {landed.HTML: _html, landed.RESULT: _named, landed.STATE: _posts, landed.DATA: _nested}


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key within a source and run, in the order of pages; rows without the key are all kept."""
    cols = [c for c in rows.columns if c not in ("run_id", "source_site", key)]
    one = rows.where(F.col(key).isNotNull()).groupBy("run_id", "source_site", key).agg(F.min_by(F.struct(*cols), F.struct("page", "pos")).alias("_first"))
    return one.select("run_id", "source_site", key, "_first.*").unionByName(rows.where(F.col(key).isNull()))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of finished runs; none where no run has finished."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/run=*")
    except AnalysisException:  # no manifest folder yet
        return spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of all finished runs together; of ``state`` and ``listings``, that of the last run."""
    rows = manifests(spark, folder).orderBy("run_id").select("run_id", "attempt").collect()  # one row per run
    if not rows:
        raise ValueError("no run has finished")
    rows = rows[-1:] if table in ("state", "listings") else rows
    return spark.read.parquet(*(f"{folder}/{table}/{r.attempt}" for r in rows))


def _listings(log: DataFrame, state: DataFrame, old: DataFrame | None, rows: DataFrame, missing: DataFrame) -> DataFrame:
    """Listings after a run: those that it saw or whose source it marked missing are made anew, the others stay."""
    if old is None:
        return history.listings(log, state)
    hit = shuffled(cut(rows.select("listing_id").unionByName(missing.select("listing_id")).distinct(), "hit"))
    fresh = history.listings(log.join(hit, "listing_id", "left_semi"), state.join(hit, "listing_id", "left_semi"))
    return old.join(hit, "listing_id", "left_anti").unionByName(fresh.select(old.columns))


def scan(spark: SparkSession, landing: DataFrame, run: Run, scope: Scope, folder: str) -> bool:
    """Scans the landed pages of a run; False if it is finished already."""
    done = manifests(spark, folder).agg(F.max("run_id").alias("last"), F.max(F.col("run_id") == run.run_id).alias("again")).first()
    if done.again:
        return False
    if done.last is not None and done.last > run.run_id:
        raise ValueError(f"run {run.run_id} comes before run {done.last}, which has finished")
    attempt = f"run-{run.run_id:06d}-{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"

    def put(name: str, rows: DataFrame) -> DataFrame:
        path = f"{folder}/{name}/{attempt}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    pages = landing.where(F.col("run_id") == run.run_id)
    sources = [(run.run_id, s, i, s not in run.not_allowed, run.pages_planned.get(s, 1)) for i, s in enumerate(run.sources)]
    planned = spark.createDataFrame(sources, "run_id int, source_site string, site_no int, allowed boolean, pages_planned bigint")
    started = F.lit(run.started_at).cast("timestamp")
    runs = spark.createDataFrame([(run.run_id, run.mode)], "run_id int, mode string").withColumn("started_at", started)

    raw = collected(pages, planned, started, list(scope.terms)).withColumn("obs_id", obs_id()).drop("site_no")
    raw = raw.withColumns({"seen_at": started, "run_date": F.to_date(started), "identity_key": E.observation_identity(raw)})
    marked = cut(with_rejection(raw, scope.filters, list(scope.terms)), "marked")
    put("rejected", marked.where("rejected_by is not null"))
    kept = marked.where("rejected_by is null").drop("rejected_by")

    first = done.last is None
    old_state = read(spark, folder, "state") if not first else spark.createDataFrame([], _STATE)
    old_listings = None if first else read(spark, folder, "listings")
    known = old_listings if old_listings is not None else spark.createDataFrame([], _LISTINGS)
    resolved = put("observations", matching.resolve_batch(kept, old_state, known))

    facts = put("facts", landed.facts(pages, scope.page_size).join(F.broadcast(planned.where("allowed")), ["run_id", "source_site"], "left_semi"))
    counts = marked.groupBy("run_id", "source_site").agg(
        F.count("*").alias("raw_observations"), F.count_if(F.col("rejected_by").isNull()).alias("filtered_observations"))
    book = put("ledger", ledger.source_runs(planned, facts, counts, runs, scope.safe_missing))

    state = put("state", lifecycle.merge_state(old_state, resolved, book))
    # one batch is one run: what it marks missing is what was active and is not any more
    gone = old_state.where("active").join(shuffled(state.where("not active").select("source_key")), "source_key", "left_semi")
    missing = put("missing", gone.select(F.lit(run.run_id).alias("run_id"), "source_site", "source_key", "listing_id"))
    log = resolved if first else read(spark, folder, "observations").unionByName(resolved)
    put("listings", _listings(log, state, old_listings, resolved, missing))

    result = ledger.run_results(book).withColumns({"inserted": F.lit(resolved.count()), "missing_marked": F.lit(missing.count()), "attempt": F.lit(attempt)})
    columns = [c.strip().split(" ") for c in MANIFEST.split(",")]
    result.select(*(F.col(n).cast(t).alias(n) for n, t in columns)).coalesce(1).write.parquet(f"{folder}/manifest/run={run.run_id}")
    return True


_STATE = """source_key string, source_site string, listing_id bigint, source_url string, source_listing_id string, first_seen_at timestamp,
last_seen_at timestamp, first_missing_at timestamp, missing_count bigint, active boolean, last_run_id int"""
_LISTINGS = """listing_id bigint, identity_key string, estate_name string, building string, block string, floor string, flat string, layout string,
usable_area_sqft int, last_rent_hkd int, last_seen_at timestamp, active boolean"""


def validation(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of every source in every finished run."""
    return ledger.validation(read(spark, folder, "ledger"), read(spark, folder, "missing"))
