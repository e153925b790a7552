"""Ledger of what a run was to collect from each source, what landed, and what went wrong.

A *page fact* (``FACTS``) is one landed page: its number, how many rows it holds, how many rows or pages the source declares, and the
problem with it, if any; problems come from the short list ``PROBLEMS``. A page that landed more than once is good if one copy is.
Pages that the source declared and that never landed are lost. Broken pages, lost pages and a source that the run may not read
are the errors of a source in a run; with one, the source cannot mark records missing.

Facts are first reduced per page, then per source and run, so a source with very many pages is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.lifecycle import missing_gate, run_status

FACTS = "run_id int, source_site string, page bigint, rows bigint, declared_rows bigint, page_size int, declared_pages bigint, problem string"
NOT_FETCHED, UNREADABLE, NO_LIST, NO_ROWS = "not fetched", "unreadable", "no list of rows", "no rows"
LOST, NOT_ALLOWED = "lost", "source not allowed"
PROBLEMS = [NOT_FETCHED, UNREADABLE, NO_LIST, NO_ROWS, LOST, NOT_ALLOWED]
KEYS = ["run_id", "source_site"]


def pages_due(declared_rows: Column, page_size: Column, declared_pages: Column) -> Column:
    """Pages that a page's own totals call for: at least one."""
    by_rows = F.ceil(declared_rows / F.when(page_size > 0, page_size))
    return F.greatest(F.lit(1), by_rows, declared_pages).cast("bigint")


def page_states(facts: DataFrame) -> DataFrame:
    """One row per page: the pages due by its totals, and its problem unless a copy without one landed."""
    due = pages_due(F.col("declared_rows"), F.col("page_size"), F.col("declared_pages"))
    return facts.groupBy(*KEYS, "page").agg(
        F.max(due).alias("due"),
        F.when(F.count_if(F.col("problem").isNull()) == 0, F.min("problem")).alias("problem"),
    )


def completeness(facts: DataFrame) -> DataFrame:
    """Pages due, landed, broken and lost per run and source."""
    out = page_states(facts).groupBy(*KEYS).agg(
        F.max("due").alias("pages_due"),
        F.count_if(F.col("problem").isNull()).alias("pages_seen"),
        F.count_if(F.col("problem").isNotNull()).alias("pages_broken"),
    )
    lost = F.greatest(F.lit(0), F.col("pages_due") - F.col("pages_seen") - F.col("pages_broken")).alias("pages_lost")
    return out.select("*", lost).withColumn("complete", F.col("pages_seen") >= F.col("pages_due"))


def problem_counts(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Number of pages per run, source and problem; lost pages and sources not allowed are among them."""
    broken = page_states(facts).where("problem is not null").groupBy(*KEYS, "problem").agg(F.count("*").alias("pages"))
    lost = ledger.where("pages_lost > 0").select(*KEYS, F.lit(LOST).alias("problem"), F.col("pages_lost").alias("pages"))
    barred = ledger.where("not allowed").select(*KEYS, F.lit(NOT_ALLOWED).alias("problem"), F.lit(1).cast("bigint").alias("pages"))
    return broken.unionByName(lost).unionByName(barred)


def source_runs(planned: DataFrame, facts: DataFrame, rows: DataFrame, runs: DataFrame, safe: bool = True) -> DataFrame:
    """One row per planned source and run: pages, errors, row counts, ``ok`` and the missing gate ``eligible``.

    ``planned``: run_id, source_site, allowed, and pages_planned where that is known. ``rows``: run_id, source_site, raw_observations and
    filtered_observations. ``runs``: run_id, started_at, mode. A source is ok if it has no error, or rows in spite of them.
    """
    counted = completeness(facts).drop("complete")
    known = F.col("pages_planned") if "pages_planned" in planned.columns else F.lit(1)
    out = planned.select(*KEYS, "allowed", known.cast("bigint").alias("_planned")).join(counted, KEYS, "left").join(rows, KEYS, "left")
    zero = ["pages_seen", "pages_broken", "raw_observations", "filtered_observations"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zero})
    out = out.withColumn("pages_due", F.when(F.col("allowed"), F.greatest("pages_due", "_planned", F.lit(1))).otherwise(0).cast("bigint"))
    lost = F.greatest(F.lit(0), F.col("pages_due") - F.col("pages_seen") - F.col("pages_broken")).cast("bigint")
    out = out.withColumn("pages_lost", lost)
    errors = F.col("pages_broken") + F.col("pages_lost") + F.when(F.col("allowed"), 0).otherwise(1)
    out = out.withColumn("errors", errors.cast("bigint"))
    out = out.withColumn("ok", F.col("allowed") & ((F.col("errors") == 0) | (F.col("raw_observations") > 0)))
    out = out.join(F.broadcast(runs.select("run_id", "started_at", "mode")), "run_id")  # one row per run
    gate = F.col("ok") & missing_gate(F.col("mode"), F.col("errors"), F.col("filtered_observations"), safe)
    return out.withColumn("eligible", gate).select(
        *KEYS, "started_at", "mode", "allowed", "pages_due", "pages_seen", "pages_broken", "pages_lost", "errors", "ok",
        "raw_observations", "filtered_observations", "eligible",
    )


def run_results(ledger: DataFrame, blocked: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Status and errors of each run."""
    no = F.lit(False)
    out = ledger.groupBy("run_id", "started_at", "mode").agg(
        F.sum("errors").alias("errors"), F.sum("raw_observations").alias("raw_observations"),
        F.sum("filtered_observations").alias("filtered_observations"),
    )
    return out.withColumn("status", run_status(no if blocked is None else blocked, no if failed is None else failed, F.col("errors")))


def validation(ledger: DataFrame, missing: DataFrame) -> DataFrame:
    """Summary per run and source, with the records it marked missing (``missing``: run_id, source_site)."""
    marked = missing.groupBy(*KEYS).agg(F.count("*").alias("missing_sources_marked"))
    return ledger.join(marked, KEYS, "left").select(
        *KEYS, "ok", "errors", "pages_due", "pages_seen", "raw_observations", "filtered_observations",
        (F.col("raw_observations") - F.col("filtered_observations")).alias("rejected_observations"),
        F.col("eligible").alias("missing_marking_enabled"), F.coalesce("missing_sources_marked", F.lit(0)).alias("missing_sources_marked"),
    )
