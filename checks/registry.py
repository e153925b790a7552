"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import Tables, flat
from checks.oracle import CTES, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def at_date(oracle: str, day: date) -> str:
    """The oracle of a report on ``day`` instead of the last date."""
    target = CTES["tgt"]
    return sql(oracle).replace(f"tgt AS ({target})", f"tgt AS ({target} AND run_date = DATE '{day}')")


def register(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(build(Tables(spark, sf_dir)))
    if oracle is not None:
        ORACLES[name] = oracle if oracle.startswith("WITH ") else sql(oracle)
