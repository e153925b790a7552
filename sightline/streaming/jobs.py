"""Structured Streaming jobs over landed observations and completed runs.

State that has to split hot keys or join whole tables is a table in parts (``PartedState``): batch ``n`` reads the parts
it touches as they were before it and writes these under ``v=n``, so a repeated batch gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline.operators import history, lifecycle
from sightline.operators.filters import Filters, filter_observations
from sightline.session import lookup_join, new_path

STATE = """source_key string, source_site string, listing_id bigint, source_url string, source_listing_id string,
first_seen_at timestamp, last_seen_at timestamp, first_missing_at timestamp, missing_count bigint, active boolean,
last_run_id int"""
RENTS = "listing_id bigint, rent int"
#: Parts of a state.
PARTS = 64


def ingest(
    observations: DataFrame, filters: Filters, terms: list[str], out: str, late: str, checkpoint: str, delay: str = "2 days"
) -> StreamingQuery:
    """Log of filtered rows with one row per source record and run, whenever it arrives.

    Of the rows of a batch that with the smallest obs_id is taken, and a row that an earlier batch has written stays. Rows that
    lie more than ``delay`` behind the latest row of earlier batches are written to ``late`` as well, for ``rebuild_late``.

    Beside the log lie the keys of each batch in a folder per run (``key_folder``), and the latest time of each batch. A row can only be a second
    one of its own run, so a batch reads the keys of the runs it has rows of, not the log.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = filter_observations(batch, filters, terms)
        row = F.min_by(F.struct(*kept.columns), "obs_id").alias("row")
        rows = kept.groupBy("source_key", "run_id").agg(row).select("row.*")
        bound = None
        if batch_id:
            runs = [r.run_id for r in batch.select("run_id").distinct().collect()]  # the runs of one batch
            keys = known_keys(spark, out, batch_id, runs)
            same = F.col("source_key").eqNullSafe(F.col("_key")) & F.col("run_id").eqNullSafe(F.col("_run"))
            rows = rows.join(keys, same, "left_anti")
            bound = spark.read.schema("last timestamp, batch long").parquet(f"{out}-last").where(F.col("batch") < batch_id).agg(F.max("last")).first()[0]
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        new = spark.read.schema(rows.schema).parquet(f"{out}/batch={batch_id}")
        limit = F.lit(bound).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        new.where(F.col("seen_at") < limit).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        new.agg(F.max("seen_at").alias("last")).write.mode("overwrite").parquet(f"{out}-last/batch={batch_id}")
        new.select("source_key", "run_id").write.mode("overwrite").partitionBy("run_id").parquet(f"{key_folder(out)}/batch={batch_id}")

    return _each(observations, step, checkpoint)


def key_folder(out: str) -> str:
    return f"{out}-keys"


def known_keys(spark: SparkSession, out: str, batch_id: int, runs: list[int]) -> DataFrame:
    """(_key, _run) that batches before ``batch_id`` have written for some runs; folders of other runs are not read."""
    schema = "source_key string, batch long, run_id int"
    keys = spark.read.schema(schema).parquet(key_folder(out)).where(F.col("batch") < batch_id)
    some = F.col("run_id").isin([r for r in runs if r is not None])
    wanted = keys.where(some | F.col("run_id").isNull()) if None in runs else keys.where(some)
    return wanted.select(F.col("source_key").alias("_key"), F.col("run_id").alias("_run")).distinct()


class PartedState:
    """State in parts by a hash of its key. A batch reads and writes the parts it touches; the others stay where they are.

    ``index/v=n`` says, for each part, which batch up to ``n`` wrote it last; a batch that is repeated reads the index before its own and
    overwrites what it wrote. There are ``PARTS`` parts at most.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(PARTS)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.part for r in rows.select(self.part().alias("part")).distinct().collect())

    def versions(self, batch_id: int) -> dict[int, int]:
        """The batch before ``batch_id`` that wrote each part."""
        if not batch_id:
            return {}
        return {r.part: r.batch for r in self.spark.read.schema("part int, batch long").parquet(f"{self.folder}/index/v={batch_id - 1}").collect()}

    def read(self, batch_id: int, parts: list[int] | None = None) -> DataFrame:
        """State before a batch: of some parts, or all."""
        known = self.versions(batch_id)
        paths = [f"{self.folder}/v={v}/part={p}" for p, v in known.items() if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch_id: int, rows: DataFrame, parts: list[int]) -> None:
        """State of the touched parts after a batch."""
        path = f"{self.folder}/v={batch_id}"
        rows.withColumn("part", self.part()).write.mode("overwrite").partitionBy("part").parquet(path)
        filled = {r.part for r in self.spark.read.schema(self.schema + ", part int").parquet(path).select("part").distinct().collect()}
        index = {p: v for p, v in self.versions(batch_id).items() if p not in parts} | dict.fromkeys(filled, batch_id)
        self.spark.createDataFrame(list(index.items()), "part int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/index/v={batch_id}")


def _each(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rent_decrease_stream(observations: DataFrame, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Rent decreases of listings as they arrive, with the last rent of every listing as state."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("obs_id", "run_id", "listing_id", "seen_at", "source_key", "rent_hkd").persist()
        held = PartedState(batch.sparkSession, state, RENTS, "listing_id")
        parts = held.touched(rows)
        old = held.read(batch_id, parts)
        down = history.rent_decreases(rows, "listing_id", initial=old.join(rows.select("listing_id").distinct(), "listing_id", "left_semi"))
        down.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        order = F.struct("run_id", "obs_id")
        last = rows.groupBy("listing_id").agg(F.max_by("rent_hkd", F.when(F.col("rent_hkd") != 0, order)).alias("now"))
        new = old.join(last, "listing_id", "full_outer").select("listing_id", F.coalesce("now", "rent").alias("rent"))
        held.write(batch_id, new, parts)
        rows.unpersist()

    return _each(observations, step, checkpoint)


def missing_stream(completed: DataFrame, log: Callable[[SparkSession], DataFrame], state: str, checkpoint: str) -> StreamingQuery:
    """Source state after every completed run. Only a completed run proves that a record is gone.

    ``completed`` is a stream of site_runs rows; ``log`` reads the observation log, of which only the runs of a batch are used: a log in
    folders per run is read in part. The state of sources without a run in the batch is left as it is.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = batch.select("source_site", "run_id", "started_at", "eligible").persist()
        held = PartedState(spark, state, STATE, "source_site")
        parts = held.touched(runs)
        numbers = [r.run_id for r in runs.select("run_id").distinct().collect()]  # the runs of one batch
        seen = log(spark).where(F.col("run_id").isin(numbers))
        rows = lookup_join(seen, runs.select("source_site", "run_id"), ["source_site", "run_id"], "inner", "source_key")
        held.write(batch_id, lifecycle.merge_state(held.read(batch_id, parts), rows, runs), parts)
        runs.unpersist()

    return _each(completed, step, checkpoint)


def rebuild_late(state: DataFrame, late: DataFrame, log: DataFrame, site_runs: DataFrame) -> DataFrame:
    """State after a late file of a closed run was appended: rebuilt from the log for its keys, kept for all others."""
    keys = late.select("source_key").distinct()
    rows = log.join(keys, "source_key", "left_semi")
    fresh = lifecycle.source_state(lifecycle.missing_events(lifecycle.sightings(rows), site_runs))
    return state.join(keys, "source_key", "left_anti").unionByName(fresh)


def latest_version(spark: SparkSession, folder: str, query: StreamingQuery, schema: str) -> DataFrame:
    """State after the last batch of a finished query; one that saw no data has none."""
    last = query.lastProgress
    return PartedState(spark, folder, schema, "").read(last.batchId + 1) if last else spark.createDataFrame([], schema)


def folders(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """New output, state and checkpoint folders on shared storage."""
    return tuple(new_path(spark, f"{name}-{part}") for part in ("out", "state", "checkpoint"))
