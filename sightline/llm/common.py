"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at once: texts are long, and an Arrow batch is held on both sides.
BATCH_ROWS = 1000

#: A group with more than this share of all rows is a heavy one; there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 1 / 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the names the operators use; other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(*(F.col(f"`{have}`").alias(name) for name, have in wanted.items()))


def numbered(df: DataFrame, row_col: str | None, **wanted: str) -> DataFrame:
    """``columns_of`` with a number of each row as ``row``: ``row_col``, or one that is only stable once written."""
    small_batches(df.sparkSession)
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    return df.select(row.alias("row"), *(F.col(f"`{have}`").alias(name) for name, have in wanted.items()))


def vocabulary_file(name: str) -> str:
    """Place of a file of the public tokenizers package; ``name`` may be a path of one's own."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
