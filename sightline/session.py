"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def build_session(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a new one only for a local master without it."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        folder = configured
    elif sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: a table on shared storage, computed once and readable after the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over three tasks per core, for costly work on each row.

    A table of narrow rows is one small file for millions of them, which Spark reads in one or two tasks. With the number given,
    adaptive execution does not put the parts together again.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the log: the join shuffles both sides and sorts them.

    Without it the size of a side is guessed from its compressed files, and an explode counts as nothing, so that Spark
    broadcasts tables of a million rows through the driver as small ones.
    """
    return df.hint("merge")


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str, salt: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join of a log-sized side with a dimension that repeats no key.

    The dimension is broadcast only after its row count was found small; beyond
    that it is replicated over salts, so that a hot key of the big side spreads
    over many tasks. ``salt`` is a column of the big side that varies within a key.
    """
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    n = 64
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
        .join(shuffled(salted), [*on, "_salt"], how)
        .drop("_salt")
    )
