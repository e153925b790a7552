"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Every text is normalised (A-Z lower-cased, null counts as empty) and digested once; (row, doc_id, digest) is written
   to shared storage, so the texts are read a single time.
2. A Misra-Gries summary (frequent-items sketch) finds candidates for frequent digests. Summaries are built per group of
   partitions and then combined, so that no task receives more than ``SUMMARIES`` of them.
3. The candidates are verified by exact counts. Their winners, at most ``TRACKED`` rows, are broadcast and joined on the
   map side: rows of a frequent digest are never shuffled by it.
4. All remaining digests are rare, and are grouped and joined by an ordinary shuffle.

Defined results: the row with the largest doc_id stays, a null doc_id being smaller than any; of rows with equal doc_id
and text one stays. Empty texts form one group. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import numbered
from sightline.session import cut

#: Digests that a summary tracks (a power of two). A digest with more than about 1 / 1000 of all rows is always found.
TRACKED = 4096
#: Summaries that are combined by one task.
SUMMARIES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id and the SHA-256 of the normalised text, as a written table."""
    rows = numbered(docs, row_col, doc_id=id_col, text=text_col).select(
        "row", "doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")
    )
    return cut(rows, "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """Exact group size and winner of the digests that a Misra-Gries summary finds frequent; at most TRACKED rows."""
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SUMMARIES)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(hex(digest), {TRACKED})").alias("summary")
    )
    # grouped, as a partition without a summary cannot be combined
    top = parts.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(summary, {TRACKED})").alias("summary")).select(
        F.explode(F.expr(f"approx_top_k_estimate(summary, {TRACKED // 4})")).alias("top")
    )
    candidates = top.where("top.count > 1").select(F.unhex("top.item").alias("digest"))
    return cut(groups(rows.join(F.broadcast(candidates), "digest", "left_semi")), "frequent")


def groups(rows: DataFrame) -> DataFrame:
    """Size and winner of each digest: the largest doc_id, and the largest row number among equal ones."""
    sizes = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"), F.max("row").alias("row"))
    best = sizes.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    kept = sizes.select(F.col("digest").alias("d"), F.col("doc_id").alias("id"), F.col("row").alias("keep_row"))
    return best.join(kept, (F.col("d") == F.col("digest")) & F.col("keep_id").eqNullSafe(F.col("id"))).select(
        "digest", "group_size", "keep_id", "keep_row"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    ``row`` is a number of the row: ``row_col`` if that is given, else one of the operator's own.
    """
    rows = digests(docs, id_col, text_col, row_col)
    if rows.isEmpty():  # there is no summary of nothing
        return rows.select(
            "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    heavy = F.broadcast(frequent(rows))
    rest = rows.join(heavy, "digest", "left_anti")
    columns = ["row", "doc_id", "digest", "group_size", "keep_id", "keep_row"]
    both = rows.join(heavy, "digest").select(columns).union(rest.join(groups(rest), "digest").select(columns))
    return both.select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
