"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: link each node's larger neighbours to the smallest node next to it. Small star: the others."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    moved = both.join(low, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node of ``links`` (columns a, b): class is the smallest node of the component.

    The number of rounds grows with the logarithm of the diameter; each is cut, and nothing but the
    number of links and a checksum of them comes to the driver.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        links = cut(_star(cut(_star(links, True), "large"), False), "small")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("class", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(roots)
