"""Mixing a corpus to target weights by iterative proportional fitting.

*Cells.* Documents are counted by (source, language, topic); a cell has the tokens of its documents. Where no topic
column is named, a plain rule on the surface of the text gives one.

*Raking.* Each dimension has target shares of the tokens. Weights of the cells start as their tokens and are scaled to the
marginals of each dimension in turn, until all marginals are within ``TOLERANCE`` of their targets or ``CYCLES`` are over. Cells, not
documents, take part; each scaling is an aggregation by value, joined back and written.

*Sampling.* A document of a cell is drawn with probability min(1, c * weight / tokens of the cell). The scale c is set so
that the expected tokens are ``share`` of all: every pass over the cells tries ``TRIES`` scales at once and keeps the interval in
which the answer lies. Draws are independent (Poisson sampling) by a hash of id and text, so equal rows are drawn alike and a
rerun draws the same documents.

Targets default to observed shares to the power ``FLATTEN``, for topics to the observed shares. A mapping may give others: values
that it leaves out share the rest of 1 as observed. Defined results: null values are a value of their own; null texts
have no tokens, and documents in cells without tokens are never drawn; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut, lookup_join

DIMENSIONS = ["source", "lang", "topic"]
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}
SHARE = 0.5
TOLERANCE = 1e-4
CYCLES = 30
TRIES = 64
SEED = 17


def topic_of(text: Column) -> Column:
    """Topic by surface: table, code, contact, shout, note or prose."""
    # plain searches and the cheapest pattern first: only texts without a lower-case letter are upper-cased
    code = text.contains("{") | text.contains("}") | text.contains(";") | text.contains("</")
    contact = text.contains("@") | (text.contains("+") & text.rlike(r"\+[0-9]")) | text.rlike("[0-9]{7}")
    shout = ~text.rlike("[a-z]") & (F.upper(text) == text) & text.rlike("[A-Z]")
    return (
        F.when(text.contains(" | "), "table").when(code, "code").when(contact, "contact").when(F.length(text) < 200, "note")
        .when(shout, "shout").otherwise("prose")
    )


def classified(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    """``docs`` with the three dimensions, tokens and the draw of each document as a struct ``mix``."""
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    topic = F.col(topic_col) if topic_col else topic_of(text)
    draw = F.pmod(F.xxhash64(doc_id, text, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    values = zip(DIMENSIONS, (F.col(source_col), F.col(lang_col), topic), strict=True)
    tokens = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    return docs.withColumn(
        "mix", F.struct(*(F.coalesce(c.cast("string"), F.lit("∅")).alias(n) for n, c in values), tokens.alias("n_tokens"), draw.alias("draw"))
    )


def target_shares(cells: DataFrame, dimension: str, given: Mapping[str, float] | None) -> DataFrame:
    """(value, target) of a dimension; targets sum to 1 over the values that have tokens."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("seen")).where("seen > 0")
    if given:
        table = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, asked double")
        sums = sums.join(F.broadcast(table), "value", "left")
        rest = sums.agg(F.coalesce(F.sum("asked"), F.lit(0.0)).alias("asked"), F.sum(F.when(F.col("asked").isNull(), F.col("seen"))).alias("other")).first()
        left = max(0.0, 1.0 - rest.asked) / (rest.other or 1)
        share = F.coalesce("asked", F.col("seen") * F.lit(left))
    else:
        share = F.pow("seen", F.lit(FLATTEN[dimension]))
    sums = cut(sums.select("value", share.alias("share")), "targets")
    total = sums.agg(F.sum("share")).first()[0]
    return sums.select("value", (F.col("share") / F.lit(float(total or 1))).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, cycles: int = CYCLES) -> DataFrame:
    """Cells with a ``weight`` whose marginals are the targets. ``cells``: the dimensions and tokens."""
    total = cells.agg(F.sum("tokens")).first()[0]
    cells = cells.withColumn("weight", F.col("tokens").cast("double") / F.lit(float(total or 1)))
    for _ in range(cycles):
        for dimension in DIMENSIONS:
            sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("sum")).where("sum > 0")
            factors = sums.join(targets[dimension], "value").select(
                F.col("value").alias(dimension), (F.col("target") / F.col("sum")).alias("factor"), F.abs(F.col("sum") / F.col("target") - 1).alias(f"off_{dimension}")
            )
            cells = cells.drop(f"off_{dimension}").join(factors, dimension, "left")
            cells = cut(cells.withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor"), "raked")
        if (cells.agg(F.max(F.greatest(*(f"off_{d}" for d in DIMENSIONS)))).first()[0] or 0.0) <= tolerance:
            break
    return cells


def calibrate(cells: DataFrame, share: float) -> float:
    """Scale c at which the expected tokens are ``share`` of all."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    total, least = cells.where("weight > 0").agg(F.sum("tokens").cast("double"), F.min(ratio)).first()
    if not total:
        return 0.0
    everything = cells.agg(F.sum("tokens").cast("double")).first()[0]
    wanted, low, high = share * everything, 0.0, 1 / least
    if wanted >= total:
        return high
    for _ in range(5):
        tries = [low + (high - low) * (i + 1) / TRIES for i in range(TRIES)]
        sums = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * F.lit(c))).alias(f"s{i}") for i, c in enumerate(tries))).first()
        at = next((i for i, s in enumerate(sums) if s >= wanted), TRIES - 1)
        low, high = (tries[at - 1] if at else low), tries[at]
    return high


def probabilities(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE) -> DataFrame:
    """The probability of each cell. ``rows``: the dimensions and n_tokens."""
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, {d: target_shares(cells, d, (targets or {}).get(d)) for d in DIMENSIONS})
    scale = calibrate(raked, share)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens") * F.lit(scale))).otherwise(0.0)
    return raked.select(*DIMENSIONS, chance.alias("probability"))


def mix_sources(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, draw, sampled."""
    rows = cut(classified(docs, id_col, text_col, source_col, lang_col, topic_col).select(F.col(id_col).alias("doc_id"), "mix.*"), "classified")
    rows = lookup_join(rows, probabilities(rows, targets, share), DIMENSIONS, "inner", salt="doc_id", rows=100_000)
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", "probability", "draw", (F.col("draw") < F.col("probability")).alias("sampled"))
