"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark passages, mixing.

Every stage takes documents and returns those it keeps, all but the last with the columns they came with. Decisions are about
rows by their place in the Parquet files that a stage reads, so they hold whatever doc_ids are missing or repeated, whatever
other columns there are, and when a task has to run again. Rows that go are looked up by place: broadcast up to
``session.BROADCAST_ROWS`` rows, by shuffle beyond.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import fold_of
from sightline.llm.decontamination import decontaminate
from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.language import learn, predict
from sightline.llm.mixing import DIMENSIONS, classified, probabilities
from sightline.llm.near_dup import near_duplicates
from sightline.session import cut, lookup_join, new_path

#: A predicted language below this posterior counts as none.
LEAST_SCORE = 0.5
#: Bits for the place of a row in its file; the file's number is above.
ROW_BITS = 40


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, doc) of documents: the row's place in its Parquet file, or its number in a copy where documents are no file."""
    doc = F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc")
    try:
        rows = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), doc)
    except AnalysisException:
        return cut(docs.select(F.monotonically_increasing_id().alias("row"), doc), name)
    paths = sorted(r.path for r in rows.select("path").distinct().collect())  # as many as the files that the driver lists anyway
    files = docs.sparkSession.createDataFrame([(p, i << ROW_BITS) for i, p in enumerate(paths)], "path string, base long")
    return rows.join(F.broadcast(files), "path").select((F.col("base") + F.col("place")).alias("row"), "doc")


def _view(rows: DataFrame) -> DataFrame:
    return rows.select("row", "doc.doc_id", "doc.text", "doc.lang", "doc.source")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return lookup_join(rows, cut(gone.select("row").distinct(), "gone"), ["row"], "left_anti", salt="row").select("doc.*")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language with a posterior of at least LEAST_SCORE."""
    rows = _numbered(docs, "language")
    view = _view(rows)
    labelled = view.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(view.select("row", "text"), learn(labelled.select("doc_id", "text", "lang")))
    return _without(rows, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)))


def by_exact_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that with the largest doc_id."""
    rows = _numbered(docs, "exact")
    return _without(rows, exact_dedup(_view(rows), row_col="row").where("not kept"))


def by_near_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, that with the smallest doc_id."""
    rows = _numbered(docs, "near")
    return _without(rows, near_duplicates(_view(rows), row_col="row").where("not kept"))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    rows = _numbered(docs, "benchmark")
    hits = decontaminate(_view(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return _without(rows, hits.select(F.col("doc_id").alias("row")))


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by the probabilities of the target mixture; adds topic, n_tokens and weight (1 / probability)."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"))
    rows = classified(rows, "doc.doc_id", "doc.text", "doc.source", "doc.lang", None).select("doc", "mix.*")
    chances = probabilities(rows.select(*DIMENSIONS, "n_tokens"))
    rows = lookup_join(rows, chances, DIMENSIONS, "inner", salt="draw", rows=100_000).where("draw < probability")
    added = {"topic": F.col("topic"), "n_tokens": F.col("n_tokens"), "weight": 1 / F.col("probability")}
    return rows.select("doc.*", *(c.alias(n) for n, c in added.items() if n not in docs.columns))


STAGES = [
    ("language", by_language),
    ("exact_dedup", by_exact_text),
    ("near_dup", by_near_text),
    ("decontamination", by_benchmark),
    ("mixing", by_mixture),
]
#: The language model, the classes of near copies and the raked weights have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
