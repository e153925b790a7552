"""Repeated word spans by a compacted de Bruijn graph.

Words are maximal runs of characters other than ASCII white space, unchanged. An edge of the graph is a window of ``K``
consecutive words of one document; its nodes are the K - 1 words at either end.

1. *Edges, by minimizer.* Each window takes the smallest hash of its runs of ``M`` words. Consecutive windows with the
   same occurrence of a minimizer travel together (a super-k-mer), so a document sends about a sixth of its windows as rows, packed per
   bucket of minimizers. Equal super-k-mers of one task are compacted before the shuffle: only the first is sent, so a
   hot passage arrives at most once per task.
2. *Repeated edges.* A bucket holds every occurrence of its windows. Minimizers that occur once are dropped; of the
   others each repeated window is led back to its first coordinate (doc_id, word position), and windows that follow
   each other both here and at their first coordinates are joined: a non-branching path within the bucket.
3. *Compaction.* Paths of different buckets meet in the words of a document. Where a path ends at the word where the next
   begins, and their sources touch in the same way, no branch lies between them, and they become one span.
4. *Verification.* Each span is read again at its own and at its source coordinates, and the SHA-256 of both word runs is
   compared. Spans that differ (colliding hashes) are taken out and the documents are computed again.

A word is removed if a window covers it whose words also start earlier: in a row that ranks before, or earlier in the same
one. Rows rank by doc_id. Windows are judged on the input. Defined results: a null text has no words; a null doc_id ranks after all
others; rows that share a doc_id or have none rank among each other by a hash of their text, so of equal rows one stays; an empty table
gives no rows; other columns are not read. Where ids are missing or repeated, rows are first numbered in that order, in a written
table; otherwise the ids are the numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import columns_of, partitions
from sightline.llm.tokens import U64, Chunk, chunks, mix, rolling, whitespace_table, words
from sightline.session import cut

K = 20
M = 8
#: Windows that a task gathers before it sends them.
FLUSH = 1 << 21
_TABLE = whitespace_table()
_PATHS = "doc long, start long, n long, source long, source_start long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class _SuperKmers:
    """Super-k-mers of some texts as columns; ``hashes`` has the window hashes of all, one after another."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> None:
        self.doc, self.start, self.n, self.key, self.hashes = doc, start, n, key, hashes

    @staticmethod
    def of(chunk: Chunk, ids: np.ndarray) -> _SuperKmers:
        found = words(chunk, _TABLE)
        codes = rolling(found.code, K)
        runs = rolling(found.code, M)
        low = _sliding_min(runs, K - M + 1)
        inside = found.text[: len(codes)] == found.text[K - 1 :] if len(codes) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        if len(at) == 0:
            none = np.zeros(0, np.int64)
            return _SuperKmers(none, none, none, np.zeros(0, U64), np.zeros(0, U64))
        text, low = found.text[at], low[at]
        leaves = runs[at] == low  # the next window finds its minimizer elsewhere, be it the same hash again
        new = np.r_[True, (text[1:] != text[:-1]) | (low[1:] != low[:-1]) | leaves[:-1]]
        head = np.flatnonzero(new)
        return _SuperKmers(ids[text[head]], (at - found.first[text])[head], np.diff(np.r_[head, len(at)]), low[head], codes[at])

    @staticmethod
    def joined(parts: list[_SuperKmers]) -> _SuperKmers:
        return _SuperKmers(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "start", "n", "key", "hashes")))

    def take(self, rows: np.ndarray) -> _SuperKmers:
        n = self.n[rows]
        first = (np.cumsum(self.n) - self.n)[rows]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return _SuperKmers(self.doc[rows], self.start[rows], n, self.key[rows], self.hashes[at])

    def whole(self) -> np.ndarray:
        """One hash per super-k-mer, of all its windows."""
        first = np.cumsum(self.n) - self.n
        place = np.arange(len(self.hashes)) - np.repeat(first, self.n)
        return np.add.reduceat(mix(self.hashes + place.astype(U64)), first) if len(first) else np.zeros(0, U64)


def _lead(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that do not come first among equal keys, the row that does)."""
    order = np.lexsort((start, doc, key))
    sorted_key = key[order]
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(order) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    later = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return order[later], lead[later]


def _path_batch(doc: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (doc, start, n, source, source_start)],
        names=["doc", "start", "n", "source", "source_start"],
    )


def _packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["bucket", "rows", "doc", "start", "n", "source", "source_start"]

    def flush(parts: list[_SuperKmers]) -> Iterator[pa.RecordBatch]:
        all_ = _SuperKmers.joined(parts)
        later, lead = _lead(all_.whole(), all_.doc, all_.start)
        local = _path_batch(all_.doc[later], all_.start[later], all_.n[later], all_.doc[lead], all_.start[lead])
        if local.num_rows:
            place = [pa.array(all_.doc[later] % buckets), pa.nulls(local.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*place, *local.columns], names=names)
        left = np.ones(len(all_.doc), bool)
        left[later] = False
        rest = all_.take(np.flatnonzero(left))
        bucket = (mix(rest.key) % U64(buckets)).astype(np.int64)
        rest, bucket = rest.take(order := np.lexsort((rest.start, rest.doc, bucket))), bucket[order]
        bound = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, int)
        window = np.r_[0, np.cumsum(rest.n)]
        small, short = (rest.key >> U64(32)).astype(np.uint32), (rest.hashes >> U64(32)).astype(np.uint32)
        extra = (rest.hashes & U64(0xFFFF)).astype(np.uint16)
        blobs = []
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            ids = rest.doc[a:b]
            head = np.array([b - a, ids[0]], np.int64)
            blobs.append(b"".join(x.tobytes() for x in (
                head, np.diff(ids, prepend=ids[0]), rest.start[a:b].astype(np.uint32), rest.n[a:b].astype(np.uint32), small[a:b],
                short[window[a] : window[b]], extra[window[a] : window[b]],
            )))
        for a in range(0, len(blobs), 256):
            some = blobs[a : a + 256]
            empty = [pa.nulls(len(some), pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([pa.array(bucket[bound[a : a + len(some)]]), pa.array(some, pa.binary()), *empty], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[_SuperKmers] = []
        held = 0
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for chunk in chunks(batch.column("text")):
                parts.append(_SuperKmers.of(chunk, ids[chunk.first : chunk.first + chunk.n]))
                held += len(parts[-1].hashes)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _unpacked(blob: bytes) -> _SuperKmers:
    count, first = np.frombuffer(blob, np.int64, 2)
    doc = np.cumsum(np.frombuffer(blob, np.int64, count, 16)) + first
    start, n, key = (np.frombuffer(blob, np.uint32, count, 16 + 8 * count + 4 * count * i) for i in range(3))
    windows, at = int(n.sum()), 16 + 20 * int(count)
    high, low = np.frombuffer(blob, np.uint32, windows, at), np.frombuffer(blob, np.uint16, windows, at + 4 * windows)
    hashes = (high.astype(U64) << U64(16)) | low
    return _SuperKmers(doc, start.astype(np.int64), n.astype(np.int64), key.astype(U64), hashes)


def _bucket_paths(parts: list[_SuperKmers]) -> pa.RecordBatch | None:
    all_ = _SuperKmers.joined(parts)
    order = np.argsort(all_.key, kind="stable")
    key = all_.key[order]
    same = key[1:] == key[:-1]
    rows = np.sort(order[np.r_[False, same] | np.r_[same, False]])
    if len(rows) == 0:
        return None
    some = all_.take(rows)
    place = np.arange(len(some.hashes)) - np.repeat(np.cumsum(some.n) - some.n, some.n)
    doc, start = np.repeat(some.doc, some.n), np.repeat(some.start, some.n) + place
    later, lead = _lead(mix(np.repeat(mix(some.key), some.n) ^ some.hashes), doc, start)
    if len(later) == 0:
        return None
    order = np.lexsort((start[later], doc[later]))
    doc, start, source, source_start = doc[later[order]], start[later[order]], doc[lead[order]], start[lead[order]]
    go_on = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1]) & (source_start[1:] == source_start[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~go_on])
    return _path_batch(doc[head], start[head], np.diff(np.r_[head, len(doc)]), source[head], source_start[head])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of each bucket, and those that tasks found by themselves; rows come sorted by bucket."""
    parts: list[_SuperKmers] = []
    at = None
    for batch in batches:
        found_before = pa.compute.is_null(batch.column("rows"))
        if (local := batch.filter(found_before)).num_rows:
            yield local.select(["doc", "start", "n", "source", "source_start"])
        batch = batch.filter(pa.compute.invert(found_before))
        for bucket, blob in zip(batch.column("bucket").to_numpy(), batch.column("rows"), strict=True):
            if bucket != at and parts:
                if (found := _bucket_paths(parts)) is not None:
                    yield found
                parts = []
            at = bucket
            parts.append(_unpacked(blob.as_py()))
    if parts and (found := _bucket_paths(parts)) is not None:
        yield found


def repeated_paths(docs: DataFrame) -> DataFrame:
    """Runs of windows that also start earlier: doc, start, n windows, source, source_start. ``docs``: doc, text."""
    n = partitions(docs.sparkSession)
    sent = docs.mapInArrow(_packed(8 * n), "bucket long, rows binary, " + _PATHS)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_paths, _PATHS)


def compact(paths: DataFrame) -> DataFrame:
    """Spans: paths that go on without a branch, here and at their source, become one."""
    order = Window.partitionBy("doc", "source", "shift").orderBy("start", "n")
    rows = paths.withColumn("shift", F.col("start") - F.col("source_start")).withColumn("end", F.col("start") + F.col("n"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("path", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("doc", "source", "shift", "path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select(
        "doc", "start", (F.col("end") - F.col("start") + K - 1).alias("words"), "source", (F.col("start") - F.col("shift")).alias("source_start")
    )


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result of each document, and digests of the word runs that are to be compared."""
    for batch in batches:
        out = []
        for text, spans, reads in zip(batch["text"], batch["spans"], batch["reads"], strict=True):
            found = [] if text is None else text.encode().split()
            keep = np.ones(len(found), bool)
            seen = []
            for x in () if spans is None else spans:
                keep[x["start"] : x["start"] + x["words"]] = False
                seen.append((x["source"], x["source_start"], x["words"], _digest(found, x["start"], x["words"])))
            for x in () if reads is None else reads:
                seen.append((None, x["start"], x["words"], _digest(found, x["start"], x["words"])))
            left = found if keep.all() else [found[i] for i in np.flatnonzero(keep)]
            out.append((len(found), len(found) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), seen))
        frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "seen"])
        frame.insert(0, "doc", batch["doc"].to_numpy())
        yield frame


def _digest(found: list[bytes], start: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(found[start : start + n])).digest()


def remove_spans(docs: DataFrame, spans: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Removes the spans from the documents; ``seen`` has the digests of each span and of each source that is named.

    With ``only`` (doc) just these documents and those that hold or are the source of a span are read.
    """
    own = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "words", "source", "source_start")).alias("spans"))
    sources = spans.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "words").distinct()
    sources = sources.groupBy("doc").agg(F.collect_list(F.struct("start", "words")).alias("reads"))
    listed = own.join(sources, "doc", "full_outer")
    if only is not None:
        listed = listed.join(only, "doc", "full_outer")
    return docs.join(listed, "doc", "left" if only is None else "inner").select("doc", "text", "spans", "reads").mapInPandas(
        _removed,
        "doc long, n_words long, n_removed long, kept_sha256 string,"
        " seen array<struct<source: long, start: long, words: long, digest: binary>>",
    )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = columns_of(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    odd = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null")
    if odd.isEmpty():
        return _removed_from(docs).withColumnRenamed("doc", "doc_id")
    order = [F.asc_nulls_last("doc"), F.xxhash64("text")]
    placed = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(placed.select(F.monotonically_increasing_id().alias("row"), F.col("doc").alias("doc_id"), "text"), "rows")  # numbers rise with the order
    done = _removed_from(rows.select(F.col("row").alias("doc"), "text"))
    return rows.select(F.col("row").alias("doc"), "doc_id").join(done, "doc").drop("doc")


def _removed_from(docs: DataFrame) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256 of documents with numbers that none shares."""
    spans = cut(compact(repeated_paths(docs)), "spans")
    done = fresh = cut(remove_spans(docs, spans), "kept")
    while not (differ := _differing(fresh)).isEmpty():
        # colliding hashes: the spans are split into windows, those that differ go, and their documents are read again
        redo = cut(spans.join(differ, ["source", "source_start", "words"], "left_semi").select("doc").distinct(), "redo")
        spans = cut(_without(spans.join(redo, "doc", "left_semi"), differ), "spans")
        fresh = cut(remove_spans(docs, spans, redo), "kept")
        done = cut(done.join(redo, "doc", "left_anti").unionByName(fresh.join(redo, "doc", "left_semi")), "kept")
    return done.select("doc", "n_words", "n_removed", "kept_sha256")


def _differing(done: DataFrame) -> DataFrame:
    """Sources whose words are not those of every span that was led back to them."""
    seen = done.select("doc", F.explode("seen").alias("s")).select(
        F.coalesce("s.source", "doc").alias("source"), F.col("s.start").alias("source_start"), "s.words", "s.digest"
    )
    digests = seen.groupBy("source", "source_start", "words").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    return cut(digests.where("a <> b").drop("a", "b"), "differ")


def _without(spans: DataFrame, differ: DataFrame) -> DataFrame:
    keys = ["source", "source_start", "words"]
    bad = spans.join(differ, keys, "left_semi")
    halves = bad.where(F.col("words") > K).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("words") - K))).select(
        "doc", (F.col("start") + F.col("i")).alias("start"), F.lit(K).cast("long").alias("words"), "source",
        (F.col("source_start") + F.col("i")).alias("source_start"),
    )
    return spans.join(differ, keys, "left_anti").unionByName(halves.select(spans.columns)).select(spans.columns)
