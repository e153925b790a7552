"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

*Signatures.* A text is the multiset of its shingles of five words (lower-cased runs of letters and digits; a shorter
text is one shingle). The weight of a shingle is its count. Every shingle owns a hierarchy of Poisson processes, one
for each dyadic shell (0,1], (1,2], (2,4], (4,8] ... of the weight axis, whose points carry a time, a height in the shell
and a slot. A point belongs to a text if its height is within the weight of the shingle there; a slot keeps the earliest
time. Two texts then agree in a slot with a probability of exactly their weighted Jaccard similarity. Points are only
generated up to the time at which all slots are expected to be full, so that a long text costs one or two draws per
shingle; texts with an empty slot are carried on, until none has any.

*Banding.* ``BANDS`` bands of ``ROWS`` slots. Documents with equal multisets are one node from here on. In each bucket of a
band every node is tested against the smallest node of the bucket, each node first against the smallest of all these
(round 1), then against the others in whose class it is not yet (round 2). Nodes that still meet another class in a
bucket of three or more get signatures of other slots, in ``DEEP_BANDS`` bands of ``DEEP_ROWS``, which split the large buckets into parts
of more alike texts: there every node is tested against the first of its part, and all pairs of a part of at most ``SMALL``
nodes, ``DEEP_ROUNDS`` times with slots of their own. All these rounds only save work, by joining classes early; they leave
pairs of different classes untested, and ``remaining`` gives all of those that can reach
the threshold: every pair of a bucket of at most ``SMALL`` nodes, and in larger ones every pair that a prefix filter cannot
rule out. For the filter, a text's shingles are put in order, the rarest first; texts of that similarity share a shingle
early in both orders, with enough of both texts left behind it. So a family of texts that share a template and differ in
shingles of their own gives few pairs; one whose texts are mixtures of the same variants, with similarities a little below
the threshold, gives up to the square of a bucket, as no bound on whole texts tells its pairs apart.

*Verification.* The multiset overlap of every tested pair is computed from both whole texts. Classes are the connected
components of pairs at or above the threshold.

A pair of similarity 0.8 shares no bucket with a probability of 3e-5. Defined results: a text without words and a null
text are never duplicates; repeated rows are copies of one another; null and repeated doc_ids take part by row, and null ones
rank last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import numbered
from sightline.llm.components import components
from sightline.llm.tokens import U64, Chunk, chunks, letter_table, mix, rolling, words
from sightline.session import cut

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
ROUNDS = 2
DEEP_BANDS, DEEP_ROWS, DEEP_ROUNDS = 32, 8, 2
SMALL = 16
_TABLE = letter_table()


def shingles(chunk: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle of a chunk, in order of text."""
    found = words(chunk, _TABLE)
    codes = rolling(found.code, k)
    whole = found.text[: len(codes)] == found.text[k - 1 :] if len(codes) else np.zeros(0, bool)
    text, code = found.text[: len(codes)][whole], codes[whole]
    short = np.diff(found.first)
    short = np.flatnonzero((short > 0) & (short < k))
    if len(short):
        extra = [mix(np.bitwise_xor.reduce(mix(found.code[a:b] + np.arange(b - a, dtype=U64))).reshape(1))[0]
                 for a, b in zip(found.first[short], found.first[short + 1], strict=True)]
        text, code = np.concatenate([text, short]), np.concatenate([code, np.array(extra, U64)])
        order = np.argsort(text, kind="stable")
        text, code = text[order], code[order]
    return text, code


def weighted(text: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    if len(text) == 0:
        return text, code, np.zeros(0, np.int64)
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    head = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (code[1:] != code[:-1])])
    return text[head], code[head], np.diff(np.r_[head, len(text)])


def bag_minhash(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots times of the earliest points; infinite for texts without shingles."""
    best = np.full(n * slots, np.inf)
    total = np.bincount(text, weight, n) if len(text) else np.zeros(n)
    horizon = np.where(total > 0, slots * (np.log(slots) + 4) / np.maximum(total, 1), 0.0)
    shells = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # 1 for weight 1, 2 for 2, 3 for 3 and 4
    owner = np.repeat(np.arange(len(text)), shells)
    shell = np.arange(len(owner)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell == 0, 0.0, 2.0 ** (shell - 1))
    rate = np.maximum(low, 1.0)
    of, limit = text[owner], weight[owner].astype(float)
    seed = mix(code[owner] + (shell.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
    step = np.zeros(len(owner), np.int64)

    def gap(at: np.ndarray) -> np.ndarray:
        draw = mix(seed[at] + step[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        return -np.log1p(-((draw >> U64(11)).astype(float) * 2.0**-53)) / rate[at]

    live = np.arange(len(owner))
    time = gap(live)
    while True:
        while len(live := live[time[live] <= horizon[of[live]]]):
            draw = mix(seed[live] ^ (step[live].astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
            height = low[live] + (draw >> U64(32)).astype(float) * 2.0**-32 * rate[live]
            mine = height < limit[live]
            slot = ((draw & U64(0xFFFFFFFF)) * U64(slots) >> U64(32)).astype(np.int64)
            np.minimum.at(best, (of[live] * slots + slot)[mine], time[live][mine])
            step[live] += 1
            time[live] += gap(live)
        open_ = (total > 0) & np.isinf(best.reshape(n, slots)).any(axis=1)
        if not open_.any():
            return best.reshape(n, slots)
        horizon[open_] *= 2
        live = np.flatnonzero(open_[of])


def _banded(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, bands: int, rows: int) -> pa.ListArray:
    """Hashes of the bands of ``rows`` slots of each text."""
    times = bag_minhash(text, code, weight, n, bands * rows)
    value = mix(times.view(U64).reshape(n, bands, rows) + np.arange(rows, dtype=U64))
    found = mix(np.bitwise_xor.reduce(value, axis=2) + mix(np.arange(bands, dtype=U64)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(found.reshape(-1).view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            text, code, weight = weighted(*shingles(chunk))
            node, check = np.zeros(chunk.n, U64), np.zeros(chunk.n, U64)
            np.add.at(node, text, mix(code * U64(3) + weight.astype(U64)))
            np.add.at(check, text, mix(code * U64(5) + weight.astype(U64)))
            some = np.bincount(text, minlength=chunk.n) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(chunk.first, chunk.n) for c in ("row", "doc_id")),
                    pa.array(mix(node).view(np.int64), mask=~some),
                    pa.array(mix(check).view(np.int64), mask=~some),
                    _banded(text, code, weight, chunk.n, BANDS, ROWS),
                ],
                names=["row", "doc_id", "node", "checksum", "bands"],
            )


def _deep_signatures(turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bands of slots that are independent of the first ones and of those of other turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text, code, weight = weighted(*shingles(chunk))
                bands = _banded(text, mix(code + mix(np.full(1, turn, U64))), weight, chunk.n, DEEP_BANDS, DEEP_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(chunk.first, chunk.n), bands], names=["node", "bands"])

    return run


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, node (hash of the shingle multiset; null without words), checksum (a second hash) and band hashes."""
    return docs.mapInArrow(_signatures, "row long, doc_id long, node long, checksum long, bands array<long>")


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts."""
    raw = [(t or "").lower().encode() for t in (a, b)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    text, code, weight = weighted(*shingles(Chunk(0, 2, data, np.array([0, len(raw[0]), len(data)]))))
    first = text == 0
    _, x, y = np.intersect1d(code[first], code[~first], assume_unique=True, return_indices=True)
    shared = np.minimum(weight[first][x], weight[~first][y]).sum()
    total = weight.sum() - shared
    return float(shared / total) if total else 0.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [overlap(a.as_py(), b.as_py()) for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], names=["a", "b", "similarity"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Similarity of each pair of nodes, from the texts."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long, similarity double")


def candidates(buckets: DataFrame, classes: DataFrame | None, tested: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of a node and the first node of a bucket they share, in the order of nodes that ``turn`` gives.

    Without classes each node comes with one such node; with them, with all those of another class.
    """
    rank = F.xxhash64(F.col("node"), F.lit(turn)) if turn > 2 else F.col("node")
    rows = _with_class(buckets.withColumn("rank", rank), classes)
    mixed = rows.groupBy("bucket").agg(F.min("rank").alias("first"), F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = mixed.where("low < high").select("bucket", "first")
    rows = cut(rows.join(mixed, "bucket"), "mixed")
    heads = rows.where("rank = first").select("bucket", F.col("node").alias("b"), F.col("class").alias("class_b"))
    pairs = rows.join(heads, "bucket").where("class <> class_b")
    if classes is None:
        return pairs.groupBy(F.col("node").alias("a")).agg(F.min("b").alias("b"))
    return _untested(pairs.select(F.col("node").alias("a"), "b"), tested)


def _with_class(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return pairs.select(low, high).distinct().join(tested.select(low, high), ["a", "b"], "left_anti")


def _mixed(buckets: DataFrame, classes: DataFrame | None) -> DataFrame:
    """bucket, n, node, class of the buckets of three or more nodes in which classes meet; those of two have been tested."""
    rows = _with_class(buckets, classes)
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    return cut(rows.join(mixed.where("low < high and n > 2").select("bucket", "n"), "bucket"), "mixed")


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes of different classes in buckets of at most SMALL nodes."""
    few = rows.where(F.col("n") <= SMALL)
    left = few.select("bucket", F.col("class").alias("class_a"), F.col("node").alias("a"))
    right = few.select("bucket", F.col("class").alias("class_b"), F.col("node").alias("b"))
    return left.join(right, "bucket").where("a < b and class_a <> class_b").select("a", "b")


def deeper(buckets: DataFrame, classes: DataFrame, tested: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Untested pairs in the parts of the mixed buckets' nodes by longer bands: each node with the first, and all pairs of small parts."""
    nodes = _mixed(buckets, classes).select("node").distinct()
    signed = texts.join(nodes, "node").mapInArrow(_deep_signatures(turn), "node long, bands array<long>")
    rows = _with_class(cut(signed.select("node", F.explode("bands").alias("bucket")), "deep"), classes)
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "class")).alias("first")
    parts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), first)
    rows = cut(rows.join(parts.where("low < high").select("bucket", "n", "first"), "bucket"), "parts")
    heads = rows.where("class <> first.class").select(F.col("node").alias("a"), F.col("first.node").alias("b"))
    return _untested(heads.unionByName(_pairs_of_small(rows)), tested)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        for chunk in chunks(batch.column("text")):
            text, code, weight = weighted(*shingles(chunk))
            size = np.bincount(text, weight, chunk.n).astype(np.int64)
            columns = [node[chunk.first + text], code.view(np.int64), weight, size[text]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "code", "weight", "size"])


def _overlapping(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that a prefix filter cannot rule out. ``nodes``: node, class.

    With sizes x >= y, an overlap of at least t (x + y) / (1 + t) needs a shingle among the first x - t x + 1 of the one and
    the first y - 2 t y / (1 + t) + 1 of the other, and that many shingles from the first shared one on in both.
    """
    counts = cut(texts.join(nodes.select("node"), "node").mapInArrow(_counted, "node long, code long, weight long, size long"), "counts")
    # an edit makes several shingles that the same texts hold: these stand next to each other in the order and count as one
    common = counts.groupBy("code").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("holders")).where("n > 1")
    ordered = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "holders", "code").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("size") - F.coalesce(F.sum("weight").over(ordered), F.lit(0))
    part, slack = 2 * threshold / (1 + threshold), 1e-6  # of rounding
    first = counts.join(common, "code", "left").withColumn("left", left).where((F.col("n") > 1) & (F.col("left") >= threshold * F.col("size") - slack))
    first = first.groupBy("node", "size", F.col("holders").alias("code")).agg(F.max("left").alias("left"))
    first = cut(first.join(nodes, "node").select("code", "class", "node", "size", "left"), "prefixes")
    long_ = first.toDF("code", "class_a", "a", "size_a", "left_a")
    short = first.where(F.col("left") >= part * F.col("size") - slack).toDF("code", "class_b", "b", "size_b", "left_b")
    # members of one class never meet, however large it is
    met = short.groupBy("code", "class_b").agg(F.min("size_b").alias("low")).join(
        long_.groupBy("code", "class_a").agg(F.max("size_a").alias("high")), "code"
    ).where("class_a <> class_b and low <= high").select("code", "class_a", "class_b")
    pairs = met.join(short, ["code", "class_b"]).join(long_, ["code", "class_a"])
    needed = part / 2 * (F.col("size_a") + F.col("size_b")) - slack
    pairs = pairs.where((F.col("size_b") <= F.col("size_a")) & (F.least("left_a", "left_b") >= needed))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining(buckets: DataFrame, classes: DataFrame, tested: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """All untested pairs (a, b) of different classes that share a bucket and can reach the threshold.

    Buckets of two nodes have been tested by round 2.
    """
    rows = _mixed(buckets, classes)
    many = rows.where(F.col("n") > SMALL).select("bucket", "class", "node")
    pairs = _untested(_pairs_of_small(rows), tested)
    if many.isEmpty():
        return pairs
    shared = many.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    found = _overlapping(many.select("node", "class").distinct(), texts, threshold)
    found = found.join(shared.toDF("a", "buckets_a"), "a").join(shared.toDF("b", "buckets_b"), "b").where(F.arrays_overlap("buckets_a", "buckets_b"))
    return pairs.union(_untested(found.select("a", "b"), tested)).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None
) -> DataFrame:
    """One row per document: row, doc_id, class_id (smallest doc_id of its class), class_size, kept (one row per class).

    ``row`` is a number of the row: ``row_col`` (no two rows alike) if that is given, else one of the operator's own, fixed by a
    written copy of the ids and texts. The kept row of a class is one with its smallest doc_id; of equal rows one is kept.
    """
    source = numbered(docs, row_col, doc_id=id_col, text=text_col).withColumn("text", F.lower("text"))
    if not row_col:
        source = cut(source, "rows")
    signed = cut(signatures(source), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("checksum", "row")).alias("first")).select("node", "first.*")
    buckets = signed.where("node is not null").select("node", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = cut(buckets.join(shared.select("bucket"), "bucket", "left_semi"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes, "node").select("node", "row")
    texts = cut(source.select("row", "text").join(wanted, "row").select("node", "text"), "texts")
    links, classes = None, None
    for turn in range(1, ROUNDS + 1):
        pairs = cut(candidates(buckets, classes, links, turn), "pairs")
        if pairs.isEmpty():
            break
        found = verify(pairs, texts)
        links = cut(found if links is None else links.unionByName(found), "links")
        classes = components(links.where(F.col("similarity") >= threshold).select("a", "b"))
    else:
        for turn in range(1, DEEP_ROUNDS + 1):
            pairs = cut(deeper(buckets, classes, links, texts, turn), "pairs")
            if pairs.isEmpty():
                break
            links = cut(links.unionByName(verify(pairs, texts)), "links")
            classes = components(links.where(F.col("similarity") >= threshold).select("a", "b"))
    if links is not None:
        pairs = cut(remaining(buckets, classes, links, texts, threshold), "pairs")
        if not pairs.isEmpty():
            links = cut(links.unionByName(verify(pairs, texts)), "links")
            classes = components(links.where(F.col("similarity") >= threshold).select("a", "b"))
    return _classed(signed, nodes, classes)


def _classed(signed: DataFrame, nodes: DataFrame, classes: DataFrame | None) -> DataFrame:
    nodes = nodes.withColumnRenamed("checksum", "same").drop("row")
    if classes is None:
        nodes = nodes.withColumn("class", F.col("node"))
    else:
        nodes = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # a second document whose multiset hashes to the same node is told apart by the checksum
    alone = F.col("checksum").isNull() | (F.col("checksum") != F.col("same"))
    rows = signed.drop("bands").join(nodes, "node", "left").select(
        "doc_id", "row", F.when(~alone, F.col("class")).alias("class"), F.when(alone, F.col("row")).alias("single")
    )
    rows = cut(rows, "classed")
    sizes = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    sizes = sizes.where("n > 1")
    first = rows.join(sizes.select(F.col("class").alias("c"), "low"), (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("low")))
    sizes = sizes.join(first.groupBy("class").agg(F.min("row").alias("first")), "class")
    return rows.join(sizes, "class", "left").select(
        "row", "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("class_id"),
        F.coalesce("n", F.lit(1)).alias("class_size"), F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"),
    )
