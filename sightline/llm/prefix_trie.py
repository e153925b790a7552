"""Prefix trie of conversations: padded turn-id matrices, range shards, boundary nodes put together again.

A node of depth d is a distinct sequence of the first d turns (role, text). It is named by its smallest member and d.

1. *Rows.* A turn becomes 16 bytes of its SHA-256 and the length of its text, so that no text goes through a shuffle. The turns of
   a conversation, in the order of ``turn`` (null first), are one row; ``rebuild`` may first exchange its beginning.
2. *Shards.* Rows are dealt by ranges of (turn ids, conv_id): a node is a stretch of rows, and a sequence that very many
   conversations share is cut by conv_id instead of being a hot key. A shard holds about ``SHARD_TURNS`` turns.
3. *Matrix.* In a shard the ids become ranks and are laid out as padded matrices of ``WIDTH`` columns; rows with more turns go on in
   a further matrix, if another row still agrees with them. ``numpy.lexsort`` orders the rows, and differences to the row before, accumulated by OR over the
   columns, mark where nodes start. ``reduceat`` over the marks of each depth gives members, children, leaves and
   saved tokens; all are sums over rows, as each row counts the nodes that start with it and the leaf that ends with it.
4. *Boundaries.* Nodes on the path of the first or the last row of a shard may go on in the next one. They leave the shard as partial sums under the
   SHA-256 of their sequence, with the two rows themselves. The common beginning of the last row of a shard and the first of the
   next one says what both have counted; that is taken off, and the sums are put together by key.

Defined results: null roles and texts are empty; turns with an equal number (and repeated rows) are all turns, in the order of the SHA-256 of
their role and text; rows without a conv_id belong to no conversation and are not read; an empty table gives no nodes, not even a
root; other columns are not read. The turns of one conversation, 24 bytes each, are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import columns_of, partitions
from sightline.session import cut, lookup_join

SHARD_TURNS = 1 << 20
#: Columns of one matrix.
WIDTH = 16
#: Conversations of one family share its first member's beginning; the longest beginning is FAMILY_TURNS - 1 turns.
FAMILY, FAMILY_TURNS = 5, 9
_ID = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Rows of a matrix job that leave a task together.
_ROWS = 20_000


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, id (16 bytes of a SHA-256) and n_bytes of the text."""
    rows = columns_of(conversations, conv_id=conv, turn=turn, role=role, text=text).where("conv_id is not null")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.select(
        "conv_id", "turn", F.unhex(F.substring(digest, 1, 2 * _ID)).alias("id"), F.octet_length("text").cast("long").alias("n_bytes")
    )


def _row(turns: Column) -> list[Column]:
    """The ids of an array of turns as one binary value, and the lengths."""
    ids = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), ""))
    return [ids.alias("ids"), F.transform(turns, lambda t: t["n_bytes"]).alias("n_bytes")]


def _ordered(turns: DataFrame) -> DataFrame:
    listed = F.collect_list(F.struct(F.col("turn").isNotNull().alias("have"), "turn", "id", "n_bytes"))
    return turns.groupBy("base", "conv_id").agg(F.array_sort(listed).alias("turns"))


def whole(turns: DataFrame) -> DataFrame:
    """conv_id, ids, n_bytes of every conversation as it is."""
    rows = _ordered(turns.withColumn("base", F.col("conv_id")))
    return rows.select("conv_id", *_row(F.col("turns")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, ids, n_bytes of conversations whose first h turns are those of the first one of their family.

    The family of c starts with c - c % FAMILY, and h is crc32(c) % FAMILY_TURNS. A family goes to one task, by one shuffle.
    """
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    family = Window.partitionBy("base")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, FAMILY_TURNS - 1))).over(family)
    rows = _ordered(turns.select(base, "*").repartition(partitions(turns.sparkSession), "base"))
    rows = rows.select("conv_id", "turns", first.alias("first")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % FAMILY_TURNS).cast("int"))
    begin = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(begin, rest).alias("turns")).select("conv_id", *_row(F.col("turns")))


def _keys(ids: bytes, depth: int) -> list[bytes]:
    """SHA-256 of the first 0, 1, ... ``depth`` turns."""
    state, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(state.copy().digest())
        state.update(ids[_ID * d : _ID * (d + 1)])
    return out


def _common(a: bytes, b: bytes) -> int:
    """Number of turns that two rows begin with in common."""
    n = min(len(a), len(b)) // _ID
    x, y = (np.frombuffer(v, "V16", n) for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class Shard:
    """Sorted rows of a shard: conv ids, lengths, and how many turns each shares with the row before."""

    def __init__(self, conv: np.ndarray, ids: list[bytes], n_bytes: list[np.ndarray]) -> None:
        length = np.array([len(x) // _ID for x in ids], np.int64)
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(ids), "S1").reshape(-1, _ID).view("V16").ravel() if length.sum() else np.zeros(0, "V16")
        rank = _ranks(flat)
        order, shared = self._sorted(conv, length, start, rank)
        self.conv, self.length, self.shared = conv[order], length[order], shared
        bytes_before = np.r_[0, np.cumsum(np.concatenate(n_bytes))] if n_bytes else np.zeros(1, np.int64)
        self.bytes_before, self.start = bytes_before, start[order]
        self.first, self.last = int(order[0]), int(order[-1])

    @staticmethod
    def _sorted(conv: np.ndarray, length: np.ndarray, start: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(conv)
        order, shared = np.arange(n), np.zeros(n, np.int64)
        slots, group, done = np.arange(n), np.zeros(n, np.int64), 0
        while len(slots):
            rows = order[slots]
            width = max(1, min(WIDTH, int((length[rows] - done).max())))
            matrix = np.full((len(rows), width), -1, np.int64)
            for c in range(width):
                have = length[rows] > done + c
                matrix[have, c] = rank[start[rows[have]] + done + c]
            # of rows that agree in all columns, those that end here come first
            by = np.lexsort((conv[rows], length[rows] > done + width, *matrix.T[::-1], group))
            rows, matrix, group = rows[by], matrix[by], group[by]
            order[slots] = rows
            # where a node starts: a new group, or a column that differs, accumulated from left to right
            change = np.ones((len(rows), width + 1), bool)
            change[1:, 0] = group[1:] != group[:-1]
            change[1:, 1:] = matrix[1:] != matrix[:-1]
            starts = np.logical_or.accumulate(change, axis=1)
            same = ~starts[:, 0]
            agreed = np.where(starts[:, 1:].any(axis=1), starts[:, 1:].argmax(axis=1), width)
            shared[slots[same]] = np.minimum(done + agreed[same], length[rows[same]])
            # rows that agree with a neighbour in all columns go on, if they have more turns
            inner = ~starts[:, -1]
            tied = inner | np.r_[inner[1:], False]
            group = np.cumsum(~inner)
            done += width
            on = tied & (length[rows] > done)
            slots, group = slots[on], group[on]
        return order, shared

    def bytes_between(self, rows: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Bytes of the turns of depth a + 1 to b."""
        at = self.start[rows]
        return self.bytes_before[at + np.maximum(a, b)] - self.bytes_before[at + a]


def _ranks(flat: np.ndarray) -> np.ndarray:
    """Ranks of ids in the order of their bytes."""
    if len(flat) == 0:
        return np.zeros(0, np.int64)
    words = flat.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.r_[False, (words[order][1:] != words[order][:-1]).any(axis=1)]
    rank = np.zeros(len(flat), np.int64)
    rank[order] = np.cumsum(new)
    return rank


_FIELDS = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent", pa.binary()),
    ("shard", pa.int64()), ("ends", pa.string()), ("first_ids", pa.binary()), ("first_bytes", pa.list_(pa.int64())), ("last_ids", pa.binary()),
]
_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string,"
    " key binary, parent binary, shard long, ends string, first_ids binary, first_bytes array<long>, last_ids binary"
)


def _nodes(shard: Shard, keys: tuple[list[bytes], list[bytes]]) -> Iterator[dict]:
    """Columns of the nodes of each depth; those with a key are boundary nodes."""
    n = len(shard.conv)
    leaf = (np.r_[shard.shared[1:], -1] < shard.length).astype(np.int64)
    rows = np.arange(n)
    above, above_conv, above_key = np.zeros(1, np.int64), np.zeros(1, np.int64), [None]
    for depth in range(int(shard.length.max()) + 1):
        rows = rows[shard.length[rows] >= depth]
        at = np.flatnonzero(shard.shared[rows] < depth) if depth else np.zeros(1, np.int64)
        at = at if len(at) and at[0] == 0 else np.r_[0, at]
        count = np.diff(np.r_[at, len(rows)])
        conv = np.minimum.reduceat(shard.conv[rows], at)
        child = (shard.length[rows] > depth) & (shard.shared[rows] <= depth)
        saved = shard.bytes_between(rows, max(depth - 1, 0), np.minimum(shard.shared[rows], shard.length[rows]))
        heads = rows[at]
        up = np.searchsorted(above, heads, "right") - 1
        ending = np.add.reduceat((shard.length[rows] == depth).astype(np.int64), at)
        key: list[bytes | None] = [None] * len(at)
        if depth <= shard.length[0]:
            key[0] = keys[0][depth]
        if depth <= shard.length[-1]:
            key[-1] = keys[1][depth]
        ends: list[str | None] = [None] * len(at)
        hashes: list[str | None] = [_NO_ENDS] * len(at)
        for i in np.flatnonzero(ending):
            ends[i] = ",".join(map(str, shard.conv[rows[at[i]] : rows[at[i]] + ending[i]].tolist()))
        for i in {0, len(at) - 1, *np.flatnonzero(ending).tolist()}:
            if key[i] is not None:
                hashes[i], ends[i] = None, ends[i] or ""
            elif ends[i] is not None:
                hashes[i], ends[i] = hashlib.sha256(ends[i].encode()).hexdigest(), None
        parent = [above_key[u] if depth else None for u in up] if any(above_key) else [None] * len(at)
        known = above_conv[up]
        yield {
            "conv_id": conv, "depth": np.full(len(at), depth),
            "parent_conv_id": pa.array(known, pa.int64(), mask=np.array([p is not None for p in parent]) | (depth == 0)),
            "n_convs": count, "n_children": np.add.reduceat(child.astype(np.int64), at), "n_leaves": np.add.reduceat(leaf[rows], at),
            "saved_tokens": np.add.reduceat(saved, at), "ends_sha256": hashes, "key": key, "parent": parent, "ends": ends,
        }
        above, above_conv, above_key = heads, conv, key


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    made = [pa.nulls(n, t) if columns.get(c) is None else pa.array(columns[c], t) if not isinstance(columns[c], pa.Array) else columns[c] for c, t in _FIELDS]
    return pa.RecordBatch.from_arrays(made, schema=pa.schema(_FIELDS))


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard, then one row with its first and last row."""
    conv: list[np.ndarray] = []
    ids: list[bytes] = []
    n_bytes: list[np.ndarray] = []
    for batch in batches:
        conv.append(batch.column("conv_id").to_numpy())
        ids += batch.column("ids").to_pylist()
        lists = batch.column("n_bytes")
        n_bytes.append(lists.flatten().to_numpy())
    if not ids:
        return
    shard = Shard(np.concatenate(conv), ids, n_bytes)
    first, last = ids[shard.first], ids[shard.last]
    number = TaskContext.get().partitionId()
    keys = _keys(first, len(first) // _ID), _keys(last, len(last) // _ID)
    held: list[dict] = []
    count = 0
    for columns in _nodes(shard, keys):
        size = len(columns["conv_id"])
        for a in range(0, size, _ROWS):
            part = {c: v[a : a + _ROWS] for c, v in columns.items()}
            rows = len(part["conv_id"])
            held.append(_batch({**part, "shard": np.full(rows, number)}, rows))
            count += rows
            if count >= _ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    first_bytes = np.diff(shard.bytes_before[shard.start[0] : shard.start[0] + shard.length[0] + 1])
    yield _batch({"shard": [number], "first_ids": [first], "first_bytes": [first_bytes], "last_ids": [last]}, 1)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring shards have both counted, by key: children, leaves and saved tokens."""
    for batch in batches:
        for last, first, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("before", "first_ids", "first_bytes")), strict=True):
            both = _common(last, first)
            keys = _keys(first, both)
            again = np.r_[np.cumsum(np.array(n_bytes[:both], np.int64)[::-1])[::-1], 0] if both else np.zeros(1, np.int64)
            saved = np.r_[again[:1], again[:both]] if both else again
            whole_row = both == len(last) // _ID  # the last row goes on, so it ends in no leaf (or once more)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.binary()), "n_children": pa.array([-1] * both + [0], pa.int64()),
                "n_leaves": pa.array([-int(whole_row)] * (both + 1), pa.int64()), "saved_tokens": pa.array(saved, pa.int64()),
            })


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come in order; a piece at a time is held."""
    at, state, some = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state, some = key, hashlib.sha256(), False
            if ends:
                state.update((("," if some else "") + ends).encode())
                some = True
        if out:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in out], "ends_sha256": [h for _, h in out]})
    if at is not None:
        yield pa.RecordBatch.from_pydict({"key": [at], "ends_sha256": [state.hexdigest()]})


def _boundary(parts: DataFrame, shards: DataFrame) -> DataFrame:
    """Boundary nodes from the partial sums of their shards."""
    n = partitions(parts.sparkSession)
    # one row per shard, however many conversations there are
    pairs = shards.withColumn("before", F.lag("last_ids").over(Window.orderBy("shard"))).where("before is not null")
    taken = pairs.select("before", "first_ids", "first_bytes").mapInArrow(_corrections, "key binary, n_children long, n_leaves long, saved_tokens long")
    sums = ["n_children", "n_leaves", "saved_tokens"]
    none = F.lit(None)
    fixed = taken.select(
        "key", none.cast("long").alias("conv_id"), none.cast("long").alias("depth"), F.lit(0).cast("long").alias("n_convs"), *sums, none.cast("binary").alias("parent")
    )
    parts_ = parts.select("key", "conv_id", "depth", "n_convs", *sums, "parent").unionByName(fixed)
    nodes = parts_.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n_convs").alias("n_convs"),
        *(F.sum(c).alias(c) for c in sums),
    )
    pieces = parts.select("key", "shard", "ends").repartition(n, "key").sortWithinPartitions("key", "shard")
    return nodes.join(pieces.mapInArrow(_digested, "key binary, ends_sha256 string"), "key")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of ``rows`` (conv_id, ids, n_bytes): one row each, with the columns ``NODE``."""
    rows = cut(rows.select("conv_id", "ids", "n_bytes"), "rows")
    turns = rows.agg(F.sum(F.size("n_bytes")).alias("n")).first().n or 0
    shards = max(min(partitions(rows.sparkSession), 64), turns // SHARD_TURNS)
    found = cut(rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_sharded, _DDL), "nodes")
    inner = found.where("conv_id is not null and key is null")
    boundary = cut(_boundary(found.where("key is not null"), found.where("first_ids is not null").select("shard", "first_ids", "first_bytes", "last_ids")), "boundary")
    named = boundary.select(F.col("key").alias("parent"), F.col("conv_id").alias("of"))
    below = inner.where("parent is not null").select(*NODE, "parent")
    below = below.unionByName(boundary.select(*(F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else F.col(c) for c in NODE), "parent"))
    below = lookup_join(below, named, ["parent"], "left", salt="conv_id").withColumn("parent_conv_id", F.col("of")).select(NODE)
    return inner.where("parent is null").select(NODE).unionByName(below)


def conversation_trie(conversations: DataFrame, rebuild: bool = True, **columns: str) -> DataFrame:
    """Nodes of the prefix trie of conversations; ``columns`` names conv, turn, role and text."""
    turns = turns_of(conversations, **columns)
    return trie(rebuilt(turns) if rebuild else whole(turns))
