"""Token ids in binary files: frequency ranks in byte-aligned codes of variable length, control bytes apart.

*Tokenise.* Texts go through a public tokenizer. A task cuts them at ASCII white space, encodes each distinct word once and
joins the ids again, which gives what encoding the whole text gives, as the vocabulary has no token with white space in it;
a tokenizer of another kind is given whole texts. Every task counts its ids too.

*Rank.* The counts of all documents are summed, and ids are ranked by falling count, then by id. The table is as long as
the vocabulary at most, so it goes to the driver and into each file.

*Write.* Documents are dealt by ranges of (doc_id, digest of the ids), so that a repeated id is no hot key, and a task writes its
range in order, in files of about ``FILE_BYTES``. A file is a header with the ranks, then blocks of about ``BLOCK_IDS`` ids: doc_ids, lengths,
control bytes, data bytes. Ranks below 256 take one data byte, others two, three or four; a control byte has the lengths of four
ranks, two bits each, and is looked up in a table of 256 rows when numpy decodes a block. Each block ends with a CRC-32. Tasks write under
names of their own and return manifest rows; only files of the written manifest count, so those of lost or repeated tasks
are never read.

*Read.* Files are read back block by block. ``start`` is the sum of the ids in earlier blocks, from the manifest, and those
before in the block.

Defined results: a null text is empty and has the end id alone; a null doc_id ranks after all others; rows that repeat a doc_id
are documents of their own, in the order of their number of ids and then of a hash of them; a damaged block stops the job;
an empty table gives no rows and no files; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.common import columns_of, partitions
from sightline.llm.store import store
from sightline.llm.tokens import chunks
from sightline.session import cut, new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
FILE_BYTES = 64 << 20
BLOCK_IDS = 1 << 18
#: Text whose distinct words are looked up together.
CHUNK_BYTES = 8 << 20
#: Distinct words whose ids a Python worker keeps, over all of its tasks.
KEPT = 1_000_000
MAGIC = b"TKRANK1\n"
_HEAD = "<8sII"  # magic, number of ranks, end id
_BLOCK = "<IQQ"  # documents, ids, data bytes
_MARK = "<|startoftext|>"

#: Data bytes of each of the four ranks of a control byte, and of all four.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


def vocabulary_file(name: str = TOKENIZER) -> str:
    return common.vocabulary_file(name)


class WordEncoder:
    """Ids of texts, by words where the tokenizer drops white space."""

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(_MARK)
        probe = [self.tokenizer.encode(f"ab{x}cd", add_special_tokens=False).ids for x in " \t\n\v\f\r"]
        whole = [*self.ids_of("ab"), *self.ids_of("cd")]
        self.by_word = self.mark is not None and all(x == whole for x in probe)
        self.folds = self.ids_of("AZ") == self.ids_of("az")
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The encoder of this Python worker: words stay known from task to task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encodes words many at a time, with a special token between them; those that may hold one by themselves."""
        plain = np.array(["<|" not in w for w in words], bool)
        some = [w for w, p in zip(words, plain, strict=True) if p]
        groups = [_MARK.join(some[i : i + 64]) + _MARK for i in range(0, len(some), 64)]
        ids = np.array([i for x in self.tokenizer.encode_batch(groups, add_special_tokens=False) for i in x.ids], np.uint32)
        ends = np.flatnonzero(ids == self.mark)
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = np.diff(ends, prepend=-1) - 1
        flat = ids[ids != self.mark]
        if not plain.all():
            odd = {i: self.ids_of(words[i]) for i in np.flatnonzero(~plain)}
            lengths[~plain] = [len(x) for x in odd.values()]
            at = np.cumsum(lengths) - lengths
            whole = np.zeros(int(lengths.sum()), np.uint32)
            free = np.ones(len(whole), bool)
            for i, x in odd.items():
                whole[at[i] : at[i] + len(x)] = x
                free[at[i] : at[i] + len(x)] = False
            whole[free] = flat
            flat = whole
        self.flat = np.concatenate([self.flat, flat])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text in them); a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.r_[0, np.cumsum([len(x) for x in found], dtype=np.int64)]
        if len(self.known) > KEPT:
            self.clear()
        if self.folds:
            # upper case of ASCII can go first unless a special token or a combining mark is near
            odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
            texts = pc.if_else(odd, texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        found = pc.dictionary_encode(split.flatten())
        place = pc.index_in(found.dictionary, value_set=self.known)
        if place.null_count:
            new = found.dictionary.filter(pc.is_null(place))
            place = place.to_numpy(zero_copy_only=False)
            place[np.isnan(place)] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self._learn(new.to_pylist())
        at = np.asarray(place, np.int64)[found.indices.to_numpy()]
        n = self.first[at + 1] - self.first[at]
        total = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.first[at] - total[:-1], n) + np.arange(total[-1])]
        bounds = split.offsets.to_numpy()
        return ids, total[bounds - bounds[0]]


def _pack(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes, for the tables between the steps."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, texts) of about ``CHUNK_BYTES`` of text, from one or more batches; a longer text is one by itself."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for batch in batches:
        for chunk in chunks(batch.column("text"), CHUNK_BYTES):
            ids.append(batch.column("doc_id").slice(chunk.first, chunk.n))
            texts.append(batch.column("text").slice(chunk.first, chunk.n))
            held += len(chunk.data)
            if held >= CHUNK_BYTES:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _tokenised(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = WordEncoder.of(path), np.zeros(0, np.int64)
        for doc_ids, texts in _gathered(batches):
            ids, bounds = encoder.encode(texts)
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
            more = np.bincount(ids)
            counts = np.pad(counts, (0, max(0, len(more) - len(counts))))
            counts[: len(more)] += more
            none = pa.nulls(len(texts), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": doc_ids, "n": pa.array(np.diff(bounds), pa.int64()),
                "packed": pa.array([_pack(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "tokens": none, "counts": none,
            })
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "packed": pa.nulls(1, pa.binary()),
                "tokens": pa.array([seen], pa.list_(pa.int64())), "counts": pa.array([counts[seen]], pa.list_(pa.int64())),
            })

    return run


def ranked_ids(tokenised: DataFrame) -> np.ndarray:
    """Ids by rank. At most one row per entry of the vocabulary comes to the driver."""
    pairs = tokenised.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    found = pairs.groupBy(F.col("x.tokens").alias("id")).agg(F.sum("x.counts").alias("n"))
    return np.array([r.id for r in sorted(found.collect(), key=lambda r: (-r.n, r.id))], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    control = (code.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    kept = np.arange(4) < length[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks again: lengths by table lookup, then one gather per byte place."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(length) - length
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    for place in range(4):
        have = np.flatnonzero(length > place)
        out[have, place] = raw[first[have] + place]
    return out.view("<u4").ravel()


def _block(doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> tuple[bytes, int]:
    """A block as bytes, and its number of ids."""
    flat = np.concatenate(ids)
    control, data = encode_ranks(rank_of[flat])
    have = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    lengths = np.array([len(x) for x in ids], "<u8")
    body = b"".join((struct.pack(_BLOCK, len(ids), len(flat), len(data)), have.tobytes(), numbers.tobytes(), lengths.tobytes(), control, data))
    return body + struct.pack("<I", zlib.crc32(body)), len(flat)


_MANIFEST = "part long, file string, block long, n_ids long, bytes long"


def _writer(folder: str, ranked: np.ndarray, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.zeros(int(ranked.max()) + 1, np.uint32)
        rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
        part, block, name, size, stream = TaskContext.get().partitionId(), 0, "", 0, None
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal stream, name, size, block, held
            if stream is None:
                files, path = store(folder)
                files.create_dir(path, recursive=True)
                name, size = f"{part:06d}-{block:06d}-{uuid.uuid4().hex}.ids", 0
                stream = files.open_output_stream(f"{path}/{name}", compression=None)
                stream.write(struct.pack(_HEAD, MAGIC, len(ranked), end_id) + ranked.astype("<u4").tobytes())
            raw, n = _block(docs, ids, rank_of)
            stream.write(raw)
            row = {"part": [part], "file": [name], "block": [block], "n_ids": [n], "bytes": [len(raw)]}
            docs.clear()
            ids.clear()
            size, block, held = size + len(raw), block + 1, 0
            if size >= FILE_BYTES:
                stream.close()
                stream = None
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for doc_id, n, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "packed")), strict=True):
                docs.append(doc_id)
                ids.append(_unpack(packed, n))
                held += n
                if held >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()
        if stream is not None:
            stream.close()

    return run


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID
) -> DataFrame:
    """Writes the ids of documents as files in the order of doc_id; returns the manifest: part, file, block, n_ids, bytes."""
    spark = docs.sparkSession
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ddl = "doc_id long, n long, packed binary, tokens array<long>, counts array<long>"
    tokenised = cut(rows.mapInArrow(_tokenised(vocabulary_file(tokenizer), end_id), ddl), "ids")
    ranked = ranked_ids(tokenised)
    if len(ranked) == 0:
        return spark.createDataFrame([], _MANIFEST)
    order = [F.asc_nulls_last("doc_id"), F.col("n"), F.col("digest")]
    rows = tokenised.where("n is not null").select("doc_id", "n", "packed", F.xxhash64("packed").alias("digest"))
    ranges = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return cut(ranges.mapInArrow(_writer(folder, ranked, end_id), _MANIFEST), "manifest")


def read_blocks(folder: str, name: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, first id of each and the end of the last, ids) of every block of a file."""
    files, path = store(folder)
    with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
        magic, n_ranks, _ = struct.unpack(_HEAD, stream.read(struct.calcsize(_HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{name} is no file of ranked ids")
        ranked = np.frombuffer(stream.read(4 * n_ranks), "<u4")
        while head := stream.read(struct.calcsize(_BLOCK)):
            n_docs, n_ids, n_data = struct.unpack(_BLOCK, head)
            n_control = -(-n_ids // 4)
            body = stream.read(17 * n_docs + n_control + n_data)
            if zlib.crc32(head + body) != struct.unpack("<I", stream.read(4))[0]:
                raise ValueError(f"a block of {name} is damaged")
            have = np.frombuffer(body, np.uint8, n_docs)
            numbers = np.frombuffer(body, "<i8", n_docs, n_docs)
            bound = np.r_[0, np.cumsum(np.frombuffer(body, "<u8", n_docs, 9 * n_docs).astype(np.int64))]
            at = 17 * n_docs
            ranks = decode_ranks(body[at : at + n_control], body[at + n_control :], n_ids)
            yield [int(d) if h else None for d, h in zip(numbers, have, strict=True)], bound, ranked[ranks]


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for doc_ids, bound, ids in read_blocks(folder, name):
                    raw = ids.astype("<u4").tobytes()
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + bound[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(bound), pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                    })
                    start += int(bound[-1])

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of the manifest."""
    files = manifest.groupBy("part", "file").agg(F.sum("n_ids").alias("n"), F.min("block").alias("block"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    files = files.select("file", (F.col("base") + F.col("inside")).alias("start")).repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """Writes the documents' ids as files, reads them back and returns one row per document."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **options), folder)
