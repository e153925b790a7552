"""Benchmark decontamination: BM25 inverted index of the test items, searched by block-max WAND with every passage.

*Index.* The items are the indexed side. The BM25 impact of a term in an item is divided by the score the item gives
itself, so 1 means "all of the item" and one threshold suits all items. Items are ordered by length and cut into blocks of
``BLOCK``; every (term, block) keeps its largest impact. Document frequencies are over all items.

*Queries.* Every document is cut into passages of twice the longest item with a step of its length, so that each
occurrence of an item lies whole in one passage. A passage keeps its distinct indexed terms. As in WAND the terms whose
upper bounds cannot reach the threshold together name no candidates; the blocks of the others are candidates, the sums of
their block maxima are compared with the threshold, and only the items of the blocks that pass are scored. All items at
or above the threshold are returned; nothing is cut to a top k.

*Verification.* The item's text up to its first line break counts as question, the rest as answer. For a hit the passage must hold
at least ``OVERLAP`` of the question's word 5-grams, and as large a share of the answer's.

The index is built from at most ``SLICE`` items at a time and sent to the tasks; a larger benchmark takes one pass per
slice over the corpus. Items of fewer than ``GRAM`` words have no grams; they are hits where a text holds all of their words one after the
other, with overlaps of 1 and no score. Defined results: null texts hold nothing; items without a word, a text or an item_id are not searched;
rows that share a doc_id are counted together, so equal rows give one hit with the passages of all; an empty table on either side gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import columns_of
from sightline.llm.tokens import U64, Chunk, chunks, letter_table, lookup, rolling, words

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
GRAM = 5
BLOCK = 8
SLICE = 20_000
_TABLE = letter_table()


class Index(NamedTuple):
    terms: np.ndarray  # sorted codes
    bound: np.ndarray  # largest impact of each term
    block_key: np.ndarray  # term * blocks + block, sorted
    block_max: np.ndarray
    blocks_of: np.ndarray  # first entry of each term in block_key, one more than terms
    post_key: np.ndarray  # term * items + item, sorted
    post_impact: np.ndarray
    items: np.ndarray  # item_id by position
    parts: list  # grams of question and of answer by position
    longest: int

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


def _codes(text: str) -> np.ndarray:
    raw = text.lower().encode()
    return words(Chunk(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), _TABLE).code


def _grams(codes: np.ndarray) -> np.ndarray:
    return np.unique(rolling(codes, min(GRAM, max(len(codes), 1))))


def parts_of(text: str) -> list[np.ndarray]:
    """Grams of the question and of the answer. A part below five words is no evidence and is taken with the other."""
    question, _, answer = text.partition("\n")
    both = [_codes(question), _codes(answer)]
    return [_grams(x) for x in both] if min(map(len, both)) >= GRAM else [_grams(_codes(text))]


def build_index(items: list[tuple[int, str]], frequency: dict[int, int], n_items: int, mean_length: float) -> Index | None:
    found = [(item, text, codes) for item, text in items if len(codes := _codes(text)) >= GRAM]
    if not found:
        return None
    found.sort(key=lambda x: (len(x[2]), x[0]))
    terms = np.unique(np.concatenate([c for _, _, c in found]))
    seen = np.array([frequency[int(t)] for t in terms], float)
    idf = np.log(1 + (n_items - seen + 0.5) / (seen + 0.5))
    term, item, impact = [], [], []
    for at, (_, _, codes) in enumerate(found):
        own, tf = np.unique(codes, return_counts=True)
        t = np.searchsorted(terms, own)
        score = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(codes) / mean_length))
        term.append(t)
        item.append(np.full(len(t), at))
        impact.append(score / score.sum())
    term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
    n, blocks = len(found), -(-len(found) // BLOCK)
    post = term * n + item
    order = np.argsort(post)
    block_key, at = np.unique(term * blocks + item // BLOCK, return_inverse=True)
    block_max = np.zeros(len(block_key))
    np.maximum.at(block_max, at, impact)
    bound = np.zeros(len(terms))
    np.maximum.at(bound, term, impact)
    return Index(
        terms, bound, block_key, block_max, np.searchsorted(block_key, np.arange(len(terms) + 1) * blocks), post[order],
        impact[order], np.array([i for i, _, _ in found]), [parts_of(t) for _, t, _ in found], max(len(c) for _, _, c in found),
    )


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of every element of the runs that begin at ``first``."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _value(key: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, values[at], 0.0)


def search(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all scores at or above the threshold. Inputs: distinct (passage, term), passages in order."""
    eps = threshold - 1e-9
    order = np.lexsort((index.bound[term], passage))
    passage, term = passage[order], term[order]
    names, first, count = np.unique(passage, return_index=True, return_counts=True)
    running = np.cumsum(index.bound[term])
    running -= np.repeat(running[first] - index.bound[term[first]], count)
    essential = np.flatnonzero(running >= eps)
    owner, entry = _spread(index.blocks_of[term[essential]], np.diff(index.blocks_of)[term[essential]])
    rank = np.searchsorted(names, passage[essential[owner]])
    pairs = np.unique(rank * index.blocks + index.block_key[entry] % index.blocks)
    rank, block = pairs // index.blocks, pairs % index.blocks
    owner, at = _spread(first[rank], count[rank])
    upper = np.bincount(owner, _value(term[at] * index.blocks + block[owner], index.block_key, index.block_max), len(pairs))
    rank, block = rank[upper >= eps], block[upper >= eps]
    n = len(index.items)
    rank, item = np.repeat(rank, BLOCK), (block[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
    rank, item = rank[item < n], item[item < n]
    owner, at = _spread(first[rank], count[rank])
    score = np.bincount(owner, _value(term[at] * n + item[owner], index.post_key, index.post_impact), len(rank))
    good = score >= eps
    return names[rank[good]], item[good], score[good]


def short_items(items: list[tuple[int, str]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Items of fewer than GRAM words, by their number of words: sorted hashes of the whole word sequence, and the items."""
    found: dict[int, list[tuple[int, int]]] = {}
    for item, text in items:
        if 0 < len(codes := _codes(text)) < GRAM:
            found.setdefault(len(codes), []).append((int(rolling(codes, len(codes))[0]), item))
    out = {}
    for k, rows in found.items():
        codes, ids = zip(*sorted(rows), strict=True)
        out[k] = np.array(codes, U64), np.array(ids, np.int64)
    return out


def _whole(short: dict[int, tuple[np.ndarray, np.ndarray]], chunk: Chunk) -> list[tuple]:
    """Short items that a text holds word for word, at each place."""
    found, out = words(chunk, _TABLE), []
    for k, (codes, items) in short.items():
        here = rolling(found.code, k)
        inside = found.text[: len(here)] == found.text[k - 1 :] if len(here) else np.zeros(0, bool)
        first, last = np.searchsorted(codes, here, "left"), np.searchsorted(codes, here, "right")
        for at in np.flatnonzero(inside & (last > first)):
            text = int(found.text[at])
            out += [(text, int(item), int(at - found.first[text]), None, 1.0, 1.0) for item in items[first[at] : last[at]]]
    return out


def _hits(
    index: Index | None, short: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float, overlap: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    step = index.longest if index is not None else 0
    names = ["doc_id", "item_id", "start_word", "score", "question_overlap", "answer_overlap"]

    def of_chunk(chunk: Chunk) -> list[tuple]:
        found = words(chunk, _TABLE)
        term = lookup(found.code, index.terms)
        some = np.flatnonzero(term >= 0)
        if len(some) == 0:
            return []
        size = np.diff(found.first)
        n_passages = np.maximum(1, -(-size // step) - 1)
        base = np.cumsum(n_passages) - n_passages
        text = found.text[some]
        slot = (some - found.first[text]) // step
        late = np.minimum(slot, n_passages[text] - 1)  # a word lies in the passage that begins in its step and in the one before
        keys = np.concatenate([(base[text] + late), (base[text] + slot - 1)[(slot > 0)]])
        terms = np.concatenate([term[some], term[some][slot > 0]])
        total = np.bincount(keys, index.bound[terms], int(n_passages.sum()))
        strong = total[keys] >= threshold - 1e-9  # repeated terms count again, so this is an upper bound
        if not strong.any():
            return []
        pairs = np.unique(keys[strong] * len(index.terms) + terms[strong])
        out = []
        for p, item, score in zip(*search(index, pairs // len(index.terms), pairs % len(index.terms), threshold), strict=True):
            text = int(np.searchsorted(base, p, "right") - 1)
            start = int(p - base[text]) * step
            codes = found.code[found.first[text] + start : min(found.first[text] + start + 2 * step, found.first[text + 1])]
            shares = [float(np.isin(part, rolling(codes, min(GRAM, len(codes)))).mean()) for part in index.parts[item]]
            if min(shares) >= overlap:
                out.append((text, int(index.items[item]), start, float(score), shares[0], shares[-1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in chunks(batch.column("text")):
                if rows := (of_chunk(chunk) if index is not None else []) + (_whole(short, chunk) if short else []):
                    text, *rest = zip(*rows, strict=True)
                    columns = [pa.array(x, t) for x, t in zip(rest, [pa.int64(), pa.int64(), *[pa.float64()] * 3], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(chunk.first + np.array(text))), *columns], names=names)

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_passages, score (best), overlaps (best)."""
    docs = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.lower("text"))
    items = columns_of(benchmark, item_id=item_col, text=item_text_col).where("text is not null and item_id is not null")
    n = items.count()
    slices = max(1, -(-2 * n // SLICE))
    frequency, total, kept = {}, 0, []
    if slices > 1:  # statistics over all items come first, one slice at a time
        for s in range(slices):
            kept.append(items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s))
    else:
        kept.append(items)
    for part in kept:
        for _, text in part.collect():
            codes = _codes(text)
            total += len(codes)
            for code in np.unique(codes):
                frequency[int(code)] = frequency.get(int(code), 0) + 1
    schema = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"
    found = None
    for part in kept:
        some = [tuple(r) for r in part.collect()]
        index, short = build_index(some, frequency, n, max(total / max(n, 1), 1.0)), short_items(some)
        if index is not None or short:
            hits = docs.mapInArrow(_hits(index, short, threshold, overlap), schema)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_passages"), F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"),
    )
