"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index with score bounds.

*Terms.* All words of a bounded sample of labelled documents (``SAMPLE`` documents, those with the smallest hash of the id)
span the vectors. Each is weighed by its inverse document frequency, counted over all documents, and by its association
with the label: ((1 + G) / (1 + critical G)) squared, at most 1, where G is the statistic of its document counts in the sample
and the critical value is that for all words tested (less than one word by chance). So no word is left out, and words that say
little about the label weigh little.

*Neighbours.* The sample is the index: per term a list of examples with their normalised weights and the largest of them. A
query adds up lists by falling bound, until few examples can still reach its ``NEIGHBOURS``-th best cosine by the bounds
that are left; these get their whole cosine, so the neighbours are exact. Ties go to the smaller doc_id.

*Score.* Votes weigh 1 / (distance + ``SOFTEN``). The share of toxic weight is mapped to a probability by isotonic
regression on leave-one-out votes of the examples. A text without any word of the sample gets the rate of such texts in the sample.
Evidence are the ids of the three nearest examples.

Only rows outside the held-out fold are learned from, and lang, source and ids are no inputs of a score. Defined results: null
and empty texts have no terms; without labelled rows the score is 0.5 for all, and with labels of one kind about
their rate; a doc_id labelled several times counts as toxic if one label says so; repeated rows get equal results; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import columns_of, fold_of
from sightline.llm.tokens import U64, Chunk, chunks, letter_table, lookup, mix, words

SAMPLE = 8192
NEIGHBOURS = 15
FEW = 256
SOFTEN = 0.05
_TABLE = letter_table()


class Index(NamedTuple):
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # times the weight by label
    first: np.ndarray  # first posting of each term
    example: np.ndarray  # postings: example and weight
    weight: np.ndarray
    most: np.ndarray  # largest weight of each term
    own_first: np.ndarray  # first own term of each example
    own_term: np.ndarray  # their terms and weights
    own_weight: np.ndarray
    query: np.ndarray  # room for the weights of a query, zero between queries
    label: np.ndarray
    ids: np.ndarray
    grid: tuple[np.ndarray, np.ndarray]  # calibration: vote and probability
    blank: float  # probability of a text without terms


def vector(terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(tf)) * idf[terms]
    return value / max(np.sqrt((value * value).sum()), 1e-12)


def build_index(terms: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, ids: np.ndarray) -> Index:
    """``vectors``: (terms, tf) of every example, in order of id; those without terms only count for ``blank``."""
    some = np.array([len(t) > 0 for t, _ in vectors], bool)
    blank = float((label[~some].sum() + 0.5) / ((~some).sum() + 1)) if (~some).any() else 0.5 * float(label.mean() if len(label) else 1)
    keep = [int(i) for i in np.flatnonzero(some)]
    own = [vectors[i][0] for i in keep]
    own_first = np.cumsum([0, *map(len, own)])
    own_term = np.concatenate(own) if own else np.zeros(0, int)
    own_weight = np.concatenate([vector(*vectors[i], idf) for i in keep]) if own else np.zeros(0)
    order = np.argsort(own_term, kind="stable")
    first = np.searchsorted(own_term[order], np.arange(len(terms) + 1))
    example = np.repeat(np.arange(len(keep), dtype=np.int32), np.diff(own_first))[order]
    most = np.zeros(len(terms))
    np.maximum.at(most, own_term, own_weight)
    index = Index(
        terms, idf, first, example, own_weight[order], most, own_first, own_term.astype(np.int32), own_weight, np.zeros(len(terms)),
        label[keep], ids[keep], (np.zeros(1), np.zeros(1)), blank,
    )
    votes = np.array([vote(index, nearest(index, vectors[i][0], vector(*vectors[i], idf), skip=at)) for at, i in enumerate(keep)])
    return index._replace(grid=isotonic(votes, label[keep])) if len(keep) else index


def nearest(index: Index, terms: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """(examples, cosines) of the exact k nearest with a cosine above 0, nearest first."""
    bound = weight * index.most[terms]
    order = np.argsort(-bound, kind="stable")
    terms, weight, bound = terms[order], weight[order], bound[order]
    rest = np.r_[np.cumsum(bound[::-1])[::-1], 0.0]
    score, at, step = np.zeros(len(index.ids)), 0, 16
    while True:
        some = terms[at : at + step]
        place, of = _ranges(index.first, some)
        score += np.bincount(index.example[place], index.weight[place] * weight[at : at + step][of], len(score))
        if skip >= 0:
            score[skip] = -np.inf
        at, step = min(at + step, len(terms)), 2 * step
        worst = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        hit = np.flatnonzero(score >= max(worst, 0.0) - rest[at] - 1e-9) if rest[at] > 0 else np.flatnonzero((score > 0) & (score >= worst - 1e-9))
        if at == len(terms) or len(hit) <= FEW:
            break
    hit = hit[hit != skip]
    place, of = _ranges(index.own_first, hit)
    index.query[terms] = weight
    cosine = np.bincount(of, index.query[index.own_term[place]] * index.own_weight[place], len(hit))
    index.query[terms] = 0
    hit, cosine = hit[cosine > 0], cosine[cosine > 0]
    order = np.lexsort((index.ids[hit], -np.round(cosine, 12)))[:k]
    return hit[order], cosine[order]


def _ranges(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows of a table, and which of the rows each is of."""
    sizes = first[rows + 1] - first[rows]
    of = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(of)) + np.repeat(first[rows] - np.cumsum(sizes) + sizes, sizes), of


def vote(index: Index, near: tuple[np.ndarray, np.ndarray]) -> float:
    found, cosine = near
    weight = 1 / (np.maximum(1 - cosine, 0) + SOFTEN)
    return float((weight * index.label[found]).sum() / weight.sum()) if len(found) else index.blank


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y by x (pool adjacent violators), each shrunk a little to the middle."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, n
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, float(b), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def _term_counts(chunk: Chunk, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms in a chunk, in order of text."""
    found = words(chunk, _TABLE)
    term = lookup(found.code, terms)
    some = term >= 0
    pairs, count = np.unique(found.text[some] * max(len(terms), 1) + term[some], return_counts=True)
    return pairs // max(len(terms), 1), pairs % max(len(terms), 1), count


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            found = words(chunk, _TABLE)
            _, first = np.unique(mix(found.code + found.text.astype(U64)), return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.code[first].view(np.int64)), batch.column("toxic").take(pa.array(chunk.first + found.text[first]))],
                names=["term", "toxic"],
            )


def weighted_terms(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all words of the examples, and their weights by how far their document counts depend on the label."""
    n, toxic = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seen = examples.select("text", "toxic").mapInArrow(_distinct_words, "term long, toxic int")
    seen = seen.groupBy("term").agg(F.sum("toxic").alias("b"), F.count("*").alias("d")).toArrow()
    terms = seen["term"].to_numpy().view(U64)
    order = np.argsort(terms)
    b, d = (seen[c].to_numpy().astype(float)[order] for c in ("b", "d"))

    def part(have, row, column):
        return have * np.log(np.maximum(have, 1) * n / np.maximum(row * column, 1))

    g = 2 * (part(b, d, toxic) + part(d - b, d, n - toxic) + part(toxic - b, n - d, toxic) + part(n - toxic - d + b, n - d, n - toxic))
    limit = 2 * np.log(max(len(terms), 2))  # less than one word passes by chance
    return terms[order], np.minimum((1 + np.maximum(g, 0)) / (1 + limit), 1) ** 2


def _frequencies(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for chunk in chunks(batch.column("text")):
                total += np.bincount(_term_counts(chunk, terms)[1], minlength=len(terms))
        counts = np.r_[n, total]
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(counts[at])], names=["at", "n"])

    return run


def _example_vectors(terms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text, term, count = _term_counts(chunk, terms)
                bound = pa.array(np.searchsorted(text, np.arange(chunk.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(chunk.first, chunk.n) for c in ("doc_id", "toxic")]
                    + [pa.ListArray.from_arrays(bound, pa.array(x.astype(np.int64))) for x in (term, count)],
                    names=["doc_id", "toxic", "terms", "counts"],
                )

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Index | None:
    """Index from ``labels`` (doc_id, toxic) and the documents (doc_id, text)."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    examples = docs.join(picked, "doc_id").select("doc_id", F.lower("text").alias("text"), "toxic")
    terms, weight = weighted_terms(examples)
    rows = examples.mapInArrow(_example_vectors(terms), "doc_id long, toxic int, terms array<long>, counts array<long>").toArrow()
    if rows.num_rows == 0:
        return None
    counted = docs.select(F.lower("text").alias("text")).mapInArrow(_frequencies(terms), "at long, n long")
    counted = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms) + 1)
    counts[counted["at"].to_numpy() + 1] = counted["n"].to_numpy()
    idf = (np.log((1 + counts[0]) / (1 + counts[1:])) + 1) * weight
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    vectors = [(np.array(t, int), np.array(c, float)) for t, c in zip(rows["terms"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
    return build_index(terms, idf, [vectors[i] for i in order], rows["toxic"].to_numpy()[order], rows["doc_id"].to_numpy()[order])


def _scored(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                text, term, count = _term_counts(chunk, index.terms)
                bound = np.searchsorted(text, np.arange(chunk.n + 1))
                out = []
                for a, b in zip(bound[:-1], bound[1:], strict=True):
                    if a == b:
                        out.append((index.blank, []))
                        continue
                    key = hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        near = nearest(index, term[a:b], vector(term[a:b], count[a:b].astype(float), index.idf))
                        score = float(np.interp(vote(index, near), *index.grid)) if len(near[0]) else index.blank
                        known[key] = (score, [int(i) for i in index.ids[near[0][:3]]])
                    out.append(known[key])
                rest = [batch.column(c).slice(chunk.first, chunk.n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "score", "evidence"],
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence."""
    docs = columns_of(docs, doc_id=id_col, text=text_col)
    labels = columns_of(labels, doc_id=id_col, toxic=label_col)
    index = learn(docs, labels.where(fold_of(F.col("doc_id")) != 0))
    rows = docs.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.lower("text").alias("text"))
    if index is None:
        rows = rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.array().cast("array<long>").alias("evidence"))
    else:
        rows = rows.mapInArrow(_scored(index), "doc_id long, held_out boolean, score double, evidence array<long>")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
