"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The score of a word is the sum over *all* its
segmentations into pieces of the product of their probabilities, computed by the forward algorithm over its bytes; the
vocabulary has a piece for each single byte, so every word has one. The probabilities are fitted by expectation
maximisation (forward-backward over the same lattices) to the word counts of a bounded sample of labelled documents:
``SAMPLE`` documents a language, those with the smallest hash of the id, and of these the ``WORDS`` most frequent words. Every
language of a labelled document can be predicted.
The vocabulary itself is only read, never trained.

Texts are learned and scored whole. Words are runs of ASCII letters (lower-cased) and other non-ASCII characters; a run of more than
``LONGEST`` bytes, as in languages without spaces, is learned and scored in parts of that length. A text's score for a language is the sum over its words; each
distinct word of a task is scored once. ``score`` is the posterior of the predicted language under equal priors, with at most
``EVIDENCE`` words' worth of evidence, so that it stays below 1 on long texts.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every text where nothing could be
learned; ties go to the language that sorts first; null ids are in the held-out fold; repeated rows get equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import columns_of, fold_of, small_batches, vocabulary_file
from sightline.llm.tokens import U64, Words, chunks, letter_table, lookup, mix, words

#: The vocabulary: 32,000 pieces with byte fallback, from the public tokenizers package; a path of one's own may be given instead.
VOCABULARY = "piece_bpe_32k.model"
SAMPLE = 400
#: Parts of a language that are ranked on their own first.
SALTS = 16
WORDS = 30_000
LONGEST = 24
EVIDENCE = 12
ITERATIONS = 4
_MARK = 1  # byte that stands for the beginning of a word
_TABLE = letter_table(digits=False)
_BASE = 0x9E3779B97F4A7C15
_UP = np.array([pow(_BASE, i, 1 << 64) for i in range(LONGEST + 2)], U64)
_DOWN = np.array([pow(pow(_BASE, -1, 1 << 64), i, 1 << 64) for i in range(LONGEST + 2)], U64)
#: Bytes of text whose distinct words are scored together, and words whose scores a task keeps.
_CHUNK, _KEPT = 1 << 21, 400_000


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces as bytes, a leading word mark as one byte; every single byte is a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(path))
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        body = piece.removeprefix("▁")
        if "▁" not in body and (raw := b"\x01" * (len(body) < len(piece)) + body.encode()):
            pieces.add(raw)
    return sorted(p for p in pieces if len(p) <= LONGEST + 1)


def _hashes(matrix: np.ndarray) -> np.ndarray:
    """Running sums of a byte matrix, from which the hash of any run of columns follows."""
    total = np.zeros((matrix.shape[0], matrix.shape[1] + 1), U64)
    np.cumsum((matrix.astype(U64) + U64(1)) * _UP[: matrix.shape[1]], axis=1, out=total[:, 1:])
    return total


def _run_hash(total: np.ndarray, a: int, b: int) -> np.ndarray:
    return mix((total[:, b] - total[:, a]) * _DOWN[a] + U64(b - a))


class Pieces:
    """The vocabulary as sorted hashes."""

    def __init__(self, pieces: list[bytes]) -> None:
        codes = np.array([_run_hash(_hashes(np.frombuffer(p, np.uint8)[None]), 0, len(p))[0] for p in pieces], U64)
        self.keys = np.sort(codes)
        self.longest = max(map(len, pieces))

    def lattice(self, matrix: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, piece) of all pieces in the rows of a byte matrix, by end and beginning."""
        total, out = _hashes(matrix), []
        for end in range(1, matrix.shape[1] + 1):
            for start in range(max(0, end - self.longest), end):
                piece = lookup(_run_hash(total, start, end), self.keys)
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    out.append((start, end, rows, piece[rows]))
        return out


def forward(lattice: list, n: int, length: int, prob: np.ndarray) -> np.ndarray:
    """n x (length + 1) x languages: sums over all segmentations of each beginning of the words."""
    alpha = np.zeros((length + 1, n, prob.shape[1]))
    alpha[0] = 1
    for start, end, rows, piece in lattice:
        alpha[end][rows] += alpha[start][rows] * prob[piece]
    return alpha


def expected(lattice: list, n: int, length: int, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected piece counts by language, for words that occur ``count`` (n x languages) times."""
    alpha = forward(lattice, n, length, prob)
    beta = np.zeros_like(alpha)
    beta[length] = 1
    for start, end, rows, piece in reversed(lattice):
        beta[start][rows] += beta[end][rows] * prob[piece]
    weight = count / np.maximum(alpha[length], 1e-300)
    out = np.zeros_like(prob)
    for start, end, rows, piece in lattice:
        np.add.at(out, piece, alpha[start][rows] * beta[end][rows] * prob[piece] * weight[rows])
    return out


def _matrices(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte matrix) of the words of each length."""
    size = np.array([len(w) for w in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)


def fit(pieces: Pieces, raw: list[bytes], count: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Piece probabilities (pieces x languages) by expectation maximisation."""
    prob = np.full((len(pieces.keys), count.shape[1]), 1.0 / len(pieces.keys))
    lattices = [(at, m.shape[1], pieces.lattice(m)) for at, m in _matrices(raw)]
    for _ in range(iterations):
        total = sum(expected(lattice, len(at), n, prob, count[at]) for at, n, lattice in lattices) + 0.02
        prob = total / total.sum(axis=0)
    return prob


class Scorer:
    """Log scores of words by language; distinct words are scored once and remembered."""

    def __init__(self, pieces: Pieces, prob: np.ndarray) -> None:
        self.pieces, self.prob = pieces, prob
        self.known, self.values = np.zeros(0, U64), np.zeros((0, prob.shape[1]))

    def of(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, opens: np.ndarray, code: np.ndarray) -> np.ndarray:
        names, first, back = np.unique(code, return_index=True, return_inverse=True)
        at = lookup(names, self.known)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = self._score(data, start[first[new]], size[first[new]], opens[first[new]])
            if len(self.known) > _KEPT:
                held = at >= 0
                self.known, self.values = names[held], self.values[at[held]]
            known, values = np.concatenate([self.known, names[new]]), np.concatenate([self.values, fresh])
            order = np.argsort(known)
            self.known, self.values = known[order], values[order]
            at = lookup(names, self.known)
        return self.values[at][back]

    def _score(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, opens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), self.prob.shape[1]))
        for n in np.unique(size):
            for mark in (False, True):
                every = np.flatnonzero((size == n) & (opens == mark))
                for a in range(0, len(every), 1 << 14):
                    at = every[a : a + (1 << 14)]
                    matrix = data[start[at][:, None] + np.arange(n)]
                    if mark:
                        matrix = np.concatenate([np.full((len(at), 1), _MARK, np.uint8), matrix], axis=1)
                    total = forward(self.pieces.lattice(matrix), len(at), matrix.shape[1], self.prob)[-1]
                    out[at] = np.log(np.maximum(total, 1e-300))
        return out


class Parts(NamedTuple):
    """Parts of at most ``LONGEST`` bytes of the words of a chunk: first byte, length, text, whether it opens the word, hash."""

    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    opens: np.ndarray
    code: np.ndarray


def word_parts(found: Words) -> Parts:
    size = found.end - found.start
    count = -(-size // LONGEST)
    owner = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = found.start[owner] + place * LONGEST
    code = np.where(place == 0, found.code[owner], mix(found.code[owner] + place.astype(U64)))
    return Parts(start, np.minimum(found.end[owner] - start, LONGEST), found.text[owner], place == 0, code)


def _scored(pieces: Pieces, prob: np.ndarray, langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces, prob)
        names = np.array(langs, object)
        for batch in batches:
            for chunk in chunks(batch.column("text"), _CHUNK):
                parts = word_parts(words(chunk, _TABLE))
                score = scorer.of(_TABLE[chunk.data], parts.start, parts.size, parts.opens, parts.code)
                text = parts.text
                total = np.stack([np.bincount(text, score[:, k], chunk.n) for k in range(len(names))], axis=1)
                n = np.bincount(text, minlength=chunk.n)
                scaled = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
                weight = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                best = weight.argmax(axis=1)
                share = weight[np.arange(chunk.n), best] / weight.sum(axis=1)
                some = (n > 0) & batch.column("letters").slice(chunk.first, chunk.n).to_numpy(zero_copy_only=False)
                rest = [batch.column(c).slice(chunk.first, chunk.n) for c in batch.schema.names if c not in ("text", "letters")]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(np.where(some, names[best], "und"), pa.string()), pa.array(np.where(some, share, 0.0))],
                    names=[c for c in batch.schema.names if c not in ("text", "letters")] + ["lang_pred", "score"],
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the parts of words in each text; the part that opens a word has its mark in front."""
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            parts = word_parts(words(chunk, _TABLE))
            body = _TABLE[chunk.data].tobytes()
            _, first, count = np.unique(mix(parts.code + parts.text.astype(U64)), return_index=True, return_counts=True)
            word = [
                b"\x01" * bool(opens) + body[a : a + n]
                for a, n, opens in zip(parts.start[first], parts.size[first], parts.opens[first], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(chunk.first + parts.text[first])), pa.array(word, pa.binary()), pa.array(count)],
                names=["lang", "word", "n"],
            )


def _first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each language. First those of each of SALTS parts of a language, so that no task gets all of a language."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))
    for keys in (["lang", "part"], ["lang"]):
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("part", part if "part" in keys else F.lit(0)).withColumn("at", at).where(F.col("at") <= n).drop("at", "part")
    return rows


def learn(labelled: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE, n_words: int = WORDS) -> tuple[Pieces, np.ndarray, list[str]]:
    """Model from labelled documents (doc_id, text, lang): pieces, probabilities, languages in order."""
    small_batches(labelled.sparkSession)
    picked = _first(labelled.select("doc_id", "lang"), sample, F.xxhash64("doc_id"), F.col("doc_id"))
    texts = labelled.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    counted = texts.select("lang", F.lower("text").alias("text")).mapInArrow(_counted, "lang string, word binary, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = _first(counted, n_words, F.desc("n"), F.col("word")).toArrow()
    langs = sorted(r.lang for r in picked.select("lang").distinct().collect())  # one row per language
    pieces = Pieces(vocabulary(path))
    if not langs:
        return pieces, np.zeros((len(pieces.keys), 0)), langs
    raw = sorted(set(rows["word"].to_pylist()))
    place, column = {w: i for i, w in enumerate(raw)}, {x: i for i, x in enumerate(langs)}
    count = np.zeros((len(raw), len(langs)))
    for lang, word, n in zip(*(rows[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        count[place[word], column[lang]] += n
    return pieces, fit(pieces, raw, count) if raw else np.full(count.shape, 0.0) + 1 / len(pieces.keys), langs


def predict(docs: DataFrame, model: tuple[Pieces, np.ndarray, list[str]], text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with lang_pred and score."""
    small_batches(docs.sparkSession)
    pieces, prob, langs = model
    rest = [c for c in docs.columns if c != text_col]
    if not langs:
        return docs.select(*(f"`{c}`" for c in rest), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(
        *(f"`{c}`" for c in rest), F.lower(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False)).alias("letters")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "letters"))
    return rows.mapInArrow(_scored(pieces, prob, langs), f"{fields}, lang_pred string, score double")


def identify_languages(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from documents outside the held-out fold."""
    docs = columns_of(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    model = learn(docs.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang"), path)
    return predict(docs.select("doc_id", "held_out", "text"), model)
