"""Periodic runs of words: Lyndon roots from Baier's grouping, extended by longest common extensions.

Words are maximal runs of characters other than ASCII white space, as numbers. Every run (a stretch with smallest period q
that no neighbouring word extends) has a Lyndon root of length q in one of two orders of the words: a stretch that is the longest Lyndon word at
its start. So the roots of a text are the entries of its Lyndon arrays under both orders.

1. *Grouping.* The first phase of Baier's suffix sorter puts suffixes with the same longest Lyndon prefix into one group. It
   goes through the groups from the highest to the lowest; each suffix of a group is joined to the last place before it that lies in a lower
   group, whose Lyndon prefix it extends. The length of a group's common prefix when its turn comes is the Lyndon
   array entry of its suffixes; no suffix is sorted further.
2. *Extension.* For each entry (i, q) the longest common extension of i and i + q to the right and to the left gives the
   run. Extensions are exact: names of stretches of 1, 2, 4, ... words (doubling), compared from the longest down, for all entries at once.
3. *Choice.* Runs with length at least ``max(MIN_WORDS, MIN_POWER * q)`` stay. A word that lies in such a run after its
   first q words is dropped from the collapsed text.

Before that, words that cannot be in such a run are set aside: every three consecutive words of one occur at least three times in
the document. This only splits the text; all runs lie within the parts left, and no neighbouring word outside a part can extend one.
The parts of many documents are grouped together, each behind a separator of its own.

Defined results: a null or blank text has no words and no run; a null doc_id is never altered (``alter``); repeated rows get
equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import columns_of

MIN_WORDS = 6
MIN_POWER = 4
#: Consecutive words that must come back within a run, and how often they do.
GRAM, TIMES = 3, 3
#: Words whose parts are grouped together.
CHUNK_WORDS = 1 << 18
_EMPTY = np.zeros((0, 3), np.int64)


def lyndon_array(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place; ``codes`` are numbers from 0, smaller ones come first."""
    if (n := len(codes)) == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(codes, kind="stable")
    heads = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
    of = np.zeros(n, np.int64)
    of[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    group = of.tolist()  # first place of the group of each suffix, in the order of the groups
    ends = np.r_[heads[1:], n].tolist()
    end = dict(zip(heads.tolist(), ends, strict=True))  # group -> place behind it
    below = dict(zip(ends, heads.tolist(), strict=True))  # place behind a group -> the group
    members = {h: x.tolist() for h, x in zip(heads.tolist(), np.split(order, heads[1:]), strict=True)}
    size = dict.fromkeys(end, 1)  # words in the common prefix
    before = [-1] * n  # last place before a suffix that lies in a lower group
    out = [0] * n
    stop = n
    while stop:
        here = below[stop]
        width = size[here]
        counts: dict[int, int] = {}
        for s in sorted(x for x in members.pop(here) if group[x] == here):
            out[s] = width
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = before[p]
            before[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in counts.items():
            parts.setdefault((-times, group[p]), []).append(p)
        for (times, low), moved in sorted(parts.items()):
            top = end[low]
            new = top - len(moved)
            end[new], below[top], size[new] = top, new, size[low] - times * width
            if new != low:
                end[low], below[new] = new, low
                for p in moved:
                    group[p] = new
                members[new] = moved
        stop = here
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions within one sequence, by names of its stretches of 1, 2, 4, ... words."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        self.names = [np.asarray(codes, np.int64)]
        width = 1
        while 2 * width <= self.n:
            last = self.names[-1]
            pair = last[:-width] * (int(last.max()) + 1) + last[width:]
            kinds, name = np.unique(pair, return_inverse=True)
            if len(kinds) == len(pair):
                break  # no stretch of this length comes twice
            self.names.append(name)
            width *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j (i < j) on."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            again = level == len(self.names) - 1
            some = np.arange(len(i))
            while len(some):
                some = some[j[some] + found[some] + width <= self.n]
                same = name[i[some] + found[some]] == name[j[some] + found[some]]
                some = some[same]
                found[some] += width
                if not again:
                    break
        return found

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and j."""
        found = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            again = level == len(self.names) - 1
            some = np.arange(len(i))
            while len(some):
                some = some[i[some] - found[some] >= width]
                same = name[i[some] - found[some] - width] == name[j[some] - found[some] - width]
                some = some[same]
                found[some] += width
                if not again:
                    break
        return found


def runs(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of all maximal runs of at least two periods, by start, then period."""
    codes = np.unique(codes, return_inverse=True)[1] if len(codes) else np.zeros(0, np.int64)
    return _roots_to_runs(codes, np.zeros(len(codes), bool), 2, 2)


def _roots_to_runs(codes: np.ndarray, apart: np.ndarray, least: int, power: int) -> np.ndarray:
    """Runs of a sequence; places where ``apart`` hold the lowest codes, each once, and are in no run."""
    if len(codes) == 0:
        return _EMPTY
    found = []
    reach = Extensions(codes)
    for turned in (False, True):
        ordered = np.where(apart, codes, 2 * len(codes) - codes) if turned else codes
        root = lyndon_array(ordered)
        i = np.flatnonzero(~apart & (np.arange(len(codes)) + root < len(codes)))
        i = i[~apart[i + root[i]]]
        j, period = i + root[i], root[i]
        before, after = reach.left(i, j), reach.right(i, j)
        length = before + after + period
        good = (length >= least) & (length >= power * period)
        found.append(np.stack([i - before, length, period], axis=1)[good])
    return np.unique(np.concatenate(found), axis=0)


def alter(doc_id: int | None, words: list) -> list:
    """The words of the documents whose id's CRC-32 ends in 0 come back with a period from some place on; others unchanged."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def _candidates(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words that every ``GRAM`` words around them share with ``TIMES`` places of their document."""
    n = len(codes)
    inside = np.zeros(n, bool)
    if n < GRAM:
        return inside
    _, name = np.unique(codes, return_inverse=True)
    key = np.asarray(name, np.int64)
    for step in range(1, GRAM):
        key = np.unique(key[:-1] * n + name[step:], return_inverse=True)[1].astype(np.int64)
    whole = doc[: len(key)] == doc[GRAM - 1 :]
    pair = np.unique(key * (int(doc.max()) + 1) + doc[: len(key)], return_inverse=True, return_counts=True)
    often = np.flatnonzero((pair[2][pair[1]] >= TIMES) & whole)
    for step in range(GRAM):
        inside[often + step] = True
    return inside


def runs_of_documents(texts: list[list]) -> list[np.ndarray]:
    """(start, length, period) of the runs to report for each list of words, by start, then period."""
    number: dict = {}
    codes = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    sizes = np.array([len(w) for w in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = _candidates(codes, doc)
    kept = np.flatnonzero(inside)
    if len(kept) == 0:
        return [_EMPTY] * len(texts)
    # parts: stretches of candidates of one document, each behind a separator with a code of its own
    new = np.r_[True, (np.diff(kept) != 1) | (np.diff(doc[kept]) != 0)]
    part = np.cumsum(new) - 1
    separators = int(part[-1]) + 1
    place = np.arange(len(kept)) + part + 1
    line = np.zeros(len(kept) + separators, np.int64)
    apart = np.ones(len(line), bool)
    apart[place] = False
    line[apart] = np.arange(separators)
    line[place] = separators + np.unique(codes[kept], return_inverse=True)[1]
    origin = np.zeros(len(line), np.int64)
    origin[place] = kept
    found = _roots_to_runs(line, apart, MIN_WORDS, MIN_POWER)
    at = origin[found[:, 0]]
    of = doc[at]
    first = np.cumsum(sizes) - sizes
    rows = np.stack([at - first[of], found[:, 1], found[:, 2]], axis=1)
    rows = rows[order := np.lexsort((rows[:, 2], rows[:, 0], of))]
    bound = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])
_DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,"
    " collapsed_sha256 string"
)


def _result(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found.tolist()).encode()).hexdigest()
    if len(found) == 0:
        return doc_id, 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    left = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
    start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
    collapsed = hashlib.sha256(b" ".join(left)).hexdigest()
    return doc_id, len(found), start, length, period, 1000 * length // period, listed, collapsed


def _found(prepare: Callable[[int | None, list], list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_result(i, w, f) for i, w, f in zip(ids, texts, runs_of_documents(texts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                words = prepare(doc_id, raw.to_pybytes().split() if raw is not None else [])
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield done(ids, texts)

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list], list] = lambda _, words: words
) -> DataFrame:
    """One row per document: number of runs, the longest one, and digests of all runs and of the text without repeats.

    ``prepare`` may change the words (as bytes) of a document first.
    """
    rows = columns_of(docs, doc_id=id_col, text=text_col)
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(_found(prepare), _DDL)
