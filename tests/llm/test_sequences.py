"""Prefix trie, periodic runs and token files against brute force, and their defined results on odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

CONV = "conv_id long, turn int, role string, text string, ids string, shard int, base int"


def talks(spark, rows):
    """Conversations with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CONV)


# prefix trie


def trie_by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        own_bytes = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own_bytes + sum(saved[c] for c in children[path])
    out = set()
    for path, of in members.items():
        ends = ",".join(str(c) for c in of if len(built[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.add((of[0], len(path), parent, len(of), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_talks(seed, n, kinds, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice((1, 1, 3)), rng.choice((t, t, t, None)), rng.choice(("user", "", None)), rng.choice(("é", "bb", "", None, "x" * 9)[:kinds])))
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("seed, n, kinds, longest", [(1, 300, 5, 6), (2, 120, 1, 50), (3, 500, 2, 12), (4, 7, 5, 40)])
def test_trie_against_brute_force(spark, monkeypatch, rebuild, seed, n, kinds, longest):
    from sightline.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 60)  # many shards with boundaries within nodes
    rows = random_talks(seed, n, kinds, longest)
    found = prefix_trie.conversation_trie(talks(spark, rows).repartition(3), rebuild).select(prefix_trie.NODE).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == trie_by_hand(rows, rebuild)


def test_trie_with_a_hot_sequence_over_shards(spark, monkeypatch):
    from sightline.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 100)
    rows = [(c, t, "user", f"hot {t}") for c in range(400) for t in range(3)] + [(1000 + c, t, "user", f"hot {t}" if t < 3 else f"{c % 5}") for c in range(50) for t in range(20)]
    found = {tuple(r) for r in prefix_trie.conversation_trie(talks(spark, rows), False).select(prefix_trie.NODE).collect()}
    assert found == trie_by_hand(rows, False)


def test_trie_on_odd_rows(spark):
    from sightline.llm.prefix_trie import NODE, conversation_trie

    assert conversation_trie(talks(spark, [])).count() == 0
    odd = [
        (None, 0, "user", "lost"), (5, None, None, None), (5, None, "", ""), (5, 1, "user", "x" * 100_000), (5, 1, "user", "x" * 100_000),
        (6, 3, "a", "b"), (11, 0, "ab", ""), (12, 0, "a", "b"), (-3, 0, "a", "b"), (0, 1, "q", "r"), (2**40, 1, "q", "r"),
    ]
    for rows in (odd, odd[:1], odd[5:6], [(c, t, "r", str(t)) for c in (7, 8) for t in range(400)]):
        found = conversation_trie(talks(spark, rows)).select(NODE).collect()
        assert {tuple(r) for r in found} == trie_by_hand(rows) and len(found) == len(trie_by_hand(rows))


# periodic runs


def runs_by_hand(words, least, power):
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(least, power * q):
                part = words[a : a + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((a, length, q))
            i += i == a
    return sorted(out)


def test_lyndon_arrays_and_runs_against_brute_force():
    from sightline.llm.word_runs import lyndon_array, runs

    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 28))]
        codes = np.array(words, np.int64)
        longest = [next((j for j in range(i + 1, len(words)) if words[j:] < words[i:]), len(words)) - i for i in range(len(words))]
        assert lyndon_array(codes).tolist() == longest
        assert [tuple(r) for r in runs(codes).tolist()] == runs_by_hand(words, 2, 2)


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_result(doc_id, text):
    words = altered(doc_id, (text or "").encode().split())
    found = runs_by_hand(words, 6, 4)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    return doc_id, len(found), *best, milli, listed, kept


DOCS = "doc_id long, text string, start string, n_runs int, n int, packed string"


def texts(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


ODD = [
    (None, None), (None, "a a a a a a"), (None, "a a a a a a"), (3, ""), (4, " \t\n"), (4, "one"), (5, "A a A a A a A a"), (5, "A a A a A a A a"),
    (6, "word " * 30_000), (7, "x" * 200_000), (-8, "a a a a a"), (9, "ÉTÉ 漢字 ÉTÉ 漢字 ÉTÉ 漢字 ÉTÉ 漢字 q"), (10, "a\x0bb\x1fa\x0bb\x1fa\x0bb\x1fa\x0bb\x1fa"),
]


def test_periodic_runs_against_brute_force(spark):
    from sightline.llm.word_runs import alter, periodic_runs

    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = []
        while len(words) < rng.randrange(60):
            words += [rng.choice("abcdefg") for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
        rows.append((i, " ".join(words)))
    rows += [r for r in ODD if r[0] != 6]
    found = periodic_runs(texts(spark, rows).repartition(3), prepare=alter).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(run_result(*r)) for r in rows)
    assert sum(r.n_runs for r in found) > 200
    long = {r.doc_id: r for r in periodic_runs(texts(spark, ODD)).collect()}[6]
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert periodic_runs(texts(spark, [])).count() == 0


def test_periodic_runs_of_given_documents(spark):
    from sightline.llm.queries import op12_periodic_runs

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len((r.text or "").split()) < 600}
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    for r in docs:
        if r.doc_id in short:
            assert found[r.doc_id] == run_result(r.doc_id, r.text)


# token files


def test_ranks_there_and_back():
    from sightline.llm.token_files import decode_ranks, encode_ranks

    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        ranks[:4] = [0, 255, 256, 65536][: min(n, 4)]
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4) and decode_ranks(control, data, n).tolist() == ranks.tolist()


TRICKY = [
    "Don't I'LL 'S x'T ...a.b", "J̌ É É Å", "<|startoftext|>a <|ENDOFTEXT|> x<|endoftext|>y <|q", "ΣΑΣ ΟΔΟΣ. İi ẞ", "漢字　a  b\x85c",
    "a\x00b\x1fc", "​", "1234 5", "<|startoftext|>", "A" * 5000,
]


def expected_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(d, [*tool.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def summed(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_against_the_tokenizer(spark, monkeypatch, tmp_path):
    from sightline.llm import token_files

    rows = [r for r in ODD if r[0] is not None and r[0] not in (4, 5)] + [(100 - i, t) for i, t in enumerate(TRICKY)]
    start, want = 0, set()
    for d, ids in sorted(expected_ids(rows)):
        want.add((d, start, len(ids), summed(ids)))
        start += len(ids)
    docs = texts(spark, rows).repartition(3)
    assert {tuple(r) for r in token_files.token_files(docs).collect()} == want
    folder = str(tmp_path / "out")
    monkeypatch.setattr(token_files, "FILE_BYTES", 100)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 7)
    manifest = token_files.write_token_files(docs, folder)
    assert {tuple(r) for r in token_files.read_token_files(manifest, folder).collect()} == want
    names = [r.file for r in manifest.orderBy("part", "block").dropDuplicates(["file"]).collect()]
    back = {}
    for name in names:
        for ids, bound, flat in token_files.read_blocks(folder, name):
            back.update({i: flat[a:b].tolist() for i, a, b in zip(ids, bound[:-1], bound[1:], strict=True)})
    assert back == dict(expected_ids(rows))
    name = names[0]
    raw = bytearray((tmp_path / "out" / name).read_bytes())
    raw[-9] ^= 1
    (tmp_path / "out" / name).write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_blocks(folder, name))


def test_token_files_with_null_and_repeated_ids(spark):
    from sightline.llm.token_files import token_files

    found = token_files(texts(spark, ODD).repartition(4)).orderBy("start").collect()
    ids = expected_ids(ODD)
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in found))) == sorted(repr((d, len(i), summed(i))) for d, i in ids)
    assert [r.start for r in found] == np.r_[0, np.cumsum([r.n_tokens for r in found])][:-1].tolist()
    order = [(r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in found]
    assert order == sorted(order)
    assert token_files(texts(spark, [])).count() == 0


def test_known_words_may_be_forgotten(monkeypatch):
    import pyarrow as pa

    from sightline.llm import token_files

    monkeypatch.setattr(token_files, "KEPT", 3)
    encoder = token_files.WordEncoder(token_files.vocabulary_file())
    for batch in (TRICKY, ["one two three four five", None], TRICKY[::-1]):
        ids, bounds = encoder.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [i[:-1] for _, i in expected_ids([(0, t) for t in batch])]
