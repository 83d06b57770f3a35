"""Centroid clustering, byte-level BPE and hard negatives against brute force, the library and edge rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from memoryloom.llm import bytebpe, centroids, negatives
from memoryloom.llm.queries import QUERIES
from memoryloom.llm.shared import Scratch

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster int, was int, block int, group string"


def embedded(spark, rows):
    """rows: (vec_id, embedding, label); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], VECTORS)


def numbers(width, n, seed, scale=1.0, label=lambda i, rng: rng.randrange(4)):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(width)], label(i, rng)) for i in range(n)]


# Byte-level BPE


@pytest.fixture(scope="module")
def byte_bpe():
    bpe = bytebpe.ByteBpe(public_tokenizers.path(bytebpe.MODEL))
    return bpe, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_byte_bpe_equals_the_library(byte_bpe):
    bpe, lib = byte_bpe
    rng = random.Random(5)
    kinds = ["ab", "a ", "a' s", "'tsrevmld ", "\n\r\t  ab1!", "éàü漢字 　 ", "abcdefghijklmnop", "0123 .", "aA!?#-_=*", "\x1c\x1d\x85 \xa0a", "🙂a‍ "]
    for _ in range(2500):
        text = "".join(rng.choice(kinds[rng.randrange(len(kinds))]) if rng.random() < 0.1 else rng.choice(kinds[_ % len(kinds)]) for _ in range(rng.randrange(0, 150)))
        ids = bpe.encode(text)
        assert ids == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 70_001, "ab" * 40_000, "the" * 30_000, " " * 65_537, "=" * 99_999, "漢" * 20_000, "-=" * 30_001 + "x"])
def test_byte_bpe_of_one_very_long_word(byte_bpe, text):
    bpe, lib = byte_bpe
    assert bpe.encode(text) == lib.encode_ordinary(text)


def test_byte_bpe_of_a_long_word_of_any_letters(byte_bpe):
    bpe, lib = byte_bpe
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert bpe.encode(text) == lib.encode_ordinary(text)


def test_neighbours_join_as_a_monoid(byte_bpe):
    """Wherever a word is cut, the halves' encodings join to the whole's."""
    bpe, _ = byte_bpe
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaa", b"abababababab", "übergrößenträger".encode()):
        raw = np.frombuffer(word, np.uint8)
        whole, _ = bpe.tree(raw, np.array([len(word)]))
        for cut in range(1, len(word)):
            (a, n), (b, m) = bpe.tree(raw[:cut], np.array([cut])), bpe.tree(raw[cut:], np.array([len(word) - cut]))
            joined, _ = bpe._joined(np.concatenate([a, b]), n, m)
            assert joined.tolist() == whole.tolist()


def test_a_match_that_is_a_token_is_that_token(tmp_path):
    """Ranks by whose merges a token of three bytes isn't reached: the whole match still is it, a part of one isn't."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258}
    ranks = {**ranks, b"ab": 258, b"abc": 300, b"bcd": 257, b"abcd": 301}
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for t, i in ranks.items()))
    bpe, lib = bytebpe.ByteBpe(str(path)), tiktoken.Encoding("few", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for text in ["abc", "abcd", "xabc", "abcabc", "abcdabc", *("".join(rng.choice("abcd ") for _ in range(rng.randrange(30))) for _ in range(500))]:
        assert bpe.encode(text) == lib.encode_ordinary(text), text


def test_op12(spark, data, byte_bpe):
    _, lib = byte_bpe
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op12_bytebpe"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_of_edge_rows(spark, byte_bpe):
    _, lib = byte_bpe
    long = "word " * 60_000 + "x" * 50_000
    rows = [(1, None, "a"), (1, "", "b"), (None, "same", "c"), (None, "same", "c"), (2, "\n\n \t", None), (3, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bytebpe.encode_documents(docs, public_tokenizers.path(bytebpe.MODEL)).collect()
    want = [lib.encode_ordinary(t or "") for _, t, _ in rows]
    assert sorted((r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out) == sorted((len(w), np.array(w, "<u4").tobytes(), (t or "").encode()) for w, (_, t, _) in zip(want, rows))
    assert bytebpe.encode_documents(docs.limit(0), public_tokenizers.path(bytebpe.MODEL)).count() == 0


def test_chunks_are_forgotten_within_bounds(byte_bpe, monkeypatch):
    bpe, lib = byte_bpe
    monkeypatch.setattr(bytebpe, "CACHE_IDS", 500)
    table = bytebpe.ChunkTable(bpe.encode_chunks, 50, 20)
    for k in range(30):
        texts = [f"some {k} words{j % 7} and {j * k} more" for j in range(20)]
        ids, n = table.lookup(map(bytebpe.chunks_of, texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode_ordinary(t) for t in texts]


# Centroids


def lloyd(vectors, k, rounds, seed):
    """(vec_id, v) assigned in plain rounds over all vectors and centroids."""
    named = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None]
    cs = [v for _, v in sorted(named)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        for j in range(len(cs)):
            if mine := [v for (_, v), o in zip(vectors, own) if o == j]:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in vectors] if cs else [], cs


@pytest.mark.parametrize("scale, rounds, n", [(1.0, 3, 400), (1.0, 9, 150), (2e6, 3, 120), (1e12, 3, 60), (0.02, 4, 300), (1.0, 3, 5)])
def test_centroids_equal_plain_rounds(spark, scale, rounds, n):
    rows = [r for r in numbers(6, n, n, scale)]
    rows += [(r[0], r[1], r[2]) for r in rows[: n // 4]] + [(None, rows[0][1], 1), (9_000_000, [0.0] * 6, None)]
    kept = centroids.kept_vectors(embedded(spark, rows).repartition(5), 6)
    vectors = [(r.vec_id, list(r.v)) for r in kept.collect()]
    assert len(vectors) == len(rows)
    want, cs = lloyd(vectors, 8, rounds, 1)
    with Scratch(spark) as scratch:
        found = centroids.cluster(scratch, kept, 8, rounds, 1)
    got = [(r.vec_id, r.cluster, r.distance) for r in found.rows.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=order) == sorted([(i, c, min(d, centroids.LONG)) for i, c, d in want], key=order)
    assert found.centroids == cs
    assert found.inertia == [sum(min(d, centroids.LONG) for _, c, d in want if c == j) for j in range(len(cs))]


def test_centroids_leave_bad_vectors_out(spark):
    good = [(i, [float(i % 5), 1.0, -2.5], 0) for i in range(20)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [1.0, float("nan"), 2.0], 0), (103, [float("inf"), 1.0, 2.0], 0), (104, [1.0, 2.0], 0), (105, [], 0), (106, [1.0] * 4, 0)]
    kept = centroids.kept_vectors(embedded(spark, good + bad), 3)
    assert sorted(r.vec_id for r in kept.collect()) == list(range(20))
    assert [r.v for r in kept.where("vec_id = 3").collect()] == [[192, 64, -160]]
    with Scratch(spark) as scratch:
        none = centroids.cluster(scratch, kept.limit(0), 4, 3, 1)
        # Vectors that are all alike: ties go to the smallest number, the other clusters stay empty where they are.
        same = centroids.cluster(scratch, kept.where("vec_id % 5 = 2"), 3, 3, 1)
    assert none.rows.count() == 0 and none.centroids == []
    assert {r.cluster for r in same.rows.collect()} == {0} and same.centroids[0] == same.centroids[2] and same.inertia == [0, 0, 0]


# Hard negatives


def hard(rows, every, positives, negatives_):
    """(vec_id, label, v) by brute force."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for n, (j, other, w) in enumerate(rows) if n != k)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            some = [(s, m) for s, m, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, r, m, -p, -s) for r, (s, m) in enumerate(some[:negatives_], 1)]
    return out


@pytest.mark.parametrize("n, width, scale, seed", [(300, 5, 1.0, 1), (300, 2, 0.01, 2), (120, 4, 3e6, 3), (80, 3, 1e14, 4), (250, 5, 0.004, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, width, scale, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "GROUP", 6)
    monkeypatch.setattr(negatives, "FIRST", 3)
    rows = numbers(width, n, seed, scale)
    rows += rows[:20] + [(i, rows[0][1], 2) for i in range(n, n + 60)] + [(10, rows[3][1], 1), (n + 70, [0.0] * width, 1), (n + 100, [scale], 0)]
    mined = negatives.mined_vectors(embedded(spark, rows).repartition(4))
    plain = [(r.vec_id, r.label, list(r.v)) for r in mined.collect()]
    with Scratch(spark) as scratch:
        got = [tuple(r) for r in scratch.keep(negatives.mine(scratch, mined, 10, 5, 10)).collect()]
    want = hard(plain, 10, 5, 10)
    cut = lambda rows: sorted((*r[:4], *(min(max(x, -(2**63)), 2**63 - 1) for x in r[4:])) for r in rows)
    assert cut(got) == cut(want)
    assert want or scale == 0.004


def test_negatives_of_edge_rows(spark):
    ok = numbers(4, 40, 9)
    bad = [(100, None, 0), (200, [1.0, None], 0), (300, [float("nan")] * 4, 0), (400, [1.0] * 4, None), (None, [1.0] * 4, 1), (500, [float("-inf")] * 4, 1)]
    mined = negatives.mined_vectors(embedded(spark, ok + bad))
    found = {r.vec_id: r.label for r in mined.collect()}
    assert sorted(found) == list(range(40))
    assert all(found[i] == ((label + 1) % 10 if i % 7 == 0 else label) for i, _, label in ok)
    with Scratch(spark) as scratch:
        assert negatives.mine(scratch, mined.limit(0)).count() == 0
        assert negatives.mine(scratch, mined.where("vec_id % 100 <> 0")).count() == 0
        # An anchor without another row of its label has no positive; one without other labels no negative.
        alone = spark.createDataFrame([(0, 1, [5, 5]), (1, 2, [4, 4]), (2, 2, [3, 3])], "vec_id long, label long, v array<long>")
        assert negatives.mine(scratch, alone).count() == 0
        alike = spark.createDataFrame([(0, 1, [5, 5]), (1, 1, [4, 4])], "vec_id long, label long, v array<long>")
        assert negatives.mine(scratch, alike).count() == 0
        assert negatives.mine(scratch, alike.union(alone.where("vec_id = 2"))).count() == 1


def test_brackets_hold_every_score(spark):
    """Blocks are read only where their bracket reaches a target, so a wrong bracket would lose rows of tight clusters."""
    rng = random.Random(3)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in centers[i % 6]], i % 3) for i in range(600)]
    mined = negatives.mined_vectors(embedded(spark, rows))
    plain = [(r.vec_id, r.label, list(r.v)) for r in mined.collect()]
    with Scratch(spark) as scratch:
        got = [tuple(r) for r in scratch.keep(negatives.mine(scratch, mined, 20, 5, 10)).collect()]
    assert sorted(got) == sorted(hard(plain, 20, 5, 10))
