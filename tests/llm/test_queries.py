"""Queries over whole tables against SQL or brute force."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest

from memoryloom.llm import pieces
from memoryloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    ours, theirs = QUERIES[name](spark, data).toPandas(), c.execute(ORACLE_SQL[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(repr, map(tuple, ours[cols].astype(str).values))) == sorted(map(repr, map(tuple, theirs[cols].astype(str).values)))


def test_op2(spark, data, texts):
    import xxhash

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        hs = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {d: fp(t) for d, t in texts.items()}
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, data).collect()}
    assert got == {d: (f"{fps[d]:016x}", root(d)) for d in fps}


def test_op8(spark, data, texts):
    kinds = {
        "assign": (re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    for r in QUERIES["op8_secrets"](spark, data).collect():
        found = sorted((m.start(), i, k, m.end()) for i, (k, (rx, g, n)) in enumerate(kinds.items()) for m in rx.finditer(texts[r.doc_id]) if len(m[g]) >= n)
        shown = [f"{k}:{a}:{b}" for a, _, k, b in found]
        assert hashlib.sha256(",".join(shown).encode()).hexdigest() == r.base_sha256
        assert [sum(x[2] == k for x in found) for k in kinds] == [r.n_assign, r.n_access, r.n_hex]
        assert not Counter(shown) - Counter(r.spans.split(","))


def test_op9(spark, data, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op9_sentencepiece"](spark, data).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op3_finds_every_repeated_line(spark, data, texts):
    first = {}
    for d in sorted(texts):
        for k, line in enumerate(texts[d].split("\n")):
            first.setdefault(line, (d, k))
    for r in QUERIES["op3_lines"](spark, data).collect():
        gone = {int(x.split(":")[0]): tuple(map(int, x.split(":")[1:])) for x in r.dropped.split(",") if x}
        assert r.n_dropped == len(gone) and r.n_lines == texts[r.doc_id].count("\n") + 1
        for k, line in enumerate(texts[r.doc_id].split("\n")):
            if not line or line.isspace():
                assert k not in gone
            elif first[line] != (r.doc_id, k):
                assert k in gone
            if k in gone:
                d, n = gone[k]
                if len(line) < 5:
                    assert (d, n) == first[line]
                    continue
                a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (line, texts[d].split("\n")[n]))
                assert (d, n) < (r.doc_id, k) and len(a & b) > 0.5 * len(a | b)  # its class's first: linked over others


def test_pipeline_stages(spark, data, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and (i not in (3, 4) or now == ids)
        ids = now
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    assert sum(q == (d in kept) for d, q in labels.items()) >= 0.97 * len(labels)
    text = "\n".join(r.text for r in spark.read.parquet(str(tmp_path / "3")).collect())
    assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|password=[0-9a-f]{6,}", text)
    whole = pipeline.run(spark, data).toPandas()
    assert set(whole.doc_id) == ids and whole.groupby("sequence_id").length.sum().max() <= 2048
