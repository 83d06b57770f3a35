"""Operators whose results are trained, packed or searched, against brute force and held-out rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memoryloom.llm import bpe, hostrules, language, licences, lines, packing, pieces, quality, secrets, simhash, topk
from memoryloom.llm.shared import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, "s", 1), (3, "x " * 60_000, "en", "s", 9), (3, "x " * 60_000, "en", "s", 9)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumn("fp", F.lit(1)).withColumn("node", F.lit("extra"))


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


def test_edge_rows_and_empty_tables(spark, edge, empty, data):
    path = public_tokenizers.path
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for docs in (edge, empty):
        n = docs.count()
        assert quality.score(docs, quality.fit_sample(docs, labels)).count() == n
        assert quality.accepted(docs, quality.fit_sample(docs, labels)).columns == docs.columns
        assert language.predict(docs, language.fit_sample(docs)).count() == n
        assert simhash.classes(spark, docs).count() == n
        assert simhash.one_per_group(spark, docs).columns == docs.columns
        assert lines.without_repeated_lines(spark, docs).columns == docs.columns
        assert pieces.encode_documents(docs, path(pieces.MODEL)).count() == n
        assert hostrules.verdicts(spark, docs).count() == n
        assert secrets.find(spark, docs).count() == n
        assert secrets.redact(spark, docs).count() == n
        assert licences.scan(docs).count() == n
        assert (packing.pack_documents(spark, docs).select("doc_id").distinct().count() if n else 0) == (4 if n else 0)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 400)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {x.node: x.root for x in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert set(got) == set(want)
    pairs = {(got[x], want[x]) for x in got}
    assert len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_simhash_links_all_within_three_bits(spark):
    r = random.Random(4)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for _ in range(8)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x.node: x.root for x in components(scratch, simhash.ball_links(simhash.close_enough(df))).collect()}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = lambda f: {frozenset(x for x in signed if f(x) == c) for c in {f(x) for x in signed}}
    assert groups(lambda x: got.get(x, x)) == groups(root)


def test_packing_fills_sequences(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack_documents(spark, docs).toPandas()
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(public_tokenizers.path(packing.MODEL)), {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[r.doc_id, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 2


def test_packing_plans_use_every_piece_once():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 20_000):
        hist = np.zeros(2049, np.int64)
        np.add.at(hist, np.minimum(2047, rng.lognormal(5.5, 1.2, n).astype(int)) + 1, 1)
        used = np.zeros(2049, np.int64)
        plan, total = packing.plan(hist, 60)
        for lengths, m in plan:
            assert sum(lengths) <= 2048
            np.add.at(used, list(lengths), m)
        assert (used == hist).all() and total <= 1.01 * (hist * np.arange(2049)).sum() / 2048 + 2


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    mine, lib, r = packing.WordBpe(public_tokenizers.path(packing.MODEL)), Tokenizer.from_file(public_tokenizers.path(packing.MODEL)), random.Random(1)
    parts = ["a", "The", "ING", " ", "\n", "É", "'s", "'", "\x00", "日本", "🙂", "====", "23", "\xa0", "\x85", "Å", "Σ", "İ", "ß", "don't", "<|endoftext|>", ".", "|"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(25)))
        ws = t.encode().split()
        assert (mine.encode_words(ws)[0].tolist() if ws else []) == lib.encode(t, add_special_tokens=False).ids


def test_pieces_are_the_library():
    import sentencepiece

    mine, lib, r = pieces.PieceBpe(public_tokenizers.path(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL)), random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "▁", "\x00", "日本", "🙂", "====", "----", "ﬁ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(1500)] + ["a" * 3000, "-_" * 900 + "aab" * 400]
    table = bpe.WordTable(mine.encode_words, 50)
    for t in texts:
        ids = mine.encode(t)
        assert ids == lib.encode(t) and mine.decode(ids) == lib.decode(ids) == lib.decode(lib.encode(t))
        got, n = table.lookup([mine.words(t)])
        assert pieces._strings(mine.bytes, got, n, head=1).to_pylist() == [lib.decode(ids)]
    assert mine.decode([mine.byte_ids[0xFF], mine.chars[ord("a")]]) == lib.decode([int(mine.byte_ids[0xFF]), int(mine.chars[ord("a")])])


def test_quality_and_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    from memoryloom.llm.quality import op1_quality

    out = op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.97 and out.score.between(0, 1).all()
    out = language.op5_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97


def test_suffix_automaton_knows_all_substrings():
    codes = [1, 2, 1, 1, 3, 2, 1]
    table, keys, _ = language.suffix_automaton(codes, 4)
    assert not len(keys)
    dense, keys, to = language.suffix_automaton(codes, 2)  # transitions of codes 2 and 3 are searched for
    full = dict(zip(keys.tolist(), to.tolist()))
    assert all(table[s, c] == (dense[s, c] if c < 2 else full.get(s << 32 | c, 0)) for s in range(len(table)) for c in range(4))
    for a in range(1, 4):
        for b in range(1, 4):
            for c in range(1, 4):
                s = 0
                for x in (a, b, c):
                    s = table[s, x] if s or x == a else 0
                    if not s:
                        break
                assert bool(s) == any(codes[i : i + 3] == [a, b, c] for i in range(5))


def test_line_forests_connect_what_all_pairs_connect():
    r = random.Random(5)
    base = "the quick brown fox jumps over the lazy dog near the river bank while it rains on green hills"
    for n in (2, 20, 200):
        some = []
        for _ in range(n):
            w = base.split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = "".join(r.choice("abcdefé") for _ in range(4))
            some.append(" ".join(w))
        sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in some]
        close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9  # noqa: B023, E731

        def names(edges):
            p = list(range(n))  # noqa: B023

            def f(x):
                while p[x] != x:
                    x = p[x]
                return x

            for a, b in edges:
                p[f(a)] = f(b)
            return [f(i) for i in range(n)]  # noqa: B023

        got = lines.linked(lines.Shingler().sets(some))
        assert all(close(i, j) for i, j in got)
        a, b = names(got), names([(i, j) for i in range(n) for j in range(i) if close(i, j)])
        assert all((a[i] == a[j]) == (b[i] == b[j]) for i in range(n) for j in range(i))


def test_repeated_lines_keep_the_first(spark):
    long = "a line that is long enough to take part in the comparison of all lines"
    docs = spark.createDataFrame([(5, f"{long}\nOf.", 1), (2, f"own words stand here and nobody else has them in this table\n{long}!", 1), (9, "Of.", 1), (7, long, 1)], "doc_id long, text string, other int")
    out = {r.doc_id: r.text for r in lines.without_repeated_lines(spark, docs).collect()}
    assert out == {2: f"own words stand here and nobody else has them in this table\n{long}!"}
    short = spark.createDataFrame([(1, "a few words that stand alone here\nOf.\n \n{\nof."), (2, "other words that nobody else has\nOf.\n \n\n{\n}")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.without_repeated_lines(spark, short).collect()}
    # Equal short lines are one, blank ones separate paragraphs and stay.
    assert out == {1: "a few words that stand alone here\nOf.\n \n{\nof.", 2: "other words that nobody else has\n \n\n}"}


def test_lines_of_templates_meet_by_rare_shingles(spark):
    """Lines of one template share bins without being similar; those that are similar among them are still found."""
    r = random.Random(8)
    pool = [f"entry {k} of the list with its own words {r.randrange(10**6)}" for k in range(700)]
    pool += [f"{r.randrange(10**9)} zzz yyy {r.randrange(10**9)} request answered by the usual server" for k in range(500)]
    pool += [x[:-1] + "!" for x in pool[::40]]
    sets = lines.Shingler().sets(pool)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(both := set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * (len(sets[i]) + len(sets[j]) - len(both))}

    def classes(pairs):
        parent = list(range(len(pool)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(len(pool))]

    assert classes(lines.linked(sets)) == classes(want)
    assert lines._rare_pairs(sets, [np.unique(np.concatenate(sets), return_inverse=True)[1][a:b] for a, b in zip(np.cumsum([0, *map(len, sets[:-1])]), np.cumsum(list(map(len, sets))))], np.bincount(np.unique(np.concatenate(sets), return_inverse=True)[1]), np.arange(len(sets)), 0.8) is not None
    scratch = Scratch(spark)
    rows = spark.createDataFrame([(x,) for x in pool], "line string").withColumn("line_id", F.xxhash64("line"))
    met = rows.select(F.lit(1).cast("long").alias("key"), "line_id")
    links = lines._links(scratch, rows.select("line"), met, 0.8, lambda: lines.Shingler().sets, 64)
    ids = {x.line_id: k for k, x in enumerate(rows.collect())}
    assert classes((ids[x.a], ids[x.b]) for x in links.collect()) == classes(want)


def test_secret_parts_need_each_other(spark):
    token = "q8Zk2mVb7Xw4Rt9Lp3Nc6Hd1Js5Fg0Ya"
    texts = [f"key {token} alone", f"login: alice then {token} there", f"https://api.example.org/v1 with {token}", "secret=token:abcdefgh", "see https://example.org", f"login: alice {'x ' * 400} {token}"]
    out = {r.doc_id: r for r in secrets.find(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = lambda i: [x.kind for x in out[i].spans]
    assert [kinds(i) for i in range(6)] == [[], ["id_part", "secret_part"], ["endpoint_part", "secret_part"], [], [], []]
    red = {r.doc_id: r.text for r in secrets.redact(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert token not in red[1] and red[0] == texts[0] and red[1].endswith("[secret] there")


def test_host_counts():
    assert hostrules._counts("a b c a b c\n\na b\na b\n é #$") == (12, 13, 2, 1, 8, 4)
    assert hostrules._counts("") == (0, 0, 0, 0, 0, 0)


def test_top_k_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[50:150] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1020, [float("nan")] * 6), (1040, [1.0, None]), (None, [1.0] * 6)]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.Index(Scratch(spark), df).search(every=20, k=20).toPandas()
    v = np.floor(64 * x).astype(int)
    for q in range(0, 300, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g.vec_id) == order and list(g.score) == list(s[order])


def test_licence_rules_need_their_order(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [mit, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "A licence of my own. No permission.", "\n\n".join(reversed(mit.split("\n\n")))]
    out = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(5)] == ["MIT", "MIT", "Apache-2.0", "", ""]


def test_word_table_forgets_words_that_came_once():
    import numpy as np
    import pyarrow as pa

    from memoryloom.llm.bpe import WordTable

    def encode(words):
        return np.array([c for w in words for c in w], np.int32), np.array([len(w) for w in words], np.int64)

    table = WordTable(encode, 8, batch=3)
    for k in range(60):
        texts = [f" often  {'abc'[k % 3] * 3}\n", None, f"new{k} other{k}\t", "", "\x0b\x0c often"]
        ids, n = table.lookup_split(pa.array(texts)) if k % 2 else table.lookup([(t or "").encode().split() for t in texts])
        want = ["".join((t or "").split()) for t in texts]
        assert "".join(map(chr, ids)) == "".join(want) and n.tolist() == [len(w) for w in want]
        assert len(table) <= 8 + 5
    assert [len(x) for x in table.lookup_split(pa.array([], pa.string()))] == [0, 0]


def test_pipeline_links_every_pair_of_four_fifths(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    base = [[word() for _ in range(r.choice([20, 60, 300]))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for n in (1, 2, 4, 8):
            c = list(b)
            for i in r.sample(range(len(c)), min(n, max(1, len(c) // 40))):
                c[i] = word()
            texts.append(" ".join(c))
        texts.append(" ".join(b[: len(b) * 85 // 100]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    fps = [simhash.fingerprint(t.encode().split(), 5) for t in texts]
    far = [(i, j) for i, j in near if (fps[i] ^ fps[j]).bit_count() > simhash.RADIUS]
    assert len(far) > 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.component_id for x in simhash.classes(spark, docs, 5, similarity=simhash.SIMILARITY).collect()}
    assert all(got[i] == got[j] for i, j in near)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in near + [(i, j) for j in range(len(texts)) for i in range(j) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3]:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(texts))}
    assert {x.doc_id for x in simhash.one_per_group(spark, docs).collect()} == {i for i in range(len(texts)) if root(i) == i}


def test_short_lines_that_repeat_go(spark):
    rows = ["All rights reserved.\nnext:\nfirst text", "next:\n\n      \nsecond text here\nAll rights reserved.", "Released under the MIT License\n      \nother\nother", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], DOCS)
    got = {x.doc_id: [(y.line_no, y.owner_id, y.owner_no) for y in x.dropped] for x in lines.dropped_lines(Scratch(spark), docs).collect()}
    assert got == {1: [(0, 0, 1), (4, 0, 0)], 2: [(3, 2, 2)], 3: [(0, 2, 0)]}


def test_secret_parts_meet_at_all_offsets_and_lengths(spark):
    texts, want = [], []
    for long in (32, 50, 399, 450, 1300):
        for at in (0, 1, 390, 399, 400, 770):
            for gap in (1, 10, 360, 390, 399, 400, 401):
                key = "Ab1" + "x" * (long - 3)
                for first, second in ((key, "login: alice"), ("login: alice", key)):
                    texts.append(" " * at + first + " " * gap + second)
                    want.append([] if gap >= 400 else [(at, at + len(first)), (at + len(first) + gap, at + len(first) + gap + len(second))])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: [(y.start, y.end) for y in x.spans] for x in secrets.find(spark, docs).collect()}
    assert got == dict(enumerate(want))
    assert not any("Ab1" in x.text for x in secrets.redact(spark, docs).collect() if want[x.doc_id])


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def _licensed(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    return [(x.sentence_ids, x.licences) for x in licences.scan(docs).sort("doc_id").collect()]


def test_licences_of_genuine_headers(spark):
    texts = [MIT, APACHE, GPL, BSD, ISC]
    want = [
        ("/mit-grant/mit-condition/as-is/", "MIT"),
        ("/apache-notice/apache-use/apache-basis/", "Apache-2.0"),
        ("/gpl-redistribute/gpl-hope/", "GPL-3.0-or-later"),
        ("/bsd-grant/bsd-source/bsd-binary/", "BSD-2-Clause"),
        ("/isc-grant/", "ISC"),
    ]
    assert _licensed(spark, texts) == want
    assert _licensed(spark, [" ".join(t.split()) for t in texts]) == want
    lesser = GPL.replace("GNU General", "GNU Lesser General")
    assert _licensed(spark, [lesser])[0][1] == "LGPL-3.0-or-later"
    older = lesser.replace("either version 3", "either version 2")
    assert _licensed(spark, [older])[0][1] == ""


def test_licences_of_spdx_lines(spark):
    texts = ["// SPDX-License-Identifier: MIT\nint main();", "# SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0+) AND Nobody-1.0\n" + MIT, "SPDX-License-Identifier: gpl-3.0", "SPDX-License-Identifier:", "the MIT of SPDX"]
    want = [("/spdx-MIT/", "MIT"), ("/spdx-Apache-2.0/spdx-GPL-2.0-or-later/mit-grant/mit-condition/as-is/", "MIT,Apache-2.0,GPL-2.0-or-later"), ("/spdx-GPL-3.0-only/", "GPL-3.0-only"), ("", ""), ("", "")]
    assert _licensed(spark, texts) == want


def test_licences_of_very_long_texts(spark):
    """40,000 sentences between two of one licence, and a text of one endless sentence: time in proportion."""
    import time

    grant, condition = MIT.split("\n\n")[:2]
    one = "Licensed under CC BY 4.0.\n"
    near = grant + "\n\n" + one * 40_000 + condition
    far = grant + "\n\n" + one * 100 + "licence " * 1000 + "\n\n" + condition
    began = time.time()
    got = _licensed(spark, [near, far, "licence " * 400_000])
    assert time.time() - began < 20
    assert [x[1] for x in got] == ["MIT,CC-BY-4.0", "CC-BY-4.0", ""]
    assert got[0][0].count("/") == 40_003


def test_licences_of_both_readings(spark):
    bare = "some text\nLicensed under CC BY 4.0\nmore text\n"
    got = _licensed(spark, [bare + "\n" + MIT, MIT + "\n\n" + bare, bare + bare.replace("CC BY", "CC BY SA") + bare.replace("CC BY", "CC BY NC") + bare.replace("CC BY 4.0", "the MIT License") + "\n" + ISC])
    assert got == [
        ("/cc-by-notice/mit-grant/mit-condition/as-is/", "MIT,CC-BY-4.0"),
        ("/mit-grant/mit-condition/as-is/cc-by-notice/", "MIT,CC-BY-4.0"),
        ("/cc-by-notice/cc-by-sa-notice/cc-by-nc-notice/mit-licensed/isc-grant/", "MIT,ISC,CC-BY-NC-4.0,CC-BY-4.0,CC-BY-SA-4.0"),
    ]


def test_components_in_rounds(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(200)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    groups = []
    for alone in (10**6, 30, 0):
        with Scratch(spark) as scratch:
            names = {x.node: x.root for x in components(scratch, links, alone=alone).collect()}
        groups.append({frozenset(n for n in names if names[n] == x) for x in names.values()})
    assert groups[0] == groups[1] == groups[2] and frozenset(range(61)) in groups[0]
    with Scratch(spark) as scratch:
        assert components(scratch, links.where("false")).collect() == []


def test_scratch_tables_go(spark):
    import os

    with Scratch(spark) as scratch:
        gone = scratch.save(spark.range(5))
        kept = scratch.keep(spark.range(7))
        paths = [scratch.paths[id(x)] for x in (gone, kept)]
    assert [os.path.exists(x) for x in paths] == [False, True] and kept.count() == 7
    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch:
        path = scratch.paths[id(scratch.keep(spark.range(3)))]
        1 / 0  # noqa: B018
    assert not os.path.exists(path)


@pytest.mark.parametrize("near", [True, False])
def test_large_buckets_link_what_all_pairs_link(spark, near):
    r = random.Random(8)
    texts = []
    for _ in range(3 if near else 40):
        base = [r.choice("abcdefgh") for _ in range(60)]
        for _ in range(40 if near else 3):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(60)] = r.choice("ijkl")
            texts.append("".join(w))
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("line_id", F.xxhash64("line"))
    met = rows.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "line_id").where("key = 1 or pmod(line_id, 3) = 0")
    ids = {x.line: x.line_id for x in rows.collect()}
    with Scratch(spark) as scratch:
        links = lines._links(scratch, rows.select("line"), met, 0.8, lambda: lines.Shingler().sets, 8)
        names = {x.node: x.root for x in components(scratch, links, forests=True).collect()}
    sets = {ids[t]: {t[i : i + 5] for i in range(len(t) - 4)} for t in texts}
    parent = {x: x for x in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = lambda f: {frozenset(x for x in sets if f(x) == c) for c in map(f, sets)}
    assert groups(lambda x: names.get(x, x)) == groups(root)


def test_fuzzy_lines_are_those_of_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    rows = []
    for i in range(40):
        base = [word() for _ in range(r.choice([4, 25, 40]))]
        for k in range(3):
            w = list(base)
            if k:
                w[r.randrange(len(w))] = word()
            rows.append((3 * i + k, " ".join(w) + "\n" + word() + word(), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    with Scratch(spark) as scratch:
        got = {(x.doc_id, y.line_no): (y.owner_id, y.owner_no) for x in lines.dropped_lines(scratch, docs).collect() for y in x.dropped}
    places = [(d, n, line) for d, t, *_ in rows for n, line in enumerate(t.split("\n"))]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for *_, x in places]
    parent = list(range(len(places)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(places)):
        for i in range(j):
            # Bands may miss a pair at the threshold; none of these lies there.
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {places[i][:2]: places[root(i)][:2] for i in range(len(places)) if root(i) != i} and len(got) > 20


def test_bands_find_most_pairs_at_the_threshold():
    r, pairs = random.Random(10), []
    while len(pairs) < 3000:
        a = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=r.randrange(60, 300)))
        w = list(a)
        for _ in range(max(1, len(a) // 55)):
            w[r.randrange(len(w))] = r.choice("ABCDE")
        b = "".join(w)
        x, y = ({s[i : i + 5] for i in range(len(s) - 4)} for s in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            pairs.append((a, b))
    keys = [lines.band_keys([p[k] for p in pairs]) for k in (0, 1)]
    assert (keys[0] == keys[1]).any(1).mean() > 0.98


def test_packing_program_covers_every_length_near_its_bound():
    rng = np.random.default_rng(0)
    for n, least in ((2000, 0.6), (20_000, 0.9)):
        hist = np.zeros(2049, np.int64)
        np.add.at(hist, np.minimum(2047, rng.lognormal(5.5, 1.2, n).astype(int)) + 1, 1)
        solution, bound = packing.configurations(hist)
        covered = np.zeros(2049)
        for lengths, x in solution.items():
            assert sum(lengths) <= 2048 and x > 0
            np.add.at(covered, list(lengths), x)
        there = hist > 0
        assert (covered[there] <= hist[there] + 1e-6).all() and (covered[there] > 0).all()
        assert bound >= (hist * np.arange(2049)).sum() / 2048 - 1e-6
        assert sum(solution.values()) / (covered[there] / hist[there]).min() <= 1.02 * bound
        out, left = packing.rounded(hist)
        assert sum(m for _, m in out) > least * packing.plan(hist)[1]  # the program decides, not the best fit of the rest
        assert (left >= 0).all() and left.sum() < n


def test_packing_bound_is_above_the_volume_where_pieces_exclude_each_other():
    hist = np.zeros(2049, np.int64)
    hist[1100], hist[2000] = 300, 200
    assert packing.configurations(hist, 40)[1] > 1.2 * (hist * np.arange(2049)).sum() / 2048
    assert packing.plan(hist)[1] == 500


def test_knapsack_is_brute_force():
    rng = np.random.default_rng(4)
    value = np.append(-1.0, rng.random(12).round(2))
    best = packing.knapsack(value)

    def most(c):
        return max([0.0] + [value[k] + most(c - k) for k in range(1, c + 1)])

    assert np.allclose(best[1:], [most(c) for c in range(1, 13)])


def _brute_top(rows, every, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i)[:k]
            out += [(q, n, c, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, c) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [10, 10**8, 2**40])
def test_top_k_of_large_numbers_repeated_rows_and_unequal_lengths(spark, size):
    r = random.Random(size)
    rows = [(i % 90, [r.randrange(-size, size) for _ in range(3 if i % 7 else 2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    with Scratch(spark) as scratch:
        got = sorted(map(tuple, topk.Index(scratch, df).search(10, 5).collect()))
    assert got == _brute_top(rows, 10, 5)


def test_top_k_in_rounds_and_of_nothing(spark, monkeypatch):
    for name, x in (("ANNULUS_ROWS", 16), ("FIRST", 2), ("QUERY_ROWS", 8), ("SLICES", 3)):
        monkeypatch.setattr(topk, name, x)
    r = random.Random(5)
    rows = [(i, [r.randrange(-40, 40) for _ in range(8)] if i % 3 else [1] * 8) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    with Scratch(spark) as scratch:
        index = topk.Index(scratch, df)
        assert index.blocks.count() > 30
        assert sorted(map(tuple, index.search(20, 20).collect())) == _brute_top(rows, 20, 20)
        assert topk.Index(scratch, df.where("false")).search().collect() == []
        assert topk.Index(scratch, df.where("vec_id = 20")).search().collect() == []


def test_language_parse_is_longest_match():
    r = random.Random(3)
    samples = {"xx": ["".join(r.choices("abcd é", k=400)), "".join(r.choices("abx", k=50))], "yy": ["".join(r.choices("abef漢字", k=300))], "zz": ["".join(map(chr, range(0x4E00, 0x4E00 + 300)))]}
    model = language.fit(samples)
    texts = ["".join(r.choices("abcdefx é漢字", k=n)) for n in (0, 1, 7, 90, 900)]

    def known(lang, text):
        """Substrings of the sample over the language's own commonest characters."""
        code = model.codes[model.languages.index(lang)]
        return "".join(c if ord(c) < len(code) - 1 and code[ord(c)] else "\0" for c in text)

    for t in texts:
        for j, lang in enumerate(model.languages):
            sample, i, n = known(lang, "\n".join(samples[lang])), 0, 0
            lowered = known(lang, t)
            while i < len(lowered):
                k = 0
                while i + k < len(lowered) and lowered[i + k] != "\0" and lowered[i : i + k + 1] in sample:
                    k += 1
                # A character that the language doesn't know ends the phrase before it and belongs to it.
                n, i = n + 1, i + k + (i + k < len(lowered) and lowered[i + k] == "\0")
            n += sum(c == "\0" and x.isalpha() for c, x in zip(lowered, t.lower()))
            got = int(model.phrases([t])[0][j])
            # The lockstep counts a phrase where one ends, so the last open one is not counted.
            assert got in (n, n - 1)


def test_languages_of_thousands_of_characters():
    """Languages that share their commonest characters and differ in thousands of rarer ones."""
    r = random.Random(9)
    shared = [chr(0x4E00 + k) for k in range(150)]
    own = {"aa": [chr(0x5000 + k) for k in range(3000)], "bb": [chr(0x6000 + k) for k in range(3000)]}
    text = lambda lang, n: "".join(r.choice(shared) if r.random() < 0.6 else r.choice(own[lang][:1500]) for _ in range(n))
    model = language.fit({x: [text(x, 8000) for _ in range(4)] for x in own})
    texts = [(x, text(x, 300)) for x in own for _ in range(40)]
    got, _ = model.predict([t for _, t in texts])
    assert sum(a == b for a, (b, _) in zip(got, texts)) >= 79


def test_fits_count_every_text_once(spark, monkeypatch):
    """Repeats, rows without an id and ids of several texts: neither the sample nor what reaches the driver follows them."""
    monkeypatch.setattr(language, "FIT_ROWS", 20)
    sent = []
    fitted = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, labels, seed=7: sent.append((texts, labels)) or fitted(texts, labels, seed))
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text of its own number {i} with {'good' if i % 2 else 'bad'} words", "en" if i % 3 else "fr") for i in free]
    again = [(free[3], rows[3][1], "en")] * 3000 + [(None, "a text without an id", "en")] * 2000 + [(None, f"one more without {k}", "de") for k in range(30)]
    other = [(free[4], "another text of the same id", "en")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + again + other, schema).repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in free] + [(free[5], 0), (free[6], None), (None, 1)], "doc_id long, quality int")
    quality.fit_sample(docs, labels, 50)
    quality.fit_sample(docs.repartition(3), labels, 50)
    texts, marks = sent[0]
    assert sent[0] == sent[1] and len(texts) == len(set(texts)) == 50
    assert all(("good" in t) == bool(m) or t == other[0][1] for t, m in zip(texts, marks))
    quality.fit_sample(docs, labels)
    assert sorted(sent[2][0]) == sorted({t for _, t, _ in rows + other} - {None})
    kept = []
    whole = language.fit
    monkeypatch.setattr(language, "fit", lambda samples: kept.append(samples) or whole(samples))
    language.fit_sample(docs)
    language.fit_sample(docs.repartition(2))
    assert kept[0] == kept[1] and set(kept[0]) == {"de", "en", "fr"}
    assert all(len(x) == len(set(x)) == 20 for x in kept[0].values())


def test_quality_scores_are_pooled_layers():
    r = random.Random(4)
    texts = [" ".join(r.choices(["good", "fine", "words", "here"] if i % 2 else ["&&#", "x", "1234", "zz"], k=40)) for i in range(200)]
    model = quality.fit(texts, [i % 2 for i in range(200)])
    w1, b1, w2, b2 = model.weights
    for t in [*texts[:20], "", "unseen tokens", "good good fine"]:
        vs, last = [], None
        for w in t.split():
            vs.append(model.vectors[1 if w == last else model.ids.get(w, model.ids.get(quality.shape(w), 0))])
            last = w
        x = np.mean(vs, axis=0) if vs else np.zeros(quality.DIMENSIONS)
        z = sum(np.tanh(sum((x[d] - model.mean[d]) / model.scale[d] * w1[d, h] for d in range(len(x))) + b1[h]) * w2[h] for h in range(len(b1))) + b2
        got = model.scores(np.array([model.pool(s) for s in model.word_ids([t], {})]))[0]
        assert abs(got - 1 / (1 + np.exp(-z / model.temperature))) < 1e-6


def test_long_words_merge_as_in_the_libraries(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path, random.Random(2)
    mine, lib = pieces.PieceBpe(path(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))
    words, tok = packing.WordBpe(path(packing.MODEL)), Tokenizer.from_file(path(packing.MODEL))
    monkeypatch.setattr(bpe, "LONG", 16)
    for k in range(300):
        some = r.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "etaoinshr", "aAbB01=-_", "0123456789abcdef", "日本é🙂ab", "=-"])
        t = "".join(r.choices(some, k=r.randrange(10, 300))) if k % 3 else "".join(r.choices(["the", "ing", "tion", "aaaa", "====", "er", "Q"], k=60))
        assert mine.encode(t) == lib.encode(t)
        assert words.encode_words([t.encode()])[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    t = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert mine.encode(t) == lib.encode(t)


def test_long_texts_of_secrets_take_time_in_proportion(spark):
    import time

    t = " ".join(f"password=abc{i}def login: bob{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, t, "en", "s", 1)], DOCS)
    secrets.find(spark, docs.where("false")).collect()
    began = time.perf_counter()
    got = secrets.find(spark, docs).collect()[0].spans
    assert len(got) == 60_000 and time.perf_counter() - began < 30
    assert [t[x.start : x.end] for x in got[:2]] == ["password=abc0def", "login: bob0"]
    assert t[got[-1].start : got[-1].end] == "login: bob29999"
    assert secrets.redact(spark, docs).collect()[0].text == " ".join(["[secret]"] * 60_000)


def test_stages_keep_columns_of_any_name(spark):
    names = ["a.b", "_hit", "_spans", "_key", "_doc", "_text", "_dropped", "_gone", "spans", "base", "parts", "gone_id", "key", "c9", "`q"]
    line, token = "a line that is long enough to be found again in another document of this table", "q8Zk2mVb7Xw4Rt9Lp3Nc6Hd1Js5Fg0Ya"
    rows = [(1, f"{line}\nfirst words", *names), (2, f"login: bob {token} and some more words that stand here alone\n{line}", *names), (None, None, *names), (3, "", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    texts = lambda df: sorted(((x[0], x[1]) for x in df.collect()), key=repr)
    for out in (lines.without_repeated_lines(spark, docs), simhash.one_per_group(spark, docs), secrets.redact(spark, docs), quality.accepted(docs, quality.fit_sample(docs, labels), 0.0)):
        assert out.columns == docs.columns and {tuple(x[2:]) for x in out.collect()} == {tuple(names)}
    assert texts(lines.without_repeated_lines(spark, docs)) == [(1, rows[0][1]), (2, rows[1][1].split("\n")[0]), (3, ""), (None, None)]
    assert texts(secrets.redact(spark, docs))[1] == (2, "[secret] [secret] and some more words that stand here alone\n" + line)
    assert texts(simhash.one_per_group(spark, docs)) == texts(docs)
    for df in (quality.score(docs, quality.fit_sample(docs, labels)), language.predict(docs, language.fit_sample(docs.withColumn("lang", F.lit("en")))), hostrules.verdicts(spark, docs.withColumn("source", F.lit("s"))), licences.scan(docs), packing.pack_documents(spark, docs)):
        assert df.count() == 4


def test_edge_rows_have_their_defined_results(spark, edge, empty):
    assert sorted((x.doc_id or -1, x.fp == 0) for x in simhash.classes(spark, edge).collect()) == [(-1, False), (1, True), (2, True), (3, False), (3, False)]
    assert sorted((x.doc_id or -1, x.lang_pred) for x in language.predict(edge, language.fit({"en": ["abc"]})).collect()) == [(-1, "en"), (1, "und"), (2, "und"), (3, "en"), (3, "en")]
    assert sorted((x.doc_id or -1, x.n_words, x.kept) for x in hostrules.verdicts(spark, edge).collect()) == [(-1, 3, False), (1, 0, False), (2, 0, False), (3, 60_000, False), (3, 60_000, False)]
    assert sorted((x.doc_id or -1, x.n_tokens) for x in pieces.encode_documents(edge, public_tokenizers.path(pieces.MODEL)).select("doc_id", "n_tokens").collect())[1:3] == [(1, 0), (2, 0)]
    assert {x.doc_id: x.text for x in lines.without_repeated_lines(spark, edge).collect()} == {x.doc_id: x.text for x in edge.collect()}
    for df in (simhash.classes(spark, empty), hostrules.verdicts(spark, empty), secrets.find(spark, empty), packing.pack_documents(spark, empty)):
        assert df.collect() == []


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_pipeline_over_edge_tables(spark, tmp_path, edge, empty, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = (edge if rows == "edge" else empty).drop("fp", "node")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert (out.count() > 0) == (rows == "edge") or out.count() == 0


BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GENUINE = {
    "BSD-3-Clause": BSD3,
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2 of the License.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def test_more_genuine_licences(spark):
    assert [x[1] for x in _licensed(spark, list(GENUINE.values()))] == list(GENUINE)
    assert [x[1] for x in _licensed(spark, [" ".join(t.split()) for t in GENUINE.values()])] == list(GENUINE)


def test_licence_rules_use_their_sentences_up(spark):
    far = "word " * 2000
    got = _licensed(spark, [BSD3, BSD3 + "\n\n" + BSD, BSD3 + "\n\n" + GENUINE["Unlicense"], MIT.replace("\n\nThe above", far + "\n\nThe above"), BSD.replace("2. Redis", far + "\n2. Redis")])
    assert [x[1] for x in got] == ["BSD-3-Clause", "BSD-3-Clause,BSD-2-Clause", "BSD-3-Clause,Unlicense", "", ""]


def test_licences_are_those_of_brute_force(spark):
    r = random.Random(12)
    ids = sorted({x for _, rule in licences.RULES for x in rule})
    texts, want = [], []
    for _ in range(200):
        some = []
        while len(some) < 12:
            some += r.choice(licences.RULES)[1] if r.random() < 0.5 else [r.choice(ids)]
        if r.random() < 0.5:
            r.shuffle(some)
        texts.append("\n\n".join(licences.SENTENCES[x].capitalize() + "." for x in some))
        left, found = list(some), set()
        for number, (_, rule) in sorted(enumerate(licences.RULES), key=lambda x: -len(x[1][1])):
            start = 0
            while True:
                places = []
                for x in rule:
                    at = next((k for k in range(places[-1] + 1 if places else start, len(left)) if left[k] == x), None)
                    if at is None:
                        break
                    places.append(at)
                if len(places) < len(rule):
                    break
                found.add(number)
                for k in places:
                    left[k] = None
                start = places[-1] + 1
        want.append((f"/{'/'.join(some)}/", ",".join(dict.fromkeys(licences.RULES[k][0] for k in sorted(found)))))
    assert _licensed(spark, texts) == want
