"""Operators over tables of requests, and keyed state over streams, against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memoryloom.operators import consolidate, evaluate, gate, graph, merkle, rank, temporal, vectors
from memoryloom.plans import requests as plans
from memoryloom.sources.scratch import Scratch
from memoryloom.streaming import processors


def test_as_of_carries_the_last_fact_over_ranges(spark):
    r = random.Random(1)
    facts = [(r.choice(["hot", "hot", "hot", "a", "b"]), r.randrange(300), r.randrange(3), f"v{k}") for k in range(600)] + [("hot", None, 0, "never"), (None, 5, 0, "nobody")]
    probes = [(r.choice(["hot", "hot", "a", "b", "unknown"]), r.randrange(-20, 330), k) for k in range(400)] + [("hot", None, 1000), (None, 9, 1001), ("hot", 50, 1002), ("hot", 50, 1002)]
    f = spark.createDataFrame(facts, "k string, t int, tie int, value string").dropDuplicates(["k", "t", "tie"])
    kept = [tuple(x) for x in f.collect()]
    p = spark.createDataFrame(probes, "k string, t int, probe int")
    for ranges in (1, 7):
        got = sorted((x.probe, x.k or "", x.t if x.t is not None else -99, x.fact.value if x.fact else "") for x in temporal.as_of(f, p, "k", "t", ["tie"], ranges).collect())
        last = lambda k, t: max(((a, b, v) for q, a, b, v in kept if None not in (t, k, a) and q == k and a <= t), default=(0, 0, ""))[2]
        assert got == sorted((n, k or "", t if t is not None else -99, last(k, t)) for k, t, n in probes)
    assert all(x.fact is None for x in temporal.as_of(f.limit(0), p, "k", "t", ["tie"]).collect())
    assert temporal.as_of(f, p.where("probe > 5000"), "k", "t", ["tie"]).count() == 0


def test_hot_keys_of_as_of_are_dealt(spark):
    rows = spark.range(20_000).selectExpr("'one' as k", "cast(id as int) as t", "0 as tie")
    out = temporal.as_of(rows, rows.selectExpr("k", "t + 1 as t", "t as probe"), "k", "t", ["tie"], 16)
    assert out.where("fact.tie is null or t - 1 <> probe").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_requests_see_what_they_may(spark):
    r = random.Random(2)
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    memories = [(f"m{k}", r.randrange(4), r.random() < 0.1, r.choice(["x", "y"]), s := day(r.randrange(200)), r.choice([None, s, s + timedelta(days=r.randrange(1, 90))]), "kind", "text") for k in range(120)] + [("old", 0, False, "x", date(1800, 1, 1), None, "kind", "t"), ("none", 0, False, "x", None, None, "kind", "t")]
    requests = [(k, r.choice(["x", "y", "z"]), r.randrange(4), day(r.randrange(-10, 320))) for k in range(40)] + [(99, None, 3, day(5)), (100, "x", None, day(5)), (101, "x", 3, None)]
    m = spark.createDataFrame(memories, "id string, label int, quarantined boolean, purpose string, valid_from date, invalid_at date, kind string, text string")
    q = spark.createDataFrame(requests, "request_id int, purpose string, ceiling int, as_of date")
    want = sorted((i, a, "visible" if label <= c else "redacted") for i, p, c, at in requests if p and c is not None and at for a, label, bad, own, s, e, *_ in memories if own == p and not bad and s and s <= at and (e is None or at < e))
    assert sorted(map(tuple, gate.for_requests(m, q).collect())) == want
    assert sorted(map(tuple, gate.for_requests(m, q, redacted=False).collect())) == [x for x in want if x[2] == "visible"]
    assert gate.for_requests(m.limit(0), q).count() == gate.for_requests(m, q.limit(0)).count() == 0


def rows_of_joins(df):
    """df's rows, and the rows that each join of its plan gave."""
    rows, made = df.collect(), []
    below = [df._jdf.queryExecution().executedPlan()]
    while below:
        p = below.pop()
        name = p.nodeName()
        if "Join" in name:
            made.append(p.metrics().get("numOutputRows").get().value())
        kids = p.children()
        below += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [kids.apply(k) for k in range(kids.size())]
    return rows, made


def test_totals_of_requests_are_those_of_the_pairs(spark):
    r = random.Random(12)
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    memories = [(f"m{k:03}", k, r.randrange(4), r.random() < 0.1, r.choice(["x", "y", None]), s := day(r.randrange(200)), r.choice([None, s, s + timedelta(days=r.randrange(1, 90))])) for k in range(200)] + [("m003", 7, 2, False, "x", day(3), None), ("old", 8, 0, False, "x", date(1800, 1, 1), None), ("none", 9, 0, False, "x", None, None)]
    requests = [(k % 50, r.choice(["x", "y", "z"]), r.randrange(-1, 5), day(r.randrange(-10, 320))) for k in range(60)] + [(99, None, 3, day(5)), (100, "x", None, day(5)), (101, "x", 3, None), (None, "x", 3, day(5))]
    m = spark.createDataFrame(memories, "id string, doc_id long, label int, quarantined boolean, purpose string, valid_from date, invalid_at date").repartition(3)
    q = spark.createDataFrame(requests, "request_id int, purpose string, ceiling int, as_of date").repartition(3)
    pairs = {}
    for i, p, c, at in requests:
        for name, n, label, bad, own, s, e in memories:
            if None not in (i, p, c, at, s) and own == p and not bad and s <= at and (e is None or at < e):
                pairs.setdefault(i, []).append((label <= c, name, n))
    want = sorted((i, sum(x[0] for x in v), sum(not x[0] for x in v), min(x[1] for x in v), max(x[1] for x in v), sum(x[2] for x in v)) for i, v in pairs.items())
    totals = {"first_id": ("id", F.min), "last_id": ("id", F.max), "ids": ("doc_id", F.sum)}
    assert sorted(map(tuple, gate.totals_for_requests(m, q, totals).collect())) == want
    assert gate.totals_for_requests(m.limit(0), q, totals).count() == gate.totals_for_requests(m, q.limit(0), totals).count() == 0


def test_request_gate_lists_no_pairs(spark, tmp_path):
    n = 600
    spark.range(n).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'web' as source", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, n, 2).selectExpr("id as doc_id", "cast(id % 3 as int) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(n).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows, made = rows_of_joins(plans.request_gate(spark, str(tmp_path)))
    assert sum(x.visible + x.redacted for x in rows) > 50_000 and len(rows) > 500  # pairs
    assert max(made) < 10_000


def test_time_bins_make_up_an_interval_once(spark):
    r = random.Random(3)
    rows = [(k, date(1990, 1, 1) + timedelta(days=r.randrange(20_000)), None) for k in range(20)] + [(k, s := date(1990, 1, 1) + timedelta(days=r.randrange(20_000)), s + timedelta(days=r.choice([-3, 0, 1, 2, 31, 365, 9999]))) for k in range(20, 120)]
    out = spark.createDataFrame(rows, "k int, s date, e date").select("k", "s", "e", gate.time_bins(F.col("s"), F.col("e")).alias("b")).collect()
    for x in out:
        days = sorted(d for b in x.b for d in ((b.bin << b.level), ((b.bin + 1) << b.level)))
        start = (x.s - date(1970, 1, 1)).days - gate.EARLIEST
        end = (x.e - date(1970, 1, 1)).days - gate.EARLIEST if x.e else 1 << gate.LEVELS
        assert len(x.b) <= 2 * gate.LEVELS and sum(1 << b.level for b in x.b) == max(0, end - start)
        assert not days or (days[0], days[-1]) == (start, end)


def test_reach_from_many_starts(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(190)] + [("hub", f"n{k}") for k in range(0, 150, 3)] + [("n1", "n1")]
    edges = spark.createDataFrame([(a, b, "x") for a, b in pairs], "src string, dst string, rel string")
    names = [f"n{k}" for k in range(0, 150, 2)] + ["hub", "alone", "n4", "n4", None]
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    want = set()
    for start in {x for x in names if x}:
        seen, front = {start: 0}, {start}
        for hop in (1, 2, 3):
            front = {b for a in front for b in beside.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, hop)
        want |= {(start, n, h) for n, h in seen.items()}
    starts = spark.createDataFrame([(x,) for x in names], "node string")
    got = [tuple(x) for x in graph.reach_from(edges, starts, 3).collect()]
    assert len(got) == len(want) and set(got) == want
    assert graph.reach_from(edges, starts.limit(0), 2).count() == 0
    assert {tuple(x) for x in graph.reach_from(edges.limit(0), starts, 2).collect()} == {(x, x, 0) for x in names if x}


def test_topk_for_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "TILE", 16)
    r = random.Random(5)
    rows = [(f"v{k:03}", [r.gauss(0, 1) for _ in range(6)]) for k in range(150)] + [("same1", [1.0] * 6), ("same0", [2.0] * 6), ("zero", [0.0] * 6), ("null", None), ("hole", [1.0, None, 1.0]), ("short", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    plain = {k: [x or 0.0 for x in v] for k, v in rows if v is not None}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 9) if norm(a) * norm(b) else 0.0
    stored = {x.id: [y or 0.0 for y in x.embedding] for x in df.collect() if x.embedding is not None}
    queries = [k for k in plain if k[-1] in "05e"]
    got = {}
    for x in vectors.top_for(df.where(F.col("id").isin(queries)).withColumnRenamed("id", "query_id"), df, 7).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id))
    for q in queries:
        best = sorted((-s, k) for k, v in stored.items() if (s := cos(stored[q], v)) > 0)[:7]
        assert sorted(got.get(q, [])) == [(i, k) for i, (_, k) in enumerate(best, 1)]


def test_topk_for_many_vectors_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 8)
    monkeypatch.setattr(vectors, "TILE", 32)
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    r = random.Random(13)
    few = [[float(r.randrange(-2, 3)) for _ in range(5)] for _ in range(40)]  # many rows are equal or have equal scores
    rows = [(f"v{k:04}", few[r.randrange(40)] if k % 3 else [r.gauss(0, 1) for _ in range(5)]) for k in range(700)] + [("tiny", [1e-10, 1.0, 0.0, 0.0, 0.0]), ("empty", []), ("nan", [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(5)
    queries = df.where("id < 'v0070' or id = 'v0100'").withColumnRenamed("id", "query_id").union(spark.createDataFrame([("first", [1.0]), ("void", [])], "query_id string, embedding array<double>"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = vectors.top_for(queries, df, 9)
        found = out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 9) if norm(a) * norm(b) > 0 else 0.0
    want = []
    for q, v in queries.collect():
        best = sorted((-s, k) for k, e in rows if k != "nan" and (s := cos(v, e)) > 0)[:9]
        want += [(q, i, k, -s) for i, (s, k) in enumerate(best, 1)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert not [x for x in found if x.id == "tiny" and x.query_id == "first"]
    few_rows = df.where("id in ('tiny', 'v0001', 'v0002')")
    assert {x.id for x in vectors.top_for(queries.where("query_id = 'first'"), few_rows, 9).collect()} <= {"v0001", "v0002"}  # 1e-10 is 0 to nine places
    assert vectors.top_for(queries.limit(0), df, 3).count() == vectors.top_for(queries, df.limit(0), 3).count() == 0


def test_positions_and_zip(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k % 5) for k in range(101)] + [(3, 1)], "a int, b int").repartition(6)
    with Scratch(spark) as scratch:
        got = [tuple(x) for x in evaluate.positioned(scratch, rows, "a", "b").orderBy("position").collect()]
        assert [x[2] for x in got] == list(range(102)) and [x[:2] for x in got] == sorted(map(tuple, rows.collect()))
        both = evaluate.zipped(scratch, rows, ["a", "b"], rows, ["b", "a"]).orderBy("position").collect()
        assert [tuple(x.a) for x in both] == sorted(map(tuple, rows.collect())) and [tuple(x.b) for x in both] == sorted(map(tuple, rows.collect()), key=lambda x: (x[1], x[0]))
        with pytest.raises(Exception, match="lengths differ"):
            evaluate.zipped(scratch, rows, ["a", "b"], rows.where("a > 3"), ["a", "b"]).collect()


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-(2**63), 2**63 - 1, 0, -1, 1], [2**40 + k for k in range(70_000, 0, -911)], [random.Random(6).randrange(-(10**12), 10**12) for _ in range(400)]])
def test_radix_selection_finds_every_rank(spark, values):
    rows = spark.createDataFrame([("g", v) for v in values] + [("h", v) for v in values[:2]] + [(None, 7), ("empty", None)], "g string, v long").repartition(4)
    ranks = {"first": lambda n: F.lit(1), "half": lambda n: F.ceil(n / 2), "last": lambda n: n, "beyond": lambda n: n + 1}
    got = {x.grp: (x.first, x.half, x.last, x.beyond) for x in evaluate.at_ranks(rows, F.col("g"), "v", ranks).select("grp", *[F.col(k) for k in ranks]).toDF("grp", "first", "half", "last", "beyond").collect()}
    want = lambda xs: (xs[0], xs[(len(xs) + 1) // 2 - 1], xs[-1], None)
    assert got == {"g": want(sorted(values)), "h": want(sorted(values[:2])), None: (7, 7, 7, None), "empty": (None,) * 4}


def test_merkle_trees_tell_what_changed(spark):
    rows = {f"id{k}": f"d{k}" for k in range(600)}
    new = {**rows, "id7": "other", "more": "x"}
    del new["id300"]
    df = lambda x: spark.createDataFrame([*x.items(), (None, "no id")], "id string, digest string")
    with Scratch(spark) as scratch:
        old, now = merkle.tree(scratch, df(rows), 2), merkle.tree(scratch, df(new), 2)
        leaves = merkle.different_leaves(scratch, old, now, 2)
        assert 1 <= leaves.count() <= 3
        got = sorted(map(tuple, merkle.different_rows(scratch, df(rows), df(new), 2).collect()))
        assert got == [("id300", "d300", None), ("id7", "d7", "other"), ("more", None, "x")]
        changed = spark.createDataFrame([("id7",), ("id300",), ("more",)], "id string")
        grown = merkle.updated(scratch, old, df(new), changed, 2)
        assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, now.collect()))
        assert now.where("depth = 0").first().n == 600
        assert merkle.different_leaves(scratch, old, old, 2).count() == 0 and merkle.tree(scratch, df({}), 1).count() == 0
    assert [merkle.depth_for(n) for n in (0, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2]


def test_positions_of_hits(spark):
    rows = [(f"id{k:02}", k * 7 % 4) for k in range(30)]
    got = {x.id: x.position for x in rank.positions(spark.createDataFrame(rows, "id string, overlap int"), "overlap").collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}


def test_duplicates_exchange_repeated_texts_alone(spark):
    text = "word " * 200
    rows = [(f"m{k}", date(2024, 1, 1 + k % 3), f"{text}{k if k > 9 else 'same'}") for k in range(400)] + [("n1", date(2024, 1, 1), None), ("n2", date(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, "id string, valid_from date, text string").repartition(4)
    assert sorted(x.id for x in consolidate.duplicate_rows(df).collect()) == sorted([f"m{k}" for k in range(10)] + ["n1", "n2"])
    plan = consolidate.duplicate_plan(df).collect()
    assert {x.superseded: x.n for x in plan}[",".join(sorted((f"m{k}" for k in range(10)), key=lambda i: (int(i[1:]) % 3, i)))] == 10


# Streams


def _micros(t):
    return int(t.timestamp() * 1_000_000)


def test_decisions_in_event_time_order_and_forgotten_keys(spark, tmp_path):
    """Files that arrive out of order, a file a batch: the same decisions as in order, and no state of idle keys."""
    start = datetime(2024, 1, 1)
    r = random.Random(7)
    rows = [(k, f"user{r.randrange(6)}", start + timedelta(minutes=r.randrange(0, 600))) for k in range(300)]
    rows.sort(key=lambda x: x[2])
    rows += [(1000, "late again", start + timedelta(days=30))]
    for i in range(0, len(rows), 60):
        part = rows[i : i + 60]
        r.shuffle(part)
        spark.createDataFrame([(*x, _micros(x[2])) for x in part], "n long, user string, ts timestamp, at long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    step = lambda st, row: (st.update(n=st.get("n", 0) + 1, at=row["at"]), st["n"])[1]
    stream = spark.readStream.schema("n long, user string, ts timestamp, at long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "5 hours")
    out = processors.in_order(stream, ["user"], "n", step, lambda st: st["at"] + 3_600_000_000, "turn long")
    processors.run(spark, out, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {x.n: x.turn for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    turns, want = {}, {}
    for n, user, ts in sorted(rows[:-1], key=lambda x: (x[2], x[0])):
        turns[user] = turns.get(user, 0) + 1
        want[n] = turns[user]
    # Users that were idle for over an hour start anew, as their state went; none is, in ten hours of 300 requests of six.
    assert got == want
    held = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "held").load()
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "waiting").load()
    assert {x.key[0] for x in held.collect()} <= {"late again"} and {x.key[0] for x in waiting.collect()} == {"late again"}


def test_replay_and_window_totals(spark):
    start = datetime(2024, 1, 1)
    rows = [("a" if k % 3 else "b", start + timedelta(minutes=k * 13), k % 5 > 0, k) for k in range(200)]
    df = spark.createDataFrame([(o, ts, _micros(ts), ok, n) for o, ts, ok, n in rows], "operation string, ts timestamp, at long, allowed boolean, latency_micros long")
    hour = 3_600_000_000
    got = sorted(map(tuple, processors.replayed(spark, df, lambda x: processors.window_totals(x, hour), files=3).collect()))
    want = {}
    for o, ts, ok, n in rows:
        w = want.setdefault((o, _micros(ts) // hour * hour), [0, 0, 0, 0])
        w[0], w[1], w[2], w[3] = w[0] + 1, w[1] + (not ok), w[2] + n, max(w[3], n)
    assert got == sorted((*k, *w) for k, w in want.items())


def test_first_uses_pass_once(spark, tmp_path):
    rows = [(k % 7, f"x{k}") for k in range(60)]
    spark.createDataFrame(rows, "key long, value string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    processors.run(spark, processors.first_uses(stream, ["key"], 3_600_000), str(tmp_path / "out"), str(tmp_path / "check"), timers=False)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(x.key for x in got) == list(range(7))
