"""Bounds, empty inputs and edge cases of single operators."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memoryloom.functions import text
from memoryloom.operators import consolidate, context, evaluate, gate, governed, graph, ledger, lifecycle, outbox, rank, scheduler, semantic, stateful, temporal, vectors
from memoryloom.sources import files

MEM = "id string, text string, valid_from int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalization(spark):
    assert one(spark, text.normalized(F.lit("\t A\n b  C "))) == "a b c"
    assert one(spark, text.normalized_strict(F.lit("ΟΔΟΣ 　X"))) == "οδοσ x"


def test_statement_parts(spark):
    a, b = text.statement_parts(F.lit("alice lives in rome"))
    assert (one(spark, a), one(spark, b)) == ("alice lives in", "rome")
    assert one(spark, text.statement_parts(F.lit("one"))[0]) == ""


@pytest.mark.parametrize("name,ok", [("memory-v2", True), ("memory-v9", True), ("memory-v1", False), ("memory-v10", False), ("memory-v02", False), ("x", False)])
def test_schema_window(spark, name, ok):
    assert one(spark, text.schema_accepted(F.lit(name), "memory", 2, 9)) is ok


@pytest.mark.parametrize("n,ok", [(256, True), (257, False)])
def test_identity_bound(spark, n, ok):
    assert one(spark, text.identity(F.lit("a" * n))) is ok


def test_ratios(spark):
    assert [one(spark, f(F.lit(a), F.lit(b))) for f, a, b in ((text.ratio_floor, 1, 3), (text.ratio_ceil, 1, 3), (text.ratio_floor, 1, 0), (text.ratio_floor, 5, 3))] == [3333, 3334, 0, 10_000]


def test_duplicates_keep_the_first_and_list_all(spark):
    rows = spark.createDataFrame([("m1", "Alice likes espresso", 2), ("m2", "alice  likes espresso", 1), ("m3", "Bob", 1), ("m4", None, 1)], MEM)
    r = consolidate.duplicate_plan(rows).collect()
    assert [(x.canonical_id, x.superseded, x.n) for x in r] == [("m2", "m2,m1", 2)]


def test_three_tails_make_three_pairs_and_two_invalidations(spark):
    rows = spark.createDataFrame([("a", "x is 1", 1), ("b", "x is 2", 2), ("c", "x is 3", 2), ("d", "single", 1)], MEM)
    assert {(r.newer, r.older) for r in consolidate.contradictions(rows).collect()} == {("b", "a"), ("c", "a"), ("c", "b")}
    assert {r.older for r in consolidate.invalidated(rows).collect()} == {"a", "b"}


def test_validity_is_half_open(spark):
    rows = spark.createDataFrame([(1, 5), (5, None), (6, None)], "valid_from int, invalid_at int")
    assert [r.valid_from for r in rows.where(temporal.valid_at(F.lit(5))).collect()] == [5]


def test_empty_state_set_is_an_error(spark):
    with pytest.raises(ValueError):
        temporal.states_in(spark.range(1), [])


def test_zero_vectors_score_nothing_but_can_be_boosted(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0], True), ("b", [1.0, 0.0], False), ("c", [0.0, 1.0], False)], "id string, v array<float>, shared boolean")
    score = rank.cosine(F.col("v"), [1.0, 0.0, 9.0])
    assert [r.id for r in rank.top(rows, score, 5).collect()] == ["b"]
    assert [r.id for r in rank.top(rows, score, 5, F.col("shared")).collect()] == ["b", "a"]


def test_redacted_rows_lose_their_text(spark):
    rows = spark.createDataFrame([("a", "k", 1, False, 0, None, "t", "p"), ("b", "k", 2, False, 0, None, "t", "p"), ("c", "k", 0, True, 0, None, "t", "p")], "id string, kind string, label int, quarantined boolean, valid_from int, invalid_at int, text string, purpose string")
    assert {(r.id, r.visibility, r.text) for r in gate.split(rows, F.lit(1), 1).collect()} == {("a", "visible", "t"), ("b", "redacted", None)}


def test_reach_gives_least_hops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    assert {(r.node, r.hop) for r in graph.reach(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_greedy_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 9, 60, False), (2, 8, 60, False), (3, 7, 40, False)], "id long, score_bp long, tokens long, pinned boolean")
    assert sorted(r.id for r in context.greedy(rows, 100).collect()) == [1, 3]
    with pytest.raises(Exception, match="pinned"):
        context.greedy(rows.withColumn("pinned", F.lit(True)), 100).collect()
    with pytest.raises(ValueError):
        context.greedy(rows, 0)


def test_quota_windows_open_at_requests():
    state = {}
    assert [stateful.quota_step(state, t, 1, 2, 10) for t in (3, 4, 5, 13, 14)] == [True, True, False, True, True]
    with pytest.raises(ValueError):
        stateful.quota_step(state, 1, 1, 2, 10)


def test_a_job_is_cancelled_after_its_attempts():
    state = {}
    assert all(stateful.job_step(state, e, 2) for e in ("signup", "view", "error", "view", "error"))
    assert state["status"] == "cancelled" and not stateful.job_step(state, "view", 2)


def test_ledger_verbs_and_idempotency(spark, tmp_path):
    log, at = ledger.Ledger(spark, str(tmp_path / "store")), datetime(2025, 1, 1)
    a = log.remember("k1", ledger.Request("user/a", "Alice likes tea"), at)
    assert log.remember("k1", ledger.Request("user/a", "Alice likes tea"), at) == a and log.log().count() == 1
    b = log.improve("k2", ledger.Request("user/a", "Alice likes coffee", ids=(a,)), datetime(2025, 1, 2))
    assert [r.id for r in log.recall(ledger.Request("user/a", "alice")).collect()] == [b]
    with pytest.raises(ValueError):
        log.improve("k3", ledger.Request("user/a", "x", ids=("missing",)), at)
    log.forget("k4", ledger.Request("user/a", ids=(b,)), datetime(2025, 1, 3))
    assert log.recall(ledger.Request("user/a", "alice")).count() == 0
    with pytest.raises(ValueError):
        ledger.Request("bad space!")


def test_sources(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("observation_id,country,commodity,market,price_usd_per_kg,observed_on,source,note\n1,HN,coffee,m,4.2,2024-01-01,s,n\n2,HN,coffee,m,,2024-01-02,s,n\n")
    assert [r.price_usd_per_kg for r in files.prices(spark, str(p)).orderBy("observation_id").collect()] == [4.2, None]
    c = tmp_path / "c.jsonl"
    c.write_text("\n".join(json.dumps({"case_id": f"c{i}", "query": "q", "as_of": "2024-01-01", "expected_ids": []}) for i in (1, 2)))
    assert files.cases(spark, str(c)).count() == 2
    c.write_text("\n".join(json.dumps({"case_id": "c", "query": "q", "as_of": "2024-01-01", "expected_ids": []}) for _ in (1, 2)))
    with pytest.raises(ValueError):
        files.cases(spark, str(c))
    d = tmp_path / "d.json"
    d.write_text(json.dumps([{"qa": [{"question": "q1", "evidence": ["e"]}, {"question": "q2", "evidence": []}]}]))
    assert [(r.case_id, r.abstain) for r in files.conversations_qa(spark, str(d)).orderBy("case_id").collect()] == [("locomo:0:0", False), ("locomo:0:1", True)]
    with pytest.raises(ValueError):
        files.verified([{"a": 1}], files.manifest([{"a": 2}]))


def test_streams(spark, tmp_path):
    from memoryloom.streaming import stateful as live

    spark.createDataFrame([(i, i % 2, 10 * i) for i in range(8)], "event_id long, user_id long, at long").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("event_id long, user_id long, at long").parquet(str(tmp_path / "in"))
    q = live.quota(rows, 2, 1000).writeStream.format("memory").queryName("quota_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count_if(within) as n, count(*) as c from quota_out").first()[:] == (4, 8)


def test_greedy_prunes_exactly(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 997 as score_bp", "1 + (id * 31) % 17 as tokens", "id in (3, 5) as pinned")
    left, want = 300, []
    for r in sorted(rows.collect(), key=lambda r: (not r.pinned, -r.score_bp, r.id)):
        if r.tokens <= left:
            left -= r.tokens
            want.append(r.id)
    assert sorted(r.id for r in context.greedy(rows, 300).collect()) == sorted(want)
    with pytest.raises(Exception, match="no tokens"):
        context.greedy(rows.withColumn("tokens", F.lit(0)), 300).collect()


def test_lifecycles():
    state = {}
    steps = [("active", 1), ("evaluated", 2), ("approved", 1), ("approved", 3), ("active", 3), ("rolled_back", 4), ("active", 5)]
    assert [lifecycle.move_step(state, "procedure", to, at) for to, at in steps] == [False, True, False, True, True, True, False]
    assert not lifecycle.move_step({}, "procedure", "evaluated", 1, ready=False)
    assert all(not to or set(to) <= set(states) for states in lifecycle.LIFECYCLES.values() for to in states.values())


def test_evaluations_pass_at_the_bound(spark):
    rows = spark.createDataFrame([("a", 7000), ("b", 6999), ("c", 7000), ("c", 6999)], "procedure string, outcome_bp int")
    assert {r.procedure: (r.score_bp, r.passed) for r in lifecycle.evaluations(rows).collect()} == {"a": (7000, True), "b": (6999, False), "c": (6999, False)}
    with pytest.raises(Exception, match="range"):
        lifecycle.evaluations(rows.withColumn("outcome_bp", F.lit(10_001))).collect()


def test_feedback_digest_ignores_order(spark):
    rows = [("p", "t2", 1, 5), ("p", "t1", 2, 5), ("p", "t1", 1, 7)]
    a, b = (lifecycle.feedback_digest(spark.createDataFrame(r, "procedure string, trajectory string, recorded_at int, outcome_bp int")).first().digest for r in (rows, rows[::-1]))
    assert a == b


def test_delivery_is_at_least_once():
    state = {}
    steps = [("ack", 1, 0), ("claim", 0, 1), ("claim", 0, 5), ("ack", 1, 0), ("ack", 1, 11), ("claim", 0, 11), ("ack", 1, 12), ("ack", 2, 12), ("ack", 2, 13), ("ack", 1, 13), ("claim", 0, 14)]
    assert [outbox.delivery_step(state, op, token, at, 10) for op, token, at in steps] == ["stale", "claimed", "leased", "backdated", "stale", "claimed", "stale", "acked", "repeated", "stale", "done"]
    with pytest.raises(ValueError):
        outbox.claim(None, "c", None, 0)


def test_projections():
    mapping = {"id": "a", "text": "b", "valid_from": "c"}
    with pytest.raises(PermissionError):
        governed.projected(None, mapping, ["a", "b"])
    for bad in ([], ["a", "a"], [" a"], ["x"] * 2, ["é" * governed.MOST_FIELD_BYTES]):
        with pytest.raises(ValueError):
            governed.canonical_projection(bad)
    assert governed.still_granted(["a"], ["a", "b"], ["a", "b", "c"]) and not governed.still_granted(["a"], ["b"], ["a", "b"])


def test_freshness_window_is_closed(spark):
    at = lambda x: one(spark, governed.freshness(F.lit(x), F.lit(100), F.lit(10), F.lit(5)))
    assert [at(x) for x in (89, 90, 105, 106)] == ["stale", "fresh", "fresh", "future"]


def test_models():
    d = {"namespace": "n", "name": "m", "version": 1, "metrics": [{"name": "x", "expression": "sum(a)"}], "dimensions": [{"name": "k", "role": "identifier"}], "relationships": []}
    m = semantic.Model.parsed(json.dumps(d))
    assert m.fields() == [("x", "decimal"), ("k", "identifier")]
    other = semantic.Model.parsed(json.dumps(d | {"metrics": [{"name": "x", "expression": "sum(b)"}]}))
    assert m.digest("s") != other.digest("s") and m.digest("s") == semantic.Model.parsed(json.dumps(d)).digest("s")
    for bad in (d | {"more": 1}, d | {"dimensions": [{"name": "x", "role": "r"}]}, d | {"metrics": []}, d | {"version": 0}, d | {"name": " m"}):
        with pytest.raises(ValueError):
            semantic.Model.parsed(json.dumps(bad))


def test_valid_cases(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3], 10), (2, [1], [1], 10), (3, [1, 1], [], 10), (4, [1], [2], 0)], "case_id int, expected_ids array<int>, forbidden_ids array<int>, token_budget int")
    assert {r.case_id: r.fault for r in evaluate.valid_cases(rows, 2, 10).collect()} == {1: None, 2: "overlap", 3: "repeated", 4: "bounds"}


def test_uuid5_and_words(spark):
    import uuid

    from memoryloom.functions import digest

    for name in ("a", "", "é", "x" * 1000):
        assert one(spark, digest.uuid5("d", F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_OID, f"d\0{name}"))
    assert bytes(one(spark, digest.word(F.lit(258), 4))) == b"\0\0\1\2"
    with pytest.raises(Exception, match="fit"):
        one(spark, digest.word(F.lit(2**32), 4))


def test_index_and_embedder(spark, tmp_path):
    rows = spark.createDataFrame([("a", "red apple", 0), ("b", "red brick", 1), ("c", "", 1), ("d", "red apple", 3)], "id string, text string, label int")

    class Remote(vectors.HashedWords):
        is_local = False

    assert vectors.embedded(rows, Remote(is_local=False)).count() == 3
    e = vectors.embedded(rows, vectors.HashedWords()).select("id", "embedding", "label", F.array(F.lit("x")).alias("entities"))
    assert e.count() == 4
    index = vectors.Index(e)
    q = [float(x) for x in e.where("id = 'a'").first().embedding]
    assert [r.id for r in index.search(q, 2).collect()] == ["a", "d"] and index.search(q, 0).count() == 0
    assert [r.id for r in index.search(q, 9, where=F.col("label") <= 1).collect()] == ["a", "b"]
    assert "a" not in {r.id for r in index.remove(e.where("id = 'a'")).members.collect()}
    assert index.index(e.where("id = 'a'")).members.count() == 4
    vectors.persist(e, str(tmp_path), "t", "s")
    assert vectors.load(spark, str(tmp_path), "t", "s").count() == 4
    with pytest.raises(ValueError):
        vectors.load(spark, str(tmp_path), "t", "other")
    ops = spark.createDataFrame([("a", "remove", 1), ("a", "add", 2), ("z", "add", 3), ("b", "remove", 4)], "id string, op string, ordinal int")
    assert {r.id for r in vectors.delta(e, ops, 4).collect()} == {"a", "c", "d", "z"}
    with pytest.raises(Exception, match="full"):
        vectors.delta(e, ops, 3).collect()


def test_links_are_idempotent(spark):
    none = spark.createDataFrame([], "src string, dst string, rel string, record_id string")
    once = graph.linked(none, "a", "r", "b", "m1")
    assert graph.linked(once, "a", "r", "b", "m1").count() == 1 and graph.linked(once, "a", "r", "b", "m2").count() == 2


def test_commits_count_by_their_marker_and_expect_their_sources(spark, tmp_path):
    log, at = ledger.Ledger(spark, str(tmp_path / "store")), datetime(2025, 1, 1)
    first = log.remember("k1", ledger.Request("space", "one text"), at)
    second = log.remember("k2", ledger.Request("space", "two texts"), at)
    (tmp_path / "store" / "log" / "commit-k2" / "_SUCCESS").unlink()
    assert [x.id for x in ledger.current(log.log()).collect()] == [first]
    assert log.remember("k2", ledger.Request("space", "two texts"), at) == second and log.log().count() == 2
    source = lambda text: spark.createDataFrame([(first, text)], "id string, text string")
    events = log._event("put", [("mem-new", "space", "semantic", 1, "new text", at)])
    with pytest.raises(ValueError, match="stale"):
        log.commit_expecting("k3", events, source("another text"))
    assert log.log().count() == 2
    assert log.commit_expecting("k3", events, source("one text")) and not log.commit_expecting("k3", events, source("one text"))
    with pytest.raises(ValueError, match="another commit"):
        log.commit_expecting("k3", log._event("put", [("mem-new", "space", "semantic", 1, "other", at)]), source("one text"))
    with pytest.raises(ValueError, match="known already"):
        log.commit_expecting("k4", events, source("one text"))
    assert ledger.Ledger(spark, str(tmp_path / "store")).log().count() == 3


def test_arrow_streams_are_checked_before_they_are_read(spark):
    import pyarrow as pa

    from memoryloom.sources import files

    schema = pa.schema([("newer", pa.string()), ("older", pa.string())])

    def stream(rows, kind=schema):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kind) as w:
            for r in rows:
                w.write_batch(pa.record_batch(r, schema=kind))
        return sink.getvalue().to_pybytes()

    good = [stream([[["a", "b"], ["c", "d"]], [["e"], ["f"]]]), stream([])]
    assert files.preflight(good, schema) == 3 and files.preflight([], schema) == 0
    assert sorted(map(tuple, files.staged_ipc(spark, good, schema).collect())) == [("a", "c"), ("b", "d"), ("e", "f")]
    other = pa.schema([("newer", pa.int64()), ("older", pa.string())])
    coded = pa.schema([("newer", pa.dictionary(pa.int32(), pa.string())), ("older", pa.string())])
    for bad in ([b"no stream"], [good[0] + b"more"], [stream([[[1], ["a"]]], other)], [stream([[pa.array(["a"]).dictionary_encode(), ["b"]]], coded)], [b""]):
        with pytest.raises(ValueError):
            files.preflight(bad, schema)
    for limit in ({"most_rows": 2}, {"most_chunks": 1}, {"most_bytes": 100}):
        with pytest.raises(ValueError):
            files.preflight(good, schema, **limit)


def test_reach_is_breadth_first(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("e", "f"), ("d", "g")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = lambda n: {x.node: x.hop for x in graph.reach(df, "a", n).collect()}
    assert got(0) == {"a": 0} and got(2) == {"a": 0, "b": 1, "c": 1, "d": 2} and got(4) == got(2) | {"g": 3}
    plan = graph.reach(df, "a", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4


def test_streamed_quota_is_in_order_across_chunks(spark, tmp_path):
    from memoryloom.operators.stateful import quota_step
    from memoryloom.streaming import stateful as streams

    ats = [40, 5, 10, 60, 1, 33, 5, 10]
    spark.createDataFrame([(i, 1, a) for i, a in enumerate(ats)], "event_id long, user_id long, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        stream = spark.readStream.schema("event_id long, user_id long, at long").parquet(str(tmp_path / "in"))
        q = streams.quota(stream, 2, 1000).writeStream.format("memory").queryName("quota_order").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    held, want = {}, {}
    for a, i in sorted((a, i) for i, a in enumerate(ats)):
        want[i] = quota_step(held, a, 1, 2, 1000)
    assert {x.event_id: x.within for x in spark.table("quota_order").collect()} == want


def test_percentile_by_index_is_that_of_the_sorted_samples(spark):
    import random

    r = random.Random(7)
    for n in (1, 2, 10, 999):
        xs = [r.randrange(50) if r.random() < 0.5 else r.randrange(10_000) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "v long").repartition(4)
        for p in (0, 50, 95, 100):
            assert evaluate.index_percentile(df, "v", p).first()[0] == sorted(xs)[round(p / 100 * (n - 1))]
    assert evaluate.index_percentile(spark.createDataFrame([], "v long"), "v", 50).first()[0] is None


def _asked(op, at, **more):
    return {"op": op, "at": at, "owner": "o", "digest": "d", "most": 2, "token": "t", "ttl": 10, "progress_at": at} | more


def test_scheduler_leases_renewal_and_budget():
    job = {}
    run = lambda *a, **k: scheduler.step(job, _asked(*a, **k))
    assert run("acquire", 0) == "missing" and job == {}
    assert [run("submit", 1), run("submit", 0), run("submit", 2, owner="x"), run("submit", 2, digest="x")] == ["submitted", "known", "collision", "collision"]
    assert [run("acquire", 0), run("acquire", 2, ttl=0), run("acquire", 2, ttl=scheduler.MOST_TTL + 1), run("fail", 2)] == ["backdated", "bad_ttl", "bad_ttl", "idle"]
    assert [run("acquire", 2), run("acquire", 11), run("renew", 5, ttl=7), run("renew", 5, ttl=8)] == ["leased", "held", "not_extended", "renewed"]
    assert [run("progress", 6, token="x"), run("progress", 6, progress_at=0), run("progress", 6), run("progress", 13)] == ["stale", "regressed", "progressed", "stale"]
    # The lease ran out: another attempt, which fails for good since the budget is two.
    assert [run("acquire", 13, token="u"), run("propose", 14), run("fail", 14, token="u"), run("submit", 20), run("claim", 20)] == ["leased", "stale", "given_up", "known", "terminal"]
    assert (job["status"], job["attempts"], job["until"]) == ("cancelled", 2, None)


def test_scheduler_proposals_are_staged_once():
    job = {}
    run = lambda *a, **k: scheduler.step(job, _asked(*a, **k))
    assert [run("claim", 1), run("propose", 2, digest="p"), run("propose", 3, digest="p"), run("propose", 3, digest="q")] == ["leased", "staged", "ready", "collision"]
    assert [run("acquire", 50), run("claim", 50), run("complete", 50, digest="q"), run("complete", 50, digest="p")] == ["needs_recovery", "ready", "collision", "completed"]
    assert [run("claim", 60), run("cancel", 60), run("cancel", 60, owner="x"), run("cancel", 40)] == ["done", "terminal", "stale", "backdated"]
    # A failed attempt keeps the digest, and the next one has to come to the same.
    job.clear()
    assert [run("claim", 1), run("propose", 2, digest="p"), run("fail", 3), run("claim", 4), run("propose", 5, digest="q"), run("propose", 5, digest="p")] == ["leased", "staged", "failed", "leased", "collision", "staged"]


def test_scheduler_streams_as_it_folds(spark, data, tmp_path):
    from memoryloom.plans import extensions
    from memoryloom.streaming import stateful as streams

    rows = spark.read.parquet(f"{data}/events.parquet").selectExpr(*extensions._ASKED)
    source = str(tmp_path / "in")
    rows.repartitionByRange(3, "seq").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    q = streams.leases(stream).writeStream.outputMode("append").format("memory").queryName("leases").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = stateful.fold(rows, "job", "seq", scheduler.step, "outcome string").select("seq", "outcome")
    assert sorted(map(tuple, spark.table("leases").select("seq", "outcome").collect())) == sorted(map(tuple, want.collect()))


def test_joined_bytes(spark):
    from memoryloom.functions import digest

    rows = spark.createDataFrame([(["ab", "", "c\0"],), ([],), (["a", None],)], "x array<string>")
    out = [r.y for r in rows.select(digest.joined(F.transform("x", lambda v: v.cast("binary"))).alias("y")).collect()]
    assert [out[0] and bytes(out[0]), out[1] is not None and bytes(out[1]), out[2]] == [b"abc\0", b"", None]


def test_recall_minds_purpose_validity_and_ceiling(spark, tmp_path):
    log, day = ledger.Ledger(spark, str(tmp_path / "store")), lambda d: datetime(2025, 1, d)
    ask = lambda purpose="", at=day(5), ceiling=1: {r.id: (r.visibility, r.text) for r in log.recall(ledger.Request("s", "tea", purpose), ceiling, at).collect()}
    assert ask() == {}
    a = log.remember("a", ledger.Request("s", "tea for all"), day(1))
    b = log.remember("b", ledger.Request("s", "tea of research", "research"), day(1))
    c = log.remember("c", ledger.Request("s", "tea until the third"), day(1), valid_to=day(3))
    x = log.remember("x", ledger.Request("s", "secret tea"), day(4), label=3)
    log.remember("y", ledger.Request("other", "tea elsewhere"), day(1))
    assert ask() == {a: ("visible", "tea for all"), x: ("redacted", None)}
    assert set(ask("research")) == {a, b, x} and set(ask("audit")) == {a, x}
    assert set(ask(at=day(2))) == {a, c} and set(ask(at=day(3))) == {a} and ask(ceiling=3)[x] == ("visible", "secret tea")


def test_forgotten_texts_leave_the_files(spark, tmp_path):
    store, at = tmp_path / "store", datetime(2025, 1, 1)
    log = ledger.Ledger(spark, str(store))
    both = log._event("put", [("m1", "s", "semantic", 1, "first tea", at), ("m2", "s", "semantic", 1, "second tea", at)])
    assert log.commit("k1", both) and log.erase() == 0
    texts = lambda: {r.text for f in store.glob("log/*") if list(f.glob("*.parquet")) for r in spark.read.schema(ledger.SCHEMA).parquet(str(f)).collect()}
    assert log.forget("k2", ledger.Request("s", ids=("m1",)), datetime(2025, 1, 2)) and texts() == {"second tea", None}
    assert [r.id for r in log.recall(ledger.Request("s", "tea")).collect()] == ["m2"] and log.log().count() == 3
    assert not log.commit("k1", both) and log.recover("k1", both)
    # A crash before the former version went: it is neither read nor kept.
    both_again = log._rows("k1", both)
    both_again.write.mode("append").parquet(str(store / "log" / "commit-k1"))
    assert log.log().count() == 3 and not log.forget("k2", ledger.Request("s", ids=("m1",)), datetime(2025, 1, 2)) and "first tea" not in texts()
    log.forget("k3", ledger.Request("s", ids=("m2",)), datetime(2025, 1, 3))
    assert texts() == {None} and log.log().count() == 4 and log.recover("k1", both)
    with pytest.raises(ValueError, match="another commit"):
        log.recover("k1", log._event("put", [("m3", "s", "semantic", 1, "x", at)]))


def test_external_adapter_reports_every_case_once(tmp_path):
    import sys

    from memoryloom.operators import adapter

    cases = [{"case_id": "a"}, {"case_id": "b"}]

    def command(body):
        (tmp_path / "x.py").write_text("import json, sys\nr = json.load(sys.stdin)\nids = [c['case_id'] for c in r['cases']]\n" + body)
        return f"{sys.executable} {tmp_path / 'x.py'}"

    row = "{'case_id': i, 'correct': i == 'a', 'allowed': True}"
    good = adapter.execute("x", command(f"print(json.dumps({{'adapter_version': 'v2', 'cases': [{row} for i in reversed(ids)]}}))"), cases)
    assert (good.status, good.version, [(o["case_id"], o["correct"], o["supported"], o["returned_ids"]) for o in good.outcomes]) == ("executed", "v2", [("a", True, True, []), ("b", False, True, [])])
    for bad in (f"print(json.dumps({{'cases': [{row} for i in ids + ids]}}))", "print(json.dumps({'cases': []}))", "sys.exit(3)", "print('no json')"):
        r = adapter.execute("x", command(bad), cases)
        assert r.status == "error" and 0 < len(r.error) <= 256 and not r.outcomes
    assert adapter.execute("x", command("import time; time.sleep(20)"), cases, seconds=0.3).status == "error"
    assert adapter.execute("x", " ", cases).status == "unavailable" and adapter.execute("x", None, cases).status == "unavailable"


def test_migration_needs_every_record_and_runs_once(spark):
    edges = spark.createDataFrame([("a", "b", "r", "m2"), ("a", "b", "r", "m1"), ("c", "d", "r", "m1")], "src string, dst string, rel string, fact_id string")
    records = spark.createDataFrame([("m1", 1), ("m2", 2)], "id string, valid_from int")
    none = spark.createDataFrame([], "assertion_id string")
    new = graph.migration(edges, records, none)
    assert sorted((r.subject, r.fact_id, r.valid_from) for r in new.collect()) == [("a", "m1", 1), ("c", "m1", 1)]
    assert graph.migration(edges, records, new).count() == 0
    with pytest.raises(Exception, match="no record"):
        graph.migration(edges, records.where("id = 'm1'").withColumn("id", F.lit("m9")), none).collect()


def test_judged_cases(spark):
    kind = "case_id string, expected_allowed boolean, expected_ids array<string>, forbidden_ids array<string>, must_abstain boolean"
    cases = spark.createDataFrame([("a", True, ["x", "y"], [], False), ("b", True, [], ["x"], False), ("c", True, None, None, True), ("d", False, [], [], None), ("e", True, [], [], False)], kind)
    run = lambda rows: {r.case_id: r.correct for r in evaluate.judged(cases, spark.createDataFrame(rows, "case_id string, allowed boolean, ids array<string>")).collect()}
    assert run([("a", True, ["x", "y", "z"]), ("b", True, ["y"]), ("c", True, None), ("d", False, ["q"])]) == {"a": True, "b": True, "c": True, "d": True, "e": False}
    assert run([("a", True, ["y", "x"]), ("b", True, ["y", "x"]), ("c", True, ["q"]), ("d", True, []), ("e", None, [])]) == dict.fromkeys("abcde", False)


def test_values_at_ranks(spark):
    rows = [("a", v) for v in [5, 1, 1, 9, 7]] + [(None, 3), (None, None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    out = evaluate.at_ranks(df, F.col("g"), "v", {"first": lambda n: F.lit(1), "last": lambda n: n, "third": lambda n: F.lit(3), "none": lambda n: n + 1})
    assert {r.grp: (r.first, r.last, r.third, r.none) for r in out.collect()} == {"a": (1, 9, 5, None), None: (3, 3, None, None), "b": (None, None, None, None)}
    assert evaluate.at_ranks(df.where("false"), F.col("g"), "v", {"x": lambda n: n}).count() == 0
    medians = lambda vs: evaluate.index_percentiles(spark.createDataFrame([(v,) for v in vs], "v long"), "v", [], "m").first().m
    assert [medians([4]), medians([1, 4]), medians([9, 1, 4]), medians([])] == [4.0, 2.5, 4.0, None]
