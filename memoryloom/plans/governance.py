"""Queries on lifecycles, delivery, semantic models, governed runs, indexes and digests, with the SQL of each."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from memoryloom.functions import digest, text
from memoryloom.operators import context, evaluate, gate, governed, graph, lifecycle, outbox, semantic, stateful, vectors
from memoryloom.plans.catalogue import AS_OF, COSINE, DAY, GREEDY, SPLIT, gated, planned, scored
from memoryloom.plans.registry import query
from memoryloom.sources.views import table, view, with_views


def by(column: Column, cases: dict[str, str], other: str | None = None) -> Column:
    out = F.create_map(*[F.lit(x) for kv in cases.items() for x in kv])[column]
    return out if other is None else F.coalesce(out, F.lit(other))


def by_sql(column: str, cases: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in cases.items()) + " end"


def z(*values: str) -> str:
    """SQL for the bytes of values with a zero byte after each."""
    return " || ".join(f"encode({v}) || '\\x00'::blob" for v in values)


def be(n: str, size: int) -> str:
    return f"unhex(printf('%0{2 * size}x', ({n})::bigint))"


def hashed(*parts: str) -> str:
    return "'sha256:' || sha256(" + " || ".join(parts) + ")"


# Lifecycles

PROCEDURE = {"view": "evaluated", "click": "approved", "purchase": "active", "error": "rolled_back"}
OBSERVATION = {"view": "accepted", "click": "rejected", "error": "expired"}


def _lifecycle_sql() -> str:
    made = " or ".join(f"(o.lifecycle = '{n}' and f.state = '{a}' and o.target = '{b}')" for n in ("procedure", "observation") for a, to in lifecycle.LIFECYCLES[n].items() for b in to)
    return (
        f", o as (select seq, did, case when did % 2 = 0 then 'procedure' else 'observation' end as lifecycle, case when did % 2 = 0 then {by_sql('verb', PROCEDURE)} else {by_sql('verb', OBSERVATION)} end as target, row_number() over (partition by did order by seq) as k from requests)"
        ", f as (select distinct did, 0::bigint as k, null::bigint as seq, 'proposed' as state, false as made from requests"
        f" union all select o.did, o.k, o.seq, case when coalesce({made}, false) then o.target else f.state end, coalesce({made}, false) from f join o on o.did = f.did and o.k = f.k + 1)"
        " select seq, did, made from f where k > 0"
    )


@query(with_views(_lifecycle_sql(), "requests", recursive=True))
def lifecycle_moves(s, d):
    even = F.col("did") % 2 == 0
    rows = view(s, d, "requests").select("seq", "did", F.when(even, "procedure").otherwise("observation").alias("lifecycle"), F.when(even, by(F.col("verb"), PROCEDURE)).otherwise(by(F.col("verb"), OBSERVATION)).alias("target"))
    return stateful.fold(rows, "did", "seq", lambda st, r: lifecycle.move_step(st, r["lifecycle"], r["target"], r["seq"]), "made boolean").select("seq", "did", "made")


@query("select l_suppkey as procedure, count(*) as outcomes, (sum(10000 - cast(round(l_discount * 60000) as bigint)) // count(*))::bigint as score_bp, (sum(10000 - cast(round(l_discount * 60000) as bigint)) // count(*)) >= 7000 as passed from lineitem group by 1")
def feedback_evaluation(s, d):
    return lifecycle.evaluations(table(s, d, "lineitem").selectExpr("l_suppkey as procedure", "10000 - cast(round(l_discount * 60000) as bigint) as outcome_bp"))


@query("select l_orderkey as procedure, sha256('feedback-v1' || chr(10) || string_agg(l_partkey::varchar || '|' || l_shipdate::varchar || '|' || l_suppkey::varchar, chr(10) order by l_partkey::varchar, l_shipdate, l_suppkey)) as digest from lineitem group by 1")
def feedback_digests(s, d):
    return lifecycle.feedback_digest(table(s, d, "lineitem").selectExpr("l_orderkey as procedure", "cast(l_partkey as string) as trajectory", "l_shipdate as recorded_at", "l_suppkey as outcome_bp"))


RUN_OF = {"signup": "background-deduplication-v1", "view": "conversation-deduplication-v1", "click": "document-deduplication-v1", "error": "background-reconciliation-v1", "purchase": "json-event-reconciliation-v1"}
RUNS = (
    f", r as (select event_id, latency_micros, user_id, case when event_id % 50 = 0 then 'unknown-v1' else {by_sql('event_type', RUN_OF)} end as profile, case when event_id % 2 = 0 then 'hot_path' else 'background' end as mode from (select event_id, user_id, event_type, cast(round(value * 1000) as bigint) as latency_micros from events))"
    ", x as (select *, case " + " ".join(f"when profile = '{k}' then '{o}'" for k, (o, _) in lifecycle.PROFILES.items()) + " end as operation from r) "
)


def runs(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "user_id", F.round(F.col("value") * 1000).cast("long").alias("latency_micros"), F.when(F.col("event_id") % 50 == 0, "unknown-v1").otherwise(by(F.col("event_type"), RUN_OF)).alias("profile"), F.when(F.col("event_id") % 2 == 0, "hot_path").otherwise("background").alias("mode"))


@query(with_views(RUNS + "select event_id, operation, case when operation is null then 'unknown_profile' when mode = 'hot_path' and profile in ('background-deduplication-v1', 'background-reconciliation-v1') then 'mode_refused' else 'run' end as verdict from x", "requests"))
def formation_runs(s, d):
    return lifecycle.formation(runs(s, d)).select("event_id", "operation", "verdict")


@query(with_views(RUNS + ", c as (select *, md5(event_id::varchar) as sources, md5(user_id::varchar) as proposal, latency_micros % 3000 as considered, latency_micros % 300 as proposed from x where operation is not null) select event_id, case when considered > 2048 then 'source_budget' when proposed > 256 then 'output_budget' end as refused, case when considered <= 2048 and proposed <= 256 then " + hashed(z("'formation-explanation.v1'", "profile", "operation", "mode", "sources", "proposal"), be("considered", 4), be("proposed", 4)) + " end as explanation from c", "requests"))
def formation_explanations(s, d):
    r = lifecycle.formation(runs(s, d)).where("operation is not null")
    r = r.withColumns({"sources": F.md5(F.col("event_id").cast("string").cast("binary")), "proposal": F.md5(F.col("user_id").cast("string").cast("binary")), "considered": F.col("latency_micros") % 3000, "proposed": F.col("latency_micros") % 300})
    return lifecycle.explained(r, 2048, 256).select("event_id", "refused", "explanation")


# Delivery

LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ENTRIES = ", e as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as ordinal, l_partkey, l_suppkey, case l_returnflag when 'A' then 'acked' when 'R' then 'leased' else 'pending' end as status, case when l_returnflag = 'R' then l_shipdate end as lease_expiry from lineitem) "
CLAIM_AT = "1997-01-01"


def entries(s, d):
    flag = F.col("l_returnflag")
    rows = outbox.with_ordinals(table(s, d, "lineitem"), "l_orderkey", *LINES)
    return rows.select("l_orderkey", "ordinal", "l_partkey", "l_suppkey", F.when(flag == "A", "acked").when(flag == "R", "leased").otherwise("pending").alias("status"), F.when(flag == "R", F.col("l_shipdate")).alias("lease_expiry"))


@query("with" + ENTRIES[1:] + f", c as (select *, row_number() over (partition by l_orderkey order by ordinal) as k from e where status <> 'acked' and (lease_expiry is null or lease_expiry <= timestamp '{CLAIM_AT}')) select l_orderkey, ordinal, status from c where k <= 2")
def outbox_claim(s, d):
    return outbox.claim(entries(s, d), "l_orderkey", F.lit(CLAIM_AT).cast("timestamp_ntz"), 2).select("l_orderkey", "ordinal", "status")


@query("with" + ENTRIES[1:] + ", n as (select l_orderkey + (l_suppkey % 40 = 0)::int as l_orderkey, ordinal + (l_partkey % 50 = 0)::int as ordinal, 'e-' || l_orderkey || '-' || ordinal as entry_id from e), m as (select o_orderkey as l_orderkey, unnest(range(0, 1 + o_orderkey % 4)) as place from orders), j as (select m.l_orderkey, m.place as ordinal, 'e-' || m.l_orderkey || '-' || m.place as entry_id, n.l_orderkey as c, n.ordinal as o from m left join n on n.entry_id = 'e-' || m.l_orderkey || '-' || m.place) select l_orderkey, ordinal, entry_id, case when c is null then 'missing' when c <> l_orderkey then 'commit' else 'ordinal' end as fault from j where c is null or c <> l_orderkey or o <> ordinal")
def outbox_manifest_faults(s, d):
    e = entries(s, d)
    name = F.concat(F.lit("e-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("ordinal").cast("string"))
    e = e.withColumn("entry_id", name).select("entry_id", (F.col("l_orderkey") + (F.col("l_suppkey") % 40 == 0).cast("int")).alias("l_orderkey"), (F.col("ordinal") + (F.col("l_partkey") % 50 == 0).cast("int")).alias("ordinal"))
    listed = table(s, d, "orders").selectExpr("o_orderkey as l_orderkey", "transform(sequence(0, o_orderkey % 4), i -> concat('e-', o_orderkey, '-', i)) as entry_ids")
    return outbox.manifest_faults(listed, e, "l_orderkey")


def _delivery_sql() -> str:
    claim, acked = "o.op = 'claim'", "f.status = 'acked'"
    held = "(f.ends is not null and o.at < f.ends)"
    outcome = f"case when {acked} then case when {claim} then 'done' when o.token = f.acked then 'repeated' else 'stale' end when {claim} then case when {held} then 'leased' else 'claimed' end when {held} and o.token = f.attempts then 'acked' else 'stale' end"
    return (
        ", o as (select event_id, user_id, epoch_us(ts) as at, case when operation in ('remember', 'recall') then 'claim' else 'ack' end as op, 1 + event_id % 2 as token, row_number() over (partition by user_id order by ts, event_id) as k from op_samples)"
        ", f as (select distinct user_id, 0::bigint as k, null::bigint as event_id, 'pending' as status, 0::bigint as attempts, null::bigint as ends, null::bigint as acked, '' as outcome from op_samples"
        f" union all select o.user_id, o.k, o.event_id, case {outcome} when 'claimed' then 'leased' when 'acked' then 'acked' else f.status end, f.attempts + ({outcome} = 'claimed')::int, case {outcome} when 'claimed' then o.at + {DAY} when 'acked' then null else f.ends end, case when {outcome} = 'acked' then o.token else f.acked end, {outcome} from f join o on o.user_id = f.user_id and o.k = f.k + 1)"
        " select event_id, user_id, outcome from f where k > 0"
    )


@query(with_views(_delivery_sql(), "op_samples", recursive=True))
def outbox_delivery(s, d):
    rows = view(s, d, "op_samples").select("event_id", "user_id", text.micros(F.col("ts")).alias("at"), F.when(F.col("operation").isin("remember", "recall"), "claim").otherwise("ack").alias("op"), (1 + F.col("event_id") % 2).alias("token"))
    step = lambda st, r: outbox.delivery_step(st, r["op"], r["token"], r["at"], DAY)
    return stateful.fold(rows, "user_id", ["at", "event_id"], step, "outcome string").select("event_id", "user_id", "outcome")


@query(with_views(", u as (select event_id, case event_id % 5 when 0 then 'snapshot' when 1 then 'plan' when 2 then 'proposal' when 3 then 'commit' else 'unknown' end as phase, latency_micros % 120 as completed, case when event_id % 7 = 0 then 0 when event_id % 3 > 0 then 100 end as total, ts, lag(ts) over (partition by user_id order by event_id) as b from op_samples) select event_id, case when phase = 'unknown' then 'phase' when total = 0 or completed > total then 'units' else 'time' end as fault from u where phase = 'unknown' or total = 0 or completed > total or ts < b", "op_samples"))
def progress_faults(s, d):
    e = F.col("event_id")
    phase = F.coalesce(F.get(F.array(*[F.lit(p) for p in outbox.PHASES]), (e % 5).cast("int")), F.lit("unknown"))
    total = F.when(e % 7 == 0, 0).when(e % 3 > 0, 100)
    rows = view(s, d, "op_samples").select("event_id", "user_id", phase.alias("phase"), (F.col("latency_micros") % 120).alias("completed"), total.alias("total"), F.col("ts").alias("updated_at"))
    return outbox.progress_faults(rows, "user_id", "event_id").select("event_id", "fault")


# Semantic models

MODEL = semantic.Model.parsed(
    json.dumps(
        {
            "namespace": "sales",
            "name": "orders",
            "version": 2,
            "metrics": [{"name": "revenue", "expression": "sum(o_totalprice)"}, {"name": "orders", "expression": "count(*)"}],
            "dimensions": [{"name": "customer", "role": "identifier"}, {"name": "status", "role": "category"}, {"name": "priority", "role": "category"}],
            "relationships": [{"name": "placed_by", "from": "order", "to": "customer"}],
        }
    )
)
SEMANTIC = (
    "with r as (select o_orderkey, case o_orderkey % 4 when 1 then 'orders' when 3 then 'margin' else 'revenue' end as metric, case o_custkey % 4 when 0 then ['customer'] when 1 then ['status', 'customer', 'status'] when 2 then [] else ['status', 'planet'] end as w from orders)"
    ", v as (select o_orderkey, metric, list_sort(list_distinct(w)) as w, case when metric = 'margin' then 'unknown_metric' when len(w) = 0 then 'invalid' when list_contains(w, 'planet') then 'unknown_dimension' else 'planned' end as verdict from r) "
)


def semantic_rows(s, d):
    names = [["customer"], ["status", "customer", "status"], [], ["status", "planet"]]
    wanted = F.array(*[F.array(*[F.lit(x) for x in n]).cast("array<string>") for n in names])
    metrics = F.array(*[F.lit(x) for x in ("revenue", "orders", "revenue", "margin")])
    rows = table(s, d, "orders").select("o_orderkey", F.get(metrics, (F.col("o_orderkey") % 4).cast("int")).alias("metric"), F.get(wanted, (F.col("o_custkey") % 4).cast("int")).alias("dimensions"))
    return semantic.resolved(rows, MODEL)


@query(SEMANTIC + "select o_orderkey, metric, array_to_string(w, ',') as dimensions, verdict from v")
def semantic_requests(s, d):
    return semantic_rows(s, d).select("o_orderkey", "metric", F.array_join("dimensions", ",").alias("dimensions"), "verdict")


@query(SEMANTIC + "select o_orderkey, " + hashed(z("'semantic-query.v1'", f"'{MODEL.digest('manifest')}'", "metric"), "unhex(list_aggregate(list_transform(w, lambda x: hex(encode(x)) || '00'), 'string_agg', ''))") + " as plan_digest from v where verdict = 'planned'")
def semantic_plan_digests(s, d):
    return semantic.plan_digests(semantic_rows(s, d), MODEL.digest("manifest")).select("o_orderkey", "plan_digest")


@query("select c_custkey, md5(n_name) as schema_digest from customer left join nation on n_nationkey = c_nationkey and n_regionkey = c_custkey % 5 and 1 + n_nationkey % 3 = 1 + c_custkey % 3")
def schema_registry(s, d):
    registry = table(s, d, "nation").selectExpr("concat('region-', n_regionkey) as namespace", "concat('schema-', n_nationkey) as name", "1 + n_nationkey % 3 as version", "md5(n_name) as schema_digest")
    wanted = table(s, d, "customer").selectExpr("c_custkey", "concat('region-', c_custkey % 5) as namespace", "concat('schema-', c_nationkey) as name", "1 + c_custkey % 3 as version")
    return semantic.registered(wanted, registry).select("c_custkey", "schema_digest")


_BACKUPS = "b as (select o_orderkey, 'backup-v' || case when o_orderkey % 5 = 0 then 0 else 1 end as version, 'db-v' || (o_orderkey % 6) as schema_name from orders)"


@query(f"with {_BACKUPS} select o_orderkey, (version, schema_name) = ('backup-v1', 'db-v2') as exact, version = 'backup-v1' and coalesce(try_cast(regexp_extract(schema_name, '^db-v([0-9]+)$', 1) as int) between 2 and 4, false) as in_window from b")
def backup_restore(s, d):
    version, schema = F.when(F.col("o_orderkey") % 5 == 0, "backup-v0").otherwise("backup-v1"), F.concat(F.lit("db-v"), (F.col("o_orderkey") % 6).cast("string"))
    return table(s, d, "orders").select("o_orderkey", semantic.restorable(version, schema, "backup-v1", "db-v2").alias("exact"), semantic.restorable(version, schema, "backup-v1", family="db", least=2, most=4).alias("in_window"))


# Governed runs

SEEN_AT = "2024-01-20"


@query(with_views(f", x as (select *, epoch_us(ts) // 1000000 as sec, epoch_us(ts) as us from op_samples) select event_id, case when ts < timestamp '{SEEN_AT}' - interval 5 day then 'stale' when ts > timestamp '{SEEN_AT}' + interval 1 hour then 'future' else 'fresh' end as freshness, 1705708800 < sec + 86400 as unexpired, case when latency_micros between 1 and 50000 then us + latency_micros else -1 end as expires_at, event_id % 2 = 0 and user_id % 4 = event_id % 4 and timestamp '{SEEN_AT}' < ts as leased from x", "op_samples"))
def authority_freshness(s, d):
    e, now = view(s, d, "op_samples"), F.lit(SEEN_AT).cast("timestamp_ntz")
    us = text.micros(F.col("ts"))
    e = e.withColumns({"status": F.when(F.col("event_id") % 2 == 0, "leased").otherwise("pending"), "token_digest": F.md5((F.col("user_id") % 4).cast("string").cast("binary")), "lease_expiry": F.col("ts")})
    return e.select(
        "event_id", governed.freshness(F.col("ts"), now, F.expr("interval 5 days"), F.expr("interval 1 hour")).alias("freshness"),
        governed.unexpired(F.lit(1705708800), F.floor(us / 1_000_000) + 86400).alias("unexpired"),
        F.coalesce(governed.expiry(us, F.col("latency_micros"), 50_000), F.lit(-1)).alias("expires_at"), governed.lease_holds(F.md5((F.col("event_id") % 4).cast("string").cast("binary")), now).alias("leased"),
    )


@query("with b as (select o_orderkey, o_custkey + (o_orderkey % 7 = 0)::int as o_custkey, o_orderstatus, case when o_orderkey % 11 <> 0 then o_orderpriority end as o_orderpriority from orders where o_orderkey % 10 <> 0) select a.o_orderkey, b.o_orderkey is not null as bound, case when b.o_orderkey is not null then concat_ws(',', case when a.o_custkey is distinct from b.o_custkey then 'o_custkey' end, case when a.o_orderstatus is distinct from b.o_orderstatus then 'o_orderstatus' end, case when a.o_orderpriority is distinct from b.o_orderpriority then 'o_orderpriority' end) end as differing from orders a left join b on a.o_orderkey = b.o_orderkey")
def binding_mismatches(s, d):
    intents = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    bound = intents.where("o_orderkey % 10 <> 0").withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")))
    return governed.bindings(intents, bound, "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query(with_views(" select space_id, count(*) as rows, sum(octet_length(encode(id)) + coalesce(octet_length(encode(text)), 0))::bigint as bytes, count(*) <= 10000 and sum(octet_length(encode(id)) + coalesce(octet_length(encode(text)), 0)) <= 1000000 as within from memories group by space_id", "memories"))
def source_budget(s, d):
    return governed.source_budget(view(s, d, "memories"), "space_id", ["id", "text"], 10_000, 1_000_000)


@query("select s_nationkey, count(*) as components, bool_and(s_acctbal > -500) as ready from supplier group by 1")
def component_readiness(s, d):
    return governed.readiness(table(s, d, "supplier").select("s_nationkey", F.when(F.col("s_acctbal") > -500, "ready").alias("state")), "s_nationkey")


@query("with n as (select l_orderkey, l_suppkey, count(*) as c from lineitem group by all) select l_orderkey, count(*) as entities, max(c) as most_alike from n group by 1 having count(*) > 5 or max(c) > 1")
def entity_caps(s, d):
    return governed.entity_caps(table(s, d, "lineitem"), "l_orderkey", "l_suppkey", 5)


@query(with_views(" select nonce, count(*) as n from requests group by nonce having count(*) > 1", "requests"))
def duplicate_nonces(s, d):
    return governed.duplicates(view(s, d, "requests"), "nonce")


@query("select c_custkey, " + hashed(z("'encryption-boundary.v1'", "c_nationkey::varchar", "'key-2'"), be("c_custkey + 1", 8)) + " as boundary from customer")
def key_rotation(s, d):
    rows = table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("tenant"), F.lit("key-1").alias("key"), F.col("c_custkey").alias("revision"))
    return governed.rotated(rows, F.lit("key-2")).select((F.col("revision") - 1).alias("c_custkey"), digest.key_boundary(F.col("tenant"), F.col("key"), F.col("revision")).alias("boundary"))


_SECOND_RUN = "b as (select case_id, case when case_id % 9 = 0 then 'other' else receipt end as receipt from a where case_id % 13 <> 0)"


@query(f"with a as (select o_orderkey as case_id, md5(o_custkey::varchar) as receipt from orders), {_SECOND_RUN} select count(*) as mismatches from a full join b on a.case_id = b.case_id where a.receipt is distinct from b.receipt")
def run_mismatches(s, d):
    first = table(s, d, "orders").selectExpr("o_orderkey as case_id", "md5(cast(o_custkey as string)) as receipt")
    second = first.where("case_id % 13 <> 0").withColumn("receipt", F.when(F.col("case_id") % 9 == 0, "other").otherwise(F.col("receipt")))
    return evaluate.mismatches(first, second)


_CASES = "c as (select o_orderkey as case_id, [o_custkey % 7, o_custkey % 5] as expected, [o_orderkey % 6] as forbidden, o_orderkey % 9 as budget from orders), e as (select case_id, unnest(expected) as id from c), x as (select case_id, unnest(forbidden) as id from c)"


@query(
    f"with {_CASES}, o as (select distinct e.case_id from e join x on x.case_id = e.case_id and x.id = e.id), "
    "r as (select distinct case_id from (select case_id, id from e group by all having count(*) > 1 union all select case_id, id from x group by all having count(*) > 1)) "
    "select case_id, case when case_id in (select case_id from o) then 'overlap' when case_id in (select case_id from r) then 'repeated' when len(expected) > 256 or len(forbidden) > 256 or budget < 1 or budget > 64000 then 'bounds' end as fault from c"
)
def eval_case_faults(s, d):
    rows = table(s, d, "orders").selectExpr("o_orderkey as case_id", "array(o_custkey % 7, o_custkey % 5) as expected_ids", "array(o_orderkey % 6) as forbidden_ids", "o_orderkey % 9 as token_budget")
    return evaluate.valid_cases(rows, 256, 64_000).select("case_id", "fault")


# Indexes


@query(with_views(", o as (select did, arg_max(verb, seq) as verb from requests group by did), l as (select 'vec-' || lpad(did::varchar, 8, '0') as id, verb from o), a as (select coalesce(v.id, l.id) as id, l.verb from vectors v full join l on v.id = l.id) select id from a where verb is null or verb in ('signup', 'view')", "requests", "vectors"))
def vector_manifest_delta(s, d):
    op = F.when(F.col("verb").isin("signup", "view"), "add").otherwise("remove")
    changes = view(s, d, "requests").select(F.concat(F.lit("vec-"), F.lpad(F.col("did").cast("string"), 8, "0")).alias("id"), op.alias("op"), F.col("seq").alias("ordinal"))
    return vectors.delta(view(s, d, "vectors"), changes, 2**62)


def members(s, d):
    v = view(s, d, "vectors").select("id", "embedding", "label", F.array("entity_a", "entity_b").alias("entities"))
    number = F.substring("id", 5, 8).cast("long")
    kept = vectors.Index(v).remove(v.where(number % 7 == 0))
    return kept.index(v.where(number % 35 == 0).withColumn("label", F.lit(9)).withColumn("entities", F.array().cast("array<string>")))


@query(with_views(", n as (select substr(id, 5)::bigint as k, label from vectors) select case when k % 35 = 0 then 9 else label end as label, count(*) as n from n where k % 7 <> 0 or k % 35 = 0 group by 1", "vectors"))
def vector_index_membership(s, d):
    return members(s, d).members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(COSINE + ", h as (select id, s + case when entity_a = 'entity-1' then 0.1::double else 0 end as s from c where substr(id, 5)::bigint % 7 <> 0) select id, round(s, 9) as score from h where s > 0 order by s desc, id limit 50", "vectors"))
def vector_index_search(s, d):
    _, q = scored(s, d)
    return members(s, d).search(q, 50, ["entity-1"], F.col("label") <= gate.INTERNAL).select("id", F.round("score", 9).alias("score"))


# Digests and relations

_KEY = hashed("encode('legacy-relation-key.v1') || '\\x00'::blob || " + " || ".join(f"{be(f'octet_length(encode({c}))', 8)} || encode({c})" for c in ("src", "rel", "dst")))
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(with_views(f", k as (select src, {_KEY} as relation_key from rel_edges), u as (select *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || {z(chr(39) + 'legacy-relation.v1' + chr(39))} || encode(relation_key)) as h from k) select src, relation_key, {_UUID} as assertion_id from u", "rel_edges"))
def legacy_assertion_ids(s, d):
    rows = view(s, d, "rel_edges").select("src", digest.tagged("legacy-relation-key.v1", F.col("src"), F.col("rel"), F.col("dst")).alias("relation_key"))
    return rows.withColumn("assertion_id", digest.uuid5("legacy-relation.v1", F.col("relation_key")))


@query(with_views(", a as (select 'assertion:' || substr(sha256(src || '|' || rel || '|' || dst), 1, 32) as id, src, dst from rel_edges) select 'assertion' as element, id, null::varchar as src, null::varchar as dst from a union all select 'assertion-subject', 'assertion-subject:' || id, id, src from a union all select 'assertion-object', 'assertion-object:' || id, id, dst from a union all select 'entity', e, null, null from (select src as e from a union select dst from a)", "rel_edges"))
def assertion_projection(s, d):
    return graph.projection(graph.assertions_of(view(s, d, "rel_edges")))


SHAPE = f"Default|Balanced|{AS_OF}|"
_REASON = "'sha256:' || sha256(id::varchar)"


@query(with_views(GREEDY + "select " + hashed(z("'context-plan.v1'"), "encode('query')", z("'working-set'", "'pinned'"), "coalesce(unhex(string_agg(case when pinned then hex(encode(id::varchar)) || '00' end, '' order by id::varchar)), ''::blob)", f"encode('{SHAPE}' || sum(tokens)::bigint)", f"unhex(string_agg(hex(encode(id::varchar)) || printf('%08x', score_bp::bigint) || printf('%08x', tokens::bigint) || hex(encode({_REASON})), '' order by pinned desc, score_bp desc, id))") + " as plan_digest, count(*) as items from p", "candidates", recursive=True))
def context_plan_digest(s, d):
    place = F.struct((~F.col("pinned")).alias("p"), (-F.col("score_bp")).alias("s"), F.col("id").alias("k"))
    item = F.struct(place.alias("place"), F.col("id").cast("string").alias("id"), "score_bp", "tokens", F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("reason"))
    pins = F.collect_list(F.when(F.col("pinned"), F.col("id").cast("string")))
    one = planned(s, d).agg(F.array_sort(F.collect_list(item)).alias("items"), pins.alias("pins"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    made = digest.plan(F.lit("query"), F.lit(None).cast("string"), F.col("pins"), F.concat(F.lit(SHAPE), F.col("tokens").cast("string")), F.col("items"))
    return one.select(made.alias("plan_digest"), F.col("n").alias("items"))


@query(with_views(GREEDY + SPLIT + ", b as (select g.id, g.visibility from p join g on g.id = 'doc-' || lpad(p.id::varchar, 8, '0')) select " + hashed(z("'context-materialization.v1'"), "encode('plan')", z("'space'"), "encode('space-all')", z("'ceiling'"), "encode('internal')", z("'purpose'"), "encode('research')", *[x for v in ("visible", "redacted") for x in (z(f"'{v}'"), f"coalesce(unhex(string_agg(case when visibility = '{v}' then hex(encode(id)) || '00' end, '' order by id)), ''::blob)")]) + " as receipt from b", "candidates", "memories", recursive=True))
def context_receipt(s, d):
    plan = planned(s, d).select(F.concat(F.lit("doc-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"))
    shown = context.bundle(plan, gated(s, d))
    one = shown.agg(*[F.collect_list(F.when(F.col("visibility") == v, F.col("id"))).alias(v) for v in ("visible", "redacted")])
    return one.select(digest.receipt(F.lit("plan"), F.lit("space-all"), F.lit("internal"), F.lit("research"), F.col("visible"), F.col("redacted")).alias("receipt"))


@query(with_views(" select user_id, operation, " + hashed(z("'latency-percentiles.v1'"), "unhex(string_agg(printf('%016x', latency_micros), '' order by latency_micros))") + " as digest from op_samples group by user_id, operation", "op_samples"))
def latency_digests(s, d):
    return view(s, d, "op_samples").groupBy("user_id", "operation").agg(digest.latency(F.col("latency_micros")).alias("digest"))


_SESSION = hashed(z("'session.v1'", "c_custkey::varchar", "c_mktsegment", "'policy'"))


@query("select c_custkey, " + hashed(z("'session-recall.v1'", "c_name"), f"encode({_SESSION})") + " as query_digest from customer")
def session_binding(s, d):
    own = digest.session(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.lit("policy"))
    return table(s, d, "customer").select("c_custkey", digest.bound_query(F.col("c_name"), own).alias("query_digest"))


@query(with_views(f" select count(*) as n, min(id) as least from memories where label <= 1 and quarantined and valid_from <= date '{AS_OF}'", "memories"))
def quarantined_public(s, d):
    m = view(s, d, "memories").where(gate.authorized(clearance=gate.INTERNAL) & F.col("quarantined") & (F.col("valid_from") <= F.lit(AS_OF).cast("date")))
    return m.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
