"""Queries beside the catalogue: whole orders and hits, plan validation, versions, one-use authority."""

from __future__ import annotations

from pyspark.sql import functions as F

from memoryloom.functions import text
from memoryloom.operators import consolidate, context, evaluate, governed, graph, ledger, outbox, rank, scheduler, stateful, temporal
from memoryloom.plans.catalogue import LEXICAL, N_MEM, ORDER, OVERLAP, SPLIT, STATE, STATES_AT, TOKENS, GREEDY, day, documents, gated, planned, states
from memoryloom.plans.registry import query
from memoryloom.sources import files, scratch
from memoryloom.sources.views import table, view, with_views


@query(with_views(f" select id, row_number() over ({ORDER}) as position from candidates", "candidates"))
def context_order_all(s, d):
    return context.positions(view(s, d, "candidates"))


@query(with_views(SPLIT + f", r as (select id, {OVERLAP} as overlap from g where visibility = 'visible') select * from r where overlap > 0", "memories"))
def lexical_gated_hits(s, d):
    return rank.lexical(gated(s, d).where("visibility = 'visible'"), LEXICAL).select("id", "overlap")


@query(with_views(f" select 4 * count(*) as estimated_tokens from memories where len(list_intersect({TOKENS}, ['than', 'the', 'with'])) > 0", "memories"))
def estimated_context_tokens(s, d):
    return context.estimated_tokens(rank.lexical(view(s, d, "memories"), LEXICAL))


_PLANS = "pl as (select 'canonical' as plan, *, row_number() over (order by pinned desc, score_bp desc, id) as position from p union all select 'by id', *, row_number() over (order by id) from p), lg as (select *, lag((not pinned, -score_bp, id)) over (partition by plan order by position) as b from pl)"


@query(with_views(GREEDY + ", " + _PLANS + " select plan, count(*) as items, count_if(coalesce(b >= (not pinned, -score_bp, id), false))::bigint as faults from lg group by plan", "candidates", recursive=True))
def plan_order_faults(s, d):
    from pyspark.sql import Window as W

    rows = planned(s, d).select("id", "score_bp", "tokens", "pinned")
    plans = [(name, W.partitionBy("plan").orderBy(*by)) for name, by in (("canonical", context.order()), ("by id", [F.col("id")]))]
    both = [rows.withColumn("plan", F.lit(n)).withColumn("position", F.row_number().over(w)) for n, w in plans]
    return context.out_of_order(both[0].unionByName(both[1]), "plan", "position")


@query(with_views(" select operation, round(avg(case when allowed then latency_micros end), 6) as slow_mean, round(avg(case when not allowed then latency_micros end), 6) as fast_mean, round(avg(case when allowed then latency_micros end) / avg(case when not allowed then latency_micros end), 6) as speedup from op_samples group by operation", "op_samples"))
def operation_speedups(s, d):
    out = evaluate.speedups(view(s, d, "op_samples"), "operation", "latency_micros", ~F.col("allowed"))
    return out.select("operation", *[F.round(c, 6).alias(c) for c in ("slow_mean", "fast_mean", "speedup")])


@query(with_views(N_MEM + ", g as (select normalized, count(*) as n, string_agg(id, ',' order by id) as ids from n group by normalized) select ids, case when n > 1 then 'mutated' else 'no_change' end as effect, case when n > 1 then 'sha256:' || sha256(ids) else 'v0:' || ids end as version from g", "memories"))
def resulting_versions(s, d):
    rows = documents(s, d).select("id", F.sha2(text.normalized(F.col("text")), 256).alias("digest"))
    again = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Members are gathered for repeated texts alone.
    several = rows.join(again, "digest", "left_semi").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))
    alone = rows.join(again, "digest", "left_anti").select(F.col("id").alias("ids"), F.lit(1).cast("long").alias("n"))
    both = several.select("ids", "n").unionByName(alone).withColumn("effect", consolidate.effect(F.col("n") - 1))
    return both.select("ids", "effect", consolidate.resulting_version(F.col("effect"), F.col("ids"), F.concat(F.lit("v0:"), "ids")).alias("version"))


@query(with_views(STATE + f", va as (select assertion_id, min(changed_at) as valid_from from transitions group by assertion_id) select st.assertion_id from st join va using (assertion_id) where state = 'current' and valid_from <= date '{STATES_AT}' and date '{STATES_AT}' < valid_from + interval 3 year", "transitions"))
def assertion_valid_current_at(s, d):
    first = view(s, d, "transitions").groupBy("assertion_id").agg(F.min("changed_at").alias("valid_from"))
    validity = first.withColumn("valid_to", F.add_months("valid_from", 36))
    return temporal.current_at(states(s, d), validity, "assertion_id", day(STATES_AT))


@query(with_views(" select seq, case when row_number() over (partition by did, idempotency_key order by seq) = 1 then 'accepted' else 'spent' end as decision from requests", "requests"))
def authority_one_use(s, d):
    return stateful.one_use(view(s, d, "requests"), ["did", "idempotency_key"]).select("seq", "decision")


_VERB = "case verb when 'signup' then 'remember' when 'click' then 'improve' when 'error' then 'forget' else 'recall' end"
_FACTS = f"select seq, did, nonce, idempotency_key, {_VERB} as verb, did % 3 <> 0 as can_mutate, seq % 1200 as size, tenant % 4 <> 3 as in_scope, idempotency_key % 5 <> 0 as cleared, seq % 7 <> 0 as fresh from requests"
_OWN = "case when verb = 'remember' and size > 1024 then 'oversized-memory' when verb = 'remember' and not in_scope then 'scope-denied' when verb = 'remember' and not cleared then 'clearance-denied' when verb = 'recall' and size > 1024 then 'oversized-query' when verb = 'improve' and not fresh then 'stale-source' when verb in ('improve', 'forget') and not (in_scope and cleared) then 'authorization-denied' else 'accepted' end"


@query(
    with_views(
        f", f as ({_FACTS}), o as (select *, row_number() over (partition by did, nonce order by seq) = 1 and (verb = 'recall' or can_mutate) as open, {_OWN} as own from f), "
        "p as (select *, bool_or(open and verb = 'improve' and own = 'accepted') over (partition by did, idempotency_key, verb order by seq rows unbounded preceding) as known from o) "
        "select seq, did, case when not open then case when verb = 'recall' then 'replay' else 'replay-or-mutation-denied' end when verb = 'improve' and known then 'accepted' else own end as decision from p",
        "requests",
    )
)
def verb_order_decisions(s, d):
    return stateful.verb_order(view(s, d, "requests").selectExpr(*_FACTS.removeprefix("select ").removesuffix(" from requests").split(", ")))


@query(with_views(" select seq, idempotency_key as job, case when row_number() over w = 1 then 'staged' when verb = first_value(verb) over w then 'ready' else 'collision' end as outcome from requests window w as (partition by idempotency_key order by seq)", "requests"))
def proposal_staging(s, d):
    return stateful.restaged(view(s, d, "requests").selectExpr("idempotency_key as job", "seq", "verb as digest"))


_PRICE = "select concat('ord-', o_orderkey) as observation_id, o_orderstatus as country, 'coffee' as commodity, o_orderpriority as market, case when o_orderkey % 7 <> 0 then cast(o_totalprice as double) end as price_usd_per_kg, cast(o_orderdate as date) as observed_on, 'table' as source, cast(null as string) as note from orders"
_PRICES = "select observation_id, country, market, price_usd_per_kg, cast(observed_on as string) as observed_on, note from p"


def _orders(s, d):
    with ledger.temp_view(table(s, d, "orders")) as name:
        return s.sql(_PRICE.replace("from orders", f"from {name}"))


@query(f"with p as ({_PRICE}) {_PRICES}")
def csv_prices(s, d):
    """All orders as price observations, written as CSV files and scanned."""
    path = scratch.folder(s, "prices")
    _orders(s, d).write.option("header", True).csv(path)
    with ledger.temp_view(files.prices(s, path)) as name:
        return s.sql(_PRICES.replace("from p", f"from {name}"))


@query(f"with p as ({_PRICE}) select observation_id, country, commodity, price_usd_per_kg, observed_on::varchar as observed_on from p where country = 'F'")
def prices_by_country(s, d):
    with ledger.temp_view(_orders(s, d)) as name:
        return files.by_country(s, name, "F").withColumn("observed_on", F.col("observed_on").cast("string"))


@query(with_views(" select id as case_id, valid_from::varchar as as_of, 1 as expected, quarantined as abstain from memories", "memories"))
def jsonl_cases(s, d):
    """A case for each memory, written as JSON lines and read under the strict rules."""
    path = scratch.folder(s, "cases")
    rows = view(s, d, "memories").select(F.col("id").alias("case_id"), F.concat(F.lit("what is "), "id").alias("query"), F.col("valid_from").cast("string").alias("as_of"), F.array("id").alias("expected_ids"), F.col("quarantined").alias("abstain"))
    rows.write.json(path)
    return files.cases(s, path).select("case_id", F.col("as_of").cast("string").alias("as_of"), F.size("expected_ids").alias("expected"), "abstain")


@query("select n_nationkey, n_name, n_regionkey from nation")
def arrow_staged(s, d):
    """The nations, a table of fixed size, through an Arrow stream that is checked first."""
    import pyarrow as pa

    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return files.staged_ipc(s, [sink.getvalue().to_pybytes()], rows.schema)


@query(with_views(" select id, coalesce(octet_length(encode(text)) between 1 and 16384 and trim(text) = text and not regexp_matches(text, '[[:cntrl:]]'), false) as canonical from memories", "memories"))
def canonical_texts(s, d):
    return view(s, d, "memories").select("id", F.coalesce(text.canonical(F.col("text"), 16_384), F.lit(False)).alias("canonical"))


@query("select doc_id as id, md5(text) as text_md5, n_chars as valid_from from documents")
def granted_projection(s, d):
    out = governed.projected(table(s, d, "documents"), {"id": "doc_id", "text": "text", "valid_from": "n_chars"}, ["doc_id", "n_chars", "text"])
    return out.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "valid_from")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_ZIP_SQL = f"a as (select *, row_number() over (order by {', '.join(_LINE)}) - 1 as position from lineitem), b as (select *, row_number() over (order by l_quantity, {', '.join(_LINE)}) - 1 as position from lineitem)"


@query(f"with {_ZIP_SQL} select a.position, a.l_orderkey as first_key, b.l_orderkey as second_key, a.l_quantity = b.l_quantity as equal from a join b on a.position = b.position")
def positional_zip(s, d):
    """The lines in two orders, side by side."""
    rows = table(s, d, "lineitem").select(*_LINE)
    with scratch.Scratch(s) as tables:
        both = evaluate.zipped(tables, rows, _LINE, rows, ["l_quantity", *_LINE])
        return tables.keep(both.select("position", F.col("a.l_orderkey").alias("first_key"), F.col("b.l_orderkey").alias("second_key"), (F.col("a.l_quantity") == F.col("b.l_quantity")).alias("equal")))


# Jobs and leases

_ASKED = [
    "event_id as seq",
    "user_id * 3 + event_id % 3 as job",
    "case event_type when 'signup' then case when event_id % 4 = 0 then 'claim' else 'submit' end when 'view' then 'acquire' when 'error' then 'fail' when 'purchase' then case when event_id % 3 = 0 then 'cancel' else 'complete' end else case event_id % 4 when 0 then 'renew' when 1 then 'progress' else 'propose' end end as op",
    "event_id * 6000000 - case when event_id % 17 = 0 then 3600000000 else 0 end as at",
    "case when event_type = 'purchase' then event_id % 6 else user_id % 3 end as owner",
    "case when event_type = 'signup' then case when event_id % 19 = 0 then 1 else 0 end else event_id % 2 end as digest",
    "cast(2 + user_id % 2 as bigint) as most",
    "cast(floor(event_id / 7) as bigint) % 2 as token",
    "case when event_id % 13 = 0 then 7200000000 else (event_id % 5) * 900000000 end as ttl",
    "event_id * 6000000 - (event_id % 3) * 1800000000 as progress_at",
]


def _lease_sql() -> str:
    """The scheduler as one recursion over numbered requests: what became of each, then the state after it."""
    fresh = "(status is null and op in ('submit', 'claim'))"
    acquire = "case when ttl <= 0 or ttl > 3600000000 then 'bad_ttl' when status is null and op <> 'claim' then 'missing' when \"at\" < last then 'backdated' when status in ('completed', 'cancelled') then 'terminal' when status = 'proposal_ready' then 'needs_recovery' when until > \"at\" then 'held' when attempts >= max_attempts then 'exhausted' else 'leased' end"
    lease = "when status in ('completed', 'cancelled') then 'terminal' when status not in ('leased', 'proposal_ready') then 'idle' when until <= \"at\" or held_by <> token then 'stale'"
    outcome = (
        "case when op in ('submit', 'claim') and status is not null and (submitter <> owner or terms <> digest or max_attempts <> most) then 'collision' "
        "when op = 'submit' then case when status is null then 'submitted' else 'known' end "
        "when op = 'claim' and status = 'proposal_ready' then 'ready' when op = 'claim' and status = 'completed' then 'done' when op = 'claim' and status = 'cancelled' then 'terminal' "
        f"when op in ('claim', 'acquire') then {acquire} "
        "when op = 'renew' and (ttl <= 0 or ttl > 3600000000) then 'bad_ttl' when status is null then 'missing' when \"at\" < last then 'backdated' "
        "when op = 'cancel' then case when submitter <> owner then 'stale' when status in ('completed', 'cancelled') then 'terminal' else 'cancelled' end "
        "when op = 'complete' then case when status in ('completed', 'cancelled') then 'terminal' when status <> 'proposal_ready' then 'unstaged' when proposal <> digest then 'collision' else 'completed' end "
        f"{lease} "
        "when op = 'renew' then case when \"at\" + ttl <= until then 'not_extended' else 'renewed' end "
        "when op = 'progress' then case when progress_at < progressed then 'regressed' else 'progressed' end "
        "when op = 'propose' then case when proposal <> digest then 'collision' when status = 'proposal_ready' then 'ready' else 'staged' end "
        "else case when attempts >= max_attempts then 'given_up' else 'failed' end end"
    )
    over = "outcome in ('exhausted', 'given_up', 'failed', 'cancelled', 'completed')"
    moved = f"({over} or {fresh} or outcome in ('leased', 'renewed', 'progressed', 'staged'))"
    after = [
        "job", "n", "seq", "op", "outcome",
        f"case when outcome = 'leased' then 'leased' when outcome in ('exhausted', 'given_up', 'cancelled') then 'cancelled' when outcome = 'staged' then 'proposal_ready' when outcome in ('failed', 'completed') then outcome when {fresh} then 'pending' else status end",
        "coalesce(attempts, 0) + case when outcome = 'leased' then 1 else 0 end",
        f"case when {fresh} then most else max_attempts end",
        f"case when {fresh} then owner else submitter end",
        f"case when {fresh} then digest else terms end",
        f"case when {moved} then \"at\" else last end",
        f"case when {over} then null when outcome = 'leased' then token else held_by end",
        f"case when {over} then null when outcome in ('leased', 'renewed') then \"at\" + ttl else until end",
        "case when outcome = 'staged' then digest else proposal end",
        f"case when {fresh} then \"at\" when outcome = 'progressed' then progress_at else progressed end",
    ]
    none = ", ".join(f"null::{t}" for t in ("bigint", "varchar", "varchar", "varchar", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint", "bigint"))
    names = "job, n, seq, op, outcome, status, attempts, max_attempts, submitter, terms, last, held_by, until, proposal, progressed"
    both = "select f.status, f.attempts, f.max_attempts, f.submitter, f.terms, f.last, f.held_by, f.until, f.proposal, f.progressed, r.* from f join r on r.job = f.job and r.n = f.n + 1"
    return (
        f"with recursive q as (select {', '.join(_ASKED)} from events), r as (select *, row_number() over (partition by job order by seq) as n from q), "
        f"f({names}) as (select distinct job, 0::bigint, {none} from r union all select {', '.join(after)} from (select *, {outcome} as outcome from ({both})))"
        " select seq, job, op, outcome from f where n > 0"
    )


@query(_lease_sql())
def job_leases(s, d):
    """Requests to the scheduler, what became of each."""
    rows = table(s, d, "events").selectExpr(*_ASKED)
    return stateful.fold(rows, "job", "seq", scheduler.step, "outcome string").select("seq", "job", "op", "outcome")


# Tombstones, migration, evaluation, proofs

_RELATIONS = "concat('ord-', lpad(cast(l_orderkey as string), 10, '0')) as fact_id", "concat('part:', l_partkey) as src", "'supplied_by' as rel", "concat('supplier:', l_suppkey) as dst"
_RELATED = f"l as (select {', '.join(_RELATIONS)} from lineitem)"
_GONE = "g as (select id from statements where cast(substr(id, 5) as bigint) % 50 = 1)"


def _gone(s, d):
    return view(s, d, "statements").select("id").where("cast(substr(id, 5) as bigint) % 50 = 1")


@query(with_views(f", {_RELATED}, {_GONE}, n as (select 'records' as what, count(*) as n from statements where id not in (from g) union all select 'mentions', count(*) from mentions where record_id not in (from g) union all select 'relations', count(*) from l where fact_id not in (from g)) select what, n from n", "statements", "mentions"))
def tombstone_incident(s, d):
    """What is left of records, mentions and relations once some records are gone."""
    relations = table(s, d, "lineitem").selectExpr(*_RELATIONS)
    left = graph.tombstoned(view(s, d, "statements"), view(s, d, "mentions"), relations, _gone(s, d))
    counts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, x in zip(("records", "mentions", "relations"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(with_views(f", {_RELATED}, a as (select 'assertion:' || substr(sha256(src || '|' || rel || '|' || dst), 1, 32) as assertion_id, src as subject, rel as predicate, dst as object, min(fact_id) as fact_id from l group by src, rel, dst) select a.*, valid_from::varchar as valid_from from a join statements on id = fact_id where substr(assertion_id, 11, 1) <> '0'", "statements"))
def legacy_migration_sources(s, d):
    edges = table(s, d, "lineitem").selectExpr(*_RELATIONS)
    there = graph.assertions_of(edges).where("substr(assertion_id, 11, 1) = '0'")
    return graph.migration(edges, view(s, d, "statements"), there).withColumn("valid_from", F.col("valid_from").cast("string"))


_OUTCOMES = "concat('case-', doc_id) as case_id", "concat('category-', doc_id % 4) as category", "quality = 1 as correct"
_GATE_OF, _GATE_OF_CASE = {"category-0": "disclosure", "category-1": "replay", "category-2": "determinism"}, {f"case-{i}": "leakage" for i in range(0, 60, 3)}
_GATE_SQL = "coalesce(" + ", ".join("case " + " ".join(f"when {c} = '{k}' then '{g}'" for k, g in m.items()) + " end" for c, m in (("case_id", _GATE_OF_CASE), ("category", _GATE_OF))) + ")"


@query(f"with o as (select {', '.join(_OUTCOMES)} from labels), f as (select {_GATE_SQL} as gate from o where not correct), g as (select unnest(['leakage', 'disclosure', 'replay', 'determinism', 'residue']) as gate) select g.gate, count(f.gate) + case when g.gate = 'determinism' then 2 else 0 end as failures from g left join f on f.gate = g.gate group by g.gate")
def hard_gates_by_case(s, d):
    return evaluate.case_gates(table(s, d, "labels").selectExpr(*_OUTCOMES), _GATE_OF, _GATE_OF_CASE, ["leakage", *_GATE_OF.values(), "residue"], ("determinism", 2))


_RIGHT = "allowed = wanted and (len(expected) = 0 or list_slice(ids, 1, len(expected)) = expected) and (not abstain or len(ids) = 0) and not list_has_any(ids, forbidden)"


@query(f"with c as (select o_orderkey as case_id, o_orderkey % 4 <> 3 as wanted, case when o_orderkey % 3 = 0 then [] else ['m' || o_custkey % 3] end as expected, ['m' || o_custkey % 5] as forbidden, o_orderkey % 7 = 0 as abstain, o_orderkey % 8 <> 7 as allowed, case when o_orderkey % 5 = 0 then [] else ['m' || o_custkey % 3, 'm' || o_orderkey % 4] end as ids from orders) select 'case-' || case_id as case_id, case_id % 11 <> 0 and {_RIGHT} as correct from c")
def case_outcomes(s, d):
    """Decisions held against their cases; some cases have none."""
    rows = table(s, d, "orders").withColumn("case_id", F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")))
    none = "cast(array() as array<string>)"
    cases = rows.selectExpr("case_id", "o_orderkey % 4 <> 3 as expected_allowed", f"if(o_orderkey % 3 = 0, {none}, array(concat('m', o_custkey % 3))) as expected_ids", "array(concat('m', o_custkey % 5)) as forbidden_ids", "o_orderkey % 7 = 0 as must_abstain")
    decisions = rows.where("o_orderkey % 11 <> 0").selectExpr("case_id", "o_orderkey % 8 <> 7 as allowed", f"if(o_orderkey % 5 = 0, {none}, array(concat('m', o_custkey % 3), concat('m', o_orderkey % 4))) as ids")
    return evaluate.judged(cases, decisions)


_PROOF = {
    "catalog": "case when c_custkey % 6 = 0 then 'other' else 'main' end",
    "warehouse": "c_mktsegment",
    "table": "case when c_custkey % 10 = 0 then repeat('x', 600) else c_name end",
    "snapshot_id": "c_custkey",
    "grant_id": "case when c_custkey % 9 = 0 then '' else md5(cast(c_custkey as string)) end",
    "snapshot_digest": "md5(c_name)",
    "plan_task_digest": "md5(c_mktsegment)",
    "subject": "concat('subject-', c_nationkey)",
    "purpose": "case when c_custkey % 14 <> 0 then 'audit' end",
}
_SOURCE = " || ".join(f"{c}::varchar || chr(0)" for c in ("snapshot_digest", "grant_id", "catalog", "space", '"table"', "snapshot_id", "plan_task_digest", "subject", "purpose"))


@query(
    "with p as (select c_custkey, " + ", ".join(f'{v} as "{k}"' for k, v in _PROOF.items()) + ", 'n' || c_nationkey || '.prices' as space from customer), "
    "v as (select *, case when catalog <> 'main' then 'catalog_mismatch' when grant_id = '' or purpose is null or strlen(warehouse || '.' || space || '.' || \"table\") > 512 then 'invalid' else 'accepted' end as verdict from p) "
    f"select c_custkey, verdict, case when verdict = 'accepted' then space end as namespace, case when verdict = 'accepted' then 'sha256:' || sha256('governed-source.v1' || chr(0) || {_SOURCE} || 'id' || chr(0) || 'text' || chr(0)) end as source_digest from v"
)
def catalog_proofs(s, d):
    rows = table(s, d, "customer").selectExpr("c_custkey", *[f"{v} as `{k}`" for k, v in _PROOF.items()], "array(concat('n', c_nationkey), 'prices') as namespace")
    return governed.sources_of(rows, "main", ["id", "text"]).select("c_custkey", "verdict", "namespace", "source_digest")


@query(with_views(" select 'cases' as name, 'normalized' as status, count(*) as cases from memories union all select 'broken', 'error', 0 union all select 'absent', 'unavailable', 0", "memories"))
def corpus_inventory(s, d):
    """A corpus that can be read, one that can't and one that has no path."""
    path = scratch.folder(s, "corpus")
    rows = view(s, d, "memories").select(F.col("id").alias("case_id"), F.lit("what").alias("query"), F.lit("2024-01-01").alias("as_of"), F.array("id").alias("expected_ids"))
    rows.write.json(path)
    found = files.inventory(s, {"cases": (path, files.cases), "broken": (f"{path}-missing", files.cases), "absent": (None, files.cases)})
    return s.createDataFrame([(x["name"], x["status"], x.get("cases", 0)) for x in found], "name string, status string, cases long")


# Scans, candidates, codecs


@query(with_views(" select src, dst from rel_edges where rel = 'based_in' and dst = 'nation:3'", "rel_edges"))
def edge_scan(s, d):
    return graph.edges_of(view(s, d, "rel_edges"), "based_in", end="nation:3").select("src", "dst")


@query(with_views(" select id, valid_from::varchar as valid_from from memories where kind = 'semantic' and space_id = 'space-src3' and label = 1", "memories"))
def property_scan(s, d):
    return graph.nodes_of(view(s, d, "memories"), kind="semantic", space_id="space-src3", label=1).select("id", F.col("valid_from").cast("string").alias("valid_from"))


@query(with_views(STATE + f", va as (select assertion_id, min(changed_at) as valid_from from transitions group by assertion_id) select assertion_id, state, valid_from::date::varchar as valid_from from st join va using (assertion_id) where state in ('current', 'disputed') and valid_from <= date '{STATES_AT}' and date '{STATES_AT}' < valid_from + interval 3 year", "transitions"))
def assertion_valid_candidates(s, d):
    first = view(s, d, "transitions").groupBy("assertion_id").agg(F.min("changed_at").alias("valid_from"))
    found = temporal.candidates(states(s, d), first.withColumn("valid_to", F.add_months("valid_from", 36)), "assertion_id", ["current", "disputed"], day(STATES_AT))
    return found.withColumn("valid_from", F.col("valid_from").cast("date").cast("string"))


@query(
    "with e as (select event_id, case when event_id % 4 = 0 then 'acked' else 'pending' end as status, event_id % 3 <> 0 as leased, event_id % 50 as start, event_id % 50 + event_id % 20 as stop from events) "
    "select event_id, case status when 'acked' then 'acked' else case when leased then case when start > 25 then 'backdated' when stop <= 25 then 'claimable' else 'leased' end else 'claimable' end end as claim from e"
)
def outbox_claim_states(s, d):
    lease = lambda c: F.when(F.col("event_id") % 3 != 0, c)
    start = F.col("event_id") % 50
    rows = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "acked").otherwise("pending").alias("status"), lease(start).alias("leased_at"), lease(start + F.col("event_id") % 20).alias("lease_expiry"))
    return rows.select("event_id", outbox.claim_state(F.lit(25)).alias("claim"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' as at, case when event_id % 2 = 0 then u end as uuid from (select *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) as u from (select *, md5(event_id::varchar) as h from events))")
def canonical_times_and_ids(s, d):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    u = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    # Every other one lacks its last hyphen.
    u = F.when(F.col("event_id") % 2 == 0, u).otherwise(F.concat(F.substring(u, 1, 23), F.substring(u, 25, 12)))
    return table(s, d, "events").select("event_id", text.rfc3339(F.col("ts")).alias("at"), text.uuid_canonical(u).alias("uuid"))


@query(with_views(" select id, label, md5('{' || '\"id\":\"' || id || '\",' || '\"invalid_at\":' || '\"' || invalid_at::varchar || '\",' || '\"label\":' || label || ',' || '\"space_id\":\"' || space_id || '\"}') as digest from memories where invalid_at is not null union all select id, label, md5('{' || '\"id\":\"' || id || '\",' || '\"label\":' || label || ',' || '\"space_id\":\"' || space_id || '\"}') from memories where invalid_at is null", "memories"))
def record_codec(s, d):
    """Records as JSON of sorted keys and back."""
    names = ["space_id", "id", "label", "invalid_at"]
    coded = view(s, d, "memories").select(*names).select(text.encoded(names).alias("json"))
    back = coded.select("json", text.decoded(F.col("json"), "id string, invalid_at date, label int, space_id string").alias("r"))
    return back.select("r.id", "r.label", F.md5(F.col("json").cast("binary")).alias("digest"))
