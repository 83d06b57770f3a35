"""Queries by name and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.functions import digest, text
from memoryloom.operators import consolidate, context, evaluate, gate, graph, ledger, ops, rank, stateful, temporal
from memoryloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from memoryloom.sources.views import table, view, with_views


#: Parameters of the queries, the same in both forms.
AS_OF, NOW, STATES_AT = "2024-06-01", "2025-01-01", "1998-06-01"
LEXICAL = "than the with"
BUDGET = 64_000


def day(x: str):
    return F.lit(x).cast("date")


def documents(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "memories").select("id", "text", "valid_from", "label")


NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
N_MEM = f", n as (select id, valid_from, text, label, {NORM} as normalized from memories) "
PARTS = f", st as (select id, valid_from, regexp_extract({NORM}, '^(.*) ([^ ]*)$', 1) as prefix, regexp_extract({NORM}, '^(.*) ([^ ]*)$', 2) as tail from statements) "
LATER = "(a.valid_from > b.valid_from or (a.valid_from = b.valid_from and a.id > b.id))"
PAIRS = f"select a.id as newer, b.id as older from st a join st b on a.prefix = b.prefix and a.tail <> b.tail and {LATER} where a.prefix <> ''"

# Consolidation


@query(with_views(N_MEM + "select id, md5(normalized) as digest, rank from (select *, row_number() over (partition by normalized order by valid_from, id) as rank, count(*) over (partition by normalized) as n from n) where n > 1", "memories"))
def dedup_rows(s, d):
    out = consolidate.duplicate_rows(documents(s, d))
    return out.select("id", F.md5(F.col("normalized").cast("binary")).alias("digest"), F.col("rank").cast("long").alias("rank"))


@query(with_views(N_MEM + "select arg_min(id, row(valid_from, id)) as canonical_id, md5(arg_min(text, row(valid_from, id))) as text_md5, min(valid_from)::varchar as valid_from, string_agg(id, ',' order by valid_from, id) as superseded, count(*) as n from n group by normalized having count(*) > 1", "memories"))
def dedup_groups(s, d):
    out = consolidate.duplicate_plan(documents(s, d))
    return out.select("canonical_id", F.md5(F.col("canonical_text").cast("binary")).alias("text_md5"), F.col("valid_from").cast("string").alias("valid_from"), "superseded", "n")


_HAVING = "select id from {n} where normalized in (select normalized from {n} group by normalized having count(*) > 1)"


@query(with_views(N_MEM + _HAVING.format(n="n"), "memories"))
def dedup_having_in(s, d):
    # The digest stands for the text, so no whole text is a key.
    with ledger.temp_view(documents(s, d).select("id", F.sha2(text.normalized(F.col("text")), 256).alias("normalized"))) as name:
        return s.sql(_HAVING.format(n=name))


@query(with_views(PARTS + PAIRS, "statements"))
def contradiction_pairs(s, d):
    return consolidate.contradictions(view(s, d, "statements"))


@query(with_views(PARTS + f"select distinct older from ({PAIRS})", "statements"))
def reconcile_invalidate(s, d):
    return consolidate.invalidated(view(s, d, "statements")).distinct()


@query(with_views(PARTS + f", o as (select count(distinct older) as invalidated from ({PAIRS})) select invalidated, (select max(label) from memories) as label, case when invalidated = 0 then 'no_change' else 'mutated' end as effect from o", "statements", "memories"))
def consolidation_counts(s, d):
    n = consolidate.invalidated(view(s, d, "statements")).distinct().agg(F.count(F.lit(1)).alias("invalidated"))
    return n.crossJoin(consolidate.joined_label(view(s, d, "memories"))).withColumn("effect", consolidate.effect(F.col("invalidated")))  # one row each


# Stores, time and visibility


@query(with_views(f" select id, kind, valid_from::varchar as valid_from from memories where space_id = 'space-src1' and (invalid_at is null or invalid_at > date '{AS_OF}') order by valid_from desc, id desc limit 50", "memories"))
def store_query_space(s, d):
    rows = view(s, d, "memories").where((F.col("space_id") == "space-src1") & (F.col("invalid_at").isNull() | (F.col("invalid_at") > day(AS_OF))))
    return rows.select("id", "kind", "valid_from").orderBy(F.desc("valid_from"), F.desc("id")).limit(50).withColumn("valid_from", F.col("valid_from").cast("string"))


@query(with_views(f" select id from memories where valid_from <= date '{AS_OF}' and (invalid_at is null or date '{AS_OF}' < invalid_at)", "memories"))
def validity_as_of(s, d):
    return view(s, d, "memories").where(temporal.valid_at(day(AS_OF))).select("id")


TIE = "row(changed_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
STATE = f", st as (select assertion_id, coalesce(arg_max(to_state, {TIE}) filter (where changed_at <= timestamp '{STATES_AT}'), 'proposed') as state from transitions group by assertion_id) "


def states(s, d):
    return temporal.state_at(view(s, d, "transitions"), F.lit(STATES_AT).cast("timestamp_ntz"))


@query(with_views(STATE + "select * from st", "transitions"))
def assertion_state_at(s, d):
    return states(s, d)


@query(with_views(STATE + "select assertion_id from st where state = 'current'", "transitions"))
def assertion_current_at(s, d):
    return states(s, d).where("state = 'current'").select("assertion_id")


@query(with_views(STATE + "select * from st where state in ('disputed', 'proposed')", "transitions"))
def assertion_states_in(s, d):
    return temporal.states_in(states(s, d), ["disputed", "proposed"])


MOVES = ", ".join(f"'{a}>{b}'" for a, to in temporal.LEGAL.items() for b in to)
STEPS = ", s as (select *, lag(to_state, 1, 'proposed') over w as from_state, row_number() over w as ordinal from transitions window w as (partition by assertion_id order by changed_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) "


@query(with_views(STEPS + f"select assertion_id, ordinal, from_state, to_state from s where from_state || '>' || to_state not in ({MOVES})", "transitions"))
def transition_violations(s, d):
    out = temporal.illegal(view(s, d, "transitions"))
    return out.select("assertion_id", F.col("ordinal").cast("long").alias("ordinal"), "from_state", "to_state")


SPLIT = f", g as (select id, kind, case when label <= 1 then 'visible' else 'redacted' end as visibility, case when label <= 1 then text end as text from memories where purpose = 'research' and not quarantined and valid_from <= date '{AS_OF}' and (invalid_at is null or date '{AS_OF}' < invalid_at)) "


def gated(s, d):
    return gate.split(view(s, d, "memories"), day(AS_OF), gate.INTERNAL, "research")


@query(with_views(SPLIT + "select id, kind, visibility, md5(text) as text_md5 from g", "memories"))
def visibility_split(s, d):
    return gated(s, d).select("id", "kind", "visibility", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(with_views(" select id, label from memories where label <= 1", "memories"))
def embed_gate(s, d):
    return view(s, d, "memories").where(gate.may_embed(local=False)).select("id", "label")


# Ranking

TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
OVERLAP = f"len(list_intersect({TOKENS}, ['than', 'the', 'with']))"


@query(with_views(f", r as (select id, {OVERLAP} as overlap from memories) select * from r where overlap > 0", "memories"))
def lexical_rank(s, d):
    return rank.lexical(view(s, d, "memories"), LEXICAL).select("id", "overlap")


@query(with_views(f", r as (select id, {OVERLAP} as overlap from g where visibility = 'visible')" .replace(", r", SPLIT + ", r", 1) + " select id, overlap, row_number() over (order by overlap desc, id) as position from r where overlap > 0", "memories"))
def lexical_gated_rank(s, d):
    hits = rank.lexical(gated(s, d).where("visibility = 'visible'"), LEXICAL).select("id", "overlap")
    return rank.positions(hits, "overlap")


@query(with_views(f", r as (select unnest({TOKENS}) as token, id from memories) select id, count(*) as overlap from r where token in ('than', 'the', 'with') group by id", "memories"))
def inverted_index_probe(s, d):
    return rank.probe(rank.postings(view(s, d, "memories")), LEXICAL)


@query(with_views(f" select count(*) as n from memories where len(list_intersect({TOKENS}, ['zzqx', 'qqzx'])) > 0", "memories"))
def abstain_unknown(s, d):
    return rank.lexical(view(s, d, "memories"), "zzqx qqzx").agg(F.count(F.lit(1)).alias("n"))


COSINE = ", q as (select embedding as e from vectors where id = 'vec-00000000'), c as (select id, entity_a, list_cosine_similarity(cast(embedding as double[]), cast(e as double[])) as s from vectors, q where label <= 1) "


def scored(s, d):
    v = view(s, d, "vectors")
    first = v.where("id = 'vec-00000000'").select("embedding").first()
    return v.where(gate.may_embed(local=False)), [float(x) for x in first.embedding] if first else [0.0]


@query(with_views(COSINE + "select id, round(s, 9) as score from c where s > 0 order by s desc, id limit 10", "vectors"))
def vector_topk(s, d):
    rows, q = scored(s, d)
    return rank.top(rows, rank.cosine(F.col("embedding"), q), 10).select("id", F.round("score", 9).alias("score"))


@query(with_views(COSINE + ", h as (select id, s + case when entity_a = 'entity-0' then 0.1::double else 0 end as s from c) select id, round(s, 9) as score from h where s > 0 order by s desc, id limit 100", "vectors"))
def vector_hybrid_topk(s, d):
    rows, q = scored(s, d)
    boost = F.arrays_overlap(F.array("entity_a", "entity_b"), F.array(F.lit("entity-0")))
    return rank.top(rows, rank.cosine(F.col("embedding"), q), 100, boost).select("id", F.round("score", 9).alias("score"))


@query(with_views(f" select id, round(case kind when 'profile' then 1.0::double when 'semantic' then 0.8 when 'procedural' then 0.7 else 0.4 end / (1 + greatest(0, date_diff('day', valid_from, date '{NOW}')) / 30::double), 9) as importance from memories", "memories"))
def importance_rank(s, d):
    score = rank.importance(F.col("valid_from"), day(NOW), F.col("kind"))
    return view(s, d, "memories").select("id", F.round(score, 9).alias("importance"))


# Graph

REACH = (
    ", b as (select src, dst from rel_edges union select dst, src from rel_edges)"
    ", walk as (select 'region:0' as node, 0 as hop union select b.dst, walk.hop + 1 from walk join b on walk.node = b.src where walk.hop < {hops})"
    ", reach as (select node, min(hop) as hop from walk group by node) "
)


@query(with_views(REACH.format(hops=3) + "select * from reach", "rel_edges", recursive=True))
def khop_reach(s, d):
    return graph.reach(view(s, d, "rel_edges"), "region:0", 3)


@query(with_views(REACH.format(hops=2) + "select record_id, min(hop) as hop from mentions join reach on entity = node group by record_id", "rel_edges", "mentions", recursive=True))
def neighborhood_records(s, d):
    return graph.neighborhood(view(s, d, "rel_edges"), view(s, d, "mentions"), "region:0", 2)


ASSERTION = ", a as (select distinct 'assertion:' || substr(sha256(src || '|' || rel || '|' || dst), 1, 32) as assertion_id, src as subject, rel as predicate, dst as object from rel_edges) "


@query(with_views(ASSERTION + "select * from a where subject not like 'customer:%' or substr(subject, 10)::int % 3 <> 0", "rel_edges"))
def legacy_migration(s, d):
    edges = view(s, d, "rel_edges")
    there = graph.assertions_of(edges.where("src like 'customer:%' and try_cast(substr(src, 10) as int) % 3 = 0"))
    return graph.migrate(edges, there)


@query(with_views(", r as (select *, row_number() over (partition by l_partkey order by changed_at desc, assertion_id, l_linenumber, l_suppkey, l_extendedprice) as k from transitions where to_state = 'current') select l_partkey as source_id, assertion_id, changed_at from r where k = 1", "transitions"))
def assertion_candidates(s, d):
    rows = view(s, d, "transitions").where("to_state = 'current'")
    order = F.struct((-F.unix_micros(F.col("changed_at").cast("timestamp"))).alias("t"), "assertion_id", "l_linenumber", "l_suppkey", "l_extendedprice")
    return graph.first_seen(rows, "l_partkey", order).select(F.col("l_partkey").alias("source_id"), "assertion_id", "changed_at")


@query(with_views(" select (select count(*) from mentions where record_id <> 'ord-0000000007') as mentions_left, (select count(*) from rel_edges where src <> 'customer:7') as edges_left", "mentions", "rel_edges"))
def tombstone_effect(s, d):
    gone = s.createDataFrame([("ord-0000000007", "customer:7")], "record_id string, src string")
    left = graph.without(view(s, d, "mentions"), gone, "record_id").agg(F.count(F.lit(1)).alias("mentions_left"))
    return left.crossJoin(graph.without(view(s, d, "rel_edges"), gone, "src").agg(F.count(F.lit(1)).alias("edges_left")))  # one row each


@query(with_views(", r as (select id, doc_id, case when doc_id % 10 = 1 then 'doc-' || lpad((doc_id - 1)::varchar, 8, '0') end as parent from memories) select id from r where parent in (select id from r where doc_id % 20 = 0)", "memories"))
def derived_cascade(s, d):
    rows = view(s, d, "memories").select("id", "doc_id", F.when(F.col("doc_id") % 10 == 1, F.array(F.concat(F.lit("doc-"), F.lpad((F.col("doc_id") - 1).cast("string"), 8, "0")))).alias("derived_from"))
    forgotten = rows.where("doc_id % 20 = 0").select(F.col("id").alias("parent"))
    return rows.select("id", F.explode("derived_from").alias("parent")).join(forgotten, "parent", "left_semi").select("id").distinct()


# Context

ORDER = "order by pinned desc, score_bp desc, id"
GREEDY = (
    ", o as (select *, row_number() over (" + ORDER + ") as k from candidates)"
    f", f as (select 0::bigint as k, null::bigint as id, 0::bigint as used, false as keep union all select o.k, o.id, case when f.used + o.tokens <= {BUDGET} then f.used + o.tokens else f.used end, f.used + o.tokens <= {BUDGET} from f join o on o.k = f.k + 1)"
    ", p as (select c.* from candidates c join f on c.id = f.id where f.keep) "
)


def planned(s, d):
    return context.greedy(view(s, d, "candidates"), BUDGET)


@query(with_views(f" select id, pinned, score_bp, row_number() over ({ORDER}) as position from candidates", "candidates"))
def context_order(s, d):
    rows = view(s, d, "candidates")
    return rows.select("id", "pinned", "score_bp").join(context.positions(rows), "id")


@query(with_views(GREEDY + "select id, score_bp, tokens, pinned from p", "candidates", recursive=True))
def context_greedy_plan(s, d):
    return planned(s, d).select("id", "score_bp", "tokens", "pinned")


@query(with_views(GREEDY + SPLIT + "select g.id, g.visibility, p.tokens from p join g on g.id = 'doc-' || lpad(p.id::varchar, 8, '0')", "candidates", "memories", recursive=True))
def context_bundle(s, d):
    plan = planned(s, d).select(F.concat(F.lit("doc-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"), "tokens")
    return context.bundle(plan, gated(s, d)).select("id", "visibility", "tokens")


KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(context.KINDS))


@query(with_views(SPLIT + f", k as (select * from (values {KINDS}) t(ordinal, kind)) select ordinal, k.kind, count(g.id) filter (where visibility = 'visible') as n from k left join g on k.kind = g.kind group by all", "memories"))
def context_sections(s, d):
    return context.sections(gated(s, d))


@query(with_views(SPLIT + "select id, kind, visibility = 'redacted' as redacted from g", "memories"))
def context_citations(s, d):
    return context.citations(gated(s, d))


@query(with_views(GREEDY + "select (select count(*) from candidates) as considered, count(*) as selected, sum(tokens)::bigint as tokens, count(*) < (select count(*) from candidates) as truncated from p", "candidates", recursive=True))
def context_explanation(s, d):
    return context.explanation(view(s, d, "candidates"), planned(s, d))


def _xml(x):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{raw}', '{entity}')"
    return x


@query(with_views(SPLIT + f"""select id, md5(case when visibility = 'visible' then '<memory id="' || {_xml('id')} || '">' || {_xml('text')} || '</memory>' else '<redacted id="' || {_xml('id')} || '"/>' end) as xml_md5 from g""", "memories"))
def context_render_xml(s, d):
    return context.xml_rows(gated(s, d)).select("id", F.md5(F.col("xml").cast("binary")).alias("xml_md5"))


@query(with_views(SPLIT + "select id, md5('[' || id || '] ' || coalesce(text, '<redacted>')) as line_md5 from g", "memories"))
def context_render_text(s, d):
    return context.text_lines(gated(s, d)).select("id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


# Evaluation: a case per source, its items the candidates of high score

CASES = (
    ", cases as (select source as case_id, l.doc_id as id, quality = 1 as expected, toxic = 1 as forbidden from labels l join documents d on d.doc_id = l.doc_id)"
    ", items as (select source as case_id, c.id, c.tokens, 200000 as budget from candidates c join documents d on d.doc_id = c.id where c.score_bp >= 7000)"
    ", got as (select i.case_id, count(*) as selected, count(*) filter (where expected) as hits, count(*) filter (where forbidden) as forbidden_hits, sum(tokens)::bigint as tokens, max(budget)::bigint as budget from items i left join cases using (case_id, id) group by i.case_id)"
    ", want as (select case_id, count(*) filter (where expected) as expected_n from cases group by case_id)"
    ", rep as (select case_id, coalesce(selected, 0) as selected, coalesce(hits, 0) as hits, coalesce(forbidden_hits, 0) as forbidden_hits"
    ", case when coalesce(selected, 0) = 0 then 0 else least(10000, hits * 10000 // selected) end as precision_bp"
    ", case when expected_n = 0 then 0 else least(10000, coalesce(hits, 0) * 10000 // expected_n) end as recall_bp"
    ", case when coalesce(budget, 0) = 0 then 0 else least(10000, tokens * 10000 // budget) end as tokens_bp"
    ", coalesce(forbidden_hits, 0) = 0 as passed from want left join got using (case_id)) "
)


def report(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("case_id"))
    cases = table(s, d, "labels").join(docs, "doc_id").select("case_id", F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("forbidden"))
    items = view(s, d, "candidates").where("score_bp >= 7000").join(docs, F.col("id") == F.col("doc_id")).select("case_id", "id", "tokens", F.lit(200_000).alias("budget"))
    return evaluate.case_report(cases, items)


@query(with_views(CASES + "select * from rep", "candidates"))
def eval_case_report(s, d):
    return report(s, d)


@query(with_views(CASES + "select count(*) as cases, count(*) filter (where forbidden_hits > 0) as leaking, (sum(precision_bp) // count(*))::bigint as mean_precision_bp, (sum(recall_bp) // count(*))::bigint as mean_recall_bp, bool_and(passed) as all_passed from rep", "candidates"))
def eval_corpus_summary(s, d):
    return evaluate.corpus_summary(report(s, d))


OUTCOMES = ", o as (select 'category-' || (doc_id % 6) as category, quality = 1 as correct, doc_id % 7 <> 0 as supported, doc_id % 5 = 0 as abstain, toxic = 1 as answered from labels) "


def outcomes(s, d):
    return table(s, d, "labels").select(F.concat(F.lit("category-"), (F.col("doc_id") % 6).cast("string")).alias("category"), (F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 7 != 0).alias("supported"), (F.col("doc_id") % 5 == 0).alias("abstain"), (F.col("toxic") == 1).alias("answered"))


@query("with" + OUTCOMES[1:] + "select category, round(avg(correct::int) filter (where supported), 9) as accuracy, count(*) filter (where not supported) as unsupported, round(avg(answered::int) filter (where abstain), 9) as unsupported_answers from o group by category")
def category_accuracy(s, d):
    return evaluate.category_accuracy(outcomes(s, d))


GATES = {f"category-{i}": g for i, g in enumerate(["tenancy", "clearance", "temporal", "replay", "forget", "injection"])}


@query("with" + OUTCOMES[1:] + ", g as (select * from (values " + ", ".join(f"('{c}', '{g}')" for c, g in GATES.items()) + ", (null, 'receipt')) t(category, gate)) select gate, count(o.category) filter (where not correct) as failures from g left join o on o.category = g.category group by gate")
def hard_gates(s, d):
    return evaluate.hard_gates(outcomes(s, d), GATES, [*GATES.values(), "receipt"])


@query("with e as (select *, cast(round(value * 1000) as bigint) as us from events), r as (select us, row_number() over (order by us) - 1 as k from e), n as (select count(*) as n from e) select round(avg((event_id % 10 <> 0)::int), 9) as accuracy, count(*) filter (where event_type = 'error' and event_id % 10 = 0) as leaks, round(median(us), 9) as p50, (select us from r, n where k = cast(round_even(0.95 * (n - 1), 0) as bigint)) as p95, (select us from r, n where k = cast(round_even(0.99 * (n - 1), 0) as bigint)) as p99 from e")
def smoke_summary(s, d):
    e = table(s, d, "events").withColumn("us", F.round(F.col("value") * 1000).cast("long"))
    whole = e.agg(F.round(F.avg((F.col("event_id") % 10 != 0).cast("int")), 9).alias("accuracy"), F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)).alias("leaks"))
    at = evaluate.index_percentiles(e, "us", [95, 99], "p50").withColumn("p50", F.round("p50", 9))
    return whole.crossJoin(at)  # one row each


# Operations


@query(with_views(" select operation, count(*) as count, count(*) filter (where not allowed) as denials, sum(latency_micros)::bigint as total_micros, max(latency_micros) as max_micros from op_samples group by operation", "op_samples"))
def op_metrics(s, d):
    return ops.metrics(view(s, d, "op_samples")).withColumn("total_micros", F.col("total_micros").cast("long"))


@query(with_views(" select operation, count(*) as requests, sum(latency_micros)::bigint as micros, (count(*) * 7 + sum(latency_micros) * 3)::bigint as microcredits from op_samples group by operation", "op_samples"))
def op_cost(s, d):
    out = ops.cost(view(s, d, "op_samples"), {"requests": F.lit(1), "micros": F.col("latency_micros")}, {"requests": 7, "micros": 3})
    return out.select("operation", *[F.col(c).cast("long").alias(c) for c in ("requests", "micros", "microcredits")])


@query(with_views(" select operation, quantile_disc(latency_micros, 0.5)::bigint as p50, quantile_disc(latency_micros, 0.95)::bigint as p95, quantile_disc(latency_micros, 0.99)::bigint as p99 from op_samples group by operation", "op_samples"))
def op_latency_percentiles(s, d):
    return ops.percentiles(view(s, d, "op_samples"))


@query(with_views(", o as (select * from (values " + ", ".join(f"('{x}')" for x in ops.OPERATIONS) + ") t(operation)), m as (select operation, count(*) as n, count(*) filter (where not allowed) as den, max(latency_micros) as mx from op_samples group by operation) select o.operation, n is not null as observed, case when n is null then 0 else least(10000, (den * 10000 + n - 1) // n) end as denial_bp, n is null or (mx <= 400000 and (den * 10000 + n - 1) // n <= 1000) as compliant from o left join m using (operation)", "op_samples"))
def op_slo(s, d):
    return ops.service_levels(view(s, d, "op_samples"), 400_000, 1000)


LINEAGE = ", ".join(f"({i}, '{k}')" for i, k in enumerate(ops.LINEAGE))


@query(f"with k as (select * from (values {LINEAGE}) t(i, kind)) select o_orderkey, a.i as ordinal, a.kind as from_kind, b.kind as to_kind, substr(sha256(a.kind || ':' || o_orderkey), 1, 16) as from_digest, substr(sha256(b.kind || ':' || o_orderkey), 1, 16) as to_digest from orders, k a join k b on b.i = a.i + 1")
def lineage_edges(s, d):
    return ops.lineage_edges(table(s, d, "orders"), "o_orderkey")


def _tagged(*values: str) -> str:
    parts = ["encode('audit-export.v1')", "'\\x00'::blob"]
    for v in values:
        parts += [f"unhex(lpad(printf('%x', octet_length(encode({v}))), 16, '0'))", f"encode({v})"]
    return "'sha256:' || sha256(" + " || ".join(parts) + ")"


@query(f"select o_orderkey, {_tagged('o_custkey::varchar')} as subject_digest, {_tagged('o_custkey::varchar', 'o_orderstatus')} as decision_digest from orders")
def audit_export(s, d):
    return ops.audit_export(table(s, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")


# A set is digested by buckets of its ids, so no task gathers all of it.
@query(with_views(", b as (select label, substr(sha256(id), 1, 2) as bucket, sha256(string_agg(id, '' order by id)) as x, count(*) as c from vectors group by all) select label, sha256(string_agg(x, '' order by bucket)) as digest, sum(c)::bigint as n from b group by label", "vectors"))
def manifest_digest(s, d):
    rows = view(s, d, "vectors").select("id", "label", F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 2).alias("bucket"))
    b = rows.groupBy("label", "bucket").agg(digest.of_set(F.col("id")).alias("x"), F.count(F.lit(1)).alias("c"))
    return b.groupBy("label").agg(digest.of_buckets(F.col("x"), F.col("bucket")).alias("digest"), F.sum("c").alias("n"))


# Ledger


@query(with_views(" select did, arg_max(verb, seq) as op, max(seq) as seq from requests group by did having arg_max(verb, seq) <> 'error'", "requests"))
def manifest_repair(s, d):
    last = ledger.latest(view(s, d, "requests"), "did", F.col("seq"))
    return last.where("verb <> 'error'").select("did", F.col("verb").alias("op"), "seq")


@query(with_views(", e as (select id, case when doc_id % 50 = 0 then 'changed' else md5(text) end as x from memories where doc_id % 70 <> 0), a as (select id, md5(text) as y from memories) select coalesce(e.id, a.id) as id, e.x as expected_digest, a.y as actual_digest from e full join a on e.id = a.id where e.x is distinct from a.y", "memories"))
def stale_sources(s, d):
    m = view(s, d, "memories")
    actual = m.select("id", F.md5(F.col("text").cast("binary")).alias("digest"))
    expected = m.where("doc_id % 70 <> 0").select("id", F.when(F.col("doc_id") % 50 == 0, "changed").otherwise(F.md5(F.col("text").cast("binary"))).alias("digest"))
    return ledger.stale(expected, actual, "id", "digest")


@query(with_views(" select entity, count(distinct entity_kind) as kinds from mentions group by entity having count(distinct entity_kind) > 1", "mentions"))
def entity_conflicts(s, d):
    return ledger.kind_conflicts(view(s, d, "mentions"))


@query(with_views(PARTS + f", a as (select distinct older from ({PAIRS})), b as (select distinct o.id as older from st o where prefix <> '' and exists (select 1 from st n where n.prefix = o.prefix and n.tail <> o.tail and (n.valid_from > o.valid_from or (n.valid_from = o.valid_from and n.id > o.id)))) select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right", "statements"))
def result_set_equality(s, d):
    st = view(s, d, "statements")
    return evaluate.different_rows(consolidate.contradictions(st).select("older").distinct(), consolidate.invalidated(st).distinct())


@query(with_views(" select id, regexp_full_match(id, '[A-Za-z0-9_:/.\\-]{1,256}') as is_identity, regexp_full_match('sha256:' || sha256(id), 'sha256:[0-9a-f]{64}') as is_digest, coalesce(try_cast(regexp_extract('memory-v' || (doc_id % 12), '^memory-v([1-9][0-9]*)$', 1) as int) between 2 and 9, false) as accepted, length(text) > 4096 as oversize, 'coffee-' || substr(sha256(text), 1, 16) as short_id, 'rec:' || id as node_id from memories", "memories"))
def identity_validity(s, d):
    c = F.col("id")
    return view(s, d, "memories").select(
        c, text.identity(c).alias("is_identity"), text.is_digest(F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))).alias("is_digest"),
        text.schema_accepted(F.concat(F.lit("memory-v"), (F.col("doc_id") % 12).cast("string")), "memory", 2, 9).alias("accepted"), (F.length("text") > 4096).alias("oversize"),
        digest.short_id("coffee-", F.col("text")).alias("short_id"), text.node_id("rec", c).alias("node_id"),
    )


# Folds


@query(with_views(" select did, nonce, min(seq) as seq from requests group by did, nonce", "requests"))
def nonce_dedup(s, d):
    return stateful.first_per(view(s, d, "requests"), ["did", "nonce"])


@query(with_views(" select did, idempotency_key, arg_min(verb, seq) as decision, count(*) as n from requests group by did, idempotency_key", "requests"))
def idempotent_decisions(s, d):
    return stateful.idempotent(view(s, d, "requests"), ["did", "idempotency_key"], "verb")


DAY = 86_400_000_000


@query(with_views(f", o as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from op_samples), f as (select user_id, k, event_id, t as start, 1 as used, true as within from o where k = 1 union all select o.user_id, o.k, o.event_id, case when o.t >= f.start + {DAY} then o.t else f.start end, case when o.t >= f.start + {DAY} then 1 when f.used + 1 <= 2 then f.used + 1 else f.used end, o.t >= f.start + {DAY} or f.used + 1 <= 2 from f join o on o.user_id = f.user_id and o.k = f.k + 1) select event_id, user_id, within from f", "op_samples", recursive=True))
def quota_decisions(s, d):
    rows = view(s, d, "op_samples").select("event_id", "user_id", F.struct(text.micros(F.col("ts")).alias("at"), "event_id").alias("o"))
    rows = rows.select("event_id", "user_id", F.col("o.at").alias("at"))
    return stateful.fold(rows, "user_id", ["at", "event_id"], lambda st, r: stateful.quota_step(st, r["at"], 1, 2, DAY), "within boolean").select("event_id", "user_id", "within")


def _job_sql() -> str:
    cases = " ".join(f"when {'f.status is null' if a is None else f'f.status = {chr(39)}{a}{chr(39)}'} and o.verb = '{e}' then '{b}'" for (a, e), b in stateful.JOB_MOVES.items())
    raw = f"case {cases} end"
    cancelled = f"case when {raw} is not null and o.verb = 'error' and f.attempts >= 3 then 'cancelled' else {raw} end"
    return (
        ", o as (select seq, did as job, verb, row_number() over (partition by did order by seq) as k from requests)"
        ", f as (select distinct did as job, 0::bigint as k, null::bigint as seq, null::varchar as status, 0 as attempts, false as moved from requests"
        f" union all select o.job, o.k, o.seq, coalesce({cancelled}, f.status), f.attempts + case when {raw} = 'leased' then 1 else 0 end, {raw} is not null from f join o on o.job = f.job and o.k = f.k + 1)"
        " select seq, job, moved from f where k > 0"
    )


@query(with_views(_job_sql(), "requests", recursive=True))
def job_fold(s, d):
    rows = view(s, d, "requests").select("seq", F.col("did").alias("job"), F.col("verb").alias("event"))
    return stateful.fold(rows, "job", "seq", lambda st, r: stateful.job_step(st, r["event"], 3), "moved boolean").select("seq", "job", "moved")


@query(with_views(", r as (select *, row_number() over (partition by did, nonce order by seq) > 1 as replayed, verb in ('click', 'error', 'purchase') and did % 3 = 0 as denied from requests), k as (select did, idempotency_key, arg_min(verb, seq) as verb from r where not replayed and not denied group by all) select seq, r.did, case when replayed then 'replay' when denied then 'denied' else 'accepted:' || k.verb end as decision from r left join k on k.did = r.did and k.idempotency_key = r.idempotency_key", "requests"))
def verb_decisions(s, d):
    step = lambda st, r: stateful.verb_step(st, r["nonce"], r["idempotency_key"], r["verb"], r["did"] % 3 != 0)
    rows = view(s, d, "requests").select("seq", "did", "nonce", "idempotency_key", "verb")
    return stateful.fold(rows, "did", "seq", step, "decision string").select("seq", "did", "decision")


@query(with_views(", e as (select id, label, 0 as ordinal, 'put' as op, valid_from as t from memories union all select id, label, 1, 'invalidate', invalid_at from memories where invalid_at is not null), l as (select id, arg_max(op, row(t, ordinal)) as op, arg_max(label, row(t, ordinal)) as label from e group by id) select label, count(*) as n from l where op = 'put' group by label", "memories"))
def supersede_history(s, d):
    m = view(s, d, "memories").select("id", "label", "valid_from", "invalid_at")
    put = m.select("id", "label", F.lit(0).alias("ordinal"), F.lit("put").alias("op"), F.col("valid_from").alias("at"))
    gone = m.where("invalid_at is not null").select("id", "label", F.lit(1).alias("ordinal"), F.lit("invalidate").alias("op"), F.col("invalid_at").alias("at"))
    return ledger.current(put.unionByName(gone)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
