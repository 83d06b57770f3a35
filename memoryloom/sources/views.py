"""Tables of memory data over the star-schema and corpus tables: as DataFrames, and as SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEMORIES = [
    "concat('doc-', lpad(cast({d}doc_id as string), 8, '0')) as id",
    "concat('space-', source) as space_id",
    "case lang when 'en' then 'semantic' when 'fr' then 'episodic' when 'de' then 'procedural' else 'profile' end as kind",
    "case when toxic = 1 then 3 when quality = 0 then 2 when quality = 1 then 1 else 0 end as label",
    "{d}doc_id % 97 = 0 as quarantined",
    "case when {d}doc_id % 2 = 0 then 'research' else 'audit' end as purpose",
    "cast('2024-01-01' as date) + cast({d}doc_id % 365 as int) as valid_from",
    "case when {d}doc_id % 5 = 0 then cast('2024-01-01' as date) + cast({d}doc_id % 365 + 30 as int) end as invalid_at",
    "text",
    "{d}doc_id as doc_id",
]
_STATEMENTS = [
    "concat('ord-', lpad(cast(o_orderkey as string), 10, '0')) as id",
    "concat('customer ', cast(o_custkey as string), ' status is ', o_orderstatus) as text",
    "o_orderdate as valid_from",
]
_TRANSITIONS = [
    "l_orderkey as assertion_id",
    "case l_returnflag when 'A' then 'current' when 'R' then 'disputed' else 'superseded' end as to_state",
    "l_shipdate as changed_at",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
]
_MENTIONS = [
    "concat('ord-', lpad(cast(o_orderkey as string), 10, '0')) as record_id",
    "concat('customer:', cast(o_custkey as string)) as entity",
    "o_orderpriority as entity_kind",
]
_SAMPLES = [
    "event_id",
    "user_id",
    "ts",
    "case event_type when 'signup' then 'remember' when 'view' then 'recall' when 'click' then 'improve' when 'error' then 'forget' else 'context' end as operation",
    "event_id % 10 <> 0 as allowed",
    "cast(round(value * 1000) as bigint) as latency_micros",
]
_VECTORS = [
    "concat('vec-', lpad(cast(vec_id as string), 8, '0')) as id",
    "embedding",
    "label % 4 as label",
    "concat('entity-', cast(label as string)) as entity_a",
    "concat('group-', cast(vec_id % 32 as string)) as entity_b",
]
_CANDIDATES = [
    "doc_id as id",
    "(n_chars * 7919) % 10001 as score_bp",
    "greatest(cast(1 as bigint), cast(floor(n_chars / 4) as bigint)) as tokens",
    "doc_id in (7, 11, 13) as pinned",
]
_REQUESTS = [
    "event_id as seq",
    "user_id as did",
    "props as nonce",
    "event_id % 500 as idempotency_key",
    "event_type as verb",
    "user_id % 10 as tenant",
]
_EDGES = [
    ("customer", ["concat('customer:', cast(c_custkey as string)) as src", "concat('nation:', cast(c_nationkey as string)) as dst", "'lives_in' as rel"]),
    ("supplier", ["concat('supplier:', cast(s_suppkey as string)) as src", "concat('nation:', cast(s_nationkey as string)) as dst", "'based_in' as rel"]),
    ("nation", ["concat('nation:', cast(n_nationkey as string)) as src", "concat('region:', cast(n_regionkey as string)) as dst", "'part_of' as rel"]),
]

_SIMPLE = {
    "statements": ("orders", _STATEMENTS),
    "transitions": ("lineitem", _TRANSITIONS),
    "mentions": ("orders", _MENTIONS),
    "op_samples": ("events", _SAMPLES),
    "vectors": ("embeddings", _VECTORS),
    "candidates": ("documents", _CANDIDATES),
    "requests": ("events", _REQUESTS),
}


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").selectExpr(*[x.format(d="") for x in _MEMORIES])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = [table(spark, sf_dir, t).selectExpr(*cols) for t, cols in _EDGES]
    for x in rest:
        first = first.unionByName(x)
    return first


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; only the columns that a plan uses are read."""
    special: dict[str, Callable[[SparkSession, str], DataFrame]] = {"memories": _memories, "rel_edges": _edges}
    if name in special:
        return special[name](spark, sf_dir)
    source, columns = _SIMPLE[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def view_sql(name: str) -> str:
    if name == "memories":
        return "select " + ", ".join(x.format(d="d.") for x in _MEMORIES) + " from documents d left join labels l on d.doc_id = l.doc_id"
    if name == "rel_edges":
        return " union all ".join(f"select {', '.join(cols)} from {t}" for t, cols in _EDGES)
    source, columns = _SIMPLE[name]
    return f"select {', '.join(columns)} from {source}"


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """body, which may go on with further common tables after a comma, behind the views' definitions."""
    ctes = ", ".join(f"{n} as ({view_sql(n)})" for n in names)
    return f"with {'recursive ' if recursive else ''}{ctes}{body}"
