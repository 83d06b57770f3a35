"""Validity intervals and belief states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The moves that an assertion may make.
LEGAL = {
    "proposed": ["current", "disputed", "negated", "retracted", "forgotten"],
    "current": ["disputed", "negated", "superseded", "retracted", "forgotten"],
    "disputed": ["current", "negated", "superseded", "retracted", "forgotten"],
    "negated": ["current", "superseded", "retracted", "forgotten"],
    "superseded": ["retracted", "forgotten"],
    "retracted": ["forgotten"],
    "forgotten": [],
}
#: The order that decides among transitions of one instant.
TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def valid_at(instant: Column, start: str = "valid_from", end: str = "invalid_at") -> Column:
    """Half-open validity; a null end is open."""
    return (F.col(start) <= instant) & (F.col(end).isNull() | (instant < F.col(end)))


def state_at(transitions: DataFrame, instant: Column, ties: list[str] = TIES) -> DataFrame:
    """assertion_id and its state at the instant: the last transition's, 'proposed' before the first. Partial aggregation, no sort."""
    last = F.struct("changed_at", *ties)
    seen = F.when(F.col("changed_at") <= instant, last)
    return transitions.groupBy("assertion_id").agg(F.coalesce(F.max_by("to_state", seen), F.lit("proposed")).alias("state"))


def as_of(facts: DataFrame, probes: DataFrame, key: str, at: str, ties: list[str], ranges: int = 16) -> DataFrame:
    """Every probe (key, at and any columns) with fact (a struct of the fact's other columns), the last of its key at or before its instant, or null.

    facts: key, at, ties (which decide among facts of one instant) and what they hold. Facts and probes are sorted
    together per key and range of time, and the last fact is carried forward; ranges are cut at quantiles of the facts'
    instants, so the rows of a very common key are dealt over that many tasks. What a range starts with is carried over
    from the ranges before it, of which there is a row for each key and range. An unknown key or instant gives null,
    repeated probes repeat, and no pairs are made.
    """
    bounds = facts.agg(F.percentile_approx(at, [k / ranges for k in range(1, max(ranges, 2))])).first()[0] or []
    own = [c for c in facts.columns if c not in (key, at)]
    fact, probe = F.struct(at, *own), F.struct(*probes.columns)
    if not bounds:  # no fact has an instant
        return probes.select("*", F.lit(None).cast(facts.select(fact.alias("fact")).schema["fact"].dataType).alias("fact"))
    known = facts.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), fact.alias("fact"))
    asked = probes.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), probe.alias("_probe"))
    both = known.unionByName(asked, allowMissingColumns=True)
    part = sum(((F.lit(b) < F.col("_at")).cast("int") for b in bounds), F.lit(0))
    both = both.withColumn("_part", F.coalesce(part, F.lit(0)))
    order = [F.col(f"fact.{c}") for c in ties]
    # Facts without an instant come last, where only probes without one, which have none, could see them.
    within = W.partitionBy("_key", "_part").orderBy(F.asc_nulls_last("_at"), "_kind", *order).rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("fact", F.when(F.col("_at").isNotNull() & F.col("_key").isNotNull(), F.last("fact", ignorenulls=True).over(within))).where("_kind = 1")
    last = F.max_by("fact", F.when((F.col("_kind") == 0) & F.col("_at").isNotNull(), F.struct("_at", *order)))
    ends = both.groupBy(F.col("_key").alias("_k2"), F.col("_part").alias("_p2")).agg(last.alias("_last"))
    before = W.partitionBy("_k2").orderBy("_p2").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before is not null").drop("_last")
    found = rows.join(ends, (F.col("_key") == F.col("_k2")) & (F.col("_part") == F.col("_p2")), "left")
    carried = F.when(F.col("_at").isNotNull(), F.coalesce("fact", "_before"))
    return found.select("_probe.*", carried.alias("fact"))


def current_at(states: DataFrame, validity: DataFrame, key: str, at: Column) -> DataFrame:
    """Keys whose state at the instant is current and whose validity (valid_from, valid_to or null) holds then."""
    holds = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return states.where("state = 'current'").join(validity.where(holds), key, "left_semi").select(key)


def states_in(states: DataFrame, wanted: list[str]) -> DataFrame:
    if not wanted:
        raise ValueError("the set of states must not be empty")
    return states.where(F.col("state").isin(wanted))


def candidates(states: DataFrame, validity: DataFrame, key: str, wanted: list[str], at: Column | None = None) -> DataFrame:
    """Keys in one of the wanted states, with valid_from, latest first, then by key; at: only those valid at that instant."""
    holds = F.lit(True) if at is None else valid_at(at, end="valid_to")
    found = states_in(states, wanted).join(validity.where(holds).select(F.col(key).alias("valid_key"), "valid_from"), F.col(key) == F.col("valid_key"))
    return found.select(key, "state", "valid_from").orderBy(F.desc("valid_from"), key)


def steps(transitions: DataFrame, ties: list[str] = TIES) -> DataFrame:
    """Transitions with the state and time before each; the first comes from 'proposed'."""
    w = W.partitionBy("assertion_id").orderBy("changed_at", *ties)
    return transitions.withColumn("from_state", F.lag("to_state", 1, "proposed").over(w)).withColumn("before", F.lag("changed_at").over(w)).withColumn("ordinal", F.row_number().over(w))


def illegal(transitions: DataFrame, ties: list[str] = TIES) -> DataFrame:
    """Transitions that the lifecycle doesn't allow, or that go back in time."""
    moves = [f"{a}>{b}" for a, to in LEGAL.items() for b in to]
    move = F.concat("from_state", F.lit(">"), "to_state")
    return steps(transitions, ties).where(~move.isin(moves) | (F.col("before") > F.col("changed_at")))
