"""Ordered folds over keyed requests: quotas, replay, idempotency, jobs, verbs.

Each fold is a plain function of a state and a request, which a batch runs per key in order (here) and a stream per
micro-batch (memoryloom.streaming).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Size of a text or query that is accepted at most.
MOST_SIZE = 1024


def first_per(requests: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first request of each key: replays go."""
    return requests.groupBy(*keys).agg(F.min(order).alias(order))


def idempotent(requests: DataFrame, keys: list[str], decision: str, order: str = "seq") -> DataFrame:
    """Every request's decision is that of the first with its key."""
    return requests.groupBy(*keys).agg(F.min_by(decision, order).alias("decision"), F.count(F.lit(1)).alias("n"))


def one_use(requests: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Every request with its decision: the first of a key is accepted and spends it, by a partial aggregate."""
    first = first_per(requests, keys, order).select(F.col(order).alias("first_order"))
    known = requests.join(first, requests[order] == first.first_order, "left")
    return known.withColumn("decision", F.when(F.col("first_order").isNull(), "spent").otherwise("accepted")).drop("first_order")


def verb_order(requests: DataFrame) -> DataFrame:
    """seq, did and decision of requests (seq, did, verb, nonce, idempotency_key, can_mutate, size, in_scope, cleared, fresh).

    The nonce is claimed first; verbs that change something need can_mutate; remember then asks for size, scope and
    clearance, recall for size, improve for a key that was accepted before (whose decision it repeats), a fresh source
    and clearance, forget for clearance. Three aggregates decide it all, so no actor's history is held in one place.
    """
    claims = requests.groupBy("did", "nonce").agg(F.min("seq").alias("first_claim"))
    rows = requests.join(claims, ["did", "nonce"])
    writes, replay = F.col("verb").isin("remember", "improve", "forget"), F.col("seq") > F.col("first_claim")
    rows = rows.withColumn("open", ~replay & (~writes | F.col("can_mutate")))
    own = (
        F.when((F.col("verb") == "remember") & (F.col("size") > MOST_SIZE), "oversized-memory")
        .when((F.col("verb") == "remember") & ~F.col("in_scope"), "scope-denied")
        .when((F.col("verb") == "remember") & ~F.col("cleared"), "clearance-denied")
        .when((F.col("verb") == "recall") & (F.col("size") > MOST_SIZE), "oversized-query")
        .when((F.col("verb") == "improve") & ~F.col("fresh"), "stale-source")
        .when(F.col("verb").isin("improve", "forget") & ~(F.col("in_scope") & F.col("cleared")), "authorization-denied")
        .otherwise("accepted")
    )
    rows = rows.withColumn("own", own)
    done = rows.where("open and verb = 'improve' and own = 'accepted'").groupBy(F.col("did").alias("d2"), F.col("idempotency_key").alias("k2")).agg(F.min("seq").alias("accepted_at"))
    known = (F.col("did") == F.col("d2")) & (F.col("idempotency_key") == F.col("k2")) & (F.col("verb") == "improve")
    rows = rows.join(done, known, "left")
    refused = F.when(writes, "replay-or-mutation-denied").otherwise("replay")
    decision = F.when(~F.col("open"), refused).when(F.col("seq") >= F.col("accepted_at"), "accepted").otherwise(F.col("own"))
    return rows.select("seq", "did", decision.alias("decision"))


def restaged(proposals: DataFrame) -> DataFrame:
    """Every proposal (job, seq, digest) with its outcome: the first of a job is staged, an equal one found, another collides."""
    first = proposals.groupBy(F.col("job").alias("j2")).agg(F.min_by("digest", "seq").alias("stored"), F.min("seq").alias("first"))
    known = proposals.join(first, F.col("job") == F.col("j2"))
    outcome = F.when(F.col("seq") == F.col("first"), "staged").when(F.col("digest") == F.col("stored"), "ready").otherwise("collision")
    return known.select("seq", "job", outcome.alias("outcome"))


def quota_step(state: dict[str, Any], at: int, amount: int, limit: int, window: int) -> bool:
    """Whether the request is within the quota. A window opens at the first request after the last one ended."""
    if state.get("start") is not None and at < state["start"]:
        raise ValueError("the clock went back")
    if state.get("start") is None or at >= state["start"] + window:
        state |= {"start": at, "used": 0}
    ok = state["used"] + amount <= limit
    state["used"] += amount if ok else 0
    return ok


#: What an event does to a job in a status.
JOB_MOVES = {
    (None, "signup"): "pending",
    ("pending", "view"): "leased",
    ("leased", "click"): "completed",
    ("leased", "error"): "pending",
    ("pending", "purchase"): "cancelled",
    ("leased", "purchase"): "cancelled",
}


def job_step(state: dict[str, Any], event: str, most: int) -> bool:
    """Whether the event moved the job. A job that was leased most times and failed again is cancelled."""
    to = JOB_MOVES.get((state.get("status"), event))
    if to is None:
        return False
    if to == "leased":
        state["attempts"] = state.get("attempts", 0) + 1
    if event == "error" and state.get("attempts", 0) >= most:
        to = "cancelled"
    state["status"] = to
    return True


def verb_step(state: dict[str, Any], nonce: str, key: int, verb: str, can_mutate: bool) -> str:
    """The decision on a request: the nonce is claimed first, then rights count, then a known key gives its old decision."""
    if nonce in state.setdefault("nonces", set()):
        return "replay"
    state["nonces"].add(nonce)
    if verb in ("click", "error", "purchase") and not can_mutate:
        return "denied"
    return state.setdefault("decisions", {}).setdefault(key, f"accepted:{verb}")


def fold(rows: DataFrame, key: str, order: str | list[str], step, out: str) -> DataFrame:
    """rows with a column out ('name type'), the value of step(state, row) over the rows of each key in order.

    Rows are sorted within the shuffle's partitions by Spark, which spills, and stream through Python; a key costs
    its state, not its rows.
    """
    name, kind = out.split()
    columns = rows.columns
    at = columns.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, Any] = {}
        last: Any = object()
        for b in batches:
            values = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[at] != last:
                    state, last = {}, row[at]
                values.append(step(state, dict(zip(columns, row))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, {"boolean": pa.bool_(), "string": pa.string()}[kind])], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {out}"
    by = [order] if isinstance(order, str) else order
    return rows.repartition(key).sortWithinPartitions(key, *by).mapInArrow(run, schema)
