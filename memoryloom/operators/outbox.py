"""Delivery of committed effects, at least once: manifests, claims, leases, acknowledgements, and progress of jobs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_CLAIMED = 256
PHASES = ["snapshot", "plan", "proposal", "commit"]


def with_ordinals(entries: DataFrame, commit: str, *order: str) -> DataFrame:
    """Entries with their place, from 0, in their commit."""
    return entries.withColumn("ordinal", (F.row_number().over(W.partitionBy(commit).orderBy(*order)) - 1).cast("long"))


def claimable(now: Column) -> Column:
    """Not acknowledged, and not under a lease that still runs."""
    return (F.col("status") != "acked") & (F.col("lease_expiry").isNull() | (F.col("lease_expiry") <= now))


def claim_state(now: Column) -> Column:
    """Whether an entry (status, leased_at, lease_expiry) may be claimed: claimable, acked, leased, or backdated.

    A claim at an instant before the lease was taken is backdated, whether or not the lease has run out by then.
    """
    live = F.col("lease_expiry").isNotNull()
    return F.when(F.col("status") == "acked", "acked").when(live & (now < F.col("leased_at")), "backdated").when(live & (F.col("lease_expiry") > now), "leased").otherwise("claimable")


def claim(entries: DataFrame, commit: str, now: Column, limit: int) -> DataFrame:
    """Per commit the first limit claimable entries in manifest order; the rank filter runs before the shuffle too."""
    if not 1 <= limit <= MOST_CLAIMED:
        raise ValueError("the limit is out of bounds")
    rank = F.row_number().over(W.partitionBy(commit).orderBy("ordinal"))
    return entries.where(claimable(now)).withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def manifest_faults(manifests: DataFrame, entries: DataFrame, commit: str) -> DataFrame:
    """Listed entries that are missing, or stand at another place or in another commit: commit, ordinal, entry_id, fault.

    manifests: commit, entry_ids (an array in order); entries: commit, ordinal, entry_id.
    """
    listed = manifests.select(F.col(commit).alias("_commit"), F.posexplode("entry_ids").alias("_place", "entry_id"))
    both = listed.join(entries.select("entry_id", commit, "ordinal"), "entry_id", "left")
    fault = F.when(F.col(commit).isNull(), "missing").when(F.col(commit) != F.col("_commit"), "commit").when(F.col("ordinal") != F.col("_place"), "ordinal")
    return both.select(F.col("_commit").alias(commit), F.col("_place").cast("long").alias("ordinal"), "entry_id", fault.alias("fault")).where("fault is not null")


def delivery_step(state: dict[str, Any], op: str, token: int, at: int, ttl: int) -> str:
    """What became of a claim or an acknowledgement at an instant.

    A claim leases the entry for ttl and gives the attempt's number as its token. Only the running lease's token
    acknowledges; the same token again is harmless, any other is stale, and an instant before the lease is refused.
    """
    status, lease = state.get("status", "pending"), state.get("lease")
    if status == "acked":
        return "repeated" if op == "ack" and token == state["acked"] else "done" if op == "claim" else "stale"
    if lease and at < lease[0]:
        return "backdated"
    if op == "claim":
        if lease and at < lease[1]:
            return "leased"
        state |= {"status": "leased", "attempts": state.get("attempts", 0) + 1, "lease": [at, at + ttl]}
        return "claimed"
    if not lease or at >= lease[1] or token != state["attempts"]:
        return "stale"
    state |= {"status": "acked", "acked": token, "lease": None}
    return "acked"


def progress_faults(updates: DataFrame, job: str, *order: str) -> DataFrame:
    """Updates that name no phase, exceed their total or go back in time; a total of null is open."""
    before = F.lag("updated_at").over(W.partitionBy(job).orderBy(*order))
    fault = (
        F.when(~F.coalesce(F.col("phase").isin(PHASES), F.lit(False)), "phase")
        .when((F.col("total") == 0) | (F.col("completed") > F.col("total")), "units")
        .when(F.col("updated_at") < F.col("_before"), "time")
    )
    return updates.withColumn("_before", before).withColumn("fault", fault).where("fault is not null").drop("_before")
