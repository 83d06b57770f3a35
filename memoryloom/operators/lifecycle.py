"""Closed lifecycles as reference data, and folds of requested moves over them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.operators.temporal import LEGAL

#: The moves of each lifecycle; the first state named is the one that everything starts in.
LIFECYCLES: dict[str, dict[str, list[str]]] = {
    "assertion": LEGAL,
    "observation": {"proposed": ["accepted", "rejected"], "accepted": ["expired"], "rejected": [], "expired": []},
    "procedure": {"proposed": ["evaluated"], "evaluated": ["approved"], "approved": ["active"], "active": ["rolled_back"], "rolled_back": []},
    "rollout": {"proposed": ["approved"], "approved": ["active"], "active": ["rolled_back"], "rolled_back": []},
    "working_set": {"proposed": ["approved"], "approved": ["active"], "active": ["revoked"], "revoked": []},
}
#: Formation profiles with their operation, and whether they may run as a hot-path proposal.
PROFILES = {
    "background-deduplication-v1": ("deduplicate", False),
    "conversation-deduplication-v1": ("deduplicate", True),
    "document-deduplication-v1": ("deduplicate", True),
    "raw-deduplication-v1": ("deduplicate", True),
    "background-reconciliation-v1": ("reconcile", False),
    "json-event-reconciliation-v1": ("reconcile", True),
}
PASSING_BP = 7000


def moves(spark: SparkSession) -> DataFrame:
    """lifecycle, from_state, to_state of every allowed move: a few dozen rows."""
    rows = [(name, a, b) for name, states in LIFECYCLES.items() for a, to in states.items() for b in to]
    return spark.createDataFrame(rows, "lifecycle string, from_state string, to_state string")


def allowed(lifecycle: Column, from_state: Column, to_state: Column) -> Column:
    """Whether a move is allowed, as an expression on constants: no join."""
    every = [f"{name}:{a}>{b}" for name, states in LIFECYCLES.items() for a, to in states.items() for b in to]
    return F.coalesce(F.concat(lifecycle, F.lit(":"), from_state, F.lit(">"), to_state).isin(every), F.lit(False))


def move_step(state: dict[str, Any], lifecycle: str, to: str | None, at: int, ready: bool = True) -> bool:
    """Whether the move was made. A refused one, one back in time or one whose evidence isn't there (ready) changes nothing."""
    now = state.setdefault("state", next(iter(LIFECYCLES[lifecycle])))
    if to not in LIFECYCLES[lifecycle][now] or at < state.get("at", at) or not ready:
        return False
    state |= {"state": to, "at": at}
    return True


def evaluations(feedback: DataFrame, procedure: str = "procedure") -> DataFrame:
    """Per procedure: number of outcomes, their floored mean in basis points and whether that passes. Out-of-range outcomes are an error."""
    bp = F.col("outcome_bp")
    sane = F.when(bp.between(0, 10_000), bp.cast("long")).otherwise(F.raise_error(F.lit("an outcome is out of range")).cast("long"))
    score = F.floor(F.sum(sane) / F.count(F.lit(1)))
    return feedback.groupBy(procedure).agg(F.count(F.lit(1)).alias("outcomes"), score.alias("score_bp")).withColumn("passed", F.col("score_bp") >= PASSING_BP)


def feedback_digest(feedback: DataFrame, procedure: str = "procedure") -> DataFrame:
    """Per procedure a digest of its feedback in canonical order (trajectory, time, outcome), whatever order it came in; a dataset is bounded."""
    rows = F.array_sort(F.collect_list(F.struct("trajectory", "recorded_at", "outcome_bp")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws("|", r["trajectory"], r["recorded_at"].cast("string"), r["outcome_bp"].cast("string"))), "\n")
    return feedback.groupBy(procedure).agg(F.sha2(F.concat(F.lit("feedback-v1\n"), text).cast("binary"), 256).alias("digest"))


def formation(runs: DataFrame) -> DataFrame:
    """runs (profile, mode, ...) with the operation of the profile and a verdict: run, mode_refused or unknown_profile."""
    op = F.create_map(*[x for k, (o, _) in PROFILES.items() for x in (F.lit(k), F.lit(o))])
    hot = [k for k, (_, h) in PROFILES.items() if h]
    known = F.col("profile").isin(list(PROFILES))
    verdict = F.when(~known | F.col("profile").isNull(), "unknown_profile").when((F.col("mode") == "hot_path") & ~F.col("profile").isin(hot), "mode_refused").otherwise("run")
    return runs.withColumn("operation", op[F.col("profile")]).withColumn("verdict", verdict)


def explained(runs: DataFrame, most_sources: int, most_outputs: int) -> DataFrame:
    """Digest of each run's content-free explanation where its counts are within the budgets, else which budget it exceeds."""
    from memoryloom.functions import digest

    over = F.when(F.col("considered") > most_sources, "source_budget").when(F.col("proposed") > most_outputs, "output_budget")
    named = [digest.framed(F.col(c)) for c in ("profile", "operation", "mode", "sources", "proposal")]
    counts = [digest.word(F.least(F.col(c), F.lit(2**31 - 1)), 4) for c in ("considered", "proposed")]
    return runs.withColumn("refused", over).withColumn("explanation", F.when(over.isNull(), digest.sha256(digest.framed(F.lit("formation-explanation.v1")), *named, *counts)))
