"""Queries that replay tables as streams; each gives the rows of a batch over the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from memoryloom.functions import text
from memoryloom.operators import stateful
from memoryloom.plans.catalogue import DAY
from memoryloom.plans.registry import ORACLE_SQL, query
from memoryloom.sources.views import view, with_views
from memoryloom.streaming import processors

HOUR = 3_600_000_000


def _samples(s, d, *columns):
    rows = view(s, d, "op_samples").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", text.micros(F.col("ts")))
    return rows.select("ts", "at", *columns)


@query(ORACLE_SQL["quota_decisions"])
def quota_stream(s, d):
    """Quotas of two requests a day a user, decided in event-time order by a stream; a user's window goes when it is over."""
    step = lambda st, r: stateful.quota_step(st, r["at"], 1, 2, DAY)
    flow = lambda rows: processors.in_order(rows, ["user_id"], "event_id", step, lambda st: st["start"] + DAY, "within boolean")
    return processors.replayed(s, _samples(s, d, "event_id", "user_id"), flow).select("event_id", "user_id", "within")


def _progress(state, row):
    back = state.get("last", row["updated"]) > row["updated"]
    state |= {"last": max(state.get("last", row["updated"]), row["updated"]), "at": row["at"]}
    return "units" if row["completed"] > 100 else "time" if back else None


@query(
    with_views(
        ", u as (select event_id, user_id, latency_micros % 120 as completed, epoch_us(ts) - (event_id % 3) * 20000000000 as updated, epoch_us(ts) as t from op_samples), "
        "g as (select *, max(updated) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding) as last from u) "
        "select event_id, case when completed > 100 then 'units' else 'time' end as fault from g where completed > 100 or last > updated",
        "op_samples",
    )
)
def progress_stream(s, d):
    """Progress that exceeds its total or goes back in time, found by a stream; a job that was idle for a century's end is forgotten."""
    rows = _samples(s, d, "event_id", "user_id", (F.col("latency_micros") % 120).alias("completed"))
    rows = rows.withColumn("updated", F.col("at") - (F.col("event_id") % 3) * 20_000_000_000)
    flow = lambda x: processors.in_order(x, ["user_id"], "event_id", _progress, lambda st: st["at"] + 3650 * DAY, "fault string")
    return processors.replayed(s, rows, flow).where("fault is not null").select("event_id", "fault")


def _nonce(state, row):
    seen, state["at"] = "at" in state, row["at"]
    return "replay" if seen else "accepted"


@query(with_views(" select event_id, case when row_number() over (partition by user_id, nonce order by ts, event_id) = 1 then 'accepted' else 'replay' end as decision from (select event_id, user_id, ts, latency_micros % 50 as nonce from op_samples)", "op_samples"))
def nonce_stream(s, d):
    """Nonces of an actor, the first accepted and the others replays, by a stream."""
    rows = _samples(s, d, "event_id", "user_id", (F.col("latency_micros") % 50).alias("nonce"))
    flow = lambda x: processors.in_order(x, ["user_id", "nonce"], "event_id", _nonce, lambda st: st["at"] + 3650 * DAY, "decision string")
    return processors.replayed(s, rows, flow).select("event_id", "decision")


@query(with_views(f" select operation, epoch_us(ts) // {HOUR} * {HOUR} as start, count(*) as count, count(*) filter (where not allowed) as denials, sum(latency_micros)::bigint as total_micros, max(latency_micros) as max_micros from op_samples group by all", "op_samples"))
def metrics_stream(s, d):
    """Totals of each operation and hour, by a stream that forgets an hour when it is over."""
    rows = _samples(s, d, "operation", "allowed", "latency_micros")
    return processors.replayed(s, rows, lambda x: processors.window_totals(x, HOUR))
