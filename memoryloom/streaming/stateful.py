"""The keyed folds over streams: state per key, kept by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memoryloom.operators import scheduler
from memoryloom.operators.stateful import job_step, quota_step


def distinct_nonces(requests: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Requests whose (did, nonce) was not seen before; state goes once the watermark has passed it."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark(["did", "nonce"])


def metrics(samples: DataFrame, window: str = "1 hour", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts, denials and latency per window and operation: commutative, so the order of arrival doesn't matter."""
    grouped = samples.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "operation")
    return grouped.agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("allowed")).alias("denials"), F.sum("latency_micros").alias("total_micros"), F.max("latency_micros").alias("max_micros"))


def quota(samples: DataFrame, limit: int, window_micros: int) -> DataFrame:
    """event_id, user_id and within of requests (event_id, user_id, at in microseconds), in order within a micro-batch.

    A key's rows of one micro-batch are put in order together, however many chunks they come in; the trigger's limits
    on a micro-batch bound them.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        f = pd.concat(list(frames)).sort_values(["at", "event_id"])
        f["within"] = [quota_step(held, int(at), 1, limit, window_micros) for at in f["at"]]
        yield f[["event_id", "user_id", "within"]]
        state.update((json.dumps(held),))

    return samples.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, within boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def jobs(requests: DataFrame, most: int = 3) -> DataFrame:
    """seq, job and whether each event (seq, job, event) moved its job."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        f = pd.concat(list(frames)).sort_values("seq")
        f["moved"] = [job_step(held, e, most) for e in f["event"]]
        yield f[["seq", "job", "moved"]]
        state.update((json.dumps(held),))

    return requests.groupBy("job").applyInPandasWithState(step, "seq long, job long, moved boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def leases(requests: DataFrame) -> DataFrame:
    """seq, job and outcome of requests (seq, job and the columns of scheduler), in order within a micro-batch.

    A job that has ended is kept, since a later request must find it so; the state is one small record a job.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        f = pd.concat(list(frames)).sort_values("seq")
        f["outcome"] = [scheduler.step(held, r) for r in f.astype(object).to_dict("records")]
        yield f[["seq", "job", "outcome"]]
        state.update((json.dumps(held),))

    return requests.groupBy("job").applyInPandasWithState(step, "seq long, job long, outcome string", "held string", "append", GroupStateTimeout.NoTimeout)
