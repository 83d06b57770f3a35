"""Centroid clustering by delta Lloyd rounds, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import Scratch
from memoryloom.llm.topk import _matrix

#: Production parameters of the query.
WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LONG = 2**63 - 1


def kept_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors of exactly width components, none null or non-finite.

    A null vec_id stays. A component beyond a long counts as the nearest long.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == width) & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


@dataclass
class Clustering:
    """rows: vec_id, cluster, distance (squared) of every vector; centroids, and the distances summed over each cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def _kind(reach: float) -> type:
    """Numbers that hold every squared distance exactly, and what it is added up from."""
    most = (2 * reach**0.5 + 2) ** 2 * 2
    return float if most < 2.0**52 else np.int64 if most < 2.0**62 else object


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances [vector, centroid]: all terms are integers that x's kind holds."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def _step(centroids: list[list[int]], changed: list[bool], kind: type, stored: bool, carry: bool):
    """Assigns vectors to the nearest centroid, ties to the smaller number; stored: with an owner and distance of before.

    Where the owner's centroid stayed, the distance stored holds and only changed centroids are compared with it;
    where it moved, all are. carry: vectors and former owners go on with the rows.
    """
    c, moved = np.array(centroids, object).astype(kind), np.array(changed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), c.shape[1]).astype(kind)
            was = b.column(2).to_numpy() if stored else np.full(len(x), -1, np.int32)
            owner, best = was.copy(), b.column(3).to_numpy().astype(kind) if stored else np.zeros(len(x), kind)
            again = (was < 0) | moved[was]
            if again.any():
                far = _distances(x[again], c)
                owner[again] = near = far.argmin(1)
                best[again] = far[np.arange(len(far)), near]
            if not again.all() and moved.any():
                stay, new = np.flatnonzero(~again), np.flatnonzero(moved)
                if kind is object:  # what is stored is cut to a long
                    best[stay] = ((x[stay] - c[was[stay]]) ** 2).sum(1)
                far = _distances(x[stay], c[new])
                near = far.argmin(1)
                least = far[np.arange(len(far)), near]
                go = (least < best[stay]) | ((least == best[stay]) & (new[near] < was[stay]))
                owner[stay[go]], best[stay[go]] = new[near[go]], least[go]
            cut = np.array([min(int(d), LONG) for d in best], np.int64) if kind is object else best.astype(np.int64)
            out = [b.column(0), pa.array(owner, pa.int32()), pa.array(cut)]
            yield pa.RecordBatch.from_arrays([out[0], b.column(1), *out[1:], pa.array(was, pa.int32())], ["vec_id", "v", "cluster", "distance", "was"]) if carry else pa.RecordBatch.from_arrays(out, ["vec_id", "cluster", "distance"])

    return run


def _transfers(k: int, width: int, kind: type):
    """Signed sums of what each cluster gains and loses by the vectors that changed owners: a task's rows of (cluster, place, x).

    The place after the last component counts vectors.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), object)
        for b in batches:
            x = _matrix(b.column(0), width)
            x = np.column_stack([x.astype(object) if kind is object else x, np.ones(len(x), np.int64)])
            for at, sign in ((b.column(1).to_numpy(), 1), (b.column(2).to_numpy(), -1)):
                for c in np.unique(at[at >= 0]).tolist():
                    sums[c] += sign * x[at == c].sum(0).astype(object)
        rows = [(c, i, Decimal(int(s))) for c, row in enumerate(sums) for i, s in enumerate(row) if s]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["cluster", "place", "x"])

    return run


def cluster(scratch: Scratch, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Lloyd's clusters of vectors (vec_id, v: arrays of equally many longs), each round paying only for what changed.

    Centroids start as the k vectors of least sha256 of seed:vec_id (ties: by vector); one without an id starts none.
    Each round assigns the vectors and puts every centroid that has some at the floor of their mean; then they are
    assigned once more. Assignments and distances are written with the vectors, as one narrow stage a round; the sums
    and counts of the clusters, k rows, are kept on the driver and changed by what moved between clusters, which tasks
    sum up before anything is shuffled. Rounds end early when no centroid changes. Repeated rows are vectors of their
    own, fewer than k vectors make fewer clusters, and an empty table gives no rows. Distances beyond a long are
    compared exactly and given as the greatest long.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where("vec_id is not null").select("v", key.alias("h")).orderBy("h", "v").limit(k).collect()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    kind = _kind(float(vectors.agg(F.max(square)).first()[0] or 0))
    centroids = [list(r.v) for r in first]
    if not centroids:
        return Clustering(vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), [], [])
    k, width = len(centroids), len(centroids[0])
    sums, changed, state = [[0] * (width + 1) for _ in range(k)], [True] * k, None
    for turn in range(rounds + 1):
        last = turn == rounds or not any(changed)
        source = vectors.select("vec_id", "v") if state is None else state.select("vec_id", "v", "cluster", "distance")
        names = "vec_id long, cluster int, distance long" if last else "vec_id long, v array<long>, cluster int, distance long, was int"
        rows = source.mapInArrow(_step(centroids, changed, kind, state is not None, not last), names)
        if last:
            rows = scratch.keep(rows)
            break
        state = scratch.save(rows, state)
        gone = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_transfers(k, width, kind), "cluster int, place int, x decimal(38,0)")
        for r in gone.groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect():
            sums[r.cluster][r.place] += int(r.x)
        new = [[s // n[-1] for s in n[:-1]] if n[-1] else old for n, old in zip(sums, centroids)]
        changed, centroids = [a != b for a, b in zip(new, centroids)], new
    scratch.drop(state)
    inertia = [0] * k
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect():
        inertia[r.cluster] = int(r.x)
    return Clustering(rows, centroids, inertia)


def _pick(values: list, kind: str) -> Column:
    """The value of a row's cluster; there are as many as clusters."""
    return F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("cluster"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = cluster(scratch, kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    total = min(sum(found.inertia), LONG)
    return found.rows.select("vec_id", "cluster", "distance", _pick([min(x, LONG) for x in found.inertia], "bigint").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), _pick(shown, "string").alias("centroid_sha256"))


def _sql() -> str:
    near = "select rid, any_value(vec_id) as vec_id, any_value(v) as v, min(row(d, k)) as m from (select rid, vec_id, v, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) as d from v, c{i}) group by rid"
    mean = (
        "select o.k, coalesce(n.c, o.c) as c from c{i} o left join (select k, list((s - ((s % n) + n) % n) // n order by j) as c from"
        " (select m[2] as k, j, sum(v[j])::hugeint as s, count(*) as n from a{i}, range(1, 65) r(j) group by all) group by k) n on n.k = o.k"
    )
    rounds = "".join(f", a{i} as materialized ({near.format(i=i)})" + (f", c{i + 1} as materialized ({mean.format(i=i)})" if i < ROUNDS else "") for i in range(ROUNDS + 1))
    return f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) = {WIDTH}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as k, v as c
  from (select sha256('{SEED}:' || vec_id) as h, v from v where vec_id is not null order by h, v limit {CLUSTERS})){rounds}
select vec_id, cast(m[2] as integer) as cluster, cast(m[1] as bigint) as distance,
       cast(sum(m[1]) over (partition by m[2]) as bigint) as cluster_inertia, cast(sum(m[1]) over () as bigint) as inertia,
       sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on k = m[2]
"""


ORACLE_SQL = _sql()
