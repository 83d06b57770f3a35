"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import Scratch

#: Rows that pivots are chosen from, pivots, rows of an annulus at least, annuli at most (about), queries of a group.
SAMPLE, PIVOTS, ANNULUS_ROWS, ANNULI, QUERY_ROWS = 512, 32, 1024, 65_536, 1024
#: Annuli that a group of queries visits in the first round, the growth from round to round, and slices of a round at most.
FIRST, GROWTH, SLICES = 8, 4, 16
EVERY, K = 20, 20

HITS = "query_id long, rank int, vec_id long, score long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy()
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pivots(sample: np.ndarray, reach: float) -> np.ndarray:
    """Sample vectors far from each other, with the coordinate that brings all of them to one length."""
    full = np.column_stack([sample, np.sqrt(np.maximum(reach - (sample.astype(float) ** 2).sum(1), 0))]).astype(float)
    picked, gap = [0], ((full - full[0]) ** 2).sum(1)
    while len(picked) < min(PIVOTS, len(full)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((full - full[picked[-1]]) ** 2).sum(1))
    return full[picked]


def _kind(reach: float) -> type:
    """Numbers that hold every inner product exactly: no partial sum exceeds the largest squared length.

    Doubles do up to 53 bits, 64-bit integers up to 63; beyond that Python's own.
    """
    return float if reach < 2.0**52 else np.int64 if reach < 2.0**62 else object


def _lowest(kind: type):
    return -np.inf if kind is float else -(2**63) + 1 if kind is np.int64 else -(2**200)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns [row, k] of each row's k highest scores, ties to the earlier column; all columns if they are no more."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
    more, tie = scores > kth, scores == kth
    need = k - more.sum(1, keepdims=True)
    return np.nonzero(more | (tie & (tie.cumsum(1) <= need)))[1].reshape(-1, k)


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Columns by score, highest first, then id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores), axis=-1)
    return np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j])) for s, i in zip(scores, ids)])  # noqa: B023


class _Group:
    """Queries near each other with the best hits so far, of which fresh ones came since the group was last written."""

    def __init__(self, ids: np.ndarray, home: np.ndarray, place: np.ndarray, q: np.ndarray, k: int, kind: type):
        self.ids, self.home, self.place, self.q, self.k, self.done, self.lowest = ids, home, place, q, k, 0, _lowest(kind)
        self.scores = np.full((len(ids), k), self.lowest, kind)
        self.hits = np.full((len(ids), k), 2**63 - 1, np.int64)
        self.fresh = np.zeros((len(ids), k), bool)

    def add(self, at: np.ndarray, scores: np.ndarray, hits: np.ndarray, fresh: np.ndarray) -> None:
        """Merges hits [row, column] into those of the queries at."""
        scores, hits, fresh = (np.concatenate([a[at], b], axis=1) for a, b in ((self.scores, scores), (self.hits, hits), (self.fresh, fresh)))
        order = _order(scores, hits)[:, : self.k]
        for a, b in ((self.scores, scores), (self.hits, hits), (self.fresh, fresh)):
            a[at] = np.take_along_axis(b, order, 1)

    def merge(self, other: _Group) -> None:
        """Takes the fresh hits of the same queries over."""
        self.add(np.arange(len(self.ids)), np.where(other.fresh, other.scores, self.lowest), np.where(other.fresh, other.hits, 2**63 - 1), other.fresh)

    def visit(self, block: int, ids: np.ndarray, rows: np.ndarray, top: np.ndarray) -> None:
        """Scores the rows of an annulus, of ascending ids, for the queries whose bound there reaches their k-th best."""
        at = np.flatnonzero(top >= self.scores[:, -1])
        if not len(at):
            return
        kind = self.scores.dtype
        s = self.q[at].astype(kind) @ rows.T.astype(kind)
        own = np.flatnonzero(self.home[at] == block)
        s[own, self.place[at[own]]] = self.lowest
        some = np.flatnonzero((s >= self.scores[at, -1:]).any(1))
        if len(some):
            at, s = at[some], s[some]
            col = _best(s, self.k)
            s = np.take_along_axis(s, col, 1)
            self.add(at, s, np.where(s == self.lowest, 2**63 - 1, ids[col]), np.ones(col.shape, bool))


class Index:
    """Annuli of vectors around pivots.

    A coordinate is added that gives all vectors the same length, so the inner product falls with the distance from
    (query, 0). Each vector is keyed by its nearest pivot and its distance from it; the sorted keys are cut into
    annuli, stored as blocks. By the triangle inequality no vector of an annulus is nearer to a query than the gap
    between the query's distance from the pivot and the annulus's span of distances, which bounds the scores there.
    Equal vectors are told apart by vec_id in the sort, so a very common one is dealt over many blocks. A row is known
    by its block and its place there, so rows that share a vec_id stay different rows.
    """

    def __init__(self, scratch: Scratch, vectors: DataFrame):
        """vectors: vec_id long, v array<long> without nulls; an empty table has an empty index."""
        self.scratch = scratch
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        n, reach, width = vectors.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("v"))).first()
        self.reach, self.width, self.rows = float(reach or 0) * (1 + 1e-9), max(int(width or 0), 1), int(n)
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        points = np.zeros((max(len(sample), 1), self.width))
        for i, r in enumerate(sample):
            points[i, : len(r.v)] = r.v
        self.pivots = _pivots(points, self.reach)
        width, reach, pivots = self.width, self.reach, self.pivots
        most = max(ANNULUS_ROWS, self.rows // ANNULI)

        def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), width).astype(float)
                extra = np.sqrt(np.maximum(reach - (x * x).sum(1), 0))
                far = np.sqrt(np.maximum(2 * reach - 2 * (x @ pivots[:, :-1].T + np.outer(extra, pivots[:, -1])), 0))
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], ["vec_id", "v", "pivot", "far"])

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made = TaskContext.get().partitionId() << 32, 0
            ids, xs, far, pivot = np.zeros(0, np.int64), np.zeros((0, width), np.int64), np.zeros(0), np.zeros(0, np.int32)

            def block(k: int) -> pa.RecordBatch:
                nonlocal ids, xs, far, pivot, made
                order = np.argsort(ids[:k], kind="stable")
                row = [part + made, int(pivot[0]), float(far[0]), float(far[k - 1]), ids[:k][order].tobytes(), xs[:k][order].tobytes()]
                ids, xs, far, pivot, made = ids[k:], xs[k:], far[k:], pivot[k:], made + 1
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["block", "pivot", "least", "most", "ids", "rows"])

            for b in batches:
                ids = np.append(ids, b.column(0).to_numpy())
                xs = np.concatenate([xs, _matrix(b.column(1), width)])
                pivot, far = np.append(pivot, b.column(2).to_numpy()), np.append(far, b.column(3).to_numpy())
                while len(ids) and ((k := int(np.searchsorted(pivot, pivot[0], "right"))) < len(ids) or k >= most):
                    yield block(min(k, most))
            while len(ids):
                yield block(min(int(np.searchsorted(pivot, pivot[0], "right")), most))

        keyed = vectors.select("vec_id", "v").mapInArrow(key, "vec_id long, v array<long>, pivot int, far double")
        parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = keyed.repartitionByRange(max(1, min(parts, self.rows // most)), "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
        self.blocks = scratch.save(keyed.mapInArrow(cut, "block long, pivot int, least double, most double, ids binary, rows binary"))

    def _groups(self, every: int, k: int) -> DataFrame:
        """group, slice (0) and state of the queries, about QUERY_ROWS of neighbouring annuli a group."""
        width, kind = self.width, _kind(self.reach)

        def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = [int(np.count_nonzero(np.frombuffer(x, np.int64) % every == 0)) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["block", "n"])

        # As many rows as the directory, and as bounded.
        counts = sorted(map(tuple, self.blocks.select("block", "ids").mapInArrow(asked, "block long, n long").where("n > 0").collect()))
        before = np.cumsum([0, *(n for _, n in counts)])
        group_of = self.scratch.spark.sparkContext.broadcast({b: int(x) // QUERY_ROWS for (b, _), x in zip(counts, before)})

        def asks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for home, raw, data in zip(*(c.to_pylist() for c in b.columns)):
                    ids, rows = np.frombuffer(raw, np.int64), np.frombuffer(data, np.int64).reshape(-1, width)
                    if len(at := np.flatnonzero(ids % every == 0)):
                        state = pickle.dumps((ids[at], np.full(len(at), home), at, rows[at]))
                        yield pa.RecordBatch.from_arrays([pa.array([group_of.value[home]], pa.int64()), pa.array([home], pa.int64()), pa.array([state], pa.binary())], ["group", "home", "state"])

        def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, parts = None, []

            def out() -> pa.RecordBatch:
                state = pickle.dumps(_Group(*map(np.concatenate, zip(*parts)), k, kind))
                return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([0], pa.int32()), pa.array([state], pa.binary())], ["group", "slice", "state"])

            for b in batches:
                for g, _, x in zip(*(c.to_pylist() for c in b.columns)):
                    if g != group and parts:
                        yield out()
                        parts = []
                    group = g
                    parts.append(pickle.loads(x))
            if parts:
                yield out()

        spread = int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.blocks.select("block", "ids", "rows").mapInArrow(asks, "group long, home long, state binary")
        rows = rows.repartition(spread, "group").sortWithinPartitions("group", "home")
        return self.scratch.save(rows.mapInArrow(start, "group long, slice int, state binary"))

    def search(self, every: int = EVERY, k: int = K) -> DataFrame:
        """query_id, rank, vec_id, score for the rows whose vec_id every divides, against every other row.

        Groups of queries visit annuli in the order of their bounds, in rounds of growing size. After a round the hits
        of a group are merged to k a query, and only annuli whose bound still reaches some query's k-th best go on;
        within a round each annulus is held against the k-th best so far. Ties go to the smaller vec_id. Rows with
        equal vec_id are rows of their own: each asks, and the others are its candidates. An empty table has no rows.
        Scores beyond a long are given as the nearest long, in their exact order.
        """
        spark, scratch, reach, pivots = self.scratch.spark, self.scratch, self.reach, self.pivots
        if not self.rows:
            return spark.createDataFrame([], HITS)
        # The directory has about ANNULI rows at most, since the annuli grow with the table.
        listed = sorted(map(tuple, self.blocks.select("block", "pivot", "least", "most").collect()))
        directory = spark.sparkContext.broadcast([np.array(x) for x in zip(*listed)])

        def far_of(g: _Group) -> tuple[np.ndarray, np.ndarray]:
            """The queries' squared length and that of the vectors, added; the queries' distances from the pivots."""
            q = g.q.astype(float)
            both = (q * q).sum(1) + reach
            return both, np.sqrt(np.maximum(both[:, None] - 2 * q @ pivots[:, :-1].T, 0))

        def tops(both: np.ndarray, far: np.ndarray, some) -> np.ndarray:
            """Upper bounds [query, annulus] of scores, with what rounding may take."""
            _, pivot, least, most = directory.value
            d = far[:, pivot[some]]
            gap = np.maximum(0, np.maximum(d - most[some], least[some] - d))
            return (both[:, None] - gap * gap) / 2 + 1e-6 * (1 + reach)

        def plan(size: int):
            """Of the merged groups: a row for each slice (place -1, with the state) and the annuli it visits."""

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                number, group = None, None

                def out() -> pa.RecordBatch:
                    (both, far), n = far_of(group), len(directory.value[0])
                    chunks = [np.arange(i, min(i + 4096, n)) for i in range(0, n, 4096)]
                    order = np.argsort(-np.concatenate([tops(both, far, c).max(0) for c in chunks]), kind="stable")
                    taken: list[int] = []
                    while group.done < n and len(taken) < size:
                        some = order[group.done : group.done + min(4096, size - len(taken))]
                        taken += some[(tops(both, far, some) >= group.scores[:, -1:]).any(0)].tolist()
                        group.done += len(some)
                    group.fresh[:] = False
                    state = pickle.dumps(group)
                    each = max(FIRST, -(-len(taken) // SLICES))
                    rows = [(number, i // each, -1, None, state) for i in range(0, max(len(taken), 1), each)]
                    rows += [(number, i // each, i, int(directory.value[0][x]), None) for i, x in enumerate(taken)]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["group", "slice", "place", "block", "state"])

                for b in batches:
                    for g, part, x in zip(*(c.to_pylist() for c in b.columns)):
                        if g != number and group is not None:
                            yield out()
                        if g != number:
                            number, group = g, pickle.loads(x)
                        else:
                            group.merge(pickle.loads(x))
                if group is not None:
                    yield out()

            return run

        def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = {int(x): i for i, x in enumerate(directory.value[0])}
            group, name = None, None

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int32()), pa.array([pickle.dumps(group)], pa.binary())], ["group", "slice", "state"])

            for b in batches:
                for g, part, place, block, state, raw, data in zip(*(c.to_pylist() for c in b.columns)):
                    if place < 0:
                        if group is not None:
                            yield out()
                        group, name = pickle.loads(state), (g, part)
                        both, far = far_of(group)
                    else:
                        ids = np.frombuffer(raw, np.int64)
                        group.visit(block, ids, np.frombuffer(data, np.int64).reshape(len(ids), -1), tops(both, far, [at[block]])[:, 0])
            if group is not None:
                yield out()

        def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.column(0).to_pylist():
                    g = pickle.loads(x)
                    row, col = np.nonzero(g.hits < 2**63 - 1)
                    score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in g.scores[row, col]], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g.ids[row]), pa.array(col.astype(np.int32) + 1), pa.array(g.hits[row, col]), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

        spread, size = int(spark.conf.get("spark.sql.shuffle.partitions")), FIRST
        states = self._groups(every, k)
        while True:
            merged = states.repartition(spread, "group").sortWithinPartitions("group", "slice")
            rows = scratch.save(merged.mapInArrow(plan(size), "group long, slice int, place int, block long, state binary"), states)
            todo, held = rows.where("place >= 0"), rows.where("place < 0")
            if todo.isEmpty():
                return held.select("state").mapInArrow(rows_of, HITS)
            met = todo.drop("state").join(self.blocks.select("block", "ids", "rows"), "block")
            none = F.lit(None).cast("binary")
            both = held.withColumns({"ids": none, "rows": none}).unionByName(met.withColumn("state", none))
            dealt = both.select("group", "slice", "place", "block", "state", "ids", "rows").repartition(spread, "group", "slice").sortWithinPartitions("group", "slice", "place")
            states = scratch.save(dealt.mapInArrow(visit, "group long, slice int, state binary"), rows)
            size *= GROWTH


def whole_vectors(rows: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v = floor(scale * x) of vectors that are not null and hold finite numbers only; a null vec_id takes no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    with Scratch(spark) as scratch:
        return scratch.keep(Index(scratch, vectors).search())


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
