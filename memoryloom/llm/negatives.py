"""Hard negatives over a pivot table: stored pivot distances bracket scores, and what the brackets leave is checked."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.llm.shared import Scratch
from memoryloom.llm.topk import SAMPLE, _best, _kind, _lowest, _matrix, _order, _pivots

#: Production parameters of the query: negatives score LEAST to MOST percent of the positive.
SCALE, EVERY, RELABEL, LABELS, POSITIVES, NEGATIVES, LEAST, MOST = 256, 100, 7, 10, 5, 10, 30, 90
#: Distances stored of a row, rows of a block at least, blocks at most (about), anchors of a group, blocks of the first
#: visit and of a slice.
PIVOTS, BLOCK_ROWS, BLOCKS, GROUP, FIRST, SLICE = 8, 1024, 65_536, 1024, 8, 4
LONG, DIGITS = 2**63 - 1, 10**38 - 1

HITS = "group long, anchor int, slot int, anchor_id long, positive_id long, positive_score decimal(38,0), score decimal(38,0), vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined_vectors(rows: DataFrame, scale: int = SCALE, relabel: int = RELABEL, labels: int = LABELS) -> DataFrame:
    """vec_id, label and v = floor(scale * x) of rows whose vec_id, label and vector are whole; the label of every relabel-th id moves on by one."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % relabel == 0, (label + 1) % labels).otherwise(label)
    return good.select(vec_id.alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _decimals(x: np.ndarray) -> pa.Array:
    if x.dtype == object:
        return pa.array([Decimal(min(max(int(v), -DIGITS), DIGITS)) for v in x], pa.decimal128(38, 0))
    return pa.array(x.astype(np.int64)).cast(pa.decimal128(38, 0))


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


@dataclass
class _Group:
    """Anchors near each other and their targets: which scores count (lo to hi), how many (k), and the least that still does (floor)."""

    ids: np.ndarray
    label: np.ndarray
    home: np.ndarray
    place: np.ndarray
    q: np.ndarray
    same: bool = True
    k: int = 0
    anchor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    positive: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    worth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    lo: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hi: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ask_own(self, k: int, kind: type) -> None:
        """One target an anchor: the k best of its label."""
        n = len(self.ids)
        self.same, self.k, self.seen = True, k, np.zeros(0, np.int64)
        self.anchor, self.slot, self.positive, self.worth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.lo, self.hi = np.full(n, _lowest(kind), kind), np.full(n, -_lowest(kind), kind)
        self.floor = self.lo.copy()

    def ask_others(self, anchor: np.ndarray, slot: np.ndarray, positive: np.ndarray, worth: np.ndarray, k: int, kind: type) -> None:
        """A target for each positive: the k best of other labels that score LEAST to MOST percent of it."""
        # Quotients and remainders keep the products small; the remainder is never negative.
        whole, rest = worth // 100, worth % 100
        lo, hi = LEAST * whole - (-LEAST * rest // 100), MOST * whole + MOST * rest // 100
        some = lo <= hi
        self.same, self.k, self.seen = False, k, np.zeros(0, np.int64)
        self.anchor, self.slot, self.positive, self.worth = anchor[some], slot[some], positive[some], worth[some]
        self.lo, self.hi = lo[some].astype(kind), hi[some].astype(kind)
        self.floor = self.lo.copy()

    def raise_floors(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray) -> None:
        """Targets that have k hits already (sorted by target, best first) take the k-th as their floor."""
        if not len(anchor) or not len(self.anchor):
            return
        at = np.searchsorted(self.anchor << 20 | self.slot, anchor << 20 | slot)
        n = np.bincount(at, minlength=len(self.anchor))
        full = np.flatnonzero(n >= self.k)
        last = np.cumsum(n)[full] - n[full] + self.k - 1
        self.floor[full] = score[last].astype(self.floor.dtype)


class PivotTable:
    """Rows in blocks with their distances from a few pivots.

    A coordinate is added that gives all rows the same length, so that a row's score for a query falls with its
    distance from (query, 0). By the triangle inequality the distances of both from a pivot bracket that distance, and
    so the score, from either side. Rows are ordered by their nearest pivot and its distance and cut into blocks, whose
    least and greatest distance from each pivot bracket all of their scores. Rows are known by block and place, so rows
    that share a vec_id stay rows of their own; a very common vector is dealt over blocks by vec_id.
    """

    def __init__(self, scratch: Scratch, vectors: DataFrame, every: int):
        """vectors: vec_id, label, v (array of longs). The directory of blocks, about BLOCKS rows whatever the table's size, is on the driver."""
        self.scratch, self.every = scratch, every
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        n, reach, width = vectors.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("v"))).first()
        self.rows, self.reach, self.width = int(n), float(reach or 0) * (1 + 1e-9), max(int(width or 0), 1)
        self.kind = _kind(self.reach)
        self.packed = np.dtype(np.int16 if self.reach < 2.0**29 else np.int32 if self.reach < 2.0**61 else np.int64)
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).collect()
        points = np.zeros((max(len(sample), 1), self.width))
        for i, r in enumerate(sample):
            points[i, : len(r.v)] = r.v
        self.pivots = _pivots(points, self.reach)[:PIVOTS]
        width, reach, pivots, packed, most = self.width, self.reach, self.pivots, self.packed, max(BLOCK_ROWS, self.rows // BLOCKS)

        def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole = _matrix(b.column(2), width)
                x = whole.astype(float)
                extra = np.sqrt(np.maximum(reach - (x * x).sum(1), 0))
                far = np.sqrt(np.maximum(2 * reach - 2 * (x @ pivots[:, :-1].T + np.outer(extra, pivots[:, -1])), 0)).astype(np.float32)
                out = [b.column(0), b.column(1), _binary(whole.astype(packed)), _binary(far), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "row", "dists", "pivot", "far"])

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

            def block(of: pa.RecordBatch) -> pa.RecordBatch:
                nonlocal made
                ids, labels = of.column(0).to_numpy(), of.column(1).to_numpy()
                order = np.argsort(ids, kind="stable")
                rows, far = (np.frombuffer(b"".join(of.column(i).to_pylist()), t).reshape(len(ids), -1)[order] for i, t in ((2, packed), (3, np.float32)))
                values = [part + made, int(np.count_nonzero(ids % every == 0)), *(a.tobytes() for a in (far.min(0), far.max(0), ids[order], labels[order], rows, far))]
                made += 1
                types = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "asks", "least", "most", "ids", "labels", "rows", "dists"])

            whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= most:
                    all_of = whole()
                    for i in range(0, n - n % most, most):
                        yield block(all_of.slice(i, most))
                    n %= most
                    held = [all_of.slice(all_of.num_rows - n)] if n else []
            if n:
                yield block(whole())

        keyed = vectors.select("vec_id", "label", "v").mapInArrow(key, "vec_id long, label long, row binary, dists binary, pivot int, far float")
        parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = keyed.repartitionByRange(max(1, min(parts, self.rows // most)), "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
        self.blocks = scratch.save(keyed.mapInArrow(cut, "block long, asks long, least binary, most binary, ids binary, labels binary, rows binary, dists binary"))
        found = sorted(map(tuple, self.blocks.select("block", "asks", "least", "most").collect()))
        ends = [np.frombuffer(b"".join(r[i] for r in found), np.float32).reshape(len(found), len(pivots)) for i in (2, 3)]
        self.asks = {r[0]: r[1] for r in found if r[1]}
        self.directory = scratch.spark.sparkContext.broadcast((np.array([r[0] for r in found], np.int64), *ends))

    def groups(self) -> DataFrame:
        """group and state of the anchors, about GROUP of neighbouring blocks a group."""
        width, every, packed = self.width, self.every, self.packed
        ends = np.cumsum([0, *self.asks.values()])
        group_of = self.scratch.spark.sparkContext.broadcast({b: int(e) // GROUP for b, e in zip(self.asks, ends)})

        def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for home, raw, labels, data in zip(*(c.to_pylist() for c in b.columns)):
                    ids = np.frombuffer(raw, np.int64)
                    at = np.flatnonzero(ids % every == 0)
                    state = pickle.dumps((ids[at], np.frombuffer(labels, np.int64)[at], np.full(len(at), home), at, np.frombuffer(data, packed).reshape(-1, width)[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([group_of.value[home]], pa.int64()), pa.array([home], pa.int64()), pa.array([state], pa.binary())], ["group", "home", "state"])

        def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, parts = None, []
            out = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([pickle.dumps(_Group(*map(np.concatenate, zip(*parts))))], pa.binary())], ["group", "state"])
            for b in batches:
                for g, _, x in zip(*(c.to_pylist() for c in b.columns)):
                    if g != group and parts:
                        yield out()
                        parts = []
                    group = g
                    parts.append(pickle.loads(x))
            if parts:
                yield out()

        rows = self.blocks.where("asks > 0").select("block", "ids", "labels", "rows").mapInArrow(asked, "group long, home long, state binary")
        rows = rows.repartition(self._spread(), "group").sortWithinPartitions("group", "home")
        return self.scratch.save(rows.mapInArrow(start, "group long, state binary"))

    def _spread(self) -> int:
        return int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def visit(self, states: DataFrame, hits: DataFrame | None, ask: str, k: int, first: bool) -> tuple[DataFrame, DataFrame]:
        """The states that went out and the hits of one visit: at most k a target and slice.

        hits: at most k a target of earlier visits. ask: own (each anchor's best of its label), others (for each hit
        of own, as positive) or again (the targets of before, with the hits of the first visit as floors). first: the
        FIRST most promising blocks of a group alone, else all others whose bracket reaches a target.
        """
        kind, reach, pivots, every_block, width, packed = self.kind, self.reach, self.pivots, self.directory, self.width, self.packed
        margin = 1e-6 * (1 + reach)

        def measured(g: _Group) -> tuple[np.ndarray, np.ndarray]:
            """Squared length of the anchors and of the rows, added; distances of the anchors from the pivots."""
            q = g.q.astype(float)
            both = (q * q).sum(1) + reach
            return both, np.sqrt(np.maximum(both[:, None] - 2 * q @ pivots[:, :-1].T, 0)).astype(np.float32)

        def brackets(both: np.ndarray, dq: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least and greatest score [anchor, row or block] that the distances allow, with what rounding may take."""
            near, far = np.zeros((len(dq), len(least)), np.float32), np.full((len(dq), len(least)), np.inf, np.float32)
            for p in range(dq.shape[1]):
                d = dq[:, p, None]
                np.maximum(near, d - most[:, p], out=near)
                np.maximum(near, least[:, p] - d, out=near)
                np.minimum(far, d + most[:, p], out=far)
            return (both[:, None] - far.astype(float) ** 2) / 2 - margin, (both[:, None] - near.astype(float) ** 2) / 2 + margin

        def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, g, held = None, None, []

            def out() -> pa.RecordBatch:
                blocks, least, most = every_block.value
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None
                anchor, slot, vec_id = (rows.column(i).to_numpy().astype(np.int64) if rows else np.zeros(0, np.int64) for i in (1, 2, 4))
                score = np.array([int(x) for x in rows.column(3).to_pylist()], object if kind is object else np.int64) if rows else np.zeros(0, np.int64)
                if ask == "own":
                    g.ask_own(k, kind)
                elif ask == "others":
                    place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
                    g.ask_others(anchor, place, vec_id, score, k, kind)
                else:
                    g.raise_floors(anchor, slot, score)
                both, dq = measured(g)
                floor, hi = g.floor.astype(float), g.hi.astype(float)
                wanted, worth = np.zeros(len(blocks), bool), np.zeros(len(blocks))
                for i in range(0, len(blocks), 512) if len(g.anchor) else ():
                    low, high = brackets(both, dq, least[i : i + 512], most[i : i + 512])
                    meets = (high[g.anchor] >= floor[:, None]) & (low[g.anchor] <= hi[:, None])
                    wanted[i : i + 512] = meets.any(0)
                    worth[i : i + 512] = np.where(meets, 1 + np.minimum(high[g.anchor], hi[:, None]) / (1 + both[g.anchor, None]), 0).sum(0)
                wanted[g.seen] = False
                taken = np.argsort(-worth, kind="stable")
                taken = taken[wanted[taken]]
                if first:
                    taken = g.seen = taken[:FIRST]
                state = pickle.dumps(g)
                rows = [(number, i // SLICE, -1, None, state) for i in range(0, max(len(taken), 1), SLICE)]
                rows += [(number, i // SLICE, i, int(blocks[x]), None) for i, x in enumerate(taken)]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["group", "slice", "place", "block", "state"])

            for b in batches:
                group, state = b.column(0).to_numpy(), b.column(5)
                starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
                for i, j in zip(starts, [*starts[1:], len(group)]):
                    if group[i] != number:
                        if g is not None:
                            yield out()
                        number, g, held = int(group[i]), pickle.loads(state[i].as_py()), []
                        i += 1
                    if j > i:
                        held.append(b.slice(i, j - i))
            if g is not None:
                yield out()

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, number = None, None

            def out() -> pa.RecordBatch:
                t, col = np.nonzero(best > lowest)
                cols = [np.full(len(t), number), g.anchor[t].astype(np.int32), g.slot[t].astype(np.int32), g.ids[g.anchor[t]], g.positive[t]]
                return pa.RecordBatch.from_arrays([*map(pa.array, cols), _decimals(g.worth[t]), _decimals(best[t, col]), pa.array(hit[t, col])], [x.split()[0] for x in HITS.split(", ")])

            for b in batches:
                for group, _, place, block, state, *raw in zip(*(c.to_pylist() for c in b.columns)):
                    if place < 0:
                        if g is not None:
                            yield out()
                        g, number = pickle.loads(state), group
                        both, dq = measured(g)
                        lowest = _lowest(kind)
                        best, hit = np.full((len(g.anchor), g.k), lowest, kind), np.full((len(g.anchor), g.k), LONG, np.int64)
                        slots = [np.flatnonzero(g.slot == s) for s in np.unique(g.slot)]
                        continue
                    ids, labels = (np.frombuffer(x, np.int64) for x in raw[:2])
                    rows, far = np.frombuffer(raw[2], packed).reshape(-1, width), np.frombuffer(raw[3], np.float32).reshape(len(ids), -1)
                    # The widest range of an anchor's targets, in which its rows' brackets must lie.
                    floor, hi = np.full(len(g.ids), np.inf), np.full(len(g.ids), -np.inf)
                    np.minimum.at(floor, g.anchor, g.floor.astype(float))
                    np.maximum.at(hi, g.anchor, g.hi.astype(float))
                    low, high = brackets(both, dq, far, far)
                    left = (high >= floor[:, None]) & (low <= hi[:, None]) & ((g.label[:, None] == labels) == g.same)
                    own = np.flatnonzero(g.home == block)
                    left[own, g.place[own]] = False
                    some, cols = np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0))
                    if not len(some):
                        continue
                    # What the brackets leave is checked exactly.
                    score = g.q[some].astype(kind) @ rows[cols].T.astype(kind)
                    score[~left[np.ix_(some, cols)]] = lowest
                    at = np.full(len(g.ids), -1)
                    at[some] = np.arange(len(some))
                    for t in slots:
                        t = t[at[g.anchor[t]] >= 0]
                        s = score[at[g.anchor[t]]]
                        s = np.where((s >= g.floor[t, None]) & (s <= g.hi[t, None]), s, lowest)
                        full = np.flatnonzero((s > lowest).any(1))
                        if not len(full):
                            continue
                        t, s = t[full], s[full]
                        pick = _best(s, g.k)
                        s = np.take_along_axis(s, pick, 1)
                        new_s, new_h = np.concatenate([best[t], s], axis=1), np.concatenate([hit[t], np.where(s > lowest, ids[cols][pick], LONG)], axis=1)
                        order = _order(new_s, new_h)[:, : g.k]
                        best[t], hit[t] = np.take_along_axis(new_s, order, 1), np.take_along_axis(new_h, order, 1)
                        g.floor[t] = np.maximum(g.floor[t], best[t, -1])
            if g is not None:
                yield out()

        spread, scratch, none = self._spread(), self.scratch, F.lit(None)
        known = states.select("group", F.lit(-1).alias("anchor"), F.lit(-1).alias("slot"), none.cast("decimal(38,0)").alias("score"), none.cast("long").alias("vec_id"), "state")
        if hits is not None:
            known = known.union(hits.select("group", "anchor", "slot", "score", "vec_id", none.cast("binary").alias("state")))
        known = known.repartition(spread, "group").sortWithinPartitions("group", "anchor", "slot", F.desc("score"), "vec_id")
        rows = scratch.save(known.mapInArrow(plan, "group long, slice int, place int, block long, state binary"))
        met = rows.where("place >= 0").drop("state").join(self.blocks.select("block", "ids", "labels", "rows", "dists"), "block")
        columns = ["group", "slice", "place", "block", "state", "ids", "labels", "rows", "dists"]
        both = rows.where("place < 0").withColumns({c: none.cast("binary") for c in columns[5:]}).select(columns).union(met.withColumn("state", none.cast("binary")).select(columns))
        dealt = both.repartition(spread, "group", "slice").sortWithinPartitions("group", "slice", "place")
        return rows.where("place < 0 and slice = 0").select("group", "state"), scratch.save(dealt.mapInArrow(scan, HITS))


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each target, in rank."""
    order = W.partitionBy("group", "anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(scratch: Scratch, vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: the hard negatives of each positive of each anchor.

    vectors: vec_id, label, v. Anchors are the rows whose vec_id every divides, in groups that visit blocks of the
    pivot table: first the most promising ones, which set floors, then all others whose brackets still reach a target;
    once for the positives and once for the negatives within the positives' ranges. A block that no bracket reaches
    is not read for a group, and rows are scored for an anchor's group only where a stored distance leaves them.
    No row, hit or target is capped. Rows that share a vec_id are rows of their own, ties go to the smaller vec_id, and an
    empty table, or one without anchors, gives no rows. Scores of more than 38 digits count as equal; those beyond a
    long are given as the nearest long.
    """
    table = PivotTable(scratch, vectors, every)
    if not table.asks:
        return vectors.sparkSession.createDataFrame([], RESULT)
    states, one = table.visit(table.groups(), None, "own", positives, True)
    states, two = table.visit(states, _first(one, positives), "again", positives, False)
    states, three = table.visit(states, _first(one.union(two), positives), "others", negatives, True)
    _, four = table.visit(states, _first(three, negatives), "again", negatives, False)
    long = lambda c: F.greatest(F.least(F.col(c), F.lit(LONG)), F.lit(-LONG - 1)).cast("long")
    found = _first(three.union(four), negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), long("positive_score").alias("positive_score"), long("score").alias("negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return scratch.keep(mine(scratch, mined_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))


ORACLE_SQL = f"""
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % {RELABEL} = 0 then (label + 1) % {LABELS} else label end as label,
         list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and vec_id is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
s as (
  select a.rid as a, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         cast(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as score
  from v a join v c on a.rid <> c.rid where a.vec_id % {EVERY} = 0),
p as (
  select *, row_number() over (partition by a order by score desc, vec_id) as k from s where same
  qualify k <= {POSITIVES}),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         cast(row_number() over (partition by p.a, p.k order by s.score desc, s.vec_id) as integer) as rank
  from p join s on s.a = p.a and not s.same
  where {LEAST} * p.score <= 100 * s.score and 100 * s.score <= {MOST} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
