"""Fuzzy line deduplication: MinHash candidates, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.bpe import gather
from memoryloom.llm.shared import Scratch, components, forest, plain, steps

#: Characters of a shingle, and least Jaccard similarity. Shorter lines have no shingle: only equal ones are the same.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of so many bins each: at a similarity of 0.8, 97.7 % of pairs share a band by the formula, at 0.9 all but 3 in
#: 100,000; fewer bins let unrelated lines meet, in number as the square of the input.
BANDS, BINS = 16, 7
#: Hashes of a shingle; each falls into one of the bins, of which every one keeps its least value.
THROWS = 4
SEEN_LINES = 1_000_000
#: Words of 64 bits in the filter of candidate lines; a table of that many rows at most is broadcast.
FILTER_WORDS = 1 << 19
#: Lines of a part of a large bucket; a task compares those of two parts at a time.
BLOCK = 512
#: Pivots that a task tries on a group of lines before it looks for candidates by rare shingles.
TRIES = 24
#: Counters of shingles by which rare ones are told, whatever the input's size.
COUNTERS = 1 << 16

_RNG = np.random.default_rng(11)
_MIX = _RNG.integers(0, 2**31, SHINGLE, np.uint32) * np.uint32(2) + np.uint32(1)
_THROW = _RNG.integers(0, 2**31, THROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 2**63, (BANDS, BINS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(lines: list[str]) -> np.ndarray:
    """Band keys [line, band] of lines of SHINGLE characters or more.

    One-permutation MinHash with several throws: each shingle's hashes fall into BANDS * BINS bins and every bin
    keeps the least. A bin that stays empty, in a short line, takes the value of the next one that did not.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - SHINGLE + 1
    h = points[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        h = h * np.uint32(31) + points[k : n + k] * _MIX[k]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    line = np.repeat(np.arange(len(lines)), size)
    inside = line[:n] == line[SHINGLE - 1 :]
    h, base = h[inside], line[:n][inside] * (BANDS * BINS)
    least = np.full(len(lines) * BANDS * BINS, 2**32 - 1, np.uint32)
    for a in _THROW:
        x = h * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        at = base + (((x >> np.uint32(16)) * np.uint32(BANDS * BINS)) >> np.uint32(16))
        np.minimum.at(least, at, (x << np.uint32(16)) | (x >> np.uint32(16)))
    least = least.reshape(len(lines), -1)
    full = least < 2**32 - 1
    if not full.all():
        width = least.shape[1]
        nxt = np.where(np.hstack([full, full]), np.arange(2 * width), 4 * width)
        nxt = np.minimum.accumulate(nxt[:, ::-1], axis=1)[:, ::-1][:, :width] % width
        least = np.take_along_axis(least, nxt, 1)
    keys = (least.reshape(len(lines), BANDS, BINS).astype(np.uint64) * _BAND).sum(2, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


class Shingler:
    """Shingle sets as sorted arrays of exact codes, comparable within one object.

    Characters get numbers of 12 bits as they come, five of which fill a code. A line with a character beyond the
    4095 first gets negative codes, from a table, for the shingles that hold it.
    """

    def __init__(self):
        self.number = np.zeros(0x110000, np.int64)
        self.known, self.rare = 0, {}

    def sets(self, lines: list[str]) -> list[np.ndarray]:
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.unique(points)
        new = new[self.number[new] == 0][: 4095 - self.known]
        self.number[new] = np.arange(self.known + 1, self.known + 1 + len(new))
        self.known += len(new)
        codes = self.number[points]
        n = max(len(points) - SHINGLE + 1, 0)
        whole, odd = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(SHINGLE):
            whole = whole << 12 | codes[k : n + k]
            odd |= codes[k : n + k] == 0
        start = np.cumsum(size) - size
        for at in np.flatnonzero(odd).tolist():
            i = int(np.searchsorted(start, at, "right")) - 1
            if at + SHINGLE <= start[i] + size[i]:
                s = lines[i][at - start[i] : at - start[i] + SHINGLE]
                whole[at] = -self.rare.setdefault(s, len(self.rare) + 1)
        out = []
        for i, j in zip(start.tolist(), (start + size - SHINGLE + 1).tolist()):
            x = np.sort(whole[i : max(j, i)])
            out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
        return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    x = np.concatenate([a, b])
    x.sort()
    return int(np.count_nonzero(x[1:] == x[:-1]))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line_id of every line that is not blank, and the bands where a task meets one of SHINGLE characters or more first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        h64 = xxhash.xxh64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for part, texts in steps(batches):
            doc, text_hash, no, ids, new, new_at = [], [], [], [], [], []
            for d, t in zip(part.column(0).to_pylist(), texts):
                whole = None
                for k, line in enumerate(t.split("\n")):
                    if not line or line.isspace():
                        continue
                    if whole is None:
                        whole = signed(h64(t.encode(), 42))
                    x = signed(h64(line.encode(), 42))
                    doc.append(d)
                    text_hash.append(whole)
                    no.append(k)
                    ids.append(x)
                    if len(line) >= SHINGLE and x not in seen:
                        seen.add(x)
                        new.append(line)
                        new_at.append(len(ids) - 1)
            if len(seen) > SEEN_LINES:
                seen.clear()
            sizes = np.zeros(len(ids) + 1, np.int32)
            sizes[np.array(new_at, np.int64) + 1] = BANDS
            flat = band_keys(new).ravel() if new else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(no, pa.int32()), pa.array(ids, pa.int64()), bands], ["doc_id", "text_hash", "line_no", "line_id", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, line_no int, line_id long, bands array<long>")


def linked(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of least Jaccard similarity, exactly, that connect what all such pairs connect: a forest.

    A few sets are compared pair by pair, but for those already connected. Many are compared with one pivot at a time
    through postings, and a pivot is taken outside the largest component as long as there is one not yet used: a
    similar pair across components has a side there, so none goes unseen, and near copies need few pivots. What TRIES
    pivots leave, as lines of one template that aren't similar do, is compared where prefixes of rare shingles meet.
    """
    parent, found = list(range(len(sets))), []
    size = np.fromiter(map(len, sets), np.int64, len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: int, j: int) -> None:
        if (x := root(i)) != (y := root(j)):
            parent[x] = y
            found.append((i, j))

    if len(sets) <= 24:
        sizes = size.tolist()
        for j in range(1, len(sets)):
            for i in range(j):
                a, b = sizes[i], sizes[j]
                if min(a, b) >= least * max(a, b) - 1e-9 and root(i) != root(j):
                    both = _shared(sets[i], sets[j])
                    if both >= least * (a + b - both) - 1e-9:
                        join(i, j)
        return found
    codes, name = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(name, kind="stable")
    owners, ends = owner[order], np.cumsum(np.bincount(name, minlength=len(codes)))
    first = np.concatenate([[0], ends[:-1]])
    names = np.split(name, np.cumsum(size)[:-1])
    used = np.zeros(len(sets), bool)
    for turn in count():
        roots = np.fromiter(map(root, range(len(sets))), np.int64, len(sets))
        kinds, n = np.unique(roots, return_counts=True)
        todo = np.flatnonzero((roots != kinds[n.argmax()]) & ~used)
        if not len(todo):
            return found
        if turn == TRIES and len(todo) > TRIES and (pairs := _rare_pairs(sets, names, np.bincount(name), todo, least)) is not None:
            for a, b in pairs:
                if root(a) != root(b):
                    both = _shared(sets[a], sets[b])
                    if both >= least * (size[a] + size[b] - both) - 1e-9:
                        join(a, b)
            return found
        p = int(todo[0])
        used[p] = True
        at = names[p]
        both = np.bincount(gather(owners, first[at], ends[at] - first[at]), minlength=len(sets))
        both[p] = 0
        for i in np.flatnonzero(both >= least * (size + size[p] - both) - 1e-9).tolist():
            if i != p:
                join(p, i)


def prefix(size: np.ndarray, least: float) -> np.ndarray:
    """Of sets in one common order, two of least similarity share one of so many first elements."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def _rare_pairs(sets: list[np.ndarray], names: list[np.ndarray], times: np.ndarray, todo: np.ndarray, least: float) -> list[tuple[int, int]] | None:
    """Pairs of a set in todo and another whose prefixes, rarest elements first, meet, and whose sizes allow least similarity.

    None if prefixes meet so often that one pivot after the other is less work.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    first = [x[np.lexsort((x, times[x]))][:k] for x, k in zip(names, prefix(size, least).tolist())]
    owner, token = np.repeat(np.arange(len(sets)), [len(x) for x in first]), np.concatenate(first)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    wanted = np.zeros(len(sets), bool)
    wanted[todo] = True
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    width = np.diff(np.append(start, len(token)))
    if (np.add.reduceat(wanted[owner].astype(np.int64), start) * width).sum() > 32 * len(sets):
        return None
    seen: set[tuple[int, int]] = set()
    for i, n in zip(start[width > 1].tolist(), width[width > 1].tolist()):
        group = owner[i : i + n]
        for a in group[wanted[group]].tolist():
            near = group[(np.minimum(size[group], size[a]) >= least * np.maximum(size[group], size[a]) - 1e-9) & (group != a)]
            seen.update((min(a, b), max(a, b)) for b in near.tolist())
    return sorted(seen)


def shingle_codes(lines: list[str]) -> list[np.ndarray]:
    """Distinct shingles of each line as 64-bit codes that are the same in every task."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(points) - SHINGLE + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ points[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    start = np.cumsum(size) - size
    return [np.unique(h[i : max(j, i)]) for i, j in zip(start.tolist(), (start + size - SHINGLE + 1).tolist())]


def _needed(lines: DataFrame, need: DataFrame) -> DataFrame:
    """id and line of the lines (column line) whose xxhash64 stands in need (distinct), once each.

    A fixed-size bit table of those ids, joined in memory, turns most others away before the exact join. It is a
    filter alone; where it fills up, the join does its work.
    """
    word = lambda c: F.pmod(F.shiftrightunsigned(F.col(c), 6), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    filled = need.groupBy(word("need").alias("word")).agg(F.bit_or(bit("need")).alias("bits"))
    lines = lines.select("line", F.xxhash64("line").alias("id"))
    lines = lines.join(F.broadcast(filled), word("id") == F.col("word")).where(F.col("bits").bitwiseAND(bit("id")) != 0)
    # An inner join: the optimiser moves a semi-join in front of the filter.
    return lines.join(need, F.col("id") == F.col("need")).dropDuplicates(["id"]).select("id", "line")


def _compared(scratch: Scratch, rows: DataFrame, texts: DataFrame, least: float, sets_of: Callable, block: int) -> DataFrame:
    """Links a, b of groups (key, i, j) of rows, whose line_id has its line in texts: forests, for each run of groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, made = None, [], [], sets_of()

        def out() -> pa.RecordBatch:
            pairs = linked(sets, least) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in (b.slice(k, block // 2) for b in batches for k in range(0, b.num_rows, block // 2)):
            done = []
            for key, i, j, x, own in zip(*(c.to_pylist() for c in batch.columns[:4]), made(batch.column(4).to_pylist())):
                if (key, i, j) != group:
                    done.append(out())
                    group, ids, sets = (key, i, j), [], []
                ids.append(x)
                sets.append(own)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        yield out()

    both = rows.join(texts, F.col("line_id") == F.col("id")).select("key", "i", "j", "line_id", "line")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "line_id")
    return dealt.mapInArrow(lambda batches: forest(run(batches)), "a long, b long")


def _meeting(scratch: Scratch, buckets: DataFrame) -> DataFrame:
    """key and line_id, once each, of the keys that several lines have."""
    # One exchange serves both sides; the keys of several lines are few, so they are the table and the rows pass by.
    dealt = buckets.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "key")
    several = dealt.groupBy(F.col("key").alias("k2")).agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi")).where("lo <> hi")
    return scratch.save(dealt.join(several.select("k2").hint("shuffle_hash"), F.col("key") == F.col("k2")).select("key", "line_id").distinct())


def _by_prefix(scratch: Scratch, ids: DataFrame, texts: DataFrame, least: float, codes_of: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """key and line_id of the lines (line_id): a key for each element of a prefix of rare shingles, so similar lines meet.

    Rare ones are told by a fixed number of counters, summed by tasks and once more; any order that all lines share
    keeps every similar pair, and counts that are far off only make keys more common.
    """
    rows = ids.join(texts, F.col("line_id") == F.col("id")).select("line_id", "line")
    slot = lambda x: (x >> np.uint64(48)).astype(np.int64)

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for _, lines in (x for b in batches for x in steps([b], "line")):
            for x in codes_of(lines):
                n += np.bincount(slot(x.view(np.uint64)), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    times = np.zeros(COUNTERS, np.int64)
    for r in rows.mapInArrow(counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # COUNTERS rows at most
        times[r.slot] = r.n
    shared = scratch.spark.sparkContext.broadcast(times)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines in (x for b in batches for x in steps([b], "line")):
            sets = [x.view(np.uint64) for x in codes_of(lines)]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            first = [x[np.lexsort((x, shared.value[slot(x)]))][:k] for x, k in zip(sets, prefix(size, least).tolist())]
            own = np.repeat(part.column(0).to_numpy(), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(own)], ["key", "line_id"])

    return _meeting(scratch, rows.mapInArrow(keys, "key long, line_id long"))


def _links(scratch: Scratch, lines: DataFrame, met: DataFrame, least: float, sets_of: Callable[[], Callable[[list[str]], list[np.ndarray]]], block: int, codes_of: Callable[[list[str]], list[np.ndarray]] | None = shingle_codes, texts: DataFrame | None = None) -> DataFrame:
    """Links a, b (line ids) that connect what the similar pairs of all buckets (key, line_id) connect.

    lines has the texts (column line) of the ids, their xxhash64; sets_of() gives what makes sorted sets of codes of them.
    Buckets of the same lines, as near copies make in many bands, count once. A bucket of more than block lines is
    dealt into parts that are linked each for itself. Of what that leaves apart, a similar pair has a side outside the
    bucket's largest component. Near copies leave few lines outside, and they alone are held against every part, in
    groups of block. Where more than block lines are left, as by lines of a template that aren't similar, all lines
    of such buckets meet anew by prefixes of their rare shingles (codes_of), which costs a few keys a line and not the
    bucket's square. No similar pair stays unlinked either way.
    """
    mark = [F.count(F.lit(1)).alias("n"), F.min("line_id").alias("lo"), F.bit_xor(F.xxhash64("line_id")).alias("x"), F.bit_xor(F.xxhash64("line_id", F.lit(1))).alias("y")]
    once = met.groupBy("key").agg(*mark).groupBy("n", "lo", "x", "y").agg(F.min("key").alias("once"))
    once = scratch.save(once.select("once", F.ceil(F.col("n") / block).cast("int").alias("parts")), small=True)
    rows = met.join(once, F.col("key") == F.col("once")).select("key", "line_id", "parts", F.pmod(F.xxhash64("line_id"), F.col("parts")).cast("int").alias("i"))
    rows = scratch.save(rows.withColumn("j", F.lit(-1)))
    if texts is None:
        texts = scratch.save(_needed(lines, scratch.save(rows.select(F.col("line_id").alias("need")).distinct(), small=True)), small=True)
    links = _compared(scratch, rows, texts, least, sets_of, block)
    large = rows.where("parts > 1")
    if large.isEmpty():
        return links
    links = scratch.save(links, small=True)
    names = components(scratch, links, forests=True)
    named = large.join(names, large.line_id == names.node, "left").select("key", "line_id", "parts", "i", F.coalesce("root", "line_id").alias("cls"))
    named = scratch.save(named)
    sizes = named.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("k2"))
    most = sizes.agg(F.max_by("cls", F.struct("n", "cls")).alias("top"), F.ceil((F.sum("n") - F.max("n")) / block).cast("int").alias("groups"))
    most = scratch.save(most.where("groups > 0"), small=True)
    many = F.col("groups") > (1 if codes_of else 2**31 - 1)
    left = named.join(most, F.col("key") == F.col("k2"))
    minor = F.pmod(F.xxhash64("line_id", F.lit(1)), F.col("groups")).cast("int")
    rest = scratch.save(left.where(~many & (F.col("cls") != F.col("top"))).select("key", "line_id", "parts", minor.alias("j"), "groups"), small=True)
    apart = rest.select("key", "line_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "j")
    few = most.where(~many)
    whole = named.join(few, F.col("key") == F.col("k2")).select("key", "line_id", "i", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("j"))
    more = links.union(_compared(scratch, whole.select("key", "line_id", "i", "j").union(apart.select("key", "line_id", "i", "j")).distinct(), texts, least, sets_of, block))
    if codes_of is None or most.where(many).isEmpty():
        return more
    again = _by_prefix(scratch, scratch.save(left.where(many).select("line_id").distinct(), small=True), texts, least, codes_of)
    return more.union(_links(scratch, lines, again, least, sets_of, block, None, texts))


def similar_links(scratch: Scratch, lines: DataFrame, seen: DataFrame, least: float, sets_of: Callable[[], Callable[[list[str]], list[np.ndarray]]], block: int = BLOCK, codes_of: Callable[[list[str]], list[np.ndarray]] = shingle_codes) -> DataFrame:
    """Links a, b that connect what the similar pairs among lines connect, from seen (line_id and bands or null); forests for each task."""
    buckets = seen.where("bands is not null").select("line_id", F.explode("bands").alias("key"))
    return _links(scratch, lines, _meeting(scratch, buckets), least, sets_of, block, codes_of)


def line_classes(scratch: Scratch, docs: DataFrame, seen: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Components of similar lines: node, root (line ids), for lines that have a similar one."""
    lines = docs.select(F.explode(F.split(docs["text"].cast("string"), "\n", -1)).alias("line")).where(F.length("line") >= SHINGLE)
    return components(scratch, similar_links(scratch, lines, seen, least, lambda: Shingler().sets), forests=True)


def dropped_lines(scratch: Scratch, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and dropped (array of line_no, owner_id, owner_no) of the documents that lose lines.

    Of each class of equal or similar lines the first by doc_id, text and line number stays (a null id counts as
    least). Copies of a row are the same document and lose the same lines. Lines are counted and their first place is
    found with partial aggregates, so a line that stands in a third of all documents is one row a task.
    """
    seen = scratch.save(occurrences(docs))
    names = line_classes(scratch, docs, seen, least)
    # Only lines that repeat or have a similar one go on; the others are counted, with a hash aggregate, and left.
    counted = seen.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    some = counted.join(names, counted.line_id == names.node, "left").where("n > 1 or root is not null")
    some = scratch.save(some.select(F.col("line_id").alias("some_id"), F.coalesce("root", "line_id").alias("cls")), small=True)
    rows = scratch.save(seen.drop("bands").join(some, F.col("line_id") == F.col("some_id")).select("doc_id", "text_hash", "line_no", "cls"))
    place = F.struct("doc_id", "text_hash", "line_no")
    owners = rows.groupBy(F.col("cls").alias("cls2")).agg(F.count(F.lit(1)).alias("total"), F.min(place).alias("owner")).where("total > 1")
    # Written, so that the join has two exchanges of rows and Spark can split a very common class.
    owners = scratch.save(owners, small=True)
    gone = rows.join(owners, F.col("cls") == F.col("cls2")).where(~place.eqNullSafe(F.col("owner")))
    gone = gone.select("doc_id", "text_hash", F.struct("line_no", F.col("owner.doc_id").alias("owner_id"), F.col("owner.line_no").alias("owner_no")).alias("x"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("x")).alias("dropped"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its number of lines, the dropped ones, and for each of them line:document:line of the one kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        gone = scratch.keep(dropped_lines(scratch, docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.xxhash64("text").alias("h"))
    gone = gone.toDF("d2", "h2", "dropped")
    out = rows.join(gone, rows.doc_id.eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    empty = F.coalesce("dropped", F.array().cast("array<struct<line_no:int,owner_id:bigint,owner_no:int>>"))
    text = lambda x: F.concat_ws(":", x["line_no"].cast("string"), F.coalesce(x["owner_id"].cast("string"), F.lit("")), x["owner_no"].cast("string"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(empty).cast("long").alias("n_dropped"), F.array_join(F.transform(empty, text), ",").alias("dropped"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, most: float = 0.8) -> DataFrame:
    """docs with repeated lines taken out of the text; a document of which they hold over most of the characters goes.

    Null and empty texts stay as they are; equal rows lose the same lines; an empty table stays empty; other columns
    may have any names. A text of any length is cut in slices of its lines, in one pass.
    """
    with Scratch(spark) as scratch:
        gone = scratch.keep(dropped_lines(scratch, docs)).toDF("gone_id", "gone_hash", "gone_lines")
    rows, doc, text = plain(docs)
    joined = rows.join(gone, rows[doc].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(rows[text].cast("string")) == F.col("gone_hash")), "left")
    # What stands between one dropped line and the next is a slice. An array of one binds the lines, so that they are split once.
    ends = F.concat(F.array(F.lit(-1)), F.transform("gone_lines", lambda x: x["line_no"]), F.array(F.size(F.split(text, "\n", -1))))
    between = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["e"]) - 2), lambda k: F.slice(x["l"], F.get(x["e"], k) + 2, F.get(x["e"], k + 1) - F.get(x["e"], k) - 1))
    kept = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("l"), ends.alias("e"))), lambda x: F.array_join(F.flatten(between(x)), "\n"))[0]
    cut = F.when(F.col("gone_lines").isNull(), F.col(text)).otherwise(kept)
    stays = F.col("gone_lines").isNull() | (F.length(cut) >= F.length(text) * (1 - most))
    return joined.where(stays).select(*(cut.alias(c) if c == text else c for c in rows.columns)).toDF(*docs.columns)
