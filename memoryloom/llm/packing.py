"""Best-fit packing of tokenised documents: a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.llm.bpe import PairTable, WordTable, merge
from memoryloom.llm.shared import Scratch, steps

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 400_000
#: Multiplicative weights: phases, rounds and passes at most, the gap to the bound at which they stop, the rate at which a
#: covered share lowers a length's value, and what a configuration may lose against the best, more with each round.
PHASES, ROUNDS, PASSES, GAP, RATE, LOSS = 2, 8, 6, 0.01, 0.5, 0.002
#: Pieces of a length that one task ranks.
RANKED_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordBpe:
    """Ids of words as a tokenizers file of byte-level BPE with word ends, lower case and letter runs gives them.

    Words of characters below U+0250 are lower-cased, split and merged here, all of a batch at once; words with other
    characters or the mark of a special token go through the library one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.loads(self.library.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.final = np.array([vocab[c + end] for c in names], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rows = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.table = PairTable(len(vocab), rows[:, 0], rows[:, 1], rows[:, 2], np.arange(len(rows)))
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\u0000-\u024f]*").fullmatch

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, which hold no ASCII white space, joined, and how many each has."""
        parts, per, odd = [], np.zeros(len(words), np.int64), {}
        whole = b"\n".join(words).decode()
        simple = self.plain(whole) and "<|" not in whole
        for i, w in enumerate((whole.lower() if simple else whole).split("\n") if words else ()):
            if not simple:
                if not self.plain(w) or "<|" in w:
                    odd[i] = self.library.encode(w, add_special_tokens=False).ids
                    continue
                w = w.lower()
            some = [w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".,|" and w[:-1].isalpha() else self.split(w)
            parts += some
            per[i] = len(some)
        raw = [p.encode() for p in parts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        codes = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[codes]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[codes[last]]
        ids, counts = merge(self.table, sym, sizes)
        size = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per)])])
        if odd:
            cut = np.split(ids, np.cumsum(size)[:-1])
            for i, x in odd.items():
                cut[i], size[i] = np.array(x, np.int32), len(x)
            ids = np.concatenate(cut)
        return ids, size


def _byte_names() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTable:
    return WordTable(WordBpe(path).encode_words, CACHE_WORDS)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty and gives one piece that holds the end id alone. The tokenizer drops white space and
    merges within what stands between it, so text is cut at ASCII white space and the ids of each cut are kept in a
    bounded table of the worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for part, _ in steps(batches):
            ids, n = known.lookup_split(part.column(1))
            ends, rows = np.cumsum(n), []
            whole = ids.astype("<u4").tobytes()
            for doc, a, b in zip(part.column(0).to_pylist(), (ends - n).tolist(), ends.tolist()):
                mine = whole[4 * a : 4 * b] + end
                for k in range(0, len(mine), 4 * capacity):
                    piece = mine[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


def knapsack(value: np.ndarray) -> np.ndarray:
    """The most value that each capacity holds, by dynamic programming, where a piece of length l is worth value[l]. value[0] is unused."""
    cap = len(value) - 1
    best = np.zeros(cap + 1)
    for c in range(1, cap + 1):
        best[c] = max(best[c - 1], (best[c - 1 :: -1][:c] + value[1 : c + 1]).max())
    return best


def _column(first: int, value: np.ndarray, best: np.ndarray, least: float, open_: np.ndarray, skip: int) -> list[int] | None:
    """Lengths of a configuration that holds first and is worth least or more, else None.

    It is filled up with the longest open length of those that the knapsack can still bring to least; skip passes over
    that many of the longest ones at the second place.
    """
    got, gain, left = [first], value[first], len(value) - 1 - first
    while left:
        some = np.where(open_[1 : left + 1], value[1 : left + 1] + best[left - 1 :: -1][:left], -1.0)
        ok = np.flatnonzero(some >= least - gain - 1e-12)
        if not len(ok):
            break
        k = int(ok[-1 - min(skip, len(ok) - 1)]) + 1
        got.append(k)
        gain, left, skip = gain + value[k], left - k, 0
    return got if gain >= least - 1e-12 else None


def configurations(counts: np.ndarray, rounds: int = ROUNDS, gap: float = GAP) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional solution of: least sum of x with (times a length occurs in configurations) . x >= counts, and a lower bound.

    Multiplicative weights. The dual value of a length starts in proportion to it, which makes all full sequences
    equal, and shrinks exponentially with the share of its pieces that is covered. A round covers every length once
    more, in passes: the knapsack prices the lengths still open, and from the length furthest behind on configurations
    are added that are worth nearly the best, each as much as covers one of its lengths for this round. What only
    fits configurations below a fair price, the dual value of all pieces over the bound, waits and gains in value. No
    length is covered beyond the rounds, so the solution divided by them takes no more pieces than there are. The
    bound is the dual value over the knapsack's best, of single rounds or their mean. Rounds end when cost over the
    least covered share is within gap of it; without that, they start anew from the mean dual values, with half the
    rate, and the best of these solutions counts. A length that no round reached gets the best configuration that holds it.
    """
    cap, n = len(counts) - 1, counts.astype(float)
    there = np.flatnonzero(counts > 0)
    if not len(there):
        return {}, 0.0
    base, bound, best_ratio, solution = there / cap, 0.0, np.inf, {}
    for phase in range(PHASES):
        rate, share, mean, found, cost = RATE / 2**phase, np.zeros(cap + 1), np.zeros(cap + 1), {}, 0.0
        for turn in range(1, rounds + 1):
            value = np.full(cap + 1, -1.0)
            value[there] = base * np.exp(-rate * np.minimum(share[there] - share[there].min(), 100))
            best = knapsack(value)
            mean[there] += value[there] / best[cap]
            bound = max(bound, float(n[there] @ value[there] / best[cap]))
            if turn % 4 == 0:
                bound = max(bound, float(n[there] @ mean[there] / knapsack(np.where(counts > 0, mean, -1.0))[cap]))
            room = np.where(counts > 0, turn - share, 0.0)
            fair = (1 - LOSS * min(turn, 10)) * float(n[there] @ value[there]) / bound
            for _ in range(PASSES):
                open_ = room > 1e-9
                priced = np.where(open_, value, -1.0)
                best = knapsack(priced)
                least = max(best[cap] * (1 - LOSS), fair)
                added = 0.0
                for first in there[np.lexsort((-there, -room[there]))].tolist() if best[cap] >= least else ():
                    skip = 0
                    while room[first] > 1e-9 and skip < 3:
                        got = _column(first, priced, best, least, room > 1e-9, skip)
                        if got is None:
                            skip += 1
                            continue
                        ks, times = np.unique(got, return_counts=True)
                        amount = float((room[ks] * n[ks] / times).min())
                        amount = np.floor(amount + 1e-9) if amount >= 1 else amount
                        share[ks] += times * amount / n[ks]
                        room[ks] -= times * amount / n[ks]
                        found[tuple(got)] = found.get(tuple(got), 0.0) + amount
                        added += amount
                cost += added
                if not added:
                    break
            least_share = share[there].min()
            if least_share > 0 and cost / least_share <= (1 + gap) * bound:
                break
        for first in there[share[there] < 1e-9].tolist():
            got = _column(first, value, knapsack(value), value[first], counts > 0, 0)
            found[tuple(got)] = amount = turn * n[first] / got.count(first)
            cost, share[first] = cost + amount, turn
        if (ratio := cost / share[there].min()) < best_ratio:
            best_ratio, solution = ratio, {c: x / turn for c, x in found.items()}
        if best_ratio <= (1 + gap) * bound:
            break
        base = mean[there] / turn
    return solution, bound


def rounded(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Configurations of the program a whole number of times, and the pieces left.

    Whole parts first, which always fit; then one more of each configuration by its fraction, largest first, while its
    pieces are there. The program is solved anew for what is left, as long as that takes at least a tenth of it.
    """
    left, out = counts.copy(), []
    while left.any():
        before = int(left.sum())
        found = sorted(configurations(left, rounds)[0].items(), key=lambda p: (-(p[1] % 1), p[0]))
        parts = [(*np.unique(c, return_counts=True), c, x) for c, x in found]
        for up in (0, 1):
            for ks, times, c, x in parts:
                n = int(min(np.floor(x + 1e-9) if not up else 1, (left[ks] // times).min()))
                if n > 0:
                    left[ks] -= n * times
                    out.append((c, n))
        if before - left.sum() < before / 10:
            break
    return out, left


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over runs of equal sequences, so the work depends on the number of lengths."""
    cap, left = len(left) - 1, left.copy()
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(cap + 1)]
    for length in range(cap, 0, -1):
        todo = int(left[length])
        room = length
        while todo:
            while room <= cap and not open_[room]:
                room += 1
            if room > cap:
                held, bins = (), -(-todo // (cap // length))
                space = cap
            else:
                held, bins = open_[room].pop()
                space = room
            each = space // length
            use = min(bins, -(-todo // each))
            full, rest = divmod(min(todo, use * each), each)
            if full:
                open_[space - each * length].append((held + (length,) * each, full))
            if rest:
                open_[space - rest * length].append((held + (length,) * rest, 1))
            if room <= cap and bins > full + (rest > 0):
                open_[room].append((held, bins - full - (rest > 0)))
            todo -= full * each + rest
            room = length
    return [x for group in open_ for x in group]


def plan(counts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(lengths in a sequence, number of such sequences), and the number of sequences: the program rounded, the few pieces left by best fit."""
    out, left = rounded(counts, rounds)
    out += best_fit(left)
    return out, sum(n for _, n in out)


def _slots(planned: list[tuple[tuple[int, ...], int]], cap: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of its pieces, the run's first sequence, the place in the sequence."""
    runs: list[list[tuple[int, int]]] = [[] for _ in range(cap + 1)]
    sizes: list[list[int]] = [[] for _ in range(cap + 1)]
    first = 0
    for lengths, n in planned:
        at = 0
        for length in lengths:
            runs[length].append((first, at))
            sizes[length].append(n)
            at += length
        first += n
    return [(np.cumsum([0, *s])[:-1], np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x], np.int64)) for x, s in zip(runs, sizes)]


def pack(scratch: Scratch, pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """pieces (with a column length from 1 to capacity) and their sequence_id and offset.

    Only the histogram, capacity rows at most, comes to the driver. Pieces of one length are interchangeable: each
    gets a rank among them, counted in salted buckets so that a frequent length is dealt over many tasks, and takes
    the slot of that rank. The slots are runs, few per configuration, and go to the tasks with the function.
    """
    spark = scratch.spark
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        hist[length] = n
    planned, _ = plan(hist, rounds)
    slots = _slots(planned, capacity)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(hist.sum()) // RANKED_ROWS)
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    base = salted.groupBy("length", "bucket").count()
    base = base.select(F.col("length").alias("l2"), F.col("bucket").alias("b2"), (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("base"))
    within = salted.withColumn("k", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = within.join(base, (F.col("length") == F.col("l2")) & (F.col("bucket") == F.col("b2"))).withColumn("rank", F.col("base") + F.col("k") - 1)
    keep = pieces.columns
    names = [*keep, "sequence_id", "offset"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(len(keep)).to_numpy(), b.column(len(keep) + 1).to_numpy()
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                starts, sequences, offsets = slots[length[group[0]]]
                run = np.searchsorted(starts, rank[group], "right") - 1
                seq[group], at[group] = sequences[run] + rank[group] - starts[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(seq), pa.array(at)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*keep, F.col("length").alias("_l"), F.col("rank").alias("_r")).mapInArrow(place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed. An empty table gives no pieces; equal rows give equal pieces, each packed; no other column is read."""
    with Scratch(spark) as scratch:
        pieces = scratch.save(token_pieces(docs, path or public_tokenizers.path(MODEL), capacity))
        scratch.kept.add(scratch.paths[id(pieces)])
        return pack(scratch, pieces, capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
