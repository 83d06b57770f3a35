"""Byte-pair merges over flat arrays, and tables that keep what words were encoded to."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
#: Hash of pairs: 64 bits over the golden ratio, of which the upper SLOT_BITS count.
SPREAD, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 19


#: Symbols from which on a word is merged by itself.
LONG = 2048


class PairTable:
    """Merges of symbol pairs: what a pair becomes, its rank (least first), and whether its places may merge at once.

    A merge is safe if no pair that contains what it makes has as good a rank: then nothing it brings about can come
    before the other places of the same pair.
    """

    def __init__(self, size: int, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray):
        order = np.argsort(left.astype(np.int64) * size + right)
        left, right, made, rank = left[order], right[order], made[order], rank[order]
        self.size = size
        self.keys = np.append(left.astype(np.int64) * size + right, 2**62)
        self.made = np.append(made, -1).astype(np.int32)
        self.rank = np.append(rank, NONE).astype(np.int32)
        used = np.full(size, NONE, np.int64)
        np.minimum.at(used, left, rank)
        np.minimum.at(used, right, rank)
        self.safe = np.append(used[made] > rank, False)
        # Base symbols in the longest symbol, which bounds how far a merge makes itself felt.
        length = np.ones(size, np.int64)
        while (length[made] < length[left] + length[right]).any():
            np.maximum.at(length, made, length[left] + length[right])
        self.reach = 2 * int(length.max()) + 4
        # One slot per hash value; keys that share theirs with another are marked and searched for.
        self.shift = np.uint64(64 - SLOT_BITS)
        slot = self._slot(self.keys[:-1])
        self.slots = np.full(1 << SLOT_BITS, len(self.keys) - 1, np.int32)
        self.slots[slot] = np.arange(len(slot), dtype=np.int32)
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1 << SLOT_BITS) > 1)] = -1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's place in the table (the last one: none) and its rank. A symbol of -1 pairs with nothing."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = self.slots[self._slot(key)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.searchsorted(self.keys, key[shared])
        at[self.keys[at] != key] = len(self.keys) - 1
        return at, self.rank[at]


def merge(table: PairTable, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words in one flat array, merged until no pair remains: the symbols left, and how many each word has.

    Every round finds each word's least rank, merges its leftmost place, or all places that don't overlap where that
    is safe, and compacts the arrays; words without a pair leave.
    """
    words = len(sizes)
    if len(sizes) and sizes.max() > LONG:
        ends, long = np.cumsum(sizes), sizes > LONG
        ids, counts = merge(table, sym[~np.repeat(long, sizes)], sizes[~long])
        parts, n = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], np.zeros(words, np.int64)
        out, short = [], iter(parts)
        for i in range(words):
            out.append(_merge_long(table, sym[ends[i] - sizes[i] : ends[i]]) if long[i] else next(short))
            n[i] = len(out[-1])
        return np.concatenate(out), n
    sym, word = sym.astype(np.int32), np.repeat(np.arange(words, dtype=np.int32), sizes)
    out_sym, out_word = [], []
    if len(sym):
        pair, rank = (np.append(x, y).astype(np.int32) for x, y in zip(table.find(sym[:-1], sym[1:]), (len(table.keys) - 1, NONE)))
        rank[:-1][word[1:] != word[:-1]] = NONE
    while len(sym):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, len(sym)))
        over = best == NONE
        best = np.repeat(best, size)
        if over.any():
            live = best < NONE
            out_sym.append(sym[~live])
            out_word.append(word[~live])
            best, sym, word, pair, rank = best[live], sym[live], word[live], pair[live], rank[live]
            if not len(sym):
                break
        at = np.flatnonzero(rank == best)
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        if len(at) > first.sum():
            safe = table.safe[pair[at]]
            k = np.arange(len(at))
            run = first | np.append(True, at[1:] != at[:-1] + 1)
            even = (k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0
            lead = np.maximum.accumulate(np.where(first, k, 0))
            at = at[first | (even & safe & safe[lead])]
        sym[at] = table.made[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        sym, word, pair, rank = sym[keep], word[keep], pair[keep], rank[keep]
        redo = np.concatenate([at, at[at > 0] - 1])
        nxt = np.minimum(redo + 1, len(sym) - 1)
        pair[redo], got = table.find(sym[redo], sym[nxt])
        got[(word[redo] != word[nxt]) | (nxt == redo)] = NONE
        rank[redo] = got
    if not out_sym:
        return np.zeros(0, np.int32), np.zeros(words, np.int64)
    sym, word = np.concatenate(out_sym), np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=words)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    m, k = x, 1
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[: len(x) - width + 1], m[width - k :][: len(x) - width + 1])


def _merge_long(table: PairTable, sym: np.ndarray) -> np.ndarray:
    """merge() of one long word, in rounds that take the least rank of every surroundings, not of the whole word.

    A merge of a better rank can only reach a place by growing a symbol up to it, so no further than the longest
    symbol; nor can what a place itself brings about reach further. A pair that is the least within twice that on
    either side therefore merges in the end as it does now, whatever happens beyond. Of equal ranks only the leftmost
    merges, or every other one of a run whose start is such a place, where nothing that this makes can come before.
    """
    d = table.reach
    sym = sym.astype(np.int32)
    pair, rank = (np.append(x, y).astype(np.int32) for x, y in zip(table.find(sym[:-1], sym[1:]), (len(table.keys) - 1, NONE)))
    while True:
        wide = np.concatenate([np.full(d, NONE, np.int32), rank, np.full(d, NONE, np.int32)])
        at = np.flatnonzero((rank < NONE) & (rank == _least(wide, 2 * d + 1)))
        if not len(at):
            return sym
        left = _least(wide[: len(rank) + d - 1], d)
        k, mine = np.arange(len(at)), rank[at]
        first = np.append(True, (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1]))
        lead = np.maximum.accumulate(np.where(first, k, 0))
        whole = (at == 0) | (rank[at - 1] != mine)
        alone = first & (left[at] > mine)
        at = at[alone | (table.safe[pair[at]] & ((k - lead) % 2 == 0) & whole[lead])]
        sym[at] = table.made[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        sym, pair, rank = sym[keep], pair[keep], rank[keep]
        redo = np.concatenate([at, at[at > 0] - 1])
        redo = redo[redo < len(sym) - 1]
        pair[redo], rank[redo] = table.find(sym[redo], sym[redo + 1])
        rank[-1] = NONE


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at start and have the given sizes, joined."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordTable(dict):
    """Numbers of words and, by number, the ids they were encoded to. A word is encoded once, in a batch with others.

    It holds about limit words and then forgets those that came once, or all if that frees too few, so a worker's
    memory is bounded whatever it reads.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int, batch: int = 5000):
        super().__init__()
        self.encode, self.limit, self.batch = encode, limit, batch
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Drops the words that came at most once since the last time."""
        stay = np.flatnonzero(self.hits[: len(self)] > 1)
        if 2 * len(stay) > self.limit:
            return self._reset()
        words = list(self)
        words = [words[i] for i in stay.tolist()]
        start, size, flat = self.start[stay], self.size[stay], self.flat
        self._reset()
        self.update(zip(words, range(len(words))))
        for name in ("start", "size", "hits"):
            self._room(name, len(words))
        self.flat = gather(flat, start, size)
        self.used = len(self.flat)
        self.start[: len(words)], self.size[: len(words)] = np.cumsum(size) - size, size

    def __missing__(self, word) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))

    def _learn(self) -> None:
        at = len(self) - len(self.new)
        self._room("hits", len(self))
        for i in range(0, len(self.new), self.batch):
            some = self.new[i : i + self.batch]
            flat, size = self.encode(some)
            self._room("flat", self.used + len(flat))
            self._room("start", at + len(some))
            self._room("size", at + len(some))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[at : at + len(some)] = self.used + np.cumsum(size) - size
            self.size[at : at + len(some)] = size
            self.used += len(flat)
            at += len(some)
        self.new = []

    def lookup(self, texts: Iterable[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, which are lists of words, joined; and how many each text has."""
        texts = list(texts)
        self._make_room()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        return self._found(np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum())), counts)

    def lookup_split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """lookup() of texts (null: empty) whose words, as bytes, stand between ASCII white space; a step's distinct words alone become Python objects."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten()
        full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word there
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        counts = np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])])
        coded = words.filter(full).dictionary_encode()
        self._make_room()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        return self._found(numbers[coded.indices.to_numpy(zero_copy_only=False)], counts)

    def _make_room(self) -> None:
        if len(self) > self.limit:
            self._forget()

    def _found(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._learn()
        self.hits[: len(self)] += np.bincount(numbers, minlength=len(self))
        size = self.size[numbers]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.flat, self.start[numbers], size), np.diff(total[ends])
