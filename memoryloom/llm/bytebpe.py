"""Byte-level BPE encoding and decoding by a monoid tree reduction."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.bpe import PairTable, WordTable, gather, merge
from memoryloom.llm.shared import steps

MODEL = "byte_bpe_50k.tiktoken"
#: Chunks whose ids a worker remembers, and ids of them; beyond either it forgets.
CACHE_CHUNKS, CACHE_IDS = 400_000, 8_000_000
#: Fixed value: the characters that match \s in the pattern (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0  -     　"


class ChunkTable(WordTable):
    """A table of chunks whose ids are bounded too, since a chunk may be very long."""

    def _make_room(self) -> None:
        if self.used > CACHE_IDS:
            self._reset()
        super()._make_room()


class ByteBpe:
    """Encoder and decoder over ranks of byte strings, in which any two neighbours that are a token together may merge.

    Encoded texts are a monoid. What joins two of them rests on one property: a row of tokens is the encoding of its
    bytes exactly if every two neighbours are the encoding of theirs, because the first merge across a border would
    also be the first one there if both tokens stood alone. So encodings join by encoding anew a window around the
    border; if the window's outermost tokens come out as they were, the pairs that it shares with what lies outside
    are as before, and nothing outside can change. Otherwise that side of the window doubles, to the side's end at
    most, where nothing is left to check. A word of n bytes takes log n levels and O(n log n) steps in all, whatever
    its bytes are.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte is no token")
        self.pattern = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        get = self.ranks.get
        pairs = np.array([(a, b, made) for t, made in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None], np.int64).reshape(-1, 3)
        self.table = PairTable(size, pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 2])
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        sizes = np.zeros(size, np.int64)
        for t, i in self.ranks.items():
            sizes[i] = len(t)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes
        self.flat = np.frombuffer(b"".join(t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[ids], self.size[ids])

    def _joined(self, tok: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring encodings joined pair by pair: tok holds left[i] tokens, then right[i]; of a node that is alone right is 0."""
        start = np.cumsum(left + right) - (left + right)
        border = start + left
        ka, kb = np.minimum(left, 1) * (right > 0), np.minimum(right, 1)
        new, made = np.zeros(len(left), np.int64), []
        where = np.zeros(len(left), np.int64)
        todo, base = np.flatnonzero(right > 0), len(tok)
        while len(todo):
            a, b = ka[todo], kb[todo]
            one = slice(None)
            if (a + b).max() == 2:  # what two tokens become is found once for all places where they meet
                _, some, one = np.unique(tok[border[todo] - 1].astype(np.int64) * len(self.size) + tok[border[todo]], return_index=True, return_inverse=True)
                window, width = gather(tok, border[todo[some]] - 1, a[some] + b[some]), a[some] + b[some]
            else:
                window, width = gather(tok, border[todo] - a, a + b), a + b
            raw = self.byte_ids[self.bytes_of(window)]
            ends = np.concatenate([[0], np.cumsum(self.size[window])])[np.concatenate([[0], np.cumsum(width)])]
            ids, n = merge(self.table, raw, np.diff(ends))
            first, n = (np.cumsum(n) - n)[one], n[one]
            left_ok = (a == left[todo]) | (ids[first] == tok[border[todo] - a])
            right_ok = (b == right[todo]) | (ids[first + n - 1] == tok[border[todo] + b - 1])
            ok = left_ok & right_ok
            done = todo[ok]
            new[done], where[done] = n[ok], base + first[ok]
            made.append(ids)
            base += len(ids)
            ka[todo] = np.where(left_ok, a, np.minimum(2 * a, left[todo]))
            kb[todo] = np.where(right_ok, b, np.minimum(2 * b, right[todo]))
            todo = todo[~ok]
        # Each node: what lies before the window, what the window became, and what lies behind it.
        sizes = np.stack([left - ka, new, right - kb], axis=1)
        starts = np.stack([start, where, border + kb], axis=1)
        return gather(np.concatenate([tok, *made]), starts.ravel(), sizes.ravel()), sizes.sum(1)

    def tree(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings in one flat array, and how many each has. All nodes of a level of all trees join at once."""
        tok, count = self.byte_ids[raw], np.ones(len(raw), np.int64)
        nodes = sizes.astype(np.int64)
        while len(nodes) and nodes.max() > 1:
            up = (nodes + 1) // 2
            first = np.repeat(np.cumsum(nodes) - nodes, up)
            k = np.arange(int(up.sum())) - np.repeat(np.cumsum(up) - up, up)
            left = first + 2 * k
            paired = 2 * k + 1 < np.repeat(nodes, up)
            right = np.where(paired, count[np.minimum(left + 1, len(count) - 1)], 0)
            tok, count = self._joined(tok, count[left], right)
            nodes = up
        return tok, np.where(sizes > 0, np.append(count, 0)[np.minimum(np.cumsum(nodes) - nodes, len(count))], 0)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, joined, and how many each has. A match that is a token is that token, whatever its merges give."""
        # Letters, with a space before them or not, are one match.
        matches = [[c] if (c[1:] if c[0] == " " else c).isalpha() else self.pattern(c) for c in chunks]
        words = [m.encode() for m in chain.from_iterable(matches)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, n = self.tree(np.frombuffer(b"".join(words), np.uint8), sizes)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        if (other := (whole >= 0) & (n != 1)).any():
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(other).tolist():
                parts[i] = whole[i : i + 1].astype(np.int32)
            ids, n = np.concatenate(parts), np.where(other, 1, n)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))])]
        return ids, np.diff(ends)

    def encode(self, text: str) -> list[int]:
        return self.encode_chunks(chunks_of(text))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.bytes_of(np.array(ids, np.int64)).tobytes()


#: Chunks end before white space that follows anything else: no match of the pattern crosses such a place, nor does what
#: stands on one side of it change the matches on the other.
chunks_of = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[ByteBpe, ChunkTable]:
    bpe = ByteBpe(path)
    return bpe, ChunkTable(bpe.encode_chunks, CACHE_CHUNKS, 20_000)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of data, as bytes, of so many items each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of every document, whole; null text counts as empty.

    A text is a tree whose lower nodes lie within matches of the pattern, where encodings join by windows, and whose
    upper nodes lie between chunks, where no match crosses and ids are appended. Decoding is the same tree with tokens'
    bytes at the leaves and concatenation at the nodes; all nodes of a step are put together in one pass. Rows map to
    rows one to one, so repeated rows, null ids and an empty table need nothing of their own, and no other column is
    read. Steps hold some two million characters, or one text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = _model(path)
        for part, texts in steps(batches):
            ids, n = known.lookup(map(chunks_of, texts))
            sizes = np.diff(np.concatenate([[0], np.cumsum(bpe.size[ids])])[np.concatenate([[0], np.cumsum(n)])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _binary(ids.astype("<u4"), n), _binary(bpe.bytes_of(ids), sizes)], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of ids and decoded bytes of every document."""
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
