"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memoryloom.llm.bpe import PairTable, WordTable, gather, merge
from memoryloom.llm.shared import steps

MODEL = "piece_bpe_32k.model"
#: Words whose ids a worker remembers; beyond that it starts anew.
CACHE_WORDS = 400_000
SPACE = "▁"


class PieceBpe:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback and a dummy prefix.

    Text is cut into words that no piece can cross: before a run of spaces that follows another character, and around
    newlines. Words are merged together, in rounds over flat arrays; the order in each word is that of the library's
    queue: best rank first, then leftmost.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
            raise ValueError("a piece of this model crosses words")
        self.unknown = sp.unk_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        #: Id of a code point that is a piece, else -1.
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        rank = np.unique([-sp.get_score(i) for i in range(n)], return_inverse=True)[1]
        pairs = np.array([(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids])
        self.table = PairTable(n, pairs[:, 0], pairs[:, 1], pairs[:, 2], rank[pairs[:, 2]])
        self.text_of = [" ⁇ ".encode() if i == self.unknown else self.byte_of.get(i, b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.decimal = _flat([f"{i},".encode() for i in range(n)])
        self.bytes = _flat(self.text_of)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and how many each has; characters that are no piece become their UTF-8 bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.chars[points]
        odd = np.flatnonzero(sym < 0)
        ids, counts = merge(self.table, sym, sizes)
        if not len(odd):
            return ids, counts
        # Symbols without a piece never merge, so they come out in the order in which they went in.
        raw = [chr(p).encode("utf-8", "surrogatepass") for p in points[odd]]
        more = np.ones(len(ids), np.int64)
        holes = np.flatnonzero(ids < 0)
        more[holes] = [len(x) for x in raw]
        out = np.repeat(ids, more)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(more)])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(ends)

    @staticmethod
    def words(text: str) -> list[str]:
        return _WORDS(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return self.encode_words(self.words(text))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; a leading space is the dummy prefix and goes. Bytes that are no UTF-8 become U+FFFD each."""
        raw = b"".join(self.text_of[x] for x in ids)
        return _utf8(raw[1:] if raw[:1] == b" " and ids[0] not in self.byte_of else raw)


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items' bytes joined, their starts and their sizes."""
    sizes = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes


def _strings(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, counts: np.ndarray, head: int = 0, tail: int = 0) -> pa.Array:
    """A string for each text: the table's entries of its ids, less head bytes in front and tail bytes behind."""
    flat, start, size = table
    size = size[ids]
    data = gather(flat, start[ids], size)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    first, last = ends[:-1] + head * (counts > 0), ends[1:] - tail * (counts > 0)
    keep = np.ones(len(data), bool)
    if head:
        keep[ends[:-1][counts > 0]] = False
    if tail:
        keep[ends[1:][counts > 0] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep] if head or tail else data)).cast(pa.string())


_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall


def _utf8(raw: bytes) -> str:
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]
    return out


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[PieceBpe, WordTable]:
    bpe = PieceBpe(path)
    return bpe, WordTable(bpe.encode_words, CACHE_WORDS)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined) and decoded text of every document, whole; null text counts as empty.

    Rows map to rows one to one, so repeated rows, null ids and an empty table need nothing of their own. Each step
    encodes the words of some two million characters that the worker has not met lately in vectorised calls; the
    decoded text is put together from the ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = _model(path)
        for part, texts in steps(batches):
            ids, n = known.lookup(map(bpe.words, texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _strings(bpe.decimal, ids, n, tail=1), _strings(bpe.bytes, ids, n, head=1)], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and digests of ids and decoded text of every document."""
    from pyspark.sql import functions as F

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
