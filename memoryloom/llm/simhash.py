"""SimHash near-duplicates by meet-in-the-middle ball hashing, and for the pipeline those by Jaccard similarity beside them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.llm.lines import similar_links
from memoryloom.llm.shared import Scratch, components, plain, steps

RADIUS = 3
#: Bits of the three parts that the first, coarse round leaves out in turn.
PARTS = (range(0, 21), range(21, 42), range(42, 64))


#: Least Jaccard similarity of the pipeline's stage, and bands of so many hashes each: at it, all but 3 pairs in a million
#: share a band by the formula.
SIMILARITY, BANDS, HASHES = 0.8, 32, 5
#: Texts of a part of a large bucket.
BLOCK = 512
SEEN_TEXTS = 1_000_000

_RNG = np.random.default_rng(12)
_FLIP = _RNG.integers(0, 2**64, BANDS * HASHES, np.uint64)
_TIMES = _RNG.integers(0, 2**63, BANDS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, (BANDS, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of shingle words; of all words if they are no more, and none if there is none."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[s:e], 42) for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits as a signed integer: each set if it is set in over half of the shingles' XXH64."""
    return _majority(shingle_hashes(words, shingle))


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp of whole texts: words between ASCII white space, A-Z lower-cased; no word (or null): 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t.encode().lower().split(), shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys [set, band] of sets of hashes, none of them empty: MinHash with a hash function for each of BANDS * HASHES."""
    points, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat((points ^ a) * b, first) for a, b in zip(_FLIP, _TIMES)], axis=1)
    least ^= least >> np.uint64(32)
    keys = (least.reshape(len(sets), BANDS, HASHES) * _BAND).sum(2, dtype=np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp as in fingerprints, line_id (XXH64 of the text), and the bands where a task meets a text with words first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for part, texts in steps(batches):
            fps, ids, new, new_at = [], np.zeros(len(texts), np.uint64), [], []
            for k, raw in enumerate(t.encode() for t in texts):
                hashes = shingle_hashes(raw.lower().split(), shingle)
                fps.append(_majority(hashes))
                ids[k] = x = xxhash.xxh64_intdigest(raw, 42)
                if len(hashes) and x not in seen:
                    seen.add(x)
                    new.append(hashes)
                    new_at.append(k)
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            sizes = np.zeros(len(texts) + 1, np.int32)
            sizes[np.array(new_at, np.int64) + 1] = BANDS
            flat = band_keys(new).ravel() if new else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), pa.array(ids.view(np.int64)), bands], ["doc_id", "fp", "line_id", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, line_id long, bands array<long>")


def jaccard_links(scratch: Scratch, docs: DataFrame, found: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links a, b (fingerprints) that connect what texts of least Jaccard similarity of their shingles connect.

    MinHash bands make candidates, and the similarity of the whole sets is verified. Equal texts are one.
    """
    sets = lambda texts: [np.unique(shingle_hashes(t.encode().lower().split(), shingle)).view(np.int64) for t in texts]
    texts = docs.select(docs["text"].cast("string").alias("line")).where("line is not null")
    links = similar_links(scratch, texts, found, least, lambda: sets, BLOCK, sets)
    of = found.select("line_id", "fp").distinct()
    both = links.join(of.toDF("a2", "fa"), F.col("a") == F.col("a2")).join(of.toDF("b2", "fb"), F.col("b") == F.col("b2"))
    return both.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).where("a <> b").distinct()


def _mask(*bits: int) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


#: Flips of one bit, and of two bits in the same half of the word: of any three bits two lie in one half.
ONE = [_mask(i) for i in range(64)]
TWO = [_mask(i, j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]


def _odd() -> F.Column:
    return F.bit_count(F.col("fp")) % 2 == 1


def close_enough(fps: DataFrame) -> DataFrame:
    """The fingerprints (distinct, column fp) that may have another within RADIUS bits; none that has one is missed.

    Of three differing bits at most two lie outside the part that holds most of them. So the word without that part
    has a middle within one bit of both: every fingerprint emits, for each part left out, the rest and its flips of
    one bit. This round is 132 narrow rows a fingerprint and spares nearly all of them the 560 of the exact one.
    """
    rest = [(~_mask(*p), [0] + [_mask(b) for b in range(64) if b not in p]) for p in PARTS]
    rows = F.array(*[F.struct(F.lit(k).cast("byte").alias("part"), F.lit(keep).alias("keep"), F.lit(flip).alias("flip")) for k, (keep, flips) in enumerate(rest) for flip in flips])
    keys = fps.select("fp", F.explode(rows).alias("v")).select("fp", F.xxhash64(F.col("v.part"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip"))).alias("key"))
    return keys.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).where("n > 1").select("fp").distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """Links a, b among distinct fingerprints whose components are those of all pairs within RADIUS (3) bits.

    Two words at three bits differ in parity. The even one emits its variants at two bits, the odd one those at one
    bit, and they meet at an even key; pairs at two bits meet at one bit from either, pairs at one bit at the even
    word itself. A key's rows are within 0, 1 or 2 bits of it (a ball's volume bounds them), and by the triangle
    inequality all lie within RADIUS of the nearest one, unless that is at two bits itself. So linking each row to
    the nearest replaces the pairs of a key. The pairs are deduplicated and their distance is verified.
    """
    one, two = (F.array(*map(F.lit, x)) for x in (ONE, TWO))
    flips = F.when(_odd(), one).otherwise(F.concat(F.array(F.lit(0).cast("long")), one, two))
    keys = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    # Odd words leave their own key out, so an odd key holds only words at one bit, which lie within two of each other.
    far = F.bit_count(F.col("key").bitwiseXOR(F.col("fp"))).cast("byte")
    near = F.min(F.struct(far.alias("far"), F.col("fp").alias("fp"))).over(W.partitionBy("key"))
    met = keys.withColumn("near", near).where("near.far < 2 and near.fp <> fp").select(F.least("near.fp", "fp").alias("a"), F.greatest("near.fp", "fp").alias("b"))
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def classes(spark: SparkSession, docs: DataFrame, shingle: int = 3, extra: bool = False, similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach.

    similarity: texts of that Jaccard similarity or more are linked beside those of close fingerprints. Without it,
    texts are read once and the rest moves identifiers and fingerprints. Equal fingerprints are one node, so a large
    group of copies costs one. Null ids are passed over as component_id unless a group has no other. Repeated rows
    repeat, null and empty texts share the fingerprint 0, and an empty table has no rows. Only the columns doc_id and
    text are read. A text is hashed whole, in memory of a few times its size.
    """
    with Scratch(spark) as scratch:
        found = scratch.save(sketches(docs, shingle) if similarity else fingerprints(docs, shingle))
        fps = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
        near = scratch.save(close_enough(fps.select("fp")), small=True)
        links = ball_links(near)
        if similarity:
            links = links.union(jaccard_links(scratch, docs, found, shingle, similarity))
        names = components(scratch, links)
        # Most fingerprints are of one document; only the others need a name and a join, of written tables on either side.
        several = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
        owner = several.join(names, several.fp == names.node, "left").where("n > 1 or root is not null")
        owner = scratch.save(owner.select("fp", "least", F.coalesce("root", "fp").alias("root")), small=True)
        least = owner.groupBy(F.col("root").alias("root2")).agg(F.min("least").alias("component_id"))
        owner = scratch.keep(owner.join(least, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "component_id"))
        scratch.kept.add(scratch.paths[id(found)])
    joined = found.join(owner, found.fp == owner.fp2, "left")
    return joined.select("doc_id", "fp", F.when(F.col("fp2").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(spark: SparkSession, docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without those whose group has a smaller doc_id; all columns stay. Rows with a null doc_id stay as they are.

    Groups are those of close fingerprints and of texts of SIMILARITY or more. Null and empty texts are one group, of
    equal rows all stay or go, an empty table stays empty, and other columns may have any names.
    """
    found = classes(spark, docs, shingle, similarity=SIMILARITY)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows, doc, _ = plain(docs)
    return rows.join(gone, rows[doc].cast("long") == gone["gone_id"], "left_anti").toDF(*docs.columns)
