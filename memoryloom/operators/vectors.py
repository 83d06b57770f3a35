"""The embedding hook, a semantic index over a DataFrame, and manifests of what an index holds."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.functions import digest
from memoryloom.operators import gate, rank
from memoryloom.operators.ledger import latest


class Embedder(Protocol):
    """What turns texts into vectors. Only a local one may see rows above internal."""

    is_local: bool

    def embed(self, texts: pd.Series) -> pd.Series: ...


@dataclass(frozen=True)
class HashedWords:
    """A local embedder: counts of words by their CRC-32, to unit length; a text without words is all zeros."""

    dimensions: int = 64
    is_local: bool = True

    def embed(self, texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = [0.0] * self.dimensions
            for w in re.findall("[a-z0-9]+", (text or "").lower()):
                v[zlib.crc32(w.encode()) % self.dimensions] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            return [x / n for x in v]

        return texts.map(one)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """Rows that the embedder may see, with their embedding; the privacy filter stands below the Python stage."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return embedder.embed(texts)

    return rows.where(gate.may_embed(embedder.is_local)).withColumn("embedding", run(text))


@dataclass(frozen=True)
class Index:
    """Members (id, embedding, label, entities) of a semantic index; every change gives a new one."""

    members: DataFrame

    def index(self, rows: DataFrame) -> Index:
        """With rows in place of members of their ids; of an id that comes twice the row is undefined."""
        new = rows.select(self.members.columns)
        return Index(self.members.join(new.select("id"), "id", "left_anti").unionByName(new))

    def remove(self, ids: DataFrame) -> Index:
        """Without the ids; vectors and entities go together since they stand in one row."""
        return Index(self.members.join(ids.select("id"), "id", "left_anti"))

    def search(self, query: list[float], k: int, entities: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The k best members that pass where, which is applied before any score; shared entities add to a score."""
        if k < 0 or any(not math.isfinite(x) for x in query):
            raise ValueError("the search is not valid")
        rows = self.members if where is None else self.members.where(where)
        boost = F.arrays_overlap("entities", F.array(*[F.lit(e) for e in entities])) if entities else None
        return rank.top(rows, rank.cosine(F.col("embedding"), query), k, boost).select("id", "score")


def delta(members: DataFrame, operations: DataFrame, capacity: int) -> DataFrame:
    """Members after a batch of operations (id, op of add or remove, ordinal), the last per id deciding.

    More members than capacity are an error, found by a count beside the rows.
    """
    last = latest(operations, "id", F.col("ordinal")).select("id", "op")
    after = members.select("id").join(last, "id", "full_outer").where("op is null or op = 'add'").select("id")
    n = after.agg(F.count(F.lit(1)).alias("n"))
    fits = F.when(F.col("n") > capacity, F.raise_error(F.lit("the manifest is full")).cast("boolean")).otherwise(F.lit(True))
    return after.crossJoin(n.select(fits.alias("fits"))).where("fits").select("id")  # n is one row


def manifest(members: DataFrame, tenant: str, space: str) -> DataFrame:
    """Scope digest, member digest and number of members, by buckets of ids, so no task gathers all of them."""
    scope = digest.sha256(digest.framed(F.lit("vector-scope.v1")), digest.framed(F.lit(tenant)), F.lit(space).cast("binary"))
    bucket = F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 4)
    b = members.groupBy(bucket.alias("bucket")).agg(digest.of_set(F.col("id"), "\0").alias("x"), F.count(F.lit(1)).alias("c"))
    return b.agg(digest.of_buckets(F.col("x"), F.col("bucket")).alias("digest"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).select(scope.alias("scope"), "digest", "n")


def persist(members: DataFrame, path: str, tenant: str, space: str) -> None:
    """Members and their manifest under path; the manifest is written last, so a half-written set is never loaded."""
    members.write.mode("overwrite").parquet(f"{path}/members")
    manifest(members.sparkSession.read.parquet(f"{path}/members"), tenant, space).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, tenant: str, space: str) -> DataFrame:
    """Members under path if their digests are those of the manifest and the scope is the caller's."""
    members = spark.read.parquet(f"{path}/members")
    if spark.read.parquet(f"{path}/manifest").first() != manifest(members, tenant, space).first():
        raise ValueError("the manifest doesn't fit its scope or members")
    return members


Engine = Callable[[DataFrame], DataFrame]
"""A pluggable step of consolidation: memories in, a plan out."""


def proposed(memories: DataFrame, engine: Engine, columns: list[str]) -> DataFrame:
    """The plan of an engine, if it has the columns agreed upon."""
    plan = engine(memories)
    if plan.columns != columns:
        raise ValueError("the engine's plan has other columns")
    return plan


#: Queries, and rows, that are multiplied at a time; a cell has so many blocks of either at most.
QUERIES, TILE, BLOCKS = 1024, 1024, 8
#: Scores count in these parts; places of rows stay below SPAN, so a score and a place are one exact double.
PARTS, SPAN = 1e9, 1 << 22


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors as rows; missing components are 0, shorter vectors are filled with zeros, and zeros stay zeros."""
    lists = vectors.combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(n), n.max(initial=0)))
    m[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy()
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(q: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k highest of rounded score * SPAN - place, in descending order, 0 where there are no more; only positive scores count."""
    best, start, step = np.zeros((len(q), k)), 0, max(1, TILE // 8)
    while start < len(m):
        s = q @ m[start : start + step].T
        # An equal score at a later place doesn't count, so the next higher one is asked for.
        i, j = np.nonzero(s > (np.ceil(best[:, -1:] / SPAN) + 0.4) / PARTS)
        found = np.concatenate([best.ravel(), np.rint(s[i, j] * PARTS) * SPAN - (start + j)])
        i = np.concatenate([np.repeat(np.arange(len(q)), k), i])
        order = np.lexsort((-found, i))
        i, found = i[order], found[order]
        best = found[np.arange(len(i)) - np.searchsorted(i, i) < k].reshape(-1, k)
        start, step = start + step, TILE
    return best


def top_for(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id and score: for each query (query_id, embedding) its k rows (id, embedding) of highest positive cosine.

    Queries and rows are dealt by hashes over a grid of cells, rows over its columns and queries over its lines; a row goes to
    each line and a query to each column, by a shuffle, never by a broadcast. A cell holds BLOCKS blocks of either or about
    so, multiplies them a block at a time and leaves k rows a query, cut once more by tasks before they meet. Scores
    count to nine places, ties go to the smaller id. A null vector takes no part, a missing component is 0, a shorter
    vector is filled with zeros, and one of length 0 scores 0.
    """
    spark, most = rows.sparkSession, max(1, k)
    n, of = max(1, queries.count()), max(1, rows.count())
    cells = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # What is exchanged is least where lines * rows is columns * queries; k hits of a third of a vector each go with a query.
    between = lambda x, have, block: max(-(-have // (block * BLOCKS)), min(math.ceil(x), -(-have // block)))
    columns = between(math.sqrt(cells * of / (n * (1 + most / 3))), of, TILE)
    lines = between(cells / columns, n, QUERIES)

    def cell(mine: pa.Table, asked: pa.Table) -> pa.Table:
        mine = mine.sort_by("id")
        ids, m, q = mine["id"].combine_chunks(), _matrix(mine["e"]), _matrix(asked["e"])
        width = min(m.shape[1], q.shape[1])
        m = np.ascontiguousarray(m[:, :width])
        best = np.concatenate([np.zeros((0, most)), *[_best(q[i : i + QUERIES, :width], m, most) for i in range(0, len(q), QUERIES)]])
        at, _ = np.nonzero(best > 0)
        best = best[best > 0]
        score = np.ceil(best / SPAN)
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), "id": ids.take(pa.array((score * SPAN - best).astype(np.int64))), "score": score / PARTS})

    def dealt(df: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        e = F.col("embedding") if dict(df.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
        df = df.where("embedding is not null").select(F.col(key).cast("string").alias(key), e.alias("e"))
        return df.withColumn(own, F.pmod(F.xxhash64(key, "e"), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))).groupBy("line", "column")

    met = dealt(rows, "id", "column", columns, "line", lines).cogroup(dealt(queries, "query_id", "line", lines, "column", columns))
    hits = met.applyInArrow(cell, "query_id string, id string, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
