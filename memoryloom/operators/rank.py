"""Lexical, vector and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.functions.text import tokens

#: Weights of kinds, and what a shared entity adds to a score.
WEIGHTS = {"profile": 1.0, "semantic": 0.8, "procedural": 0.7, "episodic": 0.4}
BOOST = 0.1


def query_tokens(query: str) -> list[str]:
    import re

    if len(query) > 4096:
        raise ValueError("the query is too long")
    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def overlap(text: Column, query: str) -> Column:
    """Number of distinct query tokens in the text."""
    return F.size(F.array_intersect(tokens(text), F.array(*[F.lit(x) for x in query_tokens(query)]).cast("array<string>"))).cast("long")


def lexical(rows: DataFrame, query: str) -> DataFrame:
    """Rows that share a token with the query, and overlap; their order is overlap descending, id."""
    return rows.withColumn("overlap", overlap(F.col("text"), query)).where("overlap > 0")


def positions(hits: DataFrame, score: str) -> DataFrame:
    """hits with their position by score, highest first, then id: counts of the scores are the base, so rows are sorted within a score only."""
    n = hits.groupBy(F.col(score).alias("score2")).agg(F.count(F.lit(1)).alias("n"))
    base = n.withColumn("base", F.sum("n").over(W.orderBy(F.desc("score2"))) - F.col("n"))  # a row for each score, as many as a query has tokens
    within = F.row_number().over(W.partitionBy(score).orderBy("id"))
    found = hits.join(base, F.col(score) == F.col("score2")).withColumn("position", (F.col("base") + within).cast("long"))
    return found.drop("score2", "n", "base")


def postings(rows: DataFrame) -> DataFrame:
    """The inverted index: token, id; to be kept clustered by token."""
    return rows.select(F.explode(tokens(F.col("text"))).alias("token"), "id")


def probe(index: DataFrame, query: str) -> DataFrame:
    """id and overlap from an inverted index; the filter on tokens reaches the scan."""
    return index.where(F.col("token").isin(query_tokens(query))).groupBy("id").agg(F.count(F.lit(1)).alias("overlap"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in doubles."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: list[float]) -> Column:
    """Cosine similarity; 0 where either norm is 0."""
    q = F.array(*[F.lit(float(x)) for x in b])
    own = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norm = sum(float(x) * float(x) for x in b) ** 0.5
    return F.when((own == 0) | F.lit(norm == 0), 0.0).otherwise(dot(a, q) / (own * norm))


def top(rows: DataFrame, score: Column, k: int, boost: Column | None = None) -> DataFrame:
    """The k best rows of positive score, ties by id; boost: whether BOOST is added first. A heap a task, then one merge."""
    total = score if boost is None else score + F.when(boost, BOOST).otherwise(0.0)
    return rows.withColumn("score", total).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def importance(valid_from: Column, now: Column, kind: Column) -> Column:
    """Weight of the kind over 1 + age in whole days / 30; the future counts as today."""
    days = F.greatest(F.lit(0), F.datediff(now, valid_from))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[kind]
    return weight / (1 + days / 30)
