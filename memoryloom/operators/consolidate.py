"""Duplicate and contradiction consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.functions.text import normalized, statement_parts


#: Words of 64 bits in the filter of repeated digests; a table of that many rows at most is broadcast.
FILTER_WORDS = 1 << 19


def _digested(memories: DataFrame, *columns: str) -> DataFrame:
    """The columns and a digest of the normalized text; never null, so no filter on it makes the text be read and hashed twice."""
    return memories.select(*columns, F.coalesce(F.sha2(normalized(F.col("text")), 256), F.lit("")).alias("digest"))


def _of_repeated(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Rows whose digest may be in again (d2), before anything of them is exchanged.

    A bit table of the repeated digests, of a fixed size, is joined in memory. It is a filter alone: what it lets
    through in error goes in the join that follows.
    """
    h = lambda c: F.xxhash64(F.col(c))
    word = lambda c: F.pmod(F.shiftrightunsigned(h(c), 6), F.lit(FILTER_WORDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), h(c).bitwiseAND(F.lit(63)).cast("int"))
    filled = again.groupBy(word("d2").alias("word")).agg(F.bit_or(bit("d2")).alias("bits"))
    return rows.join(F.broadcast(filled), word("digest") == F.col("word")).where(F.col("bits").bitwiseAND(bit("digest")) != 0).drop("word", "bits")


def duplicate_rows(memories: DataFrame) -> DataFrame:
    """id, normalized and the rank by (valid_from, id) of memories whose normalized text repeats.

    Copies are counted by a digest of the text and valid_from with partial sums; the counts of earlier days are the
    base of a rank, so rows are sorted per digest and day only, and a very common text is dealt over its days. Only
    rows of repeated texts, with their texts, are exchanged and ranked, and no text is a key.
    """
    days = _digested(memories, "valid_from").groupBy(F.col("digest").alias("d2"), F.col("valid_from").alias("v2")).agg(F.count(F.lit(1)).alias("c"))
    same = W.partitionBy("d2")
    days = days.withColumn("n", F.sum("c").over(same)).where("n > 1").withColumn("base", F.sum("c").over(same.orderBy("v2")) - F.col("c"))
    rows = _of_repeated(_digested(memories, "id", "valid_from", "text"), days)
    known = rows.join(days, (F.col("digest") == F.col("d2")) & F.col("valid_from").eqNullSafe(F.col("v2")))
    within = F.row_number().over(W.partitionBy("digest", "valid_from").orderBy("id"))
    return known.select("id", normalized(F.col("text")).alias("normalized"), (F.col("base") + within).alias("rank"))


def duplicate_plan(memories: DataFrame) -> DataFrame:
    """One row per group of equal normalized text: the first member by (valid_from, id), all members in that order, their number.

    The groups are found on the text's digest with partial counts; texts and member lists are exchanged for repeated
    ones alone.
    """
    again = _digested(memories).groupBy(F.col("digest").alias("d2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _of_repeated(_digested(memories, "id", "valid_from", "text"), again)
    members = members.join(again.select("d2"), F.col("digest") == F.col("d2"), "left_semi")
    order = F.struct("valid_from", "id")
    return members.groupBy("digest").agg(
        F.min_by("id", order).alias("canonical_id"),
        F.min_by("text", order).alias("canonical_text"),
        F.min("valid_from").alias("valid_from"),
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]), ",").alias("superseded"),
        F.count(F.lit(1)).alias("n"),
    )


def staged(memories: DataFrame) -> DataFrame:
    """id, prefix, tail and valid_from of memories whose statement has a prefix."""
    norm = normalized(F.col("text"))
    prefix, tail = statement_parts(norm)
    return memories.select("id", prefix.alias("prefix"), tail.alias("tail"), "valid_from").where("prefix <> ''")


def contradictions(memories: DataFrame) -> DataFrame:
    """newer and older id of statements that share a prefix and differ in the tail: an equi-join with the rest as a residual."""
    a, b = staged(memories).alias("a"), staged(memories).alias("b")
    later = "a.valid_from > b.valid_from or (a.valid_from = b.valid_from and a.id > b.id)"
    return a.join(b, F.expr(f"a.prefix = b.prefix and a.tail <> b.tail and ({later})")).selectExpr("a.id as newer", "b.id as older")


def invalidated(memories: DataFrame) -> DataFrame:
    """Ids that a later contradiction makes obsolete.

    A statement is older than one with another tail exactly if the last statement of its prefix with a different tail
    comes after it, so two aggregates per prefix decide it and no pairs are made.
    """
    rows = staged(memories).withColumn("at", F.struct("valid_from", "id"))
    last = rows.groupBy("prefix", "tail").agg(F.max("at").alias("last"))
    per = W.partitionBy("prefix").orderBy(F.desc("last"))
    # The latest tail, and the latest of the other tails.
    two = last.withColumn("k", F.row_number().over(per)).where("k <= 2").groupBy("prefix").agg(
        F.max(F.when(F.col("k") == 1, F.col("last"))).alias("first_last"), F.max(F.when(F.col("k") == 1, F.col("tail"))).alias("first_tail"), F.max(F.when(F.col("k") == 2, F.col("last"))).alias("second_last")
    )
    joined = rows.join(two, "prefix")
    rival = F.when(F.col("tail") == F.col("first_tail"), F.col("second_last")).otherwise(F.col("first_last"))
    return joined.where(rival > F.col("at")).select(F.col("id").alias("older"))


def joined_label(memories: DataFrame) -> DataFrame:
    return memories.agg(F.max("label").alias("label"))


def resulting_version(made: Column, prepared: Column, prior: Column) -> Column:
    """The digest of what was prepared if anything changed, else the version before."""
    return F.when(made == "mutated", F.concat(F.lit("sha256:"), F.sha2(prepared.cast("binary"), 256))).otherwise(prior)


def effect(n):
    return F.when(n == 0, "no_change").otherwise("mutated")
