"""A tree of digests over a table: two versions are compared by descent, and a change touches its leaves and their parents alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoryloom.sources.scratch import Scratch

NODES = "depth int, prefix string, digest string, n long"


def _leaf(depth: int):
    """The leaf of an id: so many hexadecimal digits of its digest, which deal ids evenly, whatever they are."""
    return F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, depth)


def depth_for(rows: int, each: int = 256) -> int:
    """Digits that leave about each rows a leaf."""
    depth = 0
    while rows > each << (4 * depth):
        depth += 1
    return depth


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    """Leaves of rows (id, digest): the digest of their rows in order. A leaf holds few rows, as depth_for() sees to."""
    row = F.concat_ws(":", F.sha2(F.col("id").cast("binary"), 256), F.coalesce("digest", F.lit("")))
    of = F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary"), 256)
    return rows.where("id is not null").groupBy(_leaf(depth).alias("prefix")).agg(of.alias("digest"), F.count(F.lit(1)).alias("n"))


def _parents(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes a digit shorter, of sixteen children at most."""
    children = F.array_sort(F.collect_list(F.concat_ws(":", "prefix", "digest")))
    return nodes.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(children, "\n").cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def _grown(scratch: Scratch, leaves: DataFrame, depth: int) -> DataFrame:
    levels = [scratch.save(leaves)]
    for d in range(depth - 1, -1, -1):
        levels.append(scratch.save(_parents(levels[-1], d)))
    tree = None
    for d, level in zip(range(depth, -1, -1), levels):
        level = level.select(F.lit(d).alias("depth"), "prefix", "digest", "n")
        tree = level if tree is None else tree.unionByName(level)
    return tree


def tree(scratch: Scratch, rows: DataFrame, depth: int) -> DataFrame:
    """depth, prefix, digest and n of every node over rows (id, digest); an empty table has no nodes. A row of a null id doesn't count."""
    return scratch.save(_grown(scratch, _leaves(rows, depth), depth))


def updated(scratch: Scratch, nodes: DataFrame, rows: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """The tree of rows, from that before the ids in changed came, went or got another digest: only rows of their leaves are digested anew."""
    touched = scratch.save(changed.where("id is not null").select(_leaf(depth).alias("touched")).distinct())
    own = rows.withColumn("leaf", _leaf(depth))
    fresh = _leaves(own.join(touched, own.leaf == touched.touched, "left_semi"), depth)
    old = nodes.where(F.col("depth") == depth).select("prefix", "digest", "n")
    kept = old.join(touched, old.prefix == touched.touched, "left_anti")
    return scratch.save(_grown(scratch, kept.unionByName(fresh), depth))


def different_leaves(scratch: Scratch, a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Prefixes of the leaves that differ between two trees of one depth, found from the root on: below equal nodes nothing is compared."""
    found = None
    for d in range(depth + 1):
        left, right = (x.where(F.col("depth") == d).select(F.col("prefix").alias(f"p{k}"), F.col("digest").alias(f"d{k}")) for k, x in (("a", a), ("b", b)))
        if found is not None:
            up = found.select(F.col("prefix").alias("up"))
            left, right = (x.join(up, F.substring(f"p{k}", 1, d - 1) == F.col("up"), "left_semi") for k, x in (("a", left), ("b", right)))
        both = left.join(right, F.col("pa") == F.col("pb"), "full_outer").where(~F.col("da").eqNullSafe(F.col("db")))
        found = scratch.save(both.select(F.coalesce("pa", "pb").alias("prefix")))
    return found


def different_rows(scratch: Scratch, expected: DataFrame, actual: DataFrame, depth: int) -> DataFrame:
    """id, expected_digest and actual_digest of the rows (id, digest) that differ or stand on one side; only rows of differing leaves are joined."""
    leaves = different_leaves(scratch, tree(scratch, expected, depth), tree(scratch, actual, depth), depth)
    some = lambda rows, name: rows.where("id is not null").withColumn("leaf", _leaf(depth)).join(leaves, F.col("leaf") == F.col("prefix"), "left_semi").select(F.col("id").alias(f"{name}_id"), F.col("digest").alias(f"{name}_digest"))
    both = some(expected, "expected").join(some(actual, "actual"), F.col("expected_id") == F.col("actual_id"), "full_outer")
    apart = F.col("expected_id").isNull() | F.col("actual_id").isNull() | ~F.col("expected_digest").eqNullSafe(F.col("actual_digest"))
    return both.where(apart).select(F.coalesce("expected_id", "actual_id").alias("id"), "expected_digest", "actual_digest")
