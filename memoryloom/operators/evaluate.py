"""Retrieval evaluation, safety gates and benchmark summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoryloom.functions.text import ratio_floor
from memoryloom.sources.scratch import Scratch


def case_report(cases: DataFrame, plan_items: DataFrame) -> DataFrame:
    """Per case: hits, forbidden hits, precision, recall and use of tokens in floored basis points, and whether it passed.

    cases: case_id, id, expected, forbidden (one row an id); plan_items: case_id, id, tokens, budget.
    """
    joined = plan_items.join(cases, ["case_id", "id"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    got = joined.groupBy("case_id").agg(F.count(F.lit(1)).alias("selected"), n(F.col("expected")).alias("hits"), n(F.col("forbidden")).alias("forbidden_hits"), F.sum("tokens").cast("long").alias("tokens"), F.max("budget").cast("long").alias("budget"))
    want = cases.groupBy("case_id").agg(n(F.col("expected")).alias("expected_n"))
    both = want.join(got, "case_id", "left").na.fill(0, ["selected", "hits", "forbidden_hits", "tokens", "budget"])
    return both.select(
        "case_id", "selected", "hits", "forbidden_hits",
        ratio_floor(F.col("hits"), F.col("selected")).alias("precision_bp"),
        ratio_floor(F.col("hits"), F.col("expected_n")).alias("recall_bp"),
        ratio_floor(F.col("tokens"), F.col("budget")).alias("tokens_bp"),
        (F.col("forbidden_hits") == 0).alias("passed"),
    )


def corpus_summary(report: DataFrame) -> DataFrame:
    mean = lambda c: F.floor(F.sum(c) / F.count(F.lit(1))).alias(f"mean_{c}")
    return report.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.when(F.col("forbidden_hits") > 0, 1).otherwise(0)).cast("long").alias("leaking"), mean("precision_bp"), mean("recall_bp"), F.bool_and("passed").alias("all_passed"))


def category_accuracy(outcomes: DataFrame) -> DataFrame:
    """Per category: accuracy over supported cases, unsupported ones, share of answers where none was due."""
    return outcomes.groupBy("category").agg(
        F.round(F.avg(F.when(F.col("supported"), F.col("correct").cast("int"))), 9).alias("accuracy"),
        F.count_if(~F.col("supported")).alias("unsupported"),
        F.round(F.avg(F.when(F.col("abstain"), F.col("answered").cast("int"))), 9).alias("unsupported_answers"),
    )


def hard_gates(outcomes: DataFrame, gate_of: dict[str, str], gates: list[str]) -> DataFrame:
    """Failures per gate, gates without any included."""
    spark = outcomes.sparkSession
    names = F.create_map(*[F.lit(x) for kv in gate_of.items() for x in kv])
    n = outcomes.where("not correct").groupBy(names[F.col("category")].alias("gate")).agg(F.count(F.lit(1)).alias("failures"))
    return spark.createDataFrame([(g,) for g in gates], "gate string").join(n, "gate", "left").select("gate", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


def case_gates(outcomes: DataFrame, gate_of: dict[str, str], gate_of_case: dict[str, str], gates: list[str], mismatched: tuple[str, int] = ("", 0)) -> DataFrame:
    """Failures per gate as hard_gates() gives them, where a case's own gate comes before its category's.

    mismatched: a gate to whose failures a number of receipts that differ between runs is added.
    """
    names = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    gate = names(gate_of)[F.col("category")]
    if gate_of_case:
        gate = F.coalesce(names(gate_of_case)[F.col("case_id")], gate)
    n = outcomes.where("not correct").groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("failures"))
    more = F.when(F.col("gate") == mismatched[0], mismatched[1]).otherwise(0)
    every = outcomes.sparkSession.createDataFrame([(g,) for g in dict.fromkeys(gates)], "gate string")
    return every.join(n, "gate", "left").select("gate", (F.coalesce("failures", F.lit(0)) + more).cast("long").alias("failures"))


def judged(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id and whether the decision on it (case_id, allowed, ids) is right.

    It is if it allows what the case expects, its ids start with the expected ones, are none where the case must be
    abstained from, and hold no forbidden one. A case without a decision is wrong.
    """
    both = cases.join(decisions.select("case_id", "allowed", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")), "case_id", "left")
    none = F.array().cast("array<string>")
    want, not_these = F.coalesce("expected_ids", none), F.coalesce("forbidden_ids", none)
    starts = (F.size(want) == 0) | (F.slice("ids", 1, F.greatest(F.size(want), F.lit(1))) == want)
    abstains = ~F.coalesce("must_abstain", F.lit(False)) | (F.size("ids") == 0)
    right = (F.col("allowed") == F.col("expected_allowed")) & starts & abstains & ~F.arrays_overlap("ids", not_these)
    return both.select("case_id", F.coalesce(right, F.lit(False)).alias("correct"))


#: Bits that a pass of the selection decides at most, of those in which values differ.
DIGIT = 16


def at_ranks(samples: DataFrame, group: Column, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group (grp) the values (longs) at ranks, from 1, that are functions of the number n of its values; null beyond them.

    Radix selection of all groups at once: a histogram of the leading bits tells the bin that holds a rank, the next
    pass counts the next bits of such bins' values alone, and after the last bits the bin is the value. How many bits
    there are is asked first (least and greatest value, one row). A pass is one aggregate with partial sums, of at most
    2^DIGIT rows a task and bin that is asked for; no value is sorted or exchanged, and the histograms of two sets of
    samples add up to that of their union.
    """
    from pyspark.sql import Window as W

    rows = samples.select(group.alias("grp"), F.col(value).cast("long").alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    bits = (int(high) - int(low)).bit_length() if low is not None else 0
    passes = max(1, -(-bits // DIGIT))
    digit = -(-bits // passes)
    # Differences that need all 64 bits are told by the signed values themselves, whose shifts keep their order.
    base = int(low or 0) if bits < 64 else 0
    here = rows.where("v is not null").select("grp", (F.col("v") - base).alias("v"))
    upto = lambda k: F.shiftright("v", max(0, bits - digit * (k + 1)))
    names = F.array(*[F.struct(F.lit(name).alias("name"), r(F.col("n")).cast("long").alias("rank")) for name, r in ranks.items()])
    every = rows.groupBy("grp").agg(F.count("v").alias("n"))
    asked = every.select(F.col("grp").alias("g2"), F.explode(names).alias("w")).select("g2", "w.name", "w.rank")
    holds = F.col("rank").between(F.col("upto") - F.col("c") + 1, F.col("upto"))
    for k in range(passes):
        # As many rows as groups times ranks are joined in memory where that is little; else Spark chooses.
        if not k:
            counts = here.groupBy("grp", upto(0).alias("bin")).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(W.partitionBy("grp").orderBy("bin")))
            held = counts.join(asked, F.col("grp").eqNullSafe(F.col("g2")) & holds)
        else:
            some = here.join(asked, F.col("grp").eqNullSafe(F.col("g2")) & (upto(k - 1) == F.col("b2")))
            counts = some.groupBy("grp", "name", "rank", upto(k).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
            held = counts.withColumn("upto", F.sum("c").over(W.partitionBy("grp", "name", "rank").orderBy("bin"))).where(holds)
        asked = held.select(F.col("grp").alias("g2"), F.col("bin").alias("b2"), "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    found = asked.groupBy(F.col("g2").alias("g3")).agg(*[F.max(F.when(F.col("name") == k, F.col("b2") + base)).alias(k) for k in ranks])
    return every.join(found, F.col("grp").eqNullSafe(F.col("g3")), "left").select("grp", *ranks)


def positioned(scratch: Scratch, rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their position, from 0, in an order that tells all rows apart (repeated rows apart from each other).

    The sorted rows are written with their partition and place in it; partitions are counted, and what comes before a
    partition is a prefix sum over as many rows as there are partitions. No task sees more than its partition.
    """
    from pyspark.sql import Window as W

    placed = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = scratch.save(placed)
    parts = placed.groupBy(F.col("_part").alias("_p2")).agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_p2", (F.sum("_n").over(W.orderBy("_p2")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(parts), F.col("_part") == F.col("_p2")).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_place")).alias("position"))


def zipped(scratch: Scratch, first: DataFrame, first_order: list[str], second: DataFrame, second_order: list[str]) -> DataFrame:
    """position, and the rows of both (structs a and b) that stand at it in their orders; a row without a partner is an error."""
    sides = [positioned(scratch, x, *order) for x, order in ((first, first_order), (second, second_order))]
    rows = [x.select(F.col("position").alias(f"p{k}"), F.struct(*[F.col(f"`{c}`") for c in y.columns]).alias("ab"[k])) for k, (x, y) in enumerate(zip(sides, (first, second)))]
    both = rows[0].join(rows[1], F.col("p0") == F.col("p1"), "full_outer")
    apart = F.col("p0").isNull() | F.col("p1").isNull()
    return both.select(F.when(apart, F.raise_error(F.lit("the lengths differ")).cast("long")).otherwise(F.col("p0")).alias("position"), "a", "b")


def index_percentiles(samples: DataFrame, value: str, ps: list[int], middle: str | None = None) -> DataFrame:
    """The samples at index round-half-even(p / 100 * (n - 1)) of the sorted ones, for each p, null for none.

    middle: name of a further column for the middle sample, or the mean of the two in the middle.
    """
    ranks = {f"p{p}": lambda n, p=p: F.bround(F.lit(p) / 100 * (n - 1), 0) + 1 for p in ps}
    ends = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1} if middle else {}
    found = at_ranks(samples, F.lit(0), value, ranks | ends)
    return found.agg(*[F.min(k).alias(k) for k in ranks], *([((F.min("low") + F.min("high")) / 2).alias(middle)] if middle else []))


def index_percentile(samples: DataFrame, value: str, p: int) -> DataFrame:
    return index_percentiles(samples, value, [p])


def speedups(samples: DataFrame, case: str, value: str, fast: Column) -> DataFrame:
    """Mean value per case of the slow and of the fast samples, and how many times faster the fast ones are (null without one)."""
    means = samples.groupBy(case).agg(F.avg(F.when(~fast, F.col(value))).alias("slow_mean"), F.avg(F.when(fast, F.col(value))).alias("fast_mean"))
    return means.withColumn("speedup", F.when(F.col("fast_mean") > 0, F.col("slow_mean") / F.col("fast_mean")))


def mismatches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Number of cases whose receipts differ between two runs, joined by case_id."""
    both = first.join(second.withColumnsRenamed({"receipt": "r2"}), "case_id", "full_outer")
    return both.agg(F.count_if(~F.col("receipt").eqNullSafe(F.col("r2"))).alias("mismatches"))


def different_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows stand only in a, and only in b, as multisets."""
    left, right = (x.exceptAll(y).agg(F.count(F.lit(1)).alias(n)) for x, y, n in ((a, b, "only_left"), (b, a, "only_right")))
    return left.crossJoin(right)  # one row each


def valid_cases(cases: DataFrame, most: int, most_budget: int) -> DataFrame:
    """cases (case_id, expected_ids, forbidden_ids, token_budget) with a fault: overlap, repeated, bounds or null."""
    e, x = F.col("expected_ids"), F.col("forbidden_ids")
    repeated = (F.size(F.array_distinct(e)) < F.size(e)) | (F.size(F.array_distinct(x)) < F.size(x))
    bounds = (F.size(e) > most) | (F.size(x) > most) | ~F.col("token_budget").between(1, most_budget)
    return cases.withColumn("fault", F.when(F.arrays_overlap(e, x), "overlap").when(repeated, "repeated").when(bounds, "bounds"))
