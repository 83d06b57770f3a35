"""Context planning under a token budget, and what is shown of a plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.functions.text import escaped_xml

KINDS = ["episodic", "semantic", "procedural", "profile"]
MOST_CANDIDATES, MOST_BUDGET = 100_000, 64_000
SALTS = 64


def order() -> list[Column]:
    """Pinned first, then score descending, then id."""
    return [F.desc("pinned"), F.desc("score_bp"), F.col("id")]


def positions(candidates: DataFrame) -> DataFrame:
    """id and position of every candidate in order().

    Candidates are counted by pin and score, a few tens of thousands of groups whatever the input, and those before a
    group are the base of its positions; rows are sorted within their group only.
    """
    counts = candidates.groupBy(F.col("pinned").alias("p2"), F.col("score_bp").alias("s2")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("base", F.sum("c").over(W.orderBy(F.desc("p2"), F.desc("s2"))) - F.col("c"))
    known = candidates.join(counts, (F.col("pinned") == F.col("p2")) & (F.col("score_bp") == F.col("s2")))
    within = F.row_number().over(W.partitionBy("pinned", "score_bp").orderBy("id"))
    return known.select("id", (F.col("base") + within).alias("position"))


def out_of_order(plans: DataFrame, plan: str, position: str) -> DataFrame:
    """plan, its number of items and of those that stand behind one they should precede; a canonical plan has none."""
    place = F.struct((~F.col("pinned")).alias("a"), (-F.col("score_bp")).alias("b"), F.col("id").alias("c"))
    before = F.lag(place).over(W.partitionBy(plan).orderBy(position))
    marked = plans.withColumn("fault", F.coalesce(before >= place, F.lit(False)))
    return marked.groupBy(plan).agg(F.count(F.lit(1)).alias("items"), F.count_if("fault").alias("faults"))


def estimated_tokens(hits: DataFrame, each: int = 4) -> DataFrame:
    """What the context of scored hits is taken to cost, one row."""
    return hits.agg((F.count(F.lit(1)) * each).alias("estimated_tokens"))


def greedy(candidates: DataFrame, budget: int, plan: str | None = None, most: int | None = None) -> DataFrame:
    """Candidates taken in order() while they fit; one that doesn't is passed over, a pinned one that doesn't is an error.

    plan names a column of plans that are made each for itself. Only rows that can matter reach the fold, where one
    plan's lie in one task. What is left of the budget only shrinks, so among candidates of t tokens the first
    budget / t in order are all that can be taken: at most budget * (1 + ln budget) rows, whatever the input. They are found in
    two steps, by salted groups first, so no group is sorted whole. A candidate without tokens is an error.
    """
    if not 1 <= budget <= MOST_BUDGET:
        raise ValueError("the budget is out of bounds")
    key = F.col(plan) if plan else F.lit(0)
    sane = F.when(F.coalesce(F.col("tokens") >= 1, F.lit(False)), F.col("tokens") <= budget).otherwise(F.raise_error(F.lit("a candidate has no tokens")).cast("boolean"))
    rows = candidates.where(sane | F.col("pinned")).withColumn("_plan", key)
    if not most:  # a stated most is checked on all rows
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        room = F.floor(F.lit(budget) / F.greatest("tokens", F.lit(1))) + 1  # one more, so that pinned ones that don't fit are seen
        for group in (["_plan", "tokens", salt], ["_plan", "tokens"]):
            place = F.row_number().over(W.partitionBy(*group).orderBy(*order()))
            rows = rows.withColumn("_place", place).where(F.col("_place") <= room).drop("_place")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        if most and len(pdf) > most:
            raise ValueError("too many candidates")
        pdf = pdf.sort_values(["pinned", "score_bp", "id"], ascending=[False, False, True])
        left, keep = budget, []
        for tokens, pinned in zip(pdf["tokens"], pdf["pinned"]):
            fits = tokens <= left
            if pinned and not fits:
                raise ValueError("a pinned item exceeds the budget")
            keep.append(fits)
            left -= tokens if fits else 0
        return pdf[keep].drop(columns="_plan")

    return rows.groupBy("_plan").applyInPandas(fold, candidates.schema)


def bundle(plan: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows of the plan that the gate shows or redacts."""
    return plan.join(gated, "id")


def sections(gated: DataFrame) -> DataFrame:
    """Number of visible rows per kind in the fixed order, empty kinds included."""
    kinds = gated.sparkSession.createDataFrame(list(enumerate(KINDS)), "ordinal int, kind string")
    n = gated.where("visibility = 'visible'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(n, "kind", "left").select("ordinal", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def citations(gated: DataFrame) -> DataFrame:
    """Visible and redacted rows alike, by id and kind, without content."""
    visible, redacted = (gated.where(F.col("visibility") == v).select("id", "kind", F.lit(v == "redacted").alias("redacted")) for v in ("visible", "redacted"))
    return visible.unionByName(redacted)


def explanation(candidates: DataFrame, plan: DataFrame) -> DataFrame:
    considered = candidates.agg(F.count(F.lit(1)).alias("considered"))
    chosen = plan.agg(F.count(F.lit(1)).alias("selected"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
    return considered.crossJoin(chosen).withColumn("truncated", F.col("selected") < F.col("considered"))  # one row each


def xml_rows(gated: DataFrame) -> DataFrame:
    """One element per row, content escaped; redacted rows without any."""
    body = F.when(F.col("visibility") == "visible", F.concat(F.lit('<memory id="'), escaped_xml(F.col("id")), F.lit('">'), escaped_xml(F.col("text")), F.lit("</memory>")))
    return gated.select("id", F.coalesce(body, F.concat(F.lit('<redacted id="'), escaped_xml(F.col("id")), F.lit('"/>'))).alias("xml"))


def text_lines(gated: DataFrame) -> DataFrame:
    return gated.select("id", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.coalesce("text", F.lit("<redacted>"))).alias("line"))


def rendered(rows: Iterator[str], most: int = 4 << 20) -> str:
    """Lines of an ordered plan, which a budget bounds, as one text of at most most bytes."""
    out = "\n".join(rows)
    if len(out.encode()) > most:
        raise ValueError("the rendered bundle is too large")
    return out
