"""Who sees what: tenant, purpose, clearance, quarantine and validity come before any ranking.

Rows outside the validity, in quarantine or expired are hidden: neither visible nor redacted. That is this engine's
own definition. Rows above the ceiling are redacted: their metadata stays, their content column doesn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoryloom.operators.temporal import valid_at

PUBLIC, INTERNAL, SENSITIVE, SECRET = range(4)


def authorized(purpose: str | None = None, space: str | None = None, clearance: int | None = None) -> Column:
    ok = F.lit(True)
    if purpose is not None:
        ok = ok & (F.col("purpose") == purpose)
    if space is not None:
        ok = ok & (F.col("space_id") == space)
    if clearance is not None:
        ok = ok & (F.col("label") <= clearance)
    return ok


def split(memories: DataFrame, instant: Column, ceiling: int, purpose: str | None = None) -> DataFrame:
    """id, kind, visibility (visible or redacted), text (null if redacted) of the rows that are not hidden."""
    rows = memories.where(authorized(purpose) & ~F.col("quarantined") & valid_at(instant))
    seen = F.col("label") <= ceiling
    return rows.select("id", "kind", F.when(seen, "visible").otherwise("redacted").alias("visibility"), F.when(seen, F.col("text")).alias("text"))


def may_embed(local: bool) -> Column:
    """Rows that may reach the embedder: all if it is local, else those up to internal."""
    return F.lit(True) if local else F.col("label") <= INTERNAL


#: Levels of the time bins: bins of 1, 2, 4 ... days, the last of which holds all days that count.
LEVELS = 18
#: Days before the epoch that still count.
EARLIEST = -(1 << 16)


def _day(date: Column) -> Column:
    """A day as a number from 0 to 2^LEVELS - 1."""
    return F.greatest(F.lit(0), F.least(F.unix_date(date) - EARLIEST, F.lit((1 << LEVELS) - 1)))


def time_bins(start: Column, end: Column) -> Column:
    """Bins (level, bin) that make up the days from start to the day before end (null: for ever): two a level at most, none overlap."""
    first, last = _day(start), F.when(end.isNull(), F.lit(1 << LEVELS)).otherwise(_day(end))

    def level(k: Column) -> Column:
        lo, hi = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1), k) - 1, k), F.call_function("shiftright", last, k)
        piece = lambda here, bin_: F.when((lo < hi) & here, F.struct(k.alias("level"), bin_.alias("bin")))
        return F.array(piece(lo % 2 == 1, lo), piece(hi % 2 == 1, hi - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level)), lambda x: x.isNotNull())


def for_requests(memories: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("purpose",), redacted: bool = True) -> DataFrame:
    """request_id, id and visibility of what each request may know of: split() for a table of requests, in one plan.

    requests: request_id, as_of (a day), ceiling, keys. A record's validity is made up of time bins of doubling width,
    two a level at most, and a request's day lies in one bin a level, so the inequalities become an equi-join in which
    each pair meets once and nothing is left to check. Without redacted rows a record's label is expanded to the
    ceilings that see it, so what a request doesn't see isn't joined. Null ids, days, ceilings or keys meet nothing.
    """
    rows = memories.where(~F.col("quarantined") & F.col("valid_from").isNotNull())
    rows = rows.select("id", "label", *keys, F.explode(time_bins(F.col("valid_from"), F.col("invalid_at"))).alias("b"))
    asked = requests.where("request_id is not null and ceiling is not null and as_of is not null").withColumn("day", _day(F.col("as_of")))
    at = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("day"), k).alias("bin")))
    asked = asked.select("request_id", F.col("ceiling").cast("int").alias("ceiling"), *[F.col(k).alias(f"asked_{k}") for k in keys], F.explode(at).alias("a"))
    meets = (F.col("a.level") == F.col("b.level")) & (F.col("a.bin") == F.col("b.bin"))
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"asked_{k}"))
    if not redacted:
        rows = rows.select("*", F.explode(F.sequence(F.col("label").cast("int"), F.lit(SECRET))).alias("seen_by"))
        meets = meets & (F.col("seen_by") == F.least(F.col("ceiling"), F.lit(SECRET)))
    seen = F.when(F.col("label") <= F.col("ceiling"), "visible").otherwise("redacted")
    return rows.join(asked, meets).select("request_id", "id", seen.alias("visibility"))


def totals_for_requests(memories: DataFrame, requests: DataFrame, totals: dict[str, tuple[str, Callable[[str], Column]]], keys: tuple[str, ...] = ("purpose",)) -> DataFrame:
    """request_id, visible, redacted and totals over what each request may know of: aggregates of for_requests(), without its pairs.

    totals: names to a column of memories and a function that may be applied to its own results again (min, max, sum).
    Records are added up per key, label and time bin, and each key, day and ceiling asks these sums once, whatever the
    number of requests, so the work is the records' bins and the requests, not their product.
    """
    merged = lambda: [f(name).alias(name) for name, (_, f) in totals.items()]
    rows = memories.where(~F.col("quarantined") & F.col("valid_from").isNotNull())
    spans = rows.groupBy("label", *keys, "valid_from", "invalid_at").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(name) for name, (c, f) in totals.items()])
    bins = spans.select("label", *keys, "n", *totals, F.explode(time_bins(F.col("valid_from"), F.col("invalid_at"))).alias("b"))
    bins = bins.groupBy("label", *keys, "b").agg(F.sum("n").alias("n"), *merged())
    asked = requests.where("request_id is not null and ceiling is not null and as_of is not null")
    asked = asked.select("request_id", F.col("ceiling").cast("int").alias("ceiling"), *keys, _day(F.col("as_of")).alias("day"))
    at = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("day"), k).alias("bin")))
    asks = asked.select("ceiling", *keys, "day").distinct().withColumn("b", F.explode(at))
    seen = F.when(F.col("label") <= F.col("ceiling"), F.col("n")).otherwise(0)
    found = asks.join(bins, [*keys, "b"]).groupBy("ceiling", *keys, "day").agg(F.sum(seen).alias("visible"), F.sum(F.col("n") - seen).alias("redacted"), *merged())
    found = asked.join(found, ["ceiling", *keys, "day"])
    return found.groupBy("request_id").agg(F.sum("visible").alias("visible"), F.sum("redacted").alias("redacted"), *merged())
