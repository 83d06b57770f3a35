"""Checks of governed runs: projections, freshness, leases, bindings, budgets, readiness, key boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FIELDS, MOST_FIELD_BYTES = 256, 64 * 1024


def canonical_projection(fields: list[str]) -> list[str]:
    """fields if they are 1 to MOST_FIELDS distinct names in canonical text, of bounded size together."""
    sane = all(f and f.strip() == f and f.isprintable() for f in fields)
    if not 1 <= len(fields) <= MOST_FIELDS or len(set(fields)) < len(fields) or not sane or sum(len(f.encode()) for f in fields) > MOST_FIELD_BYTES:
        raise ValueError("the projection is not canonical")
    return fields


def projected(rows: DataFrame, mapping: dict[str, str], effective: list[str]) -> DataFrame:
    """id, text and valid_from of a source by a mapping onto three distinct fields, each of which the caller may read."""
    names = [mapping[k] for k in ("id", "text", "valid_from")]
    if len(set(names)) < 3 or not set(names) <= set(canonical_projection(effective)):
        raise PermissionError("the projection is denied")
    return rows.select(*[F.col(f"`{n}`").alias(k) for k, n in zip(("id", "text", "valid_from"), names)])


def still_granted(required: list[str], now: list[str], granted: list[str]) -> bool:
    """Whether what a run needs is within what may be read now, and that within what was granted."""
    return set(required) <= set(now) <= set(granted)


def freshness(at: Column, now: Column, most_age: Column, skew: Column) -> Column:
    """stale, future or fresh; both ends of the window are fresh."""
    return F.when(at < now - most_age, "stale").when(at > now + skew, "future").otherwise("fresh")


def unexpired(now_seconds: Column, expires_at: Column) -> Column:
    return now_seconds < expires_at


def lease_holds(supplied: Column, now: Column) -> Column:
    """Whether the leased job's token is the supplied one and its lease still runs."""
    return F.coalesce((F.col("status") == "leased") & (F.col("token_digest") == supplied) & (now < F.col("lease_expiry")), F.lit(False))


def expiry(at: Column, ttl_micros: Column, most_micros: int) -> Column:
    """at, in microseconds, plus a lifetime of 1 to most_micros; any other, or an overflow, is null."""
    return F.when(ttl_micros.between(1, most_micros), F.try_add(at, ttl_micros))


def differing(left: str, right: str, fields: list[str]) -> Column:
    """Names of the fields in which two joined sides differ, in order; nulls are values."""
    return F.filter(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def bindings(intents: DataFrame, bound: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per intent: whether a binding is there, and the fields in which it departs from the intent."""
    a, b = intents.alias("a"), bound.withColumn("_there", F.lit(True)).alias("b")
    names = F.when(F.col("_there"), F.array_join(differing("a", "b", fields), ","))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}").alias(key), F.coalesce("_there", F.lit(False)).alias("bound"), names.alias("differing"))


def source_budget(rows: DataFrame, group: str, columns: list[str], most_rows: int, most_bytes: int) -> DataFrame:
    """Per group: rows, bytes of the columns, and whether both are within bounds. Partial sums only."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))
    return out.withColumn("within", (F.col("rows") <= most_rows) & (F.col("bytes") <= most_bytes))


def readiness(components: DataFrame, group: str) -> DataFrame:
    """Per group: components, and whether all of them are ready; a null state isn't."""
    return components.groupBy(group).agg(F.count(F.lit(1)).alias("components"), F.bool_and(F.coalesce(F.col("state") == "ready", F.lit(False))).alias("ready"))


def entity_caps(mentions: DataFrame, record: str, name: str, most: int) -> DataFrame:
    """Records that name an entity twice or name more than most."""
    n = mentions.groupBy(record, name).agg(F.count(F.lit(1)).alias("c")).groupBy(record).agg(F.count(F.lit(1)).alias("entities"), F.max("c").alias("most_alike"))
    return n.where((F.col("entities") > most) | (F.col("most_alike") > 1))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rotated(boundaries: DataFrame, new_key: Column) -> DataFrame:
    """Boundaries (tenant, key, revision) one revision on, under the new key; the greatest revision has no next."""
    last = F.lit(2**63 - 1)
    revision = F.when(F.col("revision") == last, F.raise_error(F.lit("no revision is left")).cast("long")).otherwise(F.col("revision") + 1)
    return boundaries.select("tenant", new_key.alias("key"), revision.alias("revision"))


#: Bytes that a table's warehouse, namespace and name hold together at most, with a byte between parts.
MOST_IDENTITY_BYTES = 512
#: What a source is known by, in the order of its digest.
SOURCE_FIELDS = ("snapshot_digest", "grant_id", "catalog", "namespace", "table", "snapshot_id", "plan_task_digest", "subject", "purpose")


def sources_of(proofs: DataFrame, catalog: str, projection: list[str], most_bytes: int = MOST_IDENTITY_BYTES) -> DataFrame:
    """proofs with a verdict (accepted, catalog_mismatch or invalid) and, where accepted, the source's namespace and digest.

    proofs: catalog, warehouse, namespace (array), table and the other SOURCE_FIELDS. A proof of another catalog, with a
    field missing or empty, or of too long an identity gives no source.
    """
    from memoryloom.functions import digest

    parts = F.concat(F.array("warehouse"), "namespace", F.array("table"))
    size = F.octet_length(F.array_join(parts, "."))
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    texts = ["warehouse", "table"] + [c for c in SOURCE_FIELDS if c not in ("catalog", "namespace", "table", "snapshot_id")]
    lacking = F.col("snapshot_id").isNull() | F.coalesce(F.size("namespace") == 0, F.lit(True)) | F.exists(parts, lambda x: blank(x))
    for c in texts:
        lacking = lacking | blank(F.col(c))
    verdict = F.when(~F.col("catalog").eqNullSafe(F.lit(catalog)), "catalog_mismatch").when(F.coalesce(lacking | (size > most_bytes), F.lit(True)), "invalid").otherwise("accepted")
    out = proofs.withColumn("verdict", verdict).withColumn("namespace", F.when(F.col("verdict") == "accepted", F.array_join("namespace", ".")))
    fields = [digest.framed(F.col(c).cast("string")) for c in SOURCE_FIELDS] + [digest.framed(F.lit(f)) for f in canonical_projection(projection)]
    return out.withColumn("source_digest", F.when(F.col("verdict") == "accepted", digest.sha256(digest.framed(F.lit("governed-source.v1")), *fields)))
