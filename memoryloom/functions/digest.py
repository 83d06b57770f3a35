"""Content-free digests over rows and ordered sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tagged(domain: str, *values: Column) -> Column:
    """sha256 of domain, a zero byte, and each value after its length as eight big-endian bytes."""
    parts = [F.lit(domain).cast("binary"), F.unhex(F.lit("00"))]
    for v in values:
        raw = v.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def short_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def of_set(items: Column, separator: str = "") -> Column:
    """Aggregate: sha256 of the items in byte order, joined."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(items)), separator).cast("binary"), 256)


def of_buckets(bucket_digest: Column, bucket: Column) -> Column:
    """Aggregate over bucket digests of a set too large for one group: the digest of the digests in bucket order."""
    rows = F.array_sort(F.collect_list(F.struct(bucket.alias("b"), bucket_digest.alias("d"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["d"]), "").cast("binary"), 256)


def framed(value: Column) -> Column:
    """Bytes of a value and a zero byte after it."""
    return F.concat(value.cast("binary"), F.unhex(F.lit("00")))


def word(n: Column, size: int) -> Column:
    """A non-negative integer as size big-endian bytes; one that doesn't fit is an error."""
    raw = F.hex(n.cast("long"))
    return F.unhex(F.when((n < 0) | (F.length(raw) > 2 * size), F.raise_error(F.lit("the number doesn't fit its bytes")).cast("string")).otherwise(F.lpad(raw, 2 * size, "0")))


def sha256(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def joined(items: Column) -> Column:
    """The byte strings of an array, one after the other, in one pass over them; null if one is null."""
    whole = F.unhex(F.array_join(F.transform(items, lambda x: F.hex(x)), ""))
    return F.when(~F.exists(items, lambda x: x.isNull()), whole)


def uuid5(domain: str, name: Column) -> Column:
    """Version-5 UUID of domain, a zero byte and name in the OID namespace (a fixed value of RFC 4122)."""
    space = F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, framed(F.lit(domain)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def latency(samples: Column, domain: str = "latency-percentiles.v1") -> Column:
    """Aggregate over a bounded window of samples: digest of the sorted values, eight bytes each."""
    return sha256(framed(F.lit(domain)), joined(F.transform(F.array_sort(F.collect_list(samples)), lambda n: word(n, 8))))


def plan(query: Column, working_set: Column, pinned: Column, shape: Column, items: Column, domain: str = "context-plan.v1") -> Column:
    """Digest of a context plan. pinned: array of ids, in any order; items: array of (id, score_bp, tokens, reason) in the plan's order."""
    pins = joined(F.transform(F.array_sort(pinned), framed))
    rows = joined(F.transform(items, lambda r: F.concat(r["id"].cast("binary"), word(r["score_bp"], 4), word(r["tokens"], 4), r["reason"].cast("binary"))))
    empty = F.coalesce(working_set, F.lit(""))
    return sha256(framed(F.lit(domain)), query.cast("binary"), framed(F.lit("working-set")), empty.cast("binary"), framed(F.lit("pinned")), pins, shape.cast("binary"), rows)


def receipt(plan_digest: Column, space: Column, ceiling: Column, purpose: Column, visible: Column, redacted: Column, domain: str = "context-materialization.v1") -> Column:
    """Digest of what a plan showed and withheld: arrays of ids, in any order."""
    labelled = [(space, "space"), (ceiling, "ceiling"), (F.coalesce(purpose, F.lit("")), "purpose")]
    head = [x for v, name in labelled for x in (framed(F.lit(name)), v.cast("binary"))]
    sets = [x for v, name in ((visible, "visible"), (redacted, "redacted")) for x in (framed(F.lit(name)), joined(F.transform(F.array_sort(v), framed)))]
    return sha256(framed(F.lit(domain)), plan_digest.cast("binary"), *head, *sets)


def session(owner: Column, space: Column, policy: Column, domain: str = "session.v1") -> Column:
    return sha256(framed(F.lit(domain)), framed(owner), framed(space), framed(policy))


def bound_query(query: Column, session_digest: Column, domain: str = "session-recall.v1") -> Column:
    """A query's digest bound to a session's, so that equal questions of two sessions differ."""
    return sha256(framed(F.lit(domain)), framed(query), session_digest.cast("binary"))


def key_boundary(tenant: Column, key: Column, revision: Column, domain: str = "encryption-boundary.v1") -> Column:
    return sha256(framed(F.lit(domain)), framed(tenant), framed(key), word(revision, 8))
