"""Scalar functions on text, identifiers and numbers, as column expressions."""

from __future__ import annotations

import ast
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
IDENTITY = "^[A-Za-z0-9_:/.\\-]{1,256}$"
DIGEST = "^sha256:[0-9a-f]{64}$"
DIGEST_ANY_CASE = "^sha256:[0-9A-Fa-f]{64}$"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def normalized(text: Column) -> Column:
    """Lower case without the final form of sigma, runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ς", "σ"), r"(?U)\s+", " "))


normalized_strict = normalized


def statement_parts(norm: Column) -> tuple[Column, Column]:
    """What stands before the last space and what follows; both empty without a space."""
    return F.regexp_extract(norm, "^(.*) ([^ ]*)$", 1), F.regexp_extract(norm, "^(.*) ([^ ]*)$", 2)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)))


def canonical(text: Column, most: int) -> Column:
    """Whether text has 1 to most bytes, no white space at the ends and no control character."""
    return F.octet_length(text).between(1, most) & (F.trim(text) == text) & ~text.rlike(r"\p{Cntrl}")


def identity(text: Column) -> Column:
    return text.rlike(IDENTITY)


def is_digest(text: Column, any_case: bool = False) -> Column:
    return text.rlike(DIGEST_ANY_CASE if any_case else DIGEST)


def schema_accepted(name: Column, family: str, least: int, most: int) -> Column:
    """Whether name is family-vN, without leading zeros, least <= N <= most."""
    n = F.regexp_extract(name, f"^{family}-v([1-9][0-9]*)$", 1)
    return F.coalesce(n.try_cast("int").between(least, most), F.lit(False))


def escaped_xml(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def ratio_floor(part: Column, whole: Column, cap: int = 10_000) -> Column:
    """Basis points rounded down, at most cap; 0 over nothing. Integers only."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(cap).cast("long"), F.floor(part.cast("long") * 10_000 / whole)))


def ratio_ceil(part: Column, whole: Column, cap: int = 10_000) -> Column:
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(cap).cast("long"), F.ceil(part.cast("long") * 10_000 / whole)))


def node_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), key)


def node_key(node: Column) -> Column:
    return F.regexp_replace(node, "^[a-z-]+:", "")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC (the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def rfc3339(ts: Column) -> Column:
    """A timestamp without zone, read as UTC, in RFC 3339 with nanoseconds."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS'Z'")


def uuid_canonical(value: Column) -> Column:
    """The value if it is a UUID in lower case with hyphens, else null."""
    return F.when(value.rlike(UUID), value)


def encoded(row: list[str]) -> Column:
    """Columns as a JSON object of sorted keys, nulls left out."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(row)]))


def decoded(text: Column, schema: str) -> Column:
    """The row that an encoded() text of the schema holds; a malformed one is an error."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def uuid5(key: str) -> str:
    """Version-5 UUID in the OID namespace."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, key))


def literal_map(text: str) -> dict[str, list[dict]]:
    """A Python literal that maps categories to lists of questions; anything else is an error."""
    found = ast.literal_eval(text)
    if not isinstance(found, dict):
        raise ValueError("expected a mapping")
    return found
