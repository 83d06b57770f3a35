"""Semantic models of metrics and dimensions, their schemas, and plans of requests against them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoryloom.functions.text import schema_accepted

MOST_ITEMS, MOST_BYTES = 256, 256


def _checked(text: object) -> str:
    if not isinstance(text, str) or not 1 <= len(text.encode()) <= MOST_BYTES or text.strip() != text or any(ord(c) < 32 or ord(c) == 127 for c in text):
        raise ValueError("a name is not canonical text")
    return text


def _digest(domain: str, *parts: str | bytes) -> str:
    raw = b"".join(p if isinstance(p, bytes) else p.encode() + b"\0" for p in (domain, *parts))
    return f"sha256:{hashlib.sha256(raw).hexdigest()}"


@dataclass(frozen=True)
class Model:
    """A validated model: metrics with their expressions, dimensions with their roles, relationships between kinds."""

    namespace: str
    name: str
    version: int
    metrics: tuple[tuple[str, str], ...]
    dimensions: tuple[tuple[str, str], ...]
    relationships: tuple[tuple[str, str, str], ...] = ()

    @classmethod
    def parsed(cls, document: str) -> Model:
        """The model of a JSON document; unknown keys, repeated names and lists out of bounds are errors."""
        d = json.loads(document)
        if not isinstance(d, dict) or set(d) - {"namespace", "name", "version", "metrics", "dimensions", "relationships"}:
            raise ValueError("the document is not a model")
        lists = [(d.get("metrics", []), ("name", "expression")), (d.get("dimensions", []), ("name", "role")), (d.get("relationships", []), ("name", "from", "to"))]
        found = []
        for rows, keys in lists:
            if len(rows) > MOST_ITEMS or any(set(r) != set(keys) for r in rows):
                raise ValueError("a list is out of bounds or its items have other fields")
            found.append(tuple(sorted(tuple(_checked(r[k]) for k in keys) for r in rows)))
        metrics, dimensions, relationships = found
        fields = [x[0] for x in metrics + dimensions]
        if not metrics or not dimensions or len(set(fields)) < len(fields) or not isinstance(d.get("version"), int) or d["version"] < 1:
            raise ValueError("the model has no fields, repeats one, or has no version")
        return cls(_checked(d.get("namespace")), _checked(d.get("name")), d["version"], metrics, dimensions, relationships)

    def fields(self) -> list[tuple[str, str]]:
        """Field and kind: metrics are decimals, dimensions identifiers or text by role."""
        return [(m, "decimal") for m, _ in self.metrics] + [(x, "identifier" if role == "identifier" else "text") for x, role in self.dimensions]

    def digest(self, source_manifest: str) -> str:
        """Binds the source, identity, fields and all names; labelled, counted sections keep them apart."""
        parts: list[str | bytes] = [_checked(source_manifest), self.namespace, self.name, self.version.to_bytes(4, "big")]
        for label, rows in (("fields", self.fields()), ("metrics", self.metrics), ("dimensions", self.dimensions), ("relationships", self.relationships)):
            parts += [label, len(rows).to_bytes(8, "big"), *(x for r in rows for x in r)]
        return _digest("semantic-model.v2", *parts)


def resolved(requests: DataFrame, model: Model) -> DataFrame:
    """requests (metric, dimensions) with sorted distinct dimensions and a verdict: planned, unknown_metric, invalid or unknown_dimension.

    The names of a model are bounded, so they go along as constants; no join, no shuffle.
    """
    metrics, dims = F.array(*[F.lit(m) for m, _ in model.metrics]), F.array(*[F.lit(x) for x, _ in model.dimensions])
    wanted = F.array_sort(F.array_distinct(F.coalesce("dimensions", F.array().cast("array<string>"))))
    verdict = (
        F.when(~F.coalesce(F.array_contains(metrics, F.col("metric")), F.lit(False)), "unknown_metric")
        .when(~F.size(wanted).between(1, MOST_ITEMS), "invalid")
        .when(F.size(F.array_except(wanted, dims)) > 0, "unknown_dimension")
        .otherwise("planned")
    )
    return requests.withColumn("dimensions", wanted).withColumn("verdict", verdict)


def plan_digests(planned: DataFrame, binding: str) -> DataFrame:
    """Planned requests with the digest that binds model, metric and dimensions."""
    from memoryloom.functions import digest

    names = digest.joined(F.transform("dimensions", digest.framed))
    value = digest.sha256(digest.framed(F.lit("semantic-query.v1")), digest.framed(F.lit(binding)), digest.framed(F.col("metric")), names)
    return planned.where("verdict = 'planned'").withColumn("plan_digest", value)


def registered(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with the digest of the schema that has exactly their namespace, name and version; null if none has."""
    return requests.join(registry.select("namespace", "name", "version", "schema_digest"), ["namespace", "name", "version"], "left")


def restorable(manifest_version: Column, schema: Column, wanted: str, supported: str | None = None, family: str = "", least: int = 1, most: int = 1) -> Column:
    """Whether a backup may be restored: its manifest of the wanted version, its schema the supported one or in the window."""
    ok = schema == supported if supported is not None else schema_accepted(schema, family, least, most)
    return F.coalesce((manifest_version == wanted) & ok, F.lit(False))
