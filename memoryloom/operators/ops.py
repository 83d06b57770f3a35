"""Operation metrics, cost, percentiles, service levels, lineage and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoryloom.functions.digest import tagged
from memoryloom.functions.text import ratio_ceil
from memoryloom.operators import evaluate

OPERATIONS = ["remember", "recall", "improve", "forget", "context"]
#: The nodes of an audit record's lineage, in order.
LINEAGE = ["request", "intent", "binding", "snapshot", "source_manifest", "proposal", "decision", "outcome", "receipt"]


def metrics(samples: DataFrame) -> DataFrame:
    return samples.groupBy("operation").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("allowed")).alias("denials"), F.sum("latency_micros").cast("decimal(38,0)").alias("total_micros"), F.max("latency_micros").alias("max_micros"))


def cost(samples: DataFrame, counters: dict[str, Column], rates: dict[str, int]) -> DataFrame:
    """Sums of the counters and the weighted sum, as decimals that don't overflow."""
    wide = {k: c.cast("decimal(38,0)") for k, c in counters.items()}
    total = sum((wide[k] * F.lit(rates[k]).cast("decimal(10,0)") for k in wide), F.lit(0).cast("decimal(10,0)"))
    return samples.groupBy("operation").agg(*[F.sum(c).alias(k) for k, c in wide.items()], F.sum(total).alias("microcredits"))


def percentiles(samples: DataFrame) -> DataFrame:
    """Nearest-rank percentiles per operation, null for one without samples; no task holds all values of an operation."""
    rank = lambda p: lambda n: F.greatest(F.lit(1), F.ceil(p * n / 100))
    found = evaluate.at_ranks(samples, F.col("operation"), "latency_micros", {f"p{p}": rank(p) for p in (50, 95, 99)})
    return found.withColumnRenamed("grp", "operation")


def service_levels(samples: DataFrame, most_micros: int, most_denials_bp: int) -> DataFrame:
    """All five operations: whether they were seen, the denial rate (rounded up) and whether they comply; an unseen one does."""
    m = metrics(samples)
    every = samples.sparkSession.createDataFrame([(x,) for x in OPERATIONS], "operation string").join(m, "operation", "left")
    bp = ratio_ceil(F.coalesce("denials", F.lit(0)), F.coalesce("count", F.lit(0)))
    seen = F.col("count").isNotNull()
    return every.select("operation", seen.alias("observed"), bp.alias("denial_bp"), (~seen | ((F.col("max_micros") <= most_micros) & (bp <= most_denials_bp))).alias("compliant"))


def lineage_edges(records: DataFrame, key: str) -> DataFrame:
    """The eight edges between the nine digests of each record: a row map over a fixed array."""
    digest = lambda kind: F.substring(F.sha2(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).cast("binary"), 256), 1, 16)
    nodes = list(zip(LINEAGE, LINEAGE[1:]))
    edges = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(a).alias("from_kind"), F.lit(b).alias("to_kind"), digest(a).alias("from_digest"), digest(b).alias("to_digest")) for i, (a, b) in enumerate(nodes)])
    return records.select(key, F.explode(edges).alias("e")).select(key, "e.*")


def audit_export(records: DataFrame, key: str, subject: str, decision: str, domain: str = "audit-export.v1") -> DataFrame:
    """Records with subject and decision replaced by digests."""
    return records.select(key, tagged(domain, F.col(subject).cast("string")).alias("subject_digest"), tagged(domain, F.col(subject).cast("string"), F.col(decision)).alias("decision_digest"))
