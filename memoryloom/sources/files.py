"""Readers and writers of memory corpora: CSV, JSON, JSON lines, Parquet, tables, Arrow, manifests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.functions.text import literal_map

PRICES = "observation_id string, country string, commodity string, market string, price_usd_per_kg double, observed_on date, source string, note string"
CASES = "case_id string, query string, as_of string, expected_ids array<string>, abstain boolean"


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Price observations from CSV; an empty price is null, a negative one an error."""
    rows = spark.read.schema(PRICES).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)
    return rows.withColumn("price_usd_per_kg", F.when(F.col("price_usd_per_kg") < 0, F.raise_error(F.lit("a price is negative")).cast("double")).otherwise(F.col("price_usd_per_kg")))


def first_csv(spark: SparkSession, path: str) -> DataFrame:
    """Name of the first CSV file that a dataset description (JSON) lists."""
    schema = "data struct<latestVersion:struct<files:array<struct<label:string,dataFile:struct<id:bigint,filename:string>>>>>"
    files = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("data.latestVersion.files").alias("k", "f"))
    return files.where(F.lower(F.coalesce("f.dataFile.filename", "f.label")).endswith(".csv")).orderBy("k").limit(1).select("f.dataFile.id", F.coalesce("f.dataFile.filename", "f.label").alias("name"))


def load_table(rows: DataFrame, name: str) -> None:
    """rows as a managed table in place of an older one."""
    if not re.fullmatch("[a-z][a-z0-9_]{0,62}", name):
        raise ValueError("not a table name")
    rows.write.mode("overwrite").saveAsTable(name)


def by_country(spark: SparkSession, name: str, country: str) -> DataFrame:
    if not re.fullmatch("[a-z][a-z0-9_]{0,62}", name):
        raise ValueError("not a table name")
    return spark.sql(f"select observation_id, country, commodity, price_usd_per_kg, observed_on from {name} where country = :country", {"country": country})


def staged(spark: SparkSession, batch: pa.Table, most_bytes: int = 16 << 20) -> DataFrame:
    """A bounded Arrow table as a DataFrame."""
    if batch.nbytes > most_bytes:
        raise ValueError("the batch is too large")
    return spark.createDataFrame(batch)


def preflight(chunks: list[bytes], schema: pa.Schema, most_chunks: int = 256, most_rows: int = 100_000, most_bytes: int = 16 << 20) -> int:
    """Rows that Arrow IPC streams hold, by their messages; an error if they are more, or anything but one schema and its batches.

    Bytes are counted before a batch is read. Dictionaries, other schemas, batches ahead of the schema and what follows
    the end of a stream are errors, as is a stream without a schema.
    """
    if len(chunks) > most_chunks or sum(map(len, chunks)) > most_bytes:
        raise ValueError("the streams are too large")
    rows = size = 0
    for chunk in chunks:
        source = pa.BufferReader(chunk)
        messages, known = pa.ipc.MessageReader.open_stream(source), None
        try:
            for message in messages:
                if message.type == "schema" and known is None:
                    known = pa.ipc.read_schema(message)
                    if known != schema:
                        raise ValueError("not the schema that was expected")
                elif message.type == "record batch" and known is not None:
                    size += message.body.size if message.body else 0
                    if size > most_bytes:
                        raise ValueError("the batches are too large")
                    rows += pa.ipc.read_record_batch(message, known).num_rows
                    if rows > most_rows:
                        raise ValueError("too many rows")
                else:
                    raise ValueError(f"a message of type {message.type} is out of place")
        except pa.ArrowInvalid as e:
            raise ValueError("no Arrow IPC stream") from e
        if known is None or source.read():
            raise ValueError("a stream without a schema, or with bytes behind its end")
    return rows


def staged_ipc(spark: SparkSession, chunks: list[bytes], schema: pa.Schema) -> DataFrame:
    """Arrow IPC streams that pass preflight() as a DataFrame; no streams give no rows."""
    preflight(chunks, schema)
    tables = [pa.ipc.open_stream(c).read_all() for c in chunks]
    return spark.createDataFrame(pa.concat_tables(tables) if tables else schema.empty_table())


def pairs(result: DataFrame, most: int = 100_000) -> list[tuple[str, str]]:
    """Rows of a bounded result of two string columns, none null or blank."""
    if [t for _, t in result.dtypes] != ["string", "string"]:
        raise ValueError("expected two string columns")
    rows = [tuple(r) for r in result.limit(most + 1).collect()]
    if len(rows) > most or any(x is None or not x.strip() for r in rows for x in r):
        raise ValueError("the result is out of bounds")
    return rows


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines: ids unique, dates ISO, lengths bounded; anything else is an error."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("as_of", F.to_date("as_of", "yyyy-MM-dd")).withColumn("abstain", F.coalesce("abstain", F.lit(False)))
    bad = F.col("case_id").isNull() | F.col("query").isNull() | F.col("as_of").isNull() | F.col("expected_ids").isNull() | ~F.length("case_id").between(1, 256) | ~F.length("query").between(1, 16_384)
    if not rows.where(bad).isEmpty() or not rows.groupBy("case_id").count().where("count > 1").isEmpty() or rows.isEmpty():
        raise ValueError("the cases are not valid")
    return rows


def conversations_qa(spark: SparkSession, path: str, as_of: str = "9999-12-31") -> DataFrame:
    """Cases of a multi-session dialogue corpus: the questions of each conversation, without evidence to be abstained from."""
    schema = "qa array<struct<question:string,evidence:array<string>>>"
    rows = spark.read.schema("value string").text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schema.replace(' ', ':', 1)}>>").alias("c"))
    qa = rows.select(F.posexplode("c").alias("i", "c")).select("i", F.posexplode("c.qa").alias("j", "q"))
    return qa.select(F.concat_ws(":", F.lit("locomo"), "i", "j").alias("case_id"), F.col("q.question").alias("query"), F.lit(as_of).cast("date").alias("as_of"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("expected_ids"), (F.coalesce(F.size("q.evidence"), F.lit(0)) == 0).alias("abstain"))


def long_memory_qa(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a long-memory corpus: the date is the first ten characters, ids that end in _abs are to be abstained from."""
    rows = spark.read.schema("question_id string, question string, question_date string, answer_session_ids array<string>").option("multiLine", True).json(path)
    return rows.select(F.col("question_id").alias("case_id"), F.col("question").alias("query"), F.to_date(F.replace(F.substring("question_date", 1, 10), F.lit("/"), F.lit("-"))).alias("as_of"), F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("expected_ids"), F.col("question_id").endswith("_abs").alias("abstain"))


def probing_questions(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a Parquet corpus whose questions stand in a Python literal, by category; blank questions go. Reads two columns."""
    rows = spark.read.parquet(path).select("conversation_id", "probing_questions")

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [(f"beam:{c}:{k}:{i}", q["question"], k) for c, p in zip(f["conversation_id"], f["probing_questions"]) for k, qs in sorted(literal_map(p).items()) for i, q in enumerate(qs) if (q.get("question") or "").strip()]
            yield pd.DataFrame(out, columns=["case_id", "query", "category"])

    return rows.mapInPandas(run, "case_id string, query string, category string")


def manifest(rows: list[dict]) -> dict:
    """Digest of rows as JSON of sorted keys."""
    raw = json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return {"rows": len(rows), "digest": f"sha256:{hashlib.sha256(raw).hexdigest()}"}


def verified(rows: list[dict], pinned: dict) -> list[dict]:
    if manifest(rows) != pinned:
        raise ValueError("the corpus is not the pinned one")
    return rows


def inventory(spark: SparkSession, corpora: dict[str, tuple[str | None, Callable[[SparkSession, str], DataFrame]]]) -> list[dict]:
    """What there is of each named corpus (path and reader): normalized with cases and file digest, error, or unavailable.

    Files are read and hashed by the executors; only a count, a digest a file and a message come back.
    """
    report = []
    for name, (path, reader) in corpora.items():
        entry = {"name": name, "status": "unavailable"}
        if path and path.strip():
            try:
                # A message names the fault; what else the JVM says of it doesn't belong in a report.
                entry |= {"status": "normalized", "cases": reader(spark, path).count()}
                raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest")).orderBy("path")
                found = [r.digest for r in raw.collect()]
                entry["file_digest"] = "sha256:" + (found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest())
            except Exception as e:  # noqa: BLE001 - every fault of a corpus is reported
                entry = {"name": name, "status": "error", "error": (str(e).splitlines() or [""])[0][:256]}
        report.append(entry)
    return report


def write_report(report: dict, path: str) -> None:
    """A report as JSON of sorted keys; strings hold at most 256 characters and no newline."""

    def check(x):
        if isinstance(x, str) and (len(x) > 256 or "\n" in x):
            raise ValueError("a string is out of bounds")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(report)
    Path(path).write_text(json.dumps(report, sort_keys=True, indent=1) + "\n")
