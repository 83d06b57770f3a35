"""The event log behind remember, recall, improve and forget, and checks of commits against it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "commit_id string, ordinal int, op string, id string, space_id string, kind string, label int, text string, at timestamp, purpose string, valid_to timestamp"


@dataclass(frozen=True)
class Request:
    """A validated verb request."""

    space_id: str
    text: str = ""
    purpose: str = ""
    ids: tuple[str, ...] = ()

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_:/.\-]{1,256}", self.space_id):
            raise ValueError("the space is no identity")
        if len(self.text.encode()) > 16 * 1024:
            raise ValueError("the text is too long")
        if len(self.ids) > 256 or any(not re.fullmatch(r"[A-Za-z0-9_:/.\-]{1,256}", x) for x in self.ids):
            raise ValueError("the ids are out of bounds")


def latest(log: DataFrame, key: str, order: Column) -> DataFrame:
    """The last event of each key, by a partial aggregate."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns]), order).alias("row")).select("row.*")


def current(log: DataFrame) -> DataFrame:
    """Rows that were put and since then neither invalidated nor forgotten."""
    return latest(log, "id", F.struct("at", "ordinal")).where("op = 'put'")


def supersede(sources: DataFrame) -> DataFrame:
    """Label and members of the record that takes the place of sources: the strictest label wins."""
    return sources.agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))


def stale(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digest differs or that stand on one side alone; a commit goes ahead only if there is none."""
    a, b = expected.select(key, F.col(digest).alias("expected_digest")), actual.select(key, F.col(digest).alias("actual_digest"))
    return a.join(b, key, "full_outer").where(~F.col("expected_digest").eqNullSafe(F.col("actual_digest")))


def kind_conflicts(mentions: DataFrame, name: str = "entity", kind: str = "entity_kind") -> DataFrame:
    """Entities that are mentioned with more than one kind."""
    return mentions.groupBy(name).agg(F.count_distinct(kind).alias("kinds")).where("kinds > 1")


@contextmanager
def temp_view(df: DataFrame) -> Iterator[str]:
    """A uniquely named view of df that goes at the end, whatever happens."""
    name = f"v_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


class Ledger:
    """An append-only log in one folder; a single writer commits, and a commit is one write that is listed or not.

    Every commit is a folder of its own under log/, named by its idempotency key, and counts once the marker that
    Spark writes last is there. Committing a key again changes nothing. Where texts were erased a later version of the
    commit, in a folder beside it, counts in its place; the first folder then holds the marker alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def _versions(self) -> dict[str, int]:
        """The version that counts of each commit: the latest whose marker is there."""
        p, fs = self._at(f"{self.path}/log/*/_SUCCESS")
        found: dict[str, int] = {}
        for x in fs.globStatus(p) or []:
            if m := re.fullmatch(r"(?s)(?:commit|version-(\d+))-(.*)", x.getPath().getParent().getName()):
                found[m[2]] = max(found.get(m[2], 0), int(m[1] or 0))
        return found

    def _folder(self, key: str, version: int) -> str:
        return f"{self.path}/log/" + (f"version-{version}-{key}" if version else f"commit-{key}")

    def log(self) -> DataFrame:
        """The events of the commits whose marker is there; what a crash left of others is not read."""
        folders = [self._folder(k, v) for k, v in sorted(self._versions().items())]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _digest(self, rows: DataFrame) -> str:
        """Digest of a commit's events, which a request bounds."""
        lines = F.array_sort(F.collect_list(F.to_json(F.struct(*[F.col(x.split()[0]) for x in SCHEMA.split(", ")]))))
        return rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("x")).first().x

    def recover(self, key: str, events: DataFrame) -> bool:
        """Whether key was committed, with these very events; others under the same key are an error.

        Texts that were erased since then can't be compared.
        """
        if not self._exists(f"{self._folder(key, 0)}/_SUCCESS"):
            return False
        stored = self.spark.read.schema(SCHEMA).parquet(self._folder(key, self._versions()[key]))
        erased = [r.id for r in stored.where("op = 'put' and text is null").select("id").collect()]
        rows = self._rows(key, events).withColumn("text", F.when(~F.col("id").isin(erased), F.col("text")) if erased else F.col("text"))
        if self._digest(stored) != self._digest(rows):
            raise ValueError("the key stands for another commit")
        return True

    def _rows(self, key: str, events: DataFrame) -> DataFrame:
        kinds = [x.split() for x in SCHEMA.split(", ")]
        there = {"commit_id": F.lit(key)} | {n: F.col(n) for n in events.columns if n != "commit_id"}
        return events.select([there.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds])

    def commit_expecting(self, key: str, events: DataFrame, sources: DataFrame) -> bool:
        """commit() if sources (id, text) still stand as they are given and no id that is put is known; False if it was done before.

        Anything stale is an error and nothing is written. A commit that was done is recovered first, since its own
        events make its sources stale.
        """
        if self.recover(key, events):
            return False
        now, ids = current(self.log()), sources.select("id")
        found = now.join(ids, "id", "left_semi")
        if not stale(sources.select("id", "text"), found, "id", "text").isEmpty():
            raise ValueError("a source is stale")
        if not events.where("op = 'put'").join(self.log().select("id"), "id", "left_semi").isEmpty():
            raise ValueError("a new record is known already")
        return self.commit(key, events)

    def commit(self, key: str, events: DataFrame) -> bool:
        """Whether the events were written: False if key was committed before."""
        folder = self._folder(key, 0)
        if self._exists(f"{folder}/_SUCCESS"):
            return False
        rows = self._rows(key, events)
        rows.write.mode("overwrite").parquet(folder)
        return True

    def _event(self, op: str, rows: list[tuple], purpose: str = "", valid_to=None) -> DataFrame:
        new = self.spark.createDataFrame([(i, op, *r) for i, r in enumerate(rows)], "ordinal int, op string, id string, space_id string, kind string, label int, text string, at timestamp")
        return new.withColumns({"purpose": F.lit(purpose or None).cast("string"), "valid_to": F.lit(valid_to).cast("timestamp")})

    def remember(self, key: str, request: Request, at, label: int = 1, valid_to=None) -> str:
        """A new record, valid from at until valid_to; one remembered for a purpose is recalled for that purpose alone."""
        new = f"mem-{uuid.uuid5(uuid.NAMESPACE_OID, key).hex}"
        self.commit(key, self._event("put", [(new, request.space_id, "semantic", label, request.text, at)], request.purpose, valid_to))
        return new

    def recall(self, request: Request, ceiling: int = 1, at=None) -> DataFrame:
        """Records of the space that share a word with the text, as they stood at the instant (now, if none is given).

        Space, validity and purpose come before any ranking. What lies above the ceiling is redacted: it has no text.
        """
        from memoryloom.operators.rank import lexical

        instant = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
        rows = current(self.log().where(F.col("at") <= instant)).where(F.col("space_id") == request.space_id)
        rows = rows.where(F.col("valid_to").isNull() | (instant < F.col("valid_to")))
        rows = rows.where(F.col("purpose").isNull() | (F.col("purpose") == request.purpose))
        seen = F.coalesce(F.col("label") <= ceiling, F.lit(False))
        shown = {"visibility": F.when(seen, "visible").otherwise("redacted"), "text": F.when(seen, F.col("text"))}
        return lexical(rows, request.text).withColumns(shown).orderBy(F.desc("overlap"), "id")

    def improve(self, key: str, request: Request, at) -> str:
        """One new record in place of request.ids, in one commit; unknown ids are an error."""
        old = current(self.log()).where(F.col("id").isin(list(request.ids)) & (F.col("space_id") == request.space_id))
        row = supersede(old).first()
        if row.n != len(set(request.ids)):
            raise ValueError("a source is missing")
        new = f"mem-{uuid.uuid5(uuid.NAMESPACE_OID, key).hex}"
        gone = self._event("invalidate", [(x, request.space_id, None, None, None, at) for x in request.ids])
        self.commit(key, gone.unionByName(self._event("put", [(new, request.space_id, "semantic", row.label, request.text, at)], request.purpose)))
        return new

    def forget(self, key: str, request: Request, at) -> bool:
        """Hides the ids, by a commit, then erases their texts; done again, it finishes what a crash left."""
        new = self.commit(key, self._event("tombstone", [(x, request.space_id, None, None, None, at) for x in request.ids]))
        self.erase()
        return new

    def erase(self) -> int:
        """Takes the texts of forgotten records out of the stored files; how many commits were written anew.

        Such a commit is written as its next version, which counts from its marker on, and then the files of those
        before it go. A crash in between leaves both, and the next call deletes the former.
        """
        log, versions = self.log(), self._versions()
        gone = latest(log, "id", F.struct("at", "ordinal")).where("op = 'tombstone'").select("id")
        held = log.where("text is not null").join(gone, "id", "left_semi").select("commit_id").distinct()
        keys = [r.commit_id for r in held.collect()]  # at most the commits, whose folders are listed here anyway
        for key in keys:
            rows = self.spark.read.schema(SCHEMA).parquet(self._folder(key, versions[key]))
            there = rows.join(gone.withColumnRenamed("id", "gone"), F.col("id") == F.col("gone"), "left")
            clean = there.withColumn("text", F.when(F.col("gone").isNull(), F.col("text"))).drop("gone")
            clean.write.mode("overwrite").parquet(self._folder(key, versions[key] + 1))
        self._drop_former()
        return len(keys)

    def _drop_former(self) -> None:
        """Deletes the files of versions that no longer count, but for the first folder's marker."""
        p, fs = self._at(f"{self.path}/log")
        now = self._versions()
        for x in fs.listStatus(p) if fs.exists(p) else []:
            m = re.fullmatch(r"(?s)(?:commit|version-(\d+))-(.*)", x.getPath().getName())
            if not m or int(m[1] or 0) >= now.get(m[2], 0):
                continue
            if m[1]:
                fs.delete(x.getPath(), True)
                continue
            for f in fs.listStatus(x.getPath()):
                if f.getPath().getName() != "_SUCCESS":
                    fs.delete(f.getPath(), True)
