"""Secret scanning by patterns and multipart credential linking, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import Scratch, plain

#: Base kinds, in the order that breaks ties of the start.
ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+"
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: Weak parts: alone they say little. An access identifier, a secret without a name, the endpoint they belong to.
ACCESS = r"(?i:client_?id|access_?key_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@=-]{3,}"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"(?i:https?|jdbc:[a-z0-9]+|mongodb|postgres(?:ql)?|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+"
WEAK = {"id_part": ACCESS, "secret_part": SECRET, "endpoint_part": ENDPOINT}
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}
#: Code points within which parts belong to one credential.
SCOPE = 400
#: Items that are folded at a time.
RUN = 128

SPAN = "array<struct<start: int, ord: int, kind: string, end: int>>"
GAP = "array<struct<`from`: int, size: int>>"


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: an array of one binds it."""
    return F.transform(F.array(x), f)[0]


def _runs(x: Column) -> Column:
    """The array x, bound and not empty, in runs of RUN."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, RUN))


def folded(items: Column, at: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The arrays of the given type that step(at, item) -> (next at, array) gives for each item in turn, flattened.

    Items are folded in runs, so an array grows within a run only, and what a long array takes stays nearly in
    proportion to its length.
    """
    none = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        to, out = step(acc["at"], x)
        return F.struct(to.alias("at"), F.concat(acc["out"], out).alias("out"))

    def run(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _bound(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(x: Column) -> Column:
        out = F.aggregate(_runs(x), F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), run, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(x) > 0, out).otherwise(none)

    return _bound(items, whole)


def spans(text: Column, pattern: str, kind: str, least: Column | None = None) -> Column:
    """Spans of the leftmost, non-overlapping matches, in code points, end exclusive.

    What stands between the matches and the matches themselves give the places; least drops matches where it fails,
    given the match as x.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    keep = lambda m: F.lit(True) if least is None else F.length(F.regexp_replace(m, "^" + ASSIGN_HEAD, "")) >= least
    sized = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), keep(m).alias("keep")))
    # A zip pads the match behind the last gap with null; it carries the end of the text and goes.
    sized = F.filter(sized, lambda x: x["size"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        row = F.struct(start.alias("start"), F.lit(ORDER[kind]).alias("ord"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))
        return start + x["size"], F.when(x["keep"], F.array(row)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(pattern), folded(sized, F.lit(0), step, SPAN)).otherwise(F.array().cast(SPAN))


def shown(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base spans and weak parts of every whole text; null text counts as empty.

    Rows map to rows, so repeated rows repeat, null ids stay and an empty table gives none; other columns aren't read.
    Hex runs and access keys match greedily, so asking for their least length in the pattern drops just the runs that
    fail. An assignment's value is measured after the match, since a short value still takes up its place. Time is
    nearly in proportion to a text's length and its matches.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return _scanned(docs.select(docs[doc_id].cast("long").alias("doc_id"), t.alias("t")), "t").drop("t")


def _scanned(rows: DataFrame, text: str) -> DataFrame:
    """rows with the spans of each kind, and text_key, the digest of texts that have weak parts."""
    base = [spans(F.col(text), p, k, F.lit(6) if k == "assign" else None).alias(k) for k, p in BASE.items()]
    weak = [spans(F.col(text), p, k).alias(k) for k, p in WEAK.items()]
    linked = (F.size("id_part") + F.size("secret_part") + F.size("endpoint_part")) > 0
    return rows.select("*", *base, *weak).withColumn("text_key", F.when(linked, F.sha2(text, 256)))


def link(found: DataFrame) -> DataFrame:
    """text_key and the weak parts that have complementary ones within SCOPE, as spans.

    A part counts if parts of two other roles, or one and an access key, overlap its surroundings: an identifier
    needs a secret, a secret an identifier or endpoint, an endpoint a secret. This is an interval join on the text and
    the scope-wide bin: a left part is put in every bin from its start to its end, a right one in those of its
    surroundings, so parts that are close share a bin however long they are; distinct spans bound what a bin holds.
    Equal texts are joined once. The semi-join gives no pairs, and a part kept in several bins counts once.
    """
    texts = found.where("text_key is not null").dropDuplicates(["text_key"])
    roles = {"access": "id", "id_part": "id", "assign": "secret", "hex": "secret", "secret_part": "secret", "endpoint_part": "endpoint"}
    parts = texts.select("text_key", F.explode(F.concat(*roles)).alias("p")).select("text_key", "p.*")
    role = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    parts = parts.withColumn("role", role[F.col("kind")])
    left = parts.where(F.col("kind").isin(list(WEAK))).withColumn("bin", F.explode(F.expr(f"sequence(start div {SCOPE}, end div {SCOPE})")))
    right = parts.select(F.col("text_key").alias("k2"), F.col("role").alias("role2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    right = right.withColumn("bin2", F.explode(F.expr(f"sequence(greatest(s2 - {SCOPE}, 0) div {SCOPE}, (e2 + {SCOPE}) div {SCOPE})")))
    apart = (F.col("s2") < F.col("end") + SCOPE) & (F.col("start") < F.col("e2") + SCOPE) & ((F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start")))
    fits = (F.col("role") != F.col("role2")) & ((F.col("role") == "secret") | (F.col("role2") == "secret"))
    kept = left.join(right, (F.col("text_key") == F.col("k2")) & (F.col("bin") == F.col("bin2")) & apart & fits, "left_semi")
    return kept.groupBy(F.col("text_key").alias("key2")).agg(F.collect_set(F.struct("start", "ord", "kind", "end")).alias("parts"))


def _every(scratch: Scratch, found: DataFrame) -> DataFrame:
    """found (of _scanned) with base, its base spans, and spans, those and the linked weak parts.

    Only rows with weak parts are joined, so the others, which are most, don't meet in one task.
    """
    found = scratch.save(found)
    scratch.kept.add(scratch.paths[id(found)])
    linked = scratch.keep(link(found))
    with_parts = found.where("text_key is not null").join(linked, F.col("text_key") == F.col("key2"), "left").drop("key2")
    rows = found.where("text_key is null").withColumn("parts", F.lit(None).cast(SPAN)).unionByName(with_parts)
    return rows.withColumns({"base": F.array_sort(F.concat(*BASE)), "spans": F.array_sort(F.concat(*BASE, F.coalesce("parts", F.array().cast(SPAN))))})


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base (base spans) and spans (those and the linked weak parts), each by start, then kind. Cases as in scan."""
    with Scratch(spark) as scratch:
        return _every(scratch, scan(docs)).select("doc_id", *BASE, "base", "spans")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans become one mark. All rows and columns stay.

    A row's spans stand beside it, so repeated rows and null ids get their own, and other columns may have any names.
    Null and empty texts stay as they are, and an empty table stays empty. The linked parts of a text are joined by
    its SHA-256 digest. A text is put together from an array of its pieces in one step.
    """
    rows, _, text = plain(docs)
    with Scratch(spark) as scratch:
        found = _every(scratch, _scanned(rows.withColumn("whole", F.coalesce(F.col(text).cast("string"), F.lit(""))), "whole").drop("whole"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.struct((at + 1).alias("from"), (x["start"] - at).alias("size"))
        return F.greatest(at, x["end"]), F.when(x["start"] < at, F.array().cast(GAP)).otherwise(F.array(gap))

    def cut(r: Column) -> Column:
        """The gaps of a run, cut out of the part of the text that the run spans."""
        start = lambda x: x[0]["from"]
        size = F.element_at(r, -1)["from"] + F.element_at(r, -1)["size"] - start(r)
        both = F.struct(r.alias("gaps"), F.substring(F.col(text), start(r), size).alias("part"))
        return _bound(both, lambda z: F.transform(z["gaps"], lambda g: F.substring(z["part"], g["from"] - start(z["gaps"]) + 1, g["size"])))

    pieces = _bound(folded(F.col("spans"), F.lit(0), step, GAP), lambda x: F.flatten(F.transform(_runs(x), cut)))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    done = F.concat(F.array_join(pieces, mark), F.lit(mark), F.substring(F.col(text), last + 1, F.length(text)))
    return found.select(*(F.when(F.size("spans") == 0, F.col(text)).otherwise(done).alias(c) if c == text else c for c in rows.columns)).toDF(*docs.columns)
