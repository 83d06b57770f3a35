"""Quality rules per document and verdicts per host."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import Scratch, steps

SYMBOLS = b"#*$%&|<>"
#: Soft rules (condition over the counts): they count against a document only where its host is known for them.
SOFT = {
    "symbols": "n_symbols * 10 > n_words",
    "repeats": "n_repeat_words * 5 > n_words",
    "lines": "n_dup_lines * 3 > n_lines",
    "length": "word_chars > n_words * 12 or word_chars < n_words * 2",
}
#: A host is known for a rule at this shrunken rate, and bad altogether at that one.
KNOWN, BAD = 0.02, 0.6


def _counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    # Code points: the bytes that don't continue a character.
    chars = sum(map(len, words)) if len(raw) == len(text) else len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n >= 3:
        first: dict[bytes, int] = {}
        ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
        windows = (ids[:-2] * len(first) + ids[1:-1]) if len(first) < 2**31 else None
        pair, two = np.unique(windows, return_inverse=True)
        triple, at, times = np.unique(two * len(first) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        if len(again):
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[again + k] = True
            repeats = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The counts of every whole text, with doc_id and host. Null text has no word; all counts are zero."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            rows = np.array([_counts(t) for t in texts], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(rows[:, k]) for k in range(6))], ["doc_id", "host", *names])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[host].cast("string").alias("host"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))


def host_rates(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """host_key and each rule's failure rate there, shrunk by a beta prior that the hosts' own rates give.

    The prior's mean is the rate over all documents, and its strength follows from how the rates vary among hosts
    (method of moments). Hosts are aggregated with partial sums, so one that holds a third of all rows is one row a
    task in the shuffle; the moments are one row. Documents of the null host form a host of their own.
    """
    by_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"cast({c} as long)")).alias(k) for k, c in rules.items()])
    moments = []
    for k in rules:
        rate = F.col(k) / F.col("n")
        moments += [(F.sum(k) / F.sum("n")).alias(f"{k}_mean"), F.var_pop(rate).alias(f"{k}_var")]
    total = by_host.agg(*moments, (F.count(F.lit(1)) / F.sum(1 / F.col("n"))).alias("typical_n"))
    joined = by_host.join(F.broadcast(total))  # one row
    out = []
    for k in rules:
        m, v = F.col(f"{k}_mean"), F.col(f"{k}_var")
        spread = F.greatest(v - m * (1 - m) / F.col("typical_n"), F.lit(1e-6))  # beyond what sampling explains
        strength = F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(2.0)), F.lit(1000.0))
        out.append(((F.col(k) + strength * m) / (F.col("n") + strength)).alias(f"{k}_rate"))
    return joined.select(F.col("host").alias("host_key"), *out)


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document.

    base_failed: under 50 words, or over half of the words in repeated windows. Others are kept unless they fail a
    soft rule at whose shrunken rate their host is known for it, or their host's rate of base failures is beyond BAD
    and they fail a soft rule too. Null and empty texts have no word and fail; repeated rows repeat and count in their
    host's rates; an empty table gives none; other columns aren't read. A long text is counted in memory of a few
    times its size. The rates are written before the join, so Spark can split a host with very many documents.
    """
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    with Scratch(spark) as scratch:
        rows = scratch.save(counts(docs).withColumn("base_failed", base))
        scratch.kept.add(scratch.paths[id(rows)])
        rates = scratch.keep(host_rates(rows, {"base": "base_failed", **SOFT}))
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("host_key")), "left")
    soft = {k: F.expr(c) for k, c in SOFT.items()}
    known = [soft[k] & (F.col(f"{k}_rate") >= KNOWN) for k in ("symbols", "lines", "length")]
    known.append((soft["repeats"] | soft["symbols"]) & (F.col("base_rate") >= BAD))
    fails = F.lit(False)
    for x in known:
        fails = fails | F.coalesce(x, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails)


def op10_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same rows in SQL, for tables whose doc_id is unique."""
    rules = {"base": "base_failed", **SOFT}
    sums = ", ".join(f"sum(({c})::int) as {k}" for k, c in rules.items())
    total = ", ".join(f"sum({k}) / sum(n) as {k}_mean, var_pop({k} / n) as {k}_var" for k in rules)
    strength = "least(greatest({k}_mean * (1 - {k}_mean) / greatest({k}_var - {k}_mean * (1 - {k}_mean) / typical_n, 1e-6::double) - 1, 2.0::double), 1000.0::double)"
    rates = ", ".join(f"({k} + {strength.format(k=k)} * {k}_mean) / (n + {strength.format(k=k)}) as {k}_rate" for k in rules)
    known = " or ".join(f"(({SOFT[k]}) and {k}_rate >= {KNOWN})" for k in ("symbols", "lines", "length"))
    return f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
p as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from p),
h as (select doc_id, count(distinct i + k) as n from g, range(3) r(k) where g.n > 1 group by doc_id),
c as (select w.doc_id, source as host, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(h.n, 0) as n_repeat_words, len(ls) as n_lines
      from w left join h on h.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
s as (select host, count(*)::double as n, {sums} from b group by host),
m as (select {total}, count(*) / sum(1 / n) as typical_n from s),
r as (select host, {rates} from s, m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not ({known} or ((({SOFT['repeats']}) or ({SOFT['symbols']})) and base_rate >= {BAD})) as kept
from b join r on b.host is not distinct from r.host
"""


ORACLE_SQL = _sql()
