"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memoryloom.llm.shared import held_out, steps

#: The fit's sample: documents a language at most, least hashes first; the characters of each; and of all, which are whole documents.
FIT_ROWS, FIT_DOC_CHARS, FIT_CHARS = 60, 20_000, 40_000
#: Characters, commonest first, whose transitions stand in a table; those of the others of a language are searched for.
ALPHABET = 96
#: Whole texts are parsed in segments of so many characters, each from the start of a phrase.
SEGMENT = 1000


def suffix_automaton(codes: list[int], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of all substrings without code 0; state 0 is the start, and 0 also means none.

    Transitions [state, code] of codes under alphabet, and those of the others as sorted keys (state << 32 | code) with
    the states that they lead to.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0

    def split(p: int, c: int) -> int:
        """A copy of the state that c leads to from p, for what is one longer than p."""
        q, copy = nxt[p][c], len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    for c in codes:
        if not c:
            last = 0
            continue
        if c in nxt[last]:  # after a code 0, where what comes may be known
            q = nxt[last][c]
            last = q if length[last] + 1 == length[q] else split(last, c)
            continue
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else split(p, c)
        last = cur
    table, rare = np.zeros((len(nxt), alphabet), np.int32), []
    for s, row in enumerate(nxt):
        for c, t in row.items():
            if c < alphabet:
                table[s, c] = t
            else:
                rare.append((s << 32 | c, t))
    rare.sort()
    return table, np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    languages: list[str]
    codes: list[np.ndarray]
    tables: list[np.ndarray]
    rare: list[tuple[np.ndarray, np.ndarray]]

    def _moved(self, j: int, state: np.ndarray | None, code: np.ndarray) -> np.ndarray:
        """Where codes lead to from states (none: the start) in the automaton of language j."""
        table, (keys, to) = self.tables[j], self.rare[j]
        if not len(keys):
            return table.ravel()[code if state is None else state * table.shape[1] + code]
        code = code.astype(np.int64)
        state = np.zeros(len(code), np.int64) if state is None else state
        width = table.shape[1]
        out = table.ravel()[state * width + np.where(code < width, code, 0)].astype(np.int64)
        far = np.flatnonzero(code >= width)
        if len(far):
            key = state[far] << 32 | code[far]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[far] = np.where(keys[at] == key, to[at], 0)
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases [text, language]: each phrase is the longest match from where the last one ended.

        All segments of all texts advance together, a character a step; a lane whose automaton has no transition
        starts a phrase at that character. A letter that the language doesn't know is a phrase of its own.
        """
        lowered = [t.lower() for t in texts]
        size = np.fromiter(map(len, lowered), np.int64, len(texts))
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = [known[np.minimum(points, len(known) - 1)] for known in self.codes]
        first = np.cumsum(size) - size
        per = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(texts)), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        start = first[text] + k * SEGMENT
        length = np.minimum(SEGMENT, size[text] - k * SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        live = np.searchsorted(-length, -np.arange(SEGMENT), "left")
        counts = np.zeros((len(start), len(self.tables)), np.int32)
        state = [np.zeros(len(start), np.int64) for _ in self.tables]
        for step in range(int(length.max()) if len(length) else 0):
            n = live[step]
            at = start[:n] + step
            for j, s in enumerate(state):
                c = codes[j][at]
                to = self._moved(j, s[:n], c)
                miss = to == 0
                counts[:n, j] += miss
                s[:n] = np.where(miss, self._moved(j, None, c), to)
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        np.add.at(out, text, counts)
        ends, letter = np.cumsum(size), _letters()[points]
        for j, c in enumerate(codes):
            new = np.flatnonzero(letter & (c == 0))
            out[:, j] += np.bincount(np.searchsorted(ends, new, "right"), minlength=len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language of fewest phrases a character (ties: the first by name) and its share of confidence, 1 being certain."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        n = self.phrases(texts) + 1.0
        rate = n / np.maximum(np.fromiter(map(len, texts), float, len(texts)), 1)[:, None]
        best = rate.argmin(1)
        # Bits of the parse: each phrase costs about the logarithm of the sample; the difference to the best is evidence.
        gap = np.minimum((n - n.min(1, keepdims=True)) * 0.5, 50)
        share = 1 / np.exp(-gap).sum(1)
        blank = [not any(map(str.isalpha, t)) for t in texts]
        return ["und" if e else self.languages[i] for i, e in zip(best, blank)], [0.0 if e else float(p) for p, e in zip(share, blank)]


def fit(samples: dict[str, list[str]]) -> Model:
    """An automaton of each language's texts, over all of their letters and the space; other characters end a phrase in every language alike."""
    languages, codes, tables, rare = sorted(samples), [], [], []
    for x in languages:
        joined = "\n".join(samples[x]).lower()
        common = [c for c, _ in sorted(Counter(joined).items(), key=lambda p: (-p[1], p[0])) if c.isalpha() or c == " "]
        known = np.zeros(max(map(ord, common), default=0) + 2, np.uint8 if len(common) < 255 else np.int32)
        for i, c in enumerate(common, 1):
            known[ord(c)] = i
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.append(known)
        table, *others = suffix_automaton(known[np.minimum(points, len(known) - 1)].tolist(), min(ALPHABET, len(common) + 1))
        tables.append(table)
        rare.append(tuple(others))
    return Model(languages, codes, tables, rare)


def fit_sample(docs: DataFrame) -> Model:
    """Fits on at most FIT_ROWS texts a language, of up to FIT_DOC_CHARS characters, none held out.

    A text counts once a language, however many rows hold it (told by a hash of 64 bits), whether they have an id or
    not. Distinct texts are estimated by sketches, one row a language, as many as the model has automata; those whose
    hash lies under what leaves a few times FIT_ROWS of them are ranked by it, and the first, whole, make up to
    FIT_CHARS characters. So neither repeats nor the order of rows change the sample, and what reaches the driver is
    bounded by the parameters. A table without such rows gives a model without languages.
    """
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    ok = some.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.length("text").between(1, FIT_DOC_CHARS)).withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in ok.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return fit({})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (4.0 * FIT_ROWS + 40) / max(n, 1))])
    few = ok.select("lang", "h").where((F.col("h") / F.lit(2.0**63) + 1) / 2 <= share[F.col("lang")]).distinct()
    few = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= FIT_ROWS).collect()
    want = docs.sparkSession.createDataFrame([(r.lang, r.h, r.k) for r in few], "lang string, h long, k int")
    texts = ok.select("lang", "h", "text").join(F.broadcast(want), ["lang", "h"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text")).limit(max(1, len(few)))
    samples: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.k)):
        if sum(map(len, samples.setdefault(r.lang, []))) + len(r.text) <= FIT_CHARS:
            samples[r.lang].append(r.text)
    return fit(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document; null text or none with a letter: und, 0.

    Rows map to rows: repeated ones repeat, null ids stay, an empty table gives none, and no other column is read. A
    tie of languages goes to the first by name. Long texts are parsed whole, in segments side by side.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            lang, share = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit_sample(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
