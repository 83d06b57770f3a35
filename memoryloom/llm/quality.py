"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm.shared import held_out, plain, steps

#: Labelled rows that a fit reads at most, least hashes first, and the characters of each: longer texts are no examples.
FIT_ROWS, FIT_CHARS = 3000, 30_000
VOCABULARY, DIMENSIONS, NONZERO, WINDOW, HIDDEN = 20_000, 64, 8, 2, 32
CACHE_WORDS = 300_000

_RUN = re.compile(r"(.)\1+", re.S)


class _Classes(dict):
    """Character classes for str.translate: letters a or A, digits 0, other characters themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return out


_CLASSES = _Classes()


def shape(word: str) -> str:
    """Classes of the word's characters, runs shortened: 'The&&&' gives '<Aa&>'."""
    return f"<{_RUN.sub(lambda m: m[1], word.translate(_CLASSES))[:12]}>"


@dataclass
class Model:
    ids: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def word_ids(self, texts: list[str], known: dict[str, int]) -> list[np.ndarray]:
        """Ids of each text's words: the word's own, else its shape's, else 0; a word that repeats the one before it is id 1."""
        cut = [t.split() for t in texts]
        new = set().union(*cut).difference(known) if cut else set()
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set().union(*cut)
        get = self.ids.get
        for w in new:
            known[w] = x if (x := get(w, -1)) >= 0 else get(shape(w), 0)
        out = []
        for ws in cut:
            ids = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
            if len(ws) > 1:
                ids[1:][np.fromiter(map(str.__eq__, ws[1:], ws), bool, len(ws) - 1)] = 1
            out.append(ids)
        return out

    def pool(self, ids: np.ndarray) -> np.ndarray:
        return self.vectors[ids].mean(0) if len(ids) else np.zeros(self.vectors.shape[1])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -40, 40)))


def word_vectors(streams: list[np.ndarray], size: int, rng: np.random.Generator) -> np.ndarray:
    """Random indexing: a word's vector is the sum of the sparse ternary index vectors of the words near it, unit length."""
    index = np.zeros((size, DIMENSIONS), np.float32)
    for row in index:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    context = np.zeros_like(index)
    flat = np.concatenate([np.append(s, -1) for s in streams]) if streams else np.zeros(0, np.int64)
    for gap in range(1, WINDOW + 1):
        a, b = flat[:-gap], flat[gap:]
        ok = (a >= 0) & (b >= 0)
        for k in range(1, gap):
            ok &= flat[k : len(flat) - gap + k] >= 0
        pairs, n = np.unique(np.concatenate([a[ok] * size + b[ok], b[ok] * size + a[ok]]), return_counts=True)
        for i in range(0, len(pairs), 200_000):
            w, c = pairs[i : i + 200_000] // size, pairs[i : i + 200_000] % size
            start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            context[w[start]] += np.add.reduceat(index[c] * n[i : i + 200_000, None], start)
    context += 4 * index  # a word seen once or twice still differs from its neighbours
    return context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Two layers by Adam on the cross-entropy, classes weighted evenly."""
    w = [rng.normal(0, DIMENSIONS**-0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    turn = 0
    for _ in range(60):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            turn += 1
            h = np.tanh(x[part] @ w[0] + w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[part]) * balance[part] / len(part)
            back = np.outer(e, w[2]) * (1 - h * h)
            grads = [x[part].T @ back + 1e-3 * w[0], back.sum(0), h.T @ e + 1e-3 * w[2], e.sum()]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**turn)) / (np.sqrt(v[i] / (1 - 0.999**turn)) + 1e-8)
    return w


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of the labelled texts. A fifth of them sets the temperature alone. Without both labels every score is their mean."""
    rng = np.random.default_rng(seed)
    counts = Counter(w for t in texts for w in t.split())
    shapes = Counter(shape(w) for t in texts for w in t.split())
    common = [w for w, n in counts.most_common(VOCABULARY // 2) if n >= 5]
    names = ["<other>", "<again>", *common, *(s for s, n in shapes.most_common(VOCABULARY // 2 - 2) if n >= 2)]
    ids = {w: i for i, w in enumerate(names)}
    model = Model(ids, np.zeros((len(names), DIMENSIONS), np.float32), np.zeros(DIMENSIONS), np.ones(DIMENSIONS), [], 1.0)
    streams = model.word_ids(texts, {})
    model.vectors = word_vectors(streams, len(names), rng)
    x, y = np.array([model.pool(s) for s in streams]).reshape(-1, DIMENSIONS), np.array(labels, float)
    if len(set(labels)) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        model.weights = [np.zeros((DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(p / (1 - p)))]
        return model
    aside = rng.random(len(x)) < 0.2
    if not aside.any() or len(set(y[~aside])) < 2:
        aside[:] = False
    model.mean, model.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    model.weights = _train((x[~aside] - model.mean) / model.scale, y[~aside], rng)
    z, t = model.logits(x[aside] if aside.any() else x), y[aside] if aside.any() else y
    loss = lambda c: np.logaddexp(0, np.where(t == 1, -z, z) / c).mean()
    model.temperature = float(min(np.geomspace(0.25, 16, 61), key=loss))
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most rows labelled texts of 1 to FIT_CHARS characters that are not held out.

    Every text counts once, however many rows or documents hold it: its label is that of its least doc_id (the least
    label, if that has several), and a doc_id with several texts has several examples. Texts are told apart by a hash of 64 bits;
    those of the least (hash of doc_id, doc_id, hash of text) make the sample, so it doesn't depend on the order of
    rows. Rows without an id have no label. Rows and characters that reach the driver are bounded by the parameters.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    some = some.where(~held_out("doc_id") & F.length("text").between(1, FIT_CHARS)).withColumn("h", F.xxhash64("text"))
    once = some.select("doc_id", "h").join(marks, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "quality")).alias("x"))
    picked = once.select("h", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(rows).collect()
    if not picked:
        return fit([], [])
    want = docs.sparkSession.createDataFrame([(r.h, r.doc_id) for r in picked], "h long, doc_id long")
    # The sample's rows, as many as the parameter says, are broadcast; copies of a row are one again before they are collected.
    texts = some.join(F.broadcast(want), ["h", "doc_id"]).groupBy("h").agg(F.min("text").alias("text")).limit(rows)
    found = {r.h: r.text for r in texts.collect()}
    order = sorted(picked, key=lambda r: (r.doc_id, r.h))
    return fit([found[r.h] for r in order], [r.quality for r in order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; null and empty texts pool to zero and get that vector's score.

    Rows map to rows: repeated ones repeat, null ids stay, an empty table gives none, and no other column is read.
    Long texts are pooled whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for part, texts in steps(batches):
            pooled = np.array([m.pool(s) for s in m.word_ids(texts, known)]).reshape(len(texts), -1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores(pooled), pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is least or more, with all their columns, whatever their names.

    Equal rows get equal scores; null and empty texts get that of the zero vector; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, _, text = plain(docs)
    if dict(rows.dtypes)[text] != "string":
        rows = rows.withColumn(text, rows[text].cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for part, texts in steps(batches, text):
            pooled = np.array([m.pool(s) for s in m.word_ids(texts, known)]).reshape(len(texts), -1)
            yield part.filter(pa.array(m.scores(pooled) >= least))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
