"""Toxicity by a logistic regression that is indifferent to which group a text mentions.

Features are words and word beginnings, hashed; those that tell toxic from other documents best are kept. For every
labelled text that names a group the same text with another group is made, and the squared change of its score is
part of what training makes small: a group's name alone can't make a text toxic.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import ChunkCache, bounded, bucket, fold, texts, worker_cache

HASH_BITS = 18
# Labelled rows that the model is fitted on.
LABELLED_ROWS = 20_000
FEATURES = 2_048
WORD = re.compile(r"\w+")
# Terms of one line may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("muslims", "christians", "jews", "hindus", "buddhists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian"),
    ("immigrants", "natives"), ("old", "young"), ("deaf", "hearing"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def _word_features(word: str) -> set[int]:
    return {bucket(p, 1 << HASH_BITS) for p in {f"={word}", *(word[:n] for n in range(3, 8) if len(word) >= n)}}


def chunk_features(chunk: str) -> list[int]:
    return sorted({f for w in WORD.findall(chunk.lower()) for f in _word_features(w)})


_all = ChunkCache(lambda chunk: np.asarray(chunk_features(chunk), np.int64).tobytes())


def swapped(text: str, terms=IDENTITY_TERMS) -> str | None:
    """The text with each identity term replaced by the next of its line; None if there is none."""
    other = {t: line[(i + 1) % len(line)] for line in terms for i, t in enumerate(line)}
    n = 0

    def change(m):
        nonlocal n
        n += m[0].lower() in other
        return other.get(m[0].lower(), m[0])

    new = WORD.sub(change, text)
    return new if n else None


def _kept_features(kept: np.ndarray):
    """What a chunk has of the kept features, as their places."""
    place = {int(f): i for i, f in enumerate(kept)}
    return lambda chunk: np.asarray([place[f] for f in chunk_features(chunk) if f in place], np.int64).tobytes()


@dataclass
class Model:
    """Weights of the kept features, of the text's length, and the constant: a fixed number of figures."""

    kept: np.ndarray
    weights: np.ndarray
    length: float
    constant: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, docs: list[str]) -> np.ndarray:
        cache = worker_cache(self.name, _kept_features(self.kept))
        return np.asarray([self._score(t, cache) for t in docs])

    def _score(self, text: str, cache: ChunkCache) -> float:
        chunks = set(text.split())
        at = np.frombuffer(cache.lookup(chunks), np.int64)
        z = self.constant + self.length * np.log1p(len(chunks))
        if len(at):
            found, count = np.unique(at, return_counts=True)
            z += float(np.log1p(count) @ self.weights[found])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _feature_stats(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each kind that have it."""
    def run(batches):
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                n[int(label == 1)][np.unique(np.frombuffer(_all.lookup(set(text.split())), np.int64))] += 1
        at = np.flatnonzero(n.sum(0) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], names=["feature", "toxic", "clean"])

    return labelled.select("text", "label").mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _vectors(labelled: DataFrame, kept: np.ndarray, terms) -> DataFrame:
    """(doc_id, label, pair, length, at, count): each text's kept features, and those of its swapped copy."""
    name = uuid.uuid4().hex

    def run(batches):
        cache = worker_cache(name, _kept_features(kept))

        def vector(text):
            chunks = set(text.split())
            found, count = np.unique(np.frombuffer(cache.lookup(chunks), np.int64), return_counts=True)
            return float(np.log1p(len(chunks))), found, np.log1p(count)

        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                rows.append((int(label == 1), False, *vector(text)))
                other = swapped(text, terms)
                if other is not None:
                    rows.append((int(label == 1), True, *vector(other)))
            kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["label", "pair", "length", "at", "count"])

    return labelled.mapInArrow(run, "label long, pair boolean, length double, at array<bigint>, count array<double>")


def _solve(rows, n_features: int, fairness: float, l2: float, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """Adam on the mean log loss, the squared weights, and the squared change of the logit between a text and its
    swapped copy (the row after it)."""
    kept_rows = list(rows)
    sizes = np.asarray([len(r["at"]) for r in kept_rows])
    at = np.concatenate([np.asarray(r["at"], np.int64) for r in kept_rows]) if sizes.sum() else np.zeros(0, np.int64)
    value = np.concatenate([np.asarray(r["count"]) for r in kept_rows]) if sizes.sum() else np.zeros(0)
    row = np.repeat(np.arange(len(kept_rows)), sizes)
    length = np.asarray([r["length"] for r in kept_rows])
    label = np.asarray([r["label"] for r in kept_rows], float)
    copy = np.flatnonzero([r["pair"] for r in kept_rows])
    own = np.ones(len(kept_rows), bool)
    own[copy] = False
    n = max(1, own.sum())
    center, spread = length.mean(), length.std() + 1e-9
    scaled = (length - center) / spread
    w = np.zeros(n_features + 2)
    w[-1] = np.log((label[own].sum() + 1) / (n - label[own].sum() + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[at], len(kept_rows)) + w[-2] * scaled + w[-1]
        g = np.where(own, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label, 0) / n
        change = 2 * fairness * (z[copy] - z[copy - 1]) / max(1, len(copy))
        np.add.at(g, copy, change)
        np.add.at(g, copy - 1, -change)
        grad = np.concatenate([np.bincount(at, value * g[row], n_features) + l2 * w[:-2], [(g * scaled).sum(), g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-2], w[-2] / spread, w[-1] - w[-2] * center / spread


def fit(
    labelled: DataFrame, n_features: int = FEATURES, fairness: float = 1.0, l2: float = 1e-4, terms=IDENTITY_TERMS
) -> Model:
    """The model for (text, label) rows, of which there should be a bounded number: their kept features are solved on
    the driver. Without rows of both kinds every text scores the share of toxic rows (half, without rows)."""
    stats = _feature_stats(labelled)
    totals = labelled.agg(F.sum("label"), F.count("label")).first()
    toxic, n = int(totals[0] or 0), int(totals[1])
    if not 0 < toxic < n:
        share = toxic / n if n else 0.5
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    expected_a, expected_b = (a + b) * (toxic / n), (a + b) * (1 - toxic / n)
    gain = a * F.log(a / expected_a) + b * F.log(b / expected_b)
    best = stats.withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(n_features).collect()
    kept = np.sort(np.asarray([r["feature"] for r in best], np.int64))
    weights, length, constant = _solve(_vectors(labelled, kept, terms).collect(), len(kept), fairness, l2)
    return Model(kept, weights, float(length), float(constant))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = LABELLED_ROWS, folds: int = 5) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents outside fold 0, dealt over a few tasks."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna().filter(fold(F.col("doc_id"), folds) != 0)
    known = bounded(known.groupBy("doc_id").agg(F.max("label").alias("label")), max_rows)
    return texts(docs).join(F.broadcast(known), "doc_id").select("text", "label").repartition(8)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per row. Null text is empty text, which scores by the constant alone."""
    def run(batches):
        for batch in batches:
            s = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))],
                                             names=["doc_id", "score", "predicted"])

    source = texts(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
