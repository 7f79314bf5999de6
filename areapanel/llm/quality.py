"""Quality by importance resampling.

Two bag-of-n-gram models are counted: one of the target (documents labelled good), one of all raw text. A document's
log weight is the sum of the log ratios of its hashed words and word pairs. Gumbel top-k then draws documents without
replacement with chances that follow the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import TOKEN, ChunkCache, bucket, hash_share, kth_largest, materialize, texts, with_labels

BUCKETS = 10_000
# Labels that are used, to count the target model and to place the cut.
LABELLED_ROWS = 20_000
SMOOTHING = 0.5
GOOD_WEIGHT = 5.0

_tokens = ChunkCache(
    lambda chunk: np.asarray([bucket(t, BUCKETS) for t in TOKEN.findall(chunk.lower())], np.int64).tobytes())


def features(text: str) -> np.ndarray:
    """Hashed words and word pairs, in text order; a run of signs is a word. A word and itself is the same pair for all words."""
    words = np.frombuffer(_tokens.lookup(text.split()), np.int64)
    before, after = words[:-1], words[1:]
    return np.concatenate([words, np.where(before == after, 0, (before * 31_337 + after * 7_919 + 1) % BUCKETS)])


def _ngram_counts(labelled: DataFrame) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over those with label 1, summed per task first."""
    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = np.bincount(features(text), minlength=BUCKETS)
                raw += found
                if label == 1:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return labelled.select("text", "label").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS) -> np.ndarray:
    """Log ratio of target to raw for each of ``BUCKETS`` buckets: a model of fixed size.

    The raw model counts every document; the target model those of a bounded number of labelled ones with quality 1.
    """
    counts = _ngram_counts(with_labels(texts(docs, id_col, text_col), labels, "quality", labelled_rows, "left")).collect()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for row in counts:  # at most BUCKETS rows
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, log_weight, text_hash). An empty or null text has weight 0 in logarithm."""
    def run(batches):
        for batch in batches:
            n, w = [], []
            for text in batch.column("text").to_pylist():
                f = features(text)
                n.append(len(f))
                w.append(float(model[f].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(w, pa.float64()), batch.column("text_hash")],
                                             names=["doc_id", "n_features", "log_weight", "text_hash"])

    source = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_features long, log_weight double, text_hash long")


def cut_of(weights: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> float:
    """The log weight that parts labelled good from bad best, where a share of the good lost weighs ``GOOD_WEIGHT`` times as
    much as that share of the bad kept.

    Without labels of both kinds it is minus infinity: nothing is known against any document.
    """
    known = with_labels(weights, labels, "quality", labelled_rows, "inner").select("log_weight", "label").toPandas()  # bounded
    good, bad = known.loc[known["label"] == 1, "log_weight"].to_numpy(), known.loc[known["label"] == 0, "log_weight"].to_numpy()
    if not len(good) or not len(bad):
        return float("-inf")
    at = np.unique(np.concatenate([good, bad]))
    good_below, bad_below = np.searchsorted(np.sort(good), at) / len(good), np.searchsorted(np.sort(bad), at) / len(bad)
    best = int(np.argmax(bad_below - GOOD_WEIGHT * good_below))
    below = at[best - 1] if best else at[best] - 1.0
    return float((at[best] + below) / 2)


def gumbel_top_k(weights: DataFrame, k: int, seed: int = 7, temperature: float = 0.25) -> DataFrame:
    """``weights`` with ``gumbel_key`` and ``selected``: the ``k`` rows with the largest log weight plus Gumbel noise.

    The noise depends on seed and id, so a lost task draws the same again. Rows that tie at the k-th key are all taken.
    """
    share = F.greatest(hash_share(F.col("doc_id"), seed), F.lit(1e-15))
    key = F.round((F.col("log_weight") - F.log(-F.log(share)) * temperature) * 1_000_000).cast("long")
    keyed = materialize(weights.withColumn("gumbel_key", F.coalesce(key, F.lit(0))))
    least = kth_largest(keyed, "gumbel_key", k)
    chosen = F.lit(k > 0) if least is None else F.col("gumbel_key") >= least
    return keyed.withColumn("selected", chosen)


def resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    labelled_rows: int = LABELLED_ROWS, seed: int = 7, temperature: float = 0.25,
) -> DataFrame:
    """(doc_id, n_features, log_weight, gumbel_key, selected), one row per row of ``docs``.

    ``k`` defaults to the number of documents whose weight is past the cut between labelled good and bad, so that
    as many are drawn as look like the target. Null text is empty text. Equal rows get equal results; with a ``k`` of
    at least the number of rows all are selected. Labels may be missing: then all stay.
    """
    return _resampled(docs, labels, k, id_col, text_col, labelled_rows, seed, temperature).drop("text_hash")


def _resampled(
    docs: DataFrame, labels: DataFrame, k: int | None, id_col: str, text_col: str, labelled_rows: int = LABELLED_ROWS, seed: int = 7, temperature: float = 0.25
) -> DataFrame:
    """``resample`` with a hash of each row's text, which tells rows apart that share an id."""
    weights = materialize(log_weights(docs, fit(docs, labels, id_col, text_col, labelled_rows), id_col, text_col))
    if k is None:
        k = weights.filter(F.col("log_weight") >= cut_of(weights, labels, labelled_rows)).count()
    return gumbel_top_k(weights, k, seed, temperature)


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, without the rows that were not drawn.

    Of rows that share an id those with a text that was drawn stay; rows that repeat id and text stay or go together.
    """
    chosen = _resampled(docs, labels, None, id_col, text_col, **how)
    drawn = materialize(chosen.filter("not selected").select(F.col("doc_id").alias("_out_id"), F.col("text_hash").alias("_out_hash")).distinct())
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("_out_id")) & (own == F.col("_out_hash")), "left_anti")
