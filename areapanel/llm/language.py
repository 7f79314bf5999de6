"""Which languages a text is written in.

Every word has a likelihood under each language's model of hashed letter triples. Expectation maximisation finds the
shares of the languages that make the text likeliest; languages are dropped one by one while that costs less
likelihood than a penalty for each language.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import ChunkCache, bounded, bucket, fold, texts, worker_generations

BUCKETS = 1 << 16
CACHED_CHUNKS = 250_000
LABELLED_ROWS = 20_000
SMOOTHING = 0.1
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def _letter_words(chunk: str) -> list[str]:
    """Words of letters; signs such as raised figures, which the pattern lets through, are none."""
    return [w for w in LETTERS.findall(chunk) if w.isalpha() or any(map(str.isalpha, w))]


def _grams(chunk: str) -> list[int]:
    out = []
    for word in _letter_words(chunk.lower()):
        out += _word_grams(word)
    return out


@lru_cache(1 << 17)  # there are few triples
def _triple(triple: str) -> int:
    return bucket(triple, BUCKETS)


def _word_grams(word: str) -> list[int]:
    edged = f"^{word}$"
    return [_triple(edged[i:i + 3]) for i in range(len(edged) - 2)]


_all = ChunkCache(lambda chunk: np.asarray(_grams(chunk), np.int64).tobytes())


@dataclass
class Model:
    """Log likelihood of each hashed triple under each language: a table of fixed size per language."""

    languages: list[str]
    table: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.by_bucket = np.ascontiguousarray(self.table.T)

    def _words(self, chunk: str) -> bytes:
        """One row of log likelihoods for each word of the chunk."""
        low = chunk.lower()
        if low.isalpha() and LETTERS.fullmatch(low):
            return self.by_bucket[_word_grams(low)].sum(0).tobytes()
        return b"".join(self.by_bucket[_grams(word)].sum(0).tobytes() for word in _letter_words(chunk))

    def likelihoods(self, text: str) -> np.ndarray:
        """(words, languages)"""
        words = worker_generations(self.name, self._words, CACHED_CHUNKS)
        found = b"".join(map(words.__getitem__, text.split()))
        return np.frombuffer(found, np.float32).reshape(-1, len(self.languages)).astype(float)


def shares(like: np.ndarray, start: np.ndarray | None = None, steps: int = 50, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """The mixture's shares by expectation maximisation, from even ones or from ``start``, and the log likelihood."""
    top = like.max(1, keepdims=True)
    p = np.exp(np.maximum(like - top, -60))
    pi = np.full(like.shape[1], 1 / like.shape[1]) if start is None else start
    for _ in range(steps):
        new = pi * ((1 / (p @ pi)) @ p) / len(p)
        moved = np.abs(new - pi).max()
        pi = new
        if moved < close:
            break
    return pi, float(np.log(p @ pi).sum() + top.sum())


def mixture(like: np.ndarray, penalty: float = 3.0) -> dict[int, float]:
    """Languages that stay, with their shares: the least likely go while that costs at most ``penalty`` times the
    logarithm of the number of words plus one."""
    stay = np.arange(like.shape[1])
    pi, value = shares(like)
    cost = penalty * np.log(len(like) + 1)
    while len(stay) > 1:
        rest = np.delete(np.arange(len(stay)), pi.argmin())
        # Near the shares that were found with one language more; a little of each, so that none is out for good.
        near = (pi[rest] + 1e-3) / (pi[rest] + 1e-3).sum()
        next_pi, next_value = shares(like[:, stay[rest]], near) if len(rest) > 1 else (np.ones(1), float(like[:, stay[rest[0]]].sum()))
        if value - next_value > cost:
            break
        stay, pi, value = stay[rest], next_pi, next_value
    return dict(zip(stay.tolist(), pi.tolist()))


def training_rows(docs: DataFrame, max_rows: int = LABELLED_ROWS, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(text, lang) of at most ``max_rows`` documents with a language, outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    chosen = bounded(known.select(F.col("doc_id").alias("_id")).distinct(), max_rows, id_col="_id")
    return known.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "lang")


def fit(rows: DataFrame) -> Model | None:
    """The model for (text, lang) rows; None without any."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = np.bincount(np.frombuffer(_all.lookup(text.split()), np.int64), minlength=BUCKETS)
                counts[lang] = counts[lang] + found if lang in counts else found
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most BUCKETS rows a language
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    table[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), found["bucket"].to_numpy()] += found["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages), one row per row.

    ``languages`` maps each language that stays to its share; ``lang_pred`` has the largest and ``score`` is that share,
    drawn towards even shares by half a word for each language known, so that a few words never give 1. A text that is
    null or has no letter is ``und`` with score 0 and no language, as is every text without a model.
    """
    def run(batches):
        for batch in batches:
            pred, score, sets = [], [], []
            for text in batch.column("text").to_pylist():
                like = model.likelihoods(text) if model else np.zeros((0, 1))
                if not len(like):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append([])
                    continue
                found = mixture(like, penalty)
                best = max(found, key=lambda i: (found[i], -i))
                n, all_known = len(like), len(model.languages)
                pred.append(model.languages[best])
                score.append((n * found[best] + 0.5) / (n + 0.5 * all_known))
                sets.append([(model.languages[i], float(s)) for i, s in found.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages"])

    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages map<string,double>")
