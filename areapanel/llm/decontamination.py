"""Benchmark decontamination: an inverted index of test items, queried with every passage of every document.

Items are ranked by BM25; a score is given as a share of what the item scores for itself, so that one threshold holds
for all. The search goes from bounds to scores, as block-max WAND does: items are put into blocks, and a term's
greatest weight in a block bounds what it adds there. A passage's bound is the sum of those of its two halves, each worked out
once; only the blocks whose bound reaches the threshold are scored, term by term. What is retrieved is checked: the shingles of
the item's question and of its answer have to be found near the passage.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from areapanel.llm.common import materialize, ship, texts, worker_cache

WORDS = re.compile(r"\w+")
K1, B = 1.2, 0.75
# Least share of an item's own score, and least share of its question's and its answer's shingles.
RETRIEVE, OVERLAP = 0.5, 0.8
SHINGLE = 5
# A passage has at least so many words, or as many as the longest item of the shard; the next starts half of that later.
PASSAGE = 64
# Blocks of items that a shard has at most; half passages that are bounded together.
BLOCKS, TOGETHER = 128, 64
# Bounds of the part of the index that is sent to executors at once.
SHARD_ITEMS, SHARD_BYTES = 2_000, 2 << 20


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line, or the last sentence of a single line; the question is what comes before. A text
    of one sentence is both."""
    lines = [x for x in text.split("\n") if words_of(x)]
    if len(lines) > 1:
        return words_of("\n".join(lines[:-1])), words_of(lines[-1])
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text) if words_of(x)]
    if len(parts) > 1:
        return words_of(" ".join(parts[:-1])), words_of(parts[-1])
    return words_of(text), words_of(text)


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], text: list[str]) -> float:
    """Share of ``part``'s shingles that ``text`` has; shingles are shorter where ``part`` is."""
    wanted = shingles(part)
    if not wanted:
        return 1.0
    n = min(SHINGLE, len(part))
    return len(wanted & {tuple(text[i:i + n]) for i in range(len(text) - n + 1)}) / len(wanted)


@dataclass
class Index:
    """Postings of one shard: for term t the items and weights at ``start[t]:start[t + 1]``; ``block_max[t]`` has the greatest
    weight in each block of ``block`` items, and zeros last, for words that no item has."""

    name: str
    ids: list
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    start: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block: int
    block_max: np.ndarray
    passage: int

    @classmethod
    def of(cls, rows: list, frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
        """``rows`` are (item_id, text); term frequencies and mean length are those of all items."""
        held = sorted(((len(words_of(t)), i, t) for i, t in rows if words_of(t)), key=lambda r: (r[0], str(r[1])))
        terms: dict[str, int] = {}
        post: list[list[tuple[int, float]]] = []
        for n, (length, _, text) in enumerate(held):
            words = words_of(text)
            own = {}
            for w in set(words):
                tf = words.count(w)
                idf = np.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            total = sum(own.values())
            for w, weight in own.items():
                t = terms.setdefault(w, len(terms))
                if t == len(post):
                    post.append([])
                post[t].append((n, weight / total))
        flat = [x for p in post for x in p]
        start = np.cumsum([0, *map(len, post)])
        items, weights = np.asarray([x[0] for x in flat], np.int64), np.asarray([x[1] for x in flat])
        term_of = np.repeat(np.arange(len(post)), np.diff(start))
        block = max(1, -(-len(held) // BLOCKS))
        block_max = np.zeros((len(post) + 1, len(held) // block + 1), np.float32)
        np.maximum.at(block_max, (term_of, items // block), np.nextafter(weights.astype(np.float32), np.float32(1)))
        longest = held[-1][0] if held else 0
        return cls(uuid.uuid4().hex, [h[1] for h in held], [question_and_answer(h[2]) for h in held], terms, start, items, weights, block, block_max,
                   max(PASSAGE, longest + longest % 2))

    def _chunk(self, chunk: str) -> bytes:
        return np.asarray([self.terms.get(w, len(self.terms)) for w in words_of(chunk)], np.int32).tobytes()

    def scores(self, passage_terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of the items of ``blocks`` that score ``threshold`` and more for these distinct terms."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in passage_terms]
        score = np.bincount(np.concatenate([self.items[at] for at in spans]), np.concatenate([self.weights[at] for at in spans]), len(self.ids))
        found = np.flatnonzero(score >= threshold - 1e-9)
        return [(int(i), float(score[i])) for i in found[np.isin(found // self.block, blocks)]]

    def document(self, text: str, retrieve: float) -> dict[int, tuple[float, int, float, float]]:
        """item → (best score of its passages, then first word, question's overlap and answer's overlap of the passage that is
        most like it); all passages that are retrieved are looked at."""
        terms = np.frombuffer(worker_cache(self.name, self._chunk).lookup(text.split()), np.int32)
        unknown, half = len(self.terms), self.passage // 2
        at = np.flatnonzero(terms < unknown)
        if not len(at):
            return {}
        # Distinct terms of each half passage.
        keys = np.unique(at // half * unknown + terms[at])
        part, term = keys // unknown, keys % unknown
        retrieved: dict[int, list[tuple[float, int]]] = {}
        for lo in range(0, int(part[-1]) + 1, TOGETHER):
            a, b = np.searchsorted(part, [lo, lo + TOGETHER + 1])
            if a == b:
                continue
            first = np.flatnonzero(np.concatenate([[True], part[a + 1:b] != part[a:b - 1]]))
            bound = np.zeros((TOGETHER + 2, self.block_max.shape[1]), np.float32)
            bound[part[a:b][first] - lo] = np.add.reduceat(self.block_max[term[a:b]], first)
            reach = bound[:TOGETHER] + bound[1:TOGETHER + 1] >= retrieve - 1e-4
            for i in np.flatnonzero(reach.any(1)):
                c, d = np.searchsorted(part, [lo + i, lo + i + 2])
                for item, score in self.scores(np.unique(term[c:d]), np.flatnonzero(reach[i]), retrieve):
                    retrieved.setdefault(item, []).append((-score, int(lo + i) * half))
        if not retrieved:
            return {}
        words = [w for chunk in text.split() for w in words_of(chunk)]
        out = {}
        for item, passages in retrieved.items():
            question, answer = self.parts[item]
            likest = -1.0
            for _, at in sorted(passages):
                near = words[max(0, at - self.passage):at + 2 * self.passage]
                both = overlap(question, near), overlap(answer, near)
                if min(both) > likest:
                    likest, found = min(both), (at, *both)
                if likest == 1.0:
                    break
            out[item] = (-min(passages)[0], *found)
        return out


def index_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """The inverted index, in shards of bounded size. Items without a word are left out; items that repeat are found each."""
    ship(items.sparkSession)
    rows = materialize(items.select(F.col(id_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text")))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}\p{M}_]+"), lambda w: w != "")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-(size or 0) // SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    mean = dealt.agg(F.avg(F.size(words))).first()[0] or 1.0
    out = []
    counted = materialize(dealt.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    for shard in range(shards):
        held = [(r["item_id"], r["text"]) for r in dealt.filter(F.col("shard") == shard).select("item_id", "text").collect()]
        own = sorted({w for _, t in held for w in words_of(t)})
        asked = rows.sparkSession.createDataFrame([(w,) for w in own], "w string")
        frequency = {r["w"]: r["n"] for r in asked.join(counted, "w").collect()}
        out.append(Index.of(held, {w: frequency.get(w, 1) for w in own}, n, mean))
    return out


def matches(
    docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, least: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, first_word, question_overlap, answer_overlap, verified) of all that is retrieved.

    ``verified`` asks for ``least`` of the shingles of both question and answer. Null texts and texts without words match
    nothing; rows that repeat match each.
    """
    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, score double, first_word long, question_overlap double, answer_overlap double"

    def searched(index: Index) -> DataFrame:
        def run(batches):
            for batch in batches:
                at, rows = [], []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    for item, found in sorted(index.document(text, retrieve).items()):
                        at.append(n)
                        rows.append((index.ids[item], *found))
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate([None, pa.float64(), pa.int64(), pa.float64(), pa.float64()]) if k]
                ids, place = pa.array([r[0] for r in rows], to_arrow_type(item_type)), pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(place), ids, *columns],
                                                 names=["doc_id", "item_id", "score", "first_word", "question_overlap", "answer_overlap"])

        return source.mapInArrow(run, schema)

    parts = [searched(index) for index in index_shards(items)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("verified", (F.col("question_overlap") >= least) & (F.col("answer_overlap") >= least))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, contaminated, item_ids, retrieved, best_score), one row for each row of ``docs``.

    ``item_ids`` are the verified items in order; ``retrieved`` counts all that were retrieved. Rows that repeat an id are
    judged together.
    """
    found = materialize(matches(docs, items, id_col=id_col, text_col=text_col, **how))
    by = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("item_id")))).alias("item_ids"),
        F.count_distinct("item_id").alias("retrieved"), F.max("score").alias("best_score"))
    ids = texts(docs, id_col, text_col).select("doc_id")
    empty = F.array().cast(found.select(F.array("item_id").alias("x")).schema["x"].dataType)
    return ids.join(by, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", (F.coalesce(F.size("item_ids"), F.lit(0)) > 0).alias("contaminated"), F.coalesce("item_ids", empty).alias("item_ids"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, without those that hold a verified item. Rows that repeat an id are judged together, as
    ``contaminated`` does: if one holds an item, all go."""
    found = matches(docs, items, id_col=id_col, text_col=text_col, **how).filter("verified")
    out = materialize(found.select(F.col("doc_id").alias("_out_id")).distinct())
    return docs.join(out, docs[id_col].eqNullSafe(F.col("_out_id")), "left_anti")
