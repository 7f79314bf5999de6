"""Ranked lexical search over an index of documents grouped by equal length normaliser.

Documents with the same normaliser m form a stratum. Within it a term's postings lie in runs of equal frequency, highest first,
so that an impact is worked out once per frequency, and the first run bounds what the term can add. The sum of
these bounds over an item's terms bounds every score of the stratum: strata are visited from the highest bound down, until
the bound is below the item's k-th score. Scores are whole numbers.

Large strata are cut into blocks, and blocks are dealt over parts. A part meets the items in shards, each pair in a task of its
own; a first wave over some of the parts gives every item a score that the strata of the other parts have to reach.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapanel.llm.common import materialize, ship
from areapanel.operators.scale import lookup_join

BLOCK = 4096  # documents of a stratum that lie together, about
PART = 16384  # documents that a task searches, about
SHARD = 512  # items that meet a part in one task, about
WAVE = 8  # the first wave takes one of so many parts
VOCABULARY = 200_000  # terms that are sent to the tasks; with more, postings of all terms are kept

# The score: fixed values. m is SPREAD of 100 parts length over the mean length; UNIT, TF and NORM scale impacts to whole numbers.
SPREAD, UNIT, TF, NORM = 75, 1_000_000_000, 1000, 8

# Bytes of terms as they are, but A-Z in lower case; all others become blanks.
SEPARATED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def term_counts(text: bytes) -> Counter:
    """Terms of a whole text: runs of letters and digits and of everything beyond ASCII."""
    return Counter(text.translate(SEPARATED).split())


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (UNIT * tf) // (TF * tf + NORM * m)


@dataclass(frozen=True)
class Index:
    """strata (part, m, docs, terms, term_runs, run_tf, run_end, postings), df (term, df), and the corpus' figures."""

    strata: DataFrame
    df: DataFrame
    documents: int
    terms: int
    parts: int


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, q): how often each item has a term. Rows with a null id are left out; rows of one id are one item."""
    ship(items.sparkSession)
    source = items.select(F.col(f"`{id_col}`").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    source = source.filter(F.col("item_id").isNotNull())
    kind = source.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, terms, counts = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                found = term_counts(text)
                at += [n] * len(found)
                terms += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["item_id", "term", "q"])

    found = source.mapInArrow(run, f"item_id {kind}, term binary, q long")
    return found.groupBy("item_id", F.col("term").cast("string").alias("term")).agg(F.sum("q").alias("q"))


def _forward(docs: DataFrame, vocabulary: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of terms, and those of the vocabulary with their frequencies."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text)
                sizes.append(counts.total())
                held = sorted(counts if vocabulary is None else counts.keys() & vocabulary)
                terms.append(b" ".join(held) if held else None)
                tfs.append([counts[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    return source.mapInArrow(run, "doc_id long, n long, terms binary, tfs array<int>").withColumn("terms", F.col("terms").cast("string"))


def build_index(
    docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part: int = PART,
    vocabulary_terms: int = VOCABULARY,
) -> Index:
    """Index every row of ``docs``; ``only`` (term) names the terms that will be asked for.

    Postings are kept for the terms of ``only`` if they are at most ``vocabulary_terms``, which are then sent to the tasks, and
    otherwise for all terms; figures of the corpus cover all terms in both cases. Null text has no term. Rows without an
    id count in the corpus' figures but are never found. Rows that repeat an id are documents of their own.
    """
    vocabulary = None
    if only is not None:
        asked = materialize(only.select("term").distinct())
        if asked.count() <= vocabulary_terms:
            vocabulary = frozenset(r["term"].encode() for r in asked.collect())
    rows = materialize(_forward(docs, vocabulary, id_col, text_col))
    documents, terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.filter("terms IS NOT NULL")
    df = materialize(held.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))

    norm = F.lit(100 - SPREAD) + F.expr(f"({SPREAD}L * n * {documents}L) div {max(1, terms)}L")
    found = held.filter("doc_id IS NOT NULL").withColumn("m", norm)
    sizes = found.groupBy("m").agg(F.count(F.lit(1)).alias("_size"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_size") / block))
    dealt = lookup_join(found, sizes, ["m"], "inner").withColumn("chunk", chunk)
    parts = max(1, -(-documents // part))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("m", "chunk"), F.lit(parts)).cast("int"))
    strata = dealt.select("part", "m", "chunk", "doc_id", "terms", "tfs").groupBy("part").applyInArrow(
        _strata, "part int, m long, docs array<bigint>, terms string, term_runs array<int>, run_tf array<int>, run_end array<int>, postings array<int>")
    return Index(materialize(strata), df, documents, terms, parts)


def _strata(rows: pa.Table) -> pa.Table:
    """One row per block of a stratum: its documents, its terms, where each term's runs end, and the runs."""
    rows = rows.sort_by([("m", "ascending"), ("chunk", "ascending"), ("doc_id", "ascending")])
    m, chunk, ids = (rows.column(c).to_numpy() for c in ("m", "chunk", "doc_id"))
    codes: dict[str, int] = {}
    words = [t.split(" ") for t in rows.column("terms").to_pylist()]
    code = np.array([codes.setdefault(w, len(codes)) for own in words for w in own], np.int64)
    names = np.array(list(codes), object)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    code, names = rank[code], np.sort(names)
    doc = np.repeat(np.arange(len(ids)), [len(own) for own in words])
    tf = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (chunk[1:] != chunk[:-1])])
    stratum = np.searchsorted(first, doc, "right") - 1
    order = np.lexsort((doc, -tf, code, stratum))
    code, doc, tf, stratum = code[order], doc[order], tf[order], stratum[order]
    out = {c: [] for c in ("part", "m", "docs", "terms", "term_runs", "run_tf", "run_end", "postings")}
    ends = np.searchsorted(stratum, np.arange(len(first) + 1))
    for s, (lo, hi) in enumerate(zip(first, np.r_[first[1:], len(ids)])):
        c, d, f = (x[ends[s]:ends[s + 1]] for x in (code, doc, tf))
        new_term = np.r_[True, c[1:] != c[:-1]]
        new_run = new_term | np.r_[True, f[1:] != f[:-1]]
        runs, run_term = np.flatnonzero(new_run), new_term[new_run]
        out["part"].append(rows.column("part")[0].as_py())
        out["m"].append(int(m[lo]))
        out["docs"].append(ids[lo:hi])
        out["terms"].append(" ".join(names[c[new_term]]))
        out["term_runs"].append(np.r_[np.flatnonzero(run_term)[1:], len(runs)].astype(np.int32))
        out["run_tf"].append(f[runs].astype(np.int32))
        out["run_end"].append(np.r_[runs[1:], len(c)].astype(np.int32))
        out["postings"].append((d - lo).astype(np.int32))
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), *[pa.list_(pa.int32())] * 4)
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


class Part:
    """Blocks of strata in a task. ``bounds`` of an item's terms, and ``scores`` of one block."""

    def __init__(self, strata: pa.Table, asked: set[str]):
        self.m = strata.column("m").to_numpy()
        self.docs, self.postings, self.impact = ([None] * len(self.m) for _ in range(3))
        at: dict[str, list[tuple[int, int, int, int]]] = {t: [] for t in asked}  # block, highest impact, first and end of postings
        columns = [strata.column(c) for c in ("terms", "term_runs", "run_tf", "run_end", "docs", "postings")]
        for s in range(len(self.m)):
            terms, term_runs, run_tf, run_end, docs, postings = (c[s] for c in columns)
            term_runs, run_tf, run_end = (x.values.to_numpy() for x in (term_runs, run_tf, run_end))
            run_impact = impacts(run_tf, int(self.m[s]))  # once per frequency of a term
            self.docs[s], self.postings[s] = docs.values.to_numpy(), postings.values.to_numpy()
            self.impact[s] = np.repeat(run_impact, np.diff(run_end, prepend=0))
            first_run = np.r_[0, term_runs[:-1]]
            begin, end, top = np.r_[0, run_end][first_run], run_end[term_runs - 1], run_impact[first_run]
            for n, t in enumerate(terms.as_py().split(" ")):
                if t in at:
                    at[t].append((s, int(top[n]), int(begin[n]), int(end[n])))
        self.at = {t: np.array(x, np.int64).reshape(-1, 4) for t, x in at.items()}

    def first(self, terms: list[str], weights: list[int], floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k highest scores of at least ``floor`` with their documents, and how many blocks were visited."""
        found = [(w, self.at[t]) for t, w in zip(terms, weights) if len(self.at[t])]
        bounds = np.zeros(len(self.m), np.int64)
        places = np.full((len(found), len(self.m)), -1, np.int64)
        for n, (w, where) in enumerate(found):
            bounds[where[:, 0]] += w * where[:, 1]
            places[n, where[:, 0]] = np.arange(len(where))
        best, ids, visited = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for s in np.argsort(-bounds, kind="stable"):
            if bounds[s] < floor or not bounds[s]:
                break
            visited += 1
            scores = np.zeros(len(self.docs[s]), np.int64)
            for n in np.flatnonzero(places[:, s] >= 0):
                w, where = found[n]
                _, _, lo, hi = where[places[n, s]]
                scores[self.postings[s][lo:hi]] += w * self.impact[s][lo:hi]  # a document is once among a term's postings
            hits = np.flatnonzero(scores >= floor)
            if len(hits):
                best, ids = np.concatenate([best, scores[hits]]), np.concatenate([ids, self.docs[s][hits]])
                keep = np.lexsort((ids, -best))[:k]
                best, ids = best[keep], ids[keep]
                if len(best) == k:
                    floor = max(floor, int(best[-1]))
        return best, ids, visited


def search(index: Index, terms: DataFrame, k: int = 10, shard: int = SHARD, wave: int = WAVE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest scores above 0 of each item of ``terms`` (see ``item_terms``).

    Equal scores go by smaller doc_id. Items without a term that a document has get no row.
    """
    spark, kind = terms.sparkSession, terms.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, doc_id long, score long"
    if not index.documents:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = terms.join(index.df, "term").withColumn("w", F.col("q") * weight).filter("w > 0")
    items = materialize(weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("own")))
    shards = max(1, -(-items.count() // shard))
    items = items.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), F.col("own.term").alias("terms"), F.col("own.w").alias("weights"))
    ship(spark)

    def tile(key, strata, asked):
        own = [x for x in asked.column("terms").to_pylist()]
        here = Part(strata, {t for x in own for t in x})
        at, ids, scores = [], [], []
        for n, (x, weights, floor) in enumerate(zip(own, asked.column("weights").to_pylist(), asked.column("floor").to_pylist())):
            best, docs, _ = here.first(x, weights, max(1, floor or 0), k)
            at += [n] * len(best)
            ids.append(docs)
            scores.append(best)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, scores)]
        return pa.table([asked.column("item_id").take(pa.array(at, pa.int64())), pa.array(flat[0]), pa.array(flat[1])], names=["item_id", "doc_id", "score"])

    def visit(floors: DataFrame | None, here: Column) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        left = index.strata.filter(here).withColumn("shard", each)
        own = items.withColumn("floor", F.lit(0).cast("long")) if floors is None else items.join(floors, "item_id", "left")
        right = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1)))).filter(here)
        right = right.select(F.col("part").alias("met"), F.col("shard").alias("met_shard"), "item_id", "terms", "weights", "floor")
        return left.groupBy("part", "shard").cogroup(right.groupBy("met", "met_shard")).applyInArrow(tile, schema)

    def merged(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    first = F.col("part") % wave == 0
    near = materialize(merged(visit(None, first)))
    floors = near.filter(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))
    far = visit(floors, ~first)
    return merged(near.drop("rank").unionByName(far)).select("item_id", "rank", "doc_id", "score")
