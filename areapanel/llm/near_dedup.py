"""Near-duplicate documents by order MinHash.

A document's five-word shingles are labelled by occurrence. For each of many hash functions the few smallest labelled
shingles are taken and put back into text order: their hash is one entry of the sketch, so that a sketch tells texts
apart that have the same shingles in another order. Documents that share a band of entries are candidates, and a banded
alignment of their shingles decides: aligned shingles over all shingles of both, at least ``THRESHOLD``.

Only small buckets make all their pairs. In a larger one everyone meets the bucket's most central member. Where that leaves
several classes in it, all its members, linked or not, go through an exact join: shingles are put in one order for all,
rare ones first, and texts that reach the threshold must share one so early that enough of both is left. Pairs of different
classes that do are aligned, so that no pair of a large bucket is lost.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import materialize, texts

SHINGLE = 5
THRESHOLD = 0.8
# Smallest labelled shingles of one sketch entry; entries of a band; bands.
ORDERED, ROWS, BANDS = 2, 3, 28
# A bucket of at most so many documents makes all its pairs.
SMALL_BUCKET = 8
# Bins of shingle counts: they only tell which shingles are rare, so that collisions cost time and lose nothing.
COUNT_BINS = 1 << 18
WORDS = re.compile(r"\w+")
_MIX = np.random.default_rng(20_240_501).integers(1, 1 << 63, (2, ROWS * BANDS), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    places = [seen.setdefault(w, len(seen)) for w in words]
    own = [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in seen]
    return np.asarray(own, np.uint64)[places]


def labelled_shingles(words: list[str]) -> np.ndarray:
    """Hash of each five-word shingle and of how often it came before, in text order; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x = _mixed(x * np.uint64(31) + h[i:i + n])
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    count = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = count.astype(np.uint64)
    return np.where(label == 0, x, _mixed(x + label * np.uint64(0xD1B54A32D192ED03)))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band of the sketch."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    best = []
    for lo in range(0, n, 4096):  # long texts in blocks: the smallest of the blocks' smallest
        block = shingles[lo:lo + 4096]
        v = (block[None, :] ^ _MIX[0][:, None]) * _MIX[1][:, None]
        v ^= v >> np.uint64(32)
        for _ in range(min(ORDERED, len(block))):
            at = v.argmin(1)
            least = v[np.arange(len(v)), at]
            best.append((least, at + lo))
            v[np.arange(len(v)), at] = np.uint64(0xFFFFFFFFFFFFFFFF)
    values, places = np.stack([b[0] for b in best], 1), np.stack([b[1] for b in best], 1)
    pick = np.argsort(values, 1, kind="stable")[:, :ORDERED]
    chosen = np.sort(np.take_along_axis(places, pick, 1), 1)  # back into text order
    entry = np.zeros(len(chosen), np.uint64)
    for c in range(chosen.shape[1]):
        entry = _mixed(entry * np.uint64(31) + shingles[chosen[:, c]])
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = _mixed(out * np.uint64(31) + entry[r::ROWS])
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned labelled shingles over all of both, or 0 where they can't reach ``threshold``.

    Labelled shingles don't repeat, so that the longest common subsequence is the longest increasing run of their
    places. An alignment that reaches the threshold leaves at most ``slack`` shingles out: only places in that band count.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    least = threshold * (n + m) / (1 + threshold)
    slack = int(n + m - 2 * least + 1e-9)
    if min(n, m) < least - 1e-9:
        return 0.0
    order = np.argsort(b)
    at = order[np.minimum(np.searchsorted(b[order], a), m - 1)]
    both = (b[at] == a) & (np.abs(at - np.arange(n)) <= slack)
    if both.sum() < least - 1e-9:
        return 0.0
    tails: list[int] = []
    for place in at[both].tolist():
        i = bisect_left(tails, place)
        tails[i:i + 1] = [place]
    return len(tails) / (n + m - len(tails))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words_md5, bands): what equal word sequences share, and the bands of the sketch."""
    def run(batches):
        for batch in batches:
            keys, all_bands = [], []
            for text in batch.column("text").to_pylist():
                words = WORDS.findall(text.lower())
                keys.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
                all_bands.append(bands(labelled_shingles(words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array(all_bands, pa.list_(pa.int64()))],
                                             names=["doc_id", "words_md5", "bands"])

    source = texts(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, words_md5 string, bands array<bigint>")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_sizes(rows: DataFrame) -> DataFrame:
    """(bucket, id) rows of buckets of two and more, with ``n`` and how ``central`` the id is: its buckets' sizes summed."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = materialize(rows.join(sizes, "bucket"))
    return materialize(held.join(held.groupBy("id").agg(F.sum("n").alias("central")), "id"))


def _candidates(held: DataFrame, small: int) -> DataFrame:
    """Pairs to verify: all of buckets up to ``small``, and each with the most central member of a larger one."""
    listed = held.filter(F.col("n") <= small).groupBy("bucket").agg(F.collect_set("id").alias("ids"))  # at most ``small``
    pairs = listed.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).filter("a < b")
    large = held.filter(F.col("n") > small)
    heads = large.groupBy("bucket").agg(F.max(F.struct("central", "id"))["id"].alias("head"))
    return _distinct_pairs(pairs.unionByName(large.join(heads, "bucket").select(F.col("id").alias("a"), F.col("head").alias("b"))))


def _verified(pairs: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for every pair; ``candidates`` are (id, text)."""
    def run(batches):
        last = (None, None)
        for batch in batches:
            out = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if last[0] != y:
                    last = (y, labelled_shingles(WORDS.findall(y.lower())))
                out.append(aligned_similarity(labelled_shingles(WORDS.findall(x.lower())), last[1], threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.join(candidates.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(candidates.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that links lead to, for every id of a link. ``links`` (a, b) both ways round are one link.

    Each round every id takes the smallest class of itself and its neighbours, then the class of that class; the table
    is written each round, until nothing changes.
    """
    edges = links.select(F.col("a").alias("id"), F.col("b").alias("other"))
    edges = materialize(edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    label = materialize(edges.groupBy("id").agg(F.least("id", F.min("other")).alias("class")))
    while True:
        near = edges.join(label.select(F.col("id").alias("other"), F.col("class").alias("next")), "other").groupBy("id").agg(
            F.min("next").alias("next"))
        moved = label.join(near, "id").select("id", F.col("class").alias("old"), F.least("class", "next").alias("class"))
        jump = label.select(F.col("id").alias("class"), F.col("class").alias("far"))
        new = materialize(moved.join(jump, "class", "left").select("id", "old", F.least("class", F.coalesce("far", "class")).alias("class")))
        changed = new.filter("class <> old").limit(1).count()
        label = new.select("id", "class")
        if not changed:
            return label


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (id, class) after more links, which join classes: earlier links are not gone through again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti")
    label = materialize(label.unionByName(ends.select("id", F.col("id").alias("class"))))
    between = links.join(label.select(F.col("id").alias("a"), F.col("class").alias("x")), "a").join(
        label.select(F.col("id").alias("b"), F.col("class").alias("y")), "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(between.distinct()).select(F.col("id").alias("class"), F.col("class").alias("new"))
    return materialize(label.join(joined, "class", "left").select("id", F.coalesce("new", "class").alias("class")))


def _rarity(candidates: DataFrame) -> np.ndarray:
    """Of each bin of shingles how often they occur in ``candidates``, as a level."""
    def run(batches):
        total = np.zeros(COUNT_BINS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = labelled_shingles(WORDS.findall(text.lower()))
                total += np.bincount((found % np.uint64(COUNT_BINS)).astype(np.int64), minlength=COUNT_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    counts = candidates.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNT_BINS)
    total[counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
    return np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)


def prefix(shingles: np.ndarray, rarity: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles: two texts of at least ``threshold`` share one. The order is the same in all texts."""
    order = np.lexsort((shingles, rarity[(shingles % np.uint64(len(rarity))).astype(np.int64)]))
    return shingles[order[:int(len(shingles) * (1 - threshold) + 1e-9) + 1]]


def _joined(candidates: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes that may reach ``threshold``, none of those that do missing; ``candidates`` are (id,
    class, text).

    What precedes the first shared shingle is in one text only, so that the shorter rest bounds what both share.
    """
    rarity = _rarity(candidates)

    def run(batches):
        for batch in batches:
            at, rare, places, sizes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = labelled_shingles(WORDS.findall(text.lower()))
                own = prefix(found, rarity, threshold)
                at.append(np.full(len(own), i))
                rare.append(own)
                places.append(np.arange(len(own)))
                sizes.append(np.full(len(own), len(found)))
            if not at:
                continue
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("class").take(at), pa.array(np.concatenate(rare).view(np.int64)),
                 pa.array(np.concatenate(sizes) - np.concatenate(places)), pa.array(np.concatenate(sizes))],
                names=["id", "class", "shingle", "rest", "size"])

    kind = candidates.schema["id"].dataType.simpleString()
    rows = materialize(candidates.select("id", "class", "text").mapInArrow(run, f"id {kind}, class {kind}, shingle long, rest long, size long"))
    # Of shingles that several classes have, the class that has them most often; pairs have one side outside it.
    several = rows.groupBy("shingle").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last").select("shingle")
    held = materialize(rows.join(several, "shingle", "left_semi"))
    most = held.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "class"))["class"].alias("most"))
    left = held.join(most, "shingle").filter("class <> most").select(
        "shingle", "most", F.col("id").alias("a"), F.col("class").alias("class_a"), F.col("rest").alias("rest_a"), F.col("size").alias("size_a"))
    other = held.select("shingle", F.col("id").alias("b"), F.col("class").alias("class_b"), F.col("rest").alias("rest_b"), F.col("size").alias("size_b"))
    reach = F.least("rest_a", "rest_b") >= (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    once = (F.col("class_b") == F.col("most")) | (F.col("a") < F.col("b"))
    return _distinct_pairs(left.join(other, "shingle").filter((F.col("class_a") != F.col("class_b")) & once & reach).select("a", "b"))


def _labels(rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(id, class) of ids that have a link of at least ``threshold``, among ids that share a bucket; ``rows`` are (id, bucket)."""
    held = _with_sizes(rows)
    seen = materialize(_verified(_candidates(held, SMALL_BUCKET), found, threshold))
    label = components(seen.filter(F.col("similarity") >= threshold).select("a", "b"))
    large = held.filter(F.col("n") > SMALL_BUCKET).join(label, "id", "left").withColumn("class", F.coalesce("class", "id"))
    large = materialize(large.select("bucket", "id", "class"))
    # Large buckets of several classes: their members, those in the head's class too, are joined exactly.
    several = large.groupBy("bucket").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last").select("bucket")
    still = materialize(found.join(large.join(several, "bucket", "left_semi").select("id", "class").distinct(), "id"))
    if not still.limit(1).count():
        return label
    pairs = _joined(still, threshold).join(seen.select("a", "b"), ["a", "b"], "left_anti")
    links = _verified(materialize(pairs), found, threshold).filter(F.col("similarity") >= threshold).select("a", "b")
    return _merged(label, materialize(links))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, kept), one row for each row of ``docs`` with an id.

    ``class_id`` is the smallest id of the documents that links of at least ``threshold`` lead to; its document is
    ``kept``. Documents with the same words in the same order are one text; so are all that have no word, null texts too.
    Rows that repeat an id are judged by that id: if their texts differ, the id is in the classes of both. A null id can't
    be in a class and is left out (``drop_near_copies`` keeps such rows). Other columns are ignored.
    """
    sketched = materialize(sketches(docs, id_col, text_col))
    keys = sketched.groupBy("words_md5").agg(F.min("doc_id").alias("id"))  # equal words go by their smallest id
    member = materialize(sketched.join(keys, "words_md5").select("doc_id", "id", F.when(F.col("doc_id") == F.col("id"), F.col("bands")).alias("bands")))
    rows = member.filter("bands IS NOT NULL").select("id", F.explode("bands").alias("bucket")).distinct()
    shared = materialize(rows.join(rows.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket", "left_semi"))
    # The texts that candidates have, once: what is verified is read from there.
    found = texts(docs, id_col, text_col).join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = materialize(found.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")))
    label = _labels(shared, found, threshold)
    # An id with several texts joins what they belong to.
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last")
    label = _merged(label, member.join(several, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct())
    out = member.select("doc_id", "id").join(label, "id", "left")
    return out.select("doc_id", F.coalesce("class", "id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns: of each class the document with the smallest id; rows without an id stay."""
    gone = materialize(near_classes(docs, threshold, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_out_id")).distinct())
    return docs.join(gone, docs[id_col] == F.col("_out_id"), "left_anti")
