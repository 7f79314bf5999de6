"""Repeated byte strings by suffix order.

Suffixes are put in order by the difference-cover method: the suffixes at two of every three places are named by their
sorted triples, the names are put in order by the same method, the other suffixes follow from them, and both are
merged. A string of ``length`` bytes that starts in several places makes these places neighbours in that order, so
comparing neighbours' first ``length`` bytes finds all of them.

Sorting every suffix of a corpus together would move each byte many times. What decides which suffixes have to meet is
found first: each string of ``length`` bytes has one anchor in it, the place whose ``GRAM`` bytes have the smallest hash.
Equal strings have their anchor at the same place, so only strings with equal anchors can be equal. Strings in a row with
the same anchor make up a segment; Spark deals segments by anchor, and each task orders the suffixes of its segments.
Segments that are equal as a whole meet as one. The segments of an anchor that has many different ones are cut into blocks
of strings, which meet by the bytes that all strings of the block have; only what is shared that far by many different
blocks is dealt over several tasks, whose distinct strings are then compared by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import materialize, texts

LENGTH = 400
GRAM = 64
# An anchor with more different segments is dealt over several tasks.
SEGMENTS_TOGETHER = 1_000
# Strings in a row that a segment is cut into then.
BLOCK_STRINGS = 32
# Bytes whose suffixes one task orders at once: names of up to 2^21 places fit three to a number.
CHUNK_BYTES = 1_200_000
# Bytes of a text that are looked at together.
BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(BLOCK + 1024, base)]))


_UP, _DOWN = _powers(_ODD), _powers(np.uint64(pow(int(_ODD), -1, 1 << 64)))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:len(data)])])
    h = (sums[size:] - sums[:-size]) * _DOWN[:len(data) - size + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(anchor's hash, first start, last start) of the strings of ``length`` bytes, in order."""
    every = np.frombuffer(data, np.uint8)
    mask = np.uint64((1 << 20) - 1)
    for lo in range(0, max(0, len(every) - length + 1), BLOCK):
        part = every[lo:lo + BLOCK + length - 1]
        hashes = _gram_hashes(part, gram)
        # The place is part of the number, so that the first of equal hashes is the smallest.
        at = (_sliding_min((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        yield from zip(hashes[at[first]].view(np.int64).tolist(), (first + lo).tolist(), (last + lo).tolist())


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``s`` (numbers from 0) in the order of their suffixes, at least as far as ``depth`` numbers tell."""
    return np.argsort(_ranks(s.astype(np.int64) + 1, depth), kind="stable")


def _ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``s`` (numbers from 1); suffixes alike for ``depth`` numbers may have the same rank."""
    n, top = len(s), int(s.max(initial=0)) + 1
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # a place past the end ends the first half of the names
    sample = np.concatenate([one, two])
    triples = (padded[sample] * top + padded[sample + 1]) * top + padded[sample + 2]
    names, name = np.unique(triples, return_inverse=True)
    if len(names) < len(sample) and depth > 3:
        name = _ranks(name + 1, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name + 1
    # The other suffixes: a number and the rank of what follows.
    size = int(rank.max()) + 1
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(padded[rest] * size + rank[rest + 1], kind="stable")]
    # Merge: with places of the first kind one number decides, with those of the second two.
    one, two = one[one < n], two[two < n]
    one, two = one[np.argsort(rank[one], kind="stable")], two[np.argsort(rank[two], kind="stable")]
    key = lambda at: padded[at] * size + rank[at + 1]
    pair = lambda at: (padded[at] * top + padded[at + 1]) * size + rank[at + 2]
    before = np.searchsorted(key(one), key(rest)) + np.searchsorted(pair(two), pair(rest))
    both = np.concatenate([one, two])
    both = both[np.argsort(rank[both], kind="stable")]
    out = np.empty(n, np.int64)
    out[rest] = before + np.arange(len(rest))
    out[both] = np.arange(len(both)) + np.searchsorted(before, np.arange(len(both)), side="right")
    return out


def repeated_starts(pieces: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its first ``starts`` places start a string of ``length`` that another such place has too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum([0, *map(len, pieces)])
    wanted = np.zeros(len(data), bool)
    for b, n in zip(begin, starts):
        wanted[b:b + n] = True
    order = suffix_order(data, length)
    order = order[wanted[order]]
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(max(0, len(order) - 1), bool)
    for lo in range(0, len(same), 16_384):
        a, b = order[lo:lo + 16_384], order[lo + 1:lo + 16_385]
        same[lo:lo + len(b)] = (windows[a[:len(b)]] == windows[b]).all(1)
    found = np.zeros(len(data), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[b:b + n] for b, n in zip(begin, starts)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


# A row of the input: hashes of its id and of its text. Rows that agree in both share all that is found.
ROW = ["id_hash", "text_hash"]


def _all_segments(source: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, ROW, n_bytes, sha256, segments): one row for each text."""
    item = pa.struct([("anchor", pa.int64()), ("same", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches):
        for batch in batches:
            size, sha, parts = [], [], []
            for text in batch.column("text").to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                size.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                parts.append([{"anchor": a, "lo": lo, "hi": hi, "same": _digest(data[lo:hi + length])}
                              for a, lo, hi in segments(data, length, gram)])
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(size, pa.int64()), pa.array(sha), pa.array(parts, pa.list_(item))],
                                             names=[*names, "n_bytes", "sha256", "segments"])

    names, kind = ["doc_id", *ROW], source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, id_hash long, text_hash long, n_bytes long, sha256 string, segments array<struct<anchor: bigint, same: bigint, lo: bigint, hi: bigint>>")


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _anchor_place(data: bytes, start: int, length: int, gram: int) -> int:
    """Where the anchor of the string that begins at ``start`` is."""
    part = np.frombuffer(data[start:start + length], np.uint8)
    hashes = _gram_hashes(part, gram)
    return start + int(((hashes & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashes), dtype=np.uint64)).argmin())


def _pieces(rows: list[dict], numbers: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in numbers), pa.array([r["piece"] for r in rows], pa.binary())],
                                      names=[*numbers, "piece"])


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """(ROW, lo, hi, one, two): runs of repeated starts, and for anchors dealt over several tasks (``salts`` > 1) the
    digests of their distinct strings; those that repeat nothing in their task have a row, others none."""
    def flush(rows):
        out = []
        flags = repeated_starts([r["piece"] for r in rows], [r["hi"] - r["lo"] + 1 for r in rows], length)
        seen: set[bytes] = set()
        for r, f in zip(rows, flags):
            if r["n"] == 1:
                out += [(r["id_hash"], r["text_hash"], r["lo"] + a, r["lo"] + b, None, None) for a, b in _runs(f)]
            if r["salts"] > 1:
                for i in range(len(f)):
                    digest = hashlib.blake2b(r["piece"][i:i + length], digest_size=16).digest()
                    if digest not in seen:
                        seen.add(digest)
                        known = bool(f[i]) or r["n"] > 1
                        row = (None, None) if known else (r["id_hash"], r["text_hash"])
                        out.append((*row, r["lo"] + i, r["lo"] + i, int.from_bytes(digest[:8], "little", signed=True),
                                    int.from_bytes(digest[8:], "little", signed=True)))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(6)], names=[*ROW, "lo", "hi", "one", "two"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["anchor"], r["salt"])
                if size > CHUNK_BYTES and key != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["piece"])
                last = key
        if held:
            yield flush(held)

    dealt = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, "id_hash long, text_hash long, lo long, hi long, one long, two long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, ROW, n_bytes, sha256) of every text, and (ROW, text, spans) of those with a string of ``length`` bytes that
    starts elsewhere too; ``spans`` are (lo, hi) of such starts."""
    source = texts(docs, id_col, text_col)
    source = source.select("doc_id", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash"), "text")
    every = materialize(_all_segments(source, length, gram))
    parts = every.select(*ROW, F.explode("segments").alias("s")).select(*ROW, "s.*")
    alike = materialize(parts.groupBy("anchor", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "lo", "hi")).alias("at")))
    several = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    salts = F.ceil(F.col("kinds") / SEGMENTS_TOGETHER)
    compare = alike.join(several, "anchor").select("anchor", F.pmod("same", salts).alias("salt"), salts.alias("salts"), "n", "at.*")
    asked = materialize(compare.groupBy(*ROW).agg(F.collect_list(F.struct("anchor", "salt", "salts", "n", "lo", "hi")).alias("asked")))
    # Whole segments that repeat, as spans of starts per text.
    whole = parts.join(alike.filter("n > 1").select("anchor", "same"), ["anchor", "same"]).select(*ROW, "lo", "hi")
    whole = materialize(whole.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("whole")))
    held = materialize(source.join(whole.join(asked, ROW, "full_outer"), ROW).select(*ROW, "text", "whole", "asked"))

    numbers = [*ROW, "anchor", "salt", "salts", "n", "lo", "hi"]
    schema = ", ".join(f"{c} long" for c in numbers) + ", piece binary"

    def cut(batches):
        for batch in batches:
            out = []
            for one, two, text, wanted in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text", "asked"))):
                data = text.encode("utf-8", "surrogatepass")
                out += [w | {"id_hash": one, "text_hash": two, "piece": data[w["lo"]:w["hi"] + length]} for w in wanted or () if w["salts"] == 1]
            yield _pieces(out, numbers)

    def cut_blocks(batches):
        for batch in batches:
            out = []
            for one, two, text, wanted in zip(*(batch.column(c).to_pylist() for c in (*ROW, "text", "asked"))):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted or ():
                    if w["salts"] > 1:
                        # Blocks are counted from the anchor, so that equal strings are in equal blocks.
                        place = _anchor_place(data, w["lo"], length, gram)
                        lo = w["lo"]
                        while lo <= w["hi"]:
                            number = (place - lo) // BLOCK_STRINGS
                            last = place - number * BLOCK_STRINGS
                            hi = min(w["hi"], last)
                            core = data[last:last - BLOCK_STRINGS + 1 + length]
                            out.append({"id_hash": one, "text_hash": two, "n": w["n"], "lo": lo, "hi": hi, "piece": data[lo:hi + length],
                                        "anchor": _digest(b"%d %d " % (w["anchor"], number) + core), "salt": 0, "salts": 1})
                            lo = hi + 1
            yield _pieces(out, numbers)

    asked_texts = held.select(*ROW, "text", "asked").filter("asked IS NOT NULL")
    many = asked_texts.filter(F.exists("asked", lambda w: w["salts"] > 1))
    blocks = materialize(many.mapInArrow(cut_blocks, schema).withColumn("same", F.xxhash64("piece")))
    kinds = materialize(blocks.groupBy("anchor", "same").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(*ROW, "lo", "hi")).alias("at"), F.min("piece").alias("piece")))
    crowds = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    crowds = crowds.select("anchor", F.ceil(F.col("kinds") / SEGMENTS_TOGETHER).alias("salts"))
    rest = kinds.join(crowds, "anchor").select("at.id_hash", "at.text_hash", "anchor", F.pmod("same", "salts").alias("salt"), "salts",
                                               F.greatest("n", "copies").alias("n"), "at.lo", "at.hi", "piece")
    alike_blocks = blocks.join(kinds.filter("copies > 1").select("anchor", "same"), ["anchor", "same"]).select(*ROW, "lo", "hi")
    pieces = asked_texts.mapInArrow(cut, schema).unionByName(rest)
    found = materialize(_compared(pieces, length))
    digests = found.filter("one IS NOT NULL")
    shared = digests.groupBy("one", "two").agg(F.count(F.lit(1)).alias("tasks")).filter("tasks > 1")
    across = digests.filter("id_hash IS NOT NULL").join(shared, ["one", "two"], "left_semi").select(*ROW, "lo", "hi")
    runs = found.filter("one IS NULL").select(*ROW, "lo", "hi").unionByName(across).unionByName(alike_blocks)
    runs = runs.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    empty = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    spans = held.select(*ROW, "text", "whole").join(runs, ROW, "left").select(
        *ROW, "text", F.concat(F.coalesce("whole", empty), F.coalesce("runs", empty)).alias("spans")).filter(F.size("spans") > 0)
    return every.select("doc_id", *ROW, "n_bytes", "sha256"), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed), one row for each row of ``docs``.

    Removes every byte of a string of ``length`` bytes that also starts anywhere else, in the same text or another;
    ``removed`` lists the maximal removed runs as (from, to) with ``to`` past the end. Null text is empty; shorter texts
    lose nothing; rows that repeat lose all, if they are long enough. Other columns are ignored.
    """
    every, spans = repeated_spans(docs, length, gram, id_col, text_col)
    run_type = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def cut(batches):
        for batch in batches:
            shas, removed = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                gone = []
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in starts):
                    if gone and lo <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], hi)
                    else:
                        gone.append([lo, hi])
                sha, at = hashlib.sha256(), 0
                for lo, hi in gone:
                    sha.update(data[at:lo])
                    at = hi
                sha.update(data[at:])
                shas.append(sha.hexdigest())
                removed.append([{"from": lo, "to": hi} for lo, hi in gone])
            yield pa.RecordBatch.from_arrays([*map(batch.column, ROW), pa.array(shas), pa.array(removed, pa.list_(run_type))], names=[*ROW, "kept_sha256", "removed"])

    cuts = spans.mapInArrow(cut, "id_hash long, text_hash long, kept_sha256 string, removed array<struct<from: bigint, to: bigint>>")
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")
    gone = F.coalesce("removed", none)
    n_removed = F.aggregate(gone, F.lit(0).cast("long"), lambda total, r: total + r["to"] - r["from"])
    return every.join(cuts.dropDuplicates(ROW), ROW, "left").select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size(gone).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), gone.alias("removed"))
