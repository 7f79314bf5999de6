"""Packing documents into sequences by the sum-of-squares rule.

A piece goes where the squared numbers of open sequences per residual gap add up to least afterwards. Pieces are dealt
over tasks of bounded size; what stays open at their end is packed again, as whole blocks, until it is few.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import ChunkCache, materialize, texts
from areapanel.llm.token_counts import ODD_SPACE, shown_bytes

MAX_TOKENS = 4096
# Pieces that one task packs.
SHARD_PIECES = 20_000


class Encoder:
    """Ids of texts by a word-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The file's rule lowers case, drops white space and splits into words, digits and runs of signs, which the library's
    byte-pair model then encodes each by itself. So chunks between white space are remembered, and so are their pieces.
    Characters beyond Latin, special tokens and files with other rules go to the library whole.
    """

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        words = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known = steps == ["NFC", "Replace", "Lowercase"] and [w["type"] for w in words] == ["Split", "ByteLevel"] and words[0]["invert"]
        if self.known:
            self.split = regex.compile(words[0]["pattern"]["Regex"]).findall
        self.shown = shown_bytes()
        self.chunks, self.pieces = ChunkCache(self._chunk), ChunkCache(self._piece)

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else "".join(map(self.shown.__getitem__, piece.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not chunk.isascii() and (max(chunk) >= "\u0250" or "\u0130" in chunk):
            return self.whole(chunk)
        low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".,!" and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return self.pieces.lookup(self.split(low))

    def ids(self, text: str) -> bytes:
        if not self.known or any(c in text for c in ODD_SPACE):
            return self.whole(text)
        return self.chunks.lookup(text.split())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and ``ids`` on request: the ids of each document and ``end_id``, cut
    into pieces of ``max_tokens`` where it has more. An empty or null text is ``end_id`` alone."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                data = own.ids(text) + end
                for p, lo in enumerate(range(0, len(data), 4 * max_tokens)):
                    part = data[lo:lo + 4 * max_tokens]
                    at.append(n)
                    piece.append(p)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i8"))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's level, by the sum-of-squares rule.

    With N(g) bins of gap g, putting a length s into a gap g changes the sum of squares by 2 (N(g-s) - N(g) + 1), into
    a gap that it fills by 1 - 2 N(g), into a new bin by 2 N(capacity-s) + 1. The smallest change wins; of equal ones
    the tightest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, level = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        change = np.where(count[s:] > 0, 2 * (count[:capacity + 1 - s] - count[s:] + 1), 1 << 60)
        change[0] = 1 - 2 * count[s] if count[s] else 1 << 60
        gap = int(change.argmin())
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        if change[gap] <= new:
            gap += s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(level)
            level.append(0)
        bins[i], offsets[i] = b, level[b]
        level[b] += s
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, np.asarray(level, np.int64)


def _pack_round(blocks: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(block, length) to (block, bin, offset, level): each shard packs its blocks by itself, longest first."""
    def pack(rows):
        rows = rows.sort_values(["length", "block"], ascending=[False, True])
        bins, offsets, level = sum_of_squares(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"block": rows["block"].to_numpy(), "bin": bins * shards + int(rows["shard"].iloc[0]), "offset": offsets,
                             "level": level[bins]})

    dealt = blocks.select("block", "length", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(pack, "block long, bin long, offset long, level long")


def pack(
    pieces: DataFrame, max_tokens: int = MAX_TOKENS, shard_pieces: int = SHARD_PIECES, rounds: int = 3
) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``max_tokens``) and where each goes: ``sequence_id`` and ``offset``.

    Sequences are filled without gaps from offset 0. A shard packs about ``shard_pieces`` pieces; sequences that it
    leaves open are packed again as blocks of their level, with those of other shards. Equal pieces are packed each.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset").withColumn("block", F.monotonically_increasing_id()))
    n = pieces.count()
    placed, blocks = pieces.select("block", F.col("block").alias("bin"), F.lit(0).cast("long").alias("offset")), pieces.select("block", "length")
    for number in range(1, rounds + 1):
        shards = -(-max(1, n) // shard_pieces)
        packed = materialize(_pack_round(blocks, shards, max_tokens))
        # Blocks of the last round become bins of this one; full sequences of earlier rounds have no row here.
        step = packed.select(F.col("block").alias("bin"), F.col("bin").alias("new_bin"), F.col("offset").alias("base"))
        shift = F.lit(1 << 50)  # keeps the ids of rounds apart
        placed = materialize(placed.join(step, "bin", "left").select(
            "block", F.coalesce(F.col("new_bin") + shift * number, F.col("bin")).alias("bin"),
            (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")))
        blocks = packed.filter(F.col("level") < max_tokens).groupBy((F.col("bin") + shift * number).alias("block")).agg(
            F.first("level").alias("length"))
        if shards == 1:
            break
        before, n = n, blocks.count()
        if not n or n > 0.95 * before:
            break
    return pieces.join(placed.withColumnRenamed("bin", "sequence_id"), "block").drop("block")
