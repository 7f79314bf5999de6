"""What the operators share: reading documents, scratch tables, a bounded cache of text chunks, exact top-k."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import areapanel
from areapanel.operators.scale import materialize, scratch_dir

__all__ = ["ChunkCache", "worker_cache", "table", "texts", "fold", "hash_share", "kth_largest", "materialize"]

# Entries that all caches of one Python worker may hold together; then all are emptied, so that memory stays bounded
# however many operators a worker runs one after another.
CACHE_ENTRIES = 500_000


def ship(spark: SparkSession) -> None:
    """Hand this library to the Python workers, once per session, so that it need not be installed on them.

    The archive is written to the folder that the cluster shares, and Spark brings it to the executors.
    """
    context, name = spark.sparkContext, "areapanel-code.zip"
    if name in context._python_includes:
        return
    root, archive = Path(areapanel.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    place = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark).rstrip('/')}/areapanel-code-{uuid.uuid4().hex}/{name}")
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    out.write(archive.getvalue())
    out.close()
    context.addPyFile(place.toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, so that no other column can clash; null text is empty text."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: which fold a document is in. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def hash_share(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id and seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / float(1 << 52)


class ChunkCache(dict):
    """What a function makes of a white-space-separated chunk, remembered while the worker lives.

    ``lookup`` joins what the chunks of a text give. Chunks repeat, so most of the work is done once per worker.
    """

    entries = 0
    caches: list[ChunkCache] = []

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        ChunkCache.caches.append(self)

    def __missing__(self, chunk: str) -> bytes:
        if ChunkCache.entries >= CACHE_ENTRIES:
            for cache in ChunkCache.caches:
                cache.clear()
            ChunkCache.entries = 0
        value = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = value
            ChunkCache.entries += 1
        return value

    def lookup(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))


class Generations(dict):
    """What a function makes of a key, remembered in two generations: when ``entries`` keys have been added, those of the
    generation before go, unless they were asked for since. Rare keys do not push the frequent ones out."""

    def __init__(self, make: Callable[[str], object], entries: int = CACHE_ENTRIES // 4):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_shared: dict[str, ChunkCache] = {}


def worker_cache(key: str, make: Callable[[str], bytes]) -> ChunkCache:
    """The worker's cache for the model called ``key``, so that tasks that follow each other share it; two are kept."""
    if key not in _shared:
        while len(_shared) > 1:
            old = _shared.pop(next(iter(_shared)))
            old.clear()
            ChunkCache.caches[:] = [c for c in ChunkCache.caches if c is not old]
        _shared[key] = ChunkCache(make)
    return _shared[key]


_kept: dict[str, Generations] = {}


def worker_generations(key: str, make: Callable[[str], object], entries: int) -> Generations:
    """The same for a cache in two generations."""
    if key not in _kept:
        while len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[key] = Generations(make, entries)
    return _kept[key]


TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def bucket(token: str, buckets: int) -> int:
    """Hash of a token that is the same in every process."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a bigint column, exactly; None if k < 1 or there are fewer rows.

    Narrows in on it with counts per bin, so that at most ``bins`` rows reach the driver each time. ``df`` should be a
    written table: it is read once per round.
    """
    if k < 1:
        return None
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if n < k:
        return None
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // bins))
        counts = (df.filter(F.col(key).between(lo, hi)).groupBy(F.expr(f"({key} - {lo}L) div {width}L").alias("b")).count().collect())
        for row in sorted(counts, key=lambda r: -r["b"]):
            if row["count"] >= k:
                lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                break
            k -= row["count"]
    return lo


def bounded(rows: DataFrame, max_rows: int, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` of ``rows``, the same ones each time, in the order of a hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(max_rows)


def with_labels(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, how: str, seed: int = 0) -> DataFrame:
    """``documents`` (doc_id, text) with a bounded number of labels as int column ``label``.

    At most ``max_rows`` labels with a non-null id and value are taken (12 bytes each), so that they can be broadcast;
    of labels that repeat an id the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    return documents.join(F.broadcast(bounded(known, max_rows, seed)), "doc_id", how)
