"""Tables in parts, each of which counts once a manifest names it.

A part is written to a folder of its own, ``data-<id>``, and committed by renaming a small file to ``manifest-<version>-<id>``.
Readers list manifests: a part that is still being written, or was left by a run that failed, is not there for them, no success
markers are needed, and nothing that may be read is rewritten. ``sweep`` deletes what was never committed.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"manifest-(\d{8})-([0-9a-f]{32})\.json")


def _place(spark: SparkSession, path: str, *below: str):
    """(file system, Hadoop path)"""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *below]))
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in the folder, with the time of their last change in milliseconds."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(place)]


def manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, id) of the committed parts, in order."""
    found = (NAME.fullmatch(name) for name, _ in _names(spark, path))
    return sorted((int(m[1]), m[2]) for m in found if m)


def folders(spark: SparkSession, path: str) -> list[str]:
    return [f"{path.rstrip('/')}/data-{part}" for _, part in manifests(spark, path)]


def write_part(df: DataFrame, path: str) -> str:
    """Write ``df`` to a folder that no reader sees yet; returns the part's id."""
    part = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/data-{part}")
    return part


def commit(spark: SparkSession, path: str, part: str, version: int) -> None:
    """Make a part visible: its manifest appears whole, by one rename."""
    fs, hidden = _place(spark, path, f".manifest-{part}")
    out = fs.create(hidden, True)
    out.write(json.dumps({"folder": f"data-{part}", "version": version}).encode())
    out.close()
    _, shown = _place(spark, path, f"manifest-{version:08d}-{part}.json")
    if not fs.rename(hidden, shown):
        raise OSError(f"could not commit {shown.toString()}")


def withdraw(spark: SparkSession, path: str, part: str, version: int) -> None:
    """Take a part's manifest away. Its files stay until ``sweep``, for those who have just begun to read them."""
    fs, shown = _place(spark, path, f"manifest-{version:08d}-{part}.json")
    fs.delete(shown, False)


def append(df: DataFrame, path: str) -> None:
    """Write and commit one more part."""
    spark, part = df.sparkSession, write_part(df, path)
    commit(spark, path, part, 1 + max((v for v, _ in manifests(spark, path)), default=0))


def first_of(spark: SparkSession, path: str, part: str) -> bool:
    """After committing as version 1: whether this part is the one that counts. Of several built at once the smallest id
    does, and the others withdraw."""
    own = manifests(spark, path)
    if own and own[0][1] != part:
        withdraw(spark, path, part, 1)
        return False
    return True


def sweep(spark: SparkSession, path: str, older_than_hours: float = 24) -> int:
    """Delete folders that no manifest names and that have not changed for so long; returns their number."""
    known = {f"data-{part}" for _, part in manifests(spark, path)}
    limit = (time.time() - older_than_hours * 3600) * 1000
    gone = [name for name, changed in _names(spark, path) if re.fullmatch("data-[0-9a-f]{32}", name) and name not in known and changed <= limit]
    for name in gone:
        fs, place = _place(spark, path, name)
        fs.delete(place, True)
    return len(gone)
