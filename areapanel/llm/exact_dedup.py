"""Exact deduplication with column functions only.

Rows are grouped by the md5 of their normalised text; of a group the smallest id stays. Rows of groups of several are
then compared byte for byte with the text that stays; what differs (a collision of the hash) is grouped by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.llm.common import materialize, texts


def normalized(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Null text counts as empty, and empty texts are equal. A null id counts as larger than any other; a group of null
    ids only has a null ``keep_id``. Rows that repeat an id with an equal text count in ``group_size`` and are all ``kept``
    when their id is (``drop_copies`` leaves one of them). Other columns are ignored.

    Only ids and hashes are shuffled, but for texts that have a copy: those meet the text that stays. A hot group is no
    row but one on the other side of that join, so that its rows can be split over tasks.
    """
    base = texts(docs, id_col, text_col).withColumn("text", normalized(F.col("text")))
    # One table of ids and hashes, so that texts are normalised and hashed once.
    rows = materialize(base.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256")))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rows = materialize(rows.join(groups, "digest"))

    several = rows.filter("group_size > 1")
    ids = several.select("doc_id", "digest", "keep_id").distinct()
    same_id = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))
    raw = texts(docs, id_col, text_col)
    members = raw.alias("d").join(ids.alias("i"), same_id).select(
        "i.doc_id", "i.digest", "i.keep_id", normalized(F.col("d.text")).alias("text")).filter(
        digest(F.col("text")) == F.col("digest"))
    keepers = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("keep_text"))
    differ = materialize(members.join(keepers, "digest").filter("text <> keep_text").select("doc_id", "digest", "text"))

    # Usually no row at all: texts whose hash collides with that of the text that stays.
    own = differ.groupBy("digest", "text").agg(F.min("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
    apart = differ.select("doc_id", "digest", "text").join(own, ["digest", "text"]).select(
        F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"), F.sha2("text", 256).alias("a_sha"), "own_id", "own_size").distinct()
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("n_apart"))
    joined = rows.join(lost, "digest", "left").join(
        apart, rows["doc_id"].eqNullSafe(F.col("a_id")) & (rows["digest"] == F.col("a_digest")) & (rows["text_sha256"] == F.col("a_sha")),
        "left")
    keep = F.when(F.col("a_digest").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id"))
    size = F.when(F.col("a_digest").isNotNull(), F.col("own_size")).otherwise(
        F.col("group_size") - F.coalesce("n_apart", F.lit(0)))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that have an equal text of smaller id; of rows that repeat an id
    with an equal text, one stays."""
    kept = materialize(exact_groups(docs, id_col, text_col).filter("kept").groupBy(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).agg(F.count(F.lit(1)).alias("_kept_n")))
    sha = F.sha2(normalized(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))), 256)
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("_kept_id")) & (sha == F.col("_kept_sha"))
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    once = docs.alias("d").join(kept.filter("_kept_n = 1"), same).select(*names)
    told_again = docs.alias("d").join(kept.filter("_kept_n > 1"), same).select(*names, "_kept_sha")
    return once.unionByName(told_again.dropDuplicates([id_col, "_kept_sha"]).drop("_kept_sha"))
