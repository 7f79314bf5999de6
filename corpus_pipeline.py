"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``, with the rows
that stay; the last says where each piece of each document goes. A stage works on all that the one before it kept.

* Quality: rejects what importance resampling doesn't draw. As many are drawn as look like documents labelled good, so an
  empty text, which says nothing, stays. Labels come from ``labels``; without any, all stay.
* Exact copies: one document of each group of equal texts stays; null and empty texts are equal.
* Near copies: of each class of near copies the document with the smallest id stays; rows without an id stay.
* Benchmark passages: a document with a verified passage of ``benchmark`` goes.
* Packing: token ids of what is left, in sequences of at most 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from areapanel.llm import decontamination, exact_dedup, near_dedup, packing, quality
from areapanel.llm.common import materialize, table
from areapanel.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenized_pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

# Language models, alignment and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
