"""Exact groups against a dictionary of normalised texts, with a hash that collides as well."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from areapanel.llm import exact_dedup as ed

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\n b"), (4, "A b"), (7, None), (6, ""), (8, " "), (10, "a b"), (11, "long " * 20_000), (12, "long\n" * 20_000),
        (3, "a b"), (13, "a b "), (None, "a b"), (None, "only here"), (14, "\x0b\x0cq"), (15, " q")]


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, True) for i, t in ROWS], "doc_id long, text string, digest string, keep_id int, kept boolean").repartition(3)


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same")])
def test_groups_equal_brute_force(docs, digest):
    got = ed.exact_groups(docs, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_dropping_keeps_one_row_of_each_text_and_all_columns(docs):
    left = ed.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [3, 4, 6, 8, 10, 11, 13, 14, None]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_groups(empty).count() == 0 and ed.drop_copies(empty).count() == 0


def test_plan_has_no_python(docs):
    plan = ed.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_query_equals_sql(spark, sf):
    from areapanel.llm.queries import QUERIES, SQL
    from oracle import compare, connect

    assert compare(QUERIES["op1_exact_dedup"](spark, sf), connect(sf), SQL["op1_exact_dedup"]) is None
