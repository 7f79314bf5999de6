"""Removal of repeated byte strings, against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from areapanel.llm import suffix_dedup as sd


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_suffix_order():
    rnd = random.Random(1)
    for _ in range(200):
        a = np.asarray([rnd.randint(0, rnd.choice([1, 3, 200])) for _ in range(rnd.randint(1, 60))])
        assert sd.suffix_order(a, 10**6).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_anchor_depends_on_the_string_alone():
    rnd = random.Random(3)
    word = bytes(rnd.choice(b"abcdef ") for _ in range(40))
    found = set()
    for _ in range(20):
        data = bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(0, 90)))
        place = len(data)
        data += word + bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randint(0, 90)))
        parts = list(sd.segments(data, 40, 8))
        assert sum(hi - lo + 1 for _, lo, hi in parts) == len(data) - 39
        found |= {a for a, lo, hi in parts if lo <= place <= hi}
    assert len(found) == 1


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcde é") for _ in range(n))
    shared, edge = text(70), text(21)
    rows = [(i, text(rnd.randint(0, 120)) + (shared if i % 3 == 0 else "") + (edge if i % 4 == 0 else "") + text(rnd.randint(0, 60)))
            for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[5][1] + "x"), (102, "a" * 300), (103, "ab" * 100), (104, ""), (105, None), (106, shared), (107, shared[:20]),
             (108, "z" * 19), (3, rows[3][1]), (3, "another text of the same id"), (None, shared + "!"), (109, "qwertyuiopasdfghjklzxcvbnm" * 2)]
    return rows


@pytest.mark.parametrize("together, block", [(1_000, 32), (2, 8)])
def test_equals_brute_force(spark, odd_rows, together, block, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENTS_TOGETHER", together)
    monkeypatch.setattr(sd, "BLOCK_STRINGS", block)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in odd_rows], "doc_id long, text string, lo int, n_bytes int").repartition(4)
    for length, gram in ((20, 6), (50, 8)):
        assert rows_of(sd.remove_repeats(docs, length, gram)) == brute(odd_rows, length)


def test_long_texts_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh") for _ in range(3_000))
    rows = [(1, base), (2, base[:1_400] + "#" + base[1_400:]), (3, "x" * 700 + base[900:1_300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 60)
    assert rows_of(sd.remove_repeats(docs, 60, 16)) == want
    monkeypatch.setattr(sd, "BLOCK", 512)
    data = base.encode()
    assert sum(hi - lo + 1 for _, lo, hi in sd.segments(data, 60, 16)) == len(data) - 59


def test_no_rows(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, sf):
    from areapanel.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op6_suffix_dedup"](spark, sf)) == brute(rows, 400)
