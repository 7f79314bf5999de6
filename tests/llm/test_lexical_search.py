"""Ranked search against scores worked out term by term."""

import math
import random
import re
from collections import Counter

import pytest

from areapanel.llm import lexical_search as ls

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for i, q in queries.items():
        scored = []
        for d, c in counts:
            m = 25 + (75 * c.total() * n_docs) // total if total else 0
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in q.items() if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def made(rows, seed=0):
    draw = random.Random(seed)
    words = [f"w{n}" for n in range(60)] + ["Été", "straße", "ΑΒΓ", "x9"]
    texts = [" ".join(draw.choices(words, weights=[1 / (n + 1) for n in range(len(words))], k=draw.choice([1, 5, 5, 40]))) for _ in range(rows)]
    return texts + [None, "", "?! ...", "W0 w0,W0;w0", "w1 " * 30_000, texts[0], texts[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n * 3 % 1009, t) for n, t in enumerate(made(300))] + [(None, "w50 w51"), (7, "w3 w4"), (7, "w3 w4")]
    return rows, spark.createDataFrame([(*r, "m", 1, "t") for r in rows], "doc_id long, text string, m string, part int, terms string").repartition(4)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(n, t) for n, t in enumerate(made(25, 1))] + [(None, "w1"), (3, "w59 w59 w2"), (99, "nothing that occurs"), (98, "W50 É")]
    return rows, spark.createDataFrame([(*r, 5) for r in rows], "item_id int, text string, q int")


def found(docs, items, k=10, vocabulary_terms=ls.VOCABULARY, sizes=(ls.BLOCK, ls.PART, ls.SHARD, ls.WAVE)):
    block, part, shard, wave = sizes
    terms = ls.item_terms(items)
    index = ls.build_index(docs, terms, block=block, part=part, vocabulary_terms=vocabulary_terms)
    return ls.search(index, terms, k, shard, wave)


@pytest.mark.parametrize("k,limit,sizes", [(10, 10**6, (4096, 16384, 512, 8)), (10, 0, (8, 20, 7, 3)), (3, 10**6, (5, 50, 1000, 2))])
def test_search_equals_brute_force(docs, items, k, limit, sizes):
    got = found(docs[1], items[1], k, limit, sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["item_id"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(items[0], docs[0], k)


def test_index_of_all_terms_and_item_ids_of_text(spark, docs):
    asked = spark.createDataFrame([("a", "w1 w2"), ("b", "w3")], "item_id string, text string")
    index = ls.build_index(docs[1])
    got = ls.search(index, ls.item_terms(asked))
    assert sorted(map(tuple, got.collect())) == brute([("a", "w1 w2"), ("b", "w3")], docs[0])


def test_no_rows(spark, docs, items):
    none, no_items = docs[1].limit(0), items[1].limit(0)
    assert found(none, items[1]).count() == 0 and found(docs[1], no_items).count() == 0 and found(none, no_items).count() == 0
    wordless = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    assert found(wordless, items[1]).count() == 0


def test_one_stratum_and_one_word_hold_everything(spark):
    rows = [(n, "same words here") for n in range(500)] + [(900, "same same words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "same"), (2, "here words")], "item_id long, text string")
    got = found(docs, items, sizes=(32, 64, 1, 4))
    assert sorted(map(tuple, got.collect())) == brute([(1, "same"), (2, "here words")], rows)


def test_low_bounds_are_not_visited():
    import pyarrow as pa

    rows = pa.table({"part": pa.array([0] * 40, pa.int32()), "m": [25 + n for n in range(40)], "chunk": [0] * 40, "doc_id": list(range(40)),
                     "terms": ["a"] * 40, "tfs": pa.array([[1]] * 40, pa.list_(pa.int32()))})
    part = ls.Part(ls._strata(rows), {"a"})
    best, ids, visited = part.first(["a"], [1000], 1, 3)
    assert ids.tolist() == [0, 1, 2] and visited == 3


def test_query_equals_sql(spark, sf):
    from areapanel.llm.queries import QUERIES, SQL
    from oracle import compare, connect

    assert compare(QUERIES["op11_lexical_search"](spark, sf), connect(sf), SQL["op11_lexical_search"]) is None
