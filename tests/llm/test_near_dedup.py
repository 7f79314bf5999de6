"""Order MinHash classes against brute-force alignment of all pairs."""

import random

import numpy as np
import pytest

from areapanel.llm import near_dedup as nd

WORDS = [f"w{i}" for i in range(400)]


def edited(words, n, rnd):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return words


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    texts = []
    for g in range(12):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 300))]
        texts.append(base)
        texts += [edited(base, rnd.randint(1, 9), rnd) for _ in range(3)]
    hot = [rnd.choice(WORDS) for _ in range(120)]  # a large group, many of whose members are alike to the first only
    texts += [hot] + [edited(hot, rnd.randint(1, 5), rnd) for _ in range(90)]
    texts += [[rnd.choice(WORDS) for _ in range(rnd.randint(1, 200))] for _ in range(40)]
    texts.append(texts[0][60:] + texts[0][:60])  # the same shingles in another order
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000, rows[0][1].upper() + " !"), (1001, ""), (1002, None), (1003, "w1 w2"), (1004, "W1, w2"), (1005, " . "), (1006, "w5 " * 6000),
             (1007, "w5 " * 5990)]
    return rows


def brute_classes(rows, threshold=0.8):
    words = {i: nd.WORDS.findall((t or "").lower()) for i, t in rows}
    shingles = {i: nd.labelled_shingles(w) for i, w in words.items()}
    parent = {i: i for i in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(words)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if words[a] == words[b] or nd.aligned_similarity(shingles[a], shingles[b], threshold) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(60):
        a = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))]
        b = edited(a, 2, rnd) if rnd.random() < 0.7 else [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))]
        x, y = nd.labelled_shingles(a), nd.labelled_shingles(b)
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        m = t[-1, -1]
        want = m / (len(x) + len(y) - m)
        got = nd.aligned_similarity(x, y)
        assert got == (pytest.approx(want) if want >= 0.8 else got) and (got >= 0.8) == (want >= 0.8)


def test_classes_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, 7, "c") for i, t in corpus], "doc_id long, text string, kept int, bucket string").repartition(5)
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()}
    want = brute_classes(corpus)
    assert got == want
    left = nd.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_hot_group_loses_no_link_to_copies_that_are_not_its_head(spark):
    base = [f"b{i}" for i in range(150)]
    near = [[*base[:-1], f"n{i}"] for i in range(30)]  # 1 of 146 shingles differs
    far = []  # 16 more differ: 130 are in the one copy it was made of, which is 0.8, and 129 in any other
    for i, x in enumerate(near):
        y = list(x)
        for at in (0, 20 + i, 60 + i, 100 + i):
            y[at] = f"f{i}at{at}"
        far.append(y)
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *near, *far])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_classes(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in nd.near_classes(docs).collect()} == want


def test_prefixes_of_alike_texts_meet():
    rnd = random.Random(3)
    rarity = np.asarray([rnd.randrange(4) for _ in range(64)], np.uint8)
    for _ in range(200):
        a = [rnd.choice(WORDS) for _ in range(rnd.randint(5, 80))]
        x, y = nd.labelled_shingles(a), nd.labelled_shingles(edited(a, 1, rnd)[rnd.randint(0, 5):])
        if nd.aligned_similarity(x, y) >= 0.8:
            assert set(nd.prefix(x, rarity, 0.8)) & set(nd.prefix(y, rarity, 0.8))


def test_order_matters_to_the_sketch(corpus):
    a = nd.labelled_shingles([f"x{i}" for i in range(200)])
    b = np.concatenate([a[100:], a[:100]])
    assert len(set(nd.bands(a)) & set(nd.bands(b))) < len(nd.bands(a))
    assert nd.aligned_similarity(a, b) < 0.8


def test_repeated_ids_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, "q r s t u v")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id, r.class_id, r.kept) for r in nd.near_classes(docs).collect()) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert nd.drop_near_copies(docs).count() == 4
    assert nd.near_classes(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_brute_force(spark, sf):
    from areapanel.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op9_near_dedup"](spark, sf).collect()} == brute_classes(docs)
