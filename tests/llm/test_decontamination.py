"""The index search against scoring all passages with all items, and planted items."""

import random

import numpy as np
import pytest

from areapanel.llm import decontamination as dc

VOCABULARY = ["the", "of", "and", "to", "in"] * 30 + [f"v{i}" for i in range(300)]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(4)
    return [(i, "\n".join(sentence(rnd, rnd.randint(6, 14)) for _ in range(rnd.randint(1, 4)))) for i in range(60)] + [
        (60, ""), (61, None), (62, "One sentence alone with several words in it"), (63, "Two parts? Yes, v1 v2 v3 v4 v5 v6.")]


@pytest.fixture(scope="module")
def rows(items):
    rnd = random.Random(8)
    out = [(i, sentence(rnd, rnd.randint(0, 200))) for i in range(60)]
    out += [(100 + n, sentence(rnd, rnd.randint(0, 150)) + " " + t + " " + sentence(rnd, rnd.randint(0, 90))) for n, (_, t) in enumerate(items) if t]
    out += [(300, items[0][1].upper().replace("\n", "   ")), (301, None), (302, ""), (303, "v1"), (304, "word " * 30_000 + items[3][1]), (None, items[4][1]),
            (100, "again"), (305, items[5][1].split("\n")[0])]
    return out


def full_scores(index, text):
    terms = [index.terms.get(w, -1) for w in dc.words_of(text)]
    best = {}
    step = index.passage // 2
    for lo in range(0, max(1, len(terms)), step):
        score = np.zeros(len(index.ids))
        for t in {t for t in terms[lo:lo + index.passage] if t >= 0}:
            at = slice(index.start[t], index.start[t + 1])
            score[index.items[at]] += index.weights[at]
        for i in np.flatnonzero(score >= dc.RETRIEVE):
            best[int(i)] = max(best.get(int(i), 0), score[i])
    return best


def test_search_finds_all_that_full_scoring_finds(spark, items, rows):
    index, = dc.index_shards(spark.createDataFrame(items, "item_id long, text string"))
    found = 0
    for _, text in rows:
        want = full_scores(index, text or "")
        got = {i: s[0] for i, s in index.document(text or "", dc.RETRIEVE).items()}
        assert got == pytest.approx(want)
        found += len(want)
    assert found > 60
    assert all(abs(sum(index.weights[index.items == i]) - 1) < 1e-9 for i in range(len(index.ids)))


def test_item_after_a_shuffled_rival_is_verified():
    rnd = random.Random(6)
    question, answer = [f"q{i}" for i in range(20)], [f"a{i}" for i in range(10)]
    item = " ".join(question) + "\n" + " ".join(answer)
    index = dc.Index.of([(1, item)], {w: 1 for w in question + answer}, 1, 30.0)
    shuffled = question + answer
    rnd.shuffle(shuffled)
    text = " ".join(shuffled) + " other" * 1000 + " " + item
    score, first, *overlaps = index.document(text, dc.RETRIEVE)[0]
    assert score == pytest.approx(1) and first > 900 and overlaps == [1.0, 1.0]


def test_planted_items_are_found_and_others_are_left(spark, items, rows, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, score string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    texts = {i: t for i, t in items if t}
    for shard in (20_000, 20):
        monkeypatch.setattr(dc, "SHARD_ITEMS", shard)
        got = dc.contaminated(docs, table).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for n, (item, t) in enumerate(items):
            if t:
                assert item in by[100 + n].item_ids, (item, by[100 + n])
        assert list(by[300].item_ids) == [0] and 3 in by[304].item_ids and by[None].item_ids == [4]
        assert not any(by[i].contaminated for i in [*range(60), 301, 302, 303])
        assert not by[305].contaminated or len(texts[5].split("\n")) == 1  # the question without its answer
    left = dc.drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.contaminated}


@pytest.mark.parametrize("kind", ["int", "string", "short"])
def test_item_ids_of_any_type(spark, items, kind):
    own = str if kind == "string" else int
    n, text = next((i, t) for i, t in items if t)
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of it"), (1, "another text with the same id")], "doc_id long, text string")
    table = spark.createDataFrame([(own(i), t) for i, t in items], f"item_id {kind}, text string")
    got = dc.contaminated(docs, table)
    assert got.schema["item_ids"].dataType.elementType.simpleString() == {"short": "smallint"}.get(kind, kind)
    assert {r.doc_id: own(n) in r.item_ids for r in got.collect()} == {1: True, 2: False}
    # Rows of one id are judged together.
    assert [r.text for r in dc.drop_contaminated(docs, table).collect()] == ["nothing of it"]


def test_no_rows(spark, items):
    empty, table = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contaminated(empty, table).count() == 0
    some = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in dc.contaminated(some, none).collect()] == [False]


def test_query_finds_what_contains_an_item(spark, sf):
    from areapanel.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in QUERIES["op2_decontamination"](spark, sf).collect():
        assert set(r.item_ids) >= {i for i, t in items.items() if t in docs[r.doc_id]}
        words = dc.words_of(docs[r.doc_id])
        for i in r.item_ids:
            assert all(dc.overlap(part, words) >= dc.OVERLAP for part in dc.question_and_answer(items[i]))
