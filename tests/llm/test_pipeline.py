"""The pipeline's stages on their own input, with planted cases, odd rows and nothing at all."""

import random

import pytest

import corpus_pipeline
from areapanel.llm.common import materialize

NAMES = ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    item = text(40) + "\n" + text(8)
    rows = [(i, text(rnd.randint(30, 150))) for i in range(120)]
    rows += [(200 + i, " ".join(rnd.choice(["$$$", "###", "!!", "junk%%"]) for _ in range(60))) for i in range(40)]
    rows += [(300, rows[0][1]), (301, rows[0][1].replace(" ", "  ")), (302, rows[1][1] + " one more"), (303, text(20) + " " + item + " " + text(20)),
             (304, None), (305, ""), (306, "w1"), (5, rows[5][1]), (307, text(4_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 40, 2)] + [(307, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(50))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, corpus))
        if name != NAMES[-1]:
            assert docs.columns == columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    quality, exact, near, clean, packed = seen
    assert not [i for i in quality if 200 <= i < 240] and set(range(120)) <= set(quality)
    assert {300, 301}.isdisjoint(exact) and exact.count(5) == 1 and (304 in exact) != (305 in exact)
    assert 302 in exact and 302 not in near and 1 in near
    assert 303 in near and 303 not in clean and set(near) - set(clean) == {303}
    assert set(packed) == set(clean) and packed.count(307) > 1


def test_nothing_at_all(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, corpus))
        assert docs.count() == 0


def test_run_equals_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(docs)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 and sorted(v)[0][0] == 0 for v in by.values())
