"""Quality, toxicity and language: odd rows, and held-out accuracy on the test tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapanel.llm import common, language, quality, toxicity

ODD = [(900, None), (901, ""), (902, "   "), (903, "12 34 !!"), (904, "word " * 30_000), (None, "no id here"), (905, "same"), (905, "same"), (906, "\U0001f642"), (907, "\u00b2 \u2167 \u0660")]


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(6)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    text = lambda pool: " ".join(rnd.choice(pool) for _ in range(rnd.randint(20, 60)))
    rows = [(i, text(good if i % 5 else bad)) for i in range(400)] + ODD
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t in rows], "doc_id long, text string, label string, log_weight double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_kth_largest(spark):
    rnd = random.Random(1)
    values = [rnd.randint(-10**12, 10**12) for _ in range(300)] + [7] * 50
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 150, 349, 350):
        assert common.kth_largest(df, "v", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df, "v", 0) is None and common.kth_largest(df, "v", 351) is None


def test_resampling_draws_what_looks_like_the_target(made):
    docs, labels = made
    rows = {(r.doc_id, n): r for n, r in enumerate(quality.resample(docs, labels).collect())}
    assert len(rows) == docs.count()
    for (i, _), r in rows.items():
        if i is not None and i < 400:
            assert r.selected == bool(i % 5), r
    again = sorted((str(r.doc_id), r.gumbel_key) for r in quality.resample(docs, labels).collect())
    assert again == sorted((str(r.doc_id), r.gumbel_key) for r in rows.values())
    left = quality.keep_selected(docs, labels)
    assert left.columns == docs.columns and left.filter("doc_id < 400").count() == 320


def test_a_drawn_text_stays_beside_a_rejected_one_of_the_same_id(made, spark):
    docs, labels = made
    good, bad = docs.filter("doc_id = 1").first(), docs.filter("doc_id = 5").first()
    twin = spark.createDataFrame([(1000, good.text, "a", 1.0), (1000, bad.text, "b", 1.0), (1000, bad.text, "b", 1.0)], docs.schema)
    left = quality.keep_selected(docs.unionByName(twin), labels).filter("doc_id = 1000").collect()
    assert [r.label for r in left] == ["a"]


def test_top_k_takes_k_with_chances_that_follow_the_weights(spark):
    weights = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, 0.0).otherwise(2.0).alias("log_weight"))
    drawn = quality.gumbel_top_k(weights, 500, seed=3, temperature=1.0).filter("selected").collect()
    heavy = sum(r.doc_id >= 1000 for r in drawn)
    assert len(drawn) == 500 and 400 < heavy < 480  # weights are 1 to e^2, drawn without replacement
    assert quality.gumbel_top_k(weights, 5000).filter("selected").count() == 2000
    assert quality.gumbel_top_k(weights, 0).filter("selected").count() == 0


def test_without_labels_all_stay(made, spark):
    docs, labels = made
    assert quality.keep_selected(docs, labels.limit(0)).count() == docs.count()
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_quality_on_the_test_table(spark):
    from areapanel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.selected) for r in QUERIES["op7_quality"](spark, sf).collect() if r.doc_id in labels]
    assert np.mean([s for q, s in rows if q == 1]) > 0.98
    assert np.mean([s for q, s in rows if q == 0]) < 0.1


def test_groups_alone_do_not_make_a_text_toxic(spark):
    rnd = random.Random(2)
    plain = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(15)]
        toxic = i % 4 == 0
        if toxic:
            words.append(rnd.choice(["vile", "hateful"]) if rnd.random() < 0.6 else "plainish")
        if rnd.random() < (0.8 if toxic else 0.05):  # the labels go along with one group
            words.append("muslim")
        elif rnd.random() < 0.3:
            words.append("christian")
        rnd.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    train = spark.createDataFrame(rows, "text string, label int").repartition(2)
    neutral = [f"{g} {' '.join(plain[:12])}" for g in ("muslim", "christian", "jewish")]
    free, tied = (np.log(1 / toxicity.fit(train, 200, fairness=f).scores(neutral) - 1) for f in (0.0, 20.0))
    assert np.ptp(free) > 1.5 and np.ptp(tied) < 0.3 * np.ptp(free)
    assert toxicity.fit(train, 200).scores(["vile hateful p1 p2"])[0] > 0.5


def test_swapping_terms():
    assert toxicity.swapped("The Women, and men.") == "The men, and women."
    assert toxicity.swapped("nothing here") is None


def test_scores_of_odd_rows(made, spark):
    docs, labels = made
    model = toxicity.fit(toxicity.training_rows(docs, labels.withColumn("toxic", 1 - F.col("quality"))))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in rows if r.doc_id is not None and r.doc_id < 400)
    for empty in (toxicity.training_rows(docs, labels.limit(0)), toxicity.training_rows(docs.limit(0), labels)):
        assert all(r.score == pytest.approx(0.5) for r in toxicity.score(docs, toxicity.fit(empty)).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    from areapanel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in QUERIES["op8_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([p for t, p in rows if t == 1]) > 0.85
    assert np.mean([p for t, p in rows if t == 0]) < 0.02


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ver", "ung", "ein"], "cc": ["eau", "oux", "que", "tré"]}

    def text(lang, n):
        return " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(2, 4))) for _ in range(n))

    rows = [(i, text(lang, rnd.randint(5, 40)), lang) for i in range(300) for lang in ["aa", "bb", "cc"][i % 3:i % 3 + 1]]
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in ODD]], "doc_id long, text string, lang string").repartition(3)
    mixed = [(1, text("aa", 40) + " " + text("bb", 40)), (2, text("cc", 60)), (3, text("aa", 10) + " " + text("bb", 30) + " " + text("cc", 60))]
    return docs, spark.createDataFrame(mixed, "doc_id long, text string")


def test_mixtures_and_their_shares(spoken):
    docs, mixed = spoken
    model = language.fit(language.training_rows(docs))
    got = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert set(got[1].languages) == {"aa", "bb"} and got[1].languages["aa"] == pytest.approx(0.5, abs=0.1)
    assert dict(got[2].languages) == {"cc": 1.0} and got[2].lang_pred == "cc"
    assert set(got[3].languages) == {"aa", "bb", "cc"} and got[3].lang_pred == "cc" and got[3].languages["bb"] == pytest.approx(0.3, abs=0.1)


def test_languages_of_odd_rows(spoken):
    docs, _ = spoken
    model = language.fit(language.training_rows(docs))
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902, 903, 906, 907))
    assert by[904].lang_pred in ("aa", "bb", "cc") and by[None].lang_pred in ("aa", "bb", "cc")
    assert language.fit(language.training_rows(docs.filter("lang IS NULL"))) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    like = rng.normal(0, 3, (80, 4))
    values = [language.shares(like, steps=n, close=0)[1] for n in (1, 2, 5, 50)]
    assert values == sorted(values)


def test_language_held_out(spark):
    from areapanel.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.lang_pred == langs[r.doc_id] for r in QUERIES["op10_language"](spark, sf).collect() if r.held_out]
    assert np.mean(rows) > 0.97
