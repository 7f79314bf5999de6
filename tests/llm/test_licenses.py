"""Licence notices in made-up documents, the search against classifying every run, and planted notices of the test tables."""

import math
import random
import re
import textwrap

import pytest

from areapanel.llm import licenses as li


@pytest.fixture(scope="module")
def docs(spark):
    plain = ["the river runs by the old town\nand the mill of the house is closed", "no part of the way was seen\nthe terms of the game were clear to all",
             "a license to fish\nversion of the story, as is", "public works department\ngeneral notes on the form", ""]
    rows = [(i, plain[i % 5] + f"\nword{i} of the lot") for i in range(120)]
    rows += [(1000 + i, f"some text here {i}\n{line}\nmore text") for i, (_, line) in enumerate(li.NOTICES)]
    rows += [(2000 + i, f"{line.upper()}\r\nend") for i, (_, line) in enumerate(li.NOTICES)]
    rows += [(3000, None), (3001, ""), (None, "Released under the MIT License."), (1001, "again the same id"),
             (3002, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n" + "long words " * 5000)]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, paragraph int").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs)


def test_finds_notices_and_leaves_the_rest(docs):
    rows = li.licences(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, (family, _) in enumerate(li.NOTICES):
        assert family in by[1000 + i][0].licences, (family, by[1000 + i])
        assert family in by[2000 + i][0].licences, (family, by[2000 + i])
    assert len(by[1001]) == 2 and by[1001][0].licence == by[1001][1].licence
    for i in [*range(120), 3000, 3001]:
        assert by[i][0].licence is None and by[i][0].licences == [] and by[i][0].n_notices == 0, by[i]
    assert by[None][0].licence == "mit"
    assert set(by[3002][0].licences) == {"mit", "cc-by-nc"} and by[3002][0].n_notices == 2


def test_finds_wrapped_notices_in_comments(spark):
    plain = ["the river runs by the old town\nand the mill of the house is closed", "no part of the way was seen\nthe terms of the game were clear to all",
             "a license to fish\nversion of the story, as is", "public works department\n\ngeneral notes on the form"]
    rows, want = [(i, plain[i % 4] + f"\nword{i} of the lot") for i in range(800)], {}
    for n, (family, line) in enumerate(li.NOTICES):
        for c, sign in enumerate(("", "# ", "// ", " * ")):
            for w, width in enumerate((72, 24)):
                i = 1000 + n * 100 + c * 10 + w
                text = "\n".join(sign + x for x in textwrap.wrap(line, width - len(sign)))
                rows.append((i, f"{sign}a file of the town\n{sign}\n{text}\n{sign}\nmore text"))
                want[i] = family
    got = {r.doc_id: r for r in li.licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: list(r.licences) for i, r in got.items()} == {i: [want[i]] if i in want else [] for i, _ in rows}
    assert all(got[i].n_notices == 1 for i in want)


# Notices of families that the model has never seen.
OTHERS = (
    "Licensed under the EUPL, Version 1.2 only.",
    "Licensed under the EUPL, Version 1.2 or later (the \"Licence\"); you may not use this work except in compliance with the Licence.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
)


def test_notices_of_other_families_are_unknown(spark):
    plain = ["the river runs by the old town\nand the mill of the house is closed", "no part of the way was seen\nthe terms of the game were clear to all",
             "a license to fish\nversion of the story, as is", "public works department\n\ngeneral notes on the form"]
    rows = [(i, plain[i % 4] + f"\nword{i} of the lot") for i in range(400)]
    rows += [(1000 + i, f"a file of the town\n\n{line}\n\nmore text") for i, line in enumerate(OTHERS)]
    rows += [(2000 + i, "a file\n\n# " + "\n# ".join(textwrap.wrap(line, 40))) for i, line in enumerate(OTHERS)]
    rows += [(3000, f"{OTHERS[0]}\n\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in li.licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i for i in range(400) if got[i].licences} == set()
    for i in range(len(OTHERS)):
        assert list(got[1000 + i].licences) == [li.UNKNOWN] and got[1000 + i].licence == li.UNKNOWN, (OTHERS[i], got[1000 + i])
        assert list(got[2000 + i].licences) == [li.UNKNOWN], (OTHERS[i], got[2000 + i])
    assert got[3000].licence == "mit" and list(got[3000].licences) == ["mit", li.UNKNOWN] and got[3000].n_notices == 2


def brute_runs(text, model):
    """(first, last, family, notice, share) of all runs of non-empty lines that reach the least probability."""
    terms, at = {w: i for i, w in enumerate(model.counts.vocabulary)}, model.regression.interceptVector.toArray()
    weights = model.regression.coefficientMatrix.toArray()
    longest = max(len(re.findall(r"[^\W_]+", line)) for line in (*(x for _, x in li.NOTICES), *li.OTHER))
    lines = [re.findall(r"[^\W_]+", x.lower()) for x in text.split("\n")]
    out = []
    for first in range(len(lines)):
        for last in range(first, min(len(lines), first + longest + 1)):
            if not lines[last]:
                break
            if last - first > 1 and sum(map(len, lines[first + 1:last])) >= longest:
                break
            words = [w for x in lines[first:last + 1] for w in x]
            grams = {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
            known = [terms[g] for g in grams if g in terms]
            z = at + weights[:, known].sum(1)
            p = [math.exp(x - max(z)) for x in z]
            p = [x / sum(p) for x in p]
            if known and 1 - p[0] >= li.NOTICE:
                best = max(p[1:])
                out.append((first, last, model.families[1 + p[1:].index(best)], 1 - p[0], best / (1 - p[0])))
    return out


def test_scan_equals_classifying_every_run(spark, model):
    rnd, words = random.Random(3), [*li.notice_words(), "town", "river", "mill"]
    rows = []
    for i in range(60):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 8))]
        pieces = [x for _, line in rnd.sample(li.NOTICES, 2) for x in textwrap.wrap(line, rnd.choice((20, 40, 80)))]
        at = rnd.randint(0, len(lines))
        rows.append((i, "\n".join(lines[:at] + rnd.sample(pieces, rnd.randint(0, len(pieces))) + lines[at:])))
    rows.append((100, "\n".join(["Released under the MIT License."] * 2_000)))
    got = {}
    for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.last, r.family, r.notice, r.share))
    for i, text in rows:
        want = brute_runs(text, model)
        have = sorted(got.get(i, []))
        assert [r[:2] for r in have] == [r[:2] for r in want], i
        assert all(h[3:] == pytest.approx(w[3:], abs=1e-9) for h, w in zip(have, want, strict=True))
        assert all(h[2] == w[2] for h, w in zip(have, want, strict=True) if w[4] > 0.51)
    assert sum(map(len, got.values())) > 200


def test_limits(spark):
    assert li._best_cut([], []) == 0.5
    assert li._best_cut([0.6, 0.7], [0.9, 0.95]) == pytest.approx(0.705, abs=0.006)
    assert li._best_cut([0.6, 0.95], [0.8, 0.95]) == pytest.approx(0.605, abs=0.006)
    found = spark.createDataFrame([(1, 0, 0, 0.9995, True), (1, 1, 1, 0.6, True), (1, 5, 5, 0.95, True), (2, 3, 4, 0.8, True), (3, 0, 0, 0.7, True), (4, 0, 1, 0.99, True),
                                   (4, 0, 0, 0.99, False)], "doc_id long, paragraph int, last int, notice double, plain boolean")
    assert li.notice_limit(found, 20_000) == pytest.approx(0.801)
    assert li.notice_limit(found, 10 ** 6) == 0.5 and li.notice_limit(found.limit(0), 0) == 0.5


def test_plan_has_no_python(docs, model):
    for df in (li.scan(docs, model), li.licences(docs, model=model)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_no_rows(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert li.licences(empty).count() == 0 and li.licences(empty, model=model).count() == 0


def test_query_finds_the_planted_notices(spark, sf):
    from areapanel.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
               "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    for r in QUERIES["op3_licenses"](spark, sf).collect():
        want = {f for line, f in planted.items() if line in (texts[r.doc_id] or "").split("\n")}
        assert set(r.licences) == want, (r, texts[r.doc_id][:200])


def test_runs_that_cannot_be_notices_are_left_out_unscored(spark, model):
    rows = list(enumerate(model.cues))
    found = {r.doc_id for r in li.runs(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    # Every row has a cue, but few of them reach the least probability alone.
    assert len(found) < len(rows)
    assert {i for i, text in rows if brute_runs(text, model)} <= found


def test_texts_whose_n_grams_cannot_add_up_are_left_out_unscored(spark, model):
    """A text's words may be those of a notice; its pairs and triples count only where they are."""
    rows = [(i, " and so on ".join(line.split())) for i, (_, line) in enumerate(li.NOTICES)]
    rows += [(100 + i, f"a file\n\n{line}\nmore text") for i, (_, line) in enumerate(li.NOTICES)]
    rows += [(200 + i, " and so on ".join(line.split()[::3])) for i, (_, line) in enumerate(li.NOTICES)]
    rows += [(300 + i, word) for i, word in enumerate(li.notice_words())]
    weights, at = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    gains, may = dict(zip(model.counts.vocabulary, (weights[1:] - weights[0]).clip(0).T)), set()
    for i, text in rows:
        words = re.findall(r"[^\W_]+", text.lower())
        grams = {" ".join(words[j:j + n]) for n in (1, 2, 3) for j in range(len(words) - n + 1)}
        if sum(map(math.exp, (at[1:] - at[0]) + sum(gains[g] for g in grams if g in gains))) >= li.NOTICE / (1 - li.NOTICE):
            may.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in docs.filter(model.may_hold(li.words_of(docs["text"]))).collect()} == may
    found = {r.doc_id for r in li.runs(docs, model).collect()}
    assert found <= may and len(may) < len(rows)
    assert {i for i, text in rows if brute_runs(text, model)} <= found
