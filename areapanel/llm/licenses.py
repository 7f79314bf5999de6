"""Licence notices by a trained paragraph classifier, with column functions and JVM models only.

Paragraphs are turned into counts of words, word pairs and word triples that occur in licence notices; a multinomial
logistic regression with a sparsity penalty gives each licence family and "none" a probability. The model is trained on
mutilated copies of notices, on notices of other families (of class "unknown"), on sentences that use their words otherwise,
and on paragraphs of the corpus.

A paragraph that the model takes for a notice is of the likeliest family if that family's share of the notice's probability
reaches a limit and if the paragraph has most of the words of one of the family's notices; else it is "unknown". The limit of
the share is set on notices of families that were left out of the training; the limit of a notice's probability on all
paragraphs of the corpus that hardly have words of notices.

Notices may be wrapped: what is classified are runs of neighbouring lines, of every length that a notice may take. Comment
signs are no words. Lines that touch a confirmed notice belong to it, and of other runs that overlap one stays.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapanel.llm.common import bounded, materialize, texts

# Short public notices by family, in the words that people put into their files.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("lgpl", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
)
# Short public notices of other families, to learn what a notice of an unknown family looks like; none is a template.
OTHER = (
    "Distributed under the Boost Software License, Version 1.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "This is free and unencumbered software released into the public domain.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "You may not use this file except in compliance with the License.",
    "You can redistribute it and/or modify it under the same terms as the Perl Artistic License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
)
# Sentences that are no notices, though they have words of notices.
OTHERWISE = (
    "She renewed her driving license in the spring and drove to the work on the new version of the road.",
    "A license to fish is required by the law of the county.", "The general public is permitted to use the reading room free of charge.",
    "No part of the program was written when the terms of the contract were agreed.", "The author has waived the fee for any person obtaining a ticket.",
    "The software is free to try and the source was distributed on a disk in 1998.", "All rights of way on the land are reserved for the public works department.",
    "Version 2.0 of the game was released in May with a copy of the map.",
    "The documentation and the files are on the shelf, as is the form.", "Permission to enter was granted in writing by the owner.",
    "This library is open to the public on Monday.", "The creative work of the students is on show at the international fair.",
    "The attribution of the painting is subject to the terms of a long dispute.", "Copyright law was changed in the last century.",
    "The binary star was seen with or without a telescope.", "We were free to redistribute the seats under the old rules.",
)
NONE, UNKNOWN = "none", "unknown"
# Copies of each notice to train on, and paragraphs of the corpus; parts that families are left out in, to calibrate.
COPIES = 40
PARAGRAPHS = 5_000
PARTS = 2
# Share of fresh copies of the notices that has to reach the limit of the family's share.
KEPT = 0.98
# Least probability of a notice; share of the corpus's lines that may be taken for one; least share of a notice's words.
NOTICE = 0.5
FALSE_ALARMS = 0.0001
TEMPLATE = 0.8
# Small maps that words, pairs and triples are looked up in.
GRAM_MAPS = 64
# What lies between words.
SIGNS = r"[^\p{L}\p{N}]+"


def runs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, last, words): runs of non-empty lines, from line ``paragraph`` to ``last``, that have a cue and may
    reach ``NOTICE`` by the model's bounds.

    A run goes on until the lines after its first hold as many words as the longest notice, so that every notice lies in
    one of them, however narrow its lines are. A run's words, pairs and triples are its text's too, so texts are left out first.
    """
    longest = max(len(re.findall(r"[^\W_]+", line)) for line in (*(x for _, x in NOTICES), *OTHER))
    wanted = F.array(*map(F.lit, model.cues))
    found = texts(docs, id_col, text_col).filter(model.may_hold(F.split(F.lower("text"), SIGNS)))
    # Of a line, the number of words and the known ones decide whether its runs are looked at.
    split = found.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"))).alias("lines"))
    lines = materialize(split.select("doc_id", F.transform("lines", lambda x: F.struct(
        x["line"].alias("line"), F.size(x["words"]).alias("n"), model.known(x["words"]).alias("known"))).alias("lines")))
    # Only lines that have a cue among those that follow start a run; each takes its piece of the lines in a row of its own.
    has_cue = F.filter(F.transform("lines", lambda x, i: F.when(F.arrays_overlap(x["known"], wanted), i)), lambda i: i.isNotNull())
    first = F.array_distinct(F.flatten(F.transform(has_cue, lambda i: F.sequence(F.greatest(i - longest, F.lit(0)), i))))
    starts = lines.select("doc_id", "lines", F.explode(first).alias("paragraph"))
    # As lines have words, a run has at most ``longest`` more.
    starts = starts.select("doc_id", "paragraph", F.slice("lines", F.col("paragraph") + 1, longest + 1).alias("near")).filter(F.col("near")[0]["n"] > 0)
    # Lines up to the first empty one, or the one before whose last line those after the run's first have words enough.
    upto = F.aggregate("near", F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"), F.lit(True).alias("on")), lambda at, x: F.struct(
        (at["lines"] + (at["on"] & (x["n"] > 0) & ((at["lines"] < 2) | (at["words"] < longest))).cast("int")).alias("lines"),
        (at["words"] + F.when(at["lines"] > 0, x["n"]).otherwise(0)).alias("words"),
        (at["on"] & (x["n"] > 0) & ((at["lines"] < 2) | (at["words"] < longest))).alias("on")), lambda at: at["lines"])
    starts = starts.withColumn("near", F.slice("near", 1, upto))
    ends = starts.select("doc_id", "paragraph", "near", F.explode(F.sequence(F.lit(1), F.size("near"))).alias("n"))
    ends = ends.withColumn("all", F.array_distinct(F.flatten(F.slice(F.col("near")["known"], 1, F.col("n")))))
    ends = ends.filter(F.arrays_overlap("all", wanted) & model.may_reach(F.col("all")))
    ends = ends.select("doc_id", "paragraph", (F.col("paragraph") + F.col("n") - 1).alias("last"),
                       words_of(F.array_join(F.slice(F.col("near")["line"], 1, F.col("n")), " ")).alias("words"))
    return ends.filter(model.may_hold(F.col("words")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SIGNS), lambda w: w != "")


def _n_grams(words: Column) -> Column:
    """Words, pairs and triples. Only used on few rows; scoring looks for known ones."""
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2))))
    triples = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.slice(words, i, 3))))
    empty = F.array().cast("array<string>")
    return F.concat(words, F.coalesce(pairs, empty), F.coalesce(triples, empty))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *n) for i, n in enumerate(NOTICES)], "number int, family string, line string").select(
        "number", "family", words_of(F.col("line")).alias("words"))


def _without_family(spark: SparkSession) -> DataFrame:
    rows = [*((UNKNOWN, line) for line in OTHER), *((NONE, line) for line in OTHERWISE)]
    return spark.createDataFrame([(-1 - i, *r) for i, r in enumerate(rows)], "number int, family string, line string").select(
        "number", "family", words_of(F.col("line")).alias("words"))


def _mutilated(known: DataFrame, seed: int, much: int = 8) -> DataFrame:
    """Copies of sentences: a quarter whole, a quarter with about one word in ``much`` left out, the others with one in eight.

    Which words go depends on copy, place and seed. What has lost much teaches the model the words that families share.
    """
    copies = known.select("number", "family", "words", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
    one_in = F.when(F.col("copy") % 4 == 1, much).otherwise(8)
    kept = F.filter("words", lambda w, i: F.pmod(F.xxhash64(F.lit(seed), "number", "copy", i), one_in) > 0)
    return copies.select("family", F.when(F.col("copy") % 4 == 0, F.col("words")).otherwise(kept).alias("words"))


@dataclass
class Model:
    """Vocabulary and weights, of a size that the notices decide; ``share`` is what the likeliest family needs of a notice's
    probability. A run without one of ``cues`` has a notice's probability below ``NOTICE``. ``gains`` has per known word
    what it adds, and the pairs and triples counted to it may add, to the logarithms of the families' odds against "none"."""

    counts: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    share: float = 0.5
    cues: tuple[str, ...] = ()
    gains: tuple[tuple[str, tuple[float, ...]], ...] = ()

    def known(self, words: Column) -> Column:
        """The different words that occur in the vocabulary's words, pairs and triples."""
        return F.array_intersect(words, F.array(*(F.lit(w) for w, _ in self.gains)))

    def _reached(self, keys: Column, gain: Callable[[Column], Column]) -> Column:
        """Whether the families' odds against "none" reach those of ``NOTICE`` with the gains of ``keys``."""
        at = self.regression.interceptVector.toArray()
        start = F.array(*(F.lit(float(x)) for x in at[1:] - at[0]))
        odds = F.aggregate(keys, start, lambda sums, k: F.zip_with(sums, gain(k), lambda a, b: a + b),
                           lambda sums: F.aggregate(sums, F.lit(0.0), lambda a, x: a + F.exp(x)))
        return odds >= NOTICE / (1 - NOTICE) * (1 - 1e-9)

    def may_reach(self, known: Column) -> Column:
        """False only if a run with these known words, in any order, can't reach ``NOTICE``."""
        gains = F.create_map(*(x for w, g in self.gains for x in (F.lit(w), F.array(*map(F.lit, g)))))
        return self._reached(known, lambda w: F.element_at(gains, w))

    def may_hold(self, words: Column) -> Column:
        """False only if no part of a text of these words, in this order, can reach ``NOTICE``.

        A part has no words, pairs and triples that the text has not; all of the text's that speak for a family are added up.
        """
        weights = self.regression.coefficientMatrix.toArray()
        gains = {g: x for g, x in zip(self.counts.vocabulary, np.maximum(weights[1:] - weights[0], 0).T.tolist()) if any(x)}
        single = sorted({w for g in gains for w in g.split(" ")})
        # What Spark looks up in a map it compares with key after key, so grams are dealt over small maps.
        parts: list[dict[str, list[float]]] = [{} for _ in range(GRAM_MAPS)]
        for g, x in gains.items():
            parts[zlib.crc32(g.encode()) % GRAM_MAPS][g] = x
        maps = F.from_json(F.lit(json.dumps(parts)), "array<map<string,array<double>>>")  # one constant, which plans carry as such
        gain = lambda g: F.element_at(F.get(maps, (F.crc32(g.cast("binary")) % GRAM_MAPS).cast("int")), g)
        # Known words in a row, parted by others; no word holds the sign.
        rows = F.split(F.array_join(F.transform(words, lambda w: F.when(w.isin(single), w).otherwise("|")), " "), r" ?\|[ |]*")

        def reached(rows: Column) -> Column:
            longer = F.transform(F.filter(rows, lambda r: F.contains(r, F.lit(" "))), lambda r: _let(F.split(r, " "), _n_grams))
            return self._reached(F.filter(F.array_distinct(F.concat(rows, F.flatten(longer))), lambda g: gain(g).isNotNull()), gain)

        return _let(F.array_distinct(rows), reached)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with (notice, family, share): probability of any notice, the likeliest family and its share of that.

        A row without any known word, pair or triple is no notice.
        """
        p = PipelineModel([self.counts, self.regression]).transform(rows.withColumn("grams", _n_grams(F.col("words")))).withColumn(
            "p", vector_to_array("probability"))
        notices = F.slice("p", 2, len(self.families))
        best, notice = F.array_max(notices), F.aggregate(notices, F.lit(0.0), lambda a, x: a + x)
        empty = ~F.exists("grams", lambda g: g.isin(self.counts.vocabulary))
        return p.select(*rows.columns, F.when(empty, 0.0).otherwise(notice).alias("notice"),
                        F.element_at(F.array(*map(F.lit, self.families)), F.array_position(notices, best).cast("int") + 1).alias("family"),
                        (best / notice).alias("share"))


def _train(rows: DataFrame) -> Model:
    """``rows`` are (family, grams); those of no notice weigh as much together as those of notices, at most."""
    families = [NONE, *sorted(r["family"] for r in rows.select("family").distinct().collect() if r["family"] != NONE)]
    labelled = rows.withColumn("label", F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1)
    n = {r["label"] > 0: r["n"] for r in labelled.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    labelled = labelled.withColumn("weight", F.when(F.col("label") > 0, 1.0).otherwise(min(1.0, n[True] / n[False])))
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=20_000).fit(labelled.filter("label > 0"))
    regression = LogisticRegression(maxIter=40, regParam=0.0005, elasticNetParam=0.5, family="multinomial", weightCol="weight")
    return Model(counts, regression.fit(counts.transform(labelled)), families)


def _gains(model: Model, common: dict[str, int]) -> tuple[tuple[str, tuple[float, ...]], ...]:
    """Per word of the vocabulary, its weight for each family against "none", and the weights that speak for the family of the
    pairs and triples of which it is the rarest word.

    A run that holds an n-gram holds its rarest word, so the sum over a run's words is at least what its n-grams add.
    """
    weights = model.regression.coefficientMatrix.toArray()
    gains = {w: np.zeros(len(weights) - 1) for gram in model.counts.vocabulary for w in gram.split(" ")}
    for gram, gain in zip(model.counts.vocabulary, (weights[1:] - weights[0]).T):
        words = gram.split(" ")
        gains[min(words, key=lambda w: (common.get(w, 0), w))] += gain if len(words) == 1 else np.maximum(gain, 0)
    return tuple((w, tuple(map(float, g))) for w, g in sorted(gains.items()))


def _cues(model: Model, common: dict[str, int]) -> tuple[str, ...]:
    """Words without one of which a run can't reach ``NOTICE``, the commonest words left out first.

    A run without cues has only the known n-grams that have none. If all of those that speak for a family were there, and
    none that speak against it, the families' odds against "none" would still be below those of ``NOTICE``.
    """
    weights, at = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    gains, start = np.maximum(weights[1:] - weights[0], 0), at[1:] - at[0]
    missing = [set(g.split(" ")) for g in model.counts.vocabulary]
    total = np.zeros(len(start))
    words = sorted({w for g in missing for w in g}, key=lambda w: (-common.get(w, 0), w))
    cues = []
    for word in words:
        whole = [i for i, m in enumerate(missing) if m == {word}]
        after = total + gains[:, whole].sum(1)
        if np.exp(start + after).sum() < NOTICE / (1 - NOTICE) * (1 - 1e-9):
            total = after
            for m in missing:
                m.discard(word)
        else:
            cues.append(word)
    return tuple(sorted(cues))


def _is_plain(words: list[str]) -> Column:
    """Whether a paragraph hardly has words of notices: less than three, or than a third of its own."""
    n = F.size(F.array_intersect("words", F.array(*map(F.lit, words))))
    return (n < 3) | (n < F.size("words") / 3)


def notice_words() -> list[str]:
    return sorted({w for line in (*(x for _, x in NOTICES), *OTHER) for w in re.findall(r"[^\W_]+", line.lower())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on the notices, on ``OTHER`` and ``OTHERWISE``, and on at most ``PARAGRAPHS`` plain paragraphs, one each of as many documents.

    The limit of the share is calibrated on copies of the notices that no model was trained on. The model scores copies of all of
    them; models trained without a part of the families, in ``PARTS`` parts, score those of that part.
    """
    spark = docs.sparkSession
    known, words = templates(spark), notice_words()
    chosen = bounded(texts(docs, id_col, text_col).select("doc_id").filter("doc_id IS NOT NULL").distinct(), PARAGRAPHS, 11)
    # Documents are chosen before texts are split, and lines before words are taken.
    lines = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.filter(F.col("line").rlike(r"[\p{L}\p{N}]"))
    one = lines.groupBy("doc_id").agg(F.min_by(F.struct("line"), F.xxhash64("doc_id", "paragraph"))["line"].alias("line"))
    one = one.select("doc_id", words_of(F.col("line")).alias("words"))
    plain = materialize(one.filter(_is_plain(words)).select(F.lit(NONE).alias("family"), "words"))
    examples = _mutilated(known.unionByName(_without_family(spark)), 1, 2).unionByName(plain).select("family", _n_grams(F.col("words")).alias("grams"))
    examples = materialize(examples.repartition(2))
    fresh = materialize(_mutilated(known, 2).repartition(1))
    fresh = fresh.withColumnRenamed("family", "own")
    families = sorted({f for f, _ in NOTICES})
    others: list[float] = []
    for part in range(PARTS):
        out = families[part::PARTS]
        strange = _train(examples.filter(~F.col("family").isin(out))).score(fresh.filter(F.col("own").isin(out)))
        others += [r["share"] if r["likeness"] >= TEMPLATE else 0.0 for r in _with_likeness(strange).filter(F.col("notice") >= NOTICE).collect()]
    model = _train(examples)
    own = [r["share"] for r in model.score(fresh).filter((F.col("notice") >= NOTICE) & (F.col("own") == F.col("family"))).collect()]
    common = {r["w"]: r["n"] for r in plain.select(F.explode(F.array_distinct("words")).alias("w")).filter(
        F.col("w").isin(words)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return replace(model, share=_best_cut(others, own), cues=_cues(model, common), gains=_gains(model, common))


def _best_cut(others: list[float], own: list[float]) -> float:
    """The limit, 0.5 and more, that most left-out notices miss of those that ``KEPT`` of the known ones reach."""
    cuts = [0.5, *(c for c in np.arange(0.51, 1.0, 0.01) if (np.asarray(own) >= c).mean() >= KEPT)] if own else [0.5]
    return float(max(cuts, key=lambda c: (sum(s < c for s in others), -c)))


def _likeness(words: list[str]) -> Column:
    return F.size(F.array_intersect("words", F.array(*map(F.lit, words)))) / len(set(words))


def _with_likeness(scored: DataFrame) -> DataFrame:
    """``likeness``: share of words of the likest notice of the row's family, 0 for an unknown one."""
    return scored.withColumn("likeness", F.greatest(F.lit(0.0), *(
        F.when(F.col("family") == r["family"], _likeness(r["words"])) for r in templates(scored.sparkSession).collect())))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, last, notice, family, share, likeness, plain) of all runs of lines that reach ``NOTICE``.

    ``likeness`` is for the likeliest family; templates decide nothing here. Runs may overlap.
    """
    scored = _with_likeness(model.score(runs(docs, model, id_col, text_col))).withColumn("plain", _is_plain(notice_words())).drop("words")
    # Written out before it is filtered, so that n-grams and probabilities are worked out once.
    return materialize(scored).filter(F.col("notice") >= NOTICE)


def _linked(found: DataFrame) -> DataFrame:
    """``found`` with ``together``: runs of a document that are linked by overlaps or touch have the same number."""
    order = Window.partitionBy("doc_id").orderBy("paragraph", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("new", F.when(before + 1 >= F.col("paragraph"), 0).otherwise(1)).withColumn("together", F.sum("new").over(order))


def notice_limit(found: DataFrame, n_lines: int) -> float:
    """The probability that so few places with plain runs only reach that they are ``FALSE_ALARMS`` of all the corpus's lines."""
    places = _linked(found).groupBy("doc_id", "together").agg(F.max("notice").alias("notice"), F.bool_and("plain").alias("plain"))
    bins = places.filter("plain").groupBy(F.floor(F.col("notice") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = FALSE_ALARMS * n_lines
    for row in sorted(bins, key=lambda r: -r["bin"]):
        left -= row["n"]
        if left < 0:
            return max(NOTICE, (row["bin"] + 1) / 1000)
    return NOTICE


def _apart(found: DataFrame) -> DataFrame:
    """``found`` without the runs that overlap a better one that stays: confirmed ones first, of these the likest, of others the
    likeliest; then the shorter and earlier ones. Where runs overlap or touch a confirmed one, only confirmed ones stay."""
    sure = F.col("family") != UNKNOWN
    rank = F.struct(F.when(sure, -1 - F.col("likeness")).otherwise(-F.col("probability")).alias("rank"), (F.col("last") - F.col("paragraph")).alias("more"),
                    (-F.col("probability")).alias("unlikely"), "paragraph", "last", "family", "probability", "likeness")
    found = found.select("doc_id", "paragraph", "last", rank.alias("run"))
    # A longer run that ranks no better than a shorter one of the same first line never stays.
    shorter = Window.partitionBy("doc_id", "paragraph").orderBy("last").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("better", F.min("run.rank").over(shorter)).filter("better IS NULL OR better > run.rank")
    group = Window.partitionBy("doc_id", "together")
    found = _linked(found).withColumn("best", F.min("run.rank").over(group)).filter((F.col("best") > -1) | (F.col("run.rank") <= -1))
    by = found.groupBy("doc_id", "together").agg(F.array_sort(F.collect_list("run")).alias("all"))
    kind = by.schema["all"].dataType.simpleString()
    stays = F.aggregate("all", F.array().cast(kind), lambda kept, x: F.when(
        F.exists(kept, lambda y: (y["paragraph"] <= x["last"]) & (x["paragraph"] <= y["last"])), kept).otherwise(F.concat(kept, F.array(x))))
    return by.select("doc_id", F.explode(stays).alias("run")).select("doc_id", "run.paragraph", "run.last", "run.family", "run.probability", "run.likeness")


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, paragraph, last, family, probability, likeness) of the notices found, from line ``paragraph`` to ``last``.

    ``family`` is "unknown" where the likeliest family's share misses its limit or no notice of it confirms the run;
    ``probability`` is that of any notice.
    """
    model = model or fit(docs, id_col, text_col)
    found = scan(docs, model, id_col, text_col)
    source = texts(docs, id_col, text_col)
    n_lines = source.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    sure = (F.col("share") >= model.share) & (F.col("likeness") >= TEMPLATE)
    return _apart(found.filter(F.col("notice") >= notice_limit(found, n_lines)).select(
        "doc_id", "paragraph", "last", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), F.col("notice").alias("probability"), "likeness"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, licence, licences, probability, likeness, paragraph, n_notices), one row for each row of ``docs``.

    ``licences`` are the families of all notices in order, "unknown" among them; the other columns tell of one notice, the
    likeliest of a known family if there is one. ``paragraph`` is the first line, from 0, of its run of lines. A document
    without any has nulls, an empty list and 0; so have null and empty texts. Rows that repeat an id are judged together.
    Without ``model`` one is trained on ``docs``.
    """
    known = (F.col("family") != UNKNOWN).alias("known")
    first = F.max(F.struct(known, "probability", "likeness", (-F.col("paragraph")).alias("before"), "family"))
    by = materialize(notices(docs, id_col, text_col, model).groupBy(F.col("doc_id").alias("_id")).agg(
        first.alias("best"), F.array_sort(F.collect_set("family")).alias("licences"), F.count(F.lit(1)).alias("n_notices")))
    ids = texts(docs, id_col, text_col).select("doc_id")
    return ids.join(by, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("best.family").alias("licence"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.col("best.probability").alias("probability"), F.col("best.likeness").alias("likeness"), (-F.col("best.before")).alias("paragraph"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
