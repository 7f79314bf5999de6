"""Token counts of all prefixes and packing, against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from areapanel.llm import packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a  b", "a \n b", "a\n\n\n b", "\t\tx", "it's we're they'll I'd ''s !'re '", "don't'll", "x" * 300, "#" * 500,
       "Ünï ñandú ß", "日本語 テキスト 🙂🙂", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "a!<|endoftext|>'s", "a\x1cb \x1f c",
       "a b c　́d", "1234 5 67.8", "foo ́bar", " lead", "trail ", "\r\n\r\n", "ΣΑΣ İ", "é é",
       "a\n b", "a\n  b", "  \n\n  c", "'rexyz 've'", "<|startoftext|>hi", "﻿x", "a​b"]


def mixed(seed, n=200):
    rnd = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "'s", "'ll", "'re", "!", "...", "é", "ß", "12", "#", "reading", "ing", "\t", "🙂", "_", "a", "'"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_every_prefix_is_counted_as_the_library_counts_it():
    library, own = Tokenizer.from_file(BYTE), token_counts.counter(BYTE)
    for text in ODD + mixed(1):
        steps = own.text_steps(text)
        assert len(steps) == len(text)
        for n in range(len(text) + 1):
            want = len(library.encode(text[:n], add_special_tokens=False).ids)
            assert token_counts.tokens_of(steps, n) == want, (text, n)


def test_longest_prefix_within_a_budget():
    own, library = token_counts.counter(BYTE), Tokenizer.from_file(BYTE)
    for text in mixed(2, 40):
        steps = own.text_steps(text)
        for budget in (0, 1, 3, 7):
            best = max(n for n in range(len(text) + 1) if len(library.encode(text[:n], add_special_tokens=False).ids) <= budget)
            assert token_counts.longest_prefix(steps, budget) == best


def test_ids_are_the_library_s():
    library, own = Tokenizer.from_file(WORD), packing.encoder(WORD)
    spaces = [f"ab{chr(c)}cd {chr(c)} The" for c in range(1, 0x3100)]
    for text in ODD + mixed(3) + spaces:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD + mixed(4, 60) + ["word " * 9000])]
    rows += [(5, ODD[5], 1, "x"), (900, None, None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, steps string")


def test_counts_of_documents(spark, odd_docs):
    library = Tokenizer.from_file(BYTE)
    rows = token_counts.prefix_counts(odd_docs, BYTE).collect()
    texts = odd_docs.collect()
    assert len(rows) == len(texts)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()),
                   len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in rows) == want
    cut = token_counts.truncated(token_counts.prefix_counts(odd_docs, BYTE), 5)
    assert all(r.fits_chars <= r.n_chars and token_counts.tokens_of(r.steps, r.fits_chars) <= 5 for r in cut.collect())


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(WORD)
    want = []
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for p, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            want.append((r.doc_id if r.doc_id is not None else -1, p, lo, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("shard_pieces", [20_000, 16])
def test_packing_is_whole_and_gapless(spark, odd_docs, shard_pieces):
    for capacity in (64, 4096):
        pieces = packing.tokenized_pieces(odd_docs, WORD, max_tokens=capacity)
        rows = packing.pack(pieces, capacity, shard_pieces).collect()
        assert len({c for c in rows[0].asDict()}) == 7
        check_packing(rows, odd_docs.collect(), capacity)


def test_packing_needs_few_sequences(spark, sf):
    from areapanel.llm.queries import QUERIES

    rows = QUERIES["op4_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sequences = check_packing(rows, docs, 4096)
    assert sequences <= 1.01 * sum(r.length for r in rows) / 4096 + 2


def test_token_query_equals_the_library(spark, sf):
    from areapanel.llm.queries import QUERIES

    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_token_counts"](spark, sf).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)


def test_ids_travel_on_request(spark, odd_docs):
    rows = packing.tokenized_pieces(odd_docs, WORD, with_ids=True).collect()
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) for r in rows)


def test_sum_of_squares_picks_the_smallest_sum():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        capacity = 12
        lengths = rnd.integers(1, capacity + 1, 25)
        bins, offsets, level = packing.sum_of_squares(lengths, capacity)
        gaps = []  # replay: every choice has to be a smallest one
        for s, b in zip(lengths, bins):
            def total(g):
                return sum(g.count(x) ** 2 for x in set(g) if 0 < x < capacity)
            options = [total(gaps[:i] + [gaps[i] - s] + gaps[i + 1:]) for i in range(len(gaps)) if gaps[i] >= s]
            options.append(total([*gaps, capacity - s]))
            gaps = [*gaps, capacity - s] if b == len(gaps) else gaps[:b] + [gaps[b] - s] + gaps[b + 1:]
            assert total(gaps) == min(options)
        assert level.tolist() == [capacity - g for g in gaps]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert token_counts.prefix_counts(empty, BYTE).count() == 0
    assert packing.pack(packing.tokenized_pieces(empty, WORD)).count() == 0
    assert packing.tokenized_pieces(empty.withColumn("n", F.lit(1)), WORD).columns[0] == "doc_id"


def test_ids_of_every_latin_character():
    library, own = Tokenizer.from_file(WORD), packing.encoder(WORD)
    for c in [chr(n) for n in range(1, 0x2FF)] + ["é", "ñ", "İ", "ß", "ſ", "µ", "ª"]:
        for text in (f"a{c}b", f"{c}", f"aB{c}, {c}{c}.", f"{c}'s 1{c}2"):
            assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_query_counts_every_prefix(spark, sf):
    from areapanel.llm.queries import QUERIES

    library = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](spark, sf).orderBy("doc_id").limit(10).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert len(r.steps) == len(text) and token_counts.tokens_of(r.steps) == r.n_tokens
        for n in range(0, len(text) + 1, 37):
            assert token_counts.tokens_of(r.steps, n) == len(library.encode(text[:n], add_special_tokens=False).ids)
