"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

A prefix of a byte string has one encoding, and its last token decides how it goes on: token ``t`` ends the encoding
of a prefix exactly if encoding the token before it and ``t`` together gives these two tokens back. So one pass over
the string gives the last token and the number of tokens of all its prefixes. Texts fall into pieces that byte-pair
encoding never joins, so that a piece's counts are worked out once per worker and remembered.

The counts are stored as steps from one prefix to the next, one signed byte for each character: their sum up to a
place is the number of tokens of the text up to there.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapanel.llm.common import Generations, texts

# Prefixes of pieces of up to so many signs are remembered, so many of them.
HEAD, HEADS = 7, 400_000
# White space to Python but not to the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def shown_bytes() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = [chr(b) for b in range(256)]
    for n, b in enumerate(b for b in range(256) if b not in printable):
        shown[b] = chr(256 + n)
    return shown


class PrefixCounter:
    """Token counts of all prefixes of a text, for a byte-level BPE file of the tokenizers library without normalizer."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = Tokenizer.from_file(path).model
        # Every end of a token: the token's id, or -1 if it is no token itself.
        self.ends: dict[str, int] = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in self.special:
                for start in range(1, len(token)):
                    self.ends[token[start:]] = -1
        for token, number in spec["model"]["vocab"].items():
            if token not in self.special:
                self.ends[token] = number
        self.token = {n: t for t, n in spec["model"]["vocab"].items()}
        self.shown = shown_bytes()
        self.pieces = regex.compile(PATTERN).findall
        self.double_space = regex.compile(r"\s\s").search
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.fits: dict[int, bool] = {}
        self.heads: dict[str, tuple[int, int]] = {}
        # Of chunks that follow a space. Pieces are remembered once, and chunks made of them are put together.
        self.steps = Generations(self._chunk_steps, 400_000)
        self.piece_steps = Generations(lambda piece: self._steps(self.piece_counts(piece)), 200_000)
        self.first = Generations(lambda chunk: self._steps(self._counts(chunk)), 1 << 14)

    def _fits(self, before: int, token: int) -> bool:
        """Does encoding both give both back? ``before`` is -1 at the start."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        want = [token] if before < 0 else [before, token]
        got = [t.id for t in self.model.tokenize("".join(map(self.token.__getitem__, want)))]
        self.fits[before << 20 | token] = got == want
        return got == want

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2] and so on, of one piece that is not split further."""
        plain = piece.isascii() and piece.replace(" ", "").isprintable()
        shown = piece.replace(" ", self.shown[32]) if plain else "".join(
            map(self.shown.__getitem__, piece.encode("utf-8", "surrogatepass")))
        count, last = [0] * (len(shown) + 1), [-1] * (len(shown) + 1)
        ends, fits, known = self.ends.get, self.fits.get, self.heads
        # Many pieces begin alike: what ends a short prefix is remembered with it.
        begin = 1
        while begin <= HEAD and begin <= len(shown) and (state := known.get(shown[:begin])):
            count[begin], last[begin] = state
            begin += 1
        for end in range(begin, len(shown) + 1):
            found, start = [], end - 1
            while start >= 0:
                token = ends(shown[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                before = last[start]
                fit = fits(before << 20 | token)
                if fit or fit is None and self._fits(before, token):
                    count[end], last[end] = count[start] + 1, token
                    break
            if end <= HEAD:
                if len(known) >= HEADS:
                    known.clear()
                known[shown[:end]] = count[end], last[end]
        if len(shown) == len(piece):
            return count[1:]
        out, n = [], 0
        for c in piece:
            n += len(c.encode("utf-8", "surrogatepass"))
            out.append(count[n])
        return out

    def _counts(self, text: str) -> list[int]:
        """Tokens of text[:1], text[:2] and so on, for a text without special tokens."""
        out, base, space = [], 0, None
        for piece in self.pieces(text):
            counts = self.piece_counts(piece)
            places = [base + c for c in counts]
            if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                # 're, 've, 'll: without its last letter it is an apostrophe and a letter.
                places[1] = places[0] + self.piece_counts(piece[1])[0]
            if space and piece[0].isspace():
                # A run of white space before a word is split ahead of its last character; a text that ends with the
                # run isn't.
                places[0] = space[0] + self.piece_counts(space[1] + piece[0])[-1]
            out += places
            space = (base, piece) if piece.isspace() else None
            base += counts[-1]
        return out

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()

    def _chunk_steps(self, chunk: str) -> bytes:
        if "'" in chunk:
            return self._steps(self._counts(" " + chunk))
        # No white space follows another in it, so the steps of its pieces follow each other.
        pieces = self.pieces(" " + chunk)
        return self.piece_steps[pieces[0]] if len(pieces) == 1 else b"".join(map(self.piece_steps.__getitem__, pieces))

    def _odd_counts(self, text: str) -> list[int] | None:
        """Counts of a text whose chunks can't be taken one by one; None for all others."""
        if self.at_special and self.at_special.search(text):
            return self._special_counts(text)
        if any(c in text for c in ODD_SPACE) or self.double_space(text):
            return self._counts(text)
        return None

    def text_steps(self, text: str) -> bytes:
        """One signed byte for each character: how many tokens the text has more up to and with it."""
        odd = self._odd_counts(text)
        if odd is not None:
            return self._steps(odd)
        head, *chunks = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.steps.__getitem__, chunks))

    def _special_counts(self, text: str) -> list[int]:
        """A special token's string is one token; up to its last character it is text like other text."""
        out, base, at = [], 0, 0
        for m in self.at_special.finditer(text):
            before = text[at:m.start()]
            counts = self._counts(before)
            out += [base + c for c in counts]
            out += [base + self._counts(before + m[0][:n])[-1] for n in range(1, len(m[0]))]
            base += (counts[-1] if counts else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self._counts(text[at:])]


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, steps): ``steps`` holds the token count of every prefix (see ``tokens_of``).

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. Null and empty texts have no
    token; rows that repeat are counted each; any length of text is taken whole. Other columns are ignored.
    """
    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            steps = [own.text_steps(text) for text in all_texts]
            # The whole text is its own longest prefix.
            tokens = pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64())
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(len, all_texts), pa.int64()), tokens, pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])

    source = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, steps binary")


def tokens_of(steps: bytes, n_chars: int | None = None) -> int:
    """Tokens of the first ``n_chars`` characters (of all, if None)."""
    return sum(array("b", steps if n_chars is None else steps[:n_chars]))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    total, best = 0, 0
    for n, step in enumerate(array("b", steps), 1):
        total += step
        if total <= budget:
            best = n
    return best


def truncated(counted: DataFrame, budget: int) -> DataFrame:
    """``counted`` (what ``prefix_counts`` gives) with ``fits_chars``: how many characters a budget of tokens leaves."""
    def run(batches):
        for batch in batches:
            fits = pa.array([longest_prefix(s, budget) for s in batch.column("steps").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fits], names=[*batch.schema.names, "fits_chars"])

    return counted.mapInArrow(run, T.StructType([*counted.schema.fields, T.StructField("fits_chars", T.LongType())]))


def over_limit(n_tokens: Column, limit: int) -> Column:
    return n_tokens > limit
