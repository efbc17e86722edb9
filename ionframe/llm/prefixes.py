"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common
from ionframe.llm.wordbpe import byte_letters

#: The splitting rule of byte-level files (fixed by the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Parts of a text whose tokens, and those of their prefixes, do not depend on what stands before: white space with
#: all that follows up to the next white space.
_PART = regex.compile(r"\s*\S+|\s+")
_WORD = regex.compile(PATTERN)
_TOUCHING = ("  ", " \n", "\n ", "\t", "\r", "\v", "\f")
_RARE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STEPS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("steps", pa.binary())])


_BLANK = regex.compile(r"\s*")
#: Marks that are a token of their own after letters, when nothing follows.
_MARKS = frozenset(".,!?;:")


def steps_of(counts: list[int]) -> bytes:
    """Differences of successive counts, the first from 0, as signed bytes."""
    steps = [after - before for before, after in zip([0, *counts], counts)]
    if steps and (min(steps) < -128 or max(steps) > 127):
        raise OverflowError("a prefix's count changes by more than a signed byte holds")
    return bytes([s & 255 for s in steps])


def counts_of(steps: bytes) -> list[int]:
    return list(accumulate(s - 256 if s > 127 else s for s in steps))


class PrefixCounter:
    """For one byte-level BPE file: token counts of all prefixes of a text."""

    def __init__(self, path: str, size: int = 250_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        back = {c: b for b, c in enumerate(byte_letters())}
        spelled = lambda token: bytes(back[c] for c in token)
        pairs = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append((a, b))
        #: Symbols are numbered by rank: single bytes first, then merges in their order.
        self.symbols: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        for a, b in pairs:
            token = spelled(a + b)
            self.halves.append((self.symbols[spelled(a)], self.symbols[spelled(b)]))
            self.symbols.setdefault(token, len(self.halves) - 1)
        self.joined = {pair: n for n, pair in enumerate(self.halves) if n >= 256}
        self.tokens = {token: n for token, n in self.symbols.items() if self._whole(n)}
        self.longest = max(map(len, self.tokens))
        self.special = [t["content"] for t in file["added_tokens"]]
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special) or "(?!)")
        self.fit: dict[tuple[int, int], bool] = {}
        self.by_word = common.Cache(self._word_steps, size, 48)
        self.by_part = common.Cache(self._part_steps, size, 48)
        self.by_chunk = common.Cache(self._chunk_steps, size, 48)

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when merged together.

        Their derivations are unrolled along the touching edges, latest merge first. If the symbols that touch are a pair
        with a rank below those at which the outer symbols arise, that merge would have come first. Among equal ranks
        the left one is merged first, so b's side bears one rank more."""
        until = 1 << 60
        while self.joined.get((a, b), until) >= until:
            if max(a, b) < 256:
                return True
            if a > b:
                until, a = a, self.halves[a][1]
            else:
                until, b = b + 1, self.halves[b][0]
        return False

    def _whole(self, token: int) -> bool:
        """Whether a symbol's bytes encode to the symbol itself: its halves stay apart until its own merge."""
        a, b = self.halves[token]
        if a < 0:
            return True
        own = self.joined.pop((a, b))
        apart = self._fits(a, b)
        self.joined[a, b] = own
        return apart and self._whole(a) and self._whole(b)

    def counts(self, word: bytes) -> list[int]:
        """Tokens of word[:1], word[:2], ... as one word: the prefix ends in the one token that fits after the last
        token of what is left of it."""
        n, token_of, fit_of = len(word), self.tokens.get, self.fit.get
        last, count = [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            token = token_of(word[:end])
            if token is not None:
                last[end], count[end] = token, 1
                continue
            for start in range(max(1, end - self.longest), end):
                token = token_of(word[start:end])
                if token is None:
                    continue
                pair = last[start], token
                fits = fit_of(pair)
                if fits is None:
                    fits = self._learn(pair)
                if fits:
                    last[end], count[end] = token, count[start] + 1
                    break
        return count[1:]

    def _learn(self, pair: tuple[int, int]) -> bool:
        if len(self.fit) > 1_000_000:
            self.fit.clear()
        fits = self.fit[pair] = self._fits(*pair)
        return fits

    def _word_steps(self, word: str) -> bytes:
        """Steps of one word of the pattern, counted at each character's end."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.counts(raw)
        if len(raw) > len(word):
            counts = [c for c, after in zip(counts, [*raw[1:], 0]) if after & 0xC0 != 0x80]
        return steps_of(counts)

    def _part_steps(self, part: str) -> bytes:
        """Changes of the count from character to character of a part, as signed bytes."""
        start = part[:1] == " "
        if part[start:].isalpha():
            return self.by_word[part]
        if part[-1:] in _MARKS and part[start:-1].isalpha():
            return self.by_word[part[:-1]] + b"\x01"
        return self._general(part)

    def _general(self, part: str) -> bytes:
        """Steps of any part, word by word; a prefix that ends in white space, or within a contraction, splits otherwise
        than the whole, so those are counted on their own."""
        blank = _BLANK.match(part).end()
        counts = counts_of(self.by_word[part[:blank]]) if blank else []
        before = 0
        for found in _WORD.finditer(part):
            word, start = found.group(), found.start()
            own = counts_of(self.by_word[word])
            for k in range(max(start, blank), found.end()):
                inner = word[: k - start + 1]
                if inner[0] == "'" and 1 < len(inner) < len(word) and inner[1].isalpha():
                    counts.append(before + sum(counts_of(self.by_word[w])[-1] for w in _WORD.findall(inner)))
                else:
                    counts.append(before + own[k - start])
            before += own[-1]
        return steps_of(counts)

    def steps(self, text: str) -> bytes:
        """For each character of a text, by how much the token count of the prefix that ends there differs from that of
        the prefix before, as signed bytes. Special strings in a text count one token from their last character on."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out, end = [], 0
        for found in self.special_pattern.finditer(text):
            before, whole = self._plain(text[end : found.start()]), found.group()
            inner = self._plain(text[end : found.end() - 1])[len(before) :]
            partial = int(np.frombuffer(inner, np.int8).sum(dtype=np.int64))
            out += [before, inner, steps_of([1 - partial])]
            end = found.end()
            assert len(whole) == len(inner) + 1
        return b"".join([*out, self._plain(text[end:])])

    def _chunk_steps(self, chunk: str) -> bytes:
        """Steps of a chunk that one space precedes."""
        if chunk.isalpha():
            return self.by_word[" " + chunk]
        return b"".join(map(self._part_steps, _PART.findall(" " + chunk)))

    def _plain(self, text: str) -> bytes:
        """Steps of a text without special strings: by chunks between single spaces where no other white space touches
        those spaces, else by parts."""
        if any(c in text for c in _TOUCHING) or not text.isascii() and any(c in text for c in _RARE_SPACE):
            return b"".join(map(self.by_part.__getitem__, _PART.findall(text)))
        first, *rest = text.strip(" ").split(" ")
        head, tail = text[:1] == " ", text[1:][-1:] == " "
        if head:
            first, rest = "", [first, *rest]
        steps = [*map(self.by_part.__getitem__, _PART.findall(first)), *map(self.by_chunk.__getitem__, rest)]
        if tail:
            steps += [self.by_part[" "]]
        return b"".join(steps)


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, steps (binary: one signed byte per character, whose
    running sum is the exact token count of the prefix that ends there). Null texts count as empty: no steps. Whole texts
    of any length; rows are independent, so repeated rows and null doc_ids come back as they are."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in common.in_slices(batches):
            sizes, totals, steps = [], [], []
            for body in batch.column(1).to_pylist():
                body = body or ""
                step = count.steps(body)
                sizes.append(len(body.encode("utf-8", "surrogatepass")))
                totals.append(int(np.frombuffer(step, np.int8).sum(dtype=np.int64)))
                steps.append(step)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(steps, pa.binary())],
                schema=_STEPS,
            )

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        rows, "doc_id long, n_bytes long, n_tokens long, steps binary"
    )


def count_at(steps: bytes, characters: int) -> int:
    """Tokens of the first `characters` characters."""
    return int(np.frombuffer(steps, np.int8)[:characters].sum(dtype=np.int64))


def cut_at(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0


def truncate(documents: DataFrame, counted: DataFrame, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text cut to the longest prefix within the budget, n_tokens of it; nothing is encoded again. Joined by
    doc_id, which must be unique; a null doc_id gives no row, a null text stays null with no tokens."""

    @F.pandas_udf("characters long, n_tokens long")
    def cut(steps: pd.Series) -> pd.DataFrame:
        ends = [cut_at(s, budget) for s in steps]
        return pd.DataFrame({"characters": ends, "n_tokens": [count_at(s, e) for s, e in zip(steps, ends)]})

    found = counted.select(F.col("doc_id").alias("__key"), cut("steps").alias("__cut"))
    return (
        documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
        .join(found, F.col("doc_id") == F.col("__key"))
        .select(
            "doc_id",
            F.substring(F.col("__text"), F.lit(1), F.col("__cut.characters").cast("int")).alias("text"),
            F.col("__cut.n_tokens").alias("n_tokens"),
        )
    )
