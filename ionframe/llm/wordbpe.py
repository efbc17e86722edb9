"""Byte-pair encoding for a `tokenizers` file with word ends: normalising, splitting, merging, decoding.

The file's path is a parameter; nothing is trained. Texts are cut at white space, and each piece's result is remembered,
because corpora repeat their words."""

from __future__ import annotations

import functools
import gc
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable

import regex

from ionframe.llm.common import Cache

#: Python's str.split() and str.lower() differ from the file's rules on these.
_EXACT_PATH = "\x1c\x1d\x1e\x1fΣ"

#: Marks that the pattern takes alone after a word of letters, when nothing follows.
_MARKS = frozenset(".,!?;:")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes get the characters from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """The parts of one tokenizer file that encoding needs. Understands files whose normaliser is NFC, white space to
    one space, lower case; which split by one pattern; and whose BPE marks word ends by a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"]["pretokenizers"][0]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {
            (self.vocabulary[a], self.vocabulary[b]): (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")

    def normalised(self, text: str) -> str:
        """NFC, every run of white space one space, each character's own lower case (no final-sigma rule)."""
        text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def spelled(self, word: str) -> str:
        """A word in the vocabulary's byte letters; printable ASCII stands for itself."""
        if word.isascii() and word.isalnum():
            return word
        return "".join(self.letters[b] for b in word.encode("utf-8", "surrogatepass"))

    def merge(self, word: str) -> list[int]:
        """The ids of one word of the pattern.

        Symbols form a doubly linked list; a heap holds (rank, position) of each adjacent pair that may merge. An entry
        is stale, and skipped, when the pair at its position is no longer the one it was made for."""
        spelled = self.spelled(word)
        symbols = [self.vocabulary[c] for c in spelled[:-1]] + [self.vocabulary[spelled[-1] + self.suffix]]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found is not None:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = right[i]
            if symbols[i] < 0 or j >= n or merges.get((symbols[i], symbols[j])) != (rank, merged):
                continue
            symbols[i], symbols[j] = merged, -1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                found = merges.get((merged, symbols[after]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))
            before = left[i]
            if before >= 0:
                found = merges.get((symbols[before], merged))
                if found is not None:
                    heapq.heappush(heap, (found[0], before, found[1]))
        return [s for s in symbols if s >= 0]

    @functools.cached_property
    def spellings(self) -> list[str]:
        """The vocabulary's strings by id, added tokens included."""
        names = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        return [names.get(i, "") for i in range(max(names) + 1)]


class TextEncoder:
    """Encodes whole texts; `merge` gives a word's ids. Ids come as little-endian unsigned 32-bit numbers in bytes.

    Memory is two bounded caches: by piece between white space, and by word of the pattern."""

    def __init__(self, bpe: WordBpe, merge: Callable[[str], list[int]] | None = None, size: int = 250_000):
        self.bpe = bpe
        merge = merge or bpe.merge
        self.by_word = Cache(lambda word: packed(merge(word)), size, 48)
        self.by_piece = Cache(self._piece, size, 48)

    def forget(self) -> None:
        """Empties the caches."""
        self.by_word.forget()
        self.by_piece.forget()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.by_word[piece]
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return self.by_word[piece[:-1]] + self.by_word[piece[-1]]
        return b"".join(map(self.by_word.__getitem__, self.bpe.pattern.findall(piece)))

    def _plain(self, text: str) -> bytes:
        """A text without special strings."""
        if any(c in text for c in _EXACT_PATH):
            return self._piece(self.bpe.normalised(text))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.by_piece.__getitem__, text.lower().split()))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty. Special strings in the text become their own ids."""
        if not text:
            return b""
        if not any(s in text for s in self.bpe.special):
            return self._plain(text)
        out, end = [], 0
        for found in self.bpe.special_pattern.finditer(text):
            out += [self._plain(text[end : found.start()]), packed([self.bpe.special[found.group()]])]
            end = found.end()
        return b"".join([*out, self._plain(text[end:])])


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def unpacked(ids: bytes) -> array:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(2)
def encoder(path: str) -> TextEncoder:
    """This process's encoder by linked-list merging."""
    return TextEncoder(load(path))


@functools.lru_cache(2)
def library_encoder(path: str, size: int = 250_000) -> TextEncoder:
    """This process's encoder whose words go through the `tokenizers` library's own BPE model; each cache remembers `size` words
    in a generation."""
    from tokenizers import Tokenizer

    bpe, model = load(path), Tokenizer.from_file(path).model
    return TextEncoder(bpe, lambda word: [t.id for t in model.tokenize(bpe.spelled(word))], size)


def unload() -> None:
    """Drops what this process holds of tokenizer files."""
    for held in (load, encoder, library_encoder):
        held.cache_clear()
    gc.collect()
