"""Substring deduplication: suffix automata of reference runs, whose matching statistics tell who holds a window first.

Only passages that can repeat are indexed and streamed. Each window of WINDOW words has an anchor, the least hash among its
runs of ANCHOR words; equal windows have equal anchors, so a window can recur only under an anchor that two documents share.
Consecutive windows with one anchor are a run. The distinct runs under an anchor are its reference: an automaton is built of
them and each of them is read by it. Where an anchor has more than SHARD distinct runs (a frequent line, each time with other
words around it), all against all would grow with the square of their number; there each window is known by the hash of its
words, and the smallest document is found per hash, in rows that grow with the text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common
from ionframe.llm.minhash import _mixed, word_hash

WINDOW = 50
ANCHOR = 10
#: Distinct runs in one automaton at most; a run has less than twice WINDOW words.
SHARD = 1024
#: Bytes of text that a worker takes apart at a time.
SLICE = 1 << 20
#: Positions take this many low bits where hash and position are compared as one number.
_PLACE = 24

_RUNS = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.string()),
    ("anchor", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()),
])


class SuffixAutomaton:
    """A suffix automaton of several sequences, each with a document number; knows the smallest one of each substring."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]
        self.closed = False

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A state for the strings of `target` that are no longer than those of `state` and the symbol."""
        clone = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = clone
        moves = self.next
        while state >= 0 and moves[state].get(symbol) == target:
            moves[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, symbols: list[int], document: int) -> None:
        moves, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for symbol in symbols:
            target = moves[last].get(symbol)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, symbol, target)
            else:
                state, own = last, self._state({}, 0, length[last] + 1)
                while state >= 0 and symbol not in moves[state]:
                    moves[state][symbol] = own
                    state = link[state]
                if state >= 0:
                    target = moves[state][symbol]
                    link[own] = target if length[target] == length[state] + 1 else self._split(state, symbol, target)
                last = own
            if least[last] is None or document < least[last]:
                least[last] = document

    def close(self) -> None:
        """Carries documents from longer to shorter strings; then matching may begin."""
        least, link = self.least, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if least[up] is None or least[state] < least[up]:
                least[up] = least[state]

    def firsts(self, symbols: list[int], window: int) -> list[int | None]:
        """For each window of a sequence, the smallest document that holds it, or None: where the matching statistic
        (the longest suffix read so far that occurs here) reaches the window's length."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[int | None] = []
        for place, symbol in enumerate(symbols):
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            target = moves[state].get(symbol)
            if target is not None:
                state, matched = target, matched + 1
            while length[link[state]] >= window if state else False:
                state = link[state]
            matched = min(matched, max(length[state], 0))
            if place >= window - 1:
                out.append(self.least[state] if matched >= window else None)
        return out


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of each window of a sequence of word hashes: the leftmost least."""
    grams = np.zeros(len(hashes) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = _mixed(grams ^ hashes[k : k + len(grams)])
    width, n = window - anchor + 1, len(hashes) - window + 1
    place = np.empty(n, np.int64)
    most = (1 << _PLACE) - width
    for begin in range(0, n, most):
        part = grams[begin : begin + most + width - 1]
        least = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(part) - width + 1], least[width - reach :][: len(part) - width + 1])
        place[begin : begin + len(least)] = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + begin
    return place, grams[place]


def runs_of(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(anchor hash, first window, windows, content hash) of the runs of a sequence of at least `window` words."""
    place, value = anchors(hashes, window, anchor)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(start, len(place)))
    raw = hashes.tobytes()
    ends = (start + count + window - 1).tolist()
    content = [xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in zip(start.tolist(), ends)]
    return value[start], start, count, content


def _hashes(words: list[str], memory: common.Cache) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, text; the key tells rows of one doc_id apart, equal rows are one."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))


def runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each document one row without anchor (doc_id, text_key, n_words, words_sha256) and one row per run."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(word_hash)
        for batch in common.in_slices(batches, SLICE):
            keys, text_keys, bodies = (batch.column(i) for i in range(3))
            counts, digests, found, owners = [], [], [], []
            for row, (key, body) in enumerate(zip(keys.to_pylist(), bodies.to_pylist())):
                words = common.words(body)
                counts.append(len(words))
                digests.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
                if len(words) >= window and key is not None:
                    value, start, count, content = runs_of(_hashes(words, memory), window, anchor)
                    found.append((value, np.array(content, np.uint64), start.astype(np.int32), count.astype(np.int32)))
                    owners.append(np.full(len(start), row))
            none = pa.nulls(batch.num_rows)
            columns = [keys, text_keys, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), none, none, none, none]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)
            if found:
                value, content, start, count = map(np.concatenate, zip(*found))
                owner = pa.array(np.concatenate(owners))
                none = pa.nulls(len(owner))
                columns = [keys.take(owner), text_keys.take(owner), none, none, *map(pa.array, (value.view(np.int64), content.view(np.int64), start, count))]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)

    return _texts(documents, doc_id, text).mapInArrow(
        rows, "doc_id long, text_key long, n_words long, words_sha256 string, anchor long, content long, start int, windows int"
    )


def references(found: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, text_key, start, windows, crowded): the distinct runs under anchors of at least two
    documents, each with the smallest document that holds it, and whether its anchor has more than SHARD of them."""
    distinct = found.where("anchor is not null").groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("at"), F.max("doc_id").alias("last")
    )
    shared = distinct.groupBy("anchor").agg(
        F.min("at.doc_id").alias("low"), F.max("last").alias("high"), (F.count(F.lit(1)) > SHARD).alias("crowded")
    ).where("low < high").select("anchor", "crowded")
    return distinct.join(shared, "anchor").select("anchor", "content", "at.*", "crowded")


def _cut_out(references: DataFrame, texts: DataFrame, window: int, each_window: bool) -> DataFrame:
    """(anchor, content, doc_id, place, words): the word hashes of each reference run, cut out of its text, or, for each
    of its windows, 16 bytes that stand for them."""
    wanted = references.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "start", "windows")).alias("runs"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(word_hash)
        for batch in common.in_slices(batches, SLICE):
            out: list[list] = [[], [], [], [], []]
            for key, body, wanted_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = memoryview(_hashes(common.words(body), memory).tobytes())
                for run in wanted_:
                    start, n = run["start"], run["windows"]
                    if each_window:
                        cut = [xxhash.xxh3_128_digest(raw[8 * s : 8 * (s + window)]) for s in range(start, start + n)]
                    else:
                        cut = [bytes(raw[8 * start : 8 * (start + n + window - 1)])]
                    k = len(cut)
                    for column, values in zip(out, ([run["anchor"]] * k, [run["content"]] * k, [key] * k, range(k), cut)):
                        column.extend(values)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "content", "doc_id", "place", "words"])

    joined = texts.dropDuplicates(["doc_id", "text_key"]).join(wanted, ["doc_id", "text_key"]).select("doc_id", "text", "runs")
    return joined.mapInArrow(rows, "anchor long, content long, doc_id long, place int, words binary")


def sequences(references: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, content, doc_id, words): the word hashes of each reference run, cut out of its text."""
    return _cut_out(references, texts, window, False).drop("place")


def windows_of(references: DataFrame, texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, content, doc_id, place, words): a row for each window of each reference run, known by a hash of its words."""
    return _cut_out(references, texts, window, True)


def first_holders(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, content, begin, windows, first): for stretches of windows of each run, the smallest document that
    holds them. One automaton holds all runs of one anchor, SHARD at most, and reads each of them."""
    dealt = sequences.repartition("anchor").sortWithinPartitions("anchor")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, ("anchor",)):
            anchor = group.column("anchor")[0].as_py()
            automaton, streams = SuffixAutomaton(), []
            for key, words in zip(group.column("doc_id").to_pylist(), group.column("words")):
                automaton.add(np.frombuffer(words.as_buffer(), np.uint64).tolist(), key)
            automaton.close()
            for content, words in zip(group.column("content").to_pylist(), group.column("words")):
                firsts = automaton.firsts(np.frombuffer(words.as_buffer(), np.uint64).tolist(), window)
                begin = 0
                for k in range(1, len(firsts) + 1):
                    if k == len(firsts) or firsts[k] != firsts[begin]:
                        if firsts[begin] is not None:
                            streams.append((anchor, content, begin, k - begin, firsts[begin]))
                        begin = k
            if streams:
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*streams), kinds)], names=["anchor", "content", "begin", "windows", "first"]
                )

    return dealt.mapInArrow(rows, "anchor long, content long, begin int, windows int, first long")


def first_holders_by_window(references: DataFrame, windows: DataFrame) -> DataFrame:
    """What first_holders gives, from rows of single windows: each run with its own smallest document, and the stretches
    of it that a smaller document holds in another run."""
    least = windows.groupBy("anchor", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    earlier = windows.join(least.drop("last"), ["anchor", "words"]).where("first < doc_id")
    # A run has less than WINDOW windows, so its places are a short list; in a stretch they grow with their numbers.
    placed = earlier.groupBy("anchor", "content", "first").agg(F.sort_array(F.collect_set("place")).alias("places"))
    stretches = (
        placed.select("anchor", "content", "first", F.posexplode("places").alias("number", "place"))
        .groupBy("anchor", "content", "first", (F.col("place") - F.col("number")).alias("stretch"))
        .agg(F.min("place").alias("begin"), F.count(F.lit(1)).cast("int").alias("windows"))
    )
    own = references.select("anchor", "content", F.lit(0).alias("begin"), "windows", F.col("doc_id").alias("first"))
    return own.union(stretches.select(own.columns))


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, texts). rows: doc_id, text_key, n_words, words_sha256 of every document. spans: doc_id, text_key,
    spans (array of begin, end word positions, may overlap) of the documents with words to remove: those covered by a
    window of `window` words that also starts in a document with a smaller doc_id, judged on the input. texts: doc_id,
    text_key, text of documents that share an anchor; it holds all that have spans.

    Words are runs of anything but ASCII white space, unchanged. Null and empty texts have none. A text shorter than a
    window, and a row without doc_id, lose nothing and take nothing from others. Rows of one doc_id do not remove each
    other's words; equal rows lose the same."""
    found = common.staged(runs(documents, doc_id, text, window, anchor))
    known = common.staged(references(found))
    of_runs = found.where("anchor is not null")
    shared = known.select("anchor").distinct()
    sharing = of_runs.join(shared, "anchor", "left_semi").select("doc_id", "text_key").distinct()
    texts = common.staged(_texts(documents, doc_id, text).join(sharing, ["doc_id", "text_key"], "left_semi"))
    pieces = first_holders(sequences(known.where("not crowded"), texts, window), window)
    crowded = known.where("crowded")
    if not crowded.isEmpty():
        pieces = pieces.union(first_holders_by_window(crowded, common.staged(windows_of(crowded, texts, window))))
    covered = of_runs.select("doc_id", "text_key", "anchor", "content", "start").join(
        pieces, ["anchor", "content"]
    ).where("first < doc_id")
    begin = F.col("start") + F.col("begin")
    spans = covered.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct(begin.alias("begin"), (begin + F.col("windows") + window - 1).alias("end"))).alias("spans")
    )
    return found.where("anchor is null").select("doc_id", "text_key", "n_words", "words_sha256"), spans, texts


def kept_marks(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words no span covers."""
    change = np.zeros(n + 1, np.int64)
    for span in spans:
        change[span["begin"]] += 1
        change[span["end"]] -= 1
    return np.cumsum(change[:-1]) == 0


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows, spans, texts = repeats(documents, doc_id, text)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, SLICE):
            removed, shas = [], []
            for body, spans_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = common.words(body)
                marks = kept_marks(len(words), spans_)
                kept = " ".join([w for w, k in zip(words, marks.tolist()) if k])
                removed.append(len(words) - int(marks.sum()))
                shas.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                                  names=["doc_id", "text_key", "n_removed", "kept_sha256"])

    changed = (
        texts.dropDuplicates(["doc_id", "text_key"]).join(spans, ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "spans")
        .mapInArrow(cut, "doc_id long, text_key long, n_removed long, kept_sha256 string")
    )
    return rows.join(changed, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their text, other columns as they are. A text that loses nothing
    stays as it was, to the character; from others the covered words go with the white space after them."""
    _, spans, _ = repeats(documents, doc_id, text)

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            both = zip(texts.to_pylist(), marks.to_pylist())
            yield pa.array([b if s is None else cut_text(b, s) for b, s in both], pa.string())

    key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    names = documents.columns
    marked = documents.withColumn("__text_key", key).join(
        spans.select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")),
        (F.col(doc_id).cast("long") == F.col("__doc_id")) & (F.col("__text_key") == F.col("__key")), "left",
    )
    return marked.withColumn(text, cut(F.col(text), F.col("__spans"))).select(*names)


def cut_text(body: str, spans: list[dict]) -> str:
    places = [m.span() for m in common.WORD.finditer(body)]
    marks = kept_marks(len(places), spans).tolist()
    ends = [p[0] for p in places[1:]] + [len(body)]
    return body[: places[0][0]] + "".join(body[begin:end] for (begin, _), end, keep in zip(places, ends, marks) if keep)
