"""Language-model scoring by a hidden Markov model: Baum-Welch over all training texts, scaled forward recursion.

Words are tied to classes by a hash, so the model's size is fixed: a state emits a class, and a class its words by their
smoothed counts. P(word | state) = P(class | state) * P(word | class), where each class keeps a share for one word that was
never seen. Word counts grow with the corpus and stay in tables; only the class model is collected and sent out."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ionframe.llm import common

STATES = 8
#: Word classes; the class after the last is the end of a text.
CLASSES = 1 << 14
ROUNDS = 5
FOLDS = 10
#: Pseudo-count of each word and of the unknown one, as in the base score.
ADDED = 0.1
#: Weight of the class shares of all states together in a state's own.
SMOOTHING = 50.0
#: Tokens whose words share one dictionary, and tokens that are recursed over at a time.
BLOCK, STRIP = 3_000_000, 400_000
#: Words whose counts travel in one row.
CHUNK = 16_384

_BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("places", pa.binary()), ("classes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
])


def class_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % CLASSES


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def blocks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per block of documents of a task: their ids, folds and lengths in words, the places of all their words in the
    block's dictionary, and that dictionary with classes and counts in training texts."""

    def row(number: int, ids: list, held: list, texts: list, places: _Places) -> pa.RecordBatch:
        train = [p for p, out in zip(texts, held) if not out]
        counts = np.bincount(np.concatenate(train), minlength=len(places)) if train else np.zeros(len(places), np.int64)
        every = np.concatenate(texts) if texts else np.empty(0, np.int32)
        words = list(places)
        classes = np.fromiter(map(class_of, words), np.uint16, len(words))
        values = [number, ids, held, [len(t) for t in texts], every.tobytes(), classes.tobytes(), words, counts]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _BLOCKS)], schema=_BLOCKS)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, held, texts, places = [], [], [], _Places()
        for batch in common.in_slices(batches):
            for key, out, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = common.words(common.ascii_lower(body))
                ids.append(key)
                held.append(out)
                texts.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                size += len(words) + 1
                if size >= BLOCK:
                    yield row(number, ids, held, texts, places)
                    number, size, ids, held, texts, places = number + 1, 0, [], [], [], _Places()
        if ids:
            yield row(number, ids, held, texts, places)

    fold = F.pmod(common.crc_of(F.col(doc_id)), F.lit(folds))
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), fold == 0, F.col(text).cast("string").alias("text")).mapInArrow(
        rows,
        "block long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, places binary, classes binary, "
        "words array<string>, counts array<long>",
    )


@dataclass
class Model:
    """Start, transition and class probabilities of the states, (states,), (states, states), (states, CLASSES + 1); and
    the log10 share of a word in its class for a count, from the classes' totals."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """States that stay what they are, with the corpus' class shares disturbed by fixed noise to tell them apart."""
    rng = np.random.default_rng(11)
    emits = shares[None, :] * np.exp(rng.normal(0.0, 0.5, (states, len(shares))))
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(1, keepdims=True))


class Strip:
    """Class sequences side by side, longest first; at each step all that still run form one slice."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths.max(initial=0))
        self.running = np.searchsorted(-lengths, -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.running)])
        self.rank = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(self.rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.offset[step] + self.rank
        self.seen = np.empty(len(place), np.int64)
        self.seen[place] = np.concatenate([sequences[k] for k in self.order]) if len(place) else 0
        self.who = np.empty(len(place), np.int64)
        self.who[place] = self.order[self.rank]
        self.before = np.empty(len(place), np.int64)
        self.before[place] = self.offset[np.maximum(step - 1, 0)] + self.rank
        self.bounds = list(zip(self.offset[:-1].tolist(), self.running.tolist()))

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission probabilities, state probabilities given the past, and the scale of each step: the probability of
        what is seen there given all before it. A sequence's likelihood is the product of its scales."""
        emitted = model.emits.T[self.seen]
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
        ones, past = np.ones(len(model.start)), None
        for at, n in self.bounds:
            here = alpha[at : at + n]
            if past is None:
                here[:] = model.start
            else:
                np.matmul(past[:n], model.moves, out=here)
            here *= emitted[at : at + n]
            total = scale[at : at + n] = here @ ones
            here /= total[:, None]
            past = here
        return emitted, alpha, scale

    def log10(self, scale: np.ndarray, sequences: int) -> np.ndarray:
        return np.bincount(self.who, np.log10(scale), minlength=sequences)

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and class emissions of the states, by the scaled forward and backward recursions."""
        emitted, alpha, scale = self.forward(model)
        ahead = emitted / scale[:, None]  # becomes emission times backward variable over scale
        beta = np.ones_like(emitted)
        back = np.ascontiguousarray(model.moves.T)
        for at, n in reversed(self.bounds[1:]):
            here = ahead[at : at + n]
            here *= beta[at : at + n]
            earlier = self.before[at]
            np.matmul(here, back, out=beta[earlier : earlier + n])
        gamma = alpha * beta
        first = self.bounds[0][1] if self.bounds else 0
        moves = model.moves * (alpha[self.before[first:]].T @ ahead[first:])
        classes = model.emits.shape[1]
        emits = np.stack([np.bincount(self.seen, gamma[:, k], minlength=classes) for k in range(gamma.shape[1])])
        return gamma[:first].sum(0), moves, emits


def strips(lengths: np.ndarray, classes: np.ndarray, chosen: np.ndarray, size: int = STRIP) -> Iterator[tuple[np.ndarray, Strip]]:
    """Strips of the chosen documents of a block, of similar length and about `size` tokens each, the end class added."""
    ends = np.cumsum(lengths)
    order = np.flatnonzero(chosen)
    order = order[np.argsort(-lengths[order], kind="stable")]
    cut = np.cumsum(lengths[order] + 1) // size
    for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1) if len(order) else ():
        yield part, Strip([np.append(classes[ends[k] - lengths[k] : ends[k]], CLASSES).astype(np.int64) for k in part])


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lengths, held_out, places, classes of the places."""
    of = {n: batch.column(n)[row] for n in ("lengths", "held_out", "places", "classes")}
    places = np.frombuffer(of["places"].as_py(), np.int32)
    classes = np.frombuffer(of["classes"].as_py(), np.uint16)
    lengths = of["lengths"].values.to_numpy(zero_copy_only=False)
    return lengths, of["held_out"].values.to_numpy(zero_copy_only=False), places, classes


def counted(staged_blocks: DataFrame) -> DataFrame:
    """(block, place, count, class, first): for each word of each block's dictionary its count in all training texts; `first`
    marks one row of each word. One shuffle by word; a word has at most one row per block."""
    words = staged_blocks.select("block", F.arrays_zip("words", "counts").alias("z")).select("block", F.posexplode("z").alias("place", "z"))
    by_word = Window.partitionBy("word")
    return (
        words.select("block", "place", F.col("z.words").alias("word"), F.col("z.counts").alias("n"))
        .withColumn("count", F.sum("n").over(by_word))
        .withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1)
        .select("block", "place", "count", "first", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(CLASSES)).cast("int").alias("class"))
    )


def _summed(staged_blocks: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Expected counts over all training texts: rows of the emission matrix by class, starts at -1, moves from state k at
    -2 - k. Each task adds up its own; the sums are a table of fixed size."""
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES + 1))]
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, held, places, classes = _unpacked(batch, row)
                for _, strip in strips(lengths, classes[places], ~held.astype(bool)):
                    for sum_, part in zip(total, strip.expected(model)):
                        sum_ += part
        start, moves, emits = total
        values = np.concatenate([start[None, :], moves, emits.T])
        key = np.concatenate([[-1], -2 - np.arange(states), np.arange(CLASSES + 1)])
        some = values.any(axis=1)
        yield pa.record_batch([pa.array(key[some], pa.int32()), *(pa.array(values[some, k]) for k in range(states))], names=["key", *names])

    made = staged_blocks.select("lengths", "held_out", "places", "classes").mapInArrow(
        rows, "key int, " + ", ".join(f"{n} double" for n in names)
    )
    total = made.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).collect()
    return {r["key"]: np.array(r[1:]) for r in total}


def train(staged_blocks: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts, `rounds` times."""
    model = first_model(shares, states)
    for _ in range(rounds):
        sums = _summed(staged_blocks, model)
        nothing = np.zeros(states)
        start = sums.get(-1, nothing) + 1 / states
        moves = np.stack([sums.get(-2 - k, nothing) for k in range(states)]) + 1 / states
        emits = np.stack([sums.get(c, nothing) for c in range(CLASSES + 1)], axis=1) + SMOOTHING * shares
        model = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Trains on documents whose crc32(doc_id as text) mod `folds` is not 0. Tokens are the words, A-Z in lower case, and one
    end; null and empty texts are an end alone. Whole texts of any length; each row is a text, repeated or not. Without
    training documents every token is unknown and both scores follow from the pseudo-counts alone. A null doc_id is in the fold
    of the empty text."""
    made = common.staged(blocks(documents, doc_id, text, folds))
    words = common.staged(counted(made))
    totals = words.where("first").groupBy("class").agg(
        F.sum("count").alias("tokens"), F.sum((F.col("count") > 0).cast("long")).alias("types")
    ).collect()  # at most CLASSES rows
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        tokens[r["class"]], types[r["class"]] = r["tokens"], r["types"]
    ended = made.select(F.sum(F.size(F.filter("held_out", lambda h: ~h))).alias("n")).first()["n"] or 0
    n_train, n_types = int(tokens.sum()) + ended, int(types.sum()) + (ended > 0)
    weight = np.append(tokens + ADDED * (types + 1), ended + ADDED)
    model = train(made, weight / weight.sum(), states, rounds)
    in_class = tokens + ADDED * (types + 1)
    whole = n_train + ADDED * (n_types + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, np.empty(0, np.int64)
        for batch in (part for whole_batch in batches for part in common.sorted_groups([whole_batch], ("block",))):
            if batch.column("block")[0].as_py() != block:
                block, counts = batch.column("block")[0].as_py(), np.empty(0, np.int64)
            for known in batch.column("known"):
                if known.is_valid:
                    counts = np.concatenate([counts, known.values.to_numpy()])
            full = batch.filter(batch.column("doc_ids").is_valid())
            for row in range(full.num_rows):
                lengths, held, places, classes = _unpacked(full, row)
                c = counts[: len(classes)]
                base = np.log10((c + ADDED) / whole)[places]
                within = np.log10((c + ADDED) / in_class[classes])[places]
                who = np.repeat(np.arange(len(lengths)), lengths)
                n = len(lengths)
                likely = np.bincount(who, within, minlength=n)
                for part, strip in strips(lengths, classes[places], np.ones(n, bool)):
                    likely[part] += strip.log10(strip.forward(model)[2], len(part))
                columns = [
                    full.column("doc_ids")[row].values, pa.array(held.astype(bool)), pa.array(lengths + 1),
                    pa.array(np.bincount(who, (c > 0)[places], minlength=n).astype(np.int64) + int(ended > 0)),
                    pa.array(np.full(n, n_train, np.int64)),
                    pa.array(np.bincount(who, base, minlength=n) + np.log10((ended + ADDED) / whole)), pa.array(likely),
                ]
                yield pa.record_batch(columns, names=names)

    # Counts travel as a few arrays per block, in the order of the places, which have no gaps.
    chunk = F.floor(F.col("place") / F.lit(CHUNK)).cast("int").alias("chunk")
    in_order = F.array_sort(F.collect_list(F.struct("place", "count")))
    known = words.groupBy("block", chunk).agg(in_order.alias("z")).select("block", "chunk", F.col("z.count").alias("known"))
    texts = made.drop("words", "counts")
    together = known.unionByName(texts, allowMissingColumns=True)
    together = together.repartition("block").sortWithinPartitions("block", F.col("chunk").asc_nulls_last())
    return together.mapInArrow(
        rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
