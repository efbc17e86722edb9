"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers from confirmed toxic texts and plain text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common

#: Features are hashed to this many numbers.
FEATURES = 1 << 26
#: Word starts of these lengths are features beside the whole word.
STARTS = (3, 4, 5)
#: Bytes of text that a worker scores at a time.
SLICE = 1 << 20
#: Words that a worker remembers in a generation when it counts features and when it scores; and where other stages need the memory.
REMEMBERED, FEWER = (100_000, 200_000), (50_000, 100_000)
#: At most so many features get a weight, those whose shares differ by so many standard deviations.
SELECTED, SURPRISE = 4_000, 3.0


def features_of(word: str) -> tuple[int, ...]:
    """Numbers of a lower-case word's features: the word without marks at its ends, and how it starts."""
    bare = word.strip("\"'`.,;:!?()[]{}<>*#$%&_-+=/\\|~^")
    if not bare:
        return ()
    names = ["=" + bare, *(bare[:n] for n in STARTS if len(bare) > n)]
    return tuple(zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES for name in names)


def document_features(text: str | None, memory: dict | None = None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    find = features_of if memory is None else memory.__getitem__
    out: set[int] = set()
    out.update(*map(find, set(common.words((text or "").lower()))))
    return np.array(sorted(out), np.int32)


@dataclass
class Model:
    """A linear classifier: sigmoid of bias plus the weights of the features present."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def margin(self, hits: Iterable[int]) -> float:
        return self.bias + sum(sorted(self.weights[f] for f in hits))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def counts_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of some documents and in how many of these they are."""
    return np.unique(np.concatenate([np.zeros(0, np.int32), *sets]), return_counts=True)


def telling(in_p, in_u, n_p: int, n_u: int, greatest=np.maximum, root=np.sqrt):
    """By how many standard deviations a feature's share among positives differs from that in unlabelled text. The greater share
    gives the deviation, so a rare feature is not telling because there is much unlabelled text. For numpy arrays and, with the
    last two arguments, for columns."""
    a, b = in_p / n_p, in_u / n_u
    share = greatest(a, b)
    return (a - b) / (root(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12)


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: np.ndarray | None = None, selected: int = SELECTED,
    surprise: float = SURPRISE, rounds: int = 400, rate: float = 0.03, decay: float = 1e-4,
) -> Model:
    """Fits a classifier on features of confirmed toxic and of unlabelled documents.

    The risk is prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with logistic loss: unlabelled
    text stands for clean text once the toxic share in it, known by the class prior, is taken out. Where that
    difference falls below 0 the model has begun to memorise; then the step goes up its gradient. `features` are those that
    get a weight; without them it is the `selected` most telling ones of these documents, of `surprise` at least. Without positives
    or unlabelled documents the model says the prior's log odds. A prior above 0.5 counts as 0.5 and one below 0.001 as that,
    so that 0.5 is not reached without features that speak for it."""
    prior = min(max(prior, 1e-3), 0.5)
    base = math.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return Model(base)
    ids = np.concatenate([*positive, *unlabelled])
    rows = np.repeat(np.arange(len(positive) + len(unlabelled)), [len(x) for x in (*positive, *unlabelled)])
    names, column = np.unique(ids, return_inverse=True)
    n_p, n_u = len(positive), len(unlabelled)
    if features is None:
        in_p, in_u = (np.bincount(column[side], minlength=len(names)) for side in (rows < n_p, rows >= n_p))
        value = np.abs(telling(in_p, in_u, n_p, n_u))
        keep = np.argsort(-value, kind="stable")[:selected]
        features = names[keep[value[keep] >= surprise]]
    keep = np.flatnonzero(np.isin(names, features))
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    used = place[column] >= 0
    rows, column, n = rows[used], place[column[used]], n_p + n_u
    weights, bias = np.zeros(len(keep)), base
    moments = [np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)]
    own = np.arange(n) < n_p
    for step in range(1, rounds + 1):
        z = bias + np.bincount(rows, weights[column], minlength=n)
        up, down = sigmoid(z), -sigmoid(-z)  # derivatives of the losses of "clean" and of "toxic"
        loss_clean = np.logaddexp(0, z)
        clean_part = loss_clean[~own].mean() - prior * loss_clean[own].mean()
        clean_gradient = np.where(own, -prior * up / n_p, up / n_u)
        slope = np.where(own, prior * down / n_p, 0) + clean_gradient if clean_part >= 0 else -clean_gradient
        gradient = np.append(np.bincount(column, slope[rows], minlength=len(keep)) + decay * weights, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        change = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-6)
        weights -= change[:-1]
        bias -= change[-1]
    return Model(float(bias), {int(f): float(w) for f, w in zip(names[keep], weights)})


def _fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(common.crc_of(doc_id), F.lit(folds))


def train(
    documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int | None = 0, most_positive: int = 3_000,
    most_unlabelled: int = 6_000, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    remembered: int = REMEMBERED[0],
) -> Model:
    """Trains on documents whose crc32(doc_id as text) mod `folds` is not `held_out`; on all where that is None.

    Positives are documents with text that are labelled toxic, unlabelled text is any document; at most `most_positive` and
    `most_unlabelled` of them, the first by a hash of doc_id, so the sample is bounded and the same at every run. The weights are
    fitted on it. Which features get one is told by their shares in these positives and in all rows of training text.
    Rows of a doc_id that share it through repeats are one example. The class prior is the toxic share of all labelled
    rows outside the held-out fold. Conflicting or repeated labels: toxic wins. Null ids, labels and texts take no part."""

    def taught(key: Column) -> Column:
        return F.lit(True) if held_out is None else _fold(key, folds) != held_out

    learn = documents.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).where(
        F.col("__id").isNotNull() & (F.col("__text") != "") & taught(F.col("__id"))
    )
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(toxic).cast("int").alias("__toxic"))
        .where(F.col("__id").isNotNull() & F.col("__toxic").isNotNull() & taught(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__toxic").alias("__toxic"))
    )
    share = known.agg(F.avg("__toxic").alias("prior")).first()["prior"]
    order = F.xxhash64(F.col("__id").cast("string"), F.lit("sample"))
    with_text = learn.select("__id").distinct()
    marked = known.where("__toxic = 1").join(with_text, "__id", "left_semi").select("__id").withColumn("__order", order).orderBy("__order", "__id")
    chosen = marked.limit(most_positive).select("__id", F.lit(True).alias("__positive"))
    plain = with_text.withColumn("__order", order).orderBy("__order", "__id")
    chosen = chosen.union(plain.limit(most_unlabelled).select("__id", F.lit(False)))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(features_of, 50_000)
        for batch in common.in_slices(batches):
            rows = [document_features(t, memory).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["__positive", "__features"])

    examples = (
        learn.join(F.broadcast(chosen), "__id")  # at most both bounds together
        .groupBy("__id", "__positive")
        .agg(F.min("__text").alias("__text"))
        .select("__positive", "__text")
        .mapInArrow(features, "__positive boolean, __features binary")
        .toArrow()
    )
    sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for positive, packed in sorted(zip(examples.column(0).to_pylist(), examples.column(1).to_pylist())):
        sides[positive].append(np.frombuffer(packed, np.int32))
    return fit(sides[True], sides[False], float(share or 0.0), telling_features(learn.select("__text"), sides[True], remembered=remembered))


def telling_features(
    texts: DataFrame, positive: list[np.ndarray], selected: int = SELECTED, surprise: float = SURPRISE, remembered: int = REMEMBERED[0],
) -> np.ndarray:
    """The features whose share among some positives differs most from that in all texts, at most `selected`; equal ones by
    number. Counted by document in tasks and added up by feature; nothing but the selected ones comes to the driver."""
    n_u = texts.count()
    if not positive or not n_u:
        return np.zeros(0, np.int32)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(features_of, remembered)
        for batch in common.in_slices(batches, 4 << 20):
            found = counts_of([document_features(t, memory) for t in batch.column(0).to_pylist()])
            yield pa.record_batch([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64())], names=["__feature", "__n"])
        memory.forget()

    everywhere = texts.mapInArrow(count, "__feature int, __n long").groupBy("__feature").agg(F.sum("__n").alias("__in_u"))
    names, in_p = counts_of(positive)
    known = texts.sparkSession.createDataFrame(pa.table({"__feature": pa.array(names, pa.int32()), "__in_p": pa.array(in_p, pa.int64())}))
    value = F.abs(telling(F.coalesce("__in_p", F.lit(0)), F.col("__in_u"), len(positive), n_u, F.greatest, F.sqrt))
    shares = everywhere.join(known, "__feature", "left").select("__feature", value.alias("__value"))
    best = shares.where(F.col("__value") >= surprise).orderBy(F.desc("__value"), "__feature").limit(selected)
    return np.array([r[0] for r in best.collect()], np.int32)


def score(model: Model, text: Column, remembered: int = REMEMBERED[1]) -> Column:
    """The model's probability that a text is toxic, from its words alone. Whole texts; null and empty ones have no
    features and get the bias' probability."""
    known = frozenset(model.weights)

    @F.arrow_udf("double")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nothing = frozenset()  # one for all words without a weight
        hits = common.Cache(lambda word: known.intersection(features_of(word)) or nothing, remembered)
        for texts in batches:
            margins = []
            for part in common.in_slices([pa.record_batch([texts], names=["text"])], SLICE):
                found = (set(common.words((t or "").lower())) for t in part.column(0).to_pylist())
                margins += [model.margin(frozenset().union(*map(hits.__getitem__, words))) for words in found]
            yield pa.array(sigmoid(np.array(margins, "float64")), pa.float64())
        hits.forget()

    return probabilities(text)


def score_documents(
    documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows are scored each; a null doc_id is in the
    fold of the empty text. Without any toxic label every score is the least one."""
    model = train(documents, labels, folds, held_out, doc_id=doc_id, text=text)
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        (_fold(F.col(doc_id), folds) == held_out).alias("held_out"),
        score(model, F.col(text).cast("string")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier, trained on all folds, does not call toxic, with their columns. Workers
    remember fewer words than in `score_documents`, as this is a stage of jobs whose other stages need the memory."""
    model = train(documents, labels, held_out=None, doc_id=doc_id, text=text, remembered=FEWER[0])
    return documents.where(score(model, F.col(text).cast("string"), FEWER[1]) < threshold)
