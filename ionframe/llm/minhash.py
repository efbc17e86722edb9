"""MinHash near-duplicates by tensored banding, with every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.llm import common
from ionframe.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Half keys in each of two collections, and min-hashes in a half key. Every pair of halves, one of each collection, is the
#: key of one table: 144 tables of four min-hashes come from 48 min-hashes, not 576. A pair at similarity s meets in
#: some table with probability (1 - (1 - s**2) ** 12) ** 2: 0.9999 at 0.75, more above.
HALVES, WIDTH = 12, 2
#: Equal min-hashes of 48 that a candidate needs. At similarity 0.75 fewer come up once in a million pairs.
LEAST_EQUAL = 20
#: Members of a table key that are compared with each other at a time.
BLOCK = 1024
#: Bytes of text or sets that a worker takes apart at a time, and words that it remembers in a generation.
SLICE, REMEMBERED = 2 << 20, 60_000
#: Members of a loose group whose full sets are compared with each other at a time.
SETS = 256

_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
    ("halves", pa.list_(pa.int64())), ("signature", pa.binary()),
])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_MULTIPLIERS = _mixed(np.arange(1, 2 * HALVES * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def shingle_set(text: str | None, memory: common.Cache, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a whole text's distinct shingles, A-Z in lower case; of a text with fewer words, one of all its
    words; empty without words."""
    words = common.words(common.ascii_lower(text))
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out ^ hashes[k : k + len(out)])
    return np.unique(out)


def half_keys(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The half keys of both collections, and a byte of each min-hash."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 8192):
        part = shingles[start : start + 8192]
        for k, multiplier in enumerate(_MULTIPLIERS):
            least[k] = min(least[k], (part * multiplier).min())
    least = _mixed(least)
    halves = least.reshape(2 * HALVES, WIDTH)
    key = np.zeros(2 * HALVES, np.uint64)
    for k in range(WIDTH):
        key = _mixed(key ^ halves[:, k])
    return key.view(np.int64), (least & np.uint64(255)).astype(np.uint8).tobytes()


def sketch(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), n_shingles, set_key (128 bits that name the shingle set),
    halves, signature."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(word_hash, REMEMBERED)
        for batch in common.in_slices(batches, SLICE):
            sizes, keys, halves, signatures = [], [], [], []
            for body in batch.column(2).to_pylist():
                shingles = shingle_set(body, memory)
                half, signature = half_keys(shingles) if len(shingles) else (np.empty(0, np.int64), b"")
                sizes.append(len(shingles))
                keys.append(hashlib.md5(shingles.tobytes()).digest())
                halves.append(half)
                signatures.append(signature)
            columns = [batch.column(0), batch.column(1), sizes, keys, halves, signatures]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SKETCH)], schema=_SKETCH)

    return _texts(documents, doc_id, text).mapInArrow(
        rows, "doc_id long, text_key long, n_shingles long, set_key binary, halves array<long>, signature binary"
    )


def text_key(text: str) -> Column:
    """A hash of a text that tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")
    )


def table_members(classes: DataFrame) -> DataFrame:
    """(key, node, members) for each table key that at least two nodes share. Half keys that only one node has are
    dropped before pairs of halves are formed; no pair of nodes is lost by that."""
    halves = classes.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("slot", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = halves.join(shared, ["slot", "half"]).groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("halves"))
    left = F.filter("halves", lambda h: h["slot"] < HALVES)
    right = F.filter("halves", lambda h: h["slot"] >= HALVES)
    keys = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x, y))))
    tables = common.staged(own.select("node", F.explode(keys).alias("key")))
    counts = tables.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return tables.join(counts, "key")


def _close(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= PERCENT * union."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    width = len(_MULTIPLIERS)
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, width)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(-1, width)
    return (x == y).sum(axis=1) >= LEAST_EQUAL


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose set sizes and signatures leave them a chance."""
    of = classes.select("node", "n_shingles", "signature")
    both = pairs.join(of.toDF("a", "n_a", "s_a"), "a").join(of.toDF("b", "n_b", "s_b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_alike(batch.column(2), batch.column(3)))
            yield batch.select([0, 1]).filter(keep)

    return both.select("a", "b", "s_a", "s_b").mapInArrow(rows, "a long, b long")


def shingle_sets(documents: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, shingles) for classes given as (node, set_key, first_doc), made again from the texts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.Cache(word_hash, REMEMBERED)
        for batch in common.in_slices(batches, SLICE):
            sets = [shingle_set(t, memory).tobytes() for t in batch.column(0).to_pylist()]
            keys = [hashlib.md5(s).digest() for s in sets]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])

    texts = _texts(documents, doc_id, text).join(
        wanted.select(F.col("first_doc").alias("__first")).distinct(), F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi"
    )
    made = texts.select("text").mapInArrow(rows, "set_key binary, shingles binary")
    return made.join(wanted, "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= PERCENT * union of their full sets.

    Each b's set goes to its a's; where many b share an a, they are dealt to several parts, each with a copy of a's
    set. A part is sorted with a first and streamed, so one set and one batch are in memory."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    b_rows = (
        pairs.join(parts, "a")
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(sets.withColumnRenamed("node", "b"), "b")
        .select("a", "part", "b", "shingles")
    )
    a_rows = parts.join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles"
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole = None, np.empty(0, np.uint64)
        for batch in common.in_slices(batches, SLICE):
            found = []
            for a, b, shingles in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                these = np.frombuffer(shingles, np.uint64)
                if b is None:
                    own, whole = a, these
                elif a == own:
                    if similar(whole, these):
                        found.append((a, b))
            yield _pairs_batch(found)

    spread = a_rows.unionByName(b_rows).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return spread.mapInArrow(rows, "a long, b long")


def _dealt(named: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Members of groups dealt to blocks of about `size`, once for each pair of blocks (i, j) that they take part in."""
    return (
        named.withColumn("own", F.pmod(F.xxhash64("node"), size).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), size - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other")
        .repartition(*keys, "i", "j")
        .sortWithinPartitions(*keys, "i", "j")
    )


class _Group:
    """Members of one pair of blocks: which pairs of them are across components, of one size and alike."""

    def __init__(self, group: pa.RecordBatch):
        self.own, self.node, self.component, self.size = (
            group.column(n).to_numpy() for n in ("own", "node", "component", "n_shingles")
        )
        self.bytes = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, len(_MULTIPLIERS))
        self.within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        self.up: dict[int, int] = {}

    def root(self, k: int) -> int:
        """What member k's component has become part of here."""
        x = int(self.component[k])
        while x in self.up:
            x = self.up[x]
        return x

    def bridges(self, test: Callable[[int, int], bool]) -> list[tuple[int, int]]:
        """Pairs of components that hold likely pairs of members (k, o) which pass a test. Components already brought together
        here need no other pair, so there are fewer of them than members."""
        found = []
        for k in range(len(self.node)):
            for o in self.partners(k).tolist():
                one, other = self.root(k), self.root(o)
                if one != other and test(k, o):
                    self.up[other] = one
                    found.append((int(self.component[k]), int(self.component[o])))
        return found

    def partners(self, k: int) -> np.ndarray:
        other = (self.component > self.component[k]) & _close(self.size, self.size[k])
        if not self.within:
            other &= self.own != self.own[k]
        other = np.flatnonzero(other)
        return other[(self.bytes[other] == self.bytes[k]).sum(axis=1) >= LEAST_EQUAL]


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ((), ()))], names=["a", "b"])


def _by_component(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """`labels` (node, component) after pairs (a, b) of components have been brought together, written to the shared folder; a component
    without a row in `labels` is a node of its own. Only the pairs are searched for components, not the nodes once more."""
    merged = components(pairs)
    every = labels.union(merged.select("node", "node")).groupBy("node").agg(F.min("component").alias("component"))
    moved = every.join(merged.toDF("component", "__to"), "component", "left")
    return common.staged(moved.select("node", F.coalesce("__to", "component").alias("component")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes lie in different components of `labels`."""
    both = pairs.join(labels.toDF("a", "c_a"), "a", "left").join(labels.toDF("b", "c_b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def cross_pairs(members: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of components of `labels` that hold likely pairs of nodes with one table key, enough of them to bring all such
    components together. Only keys whose members are not all in one component count; a pair of blocks of a key's members is
    compared in one place."""
    named = _by_component(members, labels)
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows_of = named.join(mixed.select("key"), "key").join(classes.select("node", "n_shingles", "signature"), "node")

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sorted_groups(batches, ("key", "i", "j")):
            found = _Group(batch).bridges(lambda k, o: True)
            if found:
                yield _pairs_batch(found)

    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    return _dealt(rows_of, ["key"], blocks).mapInArrow(pairs, "a long, b long").distinct()


def confirmed_within(loose: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that confirmed links inside each loose group bring together. A group's sets are dealt to blocks, and
    every likely pair across components of each pair of blocks is compared on its full sets; once a link has brought two
    components together there, their other pairs need no test."""
    named = _by_component(loose.withColumnRenamed("component", "loose"), labels)
    mixed = (
        named.groupBy("loose")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(SETS)).cast("int").alias("blocks"))
        .where("low < high")
    )
    rows_of = (
        named.join(mixed.select("loose", "blocks"), "loose")
        .join(classes.select("node", "n_shingles", "signature"), "node").join(sets, "node")
    )

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sorted_groups(batches, ("loose", "i", "j")):
            column = batch.column("shingles")
            sets_ = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in range(len(column))]
            found = _Group(batch).bridges(lambda k, o: similar(sets_[k], sets_[o]))
            if found:
                yield _pairs_batch(found)

    return _dealt(rows_of, ["loose"], F.col("blocks")).mapInArrow(pairs, "a long, b long")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id), text_key (a hash of
    the text) and group (a number of the component); these two tell rows of one doc_id apart.

    Documents with equal shingle sets are one class and enter the search once. A table key's pivot is its most popular member (the
    one that meets most others over all tables). Each class is compared with the most popular of its pivots, then with those of its other
    pivots that are still in another component; this gives confirmed links, and loose groups of classes that are likely to be alike. Loose groups that share a likely pair under some key are
    joined, so that every likely pair is inside one; there, all likely pairs that the confirmed links leave in different
    components are compared. So a large group of near copies costs a star and its few stragglers, not all its pairs, and
    no likely link between components is left untried.
    A text without words is linked with nothing, its component its own doc_id. Null doc_ids are ignored as component_id
    unless a component has no other. Rows with one doc_id and different texts are documents of their own."""
    sketches = common.staged(sketch(documents, doc_id, text), common.BATCH)
    classes = common.staged(
        sketches.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"),
             F.first("halves").alias("halves"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = common.staged(table_members(classes))
    popularity = members.groupBy("node").agg(F.sum("members").alias("met"))
    pivots = members.join(popularity, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("pivot"))
    stars = common.staged(
        members.join(pivots, "key").where("pivot.node != node")
        .select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot.met").alias("met")).distinct()
    )
    nodes = members.select("node").distinct()
    sets = common.staged(shingle_sets(documents, classes.join(nodes, "node").select("node", "set_key", "first_doc"), doc_id, text), common.BATCH)
    # A node's most popular pivot first; of the others only those that this leaves in another component.
    nearest = stars.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best")).select("best.a", "b")
    likely = common.staged(_likely(nearest, classes))
    links = common.staged(confirmed(likely, sets), common.BATCH)
    others = common.staged(_likely(_apart(stars, components(links)), classes))
    links = common.staged(links.union(confirmed(others, sets)), common.BATCH)
    labels, loose = components(links), components(likely.union(others))
    bridges = common.staged(cross_pairs(members, classes, loose))
    loose = _joined(loose, bridges)
    # Written first: else each task that compares sets has a second Python worker, which looks for components.
    links = common.staged(confirmed_within(loose, labels, classes, sets), common.BATCH)
    labels = _joined(labels, links)
    first = (
        classes.select("node", "first_doc").join(labels, "node").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    )
    of_class = (
        classes.join(labels.join(first, "component"), "node", "left")
        .where("copies > 1 or component is not null")
        .select("set_key", F.coalesce("component", "node").alias("group"),
                F.when(F.col("component").isNull(), F.col("first_doc")).otherwise(F.col("component_id")).alias("component_id"),
                F.lit(True).alias("__found"))
    )
    joined = sketches.select("doc_id", "text_key", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("__found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("group", F.xxhash64("set_key")).alias("group"),
    )


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns; of rows that repeat it one. Texts
    without words are linked with nothing, so all of them stay."""
    found = near_duplicates(documents, doc_id, text).where("n_shingles > 0 and kept")
    order = Window.partitionBy("group", "component_id").orderBy("text_key")
    keep = found.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(
        F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__kept_key")
    )
    wordy = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = documents.where(wordy).withColumn("__text_key", text_key(text))
    stay = keyed.join(
        keep, F.col(doc_id).cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__text_key") == F.col("__kept_key")), "left_semi"
    ).dropDuplicates([doc_id, "__text_key"])
    return stay.drop("__text_key").unionByName(documents.where(~wordy))
