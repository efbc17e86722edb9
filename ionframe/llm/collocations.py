"""Frequent phrases by SON partitioning: every shard is mined completely at a proportionally lowered support, the phrases that are frequent
in some shard are candidates, and all candidates are counted exactly over all texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionframe.llm import common

SUPPORT = 30
LONGEST = 4
#: Shards of the mining phase. A phrase of support 30 has 30 * share or more occurrences in some shard.
SHARDS = 4
#: A phrase goes if a longer one around it has this many hundredths of its occurrences.
COVERED = 80
UNKNOWN = "und"

#: Words of a language that a task numbers before it writes them as one block.
BLOCK_WORDS = 1 << 19
#: Languages' words that a task holds at a time.
HELD_WORDS = 1 << 20
#: Keys that a task holds before it gives their counts.
HELD_KEYS = 1 << 20
#: Phrases that a task gives at a time, and words that a task of the last count reads where that leaves two tasks per core.
ROWS, TASK_WORDS = 1 << 14, 1 << 24
#: Bits of a candidate filter: a power of two, a quarter to half the words of all texts, between these. A filter only spares work.
LEAST_BITS, MOST_BITS = 20, 27
#: Words of all texts for each part that counts are dealt to, and the most parts.
PART_WORDS, MOST_PARTS = 1 << 20, 1 << 16

_BREAK = re.compile(r"[.,;:!?\x0A-\x0D]+")
_GAP, _END = 0, 1  # numbers of the empty text and of a piece's end


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    """Numbers of words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


class _Buffer:
    """The words of one language since its last block."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.held = _Numbers({"": _GAP, "\n": _END}), [], 0

    def add(self, text: str) -> int:
        spaced = _BREAK.sub(" \n ", common.ascii_lower(text)).replace("\t", " ").split(" ")
        ids = np.fromiter(map(self.numbers.__getitem__, spaced), np.int32, len(spaced))
        ids = np.append(ids[ids != _GAP], np.int32(_END))
        self.parts.append(ids)
        self.held += len(ids)
        return len(ids)

    def block(self) -> tuple[str, bytes, int]:
        ids = np.concatenate(self.parts)
        words = list(self.numbers)[2:]
        return " ".join(words), ids.tobytes(), int((ids != _END).sum())


_BLOCKS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.string()), ("ids", pa.binary()), ("n", pa.int64())])


def blocks(documents: DataFrame, text: str = "text", lang: str = "lang", shards: int = SHARDS) -> DataFrame:
    """(shard, lang, words, ids, n): texts of one language as numbers of words (int32; 1 ends a piece, words count from 2), with the words
    in the order of their numbers, joined by spaces. A shard is every `shards`-th partition of the input."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buffers, held = TaskContext.get().partitionId() % shards, {}, 0

        def written(key: str) -> pa.RecordBatch:
            words, ids, n = buffers.pop(key).block()
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((shard, key, words, ids, n), _BLOCKS)], schema=_BLOCKS)

        for batch in common.in_slices(batches, 2 << 20):
            for body, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                buffer = buffers.setdefault(key, _Buffer())
                held += buffer.add(body)
                while buffer.held >= BLOCK_WORDS or held >= HELD_WORDS:
                    most = max(buffers, key=lambda k: buffers[k].held)
                    held -= buffers[most].held
                    yield written(most)
                    if most == key:
                        break
        for key in list(buffers):
            yield written(key)
        pa.default_memory_pool().release_unused()

    texts = documents.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return texts.mapInArrow(rows, "shard int, lang string, words string, ids binary, n long")


class Candidates:
    """One bit per hash of a phrase: set for all phrases that are frequent in some shard. Others share some of the bits, so a set bit
    means that a phrase has to be counted. Of a fixed size, whatever the input."""

    def __init__(self, bits: int, parts: int, ranges: Iterable[tuple[int, bytes]]):
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros((1 << bits) // 8, np.uint8)
        width = len(self.table) // parts
        for part, own in ranges:
            self.table[part * width : (part + 1) * width] = np.frombuffer(own, np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.among(np.array([key], np.uint64))[0])

    def among(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Block:
    """A block's words and places."""

    def __init__(self, lang: str, words: str, ids: bytes):
        self.words = ["", "\n", *words.split(" ")] if words else ["", "\n"]
        self.ids = np.frombuffer(ids, np.int32)
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        hashes = (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words)
        self.hashes = _mixed(np.fromiter(hashes, np.uint64, len(self.words)) ^ seed)

    def places(self, size: int, known: list[Candidates]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the phrases of `size` words whose shorter parts are candidates, and the phrases' keys. known: the candidates of 1, 2,
        ... words, as many as there are below `size`, or up to it to have the candidates themselves."""
        at = np.flatnonzero(self.ids != _END)
        keys = self.hashes[self.ids[at]]
        for n in range(1, size + 1):
            if n > 1:
                # Both phrases of n - 1 words are candidates, so the next place follows this one.
                both = np.flatnonzero(at[1:] - at[:-1] == 1)
                at = at[both]
                keys = _mixed(keys[both] * np.uint64(3) ^ self.hashes[self.ids[at + n - 1]])
            if n <= len(known):
                kept = known[n - 1].among(keys)
                at, keys = at[kept], keys[kept]
        return at, keys

    def counts(self, size: int, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Distinct phrases of `size` words that start at `at`, and how often; words are told apart by their numbers, not by hashes."""
        code = self.ids[at].astype(np.int64)
        for k in range(1, size):
            _, code = np.unique(code, return_inverse=True)
            code = code.astype(np.int64) << 32 | self.ids[at + k]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        starts = at[first]
        return [" ".join(self.words[j] for j in self.ids[s : s + size].tolist()) for s in starts.tolist()], n


_COUNTS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("lang", pa.string()), ("least", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_COUNT_TYPES = "part int, shard int, lang string, least long, keys binary, counts binary"


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys, counts = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def local_counts(table: DataFrame, size: int, parts: int, known: list[Broadcast], support: int) -> DataFrame:
    """(part, shard, lang, least, keys, counts): the keys of phrases of `size` words with their counts, added up over a task's blocks as far
    as they fit. Keys are dealt to `parts` (a power of two) by their first bits, and the 32 bits behind these are sent: phrases whose bits
    agree count as one, which can only make more candidates. No shard asks for more than `support`, so no larger count is sent."""
    own = np.uint64(parts.bit_length() - 1)
    kind = np.min_scalar_type(support)

    def dealt(shard: int, lang: str, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(held)
        edges = np.searchsorted(keys >> (np.uint64(64) - own), np.arange(parts + 1, dtype=np.uint64))
        keys, counts = ((keys << own) >> np.uint64(32)).astype(np.uint32), np.minimum(counts, support).astype(kind)
        used = np.flatnonzero(np.diff(edges)).tolist()
        columns = [
            used, [shard] * len(used), [lang] * len(used), [None] * len(used),
            [keys[edges[p] : edges[p + 1]].tobytes() for p in used], [counts[edges[p] : edges[p + 1]].tobytes() for p in used],
        ]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, held, n = [b.value for b in known], {}, 0
        for batch in common.in_slices(batches, 1):
            for shard, lang, words, ids in zip(*(batch.column(n).to_pylist() for n in ("shard", "lang", "words", "ids"))):
                _, keys = Block(lang, words, ids).places(size, filters)
                keys, counts = np.unique(keys, return_counts=True)
                held.setdefault((shard, lang), []).append((keys, counts))
                n += len(keys)
                if n > HELD_KEYS:
                    for key in list(held):
                        yield dealt(*key, held.pop(key))
                    n = 0
        for key in list(held):
            yield dealt(*key, held.pop(key))
        pa.default_memory_pool().release_unused()

    return table.mapInArrow(rows, _COUNT_TYPES)


def locally_frequent(counts: DataFrame, least: DataFrame, bits: int, parts: int, support: int) -> Candidates:
    """The phrases with `least` (shard, lang, least) or more occurrences in some shard, as a filter. Each part of the keys is summed in
    one task, a shard and language at a time, and gives its range of the filter."""
    width = (1 << bits) // parts
    shift, kind = np.uint32(33 - width.bit_length()), np.min_scalar_type(support)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, None

        def written() -> pa.RecordBatch:
            packed = np.packbits(own, bitorder="little").tobytes()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])

        for group in common.sorted_groups(batches, ("part", "lang", "shard")):
            least_own = [v for v in group.column("least").to_pylist() if v is not None]
            if group.num_rows == len(least_own) or not least_own:
                continue
            now = group.column("part")[0].as_py()
            if now != part:
                if part is not None:
                    yield written()
                part, own = now, np.zeros(width, bool)
            pairs = zip(group.column("keys").to_pylist(), group.column("counts").to_pylist())
            keys, n = _summed([(np.frombuffer(k, np.uint32), np.frombuffer(c, kind)) for k, c in pairs if k is not None])
            own[keys[n >= least_own[0]] >> shift] = True
        if part is not None:
            yield written()

    to_all = least.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "shard", "lang", "least",
        F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"),
    )
    dealt = counts.unionByName(to_all).repartition("part").sortWithinPartitions("part", "lang", "shard")
    return Candidates(bits, parts, ((r.part, r.bits) for r in dealt.mapInArrow(rows, "part int, bits binary").toLocalIterator()))


def global_counts(table: DataFrame, known: list[Broadcast], support: int, total: int) -> DataFrame:
    """(lang, phrase, f, size): exact counts over all texts, of `total` words, of the candidates with `support` or more occurrences."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [b.value for b in known]
        for batch in common.in_slices(batches, 1):
            for lang, words, ids in zip(*(batch.column(n).to_pylist() for n in ("lang", "words", "ids"))):
                block = Block(lang, words, ids)
                for size in range(1, len(filters) + 1):
                    at, _ = block.places(size, filters[:size])
                    phrases, n = block.counts(size, at)
                    for start in range(0, len(phrases), ROWS):
                        part = slice(start, start + ROWS)
                        columns = [pa.array([lang] * len(phrases[part]), pa.string()), pa.array(phrases[part], pa.string()), pa.array(n[part], pa.int64())]
                        yield pa.record_batch(columns, names=["lang", "phrase", "n"])
        pa.default_memory_pool().release_unused()

    made = table.select("lang", "words", "ids")
    # A task's counts are added up before they are sent, so fewer and longer tasks send less.
    least = 2 * table.sparkSession.sparkContext.defaultParallelism
    tasks = max(least, total // TASK_WORDS)
    made = made.coalesce(tasks).mapInArrow(rows, "lang string, phrase string, n long")
    counted = made.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
    # Words hold no spaces.
    return counted.withColumn("size", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)


def mine(
    documents: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to `longest` words with `support` or more occurrences, and (lang, n), the words of
    each language. Exact: a phrase that is frequent is so in some shard at that shard's share of the support, and so are its parts.

    Pieces of a text end at `.,;:!?` and line ends, words at spaces and tabs; A-Z count as lower case; overlapping occurrences count each.
    Null and empty texts have no words, a null language is `und`. Repeated rows count each. Very long texts are read whole. An empty table gives no rows."""
    spark = documents.sparkSession
    table = common.staged(blocks(documents, text, lang, shards))
    words = table.groupBy("lang").agg(F.sum("n").alias("n"))
    of_shard = table.groupBy("shard", "lang").agg(F.sum("n").alias("own"))
    share = F.expr(f"cast((cast(own as decimal(38,0)) * {support} + n - 1) div n as long)")
    least = common.staged(of_shard.join(words, "lang").where(F.col("n") >= support).select("shard", "lang", F.greatest(share, F.lit(1)).alias("least")))
    total = table.agg(F.sum("n")).first()[0] or 0
    bits = min(max(total.bit_length() - 2, LEAST_BITS), MOST_BITS)
    parts = min(1 << max(total // PART_WORDS, 1).bit_length(), MOST_PARTS)
    known = []
    for size in range(1, longest + 1):
        found = locally_frequent(local_counts(table, size, parts, known, support), least, bits, parts, support)
        known.append(spark.sparkContext.broadcast(found))
    return common.staged(global_counts(table, known, support, total)), words


def collocations(
    documents: DataFrame, top: int = 2000, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    a, l, r: occurrences of the phrase, of its first words and of the rest at the cut with the smallest floor(2000000 * a / (l + r)), the
    first of equal ones; n: all words of the language. A phrase goes if some longer frequent phrase holds it and has 80 hundredths of its
    occurrences. Order: score and a descending, then the phrase's bytes. See `mine` for words, nulls and repeats."""
    counts, words = mine(documents, support, longest, shards, text, lang)
    split = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    of = counts.select("lang", "phrase", "f")
    score = F.expr("cast(2000000 * cast(a as decimal(30,0)) div (cast(l as decimal(30,0)) + r) as long)")
    scored = (
        cuts.join(of.toDF("lang", "first", "l"), ["lang", "first"]).join(of.toDF("lang", "rest", "r"), ["lang", "rest"])
        .withColumn("score", score)
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    )
    around = (
        split.where("size > 2")
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
        .groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    )
    hundredths = lambda c, n: F.col(c).cast("decimal(20,0)") * n
    left = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (hundredths("longer", 100) < hundredths("a", COVERED))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
