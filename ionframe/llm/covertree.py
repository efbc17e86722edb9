"""Exact top-k by inner product: dual cover-tree search over blocks of queries and rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.llm import common

K = 20
#: Rows of a data block, queries that are held at a time, and queries that meet one copy of a block.
BLOCK, QUERIES_HELD, QUERY_BLOCK = 4096, 2048, 16384
#: Roots of the trees: so many rows, the first by a hash of their values, are what all rows are assigned to.
PIVOTS = 64
#: A node whose net at half its radius needs more centres than this is a leaf: nothing there can be told apart by balls.
CHILDREN = 24
LEAF = 64


@dataclass
class Node:
    """A ball: centre (a row's position), covering radius, and either children or the rows themselves."""

    centre: int
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(points: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree: a node's children are centred on rows more than half its radius apart that cover its rows within
    half its radius, found farthest first; the node's own centre is one of them."""
    rows = np.arange(len(points)) if rows is None else rows
    if centre is None:
        centre = int(rows[((points[rows] - points[rows].mean(axis=0)) ** 2).sum(1).argmin()])
    distance = np.sqrt(((points[rows] - points[centre]) ** 2).sum(1))
    node = Node(centre, float(distance.max(initial=0.0)), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    owner, near, centres = np.zeros(len(rows), int), distance.copy(), [centre]
    while near.max() > node.radius / 2:
        if len(centres) == CHILDREN:
            return node
        far = int(near.argmax())
        d = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(1))
        owner = np.where(d < near, len(centres), owner)
        near = np.minimum(near, d)
        centres.append(int(rows[far]))
    node.children = [build(points, rows[owner == k], c) for k, c in enumerate(centres)]
    return node


class Search:
    """Dual-tree search of queries among the rows of one block. `kth` starts from what is known of each query's k-th
    best score elsewhere; `best` has up to k (score, vec_id) of this block per query, none below that."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int):
        self.rows, self.ids, self.k = rows.astype(np.float64), ids, k
        self.whole = rows
        self.norms = np.sqrt((self.rows**2).sum(1))
        self.root = build(self.rows)

    def run(self, queries: np.ndarray, own: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self.queries, self.own, self.kth = queries.astype(np.float64), own, known.astype(np.float64)
        self.exact = queries
        self.q_norms = np.sqrt((self.queries**2).sum(1))
        top = np.abs(self.queries).max(initial=0) * np.abs(self.rows).max(initial=0) * self.rows.shape[1]
        self.small = top < 2.0**53  # then products and sums of doubles are exact
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in own]
        self._visit(build(self.queries), self.root)
        return self.best

    def _bound(self, q: Node, d: Node) -> float:
        """No score of a pair from both balls is above this."""
        nq, nd = self.q_norms[q.centre], self.norms[d.centre]
        bound = self.queries[q.centre] @ self.rows[d.centre] + nq * d.radius + nd * q.radius + q.radius * d.radius
        return bound + 1e-6 + 1e-9 * (nq + q.radius) * (nd + d.radius)

    def _visit(self, q: Node, d: Node) -> None:
        if self._bound(q, d) < self.kth[q.rows].min():
            return
        if q.children and (not d.children or q.radius >= d.radius):
            for child in q.children:
                self._visit(child, d)
        elif d.children:
            for child in sorted(d.children, key=lambda c: -self._bound(q, c)):
                self._visit(q, child)
        else:
            self._compare(q.rows, d.rows)

    def _compare(self, q: np.ndarray, d: np.ndarray) -> None:
        if self.small:
            scores = (self.queries[q] @ self.rows[d].T).astype(np.int64)
        else:
            scores = self.exact[q].astype(object) @ self.whole[d].astype(object).T
        ids = self.ids[d]
        for k, row in zip(q, scores):
            hit = np.flatnonzero((row >= self.kth[k]) & (ids != self.own[k])) if self.small else np.flatnonzero(ids != self.own[k])
            if not len(hit):
                continue
            score = np.concatenate([self.best[k][0], row[hit].astype(np.int64)])
            vec = np.concatenate([self.best[k][1], ids[hit]])
            order = np.lexsort((vec, -score))[: self.k]
            self.best[k] = score[order], vec[order]
            if len(order) == self.k:
                self.kth[k] = max(self.kth[k], float(score[order[-1]]))


def floored(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, values) of the rows that take part; values: floor(scale * component) as 64-bit numbers in bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            values = [floor_key(v, scale) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.binary())], names=["vec_id", "values"])

    typed = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return typed.mapInArrow(rows, "vec_id long, values binary").where("vec_id is not null and values is not null")


def floor_key(vector: list[float | None] | None, scale: float) -> bytes | None:
    if not vector or any(x is None for x in vector):
        return None
    values = np.floor(scale * np.array(vector, np.float64))
    return values.astype(np.int64).tobytes() if (np.abs(values) < 2.0**62).all() else None


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the highest inner product for each row where `is_query` (an expression
    of vec_id), its own vec_id left out, ties to the smaller vec_id; fewer if there are fewer.

    Vectors that are null or empty, hold null or non-finite components, or whose floored components leave 64 bits, and rows
    without vec_id, take no part; vectors meet those of their own length. Repeated rows count each, as candidates and as
    queries. A score beyond 64 bits fails.

    All rows are assigned to pivots, the roots of the trees; a pivot's rows are cut to blocks, so a hot region fills many
    tasks. First, queries meet the blocks of their own pivot, which gives each a k-th best score; then the blocks of every
    pivot that its bound cannot rule out; however many come to a block, they are dealt to parts of bounded size, each with
    a copy of the block. In a task a block's tree is searched together with a tree over the queries that came.
    Each block returns at most k rows per query."""
    rows = common.staged(floored(vectors, scale, vec_id, embedding))
    sizes = [r[0] for r in rows.select(F.length("values").alias("n")).distinct().orderBy("n").collect()]
    found = None
    for size in sizes:
        own = _top_k(rows.where(F.length("values") == size), is_query, k)
        found = own if found is None else found.union(own)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    return found


def _top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    sample = rows.select("values", F.xxhash64("values").alias("o")).distinct().orderBy("o", "values").limit(PIVOTS).toArrow()
    pivots = _matrix(sample.column("values").combine_chunks()).astype(np.float64)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            points = _matrix(batch.column("values")).astype(np.float64)
            squares = (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)[None, :]
            pivot = squares.argmin(axis=1)
            distance = np.sqrt(((points - pivots[pivot]) ** 2).sum(1))
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("values"), pa.array(pivot, pa.int32()), pa.array(distance)],
                names=["vec_id", "values", "pivot", "distance"],
            )

    assigned = common.staged(
        rows.mapInArrow(assign, "vec_id long, values binary, pivot int, distance double")
        .withColumn("node", F.monotonically_increasing_id())
    )
    # One row per pivot: at most PIVOTS rows.
    balls = assigned.groupBy("pivot").agg(
        F.max("distance").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")
    ).collect()
    blocks = {r["pivot"]: r["blocks"] for r in balls}
    radii = np.array([next((r["radius"] for r in balls if r["pivot"] == p), -1.0) for p in range(len(pivots))])
    queries = assigned.where(is_query).select("vec_id", "values", "pivot", "node")
    at_home = queries.withColumn("kth", F.lit(None).cast("double")).withColumn("to", F.col("pivot"))
    home = common.staged(_answers(assigned, at_home, blocks, k))
    kth = (
        _ranked(home, k).where(F.col("rank") == k).select("node", F.col("score").cast("double").alias("kth"))
    )

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 1 << 20):
            points = _matrix(batch.column("values")).astype(np.float64)
            norms = np.sqrt((points**2).sum(1))[:, None]
            bound = points @ pivots.T + norms * radii[None, :]
            bound += 1e-6 + 1e-9 * norms * (np.sqrt((pivots**2).sum(1)) + np.maximum(radii, 0))[None, :]
            least = np.nan_to_num(batch.column("kth").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            ask = (bound >= least[:, None]) & (radii >= 0)[None, :]
            ask[np.arange(len(points)), batch.column("pivot").to_numpy()] = False
            who, where = np.nonzero(ask)
            part = batch.take(pa.array(who))
            yield pa.record_batch([*part.columns, pa.array(where, pa.int32())], names=[*part.schema.names, "to"])

    away = queries.join(kth, "node", "left").select("vec_id", "values", "pivot", "node", "kth").mapInArrow(
        others, "vec_id long, values binary, pivot int, node long, kth double, to int"
    )
    merged = _ranked(home.union(_answers(assigned, away, blocks, k)), k)
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked(answers: DataFrame, k: int) -> DataFrame:
    """Answers with their rank among those of their query; a query has at most k from each block it met."""
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order))


def _dealt(assigned: DataFrame, asked: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """Rows and queries with the (to, block, part) where they meet: a pivot's rows are cut to blocks of about BLOCK, the
    queries that go to it to parts of about QUERY_BLOCK, and each block meets each part."""
    # One row per pivot: at most PIVOTS rows.
    parts = {r["to"]: -(-r["count"] // QUERY_BLOCK) for r in asked.groupBy("to").count().collect()}

    def of_pivot(numbers: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for item in sorted(numbers.items()) for x in item]), F.col("to"))

    n_blocks = of_pivot(blocks)
    n_parts = of_pivot({p: parts.get(p, 0) for p in blocks})
    block, part = F.pmod(F.xxhash64("node"), n_blocks).cast("int"), F.pmod(F.xxhash64("node", F.lit("part")), n_parts).cast("int")
    members = assigned.select(
        F.col("pivot").alias("to"), F.lit(None).cast("int").alias("from"), "vec_id", "values", "node", F.lit(None).cast("double").alias("kth")
    ).where(n_parts > 0).withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    queries = asked.select("to", F.col("pivot").alias("from"), "vec_id", "values", "node", "kth").withColumn(
        "block", F.explode(F.sequence(F.lit(0), n_blocks - 1))
    ).withColumn("part", part)
    both = members.withColumn("is_query", F.lit(False)).union(queries.withColumn("is_query", F.lit(True)).select(*members.columns, "is_query"))
    return both.repartition("to", "block", "part").sortWithinPartitions("to", "block", "part", "is_query", "from")


def _searched(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, query_id, vec_id, score) from batches sorted as _dealt does. A block is held; queries pass it by batches."""
    key, held, search = None, [], None
    for batch in batches:
        for group in common.sorted_groups([batch], ("to", "block", "part", "is_query")):
            now = tuple(group.column(n)[0].as_py() for n in ("to", "block", "part"))
            if now != key:
                key, held, search = now, [], None
            if not group.column("is_query")[0].as_py():
                held.append(group)
                continue
            if not held:  # the hash left this block empty
                continue
            if search is None:
                block = pa.concat_batches(held)
                search = Search(_matrix(block.column("values")), block.column("vec_id").to_numpy(), k)
            for start in range(0, group.num_rows, QUERIES_HELD):
                asking = group.slice(start, QUERIES_HELD)
                known = np.nan_to_num(asking.column("kth").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                own = asking.column("vec_id").to_numpy()
                best = search.run(_matrix(asking.column("values")), own, known)
                n = [len(b[0]) for b in best]
                node = np.repeat(asking.column("node").to_numpy(), n)
                yield pa.record_batch(
                    [pa.array(node), pa.array(np.repeat(own, n)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))],
                    names=["node", "query_id", "vec_id", "score"],
                )


def _answers(assigned: DataFrame, asked: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """(node, query_id, vec_id, score): each asked query's best rows in each block of the pivot it goes `to`."""
    return _dealt(assigned, asked, blocks).mapInArrow(lambda batches: _searched(batches, k), "node long, query_id long, vec_id long, score long")
