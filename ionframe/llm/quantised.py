"""Embedding near-duplicates by product quantisation: coarse lists, residual subspace codes, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common
from ionframe.llm.components import components

COSINE = 0.98
#: Vectors that the index is fitted on, at most; the first by a hash of their values.
SAMPLE = 20_000
LISTS, SUBSPACES, CODES = 64, 8, 256
#: Rows of a list that one group of queries is compared with at a time.
BLOCK = 2048
#: Room for rounding in the distances that only select candidates.
SLACK = 1e-4


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres; those that lose all their points stay where they were."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        for d in range(points.shape[1]):
            total = np.bincount(near, points[:, d], minlength=len(centres))
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(points, centres).argmin(axis=1)


@dataclass
class Index:
    """Coarse centres, and for each subspace of the residuals its code words. Vectors are of length 1."""

    coarse: np.ndarray
    words: list[np.ndarray]
    bounds: list[tuple[int, int]]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
        coarse = kmeans(sample, lists)
        rest = sample - coarse[nearest(sample, coarse)]
        cut = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        bounds = [(int(a), int(b)) for a, b in zip(cut, cut[1:])]
        return cls(coarse, [kmeans(rest[:, a:b], codes) for a, b in bounds], bounds)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error (distance to what the codes stand for) of each vector."""
        lists = nearest(vectors, self.coarse)
        rest = vectors - self.coarse[lists]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.bounds, self.words)], axis=1)
        made = np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], axis=1)
        return lists, codes.astype(np.uint8), np.sqrt(((rest - made) ** 2).sum(1))

    def probes(self, vectors: np.ndarray, lists: np.ndarray, radius: float) -> np.ndarray:
        """(vector, list) marks of the lists to ask for a vector within `radius`: those whose cell's border with the
        vector's own cell is no further away. Sufficient: a vector beyond the border by less is in such a cell. Of two
        vectors of different lists the one in the earlier list asks."""
        d = squared(vectors, self.coarse)
        own = d[np.arange(len(d)), lists]
        between = np.sqrt(squared(self.coarse, self.coarse))[lists]
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (d - own[:, None]) / (2 * between)
        within = (border <= radius + SLACK) | (between == 0)
        return within & (np.arange(len(self.coarse))[None, :] >= lists[:, None])

    def distances(self, query: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of one query to the coded vectors of one list: sums over one table per subspace."""
        rest = query - self.coarse[number]
        total = np.zeros(len(codes))
        for s, ((a, b), words) in enumerate(zip(self.bounds, self.words)):
            total += ((rest[a:b] - words) ** 2).sum(1)[codes[:, s]]
        return np.sqrt(total)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(values, label, first_id, copies) for each distinct vector of a label that can be linked at all: not null, some
    component not 0, all of them finite. `values` are the doubles' bytes, so equal vectors are counted before they meet."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches):
            values = [value_key(v) for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.binary()), batch.column(2)], names=["vec_id", "values", "label"])

    typed = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"),
        F.col(label).cast("string").alias("label"),
    )
    return typed.mapInArrow(rows, "vec_id long, values binary, label string")


def value_key(vector: list[float | None] | None) -> bytes | None:
    """The doubles' bytes of a vector that can be linked, else null."""
    if not vector or any(x is None for x in vector):
        return None
    values = np.array(vector, np.float64) + 0.0
    top = np.abs(values).max()
    if not np.isfinite(values).all() or top == 0 or not np.isfinite(np.linalg.norm(values / top)):
        return None
    return values.tobytes()


def _unit(values: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square overflows or vanishes."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values**2).sum(1, keepdims=True))


def cosines(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision of one vector with others, both as given."""
    return (others @ x) / (np.sqrt((others**2).sum(1)) * np.sqrt((x**2).sum()))


def links_of(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b) of the classes (node, values, label) of one label whose cosine is at least `cosine`, each pair once.

    Per vector length an index is fitted on at most SAMPLE vectors; every vector is coded. A vector asks its own list
    and those whose border is within reach, in its label; in a list, a member is a candidate if the asymmetric distance
    less the member's stored quantisation error is within reach, which misses nothing; candidates get the exact cosine.
    Large lists are cut to blocks, each asked in its own task, queries streaming past."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    sizes = [r[0] for r in classes.select(F.length("values").alias("n")).distinct().orderBy("n").collect()]
    found = None
    for size in sizes:
        own = classes.where(F.length("values") == size)
        sample = own.select("values", F.xxhash64("values").alias("o")).orderBy("o", "values").limit(SAMPLE).select("values").toArrow()
        index = Index.fit(_unit(_matrix(sample.column(0).combine_chunks())))
        links = _links(own, index, radius, cosine)
        found = links if found is None else found.union(links)
    return found if found is not None else classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def _links(classes: DataFrame, index: Index, radius: float, cosine: float) -> DataFrame:
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_slices(batches, 1 << 20):
            units = _unit(_matrix(batch.column("values")))
            lists, codes, errors = index.encode(units)
            who, where = np.nonzero(index.probes(units, lists, radius))
            home = lists[who] == where
            parts = batch.take(pa.array(who))
            yield pa.record_batch(
                [parts.column(n) for n in ("node", "values", "label")]
                + [pa.array(where, pa.int32()), pa.array(home), pa.array([codes[k].tobytes() for k in who], pa.binary()), pa.array(errors[who])],
                names=["node", "values", "label", "list", "home", "codes", "error"],
            )

    asked = common.staged(
        classes.select("node", "values", "label").mapInArrow(
            ask, "node long, values binary, label string, list int, home boolean, codes binary, error double"
        )
    )
    blocks = asked.where("home").groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = asked.join(blocks, ["label", "list"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = placed.where("home").withColumns({"block": block, "asks": F.lit(False)})
    queries = placed.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})
    columns = ["label", "list", "block", "asks", "node", "values", "codes", "error"]

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            pairs = []
            for part in common.sorted_groups([batch], ("label", "list", "block", "asks")):
                now = tuple(part.column(n)[0].as_py() for n in ("label", "list", "block"))
                if now != key:
                    key, held = now, []
                if not part.column("asks")[0].as_py():
                    held.append(part)
                    continue
                if not held:  # the hash left this block empty
                    continue
                if len(held) > 1:
                    held = [pa.concat_batches(held)]
                nodes, values, errors = held[0].column("node").to_numpy(), _matrix(held[0].column("values")), held[0].column("error").to_numpy()
                codes = np.frombuffer(b"".join(held[0].column("codes").to_pylist()), np.uint8).reshape(len(nodes), -1)
                for node, query in zip(part.column("node").to_pylist(), _matrix(part.column("values"))):
                    near = index.distances(_unit(query[None])[0], key[1], codes) - errors <= radius + SLACK
                    near = np.flatnonzero(near & (nodes != node))
                    good = near[cosines(query, values[near]) >= cosine]
                    pairs += [(min(node, o), max(node, o)) for o in nodes[good].tolist()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ((), ()))], names=["a", "b"])

    dealt = members.select(columns).union(queries.select(columns)).repartition("label", "list", "block")
    return dealt.sortWithinPartitions("label", "list", "block", "asks").mapInArrow(answer, "a long, b long").distinct()


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows linked directly), component_id, kept.

    Vectors are linked within one label, not null, at a cosine of at least `cosine` in double precision. Equal vectors of a
    label are one class with a count, so a frequent vector is searched once; a class links its own copies. Vectors that
    are null, empty, all zero or hold null or non-finite components, and rows without a label, link with nothing: they are
    their own component. Only vectors of one length meet. An empty table gives no rows."""
    rows = common.staged(classes_of(vectors, vec_id, embedding, label))
    classes = common.staged(
        rows.where("values is not null and label is not null").groupBy("values", "label")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    links = common.staged(links_of(classes, cosine))
    both = links.union(links.select("b", "a"))
    direct = (
        both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
        .withColumnRenamed("a", "node")
    )
    labels = components(links)
    first = classes.join(labels, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = (
        classes.join(direct, "node", "left").join(labels.join(first, "component"), "node", "left")
        .where("copies > 1 or others is not null")
        .select("values", "label", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    )
    joined = rows.join(of_class, ["values", "label"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
