"""Connected components of links, as joins and groupings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm.common import staged

#: Links that a worker brings together at a time.
SLICE = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b): component is the smallest node reachable.

    A round links each node to the smallest neighbour of its smaller neighbour, then a node's smaller neighbours to the smallest of
    them. Both keep the components and leave stars round the smallest nodes; the rounds grow with the logarithm of the longest path.
    Tasks bring together what they hold of the links before these are dealt by node, so a node comes once from each slice
    of a task, however many links it has. There are never more links than before, and each round is written to the shared folder.
    Links of a node with itself and repeated ones do no harm; no links give no rows."""
    links = _met(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while _entangled(links):
        least = links.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "b")
        links = _met(links.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b")))
    own = links.select(F.col("b").alias("a"), "b")
    return links.union(own).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _met(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, of the same components, written to the shared folder: all links of an a have been in one slice."""
    dealt = links.mapInArrow(lambda batches: _slices_as_stars(batches, False), "a long, b long").repartition("a").sortWithinPartitions("a")
    return staged(dealt.mapInArrow(lambda batches: _slices_as_stars(batches, True), "a long, b long"))


def _slices_as_stars(batches: Iterable[pa.RecordBatch], by_node: bool) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of each slice as stars round the smallest nodes; `by_node`: of sorted links, those of an a in one slice."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        if sum(part.shape[1] for part in held) >= SLICE:
            whole = np.concatenate(held, axis=1)
            end = int(np.searchsorted(whole[0], whole[0, -1])) if by_node else whole.shape[1]
            held = [whole[:, end:]]
            if end:
                yield stars(whole[:, :end])
    if held:
        yield stars(np.concatenate(held, axis=1))


def stars(links: np.ndarray) -> pa.RecordBatch:
    """(a, b) of each node a of some links that is not the smallest node b of its component."""
    nodes, places = np.unique(links, return_inverse=True)
    one, other = places.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(one):
        ends = label[one], label[other]
        np.minimum.at(label, np.maximum(*ends), np.minimum(*ends))
        while (label[label] != label).any():
            label = label[label]
        apart = label[one] != label[other]
        one, other = one[apart], other[apart]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.record_batch([pa.array(nodes[away], pa.int64()), pa.array(nodes[label[away]], pa.int64())], names=["a", "b"])


def _entangled(links: DataFrame) -> bool:
    """Whether some node of links (a, b), a > b, has two smaller neighbours, or both smaller and larger ones. If none has, the
    links are stars round their smallest nodes."""
    ends = links.select(F.col("a").alias("node"), "b").union(links.select("b", F.lit(None).cast("long")))
    met = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("larger"))
    return not met.where("low < high or low is not null and larger").isEmpty()
