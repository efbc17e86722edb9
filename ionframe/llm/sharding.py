"""Rendezvous hashing of records over weighted shards."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one shard are numbered in this many independent cells.
CELLS = 512


def _better(a: Column, b: Column) -> Column:
    """The entry with the higher score; the one named first wins a tie."""
    return F.when(b["score"] > a["score"], b).otherwise(a)


def shard_of(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard of a key among `(shard, weight)`: the one with the highest -weight / ln(u), u a uniform hash of key
    and shard. A shard's share of the keys is its weight's; adding a shard moves keys only into it, dropping one
    moves only its own. Equal scores go to the shard named first. A null key is a key like any other (the empty
    text), so all of them share a shard."""
    if not shards or any(w <= 0 for _, w in shards) or len({s for s, _ in shards}) < len(shards):
        raise ValueError("shards need distinct numbers and weights above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    entries = []
    for shard, weight in shards:
        bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(int(shard))), 11)
        u = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        entries.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(int(shard)).alias("shard")))
    # One column holds the scores, so that each hash is computed once.
    return F.aggregate(F.array(*entries[1:]), entries[0], _better, lambda e: e["shard"]) if entries[1:] else entries[0]["shard"]


def assign(rows: DataFrame, key: str, shards: Sequence[tuple[int, float]], cells: int = CELLS) -> DataFrame:
    """All rows with `shard` and `slot`, a number without gaps from 0 within the shard.

    Equal rows are counted before the shuffle, so neither a frequent key nor repeated rows fill one task; a shard's
    rows are numbered in `cells` cells by a hash of the whole row, behind offsets taken from shards x cells counts
    (that table is all that is broadcast, and its size is fixed). Within a cell the order is that of the columns.
    An empty table gives an empty table. The columns `shard`, `slot` must not be in the input."""
    columns = rows.columns
    counted = (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("shard", shard_of(F.col(key), shards))
        .withColumn("__cell", F.pmod(F.xxhash64(*columns), F.lit(cells)).cast("int"))
    )
    before = (
        counted.groupBy("shard", "__cell")
        .agg(F.sum("__n").alias("__rows"))
        .withColumn("__before", F.sum("__rows").over(Window.partitionBy("shard").orderBy("__cell")) - F.col("__rows"))
        .select("shard", "__cell", "__before")
    )
    within = Window.partitionBy("shard", "__cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("__before") + F.col("__end") - F.col("__n")
    return (
        counted.withColumn("__end", F.sum("__n").over(within))
        .join(F.broadcast(before), ["shard", "__cell"])
        .select(*columns, "shard", F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("slot"))
    )


def shard_documents(
    documents: DataFrame, shards: Sequence[tuple[int, float]], added: tuple[int, float] | None = None,
    doc_id: str = "doc_id", text: str = "text", cells: int = CELLS,
) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, shard, slot, and
    grown_shard: the shard once `added` has joined (null without one). Other columns are not read."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = assign(rows, "doc_id", shards, cells)
    grown = shard_of(F.col("doc_id"), [*shards, added]) if added else F.lit(None).cast("int")
    return placed.withColumn("grown_shard", grown)


equal_shards = functools.cache(lambda n: tuple((s, 1.0) for s in range(n)))
