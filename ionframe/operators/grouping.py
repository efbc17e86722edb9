"""Numbering and packing the rows of a group.

Numbering never brings a group into one task: rows are numbered in consecutive pieces, and each piece is shifted by the
rows before it. Packing makes one row of a group, whatever its size, because that row is the result; it must fit a row
(2**31 - 16 elements)."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions of a group that are numbered in one piece; a layout parameter that no result depends on.
PIECE_ROWS = 1_000_000

_PIECE, _KEY, _N, _OFFSET = "_piece", "_key", "_n", "_offset"


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, split: Column) -> DataFrame:
    """Zero-based position of every row within its group.

    ``split`` is a non-null integer expression that never decreases along the group's order. Rows are numbered inside
    their (group, ``split``) piece, and each piece is shifted by the number of rows in the pieces before it. The shifts
    come from a count per piece, combined before its shuffle, so the only data shuffled whole is ``df`` itself, once. The
    explicit repartition matters: an input already partitioned by ``keys`` would otherwise satisfy the window and keep a
    large group in one task. Null is a key like any other.
    """
    # One struct for all keys: unlike a bare column it joins null to null, without another shuffle.
    cut = df.withColumns({_KEY: F.struct(*keys), _PIECE: split.cast("bigint")})
    in_piece = Window.partitionBy(_KEY, _PIECE).orderBy(*order)
    before = Window.partitionBy(_KEY).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(_KEY, _PIECE)
        .agg(F.count(F.lit(1)).alias(_N))
        .select(_KEY, _PIECE, F.sum(_N).over(before).alias(_OFFSET))
        .filter(F.col(_OFFSET).isNotNull())
    )
    numbered = cut.repartition(_KEY, _PIECE).withColumn(_N, F.row_number().over(in_piece) - 1)
    position = F.col(_N) + F.coalesce(F.col(_OFFSET), F.lit(0))
    return (
        numbered.join(offsets, [_KEY, _PIECE], "left")
        .withColumn(out, position.cast("bigint"))
        .select(*df.columns, out)
    )


def pack(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], items: str = "items"
) -> DataFrame:
    """Collect each group's ``values``, in order, into one array of structs: one row per group. One shuffle, after the
    rows of a group that sit in one input partition have been put together."""
    return df.groupBy(*keys).agg(ordered_list(order, values).alias(items))


def ordered_list(order: Sequence[str], values: Sequence[str]) -> Column:
    return F.array_sort(F.collect_list(_entry(order, values)))


def _entry(order: Sequence[str], values: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in (*order, *[v for v in values if v not in order])])


def pack_under(
    headers: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    items: str = "items",
    tasks: int | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """``headers`` (one row per group) with their ``rows`` packed beside them, as ``pack`` does.

    Headers and rows meet in the one shuffle that packs, so the arrays are not shuffled again for a join. A
    header without rows keeps an empty array; rows without a header are dropped. ``tasks`` is the number of tasks they
    meet in, for results that take long to work on; otherwise Spark merges small partitions by their bytes. With ``by``, some of the
    ``keys``, groups that are equal in them come to one task.
    """
    keys = list(keys)
    rows = rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    head = F.struct(*[c for c in headers.columns if c not in keys])
    both = headers.select(*keys, head.alias("_head")).unionByName(
        rows.select(*keys, _entry(order, values).alias("_item")), allowMissingColumns=True
    )
    spread = both.repartition(tasks, *(by or keys)) if tasks else both
    packed = (
        spread.groupBy(*keys)
        .agg(F.max("_head").alias("_head"), F.array_sort(F.collect_list("_item")).alias(items))
        .filter(F.col("_head").isNotNull())
        .select(*keys, "_head.*", items)
    )
    # A session that asks for all keys of a group shuffles for the grouping once more.
    apart = tasks and by and headers.sparkSession.conf.get("spark.sql.requireAllClusterKeysForDistribution") == "true"
    return packed.repartition(tasks, *by) if apart else packed
