"""Fetching spectra by id and extracting peaks in (m/z, retention time, MS level) boxes."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionframe.functions import columns as C
from ionframe.operators.layout import SPECTRUM

# Cells of the grid that boxes are found by, of the order of a usual box. Any size gives the same peaks.
MZ_CELL, RT_CELL = 1.0, 120.0

BOXES = T.StructType([
    T.StructField("box_id", T.LongType()),
    T.StructField("ms_level", T.ByteType()),
    T.StructField("mz", T.DoubleType()),
    T.StructField("mz_tol", T.DoubleType()),
    T.StructField("rt", T.DoubleType()),
    T.StructField("rt_tol", T.DoubleType()),
    T.StructField("run_id", T.StringType()),
])


def fetch_by_ids(df: DataFrame, ids: Sequence | DataFrame) -> DataFrame:
    """The spectrum rows of a list of ids, of ``(run_id, id)`` pairs, or of a DataFrame with ``id`` and perhaps ``run_id``.

    Native ids start anew in every run, so an id alone fetches its spectrum from each run. A list reaches the
    Parquet scan as an IN predicate. Nulls fetch nothing.
    """
    return _with_ids(df.filter(F.col("data_type") == SPECTRUM), ids)


def _with_ids(spectra: DataFrame, ids: Sequence | DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        keys = [c for c in ("run_id", "id") if c in ids.columns]
        return spectra.join(ids.select(*keys), keys, "left_semi")
    ids = [i for i in ids if i is not None]
    pairs = [i for i in ids if not isinstance(i, str)]
    if len(pairs) not in (0, len(ids)):
        raise ValueError("give either ids or (run_id, id) pairs")
    if not pairs:
        return spectra.filter(_among("id", map(_text, ids)))
    pairs = [p for p in pairs if None not in p]
    among = _among("run_id", {_text(r) for r, _ in pairs}) & _among("id", {_text(i) for _, i in pairs})
    return spectra.filter(among & _among("struct(run_id, id)", (f"struct({_text(r)}, {_text(i)})" for r, i in pairs)))


def _text(s: str) -> str:
    """A string as SQL, whatever characters it has."""
    return f"cast(X'{s.encode().hex()}' as string)"


def _among(what: str, values: Iterable[str]) -> Column:
    """``what in (values)``. Parsed from one text: a call per value would take longer than the fetch."""
    listed = ", ".join(values)
    return F.expr(f"{what} in ({listed})") if listed else F.lit(False)


#: Spectra of an index that may be looked up on the driver, and the boxes that their places are covered by.
MOST_PLACES, MOST_COVERS = 10_000, 32


def fetch_indexed(long: DataFrame, index: DataFrame, ids: Sequence | DataFrame) -> DataFrame:
    """The rows that ``fetch_by_ids`` fetches, from a store whose index tells where spectra lie (``tables.read_index``).

    Ids are scattered over the clustered layout, but each spectrum has one run, level and RT. Those of the ids asked for are
    looked up when the plan is made; in the store's order they are cut into at most ``MOST_COVERS`` boxes, whose bounds reach
    the Parquet scan, so it skips all row groups beside them. Ids are then compared as without an index. More than
    ``MOST_PLACES`` spectra are fetched without bounds: so many lie everywhere. Ids that the index lacks have no rows.
    """
    fetched = fetch_by_ids(long, ids)
    rt = F.nanvl("rt", F.lit(None).cast("float")).alias("rt")
    places = _with_ids(index, ids).select("run_id", "ms_level", rt).distinct().limit(MOST_PLACES + 1).collect()
    if len(places) > MOST_PLACES:
        return fetched
    if not places:
        return fetched.filter(F.lit(False))
    covers = (_cover(part) for part in _cut(sorted(places, key=_store_order), MOST_COVERS))
    return fetched.filter(" or ".join(f"({cover})" for cover in covers))


def _store_order(place) -> tuple:
    """The order of the clustered layout; nulls first."""
    low = -float("inf")
    return (place["run_id"] or "").encode(), *(low if place[c] is None else place[c] for c in ("ms_level", "rt"))


def _cut(places: list, most: int) -> list[list]:
    """Consecutive parts, as many as allowed: cut where the run or level changes and at the widest steps of RT, or into equal
    parts where runs and levels are too many."""
    order = [_store_order(p) for p in places]
    change = [i for i in range(1, len(places)) if order[i][:2] != order[i - 1][:2]]
    if len(change) >= most:
        cuts = list(range(0, len(places), -(-len(places) // most)))[1:]
    else:
        steps = sorted(set(range(1, len(places))) - set(change), key=lambda i: order[i - 1][2] - order[i][2])
        cuts = sorted(change + steps[: most - 1 - len(change)])
    return [places[a:b] for a, b in zip([0, *cuts], [*cuts, len(places)])]


def _cover(places: list) -> str:
    """The bounds of some places; a column that is null in one of them is not bounded."""
    bounds = ["true"]
    for name, literal in (("run_id", _text), ("ms_level", "cast({} as byte)".format), ("rt", "cast('{!r}' as float)".format)):
        values = {p[name] for p in places}
        if None not in values:
            order = str.encode if name == "run_id" else None
            lo, hi = literal(min(values, key=order)), literal(max(values, key=order))
            bounds.append(f"{name} = {lo}" if lo == hi else f"{name} between {lo} and {hi}")
    return " and ".join(bounds)


def sample_ids(ids: DataFrame, n: int, rank: Column | None = None, seed: int = 42) -> DataFrame:
    """``n`` spectra ``(run_id, id)`` without replacement, the same ones on every run: those with the smallest hash."""
    rank = F.xxhash64(F.col("run_id"), F.col("id"), F.lit(seed)) if rank is None else rank
    return ids.orderBy(rank, "run_id", "id").limit(n).select("run_id", "id")


def fetch_sampled(df: DataFrame, ids: DataFrame, n: int, rank: Column | None = None) -> DataFrame:
    """All rows of ``n`` sampled spectra."""
    return fetch_by_ids(df, sample_ids(ids, n, rank))


def at_level(ms_level: int | Sequence[int]) -> Column:
    """MS level equal to one level, or one of several. Rows without a level never match."""
    levels = [ms_level] if isinstance(ms_level, int) else list(ms_level)
    return F.col("ms_level").isin([F.lit(k).cast("byte") for k in levels])


def in_box(mz: float, mz_tol: float, rt: float, rt_tol: float, ms_level: int | Sequence[int]) -> Column:
    """The predicate of one extraction box over the long layout. Every conjunct reaches the Parquet scan."""
    return (
        (F.col("data_type") == SPECTRUM)
        & at_level(ms_level)
        & C.around(F.col("rt"), rt, rt_tol)
        & C.around(F.col("mz"), mz, mz_tol)
    )


def extract_box(
    long: DataFrame, mz: float, mz_tol: float, rt: float, rt_tol: float, ms_level: int | Sequence[int]
) -> DataFrame:
    return long.filter(in_box(mz, mz_tol, rt, rt_tol, ms_level))


def spectra_with_mz(wide: DataFrame, mz: float, mz_tol: float, rt: float, rt_tol: float, ms_level: int) -> DataFrame:
    """Wide rows in the RT window and level that have a peak in the m/z window."""
    lo, hi = mz - mz_tol, mz + mz_tol
    rows = wide.filter(at_level(ms_level) & C.around(F.col("rt"), rt, rt_tol))
    return _may_hold(rows, lo, hi).filter(C.any_within(F.col("mz_array"), lo, hi, _element_type(wide)))


def extract_box_wide(wide: DataFrame, mz: float, mz_tol: float, rt: float, rt_tol: float, ms_level: int) -> DataFrame:
    """Peaks of one box from the wide layout, with their intensities."""
    lo, hi = mz - mz_tol, mz + mz_tol
    dtype = _element_type(wide)
    rows = wide.filter(at_level(ms_level) & C.around(F.col("rt"), rt, rt_tol))
    pairs = C.zip_shortest(F.col("mz_array"), F.col("intensity_array"), "mz", "intensity")
    hits = F.filter(pairs, lambda p: C.within(p["mz"], lo, hi, dtype))
    keep = [c for c in wide.columns if c not in ("mz_array", "intensity_array", "n_peaks", "mz_min", "mz_max")]
    return _may_hold(rows, lo, hi).select(*keep, F.inline(hits).alias("mz", "intensity"))


def _element_type(wide: DataFrame) -> str:
    return wide.schema["mz_array"].dataType.elementType.simpleString()


def _may_hold(wide: DataFrame, lo: float, hi: float) -> DataFrame:
    """Skip spectra whose stored m/z range misses the window; unlike the array test this is pushed down."""
    if "mz_min" not in wide.columns:
        return wide
    dtype = wide.schema["mz_min"].dataType.simpleString()
    return wide.filter((F.col("mz_max") >= F.lit(lo).cast(dtype)) & (F.col("mz_min") <= F.lit(hi).cast(dtype)))


def box_table(spark: SparkSession, boxes: Iterable[tuple]) -> DataFrame:
    """Boxes given as ``(box_id, ms_level, mz, mz_tol, rt, rt_tol)``, and perhaps the one ``run_id`` they are for."""
    return spark.createDataFrame([(*b, None)[:7] for b in boxes], BOXES)


def random_boxes(
    spark: SparkSession,
    n: int,
    ms_level: int,
    mz: tuple[float, float] = (200.0, 2000.0),
    rt: tuple[float, float] = (100.0, 1100.0),
    mz_tol: float = 0.1,
    rt_tol: float = 60.0,
    seed: int = 42,
) -> DataFrame:
    """``n`` boxes with centres drawn uniformly, the same for the same seed: an axis' share is the first 52 bits of the MD5 of
    ``seed:axis:box_id``, axis 0 being m/z and 1 RT."""

    def uniform(span: tuple[float, float], axis: int) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{axis}:"), F.col("id"))), 1, 13), 16, 10).cast("double")
        return F.lit(float(span[0])) + bits / F.lit(2.0**52) * F.lit(float(span[1] - span[0]))

    return spark.range(n).select(
        F.col("id").alias("box_id"),
        F.lit(ms_level).cast("byte").alias("ms_level"),
        uniform(mz, 0).alias("mz"),
        F.lit(mz_tol).alias("mz_tol"),
        uniform(rt, 1).alias("rt"),
        F.lit(rt_tol).alias("rt_tol"),
        F.lit(None).cast("string").alias("run_id"),
    )


def extract_boxes(
    long: DataFrame, boxes: DataFrame, mz_cell: float = MZ_CELL, rt_cell: float = RT_CELL
) -> DataFrame:
    """All peaks of all boxes in one pass: a range join made of an equi-join and an exact re-check.

    m/z and RT are cut into a grid whose cells double in width from level to level. A box asks, on each axis, at the finest level
    where it touches two cells at most, so it is four rows at most however wide it is; a peak is asked for at the pairs of levels
    that boxes use (one, where all boxes have the same tolerances), in one cell of each, so a box finds each peak once. Spark
    broadcasts the boxes while they are small, so that the peaks are not shuffled; otherwise it joins on (level, cells), with both
    axes in the key so that a crowded m/z alone does not make one heavy key. A box with a ``run_id`` finds peaks of that run
    only. The pairs of levels in use, at most some 40 x 40, are asked for when the plan is made.
    """
    asked = box_cells(boxes, mz_cell, rt_cell)
    pairs = sorted((r["_mz_level"], r["_rt_level"]) for r in asked.select("_mz_level", "_rt_level").distinct().collect())
    levels = F.array(*[F.struct(F.lit(m).alias("mz"), F.lit(r).alias("rt")) for m, r in pairs]).cast("array<struct<mz:int,rt:int>>")
    peaks = long.filter(F.col("data_type") == SPECTRUM).withColumn(
        "_at", F.get(levels, F.lit(0)) if len(pairs) == 1 else F.explode(levels)
    ).withColumns({
        "_mz_at": _shifted(_cell(F.col("mz"), mz_cell), F.col("_at.mz")),
        "_rt_at": _shifted(_cell(F.col("rt"), rt_cell), F.col("_at.rt")),
    })
    same_cell = (
        (F.col("ms_level") == F.col("_level"))
        & (F.col("_at.mz") == F.col("_mz_level"))
        & (F.col("_at.rt") == F.col("_rt_level"))
        & (F.col("_mz_at") == F.col("_mz_cell"))
        & (F.col("_rt_at") == F.col("_rt_cell"))
        & (F.col("_run").isNull() | (F.col("_run") == F.col("run_id")))
    )
    inside = F.col("mz").between(F.col("_mz_lo"), F.col("_mz_hi")) & F.col("rt").between(
        F.col("_rt_lo"), F.col("_rt_hi")
    )
    return peaks.join(asked, same_cell & inside).select("box_id", *long.columns)


def box_cells(boxes: DataFrame, mz_cell: float = MZ_CELL, rt_cell: float = RT_CELL) -> DataFrame:
    """The bounds of boxes and the cells they ask in, a row per cell, four for a box at most."""
    if "run_id" not in boxes.columns:
        boxes = boxes.withColumn("run_id", F.lit(None).cast("string"))
    edges = boxes.select(
        F.col("run_id").alias("_run"),
        "box_id",
        F.col("ms_level").alias("_level"),
        (F.col("mz") - F.col("mz_tol")).cast("float").alias("_mz_lo"),
        (F.col("mz") + F.col("mz_tol")).cast("float").alias("_mz_hi"),
        (F.col("rt") - F.col("rt_tol")).cast("float").alias("_rt_lo"),
        (F.col("rt") + F.col("rt_tol")).cast("float").alias("_rt_hi"),
    ).filter("_mz_lo <= _mz_hi and _rt_lo <= _rt_hi")
    return _each_cell(_each_cell(edges, "_mz", mz_cell), "_rt", rt_cell)


#: Cells are numbered up to this far from zero; what lies beyond is in the last one.
LAST_CELL = 1 << 40


def _cell(c: Column, width: float) -> Column:
    return F.floor(F.greatest(F.least(c.cast("double") / F.lit(float(width)), F.lit(float(LAST_CELL))), F.lit(-float(LAST_CELL))))


def _shifted(cell: Column, level: Column) -> Column:
    return F.call_function("shiftright", cell, level)


def _each_cell(edges: DataFrame, axis: str, width: float) -> DataFrame:
    """A row for each of the one or two cells that an axis of a box touches at the finest level where it touches no more. Cells lo to hi do
    so at the first level k with 2 ** k >= hi - lo, as they cross one border at most there."""
    lo, hi = _cell(F.col(f"{axis}_lo"), width), _cell(F.col(f"{axis}_hi"), width)
    level = F.when(hi - lo <= 1, F.lit(0)).otherwise(F.length(F.bin(hi - lo - 1))).cast("int")
    at = edges.withColumn(f"{axis}_level", level)
    level = F.col(f"{axis}_level")
    return at.withColumn(f"{axis}_cell", F.explode(F.sequence(_shifted(lo, level), _shifted(hi, level))))


def hits_per_box(hits: DataFrame, boxes: DataFrame) -> DataFrame:
    """Peaks found per box; boxes without any count as zero."""
    counts = hits.groupBy("box_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return boxes.select("box_id").join(counts, "box_id", "left").select(
        "box_id", F.coalesce("n_hits", F.lit(0).cast("bigint")).alias("n_hits")
    )
