"""What several operators of this package share: table access, bounded caches, staged tables, text rules."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.session import scratch_path

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bytes of rows that Spark hands to a Python worker at a time where `batches_of` holds. A batch is held in an executor's direct memory and
#: in its worker, so a batch of 10,000 texts or sets, Spark's default, costs each task several times 30 MB.
BATCH = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Other characters that str.split() takes for white space and the word rule does not.
_OTHER_SPACE = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null or empty one."""
    if not text:
        return []
    if any(c in text for c in _OTHER_SPACE[:4]) or not text.isascii() and any(c in text for c in _OTHER_SPACE[4:]):
        return WORD.findall(text)
    return text.split()


def ascii_lower(text: str | None) -> str:
    """A-Z to a-z and nothing else; null as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def crc_of(key: Column) -> Column:
    """crc32 of a key's text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


class Cache(dict):
    """Memory of a pure function of a string. Two generations bound it: when the young one is full it becomes the old
    one, and what is asked for again moves back. Strings above `longest` are never kept."""

    def __init__(self, function: Callable, size: int = 200_000, longest: int = 64):
        super().__init__()
        self.function, self.size, self.longest, self.old = function, size, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = {}
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def in_slices(batches: Iterable[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about `size` bytes, so that what is made from one stays small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def set_batches(spark: SparkSession, size: int = BATCH) -> str:
    """From now on what this session runs gives Python workers batches of about `size` bytes, or of fewer where the session says so.
    Returns what it said before."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(min(size, _in_bytes(before))))
    return before


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """`set_batches` for a while."""
    before = set_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def _in_bytes(size: str) -> int:
    """A size as Spark's settings give it, such as 67108864b or 64m; 0 or less is no limit for Spark."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    n = int(number) << 10 * " kmgtp".index(unit or " ")
    return n if n > 0 else 1 << 31


def staged(df: DataFrame, batch: int | None = None) -> DataFrame:
    """The frame written as Parquet into the shared folder of `spark.checkpoint.dir` and read back: lineage ends here,
    columns stay prunable, and a lost executor loses nothing. `batch`: bytes that Python workers get at a time meanwhile."""
    path = scratch_path(df.sparkSession, "llm")
    with batches_of(df.sparkSession, batch) if batch else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys from batches sorted by them; a run over a batch's end is joined with its rest."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for start, end in zip(starts, starts[1:]):
            yield batch.slice(start, end - start)
        rest = batch.slice(starts[-1])
    if rest is not None:
        yield rest
