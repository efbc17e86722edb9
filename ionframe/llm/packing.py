"""Packing by power-of-two decomposition: no sequence crosses documents, and none needs padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common, wordbpe

#: Tokens of the longest sequence.
LONGEST = 4096

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("bucket", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
])


def cuts(n: int, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the longest as fit, then the binary digits of the rest,
    long to short, so the lengths are powers of two and sum to n."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def pack(
    documents: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text",
    keep_ids: bool = True, keep_memory: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens (of its document, end id included), bucket (length is
    2 ** bucket), ids_crc32, ids (binary, little-endian unsigned 32-bit numbers), sequence_id, offset.

    Each piece is a sequence of its own: pieces of one bucket are stacked to batches as they are, so `offset` is 0 and
    nothing is padded. A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null
    doc_id stays null. sequence_id is unique: the partition's number and a count in it; the input is only read, never
    shuffled, so a task that runs again gives the same numbers. `tokenizer` is a file of word BPE, read by each worker.
    `keep_ids=False` leaves the ids out, for reports. A worker remembers words from task to task; `keep_memory=False` makes it remember
    fewer, take smaller slices, and forget all, the tokenizer too, after each task, for jobs whose other stages need the memory."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = wordbpe.library_encoder(tokenizer, 250_000 if keep_memory else 60_000), wordbpe.packed([end_id])
        for batch in common.in_slices(batches, 8 << 20 if keep_memory else 1 << 20):
            columns = [[] for _ in _PIECES]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(body) + end
                n = len(ids) // 4
                for start, length in cuts(n, longest):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (key, start, length, n, length.bit_length() - 1, zlib.crc32(own), own if keep_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
        if not keep_memory:
            encoder.forget()
            del encoder
            wordbpe.unload()
            pa.default_memory_pool().release_unused()

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(
        pieces, "doc_id long, start long, length long, doc_tokens long, bucket int, ids_crc32 long, ids binary"
    ).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return out if keep_ids else out.drop("ids")


def write_buckets(sequences: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Sequences with their ids as Parquet, one folder per bucket: each file holds sequences of one length, so a
    loader stacks them without padding. Rows are spread by sequence, so a common length fills many tasks."""
    (
        sequences.repartition("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(64)))
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("bucket")
        .parquet(path)
    )
