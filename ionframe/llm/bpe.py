"""BPE encoding by linked-list merging, and decoding by concatenating vocabulary strings."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.llm import common, wordbpe

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())
])


def decode_ids(ids: array, spellings: list[str], between: str = " ") -> str:
    """The vocabulary's strings of the ids, concatenated. The file has no decoder, so its library puts one space
    between strings and leaves word ends in; special strings stay."""
    return between.join(map(spellings.__getitem__, ids))


def encode(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian unsigned 32-bit numbers), n_tokens. A null or empty text
    has no ids; special strings in a text become their ids; very long texts are encoded whole. Rows are independent:
    repeated rows and null doc_ids come back as they are."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordbpe.encoder(tokenizer)
        for batch in common.in_slices(batches):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            counts = [len(i) // 4 for i in ids]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], schema=_ENCODED)

    return _texts(documents, doc_id, text).mapInArrow(rows, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of packed ids: doc_id, ids, decoded. Null ids count as none; an id beyond the vocabulary fails."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = wordbpe.load(tokenizer).spellings
        for batch in common.in_slices(batches):
            texts = [decode_ids(wordbpe.unpacked(i or b""), spellings) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=_DECODED)

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        rows, "doc_id long, ids binary, decoded string"
    )


def digests(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encoding and decoding in one pass, reported as doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and
    decoded_sha256, so that the ids and texts need not be moved."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordbpe.encoder(tokenizer)
        spellings = encoder.bpe.spellings
        decimal = [str(i) for i in range(len(spellings))]
        for batch in common.in_slices(batches):
            counts, of_ids, of_text = [], [], []
            for text_ in batch.column(1).to_pylist():
                ids = wordbpe.unpacked(encoder.encode(text_))
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(decode_ids(ids, spellings).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                schema=_DIGESTS,
            )

    return _texts(documents, doc_id, text).mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
