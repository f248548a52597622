"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids (its tokens and the end id) are cut into as many pieces of ``length`` as it holds and then into the powers of two of the rest,
largest first. Each piece is a sequence of its own; sequences of equal length form a bucket from which batches of
one shape are read. All of it is one pass over the documents; nothing shuffles. Sequence numbers are unique but not
gapless; they hold for one evaluation, so write the result before using them twice.

Ids come from ``tokenizers_io.ByteBpe``, text by text; nothing is remembered between texts, so memory is that of one block of texts.

Defined cases: null and empty texts have the end id alone, one piece of length 1; a repeated row is packed as often as it occurs;
an empty table gives no piece; of extra columns none is returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import blocks
from pathloom.llm.tokenizers_io import ByteBpe

SEQUENCE = 2048
END_ID = 1


def decompose(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces of documents of ``n`` ids; longest first, ``longest`` a power of two."""
    sizes = [1 << k for k in range(longest.bit_length() - 1, -1, -1)]
    counts = np.stack([n // longest, *[(n % longest) // s % 2 for s in sizes[1:]]], 1).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), counts.sum(1))
    length = np.repeat(np.tile(sizes, len(n)), counts.ravel())
    ends = np.cumsum(length)
    before = np.concatenate([[0], np.cumsum(n)])[:-1]
    return doc, ends - length - before[doc], length


def pieces(docs: DataFrame, vocabulary: str | None = None, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids if asked for. Nothing shuffles."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(vocabulary)
        for batch, texts in blocks(batches):
            ids = [encoder.encode(x).tobytes() + end for x in texts.to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            doc, start, length = decompose(n, longest)
            parts = [
                memoryview(ids[d])[4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())
            ]
            columns = [
                batch.column("doc_id").take(pa.array(doc)),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array(n[doc], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence: bucket (log2 of the length), sequence_id and offset, which is always 0.

    A piece is a sequence, so its number only has to be unique: partition and row give it without a shuffle.
    """
    parts = pieces(docs, vocabulary, longest, with_ids)
    return parts.select(
        *parts.columns,
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader takes batches of one shape."""
    packed.write.partitionBy("length").parquet(path)
