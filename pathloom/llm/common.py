"""What several corpus operators share: text blocks for NumPy, word hashes, columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20  # text bytes that NumPy holds at once; one longer document is a block of its own
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, each followed by one zero byte, and where each begins (n + 1 values)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    source = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    starts = ends - ends[0] + np.arange(len(ends))
    out = np.zeros(starts[-1], np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = source
    return out, starts


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches so that the texts of a piece have at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at), texts.slice(at, stop - at)
            at = stop


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last value must be False."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running polynomial."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def give_back() -> None:
    """Return freed memory to the system after large work in the driver's Python, which shares one limit with its JVM."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def keep_columns(docs: DataFrame, *added: str) -> list[str]:
    """Columns of the input that do not clash with what an operator adds."""
    return [c for c in docs.columns if c not in added]


def bounded_sample(frame: DataFrame, key: Column, rows: int, of: int, spare: int = 4) -> DataFrame:
    """``rows`` rows at most, those with the least hash of ``key``; the same ones for any partitioning.

    ``of``: how many rows ``frame`` has about. A share of ``spare`` times the rows wanted is taken by hash first, so
    that each task hands on few rows.
    """
    share = min(1.0, spare * rows / max(1, of))
    h = F.xxhash64(F.lit(7), key)
    bound = min(int((share * 2 - 1) * 2**63), 2**63 - 1)
    return frame.withColumn("_h", h).filter(F.col("_h") <= F.lit(bound)).orderBy("_h", key).limit(rows).drop("_h")
