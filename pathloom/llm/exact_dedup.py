"""Exact duplicates: a two-pass Bloom filter finds possibly repeated hashes, and only those rows shuffle.

Pass 1 counts, in slots of a filter that saturate at two, how many rows hit each slot. Slots are added
up across tasks, so a text that occurs twice in two places has two in every slot it touches. Pass 2 tests every row: one with a slot below
two is certainly unique and goes straight through; the others are grouped by their full SHA-256, so a
false alarm costs a shuffled row and never a wrong answer.

The filter has SLOTS_PER_ROW slots for each row, one bit each when broadcast, up to ``FILTER_BYTES``, which bounds what is
broadcast. Beyond that bound it fills up: more unique rows join the exact step (rows of a hash and an id, never
texts), and the answer stays the same. Rows of a hash that more than SPLIT_ROWS rows have meet their group in several tasks.

Defined cases: a null text counts as empty; all empty texts are one group. Only A-Z are lower-cased.
Of equal texts the row with the largest doc_id stays; a null doc_id counts as smaller than any. Rows repeated with the
same doc_id and equal text all carry the same verdict, and ``deduplicate`` keeps one of them. Extra columns
stay in ``deduplicate``; names the operator needs for itself start with ``_xd_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pathloom.llm.common import lower_ascii, text_or_empty
from pathloom.operators.skew import MAX_SENT_KEYS, salted_lookup
from pathloom.session import materialize

FILTER_BYTES = 64 << 20  # most the filter may take, and so the most that is broadcast
SEGMENT = 64 << 10  # slots of a part of the filter; a row's probes lie in one part
PROBES = 4
SLOTS_PER_ROW = 8
SPLIT_ROWS = 1000  # rows of one hash that may share a task; more where that would make too long a list of hashes
FLUSH_SLOTS = 2_000_000  # slots that a task gathers before it hands them on


def _slots(head: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of the filter and the probed slots in it, from the first 8 bytes of the hash."""
    part = ((head >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
    low = head & np.uint64(0xFFFFFFFF)
    step = (low >> np.uint64(16)) | np.uint64(1)
    at = [((low + np.uint64(i) * step) % np.uint64(SEGMENT)).astype(np.int64) for i in range(PROBES)]
    return part, np.stack(at, 1)


def _heads(hashes: pa.Array) -> np.ndarray:
    joined = b"".join(x[:8] for x in hashes.to_pylist())
    return np.frombuffer(joined, np.uint64)


def _touched(slots: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Slots touched by each row, numbered through all parts; a row touches a slot once."""
    order = np.sort(slots, 1)
    first = np.ones(slots.shape, bool)
    first[:, 1:] = order[:, 1:] != order[:, :-1]
    return (order + part[:, None] * SEGMENT)[first]


def possibly_repeated(hashes: DataFrame, rows: int, filter_bytes: int = FILTER_BYTES) -> Callable[[DataFrame], DataFrame]:
    """Pass 1 over the column ``_xd_sha``; what comes back adds ``_xd_maybe`` to frames with that column.

    ``_xd_maybe`` is false only for a hash that certainly occurs once.
    """
    segments = int(min(max(1, -(-rows * SLOTS_PER_ROW // SEGMENT)), max(1, filter_bytes * 8 // SEGMENT)))

    def flush(touched: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if touched:
            slots, counts = np.unique(np.concatenate(touched), return_counts=True)
            part = slots // SEGMENT
            cuts = np.flatnonzero(np.diff(part)) + 1
            at = np.split((slots % SEGMENT).astype(np.uint16), cuts)
            more = np.split(counts > 1, cuts)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(part[np.concatenate([[0], cuts])].astype(np.int32)),
                    "at": pa.array([x.tobytes() for x in at], pa.binary()),
                    "more": pa.array([np.packbits(x).tobytes() for x in more], pa.binary()),
                }
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        touched: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                part, slots = _slots(_heads(batch.column(0)), segments)
                touched.append(_touched(slots, part))
            if sum(map(len, touched)) > FLUSH_SLOTS:
                yield from flush(touched)
                touched = []
        yield from flush(touched)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.uint8)
        for packed, more in zip(frame["at"], frame["more"]):
            at = np.frombuffer(packed, np.uint16)
            twice = np.unpackbits(np.frombuffer(more, np.uint8))[: len(at)]
            total[at] = np.minimum(total[at] + 1 + twice, 2)
        return pd.DataFrame({"part": [key[0]], "twice": [np.packbits(total >= 2).tobytes()]})

    counted = hashes.select("_xd_sha").mapInArrow(count, "part int, at binary, more binary")
    # one bit for each slot comes back: filter_bytes at most
    merged = counted.groupBy("part").applyInPandas(merge, "part int, twice binary").collect()
    bits = np.zeros((segments, SEGMENT // 8), np.uint8)
    for r in merged:
        bits[r["part"]] = np.frombuffer(r["twice"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(bits)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pa.array([], pa.bool_())
            if batch.num_rows:
                part, slots = _slots(_heads(batch.column("_xd_sha")), segments)
                hit = (shared.value[part[:, None], slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
                maybe = pa.array(hit.all(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe], names=[*batch.schema.names, "_xd_maybe"])

    def tested(frame: DataFrame) -> DataFrame:
        return frame.mapInArrow(test, StructType([*frame.schema.fields, StructField("_xd_maybe", BooleanType())]))

    return tested


def text_sha(column: str = "text"):
    return F.sha2(lower_ascii(text_or_empty(column)).cast("binary"), 256)


def _repeats(tested: DataFrame) -> DataFrame:
    """Hash, largest doc_id and number of rows, for hashes that may be repeated.

    Partial sums come before the shuffle: a text that fills a third of the table is one row for each task.
    """
    return tested.filter("_xd_maybe").groupBy("_xd_sha").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )


def exact_groups(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = materialize(docs.select("doc_id", F.unhex(text_sha()).alias("_xd_sha")))
    hashes = hashes.withColumn("_xd_row", F.monotonically_increasing_id())
    rows = hashes.count()
    tested = possibly_repeated(hashes, rows, filter_bytes)(hashes)
    groups = materialize(_repeats(tested).withColumn("n", F.col("group_size")))
    per_task = max(SPLIT_ROWS, -(-rows // MAX_SENT_KEYS))
    alone = tested.filter(~F.col("_xd_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_xd_sha"
    )
    repeated = salted_lookup(tested.filter("_xd_maybe"), groups, ["_xd_sha"], "_xd_row", per_task).select(
        "doc_id", "keep_id", "group_size", "_xd_sha"
    )
    return alone.unionByName(repeated).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_xd_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Texts shuffle only where a hash may be repeated.

    The verdict is worked out on hashes and ids; rows whose hash may be repeated then meet it by hash, all rows of one text in one task.
    """
    rows = docs.withColumn("_xd_sha", F.unhex(text_sha()))
    hashes = materialize(rows.select("doc_id", "_xd_sha"))
    with_maybe = possibly_repeated(hashes, hashes.count(), filter_bytes)
    keep = _repeats(with_maybe(hashes)).select("_xd_sha", "keep_id")
    tested = with_maybe(rows)
    kept = (
        tested.filter("_xd_maybe")
        .join(keep.withColumnRenamed("keep_id", "_xd_keep"), "_xd_sha")
        .filter(F.col("doc_id").eqNullSafe(F.col("_xd_keep")))
        .dropDuplicates(["_xd_sha"])
    )
    alone = tested.filter(~F.col("_xd_maybe"))
    return alone.select(*docs.columns).unionByName(kept.select(*docs.columns))
