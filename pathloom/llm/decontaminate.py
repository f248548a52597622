"""Benchmark decontamination: Wu-Manber search with words as the alphabet.

Every window of ``window`` consecutive words of a benchmark item is a pattern; an item of fewer words is one
pattern. Patterns of one length are searched together. A block is two words (one for patterns of one word). The
shift table tells, for the block that ends at a position, how many words may be skipped because no pattern
can end there; only where the shift is zero does the hash of the block, a suffix of the pattern, select a bucket of
patterns, and the words themselves are compared. Many cursors move at once, one for each stretch of text.

The pattern tables are broadcast: benchmark suites are small, and their size is checked against
``MAX_TABLE_BYTES``. A larger suite is searched in parts of that size, each part with tables of its own, and results are
added up per document.

Defined cases: null and empty texts have no words and are clean; items without words match nothing; repeated rows
are each reported; repeated items count as one per item_id; items
without item_id hit like any other and count together as one item, which is null among ``hit_items`` and so absent from the hashed names; extra columns stay, and of clashing names
those of the operator win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from pathloom.llm.common import blocks, keep_columns, lower_bytes, mix, raw, span_hashes, spans

TABLE_BITS = 18
STRETCH = 128  # words that one cursor searches
MAX_TABLE_BYTES = 64 << 20
PAIR = np.uint64(0xD6E8FEB86659FD93)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: digits, a-z and all of non-ASCII."""
    return ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)


@dataclass
class Texts:
    """Lower-cased bytes of some texts, their words, and the first word of each text (n + 1 values)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Texts:
        data, begins = raw(texts)
        data = lower_bytes(data)
        starts, ends = spans(word_bytes(data))
        return cls(data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, begins))

    def words(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n]))


def _blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each word; the first ones of two are of no use."""
    if size == 1:
        return hashes
    out = hashes.copy()
    out[1:] = mix(hashes[:-1] * PAIR + hashes[1:])
    return out


def _ordered(items: set) -> list:
    """Items in order, the one without id last."""
    return sorted(items, key=lambda x: (x is None, x))


class PatternTables:
    """Shift table and suffix buckets of patterns that have the same number of words."""

    def __init__(self, length: int, patterns: dict[bytes, set]):
        self.length, self.size = length, min(2, length)
        texts = sorted(patterns)
        self.patterns = texts
        self.items = [_ordered(patterns[t]) for t in texts]
        t = Texts.of(pa.array([x.decode() for x in texts]))
        found = _blocks_of(t.hashes, self.size)
        last = np.arange(len(texts)) * length + length - 1
        self.shift = np.full(1 << TABLE_BITS, length - self.size + 1, np.int16)
        for back in range(length - self.size, -1, -1):  # ends with the last blocks, whose shift is the least
            self.shift[self.slot(found[last - back])] = back
        order = np.argsort(found[last], kind="stable")
        self.suffix, self.pattern = found[last][order], order

    @staticmethod
    def slot(found: np.ndarray) -> np.ndarray:
        return (found >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, t: Texts) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        n = len(t.hashes)
        if n < self.length:
            return
        found = _blocks_of(t.hashes, self.size)
        skip = self.shift[self.slot(found)].astype(np.int64)
        stop = np.append(np.arange(self.length - 1 + STRETCH, n, STRETCH), n)
        at = np.arange(self.length - 1, n, STRETCH)[: len(stop)]
        stop = stop[: len(at)]
        hits = []
        while len(at):
            step = skip[at]
            hits.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(hits)
        low = np.searchsorted(self.suffix, found[ends], "left")
        high = np.searchsorted(self.suffix, found[ends], "right")
        some = high > low
        doc = np.searchsorted(t.first, ends[some], "right")
        for end, a, b, d in zip(ends[some].tolist(), low[some].tolist(), high[some].tolist(), doc.tolist()):
            start = end - self.length + 1
            if start < t.first[d - 1]:
                continue
            words = t.words(start, self.length)
            for k in self.pattern[a:b]:
                if self.patterns[k] == words:
                    yield start, int(k)


def pattern_tables(items: pd.DataFrame, window: int) -> list[PatternTables]:
    """Tables of all windows of ``items`` (item_id, text), one for each pattern length."""
    by_length: dict[int, dict[bytes, set]] = {}
    t = Texts.of(pa.array(items["text"], pa.string()))
    for i, item in enumerate(items["item_id"]):
        a, b = int(t.first[i]), int(t.first[i + 1])
        n = min(window, b - a)
        for at in range(a, b - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(t.words(at, n), set()).add(item)
    return [PatternTables(n, p) for n, p in sorted(by_length.items())]


def _search_all(tables: list[PatternTables], t: Texts, n: int) -> tuple[list[list[int]], list[set]]:
    """For each of ``n`` texts: its words that are hit (positions in the text) and its items."""
    cover = np.zeros(len(t.hashes) + 1, np.int32)
    items: list[set] = [set() for _ in range(n)]
    for table in tables:
        for start, k in table.search(t):
            cover[start] += 1
            cover[start + table.length] -= 1
            items[int(np.searchsorted(t.first, start, "right")) - 1].update(table.items[k])
    hit = np.flatnonzero(np.cumsum(cover[:-1]))
    cuts = np.searchsorted(hit, t.first)
    return [hit[a:b] - f for a, b, f in zip(cuts[:-1], cuts[1:], t.first)], items


def parts_of(benchmark: DataFrame, part_bytes: int) -> Iterator[pd.DataFrame]:
    """The items in parts whose texts have at most ``part_bytes`` bytes, one item at least."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    rows, held = [], 0
    for r in items.toLocalIterator():
        size = len(r["text"].encode())
        if rows and held + size > part_bytes:
            yield pd.DataFrame(rows, columns=["item_id", "text"], dtype=object)
            rows, held = [], 0
        rows.append((None if r["item_id"] is None else str(r["item_id"]), r["text"]))
        held += size
    yield pd.DataFrame(rows, columns=["item_id", "text"], dtype=object)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, table_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """``docs`` plus n_words, hit_words (positions of hit words) and hit_items, from a pass per part of the benchmark.

    A pattern takes about ten times ``window`` the bytes of its item's text, so a part has table_bytes / (10 * window) of them.
    """
    added = ("n_words", "hit_words", "hit_items")
    keep = keep_columns(docs, *added)
    schema = StructType(
        [
            *[docs.schema[c] for c in keep],
            StructField("n_words", LongType()),
            StructField("hit_words", ArrayType(LongType())),
            StructField("hit_items", ArrayType(StringType())),
        ]
    )
    out = docs.select(*keep)
    for part, items in enumerate(parts_of(benchmark, table_bytes // (10 * window))):
        shared = docs.sparkSession.sparkContext.broadcast(pattern_tables(items, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, more=bool(part)) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches):
                t = Texts.of(texts)
                hit, items = _search_all(shared.value, t, len(texts))
                items = [_ordered({None if i is None else str(i) for i in x}) for x in items]
                if more:  # add to what earlier parts have found
                    hit = [sorted({*h.tolist(), *old}) for h, old in zip(hit, batch.column("hit_words").to_pylist())]
                    items = [_ordered({*x, *old}) for x, old in zip(items, batch.column("hit_items").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in keep],
                        pa.array(np.diff(t.first), pa.int64()),
                        pa.array(hit, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*keep, *added],
                )

        out = out.mapInArrow(search, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Nothing of the documents shuffles."""
    found = occurrences(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns."""
    return occurrences(docs, benchmark, window).filter(F.size("hit_words") == 0).select(*docs.columns)
