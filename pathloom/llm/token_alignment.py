"""Alignment of two tokenizers over whole texts by divide and conquer at shared cuts.

Both id sequences of a text cover the same bytes. A cut is a byte offset where a token of either ends. An interval between
two cuts is divided at the cut nearest to its middle: from the middle token of A, bisection finds the first end of
B that is not before it, then the first end of A not before that one, and so on until both agree (to the left likewise, if there is no
cut to the right). Both halves are divided in turn; an interval without a cut inside is a leaf, one group. All intervals of one
depth, of all texts of a block, take each step together as NumPy arrays.

A link is a pair of token occurrences whose bytes overlap; in a group of a and b tokens there are a + b - 1 of them, as each end of either
token closes one. How often an id pair is linked in the whole corpus, and the highest such count of each id of B, come from
a partial aggregation (distinct pairs of each task, then of all); they grow with the corpus. They are looked up in
parts of PART_PAIRS pairs: each part is broadcast (16 bytes a pair) and all links pass it once; one part is the usual case.

Three steps, each from the written result of the one before, in the folder of ``spark.checkpoint.dir``: align, count, look up.

Defined cases: texts that are null or empty, or whose joined token bytes of A or B are not the space and the text, have no tokens: all numbers
are 0 and ``groups`` is ''. A repeated row counts as often as it occurs, and so do repeated ids; an empty table gives no row; of extra columns whose name
clashes with an added one, that of the operator wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from pathloom.llm.common import blocks, keep_columns, raw
from pathloom.llm.tokenizers_io import ByteBpe, PieceBpe, byte_table, joined
from pathloom.session import ensure_checkpoint_dir

PART_PAIRS = 4 << 20
FLUSH_PAIRS = 1 << 20
BLOCK = 1 << 20  # bytes of text at once
LINK_BYTES = 4 << 20  # of links at once
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: an id pair as one number: the id of A, then 16 bits of B
B_BITS = 16


# ---------------------------------------------------------------- cuts
def _cut_near_middle(a, b, lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Index in ``a`` and in ``b`` of the cut nearest to the middle of each interval; -1 where there is none inside.

    Intervals are half-open ranges of tokens whose last ends are equal; each has two tokens of both at least.
    """
    n = len(lo_a)
    cut_a, cut_b = np.full(n, -1), np.full(n, -1)
    middle = (lo_a + hi_a) // 2 - 1
    at, i = np.arange(n), middle
    while len(at):  # to the right; the end of the interval is a cut, so this ends there at the latest
        j = np.searchsorted(b, a[i], "left")
        met = b[j] == a[i]
        cut_a[at[met]], cut_b[at[met]] = i[met], j[met]
        at = at[~met]
        i = np.searchsorted(a, b[j[~met]], "left")
        inside = i < hi_a[at] - 1
        at, i = at[inside], i[inside]
    at = np.flatnonzero(cut_a < 0)
    i = middle[at]
    while len(at):  # to the left
        j = np.searchsorted(b, a[i], "right") - 1
        ok = j >= lo_b[at]
        at, i, j = at[ok], i[ok], j[ok]
        met = b[j] == a[i]
        cut_a[at[met]], cut_b[at[met]] = i[met], j[met]
        at, j = at[~met], j[~met]
        i = np.searchsorted(a, b[j], "right") - 1
        ok = i >= lo_a[at]
        at, i = at[ok], i[ok]
    return cut_a, cut_b


def divide(a: np.ndarray, b: np.ndarray, lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Last token of A and of B of every leaf group, in order.

    ``a`` and ``b`` hold the ends of all tokens, rising over all texts; the others hold the token ranges of each text.
    """
    last_b = np.full(len(a), -1, np.int32)  # by the last token of A
    while len(lo_a):
        wide = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        cut_a[wide], cut_b[wide] = _cut_near_middle(a, b, lo_a[wide], hi_a[wide], lo_b[wide], hi_b[wide])
        leaf = cut_a < 0
        last_b[hi_a[leaf] - 1] = hi_b[leaf] - 1
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = (x[~leaf] for x in (lo_a, hi_a, lo_b, hi_b, cut_a, cut_b))
        lo_a, hi_a = np.stack([lo_a, cut_a + 1], 1).ravel(), np.stack([cut_a + 1, hi_a], 1).ravel()
        lo_b, hi_b = np.stack([lo_b, cut_b + 1], 1).ravel(), np.stack([cut_b + 1, hi_b], 1).ravel()
    ends_a = np.flatnonzero(last_b >= 0)
    return ends_a, last_b[ends_a].astype(np.int64)


def overlaps(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of A and of B of every link, by the offset where the link ends; groups as ``divide`` gives them."""
    groups_before = np.searchsorted(ends_a, np.arange(len(a)), "left")
    # links that end before this token of A: one for each end of A or B before its end, cuts once
    links = np.arange(len(a)) + np.searchsorted(b, a, "left") - groups_before
    total = len(a) + len(b) - len(ends_a)
    closes_a = np.zeros(total, bool)
    closes_a[links] = True
    closes_b = ~closes_a
    closes_b[links[ends_a]] = True
    of_a, of_b = np.cumsum(closes_a), np.cumsum(closes_b)
    return of_a - closes_a, of_b - closes_b


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, names: pa.Array, first: tuple) -> tuple[memoryview, np.ndarray]:
    """``a1,a2|b1;`` of all groups on end, and where each group's text stops.

    ``names`` holds the decimal ids with the sign behind them: of A with ',' and '|', then of B with ',' and ';'; ``first`` tells
    where the last three of these four ranges begin.
    """
    n = len(ids_a) + len(ids_b)
    sizes_a = np.diff(ends_a, prepend=-1)
    sizes_b = np.diff(ends_b, prepend=-1)
    word = np.empty(n, np.int64)
    own_a, own_b = ids_a.astype(np.int64), ids_b.astype(np.int64) + first[1]
    own_a[ends_a] += first[0]
    own_b[ends_b] += first[2] - first[1]
    word[np.arange(len(ids_a)) + np.repeat(ends_b + 1 - sizes_b, sizes_a)] = own_a
    word[np.arange(len(ids_b)) + np.repeat(ends_a + 1, sizes_b)] = own_b
    made = names.take(pa.array(word))
    _, stops, data = made.buffers()
    stops = np.frombuffer(stops, np.int64)[1 : n + 1]
    return memoryview(data), stops[ends_a + ends_b + 1]


def _names(n_a: int, n_b: int) -> tuple[pa.Array, tuple]:
    signs = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
    return pa.array([f"{i}{s}" for n, s in signs for i in range(n)], pa.large_string()), (n_a, 2 * n_a, 2 * n_a + n_b)


class Aligner:
    """Both encoders and their tables; one for a task."""

    def __init__(self, path_a: str | None, path_b: str | None):
        self.a, self.b = ByteBpe(path_a, specials=False), PieceBpe(path_b)
        self.bytes_a, self.len_a = byte_table(self.a.token_bytes())
        self.bytes_b, self.len_b = byte_table(self.b.token_bytes())
        self.names, self.first = _names(len(self.len_a), len(self.len_b))

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [np.frombuffer(self.a.encode(" " + t), "<u4") if t else np.zeros(0, "<u4") for t in texts]
        b = [np.frombuffer(x, "<u4") if t else np.zeros(0, "<u4") for t, x in zip(texts, self.b.encode_batch(texts))]
        return a, b

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links, the text of its groups, and its links as little-endian pair numbers."""
        list_a, list_b = self.ids(texts)
        want = [b"" if not t else b" " + t.encode() for t in texts]
        for i, w in enumerate(want):
            if w and not (joined(self.bytes_a, list_a[i]) == w and joined(self.bytes_b, list_b[i]) == w):
                list_a[i] = list_b[i] = np.zeros(0, "<u4")
        n_a, n_b = np.array([len(x) for x in list_a], np.int64), np.array([len(x) for x in list_b], np.int64)
        ids_a, ids_b = np.concatenate([*list_a, np.zeros(0, "<u4")]), np.concatenate([*list_b, np.zeros(0, "<u4")])
        a, b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        if len(a) and a[-1] < 1 << 31:
            a, b = a.astype(np.int32), b.astype(np.int32)
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        has = n_a > 0
        ends_a, ends_b = divide(a, b, (stop_a - n_a)[has], stop_a[has], (stop_b - n_b)[has], stop_b[has])
        groups_to = np.searchsorted(ends_a, stop_a, "left")  # groups up to each text's end
        n_groups = np.diff(groups_to, prepend=0)
        n_links = np.where(has, n_a + n_b - n_groups, 0)
        of_a, of_b = overlaps(a, b, ends_a, ends_b)
        pairs = ((ids_a[of_a] << np.uint32(B_BITS)) | ids_b[of_b]).astype("<u4")
        links_to = np.cumsum(n_links)
        text, stops = group_text(ids_a, ids_b, ends_a, ends_b, self.names, self.first)
        stops = np.append(stops, 0)
        groups, links = [], []
        for i in range(len(texts)):
            g0, g1 = groups_to[i] - n_groups[i], groups_to[i]
            groups.append(bytes(text[(stops[g0 - 1] if g0 else 0) : stops[g1 - 1] - 1]) if g1 > g0 else b"")
            links.append(pairs[links_to[i] - n_links[i] : links_to[i]].tobytes())
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "links": links}


# ---------------------------------------------------------------- the three steps
def groups_of(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """``docs`` without ``text`` plus n_a, n_b, n_groups, n_links, groups and links. One pass, nothing shuffles.

    ``digest``: of ``groups`` only its SHA-256, as groups_sha256 ('' without tokens).
    """
    name = "groups_sha256" if digest else "groups"
    keep = keep_columns(docs, "text", *COUNTS, "links", "n_best", "count_sum", name)
    schema = StructType(
        [*[docs.schema[c] for c in keep], *[StructField(c, LongType()) for c in COUNTS], StructField(name, StringType()), StructField("links", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch, texts in blocks(batches, limit=BLOCK):
            found = aligner.align(texts.to_pylist())
            text = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]] if digest else [g.decode() for g in found["groups"]]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    *[pa.array(found[c], pa.int64()) for c in COUNTS],
                    pa.array(text, pa.string()),
                    pa.array(found["links"], pa.binary()),
                ],
                names=[*keep, *COUNTS, name, "links"],
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with at most LINK_BYTES of links (one row at least): first and last row, pair numbers, and each row's end in them."""
    links = batch.column("links")
    ends = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1].astype(np.int64)
    data = links.buffers()[2]
    at = 0
    while at < len(links):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + LINK_BYTES, "right")) - 1)
        size = int(ends[stop] - ends[at])
        numbers = np.frombuffer(data, "<u4", size // 4, ends[at]) if size else np.zeros(0, "<u4")
        yield at, stop, numbers, (ends[at + 1 : stop + 1] - ends[at]) // 4
        at = stop


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus; best where no pair of the same id of B has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair = np.concatenate([p for p, _ in held])
            unique, back = np.unique(pair, return_inverse=True)
            return unique, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        for numbers in (x for batch in batches for _, _, x, _ in _numbers(batch)):
            unique, n = np.unique(numbers, return_counts=True)
            held.append((unique, n))
            size += len(unique)
            if size > FLUSH_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH_PAIRS // 2:  # hand them on; Spark adds them up
                    yield _pairs_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _pairs_batch(*merged())

    counts = aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    # an id of B has at most as many rows here as A has ids
    top = F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))))
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


def _pairs_batch(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def look_up(aligned: DataFrame, counts: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of links; ``counts`` is read in parts of about ``part_pairs`` pairs."""
    spark = aligned.sparkSession
    total = counts.count()
    parts = max(1, -(-total // part_pairs))
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for part in range(parts):
        own = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part) if parts > 1 else counts
        table = own.toArrow()
        pair = table["pair"].to_numpy().astype(np.uint32)
        order = np.argsort(pair)
        signed = np.where(table["best"].to_numpy(), -1, 1) * table["count"].to_numpy()
        shared = spark.sparkContext.broadcast((pair[order], signed[order]))
        last = part == parts - 1
        schema = StructType([f for f in rows.schema if not (last and f.name == "links")])
        rows = rows.mapInArrow(_adder(shared, schema.names), schema)
    return rows


def _adder(shared, names: list[str]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, signed = shared.value
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            best, total = batch.column("n_best").to_numpy().copy(), batch.column("count_sum").to_numpy().copy()
            for at, stop, numbers, ends in _numbers(batch) if len(pairs) else ():
                place = np.minimum(np.searchsorted(pairs, numbers), len(pairs) - 1)
                value = np.where(pairs[place] == numbers, signed[place], 0)
                begins = np.append(0, ends[:-1])
                for out, v in ((total, np.abs(value)), (best, value < 0)):
                    sums = np.append(0, np.cumsum(v))
                    out[at:stop] += sums[ends] - sums[begins]
            columns |= {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return add


def align_tokenizers(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False, part_pairs: int = PART_PAIRS
) -> DataFrame:
    """``docs`` without ``text`` plus n_a, n_b, n_groups, n_links, groups (or its digest), n_best and count_sum."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid4().hex}"
    groups_of(docs, path_a, path_b, digest).write.option("compression", "zstd").parquet(f"{folder}/links")
    aligned = spark.read.parquet(f"{folder}/links")
    pair_counts(aligned).write.parquet(f"{folder}/pairs")
    return look_up(aligned, spark.read.parquet(f"{folder}/pairs"), part_pairs)
