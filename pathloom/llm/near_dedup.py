"""Near duplicates by SetSketch: signature, bands, joint likelihood, check on full sets, components.

1. Signature. A document is the set of its word shingles (64-bit hashes). Register i of its sketch is the least of an
   exponential variate over the set, truncated on an exponential scale: floor(1 - log_b(min)). Registers merge by
   maximum, and two documents agree on one with about their Jaccard similarity. Documents with one set are one class from here on.
2. Bands. BAND_ROWS registers hashed together are a bucket. At similarity 0.8 all of 32 bands miss a pair with
   probability (1 - 0.8**4)**32 = 5e-8.
3. Candidates. In every bucket each class is compared with one center, so a bucket of n classes gives n - 1 pairs. Pairs are first judged by the joint likelihood
   of both sketches (the set sizes are known): one that fits the least similarity worse than the best fit by LIKELIHOOD_MARGIN is
   left out, and so is one whose set sizes alone forbid it. The others are confirmed on their full sets. Sets are taken from the texts once, for
   the members of buckets; pairs are dealt out in tiles, each for two parts of clusters of TILE_BYTES, so that a set is sent once for a tile and not once for a pair.
4. Components of the confirmed links. Where classes of one bucket are still in different components, they are compared
   across components, tile by tile in NumPy: by sketch, then by likelihood, then on their full sets, likeliest pairs first, and only links between
   components come out. So no link between classes that share a bucket is lost, and no bucket is expanded into its pairs.

Defined cases: null, empty and wordless texts have no shingles, form a component alone and are kept; a text of fewer words than a
shingle is one shingle; ties go to the smaller doc_id; rows repeated with one doc_id are each reported, and all
stay if it does (of their different texts the one with the largest set is compared); a null doc_id is never linked and is kept; extra columns stay in ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import blocks, lower_bytes, mix, raw, span_hashes, spans
from pathloom.session import fresh, materialize

REGISTERS = 128
BAND_ROWS = 4
BASE = 1.001  # of the exponential scale
RATE = 20.0  # of the exponential variates
TOP = (1 << 16) - 2  # largest register
LIKELIHOOD_MARGIN = 10.0
TILE_BYTES = 4 << 20  # of sets of a tile: members of one cluster that are compared together
SENT_IDS = 1_000_000  # ids that may be broadcast, 8 bytes each
HOPS = 2  # over buckets, from a member to its cluster
GROUP_BYTES = 32 << 20  # of sets that are held in one call
FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))
SHIFTS = mix(np.arange(5001, 5065, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data, begins = raw(texts)
    data = lower_bytes(data)
    # a zero byte ends each text and is a word character in texts, so ends are told by place
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    gap[begins[1:] - 1] = True
    starts, ends = spans(np.append(~gap, False))
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, begins)
    n = max(0, len(h) - words + 1)
    if words > len(SHIFTS):
        raise ValueError(f"at most {len(SHIFTS)} words in a shingle")
    full = np.zeros(n, np.uint64)
    for k in range(words):
        full += h[k : k + n] * SHIFTS[k]
    full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            yield mix((h[a:b] * SHIFTS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def sketch(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 256):
        drawn = values[at : at + 256, None] * FACTORS + OFFSETS
        drawn ^= drawn >> np.uint64(32)
        drawn *= FACTORS
        np.minimum(least, drawn.min(0), out=least)
    # the least of uniform variates has its rank in one exponential variate of the rate times the set's size
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and sketch of every row; nothing shuffles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sizes, hashes, sketches = [], [], []
            for s in shingles(texts, words):
                sizes.append(len(s))
                hashes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_hash binary, sketch binary")


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


_GRID = np.linspace(0.0, 1.0, 41)


def least_equal(similarity: float) -> int:
    """Fewer equal registers than this speak against the similarity by six standard deviations."""
    return int(REGISTERS * similarity - 6 * math.sqrt(REGISTERS * similarity * (1 - similarity)))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches (rows of ``a`` and ``b``) can have the similarity, and their likeliest one.

    The registers of a pair are greater, less or equal with probabilities that the two set sizes and the similarity fix.
    """
    greater, less = (a > b).sum(-1), (a < b).sum(-1)
    equal = a.shape[-1] - greater - less
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(na, nb) / np.maximum(na, nb)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = _p(u - v * j), _p(v - u * j)
        same = np.clip(1 - up - down, 1e-12, 1)
        return greater * np.log(np.clip(up, 1e-12, 1)) + less * np.log(np.clip(down, 1e-12, 1)) + equal * np.log(same)

    grid = np.stack([fit(g * most) for g in _GRID])
    best = _GRID[grid.argmax(0)] * most
    at_limit = fit(np.minimum(similarity, most))
    ok = (most >= similarity - 1e-12) & ((best >= similarity) | (grid.max(0) - at_limit <= LIKELIHOOD_MARGIN))
    return ok, best


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, id) for every band of every class."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = REGISTERS // BAND_ROWS
        for batch in batches:
            ids = batch.column("id")
            if not len(ids):
                continue
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(ids), n)
            bucket = mix(mix(rows) + np.arange(1, n + 1, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.ravel().view(np.int64)), ids.take(pa.array(np.repeat(np.arange(len(ids)), n)))],
                names=["bucket", "id"],
            )

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "sketch").mapInArrow(cut, f"bucket long, id {kind}")


def likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the joint likelihood leaves."""
    one = classes.select("id", "n_shingles", "sketch")
    both = (
        pairs.join(one.withColumnsRenamed({"id": "a", "n_shingles": "na", "sketch": "sa"}), "a")
        .join(one.withColumnsRenamed({"id": "b", "n_shingles": "nb", "sketch": "sb"}), "b")
        .filter(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9)
    )

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4096):
                x = f.iloc[at : at + 4096]
                ok, _ = may_link(_sketches(x["sa"]), _sketches(x["sb"]), x["na"].to_numpy(), x["nb"].to_numpy(), similarity)
                yield x.loc[ok, ["a", "b"]]

    kind = classes.schema["id"].dataType.simpleString()
    return both.mapInPandas(test, f"a {kind}, b {kind}")


def full_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(id, values): the shingle hashes of the documents in ``members`` (id); other texts don't move where the ids can be sent."""
    if members.count() <= SENT_IDS:
        members = F.broadcast(members)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(members, "id", "left_semi")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in blocks(batches):
            values = pa.array([x.tobytes() for x in shingles(part, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], names=["id", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(take, f"id {kind}, values binary")


def clusters(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, tile): members that share buckets mostly have one cluster, which is cut into parts of about TILE_BYTES.

    Every two parts of a cluster are compared, so a member is sent as often as the cluster has parts.
    """
    named = buckets.groupBy("id").agg(F.min("b").alias("cluster"))
    for _ in range(HOPS):  # members of one family that don't share the least center's bucket join it over others
        by_bucket = buckets.join(named, "id").groupBy("bucket").agg(F.min("cluster").alias("cluster"))
        named = materialize(buckets.join(by_bucket, "bucket").groupBy("id").agg(F.min("cluster").alias("cluster")))
    held = named.join(classes.select("id", (8 * F.col("n_shingles") + 300).alias("bytes")), "id")
    sizes = held.groupBy("cluster").agg(F.ceil(F.sum("bytes") / TILE_BYTES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return named.join(sizes, "cluster").select("id", F.xxhash64("cluster", part).alias("tile"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int((y[at] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, tiles: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one = tiles.select("id", "tile")
    tiled = materialize(
        pairs.join(one.withColumnsRenamed({"id": "a", "tile": "ta"}), "a")
        .join(one.withColumnsRenamed({"id": "b", "tile": "tb"}), "b")
        .select("a", "b", F.xxhash64(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("tile"))
    )
    ends = tiled.select("tile", F.explode(F.array("a", "b")).alias("id")).distinct()
    held = ends.join(sizes.select("id", "n_shingles"), "id").agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(1, -(-8 * held // GROUP_BYTES), pairs.sparkSession.sparkContext.defaultParallelism)
    tiled = tiled.withColumn("g", F.pmod("tile", F.lit(groups)).cast("int"))
    sent = tiled.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id").select("g", "id", "values")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        for i, v in zip(right["id"], right["values"]):
            known[i] = max(known.get(i, b""), v, key=lambda x: (len(x), x))  # one, unless a doc_id is repeated
        known = {i: np.frombuffer(v, np.uint64) for i, v in known.items()}
        keep = []
        for a, b in zip(left["a"], left["b"]):
            keep.append(similar(known[a], known[b], percent))
        return left.loc[np.array(keep, bool), ["a", "b"]]

    kind = pairs.schema["a"].dataType.simpleString()
    return tiled.groupBy("g").cogroup(fresh(sent).groupBy("g")).applyInPandas(check, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): the smallest id it is connected with.

    Large-star and small-star steps in turn: each moves links to smaller ids, and a hub of any size is summed by partial minima.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    found = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _spanning(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, values: list, left: np.ndarray, right: np.ndarray, percent: int):
    """Links that join the components of rows ``left`` and ``right`` (positions), likeliest pairs first.

    Pairs whose components are joined already are skipped; every other pair that the likelihood leaves is confirmed on its sets.
    """
    similarity, fewest, found = percent / 100, least_equal(percent / 100), []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        may = comp[rows][:, None] != comp[right]
        may &= np.minimum(n[rows][:, None], n[right]) >= similarity * np.maximum(n[rows][:, None], n[right]) - 1e-9
        may &= (rows[:, None] < right) | (left[0] != right[0])  # within one tile each pair once
        i, j = np.nonzero(may)
        for k in range(0, len(i), 65536):
            x, y = rows[i[k : k + 65536]], right[j[k : k + 65536]]
            equal = (sketch[x] == sketch[y]).sum(1) >= fewest
            x, y = x[equal], y[equal]
            if len(x):
                ok, best = may_link(sketch[x], sketch[y], n[x], n[y], similarity)
                found.append(np.stack([x[ok], y[ok], best[ok] * 1e6]).astype(np.int64))
    if not found:
        return
    x, y, best = np.concatenate(found, 1)
    order = np.lexsort((y, x, -best))
    parent: dict = {}

    def root(c):
        while c in parent:
            c = parent[c]
        return c

    for i, j in zip(x[order].tolist(), y[order].tolist()):
        p, q = root(comp[i]), root(comp[j])
        if p != q and similar(values[i], values[j], percent):
            parent[p] = q
            yield max(ids[i], ids[j]), min(ids[i], ids[j])


def across(buckets: DataFrame, tiles: DataFrame, classes: DataFrame, sets: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between the components that share a bucket; of each two at least one, if there is one.

    Members of buckets with several components are compared tile by tile: every pair of tiles that some bucket spans is one unit of work,
    to which each member is sent once. Only links come out, at most one less than a unit has members.
    """
    label = F.coalesce("component", "id")
    named = buckets.join(tiles, "id").join(component, "id", "left").select("bucket", "id", "tile", label.alias("component"))
    # several components in a bucket: else there is nothing to find there
    open_ = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    inside = materialize(named.join(open_.filter("low <> high").select("bucket"), "bucket"))
    spanned = inside.groupBy("bucket").agg(F.sort_array(F.collect_set("tile")).alias("t")).select("t").distinct()
    units = spanned.select(F.explode("t").alias("ta"), "t").select("ta", F.explode(F.filter("t", lambda x: x >= F.col("ta"))).alias("tb")).distinct()
    one = classes.select("id", "n_shingles", "sketch")
    members = materialize(inside.select("tile", "id", "component").distinct().join(one, "id"))
    weight = members.groupBy("tile").agg(F.sum(8 * F.col("n_shingles") + 300).alias("bytes"))
    sent = units.select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
    sent = materialize(sent.join(weight, "tile"))
    held = sent.agg(F.sum("bytes")).first()[0] or 0
    groups = max(1, -(-held // GROUP_BYTES), classes.sparkSession.sparkContext.defaultParallelism)
    rows = (
        sent.drop("bytes")
        .join(members.join(sets, "id"), "tile")
        .withColumn("g", F.pmod(F.xxhash64("ta", "tb"), F.lit(groups)).cast("int"))
    )
    kind = classes.schema["id"].dataType.simpleString()

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ta", "tb", "id"])
        ids, comp, n, tile = (f[c].to_numpy() for c in ("id", "component", "n_shingles", "tile"))
        ta, tb, sketch = f["ta"].to_numpy(), f["tb"].to_numpy(), _sketches(f["sketch"])
        values = [np.frombuffer(v, np.uint64) for v in f["values"]]
        cuts = np.flatnonzero((np.diff(ta) != 0) | (np.diff(tb) != 0)) + 1
        found: list = []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(f)]):
            every = np.arange(low, high)
            left, right = every[tile[low:high] == ta[low]], every[tile[low:high] == tb[low]]
            if len(left) and len(right):
                found += _spanning(ids, comp, n, sketch, values, left, right, percent)
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("g").applyInPandas(search, f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    similarity = percent / 100
    signed = materialize(signatures(docs, words))
    named = signed.filter(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    classes = materialize(
        named.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    all_bands = bands(classes)
    centers = all_bands.groupBy("bucket").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only buckets with several classes are read again
    buckets = materialize(all_bands.join(centers, "bucket").select("bucket", "id", "b"))
    tiles = materialize(clusters(buckets, classes))
    sets = materialize(full_sets(docs, tiles.select("id"), words))
    stars = buckets.filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = materialize(confirmed(likely(stars, classes, similarity), tiles, classes, sets, percent))
    found = materialize(components(links))
    more = materialize(across(buckets, tiles, classes, sets, found, percent))
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)))
    # class id, then component id, for every document of a class
    by_class = classes.join(found, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    linked = named.join(by_class, "set_hash").select("doc_id", "n_shingles", "component_id")
    alone = signed.filter(F.col("doc_id").isNull() | F.col("set_hash").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, the one with the smallest doc_id."""
    groups = near_groups(docs, words, percent)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
