"""Exact nearest-neighbour join.

Two plans, chosen by a measured size:

* candidates fit a fixed byte budget: they are shipped to every task once and the
  queries stream past them - no shuffle;
* otherwise both sides are cut into blocks. Candidates go to their nearest pivot
  (a bounded sample of candidates), big cells are cut into sub-blocks by id hash, and
  a query visits only the cells the triangle inequality cannot exclude. Each
  (block, query chunk) group has a bounded expected size whatever the data look like, every
  group returns at most k rows per query, and equal vectors are collapsed first, so a
  vector copied millions of times costs k candidates and one query.

Both return query_id, rank, cand_id, dist with ties broken by cand_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import blocks as B
from pathloom.operators.skew import salted_lookup
from pathloom.session import fresh, materialize, spread

LOCAL_ROWS = 4096  # candidates shipped to every task: at most this many rows ...
LOCAL_BYTES = 64 << 20  # ... and this many bytes
BLOCK_ROWS = 4096  # rows of one side in one block
CHUNK_ROWS = 16384  # queries that meet a block of candidates under several views
WIDE = 8  # columns from which on the triangle inequality hardly skips a cell
PACKED = 256  # columns from which on whole blocks are read again instead of shuffled for each block they meet
VISIT_ROWS = 256  # queries whose distances to all pivots are held at once
MAX_PIVOTS = 8192  # and at most PIVOT_BYTES of them
PIVOT_BYTES = 32 << 20


def _cosine_vectors(df: DataFrame, side: str) -> DataFrame:
    """Map cosine distance to half a squared Euclidean distance.

    Unit vectors get two spare coordinates; a zero vector uses one of them (a different
    one per side), which puts it at cosine distance 1 from everything.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    zero = (F.col("_n") == 0).cast("double")
    spare = F.array(zero, F.lit(0.0)) if side == "q" else F.array(F.lit(0.0), zero)
    return (
        df.withColumn("_n", norm)
        .withColumn(
            "vec",
            F.concat(F.transform("vec", lambda v: F.when(F.col("_n") == 0, 0.0).otherwise(v / F.col("_n"))), spare),
        )
        .drop("_n")
    )


def rows_of_block(n: int, width: int, cores: int, block_rows: int = BLOCK_ROWS) -> int:
    """Rows of one side in one block, for ``n`` rows of ``width`` columns.

    A row is sent to every block it is compared with. Of wide rows that is nearly every one, so their blocks are as
    large as leaves some 32 pairs of blocks for each core, up to half the byte budget.
    """
    rows = min(block_rows, max(LOCAL_BYTES // (8 * width), 1))
    if width <= WIDE or block_rows != BLOCK_ROWS:
        return rows
    return max(rows, min(LOCAL_BYTES // (16 * width), int(-(-n // (32 * cores) ** 0.5))))


def knn_join(
    queries: DataFrame,
    cands: DataFrame,
    k: int,
    *,
    metric: str = "euclidean",
    exclude_self: bool = False,
    use_folds: bool = False,
    block_rows: int = BLOCK_ROWS,
    local_rows: int = LOCAL_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """k nearest ``cands(id, vec[, fold])`` of every row of ``queries(id, vec[, fold])``.

    ``carry`` names double columns of the candidates to return with each neighbour, which
    saves joining the neighbour list back to the candidates.

    ``exclude_self`` drops the candidate with the query's own id (leave-one-out);
    ``use_folds`` drops candidates of the query's own fold (cross-validation).
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    cols = ["id", "vec"] + (["fold"] if use_folds else [])
    queries, cands = queries.select(*cols), cands.select(*cols, *[F.col(c).cast("double") for c in carry])
    if metric == "cosine":
        queries, cands = _cosine_vectors(queries, "q"), _cosine_vectors(cands, "c")
    if not use_folds:
        queries, cands = queries.withColumn("fold", F.lit(-1)), cands.withColumn("fold", F.lit(-2))

    head = cands.limit(1).select(F.size("vec")).first()
    if head is None:
        raise ValueError("no candidates")
    width = max(int(head[0]), 1)
    cap = min(local_rows, LOCAL_BYTES // (8 * width))
    small = cands.limit(cap + 1).toArrow() if cap > 0 else None
    if small is not None and small.num_rows <= cap:
        out = _local(queries, small, k, exclude_self, carry)
    elif width > PACKED:
        out = _packed(queries, cands, k, exclude_self, block_rows, carry, width)
    else:
        rows = rows_of_block(cands.count(), width, cands.sparkSession.sparkContext.defaultParallelism, block_rows)
        out = _blocked(queries, cands, k, exclude_self, rows, carry)
    if metric == "cosine":
        out = out.withColumn("dist", F.col("dist") * F.col("dist") / 2.0)
    return out


def knn_join_views(
    queries: DataFrame, cands: DataFrame, k: int, views: dict[str, list[int]], carry: tuple[str, ...] = (), **plan
) -> DataFrame:
    """The same join under several column subsets at once: (view, query_id, rank, ...).

    Small candidate sets are searched under every view in one pass over the queries; larger ones are cut into blocks,
    which move once for all views.
    """
    cols = ["id", "vec"]
    width = max(int(cands.limit(1).select(F.size("vec")).first()[0]), 1)
    cap = min(plan.get("local_rows", LOCAL_ROWS), LOCAL_BYTES // (8 * width))
    c = cands.select(*cols, *[F.col(x).cast("double") for x in carry]).withColumn("fold", F.lit(-2))
    small = c.limit(cap + 1).toArrow() if cap > 0 else None
    if small is not None and small.num_rows <= cap:
        return _local(queries.select(*cols).withColumn("fold", F.lit(-1)), small, k, False, carry, views)
    return _blocked_views(queries.select(*cols), c.drop("fold"), k, views, carry, width)


def _blocked_views(queries: DataFrame, cands: DataFrame, k: int, views: dict[str, list[int]], carry, width: int) -> DataFrame:
    """Every block of candidates meets every chunk of queries once, for all views; it returns at most k rows a view and query."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    queries, cands = materialize(queries), materialize(cands)
    n_blocks = -(-cands.count() // max(LOCAL_BYTES // (16 * width), 1))
    n_chunks = max(-(-queries.count() // CHUNK_ROWS), -(-4 * cores // n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.withColumn("chunk", dealt(n_chunks)).withColumn("block", every(n_blocks))
    right = cands.withColumn("block", dealt(n_blocks)).withColumn("chunk", every(n_chunks))

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found = [[] for _ in range(4 + len(carry))]
        if lt.num_rows and rt.num_rows:
            q, c = B.matrix(lt["vec"]), B.matrix(rt["vec"])
            q_ids, c_ids, extra = B.vector(lt["id"], np.int64), B.vector(rt["id"], np.int64), [B.vector(rt[x]) for x in carry]
            for number, pick in enumerate(views.values()):
                rows, at, d = B.topk(q[:, pick], c[:, pick], c_ids, k)
                for out, v in zip(found, (np.full(len(rows), number, np.int32), q_ids[rows], c_ids[at], d, *[e[at] for e in extra])):
                    out.append(v)
        kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.float64()] * (1 + len(carry))
        made = [pa.array(np.concatenate(v) if v else [], t) for v, t in zip(found, kinds)]
        return pa.Table.from_arrays(made, names=["number", "query_id", "cand_id", "dist", *carry])

    keys = ["block", "chunk"]
    near = fresh(left).groupBy(*keys).cogroup(fresh(right).groupBy(*keys))
    near = near.applyInArrow(run, "number int, query_id bigint, cand_id bigint, dist double" + _ddl(carry))
    rank = F.row_number().over(W.partitionBy("number", "query_id").orderBy("dist", "cand_id")).cast("int")
    name = F.element_at(F.lit(list(views)), F.col("number") + 1).alias("view")
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return near.select(name, "query_id", "rank", "cand_id", "dist", *carry)


def _local(queries: DataFrame, small: pa.Table, k: int, exclude_self: bool, carry, views=None) -> DataFrame:
    packed = queries.sparkSession.sparkContext.broadcast(
        (
            B.matrix(small["vec"]),
            B.vector(small["id"], np.int64),
            B.vector(small["fold"], np.int64),
            [B.vector(small[c]) for c in carry],
        )
    )

    def run(batches):
        c, c_ids, c_fold, extra = packed.value
        for b in batches:
            if not b.num_rows:
                continue
            q, q_ids = B.matrix(b["vec"]), B.vector(b["id"], np.int64)
            q_fold = B.vector(b["fold"], np.int64)

            def allowed(s):
                ok = q_fold[s][:, None] != c_fold[None, :]
                return ok & (q_ids[s][:, None] != c_ids[None, :]) if exclude_self else ok

            for name, pick in (views or {None: slice(None)}).items():
                rows, at, d = B.topk(q[:, pick], c[:, pick], c_ids, k, allowed)
                first = np.searchsorted(rows, np.arange(len(q)))
                rank = np.arange(len(rows)) - first[rows] + 1
                found = [q_ids[rows], rank.astype(np.int32), c_ids[at], d, *[e[at] for e in extra]]
                names = ["query_id", "rank", "cand_id", "dist", *carry]
                if views:
                    found, names = [np.repeat(name, len(rows)), *found], ["view", *names]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=names)

    ddl = ("view string, " if views else "") + "query_id bigint, rank int, cand_id bigint, dist double"
    return spread(queries).mapInArrow(run, ddl + _ddl(carry))


def _ddl(carry) -> str:
    return "".join(f", {c} double" for c in carry)


def _plus(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def pivots_of(cands: DataFrame, block_rows: int) -> np.ndarray:
    """A bounded, deterministic sample of candidate vectors."""
    n = cands.count()
    width = max(int(cands.limit(1).select(F.size("vec")).first()[0]), 1)
    p = int(min(MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * width)), max(1, -(-n // block_rows))))
    rows = cands.orderBy(F.xxhash64("id"), "id").select("vec").limit(p).toArrow()
    return np.unique(B.matrix(rows["vec"]), axis=0)


def assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot's number and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = B.distances(B.matrix(b["vec"]), shared.value)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                names=[*b.schema.names, "cell", "to_pivot"],
            )

    return df.mapInArrow(run, _plus(df, T.StructField("cell", T.IntegerType()), T.StructField("to_pivot", T.DoubleType())))


def _cell_table(cells: DataFrame, n_cells: int):
    """Per cell and fold: rows and radius (at most pivots x folds rows)."""
    stats = cells.groupBy("cell", "fold").agg(F.count("*").alias("n"), F.max("to_pivot").alias("r")).collect()
    folds = sorted({s["fold"] for s in stats})
    n = np.zeros((len(folds), n_cells), dtype=np.int64)
    r = np.full((len(folds), n_cells), -1.0)
    for s in stats:
        n[folds.index(s["fold"]), s["cell"]] = s["n"]
        r[folds.index(s["fold"]), s["cell"]] = s["r"]
    return np.array(folds), n, r


def _visits(queries: DataFrame, pivots, folds, n, r, k: int) -> DataFrame:
    """Add the list of cells that may hold one of the k nearest candidates of a query.

    Cells sorted by (distance to pivot + radius) give an upper bound on the k-th distance
    as soon as they hold k rows; a cell whose nearest possible point is farther is skipped.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots, folds, n, r))

    def cells_of(q: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
        piv, fold_ids, rows_in, radius = shared.value
        d = B.distances(q, piv)
        usable = fold_ids[None, :] != fold[:, None]
        count = usable.astype(np.int64) @ rows_in
        reach = np.full(d.shape, -1.0)
        for f in range(len(fold_ids)):  # fold by fold: no cube of queries, folds and pivots
            rows = usable[:, f]
            reach[rows] = np.maximum(reach[rows], radius[f][None, :])
        upper = np.where(count > 0, d + reach, np.inf)
        order = np.argsort(upper, axis=1)
        filled = np.take_along_axis(count, order, axis=1).cumsum(axis=1)
        at = np.minimum((filled < k).sum(axis=1), d.shape[1] - 1)
        bound = np.take_along_axis(upper, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        slack = 1e-9 * (1.0 + np.abs(d).max(axis=1))
        hit = (count > 0) & (d - reach <= (bound + slack)[:, None])
        return [np.flatnonzero(h).astype(np.int32) for h in hit]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, fold = B.matrix(b["vec"]), B.vector(b["fold"], np.int64)
            visits = [v for s in range(0, len(q), VISIT_ROWS) for v in cells_of(q[s : s + VISIT_ROWS], fold[s : s + VISIT_ROWS])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*b.schema.names, "visits"]
            )

    return queries.mapInArrow(run, _plus(queries, T.StructField("visits", T.ArrayType(T.IntegerType()))))


def pair_blocks(routed: DataFrame, cells: DataFrame, block_rows: int):
    """Cut both sides of the cell join into bounded groups keyed (cell, sub, chunk).

    A cell of n candidates has ceil(n / block_rows) sub-blocks and a cell visited by m
    queries has ceil(m / block_rows) query chunks. The two size tables have one row per
    pivot, so they are bounded by MAX_PIVOTS.
    """
    sizes = (
        cells.groupBy("cell")
        .agg(F.count("*").alias("n"))
        .join(routed.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        .select(
            "cell",
            F.ceil(F.col("n") / block_rows).cast("int").alias("subs"),
            F.ceil(F.col("m") / block_rows).cast("int").alias("chunks"),
        )
        .coalesce(1)
    )
    sizes = materialize(sizes)
    q = (
        routed.join(F.broadcast(sizes), "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .drop("subs", "chunks")
    )
    c = (
        cells.join(F.broadcast(sizes), "cell")
        .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("subs", "chunks")
    )
    keys = ["cell", "sub", "chunk"]
    return fresh(q).groupBy(*keys), fresh(c).groupBy(*keys)


def _blocked(queries, cands, k: int, exclude_self: bool, block_rows: int, carry) -> DataFrame:
    keep = k + 1 if exclude_self else k
    # equal vectors: only the smallest ids can be neighbours, and one query answers for all
    w = W.partitionBy("vec", "fold").orderBy("id")
    cands = cands.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= keep).drop("_i")
    cands = materialize(cands)
    pivots = pivots_of(cands, block_rows)
    cells = materialize(assign_cells(cands, pivots))
    folds, n, r = _cell_table(cells, len(pivots))
    rep = queries.groupBy("vec", "fold").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rep = materialize(_visits(rep, pivots, folds, n, r, keep))
    routed = rep.select("id", "vec", "fold", F.explode("visits").alias("cell"))
    left, right = pair_blocks(routed, cells, block_rows)

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        names = ["query_id", "cand_id", "dist", *carry]
        if not lt.num_rows or not rt.num_rows:
            kinds = [pa.int64(), pa.int64()] + [pa.float64()] * (1 + len(carry))
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        q, c = B.matrix(lt["vec"]), B.matrix(rt["vec"])
        c_ids, q_fold, c_fold = (B.vector(v, np.int64) for v in (rt["id"], lt["fold"], rt["fold"]))
        shared = np.isin(q_fold, c_fold).any()
        rows, at, d = B.topk(q, c, c_ids, keep, (lambda s: q_fold[s][:, None] != c_fold[None, :]) if shared else None)
        found = [B.vector(lt["id"], np.int64)[rows], c_ids[at], d, *[B.vector(rt[x])[at] for x in carry]]
        return pa.Table.from_arrays([pa.array(v) for v in found], names=names)

    near = left.cogroup(right).applyInArrow(run, "query_id bigint, cand_id bigint, dist double" + _ddl(carry))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "cand_id")).cast("int")
    near = near.withColumn("rank", rank).filter(F.col("rank") <= keep)
    # k entries per representative, handed to all queries with the same vector
    lists = near.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cand_id", "dist", *carry))).alias("nb")
    )
    answers = rep.join(lists, rep["id"] == lists["query_id"]).select("vec", "fold", "n", "nb")
    answered = salted_lookup(queries, materialize(answers), ["vec", "fold"], "id", block_rows)
    return _handed_out(answered, k, exclude_self, carry)


def _handed_out(answered: DataFrame, k: int, exclude_self: bool, carry) -> DataFrame:
    """The first k of the list ``nb`` of every ``id``."""
    nb = F.col("nb")
    if exclude_self:
        nb = F.filter(nb, lambda e: e["cand_id"] != F.col("id"))
    return answered.select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(nb, 1, k)).alias("_p", "e")
    ).select(
        "query_id",
        (F.col("_p") + 1).alias("rank"),
        F.col("e.cand_id").alias("cand_id"),
        F.col("e.dist").alias("dist"),
        *[F.col(f"e.{c}").alias(c) for c in carry],
    )


# ---------------------------------------------------------------- wide rows
def blocks_of(n: int, width: int, cores: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks for ``n`` rows: of at most half the byte budget; up to 32 pairs of blocks for each core, if they are not small."""
    if block_rows != BLOCK_ROWS:
        return max(1, -(-n // block_rows))
    return max(1, -(-n // max(LOCAL_BYTES // (16 * width), 1)), min(-(-n // BLOCK_ROWS), int(np.ceil((32 * cores) ** 0.5))))


def block_number(column: str, n_blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(n_blocks)).cast("int")


def pack(df: DataFrame, n_blocks: int, whole: tuple[str, ...] = ("id",), real: tuple[str, ...] = ()) -> DataFrame:
    """One row a block: (block, vec, ...), the columns of its rows as bytes. ``df`` has ``vec``, ``whole`` and ``real`` numbers."""
    names = ["vec", *whole, *real]

    def run(t: pa.Table) -> pa.Table:
        data = [B.matrix(t["vec"])] + [B.vector(t[c], np.int64) for c in whole] + [B.vector(t[c], np.float64) for c in real]
        columns = [pa.array([d.tobytes()], pa.binary()) for d in data]
        return pa.Table.from_arrays([pa.array([t["block"][0].as_py()], pa.int32()), *columns], names=["block", *names])

    rows = df.select(block_number("id", n_blocks).alias("block"), *names).repartition(n_blocks, "block")
    return materialize(rows.groupBy("block").applyInArrow(run, "block int, " + ", ".join(f"{n} binary" for n in names)))


def all_pairs(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Every packed block beside every other, the columns of the other with ``names`` marked by c_: each pair of partitions is
    a task that reads both from where they were written, so nothing is shuffled."""
    other = right.select(*[F.col(n).alias(f"c_{n}") for n in names])
    return left.crossJoin(other.hint("shuffle_replicate_nl"))


def _keyed(df: DataFrame) -> DataFrame:
    """(id, fold, key): rows with one key have equal vectors (128 bits of a hash of them)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = np.ascontiguousarray(B.matrix(b["vec"]) + 0.0)  # one zero
                keys = pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"], b["fold"], keys], names=["id", "fold", "key"])

    fold = df.schema["fold"].dataType.simpleString()
    return df.select("id", "vec", "fold").mapInArrow(run, f"id bigint, fold {fold}, key binary")


def _packed(queries: DataFrame, cands: DataFrame, k: int, exclude_self: bool, block_rows: int, carry, width: int) -> DataFrame:
    """Rows too wide to be sent to each block they meet: a row moves once, into its block, and blocks are read in pairs.

    Of equal vectors the smallest ids are candidates and one is a query, as in the other plans; copies are found by a hash, so
    that only numbers move for them.
    """
    keep = k + 1 if exclude_self else k
    w = W.partitionBy("key", "fold").orderBy("id")
    surplus = _keyed(cands).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") > keep)
    surplus = materialize(surplus.select("id"))
    if not surplus.isEmpty():
        cands = cands.join(surplus, "id", "left_anti")
    keys = materialize(_keyed(queries))
    rep = materialize(keys.groupBy("key", "fold").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    asked = queries.select("id", "vec", "fold")
    if not rep.filter(F.col("n") > 1).isEmpty():
        asked = asked.join(rep.select(F.col("rep").alias("id")), "id", "left_semi")
    cores = cands.sparkSession.sparkContext.defaultParallelism
    left = pack(asked, blocks_of(rep.count(), width, cores, block_rows), ("id", "fold"))
    right = pack(cands, blocks_of(cands.count(), width, cores, block_rows), ("id", "fold"), carry)
    names = ["query_id", "cand_id", "dist", *carry]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, q_fold = B.unpack(b["id"][i], np.int64), B.unpack(b["fold"][i], np.int64)
                c_ids, c_fold = B.unpack(b["c_id"][i], np.int64), B.unpack(b["c_fold"][i], np.int64)
                q, c = B.unpack(b["vec"][i]).reshape(len(ids), -1), B.unpack(b["c_vec"][i]).reshape(len(c_ids), -1)
                shared = np.isin(q_fold, c_fold).any()
                allowed = (lambda s: q_fold[s][:, None] != c_fold[None, :]) if shared else None  # noqa: B023
                rows, at, d = B.topk(q, c, c_ids, keep, allowed)
                found = [ids[rows], c_ids[at], d, *[B.unpack(b[f"c_{x}"][i])[at] for x in carry]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=names)

    near = all_pairs(left, right, ("vec", "id", "fold", *carry))
    near = near.mapInArrow(run, "query_id bigint, cand_id bigint, dist double" + _ddl(carry))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("dist", "cand_id")).cast("int")
    near = near.withColumn("rank", rank).filter(F.col("rank") <= keep)
    lists = near.groupBy(F.col("query_id").alias("rep")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "cand_id", "dist", *carry))).alias("nb")
    )
    answers = materialize(rep.join(lists, "rep").select("key", "fold", "n", "nb"))
    return _handed_out(salted_lookup(keys, answers, ["key", "fold"], "id", block_rows), k, exclude_self, carry)


def knn_accuracy(neighbors: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of queries whose nearest candidate carries their label (``carry=("label",)``)."""
    top = neighbors.filter(F.col("rank") == 1).select("query_id", F.col("label").alias("pred"))
    true = queries.select(F.col("id").alias("query_id"), F.col("label").alias("true"))
    return top.join(true, "query_id").agg(
        F.count("*").alias("n"), F.avg((F.col("true") == F.col("pred")).cast("int")).alias("accuracy")
    )
