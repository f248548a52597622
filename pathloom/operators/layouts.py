"""Neighbour-embedding charts as rounds over edge tables; a point's place is one row of a table keyed by its id.

Attraction is a join of the edges with the places of both ends and a sum for each row. The repulsion of the t-SNE chart acts between all pairs; it is read
from a lattice over the chart: rows are spread over nine nodes of their cell by quadratic interpolation and counted by Spark, the kernel is applied to the
lattice by FFT on the driver, and rows read the result of their cell back. At most CELLS x CELLS cells reach the driver or are sent back, whatever the
number of rows.

All sums over rows are sums of whole numbers (fixed point), so that cores, partitions and lost executors do not change a chart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.charts import trustworthiness_continuity
from pathloom.operators.knn import knn_join
from pathloom.operators.manifold import pca_chart, preprocess
from pathloom.session import ensure_checkpoint_dir, materialize

PERPLEXITY = 30
ROUNDS = 100  # of which the first EXAGGERATED draw neighbours together
EXAGGERATED = 30
EXAGGERATION = 12.0
STILL = 1e-4  # the layout ends when no point moves by more than this share of its width
CELLS = 256  # of the lattice, along each side
CELL_WIDTH = 0.4  # of a cell, while CELLS of them span the chart
SHIPPED_ROWS = 200_000  # places sent to every task; beyond, the edges meet them by shuffle
UNIT = float(1 << 30)  # of the fixed-point sums



# ---------------------------------------------------------------- neighbour lists to edges
def padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as a matrix, with a mask of the places that hold one."""
    size = np.diff(lists.offsets.to_numpy())
    mask = np.arange(size.max(initial=0))[None] < size[:, None]
    out = np.zeros(mask.shape)
    out[mask] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, mask


def entropy_weights(dist: np.ndarray, mask: np.ndarray, perplexity: float, steps: int = 60) -> np.ndarray:
    """Gaussian weights of each row's neighbours, of sum 1, with the width that gives the row that perplexity."""
    e = dist * dist
    e = np.where(mask, e - np.where(mask, e, np.inf).min(axis=1, initial=np.inf, keepdims=True), 0.0)
    size = mask.sum(axis=1)
    mean = e.sum(axis=1) / np.maximum(size, 1)
    e = e / np.where(mean > 0, mean, 1.0)[:, None]
    want = np.log(np.minimum(perplexity, np.maximum(size / 3.0, 1.0)))
    low, high = np.full(len(e), -30.0), np.full(len(e), 40.0)  # log of the inverse width
    for _ in range(steps):
        at = (low + high) / 2
        beta = np.exp(at)[:, None]
        p = np.where(mask, np.exp(-np.minimum(e * beta, 700.0)), 0.0)
        total = np.maximum(p.sum(axis=1), 1e-300)
        wide = np.log(total) + (beta * e * p).sum(axis=1) / total > want
        low, high = np.where(wide, at, low), np.where(wide, high, at)
    return p / total[:, None]


def _weighted(points: DataFrame, k: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], **plan) -> DataFrame:
    """(src, dst, w): the k nearest others of each point, at most k in a row's list."""
    near = knn_join(points, points, k, exclude_self=True, **plan)
    listed = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "cand_id", "dist"))).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dist, mask = padded(b["dist"])
                src = np.repeat(b["query_id"].to_numpy(), mask.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(src), b["dst"].flatten(), pa.array(weigh(dist, mask)[mask])], names=["src", "dst", "w"])

    rows = listed.select("query_id", F.col("near.cand_id").alias("dst"), F.col("near.dist").alias("dist"))
    return rows.mapInArrow(run, "src bigint, dst bigint, w double")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def affinities(points: DataFrame, perplexity: float = PERPLEXITY, **plan) -> DataFrame:
    """edges(src, dst, w) in both directions: the joint weights of the t-SNE chart times the number of points, about 1 for a row."""
    k = max(min(int(3 * perplexity), points.count() - 1), 1)
    one = _weighted(points, k, lambda d, m: entropy_weights(d, m, perplexity), **plan)
    return _both_ways(one).groupBy("src", "dst").agg((F.sum("w") / 2.0).alias("w"))


# ---------------------------------------------------------------- a round
def _pulled(edges: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """``state`` with a1, a2: sum over a row's edges of weight, 1 / (1 + squared distance) and difference of the places.

    The rows of ``state`` go through the same sum as the edges, so that the result is not joined once more.
    """
    places = state.select("id", "z1", "z2")
    sent = F.broadcast(places) if n <= SHIPPED_ROWS else places  # twice the same plan: sent once
    d = edges.selectExpr("src AS id", "dst", "w").join(sent, "id").toDF("src", "dst", "w", "x", "y")
    d = d.selectExpr("src", "dst AS id", "w", "x", "y").join(sent, "id").selectExpr("src", "w", "x - z1 AS x", "y - z2 AS y")
    d = d.selectExpr("src", "x", "y", f"{UNIT}D * w / (1D + x * x + y * y) AS f")
    rest = [c for c in state.columns if c != "id"]
    pulls = d.selectExpr("src AS id", "CAST(round(f * x) AS bigint) AS a1", "CAST(round(f * y) AS bigint) AS a2", *[f"CAST(NULL AS double) AS {c}" for c in rest])
    rows = pulls.unionByName(state.selectExpr("id", "0L AS a1", "0L AS a2", *rest))
    sums = [F.expr(f"sum({c}) / {UNIT}D AS {c}") for c in ("a1", "a2")]
    return rows.groupBy("id").agg(*sums, *[F.expr(f"max({c}) AS {c}") for c in rest])


def _start(points: DataFrame, spread: float) -> DataFrame:
    """(id, z1, z2): the principal-axis chart with that deviation of its first axis, rounded to a millionth of it."""
    z = materialize(pca_chart(points))
    dev = z.agg(F.stddev_pop("z1")).first()[0] or 1.0
    return z.select("id", *[(F.round(F.col(c) / F.lit(dev), 6) * spread).alias(c) for c in ("z1", "z2")])


# ---------------------------------------------------------------- t-SNE
# Numbers that change from round to round stay out of the column expressions, which would be compiled anew for each of them.
def _nodes(u: np.ndarray) -> np.ndarray:
    """Quadratic interpolation weights of the three nodes of a cell, at 1/6, 1/2 and 5/6 of it, for places within (0 to 1)."""
    return np.stack([(u - 0.5) * (u - 5 / 6) * 4.5, (u - 1 / 6) * (u - 5 / 6) * -9.0, (u - 1 / 6) * (u - 0.5) * 4.5], axis=-1)


def celled(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells (row, 2) of places on a lattice through 0, and the weights (row, 9) of the nodes of the cell."""
    cell = np.floor(z / width)
    w = _nodes(z / width - cell)
    return cell.astype(np.int64), (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(z), 9)


def _columns(b: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([b[c].to_numpy(zero_copy_only=False) for c in names], axis=-1)


_CHARGES = [f"c{i}" for i in range(9)]


def _charges(state: DataFrame, width: float) -> pa.Table:
    """Occupied cells with the charge of their nine nodes (c0 to c8, whole numbers) and the longest move of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, w = celled(_columns(b, "z1", "z2"), width)
                cells, at = np.unique(cell, axis=0, return_inverse=True)
                total, move = np.zeros((len(cells), 9), np.int64), np.zeros(len(cells))
                np.add.at(total, at.ravel(), np.rint(w * UNIT).astype(np.int64))
                np.maximum.at(move, at.ravel(), np.abs(_columns(b, "v1", "v2")).max(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells.T, *total.T, move)], names=["cx", "cy", *_CHARGES, "move"])

    ddl = "cx bigint, cy bigint, " + ", ".join(f"{c} bigint" for c in _CHARGES) + ", move double"
    part = state.select("z1", "z2", "v1", "v2").mapInArrow(run, ddl)
    return part.groupBy("cx", "cy").agg(*[F.sum(c).alias(c) for c in _CHARGES], F.max("move").alias("move")).toArrow()


def lattice_fields(charge: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all nodes of 1 / (1 + r^2), and of dx and dy over its square, at every node of a lattice."""
    shape = tuple(2 * n for n in charge.shape)
    dx, dy = (step * np.where(np.arange(2 * n) < n, np.arange(2 * n), np.arange(2 * n) - 2 * n) for n in charge.shape)
    near = 1.0 / (1.0 + dx[:, None] ** 2 + dy[None] ** 2)
    sent = np.fft.rfft2(charge, shape)
    rows, cols = charge.shape
    kernels = near, dx[:, None] * near * near, dy[None] * near * near
    return tuple(np.fft.irfft2(np.fft.rfft2(k) * sent, shape)[:rows, :cols] for k in kernels)


class Repulsion(NamedTuple):
    """Repelling force at the nodes (cell, axis, node) of the occupied cells, times the number of rows; sorted by ``key``."""

    width: float
    first: np.ndarray  # least cell of each axis
    span: int
    key: np.ndarray
    force: np.ndarray

    def at(self, z: np.ndarray) -> np.ndarray:
        cell, w = celled(z, self.width)
        x, y = (cell - self.first).T
        return np.einsum("ran,rn->ra", self.force[np.searchsorted(self.key, x * self.span + y)], w)


def _repulsion(cells: pa.Table, width: float, n: int) -> Repulsion:
    """From the charges of the occupied cells; the sum over all pairs that scales it is that of the nodes."""
    at = np.stack([cells["cx"].to_numpy(), cells["cy"].to_numpy()], axis=1)
    first = at.min(axis=0)
    x, y = (at - first).T
    span = int(y.max()) + 1
    charge = np.zeros((3 * (int(x.max()) + 1), 3 * span))
    nodes = 3 * x[:, None] + np.arange(9) // 3, 3 * y[:, None] + np.arange(9) % 3
    charge[nodes] = np.stack([cells[c].to_numpy() for c in _CHARGES], axis=1) / UNIT
    near, fx, fy = lattice_fields(charge, width / 3)
    pairs = max(float((charge * near).sum()) - n, 1e-12)
    key = x * span + y
    order = np.argsort(key)
    return Repulsion(width, first, span, key[order], np.stack([fx[nodes], fy[nodes]], axis=1)[order] * (n / pairs))


def _cell_width(extent: float) -> float:
    return max(extent / CELLS, min(CELL_WIDTH, extent / 20)) if extent > 0 else CELL_WIDTH


def _boxed(state: DataFrame, width: float) -> tuple[pa.Table, float, float]:
    """Charges, cell width and extent; the width doubles where points moved far in one round."""
    while True:
        cells = _charges(state, width)
        extent = max(int(np.ptp(cells[c].to_numpy())) + 1 for c in ("cx", "cy"))
        if extent <= 2 * CELLS:
            return cells, width, extent * width
        width *= 2


_STATE = "id bigint, z1 double, z2 double, v1 double, v2 double, g1 double, g2 double"


def tsne_step(edges: DataFrame, state: DataFrame, field: Repulsion, n: int, exaggeration: float, momentum: float, rate: float) -> DataFrame:
    """The next state(id, z, v, g), with the gradient d1, d2 (times n / 4) that led there.

    ``edges`` are affinities. A row without edges is only pushed away.
    """
    rows = _pulled(edges, state, n)
    shared = state.sparkSession.sparkContext.broadcast(field)  # at most 4 CELLS x CELLS cells of 18 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, v, g, a = (_columns(b, f"{c}1", f"{c}2") for c in "zvga")
                d = exaggeration * a - shared.value.at(z)
                g = np.maximum(np.where(d * v < 0, g + 0.2, g * 0.8), 0.01)
                v = momentum * v - 4.0 * rate / n * g * d
                values = [c for m in (z + v, v, g, d) for c in m.T]
                yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(c) for c in values]], names=["id", *[f"{c}{i}" for c in "zvgd" for i in "12"]])

    return rows.mapInArrow(run, _STATE + ", d1 double, d2 double")


def tsne_chart(points: DataFrame, perplexity: float = PERPLEXITY, rounds: int = ROUNDS, **plan) -> DataFrame:
    """chart(id, z1, z2): t-SNE of points(id, vec) in at most 50 principal axes, from the principal-axis chart.

    Affinities lie on the 3 x perplexity nearest neighbours; a smaller table has all others as neighbours and its perplexity
    falls to a third of them. Steps have momentum and a gain a coordinate. Equal points without others stay at 0; an empty table gives none.
    """
    n = points.count()
    if n == 0:
        return points.sparkSession.createDataFrame([], "id bigint, z1 double, z2 double")
    if n == 1:
        return points.selectExpr("id", "0D AS z1", "0D AS z2")
    points = materialize(preprocess(points))
    state = materialize(_start(points, 1e-4).selectExpr("id", "z1", "z2", "0D AS v1", "0D AS v2", "1D AS g1", "1D AS g2"))
    box = state.agg(F.max("z1") - F.min("z1"), F.max("z2") - F.min("z2")).first()
    if not max(box):  # nothing that could part them
        return state.select("id", "z1", "z2")
    edges = materialize(affinities(points, perplexity, **plan))
    extent, rate = max(box), max(n / EXAGGERATION / 4, 50.0)
    early = min(EXAGGERATED, rounds // 3)
    folder = f"{ensure_checkpoint_dir(points.sparkSession)}/tsne-{uuid4().hex}"
    for t in range(rounds):
        cells, width, extent = _boxed(state, _cell_width(extent))
        if t > early and max(cells["move"].to_pylist()) < STILL * extent:
            break
        step = (EXAGGERATION, 0.5) if t < early else (1.0, 0.8)
        moved = tsne_step(edges, state, _repulsion(cells, width, n), n, *step, rate).drop("d1", "d2")
        # a table and no checkpoint: that keeps the size estimated for its joins, whose digits double every round
        moved.write.parquet(f"{folder}/{t}")
        state = points.sparkSession.read.schema(_STATE).parquet(f"{folder}/{t}")
    return state.select("id", "z1", "z2")


# ---------------------------------------------------------------- choice of the neighbourhood
def sweep(points: DataFrame, chart: Callable[[DataFrame, int], DataFrame], sizes: list[int], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """scores(size, tw, ct) of chart(points, size) for every size, and the chart of the best trustworthiness (ties to the earlier size)."""
    best, rows = None, []
    for size in sizes:
        z = materialize(chart(points, size))
        both = materialize(points.select("id", F.col("vec").alias("hi")).join(z.select("id", F.array("z1", "z2").alias("lo")), "id"))
        s = trustworthiness_continuity(both, k).first()
        rows.append((size, s["tw"], s["ct"]))
        if best is None or s["tw"] > best[0]:
            best = s["tw"], z
    return points.sparkSession.createDataFrame(rows, "size int, tw double, ct double"), best[1]
