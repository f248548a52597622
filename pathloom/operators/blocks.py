"""Small NumPy helpers that run inside Spark tasks on one block of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

HELD = 1 << 21  # distances
PIECE = 1 << 18  # numbers
_EPS = np.finfo(np.float64).eps


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """list<double> column -> 2-D array (all rows have the same width)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def vector(column, dtype=None) -> np.ndarray:
    out = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return out if dtype is None else out.astype(dtype)


def unpack(value: pa.BinaryScalar, dtype=np.float64) -> np.ndarray:
    """Numbers that were stored as bytes."""
    return np.frombuffer(value.as_buffer(), dtype)


def _gemm(q: np.ndarray, c: np.ndarray):
    """Squared distances by matrix product, with a bound on their rounding error."""
    qn, cn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
    d2 = qn[:, None] + cn[None, :] - 2.0 * (q @ c.T)
    slack = 8.0 * (q.shape[1] + 4) * _EPS * (qn + (cn.max() if len(cn) else 0.0))
    return d2, slack


def exact_dist(q: np.ndarray, c: np.ndarray, rows, cols) -> np.ndarray:
    """Distances of the listed (row, col) pairs from plain differences."""
    out = np.empty(len(rows))
    piece = max(1, PIECE // max(q.shape[1], 1))
    for s in range(0, len(rows), piece):
        d = q[rows[s : s + piece]] - c[cols[s : s + piece]]
        out[s : s + piece] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All block distances; pairs the matrix product cannot resolve are recomputed exactly."""
    d2, _ = _gemm(q, c)
    scale = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", c, c)[None, :]
    rows, cols = np.nonzero(d2 <= 1e-4 * scale)
    out = np.sqrt(np.maximum(d2, 0.0))
    out[rows, cols] = exact_dist(q, c, rows, cols)
    return out


def all_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``distances`` for sums over all pairs: the sides are centred, and one limit says which pairs are recomputed."""
    with np.errstate(all="ignore"):
        mean = c.mean(axis=0)
        a, b = q - mean, c - mean
        an, bn = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        far = an.max() + bn.max()
    if not np.isfinite(far):
        return distances(q, c)
    one = lambda n: np.ones((n, 1))
    out = np.concatenate([a * -2.0, an[:, None], one(len(a))], axis=1) @ np.concatenate([b, one(len(b)), bn[:, None]], axis=1).T
    rows, cols = _set_flags(out <= 1e-4 * far)
    np.maximum(out, 0.0, out=out)
    np.sqrt(out, out=out)
    out[rows, cols] = exact_dist(q, c, rows, cols)
    return out


def held_rows(n: int, most: int) -> int:
    """Rows whose distances to ``n`` others are held at once."""
    return max(1, min(most, HELD // max(n, 1)))


class Preselect:
    """Squared distances in single precision, with a bound on their error in each row of ``q``.

    They only decide what is clear; pairs within the bound of a limit are to be compared by their exact distances. Both sides
    are centred and scaled, which makes the bound small and keeps values in range. ``usable`` is false for values beyond numbers.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray):
        with np.errstate(all="ignore"):
            far = max(np.einsum("ij,ij->i", q, q).max(), np.einsum("ij,ij->i", c, c).max())
            mean = c.mean(axis=0)
            q, c = q - mean, c - mean
            qn, cn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
            size = max(qn.max(), cn.max())
            self.usable = bool(np.isfinite(far) and np.isfinite(size) and 1e-280 < size < 1e280)
        if not self.usable:
            return
        self.scale = scale = np.sqrt(size)
        qn, cn = qn / size, cn / size
        one = lambda n: np.ones((n, 1), np.float32)
        q, c = (q / scale).astype(np.float32), (c / scale).astype(np.float32)
        self.left = np.concatenate([c, one(len(c)), cn.astype(np.float32)[:, None]], axis=1)
        self.right = np.concatenate([q * np.float32(-2.0), qn.astype(np.float32)[:, None], one(len(q))], axis=1)
        width = self.left.shape[1] + 8
        # rounding of the inputs and of a sum of as many products, then what the centring may have moved
        self.slack = width * np.finfo(np.float32).eps * (qn + cn.max()) + 8.0 * width * _EPS * (far / size) + 1e-30

    def squares(self, cands: slice, queries: slice) -> np.ndarray:
        """A row for each candidate, a column for each query; in units of ``scale`` squared."""
        return self.left[cands] @ self.right[queries].T


_MOST = float(np.finfo(np.float32).max) / 2


def _below(limit: np.ndarray) -> np.ndarray:
    return np.nextafter(np.minimum(limit, _MOST).astype(np.float32), np.float32(-np.inf))


def _above(limit: np.ndarray) -> np.ndarray:
    """Never infinite, as that stands for what is left out."""
    return np.nextafter(np.minimum(limit, _MOST).astype(np.float32), np.float32(np.inf))


def _column_counts(flags: np.ndarray) -> np.ndarray:
    """Set flags of each column; runs of at most 255 rows are summed in single bytes."""
    whole = len(flags) // 255 * 255
    runs = flags[:whole].view(np.uint8).reshape(-1, 255, flags.shape[1])
    count = np.add.reduce(runs, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return count + np.add.reduce(flags[whole:].view(np.uint8), axis=0, dtype=np.uint8)


def _set_flags(flags: np.ndarray):
    """(row, column) of the few set flags; eight are looked at in one step."""
    flat = np.ascontiguousarray(flags).reshape(-1).view(np.uint8)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at] != 0], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, flags.shape[1])


def _selected(q, c, k: int, allowed, step: int):
    """(start, rows, cols): all that may be among the k nearest, by rows of ``q`` from ``start``."""
    step = held_rows(len(c), step)
    pre = Preselect(q, c)
    for s in range(0, len(q), step):
        rows_of = slice(s, s + step)
        if pre.usable:
            d2, slack = pre.squares(slice(None), rows_of), pre.slack[rows_of]
            if allowed is not None:
                np.copyto(d2, np.inf, where=~allowed(rows_of).T)
            group = max(1, min(64, len(c) // (4 * k)))
            runs = len(c) // group
            if runs >= k:
                # the k-th least of the minima of groups is no less than the k-th least of all
                least = d2[: runs * group].reshape(runs, group, -1).min(axis=1)
                kth = np.partition(least, k - 1, axis=0)[k - 1]
            else:
                kth = d2.max(axis=0)
            keep = (d2 <= _above(kth.astype(np.float64) + 2.0 * slack)) & (d2 < np.inf)
            cols, rows = _set_flags(keep)
            yield rows_of, rows, cols
        else:
            d2, slack = _gemm(q[rows_of], c)
            if allowed is not None:
                d2 = np.where(allowed(rows_of), d2, np.inf)
            kk = min(k, d2.shape[1])
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
            rows, cols = np.nonzero((d2 <= (kth + 2.0 * slack)[:, None]) & np.isfinite(d2))
            yield rows_of, rows, cols


def topk(q, c, c_ids, k: int, allowed=None, step: int = 512):
    """Exact k nearest rows of ``c`` per row of ``q``: (row, col, dist), ordered by (dist, id).

    The matrix product only preselects: every candidate that rounding could place among
    the k nearest is kept, and the kept ones are ranked by their exact distances.
    """
    if not len(q) or not len(c) or k < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows_out, cols_out, dist_out = [], [], []
    for rows_of, rows, cols in _selected(q, c, k, allowed, step):
        qs = q[rows_of]
        d = exact_dist(qs, c, rows, cols)
        order = np.lexsort((c_ids[cols], d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.searchsorted(rows, np.arange(len(qs)))
        pos = np.arange(len(rows)) - first[rows]
        sel = pos < k
        rows_out.append(rows[sel] + rows_of.start)
        cols_out.append(cols[sel])
        dist_out.append(d[sel])
    return np.concatenate(rows_out), np.concatenate(cols_out), np.concatenate(dist_out)


def same_ids(q_ids: np.ndarray, c_ids: np.ndarray):
    """(row, col) of all equal ids, ordered by row."""
    order = np.argsort(c_ids, kind="stable")
    low, high = (np.searchsorted(c_ids[order], q_ids, side) for side in ("left", "right"))
    rows = np.repeat(np.arange(len(q_ids)), high - low)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return rows, order[low[rows] + within]


def count_closer(q, q_ids, c, c_ids, limits: np.ndarray, limit_ids: np.ndarray, step: int = 256, tile: int = 2040):
    """Per (row, limit): how many rows of ``c`` sort before (limit, limit_id), self excluded. A negative limit counts none."""
    out = np.zeros(limits.shape, dtype=np.int64)
    if not len(q) or not len(c):
        return out
    pre = Preselect(q, c)
    if not pre.usable:
        return _count_closer_plain(q, q_ids, c, c_ids, limits, limit_ids, step)
    own_rows, own_cols = same_ids(q_ids, c_ids)
    own_tile = own_cols // tile
    t2 = np.where(limits >= 0, (limits / pre.scale) ** 2, -np.inf)
    low, high = (np.ascontiguousarray(v.T) for v in (_below(t2 - pre.slack[:, None]), _above(t2 + pre.slack[:, None])))
    for s in range(0, len(q), step):
        rows_of = slice(s, s + step)
        used = np.flatnonzero((limits[rows_of] >= 0).any(axis=0))
        mine = (own_rows >= s) & (own_rows < s + step)
        for b in range(0, len(c), tile):
            d2 = pre.squares(slice(b, b + tile), rows_of)
            own = mine & (own_tile == b // tile)
            d2[own_cols[own] - b, own_rows[own] - s] = np.inf
            sure, within, unclear = np.empty(d2.shape, bool), np.empty(d2.shape, bool), np.zeros(d2.shape, bool)
            for t in used:
                np.less(d2, low[t, rows_of], out=sure)
                out[rows_of, t] += _column_counts(sure)
                np.less_equal(d2, high[t, rows_of], out=within)
                np.logical_xor(sure, within, out=within)
                np.logical_or(unclear, within, out=unclear)
            at, rows = _set_flags(unclear)
            if not len(rows):
                continue
            d, value = exact_dist(q, c, rows + s, at + b), d2[at, rows]
            rows, ids = rows + s, c_ids[at + b]
            for t in used:
                near = (value >= low[t, rows]) & (value <= high[t, rows])
                near &= (d < limits[rows, t]) | ((d == limits[rows, t]) & (ids < limit_ids[rows, t]))
                out[:, t] += np.bincount(rows[near], minlength=len(q))
    return out


def _count_closer_plain(q, q_ids, c, c_ids, limits: np.ndarray, limit_ids: np.ndarray, step: int):
    """The same for values whose squares are beyond the range of numbers."""
    out = np.zeros(limits.shape, dtype=np.int64)
    step = held_rows(len(c), step)
    for s in range(0, len(q), step):
        qs = q[s : s + step]
        d2, slack = _gemm(qs, c)
        d2[q_ids[s : s + step][:, None] == c_ids[None, :]] = np.inf
        lim, lid = limits[s : s + step], limit_ids[s : s + step]
        for t in range(limits.shape[1]):
            t2 = lim[:, t] ** 2
            sure = d2 < (t2 - 2.0 * slack)[:, None]
            cnt = sure.sum(axis=1)
            rows, cols = np.nonzero(~sure & (d2 <= (t2 + 2.0 * slack)[:, None]))
            d = exact_dist(qs, c, rows, cols)
            before = (d < lim[rows, t]) | ((d == lim[rows, t]) & (c_ids[cols] < lid[rows, t]))
            cnt += np.bincount(rows[before], minlength=len(qs))
            out[s : s + step, t] = cnt
    return out
