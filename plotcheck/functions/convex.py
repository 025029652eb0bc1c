"""Areas that convex polygons share, many pairs at a time, in NumPy inside tasks.

A shared area is the ring of all corners that lie in the other polygon and of all crossings of edges, to nine places, in the
order of their direction from the middle. Every figure comes from the given coordinates, step by step as SQL would do it, so
that both agree to the last bit far from the origin too, where products of coordinates leave few places for an area.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of polygons that one step looks at.
PAIRS = 20_000


class Rings(NamedTuple):
    """Rings of at most as many corners as ``x`` is wide; ``n`` counts the corners of each, and ``row`` is the row it is of."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    row: np.ndarray

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(self.x.shape[1]) + 1
        at = np.where(at >= self.n[:, None], 0, at)
        return np.take_along_axis(self.x, at, 1), np.take_along_axis(self.y, at, 1)

    def take(self, which: np.ndarray) -> Rings:
        return Rings(*(c[which] for c in self))

    def is_corner(self) -> np.ndarray:
        return np.arange(self.x.shape[1]) < self.n[:, None]


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def rings(column: pa.Array) -> Rings:
    """One ring a row (array of structs with x and y); null is one of no corners."""
    n, flat = _lengths(column).astype(np.int64), column.flatten()
    shape = (len(n), max(1, int(n.max(initial=0))))
    x, y, at = np.zeros(shape), np.zeros(shape), np.arange(shape[1]) < n[:, None]
    x[at], y[at] = flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)
    return Rings(x, y, n, np.arange(len(n)))


def many_rings(column: pa.Array) -> Rings:
    """Several rings a row."""
    return rings(column.flatten())._replace(row=np.repeat(np.arange(len(column)), _lengths(column)))


def are_convex(r: Rings) -> np.ndarray:
    """Which rings are convex and counter-clockwise, and go round once."""
    real, (bx, by) = r.is_corner(), r.next()
    dx, dy = bx - r.x, by - r.y
    nxt = Rings(dx, dy, r.n, r.row).next()
    turn = dx * nxt[1] - dy * nxt[0]
    round_ = np.where(real, np.arctan2(turn, dx * nxt[0] + dy * nxt[1]), 0).sum(axis=1)
    return (r.n >= 3) & ((turn >= -1e-6) | ~real).all(axis=1) & (np.abs(round_ - 2 * np.pi) < 1e-3)


def _rounded(v: np.ndarray) -> np.ndarray:
    """To nine places, halves away from zero."""
    v = v * 1e9
    whole = np.trunc(v)
    return (whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0)) / 1e9


def _areas(p: Rings, q: Rings) -> np.ndarray:
    (pbx, pby), (qbx, qby), pm, qm = p.next(), q.next(), p.is_corner(), q.is_corner()
    # Axis 1: corners and edges of p; axis 2: those of q.
    px, py, pbx, pby = (c[:, :, None] for c in (p.x, p.y, pbx, pby))
    qx, qy, qbx, qby = (c[:, None, :] for c in (q.x, q.y, qbx, qby))
    p_in = (((qbx - qx) * (py - qy) - (qby - qy) * (px - qx) >= -1e-9) | ~qm[:, None, :]).all(axis=2) & pm
    q_in = (((pbx - px) * (qy - py) - (pby - py) * (qx - px) >= -1e-9) | ~pm[:, :, None]).all(axis=1) & qm
    with np.errstate(divide="ignore", invalid="ignore"):
        det = (pbx - px) * (qby - qy) - (pby - py) * (qbx - qx)
        t = ((qx - px) * (qby - qy) - (qy - py) * (qbx - qx)) / det
        u = ((qx - px) * (pby - py) - (qy - py) * (pbx - px)) / det
        cross = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & pm[:, :, None] & qm[:, None, :]
        cx, cy = px + t * (pbx - px), py + t * (pby - py)
    at = [np.nonzero(m) for m in (p_in, q_in, cross)]
    row = np.concatenate([a[0] for a in at])
    x, y = (_rounded(np.concatenate([c[a] for c, a in zip(cs, at, strict=True)])) for cs in ((p.x, q.x, cx), (p.y, q.y, cy)))
    order = np.lexsort((y, x, row))
    row, x, y = row[order], x[order], y[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(row)]
    row, x, y = row[new], x[new], y[new]
    count = np.bincount(row, minlength=len(p.n))
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = (np.bincount(row, weights=c, minlength=len(p.n)) / count for c in (x, y))
    order = np.lexsort((y, x, np.arctan2(y - my[row], x - mx[row]), row))
    row, x, y = row[order], x[order], y[order]
    first = np.cumsum(count) - count
    after = np.arange(len(row)) + 1
    after = np.where(after == (first + count)[row], first[row], after)
    return np.bincount(row, weights=x * y[after] - x[after] * y, minlength=len(p.n)) / 2


def shared_areas(p: Rings, q: Rings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Area that ring i of ``p`` and ring j of ``q`` share, pair by pair; all are convex and counter-clockwise."""

    def box(r: Rings) -> list[np.ndarray]:
        real = r.is_corner()
        return [np.where(real, c, sign * np.inf).min(axis=1) if sign > 0 else np.where(real, c, -np.inf).max(axis=1) for c in (r.x, r.y) for sign in (1, -1)]

    (px1, px2, py1, py2), (qx1, qx2, qy1, qy2) = box(p), box(q)
    near = np.flatnonzero((px1[i] <= qx2[j] + 1e-3) & (qx1[j] <= px2[i] + 1e-3) & (py1[i] <= qy2[j] + 1e-3) & (qy1[j] <= py2[i] + 1e-3))
    out = np.zeros(len(i))
    for at in range(0, len(near), PAIRS):
        some = near[at : at + PAIRS]
        out[some] = _areas(p.take(i[some]), q.take(j[some]))
    return out


def pairs(p: Rings, q: Rings, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each ring of ``p`` with each of ``q`` of the same row, both in the order of rows."""
    n = np.bincount(q.row, minlength=rows)
    start, own = np.cumsum(n) - n, n[p.row]
    i = np.repeat(np.arange(len(p.row)), own)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + start[p.row][i]


def holds(p: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Does each ring hold the point of its place, by the even-odd rule?"""
    (bx, by), x, y = p.next(), x[:, None], y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        met = ((p.y > y) != (by > y)) & (x < (bx - p.x) * (y - p.y) / (by - p.y) + p.x)
    return (met & p.is_corner()).sum(axis=1) % 2 == 1
