"""Grid cells of polygons, in array expressions."""

from __future__ import annotations

import numpy as np


def row_spans(ring: np.ndarray, res: float, offset: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(col, row) of the grid points ((col + offset) * res, (row + offset) * res) within a ring of edges (ax, ay, bx, by), by the even-odd rule."""
    ax, ay, bx, by = ring.T
    low, high = int(np.floor(min(ay.min(), by.min()) / res)), int(np.floor(max(ay.max(), by.max()) / res))
    rows = np.arange(low, high + 1)
    y = (rows + offset) * res
    met = (ay[None] > y[:, None]) != (by[None] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(met, (bx - ax) * (y[:, None] - ay) / (by - ay) + ax, np.inf)
    x.sort(axis=1)
    cols, out = [], []
    for k in range(0, x.shape[1] - 1, 2):
        some = np.isfinite(x[:, k + 1])
        first = np.ceil(x[some, k] / res - offset).astype(np.int64)
        n = np.maximum(np.ceil(x[some, k + 1] / res - offset).astype(np.int64) - first, 0)
        cols.append(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
        out.append(np.repeat(rows[some], n))
    return (np.concatenate(cols), np.concatenate(out)) if cols else (np.zeros(0, np.int64), np.zeros(0, np.int64))
