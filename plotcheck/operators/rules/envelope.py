"""The invisible envelope of a parcel: how high a wall may be at each of its points.

A parcel is one row with arrays: its boundary, the boundary of the permitted area (moved out to the middle of roads), and the
outlines of what stands in the way. Cells come as row spans between the crossings of each grid row, and the distance of all of
them to all segments is one array expression, so that neither cells nor cells times edges are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.functions.grid import row_spans
from plotcheck.operators.rules import limits as lim
from plotcheck.storage import spread

#: Edges of own buildings up to this length have no setback area.
SHORT_EDGE = 0.3
#: Roof of a building whose pitch is unknown counts by this share.
ROOF_SHARE = 1 / 3
#: Points whose distances one step computes at most.
POINTS = 20_000

_EDGE = ("ax", "ay", "bx", "by_")


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie within a ring of edges, by the even-odd rule."""
    odd = np.zeros(len(x), bool)
    for ax, ay, bx, by in ring.tolist():
        if ay != by:
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def distance(x: np.ndarray, y: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Least distance of each point to the segments; infinite without any."""
    best = np.full(len(x), np.inf)
    for ax, ay, bx, by in segments.tolist():
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = 0.0 if square == 0 else np.clip(((x - ax) * dx + (y - ay) * dy) / square, 0.0, 1.0)
        ex, ey = x - ax - t * dx, y - ay - t * dy
        np.minimum(best, ex * ex + ey * ey, out=best)
    return np.sqrt(best)


def signed_area(ring: np.ndarray) -> float:
    return float((ring[:, 0] * ring[:, 3] - ring[:, 2] * ring[:, 1]).sum()) / 2


def outward(ring: np.ndarray) -> np.ndarray:
    """Outward unit normal of each edge."""
    d = ring[:, 2:] - ring[:, :2]
    n = np.stack([d[:, 1], -d[:, 0]], axis=1) / np.maximum(np.hypot(*d.T), 1e-12)[:, None]
    return n if signed_area(ring) > 0 else -n


def moved_out(ring: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The ring with each edge moved out by its shift, mitred; unchanged if the result is no sensible outline."""
    if not (shift > 0).any():
        return ring
    n = outward(ring)
    p = ring[:, :2] + n * shift[:, None]
    d = ring[:, 2:] - ring[:, :2]
    d = d / np.maximum(np.hypot(*d.T), 1e-12)[:, None]
    before = np.roll(np.arange(len(ring)), 1)
    det = d[before, 0] * d[:, 1] - d[before, 1] * d[:, 0]
    flat = np.abs(det) < 1e-6
    gap = p - p[before]
    t = (gap[:, 0] * d[:, 1] - gap[:, 1] * d[:, 0]) / np.where(flat, 1.0, det)
    corner = np.where(flat[:, None], ring[:, :2] + n * shift[:, None], p[before] + d[before] * t[:, None])
    out = np.hstack([corner, np.roll(corner, -1, axis=0)])
    old, new = abs(signed_area(ring)), abs(signed_area(out))
    return ring if new < 0.99 * old or new > 20 * old + 3000 else out


def setback_areas(ring: np.ndarray, depth: float) -> list[np.ndarray]:
    """The rectangle before each wall of a building that is longer than SHORT_EDGE, as rings of edges."""
    n = outward(ring) * depth
    out = []
    for (ax, ay, bx, by), (nx, ny) in zip(ring.tolist(), n.tolist()):  # noqa: B905
        if np.hypot(bx - ax, by - ay) > SHORT_EDGE:
            corner = np.array([[ax, ay], [bx, by], [bx + nx, by + ny], [ax + nx, ay + ny]])
            out.append(np.hstack([corner, np.roll(corner, -1, axis=0)]))
    return out


def rectangle_gap(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Square of each point's distance to the rectangle whose edges ``ring`` holds; 0 within."""
    ax, ay, bx, by = ring[0].tolist()
    cx, cy = ring[1, 2:].tolist()
    if (ax == bx and by == cy) or (ay == by and bx == cx):
        u, v = x - min(ax, cx), y - min(ay, cy)
        long, wide = abs(cx - ax), abs(cy - ay)
    else:
        long, wide = np.hypot(bx - ax, by - ay), np.hypot(cx - bx, cy - by)
        u = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long
        v = ((x - ax) * (cx - bx) + (y - ay) * (cy - by)) / wide
    u = np.maximum(np.maximum(-u, u - long), 0.0)
    v = np.maximum(np.maximum(-v, v - wide), 0.0)
    return u * u + v * v


class Model:
    """What limits walls on one parcel: ``plot``, permitted ``area``, obstacles that keep their distance, and rings that are only closed."""

    def __init__(self, row: dict) -> None:
        edges = sorted(row["ring"], key=lambda e: e["seg"])
        self.plot = np.array([[e[c] for c in _EDGE] for e in edges], np.float64)
        self.area = moved_out(self.plot, np.array([e["shift"] for e in edges], np.float64))
        self.obstacles, self.rectangles, self.closed = [], [], []
        for h in row["houses"] or ():
            ring = np.array([[e[c] for c in _EDGE] for e in sorted(h["ring"], key=lambda e: e["seg"])], np.float64)
            if not h["own"]:
                # Inventory counts where its first corner lies on the parcel; it needs no distance.
                if inside(ring[:1, 0], ring[:1, 1], self.plot)[0]:
                    self.closed.append(ring)
                continue
            # A point within a rectangle lies 0 from it, so that it is closed as well.
            upright = len(ring) == 4 and (((ring[:, 0] == ring[:, 2]) != (ring[:, 1] == ring[:, 3])).all()) and abs(signed_area(ring)) == np.ptp(ring[:, 0]) * np.ptp(ring[:, 1])
            (self.rectangles if upright else self.obstacles).append(ring)
            if h["eaves"] is not None:
                height = h["eaves"] + max(0.0, (h["ridge"] if h["ridge"] is not None else h["eaves"]) - h["eaves"]) * ROOF_SHARE
                self.rectangles += setback_areas(ring, max(lim.SETBACK_LEAST, lim.SETBACK_FACTOR * height))
        self.segments = np.concatenate([self.area, *self.obstacles])

    def heights(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Greatest height H of a wall at each point: distance / 0.4 from 3 m on, else 0."""
        out = np.zeros(len(x))
        for at in range(0, len(x), POINTS):
            px, py = x[at : at + POINTS], y[at : at + POINTS]
            free = inside(px, py, self.area)
            for ring in self.obstacles + self.closed:
                free &= ~inside(px, py, ring)
            d = distance(px[free], py[free], self.segments)
            if self.rectangles:
                fx, fy, d = px[free], py[free], d * d
                for ring in self.rectangles:
                    np.minimum(d, rectangle_gap(fx, fy, ring), out=d)
                d = np.sqrt(d)
            out[at : at + POINTS][free] = np.where(d >= lim.SETBACK_LEAST - 1e-9, d / lim.SETBACK_FACTOR, 0.0)
        return out


def models(edges: DataFrame, buildings: DataFrame | None = None, inventory: DataFrame | None = None) -> DataFrame:
    """(parcel_id, ring, houses), one row for each parcel.

    ``edges`` may have ``shift``, metres by which an edge moves out. ``buildings`` and ``inventory`` are edges with parcel_id, obj_id,
    and, of buildings, eaves and ridge, which may be null. Arrays hold what belongs to one parcel.
    """
    shift = F.coalesce("shift", F.lit(0.0)) if "shift" in edges.columns else F.lit(0.0)
    ring = edges.groupBy("parcel_id").agg(F.collect_list(F.struct("seg", *_EDGE, shift.alias("shift"))).alias("ring"))
    none = F.lit(None).cast("double")
    parts = [
        d.groupBy("parcel_id", "obj_id", eaves.alias("eaves"), ridge.alias("ridge")).agg(F.collect_list(F.struct("seg", *[F.col(c).cast("double").alias(c) for c in _EDGE])).alias("ring")).withColumn("own", F.lit(own))
        for d, own, eaves, ridge in ((buildings, True, F.col("eaves") if buildings is not None else none, F.col("ridge") if buildings is not None else none), (inventory, False, none, none))
        if d is not None
    ]
    if not parts:
        return ring.withColumn("houses", F.lit(None).cast("array<struct<own:boolean,eaves:double,ridge:double,ring:array<struct<seg:int,ax:double,ay:double,bx:double,by_:double>>>>"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    houses = every.groupBy("parcel_id").agg(F.collect_list(F.struct("own", "eaves", "ridge", "ring")).alias("houses"))
    return ring.join(houses, "parcel_id", "left")


def envelope(model: DataFrame, res: float, digits: int | None = None) -> DataFrame:
    """(parcel_id, col, row_, height) at every grid point (col * res, row_ * res) of each parcel of ``models``, heights to ``digits`` places if given.

    Height: distance to the permitted area's boundary, to own buildings and to their setback areas, divided by 0.4, from 3 m on;
    else 0, as in buildings, their setback areas and confirmed inventory. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = Model(row)
                col, line = row_spans(m.plot, res)
                if len(col):
                    height = m.heights(col * res, line * res)
                    if digits is not None:
                        height = np.floor(height * 10.0**digits + 0.5) / 10.0**digits
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(col), row["parcel_id"])), pa.array(col), pa.array(line), pa.array(height)], names=["parcel_id", "col", "row_", "height"])

    each = spread(model.filter("parcel_id IS NOT NULL").select(F.col("parcel_id").cast("long").alias("parcel_id"), "ring", "houses"), "parcel_id")
    return each.mapInArrow(run, "parcel_id long, col long, row_ long, height double")


def envelope_breaches(walls: DataFrame, model: DataFrame, step: float = 0.25) -> DataFrame:
    """(obj_id, samples, breaches, excess) of planned objects: points each ``step`` along their walls that stand higher than the envelope by over 1 cm, and the most.

    ``walls``: parcel_id, obj_id, ax, ay, bx, by_, height of the wall at both ends (ha, hb), and the roof's share ``roof``. Heights
    are looked up exactly, not in a grid. Objects of parcels without outline have no row.
    """
    wall = F.struct("obj_id", *[F.col(c).cast("double").alias(c) for c in (*_EDGE, "ha", "hb", "roof")])
    held = walls.groupBy("parcel_id").agg(F.collect_list(wall).alias("walls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m, found = Model(row), {}
                for w in row["walls"]:
                    n = max(1, int(np.ceil(np.hypot(w["bx"] - w["ax"], w["by_"] - w["ay"]) / step)))
                    t = np.arange(n + 1) / n
                    height = m.heights(w["ax"] + (w["bx"] - w["ax"]) * t, w["ay"] + (w["by_"] - w["ay"]) * t)
                    over = w["ha"] + (w["hb"] - w["ha"]) * t + w["roof"] - height
                    samples, breaches, most = found.get(w["obj_id"], (0, 0, 0.0))
                    found[w["obj_id"]] = (samples + n + 1, breaches + int((over > 0.01).sum()), max(most, float(over.max())))
                cols = [list(found), *(list(c) for c in zip(*found.values()))]  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["obj_id", "samples", "breaches", "excess"])  # noqa: B905

    return spread(model.join(held, "parcel_id"), "parcel_id").drop("parcel_id").mapInArrow(run, "obj_id long, samples long, breaches long, excess double")


def plant_zones(edges: DataFrame, res: float) -> DataFrame:
    """(parcel_id, col, row_, colour) of the cells of each parcel: red nearer than 0.5 m to a side, yellow where plants may be 2 m high, green without limit.

    ``edges`` have flags ``road`` (the side does not count) and ``forest`` (it limits within 0.5 m only); null is false.
    """
    ring = edges.groupBy("parcel_id").agg(F.collect_list(F.struct("seg", *_EDGE, F.coalesce("road", F.lit(False)).alias("road"), F.coalesce("forest", F.lit(False)).alias("forest"))).alias("ring"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["red", "yellow", "green"])
        for batch in batches:
            for row in batch.to_pylist():
                sides = [e for e in sorted(row["ring"], key=lambda e: e["seg"])]
                of = lambda keep: np.array([[e[c] for c in _EDGE] for e in sides if keep(e)], np.float64).reshape(-1, 4)  # noqa: B023, E731
                col, line = row_spans(of(lambda e: True), res, 0.5)
                if not len(col):
                    continue
                x, y = (col + 0.5) * res, (line + 0.5) * res
                every, open_ = distance(x, y, of(lambda e: not e["road"])), distance(x, y, of(lambda e: not e["road"] and not e["forest"]))
                near = lambda d, least: d + 1e-9 < least
                colour = np.where(near(every, lim.PLANT_SMALL), 0, np.where(near(open_, lim.PLANT_TALL), 1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(col), row["parcel_id"])), pa.array(col), pa.array(line), names.take(pa.array(colour))], names=["parcel_id", "col", "row_", "colour"])

    each = spread(ring.filter("parcel_id IS NOT NULL").withColumn("parcel_id", F.col("parcel_id").cast("long")), "parcel_id")
    return each.mapInArrow(run, "parcel_id long, col long, row_ long, colour string")
