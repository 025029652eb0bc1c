"""The envelope of a parcel against single points, on outlines that are not convex."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotcheck.functions.grid import row_spans
from plotcheck.operators import spatial as s
from plotcheck.operators.rules import envelope as env

NOTCHED = [(0.0, 0.0), (30.0, 0.0), (30.0, 24.0), (18.0, 24.0), (18.0, 14.0), (12.0, 14.0), (12.0, 24.0), (0.0, 24.0)]


def holds(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def to_edge(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


HOUSE, CLOSED = (8.0, 4.0, 14.0, 9.0), (22.0, 6.0, 24.0, 8.0)


def height(x, y):
    """With the lower side moved out by 4 m to the middle of a road."""
    area = [(0.0, -4.0), (30.0, -4.0), *NOTCHED[2:]]
    x1, y1, x2, y2 = HOUSE
    t = max(3.0, 0.4 * (9.0 + 3.0 / 3))
    held = [box(*HOUSE), box(x1, y1 - t, x2, y1), box(x2, y1, x2 + t, y2), box(x1, y2, x2, y2 + t), box(x1 - t, y1, x1, y2)]
    if not holds(x, y, area) or any(holds(x, y, r) for r in [*held, box(*CLOSED)]):
        return 0.0
    d = min(to_edge(x, y, a, b) for r in [area, *held] for a, b in zip(r, r[1:] + r[:1], strict=True))
    return d / 0.4 if d >= 3 - 1e-9 else 0.0


@pytest.fixture(scope="module")
def model(spark):
    ring = spark.createDataFrame([(1, i, *p) for i, p in enumerate(NOTCHED)] + [(2, i, *p) for i, p in enumerate(box(100.0, 0.0, 108.0, 6.0))], "parcel_id long, seq int, x double, y double")
    edges = s.ring_edges(ring).withColumn("shift", F.when((F.col("parcel_id") == 1) & (F.col("seg") == 0), 4.0))
    house = spark.createDataFrame([(7, 1, *HOUSE, 9.0, 12.0)], "obj_id long, parcel_id long, x1 double, y1 double, x2 double, y2 double, eaves double, ridge double")
    shed = spark.createDataFrame([(8, 1, *CLOSED), (9, 1, -4.0, 2.0, 5.0, 9.0)], "obj_id long, parcel_id long, x1 double, y1 double, x2 double, y2 double")
    return env.models(edges, s.box_edges(house, "parcel_id", "obj_id", "eaves", "ridge"), s.box_edges(shed, "parcel_id", "obj_id"))


def test_heights(spark, model):
    got = {(r.col, r.row_): r.height for r in env.envelope(model, 0.5).filter("parcel_id = 1").collect()}
    want = {(i, j): height(i / 2, j / 2) for i in range(-1, 62) for j in range(-1, 50) if holds(i / 2, j / 2, NOTCHED)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert max(want.values()) > 0
    assert env.envelope(model.filter("parcel_id = 3"), 0.5).count() == 0


def test_breaches(spark, model):
    walls = [(5, 1, 20.0, 2.0, 26.0, 2.0, 3.0, 9.0, 0.5), (5, 1, 26.0, 2.0, 26.0, 5.1, 9.0, 9.0, 0.5), (6, 1, 29.0, -1.0, 33.0, -1.0, 2.0, 2.0, 0.0), (7, 9, 0.0, 0.0, 1.0, 0.0, 2.0, 2.0, 0.0)]
    df = spark.createDataFrame(walls, "obj_id long, parcel_id long, ax double, ay double, bx double, by_ double, ha double, hb double, roof double")
    got = {r.obj_id: (r.samples, r.breaches, r.excess) for r in env.envelope_breaches(df, model).collect()}
    want = {}
    for i, p, ax, ay, bx, by, ha, hb, roof in walls:
        n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / 0.25))
        over = [ha + (hb - ha) * k / n + roof - height(ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(n + 1)]
        if p == 1:
            a, b, c = want.get(i, (0, 0, 0.0))
            want[i] = (a + n + 1, b + sum(o > 0.01 for o in over), max(c, *over))
    assert {i: v[:2] for i, v in got.items()} == {i: v[:2] for i, v in want.items()}
    assert all(got[i][2] == pytest.approx(want[i][2]) for i in want)


def test_row_spans_of_any_ring():
    rng = random.Random(4)
    for _ in range(50):
        ring = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(rng.randrange(3, 9))]
        edges = np.array([[*a, *b] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])
        for res, offset in ((0.5, 0.0), (1.0, 0.5)):
            got = sorted(zip(*(v.tolist() for v in row_spans(edges, res, offset)), strict=True))
            assert got == [(i, j) for i in range(-15, 15) for j in range(-15, 15) if holds((i + offset) * res, (j + offset) * res, ring)]


def test_plant_zones(spark):
    ring = spark.createDataFrame([(1, i, *p) for i, p in enumerate(NOTCHED)], "parcel_id long, seq int, x double, y double")
    edges = s.ring_edges(ring).withColumns({"road": F.col("seg") == 0, "forest": F.when(F.col("seg") == 1, True)})
    got = {(r.col, r.row_): r.colour for r in env.plant_zones(edges, 1.0).collect()}
    sides = list(zip(NOTCHED, NOTCHED[1:] + NOTCHED[:1], strict=True))
    for (i, j), colour in got.items():
        d = [to_edge(i + 0.5, j + 0.5, a, b) for a, b in sides]
        want = "red" if min(d[1:]) < 0.5 - 1e-9 else "yellow" if min(d[2:]) < 2 - 1e-9 else "green"
        assert colour == want
    assert len(got) == 30 * 24 - 6 * 10
