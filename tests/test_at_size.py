"""Queries whose intermediate tables must not outgrow their inputs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from test_queries import QUERIES, SF

from plotcheck.operators.rules import building
from plotcheck.plans import fixtures

EDGES = "parcel_id long, seg int, ax double, ay double, bx double, by_ double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ring(parcel_id, *corners):
    return [(parcel_id, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))]


def test_start_position_keeps_a_parcel_in_one_row(spark, monkeypatch):
    parcels = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 15.0, 3.0), (2, 100.0, 0.0, 4.0, 4.0, 0.0), (3, -40.0, -7.0, 12.0, 12.0, 0.0)], "parcel_id long, x0 double, y0 double, w double, h double, skew double")
    outlines = {1: ring(1, (0, 0), (20, 0), (23, 15), (0, 15)), 2: ring(2, (100, 0), (104, 0), (104, 4), (100, 4)), 3: ring(3, (-40, -7), (-28, -7), (-28, 5), (-40, 5))}
    obstacles = [(1, 8.0, 6.0, 11.0, 9.0), (1, None, 0.0, 1.0, 1.0), (3, -100.0, -100.0, -90.0, -90.0)]
    monkeypatch.setattr(building, "POINTS", 100)
    got = building.start_position(parcels, spark.createDataFrame(sum(outlines.values(), []), EDGES), spark.createDataFrame(obstacles, "parcel_id long, x1 double, y1 double, x2 double, y2 double"), 0.5, 3.0)
    assert "Generate" not in plan_of(got)
    want = {}
    for p in parcels.collect():
        for i in range(math.floor(p.x0 / 0.5), math.floor((p.x0 + p.w + p.skew) / 0.5) + 1):
            for j in range(math.floor(p.y0 / 0.5), math.floor((p.y0 + p.h) / 0.5) + 1):
                x, y = (i + 0.5) * 0.5, (j + 0.5) * 0.5
                gap = round(min(((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / math.hypot(bx - ax, by - ay) for _, _, ax, ay, bx, by in outlines[p.parcel_id]), 6)
                hit = any(o[0] == p.parcel_id and o[1] is not None and x - 1.5 < o[3] and o[1] < x + 1.5 and y - 1.5 < o[4] and o[2] < y + 1.5 for o in obstacles)
                if gap >= 3 and not hit:
                    want[p.parcel_id] = min(want.get(p.parcel_id, (math.inf,)), (-gap, y, x))
    assert {r.parcel_id: (-r.gap, r.y, r.x) for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    assert set(want) == {1, 3}


@pytest.mark.parametrize("name", ["placement_zones", "envelope", "envelope_breaches", "plant_zones", "start_position", "cells_in_polygons"])
def test_parcels_are_dealt_to_many_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES[name](spark, SF))


def test_best_places_are_those_of_all_cells(spark):
    from plotcheck.operators.rules import zones

    got = {tuple(r) for r in QUERIES["product_fit"](spark, SF).collect()}
    want = zones.product_fit(QUERIES["placement_zones"](spark, SF), fixtures.view(spark, SF, "parcel")).collect()
    assert got == {tuple(r) for r in want}


def zones_of(spark, east=0.0, north=0.0, obstacles=((1, 5.0, 5.0, 9.0, 8.0), (2, 52.0, 8.0, 60.0, 11.0)), products=(("haus", 4.0, 3.0), ("carport", 6.0, 3.0))):
    from plotcheck.operators.rules import zones

    parcels = spark.createDataFrame([(1, east, north), (2, east + 50, north)], "parcel_id long, x0 double, y0 double")
    # The first parcel is a little over as wide as a product and two distances; both products touch its sides exactly.
    outlines = ring(1, (0, 0), (12, 0), (12, 27.5), (0, 27.5)) + ring(2, (50, 0), (82, 0), (85, 25), (50, 25))
    edges = spark.createDataFrame([(p, i, ax + east, ay + north, bx + east, by + north) for p, i, ax, ay, bx, by in outlines], EDGES).withColumn("used", F.when(F.col("seg") == 0, 4.5))
    held = spark.createDataFrame([(p, *(v if v is None else v + o for v, o in zip(box, (east, north) * 2, strict=True))) for p, *box in obstacles], "parcel_id long, x1 double, y1 double, x2 double, y2 double")
    args = parcels, edges, held, spark.createDataFrame(list(products), "product string, w double, d double"), 1.0, 0.25
    return zones.placement_zones(*args), zones.fit_of(zones.best_places(*args))


def test_zones_leave_their_tasks_as_runs(spark):
    got = zones_of(spark)[0]
    plan = plan_of(got).split("== Initial Plan ==")[0]
    # Cells are counted out of runs after Python has judged them.
    assert re.search(r"Generate explode\(sequence[\s\S]*MapInArrow", plan)
    assert got.count() == got.dropDuplicates(["parcel_id", "product", "x", "y"]).count()


def test_zones_are_the_same_far_from_the_origin(spark):
    moved = lambda rows, e, n: {(r.parcel_id, r.product, r.x - e, r.y - n, r.colour, r.angle) for r in rows}
    e, n = 4e8, 7e8
    for here, there in zip(zones_of(spark), zones_of(spark, e, n), strict=True):
        want = moved(here.collect(), 0, 0)
        assert len({r[4] for r in want}) >= 1 and moved(there.collect(), e, n) == want


def test_obstacles_without_place_stand_nowhere(spark):
    seen = lambda o: {tuple(r) for r in zones_of(spark, obstacles=o)[0].collect()}
    box = (1, 5.0, 5.0, 9.0, 8.0)
    assert seen([box, (1, None, 2.0, 3.0, 4.0), (2, 1.0, None, None, None)]) == seen([box])


@pytest.mark.parametrize("turn", [0.0, math.pi / 2, 0.3, -2.0])
def test_rectangle_gap_is_the_distance_to_the_filled_rectangle(turn):
    import numpy as np

    from plotcheck.operators.rules import envelope

    rng = np.random.default_rng(1)
    box = np.array([[0.0, 0.0], [5.0, 0.0], [5.0, 2.0], [0.0, 2.0]]) @ np.round([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]], 12) + [10.0, -3.0]
    edges = np.hstack([box, np.roll(box, -1, axis=0)])
    x, y = rng.uniform(0, 20, 500), rng.uniform(-12, 8, 500)
    want = np.where(envelope.inside(x, y, edges), 0.0, envelope.distance(x, y, edges))
    assert np.allclose(np.sqrt(envelope.rectangle_gap(x, y, edges)), want, atol=1e-9)


def test_rain_lookup_keeps_a_query_in_one_row(spark):
    from plotcheck.operators import raster

    table = spark.createDataFrame([(5, 10, 1.0), (10, 10, 2.0), (20, 10, 4.0), (5, 2, 0.5)], "dauer_min int, jahre int, hn double")
    queries = spark.createDataFrame([(1, 10, 10.0), (2, 10, 15.0), (3, 10, 3.0), (4, 2, 5.0), (5, 10, None), (6, 7, 5.0)], "q long, jahre int, dauer double")
    got = raster.bracket_interpolate(queries, table)
    assert {r.q: r.hn for r in got.collect()} == {1: 2.0, 2: pytest.approx(2 + 2 * math.log(1.5) / math.log(2)), 3: None, 4: 0.5, 5: None}
    # The only aggregate is that of the table.
    assert "q#" not in "".join(line for line in plan_of(got).splitlines() if "Aggregate" in line)


def test_bilinear_does_not_multiply_points(spark):
    from plotcheck.operators import raster

    cells = spark.createDataFrame([(c, r, float(10 * c + r)) for c in range(3) for r in range(3) if (c, r) != (2, 2)] + [(7, 7, 1.0)], "col long, row_ long, z double")
    points = spark.createDataFrame([("a", 10.0, 10.0), ("b", 25.0, 25.0), ("c", -5.0, 900.0)], "pt string, x double, y double")
    got = raster.bilinear(points, cells, 10.0, 3, 3)
    assert "pt#" not in "".join(line for line in plan_of(got).splitlines() if "Aggregate" in line or "Exchange hash" in line)
    rows = {r.pt: (r.z, r.weight) for r in got.collect()}
    assert rows == {"a": (5.5, 1.0), "b": (0.0, 0.0), "c": (2.0, 1.0)}


def test_tiles_share_folders(spark, tmp_path):
    from plotcheck.sources import tiles

    path = str(tmp_path / "tiles")
    tiles.write_tiles(spark.range(3000).selectExpr("id", "5D AS x", "CAST(id - 100 AS DOUBLE) * 10 AS y"), path, 10.0)
    assert len(list((tmp_path / "tiles").glob("kx=*/*"))) <= 4
    assert {r.id for r in tiles.read_tiles(spark, path, (0.0, -20.0, 10.0, 30.0), 10.0).collect()} == {98, 99, 100, 101, 102}


def test_setback_check_equals_sql_far_from_the_origin(spark, tmp_path):
    import duckdb
    from test_queries import SQL, plain

    con = duckdb.connect()
    for table, keys in (("customer", ["c_custkey"]), ("orders", ["o_orderkey", "o_custkey"]), ("part", ["p_partkey"])):
        moved = ", ".join(f"CAST({k} + r * 1000000007 AS BIGINT) AS {k}" for k in keys)
        con.execute(f"COPY (SELECT * EXCLUDE (r) REPLACE ({moved}) FROM (SELECT t.*, r FROM '{SF}/{table}.parquet' t, range(3) x(r))) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = QUERIES["setback_check"](spark, str(tmp_path))
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['setback_check']})").fetchall())


def test_parcels_that_are_not_convex_are_clipped():
    import numpy as np

    from plotcheck.functions import convex

    corners = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (0, 4), (4, 4), (4, 0)], [(0, 0), (4, 0), (1, 1), (0, 4)], [(0, 0), (2, 0), (4, 0), (4, 4)]]
    r = convex.Rings(*(np.array([[p[k] for p in c] for c in corners], float) for k in (0, 1)), np.full(4, 4), np.arange(4))
    assert convex.are_convex(r).tolist() == [True, False, False, True]
    assert convex.shared_areas(r, r, np.array([0, 0]), np.array([0, 3])).tolist() == [16.0, 8.0]


def test_boundary_segments_keep_an_object_in_one_row_an_edge(spark):
    import random

    from plotcheck.operators import spatial as s

    rng = random.Random(3)
    boxes = spark.createDataFrame([(i, 1, (x := rng.uniform(-6, 30)), (y := rng.uniform(-6, 20)), x + rng.uniform(0.5, 9), y + rng.uniform(0.5, 9)) for i in range(300)], "obj_id long, parcel_id long, x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame(ring(1, (0, 0), (27, 0), (30, 2), (28, 18), (2, 17)), EDGES)
    got = building.boundary_segments(boxes, edges)
    assert "Aggregate" not in plan_of(got)
    length = s.projected_length(s.box_corners(boxes, "parcel_id", "obj_id"), edges)
    want = s.polygon_distance(s.as_outline(s.box_edges(boxes, "parcel_id", "obj_id"), "parcel_id", "obj_id"), edges, "parcel_id", ("obj_id", "seg")).join(length, ["obj_id", "seg"])
    want = {(r.obj_id, r.seg): (r.distance, r.length) for r in want.collect()}
    assert len(want) == 1500 and {(r.obj_id, r.seg): (r.distance, r.length) for r in got.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def one_by_one(points, least, quotas=None):
    """Ids chosen in order: points (id, stratum, x, y)."""
    import hashlib

    chosen, used = [], dict.fromkeys(quotas or (), 0)
    for p in sorted(points, key=lambda p: (hashlib.sha256(f"w9/{p[0]}".encode()).hexdigest(), p[0])):
        if quotas is not None and used.get(p[1], 0) >= quotas.get(p[1], 0):
            continue
        if all(math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) >= least for q in chosen):
            chosen.append(p)
            if quotas is not None:
                used[p[1]] += 1
    return sorted(p[0] for p in chosen)


@pytest.mark.parametrize(("tile", "crowded"), [(4, 10**9), (4, 300), (64, 10**9)])
def test_spaced_select_settles_squares_as_in_order(spark, monkeypatch, tile, crowded):
    import random

    from plotcheck.operators import iterative as it

    rng = random.Random(5)
    points = [(i, "a", rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(900)] + [(1000 + i, "a", rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)]
    df = spark.createDataFrame(points, "id long, stratum string, x double, y double")
    monkeypatch.setattr(it, "TILE", tile)
    monkeypatch.setattr(it, "CROWDED", crowded)
    beats = []
    old = it.first_come
    monkeypatch.setattr(it, "first_come", lambda nodes, b: beats.append(b.count()) or old(nodes, b))
    assert sorted(r.id for r in it.spaced_select(df, 4.0, "w9").collect()) == one_by_one(points, 4.0)
    # Only what hangs on points of other squares is left; four large ones meet here.
    assert beats[0] < it._too_near(df.withColumn("key", it.salted("w9", "id")), 4.0).count() / (10 if tile == 64 else 1)


@pytest.mark.parametrize("quotas", [{"a": 12, "b": 9}, {"a": 12, "b": 9, "rare": 3}, {"a": 400, "b": 5}])
def test_spaced_quota_pairs_what_the_quotas_reach(spark, monkeypatch, quotas):
    import random

    from plotcheck.operators import iterative as it

    rng = random.Random(6)
    points = [(i, "a" if i % 3 else "b", rng.uniform(0, 90), rng.uniform(0, 90)) for i in range(600)] + [(1000 + i, "rare", 3.0 * i, 1.0) for i in range(5)]
    df = spark.createDataFrame(points, "id long, stratum string, x double, y double")
    seen, old = [], it._wave
    monkeypatch.setattr(it, "_wave", lambda keyed, *rest: seen.append(keyed.count()) or old(keyed, *rest))
    q = spark.createDataFrame(list(quotas.items()), "stratum string, quota int")
    assert sorted(r.id for r in it.spaced_quota(df, q, 6.0, "w9").collect()) == one_by_one(points, 6.0, quotas)
    if quotas == {"a": 12, "b": 9}:
        assert sum(seen) < 150


def test_room_sun_keeps_steps_as_bits(spark):
    dealt = "".join(line for line in plan_of(QUERIES["room_sun"](spark, SF)).splitlines() if "Aggregate" in line or "Exchange hash" in line)
    assert "word#" in dealt and not re.search(r"\bt#", dealt)


def test_nearest_gap_looks_near_in_dense_clouds(spark, monkeypatch):
    import random

    from plotcheck.operators import spatial as s

    rng = random.Random(7)
    a, b = ([(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(400)] + [(400, 30.0, 0.0), (401, 80.0, 80.0)] for _ in range(2))
    reaches, old = [], s.box_join
    monkeypatch.setattr(s, "box_join", lambda x, y, size, reach: reaches.append(reach) or old(x, y, size, reach))
    got = {r.id: r.distance for r in s.nearest_gap(*(spark.createDataFrame(p, "id long, x double, y double") for p in (a, b[:401])), "id", 40.0).collect()}
    want = {i: min(math.hypot(x - u, y - v) for _, u, v in b[:401]) for i, x, y in a}
    assert got == {i: pytest.approx(d) for i, d in want.items() if d <= 40}
    assert reaches[0] < 0.5 and reaches[-1] == 40.0


def test_repeats_are_cut_where_texts_meet_their_spans(spark):
    from plotcheck.llm import suffix_dedup

    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(1, "über " + passage, 9), (2, passage + " tail", 9), (2, passage + " tail", 9), (3, None, None), (None, "short", 5)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    plan = plan_of(got).split("== Initial Plan ==")[-1]
    # Cut texts are not dealt again.
    assert "kept" not in "".join(line for line in plan.splitlines() if "Aggregate" in line or "Exchange" in line)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "über ", 5), (2, "", 0), (2, "", 0), (3, None, None), (None, "short", 5)], key=str)
