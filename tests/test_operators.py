"""Limits, greedy rounds, geometry and streams."""

import random

import pytest
from pyspark.sql import functions as F

from plotcheck.functions.utm import from_utm, to_utm
from plotcheck.operators import iterative as it
from plotcheck.operators import logs, raster, spatial
from plotcheck.operators.evaluation import rectangle_decision, release_gate
from plotcheck.operators.graph import connected_components
from plotcheck.operators.rules import building, devices
from plotcheck.operators.rules import zones as zones_
from plotcheck.sources import files
from plotcheck.streaming import jobs


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expr.alias("v")).first().v


@pytest.mark.parametrize(("mean", "ok"), [(3.0, True), (3.05, False), (None, None)])
def test_boundary_height(spark, mean, ok):
    df = spark.createDataFrame([("eave", mean, 0.0, 30.0)], "kind string, mean double, rise double, pitch double")
    assert building.boundary_wall_height(df).first().privileged is ok


@pytest.mark.parametrize(
    ("kind", "pitch", "h", "open_"),
    [("eave", 45.0, 3.0, False), ("eave", 50.0, 4.0, False), ("eave", 71.0, 6.0, False), ("gable", 45.0, 3.0, False), ("gable", 50.0, 4.5, True), ("gable", 71.0, 6.0, True)],
)
def test_roof_counts_above_45(spark, kind, pitch, h, open_):
    df = spark.createDataFrame([(kind, 3.0, 3.0, pitch)], "kind string, mean double, rise double, pitch double")
    got = building.boundary_wall_height(df).first()
    assert got.height == pytest.approx(h) and got.open is open_


@pytest.mark.parametrize(("eaves", "pitch", "depth"), [(7.5, 30.0, 3.0), (7.6, 30.0, 3.04), (3.0, 71.0, 3.0)])
def test_setback_depth(spark, eaves, pitch, depth):
    df = spark.createDataFrame([(eaves, eaves, pitch)], "eaves double, ridge double, pitch double")
    assert building.setback(df).first().depth == pytest.approx(depth)


@pytest.mark.parametrize(("length", "status"), [(9.0, "ok"), (9.01, "bad")])
def test_side_limit(spark, length, status):
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 40.0, 0.0), (1, 2, 40.0, 40.0), (1, 3, 0.0, 40.0)], "parcel_id long, seq int, x double, y double")
    obj = spark.createDataFrame([(1, 7, 10.0, 1.0, 10.0 + length, 2.0)], "parcel_id long, obj_id long, x1 double, y1 double, x2 double, y2 double")
    assert spatial.side_occupancy(obj, spatial.ring_edges(ring)).first().status == status


@pytest.mark.parametrize(("gap", "side"), [(1.0, 0), (1.01, -1)])
def test_side_contact(spark, gap, side):
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 40.0, 0.0), (1, 2, 40.0, 40.0), (1, 3, 0.0, 40.0)], "parcel_id long, seq int, x double, y double")
    obj = spark.createDataFrame([(1, 7, 10.0, gap, 12.0, 5.0)], "parcel_id long, obj_id long, x1 double, y1 double, x2 double, y2 double")
    assert [r.side for r in spatial.side_contact(obj, spatial.ring_edges(ring)).collect()] == [side]


@pytest.mark.parametrize(
    ("height", "y", "side", "status", "most"),
    [
        (2.0, 0.61, (False, None, False), "ok", 2.0),
        (2.0, 0.6, (False, None, False), "ok", 2.0),
        (2.0, 0.59, (False, None, False), "warn", 2.0),
        (2.0, 0.5, (False, None, False), "warn", 2.0),
        (2.0, 0.49, (False, None, False), "bad", 0.0),
        (2.01, 2.0, (False, None, False), "warn", None),
        (2.01, 1.99, (False, None, False), "bad", 2.0),
        (5.0, 0.7, (False, None, True), "ok", None),
        (1.8, 0.1, (False, 1.8, False), "ok", 1.8),
        (1.9, 0.1, (False, 1.8, False), "bad", 1.8),
        (9.0, 0.1, (True, None, False), "ok", None),
        (1.0, -0.5, (False, None, False), "bad", 0.0),
    ],
)
def test_plants(spark, height, y, side, status, most):
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)]
    edges = spark.createDataFrame([(1, i, *ring[i], *ring[(i + 1) % 4]) for i in range(4)], "parcel_id long, side int, ax double, ay double, bx double, by_ double")
    sides = spark.createDataFrame([(1, 0, *side)], "parcel_id long, side int, road boolean, fence double, forest boolean")
    plants = spark.createDataFrame([(1, 3, 20.0, y, height)], "parcel_id long, obj_id long, x double, y double, height double")
    got = devices.plant_verdict(plants, edges, sides).first()
    assert got.status == status
    if side[1] is None or height <= side[1]:
        assert got.max_height == most


@pytest.mark.parametrize(
    ("road", "shift"),
    [((0.0, -6.0, 40.0, 0.0), 3.0), ((0.0, -6.5, 40.0, -0.5), 3.5), ((0.0, -6.0, 40.0, -0.7), 0.0), ((0.0, -90.0, 40.0, 0.0), 30.0), ((0.0, -6.0, 12.0, 0.0), 0.0), ((0.0, -6.0, 22.0, 0.0), 3.0)],
)
def test_road_offset(spark, road, shift):
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 40.0, 0.0)], "parcel_id long, seg int, ax double, ay double, bx double, by_ double")
    roads = spark.createDataFrame([(1, *road)], "obj_id long, x1 double, y1 double, x2 double, y2 double")
    assert building.road_offset(edges, roads).first()["shift"] == pytest.approx(shift)


@pytest.mark.parametrize(("source", "db"), [((0.0, 5.0), 5), ((7.5, 5.0), 15), ((10.5, 5.0), 15), ((0.0, 20.0), 0)])
def test_line_of_sight(spark, source, db):
    pairs = spark.createDataFrame([(1, 8, *source, 40.0, source[1])], "pair long, target long, sx double, sy double, tx double, ty double")
    houses = spark.createDataFrame([(7, 10.0, 2.0, 14.0, 8.0, None), (8, 20.0, 2.0, 24.0, 8.0, 9.0), (9, 30.0, 2.0, 34.0, 8.0, 1.9)], "obj_id long, x1 double, y1 double, x2 double, y2 double, eaves double")
    assert spatial.line_of_sight(pairs, houses).first().screening == db


def test_upslope_area_of_a_long_path(spark):
    """700 cells in a row: more than any fixed number of rounds, and a side arm."""
    rows = [(i, 0, i + 1 if i < 699 else None, 0 if i < 699 else None) for i in range(700)] + [(5, 1, 5, 0)]
    area = {(r.col, r.row_): r.area for r in it.upslope_area(spark.createDataFrame(rows, "col long, row_ long, to_col long, to_row long")).collect()}
    assert area == {(i, 0): i + 1 + (i >= 5) for i in range(700)} | {(5, 1): 1}


@pytest.mark.parametrize(("ratio", "building_", "shape"), [(0.55, False, "outline"), (0.60, True, "rectangle"), (0.60, False, "outline"), (0.65, False, "rectangle"), (0.54, True, "outline")])
def test_rectangle(spark, ratio, building_, shape):
    assert one(spark, rectangle_decision(F.col("r"), F.col("b")), r=ratio, b=building_) == shape


def test_gate_counts_missing_class_as_zero(spark):
    old = spark.createDataFrame([("pool", 0.2)], "klasse string, f1 double")
    new = spark.createDataFrame([("baum", 0.5)], "klasse string, f1 double")
    assert {(r.klasse, r.reason, r.released) for r in release_gate(old, new).collect()} == {("pool", "loses", False), ("baum", "holds", False)}


def test_greedy_choice_equals_order(spark):
    rng = random.Random(4)
    for n, m in ((30, 60), (60, 400)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
        got = {r.id for r in it.first_come(nodes, spark.createDataFrame(list(pairs), "hi long, lo long")).collect()}
        want: set[int] = set()
        for i in range(n):
            if not any((j, i) in pairs for j in want):
                want.add(i)
        assert got == want


def test_greedy_match_equals_order(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(15), rng.randrange(15)): rng.randrange(1, 5) / 5 for _ in range(90)}
    got = {(r.det, r.ref) for r in it.greedy_match(spark.createDataFrame([(d, r, v) for (d, r), v in pairs.items()], "det long, ref long, iou double")).collect()}
    used_d, used_r, want = set(), set(), set()
    for _, d, r in sorted(((v, d, r) for (d, r), v in pairs.items()), reverse=True):
        if d not in used_d and r not in used_r:
            used_d.add(d)
            used_r.add(r)
            want.add((d, r))
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 150)] + [(7, None), (300, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {j: 100 for j in range(100, 150)} | {300: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def clip(subject, a, b):
    out = []
    for (x1, y1), (x2, y2) in zip(subject, subject[1:] + subject[:1], strict=True):
        side = lambda x, y: (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
        s1, s2 = side(x1, y1), side(x2, y2)
        if s1 >= 0:
            out.append((x1, y1))
        if s1 * s2 < 0:
            t = s1 / (s1 - s2)
            out.append((x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
    return out


def test_convex_overlap(spark):
    rng = random.Random(6)
    ring_a, ring_b, want = [], [], {}
    for k in range(25):
        x, y, w, h, s = (rng.uniform(0, 5), rng.uniform(0, 5), rng.uniform(2, 8), rng.uniform(2, 8), rng.uniform(0, 3))
        a = [(x, y), (x + w, y), (x + w + s, y + h), (x + s / 2, y + h)]
        b = [(2.0, 2.0), (7.0, 2.5), (8.0, 6.0), (3.0, 7.0)]
        ring_a += [(k, i, *p) for i, p in enumerate(a)]
        ring_b += [(k, i, *p) for i, p in enumerate(b)]
        poly = a
        for i in range(4):
            poly = clip(poly, b[i], b[(i + 1) % 4]) if poly else []
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) / 2 if poly else 0
        if area > 1e-6:
            want[k] = pytest.approx(area, abs=1e-5)
    edges = lambda rows, key: spatial.ring_edges(spark.createDataFrame(rows, f"{key} long, seq int, x double, y double"), key)
    got = spatial.overlap_area(edges(ring_a, "a_id"), edges(ring_b, "b_id"), spark.createDataFrame([(k, k) for k in range(25)], "a_id long, b_id long"))
    assert {r.a_id: r.area for r in got.collect() if r.area > 1e-6} == want


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(7)
    pts = spark.createDataFrame([(i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(300)], "id long, x double, y double")
    runs = [{r.id for r in it.spaced_select(pts.repartition(n), 15.0, "s").collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_utm_known_point_and_back(spark):
    df = spark.createDataFrame([(9.0, 0.0), (11.75, 49.5), (10.0, 48.0)], "lon double, lat double")
    rows = to_utm(df).collect()
    assert (rows[0].e, rows[0].n) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert (rows[2].e, rows[2].n) == (pytest.approx(574600, abs=500), pytest.approx(5316785, abs=2000))
    for r in from_utm(to_utm(df).withColumnsRenamed({"lon": "lo", "lat": "la"})).collect():
        assert (r.lon, r.lat) == (pytest.approx(r.lo, abs=1e-9), pytest.approx(r.la, abs=1e-9))


def test_sun(spark):
    df = spark.sql("SELECT timestamp'2024-06-20 11:13:00' AS t UNION ALL SELECT timestamp'2024-12-21 11:11:00'")
    alt = sorted(r.alt for r in devices.sun_position(df).collect())
    # At solar noon: 90 - latitude -+ obliquity.
    assert alt == [pytest.approx(90 - 49.5 - 23.44, abs=0.2), pytest.approx(90 - 49.5 + 23.44, abs=0.2)]


def test_bilinear_reproduces_a_plane(spark):
    cells = spark.createDataFrame([(c, r, 2.0 * c + 3.0 * r) for c in range(6) for r in range(6)], "col long, row_ long, z double")
    pts = spark.createDataFrame([("a", 23.0, 31.0), ("b", 0.0, 0.0), ("c", 59.9, 59.9)], "pt string, x double, y double")
    got = {r.pt: r.z for r in raster.bilinear(pts, cells, 10.0, 6, 6).collect()}
    assert got == {"a": pytest.approx(2 * 1.8 + 3 * 2.6), "b": pytest.approx(0.0), "c": pytest.approx(25.0)}


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    got = {(r.col, r.row_): (r.x, r.y, r.z) for r in files.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert got[0, 0] == (102.5, 207.5, 1.0) and got[2, 1] == (112.5, 202.5, 6.0) and got[1, 1][2] is None and len(got) == 6
    (tmp_path / "h.asc").write_text("ncols 1\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 5\nNODATA_value -9999\n7\n")
    assert files.read_ascii_grid(spark, str(tmp_path / "*.asc")).count() == 7


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id;wert\n1;"1,5"\n2;x\n', encoding="utf-8")
    assert [(r.id, r.wert) for r in files.read_csv_semicolon(spark, str(tmp_path / "a.csv"), ("wert",)).orderBy("id").collect()] == [("1", 1.5), ("2", None)]


def test_missing_columns(spark):
    assert files.missing_columns(spark.range(1), ["id", "b", "a"]) == ["a", "b"]


def test_rate_limit_equals_replay(spark, tmp_path):
    """Windows start with a client's request, over several batches; ties of time go by event_id."""
    rng = random.Random(3)
    at, events = 1_704_067_200, []
    for i in range(400):
        at += rng.choice([0, 1, 5, 20, 60])
        events.append((i, rng.randrange(5), at))
    seen, want = {}, {}
    for i, client, t in events:
        start, n = seen.get(client, (None, 0))
        start, n = (start, n + 1) if start is not None and t - start <= 60 else (t, 1)
        seen[client] = (start, n)
        want[i] = (client, start, n, n > 2)
    rows = lambda d: {r.event_id: (r.client, r.s, r.nth, r.refused) for r in d.selectExpr("event_id", "client", "unix_seconds(start) AS s", "nth", "refused").collect()}
    df = spark.createDataFrame(events, "event_id long, client long, s long").selectExpr("event_id", "client", "timestamp_seconds(s) AS ts")
    assert rows(logs.limit_requests(df, 60, 2)) == want
    windows = {}
    for client, start, _, refused in want.values():
        n, k = windows.get((client, start), (0, 0))
        windows[client, start] = (n + 1, k + refused)
    assert {(r.client, int(r.start.timestamp())): (r.n, r.refused) for r in logs.rate_limit(df, 60, 2).collect()} == windows
    for k in range(3):  # one batch each
        df.filter(f"event_id >= {150 * k} AND event_id < {150 * k + 150}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = jobs.log_stream(spark, str(tmp_path / "in"), "event_id long, client long, ts timestamp")
        query = jobs.limit_requests(stream, 60, 2, idle=3600).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    assert rows(spark.read.schema("client long, event_id long, start timestamp, nth long, refused boolean").json(str(tmp_path / "out"))) == want


def test_exact_quantiles(spark, monkeypatch):
    """Ranks are bracketed in several passes; many equal values, nulls, an empty column."""
    from plotcheck.operators import quantiles

    rng = random.Random(7)
    values = [(rng.choice([None, 1.0, rng.gauss(0, 5), rng.expovariate(1) ** 9, -7.5]), i % 4) for i in range(20_000)]
    df = spark.createDataFrame(values, "x double, k int").withColumn("none", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = df.selectExpr("percentile(x, array(0.0D, 0.1D, 0.5D, 0.77D, 1.0D)) AS p", "percentile(k, 0.37D) AS k").first()
    monkeypatch.setattr(quantiles, "LAST", 20)
    got = quantiles.exact_quantiles(df, {**{str(p): ("x", p) for p in shares}, "k": ("k", 0.37), "none": ("none", 0.5)})
    assert [got[str(p)] for p in shares] == pytest.approx(list(want.p), rel=1e-12)
    assert got["k"] == want.k and got["none"] is None


def test_box_join_of_all_sizes(spark, monkeypatch):
    """Boxes from points to 5 km, and a crowded cell dealt in parts: the pairs of all against all."""
    rng = random.Random(6)

    def boxes(n, crowd):
        out = []
        for i in range(n):
            x, y = (rng.uniform(0, 40), rng.uniform(0, 40)) if i < crowd else (rng.uniform(-3000, 3000), rng.uniform(-3000, 3000))
            w, h = rng.choice([(0.0, 0.0), (5.0, 3.0), (49.0, 10.0), (51.0, 200.0), (900.0, 5.0), (5000.0, 5000.0) if i % 7 == 0 else (1.0, 1.0)])
            out.append((i, x, y, x + w, y + h))
        return [*out, (n, None, 1.0, 2.0, 3.0)]

    a, b = boxes(150, 60), boxes(200, 80)
    schema = "id long, x1 double, y1 double, x2 double, y2 double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    for reach in (0.0, 20.0):
        want = sorted((p[0], q[0]) for p in a[:-1] for q in b[:-1] if p[1] - reach <= q[3] and q[1] <= p[3] + reach and p[2] - reach <= q[4] and q[2] <= p[4] + reach)
        for crowd in (spatial.CROWD, 10):
            monkeypatch.setattr(spatial, "CROWD", crowd)
            assert sorted((r.l_id, r.r_id) for r in spatial.box_join(left, right, reach=reach, spread=True).select("l_id", "r_id").collect()) == want


def test_spaced_quota_goes_in_order(spark):
    rng = random.Random(4)
    points = [(i, "abcd"[i % 4], rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(80)] + [(900, "a", None, 1.0)]
    quotas = {"a": 3, "b": 6, "c": 1000}
    df = spark.createDataFrame(points, "id long, stratum string, x double, y double")
    q = spark.createDataFrame(list(quotas.items()), "stratum string, quota int")
    order = [(r.key, r.id) for r in df.withColumn("key", it.salted("w9", "id")).collect()]
    at = {p[0]: p for p in points}
    chosen, n = [], dict.fromkeys("abcd", 0)
    for _, i in sorted(order):
        _, s_, x, y = at[i]
        if x is not None and n[s_] < quotas.get(s_, 0) and all((x - at[j][2]) ** 2 + (y - at[j][3]) ** 2 >= 16 for j in chosen):
            chosen.append(i)
            n[s_] += 1
    assert sorted(r.id for r in it.spaced_quota(df, q, 4.0, "w9").collect()) == sorted(chosen)
    assert n["a"] == 3 and n["b"] == 6 and 6 < n["c"] <= 20
    assert it.spaced_quota(df.limit(0), q, 4.0, "w9").count() == 0


def test_tiles_are_pruned(spark, tmp_path, capsys):
    from plotcheck.sources import tiles

    rng = random.Random(2)
    points = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(2000)] + [(9999, None, 1.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    path = str(tmp_path / "tiles")
    tiles.write_tiles(df, path, 100.0)
    box = (250.0, 100.0, 701.0, 300.0)
    got = tiles.read_tiles(spark, path, box, 100.0)
    assert {r.id for r in got.collect()} == {i for i, x, y in points if x is not None and 200 <= x < 800 and 100 <= y < 300}
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(kx" in plan and "(kx" in plan.split("PartitionFilters")[1]
    assert {f.split("/kx=")[1].split("/")[0] for (f,) in got.select(F.input_file_name()).distinct().collect()} == {str(k) for k in range(2, 8)}
    windows = [(1, 120.0, 120.0, 180.0, 260.0), (2, 150.0, 150.0, 150.0, 150.0)]
    w = spark.createDataFrame(windows, "win long, x1 double, y1 double, x2 double, y2 double")
    near = tiles.near_windows(spark.read.parquet(path), w, 100.0)
    assert {(r.id, r.w_win) for r in near.collect()} == {(i, 1) for i, x, y in points if x is not None and 120 <= x < 180 and 120 <= y < 260}


def test_large_boxes_take_few_cells_and_crowds_are_dealt(spark):
    wide = spark.createDataFrame([(1, 0.0, 0.0, 5000.0, 5000.0)], "id long, l_x1 double, l_y1 double, l_x2 double, l_y2 double")
    levels = spark.createDataFrame([(k,) for k in range(12)], "level int")
    assert spatial._in_cells(spatial._dealt(wide, "l_", 50.0, 0.0), levels, "l_", 50.0, 0.0).count() <= 4 * 12
    crowd = spark.range(100_000).selectExpr("id", "CAST(id % 45 AS DOUBLE) AS x1", "1D AS y1", "CAST(id % 45 AS DOUBLE) AS x2", "2D AS y2")
    few = spark.range(3).selectExpr("id", "0D AS x1", "0D AS y1", "0D AS x2", "5D AS y2")
    met = spatial.box_join(few, crowd, spread=True)
    assert met.count() == 3 * sum(1 for i in range(100_000) if i % 45 == 0)
    # What one task joins at once stays small on both sides.
    for side in spatial._meeting(few, crowd, 50.0, 0.0):
        assert max(r["count"] for r in side.groupBy(*spatial.MEETING).count().collect()) < 2 * spatial.CROWD


def test_streams_equal_their_twins(spark, tmp_path):
    rows = [(i, i % 3, ["neu", "kaputt"][i % 2], 1_704_067_200 + 40 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, client long, action string, s long").selectExpr("event_id", "client", "client AS link", "action", "timestamp_seconds(s) AS ts", "IF(event_id % 2 = 0, 'passt', 'frage') AS antwort")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = jobs.log_stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "))
    jobs.to_table(jobs.answers_by_link(stream), "by_link", str(tmp_path / "c1"), "complete").awaitTermination()
    assert sorted(map(tuple, logs.sum_days(spark.table("by_link")).collect())) == sorted(map(tuple, logs.answers_by_link(df).collect()))
    for kind in ("tumbling", "sliding", "session"):
        jobs.to_table(jobs.activity(stream, kind), f"active_{kind}", str(tmp_path / f"c3{kind}"), "complete").awaitTermination()
        twin = logs.activity_windows(df).filter(F.col("kind") == kind)
        assert sorted(map(tuple, spark.table(f"active_{kind}").collect())) == sorted(map(tuple, twin.collect()))
    asked = jobs.log_stream(spark, str(tmp_path / "in"), "client long, event_id long, ts timestamp").selectExpr("client", "event_id % 4 AS wx", "0L AS wy", "ts")
    ready = spark.createDataFrame([(1, 0)], "wx long, wy long")
    jobs.to_table(jobs.prepare_windows(asked, ready), "windows", str(tmp_path / "c5")).awaitTermination()
    twin = logs.prepare_windows(df.selectExpr("client", "event_id % 4 AS wx", "0L AS wy"), ready)
    got = spark.table("windows").select("client", "wx", "wy").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, twin.select("client", "wx", "wy").collect()))
    kept = jobs.retention(jobs.log_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "2024-01-01 00:10:00", 0)
    jobs.to_table(kept, "kept", str(tmp_path / "c6")).awaitTermination()
    assert {r.event_id for r in spark.table("kept").collect()} == {i for i in range(60) if 40 * i >= 600}
    doubled = jobs.log_stream(spark, str(tmp_path / "in"), "client long, ts timestamp").selectExpr("CAST(client AS STRING) AS id", "ts")
    jobs.to_table(jobs.dedupe_contributions(doubled), "once", str(tmp_path / "c4")).awaitTermination()
    assert sorted(r.id for r in spark.table("once").collect()) == ["0", "1", "2"]


def test_ingest_and_erase(spark, tmp_path):
    good = '{"id":"a","aktion":"neu","klasse":"pool","kachel":"698_5486","geometrie":[[698001.04,5486001],[698004,5486001],[698004,5486005]]}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join([good, good.replace('"a"', '"b"').replace("neu", "weg"), good.replace('"a"', '"c"').replace("698_", "699_")]))
    p = {k: str(tmp_path / k) for k in ("in", "ok", "bad", "c1", "erase", "new", "c2")}
    jobs.ingest_contributions(spark, p["in"], p["ok"], p["bad"], p["c1"]).awaitTermination()
    assert [(r.id, r.geometrie[0]) for r in spark.read.json(p["ok"]).collect()] == [("a", [698001.0, 5486001.0])]
    assert {(r.id, r.reason) for r in spark.read.json(p["bad"]).collect()} == {("b", "action"), ("c", "other_tile")}
    (tmp_path / "erase").mkdir()
    (tmp_path / "erase" / "e.json").write_text('{"id":"a"}')
    jobs.erase_requests(jobs.log_stream(spark, p["erase"], "id string"), spark, p["ok"], files.LOG, p["new"], p["c2"]).awaitTermination()
    assert spark.read.schema(files.LOG).json(p["new"] + "/kept/0").count() == 0
    # Erased ids stay erased in later batches, and what arrived meanwhile is there.
    (tmp_path / "in" / "y.json").write_text("\n".join(good.replace('"a"', f'"{k}"') for k in "de"))
    jobs.ingest_contributions(spark, p["in"], p["ok"], p["bad"], p["c1"]).awaitTermination()
    (tmp_path / "erase" / "f.json").write_text('{"id":"d"}')
    jobs.erase_requests(jobs.log_stream(spark, p["erase"], "id string"), spark, p["ok"], files.LOG, p["new"], p["c2"]).awaitTermination()
    assert [r.id for r in spark.read.schema(files.LOG).json(p["new"] + "/kept/1").collect()] == ["e"]


def test_answers_and_revocations(spark, tmp_path):
    rows = [(i, i % 3, 1_704_067_200 + 3600 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, link long, s long").selectExpr("event_id", "link", "CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts", "date'2024-01-01' AS bis")
    df.write.json(str(tmp_path / "in"))
    twice = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (1, "2024-01-01 09:00:00")], "link long, at string").selectExpr("link", "CAST(at AS TIMESTAMP_NTZ) AS revoked_at")
    batch = {r.event_id: r.status for r in logs.accept_answers(df, twice).collect()}
    assert len(batch) == 12 and batch == {i: "revoked" if i % 3 == 1 and i > 5 else "accepted" for i in range(12)}
    stream = jobs.log_stream(spark, str(tmp_path / "in"), "event_id long, link long, ts timestamp, bis date")
    jobs.to_table(jobs.accept_answers(stream, twice), "answered", str(tmp_path / "c1")).awaitTermination()
    assert {r.event_id: r.status for r in spark.table("answered").collect()} == batch
    (tmp_path / "rev").mkdir()
    for n, link in enumerate((1, 2)):
        (tmp_path / "rev" / f"{n}.json").write_text(f'{{"link":{link}}}')
        jobs.revoke_and_purge(jobs.log_stream(spark, str(tmp_path / "rev"), "link long"), spark, str(tmp_path / "in"), "event_id long, link long", str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert {r.link for r in spark.read.json(str(tmp_path / "out" / "kept" / "0")).collect()} == {0, 2}
    assert {r.link for r in spark.read.json(str(tmp_path / "out" / "kept" / "1")).collect()} == {0}


RING = [(0.0, 0.0), (30.0, 0.0), (33.0, 25.0), (0.0, 25.0)]


def parcel(spark):
    ring = spark.createDataFrame([(1, i, *p) for i, p in enumerate(RING)], "parcel_id long, seq int, x double, y double")
    flat = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 25.0, 3.0)], "parcel_id long, x0 double, y0 double, w double, h double, skew double")
    return flat, spatial.ring_edges(ring)


def inside(x, y, gap=0.0):
    return all(((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 >= gap - 1e-9 for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1], strict=True))


def poly_area(poly):
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True))) / 2 if poly else 0.0


def shared(subject, convex):
    for k in range(len(convex)):
        subject = clip(subject, convex[k], convex[(k + 1) % len(convex)]) if subject else []
    return poly_area(subject)


def test_setback_check_equals_clipping(spark):
    """On a slope: trapezoids against the parcel and against two houses, one without known eaves."""
    _, edges = parcel(spark)
    rng = random.Random(8)
    boxes = []
    for i in range(20):
        x, y = rng.uniform(0, 27), rng.uniform(0, 22)
        boxes.append((i, 1, x, y, x + rng.uniform(1, 3), y + rng.uniform(1, 3), rng.uniform(2, 12), 0.0, rng.uniform(20, 85)))
    boxes = [(*b[:7], b[6] + rng.choice([0, 2.0]), b[8]) for b in boxes]
    objects = spark.createDataFrame(boxes, "obj_id long, parcel_id long, x1 double, y1 double, x2 double, y2 double, eaves double, ridge double, pitch double")
    ground = {(c, r): 0.25 * c + 0.1 * r for c in range(-20, 60) for r in range(-20, 60) if c < 28}
    terrain = spark.createDataFrame([(c, r, z) for (c, r), z in ground.items()], "col long, row_ long, z double")
    houses = [(7, 1, 12.0, 10.0, 18.0, 15.0, 6.0, 9.0), (8, 1, 3.0, 18.0, 6.0, 20.0, None, None)]
    own = spark.createDataFrame(houses, "obj_id long, parcel_id long, x1 double, y1 double, x2 double, y2 double, eaves double, ridge double")
    with_cells = lambda d: building.setback_check(d, edges, terrain, own)
    old = building.walls
    building.walls = lambda p, t: old(p, t, 1.0)
    try:
        got = {r.obj_id: r for r in with_cells(objects).collect()}
    finally:
        building.walls = old
    z = lambda x, y: ground.get((int(x // 1), int(y // 1)))
    ring = lambda x1, y1, x2, y2: [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]

    def before(a, b, ta, tb):
        n = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5
        nx, ny = (b[1] - a[1]) / n, (a[0] - b[0]) / n
        return [a, (a[0] + nx * ta, a[1] + ny * ta), (b[0] + nx * tb, b[1] + ny * tb), b]

    areas = {}
    for i, _, x1, y1, x2, y2, eaves, ridge in houses:
        c = ring(x1, y1, x2, y2)
        t = max(3, 0.4 * (eaves + (ridge - eaves) / 3)) if eaves else None
        areas[i] = (c, [before(c[k], c[(k + 1) % 4], t, t) for k in range(4)] if t else [])
    assert len(got) == len(boxes)
    for i, _, x1, y1, x2, y2, eaves, ridge, pitch in boxes:
        c = ring(x1, y1, x2, y2)
        samples = [z(p[0] + (q[0] - p[0]) * k / 8, p[1] + (q[1] - p[1]) * k / 8) for p, q in zip(c, c[1:] + c[:1], strict=True) for k in range(9)]
        level = [z(*p) for p in c] if None not in samples else [0.0] * 4
        top = eaves + max(level)
        plus = 0 if ridge <= eaves else (ridge - eaves) * (1 if pitch > 70 else 1 / 3)
        depth = [max(3, 0.4 * (top - v + plus)) for v in level]
        mine = [before(c[k], c[(k + 1) % 4], depth[k], depth[(k + 1) % 4]) for k in range(4)]
        assert got[i].outside == pytest.approx(max(poly_area(m) - shared(m, RING) for m in mine), abs=1e-6)
        overlap = max(shared(a, m) for _, of in areas.values() for j, a in enumerate(of) for k, m in enumerate(mine) if (j + k) % 2 == 0)
        assert got[i].overlap == pytest.approx(overlap, abs=1e-6)
        in_house = any(shared(c, a) > 0.05 for _, of in areas.values() for a in of)
        house_in = any(shared(h, m) > 0.05 or any(poly_area(m) - sum(poly_area([p, m[k], m[(k + 1) % 4]]) for k in range(4)) > -1e-9 for p in h) for h, _ in areas.values() for m in mine)
        assert (got[i].in_house, got[i].house_in) == (in_house, house_in)
        assert got[i].status == ("bad" if got[i].outside > 0.05 or overlap > 0.05 or in_house or house_in else "ok")


def test_ring_clipping(spark):
    """Rings that are not convex against convex ones: area by counting fine cells; inside; points."""
    from plotcheck.functions import rings

    rng = random.Random(5)
    notched = [(0, 0), (10, 0), (10, 8), (6, 8), (6, 3), (4, 3), (4, 8), (0, 8)]
    rows = []
    for i in range(30):
        x, y, w, h = rng.uniform(-2, 9), rng.uniform(-2, 7), rng.uniform(0.5, 6), rng.uniform(0.5, 6)
        rows.append((i, [{"x": float(a), "y": float(b)} for a, b in notched], [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]))
    df = spark.createDataFrame(rows, "i int, s array<struct<x:double,y:double>>, c array<struct<x:double,y:double>>")
    e = rings.edges_of(F.col("c"))
    got = df.select("i", rings.clip_area(F.col("s"), e).alias("area"), rings.inside(F.col("c"), e, F.col("s")).alias("inside"), rings.contains(rings.edges_of(F.col("s")), F.col("c")[0]).alias("held")).collect()
    for (i, _, c), r in zip(rows, sorted(got, key=lambda r: r.i), strict=True):
        box = [(p["x"], p["y"]) for p in c]
        x, y, w, h = box[0][0], box[0][1], box[1][0] - box[0][0], box[2][1] - box[0][1]
        over = lambda a, b, lo, hi: max(0.0, min(b, hi) - max(a, lo))
        want = over(x, x + w, 0, 10) * over(y, y + h, 0, 3) + (over(x, x + w, 0, 4) + over(x, x + w, 6, 10)) * over(y, y + h, 3, 8)
        assert r.area == pytest.approx(want, abs=1e-9), i
        assert r.inside == (want >= w * h - 0.005)
        assert r.held == (0 < x < 10 and 0 < y < 8 and not (4 < x < 6 and y > 3))


def clipped_area(poly, box):
    """Area of a convex polygon within an upright box, by cutting it side by side."""
    for axis, sign, limit in ((0, 1, box[0]), (1, 1, box[1]), (0, -1, box[2]), (1, -1, box[3])):
        kept = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                kept.append(p)
            if a * b < 0:
                kept.append(tuple(u + (v - u) * a / (a - b) for u, v in zip(p, q, strict=True)))
        poly = kept
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True))) / 2


def test_placement_zones_equal_single_checks(spark):
    import math

    flat, edges = parcel(spark)
    edges = edges.withColumn("used", F.when(F.col("seg") == 0, 5.5).when(F.col("seg") == 1, 0.0))
    obstacle = (10.0, 10.0, 14.0, 13.0)
    obstacles = spark.createDataFrame([(1, 5, *obstacle)], "parcel_id long, obj_id long, x1 double, y1 double, x2 double, y2 double")
    w, d = 4.0, 3.0
    products = spark.createDataFrame([("haus", w, d)], "product string, w double, d double")
    zones = zones_.placement_zones(flat, edges, obstacles, products, 2.0, 1.0).cache()
    got = {(r.x, r.y): (r.colour, r.angle and round(math.degrees(r.angle), 6)) for r in zones.collect()}
    sides = list(zip(RING, RING[1:] + RING[:1], strict=True))
    angles = zones_.orientations(edges).first().angles
    wanted = [0.0]
    for (ax, ay), (bx, by) in sides:
        wanted += [math.degrees(math.atan2(by - ay, bx - ax)) % 180] * (math.hypot(bx - ax, by - ay) >= 2)
    kept = []
    for a in [*wanted, 0, 45, 90, 135]:
        kept += [a] * all(min(abs(a - k), 180 - abs(a - k)) >= 3 for k in kept)
    assert [math.degrees(a) for a in angles] == pytest.approx(kept)

    def stands(x, y, angle):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        corners = [(x + i * w / 2 * c - j * d / 2 * s, y + i * w / 2 * s + j * d / 2 * c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        if not all(inside(*p) for p in corners) or clipped_area(corners, obstacle) > 1e-7:
            return False
        used, total, over, met = [5.5, 0, 0, 0], 5.5, False, False
        for k, ((ax, ay), (bx, by)) in enumerate(sides):
            n = math.hypot(bx - ax, by - ay)
            if min(((bx - ax) * (q - ay) - (by - ay) * (p - ax)) / n for p, q in corners) < 3 - 1e-6:
                along = [((p - ax) * (bx - ax) + (q - ay) * (by - ay)) / n for p, q in corners]
                total, met = total + max(along) - min(along), True
                over |= used[k] + max(along) - min(along) > 9 + 1e-9
        return not over and not (met and total > 15 + 1e-9)

    def colour(x, y, tried):
        if not inside(x, y):
            return "grey", None
        for a in [0, *tried]:
            if stands(x, y, kept[a]):
                return ("yellow" if a else "green"), round(kept[a], 6)
        return "red", None

    coarse = {(i, j): colour(2 * i + 1, 2 * j + 1, range(len(kept))) for i in range(-1, 18) for j in range(-1, 14) if min(p[0] for p in RING) < 2 * i + 2 and 2 * i <= max(p[0] for p in RING) and min(p[1] for p in RING) < 2 * j + 2 and 2 * j <= max(p[1] for p in RING)}
    expected = {}
    for (i, j), own in coarse.items():
        around = [coarse[i + a, j + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (i + a, j + b) in coarse]
        if len({c for c, _ in around}) == 1:
            expected[2 * i + 1, 2 * j + 1] = own
            continue
        fit = sorted({kept.index(next(k for k in kept if round(k, 6) == a)) for _, a in around if a is not None})
        for x, y in ((2 * i + a, 2 * j + b) for a in (0.5, 1.5) for b in (0.5, 1.5)):
            expected[x, y] = colour(x, y, fit or range(len(kept)))
    assert {c for c, _ in expected.values()} == {"green", "yellow", "red", "grey"}
    assert got == expected
    fit = zones_.product_fit(zones, flat).collect()
    best = min((0 if c == "green" else 1, round((x**2 + y**2) ** 0.5, 6), x, y) for (x, y), (c, _) in got.items() if c in ("green", "yellow"))
    assert [(r.x, r.y, r.parcels) for r in fit] == [(best[2], best[3], 1)]


def test_sun_hours_equal_rays(spark):
    import math

    days = spark.sql("SELECT date'2024-03-21' AS day UNION ALL SELECT date'2024-12-21'")
    pts = [(1, 0.0, 0.0, 1.5, "garten", 7), (2, 20.0, 3.0, 1.5, "fenster", 7)]
    bodies = [(1, -5.0, -12.0, 6.0, -8.0, 7.0), (2, 25.0, -3.0, 30.0, 4.0, 5.0)]
    p = spark.createDataFrame(pts, "pt long, x double, y double, z double, kind string, room long")
    b = spark.createDataFrame(bodies, "obj_id long, x1 double, y1 double, x2 double, y2 double, height double")
    got = {(r.pt, str(r.day)): r.hours for r in devices.sun_hours(p, b, days, 60.0).collect()}
    sun = [r for r in devices.sun_position(devices.day_times(days, "day")).collect() if r.alt >= 5]
    free = {}
    for pt, x, y, z, *_ in pts:
        for s in sun:
            blocked = False
            for k in range(1, 1200):  # walk along the ray
                d = 0.05 * k
                px, py, pz = x + d * math.sin(math.radians(s.az)), y + d * math.cos(math.radians(s.az)), z + d * math.tan(math.radians(s.alt))
                blocked |= any(x1 <= px <= x2 and y1 <= py <= y2 and pz < h for _, x1, y1, x2, y2, h in bodies)
            free[pt, str(s.day)] = free.get((pt, str(s.day)), 0) + (not blocked) / 6
    assert got == {k: pytest.approx(free.get(k, 0), abs=0.34) for k in got}
    assert got[1, "2024-12-21"] < 3 < got[1, "2024-03-21"]
    room = {str(r.day): r.hours for r in devices.room_sun(p, b, days).collect()}
    assert all(room[d] >= max(got[1, d], got[2, d]) for d in room)
    project = spark.createDataFrame([(9, -30.0, -20.0, 30.0, -15.0, 30.0)], b.schema)
    lost = devices.extra_shading(p, b, project, days).collect()
    assert all(r.most >= 0 and r.affected >= 0 for r in lost) and any(r.affected for r in lost)


def test_suppression_equals_order(spark):
    rng = random.Random(9)
    det = []
    for i in range(60):
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        det.append((i, round(rng.random(), 1), x, y, x + rng.uniform(1, 5), y + rng.uniform(1, 5)))
    df = spark.createDataFrame(det, "id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.id for r in it.suppress_overlaps(df).collect()}
    kept = []
    for d in sorted(det, key=lambda d: (-d[1], d[0])):
        area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
        over = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        if not any(over(d, k) > 0.5 * min(area(d), area(k)) for k in kept):
            kept.append(d)
    assert got == {d[0] for d in kept}


def test_spacing_holds_and_is_full(spark):
    rng = random.Random(10)
    pts = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(150)]
    got = {r.id for r in it.spaced_select(spark.createDataFrame(pts, "id long, x double, y double"), 8.0, "s").collect()}
    far = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 >= 64
    chosen = [p for p in pts if p[0] in got]
    assert all(far(a, b) for a in chosen for b in chosen if a != b)
    assert all(p in chosen or not all(far(p, c) for c in chosen) for p in pts)
