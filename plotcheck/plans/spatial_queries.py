"""Queries of the spatial operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.operators import spatial as s
from plotcheck.plans.registry import query
from plotcheck.sources import tiles


def rounded(df, *columns: str, digits: int = 6):  # noqa: ANN001, ANN201
    """Doubles to ``digits`` places; sums in another order differ beyond."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def role(view, *roles: int):  # noqa: ANN001, ANN201
    return view("footprint").filter(F.col("role").isin(*roles))


def centres(df):  # noqa: ANN001, ANN201
    return df.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})


def numbered(points):  # noqa: ANN001, ANN201
    """Laser points with an id; rows that repeat all of a point are numbered."""
    w = W.partitionBy("x", "y", "cls", "height").orderBy("x")
    exact = [F.col(c).cast("decimal(12,1)") for c in ("x", "y", "height")]
    return points.select("x", "y", "cls", "height").withColumn("pt", F.concat_ws("_", exact[0], exact[1], "cls", exact[2], F.row_number().over(w)))


#: The same id in SQL.
_POINT = "concat_ws('_', CAST(CAST(x AS DECIMAL(12,1)) AS VARCHAR), CAST(CAST(y AS DECIMAL(12,1)) AS VARCHAR), CAST(cls AS VARCHAR), CAST(CAST(height AS DECIMAL(12,1)) AS VARCHAR))"
PT = f"concat({_POINT}, '_', CAST(row_number() OVER (PARTITION BY x, y, cls, height) AS VARCHAR))"
CENTRE = "(x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y"
LEN = "sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))"


@query("ring_edges", "SELECT parcel_id, seg, ax, ay, bx, by_ FROM parcel_edge")
def _(view):
    return s.ring_edges(view("parcel_vertex"))


@query("polygon_measures", f"""
SELECT parcel_id, round(sum(ax * by_ - bx * ay) / 2, 6) AS area, round(sum({LEN}), 6) AS perimeter,
  round(sum((ax * by_ - bx * ay) * (ax + bx)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cx, round(sum((ax * by_ - bx * ay) * (ay + by_)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cy,
  round(4 * pi() * abs(sum(ax * by_ - bx * ay) / 2) / (sum({LEN}) * sum({LEN})), 6) AS circularity
FROM parcel_edge GROUP BY parcel_id""")
def _(view):
    return rounded(s.polygon_measures(view("parcel_edge")), "area", "perimeter", "cx", "cy", "circularity")


@query("dominant_angle", f"""
WITH l AS (SELECT *, round({LEN}, 6) AS len, degrees(atan2(by_ - ay, bx - ax)) AS a FROM parcel_edge),
r AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY len DESC, seg) AS rn FROM l)
SELECT parcel_id, round(a - 90 * ceil((a - 45) / 90), 6) + 0.0e0 AS angle FROM r WHERE rn = 1""")
def _(view):
    return rounded(s.dominant_angle(view("parcel_edge")), "angle")


_PROJECTED = f"""p AS (SELECT f.parcel_id, obj_id, seg, (x2 - x1) * abs(bx - ax) / {LEN} + (y2 - y1) * abs(by_ - ay) / {LEN} AS length
  FROM footprint f JOIN parcel_edge e ON e.parcel_id = f.parcel_id WHERE role = 1)"""


@query("projected_length", f"WITH {_PROJECTED} SELECT parcel_id, obj_id, seg, round(length, 6) AS length FROM p")
def _(view):
    return rounded(s.projected_length(s.box_corners(role(view, 1), "parcel_id", "obj_id"), view("parcel_edge")), "length")


_BOX = "(SELECT parcel_id, obj_id, role, klasse, x1 AS aax, y1 AS aay, x2 AS abx, y1 AS aby FROM footprint UNION ALL SELECT parcel_id, obj_id, role, klasse, x2, y1, x2, y2 FROM footprint UNION ALL SELECT parcel_id, obj_id, role, klasse, x2, y2, x1, y2 FROM footprint UNION ALL SELECT parcel_id, obj_id, role, klasse, x1, y2, x1, y1 FROM footprint)"
_SEGDIST = g.segment_distance(("aax", "aay", "abx", "aby"), ("ax", "ay", "bx", "by_"))
_DISTANCE = f"d AS (SELECT o.parcel_id, obj_id, seg, min({_SEGDIST}) AS distance FROM {_BOX} o JOIN parcel_edge e ON e.parcel_id = o.parcel_id WHERE role = ROLE GROUP BY o.parcel_id, obj_id, seg)"


@query("polygon_distance", f"WITH {_DISTANCE.replace('ROLE', '1')} SELECT parcel_id, obj_id, seg, round(distance, 6) AS distance FROM d")
def _(view):
    outline = s.as_outline(s.box_edges(role(view, 1), "parcel_id", "obj_id"), "parcel_id", "obj_id")
    return rounded(s.polygon_distance(outline, view("parcel_edge"), "parcel_id", ("parcel_id", "obj_id", "seg")), "distance")


@query("side_occupancy", f"""
WITH {_PROJECTED}, {_DISTANCE.replace('ROLE', '1')},
s AS (SELECT p.parcel_id, p.seg, sum(length) AS side FROM p JOIN d ON p.obj_id = d.obj_id AND p.seg = d.seg WHERE distance < 3 GROUP BY p.parcel_id, p.seg)
SELECT parcel_id, round(max(side), 6) AS longest_side, round(sum(side), 6) AS total,
  CASE WHEN max(side) <= 9 + 1e-9 AND sum(side) <= 15 + 1e-9 THEN 'ok' ELSE 'bad' END AS status FROM s GROUP BY parcel_id""")
def _(view):
    return rounded(s.side_occupancy(role(view, 1), view("parcel_edge")), "longest_side", "total")


@query("side_contact", f"""
WITH {_DISTANCE.replace('ROLE', '2')}, t AS (SELECT obj_id, seg FROM d WHERE distance <= 1 + 1e-9)
SELECT f.obj_id, coalesce(t.seg, -1) AS side FROM footprint f LEFT JOIN t ON t.obj_id = f.obj_id WHERE role = 2""")
def _(view):
    return s.side_contact(role(view, 2), view("parcel_edge"))


@query("is_simple", f"""
WITH c AS (SELECT a.parcel_id, bool_or({g.segments_cross(('a.ax', 'a.ay', 'a.bx', 'a.by_'), ('b.ax', 'b.ay', 'b.bx', 'b.by_'))}) AS bad
  FROM parcel_edge a JOIN parcel_edge b ON a.parcel_id = b.parcel_id AND b.seg = a.seg + 2 GROUP BY a.parcel_id)
SELECT parcel_id, NOT bad AS simple FROM c""")
def _(view):
    return s.is_simple(view("parcel_edge"))


@query("min_rotated_rect", "SELECT obj_id, greatest(x2 - x1, y2 - y1) AS length, least(x2 - x1, y2 - y1) AS width, round((x2 - x1) * (y2 - y1), 6) AS area FROM footprint WHERE role = 2 AND (x2 - x1) * (y2 - y1) > 0")
def _(view):
    corners = s.box_corners(role(view, 2), "obj_id")
    return rounded(s.min_rotated_rect(corners, "obj_id"), "length", "width", "area")


@query("overlap_area", f"""
SELECT a.obj_id AS a_id, b.obj_id AS b_id, round({g.box_overlap('a.', 'b.')}, 6) AS area
FROM footprint a JOIN footprint b ON a.parcel_id = b.parcel_id AND a.role = 1 AND b.role <> 1 WHERE {g.box_overlap('a.', 'b.')} > 0""")
def _(view):
    a, b = role(view, 1), view("footprint").filter("role <> 1")
    pairs = a.select("parcel_id", F.col("obj_id").alias("a_id")).join(b.select("parcel_id", F.col("obj_id").alias("b_id")), "parcel_id").select("a_id", "b_id")
    edges = lambda d, k: s.box_edges(d.select(F.col("obj_id").alias(k), "x1", "y1", "x2", "y2"), k)
    return rounded(s.overlap_area(edges(a, "a_id"), edges(b, "b_id"), pairs), "area")


@query("points_in_polygons", f"""
WITH p AS (SELECT {PT} AS pt, x, y FROM laser_point),
n AS (SELECT pt, q.parcel_id, sum(CASE WHEN {g.ray_crossing('x', 'y', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) AS n
  FROM p JOIN parcel q ON x BETWEEN x0 AND x0 + w + skew AND y BETWEEN y0 AND y0 + h JOIN parcel_edge e ON e.parcel_id = q.parcel_id GROUP BY pt, q.parcel_id)
SELECT pt, parcel_id FROM n WHERE n % 2 = 1""")
def _(view):
    return s.points_in_polygons(numbered(view("laser_point")), view("parcel_edge"))


@query("cells_in_polygons", f"""
WITH c AS (SELECT parcel_id, col, unnest(generate_series(CAST(floor(y0 / 2) AS BIGINT), CAST(floor((y0 + h) / 2) AS BIGINT))) AS row_
  FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / 2) AS BIGINT), CAST(floor((x0 + w + skew) / 2) AS BIGINT))) AS col FROM parcel)),
n AS (SELECT c.parcel_id, col, row_, sum(CASE WHEN {g.ray_crossing('(col + 0.5) * 2', '(row_ + 0.5) * 2', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) AS n
  FROM c JOIN parcel_edge e ON e.parcel_id = c.parcel_id GROUP BY c.parcel_id, col, row_)
SELECT parcel_id, col, row_ FROM n WHERE n % 2 = 1""")
def _(view):
    return s.cells_in_polygons(view("parcel_edge"), res=2.0)


_PAIR = "a AS (SELECT obj_id, {c} FROM footprint WHERE role = {i}), b AS (SELECT obj_id, {c} FROM footprint WHERE role = {j})"
_AB = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _pair(i: int, j: int) -> str:
    return _PAIR.format(c=CENTRE, i=i, j=j)


@query("within_distance", f"WITH {_pair(0, 2)} SELECT a.obj_id AS a_id, b.obj_id AS b_id, round({_AB}, 6) AS distance FROM a JOIN b ON abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30 WHERE {_AB} <= 30")
def _(view):
    out = s.within_distance(centres(role(view, 0)), centres(role(view, 2)), 30.0)
    return rounded(out.select(F.col("l_obj_id").alias("a_id"), F.col("r_obj_id").alias("b_id"), "distance"), "distance")


@query("exclude_near", f"WITH {_pair(3, 5)} SELECT obj_id, x, y FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_AB} <= 15)")
def _(view):
    return s.exclude_near(centres(role(view, 3)).select("obj_id", "x", "y"), centres(role(view, 5)), 15.0, "obj_id")


@query("hit_within", f"""
WITH {_pair(5, 3)}, h AS (SELECT obj_id, max(CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_AB} <= 10) THEN 1 ELSE 0 END) AS hit FROM a GROUP BY obj_id)
SELECT count(*) AS points, CAST(sum(hit) AS BIGINT) AS hits, round(CAST(sum(hit) AS DOUBLE) / count(*), 9) AS recall FROM h""")
def _(view):
    return rounded(s.hit_within(centres(role(view, 5)).select("obj_id", "x", "y"), centres(role(view, 3)), 10.0, "obj_id"), "recall", digits=9)


@query("nearest", f"""
WITH {_pair(0, 8)}, m AS (SELECT a.obj_id, b.obj_id AS road_id, {_AB} AS d FROM a JOIN b ON abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 WHERE {_AB} <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d, road_id) AS rn FROM m)
SELECT a.obj_id, r.road_id, round(r.d, 6) AS distance FROM a LEFT JOIN r ON r.obj_id = a.obj_id AND rn = 1""")
def _(view):
    out = s.nearest(centres(role(view, 0)), centres(role(view, 8)).withColumnRenamed("obj_id", "road_id"), "obj_id", "road_id", 60.0)
    return rounded(out, "distance")


@query("collisions", f"""
SELECT a.obj_id, b.obj_id AS obstacle_id, round({g.box_overlap('a.', 'b.')}, 6) AS area, CASE WHEN b.klasse IN ('hecke', 'baum') THEN 'hint' ELSE 'collision' END AS kind
FROM footprint a JOIN footprint b ON a.role = 1 AND b.role IN (0, 2) AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 WHERE {g.box_overlap('a.', 'b.')} > 0.05""")
def _(view):
    return rounded(s.collisions(role(view, 1), role(view, 0, 2)), "area")


_SIGHT = f"""pairs AS (SELECT a.obj_id * 1000000 + b.obj_id AS pair, NULL AS target, a.x AS sx, a.y AS sy, b.x AS tx, b.y AS ty FROM (SELECT obj_id, parcel_id, {CENTRE} FROM footprint WHERE role = 1) a
  JOIN (SELECT obj_id, parcel_id, {CENTRE} FROM footprint WHERE role = 4) b ON a.parcel_id = b.parcel_id)"""


def sight_sql(pairs: str) -> str:
    """(pair, s): the screening that buildings give the lines of the table ``pairs``, where it is not 0."""
    within = lambda p: f"({p}x > x1 AND {p}x < x2 AND {p}y > y1 AND {p}y < y2)"
    return f"""se AS (SELECT o.* FROM {_BOX} o JOIN footprint f ON f.obj_id = o.obj_id WHERE o.role = 0 AND (f.eaves IS NULL OR f.eaves >= 2)),
sm AS (SELECT pair, se.obj_id, bool_or({g.segments_cross(('sx', 'sy', 'tx', 'ty'), ('aax', 'aay', 'abx', 'aby'))}) AS crossed, bool_or({g.point_segment_distance('sx', 'sy', 'aax', 'aay', 'abx', 'aby')} < 3) AS leans
  FROM {pairs} JOIN se ON least(aax, abx) <= greatest(sx, tx) + 20 AND greatest(aax, abx) >= least(sx, tx) - 20 AND least(aay, aby) <= greatest(sy, ty) + 20 AND greatest(aay, aby) >= least(sy, ty) - 20 GROUP BY pair, se.obj_id),
sv AS (SELECT sm.pair, max(CASE WHEN crossed OR {within('s')} OR {within('t')} THEN CASE WHEN leans THEN 15 ELSE 5 END ELSE 0 END) AS s FROM sm JOIN {pairs} q ON q.pair = sm.pair JOIN footprint f ON f.obj_id = sm.obj_id
  WHERE coalesce(target, -1) <> sm.obj_id AND x1 <= greatest(sx, tx) AND x2 >= least(sx, tx) AND y1 <= greatest(sy, ty) AND y2 >= least(sy, ty) GROUP BY sm.pair)"""


@query("line_of_sight", f"WITH {_SIGHT}, {sight_sql('pairs')} SELECT pairs.pair, coalesce(s, 0) AS screening FROM pairs LEFT JOIN sv ON sv.pair = pairs.pair")
def _(view):
    a, b = centres(role(view, 1)), centres(role(view, 4))
    pairs = a.select("parcel_id", F.col("obj_id").alias("i"), F.col("x").alias("sx"), F.col("y").alias("sy")).join(b.select("parcel_id", F.col("obj_id").alias("j"), F.col("x").alias("tx"), F.col("y").alias("ty")), "parcel_id")
    return s.line_of_sight(pairs.select((F.col("i") * 1000000 + F.col("j")).alias("pair"), "sx", "sy", "tx", "ty"), role(view, 0))


@query("owner_dedupe", "SELECT obj_id, CAST(floor((x1 + x2) / 2 / 250) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2 / 250) AS BIGINT) AS cy FROM footprint WHERE role IN (3, 4)")
def _(view):
    return s.owner_dedupe(role(view, 3, 4)).select("obj_id", "cx", "cy")


@query("nearest_window", "SELECT event_id, CAST(floor((e - 698000 - 48) / 48 + 0.5) AS BIGINT) AS wx, CAST(floor((n - 5486000 - 48) / 48 + 0.5) AS BIGINT) AS wy FROM contribution")
def _(view):
    pts = view("contribution").select("event_id", (F.col("e") - 698000).alias("x"), (F.col("n") - 5486000).alias("y"))
    return s.nearest_window(pts).select("event_id", "wx", "wy")


@query("windows_for_extent", """
WITH a AS (SELECT parcel_id, y0, h, unnest(generate_series(CAST(floor((x0 - 20 - 48) / 48 + 0.5) AS BIGINT), CAST(floor((x0 + w + skew + 20 - 48) / 48 + 0.5) AS BIGINT))) AS wx FROM parcel)
SELECT parcel_id, wx, unnest(generate_series(CAST(floor((y0 - 20 - 48) / 48 + 0.5) AS BIGINT), CAST(floor((y0 + h + 20 - 48) / 48 + 0.5) AS BIGINT))) AS wy FROM a""")
def _(view):
    ext = view("parcel").selectExpr("parcel_id", "x0 AS x1", "y0 AS y1", "x0 + w + skew AS x2", "y0 + h AS y2")
    return s.windows_for_extent(ext, 20.0).select("parcel_id", "wx", "wy")


@query("attach_area_attributes", """
WITH p AS (SELECT parcel_id, x0 AS x, y0 AS y FROM parcel UNION ALL SELECT parcel_id, x0 + w, y0 FROM parcel UNION ALL SELECT parcel_id, x0 + w + skew, y0 + h FROM parcel
  UNION ALL SELECT parcel_id, x0, y0 + h FROM parcel UNION ALL SELECT parcel_id, x0 + (w + skew / 2) / 2, y0 + h / 2 FROM parcel)
SELECT DISTINCT p.parcel_id, klasse FROM p JOIN footprint f ON role IN (8, 9) AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""")
def _(view):
    return s.area_attributes(view("parcel"), role(view, 8, 9))


@query("sample_raster", f"""
WITH c AS (SELECT parcel_id, x0 + w / 2 AS x, y0 + h / 2 AS y FROM parcel), p AS (SELECT {PT} AS pt, x, y FROM laser_point)
SELECT c.parcel_id, pt, coalesce(z, 400.0e0) AS z FROM c JOIN p ON sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) <= 12
LEFT JOIN terrain_cell t ON t.col = CAST(floor(p.x / 40) AS BIGINT) AND t.row_ = CAST(floor(p.y / 40) AS BIGINT)""")
def _(view):
    centre = view("parcel").selectExpr("parcel_id", "x0 + w / 2 AS x", "y0 + h / 2 AS y")
    return s.sample_raster(numbered(view("laser_point")).select("pt", "x", "y"), centre, view("terrain_cell"), 12.0, 40.0, 400.0).select(F.col("l_parcel_id").alias("parcel_id"), F.col("r_pt").alias("pt"), "z")


_T = g.segment_point("x", "y", "ax", "ay", "bx", "by_")


@query("snap_points", f"""
WITH p AS (SELECT obj_id AS pt, parcel_id, x1 AS x, y1 AS y FROM footprint WHERE role = 6),
m AS (SELECT pt, x, y, seg, ax, ay, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS dc, {g.point_segment_distance('x', 'y', 'ax', 'ay', 'bx', 'by_')} AS de, ax + {_T} * (bx - ax) AS ex, ay + {_T} * (by_ - ay) AS ey
  FROM p JOIN parcel_edge e ON e.parcel_id = p.parcel_id),
c AS (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY dc, seg) AS rc, row_number() OVER (PARTITION BY pt ORDER BY de, seg) AS re FROM m),
j AS (SELECT c.pt, c.x, c.y, c.dc, c.ax, c.ay, e.de, e.ex, e.ey FROM c JOIN c e ON c.pt = e.pt AND c.rc = 1 AND e.re = 1)
SELECT pt, round(CASE WHEN dc <= 4 THEN ax WHEN de <= 2.4 THEN ex ELSE x END, 6) AS sx, round(CASE WHEN dc <= 4 THEN ay WHEN de <= 2.4 THEN ey ELSE y END, 6) AS sy FROM j""")
def _(view):
    pts = role(view, 6).select(F.col("obj_id").alias("pt"), "parcel_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return rounded(s.snap_points(pts, view("parcel_edge"), 4.0), "sx", "sy")


_TILE = "CAST(least(greatest(floor((x1 + x2) / 2 / 250), 0), 7) AS BIGINT) AS tx, CAST(least(greatest(floor((y1 + y2) / 2 / 250), 0), 7) AS BIGINT) AS ty"


@query("tile_extents", f"""
WITH t AS (SELECT *, {_TILE} FROM footprint)
SELECT tx, ty, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(0 AS BIGINT) AS level FROM t GROUP BY tx, ty
UNION ALL SELECT NULL, NULL, count(*), min(x1), min(y1), max(x2), max(y2), 3 FROM t""")
def _(view):
    return s.tile_extents(view("footprint"))


@query("tile_qc", """
SELECT CAST(floor(x / 1000) AS BIGINT) AS kx, CAST(floor(y / 1000) AS BIGINT) AS ky, count(*) AS n, count(*) / 1000000.0e0 AS density, min(x) AS x1, max(x) AS x2, true AS inside
FROM laser_point GROUP BY 1, 2""")
def _(view):
    return s.tile_qc(view("laser_point"))


_NEAR = "(SELECT pt, min(d) AS d FROM (SELECT u.pt, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) AS d FROM {u} u JOIN {v} v ON v.cx BETWEEN u.cx - 1 AND u.cx + 1 AND v.cy = u.cy UNION ALL SELECT u.pt, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) FROM {u} u JOIN {v} v ON v.cx BETWEEN u.cx - 1 AND u.cx + 1 AND v.cy = u.cy - 1 UNION ALL SELECT u.pt, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) FROM {u} u JOIN {v} v ON v.cx BETWEEN u.cx - 1 AND u.cx + 1 AND v.cy = u.cy + 1) WHERE d <= 40 GROUP BY pt)"


@query("cloud_distance", f"""
WITH k AS (SELECT {PT} AS pt, x, y, cls, floor(x / 40) AS cx, floor(y / 40) AS cy FROM laser_point), a AS (SELECT * FROM k WHERE cls = 6), b AS (SELECT * FROM k WHERE cls = 20),
p AS {_NEAR.format(u='a', v='b')}, q AS {_NEAR.format(u='b', v='a')}
SELECT 'accuracy' AS direction, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90 FROM p
UNION ALL SELECT 'completeness', count(*), round(quantile_cont(d, 0.5), 6), round(quantile_cont(d, 0.9), 6) FROM q""")
def _(view):
    pts = numbered(view("laser_point"))
    return rounded(s.cloud_distance(pts.filter("cls = 6"), pts.filter("cls = 20")), "median", "p90")


@query("group_sides", """
WITH a AS (SELECT parcel_id, seg, degrees(atan2(by_ - ay, bx - ax)) AS angle FROM parcel_edge),
t AS (SELECT a.parcel_id, a.seg, abs((a.angle - b.angle + 540) - 360 * floor((a.angle - b.angle + 540) / 360) - 180) AS turn FROM a JOIN a b ON a.parcel_id = b.parcel_id AND b.seg = (a.seg + 3) % 4),
r AS (SELECT *, sum(CASE WHEN turn >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY parcel_id ORDER BY seg) AS run, sum(CASE WHEN turn >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY parcel_id) AS runs FROM t)
SELECT parcel_id, seg, CAST(CASE WHEN runs = 0 THEN 0 WHEN run = 0 THEN runs - 1 ELSE run - 1 END AS INTEGER) AS side FROM r""")
def _(view):
    return s.group_sides(view("parcel_edge"))


@query("side_names", """
WITH n AS (SELECT parcel_id, seg AS side, by_ - ay AS nx, ax - bx AS ny FROM parcel_edge),
b AS (SELECT *, CASE WHEN abs(ny) >= abs(nx) THEN CASE WHEN ny > 0 THEN 'Nord' ELSE 'Süd' END ELSE CASE WHEN nx > 0 THEN 'Ost' ELSE 'West' END END AS base FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, base ORDER BY side) AS nth FROM b)
SELECT parcel_id, side, CASE WHEN nth > 1 THEN concat(base, ' ', CAST(nth AS VARCHAR)) ELSE base END AS name FROM r""")
def _(view):
    e = view("parcel_edge")
    return s.side_names(e, s.group_sides(e))


@query("tile_scan", "SELECT obj_id, x1, y1 FROM footprint WHERE floor(x1 / 100) * 100 < 700 AND (floor(x1 / 100) + 1) * 100 > 250 AND floor(y1 / 100) * 100 < 600 AND (floor(y1 / 100) + 1) * 100 > 100")
def _(view):
    f = view("footprint").select("obj_id", "x1", "y1")
    folder = tiles.tile_folder(f.sparkSession, "footprint")
    tiles.write_tiles(f, folder, 100.0, "x1", "y1")
    return tiles.read_tiles(f.sparkSession, folder, (250.0, 100.0, 700.0, 600.0), 100.0).select("obj_id", "x1", "y1")


@query("grid_blocks", """
WITH x AS (SELECT col, row_, z, unnest(list_distinct([col // 25, greatest((col - 1) // 25, 0)])) AS bx FROM terrain_cell WHERE col > 0),
x0 AS (SELECT * FROM x UNION ALL SELECT col, row_, z, 0 FROM terrain_cell WHERE col = 0)
SELECT col, row_, z, bx, by_ FROM (SELECT *, unnest(list_distinct([row_ // 25, CASE WHEN row_ = 0 THEN 0 ELSE greatest((row_ - 1) // 25, 0) END])) AS by_ FROM x0)""")
def _(view):
    return s.grid_blocks(view("terrain_cell"), 25).select("col", "row_", "z", "bx", "by_")


@query("to_local", "SELECT event_id, round(e - 699000, 2) AS x, round(n - 5487000, 2) AS y FROM contribution")
def _(view):
    return s.to_local(view("contribution").select("event_id", F.col("e").alias("x"), F.col("n").alias("y")), (699000.0, 5487000.0))


@query("counter_clockwise", "SELECT parcel_id, seq, x, y FROM parcel_vertex")
def _(view):
    turned = view("parcel_vertex").withColumn("seq", F.when(F.col("parcel_id") % 2 == 0, 3 - F.col("seq")).otherwise(F.col("seq")))
    # Half of the rings run clockwise before; turned back, the vertices are those of the view.
    return s.counter_clockwise(turned)


@query("project_utm", "SELECT event_id, e, n FROM contribution")
def _(view):
    from plotcheck.functions.utm import from_utm, to_utm

    # There and back: the coordinates again, to a millimetre.
    geo = from_utm(view("contribution").select("event_id", "e", "n")).drop("e", "n")
    return rounded(to_utm(geo).select("event_id", "e", "n"), "e", "n", digits=3)
