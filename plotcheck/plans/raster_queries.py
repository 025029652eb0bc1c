"""Queries of the raster and point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotcheck.operators import raster as r
from plotcheck.operators import spatial as s
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import PT, numbered, role, rounded

_NDVI = "(nir - red) / greatest(nir + red, 1.0e0)"
#: Laser points on the terrain's 40 m cells.
_RASTER = """SELECT CAST(floor(x / 40) AS BIGINT) AS col, CAST(floor(y / 40) AS BIGINT) AS row_, max(CASE WHEN cls <> 2 THEN height END) AS top, bool_or(cls = 2) AS ground,
  count(*) AS n, CAST(sum(CASE WHEN n_returns = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS single FROM laser_point GROUP BY 1, 2"""
_CELLS = f"""surf AS ({_RASTER}), cells AS (SELECT t.col, t.row_, t.z, t.nutzart, {_NDVI} AS ndvi, s.single,
  CASE WHEN s.n IS NULL THEN NULL WHEN s.top IS NULL THEN 0.0e0 ELSE s.top END AS ndsm FROM terrain_cell t LEFT JOIN surf s ON s.col = t.col AND s.row_ = t.row_)"""


def cells_of(view):  # noqa: ANN001, ANN201
    """Terrain cells with vegetation index and height above ground."""
    t = view("terrain_cell").withColumn("ndvi", r.ndvi(F.col("nir"), F.col("red")))
    surface = r.rasterize_points(view("laser_point"), 40.0)
    return t.select("col", "row_", "z", "nutzart", "ndvi").join(r.height_above_ground(surface, t), r.CELL).join(surface.select("col", "row_", "single"), r.CELL, "left")


@query("ndvi", f"SELECT col, row_, round({_NDVI}, 9) AS ndvi FROM terrain_cell")
def _(view):
    return rounded(view("terrain_cell").select("col", "row_", r.ndvi(F.col("nir"), F.col("red")).alias("ndvi")), "ndvi", digits=9)


_BANDS = "SELECT col, row_, nir, red, CAST((col * 37 + row_ * 11) % 256 AS DOUBLE) AS green, CAST((col * 13 + row_ * 41) % 256 AS DOUBLE) AS blue FROM terrain_cell"


@query("band_indices", f"""
WITH b AS ({_BANDS}) SELECT col, row_, round(((green + blue) / 2 - red) / greatest(red + green + blue, 1.0e0), 9) AS turquoise,
  round(nir / greatest(red + green + blue, 1.0e0), 9) AS nir_rel, round((red + green + blue) / 3, 9) AS brightness FROM b""")
def _(view):
    b = view("terrain_cell").withColumns({"green": F.expr("CAST((col * 37 + row_ * 11) % 256 AS DOUBLE)"), "blue": F.expr("CAST((col * 13 + row_ * 41) % 256 AS DOUBLE)")})
    return rounded(r.band_indices(b).select("col", "row_", "turquoise", "nir_rel", "brightness"), "turquoise", "nir_rel", "brightness", digits=9)


@query("rasterize_points", f"WITH s AS ({_RASTER}) SELECT col, row_, top, ground, n, round(single, 9) AS single FROM s")
def _(view):
    return rounded(r.rasterize_points(view("laser_point"), 40.0), "single", digits=9)


@query("height_above_ground", f"WITH {_CELLS} SELECT col, row_, ndsm FROM cells")
def _(view):
    return r.height_above_ground(r.rasterize_points(view("laser_point"), 40.0), view("terrain_cell"))


@query("small_building_mask", f"WITH {_CELLS} SELECT col, row_ FROM cells WHERE ndsm BETWEEN 1.8 AND 4.9 AND ndvi < 0.2 AND nutzart <> 'Straßenverkehr' AND single >= 0.2")
def _(view):
    return r.small_building_mask(cells_of(view), 1.8, 4.9, 0.2, 0.2).select("col", "row_")


_FAMILY = """SELECT col, row_, 'building' AS family FROM cells WHERE ndsm > 1.8 AND ndvi < 0.1 UNION ALL SELECT col, row_, 'vegetation' FROM cells WHERE ndsm > 0.5 AND ndvi >= 0.1
UNION ALL SELECT col, row_, 'water' FROM cells WHERE ndvi < -0.2 AND coalesce(ndsm, 0) < 0.3 UNION ALL SELECT col, row_, 'flat' FROM cells WHERE ndvi < 0.1 AND coalesce(ndsm, 0) < 0.5"""


@query("family_masks", f"WITH {_CELLS} {_FAMILY}")
def _(view):
    return r.family_masks(cells_of(view))


@query("detection_confidence", "SELECT obj_id, round(least(greatest(0.5 * confidence + 0.3 * (eaves / 5 - 0.5) / 0.5 + 0.2 * (1 - (obj_id % 7) / 7.0e0), 0.0e0), 1.0e0), 9) AS confidence FROM footprint WHERE role IN (3, 4)")
def _(view):
    d = role(view, 3, 4).selectExpr("obj_id", "confidence AS laser", "eaves / 5 AS rect", "CAST(obj_id % 7 AS DOUBLE) / 7 AS veg")
    return rounded(d.select("obj_id", r.detection_confidence().alias("confidence")), "confidence", digits=9)


_COVER = f"""CASE nutzart WHEN 'Fließgewässer' THEN 'water' WHEN 'Straßenverkehr' THEN 'sealed' WHEN 'Landwirtschaft' THEN 'open' ELSE CASE WHEN {_NDVI} > 0.1 THEN 'garden' ELSE 'paved' END END"""


def _cover(view):
    return r.land_cover(view("terrain_cell").withColumn("ndvi", r.ndvi(F.col("nir"), F.col("red"))))


@query("land_cover", f"SELECT col, row_, {_COVER} AS cover FROM terrain_cell")
def _(view):
    return _cover(view)


@query("cover_shares", f"WITH c AS (SELECT {_COVER} AS cover FROM terrain_cell) SELECT cover, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM c GROUP BY cover")
def _(view):
    return rounded(r.cover_shares(_cover(view)), "share", digits=9)


@query("quantize", "SELECT col, row_, CAST(least(greatest(floor((z - 431) / 0.25 + 0.5), 0), 80) AS INTEGER) AS q FROM terrain_cell")
def _(view):
    return view("terrain_cell").select("col", "row_", r.quantize(F.col("z"), 431.0, 0.25, 80).alias("q"))


@query("raster_join", "SELECT a.col, a.row_, a.z, b.z AS coarse_z FROM terrain_cell a LEFT JOIN terrain_cell b ON b.col = a.col // 2 AND b.row_ = a.row_ // 2")
def _(view):
    t = view("terrain_cell")
    return r.replicate(t, t.select("col", "row_", "z"), 2)


@query("raster_bilinear", f"""
WITH p AS (SELECT {PT} AS pt, x, y FROM laser_point), u AS (SELECT pt, least(greatest(x / 40 - 0.5, 0.0e0), 49.0e0) AS u, least(greatest(y / 40 - 0.5, 0.0e0), 39.0e0) AS v FROM p),
c AS (SELECT *, CAST(least(floor(u), 48) AS BIGINT) AS c0, CAST(least(floor(v), 38) AS BIGINT) AS r0 FROM u)
SELECT pt, round((1 - (u - c0)) * (1 - (v - r0)) * a.z + (u - c0) * (1 - (v - r0)) * b.z + (1 - (u - c0)) * (v - r0) * c1.z + (u - c0) * (v - r0) * d.z, 9) AS z
FROM c JOIN terrain_cell a ON a.col = c0 AND a.row_ = r0 JOIN terrain_cell b ON b.col = c0 + 1 AND b.row_ = r0 JOIN terrain_cell c1 ON c1.col = c0 AND c1.row_ = r0 + 1 JOIN terrain_cell d ON d.col = c0 + 1 AND d.row_ = r0 + 1""")
def _(view):
    out = r.bilinear(numbered(view("laser_point")).select("pt", "x", "y"), view("terrain_cell"), 40.0, 50, 40)
    return rounded(out.filter("weight > 0.999999").select("pt", "z"), "z", digits=9)


@query("focal", """
SELECT a.col, a.row_, round(sum(b.z), 6) AS total, max(b.z) AS top, count(*) AS cells FROM terrain_cell a JOIN terrain_cell b ON b.col BETWEEN a.col - 1 AND a.col + 1 AND b.row_ BETWEEN a.row_ - 1 AND a.row_ + 1 GROUP BY a.col, a.row_""")
def _(view):
    return rounded(r.focal(view("terrain_cell"), 1, "z"), "total")


@query("block_max", "SELECT col // 4 AS col, row_ // 4 AS row_, max(z) AS z FROM terrain_cell GROUP BY 1, 2")
def _(view):
    return r.block_max(view("terrain_cell"), 4, "z")


_WATER = "m AS (SELECT col, row_ FROM terrain_cell WHERE nutzart = 'Wohnbaufläche')"
_NEAR = "abs(a.col - b.col) <= 1 AND abs(a.row_ - b.row_) <= 1"


def _mask(view):
    return view("terrain_cell").filter("nutzart = 'Wohnbaufläche'").select("col", "row_")


_GRID = "o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))"


@query("dilate", f"WITH {_WATER}, {_GRID} SELECT DISTINCT col + i AS col, row_ + j AS row_ FROM m, o")
def _(view):
    return r.dilate(_mask(view))


_ERODED = f"e AS (SELECT a.col, a.row_ FROM m a JOIN m b ON {_NEAR} GROUP BY a.col, a.row_ HAVING count(*) = 9)"


@query("erode", f"WITH {_WATER}, {_ERODED} SELECT col, row_ FROM e")
def _(view):
    return r.erode(_mask(view))


@query("open", f"WITH {_WATER}, {_ERODED}, {_GRID} SELECT DISTINCT col + i AS col, row_ + j AS row_ FROM e, o")
def _(view):
    return r.opened(_mask(view))


@query("zonal_percentiles", """
SELECT nutzart, round(quantile_cont(z, 0.1), 6) AS p10, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.9), 6) AS p90, round(quantile_cont(z, 0.99), 6) AS p99,
  round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, count(*) AS n FROM terrain_cell GROUP BY nutzart""")
def _(view):
    return rounded(r.zonal_percentiles(view("terrain_cell"), "nutzart", "z"), "p10", "p50", "p90", "p99", "mean", "sd")


@query("ring_stats", f"""
WITH c AS (SELECT DISTINCT obj_id, CAST(floor((x1 + x2) / 80) AS BIGINT) AS col, CAST(floor((y1 + y2) / 80) AS BIGINT) AS row_ FROM footprint WHERE role = 3),
v AS (SELECT col, row_, {_NDVI} AS ndvi FROM terrain_cell)
SELECT obj_id, round(avg(ndvi), 6) AS ndvi, count(*) AS cells FROM c JOIN v ON greatest(abs(c.col - v.col), abs(c.row_ - v.row_)) = 2 GROUP BY obj_id""")
def _(view):
    o = role(view, 3).select("obj_id", F.floor(F.expr("(x1 + x2) / 80")).alias("col"), F.floor(F.expr("(y1 + y2) / 80")).alias("row_"))
    v = view("terrain_cell").select("col", "row_", r.ndvi(F.col("nir"), F.col("red")).alias("ndvi"))
    return rounded(r.ring_stats(o, v, 1, 2), "ndvi")


@query("plane_fit", """
WITH b AS (SELECT (col // 10) * 100 + row_ // 10 AS block, CAST(col AS DOUBLE) AS x, CAST(row_ AS DOUBLE) AS y, z FROM terrain_cell),
p AS (SELECT block, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM b WINDOW w AS (PARTITION BY block)),
s AS (SELECT block, count(*) AS n, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(x * z) AS sxz, sum(y * z) AS syz, sum(z * z) AS szz FROM p GROUP BY block),
d AS (SELECT *, CASE WHEN sxx * syy - sxy * sxy > 1e-6 THEN sxx * syy - sxy * sxy END AS det FROM s),
e AS (SELECT *, (sxz * syy - syz * sxy) / det AS a, (syz * sxx - sxz * sxy) / det AS b FROM d)
SELECT block, n, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(greatest((szz - a * sxz - b * syz) / n, 0.0e0)), 6) AS rms, round(degrees(atan(sqrt(a * a + b * b))), 6) AS slope FROM e""")
def _(view):
    b = view("terrain_cell").selectExpr("(col div 10) * 100 + row_ div 10 AS block", "CAST(col AS DOUBLE) AS x", "CAST(row_ AS DOUBLE) AS y", "z")
    return rounded(r.plane_fit(b, "block"), "a", "b", "rms", "slope")


@query("stat_summary", """
SELECT klasse, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.95), 6) AS p95, round(min(d), 6) AS low, round(max(d), 6) AS high,
  CAST(sum(CASE WHEN abs(d) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS beyond FROM (SELECT klasse, eaves - 3 AS d FROM footprint) GROUP BY klasse""")
def _(view):
    return rounded(r.stat_summary(view("footprint").selectExpr("klasse", "eaves - 3 AS d"), "d", "klasse"), "median", "p5", "p95", "low", "high")


_ASK = "SELECT obj_id AS q, CASE obj_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 100 END AS jahre, CAST(2 + obj_id % 131 AS DOUBLE) AS dauer FROM footprint WHERE role = 0"


@query("bracket_interpolate", f"""
WITH q AS ({_ASK}), m AS (SELECT q, q.jahre, dauer, max(CASE WHEN dauer_min <= dauer THEN dauer_min END) AS a, min(CASE WHEN dauer_min >= dauer THEN dauer_min END) AS b FROM q JOIN rain_table r ON r.jahre = q.jahre GROUP BY q, q.jahre, dauer)
SELECT q, m.jahre, dauer, round(CASE WHEN a = b THEN ra.hn ELSE ra.hn + (ln(dauer) - ln(a)) / (ln(b) - ln(a)) * (rb.hn - ra.hn) END, 6) AS hn
FROM m LEFT JOIN rain_table ra ON ra.jahre = m.jahre AND ra.dauer_min = a LEFT JOIN rain_table rb ON rb.jahre = m.jahre AND rb.dauer_min = b""")
def _(view):
    q = role(view, 0).selectExpr("obj_id AS q", "CASE obj_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 100 END AS jahre", "CAST(2 + obj_id % 131 AS DOUBLE) AS dauer")
    return rounded(r.bracket_interpolate(q, view("rain_table")), "hn")


_PARCEL_CELL = "SELECT parcel_id, CAST(floor((x0 + w / 2) / 40) AS BIGINT) AS col, CAST(floor((y0 + h / 2) / 40) AS BIGINT) AS row_ FROM parcel"


@query("grid_cell_lookup", f"WITH p AS ({_PARCEL_CELL}) SELECT parcel_id, z, CASE WHEN z IS NULL THEN 'nodata' ELSE 'ok' END AS status FROM p LEFT JOIN terrain_cell t ON t.col = p.col AND t.row_ = p.row_")
def _(view):
    pts = view("parcel").selectExpr("parcel_id", "x0 + w / 2 AS x", "y0 + h / 2 AS y")
    return r.grid_cell_lookup(pts, view("terrain_cell"), 40.0).select("parcel_id", "z", "status")


@query("rain_lookup", f"""
WITH p AS ({_PARCEL_CELL}), g AS (SELECT parcel_id, CASE CAST(floor(z * 10) AS BIGINT) % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 100 END AS jahre, 37.0e0 AS dauer FROM p JOIN terrain_cell t ON t.col = p.col AND t.row_ = p.row_)
SELECT parcel_id AS q, g.jahre, dauer, round(a.hn + (ln(37) - ln(35)) / (ln(40) - ln(35)) * (b.hn - a.hn), 6) AS hn FROM g JOIN rain_table a ON a.jahre = g.jahre AND a.dauer_min = 35 JOIN rain_table b ON b.jahre = g.jahre AND b.dauer_min = 40""")
def _(view):
    pts = view("parcel").selectExpr("parcel_id", "x0 + w / 2 AS x", "y0 + h / 2 AS y")
    site = r.grid_cell_lookup(pts, view("terrain_cell"), 40.0).filter("status = 'ok'")
    q = site.selectExpr("parcel_id AS q", "CASE CAST(floor(z * 10) AS BIGINT) % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 30 ELSE 100 END AS jahre", "37.0D AS dauer")
    return rounded(r.bracket_interpolate(q, view("rain_table")), "hn")


_GAP = "greatest(greatest(x1 - x, x - x2), greatest(y1 - y, y - y2))"


@query("reference_height", f"""
WITH p AS (SELECT {PT} AS pt, x, y, cls, height FROM laser_point),
m AS (SELECT obj_id, cls, height, {_GAP} AS gap FROM (SELECT * FROM footprint WHERE role = 0) f JOIN p ON x BETWEEN x1 - 3 AND x2 + 3 AND y BETWEEN y1 - 3 AND y2 + 3),
a AS (SELECT obj_id, CAST(sum(CASE WHEN gap <= 0 AND cls <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS n, quantile_cont(CASE WHEN gap <= 0 AND cls <> 2 THEN height END, 0.99) AS top,
  median(CASE WHEN gap BETWEEN 0.5 AND 3 AND cls = 2 THEN height END) AS ground FROM m GROUP BY obj_id)
SELECT obj_id, n, CASE WHEN n >= 2 THEN round(top - coalesce(ground, 0), 6) END AS height FROM a""")
def _(view):
    return rounded(r.reference_height(numbered(view("laser_point")), role(view, 0), 2), "height")


@query("height_qc", """
WITH e AS (SELECT obj_id, x1 AS ax, y1 AS ay, x2 AS bx, y1 AS by_ FROM footprint WHERE role = 0 UNION ALL SELECT obj_id, x2, y1, x2, y2 FROM footprint WHERE role = 0
  UNION ALL SELECT obj_id, x2, y2, x1, y2 FROM footprint WHERE role = 0 UNION ALL SELECT obj_id, x1, y2, x1, y1 FROM footprint WHERE role = 0),
s AS (SELECT *, CAST(greatest(ceil(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 1) AS BIGINT) AS steps FROM e),
i AS (SELECT *, unnest(generate_series(0, steps - 1)) AS i FROM s),
p AS (SELECT obj_id, CAST(floor((ax + (bx - ax) * i / steps) / 40) AS BIGINT) AS col, CAST(floor((ay + (by_ - ay) * i / steps) / 40) AS BIGINT) AS row_ FROM i),
z AS (SELECT obj_id, min(z) AS zmin, avg(z) AS zavg, count(*) AS n FROM p JOIN terrain_cell t ON t.col = p.col AND t.row_ = p.row_ GROUP BY obj_id)
SELECT z.obj_id, n, round(430 + eaves - zmin, 6) AS above_min, round(430 + eaves - zavg, 6) AS above_mean, round(430 + eaves - zavg, 6) BETWEEN -8 AND 2 AS ok FROM z JOIN footprint f ON f.obj_id = z.obj_id""")
def _(view):
    b = role(view, 0)
    out = r.height_qc(s.box_edges(b, "obj_id"), view("terrain_cell"), b.selectExpr("obj_id", "430 + eaves AS ground"), 40.0, -8.0, 2.0)
    return rounded(out, "above_min", "above_mean").withColumn("ok", F.col("above_mean").between(-8, 2))


@query("built_density", """
WITH b AS (SELECT DISTINCT CAST(floor((x1 + x2) / 20) AS BIGINT) AS col, CAST(floor((y1 + y2) / 20) AS BIGINT) AS row_ FROM footprint WHERE role IN (0, 2)),
h AS (SELECT obj_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 0),
n AS (SELECT obj_id, x, y, CAST(floor(x / 10) AS BIGINT) + i AS col, CAST(floor(y / 10) AS BIGINT) + j AS row_ FROM h, (SELECT unnest(generate_series(-7, 7)) AS i), (SELECT unnest(generate_series(-7, 7)) AS j)),
c AS (SELECT * FROM n WHERE pow((col + 0.5) * 10 - x, 2) + pow((row_ + 0.5) * 10 - y, 2) <= 3600)
SELECT obj_id, round(CAST(count(b.col) AS DOUBLE) / count(*), 9) AS density FROM c LEFT JOIN b ON b.col = c.col AND b.row_ = c.row_ GROUP BY obj_id""")
def _(view):
    cell = lambda c: F.floor(F.expr(f"({c}1 + {c}2) / 20"))
    built = role(view, 0, 2).select(cell("x").alias("col"), cell("y").alias("row_"))
    houses = role(view, 0).selectExpr("obj_id", "(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y")
    return rounded(r.built_density(houses, built, 60.0, 10.0), "density", digits=9)


@query("roof_edge_offset", f"""
WITH p AS (SELECT {PT} AS pt, x, y FROM laser_point WHERE cls = 20),
m AS (SELECT obj_id, y - y1 AS d0, x2 - x AS d1, y2 - y AS d2, x - x1 AS d3 FROM (SELECT * FROM footprint WHERE role IN (0, 2)) f JOIN p ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2),
u AS (SELECT obj_id, 0 AS side, d0 AS d FROM m UNION ALL SELECT obj_id, 1, d1 FROM m UNION ALL SELECT obj_id, 2, d2 FROM m UNION ALL SELECT obj_id, 3, d3 FROM m),
g AS (SELECT obj_id, side, median(d) AS m, count(*) AS n FROM u WHERE d BETWEEN 0 AND 1.5 GROUP BY obj_id, side)
SELECT f.obj_id, s.side, round(CASE WHEN n >= 2 THEN m ELSE 0.3 END, 6) AS "offset" FROM footprint f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS side) s LEFT JOIN g ON g.obj_id = f.obj_id AND g.side = s.side WHERE role IN (0, 2)""")
def _(view):
    return rounded(r.wall_offset(numbered(view("laser_point")).filter("cls = 20"), role(view, 0, 2), 2), "offset")


@query("grid_overview", "SELECT col, row_, z FROM terrain_cell WHERE col % 5 = 0 AND row_ % 5 = 0")
def _(view):
    return view("terrain_cell").filter((F.pmod("col", F.lit(5)) == 0) & (F.pmod("row_", F.lit(5)) == 0)).select("col", "row_", "z")


@query("point_cells", "SELECT CAST(floor(x / 100) AS BIGINT) AS kx, CAST(floor(y / 100) AS BIGINT) AS ky, count(*) AS n FROM laser_point GROUP BY 1, 2")
def _(view):
    from plotcheck.sources.points import with_point_cells

    return with_point_cells(view("laser_point")).groupBy("kx", "ky").agg(F.count("*").alias("n"))


@query("points_in_window", "SELECT pt_id, x, y FROM laser_point WHERE x >= 250 AND x < 720 AND y >= 130 AND y < 590")
def _(view):
    from plotcheck.sources.points import points_in_window, with_point_cells

    return points_in_window(with_point_cells(view("laser_point")), (250.0, 130.0, 720.0, 590.0)).select("pt_id", "x", "y")
