"""Queries of the rule operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.operators import spatial as s
from plotcheck.operators.rules import building as b
from plotcheck.operators.rules import devices as d
from plotcheck.operators.rules import envelope as env
from plotcheck.operators.rules import limits as lim
from plotcheck.operators.rules import zones
from plotcheck.plans.registry import query
from plotcheck.plans.spatial_queries import _BOX, _SEGDIST, role, rounded, sight_sql

PITCH = "CAST(30 + obj_id % 60 AS DOUBLE)"


WALLS = """
WITH o AS (SELECT *, CASE WHEN x2 - x1 >= y2 - y1 THEN 0 ELSE 1 END AS axis FROM footprint WHERE role = 1),
e AS (SELECT obj_id, axis, eaves, ridge, 0 AS seg, x1 AS ax, y1 AS ay, x2 AS bx, y1 AS by_ FROM o UNION ALL SELECT obj_id, axis, eaves, ridge, 1, x2, y1, x2, y2 FROM o UNION ALL SELECT obj_id, axis, eaves, ridge, 2, x2, y2, x1, y2 FROM o UNION ALL SELECT obj_id, axis, eaves, ridge, 3, x1, y2, x1, y1 FROM o),
p AS (SELECT e.*, unnest(generate_series(0, 8)) AS k FROM e), q AS (SELECT *, CAST(floor((ax + (bx - ax) * k / 8) / 40) AS BIGINT) AS col, CAST(floor((ay + (by_ - ay) * k / 8) / 40) AS BIGINT) AS row_ FROM p),
z AS (SELECT obj_id, axis, eaves, ridge, seg, avg(z) AS ground, count(*) AS n, max(CASE WHEN k = 0 THEN z END) AS z0, max(CASE WHEN k = 8 THEN z END) AS z8 FROM q JOIN terrain_cell t ON t.col = q.col AND t.row_ = q.row_ GROUP BY obj_id, axis, eaves, ridge, seg),
f AS (SELECT *, eaves + max(z0) OVER (PARTITION BY obj_id) AS top FROM z)
SELECT obj_id, seg, CASE WHEN ridge <= eaves THEN 'flat' WHEN seg % 2 = axis THEN 'eave' ELSE 'gable' END AS kind, round(top - ground, 6) AS height, round(top - z0, 6) AS "start", round(top - z8, 6) AS "end", n FROM f"""


@query("walls", WALLS)
def _(view):
    return rounded(b.walls(role(view, 1), view("terrain_cell")), "height", "start", "end")


_H = f"eaves + CASE WHEN {PITCH} > 70 THEN ridge - eaves ELSE (ridge - eaves) / 3 END"


@query("setback", f"SELECT obj_id, round({_H}, 6) AS h, round(greatest(3.0e0, 0.4e0 * ({_H})), 6) AS depth FROM footprint WHERE role IN (0, 1)")
def _(view):
    return rounded(b.setback(role(view, 0, 1).withColumn("pitch", F.expr(PITCH))).select("obj_id", "h", "depth"), "h", "depth")


_SLOPE = "CAST(35 + obj_id % 50 AS DOUBLE)"


@query("boundary_wall_height", f"""
WITH w AS (SELECT w.obj_id, seg, kind, height AS mean, ridge - eaves AS rise, CAST(35 + w.obj_id % 50 AS DOUBLE) AS pitch FROM ({WALLS}) w JOIN footprint f ON f.obj_id = w.obj_id),
h AS (SELECT obj_id, seg, rise > 0 AND pitch > 45 AND kind <> 'eave' AS open, mean + CASE WHEN rise <= 0 OR pitch <= 45 THEN 0 WHEN kind = 'eave' THEN rise * CASE WHEN pitch > 70 THEN 1 ELSE 1 / 3e0 END
  ELSE greatest(rise / 2, rise * CASE WHEN pitch > 70 THEN 1 ELSE 1 / 3e0 END) END AS height FROM w)
SELECT obj_id, seg, round(height, 6) AS height, open, round(height, 6) <= 3 + 1e-9 AS privileged FROM h""")
def _(view):
    w = rounded(b.walls(role(view, 1), view("terrain_cell")), "height").withColumnRenamed("height", "mean")
    roof = role(view, 1).select("obj_id", (F.col("ridge") - F.col("eaves")).alias("rise"), F.expr(_SLOPE).alias("pitch"))
    return rounded(b.boundary_wall_height(w.join(roof, "obj_id")).select("obj_id", "seg", "height", "open"), "height").withColumn("privileged", F.col("height") <= lim.BOUNDARY_HEIGHT + 1e-9)


#: Own houses, some of them without known eaves, and the setback depth that their walls take.
_OWN = "SELECT obj_id, parcel_id, x1, y1, x2, y2, CASE WHEN obj_id % 70 <> 0 THEN eaves END AS eaves, ridge FROM footprint WHERE role = 0"
_DEPTH = "greatest(3e0, 0.4e0 * (eaves + greatest(0, ridge - eaves) / 3))"


def _own(view):
    return role(view, 0).withColumn("eaves", F.expr("CASE WHEN obj_id % 70 <> 0 THEN eaves END"))


_SHARE = "CASE WHEN pitch > 70 THEN 1 ELSE 1 / 3e0 END"
_EDGES4 = "SELECT {c}, 0 AS seg, x1 AS ax, y1 AS ay, x2 AS bx, y1 AS by_ FROM {t} UNION ALL SELECT {c}, 1, x2, y1, x2, y2 FROM {t} UNION ALL SELECT {c}, 2, x2, y2, x1, y2 FROM {t} UNION ALL SELECT {c}, 3, x1, y2, x1, y1 FROM {t}"
#: CTEs of the setback areas: wl (walls of planned objects), ar (areas that two polygons share), chk (the check).
#: Polygons pg: T a wall's area, P a parcel, H the area of a house's wall, B a house, F a planned object.
_AREAS = f"""o1 AS (SELECT *, {PITCH} AS pitch, CASE WHEN x2 - x1 >= y2 - y1 THEN 0 ELSE 1 END AS axis, ridge - eaves AS rise FROM footprint WHERE role = 1),
e1 AS ({_EDGES4.format(c='obj_id, parcel_id, eaves, ridge, pitch, axis, rise', t='o1')}),
k1 AS (SELECT e1.*, unnest(generate_series(0, 8)) AS k FROM e1), q1 AS (SELECT *, CAST(floor((ax + (bx - ax) * k / 8) / 40) AS BIGINT) AS col, CAST(floor((ay + (by_ - ay) * k / 8) / 40) AS BIGINT) AS row_ FROM k1),
z1 AS (SELECT obj_id, seg, avg(z) AS ground, count(z) AS n, max(CASE WHEN k = 0 THEN z END) AS z0, max(CASE WHEN k = 8 THEN z END) AS z8 FROM q1 LEFT JOIN terrain_cell t ON t.col = q1.col AND t.row_ = q1.row_ GROUP BY obj_id, seg),
n1 AS (SELECT obj_id, sum(n) = 36 AS known, max(z0) AS top FROM z1 GROUP BY obj_id),
w0 AS (SELECT e1.*, CASE WHEN known THEN eaves + top - ground ELSE eaves END AS mean, CASE WHEN known THEN eaves + top - z0 ELSE eaves END AS wa, CASE WHEN known THEN eaves + top - z8 ELSE eaves END AS wb, CASE WHEN ridge <= eaves THEN 'flat' WHEN e1.seg % 2 = axis THEN 'eave' ELSE 'gable' END AS kind,
  sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM e1 JOIN z1 ON z1.obj_id = e1.obj_id AND z1.seg = e1.seg JOIN n1 ON n1.obj_id = e1.obj_id),
w1 AS (SELECT *, CASE WHEN kind = 'flat' THEN 0e0 ELSE rise * {_SHARE} END AS plus, mean + CASE WHEN rise <= 0 OR pitch <= 45 THEN 0 WHEN kind = 'eave' THEN rise * {_SHARE} ELSE greatest(rise / 2, rise * {_SHARE}) END AS h7, (by_ - ay) / len AS nx, (ax - bx) / len AS ny FROM w0),
wl AS (SELECT *, greatest(wa, wb) + plus AS h4, greatest(3e0, 0.4e0 * (wa + plus)) AS ta, greatest(3e0, 0.4e0 * (wb + plus)) AS tb FROM w1),
ho AS (SELECT *, {_DEPTH} AS t FROM ({_OWN})), he AS ({_EDGES4.format(c='obj_id, parcel_id, t', t='ho WHERE eaves IS NOT NULL')}),
hw AS (SELECT *, sign(by_ - ay) AS nx, sign(ax - bx) AS ny FROM he),
pg AS (SELECT concat('T', obj_id, '_', seg) AS id, 0 AS k, ax AS x, ay AS y FROM wl UNION ALL SELECT concat('T', obj_id, '_', seg), 1, ax + nx * ta, ay + ny * ta FROM wl UNION ALL SELECT concat('T', obj_id, '_', seg), 2, bx + nx * tb, by_ + ny * tb FROM wl UNION ALL SELECT concat('T', obj_id, '_', seg), 3, bx, by_ FROM wl
  UNION ALL SELECT concat('H', obj_id, '_', seg), 0, ax, ay FROM hw UNION ALL SELECT concat('H', obj_id, '_', seg), 1, ax + nx * t, ay + ny * t FROM hw UNION ALL SELECT concat('H', obj_id, '_', seg), 2, bx + nx * t, by_ + ny * t FROM hw UNION ALL SELECT concat('H', obj_id, '_', seg), 3, bx, by_ FROM hw
  UNION ALL SELECT concat('P', parcel_id), seg, ax, ay FROM parcel_edge UNION ALL SELECT concat('F', obj_id), seg, ax, ay FROM e1 UNION ALL SELECT concat('B', obj_id), seg, ax, ay FROM ({_EDGES4.format(c='obj_id', t='ho')})),
pe AS (SELECT id, k, x AS ax, y AS ay, coalesce(lead(x) OVER (PARTITION BY id ORDER BY k), first_value(x) OVER (PARTITION BY id ORDER BY k)) AS bx, coalesce(lead(y) OVER (PARTITION BY id ORDER BY k), first_value(y) OVER (PARTITION BY id ORDER BY k)) AS by_ FROM pg),
pr AS (SELECT 'plot' AS kind, obj_id, concat('T', obj_id, '_', seg) AS a, concat('P', parcel_id) AS b FROM wl UNION ALL SELECT 'wall', wl.obj_id, concat('T', wl.obj_id, '_', wl.seg), concat('H', hw.obj_id, '_', hw.seg) FROM wl JOIN hw ON hw.parcel_id = wl.parcel_id AND (wl.seg + hw.seg) % 2 = 0
  UNION ALL SELECT 'in_house', o1.obj_id, concat('F', o1.obj_id), concat('H', hw.obj_id, '_', hw.seg) FROM o1 JOIN hw ON hw.parcel_id = o1.parcel_id UNION ALL SELECT 'house_in', wl.obj_id, concat('T', wl.obj_id, '_', wl.seg), concat('B', ho.obj_id) FROM wl JOIN ho ON ho.parcel_id = wl.parcel_id
  UNION ALL SELECT 'inside', obj_id, concat('F', obj_id), concat('P', parcel_id) FROM o1),
me AS (SELECT pr.kind, pr.obj_id, pr.a, pr.b, p.k AS pk, q.k AS qk, p.ax AS pax, p.ay AS pay, p.bx AS pbx, p.by_ AS pby, q.ax AS qax, q.ay AS qay, q.bx AS qbx, q.by_ AS qby FROM pr JOIN pe p ON p.id = pr.a JOIN pe q ON q.id = pr.b),
co AS (SELECT a, b, pax AS x, pay AS y FROM me GROUP BY a, b, pk, pax, pay HAVING bool_and({g.cross('qax', 'qay', 'qbx', 'qby', 'pax', 'pay')} >= -1e-9) UNION ALL SELECT a, b, qax, qay FROM me GROUP BY a, b, qk, qax, qay HAVING bool_and({g.cross('pax', 'pay', 'pbx', 'pby', 'qax', 'qay')} >= -1e-9)
  UNION ALL SELECT a, b, pax + t * (pbx - pax), pay + t * (pby - pay) FROM (SELECT *, ((qax - pax) * (qby - qay) - (qay - pay) * (qbx - qax)) / nullif((pbx - pax) * (qby - qay) - (pby - pay) * (qbx - qax), 0) AS t, ((qax - pax) * (pby - pay) - (qay - pay) * (pbx - pax)) / nullif((pbx - pax) * (qby - qay) - (pby - pay) * (qbx - qax), 0) AS u FROM me) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
cd AS (SELECT DISTINCT a, b, round(x, 9) AS x, round(y, 9) AS y FROM co), cm AS (SELECT *, avg(x) OVER (PARTITION BY a, b) AS mx, avg(y) OVER (PARTITION BY a, b) AS my FROM cd), ca AS (SELECT *, atan2(y - my, x - mx) AS turn FROM cm),
cn1 AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY a, b ORDER BY turn, x, y), first_value(x) OVER (PARTITION BY a, b ORDER BY turn, x, y)) AS tx, coalesce(lead(y) OVER (PARTITION BY a, b ORDER BY turn, x, y), first_value(y) OVER (PARTITION BY a, b ORDER BY turn, x, y)) AS ty FROM ca),
ar0 AS (SELECT a, b, sum(x * ty - tx * y) / 2 AS area FROM cn1 GROUP BY a, b), ar AS (SELECT pr.*, coalesce(area, 0) AS area FROM pr LEFT JOIN ar0 ON ar0.a = pr.a AND ar0.b = pr.b),
ch AS (SELECT obj_id, bool_or(odd) AS held FROM (SELECT obj_id, a, qk, sum(CASE WHEN {g.ray_crossing('qax', 'qay', 'pax', 'pay', 'pbx', 'pby')} THEN 1 ELSE 0 END) % 2 = 1 AS odd FROM me WHERE kind = 'house_in' GROUP BY obj_id, a, b, qk) GROUP BY obj_id),
chk AS (SELECT o1.obj_id, max(CASE WHEN ar.kind = 'plot' THEN greatest(0, len * (ta + tb) / 2 - area) END) AS outside, coalesce(max(CASE WHEN ar.kind = 'wall' THEN area END), 0) AS overlap, coalesce(bool_or(ar.kind = 'in_house' AND area > 0.05), false) AS in_house,
  coalesce(bool_or(ar.kind = 'house_in' AND area > 0.05), false) OR coalesce(bool_or(held), false) AS house_in FROM o1 JOIN ar ON ar.obj_id = o1.obj_id LEFT JOIN wl ON ar.kind = 'plot' AND ar.a = concat('T', wl.obj_id, '_', wl.seg) LEFT JOIN ch ON ch.obj_id = o1.obj_id GROUP BY o1.obj_id)"""


@query("setback_check", f"WITH {_AREAS} SELECT obj_id, round(outside, 4) + 0.0e0 AS outside, round(overlap, 4) + 0.0e0 AS overlap, in_house, house_in, CASE WHEN outside > 0.05 OR overlap > 0.05 OR in_house OR house_in THEN 'bad' ELSE 'ok' END AS status FROM chk")
def _(view):
    objects = role(view, 1).withColumn("pitch", F.expr(PITCH))
    return rounded(b.setback_check(objects, view("parcel_edge"), view("terrain_cell"), _own(view)), "outside", "overlap", digits=4)


_INSIDE = f"bool_and({g.cross('ax', 'ay', 'bx', 'by_', 'aax', 'aay')} >= -1e-6)"
_GAPS = f"gap AS (SELECT obj_id, {_INSIDE} AS inside, min({_SEGDIST}) AS distance FROM {_BOX} o JOIN parcel_edge e ON e.parcel_id = o.parcel_id WHERE role = 1 GROUP BY obj_id)"
_KNOWN = "provenance IN ('nutzerbestätigt', 'erfasst per Tipp') AND klasse IN ('gartenhaus', 'gewaechshaus', 'carport_garage')"


@query("placement_verdict", f"""
WITH {_AREAS}, cx AS (SELECT obj_id, parcel_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 2 AND {_KNOWN}),
ct AS (SELECT parcel_id, obj_id FROM footprint WHERE role = 1 UNION ALL SELECT cx.parcel_id, obj_id FROM cx JOIN parcel_edge e ON e.parcel_id = cx.parcel_id GROUP BY cx.parcel_id, obj_id HAVING sum(CASE WHEN {g.ray_crossing('x', 'y', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1),
sg AS (SELECT o.parcel_id, o.obj_id, seg, side, min({_SEGDIST}) AS dist FROM {_BOX} o JOIN ct ON ct.obj_id = o.obj_id JOIN parcel_edge e ON e.parcel_id = o.parcel_id GROUP BY o.parcel_id, o.obj_id, seg, side),
ln AS (SELECT sg.*, ((x2 - x1) * abs(bx - ax) + (y2 - y1) * abs(by_ - ay)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS length FROM sg JOIN footprint f ON f.obj_id = sg.obj_id JOIN parcel_edge e ON e.parcel_id = sg.parcel_id AND e.seg = sg.seg),
sd AS (SELECT parcel_id, side, sum(length) AS side_sum FROM (SELECT parcel_id, obj_id, side, max(length) AS length FROM ln WHERE dist < 3 - 1e-6 GROUP BY parcel_id, obj_id, side) GROUP BY parcel_id, side),
tt AS (SELECT parcel_id, sum(side_sum) AS total FROM sd GROUP BY parcel_id),
fw AS (SELECT wl.obj_id, e.seg, max(CASE WHEN wl.seg = 0 THEN dd END) AS d0, max(CASE WHEN wl.seg = 1 THEN dd END) AS d1, max(CASE WHEN wl.seg = 2 THEN dd END) AS d2, max(CASE WHEN wl.seg = 3 THEN dd END) AS d3
  FROM (SELECT wl.*, e.seg AS eseg, {g.point_segment_distance('(wl.ax + wl.bx) / 2', '(wl.ay + wl.by_) / 2', 'e.ax', 'e.ay', 'e.bx', 'e.by_')} AS dd FROM wl JOIN parcel_edge e ON e.parcel_id = wl.parcel_id) wl JOIN parcel_edge e ON e.parcel_id = wl.parcel_id AND e.seg = wl.eseg GROUP BY wl.obj_id, e.seg),
f1 AS (SELECT *, CASE WHEN d1 < d0 - 1e-6 THEN 1 ELSE 0 END AS b1, CASE WHEN d1 < d0 - 1e-6 THEN d1 ELSE d0 END AS m1 FROM fw), f2 AS (SELECT *, CASE WHEN d2 < m1 - 1e-6 THEN 2 ELSE b1 END AS b2, CASE WHEN d2 < m1 - 1e-6 THEN d2 ELSE m1 END AS m2 FROM f1),
f3 AS (SELECT obj_id, seg, CASE WHEN d3 < m2 - 1e-6 THEN 3 ELSE b2 END AS wall FROM f2),
nr AS (SELECT ln.obj_id, bool_or(h7 > 3 + 1e-9) AS high, bool_or(coalesce(side_sum, 0) > 9 + 1e-6) AS side_over FROM ln JOIN f3 ON f3.obj_id = ln.obj_id AND f3.seg = ln.seg JOIN wl ON wl.obj_id = ln.obj_id AND wl.seg = f3.wall LEFT JOIN sd ON sd.parcel_id = ln.parcel_id AND sd.side = ln.side
  WHERE dist < greatest(3e0, 0.4e0 * h4) - 1e-6 GROUP BY ln.obj_id),
hit AS (SELECT DISTINCT a.obj_id FROM footprint a JOIN footprint c ON a.role = 1 AND a.obj_id <> c.obj_id AND (c.role = 0 OR c.role = 2 AND c.provenance <> 'erkannt' AND c.klasse IN ('gartenhaus', 'gewaechshaus', 'carport_garage', 'pool', 'teich') OR c.role = 1 AND c.parcel_id = a.parcel_id) AND a.x1 <= c.x2 AND c.x1 <= a.x2 AND a.y1 <= c.y2 AND c.y1 <= a.y2 WHERE {g.box_overlap('a.', 'c.')} > 0.01),
ins AS (SELECT obj_id, area FROM ar WHERE kind = 'inside'), m7 AS (SELECT obj_id, max(h7) AS h7 FROM wl GROUP BY obj_id),
pl AS (SELECT o1.*, klasse = 'carport_garage' AS carport, klasse = 'carport_garage' OR NOT (o1.obj_id % 3 = 0 OR o1.obj_id % 7 = 0) AS plain, (x2 - x1) * (y2 - y1) AS size, zone = 'aussen' AS outer_ FROM o1 JOIN parcel p ON p.parcel_id = o1.parcel_id),
f AS (SELECT pl.obj_id, plain, concat_ws(',', CASE WHEN NOT ins.area >= size - 0.005 THEN 'outside' END, CASE WHEN hit.obj_id IS NOT NULL THEN 'collision' END, CASE WHEN outer_ THEN 'outer_area' END,
  CASE WHEN CASE WHEN carport THEN size > 50 + 1e-9 ELSE size * (eaves + greatest(0, ridge - eaves) / 2) > CASE WHEN outer_ THEN 20 ELSE 75 END + 1e-9 END THEN 'size' END,
  CASE WHEN NOT (plain AND m7.h7 <= 3 + 1e-9) AND nr.obj_id IS NULL AND outside > 0.05 THEN 'setback_neighbour' END, CASE WHEN NOT (plain AND m7.h7 <= 3 + 1e-9) AND nr.obj_id IS NULL AND (overlap > 0.05 OR in_house OR house_in) THEN 'setback_house' END,
  CASE WHEN nr.obj_id IS NOT NULL AND NOT plain THEN 'boundary_room' END, CASE WHEN high THEN 'boundary_height' END, CASE WHEN side_over THEN 'boundary_side' END, CASE WHEN nr.obj_id IS NOT NULL AND coalesce(total, 0) > 15 + 1e-6 THEN 'boundary_total' END) AS findings
  FROM pl JOIN chk ON chk.obj_id = pl.obj_id JOIN ins ON ins.obj_id = pl.obj_id JOIN m7 ON m7.obj_id = pl.obj_id LEFT JOIN nr ON nr.obj_id = pl.obj_id LEFT JOIN hit ON hit.obj_id = pl.obj_id LEFT JOIN tt ON tt.parcel_id = pl.parcel_id)
SELECT obj_id, findings, CASE WHEN findings <> '' THEN split_part(findings, ',', 1) WHEN plain THEN 'ok' ELSE 'fire_safety' END AS headline, CASE WHEN findings <> '' THEN 'bad' WHEN plain THEN 'ok' ELSE 'warn' END AS status FROM f""")
def findings(view):  # noqa: ANN001, ANN201
    objects = role(view, 1).withColumns({"pitch": F.expr(PITCH), "room": F.expr("obj_id % 3 = 0"), "fireplace": F.expr("obj_id % 7 = 0")})
    return b.placement_findings(objects, view("parcel"), view("parcel_edge"), _own(view), role(view, 2), view("terrain_cell"))


_FIND = "SELECT obj_id, parcel_id, concat_ws(',', CASE WHEN eaves > 4 THEN 'size' END, CASE WHEN confidence > 0.7 THEN 'setback' END, CASE WHEN klasse = 'pool' THEN 'outside' END) AS findings FROM footprint WHERE role = 1"


def _find(view):
    return role(view, 1).selectExpr("obj_id", "parcel_id", "concat_ws(',', CASE WHEN eaves > 4 THEN 'size' END, CASE WHEN confidence > 0.7 THEN 'setback' END, CASE WHEN klasse = 'pool' THEN 'outside' END) AS findings")


@query("procedure", f"""
WITH f AS ({_FIND}), k AS (SELECT obj_id, CASE WHEN findings LIKE '%outside%' THEN 'lage' WHEN findings LIKE '%size%' THEN 'genehmigung' WHEN findings LIKE '%setback%' THEN 'frei_abweichung' ELSE 'frei' END AS procedure FROM f)
SELECT obj_id, procedure, CASE procedure WHEN 'genehmigung' THEN 'lageplan,bauzeichnung,baubeschreibung' WHEN 'frei_abweichung' THEN 'lageplan,abweichungsantrag' ELSE '' END AS documents FROM k""")
def _(view):
    return b.procedure(_find(view))


@query("questions_for_authority", f"""
WITH f AS ({_FIND}), r AS (SELECT 'aussen' AS key, 'Aussenbereich?' AS question UNION ALL SELECT 'size', 'Verfahren?' UNION ALL SELECT 'rein', 'Gebietsart?'),
k AS (SELECT obj_id, unnest(string_split(findings, ',')) AS key FROM f UNION ALL SELECT obj_id, zone FROM f JOIN parcel USING (parcel_id) UNION ALL SELECT obj_id, area_kind FROM f JOIN parcel USING (parcel_id))
SELECT DISTINCT obj_id, question FROM k JOIN r ON r.key = k.key""")
def _(view):
    rules = view("region").sparkSession.createDataFrame([("aussen", "Aussenbereich?"), ("size", "Verfahren?"), ("rein", "Gebietsart?")], "key string, question string")
    return b.questions(view("parcel"), _find(view), rules)


@query("key_figures", """
SELECT obj_id, (x2 - x1) * (y2 - y1) AS footprint, (x2 - x1) * (y2 - y1) * greatest(floor(eaves / 2.8), 1) AS floor_area, round((x2 - x1) * (y2 - y1) * (eaves + (ridge - eaves) / 2), 6) AS volume,
  round((greatest(floor(eaves / 2.8), 1) - 1) * 2.8 + 1, 6) AS sill FROM footprint WHERE role = 1""")
def _(view):
    return rounded(rounded(b.key_figures(role(view, 1)), "footprint", "volume", "sill").withColumn("floor_area", F.col("floor_area").cast("double")), "floor_area")


#: Houses in true size: the derived footprints, three times as long each way.
_HOUSE = "SELECT obj_id, parcel_id, x1, y1, x1 + 3 * (x2 - x1) AS x2, y1 + 3 * (y2 - y1) AS y2, eaves, ridge, CASE obj_id % 4 WHEN 0 THEN '31001_2010' WHEN 1 THEN '51009_1610' ELSE '31001_1000' END AS kind FROM footprint WHERE role = 0"
_MAIN = "(x2 - x1) * (y2 - y1) >= 40 AND (eaves IS NULL OR eaves >= 3)"


def _houses(view):
    return role(view, 0).selectExpr("obj_id", "parcel_id", "x1", "y1", "x1 + 3 * (x2 - x1) AS x2", "y1 + 3 * (y2 - y1) AS y2", "eaves", "ridge", "CASE obj_id % 4 WHEN 0 THEN '31001_2010' WHEN 1 THEN '51009_1610' ELSE '31001_1000' END AS kind")


@query("neighbourhood_stats", f"""
WITH o AS (SELECT obj_id, parcel_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 1), m AS (SELECT parcel_id, eaves, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM ({_HOUSE}) WHERE {_MAIN})
SELECT o.obj_id, count(*) AS n, min(eaves) AS low, round(median(eaves), 6) AS median, max(eaves) AS high FROM o JOIN m ON o.parcel_id <> m.parcel_id AND sqrt((o.x - m.x) * (o.x - m.x) + (o.y - m.y) * (o.y - m.y)) <= 100 GROUP BY o.obj_id""")
def _(view):
    return rounded(b.neighbourhood(role(view, 1), _houses(view)), "median")


@query("second_row_count", f"""
WITH h AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 0), r AS (SELECT obj_id AS road_id, (x1 + x2) / 2 AS tx, (y1 + y2) / 2 AS ty FROM footprint WHERE role = 8),
m AS (SELECT h.obj_id, x, y, road_id, tx, ty, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS dd FROM h JOIN r ON abs(x - tx) <= 60 AND abs(y - ty) <= 60), n AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY dd, road_id) AS nth FROM m WHERE dd <= 60),
e AS (SELECT obj_id AS other, aax, aay, abx, aby FROM {_BOX} WHERE role = 0),
c AS (SELECT n.obj_id, bool_or({g.segments_cross(('n.x', 'n.y', 'tx', 'ty'), ('aax', 'aay', 'abx', 'aby'))}) AS crossed FROM n JOIN e ON e.other <> n.obj_id AND nth = 1 AND abs(aax - n.x) <= 80 AND abs(aay - n.y) <= 80 GROUP BY n.obj_id)
SELECT h.obj_id, CASE WHEN road_id IS NOT NULL THEN dd >= 25 AND coalesce(crossed, false) END AS second FROM h LEFT JOIN n ON n.obj_id = h.obj_id AND nth = 1 LEFT JOIN c ON c.obj_id = h.obj_id""")
def _(view):
    return b.second_row(role(view, 0), role(view, 8), 25.0, 60.0)


_CELLS = """c AS (SELECT parcel_id, col, unnest(generate_series(CAST(floor(y0 / {r}) AS BIGINT), CAST(floor((y0 + h) / {r}) AS BIGINT))) AS row_ FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / {r}) AS BIGINT), CAST(floor((x0 + w + skew) / {r}) AS BIGINT))) AS col FROM parcel))"""


#: Grid steps of the survey (K13, K16, K18).
STEP, COARSE = 0.5, 1.0


_ROAD_OFFSET = """
WITH s AS (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS share), k AS (SELECT unnest(generate_series(1, 30)) * 0.02e0 AS s0),
p AS (SELECT parcel_id, seg, share, ax + share * (bx - ax) AS mx, ay + share * (by_ - ay) AS my, (by_ - ay) / len AS nx, (ax - bx) / len AS ny FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM parcel_edge), s WHERE len >= 1),
b AS (SELECT p.parcel_id, seg, share, greatest(CASE WHEN nx = 0 THEN CASE WHEN mx BETWEEN x1 AND x2 THEN -1e9 ELSE 1e9 END ELSE least((x1 - mx) / nx, (x2 - mx) / nx) END, CASE WHEN ny = 0 THEN CASE WHEN my BETWEEN y1 AND y2 THEN -1e9 ELSE 1e9 END ELSE least((y1 - my) / ny, (y2 - my) / ny) END) AS a,
  least(CASE WHEN nx = 0 THEN 1e9 ELSE greatest((x1 - mx) / nx, (x2 - mx) / nx) END, CASE WHEN ny = 0 THEN 1e9 ELSE greatest((y1 - my) / ny, (y2 - my) / ny) END) AS z
  FROM p JOIN footprint f ON f.role IN (8, 9) AND x1 <= greatest(mx, mx + 60 * nx) AND x2 >= least(mx, mx + 60 * nx) AND y1 <= greatest(my, my + 60 * ny) AND y2 >= least(my, my + 60 * ny)),
r AS (SELECT parcel_id, seg, share, round(a, 6) AS a, least(round(z, 6), 60e0) AS z FROM b WHERE a <= z AND z >= 0),
e AS (SELECT parcel_id, seg, share, min(s0) AS s0 FROM r, k WHERE s0 BETWEEN a AND z GROUP BY parcel_id, seg, share),
x AS (SELECT e.parcel_id, e.seg, e.share, e.s0, min(r.z) AS s1 FROM e JOIN r ON r.parcel_id = e.parcel_id AND r.seg = e.seg AND r.share = e.share AND r.z >= e.s0
  WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.parcel_id = r.parcel_id AND o.seg = r.seg AND o.share = r.share AND o.a <= r.z AND r.z < o.z) GROUP BY e.parcel_id, e.seg, e.share, e.s0),
m AS (SELECT parcel_id, seg, list_sort(list((CASE WHEN s0 <= 0.04 THEN 0 ELSE s0 END + s1) / 2)) AS mids FROM x GROUP BY parcel_id, seg)
SELECT q.parcel_id, q.seg, CASE WHEN len(mids) >= 2 THEN round(least(30, greatest(0, mids[CAST(floor(len(mids) / 2) AS INTEGER) + 1])), 6) ELSE 0e0 END AS shift FROM parcel_edge q LEFT JOIN m ON m.parcel_id = q.parcel_id AND m.seg = q.seg"""


@query("road_offset", _ROAD_OFFSET)
def _(view):
    return rounded(b.road_offset(view("parcel_edge"), role(view, 8, 9)), "shift")


#: Distance of a point to a box.
_GAP_TO = "sqrt(pow(greatest(0, ({x1}) - px, px - ({x2})), 2) + pow(greatest(0, ({y1}) - py, py - ({y2})), 2))"
_RINGS = [dict(zip(("x1", "y1", "x2", "y2"), r, strict=True)) for r in (("x1", "y1", "x2", "y2"), ("x1", "y1 - t", "x2", "y1"), ("x2", "y1", "x2 + t", "y2"), ("x1", "y2", "x2", "y2 + t"), ("x1 - t", "y1", "x1", "y2"))]


def _heights_sql(points: str) -> str:
    """CTEs that end in hp (the columns of ``points``, height): points have pid, parcel_id, px, py."""
    return f"""ro AS ({_ROAD_OFFSET}), ln AS (SELECT e.parcel_id, e.seg, ax + shift * (by_ - ay) / len AS x, ay - shift * (bx - ax) / len AS y, (bx - ax) / len AS dx, (by_ - ay) / len AS dy
  FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM parcel_edge) e JOIN ro ON ro.parcel_id = e.parcel_id AND ro.seg = e.seg),
cn AS (SELECT l.parcel_id, l.seg, p.x + p.dx * ((l.x - p.x) * l.dy - (l.y - p.y) * l.dx) / (p.dx * l.dy - p.dy * l.dx) AS x, p.y + p.dy * ((l.x - p.x) * l.dy - (l.y - p.y) * l.dx) / (p.dx * l.dy - p.dy * l.dx) AS y FROM ln l JOIN ln p ON p.parcel_id = l.parcel_id AND p.seg = (l.seg + 3) % 4),
ra AS (SELECT c.parcel_id, c.seg, c.x AS ax, c.y AS ay, d.x AS bx, d.y AS by_ FROM cn c JOIN cn d ON d.parcel_id = c.parcel_id AND d.seg = (c.seg + 1) % 4),
ow AS (SELECT *, {_DEPTH} AS t FROM ({_OWN})), iv0 AS (SELECT obj_id, parcel_id, x1, y1, x2, y2 FROM footprint WHERE role = 2 AND klasse IN ('gartenhaus', 'gewaechshaus', 'carport_garage') AND provenance IN ('nutzerbestätigt', 'erfasst per Tipp')),
iv AS (SELECT i.* FROM iv0 i JOIN (SELECT i.obj_id FROM iv0 i JOIN parcel_edge e ON e.parcel_id = i.parcel_id GROUP BY i.obj_id HAVING sum(CASE WHEN {g.ray_crossing('x1', 'y1', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1) k ON k.obj_id = i.obj_id),
po AS ({points}),
dr AS (SELECT pid, sum(CASE WHEN {g.ray_crossing('px', 'py', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1 AS within, min({g.point_segment_distance('px', 'py', 'ax', 'ay', 'bx', 'by_')}) AS d FROM po JOIN ra ON ra.parcel_id = po.parcel_id GROUP BY pid),
do_ AS (SELECT pid, min(least({_GAP_TO.format(**_RINGS[0])}, CASE WHEN eaves IS NULL THEN 1e9 ELSE least({', '.join(_GAP_TO.format(**r) for r in _RINGS[1:])}) END)) AS d FROM po JOIN ow ON ow.parcel_id = po.parcel_id GROUP BY pid),
dc AS (SELECT DISTINCT pid FROM po JOIN iv ON iv.parcel_id = po.parcel_id AND px >= x1 AND px < x2 AND py >= y1 AND py < y2),
hp AS (SELECT po.*, CASE WHEN NOT within OR dc.pid IS NOT NULL THEN 0e0 WHEN least(dr.d, coalesce(do_.d, 1e9)) >= 3 - 1e-9 THEN least(dr.d, coalesce(do_.d, 1e9)) / 0.4e0 ELSE 0e0 END AS height FROM po JOIN dr ON dr.pid = po.pid LEFT JOIN do_ ON do_.pid = po.pid LEFT JOIN dc ON dc.pid = po.pid)"""


def _model(view):
    edges = view("parcel_edge")
    shift = rounded(b.road_offset(edges, role(view, 8, 9)), "shift")
    confirmed = role(view, 2).filter(F.col("klasse").isin(*lim.BUILDING_CLASSES) & F.col("provenance").isin("nutzerbestätigt", "erfasst per Tipp"))
    return env.models(edges.join(shift, ["parcel_id", "seg"]), s.box_edges(_own(view), "parcel_id", "obj_id", "eaves", "ridge"), s.box_edges(confirmed, "parcel_id", "obj_id"))


_GRID = f"""SELECT row_number() OVER () AS pid, k.*, col * 0.5e0 AS px, row_ * 0.5e0 AS py FROM (SELECT c.parcel_id, col, row_ FROM c JOIN parcel_edge e ON e.parcel_id = c.parcel_id GROUP BY c.parcel_id, col, row_
  HAVING sum(CASE WHEN {g.ray_crossing('col * 0.5e0', 'row_ * 0.5e0', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1) k"""


@query("envelope", f"WITH {_CELLS.format(r=0.5)}, {_heights_sql(_GRID)} SELECT parcel_id, col, row_, round(height, 6) AS height FROM hp")
def _(view):
    return env.envelope(_model(view), STEP, 6)


_SAMPLES = f"""SELECT row_number() OVER () AS pid, obj_id, parcel_id, eaves + CASE WHEN pitch > 70 THEN ridge - eaves ELSE (ridge - eaves) / 3 END AS top, aax + (abx - aax) * (k / n) AS px, aay + (aby - aay) * (k / n) AS py
  FROM (SELECT *, unnest(generate_series(0, CAST(n AS BIGINT))) AS k FROM (SELECT o.obj_id, o.parcel_id, f.eaves, f.ridge, CAST(30 + o.obj_id % 60 AS DOUBLE) AS pitch, aax, aay, abx, aby, greatest(1, ceil(sqrt((abx - aax) * (abx - aax) + (aby - aay) * (aby - aay)) / 0.25e0)) AS n FROM {_BOX} o JOIN footprint f ON f.obj_id = o.obj_id WHERE o.role = 1))"""


@query("envelope_breaches", f"WITH {_heights_sql(_SAMPLES)} SELECT obj_id, count(*) AS samples, CAST(sum(CASE WHEN top - height > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS breaches, round(greatest(0e0, max(top - height)), 6) AS excess FROM hp GROUP BY obj_id")
def _(view):
    roof = b.roof_share(F.expr(PITCH), F.col("ridge") - F.col("eaves"))
    walls = s.box_edges(role(view, 1).withColumns({"ha": F.col("eaves"), "hb": F.col("eaves"), "roof": roof}), "parcel_id", "obj_id", "ha", "hb", "roof")
    return rounded(env.envelope_breaches(walls, _model(view)), "excess")


_SIDES = "SELECT parcel_id, side, side = 0 AND parcel_id % 2 = 0 AS road, CASE WHEN (parcel_id + side) % 4 = 1 THEN 1.8e0 END AS fence, (parcel_id + side) % 7 = 3 AS forest FROM parcel_edge"
_PX, _PY = "(col + 0.5) * 1", "(row_ + 0.5) * 1"
_TO_SIDE = g.point_segment_distance(_PX, _PY, "ax", "ay", "bx", "by_")


@query("plant_zones", f"""
WITH {_CELLS.format(r=1)}, d AS (SELECT c.parcel_id, col, row_, sum(CASE WHEN {g.ray_crossing(_PX, _PY, 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) AS n, min(CASE WHEN NOT (side = 0 AND e.parcel_id % 2 = 0) THEN {_TO_SIDE} END) AS every_,
  min(CASE WHEN NOT (side = 0 AND e.parcel_id % 2 = 0) AND (e.parcel_id + side) % 7 <> 3 THEN {_TO_SIDE} END) AS open_ FROM c JOIN parcel_edge e ON e.parcel_id = c.parcel_id GROUP BY c.parcel_id, col, row_)
SELECT parcel_id, col, row_, CASE WHEN every_ + 1e-9 < 0.5 THEN 'red' WHEN open_ + 1e-9 < 2 THEN 'yellow' ELSE 'green' END AS colour FROM d WHERE n % 2 = 1""")
def _(view):
    return env.plant_zones(view("parcel_edge").selectExpr("*", "side = 0 AND parcel_id % 2 = 0 AS road", "(parcel_id + side) % 7 = 3 AS forest"), 1.0)


_PLANTS = "SELECT obj_id, parcel_id, x1 - 2 AS x, y1 - 1.5 AS y, eaves AS height FROM footprint WHERE role = 7"
_PLANT_D = f"pd AS (SELECT obj_id, height, e.side, {g.point_segment_distance('x', 'y', 'ax', 'ay', 'bx', 'by_')} AS dd FROM ({_PLANTS}) p JOIN parcel_edge e ON e.parcel_id = p.parcel_id WHERE side <> 0)"
_NEED = "CASE WHEN height <= 2 + 1e-9 THEN 0.5 ELSE 2.0 END"


def _plants(view):
    return role(view, 7).selectExpr("obj_id", "parcel_id", "x1 - 2 AS x", "y1 - 1.5 AS y", "eaves AS height")


@query("plant_verdict", f"""
WITH p AS ({_PLANTS}), sd AS (SELECT DISTINCT * FROM ({_SIDES})),
i AS (SELECT obj_id, sum(CASE WHEN {g.ray_crossing('x', 'y', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM p JOIN parcel_edge e ON e.parcel_id = p.parcel_id GROUP BY obj_id),
d AS (SELECT p.obj_id, height, e.parcel_id, side, min({g.point_segment_distance('x', 'y', 'ax', 'ay', 'bx', 'by_')}) AS dd FROM p JOIN parcel_edge e ON e.parcel_id = p.parcel_id GROUP BY p.obj_id, height, e.parcel_id, side),
a AS (SELECT d.obj_id, d.side, CASE WHEN inside THEN round(dd, 6) ELSE 0 END AS distance, forest, fence, CASE WHEN road THEN 'road' WHEN fence > 0 AND height <= fence + 1e-9 THEN 'fence' END AS exemption,
  CASE WHEN forest THEN 0.5e0 WHEN height > 2 + 1e-9 THEN 2.0e0 ELSE 0.5e0 END AS need0, inside FROM d JOIN sd ON sd.parcel_id = d.parcel_id AND sd.side = d.side JOIN i ON i.obj_id = d.obj_id),
v AS (SELECT *, CASE WHEN exemption IS NULL THEN need0 ELSE 0e0 END AS need, CASE WHEN distance + 1e-9 < 0.5 THEN 0e0 WHEN forest THEN 99e0 WHEN distance + 1e-9 < 2 THEN 2e0 ELSE 99e0 END AS most FROM a),
w AS (SELECT *, CASE WHEN exemption IS NOT NULL THEN 0 WHEN distance + 1e-9 < need THEN 2 WHEN distance - need < 0.1 - 1e-9 THEN 1 ELSE 0 END AS bad, CASE exemption WHEN 'road' THEN 99e0 WHEN 'fence' THEN greatest(most, fence) ELSE most END AS allowed,
  row_number() OVER (PARTITION BY obj_id ORDER BY exemption IS NOT NULL, round(distance - need, 6), side) AS nth FROM v),
t AS (SELECT obj_id, CASE WHEN NOT bool_and(inside) THEN 'bad' ELSE CASE max(bad) WHEN 2 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'ok' END END AS status, nullif(min(allowed), 99) AS max_height FROM w GROUP BY obj_id)
SELECT w.obj_id, side, distance, need, coalesce(exemption, '') AS exemption, status, max_height FROM w JOIN t ON t.obj_id = w.obj_id WHERE nth = 1""")
def _(view):
    sides = view("parcel_edge").selectExpr("parcel_id", "side", "side = 0 AND parcel_id % 2 = 0 AS road", "CASE WHEN (parcel_id + side) % 4 = 1 THEN 1.8D END AS fence", "(parcel_id + side) % 7 = 3 AS forest").distinct()
    return d.plant_verdict(_plants(view), view("parcel_edge"), sides)


@query("existing_plants", f"""WITH {_PLANT_D}, k AS (SELECT obj_id, height, side, round(dd, 6) AS distance, row_number() OVER (PARTITION BY obj_id ORDER BY round(dd, 6), side) AS nth FROM pd)
SELECT obj_id, side, distance, CASE WHEN distance - 0.5 >= {_NEED} THEN 'above' WHEN distance + 0.5 < {_NEED} THEN 'below' ELSE 'unclear' END AS result FROM k WHERE nth = 1""")
def _(view):
    return d.existing_plants(_plants(view), view("parcel_edge"), 0.5)


@query("residential_filter", f"""SELECT obj_id, CASE WHEN kind LIKE '31001_1%' AND (x2 - x1) * (y2 - y1) BETWEEN 60 AND 300 THEN 1 WHEN (kind LIKE '31001_1%' OR kind LIKE '31001_2%') AND (x2 - x1) * (y2 - y1) BETWEEN 40 AND 800 THEN 2 ELSE 0 END AS pass,
  {_MAIN} AS main FROM ({_HOUSE})""")
def _(view):
    return b.residential(_houses(view))


@query("counted_inventory", f"""
WITH o AS (SELECT obj_id, klasse, provenance, parcel_id, (x1 + x2) / 2 + CASE WHEN obj_id % 3 = 0 THEN 12 ELSE 0 END AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 2),
i AS (SELECT obj_id, klasse, provenance FROM o JOIN parcel_edge e ON e.parcel_id = o.parcel_id GROUP BY obj_id, klasse, provenance HAVING sum(CASE WHEN {g.ray_crossing('x', 'y', 'ax', 'ay', 'bx', 'by_')} THEN 1 ELSE 0 END) % 2 = 1),
k AS (SELECT obj_id, CASE WHEN klasse NOT IN ('gartenhaus', 'gewaechshaus', 'carport_garage') THEN 'no_building' WHEN provenance = 'nutzerbestätigt' THEN 'confirmed' WHEN provenance = 'erfasst per Tipp' THEN 'tapped' ELSE 'hint' END AS reason FROM i)
SELECT obj_id, reason IN ('confirmed', 'tapped') AS counts, reason FROM k""")
def _(view):
    moved = role(view, 2).withColumn("dx", F.when(F.col("obj_id") % 3 == 0, 12).otherwise(0)).withColumns({"x1": F.col("x1") + F.col("dx"), "x2": F.col("x2") + F.col("dx")})
    return b.counted_inventory(moved, view("parcel_edge"))


@query("referential_check", "SELECT DISTINCT klasse AS key, 'docs' AS missing_in FROM footprint WHERE klasse NOT IN ('pool', 'baum', 'mauer') UNION ALL SELECT 'mauer', 'rules'")
def _(view):
    docs = view("region").sparkSession.createDataFrame([("pool",), ("baum",), ("mauer",)], "key string")
    return b.referential_check(view("footprint").select(F.col("klasse").alias("key")), docs)


@query("wall_from_roof", """SELECT obj_id, round(greatest(x2 - x1 - 2 * o, 0), 6) AS length, round(greatest(y2 - y1 - 2 * o, 0), 6) AS width, round(sqrt(0.01 + o * o), 6) AS span
FROM (SELECT *, CASE provenance WHEN 'amtlich' THEN 0.2e0 WHEN 'erkannt' THEN 0.5e0 ELSE 0.3e0 END AS o FROM footprint WHERE role = 2)""")
def _(view):
    o = view("region").sparkSession.createDataFrame([("amtlich", 0.2), ("erkannt", 0.5)], "provenance string, overhang double")
    return rounded(b.wall_from_roof(role(view, 2), o), "length", "width", "span")


@query("start_position", """
WITH c AS (SELECT parcel_id, (cx + 0.5) * 0.5e0 AS x, (unnest(generate_series(CAST(floor(y0 / 0.5e0) AS BIGINT), CAST(floor((y0 + h) / 0.5e0) AS BIGINT))) + 0.5) * 0.5e0 AS y FROM (SELECT *, unnest(generate_series(CAST(floor(x0 / 0.5e0) AS BIGINT), CAST(floor((x0 + w + skew) / 0.5e0) AS BIGINT))) AS cx FROM parcel)),
g AS (SELECT c.parcel_id, x, y, round(min(((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) AS gap FROM c JOIN parcel_edge e ON e.parcel_id = c.parcel_id GROUP BY c.parcel_id, x, y),
f AS (SELECT * FROM g WHERE gap >= 3 AND NOT EXISTS (SELECT 1 FROM footprint o WHERE o.role IN (0, 2) AND o.parcel_id = g.parcel_id AND x - 1.5 < x2 AND x1 < x + 1.5 AND y - 1.5 < y2 AND y1 < y + 1.5)),
k AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY gap DESC, y, x) AS nth FROM f) SELECT parcel_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, gap FROM k WHERE nth = 1""")
def _(view):
    return b.start_position(view("parcel"), view("parcel_edge"), role(view, 0, 2), STEP, 3.0)


@query("project_verdict", f"""
WITH {_GAPS}, m AS (SELECT parcel_id, eaves, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM ({_HOUSE}) WHERE {_MAIN}),
nb AS (SELECT o.obj_id, max(m.eaves) AS high FROM (SELECT obj_id, parcel_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM footprint WHERE role = 1) o JOIN m ON o.parcel_id <> m.parcel_id AND sqrt((o.x - m.x) * (o.x - m.x) + (o.y - m.y) * (o.y - m.y)) <= 100 GROUP BY o.obj_id),
p AS (SELECT f.obj_id, CASE WHEN inside AND distance >= greatest(3, 0.4 * (eaves + (ridge - eaves) / 3)) - 1e-6 THEN 'ok' ELSE 'bad' END AS setback, CASE WHEN ridge <= 5 THEN 'ok' ELSE 'warn' END AS access,
  CASE WHEN high IS NULL THEN NULL WHEN eaves <= high + 1e-9 THEN 'ok' ELSE 'warn' END AS fits, CASE WHEN (x2 - x1) * (y2 - y1) <= 100 THEN 'ok' ELSE 'warn' END AS size FROM footprint f JOIN gap ON gap.obj_id = f.obj_id LEFT JOIN nb ON nb.obj_id = f.obj_id WHERE role = 1)
SELECT *, CASE WHEN setback = 'bad' THEN 'bad' WHEN access = 'warn' OR fits = 'warn' OR size = 'warn' THEN 'warn' WHEN fits IS NULL THEN 'open' ELSE 'ok' END AS status FROM p""")
def _(view):
    return b.project_verdict(role(view, 1), view("parcel_edge"), b.neighbourhood(role(view, 1), _houses(view)))


#: A shed with a saddle roof of 20 degrees, and an open carport.
PRODUCTS = [("haus", 4.0, 3.0, 2.3, 2.85, 20.0, "gartenhaus"), ("carport", 6.0, 3.0, 2.4, 2.4, 0.0, "carport_garage")]


def _zones(view, operator=zones.placement_zones):
    products = view("region").sparkSession.createDataFrame(PRODUCTS, "product string, w double, d double, eaves double, ridge double, pitch double, klasse string")
    edges, inventory = view("parcel_edge"), role(view, 2)
    counted = inventory.join(b.counted_inventory(inventory, edges).filter("counts").select("obj_id"), "obj_id")
    built = edges.join(s.side_lengths(counted, edges).withColumnRenamed("side", "used"), ["parcel_id", "seg"], "left")
    held = role(view, 0).unionByName(b.solid_inventory(inventory))
    # The outer area is not judged here: every parcel is asked where it would have a place within the built-up area.
    return operator(view("parcel").drop("zone"), built, held, products, COARSE, COARSE / 4, view("terrain_cell"), _own(view))


@query("placement_zones")
def _(view):
    return _zones(view)


@query("product_fit")
def _(view):
    return zones.fit_of(_zones(view, zones.best_places))


@query("clean_device_catalog", "SELECT maker, model, lw, row_id FROM device_catalog WHERE source_type LIKE 'Outdoor%' AND lw BETWEEN 35 AND 80")
def _(view):
    raw = view("device_catalog").withColumn("lw", F.col("lw").cast("string"))
    return d.clean_device_catalog(raw).select("maker", "model", "lw", "row_id")


@query("clean_device_pages", "SELECT row_id AS id, maker, lw + 20 AS lw FROM device_catalog WHERE row_id % 4 <> 3 AND lw + 20 BETWEEN 35 AND 90")
def _(view):
    pages = view("device_catalog").selectExpr("row_id AS id", """CASE row_id % 4 WHEN 0 THEN to_json(named_struct('supplierOrTrademark', maker, 'outdoorNoise', lw + 20))
      WHEN 1 THEN to_json(named_struct('supplier', maker, 'noiseOutdoor', CAST(lw + 20 AS STRING))) WHEN 2 THEN to_json(named_struct('brand', maker, 'noise', lw + 20)) ELSE '{"brand": "broken' END AS page""")
    return d.clean_device_pages(pages)


_DEV = "SELECT obj_id AS dev, f.parcel_id, area_kind, (x1 + x2) / 2 - 1 AS x, y1 - 1 AS y, CAST(50 + obj_id % 20 AS DOUBLE) AS lw FROM footprint f JOIN parcel p ON p.parcel_id = f.parcel_id WHERE role = 1"


def _devices(view):
    return role(view, 1).join(view("parcel").select("parcel_id", "area_kind"), "parcel_id").selectExpr("obj_id AS dev", "parcel_id", "area_kind", "(x1 + x2) / 2 - 1 AS x", "y1 - 1 AS y", "CAST(50 + obj_id % 20 AS DOUBLE) AS lw")


_PLACE = f"""dev AS ({_DEV}), wall AS (SELECT *, aax = abx AS upright FROM {_BOX} WHERE role = 0 AND (aax <> abx OR aay <> aby)),
pn AS (SELECT dev, count(DISTINCT upright) AS k FROM dev JOIN wall ON abs(aax - x) <= 20 AND abs(aay - y) <= 20 AND {g.point_segment_distance('x', 'y', 'aax', 'aay', 'abx', 'aby')} < 3 GROUP BY dev),
place AS (SELECT dev.dev, CASE WHEN k >= 2 THEN 'ecke' WHEN k = 1 THEN 'wand' ELSE 'frei' END AS place FROM dev LEFT JOIN pn ON pn.dev = dev.dev)"""


@query("device_placement_class", f"WITH {_PLACE} SELECT dev, place FROM place")
def _(view):
    return d.device_placement(_devices(view), role(view, 0))


_RECV = """rc0 AS (SELECT dev, f.obj_id AS house, x, y, least(greatest(x, x1), x2) AS rx, least(greatest(y, y1), y2) AS ry FROM dev JOIN footprint f ON f.role = 0 AND f.eaves >= 2 AND f.parcel_id <> dev.parcel_id),
rc AS (SELECT *, sqrt((rx - x) * (rx - x) + (ry - y) * (ry - y)) AS r FROM rc0 WHERE sqrt((rx - x) * (rx - x) + (ry - y) * (ry - y)) BETWEEN 0.5 AND 35)"""


@query("assumed_receivers", f"WITH dev AS ({_DEV}), {_RECV} SELECT dev, house, round(r, 6) AS r, rx, ry FROM rc")
def _(view):
    return rounded(d.assumed_receivers(_devices(view), role(view, 0)), "r")


@query("limit_radius", "SELECT obj_id, round(pow(10, (50 + obj_id % 20 + 10 * log10(4) - 11 - 35) / 20.0e0), 6) AS r FROM footprint WHERE role = 1")
def _(view):
    return rounded(role(view, 1).select("obj_id", d.limit_radius(F.expr("CAST(50 + obj_id % 20 AS DOUBLE)"), F.lit(4.0), F.lit(35.0)).alias("r")), "r")


@query("noise_verdict", f"""
WITH {_PLACE}, {_RECV}, np AS (SELECT dev * 1000000 + house AS pair, house AS target, x AS sx, y AS sy, rx AS tx, ry AS ty FROM rc), {sight_sql('np')},
j AS (SELECT dev.dev, house, CASE area_kind WHEN 'rein' THEN 35.0e0 WHEN 'allgemein' THEN 40.0e0 ELSE 45.0e0 END AS lim,
  round(lw + 10 * log10(CASE place WHEN 'frei' THEN 2 WHEN 'wand' THEN 4 ELSE 8 END) - 11 - 20 * log10(greatest(r, 0.5)) - coalesce(s, 0), 9) AS lp FROM dev JOIN place ON place.dev = dev.dev LEFT JOIN rc ON rc.dev = dev.dev LEFT JOIN sv ON sv.pair = rc.dev * 1000000 + rc.house),
k AS (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY lp DESC NULLS LAST, house) AS nth FROM j)
SELECT dev, house, lp, lim AS "limit", CASE WHEN lp IS NULL THEN 'warn' WHEN lp > lim THEN 'bad' WHEN lp > lim - 3 THEN 'warn' ELSE 'ok' END AS status FROM k WHERE nth = 1""")
def _(view):
    dev, houses = _devices(view), role(view, 0)
    recv = d.assumed_receivers(dev, houses)
    lines = recv.join(dev.select("dev", F.col("x").alias("sx"), F.col("y").alias("sy")), "dev").withColumn("pair", F.col("dev") * 1000000 + F.col("house"))
    seen = s.line_of_sight(lines.select("pair", F.col("house").alias("target"), "sx", "sy", F.col("rx").alias("tx"), F.col("ry").alias("ty")), houses)
    sight = lines.select("pair", "dev", "house").join(seen, "pair").select("dev", "house", "screening")
    return d.noise_verdict(dev, recv.select("dev", "house", "r"), d.device_placement(dev, houses), sight)


@query("road_distance", f"""
WITH c AS (SELECT obj_id, aax AS x, aay AS y, row_number() OVER (PARTITION BY obj_id) AS k FROM {_BOX} WHERE role = 0), r AS (SELECT * FROM footprint WHERE role IN (8, 9)),
m AS (SELECT c.obj_id, k, min(sqrt(pow(greatest(0, greatest(x - x2, x1 - x)), 2) + pow(greatest(0, greatest(y - y2, y1 - y)), 2))) AS dd FROM c JOIN r ON x BETWEEN x1 - 40 AND x2 + 40 AND y BETWEEN y1 - 40 AND y2 + 40 GROUP BY c.obj_id, k),
p AS (SELECT obj_id, max(dd) AS distance FROM m GROUP BY obj_id) SELECT f.obj_id, round(distance, 6) AS distance, distance > 50 AS far FROM footprint f LEFT JOIN p ON p.obj_id = f.obj_id WHERE role = 0""")
def _(view):
    return rounded(d.road_distance(role(view, 0), role(view, 8, 9), 40.0), "distance")


@query("straight_access", f"""
WITH ln AS (SELECT o.obj_id, o.parcel_id, aax AS tx, aay AS ty, (r.x1 + r.x2) / 2 AS sx, (r.y1 + r.y2) / 2 AS sy, r.obj_id AS road, row_number() OVER (PARTITION BY o.obj_id, r.obj_id) AS k FROM {_BOX} o JOIN footprint r ON r.role = 8 AND r.parcel_id = o.parcel_id WHERE o.role = 0),
e AS (SELECT parcel_id, aax, aay, abx, aby FROM {_BOX} WHERE role = 2),
c AS (SELECT obj_id, road, k, coalesce(min({g.segment_distance(('sx', 'sy', 'tx', 'ty'), ('aax', 'aay', 'abx', 'aby'))}), 99) AS clear FROM ln LEFT JOIN e ON e.parcel_id = ln.parcel_id GROUP BY obj_id, road, k)
SELECT obj_id, round(max(clear), 6) AS clearance, 2 * round(max(clear), 6) >= 1.25 AS ok FROM c GROUP BY obj_id""")
def _(view):
    out = rounded(d.straight_access(role(view, 0), role(view, 8), role(view, 2)), "clearance")
    return out.withColumn("ok", 2 * F.col("clearance") >= 1.25)


def _days(view):
    return view("region").sparkSession.createDataFrame([(x,) for x in lim.SUN_DAYS], "day string").withColumn("day", F.to_date("day"))


def _sun_points(view):
    return role(view, 4).selectExpr("obj_id AS pt", "klasse AS kind", "parcel_id AS room", "(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y", "1.5D AS z")


def _bodies(view, *roles):
    return role(view, *roles).selectExpr("obj_id", "x1", "y1", "x2", "y2", "ridge + 3 AS height")


@query("sun_position")
def _(view):
    from pyspark.sql import functions as f

    times = view("contribution").select("event_id", f.col("ts").cast("timestamp").alias("t"))
    return rounded(d.sun_position(times), "alt", "az")


@query("sun_hours")
def _(view):
    return d.sun_hours(_sun_points(view), _bodies(view, 0), _days(view))


@query("extra_shading")
def _(view):
    return rounded(d.extra_shading(_sun_points(view), _bodies(view, 0), _bodies(view, 1), _days(view)), "mean")


@query("room_sun")
def _(view):
    return d.room_sun(_sun_points(view), _bodies(view, 0), _days(view))
