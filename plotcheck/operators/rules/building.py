"""Walls, setbacks, boundary build-up, placement and procedure."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from plotcheck.functions import convex
from plotcheck.functions import geometry as g
from plotcheck.functions import rings as r
from plotcheck.operators import spatial as s
from plotcheck.operators.rules import limits as lim
from plotcheck.storage import materialize, spread


def walls(placements: DataFrame, terrain: DataFrame, res: float = 40.0) -> DataFrame:
    """Four walls of each placement: kind, mean height above the ground at nine samples, and height at both ends (start, end).

    The floor lies at the highest corner. Samples without terrain do not count (``n`` do); a wall without any has no row.
    """
    e = s.box_edges(placements, "obj_id", "eaves", "ridge")
    long = F.expr("CASE WHEN x2 - x1 >= y2 - y1 THEN 0 ELSE 1 END")
    axis = placements.select("obj_id", long.alias("axis"))
    kind = F.when(F.col("ridge") <= F.col("eaves"), "flat").when(F.col("seg") % 2 == F.col("axis"), "eave").otherwise("gable")
    at = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"x": F.expr("ax + (bx - ax) * k / 8"), "y": F.expr("ay + (by_ - ay) * k / 8")})
    z = at.withColumns({"col": F.floor(F.col("x") / res), "row_": F.floor(F.col("y") / res)}).join(terrain.select("col", "row_", "z"), ["col", "row_"])
    end = lambda k: F.max(F.when(F.col("k") == k, F.col("z")))
    ground = z.groupBy("obj_id", "seg", "eaves", "ridge").agg(F.avg("z").alias("ground"), F.count("*").alias("n"), end(0).alias("z0"), end(8).alias("z8"))
    top = ground.groupBy("obj_id").agg(F.max("z0").alias("floor_"))
    over = lambda c: F.col("eaves") + F.col("floor_") - F.col(c)
    return ground.join(top, "obj_id").join(axis, "obj_id").select("obj_id", "seg", kind.alias("kind"), over("ground").alias("height"), over("z0").alias("start"), over("z8").alias("end"), "n")


def roof_share(pitch: Column, rise: Column) -> Column:
    """The part of the roof that counts for the setback: a third up to 70 degrees, all above."""
    return F.when(pitch > 70, rise).otherwise(rise / 3)


def setback(buildings: DataFrame) -> DataFrame:
    """H and setback depth of buildings with eaves, ridge and pitch."""
    h = F.col("eaves") + roof_share(F.col("pitch"), F.col("ridge") - F.col("eaves"))
    return buildings.withColumn("h", h).withColumn("depth", F.greatest(F.lit(lim.SETBACK_LEAST), lim.SETBACK_FACTOR * F.col("h")))


def boundary_wall_height(walls: DataFrame) -> DataFrame:
    """Mean wall height at the boundary of ``walls`` (kind, mean, rise, pitch), whether the law leaves it open, and whether privileged.

    The roof counts above 45 degrees: a third of its height, all above 70; at a gable half of it at least, and the height
    is then open. Null heights stay null.
    """
    part = F.col("rise") * F.when(F.col("pitch") > 70, 1.0).otherwise(1 / 3)
    steep = (F.col("rise") > 0) & (F.col("pitch") > 45)
    h = F.col("mean") + F.when(~steep, 0.0).when(F.col("kind") == "eave", part).otherwise(F.greatest(F.col("rise") / 2, part))
    return walls.withColumns({"height": h, "open": steep & (F.col("kind") != "eave")}).withColumn("privileged", F.col("height") <= lim.BOUNDARY_HEIGHT + 1e-9)


def parcel_gap(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(obj_id, inside, distance): is the box within its parcel (counter-clockwise, convex), and how far from its boundary."""
    c = s.box_corners(objects, "parcel_id", "obj_id").join(edges, "parcel_id")
    inside = c.groupBy("obj_id").agg(F.bool_and(F.expr(g.cross("ax", "ay", "bx", "by_", "x", "y") + " >= -1e-6")).alias("inside"))
    d = s.polygon_distance(s.as_outline(s.box_edges(objects, "parcel_id", "obj_id"), "parcel_id", "obj_id"), edges, "parcel_id", ("obj_id",))
    return inside.join(d, "obj_id")


def setback_walls(objects: DataFrame, terrain: DataFrame) -> DataFrame:
    """(obj_id, walls): what the law asks of each wall of planned ``objects`` (obj_id, box, eaves, ridge, pitch), one array an object.

    Each wall has its ends, kind, ``h7`` (mean height with the roof's share at the boundary), ``h4`` (the higher end with the
    roof's share for the setback), and its setback area on the ground: a trapezoid, as depths at both ends differ on a
    slope, as ``ring`` (counter-clockwise) of ``size`` square metres. Where terrain is missing under an object, its ground is level.
    """
    w = walls(objects, terrain)
    known = w.groupBy("obj_id").agg((F.sum("n") == 36).alias("known"))
    roof = objects.select("obj_id", (F.col("ridge") - F.col("eaves")).alias("rise"), "pitch", F.col("eaves").alias("level"))
    flat = F.when(F.col("ridge") <= F.col("eaves"), "flat").when(F.col("seg") % 2 == F.col("axis"), "eave").otherwise("gable")
    e = s.box_edges(objects.withColumn("axis", F.expr("CASE WHEN x2 - x1 >= y2 - y1 THEN 0 ELSE 1 END")), "obj_id", "eaves", "ridge", "axis").withColumn("kind", flat).drop("eaves", "ridge", "axis")
    j = e.join(w.drop("kind", "n"), ["obj_id", "seg"], "left").join(known, "obj_id", "left").join(roof, "obj_id")
    height = lambda c: F.when(F.coalesce("known", F.lit(False)), F.col(c)).otherwise(F.col("level"))
    j = j.withColumns({"mean": height("height"), "start": height("start"), "end": height("end")})
    j = boundary_wall_height(j).withColumnRenamed("height", "h7")
    # A factor of a third, not a division by three: depths agree with SQL to the last bit.
    add = F.when(F.col("kind") == "flat", 0.0).otherwise(F.col("rise") * F.when(F.col("pitch") > 70, 1.0).otherwise(1 / 3))
    depth = lambda c: F.greatest(F.lit(lim.SETBACK_LEAST), lim.SETBACK_FACTOR * (F.col(c) + add))
    length = F.expr("sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")
    j = j.withColumns({"nx": F.expr("by_ - ay") / length, "ny": F.expr("ax - bx") / length, "ta": depth("start"), "tb": depth("end"), "h4": F.greatest("start", "end") + add}).withColumn("size", length * (F.col("ta") + F.col("tb")) / 2)
    p = lambda x, y, t: r.point(F.col(x) + F.col("nx") * t, F.col(y) + F.col("ny") * t)
    j = j.withColumn("ring", F.array(p("ax", "ay", F.lit(0.0)), p("ax", "ay", F.col("ta")), p("bx", "by_", F.col("tb")), p("bx", "by_", F.lit(0.0))))
    wall = F.struct("seg", "kind", "h7", "open", "h4", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by_")], "size", "ring")
    return j.groupBy("obj_id").agg(F.array_sort(F.collect_list(wall)).alias("walls"))


def _corners() -> Column:
    return F.array(*[r.point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])


def house_areas(buildings: DataFrame) -> DataFrame:
    """(parcel_id, house, house_ring, house_walls) of standing ``buildings`` (boxes with eaves and ridge): their outline, and the ring of the setback area of each wall over 0.3 m.

    Pitch is unknown: the roof counts by a third. Without eaves a building has no setback areas.
    """
    depth = F.greatest(F.lit(lim.SETBACK_LEAST), lim.SETBACK_FACTOR * (F.col("eaves") + F.greatest(F.lit(0.0), F.coalesce("ridge", "eaves") - F.col("eaves")) / 3))
    b = buildings.withColumns({"t": depth, "wide": F.expr("x2 - x1"), "deep": F.expr("y2 - y1")})

    def before(ax: str, ay: str, bx: str, by: str, nx: str, ny: str) -> Column:
        out = lambda c, n: F.expr(f"{c} + {n} * t")
        return F.array(r.point(F.col(ax), F.col(ay)), r.point(out(ax, nx), out(ay, ny)), r.point(out(bx, nx), out(by, ny)), r.point(F.col(bx), F.col(by)))

    along, across = (F.col("eaves").isNotNull() & (F.abs(c) > 0.3) for c in ("wide", "deep"))
    areas = [F.when(along, before("x1", "y1", "x2", "y1", "0", "sign(x1 - x2)")), F.when(across, before("x2", "y1", "x2", "y2", "sign(y2 - y1)", "0")), F.when(along, before("x2", "y2", "x1", "y2", "0", "sign(x2 - x1)")), F.when(across, before("x1", "y2", "x1", "y1", "sign(y1 - y2)", "0"))]
    return b.select("parcel_id", F.col("obj_id").alias("house"), _corners().alias("house_ring"), F.array_compact(F.array(*areas)).alias("house_walls"))


#: Area in square metres that counts as an overlap of setback areas.
SHARED = 0.05
#: Walls that meet at more degrees may have setback areas in common.
WALL_ANGLE = 75.0


@F.arrow_udf(t.ArrayType(t.DoubleType()))
def _on_plot(rings: pa.Array, plot: pa.Array) -> pa.Array:
    """Square metres of each convex ring on its plot; null for plots that are not convex."""
    p, q = convex.many_rings(rings), convex.rings(plot)
    known = convex.are_convex(q)
    n = np.bincount(p.row, minlength=len(known))
    i = np.flatnonzero(known[p.row])
    out = np.zeros(len(p.row))
    out[i] = convex.shared_areas(p, q, i, p.row[i])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(out), mask=pa.array(~known))


@F.arrow_udf(t.StructType().add("overlap", "double").add("in_house", "boolean").add("house_in", "boolean"))
def _by_house(walls: pa.Array, box: pa.Array, house_walls: pa.Array, house: pa.Array) -> pa.Array:
    """What ``setback_check`` says of one object and one house: rings of the walls' areas, and outlines."""
    w, o, hw, h = convex.many_rings(walls), convex.rings(box), convex.many_rings(house_walls), convex.rings(house)
    rows = len(box)

    def turn(c: convex.Rings) -> np.ndarray:
        # A wall's area begins at one end of the wall and closes at the other.
        last = np.maximum(c.n - 1, 0)[:, None]
        return np.degrees(np.arctan2(np.take_along_axis(c.y, last, 1)[:, 0] - c.y[:, 0], np.take_along_axis(c.x, last, 1)[:, 0] - c.x[:, 0]))

    i, j = convex.pairs(w, hw, rows)
    apart = np.abs(turn(w)[i] - turn(hw)[j]) % 180
    aligned = np.minimum(apart, 180 - apart) <= WALL_ANGLE
    i, j = i[aligned], j[aligned]
    overlap = np.zeros(rows)
    np.maximum.at(overlap, w.row[i], convex.shared_areas(w, hw, i, j))
    in_house, house_in = np.zeros(rows, bool), np.zeros(rows, bool)
    in_house[hw.row[convex.shared_areas(o, hw, hw.row, np.arange(len(hw.row))) > SHARED]] = True
    house_in[w.row[convex.shared_areas(w, h, np.arange(len(w.row)), w.row) > SHARED]] = True
    for k in range(h.x.shape[1]):
        at = np.flatnonzero(h.n[w.row] > k)
        house_in[w.row[at[convex.holds(w.take(at), h.x[w.row[at], k], h.y[w.row[at], k])]]] = True
    return pa.StructArray.from_arrays([pa.array(overlap), pa.array(in_house), pa.array(house_in)], names=["overlap", "in_house", "house_in"])


def _plots(edges: DataFrame) -> DataFrame:
    """(parcel_id, plot): corners of each parcel in order."""
    corner = F.struct("seg", F.col("ax").cast("double").alias("x"), F.col("ay").cast("double").alias("y"))
    return edges.groupBy("parcel_id").agg(F.array_sort(F.collect_list(corner)).alias("plot"))


def setback_check(objects: DataFrame, edges: DataFrame, terrain: DataFrame, own: DataFrame, walls_: DataFrame | None = None) -> DataFrame:
    """Setback areas of planned objects against their parcel (convex or not) and against the own buildings ``own`` on it.

    outside: the most square metres of one wall's area beyond the parcel; overlap: the most that it shares with the area of a
    building's wall at 75 degrees or less to it; in_house: the object stands in a building's area; house_in: a building stands
    in the object's. Status is bad if any of them holds, by over 0.05 m2. Objects of parcels without outline have no row.
    ``walls_``: what ``setback_walls`` gives for the objects, if it is known already.
    """
    walls_ = setback_walls(objects, terrain) if walls_ is None else walls_
    o = objects.select("obj_id", "parcel_id", _corners().alias("fp")).join(walls_.select("obj_id", F.col("walls.ring").alias("rings"), F.col("walls.size").alias("sizes")), "obj_id")
    # Parcels that are not convex are clipped one by one.
    p = o.select("obj_id", "parcel_id", "rings", "sizes").join(_plots(edges), "parcel_id").withColumn("on", _on_plot("rings", "plot"))
    clipped = F.transform("rings", lambda w: F.greatest(F.lit(0.0), r.area(w) - r.clip_area(F.transform("plot", lambda c: r.point(c["x"], c["y"])), r.edges_of(w))))
    beyond = F.when(F.col("on").isNotNull(), F.zip_with("sizes", "on", lambda size, on: F.greatest(F.lit(0.0), size - on))).otherwise(clipped)
    p = p.select("obj_id", F.array_max(beyond).alias("outside"))
    met = o.select("obj_id", "parcel_id", "fp", "rings").join(house_areas(own), "parcel_id").select("obj_id", _by_house("rings", "fp", "house_walls", "house_ring").alias("m"))
    houses = met.groupBy("obj_id").agg(F.max("m.overlap").alias("overlap"), F.bool_or("m.in_house").alias("in_house"), F.bool_or("m.house_in").alias("house_in"))
    no = F.lit(False)
    out = p.join(houses, "obj_id", "left").select("obj_id", "outside", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("in_house", no).alias("in_house"), F.coalesce("house_in", no).alias("house_in"))
    bad = (F.col("outside") > SHARED) | (F.col("overlap") > SHARED) | F.col("in_house") | F.col("house_in")
    return out.withColumn("status", F.when(bad, "bad").otherwise("ok"))


#: Findings in their order; the first is the headline.
FINDINGS = ("outside", "collision", "outer_area", "size", "setback_neighbour", "setback_house", "boundary_room", "boundary_height", "boundary_side", "boundary_total")


def boundary_segments(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(parcel_id, obj_id, seg, side, distance, length) of boxes' outlines against each edge of their parcel, one row each."""
    e = edges if "side" in edges.columns else edges.withColumn("side", F.col("seg"))
    met = objects.select("parcel_id", "obj_id", "x1", "y1", "x2", "y2").join(e.select("parcel_id", "seg", "side", "ax", "ay", "bx", "by_"), "parcel_id")
    length = "((x2 - x1) * abs(bx - ax) + (y2 - y1) * abs(by_ - ay)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))"
    return met.select("parcel_id", "obj_id", "seg", "side", F.expr(s.outline_to_edge()).alias("distance"), F.expr(length).alias("length"))


def solid_inventory(inventory: DataFrame) -> DataFrame:
    """Buildings and water among the ``inventory`` that a person has seen: nothing may be put there."""
    return inventory.filter((F.col("provenance") != "erkannt") & F.col("klasse").isin(*lim.BUILDING_CLASSES, "pool", "teich"))


def placement_findings(objects: DataFrame, parcels: DataFrame, edges: DataFrame, buildings: DataFrame, inventory: DataFrame, terrain: DataFrame) -> DataFrame:
    """(obj_id, findings, headline, status) of planned sheds and carports (klasse; room, fireplace, pitch), as FINDINGS orders them.

    ``buildings``: all houses, those of the object's own parcel count for setbacks; ``inventory``: small objects with klasse and
    provenance. An object is near an edge if it keeps less than its wall facing it asks for, or 3 m. Up to 3 m of mean wall
    height, without room and fireplace, it needs no setback area. Boundary build-up counts all planned objects and the confirmed
    inventory of a parcel. Without a finding, a room or fireplace warns: fire safety is not judged.
    """
    # Three steps read the walls.
    walls_ = materialize(setback_walls(objects, terrain), "walls")
    on = objects.select("obj_id", "parcel_id", _corners().alias("fp"), F.expr("(x2 - x1) * (y2 - y1)").alias("size")).join(_plots(edges), "parcel_id").withColumn("on", _on_plot(F.array("fp"), "plot"))
    clipped = r.inside(F.col("fp"), r.edges_of(F.col("fp")), F.transform("plot", lambda c: r.point(c["x"], c["y"])))
    within = on.select("obj_id", F.when(F.col("on").isNotNull(), F.get("on", F.lit(0)) >= F.col("size") - 0.005).otherwise(clipped).alias("inside"))
    # Collisions: houses, other planned objects of the parcel, and inventory that a person has seen.
    solid = solid_inventory(inventory)
    boxes = lambda d, of: d.select("obj_id", of.alias("of"), "x1", "y1", "x2", "y2")
    none = F.lit(None).cast("long")
    block = boxes(buildings, none).unionByName(boxes(solid, none)).unionByName(boxes(objects, F.col("parcel_id").cast("long")))
    met = s.box_join(objects.select("obj_id", F.col("parcel_id").cast("long").alias("of"), "x1", "y1", "x2", "y2"), block).filter((F.col("l_obj_id") != F.col("r_obj_id")) & (F.col("r_of").isNull() | (F.col("r_of") == F.col("l_of"))))
    hit = met.filter(F.expr(g.box_overlap("l_", "r_")) > 0.01).select(F.col("l_obj_id").alias("obj_id")).distinct().withColumn("hit", F.lit(True))
    # Boundary build-up: each object with its longest extent along a side.
    counted = inventory.join(counted_inventory(inventory, edges).filter("counts").select("obj_id"), "obj_id")
    small = lambda d: d.select("parcel_id", "obj_id", "x1", "y1", "x2", "y2")
    segs = boundary_segments(small(objects).unionByName(small(counted)), edges)
    most = segs.filter(F.col("distance") < lim.SETBACK_LEAST - 1e-6).groupBy("parcel_id", "obj_id", "side").agg(F.max("length").alias("length"))
    sides = most.groupBy("parcel_id", "side").agg(F.sum("length").alias("sum"))
    total = sides.groupBy("parcel_id").agg(F.sum("sum").alias("total"))
    # The wall that faces an edge: its middle is nearest, the first of equal ones.
    mine = segs.join(objects.select("obj_id"), "obj_id", "left_semi").join(walls_.select("obj_id", "walls"), "obj_id").join(edges.select("parcel_id", "seg", "ax", "ay", "bx", "by_"), ["parcel_id", "seg"])
    middle = F.transform("walls", lambda w: F.struct(((w["ax"] + w["bx"]) / 2).alias("mx"), ((w["ay"] + w["by_"]) / 2).alias("my"), w["h7"].alias("h7"), w["h4"].alias("h4")))
    off = F.expr(f"transform(w, m -> struct({g.point_segment_distance('m.mx', 'm.my', 'ax', 'ay', 'bx', 'by_')} AS d, m.h7 AS h7, m.h4 AS h4))")
    gathered = mine.withColumn("w", middle).withColumn("w", off)
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("h7"), F.lit(0.0).alias("h4"))
    facing = F.aggregate("w", start, lambda best, w: F.when(w["d"] < best["d"] - 1e-6, w).otherwise(best))
    near = gathered.withColumn("face", facing).filter(F.col("distance") < F.greatest(F.lit(lim.SETBACK_LEAST), lim.SETBACK_FACTOR * F.col("face.h4")) - 1e-6)
    near = near.join(sides, ["parcel_id", "side"], "left").groupBy("obj_id").agg(F.lit(True).alias("near"), F.bool_or(F.col("face.h7") > lim.BOUNDARY_HEIGHT + 1e-9).alias("high"), F.bool_or(F.coalesce("sum", F.lit(0.0)) > lim.SIDE_LIMIT + 1e-6).alias("side_over"))
    check = setback_check(objects, edges, terrain, buildings, walls_).select("obj_id", "outside", ((F.col("overlap") > SHARED) | F.col("in_house") | F.col("house_in")).alias("by_house"))
    o = objects.join(parcels.select("parcel_id", "zone"), "parcel_id").join(within, "obj_id").join(walls_.select("obj_id", F.array_max(F.transform("walls", lambda w: w["h7"])).alias("h7")), "obj_id").join(check, "obj_id")
    o = o.join(hit, "obj_id", "left").join(near, "obj_id", "left").join(total, "parcel_id", "left")
    size, outer = F.expr("(x2 - x1) * (y2 - y1)"), F.col("zone") == "aussen"
    volume = size * (F.col("eaves") + F.greatest(F.lit(0.0), F.col("ridge") - F.col("eaves")) / 2)
    carport = F.col("klasse") == "carport_garage"
    plain = carport | ~(F.coalesce("room", F.lit(False)) | F.coalesce("fireplace", F.lit(False)))
    is_near = F.coalesce("near", F.lit(False))
    asks = ~(plain & (F.col("h7") <= lim.BOUNDARY_HEIGHT + 1e-9)) & ~is_near
    holds = [
        ~F.col("inside"),
        F.coalesce("hit", F.lit(False)),
        outer,
        F.when(carport, size > lim.CARPORT_AREA + 1e-9).otherwise(volume > F.when(outer, lim.OUTER_VOLUME).otherwise(lim.SHED_VOLUME) + 1e-9),
        asks & (F.col("outside") > SHARED),
        asks & F.col("by_house"),
        is_near & ~plain,
        is_near & F.col("high"),
        is_near & F.col("side_over"),
        is_near & (F.coalesce("total", F.lit(0.0)) > lim.TOTAL_LIMIT + 1e-6),
    ]
    o = o.select("obj_id", plain.alias("plain"), F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in zip(FINDINGS, holds, strict=True)])).alias("found"))
    some = F.size("found") > 0
    headline = F.when(some, F.get("found", F.lit(0))).when(F.col("plain"), "ok").otherwise("fire_safety")
    return o.select("obj_id", F.array_join("found", ",").alias("findings"), headline.alias("headline"), F.when(some, "bad").when(F.col("plain"), "ok").otherwise("warn").alias("status"))


def key_figures(objects: DataFrame) -> DataFrame:
    """Footprint, gross floor area, volume with the roof prism, and sill height."""
    area = F.expr("(x2 - x1) * (y2 - y1)")
    storeys = F.greatest(F.floor(F.col("eaves") / lim.STOREY), F.lit(1))
    return objects.select("obj_id", area.alias("footprint"), (area * storeys).alias("floor_area"), (area * (F.col("eaves") + (F.col("ridge") - F.col("eaves")) / 2)).alias("volume"), ((storeys - 1) * lim.STOREY + lim.SILL).alias("sill"))


def procedure(findings: DataFrame) -> DataFrame:
    """Procedure by precedence: position, permit, free with deviation, free; with the documents that it needs."""
    f = F.split("findings", ",")
    any_ = lambda *k: F.arrays_overlap(f, F.array(*map(F.lit, k)))
    kind = F.when(any_("outside", "collision"), "lage").when(any_("size", "outer_area"), "genehmigung").when(any_("setback", "boundary"), "frei_abweichung").otherwise("frei")
    docs = F.when(kind == "genehmigung", F.array(F.lit("lageplan"), F.lit("bauzeichnung"), F.lit("baubeschreibung"))).when(kind == "frei_abweichung", F.array(F.lit("lageplan"), F.lit("abweichungsantrag"))).otherwise(F.array().cast("array<string>"))
    return findings.select("obj_id", kind.alias("procedure"), F.array_join(docs, ",").alias("documents"))


def questions(parcels: DataFrame, findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions for the authority: each rule whose finding or zone holds for an object."""
    f = findings.join(parcels, "parcel_id").select("obj_id", F.explode(F.array_union(F.split("findings", ","), F.array("zone", "area_kind"))).alias("key"))
    return f.join(F.broadcast(rules), "key").select("obj_id", "question").distinct()


def neighbourhood(objects: DataFrame, houses: DataFrame, r: float = 100.0) -> DataFrame:
    """Least, median and greatest eaves of main buildings within ``r`` on other parcels."""
    main = houses.filter(main_building())
    mid = lambda d: d.withColumns({"x": F.expr("(x1 + x2) / 2"), "y": F.expr("(y1 + y2) / 2")})
    met = s.within_distance(mid(objects).select("obj_id", "parcel_id", "x", "y"), mid(main).select("obj_id", "parcel_id", "eaves", "x", "y"), r).filter("l_parcel_id <> r_parcel_id")
    return met.groupBy(F.col("l_obj_id").alias("obj_id")).agg(F.count("*").alias("n"), F.min("r_eaves").alias("low"), F.median("r_eaves").alias("median"), F.max("r_eaves").alias("high"))


def second_row(houses: DataFrame, roads: DataFrame, least: float, reach: float) -> DataFrame:
    """Whether a house stands in the second row: its nearest road is at least ``least`` away and another house crosses the line; null without roads."""
    mid = lambda d: d.withColumns({"x": F.expr("(x1 + x2) / 2"), "y": F.expr("(y1 + y2) / 2")})
    near = s.nearest(mid(houses), mid(roads).withColumnRenamed("obj_id", "road_id"), "obj_id", "road_id", reach)
    line = near.join(mid(houses).select("obj_id", F.col("x").alias("sx"), F.col("y").alias("sy")), "obj_id").join(mid(roads).select(F.col("obj_id").alias("road_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), "road_id", "left")
    box = line.filter("road_id IS NOT NULL").withColumns({"x1": F.least("sx", "tx"), "y1": F.least("sy", "ty"), "x2": F.greatest("sx", "tx"), "y2": F.greatest("sy", "ty")})
    met = s.box_join(box, houses.select("obj_id", "x1", "y1", "x2", "y2")).filter("l_obj_id <> r_obj_id")
    e = s.box_edges(met.select("l_obj_id", "l_sx", "l_sy", "l_tx", "l_ty", F.col("r_x1").alias("x1"), F.col("r_y1").alias("y1"), F.col("r_x2").alias("x2"), F.col("r_y2").alias("y2")), "l_obj_id", "l_sx", "l_sy", "l_tx", "l_ty")
    crossed = e.groupBy(F.col("l_obj_id").alias("obj_id")).agg(F.bool_or(F.expr(g.segments_cross(("l_sx", "l_sy", "l_tx", "l_ty"), ("ax", "ay", "bx", "by_")))).alias("crossed"))
    return near.join(crossed, "obj_id", "left").select("obj_id", F.when(F.col("road_id").isNotNull(), (F.col("distance") >= least) & F.coalesce("crossed", F.lit(False))).alias("second"))


def wall_from_roof(roofs: DataFrame, overhang: DataFrame) -> DataFrame:
    """Wall extents from roof extents minus the overhang on both sides, with the span sqrt(edge^2 + overhang^2)."""
    j = roofs.join(overhang, "provenance", "left").withColumn("o", F.coalesce("overhang", F.lit(lim.OVERHANG)))
    w = lambda a, b: F.greatest(F.col(b) - F.col(a) - 2 * F.col("o"), F.lit(0.0))
    return j.select("obj_id", w("x1", "x2").alias("length"), w("y1", "y2").alias("width"), F.sqrt(F.lit(0.01) + F.col("o") * F.col("o")).alias("span"))


def road_offset(edges: DataFrame, roads: DataFrame, most: float = 30.0, reach: float = 60.0) -> DataFrame:
    """(parcel_id, seg, shift) for each boundary edge (counter-clockwise): how far the boundary moves out to the middle of the road.

    Three probes run along the outward normal. A road counts if it begins within 0.6 m (looked at each 2 cm; up to 4 cm is
    none); it ends where the roads that join it end, at ``reach`` at most. The shift is the middle one of the probes' mid
    distances, between 0 and ``most``; edges under 1 m, or with fewer than two such probes, do not move.
    """
    length = F.expr("sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")
    p = edges.withColumn("len", length).filter("len >= 1").withColumn("share", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    p = p.selectExpr("parcel_id", "seg", "share", "ax + share * (bx - ax) AS mx", "ay + share * (by_ - ay) AS my", "(by_ - ay) / len AS nx", "(ax - bx) / len AS ny")
    box = p.selectExpr("*", f"least(mx, mx + {reach!r}D * nx) AS x1", f"least(my, my + {reach!r}D * ny) AS y1", f"greatest(mx, mx + {reach!r}D * nx) AS x2", f"greatest(my, my + {reach!r}D * ny) AS y2")
    met = s.box_join(box, roads.select("obj_id", "x1", "y1", "x2", "y2"))
    slab = lambda m, n, lo, hi, f, none: f"CASE WHEN l_{n} = 0 THEN {none} ELSE {f}((r_{lo} - l_{m}) / l_{n}, (r_{hi} - l_{m}) / l_{n}) END"
    beside = lambda m, lo, hi: f"CASE WHEN l_{m} BETWEEN r_{lo} AND r_{hi} THEN -1e9 ELSE 1e9 END"
    inside = F.expr(f"greatest({slab('mx', 'nx', 'x1', 'x2', 'least', beside('mx', 'x1', 'x2'))}, {slab('my', 'ny', 'y1', 'y2', 'least', beside('my', 'y1', 'y2'))})")
    outside = F.expr(f"least({slab('mx', 'nx', 'x1', 'x2', 'greatest', '1e9')}, {slab('my', 'ny', 'y1', 'y2', 'greatest', '1e9')})")
    spans = met.withColumns({"a": inside, "z": outside}).filter("a <= z AND z >= 0").groupBy(*[F.col(f"l_{c}").alias(c) for c in ("parcel_id", "seg", "share")])
    # A probe meets the few roads near it.
    r = spans.agg(F.collect_list(F.struct(F.round("a", 6).alias("a"), F.least(F.round("z", 6), F.lit(reach)).alias("z"))).alias("r"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: k * F.lit(0.02))
    first = F.array_min(F.filter(steps, lambda t: F.exists("r", lambda x: (x["a"] <= t) & (t <= x["z"]))))
    r = r.withColumn("s0", first).filter("s0 IS NOT NULL")
    ends = F.filter("r", lambda x: (x["z"] >= F.col("s0")) & ~F.exists("r", lambda o: (o["a"] <= x["z"]) & (x["z"] < o["z"])))
    mid = (F.when(F.col("s0") <= 0.04, 0.0).otherwise(F.col("s0")) + F.array_min(F.transform(ends, lambda x: x["z"]))) / 2
    mids = r.select("parcel_id", "seg", mid.alias("mid")).groupBy("parcel_id", "seg").agg(F.array_sort(F.collect_list("mid")).alias("m"))
    shift = F.when(F.size("m") >= 2, F.least(F.lit(most), F.greatest(F.lit(0.0), F.get("m", F.floor(F.size("m") / 2).cast("int")))))
    return edges.select("parcel_id", "seg").join(mids, ["parcel_id", "seg"], "left").select("parcel_id", "seg", F.coalesce(shift, F.lit(0.0)).alias("shift"))


#: Grid points that one step of ``start_position`` looks at, about.
POINTS = 200_000


def _best_place(box: tuple[float, float, float, float], ring: np.ndarray, held: np.ndarray, step: float, side: float) -> tuple[float, float, float] | None:
    """(x, y, gap) of one parcel's best free grid point, some grid rows at a time, the lowest first."""
    x1, y1, x2, y2 = (math.floor(v / step) for v in box)
    x = (np.arange(x1, x2 + 1) + 0.5) * step
    across, best, h = max(1, POINTS // max(1, len(x))), None, side / 2
    met = held[(held[:, 0] < x[-1] + h) & (x[0] - h < held[:, 2])] if len(x) else held
    for low in range(y1, y2 + 1, across):
        y = (np.arange(low, min(low + across, y2 + 1)) + 0.5) * step
        gap = np.full((len(y), len(x)), np.inf)
        for ax, ay, bx, by in ring.tolist():
            length = math.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
            if length > 0:
                np.minimum(gap, ((bx - ax) * (y[:, None] - ay) - (by - ay) * (x - ax)) / length, out=gap)
        gap = np.floor(gap * 1e6 + 0.5) / 1e6
        free = (gap >= side) & np.isfinite(gap)
        for ox1, oy1, ox2, oy2 in met[(met[:, 1] < y[-1] + h) & (y[0] - h < met[:, 3])].tolist():
            free &= ~(((y - h < oy2) & (oy1 < y + h))[:, None] & (x - h < ox2) & (ox1 < x + h))
        if free.any():
            # The first of equal ones is the lowest, then the leftmost.
            r, c = np.unravel_index(np.where(free, gap, -np.inf).argmax(), gap.shape)
            if best is None or gap[r, c] > best[2]:
                best = (float(x[c]), float(y[r]), float(gap[r, c]))
    return best


def start_position(parcels: DataFrame, edges: DataFrame, obstacles: DataFrame, step: float, side: float) -> DataFrame:
    """The free place of a square of ``side`` that is farthest from the boundary, ties to the lowest y, then x.

    A parcel is one row with its edges and obstacles; its grid points are array expressions and are never shuffled. Parcels without
    edges, box or free place have no row; obstacles with null corners stand nowhere.
    """
    wanted = {"box": ("x1", "y1", "x2", "y2"), "ring": ("ax", "ay", "bx", "by_"), "held": ("x1", "y1", "x2", "y2")}
    row = lambda name: F.struct(*[F.col(c).cast("double").alias(c) for c in wanted[name]])
    known = lambda d, name: d.dropna(subset=list(wanted[name]))
    ext = parcels.select("parcel_id", F.col("x0").alias("x1"), F.col("y0").alias("y1"), (F.col("x0") + F.col("w") + F.col("skew")).alias("x2"), (F.col("y0") + F.col("h")).alias("y2"))
    ring = known(edges, "ring").groupBy("parcel_id").agg(F.collect_list(row("ring")).alias("ring"))
    held = known(obstacles, "held").groupBy("parcel_id").agg(F.collect_list(row("held")).alias("held"))
    each = known(ext, "box").select("parcel_id", row("box").alias("box")).join(ring, "parcel_id").join(held, "parcel_id", "left").select("parcel_id", "box", "ring", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r_ in batch.to_pylist():
                of = lambda rows, name: np.array([[e[c] for c in wanted[name]] for e in rows or ()], np.float64).reshape(-1, 4)  # noqa: B023, E731
                best = _best_place(tuple(r_["box"].values()), of(r_["ring"], "ring"), of(r_["held"], "held"), step, side)
                if best is not None:
                    found.append((r_["parcel_id"], *best))
            cols = list(zip(*found)) or [()] * 4  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("parcel_id").type), *[pa.array(c, pa.float64()) for c in cols[1:]]], names=["parcel_id", "x", "y", "gap"])

    return spread(each, "parcel_id").mapInArrow(run, f"parcel_id {dict(each.dtypes)['parcel_id']}, x double, y double, gap double")


def project_verdict(projects: DataFrame, edges: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Four check points of a project and the worst: setback, access height, height against the neighbourhood, size. A point without data is null, never ok."""
    gap = parcel_gap(projects, edges)
    p = setback(projects.withColumn("pitch", F.lit(35.0))).join(gap, "obj_id").join(neighbours.select("obj_id", "high", "n"), "obj_id", "left")
    area = F.expr("(x2 - x1) * (y2 - y1)")
    p = p.select(
        "obj_id",
        F.when(F.col("inside") & (F.col("distance") >= F.col("depth") - 1e-6), "ok").otherwise("bad").alias("setback"),
        F.when(F.col("ridge") <= 5, "ok").otherwise("warn").alias("access"),
        F.when(F.col("high").isNull(), F.lit(None).cast("string")).when(F.col("eaves") <= F.col("high") + 1e-9, "ok").otherwise("warn").alias("fits"),
        F.when(area <= 100, "ok").otherwise("warn").alias("size"),
    )
    rank = lambda c: F.when(F.col(c) == "bad", 3).when(F.col(c) == "warn", 2).when(F.col(c).isNull(), 1).otherwise(0)
    worst = F.greatest(*map(rank, ("setback", "access", "fits", "size")))
    return p.withColumn("status", F.element_at(F.array(*map(F.lit, ("ok", "open", "warn", "bad"))), worst + 1))


def counted_inventory(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(obj_id, counts, reason) of the objects whose centre lies on their parcel: which count at the boundary, and why.

    Buildings count if a person confirmed or tapped them; whatever else a source says is a hint only. Objects off the
    parcel have no row.
    """
    mid = objects.selectExpr("obj_id", "klasse", "provenance", "parcel_id", "(x1 + x2) / 2 AS x", "(y1 + y2) / 2 AS y").join(edges.select("parcel_id", "ax", "ay", "bx", "by_"), "parcel_id")
    crossings = F.count_if(F.expr(g.ray_crossing("x", "y", "ax", "ay", "bx", "by_")))
    on = mid.groupBy("obj_id", "klasse", "provenance").agg((crossings % 2 == 1).alias("on")).filter("on")
    reason = F.when(~F.col("klasse").isin(*lim.BUILDING_CLASSES), "no_building").when(F.col("provenance") == "nutzerbestätigt", "confirmed").when(F.col("provenance") == "erfasst per Tipp", "tapped").otherwise("hint")
    return on.select("obj_id", reason.isin("confirmed", "tapped").alias("counts"), reason.alias("reason"))


def main_building() -> Column:
    """A main building has 40 m2 and more, and eaves unknown or from 3 m."""
    return (F.expr("(x2 - x1) * (y2 - y1)") >= lim.MAIN_AREA) & (F.col("eaves").isNull() | (F.col("eaves") >= lim.MAIN_EAVES))


def residential(objects: DataFrame) -> DataFrame:
    """First pass: homes by their kind of 60 to 300 m2; second: of mixed use too, of 40 to 800 m2; and whether a main building."""
    area = F.expr("(x2 - x1) * (y2 - y1)")
    home = F.startswith("kind", F.lit("31001_1"))
    mixed = home | F.startswith("kind", F.lit("31001_2"))
    return objects.select("obj_id", F.when(home & area.between(60, 300), 1).when(mixed & area.between(40, 800), 2).otherwise(0).alias("pass"), main_building().alias("main"))


def referential_check(rules: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, missing_in) of keys that only the rules or only the documents have."""
    a, b = rules.select("key").distinct(), docs.select("key").distinct()
    return a.join(b, "key", "left_anti").select("key", F.lit("docs").alias("missing_in")).unionByName(b.join(a, "key", "left_anti").select("key", F.lit("rules").alias("missing_in")))
