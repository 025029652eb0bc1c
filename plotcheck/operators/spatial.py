"""Spatial joins by grid buckets and operators on polygons as edge tables.

Boxes have columns x1, y1, x2, y2. Edges have an id, a number seg, and columns ax, ay, bx, by_. Spatial joins deal both
sides to the cells that they cover, join on the cell, test exactly, and keep a pair in one of the shared cells only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.functions.grid import row_spans
from plotcheck.operators.quantiles import exact_quantiles
from plotcheck.storage import materialize, spread


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def with_cells(df: DataFrame, size: float, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2", margin: float = 0.0) -> DataFrame:
    """A row for each cell (cx, cy) that the box, wider by ``margin``, covers."""
    at = lambda c, m: F.floor((F.col(c) + m) / size)
    xs, ys = F.sequence(at(x1, -margin), at(x2, margin)), F.sequence(at(y1, -margin), at(y2, margin))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


#: Boxes of one side in a cell that one task compares with those of the other side at most, about.
CROWD = 4096
#: Levels of cells: each doubles the size, so that the largest holds any box of a map.
LEVELS = 24


def _dealt(boxes: DataFrame, p: str, size: float, reach: float) -> DataFrame:
    """Boxes with their level: the first at which a cell is as large as the box, so that it covers four cells at most."""
    wide = F.greatest(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")) + 2 * reach
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide, F.lit(1e-9)) / size)))).cast("int")
    return boxes.withColumn("own_level", level)


def _in_cells(boxes: DataFrame, levels: DataFrame, p: str, size: float, reach: float) -> DataFrame:
    """A row for each cell (level, cx, cy) of a box, at its own level and at the higher ones among ``levels`` (level, native)."""
    at = lambda c, m: F.floor((F.col(p + c) + m) / (size * F.pow(F.lit(2.0), F.col("level"))))
    rows = boxes.join(F.broadcast(levels), F.col("level") >= F.col("own_level"))
    return rows.withColumn("cx", F.explode(F.sequence(at("x1", -reach), at("x2", reach)))).withColumn("cy", F.explode(F.sequence(at("y1", -reach), at("y2", reach))))


#: What two boxes that may meet share: a cell, and a part of it where it is crowded.
MEETING = ["level", "cx", "cy", "i", "j"]


def _meeting(left: DataFrame, right: DataFrame, size: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a box join, dealt to cells and parts of crowded cells (MEETING)."""
    a, b = _dealt(prefixed(left, "l_"), "l_", size, reach), _dealt(prefixed(right, "r_"), "r_", size, 0.0)
    # At most LEVELS + 1 rows.
    levels = a.select(F.col("own_level").alias("level")).union(b.select("own_level")).filter("level IS NOT NULL").distinct()
    a = _in_cells(a, levels, "l_", size, reach).withColumnRenamed("own_level", "l_level")
    b = _in_cells(b, levels, "r_", size, 0.0).withColumnRenamed("own_level", "r_level")
    cell = MEETING[:3]
    each = a.select(*cell, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.select(*cell, F.lit(0).alias("l"), F.lit(1).alias("r")))
    parts = lambda c: F.ceil(F.sum(c) / CROWD).cast("int")
    crowded = each.groupBy(*cell).agg(parts("l").alias("pl"), parts("r").alias("pr")).filter("(pl > 1 OR pr > 1) AND pl > 0 AND pr > 0")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    own = lambda d, p, c: F.pmod(F.xxhash64(*[x for x in d.columns if x.startswith(p)]), F.coalesce(F.col(c), F.lit(1))).cast("int")
    a = a.join(crowded, cell, "left").withColumn("i", own(a, "l_", "pl")).withColumn("j", every("pr")).drop("pl", "pr")
    b = b.join(crowded, cell, "left").withColumn("j", own(b, "r_", "pr")).withColumn("i", every("pl")).drop("pl", "pr")
    return a, b


def box_join(left: DataFrame, right: DataFrame, size: float = 50.0, reach: float = 0.0, spread: bool = False) -> DataFrame:
    """Pairs (l_*, r_*) of boxes that touch or lie within ``reach`` of each other in both directions, each once.

    Both sides are dealt to the cells that they cover; a pair counts in one of the cells that both do. With ``spread``, for boxes
    of very different sizes and for crowded places, boxes are dealt to cells of their own size (four at most on each level in
    use), two of different size meet at the level of the larger, and cells with over CROWD boxes of a side are dealt out in
    parts, which the boxes of the other side visit all; both sides are then read three times, so pass written tables.
    Boxes with null corners meet none.
    """
    near = f"l_x1 - {reach!r} <= r_x2 AND r_x1 <= l_x2 + {reach!r} AND l_y1 - {reach!r} <= r_y2 AND r_y1 <= l_y2 + {reach!r}"
    if spread:
        a, b = _meeting(left, right, size, reach)
        on, width = MEETING, size * F.pow(F.lit(2.0), F.col("level"))
    else:
        a = with_cells(prefixed(left, "l_"), size, "l_x1", "l_y1", "l_x2", "l_y2", reach)
        b = with_cells(prefixed(right, "r_"), size, "r_x1", "r_y1", "r_x2", "r_y2")
        on, width = ["cx", "cy"], F.lit(size)
    own = lambda p, q: F.floor(F.greatest(F.col(p) - reach, F.col(q)) / width)
    met = a.join(b, on).filter("greatest(l_level, r_level) = level" if spread else "true").filter(near)
    return met.filter((F.col("cx") == own("l_x1", "r_x1")) & (F.col("cy") == own("l_y1", "r_y1"))).drop(*on, "l_level", "r_level")


def ring_edges(vertices: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Edges from each vertex (seq, x, y) to the next, the last to the first."""
    w = W.partitionBy(key).orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return vertices.select(key, F.col("seq").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), nxt("x").alias("bx"), nxt("y").alias("by_"))


def polygon_measures(edges: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Signed area, perimeter, centroid and circularity of each polygon."""
    c = F.expr("ax * by_ - bx * ay")
    sums = edges.groupBy(key).agg((F.sum(c) / 2).alias("area"), F.sum(F.expr("sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")).alias("perimeter"), F.sum(c * F.expr("ax + bx")).alias("sx"), F.sum(c * F.expr("ay + by_")).alias("sy"))
    return sums.select(key, "area", "perimeter", (F.col("sx") / (6 * F.col("area"))).alias("cx"), (F.col("sy") / (6 * F.col("area"))).alias("cy"), (4 * math.pi * F.abs("area") / (F.col("perimeter") * F.col("perimeter"))).alias("circularity"))


def box_edges(boxes: DataFrame, *keys: str) -> DataFrame:
    """The four edges of each box, counter-clockwise from its lower left corner."""
    corner = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    each = [F.struct(F.lit(i).alias("seg"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(corner[(i + 1) % 4][0]).alias("bx"), F.col(corner[(i + 1) % 4][1]).alias("by_")) for i, (a, b) in enumerate(corner)]
    return boxes.withColumn("e", F.explode(F.array(*each))).select(*keys, "e.*")


def box_corners(boxes: DataFrame, *keys: str) -> DataFrame:
    return box_edges(boxes, *keys).select(*keys, F.col("seg").alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def projected_length(corners: DataFrame, edges: DataFrame, on: str = "parcel_id", key: str = "obj_id") -> DataFrame:
    """Extent of each object along each edge of its parcel."""
    along = F.expr("((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")
    return corners.join(edges, on).withColumn("p", along).groupBy(on, key, "seg").agg((F.max("p") - F.min("p")).alias("length"))


def polygon_distance(a: DataFrame, b: DataFrame, on: str, keys: tuple[str, ...]) -> DataFrame:
    """Least distance of the outlines ``a`` (aax, aay, abx, aby) and ``b`` (ax, ay, bx, by_) that share ``on``, for each ``keys``."""
    d = F.expr(g.segment_distance(("aax", "aay", "abx", "aby"), ("ax", "ay", "bx", "by_")))
    return a.join(b, on).withColumn("d", d).groupBy(*keys).agg(F.min("d").alias("distance"))


def as_outline(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.select(*keys, F.col("ax").alias("aax"), F.col("ay").alias("aay"), F.col("bx").alias("abx"), F.col("by_").alias("aby"))


def box_to_edge(box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> str:
    """Distance of a box to an edge (ax, ay, bx, by_), 0 if they meet: corners to the edge, ends to the box."""
    x1, y1, x2, y2 = box
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    turns = [g.cross("ax", "ay", "bx", "by_", x, y) for x, y in corners]
    meets = f"least(ax, bx) <= {x2} AND greatest(ax, bx) >= {x1} AND least(ay, by_) <= {y2} AND greatest(ay, by_) >= {y1} AND least({', '.join(turns)}) <= 0 AND greatest({', '.join(turns)}) >= 0"
    ends = [f"sqrt(pow(greatest(0D, {x1} - {x}, {x} - {x2}), 2) + pow(greatest(0D, {y1} - {y}, {y} - {y2}), 2))" for x, y in (("ax", "ay"), ("bx", "by_"))]
    return f"CASE WHEN {meets} THEN 0D ELSE least({', '.join([*(g.point_segment_distance(x, y, 'ax', 'ay', 'bx', 'by_') for x, y in corners), *ends])}) END"


def outline_to_edge(box: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> str:
    """Distance of a box's outline to an edge (ax, ay, bx, by_): an edge within the box keeps its distance from the sides."""
    x1, y1, x2, y2 = box
    within = f"ax > {x1} AND ax < {x2} AND ay > {y1} AND ay < {y2} AND bx > {x1} AND bx < {x2} AND by_ > {y1} AND by_ < {y2}"
    sides = ", ".join(f"{x} - {x1}, {x2} - {x}, {y} - {y1}, {y2} - {y}" for x, y in (("ax", "ay"), ("bx", "by_")))
    return f"CASE WHEN {within} THEN least({sides}) ELSE {box_to_edge(box)} END"


def side_lengths(objects: DataFrame, edges: DataFrame, reach: float = 3.0) -> DataFrame:
    """(parcel_id, seg, side): metres of each side of a parcel along which its objects nearer than ``reach`` stand; sides without any have no row.

    An object meets the edges of its parcel in one join; extent and distance are one expression each.
    """
    # A box extends along a direction by its sides' shares of it.
    length = F.expr("((x2 - x1) * abs(bx - ax) + (y2 - y1) * abs(by_ - ay)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))")
    met = objects.select("parcel_id", "x1", "y1", "x2", "y2").join(edges.select("parcel_id", "seg", "ax", "ay", "bx", "by_"), "parcel_id")
    return met.filter(F.expr(box_to_edge()) < reach).groupBy("parcel_id", "seg").agg(F.sum(length).alias("side"))


def side_occupancy(objects: DataFrame, edges: DataFrame, reach: float = 3.0, side_limit: float = 9.0, total_limit: float = 15.0) -> DataFrame:
    """Build-up of each parcel's boundary: objects nearer than ``reach`` count with their extent along the side; with both limits."""
    out = side_lengths(objects, edges, reach).groupBy("parcel_id").agg(F.max("side").alias("longest_side"), F.sum("side").alias("total"))
    ok = (F.col("longest_side") <= side_limit + 1e-9) & (F.col("total") <= total_limit + 1e-9)
    return out.withColumn("status", F.when(ok, "ok").otherwise("bad"))


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str = "parcel_id", point_key: str = "pt", size: float = 50.0) -> DataFrame:
    """(point key, polygon key) for every polygon that a point lies in, by the even-odd rule."""
    box = edges.groupBy(key).agg(F.min("ax").alias("x1"), F.min("ay").alias("y1"), F.max("ax").alias("x2"), F.max("ay").alias("y2"))
    cells = with_cells(box, size).filter("x2 >= x1")
    dealt = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    met = dealt.join(cells, ["cx", "cy"]).filter("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2").select(point_key, "x", "y", key)
    hit = F.expr(g.ray_crossing("x", "y", "ax", "ay", "bx", "by_")).cast("int")
    return met.join(edges, key).groupBy(point_key, key).agg(F.sum(F.coalesce(hit, F.lit(0))).alias("n")).filter("n % 2 = 1").select(point_key, key)


def cells_in_polygons(edges: DataFrame, key: str = "parcel_id", res: float = 1.0) -> DataFrame:
    """(key, col, row_) of the grid cells whose centre lies in the polygon, by the even-odd rule: between the crossings of each grid row."""
    ring = edges.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by_")])).alias("ring"))
    kind = dict(edges.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rings = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(rings), 64):
                found = [row_spans(np.array([[e[c] for c in ("ax", "ay", "bx", "by_")] for e in r], np.float64), res, 0.5) for r in rings[at : at + 64]]
                col, row = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                which = np.repeat(np.arange(at, at + len(found)), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(which)), pa.array(col), pa.array(row)], names=[key, "col", "row_"])

    return spread(ring, key).mapInArrow(run, f"{key} {kind}, col long, row_ long")


def within_distance(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """Pairs (l_*, r_*) of points (x, y) at most ``r`` apart, with their distance."""
    as_box = lambda d: d.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})
    d = F.expr("sqrt((l_x - r_x) * (l_x - r_x) + (l_y - r_y) * (l_y - r_y))")
    return box_join(as_box(a), as_box(b), r, r).withColumn("distance", d).filter(F.col("distance") <= r)


def exclude_near(a: DataFrame, taboo: DataFrame, r: float, key: str) -> DataFrame:
    """Rows of ``a`` that are farther than ``r`` from every point of ``taboo``."""
    near = within_distance(a.select(key, "x", "y"), taboo.select("x", "y"), r).select(F.col(f"l_{key}").alias(key)).distinct()
    return a.join(near, key, "left_anti")


def hit_within(points: DataFrame, objects: DataFrame, r: float, key: str) -> DataFrame:
    """How many known points have an object within ``r``, and their share."""
    hit = within_distance(points.select(key, "x", "y"), objects.select("x", "y"), r).select(F.col(f"l_{key}").alias(key)).distinct().withColumn("hit", F.lit(1))
    return points.join(hit, key, "left").agg(F.count("*").alias("points"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


def nearest(a: DataFrame, b: DataFrame, key: str, other: str, r: float) -> DataFrame:
    """The nearest point of ``b`` within ``r`` of each of ``a``, ties to the smaller id; null where there is none."""
    met = within_distance(a.select(key, "x", "y"), b.select(other, "x", "y"), r)
    best = met.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min(F.struct("distance", f"r_{other}")).alias("m"))
    return a.select(key).join(best, key, "left").select(key, F.col(f"m.r_{other}").alias(other), F.col("m.distance").alias("distance"))


def collisions(objects: DataFrame, obstacles: DataFrame, tol: float = 0.05) -> DataFrame:
    """Objects and obstacles that share more than ``tol`` of area; hedges and trees are hints only."""
    met = box_join(objects, obstacles).withColumn("area", F.expr(g.box_overlap("l_", "r_"))).filter((F.col("area") > tol) & (F.col("l_obj_id") != F.col("r_obj_id")))
    kind = F.when(F.col("r_klasse").isin("hecke", "baum"), "hint").otherwise("collision")
    return met.select(F.col("l_obj_id").alias("obj_id"), F.col("r_obj_id").alias("obstacle_id"), "area", kind.alias("kind"))


def line_of_sight(pairs: DataFrame, buildings: DataFrame, size: float = 50.0, lean: float = 3.0) -> DataFrame:
    """``pairs`` (pair, sx, sy, tx, ty, and perhaps target) with screening: 0 free, 5 crossed, 15 if the source stands by a crossed building.

    A building is crossed by the line between its ends, or by an end within it; by it stands what is nearer than ``lean``.
    Eaves below 2 m do not screen, nor does the building named ``target``; unknown eaves do.
    """
    box = pairs.withColumns({"x1": F.least("sx", "tx"), "y1": F.least("sy", "ty"), "x2": F.greatest("sx", "tx"), "y2": F.greatest("sy", "ty")})
    met = box_join(box, buildings.filter("eaves IS NULL OR eaves >= 2"), size)
    if "target" in pairs.columns:
        met = met.filter(~F.col("l_target").eqNullSafe(F.col("r_obj_id")))
    within = lambda p: f"(l_{p}x > r_x1 AND l_{p}x < r_x2 AND l_{p}y > r_y1 AND l_{p}y < r_y2)"
    met = met.withColumn("held", F.expr(f"{within('s')} OR {within('t')}"))
    edges = box_edges(met.select("l_pair", "l_sx", "l_sy", "l_tx", "l_ty", "r_obj_id", "held", F.col("r_x1").alias("x1"), F.col("r_y1").alias("y1"), F.col("r_x2").alias("x2"), F.col("r_y2").alias("y2")), "l_pair", "l_sx", "l_sy", "l_tx", "l_ty", "r_obj_id", "held")
    crosses = F.expr(g.segments_cross(("l_sx", "l_sy", "l_tx", "l_ty"), ("ax", "ay", "bx", "by_")))
    leans = F.expr(g.point_segment_distance("l_sx", "l_sy", "ax", "ay", "bx", "by_") + f" < {lean!r}")
    each = edges.groupBy(F.col("l_pair").alias("pair"), "r_obj_id", "held").agg(F.bool_or(crosses).alias("crossed"), F.bool_or(leans).alias("leans"))
    db = F.when(F.col("crossed") | F.col("held"), F.when(F.col("leans"), 15).otherwise(5)).otherwise(0)
    seen = each.groupBy("pair").agg(F.max(db).alias("db"))
    return pairs.join(seen, "pair", "left").select("pair", F.coalesce("db", F.lit(0)).alias("screening"))


def owner_dedupe(objects: DataFrame, block: float = 250.0, halo: float = 15.0) -> DataFrame:
    """Objects as blocks with a halo see them, kept only by the block whose half-open core holds their centre."""
    seen = with_cells(objects, block, margin=halo)
    own = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / block)
    return seen.filter((F.col("cx") == own("x1", "x2")) & (F.col("cy") == own("y1", "y2")))


def nearest_window(points: DataFrame, step: float = 48.0, width: float = 96.0) -> DataFrame:
    """The grid window of ``width`` whose centre is nearest to each point."""
    at = lambda c: F.floor((F.col(c) - width / 2) / step + 0.5)
    return points.withColumns({"wx": at("x"), "wy": at("y")})


def windows_for_extent(extents: DataFrame, margin: float, step: float = 48.0, width: float = 96.0) -> DataFrame:
    """Every window that a point of the extent, wider by ``margin``, could use."""
    at = lambda c, m: F.floor((F.col(c) + m - width / 2) / step + 0.5)
    return extents.withColumn("wx", F.explode(F.sequence(at("x1", -margin), at("x2", margin)))).withColumn("wy", F.explode(F.sequence(at("y1", -margin), at("y2", margin))))


def area_attributes(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    """(parcel_id, klasse) of the zones that hold the centre or a corner of each parcel, each once."""
    probe = parcels.withColumn("p", F.explode(F.expr("array(struct(x0 AS x, y0 AS y), struct(x0 + w AS x, y0 AS y), struct(x0 + w + skew AS x, y0 + h AS y), struct(x0 AS x, y0 + h AS y), struct(x0 + (w + skew / 2) / 2 AS x, y0 + h / 2 AS y))")))
    as_box = probe.select("parcel_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    return box_join(as_box, zones).select(F.col("l_parcel_id").alias("parcel_id"), F.col("r_klasse").alias("klasse")).dropDuplicates()


def sample_raster(points: DataFrame, centre: DataFrame, raster: DataFrame, r: float, res: float, default: float) -> DataFrame:
    """Points within ``r`` of a centre with the raster value of their cell, ``default`` where there is none."""
    met = within_distance(centre, points, r)
    at = met.withColumns({"col": F.floor(F.col("r_x") / res), "row_": F.floor(F.col("r_y") / res)})
    return at.join(raster.select("col", "row_", "z"), ["col", "row_"], "left").withColumn("z", F.coalesce("z", F.lit(default)))


def snap_points(points: DataFrame, edges: DataFrame, tol: float, on: str = "parcel_id") -> DataFrame:
    """Points moved to the nearest corner of their outline within ``tol``, else to the nearest edge within 0.6 ``tol``."""
    t = g.segment_point("x", "y", "ax", "ay", "bx", "by_")
    met = points.join(edges, on).withColumns({"dc": F.expr("sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))"), "de": F.expr(g.point_segment_distance("x", "y", "ax", "ay", "bx", "by_")), "ex": F.expr(f"ax + {t} * (bx - ax)"), "ey": F.expr(f"ay + {t} * (by_ - ay)")})
    best = met.groupBy("pt", "x", "y").agg(F.min(F.struct("dc", "seg", "ax", "ay")).alias("c"), F.min(F.struct("de", "seg", "ex", "ey")).alias("e"))
    pick = lambda a, b, c: F.when(F.col("c.dc") <= tol, F.col(a)).when(F.col("e.de") <= 0.6 * tol, F.col(b)).otherwise(F.col(c))
    return best.select("pt", pick("c.ax", "e.ex", "x").alias("sx"), pick("c.ay", "e.ey", "y").alias("sy"))


def is_simple(edges: DataFrame, key: str = "parcel_id") -> DataFrame:
    """False for polygons of which two edges that are not neighbours cross."""
    n = edges.groupBy(key).agg(F.count("*").alias("n"))
    a, b = as_outline(edges, key, F.col("seg").alias("sa")), edges
    met = a.join(b, key).join(n, key).filter("sa < seg AND seg - sa > 1 AND NOT (sa = 0 AND seg = n - 1)")
    crosses = F.expr(g.segments_cross(("aax", "aay", "abx", "aby"), ("ax", "ay", "bx", "by_")))
    bad = met.groupBy(key).agg(F.bool_or(crosses).alias("bad"))
    return n.join(bad, key, "left").select(key, (~F.coalesce("bad", F.lit(False))).alias("simple"))


def dominant_angle(edges: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Direction of the longest edge in degrees, folded to (-45, 45]; the first of equal edges counts."""
    length = F.expr("round(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 6)")
    angle = F.degrees(F.atan2(F.expr("by_ - ay"), F.expr("bx - ax")))
    best = edges.groupBy(key).agg(F.max_by(angle, F.struct(length, -F.col("seg"))).alias("a"))
    return best.select(key, (F.col("a") - 90 * F.ceil((F.col("a") - 45) / 90)).alias("angle"))


def group_sides(edges: DataFrame, bend: float = 25.0, key: str = "parcel_id") -> DataFrame:
    """Edges with the number of their side: edges in a row whose direction changes by less than ``bend`` degrees, round the ring."""
    w = W.partitionBy(key).orderBy("seg")
    all_ = W.partitionBy(key)
    angle = F.degrees(F.atan2(F.expr("by_ - ay"), F.expr("bx - ax")))
    e = edges.withColumn("angle", angle)
    before = F.coalesce(F.lag("angle").over(w), F.last("angle").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    turn = F.abs(F.pmod(F.col("angle") - before + 540.0, F.lit(360.0)) - 180)
    e = e.withColumn("breaks", (turn >= bend).cast("int"))
    run = F.sum("breaks").over(w.rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumns({"run": run, "runs": F.sum("breaks").over(all_)})
    # Edges before the first bend belong to the last side.
    side = F.when(F.col("runs") == 0, F.lit(0)).when(F.col("run") == 0, F.col("runs") - 1).otherwise(F.col("run") - 1)
    return e.select(key, "seg", side.cast("int").alias("side"))


def side_names(edges: DataFrame, sides: DataFrame, key: str = "parcel_id") -> DataFrame:
    """(key, side, name): compass name of each side's outward normal, weighted by length; equal names are numbered."""
    e = edges.drop("side").join(sides, [key, "seg"])
    normal = e.groupBy(key, "side").agg(F.sum(F.expr("by_ - ay")).alias("nx"), F.sum(F.expr("ax - bx")).alias("ny"))
    name = F.expr("CASE WHEN abs(ny) >= abs(nx) THEN CASE WHEN ny > 0 THEN 'Nord' ELSE 'Süd' END ELSE CASE WHEN nx > 0 THEN 'Ost' ELSE 'West' END END")
    nth = F.row_number().over(W.partitionBy(key, "base").orderBy("side"))
    n = normal.withColumn("base", name).withColumn("nth", nth)
    return n.select(key, "side", F.when(F.col("nth") > 1, F.concat_ws(" ", "base", "nth")).otherwise(F.col("base")).alias("name"))


def min_rotated_rect(vertices: DataFrame, *keys: str) -> DataFrame:
    """The least rectangle round each vertex set that is parallel to a pair of vertices: length, width, angle, and the share it fills of ``area``, if given."""
    a = vertices.select(*keys, "seq", "x", "y")
    b = vertices.select(*keys, F.col("seq").alias("s2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    norm = F.expr("sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))")
    d = a.join(b, [*keys]).filter("seq < s2").withColumn("norm", norm).filter("norm > 0").select(*keys, "seq", "s2", (F.expr("x2 - x") / F.col("norm")).alias("ux"), (F.expr("y2 - y") / F.col("norm")).alias("uy"))
    p = d.join(vertices.select(*keys, "x", "y"), [*keys])
    span = lambda e: F.max(F.expr(e)) - F.min(F.expr(e))
    r = p.groupBy(*keys, "seq", "s2", "ux", "uy").agg(span("x * ux + y * uy").alias("u"), span("y * ux - x * uy").alias("v"))
    r = r.withColumn("rect", F.struct(F.round(F.col("u") * F.col("v"), 6).alias("area"), F.col("seq"), F.col("s2"), F.greatest("u", "v").alias("length"), F.least("u", "v").alias("width")))
    return r.groupBy(*keys).agg(F.min("rect").alias("rect")).select(*keys, "rect.length", "rect.width", "rect.area")


def overlap_area(convex_a: DataFrame, convex_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared area of convex, counter-clockwise polygons: ``pairs`` (a_id, b_id), edges with a_id or b_id.

    The shared polygon's corners are the corners of one inside the other and the crossings of edges, in the order of
    their angle round their mean.
    """
    a, b = pairs.join(convex_a, "a_id"), pairs.join(convex_b, "b_id")
    edge = lambda d, p: d.select("a_id", "b_id", *[F.col(c).alias(p + c) for c in ("seg", "ax", "ay", "bx", "by_")])
    met = edge(a, "p").join(edge(b, "q"), ["a_id", "b_id"])
    inside = lambda px, py, q: F.expr(g.cross(f"{q}ax", f"{q}ay", f"{q}bx", f"{q}by_", px, py) + " >= -1e-9")
    in_b = met.groupBy("a_id", "b_id", F.col("pax").alias("x"), F.col("pay").alias("y")).agg(F.bool_and(inside("pax", "pay", "q")).alias("ok"))
    in_a = met.groupBy("a_id", "b_id", F.col("qax").alias("x"), F.col("qay").alias("y")).agg(F.bool_and(inside("qax", "qay", "p")).alias("ok"))
    den = "((pbx - pax) * (qby_ - qay) - (pby_ - pay) * (qbx - qax))"
    t = f"(((qax - pax) * (qby_ - qay) - (qay - pay) * (qbx - qax)) / nullif({den}, 0))"
    u = f"(((qax - pax) * (pby_ - pay) - (qay - pay) * (pbx - pax)) / nullif({den}, 0))"
    cut = met.filter(f"{t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1").select("a_id", "b_id", F.expr(f"pax + {t} * (pbx - pax)").alias("x"), F.expr(f"pay + {t} * (pby_ - pay)").alias("y"))
    corners = in_b.filter("ok").drop("ok").union(in_a.filter("ok").drop("ok")).union(cut)
    corners = corners.select("a_id", "b_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).distinct()
    w = W.partitionBy("a_id", "b_id")
    c = corners.withColumns({"mx": F.avg("x").over(w), "my": F.avg("y").over(w)}).withColumn("angle", F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")))
    o = w.orderBy("angle", "x", "y")
    c = c.withColumns({"nx": F.coalesce(F.lead("x").over(o), F.first("x").over(o)), "ny": F.coalesce(F.lead("y").over(o), F.first("y").over(o))})
    return c.groupBy("a_id", "b_id").agg((F.sum(F.expr("x * ny - nx * y")) / 2).alias("area")).filter("area > 0")


def tile_extents(objects: DataFrame, size: float = 250.0, tiles: int = 8) -> DataFrame:
    """Box and count of the objects of each tile (by centre, clamped to the area), and of all tiles together."""
    at = lambda a, b: F.least(F.greatest(F.floor((F.col(a) + F.col(b)) / 2 / size), F.lit(0)), F.lit(tiles - 1))
    t = objects.withColumns({"tx": at("x1", "x2"), "ty": at("y1", "y2")})
    agg = [F.count("*").alias("n"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.grouping_id("tx", "ty").alias("level")]
    return t.rollup("tx", "ty").agg(*agg).filter("level IN (0, 3)")


def tile_qc(points: DataFrame, size: float = 1000.0) -> DataFrame:
    """Points, density and whether all lie in their tile, for each tile."""
    t = points.withColumns({"kx": F.floor(F.col("x") / size), "ky": F.floor(F.col("y") / size)})
    inside = F.expr(f"x >= kx * {size!r} - 1 AND x <= (kx + 1) * {size!r} + 1 AND y >= ky * {size!r} - 1 AND y <= (ky + 1) * {size!r} + 1")
    return t.groupBy("kx", "ky").agg(F.count("*").alias("n"), (F.count("*") / (size * size)).alias("density"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.bool_and(inside).alias("inside"))


def nearest_gap(a: DataFrame, b: DataFrame, key: str, r: float, first: float = 2.5) -> DataFrame:
    """(key, distance) from each point of ``a`` to the nearest of ``b`` within ``r``; points without one have no row.

    Looks within ``first`` metres, or less where the clouds are dense, so that a point meets few others; then four times as far
    for those that found none, and so on.
    """
    left, others = materialize(a.select(key, "x", "y"), "points"), materialize(b.select("x", "y").distinct(), "points")
    found, reach = None, min(first, r)
    # How many others a point meets in a cell of the first size, on average; with the size they grow by its square.
    per_cell = lambda d, n: d.groupBy(F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy")).agg(F.count("*").alias(n))
    met = per_cell(left, "p").join(per_cell(others, "q"), ["cx", "cy"]).agg((F.sum(F.col("p").cast("double") * F.col("q")) / F.sum("p")).alias("met")).first()[0]
    reach = reach / math.sqrt(max(1.0, met or 0.0))
    as_box = lambda d: d.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})
    d = F.expr("sqrt((l_x - r_x) * (l_x - r_x) + (l_y - r_y) * (l_y - r_y))")
    while True:
        # Cells of twice the reach: a point is dealt to four of them at most.
        met = box_join(as_box(left), as_box(others), 2 * reach, reach).withColumn("distance", d).filter(F.col("distance") <= reach)
        met = materialize(met.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min("distance").alias("distance")), "gaps")
        found = met if found is None else found.unionByName(met)
        if reach >= r:
            return found
        left = materialize(left.join(met.select(key), key, "left_anti"), "points", replaces=left)
        reach = min(r, 4 * reach)


def cloud_distance(a: DataFrame, b: DataFrame, r: float = 40.0) -> DataFrame:
    """Median and 90th percentile of the nearest distance from ``a`` to ``b`` and back, within ``r``, over points (x, y).

    Points of one place are one row with their number, as all of them are equally far.
    """
    places = lambda d: materialize(d.groupBy("x", "y").agg(F.count("*").alias("points")).withColumn("place", F.monotonically_increasing_id()), "places")
    a, b = places(a), places(b)

    def one(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        far = nearest_gap(p, q, "place", r).join(p.select("place", "points"), "place")
        d = far.select("distance", F.explode(F.expr("array_repeat(1, CAST(points AS INT))"))).select("distance")
        at = exact_quantiles(d, {"median": ("distance", 0.5), "p90": ("distance", 0.9)})
        return far.agg(F.coalesce(F.sum("points"), F.lit(0)).alias("n")).select(F.lit(name).alias("direction"), "n", F.lit(at["median"]).cast("double").alias("median"), F.lit(at["p90"]).cast("double").alias("p90"))

    return one(a, b, "accuracy").unionByName(one(b, a, "completeness"))


def grid_blocks(cells: DataFrame, k: int) -> DataFrame:
    """Cells with the block of ``k`` cells that they belong to; a cell on a shared edge belongs to both blocks."""
    own = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / k), F.greatest(F.floor((F.col(c) - 1) / k), F.lit(0))))
    return cells.withColumn("bx", F.explode(own("col"))).withColumn("by_", F.explode(own("row_")))


def to_local(points: DataFrame, origin: tuple[float, float], digits: int = 2) -> DataFrame:
    return points.withColumns({"x": F.round(F.col("x") - origin[0], digits), "y": F.round(F.col("y") - origin[1], digits)})


def counter_clockwise(vertices: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Rings turned counter-clockwise where they are not."""
    area = polygon_measures(ring_edges(vertices, key), key).select(key, "area")
    w = W.partitionBy(key)
    v = vertices.join(area, key).withColumn("n", F.count("*").over(w))
    return v.select(key, F.when(F.col("area") < 0, F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq")).cast("int").alias("seq"), "x", "y")


def side_contact(objects: DataFrame, edges: DataFrame, reach: float = 1.0) -> DataFrame:
    """Sides that each object is at most ``reach`` away from; side -1 for objects inside."""
    near = polygon_distance(as_outline(box_edges(objects, "parcel_id", "obj_id"), "parcel_id", "obj_id"), edges, "parcel_id", ("parcel_id", "obj_id", "seg")).filter(F.col("distance") <= reach + 1e-9)
    touched = near.select("obj_id", F.col("seg").alias("side"))
    return objects.select("obj_id").join(touched, "obj_id", "left").select("obj_id", F.coalesce("side", F.lit(-1)).alias("side"))
