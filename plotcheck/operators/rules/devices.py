"""Device catalogues, noise, plants, sun and access."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotcheck.functions import geometry as g
from plotcheck.operators import spatial as s
from plotcheck.operators.rules import limits as lim


def clean_device_catalog(raw: DataFrame) -> DataFrame:
    """Outdoor devices with a plausible sound power; kilowatts as numbers."""
    lw = F.col("lw").try_cast("double")
    return raw.filter(F.startswith("source_type", F.lit("Outdoor"))).withColumn("lw", lw).filter(F.col("lw").between(35, 80))


def clean_device_pages(pages: DataFrame) -> DataFrame:
    """(id, maker, lw) from JSON pages with fields of alternative names, 35 to 90 dB."""
    j = lambda *names: F.coalesce(*[F.get_json_object("page", f"$.{n}") for n in names])
    d = pages.select("id", j("supplierOrTrademark", "supplier", "brand").alias("maker"), j("outdoorNoise", "noiseOutdoor", "noise").try_cast("double").alias("lw"))
    return d.filter(F.col("lw").between(35, 90))


def level(lw: Column, q: Column, r: Column, screening: Column) -> Column:
    """Sound pressure level at distance r."""
    return lw + 10 * F.log10(q) - 11 - 20 * F.log10(F.greatest(r, F.lit(lim.LEAST_RADIUS))) - screening


def limit_radius(lw: Column, q: Column, limit: Column) -> Column:
    return F.pow(F.lit(10.0), (lw + 10 * F.log10(q) - 11 - limit) / 20)


def device_placement(devices: DataFrame, buildings: DataFrame) -> DataFrame:
    """frei, wand or ecke by the walls nearer than 3 m: a corner has two that are not parallel."""
    as_box = devices.selectExpr("dev", "x", "y", "x AS x1", "y AS y1", "x AS x2", "y AS y2")
    met = s.box_join(as_box, buildings.select("obj_id", "x1", "y1", "x2", "y2"), 50.0, lim.WALL_REACH)
    e = s.box_edges(met.select("l_dev", "l_x", "l_y", F.col("r_x1").alias("x1"), F.col("r_y1").alias("y1"), F.col("r_x2").alias("x2"), F.col("r_y2").alias("y2")), "l_dev", "l_x", "l_y")
    near = e.filter(F.expr(g.point_segment_distance("l_x", "l_y", "ax", "ay", "bx", "by_") + f" < {lim.WALL_REACH!r} AND (ax <> bx OR ay <> by_)"))
    d = near.groupBy(F.col("l_dev").alias("dev")).agg(F.count_distinct(F.col("seg") % 2).alias("directions"))
    return devices.select("dev").join(d, "dev", "left").select("dev", F.when(F.col("directions") >= 2, "ecke").when(F.col("directions") == 1, "wand").otherwise("frei").alias("place"))


def assumed_receivers(devices: DataFrame, houses: DataFrame) -> DataFrame:
    """(dev, house, r, rx, ry): the nearest point of each neighbour's house of eaves 2 m and more, not a party wall, within 35 m."""
    as_box = devices.selectExpr("dev", "parcel_id", "x", "y", "x AS x1", "y AS y1", "x AS x2", "y AS y2")
    met = s.box_join(as_box, houses.filter(F.col("eaves") >= lim.RECEIVER_HEIGHT).select("obj_id", "parcel_id", "x1", "y1", "x2", "y2"), 50.0, lim.RECEIVER_REACH).filter("l_parcel_id <> r_parcel_id")
    near = met.withColumns({"rx": F.expr("least(greatest(l_x, r_x1), r_x2)"), "ry": F.expr("least(greatest(l_y, r_y1), r_y2)")}).withColumn("r", F.expr("sqrt((rx - l_x) * (rx - l_x) + (ry - l_y) * (ry - l_y))"))
    return near.filter(F.col("r").between(0.5, lim.RECEIVER_REACH)).select(F.col("l_dev").alias("dev"), F.col("r_obj_id").alias("house"), "r", "rx", "ry")


def noise_verdict(devices: DataFrame, receivers: DataFrame, places: DataFrame, sight: DataFrame) -> DataFrame:
    """The loudest receiver decides against the night limit of the area; under 3 dB below warns, and so does having no receiver."""
    pick = lambda table, column: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)]
    d = devices.join(places, "dev").withColumns({"q": pick(lim.DIRECTIVITY, "place"), "limit": pick(lim.NIGHT, "area_kind")})
    r = d.join(receivers, "dev", "left").join(sight, ["dev", "house"], "left")
    lp = F.round(level(F.col("lw"), F.col("q"), F.col("r"), F.coalesce("screening", F.lit(0))), 9)
    loud = r.withColumn("lp", lp).groupBy("dev", "limit").agg(F.max("lp").alias("lp"), F.max_by("house", F.struct("lp", -F.col("house"))).alias("house"))
    status = F.when(F.col("lp").isNull(), "warn").when(F.col("lp") > F.col("limit"), "bad").when(F.col("lp") > F.col("limit") - lim.NOISE_MARGIN, "warn").otherwise("ok")
    return loud.select("dev", "house", "lp", "limit", status.alias("status"))


def plant_verdict(plants: DataFrame, edges: DataFrame, sides: DataFrame) -> DataFrame:
    """(obj_id, side, distance, need, exemption, status, max_height) of each plant (x, y, height), by the side that decides.

    ``sides`` (parcel_id, side, road, fence, forest) says what lies beyond: a road, and a fence at least as high as the
    plant, exempt a side; towards a forest 0.5 m always do. Else plants up to 2 m need 0.5 m, taller ones 2 m. Below the
    need is bad, less than 0.1 m above it warns; a plant off its parcel is bad, at distance 0. The side that decides has
    the least distance beyond its need, exempt ones last. max_height is what all sides allow there, null without limit.
    """
    met = plants.join(edges, "parcel_id").withColumns({"d": F.expr(g.point_segment_distance("x", "y", "ax", "ay", "bx", "by_")), "c": F.expr(g.ray_crossing("x", "y", "ax", "ay", "bx", "by_")).cast("int")})
    per = met.groupBy("parcel_id", "obj_id", "height", "side").agg(F.min("d").alias("d"), F.sum("c").alias("c"))
    inside = per.groupBy("obj_id").agg((F.sum("c") % 2 == 1).alias("inside"))
    a = per.join(sides, ["parcel_id", "side"], "left").join(inside, "obj_id")
    forest, fence = F.coalesce("forest", F.lit(False)), F.coalesce("fence", F.lit(0.0))
    exempt = F.when(F.coalesce("road", F.lit(False)), "road").when((fence > 0) & (F.col("height") <= fence + 1e-9), "fence")
    a = a.withColumns({"distance": F.when(F.col("inside"), F.round("d", 6)).otherwise(0.0), "exemption": exempt})
    need = F.when(F.col("exemption").isNotNull(), 0.0).when(forest, lim.FOREST).when(F.col("height") > lim.PLANT_HEIGHT + 1e-9, lim.PLANT_TALL).otherwise(lim.PLANT_SMALL)
    here = F.col("distance") + 1e-9
    most = F.when(here < lim.PLANT_SMALL, 0.0).when(forest, lim.NO_LIMIT).when(here < lim.PLANT_TALL, lim.PLANT_HEIGHT).otherwise(lim.NO_LIMIT)
    a = a.withColumns({"need": need, "allowed": F.when(F.col("exemption") == "road", lim.NO_LIMIT).when(F.col("exemption") == "fence", F.greatest(most, fence)).otherwise(most)})
    bad = F.when(F.col("exemption").isNotNull(), 0).when(here < F.col("need"), 2).when(F.col("distance") - F.col("need") < lim.PLANT_WARN - 1e-9, 1).otherwise(0)
    first = F.struct(F.col("exemption").isNotNull().alias("e"), F.round(F.col("distance") - F.col("need"), 6).alias("m"), "side")
    out = a.groupBy("obj_id").agg(F.min_by(F.struct("side", "distance", "need", "exemption"), first).alias("b"), F.max(bad).alias("bad"), F.bool_and("inside").alias("inside"), F.min("allowed").alias("allowed"))
    status = F.when(~F.col("inside") | (F.col("bad") == 2), "bad").when(F.col("bad") == 1, "warn").otherwise("ok")
    return out.select("obj_id", "b.side", "b.distance", "b.need", F.coalesce("b.exemption", F.lit("")).alias("exemption"), status.alias("status"), F.nullif("allowed", F.lit(lim.NO_LIMIT)).alias("max_height"))


def existing_plants(plants: DataFrame, edges: DataFrame, span: float) -> DataFrame:
    """Nearest side that is no road and whether the distance is surely above, surely below or unclear within ``span``."""
    d = plants.join(edges.filter("side <> 0"), "parcel_id").withColumn("d", F.expr(g.point_segment_distance("x", "y", "ax", "ay", "bx", "by_")))
    near = d.groupBy("obj_id", "height").agg(F.min(F.struct(F.round("d", 6).alias("d"), "side")).alias("m"))
    need = F.when(F.col("height") <= lim.PLANT_HEIGHT + 1e-9, lim.PLANT_SMALL).otherwise(lim.PLANT_TALL)
    c = F.when(F.col("m.d") - span >= need, "above").when(F.col("m.d") + span < need, "below").otherwise("unclear")
    return near.select("obj_id", "m.side", F.col("m.d").alias("distance"), c.alias("result"))


def sun_position(times: DataFrame, lat: float = lim.LATITUDE, lon: float = lim.LONGITUDE) -> DataFrame:
    """Altitude and azimuth in degrees at UTC times ``t``, by the series of the Astronomical Almanac."""
    n = (F.unix_seconds("t") - 946728000) / 86400.0
    d = times.withColumn("n", n)
    d = d.withColumns({"l": F.expr("radians(pmod(280.460 + 0.9856474 * n, 360.0))"), "g": F.expr("radians(pmod(357.528 + 0.9856003 * n, 360.0))")})
    d = d.withColumn("lam", F.expr("l + radians(1.915) * sin(g) + radians(0.020) * sin(2 * g)")).withColumn("eps", F.expr("radians(23.439 - 0.0000004 * n)"))
    d = d.withColumns({"ra": F.expr("atan2(cos(eps) * sin(lam), cos(lam))"), "dec": F.expr("asin(sin(eps) * sin(lam))"), "gmst": F.expr("pmod(6.697375 + 0.0657098242 * n + pmod((unix_seconds(t) % 86400) / 3600.0, 24.0), 24.0)")})
    d = d.withColumn("ha", F.expr(f"radians(gmst * 15 + {lon!r}) - ra"))
    lat_ = f"radians({lat!r})"
    d = d.withColumn("alt", F.expr(f"degrees(asin(sin({lat_}) * sin(dec) + cos({lat_}) * cos(dec) * cos(ha)))"))
    return d.withColumn("az", F.expr(f"pmod(degrees(atan2(-sin(ha), cos({lat_}) * tan(dec) - sin({lat_}) * cos(ha))), 360.0)")).select(*times.columns, "alt", "az")


def day_times(df: DataFrame, day: str, minutes: int = lim.SUN_STEP_MIN) -> DataFrame:
    """One row for each step of the UTC day."""
    return df.withColumn("t", F.explode(F.expr(f"sequence(to_timestamp({day}), to_timestamp({day}) + INTERVAL 1 DAY - INTERVAL {minutes} MINUTE, INTERVAL {minutes} MINUTE)")))


def sun_places(days: DataFrame) -> DataFrame:
    """The sun's place at each step of each day while it stands at 5 degrees at least: a table of fixed size for each day."""
    return sun_position(day_times(days, "day")).filter(F.col("alt") >= lim.SUN_ALTITUDE).select("day", "t", "alt", "az")


#: Steps of a day that one word of bits holds.
WORD = 48


def lit_steps(points: DataFrame, bodies: DataFrame, sun: DataFrame, reach: float | None = None) -> DataFrame:
    """(pt, day, word, lit): bits of the steps of the day at which no body (box with height) stands across the ray from a point (pt, x, y, z) to the sun.

    Word w has the steps from w * WORD on, the first in the lowest bit; words without sun have no row. A body reaches as far as
    its shadow at the lowest sun that counts, height / tan(5 degrees) above the lowest point; ``reach`` bounds it to fewer metres.
    """
    longest = F.greatest(F.col("height") - F.col("low"), F.lit(0.0)) / math.tan(math.radians(lim.SUN_ALTITUDE))
    far = F.least(longest, F.lit(math.inf if reach is None else reach))
    wide = bodies.select("obj_id", "x1", "y1", "x2", "y2", "height").crossJoin(F.broadcast(points.agg(F.min("z").alias("low")))).withColumn("far", far)
    wide = wide.selectExpr("obj_id", "height", "far", "x1 AS bx1", "y1 AS by1", "x2 AS bx2", "y2 AS by2", "x1 - far AS x1", "y1 - far AS y1", "x2 + far AS x2", "y2 + far AS y2")
    met = s.box_join(points.selectExpr("pt", "x", "y", "z", "x AS x1", "y AS y1", "x AS x2", "y AS y2"), wide, 60.0).filter("r_height > l_z")
    near = met.selectExpr("l_pt", "l_x", "l_y", "l_z", "r_height", "r_far", "r_bx1 AS r_x1", "r_by1 AS r_y1", "r_bx2 AS r_x2", "r_by2 AS r_y2")
    # What depends on the sun alone is computed once a step.
    step = F.floor((F.unix_seconds("t") - F.unix_seconds(F.col("day").cast("timestamp"))) / (60 * lim.SUN_STEP_MIN)).cast("int")
    places = sun.withColumns({"dx": F.sin(F.radians("az")), "dy": F.cos(F.radians("az")), "slope": F.tan(F.radians("alt")), "word": F.floor(step / WORD).cast("int"), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), step % WORD)})
    ray = near.crossJoin(F.broadcast(places))
    lo = lambda a, o, c: F.expr(f"CASE WHEN abs({c}) < 1e-12 THEN CASE WHEN {o} BETWEEN r_{a}1 AND r_{a}2 THEN -1e18 ELSE 1e18 END ELSE least((r_{a}1 - {o}) / {c}, (r_{a}2 - {o}) / {c}) END")
    hi = lambda a, o, c: F.expr(f"CASE WHEN abs({c}) < 1e-12 THEN CASE WHEN {o} BETWEEN r_{a}1 AND r_{a}2 THEN 1e18 ELSE -1e18 END ELSE greatest((r_{a}1 - {o}) / {c}, (r_{a}2 - {o}) / {c}) END")
    enter = F.greatest(lo("x", "l_x", "dx"), lo("y", "l_y", "dy"), F.lit(0.05))
    leave = F.least(hi("x", "l_x", "dx"), hi("y", "l_y", "dy"), F.col("r_far"))
    blocked = ray.filter((enter <= leave) & (F.col("l_z") + enter * F.col("slope") < F.col("r_height"))).groupBy(F.col("l_pt").alias("pt"), "day", "word").agg(F.bit_or("bit").alias("blocked"))
    up = places.groupBy("day", "word").agg(F.bit_or("bit").alias("up"))
    lit = F.col("up").bitwiseAND(F.bitwise_not(F.coalesce("blocked", F.lit(0).cast("long"))))
    return points.select("pt").crossJoin(F.broadcast(up)).join(blocked, ["pt", "day", "word"], "left").select("pt", "day", "word", lit.alias("lit"))


def _hours(steps: DataFrame, key: str) -> DataFrame:
    return steps.groupBy(key, "day").agg((F.sum(F.bit_count("lit")) * lim.SUN_STEP_MIN / 60.0).alias("hours"))


def sun_hours(points: DataFrame, bodies: DataFrame, days: DataFrame, reach: float | None = None) -> DataFrame:
    """Hours of sun of each point and day."""
    hours = _hours(lit_steps(points, bodies, sun_places(days), reach), "pt")
    return points.select("pt").crossJoin(F.broadcast(days)).join(hours, ["pt", "day"], "left").select("pt", "day", F.coalesce("hours", F.lit(0.0)).alias("hours"))


def extra_shading(points: DataFrame, bodies: DataFrame, project: DataFrame, days: DataFrame) -> DataFrame:
    """Hours that a project takes by kind of point and day: greatest, mean, and how many points lose a quarter hour or more."""
    before = sun_hours(points, bodies, days).withColumnRenamed("hours", "before")
    after = sun_hours(points, bodies.unionByName(project), days)
    lost = before.join(after, ["pt", "day"]).join(points.select("pt", "kind"), "pt").withColumn("lost", F.round(F.col("before") - F.col("hours"), 6))
    return lost.groupBy("kind", "day").agg(F.max("lost").alias("most"), F.avg("lost").alias("mean"), F.count_if(F.col("lost") >= 0.25).alias("affected"))


def room_sun(windows: DataFrame, bodies: DataFrame, days: DataFrame, reach: float | None = None) -> DataFrame:
    """Hours of sun of each room and day: lit while any of its windows (points with room) is."""
    lit = lit_steps(windows, bodies, sun_places(days), reach).join(windows.select("pt", "room"), "pt")
    hours = _hours(lit.groupBy("room", "day", "word").agg(F.bit_or("lit").alias("lit")), "room")
    every = windows.select("room").distinct().crossJoin(F.broadcast(days))
    return every.join(hours, ["room", "day"], "left").select("room", "day", F.coalesce("hours", F.lit(0.0)).alias("hours"))


def road_distance(houses: DataFrame, roads: DataFrame, reach: float) -> DataFrame:
    """Distance of each house's farthest corner to the nearest public road within ``reach``, and whether over 50 m."""
    c = s.box_corners(houses, "obj_id").withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})
    met = s.box_join(c, roads.select("obj_id", "x1", "y1", "x2", "y2"), 50.0, reach).withColumn("d", F.expr(g.box_gap("l_", "r_")))
    per = met.groupBy("l_obj_id", "l_seq").agg(F.min("d").alias("d")).groupBy(F.col("l_obj_id").alias("obj_id")).agg(F.max("d").alias("distance"))
    return houses.select("obj_id").join(per, "obj_id", "left").withColumn("far", F.col("distance") > 50)


def straight_access(houses: DataFrame, roads: DataFrame, obstacles: DataFrame, need: float = 1.25) -> DataFrame:
    """Greatest clearance of a straight line from a road's centre to a house's corner on the same parcel: least distance to an obstacle along it."""
    a = s.box_corners(houses, "obj_id", "parcel_id").select("obj_id", "parcel_id", "seq", F.col("x").alias("tx"), F.col("y").alias("ty"))
    r = roads.selectExpr("obj_id AS road", "parcel_id", "(x1 + x2) / 2 AS sx", "(y1 + y2) / 2 AS sy")
    line = a.join(r, "parcel_id")
    o = s.as_outline(s.box_edges(obstacles, "parcel_id", F.col("obj_id").alias("obstacle")), "parcel_id", "obstacle")
    d = line.join(o, "parcel_id", "left").withColumn("d", F.expr(g.segment_distance(("sx", "sy", "tx", "ty"), ("aax", "aay", "abx", "aby"))))
    clear = d.groupBy("obj_id", "seq", "road").agg(F.coalesce(F.min("d"), F.lit(99.0)).alias("clear"))
    return clear.groupBy("obj_id").agg(F.max("clear").alias("clearance")).withColumn("ok", 2 * F.col("clearance") >= need)
