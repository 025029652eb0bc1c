"""Queries without SQL work on all parcels and points, at the survey's grid steps."""

import math

import pytest
from pyspark.sql import functions as F
from test_queries import QUERIES, SF

from plotcheck.operators.rules import devices
from plotcheck.plans import fixtures


def test_zones_and_fit_cover_all_parcels(spark):
    zones = QUERIES["placement_zones"](spark, SF)
    parcels = {r.parcel_id for r in fixtures.view(spark, SF, "parcel").collect()}
    assert {r.parcel_id for r in zones.select("parcel_id").distinct().collect()} == parcels
    # Coarse centres lie on halves, fine ones on odd eighths.
    assert {r.f for r in zones.select(F.pmod("x", F.lit(1.0)).alias("f")).distinct().collect()} == {0.125, 0.375, 0.5, 0.625, 0.875}
    placed = {(r.product, r.parcel_id) for r in zones.filter("colour <> 'red'").select("product", "parcel_id").distinct().collect()}
    fit = QUERIES["product_fit"](spark, SF).collect()
    assert {(r.product, r.parcel_id) for r in fit} == placed
    assert all(r.parcels == sum(p == r.product for p, _ in placed) for r in fit)


@pytest.mark.parametrize("name", ["sun_hours", "room_sun"])
def test_all_points(spark, name):
    points = fixtures.view(spark, SF, "footprint").filter("role = 4")
    keys = {"sun_hours": ("pt", "obj_id"), "room_sun": ("room", "parcel_id")}[name]
    got = {r[0] for r in QUERIES[name](spark, SF).select(keys[0]).distinct().collect()}
    assert got == {r[0] for r in points.select(keys[1]).distinct().collect()}


def test_extra_shading_has_all_kinds(spark):
    kinds = {r[0] for r in fixtures.view(spark, SF, "footprint").filter("role = 4").select("klasse").distinct().collect()}
    assert {r.kind for r in QUERIES["extra_shading"](spark, SF).collect()} == kinds


def test_shadow_of_a_far_tall_body(spark):
    days = spark.sql("SELECT date'2024-12-21' AS day")
    point = spark.createDataFrame([(1, 0.0, 0.0, 1.5)], "pt long, x double, y double, z double")
    # A wall of 40 m, 200 m to the south: its shadow at 5 degrees is 440 m long.
    wall = spark.createDataFrame([(1, -400.0, -210.0, 400.0, -200.0, 40.0)], "obj_id long, x1 double, y1 double, x2 double, y2 double, height double")
    sun = devices.sun_places(days).collect()
    free = 0
    for s in sun:
        dy = math.cos(math.radians(s.az))
        free += not (dy < 0 and abs(200 / dy * math.sin(math.radians(s.az))) <= 400 and 1.5 + 200 / -dy * math.tan(math.radians(s.alt)) < 40)
    assert 0 < free < len(sun)
    assert devices.sun_hours(point, wall, days).collect()[0].hours == pytest.approx(free / 6)
