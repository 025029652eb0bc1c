"""Legal limits as one table. Fixed values, from the law and its documentation."""

from __future__ import annotations

SETBACK_FACTOR, SETBACK_LEAST = 0.4, 3.0
BOUNDARY_HEIGHT, SIDE_LIMIT, TOTAL_LIMIT = 3.0, 9.0, 15.0
SHED_VOLUME, OUTER_VOLUME, CARPORT_AREA = 75.0, 20.0, 50.0
NIGHT = {"rein": 35.0, "allgemein": 40.0, "misch": 45.0}
DAY = {"rein": 50.0, "allgemein": 55.0, "misch": 60.0}
DIRECTIVITY = {"frei": 2.0, "wand": 4.0, "ecke": 8.0}
NOISE_MARGIN, WALL_REACH, LEAST_RADIUS, RECEIVER_REACH, RECEIVER_HEIGHT = 3.0, 3.0, 0.5, 35.0, 2.0
PLANT_SMALL, PLANT_TALL, PLANT_HEIGHT, PLANT_WARN = 0.5, 2.0, 2.0, 0.1
FOREST, NO_LIMIT = 0.5, 99.0
MAIN_AREA, MAIN_EAVES = 40.0, 3.0
BUILDING_CLASSES = ("gartenhaus", "gewaechshaus", "carport_garage")
STOREY, SILL, OVERHANG = 2.80, 1.0, 0.30
SUN_ALTITUDE, SUN_STEP_MIN, SUN_DAYS = 5.0, 10, ("2024-03-21", "2024-12-21")
LATITUDE, LONGITUDE = 49.5, 11.75

#: (key, value, text) for joins with rules and documents.
TABLE = [
    ("setback_least", SETBACK_LEAST, "least setback depth in metres"),
    ("setback_factor", SETBACK_FACTOR, "share of the wall height"),
    ("side_limit", SIDE_LIMIT, "boundary build-up of a side"),
    ("total_limit", TOTAL_LIMIT, "boundary build-up of all sides"),
    ("shed_volume", SHED_VOLUME, "volume of a shed without permit"),
    ("outer_volume", OUTER_VOLUME, "volume in the outer area"),
    ("carport_area", CARPORT_AREA, "area of a carport without permit"),
    ("noise_margin", NOISE_MARGIN, "distance to the night limit that warns"),
]
