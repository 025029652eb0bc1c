"""Transverse Mercator (UTM zone 32, GRS 80) as column expressions, by the series in the third flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: GRS 80, scale and false easting of the zone.
A, FLATTENING, SCALE, EASTING, MERIDIAN = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 9.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)


def _series(rows: list[list[float]]) -> list[float]:
    """Sums of c[k] n^(j + k) for each order j."""
    return [sum(c * _N ** (j + k) for k, c in enumerate(row, 1)) for j, row in enumerate(rows)]


ALPHA = _series([[1 / 2, -2 / 3, 5 / 16, 41 / 180], [13 / 48, -3 / 5, 557 / 1440], [61 / 240, -103 / 140], [49561 / 161280]])
BETA = _series([[1 / 2, -2 / 3, 37 / 96, -1 / 360], [1 / 48, 1 / 15, -437 / 1440], [17 / 480, -37 / 840], [4397 / 161280]])
DELTA = _series([[2, -2 / 3, -2, 116 / 45], [7 / 3, -8 / 5, -227 / 45], [56 / 15, -136 / 35], [4279 / 630]])


def to_utm(points: DataFrame) -> DataFrame:
    """``points`` (lon, lat in degrees) with e, n in metres."""
    p = points.withColumns({"__s": F.sin(F.radians("lat")), "__l": F.radians(F.col("lon") - MERIDIAN)})
    p = p.withColumn("__t", F.sinh(F.atanh("__s") - _E * F.atanh(_E * F.col("__s"))))
    p = p.withColumns({"__x": F.atan2(F.col("__t"), F.cos("__l")), "__y": F.atanh(F.sin("__l") / F.sqrt(1 + F.col("__t") * F.col("__t")))})
    n, e = F.col("__x"), F.col("__y")
    for j, a in enumerate(ALPHA, 1):
        n = n + a * F.sin(2 * j * F.col("__x")) * F.cosh(2 * j * F.col("__y"))
        e = e + a * F.cos(2 * j * F.col("__x")) * F.sinh(2 * j * F.col("__y"))
    return p.withColumns({"e": EASTING + SCALE * _RADIUS * e, "n": SCALE * _RADIUS * n}).drop("__s", "__l", "__t", "__x", "__y")


def from_utm(points: DataFrame) -> DataFrame:
    """``points`` (e, n) with lon, lat in degrees."""
    p = points.withColumns({"__x": F.col("n") / (SCALE * _RADIUS), "__y": (F.col("e") - EASTING) / (SCALE * _RADIUS)})
    x, y = F.col("__x"), F.col("__y")
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * F.col("__x")) * F.cosh(2 * j * F.col("__y"))
        y = y - b * F.cos(2 * j * F.col("__x")) * F.sinh(2 * j * F.col("__y"))
    p = p.withColumns({"__u": x, "__v": y}).withColumn("__c", F.asin(F.sin("__u") / F.cosh("__v")))
    lat = F.col("__c")
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * F.col("__c"))
    lon = MERIDIAN + F.degrees(F.atan2(F.sinh("__v"), F.cos("__u")))
    return p.withColumns({"lon": lon, "lat": F.degrees(lat)}).drop("__x", "__y", "__u", "__v", "__c")
