"""Rings as array columns: corners as structs of x and y in order, edges as structs of ax, ay, bx, by_."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_of(edges: Column) -> Column:
    """Corners of a ring of edges in order."""
    return F.transform(edges, lambda e: point(e["ax"], e["ay"]))


def _before(ring: Column, i: Column) -> Column:
    return F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))


def edges_of(ring: Column) -> Column:
    """Edges of a ring in order, from each corner to the next."""
    nxt = lambda i: F.element_at(ring, F.when(i + 1 == F.size(ring), F.lit(1)).otherwise(i + 2).cast("int"))
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), nxt(i)["x"].alias("bx"), nxt(i)["y"].alias("by_")))


def area(ring: Column) -> Column:
    parts = F.transform(ring, lambda p, i: _before(ring, i)["x"] * p["y"] - p["x"] * _before(ring, i)["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)) / 2


def clip(subject: Column, convex: Column) -> Column:
    """The part of a ring, convex or not, that lies in a convex, counter-clockwise polygon given by its edges; empty if none.

    Half-plane by half-plane, each corner gives itself, its crossing from the one before, both, or nothing.
    """

    def half(ring: Column, e: Column) -> Column:
        side = lambda p: (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) - (e["by_"] - e["ay"]) * (p["x"] - e["ax"])
        told = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s")))

        def corner(p: Column, q: Column) -> Column:
            t = q["s"] / (q["s"] - p["s"])
            cut = point(q["x"] + t * (p["x"] - q["x"]), q["y"] + t * (p["y"] - q["y"]))
            own, none = F.array(point(p["x"], p["y"])), F.array().cast(RING)
            return F.when(p["s"] >= 0, F.when(q["s"] >= 0, own).otherwise(F.concat(F.array(cut), own))).otherwise(F.when(q["s"] >= 0, F.array(cut)).otherwise(none))

        # The corners and their sides are computed once, then walked in pairs.
        pairs = lambda r: F.zip_with(r, F.concat(F.slice(r, F.size(r), 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))), lambda p, q: corner(p, q))
        walked = F.transform(F.array(told), lambda r: F.when(F.size(r) == 0, F.array().cast(f"array<{RING}>")).otherwise(pairs(r)))
        return F.flatten(F.flatten(walked)).cast(RING)

    return F.aggregate(convex, subject.cast(RING), half)


def clip_area(subject: Column, convex: Column) -> Column:
    """Shared area of a ring, convex or not, and a convex, counter-clockwise polygon given by its edges."""
    part = F.element_at(F.transform(F.array(clip(subject, convex)), lambda r: F.when(F.size(r) < 3, 0.0).otherwise(area(r))), 1)
    return part


def inside(convex_ring: Column, convex_edges: Column, plot: Column, tol: float = 0.005) -> Column:
    """Does the convex polygon lie within the ring, convex or not?"""
    return clip_area(plot, convex_edges) >= area(convex_ring) - tol


def contains(edges: Column, p: Column) -> Column:
    """Does the ring of edges hold the point, by the even-odd rule?"""
    met = F.filter(edges, lambda e: ((e["ay"] > p["y"]) != (e["by_"] > p["y"])) & (p["x"] < (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) / F.nullif(e["by_"] - e["ay"], F.lit(0.0)) + e["ax"]))
    return F.size(met) % 2 == 1
