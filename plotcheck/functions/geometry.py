"""Plane geometry as SQL expression texts, for use with ``F.expr``."""

from __future__ import annotations


def segment_point(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Share of the way from a to b at which the point of the segment nearest to p lies."""
    dot = f"(({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay}))"
    square = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return f"(CASE WHEN {square} = 0 THEN 0.0e0 ELSE least(1.0e0, greatest(0.0e0, {dot} / {square})) END)"


def point_segment_distance(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = segment_point(px, py, ax, ay, bx, by)
    dx, dy = f"({px} - {ax} - {t} * ({bx} - {ax}))", f"({py} - {ay} - {t} * ({by} - {ay}))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """Positive if p lies to the left of a to b."""
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def segments_cross(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """Do two segments (ax, ay, bx, by) cross in a point inside both?"""
    p, q = a, b
    one = f"({cross(*p, q[0], q[1])} * {cross(*p, q[2], q[3])} < 0)"
    two = f"({cross(*q, p[0], p[1])} * {cross(*q, p[2], p[3])} < 0)"
    return f"({one} AND {two})"


def segment_distance(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    """Distance of two segments, 0 if they cross."""
    ends = [point_segment_distance(a[0], a[1], *b), point_segment_distance(a[2], a[3], *b), point_segment_distance(b[0], b[1], *a), point_segment_distance(b[2], b[3], *a)]
    return f"(CASE WHEN {segments_cross(a, b)} THEN 0.0e0 ELSE least({', '.join(ends)}) END)"


def ray_crossing(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Does the ray from p to the right meet the edge? An odd number of meetings is inside."""
    return f"(({ay} > {py}) <> ({by} > {py}) AND {px} < ({bx} - {ax}) * ({py} - {ay}) / nullif({by} - {ay}, 0) + {ax})"


def box_overlap(a: str, b: str) -> str:
    """Shared area of two boxes whose columns x1, y1, x2, y2 are prefixed."""
    return (
        f"(greatest(0.0e0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
        f" * greatest(0.0e0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    )


def box_area(a: str) -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


def box_iou(a: str, b: str) -> str:
    return f"({box_overlap(a, b)} / ({box_area(a)} + {box_area(b)} - {box_overlap(a, b)}))"


def box_gap(a: str, b: str) -> str:
    """Distance of two boxes, 0 if they touch."""
    dx = f"greatest(0.0e0, greatest({a}x1, {b}x1) - least({a}x2, {b}x2))"
    dy = f"greatest(0.0e0, greatest({a}y1, {b}y1) - least({a}y2, {b}y2))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def cell(value: str, size: float) -> str:
    return f"CAST(floor({value} / {float(size)!r}e0) AS BIGINT)"
