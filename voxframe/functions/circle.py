"""Closed-form area and arc length of a disc inside an axis-parallel rectangle.

Everything is expressed for the unit disc and scaled by r² (area) or r (arc).
A quadrant is the part of the disc left of ``a`` and below ``b``; a rectangle
is the alternating sum of its four corners.  Pure column arithmetic, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .rounding import clip

GEOMETRY_TOLERANCE = 1e-10


def _strip_area(t: Column) -> Column:
    return F.asin(t) + t * F.sqrt(F.greatest(1 - t * t, F.lit(0.0))) + F.lit(math.pi / 2)


def _strip_arc(t: Column) -> Column:
    return 2 * F.asin(t) + F.lit(math.pi)


def _quadrant(a: Column, b: Column, pa: Column, pb: Column, whole: float, inside: Column) -> Column:
    """Part of the disc left of ``a`` and below ``b`` from the strip values ``pa`` and ``pb``."""
    return (F.when(a * a + b * b < 1, inside)
            .when((a >= 0) & (b >= 0), pa + pb - F.lit(whole))
            .when(b >= 0, pa)
            .when(a >= 0, pb)
            .otherwise(F.lit(0.0)))


def add_overlap(df: DataFrame, cx: Column, cy: Column, r: Column, box: list[Column],
                area: str = "area", arc: str = "arc") -> DataFrame:
    """Add the area and arc length of the disc inside the box ``[x0, x1, y0, y1]``.

    The scaled edges and their strip values are columns of their own, so that each
    is computed once and the generated code stays small.
    """
    edges = {f"_{n}": clip((edge - centre) / r, -1.0, 1.0)
             for n, edge, centre in zip(("u0", "u1", "v0", "v1"), box, (cx, cx, cy, cy))}
    df = df.withColumns(edges)
    df = df.withColumns({**{f"_s{n}": _strip_area(F.col(n)) for n in edges}, **{f"_c{n}": _strip_arc(F.col(n)) for n in edges}})

    def area_of(a: str, b: str) -> Column:
        sa, sb = F.col(f"_s{a}"), F.col(f"_s{b}")
        inside = (sa + sb) / 2 + F.col(a) * F.col(b) - F.lit(math.pi / 4)
        return _quadrant(F.col(a), F.col(b), sa, sb, math.pi, inside)

    def arc_of(a: str, b: str) -> Column:
        ca, cb = F.col(f"_c{a}"), F.col(f"_c{b}")
        return _quadrant(F.col(a), F.col(b), ca, cb, 2 * math.pi, (ca + cb) / 2 - F.lit(math.pi / 2))

    def rectangle(quadrant) -> Column:
        total = quadrant("_u1", "_v1") - quadrant("_u0", "_v1") - quadrant("_u1", "_v0") + quadrant("_u0", "_v0")
        return F.greatest(total, F.lit(0.0))

    df = df.withColumns({area: rectangle(area_of) * r * r, arc: rectangle(arc_of) * r})
    return df.drop(*edges, *[f"_s{n}" for n in edges], *[f"_c{n}" for n in edges])
