"""Geometry on columns: segments, angles, homogeneous transforms, rectangles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A segment is taken to be this long at least.
SHORTEST = 2.0**-5


def length(x0: Column, y0: Column, x1: Column, y1: Column, known: Column | None = None) -> Column:
    own = F.hypot(x1 - x0, y1 - y0)
    return own if known is None else F.coalesce(known, own)


def direction(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.atan2(y1 - y0, x1 - x0)


def flipped_direction(angle: Column, flip: Column) -> Column:
    """Direction in [0, 2 pi) after an optional flip."""
    return F.pmod(angle + F.when(flip, F.lit(math.pi)).otherwise(F.lit(0.0)), F.lit(2 * math.pi))


def direction_difference(a: Column, b: Column, same_side: Column) -> Column:
    """Angle between two connected segments; those that meet with the same side are
    first turned to follow one another."""
    d = F.abs(a - b)
    d = F.least(d, F.lit(2 * math.pi) - d)
    return F.when(same_side, F.lit(math.pi) - d).otherwise(d)


def point_to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``struct(d, x, y, t)``: distance to a segment, the nearest point on it and its
    place from 0 to 1."""
    dx, dy = x1 - x0, y1 - y0
    size = F.greatest(F.hypot(dx, dy), F.lit(SHORTEST))
    t = F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / (size * size), F.lit(0.0)), F.lit(1.0))
    x, y = x0 + t * dx, y0 + t * dy
    return F.struct(F.hypot(px - x, py - y).alias("d"), x.alias("x"), y.alias("y"), t.alias("t"))


def matrix(*values: Column | float) -> Column:
    """3 x 3 matrix as an array of nine, row by row."""
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def translation(x: Column | float, y: Column | float) -> Column:
    return matrix(1, 0, x, 0, 1, y, 0, 0, 1)


def product(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def inverse(m: Column) -> Column:
    """Closed form; null for a singular matrix."""
    cof = lambda i, j: (
        m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3]
        - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    )
    det = m[0] * cof(0, 0) + m[1] * cof(0, 1) + m[2] * cof(0, 2)
    return F.when(det != 0, F.array(*[cof(j, i) / det for i in range(3) for j in range(3)]))


def transform(m: Column, x: Column, y: Column) -> Column:
    """``struct(x, y)`` of a point, normalised."""
    w = m[6] * x + m[7] * y + m[8]
    return F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))


def rectangle_corners(cx: Column, cy: Column, width: Column, height: Column, angle: Column) -> Column:
    """Corners of a rectangle given by centre, sides and angle."""
    c, s = F.cos(angle), F.sin(angle)
    return F.array(
        *[
            F.struct((cx + c * width * a - s * height * b).alias("x"), (cy + s * width * a + c * height * b).alias("y"))
            for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))
        ]
    )


def rectangle_from_corner(x: Column, y: Column, width: Column, height: Column, angle: Column) -> Column:
    """Corners of a rectangle given by its first corner, sides and angle."""
    c, s = F.cos(angle), F.sin(angle)
    return F.array(
        *[F.struct((x + c * width * a - s * height * b).alias("x"), (y + s * width * a + c * height * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    )


def projection_area(x1: Column, y1: Column, x2: Column, y2: Column, p1x: Column, p1y: Column, p2x: Column, p2y: Column) -> Column:
    """Area between a segment and the projection of its ends."""
    cross = lambda ax, ay, bx, by: F.abs(ax * by - ay * bx)
    return (cross(x2 - x1, y2 - y1, p1x - x1, p1y - y1) + cross(p2x - p1x, p2y - p1y, p2x - x2, p2y - y2)) / 2


def downward(x0: Column, y0: Column, x1: Column, y1: Column, n0: Column, n1: Column) -> Column:
    """``struct(n0, n1)`` of a segment turned so that y does not fall."""
    up = y1 < y0
    return F.struct(F.when(up, n1).otherwise(n0).alias("n0"), F.when(up, n0).otherwise(n1).alias("n1"))


def turn_angle(before: Column, after: Column) -> Column:
    """Signed change of direction in [-pi, pi)."""
    return F.pmod(after - before + math.pi, F.lit(2 * math.pi)) - math.pi
