"""Column builders for axis-aligned boxes, points and directions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.polygons import let


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def aspect(self) -> Column:
        return self.width / F.greatest(F.lit(1), self.height)

    def intersection(self, other: Box) -> Column:
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)

    def iou(self, other: Box) -> Column:
        inter = self.intersection(other)
        return inter / F.greatest(F.lit(1), self.area + other.area - inter)

    def contained_in(self, other: Box) -> Column:
        return self.intersection(other) / F.greatest(F.lit(1), self.area)

    def gap_x(self, other: Box) -> Column:
        return F.greatest(F.lit(0), F.greatest(self.x0, other.x0) - F.least(self.x1, other.x1))

    def gap_y(self, other: Box) -> Column:
        return F.greatest(F.lit(0), F.greatest(self.y0, other.y0) - F.least(self.y1, other.y1))

    def distance(self, other: Box) -> Column:
        return F.sqrt(F.pow(self.gap_x(other), 2) + F.pow(self.gap_y(other), 2))


def coerced(box: Column | None = None, width: int = 100, height: int = 30) -> Box:
    """A box from columns of which x1 and y1 may be missing."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return Box(x0, y0, F.coalesce(x1, x0 + width), F.coalesce(y1, y0 + height))


def quad_box(quad: Column) -> Box:
    """The clamped box around a quad given as array<array<double>> of points."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    clamp = lambda c: F.greatest(F.lit(0), c).cast("int")
    return Box(clamp(F.array_min(xs)), clamp(F.array_min(ys)), clamp(F.array_max(xs)), clamp(F.array_max(ys)))


def scaled(thousandths: Column, size: Column) -> Column:
    """A 0-1000 coordinate in pixels."""
    return (thousandths / 1000 * size).cast("int")


def quad_angle(quad: Column) -> Column:
    """Degrees of a quad's first side."""
    return F.degrees(F.atan2(quad[1][1] - quad[0][1], quad[1][0] - quad[0][0]))


def direction(dx: Column, dy: Column) -> Column:
    """One of eight compass names for a vector, y downwards, by slopes of 22.5 degrees in whole numbers."""
    ax, ay = F.abs(dx), F.abs(dy)
    flat, steep = 1000 * ay <= 414 * ax, 1000 * ax <= 414 * ay
    ns, we = F.when(dy < 0, "top").otherwise("bottom"), F.when(dx < 0, "left").otherwise("right")
    return F.when(flat, we).when(steep, ns).otherwise(F.concat(ns, F.lit("-"), we))


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<array<int>>."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.abs(F.aggregate(cross, F.lit(0).cast("double"), lambda s, v: s + v)) / 2


def in_polygon(points: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies in a polygon; the border counts as inside."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        side = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
        on = (side == 0) & x.between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & y.between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))
        crosses = ((a[1] > y) != (b[1] > y)) & F.when(b[1] > a[1], side > 0).otherwise(side < 0)
        return F.struct(on.alias("on"), crosses.cast("int").alias("n"))

    edges = F.zip_with(points, following, edge)
    odd = F.aggregate(edges, F.lit(0), lambda s, e: s + e["n"]) % 2 == 1
    return F.exists(edges, lambda e: e["on"]) | odd


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two numeric arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def chord_width(offset: Column, half: Column, width: Column, margin: float = 0.9) -> Column:
    """The width that a rounded shape leaves at a row ``offset`` from its middle."""
    n = F.least(F.lit(1.0), F.abs(offset) / F.greatest(F.lit(1), half))
    return width * margin * F.sqrt(F.greatest(F.lit(0.12), 1 - n * n))


def contained_shape(box: Box, page_width: int, page_height: int) -> Column:
    """(points, is_rectangle): what stands for a contour that has run out into the art around a text box.

    A box three times as long in one direction as in the other gets a rectangle around it, others
    an ellipse of 61 points. Cosines are whole millionths and halves go to even places, so that
    points do not depend on the engine."""
    w, h = F.greatest(F.lit(10), box.width), F.greatest(F.lit(10), box.height)
    cx, cy = F.floor((box.x0 + box.x1) / 2), F.floor((box.y0 + box.y1) / 2)
    hold = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), v)).cast("int")
    point = lambda x, y: F.array(hold(x, page_width), hold(y, page_height))
    x0, y0, x1, y1 = box.x0 - 18, box.y0 - 12, box.x1 + 18, box.y1 + 12
    rectangle = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    rx = F.greatest(F.lit(15), F.least(F.floor(w * 0.58), F.floor(box.width / 2) + 15))
    ry = F.greatest(F.lit(12), F.least(F.floor(h * 0.62), F.floor(box.height / 2) + 12))
    millionths = lambda v: math.floor(v * 1_000_000 + 0.5)
    ways = F.array(*[F.array(F.lit(millionths(math.cos(math.radians(a)))), F.lit(millionths(math.sin(math.radians(a))))) for a in range(0, 366, 6)]).cast("array<array<long>>")

    # rint takes halves to even places
    on = lambda middle, radius, v: F.rint((middle * 1_000_000 + radius * v) / 1_000_000)
    ellipse = let(F.struct(cx.alias("cx"), rx.alias("rx"), cy.alias("cy"), ry.alias("ry")), lambda e: F.transform(ways, lambda v: point(on(e["cx"], e["rx"], v[0]), on(e["cy"], e["ry"], v[1]))))
    long = (w >= 3 * h) | (h >= 3 * w)
    return F.struct(F.when(long, rectangle).otherwise(ellipse).alias("points"), long.alias("is_rectangle"))
