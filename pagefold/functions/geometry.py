"""Boxes as Columns: four doubles left, top, right, bottom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")
Box = Sequence[Column]


def box(prefix: str = "", names: Sequence[str] = SIDES) -> tuple[Column, ...]:
    """The box of the columns prefix + name."""
    return tuple(F.col(prefix + n) for n in names)


def of(struct: Column, names: Sequence[str] = SIDES) -> tuple[Column, ...]:
    return tuple(struct[n] for n in names)


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that are apart or without area."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def overlap_fraction(a: Box, b: Box, least: float = 1e-9) -> Column:
    """Intersection by the smaller area; 0 if that is at most least."""
    small = F.least(area(a), area(b))
    return F.when(small > least, intersection(a, b) / small).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box, share: float = 0.3) -> Column:
    return overlap_fraction(a, b) >= share


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def holds(b: Box, x: Column, y: Column, margin: float = 0.0) -> Column:
    """Whether the point is in the box, edges included, grown by margin on all sides."""
    return x.between(b[0] - margin, b[2] + margin) & y.between(b[1] - margin, b[3] + margin)


def polygon_box(points: Column, width: Column | float, height: Column | float) -> Column:
    """The upright box of a polygon x0, y0, x1, y1, ... in pixels, as shares of the page."""
    xs = F.filter(points, lambda _, i: i % 2 == 0)
    ys = F.filter(points, lambda _, i: i % 2 == 1)
    return F.struct((F.array_min(xs) / width).alias("left"), (F.array_min(ys) / height).alias("top"), (F.array_max(xs) / width).alias("right"), (F.array_max(ys) / height).alias("bottom"))


def pixel_polygon(b: Box, width: Column | float, height: Column | float) -> Column:
    """The box's corners in pixels, clockwise from the top left."""
    left, top, right, bottom = b[0] * width, b[1] * height, b[2] * width, b[3] * height
    return F.array(left, top, right, top, right, bottom, left, bottom)


def crop_to_page(b: Box, region: Box, least: float = 0.0) -> Column:
    """A box in shares of a region as shares of the page, clamped to 0..1; null if the region is narrower or lower than least."""
    wide, high = region[2] - region[0], region[3] - region[1]
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    sides = [clamp(region[0] + b[0] * wide), clamp(region[1] + b[1] * high), clamp(region[0] + b[2] * wide), clamp(region[1] + b[3] * high)]
    return F.when((wide >= least) & (high >= least), F.struct(*(s.alias(n) for s, n in zip(sides, SIDES, strict=True))))


def to_thousand(x: Column) -> Column:
    """0..1 to 0..1000, halves to even."""
    return F.bround(x * 1000).cast("int")


def to_thousand_cut(x: Column) -> Column:
    """0..1 to 0..1000, cut off."""
    return (x * 1000).cast("int")


def from_thousand(x: Column) -> Column:
    return x / 1000.0


def dot(a: Column, b: Column) -> Column:
    """Of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, epsilon: float = 1e-8, added: bool = False) -> Column:
    """v by its length: by the larger of that and epsilon, or, if added, by their sum."""
    norm = F.sqrt(dot(v, v))
    by = norm + epsilon if added else F.greatest(norm, F.lit(epsilon))
    return F.element_at(F.transform(F.array(by), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)
