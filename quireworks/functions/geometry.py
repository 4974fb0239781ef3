"""Boxes as Column expressions. A box is four Columns x0, y0, x1, y1, or an array of them or of a polygon's points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "") -> Box:
    return [F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")]


def bounds(points: Column) -> Column:
    """The rectangle around a polygon's points x, y, x, y, ..."""
    pick = lambda k: F.filter(points, lambda v, i: i % 2 == k)
    return F.array(F.array_min(pick(0)), F.array_min(pick(1)), F.array_max(pick(0)), F.array_max(pick(1)))


def centroid(points: Column) -> Column:
    half = F.size(points) / 2
    total = lambda k: F.aggregate(F.filter(points, lambda v, i: i % 2 == k), F.lit(0.0), lambda s, v: s + v)
    return F.array(total(0) / half, total(1) / half)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap_width(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))


def overlap_area(a: Box, b: Box) -> Column:
    return overlap_width(a, b) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))


def contains(a: Box, b: Box) -> Column:
    """b lies in a; borders may touch, so equal boxes contain each other."""
    return (b[0] >= a[0]) & (b[1] >= a[1]) & (b[2] <= a[2]) & (b[3] <= a[3])


def overlaps(a: Box, b: Box) -> Column:
    return overlap_area(a, b) > 0


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def iou(a: Box, b: Box) -> Column:
    both = overlap_area(a, b)
    return F.when((area(a) == 0) | (area(b) == 0), F.lit(0.0)).otherwise(both / (area(a) + area(b) - both))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return _ratio(overlap_area(a, b), F.least(area(a), area(b)))


def overlap_of_first(a: Box, b: Box) -> Column:
    return _ratio(overlap_area(a, b), area(a))


def smaller_if_overlapping(a: Box, b: Box, ratio: float) -> Column:
    """'a' or 'b', whichever is smaller (a if equal), where they overlap by more than ratio."""
    return F.when(overlap_of_smaller(a, b) > ratio, F.when(area(a) <= area(b), F.lit("a")).otherwise(F.lit("b")))


def column_overlap(a: Box, b: Box) -> Column:
    """Share of a's width that b covers."""
    return _ratio(overlap_width(a, b), a[2] - a[0])


def relative(a: Box, b: Box) -> Column:
    """(left, right, bottom, top): b lies wholly on that side of a."""
    return F.struct((b[2] < a[0]).alias("left"), (a[2] < b[0]).alias("right"), (b[3] < a[1]).alias("bottom"), (a[3] < b[1]).alias("top"))


def distance(a: Box, b: Box) -> Column:
    """Gap between two boxes, 0 if they meet."""
    gap = lambda lo, hi: F.greatest(b[lo] - a[hi], a[lo] - b[hi], F.lit(0)).cast("double")
    return F.sqrt(F.pow(gap(0, 2), F.lit(2.0)) + F.pow(gap(1, 3), F.lit(2.0)))


def center_distance(a: Box, b: Box) -> Column:
    mid = lambda p, lo, hi: (p[lo] + p[hi]) / 2.0
    return F.sqrt(F.pow(mid(a, 0, 2) - mid(b, 0, 2), F.lit(2.0)) + F.pow(mid(a, 1, 3) - mid(b, 1, 3), F.lit(2.0)))


def to_pixels(points: Column, width: Column, height: Column) -> Column:
    """Normalised coordinates to whole points of a page, cut off towards zero."""
    return F.transform(points, lambda v, i: (v.cast("double") * F.when(i % 2 == 0, width).otherwise(height)).cast("int"))


def canvas_rect(b: Box, width: Column, height: Column, rotation: Column) -> Column:
    """x, y, width, height on a canvas with its origin below, for a page rotated by 0, 90, 180 or 270."""
    w, h = b[2] - b[0], b[3] - b[1]
    return (
        F.when(rotation == 270, F.array(height - b[3], width - b[2], h, w))
        .when(rotation == 180, F.array(width - b[2], b[1], w, h))
        .when(rotation == 90, F.array(b[1], b[0], h, w))
        .otherwise(F.array(b[0], height - b[3], w, h))
    )


def render_scale(dpi: Column, width: Column, height: Column, longest: int = 3500) -> Column:
    return F.least(dpi / 72.0, F.lit(float(longest)) / F.greatest(width, height))


def intersection(a: Box, b: Box) -> Column:
    """The box that two boxes share; null where their insides don't meet."""
    lo, hi = [F.greatest(a[k], b[k]) for k in (0, 1)], [F.least(a[k], b[k]) for k in (2, 3)]
    return F.when((lo[0] < hi[0]) & (lo[1] < hi[1]), F.array(*lo, *hi))


def corners(poly: Column) -> Column:
    """(x0, y0, x1, y1, area) of a quad's first and third point, as whole points."""
    x0, y0, x1, y1 = (F.get(poly, F.lit(k)).cast("int") for k in (0, 1, 4, 5))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x1 - x0) * (y1 - y0)).alias("area"))


def canvas_quad(points: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A polygon's points on a canvas with its origin below, for a page shown `width` wide and `height`
    high, rotated by 0, 90, 180 or 270."""

    def place(v: Column, i: Column) -> Column:
        other = F.get(points, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        x = F.when(rotation == 270, height - other).when(rotation == 180, width - v).when(rotation == 90, other).otherwise(v)
        y = F.when(rotation == 270, width - other).when(rotation == 180, v).when(rotation == 90, other).otherwise(height - v)
        return F.when(i % 2 == 0, x).otherwise(y)

    return F.transform(points, place)


def fitted(width: Column, height: Column, most: int) -> Column:
    """(width, height) of a picture scaled down to `most` pixels; smaller ones stay."""
    scale = F.sqrt(F.lit(float(most)) / (width.cast("double") * height))
    size = lambda v: F.when(width.cast("long") * height > most, F.greatest(F.lit(1), F.bround(v * scale, 0).cast("int"))).otherwise(v)
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def padded(width: Column, height: Column, least_edge: int = 28, most_ratio: float = 50.0) -> Column:
    """(width, height, left, top) of a picture that is set in the middle of a wider one until its long
    edge is at most most_ratio times the short one, and then enlarged to a short edge of least_edge;
    left and top are before enlarging."""
    long_, short = F.greatest(width, height), F.least(width, height)
    edge = F.when(long_ / short > most_ratio, F.ceil(long_ / most_ratio)).otherwise(short).cast("int")
    w, h = F.when(width > height, width).otherwise(edge), F.when(width > height, edge).otherwise(height)
    grow = lambda v: F.when(edge < least_edge, F.ceil(v * (F.lit(float(least_edge)) / F.least(w, h)))).otherwise(v).cast("int")
    return F.struct(grow(w).alias("width"), grow(h).alias("height"), ((w - width) / 2).cast("int").alias("left"), ((h - height) / 2).cast("int").alias("top"))


def crop_rect(points: Column, width: Column, height: Column) -> Column:
    """(x, y, width, height) in pixels of a normalised rectangle, or around a normalised polygon, whose
    last row and column of pixels count; pixels are cut off towards zero in single precision."""
    at = F.transform(points, lambda v, i: (v.cast("float") * F.when(i % 2 == 0, width).otherwise(height).cast("float")).cast("int"))

    def rect(p: Column) -> Column:
        low = lambda k: F.array_min(F.filter(p, lambda v, i: i % 2 == k))
        high = lambda k: F.array_max(F.filter(p, lambda v, i: i % 2 == k))
        plain = F.size(p) == 4
        get = lambda k: F.get(p, F.lit(k))
        edge = lambda k: F.when(plain, get(k + 2) - get(k)).otherwise(high(k) - low(k) + 1)
        return F.struct(F.when(plain, get(0)).otherwise(low(0)).alias("x"), F.when(plain, get(1)).otherwise(low(1)).alias("y"), edge(0).alias("width"), edge(1).alias("height"))

    return F.get(F.transform(F.array(at), rect), F.lit(0))


def mostly_inside(a: Box, b: Box, least: float = 0.8) -> Column:
    """Whether the boxes' insides meet and b covers at least that share of a."""
    both = overlap_area(a, b)
    return (both > 0) & (both >= least * area(a))


def scaled_box(b: Box, scale: Column) -> Column:
    """A box on a picture of another scale, cut off towards zero."""
    return F.array(*((v * scale).cast("int") for v in b))


def crop_frame(poly: Column, pad_x: int = 0, pad_y: int = 0) -> Column:
    """(pad_x, pad_y, x0, y0, x1, y1, width, height) of a quad's box cut out onto a white frame."""
    c = corners(poly)
    return F.array(F.lit(pad_x), F.lit(pad_y), c["x0"], c["y0"], c["x1"], c["y1"], c["x1"] - c["x0"] + 2 * pad_x, c["y1"] - c["y0"] + 2 * pad_y)
