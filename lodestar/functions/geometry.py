"""Card corners: ordering four points, and where a scaled, turned and shifted card ends up. Points are arrays [x, y]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: width and height of an upright card in pixels
CARD_W, CARD_H = 488, 680


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left: the extremes of x + y and y - x; ties to the earlier point."""
    xy = lambda p: (F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double"))
    total = F.transform(points, lambda p: xy(p)[0] + xy(p)[1])
    slope = F.transform(points, lambda p: xy(p)[1] - xy(p)[0])
    at = lambda values, best: F.get(points, F.array_position(values, best(values)).cast("int") - 1)
    return F.array(at(total, F.array_min), at(slope, F.array_min), at(total, F.array_max), at(slope, F.array_max))


def placed_corners(scale: Column, degrees: Column, x: Column, y: Column, canvas: int) -> Column:
    """The four corners, as shares of a square canvas, of a card scaled, turned about its centre and centred at (x, y)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corner = lambda dx, dy: F.array((x + scale * (dx * c - dy * s)) / canvas, (y + scale * (dx * s + dy * c)) / canvas)
    w, h = CARD_W / 2, CARD_H / 2
    return F.array(corner(-w, -h), corner(w, -h), corner(w, h), corner(-w, h))


def valid_region(values: Column, least_std: float = 25, low: float = 20, high: float = 235) -> Column:
    """Not empty, not flat, neither too dark nor too bright."""
    n, add = F.nullif(F.size(values), F.lit(0)), lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    mean = add(values) / n
    std = F.sqrt(F.greatest(add(F.transform(values, lambda v: v * v)) / n - mean * mean, F.lit(0.0)))
    return F.coalesce((n > 0) & (F.round(std, 6) >= least_std) & F.round(mean, 6).between(low, high), F.lit(False))


def clean_card(width: Column, height: Column, tolerance: float = 0.02, most: int | None = 1500) -> Column:
    """Already a rectified card: large enough, of a card's proportions, and (unless ``most`` is None) not a large photo. Null where a side is null."""
    fits = (F.least(width, height) >= 200) & (F.abs(width / F.nullif(height, F.lit(0)) - CARD_W / CARD_H) < tolerance)
    return fits if most is None else fits & (F.greatest(width, height) <= most)
