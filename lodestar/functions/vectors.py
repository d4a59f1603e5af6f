"""Column expressions on hashes (64 bits in a long) and vectors (arrays of numbers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(flags: Column) -> Column:
    """An array of up to 64 booleans as a long, the first one highest."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.cast("long")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where ``use`` reads it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median_hash(block: Column) -> Column:
    """Bit i: value i exceeds the median of all values but the first (64 values, row by row)."""
    median = F.element_at(F.sort_array(F.slice(block, 2, 63)), 32)
    return once(median, lambda m: pack_bits(F.transform(block, lambda x: x > m)))


def gradient_hash(block: Column, width: int = 9, height: int = 8) -> Column:
    """A bit for each value but the last of a row (``width`` values, row by row): the next one is larger. 9 by 8 values make 64 bits."""
    place = lambda i: (i + F.floor(i / (width - 1))).cast("int")
    bits = lambda v: F.transform(F.sequence(F.lit(0), F.lit(height * (width - 1) - 1)), lambda i: F.get(v, place(i) + 1) > F.get(v, place(i)))
    return once(block, lambda v: pack_bits(bits(v)))


def softmax(scores: Column) -> Column:
    """Shares of 1 in proportion to the exponentials of an array's values."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    powers = once(F.array_max(scores), lambda m: F.transform(scores, lambda x: F.exp(x.cast("double") - m)))
    return once(powers, lambda p: F.transform(p, lambda x: x / add(p)))


def largest(scores: Column, k: int) -> Column:
    """Places (from 0) and values of an array's k largest values, largest first, ties to the earlier place."""
    placed = F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("place")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda p: F.struct(p["place"].alias("place"), (-p["v"]).alias("value")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; norms under 1e-8 count as 1e-8."""
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, clipped to [-1, 1], at 6 places, so that ranks don't hang on the last bits."""
    c = dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 6)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def rotate(block: Column, quarters: int, width: int = 8) -> Column:
    """A square block turned counter-clockwise by so many quarters."""
    places = [[r * width + c for c in range(width)] for r in range(width)]
    for _ in range(quarters % 4):
        places = [[places[r][width - 1 - c] for r in range(width)] for c in range(width)]
    return F.array(*(F.get(block, F.lit(i)) for row in places for i in row))
