"""Rasters in Arrow maps: perceptual hashes by area reduction and cosine transform, statistics of regions by summed-area tables,
perspective rectification. A raster is a binary column with a byte a pixel, row by row, and a column with its width; the last row may be
short, what it lacks is 0. All are maps over rows: no shuffle, and a lost task is redone alone."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sides of the reduced image and of the block of low frequencies that is hashed
REDUCED, BLOCK = 32, 8
# fixed values: shares of height and width, from and to, of the regions that tell a framed image; below the one deviation both are plain,
# beyond the other both are pictures
TITLE, TYPE_LINE = (0.04, 0.10, 0.06, 0.75), (0.55, 0.61, 0.06, 0.82)
PLAIN_STD, PICTURE_STD = 35, 55
#: Rectified images that are sampled at a time.
SAMPLED = 512


def square(data: Column) -> Column:
    """A width that makes a raster of any bytes about as high as wide; null where there are none."""
    return F.ceil(F.sqrt(F.nullif(F.octet_length(data), F.lit(0)).cast("double"))).cast("int")


def pixels(data: bytes, width: int) -> np.ndarray:
    height = -(-len(data) // width)
    return np.frombuffer(data.ljust(height * width, b"\0"), np.uint8).reshape(height, width)


@functools.lru_cache(4096)
def _shares(size: int, out: int) -> np.ndarray:
    """How much of each of ``size`` cells lies in each of ``out`` equal parts of their length: rows sum to 1."""
    edges = np.arange(out + 1) * size / out
    cells = np.arange(size)
    inside = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(inside, 0) * out / size


def reduced(image: np.ndarray, side: int = REDUCED) -> np.ndarray:
    """The means of ``side`` x ``side`` equal parts of the image; cells on a border count by the share inside."""
    shares = [_shares(n, side) if n <= 4096 else _shares.__wrapped__(n, side) for n in image.shape]
    return shares[0] @ image.astype(np.float64) @ shares[1].T


@functools.cache
def cosines(size: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of ``size`` values."""
    k, x = np.arange(low)[:, None], np.arange(size)[None, :]
    out = np.cos(np.pi * (2 * x + 1) * k / (2 * size)) * np.sqrt(2 / size)
    out[0] = np.sqrt(1 / size)
    return out


def _map(df: DataFrame, data: str, width: str, out: dict[str, tuple[str, pa.DataType]], fn: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``df`` with the columns ``out`` (name -> DDL and Arrow type) that ``fn`` makes of each raster; null where there is none."""
    keep = [c for c in df.columns if c not in (*out, data, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for raw, w in zip(batch.column(data), batch.column(width).to_pylist(), strict=True):  # one raster at a time
                value = raw.as_py() if w else None
                made.append(fn(pixels(value, w)) if value else (None,) * len(out))
            columns = [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {ddl}" for c, (ddl, _) in out.items())])
    return df.select(*(F.col(f"`{c}`") for c in (*keep, data, width))).mapInArrow(run, schema)


def low_frequencies(df: DataFrame, data: str, width: str, out: str = "block", places: int = 4) -> DataFrame:
    """``df`` with its raster replaced by ``out``: the ``BLOCK`` x ``BLOCK`` lowest coefficients, row by row, of the cosine transform of the reduced raster,
    at ``places`` places so that a threshold doesn't hang on the last bits. ``vectors.median_hash`` makes 64 bits of them."""
    c = cosines(REDUCED, BLOCK)
    return _map(df, data, width, {out: ("array<double>", pa.list_(pa.float64()))}, lambda image: ((np.round(c @ reduced(image) @ c.T, places) + 0.0).ravel(),))


def region(height: int, width: int, shares: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """First and end rows and columns of a region given in shares, cut down to whole pixels."""
    y0, y1, x0, x1 = shares
    return int(height * y0), int(height * y1), int(width * x0), int(width * x1)


def inset(height: int, width: int, share: float = 0.03) -> tuple[int, int, int, int]:
    """All but a border of a share of either side."""
    y, x = int(height * share), int(width * share)
    return y, height - y, x, width - x


def region_stats(df: DataFrame, data: str, width: str, regions: dict[str, Callable[[int, int], tuple[int, int, int, int]]]) -> DataFrame:
    """``df`` with its raster replaced by ``<name>_n``, ``<name>_mean`` and ``<name>_std`` (of the population) of each region. Two summed-area tables, of
    values and of squares, are built once a raster; a region then takes four look-ups in each. A region without pixels has null mean and deviation."""

    def stats(image: np.ndarray) -> tuple:
        tables = []
        for v in (image.astype(np.int64), image.astype(np.int64) ** 2):
            t = np.zeros((v.shape[0] + 1, v.shape[1] + 1), np.int64)
            t[1:, 1:] = v.cumsum(0).cumsum(1)
            tables.append(t)
        out: list = []
        for place in regions.values():
            y0, y1, x0, x1 = place(*image.shape)
            n = max(0, y1 - y0) * max(0, x1 - x0)
            total, squares = (int(t[y1, x1] - t[y0, x1] - t[y1, x0] + t[y0, x0]) if n else 0 for t in tables)
            mean = total / n if n else None
            out += [n, mean, float(np.sqrt(max(0.0, squares / n - mean * mean))) if n else None]
        return tuple(out)

    kinds = {"n": ("long", pa.int64()), "mean": ("double", pa.float64()), "std": ("double", pa.float64())}
    return _map(df, data, width, {f"{r}_{k}": t for r in regions for k, t in kinds.items()}, stats)


def frame_of(title_std: Column, type_std: Column) -> Column:
    """modern where title and type line are plain, fullart where both are pictures, else null: for ``catalog.frame_class``, which
    then takes its default."""
    return F.when((title_std < PLAIN_STD) & (type_std < PLAIN_STD), "modern").when((title_std > PICTURE_STD) & (type_std > PICTURE_STD), "fullart")


def homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per quadrilateral (n, 4, 2) of ``target`` points, the 3 x 3 matrix that maps ``source`` (4, 2) onto it: one batch of 8 x 8 systems. NaN
    where three corners are in line."""
    n = len(target)
    u, v = source.astype(np.float64).T
    x, y = target[..., 0].astype(np.float64), target[..., 1].astype(np.float64)
    zero, one = np.zeros((n, 4)), np.ones((n, 4))
    us, vs = np.broadcast_to(u, (n, 4)), np.broadcast_to(v, (n, 4))
    rows = np.concatenate([np.stack([us, vs, one, zero, zero, zero, -us * x, -vs * x], -1), np.stack([zero, zero, zero, us, vs, one, -us * y, -vs * y], -1)], 1)
    flat = np.zeros(n, bool)
    for i in range(4):
        a, b, c = (target[:, j] for j in range(4) if j != i)
        area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        flat |= ~(np.abs(area) > 1e-9)
    rows[flat] = np.eye(8)
    solved = np.linalg.solve(rows, np.concatenate([x, y], 1)[..., None])[..., 0]
    out = np.concatenate([solved, np.ones((n, 1))], 1).reshape(n, 3, 3)
    out[flat] = np.nan
    return out


def bilinear(images: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values of (n, h, w) images between pixels, at (n, m) places; what lies outside counts 0."""
    n, h, w = images.shape
    padded = np.zeros((n, h + 2, w + 2))
    padded[:, 1:-1, 1:-1] = images
    x, y = np.clip(x + 1, 0, w + 0.999999), np.clip(y + 1, 0, h + 0.999999)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - i, x - j
    at = np.arange(n)[:, None]
    top = padded[at, i, j] * (1 - fx) + padded[at, i, j + 1] * fx
    low = padded[at, i + 1, j] * (1 - fx) + padded[at, i + 1, j + 1] * fx
    return top * (1 - fy) + low * fy


def rectified(df: DataFrame, data: str, width: int, corners: str, size: tuple[int, int], out: str = "rectified") -> DataFrame:
    """``df`` with ``out``: the quadrilateral ``corners`` (eight numbers x1, y1, ... from the top left, clockwise) of the values in ``data`` (an array, ``width``
    a row, of one length) as an upright image of ``size`` (width, height). Its corners come from the quadrilateral's. Null where three
    corners are in line or a value is missing."""
    w, h = size
    frame = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]])
    v, u = np.mgrid[0:h, 0:w].reshape(2, -1)
    grid = np.stack([u, v, np.ones_like(u)]).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SAMPLED):
                batch = whole.slice(start, SAMPLED)
                values, points = batch.column(data).to_pylist(), batch.column(corners).to_pylist()
                good = [i for i, (a, p) in enumerate(zip(values, points, strict=True)) if a and p and len(p) == 8 and None not in a and None not in p]
                made: list = [None] * len(values)
                if good:
                    quads = np.array([points[i] for i in good], np.float64).reshape(-1, 4, 2)
                    x, y, z = np.moveaxis(homographies(frame, quads) @ grid, 1, 0)
                    ok = np.isfinite(x).all(1) & (np.abs(z) > 1e-12).all(1)
                    images = np.array([values[i] for i in good], np.float64).reshape(len(good), -1, width)
                    sampled = bilinear(images[ok], x[ok] / z[ok], y[ok] / z[ok])
                    for i, row in zip(np.array(good)[ok].tolist(), sampled, strict=True):
                        made[i] = row
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.list_(pa.float64()))], names=[*keep, out])

    keep = [c for c in df.columns if c not in (out, data, corners)]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` array<double>"])
    return df.select(*(F.col(f"`{c}`") for c in (*keep, data, corners))).mapInArrow(run, schema)
