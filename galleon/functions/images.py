"""Descriptors of decoded images (struct ``image`` of the image source)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _samples(image) -> np.ndarray | None:
    """Height x width x channels, or None for an invalid image."""
    if image.height is None or image.height <= 0 or image.width <= 0:
        return None
    return np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.nChannels)


def color_histogram(image: Column, bins: int = 4) -> Column:
    """Share of pixels in each of ``bins`` ^ 3 cells of the first three channels (a grey channel counts for all); null if invalid."""

    @pandas_udf("array<double>")
    def histogram(images: pd.DataFrame) -> pd.Series:
        out = []
        for row in images.itertuples(index=False):
            a = _samples(row)
            if a is None:
                out.append(None)
                continue
            a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a[:, :, :3]
            cell = (a.reshape(-1, 3).astype(int) * bins // 256) @ np.array([bins * bins, bins, 1])
            out.append(np.bincount(cell, minlength=bins**3) / len(cell))
        return pd.Series(out)

    return histogram(image)


def histogram_intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller shares of two histograms: 1 for equal ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def average_hash(image: Column, size: int = 8) -> Column:
    """Bits of ``size`` x ``size`` block means above their mean, as a long (size 8 at most); null if invalid.

    An image smaller than the grid repeats its rows and columns.
    """

    @pandas_udf("long")
    def bits(images: pd.DataFrame) -> pd.Series:
        out = []
        for row in images.itertuples(index=False):
            a = _samples(row)
            if a is None:
                out.append(None)
                continue
            grey = a[:, :, :3].mean(2)
            for axis in (0, 1):
                edges = np.arange(size + 1) * grey.shape[axis] // size
                grey = np.stack([np.take(grey, range(low, max(high, low + 1)), axis).mean(axis) for low, high in zip(np.minimum(edges[:-1], grey.shape[axis] - 1), edges[1:], strict=True)], axis)
            code = np.packbits((grey > grey.mean()).ravel()[::-1])
            out.append(int.from_bytes(code.tobytes(), "big", signed=len(code) == 8))
        return pd.Series(out, dtype="Int64")

    return bits(image)


def hash_distance(a: Column, b: Column) -> Column:
    """Bits that differ between two hashes."""
    return F.bit_count(a.bitwiseXOR(b))
