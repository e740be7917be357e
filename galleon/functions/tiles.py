"""Overlapping tiles of images on a pyramid, as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pyramid(grey: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """The image, then each time half its sides (means of 2 x 2 samples, rounded down), while both are ``least`` or more."""
    while min(grey.shape) >= least:
        yield grey
        h, w = grey.shape[0] // 2 * 2, grey.shape[1] // 2 * 2
        grey = (grey[:h:2, :w:2] + grey[1:h:2, :w:2] + grey[:h:2, 1:w:2] + grey[1:h:2, 1:w:2]) // 4


def tiles_of(grey: np.ndarray, side: int, step: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(level, top, left, samples) of the tiles that lie in the image, ``step`` apart on each level."""
    for level, a in enumerate(pyramid(grey.astype(np.int64), side)):
        for top in range(0, a.shape[0] - side + 1, step):
            for left in range(0, a.shape[1] - side + 1, step):
                yield level, top, left, a[top : top + side, left : left + side].astype(np.uint8).tobytes()


@F.arrow_udtf(returnType="id long, level int, top int, left int, samples binary")
class Tiles:
    """``Tiles(TABLE(images))``, with columns id, height, width, channels, data, side and step: a row for each tile.

    An image that is null, invalid or smaller than a tile gives none.
    """

    def eval(self, images: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for ident, h, w, c, d, side, step in zip(*(images.column(n).to_pylist() for n in ("id", "height", "width", "channels", "data", "side", "step")), strict=True):
            if None not in (h, w, c, d) and h > 0 and w > 0 and len(d) == h * w * c:
                # Colours become grey by their mean, rounded down; a fourth channel is left out.
                grey = np.frombuffer(d, np.uint8).reshape(h, w, c)[:, :, :3].sum(2, dtype=np.int64) // min(c, 3)
                rows += [(ident, *tile) for tile in tiles_of(grey, side, step)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.table({n: pa.array(c, k) for n, c, k in zip(("id", "level", "top", "left", "samples"), columns, kinds, strict=True)})


def image_tiles(images: DataFrame, side: int = 4, step: int = 2, id_col: str = "vec_id") -> DataFrame:
    """(id, level, top, left, samples): the tiles of each decoded image (struct ``image``), by the table function ``Tiles``.

    Null and invalid images, and ones smaller than a tile, give no row; rows that repeat
    an id, or have none, are images of their own; an empty table gives no row.
    """
    flat = images.select(
        F.col(id_col).cast("long").alias("id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"), F.lit(side).alias("side"), F.lit(step).alias("step"),
    )
    return Tiles(flat.asTable()).withColumnRenamed("id", id_col)
