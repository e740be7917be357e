"""Image files as rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images, one a row: struct ``image`` with origin, height, width, nChannels, mode and data (B, G, R)."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(path)


def grey_images(gallery: DataFrame, side: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of ``side * side`` places in [-1, 1] as grey images of the image source's form: (id, image)."""
    sample = F.transform(F.col(vector_col), lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255))), 2, "0"))
    image = F.struct(
        F.concat(F.lit("vector:"), F.col(id_col).cast("string")).alias("origin"), F.lit(side).alias("height"), F.lit(side).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.array_join(sample, "")).alias("data"),
    )
    return gallery.where(F.size(vector_col) == side * side).select(id_col, image.alias("image"))


def write_png(images: DataFrame, root: str, id_col: str = "vec_id") -> None:
    """Write each grey image as ``root/{id}.png``, from the tasks that hold it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        files.create_dir(folder, recursive=True)

        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        for batch in batches:
            for r in batch.itertuples(index=False):
                lines = b"".join(b"\0" + r.data[k : k + r.width] for k in range(0, len(r.data), r.width))
                head = struct.pack(">IIBBBBB", r.width, r.height, 8, 0, 0, 0, 0)
                with files.open_output_stream(f"{folder}/{r.id}.png") as out:
                    out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
            yield batch[["id"]]

    images.select(F.col(id_col).alias("id"), "image.height", "image.width", "image.data").mapInPandas(write, "id long").write.format("noop").mode("overwrite").save()
