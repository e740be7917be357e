"""Shards of images: many images a file, a header for each, read by byte range.

A shard is the compressed samples of its images one after another, then an index
with a header of fixed size for each, then the place of the index. So a reader
that wants some images fetches the index and the bytes of these images only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

HEADER = np.dtype([("id", "<i8"), ("offset", "<i8"), ("length", "<i4"), ("height", "<i4"), ("width", "<i4"), ("channels", "<i4"), ("crc", "<u4")])
END = b"imgshard"
NAMES = ["id", "height", "width", "channels", "data", "fetched"]
SCHEMA = "id long, height int, width int, channels int, data binary, fetched long"
#: Header fields that a filter can be pushed down to.
FIELDS = ("id", "height", "width", "channels")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_shard(path: str, images: Iterator[tuple[int, int, int, int, bytes]]) -> int:
    """Write images (id, height, width, channels, samples) as one shard; returns its size."""
    files, name = opened(path)
    headers, at = [], 0
    with files.open_output_stream(name) as out:
        for ident, height, width, channels, data in images:
            body = zlib.compress(data)
            out.write(body)
            headers.append((ident, at, len(body), height, width, channels, zlib.crc32(body)))
            at += len(body)
        index = np.array(headers, HEADER).tobytes()
        out.write(index)
        out.write(np.array([at, len(headers)], "<i8").tobytes() + END)
    return at + len(index) + 24


def read_index(source, size: int) -> tuple[np.ndarray, int]:
    """The headers of an open shard, and the bytes that took."""
    tail = source.read_at(24, size - 24)
    if tail[16:] != END:
        raise ValueError("not a shard of images")
    at, n = (int(x) for x in np.frombuffer(tail[:16], "<i8"))
    index = source.read_at(n * HEADER.itemsize, at)
    return np.frombuffer(index, HEADER), 24 + len(index)


def matching(headers: np.ndarray, filters: list[tuple[str, str, object]]) -> np.ndarray:
    """Whether each header meets all filters (field, comparison, value)."""
    keep = np.ones(len(headers), bool)
    compare = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": np.isin}
    for field, how, value in filters:
        keep &= compare[how](headers[field], value)
    return keep


def read_range(path: str, low: int, high: int, filters: list[tuple[str, str, object]]) -> Iterator[tuple]:
    """The images that begin in [low, high) of a shard and meet the filters, as rows of ``SCHEMA``.

    ``fetched`` is what an image's bytes, and for the first one the index, took.
    """
    files, name = opened(path)
    with files.open_input_file(name) as source:
        headers, fetched = read_index(source, source.size())
        wanted = headers[matching(headers, filters) & (headers["offset"] >= low) & (headers["offset"] < high)]
        for h in wanted:
            body = source.read_at(int(h["length"]), int(h["offset"]))
            if zlib.crc32(body) != h["crc"]:
                raise ValueError(f"image {h['id']} of {path} is damaged")
            yield int(h["id"]), int(h["height"]), int(h["width"]), int(h["channels"]), zlib.decompress(body), fetched + len(body)
            fetched = 0


def _batches(rows: Iterator[tuple], size: int = 512) -> Iterator[pa.RecordBatch]:
    kinds, held = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()], []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], NAMES)


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int


class ShardReader(DataSourceReader):
    """Splits shards into byte ranges of ``split_bytes``; filters on header fields are kept for the tasks."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes, self.filters = path, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            field = f.attribute[0] if len(f.attribute) == 1 else None
            if field in FIELDS and isinstance(f, IsNotNull):
                continue  # a header is never null
            value = getattr(f, "value", None)
            if field in FIELDS and type(f) in signs and value is not None and (type(f) is not In or None not in value):
                self.filters.append((field, signs[type(f)], list(value) if type(f) is In else value))
            else:
                yield f

    def partitions(self) -> list[ByteRange]:
        files, folder = opened(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".shard")]
        root = self.path.rstrip("/")
        return [ByteRange(f"{root}/{f.base_name}", low, low + self.split_bytes) for f in sorted(found, key=lambda f: f.base_name) for low in range(0, f.size, self.split_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(read_range(partition.path, partition.low, partition.high, self.filters)) if partition else iter(())


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShardWriter(DataSourceArrowWriter):
    """Tasks write shards of about ``shard_bytes`` of samples aside; the commit moves them into place, an abort removes them."""

    def __init__(self, path: str, shard_bytes: int, overwrite: bool):
        self.path, self.shard_bytes, self.overwrite = path.rstrip("/"), shard_bytes, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        aside = f"{self.path}/_aside-{self.job}"
        files, folder = opened(aside)
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        rows = (row for batch in iterator for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in NAMES[:5]), strict=True))
        first = next(rows, None)
        while first is not None:
            rest: list = []

            def shard(first=first, rest=rest) -> Iterator[tuple]:
                n = len(first[4])
                yield first
                for row in rows:
                    if n >= self.shard_bytes:
                        rest.append(row)
                        return
                    n += len(row[4])
                    yield row

            names.append(f"{uuid.uuid4().hex}.shard")
            write_shard(f"{aside}/{names[-1]}", shard())
            first = rest[0] if rest else None
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = opened(self.path)
        old = [f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".shard")]
        for message in messages:
            for name in message.names if message else []:
                files.move(f"{folder}/_aside-{self.job}/{name}", f"{folder}/{name}")
        for path in old if self.overwrite else []:
            files.delete_file(path)
        self._clear(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/_aside-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/_aside-{self.job}")


class ImageShards(DataSource):
    """``spark.read.format("image_shards").load(path)``, and ``write`` with modes append and overwrite.

    Reading gives ``SCHEMA``, with ``fetched`` bytes for each image. Options:
    ``split_bytes`` of a partition, ``shard_bytes`` of a written file. Writing takes
    id, height, width, channels and data, none of them null; other columns are
    left out. Repeated ids are images of their own; a folder without shards gives no row.
    Filters reach the headers where ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    @classmethod
    def name(cls) -> str:
        return "image_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("shard_bytes", 64 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageShards)


def in_shards(images: DataFrame, root: str, per_shard: int = 4096, id_col: str = "vec_id") -> DataFrame:
    """Write decoded images to shards when the result is read: (path, size), a row for each shard.

    Nothing is written before. Each attempt of a task writes files of its own, and a
    row names the file that its own attempt has finished.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(root)
        files.create_dir(folder, recursive=True)
        held: list = []

        def flush() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.shard"
            size = write_shard(path, iter(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == per_shard:
                    yield flush()
        if held:
            yield flush()

    flat = images.where(F.col(id_col).isNotNull() & F.col("image.data").isNotNull())
    return flat.select(F.col(id_col).cast("long"), "image.height", "image.width", F.col("image.nChannels"), "image.data").mapInArrow(write, "path string, size long")


def from_shards(shards: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """The images of shards (path, size), as rows of ``SCHEMA``: each shard is read in byte ranges."""
    ranges = shards.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("low"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(read_range(path, low, low + split_bytes, []))

    return ranges.mapInArrow(read, SCHEMA)
