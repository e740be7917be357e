"""Media columns: content-addressed payloads in tar shards, read by byte ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import payload, shared_path, small_batches, stored

#: Samples in a row of the grey image that holds a payload.
WIDTH = 576
#: The bytes of a PNG file up to the end of its header chunk.
HEADER = 33


def to_png(data: bytes) -> bytes:
    """A payload, whose length is a positive multiple of WIDTH, as an 8-bit grey PNG."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a grey PNG that ``to_png`` wrote."""
    width, height, _ = png_header(data)
    body, at = [], 8
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def sample_feature(samples: bytes) -> str:
    """Shares of the 16 sample ranges in thousandths, and the mean sample: a grey histogram."""
    a = np.frombuffer(samples, np.uint8)
    shares = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    return f"grey16:{','.join(map(str, shares))};mean:{int(a.sum(dtype=np.int64)) * 1000 // len(a)}"


def _store(uri: str):
    """File system and path of a shard, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_shards(rows: DataFrame, root: str, shard_bytes: int = 256 << 20, encode=to_png) -> DataFrame:
    """Store payloads in tar shards under ``root``; returns the manifest, one row per digest.

    ``rows`` has (digest, payload). Each task appends the payloads that it reads
    to shards of its own, each distinct one once, so that no payload is shuffled.
    Only the short entries meet: of the places that different tasks have for one
    digest the manifest keeps the first. A task can leave at most one spare copy
    of a digest, however many rows share it. The manifest has (digest, shard,
    offset, length), with the offset of the member's first byte of content; each
    member is named by its digest. An empty table gives an empty manifest and no
    shard; other columns are ignored; neither column may be null.

    A shard's name carries the attempt that wrote it: a task that runs again
    after a loss writes new files, and the manifest only names complete ones.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, seen, done = TaskContext.get(), 0, set(), []
        out = tar = None
        name = ""

        def close() -> pa.RecordBatch:
            tar.close(), out.close()
            entries = zip(zip(*done, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in entries], ["digest", "shard", "offset", "length"])

        for batch in batches:
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest in seen:
                    continue
                if len(seen) < 1_000_000:  # beyond that a repeated payload may be stored again
                    seen.add(digest)
                if tar is None:
                    name = f"{root}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.tar"
                    files, path = _store(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                media = encode(data.as_py())
                member = tarfile.TarInfo(digest.hex())
                member.size = len(media)
                tar.addfile(member, io.BytesIO(media))
                done.append((digest, name, tar.offset - -(-len(media) // 512) * 512, len(media)))
                if tar.offset >= shard_bytes:
                    yield close()
                    done, tar, part = [], None, part + 1
        if tar is not None:
            yield close()

    entries = stored(rows.select("digest", "payload").mapInArrow(write, "digest binary, shard string, offset long, length long"), "entries")
    first = entries.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return stored(first.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset"), "manifest")


def _ranges(batches: Iterator[pa.RecordBatch]):
    """Each batch, with a function that reads part of a row's object; one shard is open at a time."""
    at, file = None, None
    for batch in batches:
        shards, offsets = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()

        def read(i: int, n: int, shards=shards, offsets=offsets) -> bytes:
            nonlocal at, file
            if shards[i] != at:
                files, path = _store(shards[i])
                at, file = shards[i], files.open_input_file(path)
            return file.read_at(n, offsets[i])

        yield batch, read


def read_headers(manifest: DataFrame) -> DataFrame:
    """Add (width, height, bit_depth) from the first HEADER bytes of each object, and nothing else."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, read in _ranges(batches):
            found = [png_header(read(i, HEADER)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bit_depth"])

    return manifest.mapInArrow(heads, ", ".join(f"{n} {t}" for n, t in manifest.dtypes) + ", width int, height int, bit_depth int")


def read_features(manifest: DataFrame) -> DataFrame:
    """Read each object back in full and describe its samples."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, read in _ranges(batches):
            out = []
            for i, n in enumerate(batch.column("length").to_pylist()):
                media = read(i, n)
                samples = from_png(media)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), sample_feature(samples)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["digest", *FEATURES])

    return manifest.mapInArrow(describe, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Move texts into tar shards and give each row its media columns.

    A payload is the text's UTF-8 bytes, filled with bytes 255 up to a positive
    multiple of WIDTH. Equal texts share one object. Returns (id, n_bytes, shard,
    offset, length, width, height) and the features read back from the stored
    bytes. A null text counts as empty; each input row, null id or repeated row
    included, gives one row; an empty table gives none. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    root = shared_path(docs.sparkSession, "media")
    data = payload(text_col)
    n = F.octet_length(data)
    short = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(F.lit(WIDTH) - F.pmod(n, F.lit(WIDTH)), F.lit(WIDTH)))
    filler = F.unhex(F.lit("FF" * WIDTH))
    full = F.concat(data, F.substring(filler, F.lit(1), short))
    rows = docs.select(F.col(id_col).alias(id_col), n.cast("long").alias("n_bytes"), full.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    manifest = write_shards(rows, root)
    # Written, so that the last join has two fresh shuffles and Spark can split the rows of one digest.
    objects = stored(read_headers(manifest).join(read_features(manifest), "digest"), "objects")
    return rows.select(id_col, "n_bytes", "digest").join(objects, "digest").drop("bit_depth")
