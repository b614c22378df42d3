"""The single-file archive format with a Hilbert-ordered directory (version 3): header, directories
and payloads; a data source that reads it, and a writer. Compression codes are 0 none, 1 gzip and, where its
module is installed, 2 brotli; gzip is recognised by its magic bytes when read, and other codes are an error.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadlake.functions.tile import hilbert_id, hilbert_number, hilbert_tiles

MAGIC, HEADER = b"PMTiles", struct.Struct("<7sB11Q6B4iB2i")
FIELDS = (
    "magic version root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length addressed_tiles tile_entries tile_contents "
    "clustered internal_compression tile_compression tile_type min_zoom max_zoom min_lon min_lat max_lon max_lat center_zoom center_lon center_lat"
).split()


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def brotli():
    """The brotli module, which is not needed for anything else."""
    try:
        import brotli as module
    except ImportError as e:
        raise ValueError("compression 2 needs the brotli module, which is not installed") from e
    return module


def unpacked(data: bytes, code: int) -> bytes:
    """Plain bytes: by magic, else by code (0 none, 1 gzip, 2 brotli)."""
    if data[:2] == b"\x1f\x8b":
        return gunzip(data)
    if code in (0, 1):
        return data
    if code == 2:
        return brotli().decompress(data) if data else data
    raise ValueError(f"unknown compression {code}")


def packed(data: bytes, code: int) -> bytes:
    if code == 0:
        return data
    if code == 1:
        return gzip.compress(data, mtime=0)
    if code == 2:
        return brotli().compress(data, quality=5, lgwin=22)
    raise ValueError(f"compression {code} cannot be written here")


def _by_row(data: Column, change) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else change(bytes(x)))

    return run(data)


def gzipped(data: Column) -> Column:
    return _by_row(data, lambda x: gzip.compress(x, 6, mtime=0))


def gunzipped(data: Column) -> Column:
    return _by_row(data, gunzip)


def is_gzip(data: Column) -> Column:
    return F.substring(data, 1, 2) == F.unhex(F.lit("1F8B"))


def write_varints(values) -> bytes:
    out = bytearray()
    for v in values:
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def read_varints(data: bytes) -> list[int]:
    """All numbers of a byte string, by their last bytes."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    out, start = [], 0
    for end in last.tolist():
        out.append(sum((data[i] & 0x7F) << 7 * (i - start) for i in range(start, end + 1)))
        start = end + 1
    if start < len(data):
        raise ValueError("a number is cut short")
    return out


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (tile_id, offset, length, run_length) in order of ids, column by column."""
    ids = [e[0] for e in entries]
    next_ = [0, *(o + n for _, o, n, _ in entries)]
    offsets = [0 if i and e[1] == next_[i] else e[1] + 1 for i, e in enumerate(entries)]
    return write_varints([len(entries), *(b - a for a, b in zip([0, *ids], ids, strict=False)), *(e[3] for e in entries), *(e[2] for e in entries), *offsets])


def decode_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    values = read_varints(data)
    n = values[0] if values else 0
    if len(values) < 1 + 4 * n:
        raise ValueError("a directory is cut short")
    ids = np.cumsum(np.array(values[1 : n + 1], dtype=object)).tolist() if n else []
    runs, lengths, raw = values[n + 1 : 2 * n + 1], values[2 * n + 1 : 3 * n + 1], values[3 * n + 1 : 4 * n + 1]
    offsets: list[int] = []
    for i, o in enumerate(raw):
        if o == 0 and i == 0:
            raise ValueError("the first entry has no offset")
        offsets.append(offsets[-1] + lengths[i - 1] if o == 0 else o - 1)
    return list(zip(ids, offsets, lengths, runs, strict=True))


def read_header(data: bytes) -> dict:
    if len(data) < HEADER.size or data[:7] != MAGIC:
        raise ValueError("not a version 3 archive")
    return dict(zip(FIELDS, HEADER.unpack_from(data), strict=True))


def write_header(**values) -> bytes:
    whole = {f: 0 for f in FIELDS} | {"magic": MAGIC, "version": 3, "min_lon": -1_800_000_000, "min_lat": -850_000_000, "max_lon": 1_800_000_000, "max_lat": 850_000_000} | values
    return HEADER.pack(*(whole[f] for f in FIELDS))


class _Leaf(InputPartition):
    def __init__(self, entries):
        self.entries = entries


class ArchiveSource(DataSource):
    """Tiles of an archive: zoom, x, y, tile_bytes, tile_data (null unless includeData is true), tile_id.

    Each leaf directory, and up to 10 000 entries of the root, is a partition. ``zoom`` reads one zoom only, and
    with ``x`` and ``y`` one tile: its ids are one range, and leaves beyond it are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "zoom int, x long, y long, tile_bytes long, tile_data binary, tile_id long"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


#: Rows and payload bytes of an Arrow batch.
ROWS, BYTES = 8192, 16 << 20
_SCHEMA = pa.schema([("zoom", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("tile_bytes", pa.int64()), ("tile_data", pa.binary()), ("tile_id", pa.int64())])


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.data = options["path"], str(options.get("includedata", options.get("includeData", "false"))).lower() == "true"
        if not self.path.endswith(".pmtiles"):
            raise ValueError("the path of an archive ends in .pmtiles")
        with open(self.path, "rb") as f:
            self.header = read_header(f.read(HEADER.size))
        # The ids that are read.
        self.low, self.high = 0, 1 << 63
        if "zoom" in options:
            z = int(options["zoom"])
            self.low, self.high = (4**z - 1) // 3, (4 ** (z + 1) - 1) // 3
            if "x" in options and "y" in options:
                x, y = int(options["x"]), int(options["y"])
                inside = 0 <= x < 1 << z and 0 <= y < 1 << z
                self.low = hilbert_number(z, x, y) if inside else 0
                self.high = self.low + int(inside)

    def _at(self, offset: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(length)

    def directory(self, offset: int, length: int) -> list[tuple[int, int, int, int]]:
        return decode_directory(unpacked(self._at(offset, length), self.header["internal_compression"]))

    def wanted(self, entries: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Entries that may have ids of the range: runs that overlap it, and leaves that begin below its end, up
        from the last one that begins at its begin or before."""
        out, ends = [], [e[0] for e in entries[1:]] + [1 << 63]
        for e, end in zip(entries, ends, strict=True):
            last = e[0] + e[3] if e[3] else end
            if e[0] < self.high and last > self.low:
                out.append(e)
        return out

    def partitions(self) -> list[InputPartition]:
        root = self.wanted(self.directory(self.header["root_offset"], self.header["root_length"]))
        own = [e for e in root if e[3]]
        return [_Leaf([e]) for e in root if not e[3] and e[2]] + [_Leaf(own[i : i + 10_000]) for i in range(0, len(own), 10_000)] or [_Leaf([])]

    def read(self, partition: _Leaf) -> Iterator[pa.RecordBatch]:
        todo = list(partition.entries)
        ids, lengths, data, size = [], [], [], 0
        with open(self.path, "rb") as f:
            while todo:
                tile, offset, length, run = todo.pop()
                if not run:
                    todo += self.wanted(self.directory(self.header["leaf_offset"] + offset, length)) if length else []
                    continue
                payload = None
                if self.data:
                    f.seek(self.header["data_offset"] + offset)
                    payload = f.read(length)
                lo, hi = max(tile, self.low), min(tile + run, self.high)
                while lo < hi:
                    n = min(hi - lo, max(1, min(ROWS - len(ids), (BYTES - size) // max(1, length * self.data))))
                    ids.append(np.arange(lo, lo + n)), lengths.append(np.full(n, length))
                    data += [payload] * n
                    size += n * length * self.data
                    lo += n
                    if len(data) >= ROWS or size >= BYTES:
                        yield _batch(ids, lengths, data)
                        ids, lengths, data, size = [], [], [], 0
        if data:
            yield _batch(ids, lengths, data)


def _batch(ids: list[np.ndarray], lengths: list[np.ndarray], data: list) -> pa.RecordBatch:
    number = np.concatenate(ids)
    z, x, y = hilbert_tiles(number)
    return pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x), pa.array(y), pa.array(np.concatenate(lengths), pa.int64()), pa.array(data, pa.binary()), pa.array(number, pa.int64())], schema=_SCHEMA)


def metadata(path: str) -> dict:
    """The archive's metadata; values that are not strings as JSON text."""
    with open(path, "rb") as f:
        head = read_header(f.read(HEADER.size))
        f.seek(head["metadata_offset"])
        raw = unpacked(f.read(head["metadata_length"]), head["internal_compression"])
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in (json.loads(raw) if raw else {}).items()}


#: Ranges of ids that entries are cut to for running sums.
RANGES = 1 << 14


def offsets(entries: DataFrame) -> DataFrame:
    """Entries (tile_id, length) with their offset in the data section and the step of ids.

    A running sum over all rows: ids are cut to ``RANGES`` ranges between the least and the greatest, ranges are
    summed first, and only those sums, of a bounded number, go to one task."""
    bounds = entries.agg(F.min("tile_id").alias("_lo"), F.max("tile_id").alias("_hi"))
    ranged = entries.crossJoin(F.broadcast(bounds)).withColumn("part", F.expr(f"(tile_id - _lo) div ((_hi - _lo) div {RANGES} + 1)")).drop("_lo", "_hi")
    parts = ranged.groupBy("part").agg(F.sum("length").alias("sum"), F.max("tile_id").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("last"))
    own = Window.partitionBy("part").orderBy("tile_id")
    rows = ranged.join(F.broadcast(parts), "part")
    return rows.select(
        *entries.columns, (F.col("base") + F.coalesce(F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"),
        (F.col("tile_id") - F.coalesce(F.lag("tile_id").over(own), F.col("last"))).alias("delta"),
    )


def write(tiles: DataFrame, path: str, info: dict | None = None, entries_in_root: int = 4096) -> None:
    """Write tiles (zoom, x, y, tile_data) as one file. Tiles are sorted on the executors and streamed
    to the driver, one partition at a time; large directories are split to leaves."""
    rows = tiles.withColumn("tile_id", hilbert_id(F.col("zoom"), F.col("x"), F.col("y"))).repartitionByRange("tile_id").sortWithinPartitions("tile_id").select("tile_id", "zoom", "tile_data")
    entries, zooms, at, first = [], set(), 0, b""
    import os
    import tempfile

    with tempfile.TemporaryFile(dir=os.path.dirname(os.path.abspath(path))) as body:
        for row in rows.toLocalIterator():
            data = bytes(row.tile_data)
            first = first or data
            body.write(data)
            entries.append((row.tile_id, at, len(data), 1))
            zooms.add(row.zoom)
            at += len(data)
        leaves, root = b"", entries
        if len(entries) > entries_in_root:
            root = []
            for i in range(0, len(entries), entries_in_root):
                own = encode_directory(entries[i : i + entries_in_root])
                root.append((entries[i][0], len(leaves), len(own), 0))
                leaves += own
        directory, text = encode_directory(root), json.dumps(info or {}).encode()
        n, start = len(entries), HEADER.size
        head = write_header(
            root_offset=start, root_length=len(directory), metadata_offset=start + len(directory), metadata_length=len(text), leaf_offset=start + len(directory) + len(text), leaf_length=len(leaves),
            data_offset=start + len(directory) + len(text) + len(leaves), data_length=at, addressed_tiles=n, tile_entries=n, tile_contents=n, tile_compression=int(first[:2] == b"\x1f\x8b"), tile_type=1,
            min_zoom=min(zooms, default=0), max_zoom=max(zooms, default=0),
        )
        body.seek(0)
        with open(path, "wb") as out:
            out.write(head + directory + text + leaves)
            while part := body.read(1 << 20):
                out.write(part)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
