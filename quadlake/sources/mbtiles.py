"""Tiles in SQLite files: a data source, and a writer. Rows are used as they are stored (no flip)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FROM_ZOOM, PARTS = 12, 32
#: Rows and payload bytes of an Arrow batch.
ROWS, BYTES = 8192, 16 << 20
#: Tiles of a scan that is worth more than one task.
FEW = 4096


def connect(path: str, cache_mb: int = 200) -> sqlite3.Connection:
    if not path.endswith(".mbtiles"):
        raise ValueError("the path ends in .mbtiles")
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.execute("PRAGMA query_only = 1")
    db.execute(f"PRAGMA cache_size = -{cache_mb * 1024}")
    return db


def _names(db: sqlite3.Connection) -> dict[str, str]:
    return dict(db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view')"))


def layout(db: sqlite3.Connection) -> tuple[str, str, str]:
    """(relation, payload, relation for counts): one table or view, or two tables joined."""
    names = _names(db)
    if "tiles" in names:
        return "tiles", "tile_data", "tiles_shallow" if names.get("tiles_shallow") == "table" else "tiles"
    if "map" in names and "images" in names:
        return "map JOIN images USING (tile_id)", "images.tile_data", "map"
    raise ValueError("neither tiles nor map and images are there")


def is_split(path: str) -> bool:
    """Whether tiles are stored as map and images."""
    db = connect(path)
    try:
        return layout(db)[0] != "tiles"
    finally:
        db.close()


def column_ranges(zoom: int, parts: int = PARTS) -> list[tuple[int, int]] | None:
    """Equal ranges of columns of a zoom; none below FROM_ZOOM or from 33 on."""
    if not FROM_ZOOM <= zoom < 33:
        return None
    side = 1 << zoom
    step = -(-side // parts)
    return [(lo, min(lo + step, side) - 1) for lo in range(0, side, step)]


def supports_rowid(db: sqlite3.Connection, relation: str) -> bool:
    """Whether a relation is a table with row ids (views and tables without them are not)."""
    if _names(db).get(relation) != "table":
        return False
    try:
        db.execute(f"SELECT rowid FROM {relation} LIMIT 1")
    except sqlite3.OperationalError:
        return False
    return True


def rowid_bounds(db: sqlite3.Connection, relation: str) -> tuple[int, int] | None:
    """The least and the greatest row id; none without rows."""
    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {relation}").fetchone()
    return None if low is None else (low, high)


def rowid_ranges(low: int, high: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Equal ranges of row ids, from the least to the greatest."""
    step = -(-(high - low + 1) // parts)
    return [(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]


def packed_zooms(counts: dict[int, int], parts: int = PARTS) -> list[list[int]]:
    """Zooms dealt to ``parts`` readers: the largest first, each to the reader with the fewest tiles."""
    bins: list[list] = [[0, []] for _ in range(max(1, min(parts, len(counts))))]
    for zoom, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        least = min(bins, key=lambda b: b[0])
        least[0] += n
        least[1].append(zoom)
    return [sorted(zooms) for _, zooms in bins if zooms]


class _Part(InputPartition):
    """Conditions of a scan: rows to which all of them apply."""

    def __init__(self, where: str = "1", given: tuple = ()):
        self.where, self.given = where, given


class MBTilesSource(DataSource):
    """zoom, x, y, tile_bytes, tile_data (null unless includeData is true). ``zoom`` reads one zoom only, and with
    ``x`` and ``y`` one tile, by the file's index. ``table`` = "metadata" reads name, value instead (no rows
    without that table).

    A table with row ids is cut to ranges of them; else zooms from 12 on are cut to ranges of columns, and the
    others are dealt out by their numbers of tiles."""

    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return "name string, value string" if self.options.get("table") == "metadata" else "zoom int, x long, y long, tile_bytes long, tile_data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


_SCHEMA = pa.schema([("zoom", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("tile_bytes", pa.int64()), ("tile_data", pa.binary())])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.meta = options["path"], options.get("table") == "metadata"
        self.data = str(options.get("includedata", options.get("includeData", "false"))).lower() == "true"
        # Options, not pushed filters: Spark keeps what a filter pushed for later scans of the same frame.
        self.place = [(c, int(options[k])) for k, c in (("zoom", "zoom_level"), ("x", "tile_column"), ("y", "tile_row")) if k in options]
        connect(self.path).close()

    def partitions(self) -> list[InputPartition]:
        if self.meta:
            return [_Part()]
        db = connect(self.path)
        try:
            relation, _, counted = layout(db)
            given = tuple(v for _, v in self.place)
            where = " AND ".join(f"{c} = ?" for c, _ in self.place) or "1"
            if len(self.place) == 3:
                return [_Part(where, given)]
            zoom = dict(self.place).get("zoom_level")
            if zoom is not None and not 0 <= zoom <= 255:
                raise ValueError("a zoom level is out of range")
            if relation == "tiles" and zoom is None and supports_rowid(db, relation):
                if db.execute("SELECT 1 FROM tiles WHERE zoom_level NOT BETWEEN 0 AND 255 LIMIT 1").fetchone():
                    raise ValueError("a zoom level is out of range")
                bounds = rowid_bounds(db, relation)
                parts = 1 if bounds and bounds[1] - bounds[0] < FEW else PARTS
                return [_Part("tiles.rowid BETWEEN ? AND ?", r) for r in rowid_ranges(*bounds, parts)] if bounds else [_Part("0")]
            counts = dict(db.execute(f"SELECT zoom_level, count(*) FROM {counted} WHERE {where} GROUP BY zoom_level", given))
            if any(not 0 <= z <= 255 for z in counts):
                raise ValueError("a zoom level is out of range")
            # Columns that tiles are in bound the ranges, so no reader gets an empty half of the world.
            out, small = [], {}
            for z, n in sorted(counts.items()):
                if n < FEW:
                    small[z] = n
                    continue
                lo, hi = db.execute(f"SELECT min(tile_column), max(tile_column) FROM {counted} WHERE zoom_level = ?", (z,)).fetchone()
                ranges = column_ranges(z) or rowid_ranges(lo, hi)
                out += [_Part("zoom_level = ? AND tile_column BETWEEN ? AND ?", (z, *r)) for r in ranges if r[0] <= hi and r[1] >= lo]
            out += [_Part(f"zoom_level IN ({', '.join('?' * len(zs))})", tuple(zs)) for zs in (packed_zooms(small) if sum(small.values()) >= FEW else [sorted(small)]) if zs]
            return out or [_Part("0")]
        finally:
            db.close()

    def read(self, partition: _Part) -> Iterator[tuple | pa.RecordBatch]:
        db = connect(self.path)
        try:
            if self.meta:
                if "metadata" in _names(db):
                    yield from db.execute("SELECT name, value FROM metadata")
                return
            relation, payload, _ = layout(db)
            found = db.execute(f"SELECT zoom_level, tile_column, tile_row, length({payload}), {payload if self.data else 'NULL'} FROM {relation} WHERE {partition.where}", partition.given)
            rows, size = [], 0
            for row in found:
                rows.append(row)
                size += row[3] or 0
                if len(rows) >= ROWS or self.data and size >= BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        finally:
            db.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def write(tiles: DataFrame, path: str, metadata: dict[str, str] | None = None, two_tables: bool = False, by_place: bool = False, cache_mb: int = 200) -> None:
    """Write tiles in order of zoom, x, y to a new file; partitions are streamed to the driver, as the
    format is one file with one writer. ``two_tables``: map and images, equal payloads stored once, or, ``by_place``,
    each tile's under the name z-x-y."""
    import hashlib

    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA temp_store = MEMORY")
    db.execute(f"PRAGMA cache_size = -{cache_mb * 1024}")
    with db:
        db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", sorted((metadata or {}).items()))
        place = "zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER"
        if two_tables:
            db.execute(f"CREATE TABLE map ({place}, tile_id TEXT)")
            db.execute("CREATE TABLE images (tile_id TEXT PRIMARY KEY, tile_data BLOB)")
        else:
            db.execute(f"CREATE TABLE tiles ({place}, tile_data BLOB)")
        for r in tiles.select("zoom", "x", "y", "tile_data").orderBy("zoom", "x", "y").toLocalIterator():
            data = bytes(r.tile_data)
            if two_tables:
                key = f"{r.zoom}-{r.x}-{r.y}" if by_place else hashlib.sha256(data).hexdigest()
                db.execute("INSERT INTO map VALUES (?, ?, ?, ?)", (r.zoom, r.x, r.y, key))
                db.execute("INSERT OR IGNORE INTO images VALUES (?, ?)", (key, data))
            else:
                db.execute("INSERT INTO tiles VALUES (?, ?, ?, ?)", (r.zoom, r.x, r.y, data))
    db.execute("PRAGMA journal_mode = DELETE")  # one file is left
    db.close()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MBTilesSource)
