"""Vector tiles: decoding to a feature relation and encoding back, in Arrow batches."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.sources.archive import gunzip, write_varints

PROP = "struct<kind: string, s: string, d: double, b: boolean, text: string, exact: string>"
FEATURES = (
    "zoom int, x long, y long, layer string, layer_index int, extent int, feature_index long, feature_id decimal(20,0), geom_type string, "
    f"geometry array<array<struct<x: float, y: float>>>, vertices long, properties map<string, {PROP}>"
)
_KEYS = [("zoom", pa.int32()), ("x", pa.int64()), ("y", pa.int64())]
_TILES = pa.schema([*_KEYS, ("tile_data", pa.binary())])
_PROP = pa.struct([("kind", pa.string()), ("s", pa.string()), ("d", pa.float64()), ("b", pa.bool_()), ("text", pa.string()), ("exact", pa.string())])
_FEATURES = pa.schema([
    *_KEYS, ("layer", pa.string()), ("layer_index", pa.int32()), ("extent", pa.int32()), ("feature_index", pa.int64()), ("feature_id", pa.decimal128(20)), ("geom_type", pa.string()),
    ("geometry", pa.list_(pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())])))), ("vertices", pa.int64()), ("properties", pa.map_(pa.string(), _PROP)),
])
#: Rows of an Arrow batch.
SOME = 2000
KINDS = {1: "Point", 2: "LineString", 3: "Polygon"}


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else None)
        if size is None or at + size > len(data):
            raise ValueError("not a vector tile")
        yield tag >> 3, kind, data[at : at + size]
        at += size


def _numbers(data: bytes) -> list[int]:
    from quadlake.sources.archive import read_varints

    return read_varints(data)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def number_text(d: float) -> str:
    """The shortest decimal digits, without exponent or trailing zero."""
    if d != d or d in (float("inf"), float("-inf")):
        return {"inf": "inf", "-inf": "-inf"}.get(str(d), "NaN")
    text = format(__import__("decimal").Decimal(repr(d)), "f")
    return text[:-2] if text.endswith(".0") else text


def _value(data: bytes) -> dict:
    for n, _, v in fields(data):
        if n == 1:
            s = v.decode("utf-8", "replace")
            return {"kind": "string", "s": s, "text": s, "exact": "string"}
        if n in (2, 3):
            d = struct.unpack("<f" if n == 2 else "<d", v)[0]
            shown = float(str(__import__("numpy").float32(d))) if n == 2 else d
            return {"kind": "number", "d": d, "text": number_text(shown), "exact": "float" if n == 2 else "double"}
        if n in (4, 5, 6):
            i = unzigzag(v) if n == 6 else v - (1 << 64) if n == 4 and v >> 63 else v
            return {"kind": "number", "d": float(i), "text": str(i), "exact": {4: "int", 5: "uint", 6: "sint"}[n]}
        if n == 7:
            return {"kind": "bool", "b": bool(v), "text": "true" if v else "false", "exact": "bool"}
    return {"kind": "null", "text": "null", "exact": "null"}


def _geometry(commands: list[int], kind: int) -> list[list[dict]]:
    x = y = 0
    parts: list[list[dict]] = []
    at = 0
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == 7:
            parts[-1].append(dict(parts[-1][0]))
            continue
        for _ in range(n):
            x, y = x + unzigzag(commands[at]), y + unzigzag(commands[at + 1])
            at += 2
            if op == 1:
                parts.append([])
            parts[-1].append({"x": float(x), "y": float(y)})
    return parts


def decode_tile(data: bytes) -> Iterator[dict]:
    """Features of a tile, gzipped or not."""
    for index, (_, _, raw) in enumerate(f for f in fields(gunzip(data)) if f[0] == 3):
        name, extent, keys, values, found = "", 4096, [], [], []
        for n, _, v in fields(raw):
            if n == 1:
                name = v.decode("utf-8", "replace")
            elif n == 2:
                found.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        for i, f in enumerate(found):
            own, tags, kind, commands = None, [], 0, []
            for n, _, v in fields(f):
                if n == 1:
                    own = v
                elif n == 2:
                    tags = _numbers(v)
                elif n == 3:
                    kind = v
                elif n == 4:
                    commands = _numbers(v)
            parts = _geometry(commands, kind)
            vertices = sum(len(p) - (kind == 3 and len(p) > 1 and p[0] == p[-1]) for p in parts)
            name_of = KINDS.get(kind, "Unknown")
            yield {"layer": name, "layer_index": index, "extent": extent, "feature_index": i, "feature_id": own, "geom_type": f"Multi{name_of}" if len(parts) > 1 and kind in (1, 2) else name_of, "geometry": parts, "vertices": vertices, "properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=False)}}


def _message(number: int, data: bytes) -> bytes:
    return write_varints([number << 3 | 2, len(data)]) + data


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _encode_value(p: dict) -> bytes | None:
    exact = p.get("exact") or {"number": "double"}.get(p["kind"], p["kind"])
    if exact == "null":
        return None
    if exact == "string":
        return _message(1, p["s"].encode())
    if exact in ("float", "double"):
        return bytes([2 << 3 | 5]) + struct.pack("<f", p["d"]) if exact == "float" else bytes([3 << 3 | 1]) + struct.pack("<d", p["d"])
    if exact == "bool":
        return write_varints([7 << 3, int(p["b"])])
    i = int(p["text"])
    return write_varints([{"int": 4, "uint": 5, "sint": 6}[exact] << 3, zigzag(i) if exact == "sint" else i % (1 << 64)])


def _commands(parts, kind: int) -> list[int]:
    out, x, y = [], 0, 0
    if kind == 1:
        points = [p for part in parts for p in part]
        parts = [points] if points else []
    for part in parts:
        points = [(round(p["x"]), round(p["y"])) for p in part]
        if kind == 3 and len(points) > 1 and points[0] == points[-1]:
            points = points[:-1]
        lead = len(points) if kind == 1 else 1
        for group, op in ((points[:lead], 1), (points[lead:], 2)):
            if group:
                out.append(len(group) << 3 | op)
                for a, b in group:
                    out += [zigzag(a - x), zigzag(b - y)]
                    x, y = a, b
        if kind == 3:
            out.append(1 << 3 | 7)
    return out


def encode_tile(features: list[dict]) -> bytes:
    """A tile of features (layer, extent, geom_type, geometry, properties, feature_id), layers in the
    order they are first met. Null values are left out."""
    layers: dict[str, list[dict]] = {}
    for f in features:
        layers.setdefault(f["layer"], []).append(f)
    out = b""
    for name, own in layers.items():
        keys, values, body = {}, {}, b""
        for f in own:
            kind = {v: k for k, v in KINDS.items()}.get((f["geom_type"] or "").removeprefix("Multi"))
            if not kind:
                raise ValueError(f"geometry {f['geom_type']} cannot be encoded")
            tags = []
            for k, p in dict(f["properties"] or {}).items():
                v = _encode_value(p)
                if v is not None:
                    tags += [keys.setdefault(k, len(keys)), values.setdefault(v, len(values))]
            part = write_varints([1 << 3, int(f["feature_id"])]) if f.get("feature_id") is not None and f["feature_id"] == f["feature_id"] else b""
            part += _message(2, write_varints(tags)) if tags else b""
            body += _message(2, part + write_varints([3 << 3, kind]) + _message(4, write_varints(_commands(f["geometry"], kind))))
        out += _message(3, _message(1, name.encode()) + body + b"".join(_message(3, k.encode()) for k in keys) + b"".join(_message(4, v) for v in values) + write_varints([5 << 3, int(own[0].get("extent") or 4096), 15 << 3, 2]))
    return out


def decoded(tiles: DataFrame, strict: bool = True) -> DataFrame:
    """Features of tiles (zoom, x, y, tile_data); without ``strict`` tiles that fail give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            cols = [batch.column(c) for c in ("zoom", "x", "y", "tile_data")]
            for i in range(batch.num_rows):
                zoom, x, y, data = (c[i].as_py() for c in cols)
                try:
                    found = list(decode_tile(data))
                except (ValueError, IndexError):
                    if strict:
                        raise
                    continue
                for f in found:
                    own = None if f["feature_id"] is None else Decimal(f["feature_id"])
                    rows.append(f | {"zoom": zoom, "x": x, "y": y, "feature_id": own, "properties": list(f["properties"].items())})
                if len(rows) >= SOME:
                    yield pa.RecordBatch.from_pylist(rows, _FEATURES)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FEATURES)

    return tiles.select("zoom", "x", "y", "tile_data").mapInArrow(run, FEATURES)


def encoded(features: DataFrame) -> DataFrame:
    """Tiles (zoom, x, y, tile_data) of features; a tile's features follow one another in one sorted partition."""
    keys = ("zoom", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, batch.num_rows, SOME) for r in batch.slice(at, SOME).to_pylist())
        out, size = [], 0
        for key, own in itertools.groupby(rows, lambda r: tuple(r[k] for k in keys)):
            out.append(dict(zip(keys, key, strict=True)) | {"tile_data": encode_tile(list(own))})
            size += len(out[-1]["tile_data"])
            if len(out) >= SOME or size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(out, _TILES)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, _TILES)

    wanted = features.select(F.col("zoom").cast("int").alias("zoom"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "layer", "extent", "feature_index", "feature_id", "geom_type", "geometry", "properties")
    return wanted.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("layer"), F.asc_nulls_last("feature_index")).mapInArrow(run, "zoom int, x long, y long, tile_data binary")
