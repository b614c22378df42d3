"""Codecs, both archive formats, and transforms on small fixtures."""

import gzip
import sqlite3

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quadlake.functions.tile import hilbert_id, hilbert_number, hilbert_tile, hilbert_tiles, parse_sample, parse_tile
from quadlake.operators import features as fo
from quadlake.operators import tiles as to
from quadlake.operators.geometry import simplify_line, simplify_ring
from quadlake.plans.report import Report, text_table, wanted
from quadlake.plans.style import Style
from quadlake.sources import archive, mbtiles, mvt
from pyspark.sql import functions as F


@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 10**9), st.integers(1, 10**6), st.integers(0, 50)), max_size=30))
def test_directory_round_trip(raw):
    tile, entries = 0, []
    for step, offset, length, run in raw:
        tile += step
        entries.append((tile, offset, length, run))
    assert archive.decode_directory(archive.encode_directory(entries)) == entries


def test_hilbert(spark):
    cells = [(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    numbers = [hilbert_number(*c) for c in cells]
    assert sorted(numbers) == list(range(len(cells)))
    assert [hilbert_tile(n) for n in numbers] == cells == list(zip(*(c.tolist() for c in hilbert_tiles(np.array(numbers))), strict=True))
    far = [(z, x % (1 << z), y % (1 << z)) for z in (12, 20, 29) for x, y in ((0, 0), (12345, 987654321), (2**29 - 1, 7))]
    assert far == list(zip(*(c.tolist() for c in hilbert_tiles(np.array([hilbert_number(*c) for c in far]))), strict=True))
    df = spark.createDataFrame(cells, "z int, x long, y long")
    assert [r.n for r in df.select(hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("n")).collect()] == numbers


def prop(kind, text, exact, **more):
    return {"kind": kind, "s": None, "d": None, "b": None, "text": text, "exact": exact} | more


def tile(n=2):
    f = [{"layer": "roads", "extent": 4096, "geom_type": "Point", "geometry": [[{"x": 1.0 * i, "y": 2.0}]], "feature_id": i, "properties": {"class": prop("string", "primary", "string", s="primary"), "lanes": prop("number", "-3", "sint", d=-3.0)}} for i in range(n)]
    ring = [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 0.0}]
    f.append({"layer": "water", "extent": 4096, "geom_type": "Polygon", "geometry": [ring], "feature_id": None, "properties": {"deep": prop("bool", "true", "bool", b=True), "d": prop("number", "0.5", "double", d=0.5)}})
    return mvt.encode_tile(f)


def test_tile_round_trip():
    own = list(mvt.decode_tile(tile()))
    assert [(f["layer"], f["vertices"], f["geom_type"]) for f in own] == [("roads", 1, "Point"), ("roads", 1, "Point"), ("water", 3, "Polygon")]
    assert own[0]["properties"]["lanes"]["text"] == "-3" and own[2]["properties"]["deep"]["b"] is True
    assert list(mvt.decode_tile(gzip.compress(tile()))) == own


def test_both_formats(spark, tmp_path):
    mbtiles.register(spark)
    archive.register(spark)
    db = sqlite3.connect(tmp_path / "a.mbtiles")
    db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    db.execute("INSERT INTO metadata VALUES ('name', 'sample')")
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(0, 0, 0, b"x" * 10), (1, 1, 1, b"y" * 20), (1, 0, 1, b"y" * 20)])
    db.commit()
    path = str(tmp_path / "a.mbtiles")
    read = lambda p, kind, **o: spark.read.format(kind).options(path=p, **o).load()
    t = read(path, "mbtiles", includeData="true")
    assert {(r.zoom, r.x, r.y, r.tile_bytes) for r in t.collect()} == {(0, 0, 0, 10), (1, 1, 1, 20), (1, 0, 1, 20)}
    assert t.where("zoom = 1").count() == 2 and read(path, "mbtiles", zoom="1").count() == 2
    assert read(path, "mbtiles", table="metadata").collect()[0].value == "sample"
    for kind, write, name in (("pmtiles", lambda d, p: archive.write(d, p, {"name": "s", "n": 1}, entries_in_root=2), "b.pmtiles"), ("mbtiles", lambda d, p: mbtiles.write(d, p, {}, two_tables=True), "c.mbtiles")):
        out = str(tmp_path / name)
        write(t, out)
        back = read(out, kind, includeData="true")
        key = lambda r: (r.zoom, r.x, r.y, bytes(r.tile_data))
        assert sorted(map(key, back.collect())) == sorted(map(key, t.collect()))
    assert archive.metadata(str(tmp_path / "b.pmtiles")) == {"name": "s", "n": "1"}
    own = to.overall(t).collect()[0]
    assert (own.tile_count, own.total_bytes, own.max_bytes, own.avg_bytes) == (3, 50, 20, 16)
    with pytest.raises(ValueError):
        archive.unpacked(b"abc", 2)


def _file(path, rows, split=False, rowid=True):
    db = sqlite3.connect(path)
    place = "zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER"
    if split:
        db.execute(f"CREATE TABLE map ({place}, tile_id TEXT)")
        db.execute("CREATE TABLE images (tile_id TEXT, tile_data BLOB)")
        db.executemany("INSERT INTO map VALUES (?, ?, ?, ?)", [(*r[:3], r[3].hex()) for r in rows])
        db.executemany("INSERT INTO images VALUES (?, ?)", {r[3].hex(): (r[3].hex(), r[3]) for r in rows}.values())
        db.execute("CREATE VIEW tiles AS SELECT zoom_level, tile_column, tile_row, tile_data FROM map JOIN images USING (tile_id)") if split == "view" else None
    else:
        db.execute(f"CREATE TABLE tiles ({place}, tile_data BLOB, PRIMARY KEY (zoom_level, tile_column, tile_row)){'' if rowid else ' WITHOUT ROWID'}")
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", rows)
    db.commit()
    db.close()
    return str(path)


@pytest.mark.parametrize("form", ["rows", "no row ids", "split", "view"])
def test_partitions_hold_every_tile_once(tmp_path, monkeypatch, form):
    monkeypatch.setattr(mbtiles, "FEW", 50)
    rows = [(z, x, y, bytes([z]) * (1 + (x + y) % 9)) for z, side in ((0, 1), (3, 8), (5, 20), (12, 30), (13, 8)) for x in range(100 * (z > 11), 100 * (z > 11) + side) for y in range(side)]
    path = _file(tmp_path / "a.mbtiles", rows, {"split": True, "view": "view"}.get(form, False), form != "no row ids")

    def read(**options):
        reader = mbtiles._Reader({"path": path, "includeData": "true", **options})
        parts = reader.partitions()
        return parts, [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]

    want = lambda keep: sorted((z, x, y, len(d), d) for z, x, y, d in rows if keep(z, x, y))
    parts, got = read()
    assert sorted(got) == want(lambda z, x, y: True) and len(parts) > 4
    for zoom in (3, 5, 12, 13, 20):
        assert sorted(read(zoom=str(zoom))[1]) == want(lambda z, x, y: z == zoom)
    parts, got = read(zoom="12", x="103", y="4")
    assert got == want(lambda z, x, y: (z, x, y) == (12, 103, 4)) and len(parts) == 1
    assert read(zoom="12", x="1", y="4")[1] == []


def test_dealing_of_zooms_and_rows():
    assert mbtiles.packed_zooms({1: 5, 2: 9, 3: 4, 4: 1}, 2) == [[2, 4], [1, 3]]
    assert mbtiles.rowid_ranges(3, 12, 4) == [(3, 5), (6, 8), (9, 11), (12, 12)] and mbtiles.rowid_ranges(1, 1) == [(1, 1)]
    assert mbtiles.column_ranges(11) is None and mbtiles.column_ranges(33) is None and mbtiles.column_ranges(12)[-1][1] == 4095


def test_lookups_in_an_archive_read_one_leaf(spark, tmp_path, monkeypatch):
    rows = [(z, x, y, bytearray(f"{z}/{x}/{y}".encode())) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    path = str(tmp_path / "a.pmtiles")
    archive.write(spark.createDataFrame(rows, "zoom int, x long, y long, tile_data binary"), path, {}, entries_in_root=16)

    def read(**options):
        reader = archive._ArchiveReader({"path": path, "includeData": "true", **options})
        parts = reader.partitions()
        return parts, [(r["zoom"], r["x"], r["y"], r["tile_data"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]

    parts, got = read()
    assert sorted(got) == sorted((z, x, y, bytes(d)) for z, x, y, d in rows) and len(parts) == 22
    for place in ((4, 3, 9), (0, 0, 0), (2, 3, 3)):
        parts, got = read(**dict(zip(("zoom", "x", "y"), map(str, place), strict=True)))
        assert got == [(*place, "/".join(map(str, place)).encode())] and len(parts) == 1
    assert read(zoom="7", x="1", y="1")[1] == read(zoom="1", x="9", y="0")[1] == []
    assert sorted(read(zoom="3")[1]) == sorted((z, x, y, bytes(d)) for z, x, y, d in rows if z == 3)


def test_style_at_high_zooms(spark):
    f = spark.createDataFrame([(z, "roads", {}) for z in (0, 31, 32, 40, 41, 255)], "zoom int, layer string, properties map<string, struct<kind: string, s: string, d: double, b: boolean>>").withColumns({"geom_type": F.lit("Point")})
    kept = lambda *rules: sorted(r.zoom for r in fo.pruned(f, Style({"layers": [{"source": "s", "source-layer": "roads", **r} for r in rules]})).collect())
    assert kept({}) == [0, 31, 32, 40, 41, 255] and kept({"minzoom": 31.5, "maxzoom": 41}) == [32, 40]
    assert kept({"paint": {"line-width": {"stops": [[40, 0], [41, 2]]}}}) == [0, 31, 32, 41, 255]
    assert kept({"paint": {"line-width": 0}}, {"layout": {"visibility": "none"}}) == []
    assert kept({"minzoom": 100}, {"maxzoom": 1}) == [0, 255]
    rules = [{}, {"minzoom": 3.5}, {"maxzoom": 2}, {"paint": {"line-width": {"stops": [[2, 0], [2, 1], [-0.5, 0]]}}}, {"paint": {"line-width": {"stops": [[3, 0], ["x", 0]]}}}, {"paint": {"fill-opacity": False}}]
    z = spark.range(8).select(F.col("id").cast("int").alias("zoom"), F.lit("a").alias("layer"))
    for rule in rules:
        style = Style({"layers": [{"source": "s", "source-layer": "a", **rule}]})
        assert sorted(r.zoom for r in z.where(style.visible()).collect()) == style.zooms(style.rules[0], range(8)), rule


def test_samples_number_tiles_within_zooms(spark, monkeypatch):
    monkeypatch.setattr(to, "PARTS", 7)
    rng = np.random.default_rng(0)
    cells = {(int(z), int(x), int(y)) for z, x, y in zip(rng.integers(0, 3, 400), rng.integers(-5, 90, 400) ** 3, rng.integers(0, 9, 400), strict=True)}
    t = spark.createDataFrame([(*c, 1) for c in cells], "zoom int, x long, y long, tile_bytes long")
    by_zoom = {z: sorted(c for c in cells if c[0] == z) for z in range(3)}
    assert {(r.zoom, r.x, r.y): (r["index"], r.total) for r in to.numbered(t).collect()} == {c: (i + 1, len(own)) for own in by_zoom.values() for i, c in enumerate(own)}


def test_decoded_features(spark):
    rows = spark.createDataFrame([(0, 0, 0, bytearray(tile())), (1, 0, 0, bytearray(b"\xff\xff\xff"))], "zoom int, x long, y long, tile_data binary")
    f = mvt.decoded(rows, strict=False)
    assert {(r.layer, r.feature_count, r.vertex_count, r.property_keys, r.property_values) for r in fo.layers(f).collect()} == {("roads", 2, 2, 2, 2), ("water", 1, 3, 2, 2)}
    style = Style({"layers": [{"source": "s", "source-layer": "roads", "filter": ["==", "lanes", -3]}]})
    assert fo.pruned(f, style).count() == 2
    assert mvt.decoded(mvt.encoded(f)).count() == 3


def test_histogram_values(spark):
    t = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 1, 30)], "zoom int, x long, y long, tile_bytes long")
    h = to.histogram(t, 2, 0).orderBy("bucket").collect()
    assert [(r["count"], r.running_avg, r.pct_tiles, r.pct_bytes, r.accum_pct_bytes) for r in h] == [(1, 10, 0.5, 0.25, 0.25), (1, 20, 0.5, 0.75, 1.0)]
    assert to.sample(t, "count", 1).count() == 1
    report = Report(t, buckets=2, topn=1)
    assert report.section("top_tiles").collect()[0].tile_bytes == 30
    assert report.json_lines("summary, top-tiles").count() == 2
    assert len(text_table(report.section("zoom"))) == 2
    with pytest.raises(ValueError):
        wanted("nothing")


def test_empty_tiles(spark):
    t = spark.createDataFrame([], "zoom int, x long, y long, tile_bytes long")
    assert to.overall(t).collect()[0].tile_count == 0
    assert to.histogram(t).count() == 0 and to.zoom_histograms(t).count() == 0 and to.top(t, 3).count() == 0


def test_simplify():
    line = np.array([(0, 0), (1, 0.1), (2, 0), (3, 0.1), (4, 0)], np.float32)
    assert len(simplify_line(line, 0.5)) <= 3 and len(simplify_line(line, 0)) == 5
    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 0)], np.float32)
    assert len(simplify_ring(ring, 100.0)) == 4


def recursive(points, tolerance):
    """Radial distance, then the farthest point of each part, by recursion."""
    limit = np.float32(tolerance) * np.float32(tolerance)
    near = lambda a, b: float(((a - b) ** 2).sum(dtype=np.float32)) <= limit
    kept = [points[0]]
    for p in points[1:]:
        if not near(p, kept[-1]):
            kept.append(p)
    if (kept[-1] != points[-1]).any():
        kept.append(points[-1])

    def distance(p, a, b):
        along = b - a
        size = np.float32(along[0] * along[0] + along[1] * along[1])
        t = np.float32(((p - a) * along).sum(dtype=np.float32) / size) if size else np.float32(0)
        q = a if t <= 0 else b if t > 1 else a + along * t
        return float(((p - q) ** 2).sum(dtype=np.float32))

    def part(own):
        far = [distance(p, own[0], own[-1]) for p in own[1:-1]]
        if not far or max(far) <= limit:
            return [own[0], own[-1]]
        i = far.index(max(far)) + 1
        return part(own[: i + 1])[:-1] + part(own[i:])

    return part(kept) if len(kept) > 1 else kept


@pytest.mark.parametrize("seed", range(12))
def test_simplification_against_recursion(seed):
    rng = np.random.default_rng(seed)
    line = np.cumsum(rng.normal(size=(120, 2)), axis=0).astype(np.float32)
    for tolerance in (0.3, 1.0, 4.0):
        assert np.array_equal(simplify_line(line, tolerance), np.array(recursive(line, tolerance)))
    angle = np.sort(rng.random(80)) * 2 * np.pi
    ring = (np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(8, 10, (80, 1))).astype(np.float32)
    closed = np.concatenate([ring, ring[:1]])
    for tolerance in (0.2, 1.0, 100.0):
        out, open_ = simplify_ring(closed, tolerance), np.array(recursive(ring, tolerance))
        assert np.array_equal(out, np.concatenate([open_, open_[:1]]) if len(open_) >= 3 else closed)


def test_visibility():
    s = Style({"layers": [
        {"source": "s", "source-layer": "water", "minzoom": 2, "maxzoom": 5}, {"source": "s", "source-layer": "water", "layout": {"visibility": "none"}},
        {"source": "s", "source-layer": "roads", "paint": {"line-width": 0}}, {"source": "s", "source-layer": "roads", "paint": {"line-width": {"stops": [[3, 0], [4, 2]]}}},
    ]})
    shown = lambda layer, z: any(r["source-layer"] == layer and s.shown(r, z) for r in s.rules)
    assert (shown("water", 1), shown("water", 3), shown("roads", 3), shown("roads", 4)) == (False, True, False, True)


def test_parsers():
    assert parse_sample("1") == ("ratio", 1.0) and parse_sample("20") == ("count", 20)
    assert parse_tile("3/4/5") == (3, 4, 5)
    for bad in ("0", "1.5"):
        with pytest.raises(ValueError):
            parse_sample(bad)
