"""Tile sets and the command line on a small file."""

import json
import sqlite3

import pytest

from quadlake.__main__ import main
from quadlake.plans.style import Style
from quadlake.sources import mvt
from quadlake.tileset import Tileset, format_of, output_of, simplified
from tests.test_archives import tile

STYLE = {"layers": [{"source": "s", "source-layer": "roads", "filter": ["==", "class", "primary"]}, {"source": "s", "source-layer": "water", "maxzoom": 1}]}


@pytest.fixture
def path(tmp_path):
    import gzip

    db = sqlite3.connect(tmp_path / "a.mbtiles")
    db.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    db.execute("CREATE TABLE metadata (name TEXT, value TEXT)")
    db.execute("INSERT INTO metadata VALUES ('name', 'sample')")
    db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(0, 0, 0, tile(1)), (1, 1, 0, gzip.compress(tile(3))), (1, 0, 1, tile(0))])
    db.commit()
    db.close()
    return str(tmp_path / "a.mbtiles")


def layers(t):
    return {(r.zoom, r.x, r.y): sorted({f["layer"] for f in mvt.decode_tile(bytes(r.tile_data))}) for r in t.collect()}


def test_optimize(spark, path, tmp_path):
    own = Tileset(spark, path)
    assert layers(own.optimize(Style(STYLE))) == {(0, 0, 0): ["roads", "water"], (1, 1, 0): ["roads"], (1, 0, 1): []}
    out = own.optimize(Style(STYLE), drop_empty=True)
    assert layers(out) == {(0, 0, 0): ["roads", "water"], (1, 1, 0): ["roads"]}
    assert {(r.zoom, bytes(r.tile_data)[:2] == b"\x1f\x8b") for r in out.collect()} == {(0, False), (1, True)}


def test_copy_and_lookup(spark, path, tmp_path):
    own = Tileset(spark, path)
    made = own.copy(str(tmp_path / "b.pmtiles"))
    back = made.copy(str(tmp_path / "c.mbtiles"))
    key = lambda t: sorted((r.zoom, r.x, r.y, bytes(r.tile_data)) for r in t.tiles(data=True).collect())
    assert key(own) == key(made) == key(back) and made.metadata() == back.metadata() == {"name": "sample"}
    assert own.tile(1, 1, 0).count() == 1 and made.tile(5, 0, 0).count() == 0 and made.tiles(1).count() == 2
    for bad in (lambda: made.copy(str(tmp_path / "d.pmtiles")), lambda: own.simplify(9, 0, 0), lambda: own.save(own.tiles(data=True), path)):
        with pytest.raises(ValueError):
            bad()


def test_simplify(spark):
    line = [[{"x": float(i), "y": 0.1 * (i % 2)} for i in range(20)]]
    f = [{"layer": "l", "extent": 4096, "geom_type": "LineString", "geometry": line, "feature_id": 1, "properties": {}}, {"layer": "m", "extent": 4096, "geom_type": "Point", "geometry": [line[0][:1]], "feature_id": 2, "properties": {}}]
    rows = spark.createDataFrame([(0, 0, 0, bytearray(mvt.encode_tile(f)))], "zoom int, x long, y long, tile_data binary")
    count = lambda t: {r["layer"]: r["vertices"] for x in t.collect() for r in mvt.decode_tile(bytes(x.tile_data))}
    assert count(simplified(rows, None, 2.0)) == {"l": 2, "m": 1}
    assert count(simplified(rows, ["l"])) == {"l": 20}


def test_command_line(spark, path, tmp_path, capsys):
    style = tmp_path / "style.json"
    style.write_text(json.dumps(STYLE))
    run = lambda *a: (main(list(a)), capsys.readouterr().out)
    code, out = run("inspect", path, "--report-format", "json", "--include-layer-list", "--topn", "2", "-z", "1", "--recommend")
    report = json.loads(out)
    assert code == 0 and report["summary"][0]["tile_count"] == 2 and len(report["top_tiles"]) == 2 and report["metadata"] == [{"name": "name", "value": "sample"}]
    assert {r["layer"]: r["feature_count"] for r in report["layers"]} == {"roads": 3, "water": 2} and len(report["top_tile_summaries"]) == 3
    code, out = run("inspect", path, "--report-format", "json", "-z", "1", "-x", "1", "-y", "0", "--stats", "tile_summary")
    assert {r["layer"]: r["property_names"] for r in json.loads(out)["tile_summary"]} == {"roads": ["class", "lanes"], "water": ["d", "deep"]}
    types = lambda *a: {json.loads(x)["type"] for x in run("inspect", path, *a)[1].splitlines()}
    assert types("--ndjson-compact", "--topn", "1") == {"histogram", "histogram_by_zoom", "top_tile"}
    assert "summary" in types("--report-format", "ndjson", "--fast")
    assert run("inspect", path, "--summary")[0] == run("inspect", path, "--recommend")[0] == 1
    code, out = run("optimize", path, "--style", str(style), "--drop-empty-tiles", "--report-format", "json")
    assert code == 0 and json.loads(out)["tiles"][0]["tiles_diff"] == "-1" and (tmp_path / "a.pruned.mbtiles").exists()
    assert run("simplify", path, "--z", "1", "--x", "1", "--y", "0", "--tolerance", "1")[0] == 0
    assert run("copy", path, "--output-format", "pmtiles")[1].endswith("3 tiles\n")


def test_pruned_copies_of_two_tables_have_an_image_for_each_tile(spark, path, tmp_path):
    from quadlake.sources import mbtiles

    own, split = Tileset(spark, path), str(tmp_path / "s.mbtiles")
    mbtiles.write(own.tiles(data=True).unionByName(own.tiles(data=True).where("zoom = 1 and x = 0").selectExpr("zoom", "1L as x", "1L as y", "tile_bytes", "tile_data")), split, {}, two_tables=True)
    names = lambda p: sorted(r[0] for r in sqlite3.connect(p).execute("SELECT tile_id FROM images"))
    assert len(names(split)) == 3 and mbtiles.is_split(split)
    source = Tileset(spark, split)
    out = source.save(source.optimize(Style(STYLE)), str(tmp_path / "p.mbtiles"), by_place=True)
    assert names(out.path) == ["0-0-0", "1-0-1", "1-1-0", "1-1-1"] and out.tiles().count() == 4


def test_record_stream(spark, path, capsys):
    def stream(*a):
        assert main(["inspect", path, "--report-format", "ndjson", *a]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    rows = stream("--topn", "3", "--bucket", "0", "--list-tiles", "--histogram-buckets", "2")
    assert [r["type"] for r in rows] == ["summary", "histogram", "histogram_by_zoom", "histogram_by_zoom", "bucket_count", *["bucket_tile"] * rows[4]["count"], *["top_tile"] * 3]
    assert rows[0]["overall"]["tile_count"] == 3 and [z["zoom"] for z in rows[0]["by_zoom"]] == [0, 1] and rows[0]["used"] == 3
    assert [b["bucket"] for b in rows[1]["buckets"]] == [0, 1] and [r["zoom"] for r in rows[2:4]] == [0, 1]
    sizes = [r["tile"]["tile_bytes"] for r in rows if r["type"] == "top_tile"]
    assert sizes == sorted(sizes, reverse=True)
    rows = stream("--ndjson-compact", "--topn", "2", "-z", "1", "--recommend", "--histogram-buckets", "2", "--max-tile-bytes", "10")
    kinds = [r["type"] for r in rows]
    assert kinds == ["histogram", "top_tile", "top_tile", "recommended_buckets", "top_tile_summary", "top_tile_summary"]
    assert rows[0]["bucket_count"] == 2 and rows[1].keys() == {"type", "z", "x", "y", "bytes"} and rows[3]["buckets"] == sorted(rows[3]["buckets"])
    assert [(r["z"], r["x"], r["y"], r["bytes"]) for r in rows[4:]] == [(r["z"], r["x"], r["y"], r["bytes"]) for r in rows[1:3]] and {r["total_features"] for r in rows[4:]} == {4, 1}
    (row,) = [r for r in stream("--tile", "1/1/0", "--summary") if r["type"] == "tile_summary"]
    assert row["summary"]["layer_count"] == 2 and {x["layer"]: x["feature_count"] for x in row["summary"]["layers"]} == {"roads": 3, "water": 1}


def test_calls_without_a_subcommand(spark, path, tmp_path, capsys):
    from quadlake.__main__ import without_command

    assert without_command(["-m", "a", "-x", "1", "-y", "2", "-z", "3", "-l", "r", "-l", "s", "-t", "0.5", "-o", "b"]) == ["simplify", "a", "--z", "3", "--x", "1", "--y", "2", "--layer", "r", "--layer", "s", "--tolerance", "0.5", "--output", "b"]
    assert without_command(["-m", "a", "-x", "1"]) == ["inspect", "a"]
    style = tmp_path / "style.json"
    style.write_text(json.dumps(STYLE))
    run = lambda *a: (main(list(a)), capsys.readouterr().out)
    code, out = run("-m", path, "-z", "1", "-x", "1", "-y", "0")
    assert code == 0 and "roads" in out and "== tile_summary ==" in out and "histogram" not in out
    assert run("-m", path, "-s", str(style), "-o", str(tmp_path / "p.mbtiles"))[0] == 0 and (tmp_path / "p.mbtiles").exists()
    assert run("verify", path) == (0, f"verify: input={path}\n")


def test_formats():
    assert format_of("A.MBTiles") == "mbtiles" and output_of("d/a.mbtiles", None, "pmtiles", "pruned") == ("d/a.pruned.pmtiles", "pmtiles")
    for bad in (lambda: format_of("a.txt"), lambda: output_of("a.mbtiles", "b.pmtiles", "mbtiles", "x")):
        with pytest.raises(ValueError):
            bad()
