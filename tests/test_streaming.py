"""Zoom totals over a stream of tiles: every batch of files adds to its windows, late tiles are left out."""

from datetime import datetime

from quadlake.streaming.tiles import zoom_totals


def test_zoom_totals(spark, tmp_path):
    kind = "ts timestamp, zoom int, x long, y long, tile_bytes long"
    at = lambda m: datetime(2026, 1, 1, m // 60, m % 60)
    batches = [
        [(at(0), 1, 0, 0, 10), (at(9), 1, 1, 0, 30), (at(5), 2, 0, 0, 5)],
        [(at(10), 1, 0, 1, 7), (at(1), 2, 1, 1, 6)],
        [(at(65), 1, 0, 0, 1)],
        [(at(2), 1, 0, 0, 1000), (at(66), 1, 0, 0, 1)],  # the first is late by far
        [(at(130), 3, 0, 0, 1)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(kind).parquet(str(source))
    query = zoom_totals(stream).writeStream.format("memory").queryName("zoom_totals").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    got = {(60 * r.window.start.hour + r.window.start.minute, r.zoom): (r.tile_count, r.total_bytes) for r in spark.table("zoom_totals").collect()}
    assert got == {(0, 1): (2, 40), (0, 2): (2, 11), (10, 1): (1, 7), (60, 1): (2, 2)}
