"""The same statistics over a stream of tiles: per-zoom totals by window of arrival time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zoom_totals(tiles: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and bytes by window and zoom; rows later than ``late`` are left out."""
    return tiles.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "zoom").agg(F.count("*").alias("tile_count"), F.sum("tile_bytes").alias("total_bytes"))
