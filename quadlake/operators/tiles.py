"""Statistics of a tile relation: zoom int, x long, y long, tile_bytes long.

Every operator takes and returns DataFrames; sizes alone are read, never payloads. Bounds and
totals are one-row aggregates, broadcast within the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlake.functions.tile import EMPTY_BYTES, MAX_TILE_BYTES, NEAR, bucket_index, bucket_size, in_ratio, share

def _stats():
    size = F.col("tile_bytes")
    return (
        F.count("*").alias("tile_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.max(size), F.lit(0)).alias("max_bytes"),
        F.when(F.count("*") == 0, F.lit(0)).otherwise(F.expr("sum(tile_bytes) div count(*)")).cast("long").alias("avg_bytes"),
    )


def overall(tiles: DataFrame) -> DataFrame:
    return tiles.agg(*_stats())


def by_zoom(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("zoom").agg(*_stats(), F.min("tile_bytes").alias("min_bytes"))


def by_zoom_and_overall(tiles: DataFrame) -> DataFrame:
    """Zoom null: all zooms, in the same pass."""
    return tiles.rollup("zoom").agg(*_stats())


def zoom_table(tiles: DataFrame) -> DataFrame:
    """Shares of each zoom, and shares accumulated by zoom. The window is over one row for each zoom."""
    z = by_zoom(tiles).crossJoin(F.broadcast(tiles.agg(F.count("*").alias("n"), F.sum("tile_bytes").alias("b"))))
    upto = Window.orderBy("zoom").rowsBetween(Window.unboundedPreceding, 0)
    return z.select("zoom", "tile_count", "total_bytes", share(F.col("tile_count"), F.col("n")).alias("pct_tiles"), share(F.col("total_bytes"), F.col("b")).alias("pct_bytes"),
                    share(F.sum("tile_count").over(upto), F.col("n")).alias("accum_pct_tiles"), share(F.sum("total_bytes").over(upto), F.col("b")).alias("accum_pct_bytes"))


def empty_and_over(tiles: DataFrame, max_bytes: int = MAX_TILE_BYTES) -> DataFrame:
    """Tiles of at most 50 stored bytes with their ratio, and tiles above the limit (0: none)."""
    size, n = F.col("tile_bytes"), F.count("*")
    return tiles.agg(n.alias("used"), F.count_if(size <= EMPTY_BYTES).alias("empty_tiles"), share(F.count_if(size <= EMPTY_BYTES), n).alias("empty_ratio"), F.count_if((F.lit(max_bytes) > 0) & (size > max_bytes)).alias("over_limit"))


def _running(counted: DataFrame, keys: list[str], max_bytes: int) -> DataFrame:
    """Columns of a histogram: accumulated values, running average, shares and flags."""
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = counted.withColumns({"accum_count": F.sum("count").over(upto), "accum_bytes": F.sum("bytes").over(upto), "_n": F.sum("count").over(whole), "_b": F.sum("bytes").over(whole)})
    rows = rows.withColumn("running_avg", F.when(F.col("accum_count") == 0, F.lit(0)).otherwise(F.expr("accum_bytes div accum_count")).cast("long"))
    limit = F.lit(float(max_bytes))
    over = (F.lit(max_bytes) > 0) & (F.col("running_avg") > max_bytes)
    near = (F.lit(max_bytes) > 0) & (F.col("running_avg") >= limit * NEAR) & ~over
    return rows.select(*keys, "bucket", "min_bytes", "max_bytes", "count", "bytes", "running_avg", share(F.col("count"), F.col("_n")).alias("pct_tiles"), share(F.col("bytes"), F.col("_b")).alias("pct_bytes"),
                       share(F.col("accum_count"), F.col("_n")).alias("accum_pct_tiles"), share(F.col("accum_bytes"), F.col("_b")).alias("accum_pct_bytes"), near.alias("avg_near_limit"), over.alias("avg_over_limit"))


def _histogram(tiles: DataFrame, keys: list[str], buckets: int, max_bytes: int) -> DataFrame:
    bounds = tiles.groupBy(*keys).agg(F.min("tile_bytes").alias("low"), F.max("tile_bytes").alias("high"))
    size, i = bucket_size(F.col("low"), F.col("high"), buckets), F.col("bucket")
    dense = bounds.where(F.col("low").isNotNull()).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    dense = dense.withColumns({"min_bytes": F.col("low") + i * size, "max_bytes": F.when(i == buckets - 1, F.col("high")).otherwise(F.col("low") + (i + 1) * size - 1)}).drop("low", "high")
    own = tiles.join(F.broadcast(bounds), keys) if keys else tiles.crossJoin(F.broadcast(bounds))
    counted = own.groupBy(*keys, bucket_index(F.col("tile_bytes"), F.col("low"), F.col("high"), buckets).alias("bucket")).agg(F.count("*").alias("count"), F.sum("tile_bytes").alias("bytes"))
    full = dense.join(counted, [*keys, "bucket"], "left").withColumns({"count": F.coalesce("count", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})
    return _running(full, keys, max_bytes)


def histogram(tiles: DataFrame, buckets: int = 10, max_bytes: int = MAX_TILE_BYTES) -> DataFrame:
    """Dense equal-width histogram of sizes. Two passes over sizes, each a partial aggregate."""
    return _histogram(tiles, [], buckets, max_bytes)


def zoom_histograms(tiles: DataFrame, buckets: int = 10, max_bytes: int = MAX_TILE_BYTES) -> DataFrame:
    """The same for each zoom, between its own bounds (at most 256 rows are broadcast)."""
    return _histogram(tiles, ["zoom"], buckets, max_bytes)


def recommended(histogram_: DataFrame) -> DataFrame:
    """Buckets whose running average is over the limit, or else those near it."""
    rows = histogram_.withColumn("_any", F.max("avg_over_limit").over(Window.partitionBy()))
    return rows.where(F.when(F.col("_any"), F.col("avg_over_limit")).otherwise(F.col("avg_near_limit"))).select("bucket")


def top(tiles: DataFrame, n: int) -> DataFrame:
    """The largest tiles; ties by zoom, x, y, greatest first."""
    return tiles.orderBy(F.desc("tile_bytes"), F.desc("zoom"), F.desc("x"), F.desc("y")).limit(n).select("zoom", "x", "y", "tile_bytes")


def with_bucket(tiles: DataFrame, buckets: int) -> DataFrame:
    bounds = tiles.agg(F.min("tile_bytes").alias("low"), F.max("tile_bytes").alias("high"))
    return tiles.crossJoin(F.broadcast(bounds)).withColumn("bucket", bucket_index(F.col("tile_bytes"), F.col("low"), F.col("high"), buckets)).drop("low", "high")


def in_bucket(tiles: DataFrame, buckets: int, bucket: int, limit: int = 100, sort: str = "size") -> DataFrame:
    """Tiles of one bucket, largest first ("size") or by coordinates ("zxy")."""
    order = [F.desc("tile_bytes")] if sort == "size" else []
    return with_bucket(tiles, buckets).where(F.col("bucket") == bucket).orderBy(*order, "zoom", "x", "y").limit(limit).select("zoom", "x", "y", "tile_bytes")


def bucket_count(tiles: DataFrame, buckets: int, bucket: int) -> DataFrame:
    """Tiles in one bucket; null outside the histogram."""
    n = F.count_if(F.col("bucket") == bucket) if 0 <= bucket < buckets else F.lit(None).cast("long")
    return with_bucket(tiles, buckets).agg(n.alias("bucket_count"))


#: Parts that the columns of a zoom are cut to where its tiles are numbered.
PARTS = 4096


def numbered(tiles: DataFrame) -> DataFrame:
    """Row numbers from 1 within each zoom, by x and y, and the zoom's count.

    No task holds a zoom: its columns are cut to ``PARTS`` ranges between the least and the greatest, rows are
    numbered within a range, and the counts of the ranges before (at most PARTS for each zoom) are added."""
    bounds = tiles.groupBy("zoom").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.count("*").alias("total"))
    own = tiles.join(F.broadcast(bounds), "zoom").withColumn("_part", F.expr(f"(x - _lo) div ((_hi - _lo) div {PARTS} + 1)")).drop("_lo", "_hi")
    counts = own.groupBy("zoom", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("zoom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("zoom", "_part", before.alias("_base"))
    index = F.row_number().over(Window.partitionBy("zoom", "_part").orderBy("x", "y")) + F.col("_base")
    return own.join(F.broadcast(base), ["zoom", "_part"]).withColumn("index", index.cast("long")).select(*tiles.columns, "index", "total")


def sample(tiles: DataFrame, kind: str, amount: float) -> DataFrame:
    """A deterministic sample: the first ``amount`` tiles of each zoom, or a ratio of them."""
    if kind == "count":
        first = F.row_number().over(Window.partitionBy("zoom").orderBy("x", "y"))
        return tiles.withColumn("index", first).where(F.col("index") <= int(amount)).drop("index")
    return numbered(tiles).where(in_ratio(F.col("index"), F.col("total"), amount)).drop("index", "total")


def expand_directory(entries: DataFrame) -> DataFrame:
    """Tiles of directory entries (tile_id, offset, length, run_length): one for each member of a run."""
    return entries.where("run_length > 0").withColumn("tile", F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)))


def find_entry(entries: DataFrame, tile_id: int) -> DataFrame:
    """The entry whose run holds a tile."""
    return entries.where((F.col("tile_id") <= tile_id) & (F.lit(tile_id) < F.col("tile_id") + F.col("run_length")))


def normalized(map_: DataFrame, images: DataFrame) -> DataFrame:
    """Tiles of the two-table form: map (zoom, x, y, tile_id) and images (tile_id, tile_data); an
    image that stands twice counts once."""
    return map_.join(images.dropDuplicates(["tile_id"]), "tile_id")
