"""A tile set in one file: sections of a report on it, and pruned, simplified or converted copies.

Transforms take and return DataFrames (zoom, x, y, tile_data), so they work on Parquet tables of
tiles, too. A tile that loses all its layers stays, with an empty payload, unless it is to be dropped.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.tile import MAX_TILE_BYTES
from quadlake.operators import features as fo
from quadlake.operators import tiles as to
from quadlake.operators.geometry import simplified_by_kind
from quadlake.plans.report import Report
from quadlake.plans.style import Style, geometry_class
from quadlake.sources import archive, mbtiles, mvt

FORMATS, PLACE = ("mbtiles", "pmtiles"), ["zoom", "x", "y"]
MODES = ("layer", "layer+filter", "vt-compat")


def format_of(path: str, given: str | None = None) -> str:
    """The format that is given, or else that of the path's extension in any case of letters."""
    name = (given or Path(path).suffix.removeprefix(".")).lower()
    if name not in FORMATS:
        raise ValueError(f"the format of {path} is not one of {', '.join(FORMATS)}")
    return name


def output_of(path: str, out: str | None, kind: str | None, tag: str) -> tuple[str, str]:
    """(path, format) of a copy: as given, else ``<stem>.<tag>.<format>`` beside the input."""
    kind = kind and format_of(path, kind)
    if out is None:
        kind = kind or format_of(path)
        return str(Path(path).with_suffix(f".{tag}.{kind}")), kind
    if kind and kind != format_of(out):
        raise ValueError(f"the format {kind} does not match the path {out}")
    return out, format_of(out)


def repacked(tiles: DataFrame, features: DataFrame, drop_empty: bool = False) -> DataFrame:
    """``tiles`` with payloads of ``features``, gzipped where they were. Only places are joined, not the old payloads."""
    places = tiles.select(*PLACE, F.coalesce(archive.is_gzip(F.col("tile_data")), F.lit(False)).alias("zipped"))
    rows = places.join(mvt.encoded(features), PLACE, "inner" if drop_empty else "left")
    data = F.coalesce("tile_data", F.lit(bytearray()))
    return rows.select(*PLACE, F.coalesce(archive.gzipped(F.when(F.col("zipped"), data)), data).alias("tile_data"))


def optimized(tiles: DataFrame, style: Style, mode: str = "layer+filter", keep_unknown: bool = True, drop_empty: bool = False) -> DataFrame:
    """Tiles with the layers that the style shows at their zoom and, but for mode "layer", the features its filters keep."""
    if mode not in MODES:
        raise ValueError(f"the mode is one of {', '.join(MODES)}")
    return repacked(tiles, fo.pruned(mvt.decoded(tiles), style, keep_unknown, mode != "layer"), drop_empty)


def simplified_features(features: DataFrame, layers: list[str] | None = None, tolerance: float | None = None) -> DataFrame:
    """Features of the layers (all, if none are named), lines and polygons simplified."""
    if layers:
        features = features.where(F.col("layer").isin(layers))
    if tolerance is None or tolerance <= 0:
        return features
    return features.withColumn("geometry", simplified_by_kind(F.col("geometry"), geometry_class(F.col("geom_type")), tolerance))


def simplified(tiles: DataFrame, layers: list[str] | None = None, tolerance: float | None = None) -> DataFrame:
    return repacked(tiles, simplified_features(mvt.decoded(tiles), layers, tolerance))


def transform_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Layers, features and vertices of two tile relations, in one row."""
    def own(t: DataFrame, tag: str) -> DataFrame:
        return mvt.decoded(t).agg(F.count_distinct("layer").alias(f"layers_{tag}"), F.count("*").alias(f"features_{tag}"), F.coalesce(F.sum("vertices"), F.lit(0)).cast("long").alias(f"vertices_{tag}"))

    return own(before, "before").crossJoin(own(after, "after"))


class Tileset:
    """A file of tiles. Frames are lazy; what is not asked for is not read."""

    def __init__(self, spark: SparkSession, path: str, kind: str | None = None):
        self.spark, self.path, self.kind = spark, path, format_of(path, kind)
        mbtiles.register(spark)
        archive.register(spark)

    def tiles(self, zoom: int | None = None, data: bool = False) -> DataFrame:
        """zoom, x, y, tile_bytes, and tile_data if asked for."""
        return self._read(data, {} if zoom is None else {"zoom": zoom})

    def _read(self, data: bool, place: dict[str, int]) -> DataFrame:
        """Tiles at a place, which the source looks up."""
        rows = self.spark.read.format(self.kind).options(path=self.path, includeData=str(data).lower(), **{k: str(v) for k, v in place.items()}).load()
        return rows.select(*PLACE, "tile_bytes", *["tile_data"] * data)

    def metadata(self) -> dict[str, str]:
        if self.kind == "pmtiles":
            return archive.metadata(self.path)
        rows = self.spark.read.format("mbtiles").options(path=self.path, table="metadata").load().collect()
        return {r.name: r.value for r in sorted(rows, key=lambda r: r.name)}

    def tile(self, z: int, x: int, y: int) -> DataFrame:
        """One tile with its payload, in at most one row."""
        return self._read(True, {"zoom": z, "x": x, "y": y}).limit(1)

    def inspect(self, zoom: int | None = None, sample: tuple[str, float] | None = None, layers: list[str] | None = None, tile: tuple[int, int, int] | None = None, **options) -> Report:
        """A report; ``options`` are those of Report."""
        whole = self.tiles(zoom)
        rows = to.sample(whole, *sample) if sample else whole
        some = self.tiles(zoom, True)
        if sample:
            some = some.join(rows.select(*PLACE), PLACE, "left_semi")
        one = mvt.decoded(self.tile(*tile)) if tile else None
        # Tiles of a sample that cannot be decoded are passed over.
        return Report(rows, whole=whole if sample and sample[0] == "ratio" else None, features=mvt.decoded(some, strict=not sample), tile=one, layers=layers, metadata=self.metadata, **options)

    def optimize(self, style: Style, mode: str = "layer+filter", keep_unknown: bool = True, drop_empty: bool = False) -> DataFrame:
        return optimized(self.tiles(data=True), style, mode, keep_unknown, drop_empty)

    def simplify(self, z: int, x: int, y: int, layers: list[str] | None = None, tolerance: float | None = None) -> DataFrame:
        one = self.tile(z, x, y)
        if one.isEmpty():
            raise ValueError(f"there is no tile {z}/{x}/{y}")
        return simplified(one, layers, tolerance)

    def save(self, tiles: DataFrame, path: str, kind: str | None = None, by_place: bool = False) -> Tileset:
        """Write tiles as a file with this one's metadata; map and images stay two tables, ``by_place`` with an image for each tile."""
        kind = format_of(path, kind)
        if Path(path).exists():
            if Path(path).samefile(self.path):
                raise ValueError("the output is the input")
            Path(path).unlink()
        if kind == "pmtiles":
            archive.write(tiles, path, self.metadata())
        else:
            mbtiles.write(tiles, path, self.metadata(), two_tables=self.kind == "mbtiles" and mbtiles.is_split(self.path), by_place=by_place)
        return Tileset(self.spark, path, kind)

    def copy(self, path: str, kind: str | None = None) -> Tileset:
        if self.kind == format_of(path, kind) == "pmtiles":
            raise ValueError("pmtiles are not copied to pmtiles")
        return self.save(self.tiles(data=True), path, kind)


def optimize_report(before: Tileset, after: Tileset, style: Style, mode: str, keep_unknown: bool, max_bytes: int = MAX_TILE_BYTES) -> dict[str, DataFrame]:
    """Sections of what a style removed; file sizes are those of local files."""
    from quadlake.plans.report import delta

    sizes = [(Path(before.path).stat().st_size, Path(after.path).stat().st_size)]
    b, a = before.tiles(), after.tiles()
    features = mvt.decoded(before.tiles(data=True))
    out = {
        "files": before.spark.createDataFrame(sizes, "file_bytes_before long, file_bytes_after long"),
        "tiles": delta(to.overall(b), to.overall(a)),
        "over_limit": to.empty_and_over(a, max_bytes),
    }
    if mode != "layer":
        out |= {
            "removed_features": fo.removed_by_zoom(features, style, keep_unknown).orderBy("zoom"),
            "removed_layers": fo.removed_layers(features, style, keep_unknown).orderBy("layer"),
            "unknown": fo.unknown_by_layer(features, style).orderBy("layer"),
        }
    return out
