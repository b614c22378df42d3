"""Reports: sections as lazy DataFrames, records of JSON lines, deltas, text tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.tile import MAX_TILE_BYTES, percent_change, percent_reduction, signed
from quadlake.operators import features as fo
from quadlake.operators import tiles as to

#: Names of sections and their other names.
SECTIONS = ("metadata", "summary", "zoom", "histogram", "histogram_by_zoom", "layers", "recommendations", "bucket", "bucket_tiles", "top_tiles", "top_tile_summaries", "tile_summary")


def wanted(text: str | None) -> set[str]:
    """Section names of a comma-separated list; all of them without one."""
    names = {x.strip().lower().replace("-", "_") for x in (text or "all").split(",") if x.strip()}
    bad = names - {*SECTIONS, "all"}
    if bad:
        raise ValueError(f"unknown sections {sorted(bad)}; known: all, {', '.join(SECTIONS)}")
    return set(SECTIONS) if "all" in names else names


class Report:
    """Sections of a tile relation; only those that are looked at are computed."""

    def __init__(
        self, tiles: DataFrame, buckets: int = 10, max_bytes: int = MAX_TILE_BYTES, topn: int = 5, bucket: int | None = None, limit: int = 100, sort: str = "size",
        whole: DataFrame | None = None, features: DataFrame | None = None, tile: DataFrame | None = None, layers: list[str] | None = None, metadata: Callable[[], dict[str, str]] = dict, compact: bool = False,
    ):
        """``whole``: all tiles, where ``tiles`` is a ratio of them (tiles over the limit are counted in
        all); ``features``: those of ``tiles``; ``tile``: those of one tile; ``layers``: the only ones to be shown."""
        self.tiles, self.buckets, self.max_bytes, self.topn, self.bucket, self.limit, self.sort = tiles, buckets, max_bytes, topn, bucket, limit, sort
        self.whole, self.features, self.tile, self.layers, self.metadata, self.compact = whole, features, tile, layers, metadata, compact

    def _summary(self) -> DataFrame:
        rows = to.overall(self.tiles).crossJoin(to.empty_and_over(self.tiles, self.max_bytes))
        return rows if self.whole is None else rows.drop("over_limit").crossJoin(to.empty_and_over(self.whole, self.max_bytes).select("over_limit"))

    def _tile_summary(self, features: DataFrame, keys: list[str]) -> DataFrame:
        """Layers of tiles, with their property names unless compact."""
        own = fo.layers(features, self.layers, keys)
        if not self.compact:
            names = features.select(*keys, "layer", F.explode_outer(F.map_keys("properties")).alias("name")).groupBy(*keys, "layer").agg(F.array_sort(F.collect_set("name")).alias("property_names"))
            own = own.join(names, [*keys, "layer"])
        return own.orderBy(*keys, "layer")

    def _top_features(self) -> DataFrame:
        places = to.top(self.tiles, self.topn).select("zoom", "x", "y")
        return self.features.join(places, ["zoom", "x", "y"], "left_semi")

    def _metadata(self) -> DataFrame:
        return self.tiles.sparkSession.createDataFrame(sorted(self.metadata().items()), "name string, value string")

    def section(self, name: str) -> DataFrame:
        t = self.tiles
        return {
            "metadata": self._metadata,
            "summary": self._summary,
            "zoom": lambda: to.zoom_table(t),
            "histogram": lambda: to.histogram(t, self.buckets, self.max_bytes),
            "histogram_by_zoom": lambda: to.zoom_histograms(t, self.buckets, self.max_bytes),
            "recommendations": lambda: to.recommended(to.histogram(t, self.buckets, self.max_bytes)),
            "bucket": lambda: to.bucket_count(t, self.buckets, -1 if self.bucket is None else self.bucket),
            "bucket_tiles": lambda: to.in_bucket(t, self.buckets, self.bucket or 0, self.limit, self.sort),
            "top_tiles": lambda: to.top(t, self.topn),
            "layers": lambda: fo.layers(self.features, self.layers).orderBy("layer"),
            "tile_summary": lambda: self._tile_summary(self.tile, []),
            "top_tile_summaries": lambda: self._tile_summary(self._top_features(), ["zoom", "x", "y"]),
        }[name]()

    def _summaries(self, features: DataFrame, sizes: DataFrame) -> DataFrame:
        """Of each tile its totals, with its layers nested; ``sizes`` has the tiles' bytes."""
        place = ["zoom", "x", "y"]
        some = features.where(F.col("layer").isin(self.layers)) if self.layers else features
        own = self._tile_summary(features, place)
        layers = own.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("layer", *(c for c in own.columns if c not in (*place, "layer"))))).alias("layers"))
        return fo.tile_summary(some).join(layers, place).join(sizes.select(*place, "tile_bytes"), place)

    def json_lines(self, sections: str | None = None, compact: bool = False, summary: bool = True) -> DataFrame:
        """type, record: the record stream in its order. ``compact`` has no summary record and nests less."""
        names, t = wanted(sections), self.tiles
        tile = ["zoom", "x", "y", "tile_bytes"]
        flat = (F.col("zoom").alias("z"), "x", "y", F.col("tile_bytes").alias("bytes"))
        whole = lambda df, order: F.sort_array(F.collect_list(F.struct(order, *(c for c in df.columns if c != order))))

        def listed(kind: str, df: DataFrame, order: list) -> DataFrame:
            record = F.struct(*flat) if compact else F.struct(F.struct(*tile).alias("tile"))
            return df.select(F.lit(kind).alias("type"), F.to_json(record).alias("record"), F.struct(*order).alias("at"))

        def summaries(kind: str, df: DataFrame) -> DataFrame:
            short = F.struct(*flat, F.col("layer_count").alias("layers"), F.col("feature_count").alias("total_features"), F.col("vertex_count").alias("vertices"), F.col("property_keys").alias("keys"), F.col("property_values").alias("values"))
            record = short if compact else F.struct(F.struct(*df.columns).alias("summary"))
            return df.select(F.lit(kind).alias("type"), F.to_json(record).alias("record"), F.struct(-F.col("tile_bytes"), -F.col("zoom"), -F.col("x"), -F.col("y")).alias("at"))

        def one(kind: str, df: DataFrame, record) -> DataFrame:
            return df.select(F.lit(kind).alias("type"), F.to_json(record).alias("record"), F.lit(0).alias("at"))

        parts = []
        if "summary" in names and summary and not compact:
            zooms = to.by_zoom(t)
            zooms = zooms.agg(whole(zooms, "zoom").alias("by_zoom"))
            total = to.overall(t)
            parts.append(one("summary", total.select(F.struct("*").alias("overall")).crossJoin(zooms).crossJoin(self._summary().select("used", "empty_tiles", "empty_ratio", "over_limit")), F.struct("*")))
        if "histogram" in names and self.buckets:
            h = self.section("histogram")
            h = h.agg(F.count("*").alias("bucket_count"), whole(h, "bucket").alias("buckets")).where("bucket_count > 0")
            parts.append(one("histogram", h, F.struct("bucket_count" if compact else "buckets")))
        if "histogram_by_zoom" in names and self.buckets:
            h = self.section("histogram_by_zoom")
            h = h.groupBy("zoom").agg(F.count("*").alias("bucket_count"), whole(h.drop("zoom"), "bucket").alias("buckets"))
            parts.append(h.select(F.lit("histogram_by_zoom").alias("type"), F.to_json(F.struct("zoom", "bucket_count" if compact else "buckets")).alias("record"), F.col("zoom").alias("at")))
        if "bucket" in names and self.bucket is not None:
            parts.append(one("bucket_count", self.section("bucket").where(F.col("bucket_count").isNotNull()), F.struct(F.col("bucket_count").alias("count"))))
        if "bucket_tiles" in names and self.bucket is not None:
            parts.append(listed("bucket_tile", self.section("bucket_tiles"), [-F.col("tile_bytes"), "zoom", "x", "y"] if self.sort == "size" else ["zoom", "x", "y"]))
        if "top_tiles" in names and self.topn:
            parts.append(listed("top_tile", self.section("top_tiles"), [-F.col("tile_bytes"), -F.col("zoom"), -F.col("x"), -F.col("y")]))
        if "tile_summary" in names and self.tile is not None:
            parts.append(summaries("tile_summary", self._summaries(self.tile, t)))
        if "recommendations" in names and self.buckets:
            r = self.section("recommendations").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).where(F.size("buckets") > 0)
            parts.append(one("recommended_buckets", r, F.struct("buckets")))
        if "top_tile_summaries" in names and self.topn and self.features is not None:
            parts.append(summaries("top_tile_summary", self._summaries(self._top_features(), to.top(t, self.topn))))
        if not parts:
            return t.sparkSession.createDataFrame([], "type string, record string")
        # Each part's order as text of one kind of column, behind the part's own number.
        place = lambda df: df.orderBy("at").select("type", "record")
        numbered = [place(df).withColumn("n", F.lit(i)).withColumn("k", F.monotonically_increasing_id()) for i, df in enumerate(parts)]
        return reduce(DataFrame.unionByName, numbered).orderBy("n", "k").select("type", "record")


def records(sections: dict[str, DataFrame]) -> DataFrame:
    """type, record (JSON) of each row of each section."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("type"), F.to_json(F.struct("*")).alias("record")) for name, df in sections.items()))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row statistics side by side."""
    a, b = F.col("a"), F.col("b")
    both = before.select(F.struct("*").alias("b")).crossJoin(after.select(F.struct("*").alias("a")))
    return both.select(
        b["tile_count"].alias("tiles_before"), a["tile_count"].alias("tiles_after"), signed(a["tile_count"] - b["tile_count"]).alias("tiles_diff"), b["total_bytes"].alias("bytes_before"), a["total_bytes"].alias("bytes_after"),
        percent_reduction(b["total_bytes"], a["total_bytes"]).alias("percent_reduction"), percent_change(a["total_bytes"], b["total_bytes"]).alias("percent_change"),
    )


def text_table(df: DataFrame) -> list[str]:
    """Lines of a section, all of its rows, columns aligned."""
    rows = [tuple(df.columns), *(tuple("" if v is None else str(v) for v in r) for r in df.collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows]
