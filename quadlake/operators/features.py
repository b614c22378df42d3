"""Statistics of a feature relation: tile columns, layer, feature_index, geom_type, vertices, and
properties (map of name -> struct kind, s, d, b, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.plans.style import Style


def layers(features: DataFrame, keep: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Features, vertices, distinct property names and value texts of each layer (and of ``keys``).

    Names and texts are made distinct in a shuffle by (layer, name or text), so few layers do not make few tasks."""
    if keep:
        features = features.where(F.col("layer").isin(keep))
    keys = [*(keys or []), "layer"]
    counts = features.groupBy(*keys).agg(F.count("*").alias("feature_count"), F.sum("vertices").cast("long").alias("vertex_count"))
    entry = F.explode(F.map_entries("properties")).alias("p")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("p.key").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("p.value.text").alias("value")))).alias("v")
    distinct = features.select(*keys, entry).select(*keys, both).select(*keys, "v.kind", "v.value").where(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy(*keys).agg(F.count_if(F.col("kind") == 0).alias("property_keys"), F.count_if(F.col("kind") == 1).alias("property_values"))
    return counts.join(sizes, keys, "left").na.fill(0, ["property_keys", "property_values"])


def totals(layers_: DataFrame) -> DataFrame:
    """Sums over layers."""
    return layers_.agg(F.count("*").alias("layer_count"), *(F.sum(c).cast("long").alias(c) for c in ("feature_count", "vertex_count", "property_keys", "property_values")))


def tile_summary(features: DataFrame) -> DataFrame:
    """Of each tile, totals with tile-wide distinct names and value texts.

    One shuffle by tile, after partial aggregates; the sets that are kept are no larger than a tile."""
    keys = ["zoom", "x", "y"]
    rows = features.select(*keys, "layer", "vertices", F.posexplode_outer(F.map_entries("properties")).alias("pos", "p"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0  # one row of each feature
    return rows.groupBy(*keys).agg(
        F.size(F.collect_set("layer")).cast("long").alias("layer_count"), F.count_if(first).alias("feature_count"), F.sum(F.when(first, F.col("vertices"))).cast("long").alias("vertex_count"),
        F.size(F.collect_set("p.key")).cast("long").alias("property_keys"), F.size(F.collect_set("p.value.text")).cast("long").alias("property_values"),
    )


def property_names(features: DataFrame) -> DataFrame:
    """Sorted property names of each layer."""
    names = features.select("layer", F.explode(F.map_keys("properties")).alias("name")).distinct()
    return names.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("property_names"))


def narrowed(features: DataFrame, style: Style) -> DataFrame:
    """``features`` whose ``properties`` have only what the style's filters read, made once for each row: conditions on
    what a generator returns are not pushed below it, so no filter builds the map again."""
    names = style.properties()
    own = F.map_filter("properties", lambda k, _: k.isin(names)) if names else F.col("properties")
    rest = [c for c in features.columns if c != "properties"]
    return features.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.array(own)).alias("properties"))


def judged(features: DataFrame, style: Style) -> DataFrame:
    """``features`` with ``decision`` (null: unknown) and ``unknown_count`` by the style."""
    decision, unknown = style.decision()
    return features.withColumns({"decision": decision, "unknown_count": unknown})


def layer_semi(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features of the layers in ``names`` (layer); the smaller side is chosen by its size, when it runs."""
    return features.join(names, "layer", "left_semi")


def layer_anti(features: DataFrame, names: DataFrame) -> DataFrame:
    """Features of layers that are not in ``names`` (layer)."""
    return features.join(names, "layer", "left_anti")


def _shown(features: DataFrame, style: Style) -> DataFrame:
    return features.where(F.col("layer").isin(sorted(style.source_layers())) & style.visible())


def pruned(features: DataFrame, style: Style, keep_unknown: bool = True, filters: bool = True) -> DataFrame:
    """Features of visible layers that the style's filters keep."""
    shown = _shown(features, style)
    if not filters:
        return shown
    # The filters read a copy of the properties that they name; the features keep all of theirs.
    whole = shown.withColumn("_all", F.col("properties"))
    kept = judged(narrowed(whole, style), style).where(F.coalesce("decision", F.lit(keep_unknown)))
    return kept.select(*(F.col("_all").alias(c) if c == "properties" else F.col(f"`{c}`") for c in features.columns))


def removed_by_zoom(features: DataFrame, style: Style, keep_unknown: bool = True) -> DataFrame:
    """Features that filters remove from visible layers, by zoom."""
    shown = judged(narrowed(_shown(features, style), style), style)
    return shown.where(~F.coalesce("decision", F.lit(keep_unknown))).groupBy("zoom").agg(F.count("*").alias("removed_features"))


def removed_layers(features: DataFrame, style: Style, keep_unknown: bool = True) -> DataFrame:
    """Layers that vanish from a tile's zoom: hidden, unknown to the style, or left without features."""
    kept = _kept(features, style, keep_unknown)
    tiles = narrowed(features, style).withColumn("kept", kept).groupBy("zoom", "x", "y", "layer").agg(F.max("kept").alias("kept"))
    return tiles.where(~F.col("kept")).groupBy("layer").agg(F.array_join(F.sort_array(F.collect_set("zoom")), ",").alias("zooms"))


def _kept(features: DataFrame, style: Style, keep_unknown: bool) -> Column:
    decision, _ = style.decision()
    known = F.col("layer").isin(sorted(style.source_layers()))
    return known & style.visible() & F.coalesce(decision, F.lit(keep_unknown))


def unknown_by_layer(features: DataFrame, style: Style) -> DataFrame:
    """Unknown evaluations, and features whose decision is unknown, by layer."""
    shown = judged(narrowed(_shown(features, style), style), style)
    return shown.groupBy("layer").agg(F.sum("unknown_count").cast("long").alias("unknown_evaluations"), F.count_if(F.col("decision").isNull()).alias("unknown_features"))
