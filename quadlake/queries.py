"""Queries over the driver's tables, seen as tiles and features, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions import tile as T
from quadlake.operators import features as fo
from quadlake.operators import tiles as to
from quadlake.plans.style import Style, value

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
BUCKETS, LIMIT = 10, 40_000


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_linenumber").alias("zoom"), F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"), F.col("l_extendedprice").cast("long").alias("tile_bytes"))


LINE = "t AS (SELECT l_linenumber AS zoom, l_orderkey AS x, l_partkey AS y, trunc(l_extendedprice)::BIGINT AS tile_bytes FROM lineitem)"


def page_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select((F.col("page_id") % 5).cast("int").alias("zoom"), F.expr("page_id div 5").alias("x"), (F.col("page_id") % 7).alias("y"), F.octet_length("html").cast("long").alias("tile_bytes"))


PAGE = "t AS (SELECT (page_id % 5)::INT AS zoom, page_id // 5 AS x, page_id % 7 AS y, octet_length(encode(html))::BIGINT AS tile_bytes FROM pages)"


def text_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select((F.col("n_chars") % 8).cast("int").alias("zoom"), F.col("doc_id").alias("x"), F.lit(0).cast("long").alias("y"), F.octet_length("text").cast("long").alias("tile_bytes"))


TEXT = "t AS (SELECT (n_chars % 8)::INT AS zoom, doc_id AS x, 0::BIGINT AS y, octet_length(encode(text))::BIGINT AS tile_bytes FROM documents)"


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders: numbers and strings as properties; quantity is missing above 45."""
    number = lambda c: F.struct(*(value("number", d=F.col(c))[f].alias(f) for f in ("kind", "s", "d", "b")), F.col(c).cast("string").alias("text"))
    string = lambda c: F.struct(*(value("string", s=F.col(c))[f].alias(f) for f in ("kind", "s", "d", "b")), F.col(c).alias("text"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("quantity", number("l_quantity")), ("discount", number("l_discount")), ("flag", string("l_returnflag")), ("status", string("l_linestatus")))))
    known = F.filter(pairs, lambda p: (p["key"] != "quantity") | (p["value"]["d"] <= 45))
    return read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("zoom"), F.col("l_orderkey").alias("x"), F.lit(0).cast("long").alias("y"), F.concat("l_returnflag", "l_linestatus").alias("layer"), F.col("l_partkey").alias("feature_index"),
        F.when(F.col("l_suppkey") % 3 == 0, "Point").when(F.col("l_suppkey") % 3 == 1, "MultiLineString").otherwise("Polygon").alias("geom_type"),
        (F.col("l_partkey") % 9 + 1).alias("vertices"), F.map_from_entries(known).alias("properties"),
    )


FEATURES = """f AS (SELECT l_linenumber AS zoom, l_orderkey AS x, l_returnflag || l_linestatus AS layer, CASE WHEN l_quantity <= 45 THEN l_quantity END AS quantity, l_discount AS discount,
  l_returnflag AS flag, l_linestatus AS status, CASE l_suppkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS geom, l_partkey % 9 + 1 AS vertices, l_partkey AS feature_index FROM lineitem)"""


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_STATS = "count(*) AS tile_count, coalesce(sum(tile_bytes), 0)::BIGINT AS total_bytes, max(tile_bytes) AS max_bytes, (sum(tile_bytes) // count(*))::BIGINT AS avg_bytes"


@query(f"WITH {LINE} SELECT {_STATS} FROM t")
def tile_overall(spark, sf):
    return to.overall(line_tiles(spark, sf))


@query(f"WITH {LINE} SELECT zoom, {_STATS}, min(tile_bytes) AS min_bytes FROM t GROUP BY zoom")
def tile_by_zoom(spark, sf):
    return to.by_zoom(line_tiles(spark, sf))


@query(f"WITH {LINE} SELECT zoom, {_STATS} FROM t GROUP BY ROLLUP (zoom)")
def tile_rollup(spark, sf):
    return to.by_zoom_and_overall(line_tiles(spark, sf))


@query(f"WITH {LINE} SELECT {_STATS} FROM t WHERE zoom = 3")
def zoom_filter(spark, sf):
    return to.overall(line_tiles(spark, sf).where("zoom = 3"))


@query(f"""WITH {TEXT} SELECT count(*) AS used, count(*) FILTER (tile_bytes <= 50) AS empty_tiles, count(*) FILTER (tile_bytes <= 50) / count(*)::DOUBLE AS empty_ratio,
count(*) FILTER (tile_bytes > 10000) AS over_limit FROM t""")
def empty_over_limit(spark, sf):
    return to.empty_and_over(text_tiles(spark, sf), 10_000)


def _histogram_sql(source: str, zoom: bool, limit: int) -> str:
    k, on, by = ("zoom, ", "USING (zoom)", "PARTITION BY zoom ORDER BY bucket") if zoom else ("", "ON true", "ORDER BY bucket")
    part, group = ("PARTITION BY zoom", "GROUP BY zoom") if zoom else ("", "")
    return f"""WITH {source}, r AS (SELECT {k}min(tile_bytes) AS lo, max(tile_bytes) AS hi, ceil(greatest(max(tile_bytes) - min(tile_bytes), 1) / {BUCKETS}.0)::BIGINT AS bs FROM t {group}),
h AS (SELECT {k}least((tile_bytes - lo) // bs, {BUCKETS - 1}) AS bucket, count(*) AS c, sum(tile_bytes) AS b FROM t JOIN r {on} GROUP BY ALL),
d AS (SELECT {k}i.range AS bucket, lo + i.range * bs AS min_bytes, CASE WHEN i.range = {BUCKETS - 1} THEN hi ELSE lo + (i.range + 1) * bs - 1 END AS max_bytes FROM r, range({BUCKETS}) i),
g AS (SELECT d.*, coalesce(c, 0) AS c, coalesce(b, 0) AS b FROM d LEFT JOIN h USING ({k}bucket)),
a AS (SELECT *, sum(c) OVER w AS ac, sum(b) OVER w AS ab, sum(c) OVER ({part}) AS n, sum(b) OVER ({part}) AS s FROM g WINDOW w AS ({by} ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN ac = 0 THEN 0 ELSE ab // ac END AS ra FROM a)
SELECT {k}bucket, min_bytes, max_bytes, c::BIGINT AS count, b::BIGINT AS bytes, ra::BIGINT AS running_avg, CASE WHEN n = 0 THEN 0.0 ELSE c::DOUBLE / n::DOUBLE END AS pct_tiles, CASE WHEN s = 0 THEN 0.0 ELSE b::DOUBLE / s::DOUBLE END AS pct_bytes,
CASE WHEN n = 0 THEN 0.0 ELSE ac::DOUBLE / n::DOUBLE END AS accum_pct_tiles, CASE WHEN s = 0 THEN 0.0 ELSE ab::DOUBLE / s::DOUBLE END AS accum_pct_bytes, ra >= {limit} * 0.9 AND ra <= {limit} AS avg_near_limit, ra > {limit} AS avg_over_limit FROM v"""


@query(_histogram_sql(LINE, False, LIMIT))
def size_histogram(spark, sf):
    return to.histogram(line_tiles(spark, sf), BUCKETS, LIMIT)


@query(_histogram_sql(PAGE, False, 3000))
def size_histogram_pages(spark, sf):
    return to.histogram(page_tiles(spark, sf), BUCKETS, 3000)


@query(_histogram_sql(LINE, True, LIMIT))
def zoom_histogram(spark, sf):
    return to.zoom_histograms(line_tiles(spark, sf), BUCKETS, LIMIT)


@query(f"""WITH {LINE}, z AS (SELECT zoom, count(*) AS c, sum(tile_bytes) AS b FROM t GROUP BY zoom)
SELECT zoom, c AS tile_count, b::BIGINT AS total_bytes, c::DOUBLE / (sum(c) OVER ())::DOUBLE AS pct_tiles, b::DOUBLE / (sum(b) OVER ())::DOUBLE AS pct_bytes,
(sum(c) OVER w)::DOUBLE / (sum(c) OVER ())::DOUBLE AS accum_pct_tiles, (sum(b) OVER w)::DOUBLE / (sum(b) OVER ())::DOUBLE AS accum_pct_bytes FROM z WINDOW w AS (ORDER BY zoom ROWS UNBOUNDED PRECEDING)""")
def zoom_table_cumulative(spark, sf):
    return to.zoom_table(line_tiles(spark, sf))


@query(f"WITH {LINE} SELECT * FROM t ORDER BY tile_bytes DESC, zoom DESC, x DESC, y DESC LIMIT 25")
def top_tiles(spark, sf):
    return to.top(line_tiles(spark, sf), 25)


_BUCKETED = f"r AS (SELECT min(tile_bytes) AS lo, ceil(greatest(max(tile_bytes) - min(tile_bytes), 1) / {BUCKETS}.0)::BIGINT AS bs FROM t), b AS (SELECT t.*, least((tile_bytes - lo) // bs, {BUCKETS - 1}) AS bucket FROM t, r)"


@query(f"WITH {LINE}, {_BUCKETED} SELECT zoom, x, y, tile_bytes FROM b WHERE bucket = 8 ORDER BY tile_bytes DESC, zoom, x, y LIMIT 100")
def bucket_tiles_size(spark, sf):
    return to.in_bucket(line_tiles(spark, sf), BUCKETS, 8)


@query(f"WITH {LINE}, {_BUCKETED} SELECT zoom, x, y, tile_bytes FROM b WHERE bucket = 8 ORDER BY zoom, x, y LIMIT 100")
def bucket_tiles_zxy(spark, sf):
    return to.in_bucket(line_tiles(spark, sf), BUCKETS, 8, sort="zxy")


@query(f"WITH {LINE}, {_BUCKETED} SELECT count(*) FILTER (bucket = 4) AS bucket_count FROM b")
def bucket_count(spark, sf):
    return to.bucket_count(line_tiles(spark, sf), BUCKETS, 4)


@query(f"SELECT bucket FROM ({_histogram_sql(LINE, False, 35000)}) QUALIFY CASE WHEN bool_or(avg_over_limit) OVER () THEN avg_over_limit ELSE avg_near_limit END")
def recommended_buckets(spark, sf):
    return to.recommended(to.histogram(line_tiles(spark, sf), BUCKETS, 35_000))


_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY zoom ORDER BY x, y) AS i, count(*) OVER (PARTITION BY zoom) AS total FROM t)"


@query(f"WITH {LINE}, {_NUMBERED} SELECT zoom, {_STATS} FROM n WHERE i <= 100 GROUP BY zoom")
def sample_count(spark, sf):
    return to.by_zoom(to.sample(line_tiles(spark, sf), "count", 100)).drop("min_bytes")


_MOD = "18446744073709551616::UHUGEINT"
_MIX = f"""a AS (SELECT *, ((xor(i::UBIGINT, total::UBIGINT)::UHUGEINT + 11400714819323198485::UHUGEINT) % {_MOD})::UBIGINT AS z FROM n),
b AS (SELECT *, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_MOD})::UBIGINT AS z2 FROM a), c AS (SELECT *, ((xor(z2, z2 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_MOD})::UBIGINT AS z3 FROM b)"""


@query(f"WITH {PAGE}, {_NUMBERED}, {_MIX} SELECT zoom, x, y, tile_bytes FROM c WHERE xor(z3, z3 >> 31) <= 4611686018427387904::UBIGINT")
def sample_ratio(spark, sf):
    return to.sample(page_tiles(spark, sf), "ratio", 0.25)


_LONG = """p AS (SELECT zoom, x, layer, 'quantity' AS name, quantity::VARCHAR AS text FROM f WHERE quantity IS NOT NULL UNION ALL SELECT zoom, x, layer, 'discount', discount::VARCHAR FROM f
  UNION ALL SELECT zoom, x, layer, 'flag', flag FROM f UNION ALL SELECT zoom, x, layer, 'status', status FROM f)"""
_LAYERS = f"""{FEATURES}, {_LONG}, c AS (SELECT layer, count(*) AS feature_count, sum(vertices)::BIGINT AS vertex_count FROM f GROUP BY layer),
s AS (SELECT layer, count(DISTINCT name) AS property_keys, count(DISTINCT text) AS property_values FROM p GROUP BY layer), l AS (SELECT * FROM c JOIN s USING (layer))"""


@query(f"WITH {_LAYERS} SELECT * FROM l")
def layer_list(spark, sf):
    return fo.layers(line_features(spark, sf))


@query(f"WITH {_LAYERS} SELECT * FROM l WHERE layer IN ('AF', 'RF')")
def layer_filter(spark, sf):
    return fo.layers(line_features(spark, sf), ["AF", "RF"])


@query(f"WITH {_LAYERS} SELECT count(*) AS layer_count, sum(feature_count)::BIGINT AS feature_count, sum(vertex_count)::BIGINT AS vertex_count, sum(property_keys)::BIGINT AS property_keys, sum(property_values)::BIGINT AS property_values FROM l")
def layer_totals(spark, sf):
    return fo.totals(fo.layers(line_features(spark, sf)))


@query(f"""WITH {FEATURES}, {_LONG}, c AS (SELECT zoom, x, count(DISTINCT layer) AS layer_count, count(*) AS feature_count, sum(vertices)::BIGINT AS vertex_count FROM f GROUP BY ALL),
s AS (SELECT zoom, x, count(DISTINCT name) AS property_keys, count(DISTINCT text) AS property_values FROM p GROUP BY ALL) SELECT zoom, x, 0::BIGINT AS y, layer_count, feature_count, vertex_count, property_keys, property_values FROM c JOIN s USING (zoom, x)""")
def tile_summary(spark, sf):
    return fo.tile_summary(line_features(spark, sf))


@query(f"WITH {FEATURES}, {_LONG} SELECT layer, string_agg(DISTINCT name, ',' ORDER BY name) AS property_names FROM p GROUP BY layer")
def property_names(spark, sf):
    return fo.property_names(line_features(spark, sf))


STYLE = {
    "layers": [
        {"source": "s", "source-layer": "AF", "minzoom": 2, "maxzoom": 5, "filter": ["==", "status", "F"]},
        {"source": "s", "source-layer": "RF", "filter": ["any", ["in", "quantity", 1, 2, 3], ["==", ["get", "discount"], 0.05]]},
        {"source": "s", "source-layer": "RF", "filter": ["<", "quantity", 10]},
        {"source": "s", "source-layer": "NO", "layout": {"visibility": "none"}},
        {"source": "s", "source-layer": "NO", "paint": {"line-width": {"stops": [[3, 0], [4, 2]]}}, "filter": ["!=", "quantity", 7]},
        {"source": "s", "source-layer": "NF", "paint": {"fill-opacity": 0}},
        {"source": "none"},
    ]
}
#: Rules that apply, as (condition, filter) in SQL.
_RULES = [
    ("layer = 'AF' AND zoom >= 2 AND zoom < 5", "status = 'F'"),
    ("layer = 'RF'", "(quantity IN (1, 2, 3) OR discount = 0.05)"),
    ("layer = 'RF'", "NULL::BOOLEAN"),
    ("layer = 'NO' AND zoom <> 3", "quantity <> 7"),
]
_DECIDED = f"""{FEATURES}, d AS (SELECT *, {" OR ".join(f"({c})" for c, _ in _RULES)} AS visible, layer IN ('AF', 'RF', 'NO', 'NF') AS known,
  {" OR ".join(f"CASE WHEN {c} THEN {e} ELSE false END" for c, e in _RULES)} AS decision FROM f)"""


@query("SELECT * FROM (VALUES ('AF', 2), ('AF', 3), ('AF', 4)) v(source_layer, zoom) UNION ALL SELECT 'RF', range::INT FROM range(32) UNION ALL SELECT 'NO', range::INT FROM range(32) WHERE range <> 3")
def style_visible_layers(spark, sf):
    return Style(STYLE).table(spark, range(32))


@query(f"WITH {_DECIDED} SELECT zoom, x, feature_index FROM d WHERE visible AND coalesce(decision, true)")
def prune_kept_features(spark, sf):
    return fo.pruned(line_features(spark, sf), Style(STYLE)).select("zoom", "x", "feature_index")


@query(f"WITH {_DECIDED} SELECT zoom, x, feature_index FROM d WHERE visible AND coalesce(decision, false)")
def filter_unknown_drop(spark, sf):
    return fo.pruned(line_features(spark, sf), Style(STYLE), keep_unknown=False).select("zoom", "x", "feature_index")


@query(f"WITH {_DECIDED} SELECT zoom, count(*) AS removed_features FROM d WHERE visible AND NOT coalesce(decision, false) GROUP BY zoom")
def prune_removed_features_by_zoom(spark, sf):
    return fo.removed_by_zoom(line_features(spark, sf), Style(STYLE), keep_unknown=False)


@query(f"""WITH {_DECIDED}, t AS (SELECT zoom, x, layer, bool_or(visible AND coalesce(decision, false)) AS kept FROM d GROUP BY ALL)
SELECT layer, string_agg(DISTINCT zoom, ',' ORDER BY zoom) AS zooms FROM t WHERE NOT kept GROUP BY layer""")
def prune_removed_layers(spark, sf):
    return fo.removed_layers(line_features(spark, sf), Style(STYLE), keep_unknown=False)


@query(f"""WITH {_DECIDED} SELECT layer, sum(CASE layer WHEN 'RF' THEN (NOT coalesce(quantity IN (1, 2, 3) OR discount = 0.05, false))::INT + (quantity IS NULL AND discount <> 0.05)::INT
  WHEN 'NO' THEN (quantity IS NULL)::INT ELSE 0 END)::BIGINT AS unknown_evaluations, count(*) FILTER (decision IS NULL) AS unknown_features FROM d WHERE visible GROUP BY layer""")
def unknown_counters(spark, sf):
    return fo.unknown_by_layer(line_features(spark, sf), Style(STYLE))


def _filter_query(name: str, rule, sql: str) -> None:
    """A filter over all features: how many it keeps, drops and does not know, by layer."""

    def run(spark, sf):
        rows = fo.judged(line_features(spark, sf), Style({"layers": [{"source": "s", "source-layer": x, "filter": rule} for x in ("AF", "RF", "AO", "RO", "NO", "NF")]}))
        return rows.groupBy("layer").agg(F.count_if("decision").alias("kept"), F.count_if(~F.col("decision")).alias("dropped"), F.count_if(F.col("decision").isNull()).alias("unknown"))

    run.__name__ = name
    query(f"WITH {FEATURES}, d AS (SELECT layer, ({sql})::BOOLEAN AS v FROM f) SELECT layer, count(*) FILTER (v) AS kept, count(*) FILTER (NOT v) AS dropped, count(*) FILTER (v IS NULL) AS unknown FROM d GROUP BY layer")(run)


for _name, _rule, _sql in (
    ("filter_eq", ["==", "quantity", 7], "quantity = 7"),
    ("filter_eq_kind", ["==", "flag", 1], "false"),
    ("filter_neq", ["!=", "quantity", 7], "quantity <> 7"),
    ("filter_in", ["in", "quantity", 1, 2, "3"], "quantity IN (1, 2)"),
    ("filter_not_in", ["!in", "quantity", [1, 2]], "quantity NOT IN (1, 2)"),
    ("filter_has", ["has", "quantity"], "quantity IS NOT NULL"),
    ("filter_not_has", ["!has", "quantity"], "quantity IS NULL"),
    ("filter_type", ["==", "$type", "LineString"], "geom = 'LineString'"),
    ("filter_zoom", ["==", ["zoom"], 3], "zoom = 3"),
    ("filter_unsupported", [">=", "quantity", 3], "NULL"),
    ("filter_all_any_none_not", ["all", ["any", ["==", "quantity", 7], ["==", "flag", "A"]], ["none", ["==", "discount", 0.02]], ["!", ["==", "status", "O"]]], "(quantity = 7 OR flag = 'A') AND NOT (discount = 0.02) AND NOT (status = 'O')"),
    ("expr_match", ["==", ["match", ["get", "quantity"], 1, "one", 2, "two", "many"], "many"], "CASE WHEN quantity IS NULL THEN NULL ELSE quantity NOT IN (1, 2) END"),
    ("expr_case", ["==", ["case", ["==", "quantity", 7], "a", ["==", "flag", "N"], "b", "c"], "b"], "CASE WHEN quantity IS NULL THEN NULL WHEN quantity = 7 THEN false ELSE flag = 'N' END"),
    ("expr_coalesce", ["==", ["coalesce", ["get", "quantity"], ["get", "discount"]], 0.04], "coalesce(quantity, discount) = 0.04"),
):
    _filter_query(_name, _rule, _sql)


@query(f"WITH {FEATURES} SELECT layer, count(*) AS n FROM f WHERE layer IN ('AF', 'RF') GROUP BY layer")
def layer_semi(spark, sf):
    f = line_features(spark, sf)
    wanted = spark.createDataFrame([("AF",), ("RF",)], "layer string")
    return fo.layer_semi(f, wanted).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"WITH {FEATURES} SELECT layer, count(*) AS n FROM f WHERE layer NOT IN ('AF', 'RF') GROUP BY layer")
def layer_anti(spark, sf):
    f = line_features(spark, sf)
    wanted = spark.createDataFrame([("AF",), ("RF",)], "layer string")
    return fo.layer_anti(f, wanted).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS x, o_custkey AS tile_id, c_name AS tile_data FROM orders JOIN customer ON o_custkey = c_custkey")
def map_images_join(spark, sf):
    m = read(spark, sf, "orders").select(F.col("o_orderkey").alias("x"), F.col("o_custkey").alias("tile_id"))
    i = read(spark, sf, "customer").select(F.col("c_custkey").alias("tile_id"), F.col("c_name").alias("tile_data"))
    return to.normalized(m, i)


def directory(spark, sf):
    """Orders as directory entries: a run of as many tiles as an order has lines."""
    runs = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("run_length"), F.sum(F.col("l_quantity").cast("long")).alias("length"))
    return runs.select((F.col("l_orderkey") * 10).alias("tile_id"), "run_length", "length")


_DIRECTORY = "e AS (SELECT l_orderkey * 10 AS tile_id, count(*) AS run_length, sum(l_quantity::BIGINT)::BIGINT AS length FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_DIRECTORY} SELECT tile_id, run_length, length, tile_id + unnest(range(run_length)) AS tile FROM e")
def directory_expand(spark, sf):
    return to.expand_directory(directory(spark, sf))


@query(f"WITH {_DIRECTORY} SELECT * FROM e WHERE tile_id <= 10001 AND 10001 < tile_id + run_length")
def range_lookup(spark, sf):
    return to.find_entry(directory(spark, sf), 10_001)


@query(f"WITH {_DIRECTORY} SELECT tile_id, length, (coalesce(sum(length) OVER (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset, tile_id - coalesce(lag(tile_id) OVER (ORDER BY tile_id), 0) AS delta FROM e")
def directory_offsets(spark, sf):
    from quadlake.sources.archive import offsets

    return offsets(directory(spark, sf).drop("run_length")).select("tile_id", "length", "offset", "delta")


@query("""WITH p AS (SELECT page_id, (page_id % 16)::BIGINT AS x, (page_id // 16 % 16)::BIGINT AS y FROM pages),
s3 AS (SELECT *, 64 * xor(3 * (x >> 3 & 1), y >> 3 & 1) AS d, CASE WHEN y >> 3 & 1 = 0 THEN CASE WHEN x >> 3 & 1 = 1 THEN 15 - y ELSE y END ELSE x END AS x3, CASE WHEN y >> 3 & 1 = 0 THEN CASE WHEN x >> 3 & 1 = 1 THEN 15 - x ELSE x END ELSE y END AS y3 FROM p),
s2 AS (SELECT *, d + 16 * xor(3 * (x3 >> 2 & 1), y3 >> 2 & 1) AS d2, CASE WHEN y3 >> 2 & 1 = 0 THEN CASE WHEN x3 >> 2 & 1 = 1 THEN 15 - y3 ELSE y3 END ELSE x3 END AS x2, CASE WHEN y3 >> 2 & 1 = 0 THEN CASE WHEN x3 >> 2 & 1 = 1 THEN 15 - x3 ELSE x3 END ELSE y3 END AS y2 FROM s3),
s1 AS (SELECT *, d2 + 4 * xor(3 * (x2 >> 1 & 1), y2 >> 1 & 1) AS d1, CASE WHEN y2 >> 1 & 1 = 0 THEN CASE WHEN x2 >> 1 & 1 = 1 THEN 15 - y2 ELSE y2 END ELSE x2 END AS x1, CASE WHEN y2 >> 1 & 1 = 0 THEN CASE WHEN x2 >> 1 & 1 = 1 THEN 15 - x2 ELSE x2 END ELSE y2 END AS y1 FROM s2)
SELECT page_id, 85 + d1 + xor(3 * (x1 & 1), y1 & 1) AS tile_id FROM s1""")
def hilbert_id(spark, sf):
    p = read(spark, sf, "pages").select("page_id", (F.col("page_id") % 16).alias("x"), F.expr("page_id div 16 % 16").alias("y"))
    return p.select("page_id", T.hilbert_id(F.lit(4), F.col("x"), F.col("y")).alias("tile_id"))


@query("SELECT n_name AS name, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def metadata_map(spark, sf):
    n, r = read(spark, sf, "nation"), F.broadcast(read(spark, sf, "region"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("value"))


@query("SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.2fMB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2fKB', b / 1024.0) ELSE printf('%dB', b) END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)")
def format_bytes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.human_bytes(F.octet_length("text").cast("long")).alias("size"))


@query(f"""WITH {LINE}, s AS (SELECT count(*) AS b, count(*) FILTER (tile_bytes <= 30000) AS a, sum(tile_bytes)::BIGINT AS bb, (sum(tile_bytes) FILTER (tile_bytes <= 30000))::BIGINT AS ab FROM t)
SELECT b AS tiles_before, a AS tiles_after, printf('%+d', a - b) AS tiles_diff, bb AS bytes_before, ab AS bytes_after, (bb - ab)::DOUBLE / bb * 100 AS percent_reduction, (ab - bb)::DOUBLE / bb * 100 AS percent_change FROM s""")
def optimize_delta(spark, sf):
    from quadlake.plans.report import delta

    before = line_tiles(spark, sf)
    return delta(to.overall(before), to.overall(before.where("tile_bytes <= 30000")))


@query(f"""WITH {LINE} SELECT 'summary' AS type, to_json({{'tile_count': count(*), 'total_bytes': sum(tile_bytes)::BIGINT}})::VARCHAR AS record FROM t
UNION ALL SELECT 'zoom', to_json({{'zoom': zoom, 'tile_count': count(*)}})::VARCHAR FROM t GROUP BY zoom""")
def ndjson_records(spark, sf):
    from quadlake.plans.report import records

    t = line_tiles(spark, sf)
    return records({"summary": to.overall(t).select("tile_count", "total_bytes"), "zoom": to.by_zoom(t).select("zoom", "tile_count")})


@query("SELECT vec_id, len(embedding) // 2 AS vertices FROM embeddings")
def vertex_count(spark, sf):
    return polylines(spark, sf).select("vec_id", T.vertex_count(F.col("line")).alias("vertices"))


def polylines(spark, sf):
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(embedding) div 2 - 1")), lambda i: F.struct(F.get("embedding", 2 * i).alias("x"), F.get("embedding", 2 * i + 1).alias("y")))
    return read(spark, sf, "embeddings").select("vec_id", F.array(pairs).alias("line"))


@query()
def simplify_lines(spark, sf):
    from quadlake.operators.geometry import simplified

    return polylines(spark, sf).select("vec_id", F.size(F.get(simplified(F.col("line"), False, 0.1), 0)).alias("points"))


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS n_bytes, sha256(html) AS digest, true AS zipped FROM pages")
def gzip_roundtrip(spark, sf):
    from quadlake.sources.archive import gunzipped, gzipped, is_gzip

    p = read(spark, sf, "pages").select("page_id", gzipped(F.col("html").cast("binary")).alias("data"))
    back = gunzipped(F.col("data"))
    return p.select("page_id", F.octet_length(back).cast("long").alias("n_bytes"), F.sha2(back, 256).alias("digest"), is_gzip(F.col("data")).alias("zipped"))


@query("""SELECT l_linenumber AS zoom, l_returnflag || l_linestatus AS layer, count(*) AS n, sum(l_partkey)::BIGINT AS ids, count(*) FILTER (l_quantity <= 45) AS with_quantity, sum(CASE WHEN l_quantity <= 45 THEN l_quantity END) AS quantity
FROM lineitem GROUP BY ALL""")
def mvt_roundtrip(spark, sf):
    """All lines encoded to tiles and decoded again."""
    quantity = F.col("properties")["quantity"]
    return all_decoded(spark, sf).groupBy("zoom", "layer").agg(
        F.count("*").alias("n"), F.sum("feature_id").cast("long").alias("ids"), F.count(quantity).alias("with_quantity"), F.sum(quantity["d"]).alias("quantity")
    )


def all_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all lines after encoding to tiles and decoding (the encoder groups by tile)."""
    from quadlake.sources.mvt import decoded, encoded

    f = line_features(spark, sf).withColumn("geometry", F.array(F.array(F.struct(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y")))))
    f = f.withColumns({"geom_type": F.lit("Point"), "feature_id": F.col("feature_index"), "extent": F.lit(4096)})
    return decoded(encoded(f))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
