"""The command line: python -m quadlake inspect | optimize | simplify | copy | verify FILE ..., or -m FILE ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from quadlake.functions.tile import MAX_TILE_BYTES, parse_sample, parse_tile
from quadlake.plans.report import records, text_table, wanted
from quadlake.plans.style import Style
from quadlake.tileset import MODES, Tileset, format_of, optimize_report, output_of, transform_stats


def names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadlake")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, report: bool = False, copies: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("input")
        if report:
            p.add_argument("--report-format", choices=("text", "json", "ndjson"), default="text")
            p.add_argument("--max-tile-bytes", type=int, default=MAX_TILE_BYTES)
        if copies:
            p.add_argument("--output")
            p.add_argument("--input-format")
            p.add_argument("--output-format")
        return p

    p = command("inspect", report=True)
    for flag in ("summary", "recommend", "fast", "list-tiles", "ndjson-lite", "ndjson-compact", "include-layer-list"):
        p.add_argument(f"--{flag}", action="store_true")
    for flag in ("topn", "bucket"):
        p.add_argument(f"--{flag}", type=int)
    p.add_argument("--zoom", "-z", type=int)
    p.add_argument("-x", type=int)
    p.add_argument("-y", type=int)
    p.add_argument("--histogram-buckets", type=int, default=10)
    p.add_argument("--sample", type=parse_sample)
    p.add_argument("--stats", nargs="?", const="")
    p.add_argument("--tile", type=parse_tile)
    p.add_argument("--layers", "--layer", type=names, action="extend", default=[])
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--sort", choices=("size", "zxy"), default="size")
    p.add_argument("--tile-info-format", choices=("full", "compact"), default="full")

    p = command("optimize", report=True, copies=True)
    p.add_argument("--style", required=True)
    p.add_argument("--style-mode", choices=MODES, default="layer+filter")
    p.add_argument("--unknown-filter", choices=("keep", "drop"), default="keep")
    p.add_argument("--drop-empty-tiles", action="store_true")

    p = command("simplify", copies=True)
    for flag in "zxy":
        p.add_argument(f"--{flag}", type=int, required=True)
    p.add_argument("--layer", type=names, action="extend", default=[])
    p.add_argument("--tolerance", type=float)

    command("copy", copies=True)
    command("verify")
    return top


def without_command(args: list[str]) -> list[str]:
    """The call with a subcommand that a call without one stands for: a style asks for a pruned copy, a place with layers or
    a tolerance for a simplified tile, a place alone for a summary of its tile, and a file alone for a report."""
    p = argparse.ArgumentParser(prog="quadlake")
    p.add_argument("-m", "--mbtiles", required=True)
    p.add_argument("-s", "--style")
    p.add_argument("-o", "--output")
    for flag in "xyz":
        p.add_argument(f"-{flag}", type=int)
    p.add_argument("-l", action="append", default=[])
    p.add_argument("-t", type=float)
    a = p.parse_args(args)
    out = ["--output", a.output] if a.output else []
    if a.style:
        return ["optimize", a.mbtiles, "--style", a.style, "--style-mode", "vt-compat", *out]
    if None in (a.x, a.y, a.z):
        return ["inspect", a.mbtiles]
    if not a.l and a.t is None:
        return ["inspect", a.mbtiles, "--histogram-buckets", "0", "--stats", "tile_summary", "--tile", f"{a.z}/{a.x}/{a.y}", "--summary"]
    layers = [x for name in a.l for x in ("--layer", name)]
    return ["simplify", a.mbtiles, "--z", str(a.z), "--x", str(a.x), "--y", str(a.y), *layers, *(["--tolerance", str(a.t)] if a.t is not None else []), *out]


def checked(a: argparse.Namespace) -> argparse.Namespace:
    """Options of inspect that go together, and the defaults that follow from them."""
    if a.ndjson_compact:
        a.report_format = "ndjson"
    if a.ndjson_lite and a.report_format != "ndjson":
        raise ValueError("--ndjson-lite needs --report-format ndjson")
    if a.x is not None or a.y is not None:
        if a.tile:
            raise ValueError("--tile does not go with -x and -y")
        if None in (a.zoom, a.x, a.y):
            raise ValueError("-x and -y need each other and --zoom")
        a.tile, a.summary = (a.zoom, a.x, a.y), True
    if a.summary != bool(a.tile):
        raise ValueError("--tile and --summary need each other")
    if a.recommend and (a.zoom is None or not a.histogram_buckets):
        raise ValueError("--recommend needs --zoom and --histogram-buckets")
    if a.list_tiles and a.bucket is None:
        raise ValueError("--list-tiles needs --bucket")
    if a.fast:
        a.sample, a.topn, a.histogram_buckets = ("ratio", 0.1), 5, 10
    a.topn = a.topn or (5 if a.recommend and a.topn is None else 10 if a.report_format == "text" else 0)
    return a


def shown(sections: dict[str, DataFrame], how: str) -> list[str]:
    """Lines of a report. Its sections are bounded: by zooms, buckets, layers or a limit of their own."""
    if how == "ndjson":
        return [json.dumps({"type": r.type} | json.loads(r.record)) for r in records(sections).collect()] if sections else []
    if how == "json":
        return [json.dumps({n: [json.loads(r) for r in df.toJSON().collect()] for n, df in sections.items()}, indent=2)]
    return [line for n, df in sections.items() for line in (f"== {n} ==", *text_table(df), "")]


def inspect(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    a = checked(a)
    report = Tileset(spark, a.input).inspect(
        a.zoom, a.sample, a.layers, a.tile, buckets=a.histogram_buckets, max_bytes=a.max_tile_bytes, topn=a.topn, bucket=a.bucket, limit=a.limit, sort=a.sort, compact=a.tile_info_format == "compact",
    )
    chosen, given = wanted(a.stats), a.stats is not None
    keep = {
        "metadata": a.report_format != "ndjson", "summary": not (a.ndjson_lite or a.ndjson_compact), "zoom": True, "histogram": a.histogram_buckets > 0, "histogram_by_zoom": a.histogram_buckets > 0 and a.zoom is None and not a.sample,
        "layers": (a.include_layer_list or given and "layers" in a.stats) and a.report_format != "ndjson", "recommendations": a.recommend, "bucket": a.bucket is not None, "bucket_tiles": a.list_tiles,
        "top_tiles": a.topn > 0, "top_tile_summaries": a.recommend and a.topn > 0, "tile_summary": bool(a.tile),
    }
    sections = [n for n, yes in keep.items() if yes and n in chosen]
    if a.report_format == "ndjson":
        rows = report.json_lines(",".join(sections), a.ndjson_compact, keep["summary"]).collect() if sections else []
        return [json.dumps({"type": r.type} | json.loads(r.record)) for r in rows]
    return shown({n: report.section(n) for n in sections}, a.report_format)


def optimize(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    path, kind = output_of(a.input, a.output, a.output_format, "pruned")
    source, style = Tileset(spark, a.input, a.input_format), Style.read(a.style)
    if kind != source.kind:
        raise ValueError("tiles are optimized within one format")
    unknown = a.unknown_filter == "keep"
    made = source.save(source.optimize(style, a.style_mode, unknown, a.drop_empty_tiles and kind == "mbtiles"), path, kind, by_place=True)
    return shown(optimize_report(source, made, style, a.style_mode, unknown, a.max_tile_bytes), a.report_format)


def simplify(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    path, kind = output_of(a.input, a.output, a.output_format, "simplified")
    source = Tileset(spark, a.input, a.input_format)
    made = source.save(source.simplify(a.z, a.x, a.y, a.layer, a.tolerance), path, kind)
    return shown({"simplified": transform_stats(source.tile(a.z, a.x, a.y), made.tiles(data=True))}, "text")


def copy(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    if not a.output and not a.output_format:
        raise ValueError("copy needs --output or --output-format")
    path, kind = output_of(a.input, a.output, a.output_format, "copy")
    made = Tileset(spark, a.input, a.input_format or format_of(a.input)).copy(path, kind)
    return [f"{made.path}: {made.tiles().count()} tiles"]


def verify(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Only that the file can be opened."""
    Tileset(spark, a.input).tiles()
    return [f"verify: input={a.input}"]


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args and args[0].startswith("-") and args[0] not in ("-h", "--help"):
        args = without_command(args)
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quadlake").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        lines = {"inspect": inspect, "optimize": optimize, "simplify": simplify, "copy": copy, "verify": verify}[a.command](spark, a)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for line in lines:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
