"""Style rules compiled to Catalyst columns.

Filters are three-valued: a nullable boolean, null for unknown. A compiled filter is a Column,
or None where the rule has no filter. Values are structs (kind, s, d, b), null if missing;
they are equal only within one kind, so nothing is ever cast.

Columns that the result reads: zoom, layer, geom_type, properties (map of structs).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paint properties that hide a layer where they are zero.
PAINT = (
    "fill-opacity", "fill-outline-color", "line-opacity", "line-width", "icon-size", "text-size", "text-max-width", "text-opacity",
    "raster-opacity", "circle-radius", "circle-opacity", "fill-extrusion-opacity", "heatmap-opacity",
)
#: Fixed value: numbers differ from here on.
EPSILON = 2.220446049250313e-16


def unknown() -> Column:
    return F.lit(None).cast("boolean")


class Invalid(ValueError):
    """An operand that cannot be read."""


def value(kind: str, *, s=None, d=None, b=None) -> Column:
    cast = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(F.lit(kind).alias("kind"), cast(s, "string").alias("s"), cast(d, "double").alias("d"), cast(b, "boolean").alias("b"))


def literal(x) -> Column:
    if isinstance(x, bool):
        return value("bool", b=x)
    if isinstance(x, str):
        return value("string", s=x)
    if isinstance(x, int | float):
        return value("number", d=float(x))
    raise Invalid(x)


def prop(name: str) -> Column:
    own = F.col("properties")[name]
    return F.when(own["kind"] != "null", F.struct(*(own[c].alias(c) for c in ("kind", "s", "d", "b"))))


def zoom() -> Column:
    return value("number", d=F.col("zoom"))


def geometry() -> Column:
    return value("string", s=geometry_class(F.col("geom_type")))


def geometry_class(kind: Column) -> Column:
    """Multi geometries count as their parts' class."""
    base = F.regexp_replace(kind, "^Multi", "")
    return F.when(base.isin("Point", "LineString", "Polygon"), base).otherwise("Unknown")


def same(a: Column, b: Column) -> Column:
    """Equality of present values; null if one is missing."""
    by_kind = F.when(a["kind"] == "string", a["s"] == b["s"]).when(a["kind"] == "number", F.abs(a["d"] - b["d"]) < EPSILON).otherwise(a["b"] == b["b"])
    return F.when(a.isNotNull() & b.isNotNull(), (a["kind"] == b["kind"]) & F.coalesce(by_kind, F.lit(False)))


def key(x) -> tuple[str, str | None]:
    """What a key names: ("zoom" | "type" | "property", name)."""
    if isinstance(x, str):
        return {"$type": ("type", None), "geometry-type": ("type", None), "zoom": ("zoom", None)}.get(x, ("property", x))
    if isinstance(x, list) and x and isinstance(x[0], str):
        if x[0] == "get" and len(x) > 1 and isinstance(x[1], str):
            return "property", x[1]
        if x[0] in ("zoom", "geometry-type"):
            return {"zoom": "zoom", "geometry-type": "type"}[x[0]], None
    raise Invalid(x)


def key_value(x) -> Column:
    kind, name = key(x)
    return prop(name) if kind == "property" else {"zoom": zoom, "type": geometry}[kind]()


def expression(x) -> Column:
    """A value expression; Invalid if it cannot be read."""
    if not isinstance(x, list):
        return literal(x)
    if not x or not isinstance(x[0], str):
        raise Invalid(x)
    op, args = x[0], x[1:]
    if op in ("get", "zoom", "geometry-type"):
        return key_value(x)
    if op == "coalesce" and args:
        return F.coalesce(*map(expression, args))
    if op in ("match", "case") and len(x) >= 4:
        head, rest = (args[:1], args[1:]) if op == "match" else ([], args)
        pairs = list(zip(rest[:-1:2], rest[1:-1:2], strict=False))
        otherwise = expression(rest[-1])
        if op == "match":
            given = expression(head[0])
            tests = [same(given, literal(label)) for label, _ in pairs]
        else:
            tests = [inner(test) for test, _ in pairs]
        out = otherwise
        for test, (_, then) in reversed(list(zip(tests, pairs, strict=True))):
            # An unknown test gives no value: later branches are not looked at.
            out = F.when(test, expression(then)).when(~test, out)
        return F.when(given.isNotNull(), out) if op == "match" else out
    raise Invalid(x)


def inner(x) -> Column:
    """A filter within another: unknown if it cannot be read."""
    own = compiled(x)
    return unknown() if own is None else own


def compiled(x) -> Column | None:
    """A filter as a nullable boolean; None if it is no filter at all."""
    if not isinstance(x, list) or not x or not isinstance(x[0], str):
        return None
    op, args = x[0], x[1:]
    need = {"==": 2, "!=": 2, "in": 2, "!in": 2, "has": 1, "!has": 1, "!": 1}.get(op, 0)
    if len(args) < need:
        return unknown()
    try:
        if op in ("==", "!="):
            try:
                left = key_value(args[0])
            except Invalid:
                left = expression(args[0])
            equal = same(left, expression(args[1]))
            return equal if op == "==" else ~equal
        if op in ("in", "!in"):
            own = key_value(args[0])
            items = args[1] if isinstance(args[1], list) else args[1:]
            try:
                tests = [same(own, literal(i)) for i in items]
            except Invalid:
                return unknown()
            found = F.when(own.isNotNull(), reduce(Column.__or__, tests, F.lit(False)))
            return found if op == "in" else ~found
        if op in ("has", "!has"):
            kind, name = key(args[0])
            there = F.coalesce(F.map_contains_key("properties", F.lit(name)), F.lit(False)) if kind == "property" else F.lit(True)
            return there if op == "has" else ~there
    except Invalid:
        return None
    if op == "!":
        return ~inner(args[0])
    if op == "all":
        return reduce(Column.__and__, map(inner, args), F.lit(True))
    if op in ("any", "none"):
        some = reduce(Column.__or__, map(inner, args), F.lit(False))
        return some if op == "any" else ~some
    return unknown()


class Style:
    """Rules of a style: layers with a source and a source-layer, in order."""

    def __init__(self, text: str | dict):
        style = json.loads(text) if isinstance(text, str) else text
        rows = [x for x in style.get("layers", []) if "source" in x and isinstance(x.get("source-layer"), str)]
        if not rows:
            raise ValueError("the style has no layers with a source and a source-layer")
        self.rules = rows

    @classmethod
    def read(cls, path: str) -> Style:
        with open(path) as f:
            return cls(f.read())

    def source_layers(self) -> set[str]:
        return {r["source-layer"] for r in self.rules}

    @staticmethod
    def shown(rule: dict, at: int) -> bool:
        """Whether a rule draws at a zoom: visibility, zoom range and no paint property of zero."""
        layout = rule.get("layout") or {}
        if layout.get("visibility") == "none" or at < rule.get("minzoom", at) or at >= rule.get("maxzoom", at + 1):
            return False
        return not any(_zero(rule.get("paint", {}).get(p), at) for p in PAINT)

    def zooms(self, rule: dict, zooms=range(256)) -> list[int]:
        """Those of ``zooms`` at which a rule draws."""
        return [z for z in zooms if self.shown(rule, z)]

    def _applies(self, rule: dict) -> Column:
        """Whether a rule draws the feature's layer at its zoom, at any zoom that data may have."""
        zoom, paint = F.col("zoom"), [rule.get("paint", {}).get(p) for p in PAINT]
        if (rule.get("layout") or {}).get("visibility") == "none" or any(_number(p) and p == 0 for p in paint):
            return F.lit(False)
        own = F.col("layer") == rule["source-layer"]
        if "minzoom" in rule:
            own = own & (zoom >= F.lit(rule["minzoom"]))
        if "maxzoom" in rule:
            own = own & (zoom < F.lit(rule["maxzoom"]))
        hidden = sorted({int(z) for p in paint for z, *_ in _stops(p) if _zero(p, int(z))})
        return own & ~zoom.isin(hidden) if hidden else own

    def by_layer(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for rule in self.rules:
            out.setdefault(rule["source-layer"], []).append(rule)
        return out

    def _chosen(self, of, otherwise: Column) -> Column:
        """``of(rules)`` by the feature's layer, as one CASE."""
        out = None
        for layer, rules in self.by_layer().items():
            test = F.col("layer") == layer
            out = F.when(test, of(rules)) if out is None else out.when(test, of(rules))
        return out.otherwise(otherwise)

    def visible(self) -> Column:
        """Whether some rule shows the feature's layer at its zoom."""
        return self._chosen(lambda rules: reduce(Column.__or__, map(self._applies, rules)), F.lit(False))

    def properties(self) -> list[str]:
        """Properties that the filters may read, by any text in them."""
        found: set[str] = set()

        def walk(x) -> None:
            if isinstance(x, str):
                found.add(x)
            elif isinstance(x, list):
                for y in x:
                    walk(y)

        for rule in self.rules:
            walk(rule.get("filter"))
        return sorted(found)

    def decision(self) -> tuple[Column, Column]:
        """Whether a rule keeps the feature (null: unknown); and how many rules before the first
        that keeps it are unknown. Rules of other layers say nothing of a feature."""
        def decided(rules: list[dict], count: bool) -> Column:
            result, n, kept = F.lit(False), F.lit(0), F.lit(False)
            for rule in rules:
                own = compiled(rule["filter"]) if "filter" in rule else None
                own = F.lit(True) if own is None else own
                applies = self._applies(rule)
                result = result | F.when(applies, own).otherwise(False)
                n = n + (applies & own.isNull() & ~kept).cast("int")
                kept = kept | (applies & F.coalesce(own, F.lit(False)))
            return n if count else result

        return self._chosen(lambda rules: decided(rules, False), F.lit(False)), self._chosen(lambda rules: decided(rules, True), F.lit(0))

    def table(self, spark, zooms=range(256)):
        """(source_layer, zoom) pairs that are visible at some of ``zooms``: bounded by rules x zooms."""
        rows = sorted({(r["source-layer"], z) for r in self.rules for z in self.zooms(r, zooms)})
        return spark.createDataFrame(rows, "source_layer string, zoom int")


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _stops(paint) -> list:
    """The stops of a paint value, if all of them are readable."""
    stops = paint.get("stops") if isinstance(paint, dict) else None
    return stops if isinstance(stops, list) and all(isinstance(s, list) and len(s) >= 2 and _number(s[0]) and _number(s[1]) for s in stops) else []


def _zero(paint, at: int) -> bool:
    """Whether a paint value is zero at a zoom; stops count at their own zoom only."""
    if _number(paint):
        return paint == 0
    return next((v == 0 for z, v, *_ in _stops(paint) if int(z) == at), False)
