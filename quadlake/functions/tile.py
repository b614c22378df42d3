"""Scalar functions over tile coordinates, sizes and geometry, as Catalyst expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_BYTES, MAX_TILE_BYTES, NEAR = 50, 1_280_000, 0.9
_U64 = (1 << 64) - 1


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Number of a tile on the Hilbert curve, after all tiles of smaller zooms."""
    top = F.pow(F.lit(2.0), z).cast("long")

    def step(acc, i):
        bit = F.pow(F.lit(2.0), i).cast("long")
        rx, ry = acc["x"].bitwiseAND(bit) / bit, acc["y"].bitwiseAND(bit) / bit
        rx, ry = rx.cast("long"), ry.cast("long")
        d = acc["d"] + bit * bit * (F.lit(3) * rx).bitwiseXOR(ry)
        fx = F.when((ry == 0) & (rx == 1), top - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when((ry == 0) & (rx == 1), top - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.cast("long").alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    steps = F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))
    base = ((top * top - 1) / 3).cast("long")
    return F.when(z == 0, F.lit(0).cast("long")).otherwise(base + F.aggregate(steps, start, step, lambda acc: acc["d"]))


def hilbert_number(z: int, x: int, y: int) -> int:
    """The same for one tile, on the driver."""
    d, side = 0, 1 << z
    for i in reversed(range(z)):
        rx, ry = x >> i & 1, y >> i & 1
        d += (3 * rx ^ ry) << 2 * i
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return (4**z - 1) // 3 + d


def hilbert_tile(number: int) -> tuple[int, int, int]:
    """(z, x, y) of a number on the curve."""
    z = 0
    while (4 ** (z + 1) - 1) // 3 <= number:
        z += 1
    rest, x, y = number - (4**z - 1) // 3, 0, 0
    for i in range(z):
        rx, ry = rest >> 1 & 1, (rest ^ rest >> 1) & 1
        if not ry:
            if rx:
                x, y = (1 << i) - 1 - x, (1 << i) - 1 - y
            x, y = y, x
        x, y, rest = x + (rx << i), y + (ry << i), rest >> 2
    return z, x, y


def hilbert_tiles(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zooms, columns and rows of numbers on the curve."""
    numbers = np.asarray(numbers, np.int64)
    first = np.array([(4**z - 1) // 3 for z in range(32)], np.int64)  # of each zoom
    z = np.searchsorted(first, numbers, "right") - 1
    rest = numbers - first[z]
    x, y = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for i in range(int(z.max(initial=0))):
        live = z > i
        rx, ry = rest >> 1 & 1, (rest ^ rest >> 1) & 1
        turn, side = live & (ry == 0), (1 << i) - 1
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - x, x), np.where(flip, side - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y, rest = x + np.where(live, rx << i, 0), y + np.where(live, ry << i, 0), np.where(live, rest >> 2, rest)
    return z, x, y


def bucket_size(low: Column, high: Column, n: int) -> Column:
    return F.ceil(F.greatest(high - low, F.lit(1)) / F.lit(float(n))).cast("long")


def bucket_index(value: Column, low: Column, high: Column, n: int) -> Column:
    """Equal-width bucket of a size, the last one open above; null without buckets or bounds."""
    if n <= 0:
        return F.lit(None).cast("long")
    own = F.least(F.floor(F.greatest(value - low, F.lit(0)) / bucket_size(low, high, n)), F.lit(n - 1)).cast("long")
    return F.when(low <= high, own)


def scrambled(x: np.ndarray) -> np.ndarray:
    """splitmix64 of uint64 numbers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def in_ratio(index: Column, total: Column, ratio: float) -> Column:
    """Whether the row number ``index`` of ``total`` is in the deterministic sample of a ratio."""
    most = np.uint64(min(int(ratio * float(_U64)), _U64))

    @F.pandas_udf("boolean")
    def chosen(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(scrambled(i.to_numpy().astype(np.uint64) ^ n.to_numpy().astype(np.uint64)) <= most)

    return chosen(index.cast("long"), total.cast("long"))


def human_bytes(size: Column) -> Column:
    shown = lambda unit: F.bround(size / float(unit), 2)
    return F.when(size >= 1 << 20, F.format_string("%.2fMB", shown(1 << 20))).when(size >= 1 << 10, F.format_string("%.2fKB", shown(1 << 10))).otherwise(F.format_string("%dB", size))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole).cast("double")


def percent_change(after: Column, before: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before).cast("double") / before * 100)


def percent_reduction(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(F.greatest(before - after, F.lit(0)).cast("double") / before * 100)


def signed(value: Column) -> Column:
    return F.format_string("%+d", value)


def padded(text: Column, width: int, left: bool = False) -> Column:
    """Padded with spaces, never cut."""
    return F.when(F.length(text) >= width, text).otherwise((F.lpad if left else F.rpad)(text, width, " "))


def vertex_count(rings: Column) -> Column:
    """Points of rings, a closing point that equals the first not counted."""
    own = lambda r: F.size(r) - ((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1))).cast("int")
    return F.aggregate(rings, F.lit(0).cast("long"), lambda acc, r: acc + own(r).cast("long"))


def parse_sample(text: str) -> tuple[str, float]:
    """("ratio", r) for 0 < r <= 1, ("count", n) for whole numbers above 1."""
    value = float(text)
    if value <= 0 or value > 1 and value != int(value):
        raise ValueError(f"not a sample: {text}")
    return ("ratio", value) if value <= 1 else ("count", int(value))


def parse_tile(text: str) -> tuple[int, int, int]:
    parts = text.split("/")
    if len(parts) != 3:
        raise ValueError("a tile is written z/x/y")
    z, x, y = map(int, parts)
    return z, x, y
