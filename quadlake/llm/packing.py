"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes to the window whose
free space exceeds it least (best fit). When none fits, the fullest window is emitted:
if its gap is at least ``min_cut`` ids, the piece is cut to fill it, else the gap is left
as padding. Documents longer than a window give whole windows first.
At the end the open windows of a few partitions each meet in one group, are packed again
in the same way, and what is open then is laid end to end, cut into full windows, and its
rest into sequences whose lengths are powers of two, which need no padding.

Which partitions' leftovers meet depends on their numbers alone, so no group grows with
the input. The packed pieces are written to the scratch folder before leftovers are merged.

Defined results: null text is empty and packs as the one end id; repeated rows and null
ids are packed each; no input rows give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import slices, text_of, texts, written
from quadlake.llm.tokens import vocabulary, word_cache

WINDOW, OPEN, MIN_CUT, END, GROUP = 4096, 16, 16, 2, 8
#: Sequence numbers: the partition or the merging group above, a running number below.
SHIFT, MERGED = 32, 1 << 30

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")] + [("ids", pa.binary())])


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, number: int, window: int = WINDOW, most: int = OPEN, min_cut: int = MIN_CUT):
        self.window, self.most, self.min_cut = window, most, min_cut
        self.next, self.open, self.done = number << SHIFT, [], []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, -1, None))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits:
                best = min(fits, key=lambda w: w[0])
                best[0] -= len(ids)
                best[1].append((doc, start, ids, total))
                if not best[0]:
                    self.open.remove(best)
                    self.emit(best[1])
                return
            if len(self.open) < self.most:
                self.open.append([self.window - len(ids), [(doc, start, ids, total)]])
                return
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = fullest[0]
            if gap >= self.min_cut:
                fullest[1].append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.emit(fullest[1])

    def leftovers(self) -> list[tuple]:
        return [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]

    def close(self) -> None:
        """Lay what is open end to end: full windows, then powers of two."""
        rest, self.open = self.leftovers(), []
        total = sum(len(p[2]) for p in rest)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in reversed(range(self.window.bit_length())) if (total % self.window) >> b & 1]
        held: list[tuple] = []
        for doc, start, ids, n in rest:
            while len(ids):
                take = min(len(ids), sizes[0] - sum(len(h[2]) for h in held))
                held.append((doc, start, ids[:take], n))
                start, ids = start + take, ids[take:]
                if sum(len(h[2]) for h in held) == sizes[0]:
                    self.emit(held)
                    held = []
                    sizes.pop(0)

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else pa.RecordBatch.from_pylist([], _ARROW)


def _pack(path: str, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        cache, packer = word_cache(path), Packer(number, window, most)
        for batch in batches:
            for part in slices(batch, 256):
                values = [x.decode("utf-8", "replace") for x in texts(part.column("text"))]
                for doc, ids in zip(part.column("doc_id").to_pylist(), cache.batch(values), strict=True):
                    ids = np.append(ids.astype("<u4"), np.array([END], "<u4"))
                    packer.add(doc, 0, ids, len(ids))
                if len(packer.done) >= 4096:
                    yield packer.take()
        packer.done += [(doc, start, len(ids), 0, total, -1, -1, number, ids.tobytes()) for doc, start, ids, total in packer.leftovers()]
        yield packer.take()

    return run


def _merge(window: int, most: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        packer = Packer(MERGED + key[0].as_py(), window, most)
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        for row in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
        packer.close()
        return pa.Table.from_batches([packer.take()])

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` must be a power of two. ``most`` is the number of open windows a partition keeps.
    """
    path = path or vocabulary()
    source = docs.select("doc_id", text_of().alias("text"))
    first = written(source.mapInArrow(_pack(path, window, most), PIECES), "packed")
    left = first.where("part >= 0").withColumn("group", F.expr(f"part div {GROUP}"))
    merged = left.groupBy("group").applyInArrow(_merge(window, most), PIECES)
    return first.where("part < 0").unionByName(merged).drop("part", "ids")
