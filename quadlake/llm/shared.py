"""Which keys of each document other documents have, too.

Every document gives an array of 64-bit keys (a function of its text alone). Tasks gather
keys of many documents to a run; each distinct key of a run is sent once, in packed arrays by
bucket of the key, so a key that a third of all documents hold costs no bucket more than
one entry for each run. A bucket answers every run with the entries whose key other runs
hold as well; what a run's documents share among themselves, the run itself knows. The
answers meet the run's table of documents, which gives a bit for each key of each document
(``shared_bits``), or the keys themselves (``shared_keys``).

Nothing is dropped: a bit is set for every key that stands in two documents (rarely for one
that does not, when two keys of a bucket agree in their upper 32 bits: in some six of 100,000 keys). Runs hold at most ``RUN`` keys, or one document.
The number of buckets follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import bytewise, parallelism, slices, squeezed, texts, tidy, unsqueezed, whole

RUN = 1_000_000
_PACKED = "bucket int, run long, data binary"
_NAMES = ["bucket", "run", "data"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], _NAMES)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by bucket (stable), and (bucket, begin, end) in it."""
    own = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # short numbers are sorted by their digits
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(buckets + 1))
    return order, [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def alike(keys: np.ndarray) -> np.ndarray:
    """An order in which equal keys stand together, by their places (but for a few that others, equal in their upper
    bits, may stand between). Keys are sorted with their places in their lower bits, which is much quicker than by an order."""
    mask = np.uint64((1 << max(1, (len(keys) - 1).bit_length())) - 1)
    return (np.sort((keys & ~mask) | np.arange(len(keys), dtype=np.uint64)) & mask).astype(np.int64)


class _Run:
    """Documents (doc_id, rid), their keys, and what else is to be told of each (bytes)."""

    def __init__(self, number: int):
        self.number, self.docs, self.keys, self.extra, self.n = number, [], [], [], 0

    def add(self, doc: int, rid: int, keys: np.ndarray, extra: bytes) -> None:
        self.docs.append((doc, rid)), self.keys.append(keys), self.extra.append(extra)
        self.n += len(keys)

    def rows(self, buckets: int, told: bool) -> list[tuple]:
        """The run's table, to the bucket -1, and its entries by bucket. ``told``: the table has the
        known keys and the documents' extra bytes, too."""
        counts = np.array([len(k) for k in self.keys], np.int64)
        table = np.array(self.docs, np.int64).reshape(-1, 2)
        keys = np.concatenate(self.keys)
        doc = np.repeat(np.arange(len(counts)), counts)
        order = alike(keys)
        k, d = keys[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(start, len(k)))
        in_two = d[start] != d[start + size - 1]  # in two documents of this run
        known, first, several = (np.zeros(len(keys), bool) for _ in range(3))
        known[order] = np.repeat(in_two, size)
        first[order[start]], several[order[start]] = True, in_two
        entry = np.flatnonzero(first)
        key, several = keys[entry], several[entry]
        head = [np.concatenate([[len(counts)], table.ravel(), counts]).astype("<i8").tobytes(), np.packbits(known).tobytes()]
        if told:
            head += [keys[known].astype("<u8").tobytes(), np.array(list(map(len, self.extra)), "<i4").tobytes(), *self.extra]
        out = [(-1, b"".join(head))]
        where, parts = by_bucket(key, buckets)
        for b, lo, hi in parts:
            at = where[lo:hi]  # in order of places
            steps = np.diff(entry[at], prepend=0)
            wide = steps.max() > 0xFFFF
            own = (key[at] >> np.uint64(32)).astype("<u4")
            head = np.array([len(at), wide], "<i8").tobytes()
            out.append((b, head + own.tobytes() + np.packbits(several[at]).tobytes() + squeezed(bytewise(steps, "<u4" if wide else "<u2"))))
        return out


def _gather(keys_of: Callable[[bytes], np.ndarray | tuple[np.ndarray, bytes]], buckets: int, told: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        now = _Run(number)

        def full():
            nonlocal now, number
            own, number = now, number + 1
            now = _Run(number)
            # The run's own table goes to a bucket by its number.
            return batch_of([(own.number % buckets if b < 0 else b, own.number if b < 0 else ~own.number, data) for b, data in own.rows(buckets, told)])

        for batch in batches:
            for part in slices(batch):
                for doc, rid, text in zip(part.column("doc_id").to_pylist(), part.column("rid").to_pylist(), texts(part.column("text")), strict=True):
                    keys, extra = keys_of(text) if told else (keys_of(text), b"")
                    if len(keys):
                        now.add(doc, rid, keys, extra)
                    if now.n >= RUN:
                        yield full()
        if now.docs:
            yield full()

    return run


def _match(key: tuple[pa.Scalar, ...], table: pa.Table, told: int = 0) -> pa.Table:
    """One bucket: the entries of each run whose keys other runs hold (``told``, the number of buckets: and those
    keys' ``short`` numbers); the runs' tables pass."""
    out, keys, entries, several, runs = [], [], [], [], []
    for run, data in zip(table.column("run").to_pylist(), table.column("data").to_pylist(), strict=True):
        if run >= 0:
            out.append((0, run, data))
            continue
        n, wide = np.frombuffer(data, "<i8", 2).tolist()
        at = 16 + 4 * n
        keys.append(np.frombuffer(data, "<u4", n, 16))
        several.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
        entries.append(np.cumsum(whole(unsqueezed(data[at + -(-n // 8) :]), n, 0, "<u4" if wide else "<u2").astype(np.int64)))
        runs.append(np.full(n, ~run, np.int64))
    if keys:
        k, e, s, r = map(np.concatenate, (keys, entries, several, runs))
        order = np.argsort(k, kind="stable")
        kept, k = k, k[order]
        same = k[1:] == k[:-1]
        shared = (np.append(same, False) | np.append(False, same)) & ~s[order]  # what a run knows is not told again
        own = order[shared]
        own = own[np.lexsort((e[own], r[own]))]
        cuts = np.flatnonzero(np.diff(r[own])) + 1
        for part in np.split(own, cuts) if len(own) else []:
            own_keys = (kept[part].astype("<u8") * np.uint64(told) + np.uint64(key[0].as_py())).tobytes() if told else b""
            out.append((1, int(r[part[0]]), e[part].astype("<u4").tobytes() + own_keys))
    tidy()
    return pa.Table.from_batches([batch_of(out)])


_BITS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("bits", pa.binary())])


def _answers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One run: its table of documents and the buckets' answers, to bits by document."""
    docs = counts = known = None
    entries = []
    for kind, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind:
            entries.append(np.frombuffer(data, "<u4"))
        else:
            n = int(np.frombuffer(data, "<i8", 1)[0])
            docs = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
            counts = np.frombuffer(data, "<i8", n, 8 + 16 * n)
            known = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 24 * n), count=int(counts.sum()))
    if entries:
        known[np.concatenate(entries)] = 1
    ends = np.cumsum(counts)
    some = np.flatnonzero(np.add.reduceat(known, ends - counts, dtype=np.int64))
    bits = [np.packbits(known[ends[i] - counts[i] : ends[i]]).tobytes() for i in some]
    return pa.Table.from_arrays([pa.array(docs[some, 0]), pa.array(docs[some, 1]), pa.array(bits, pa.binary())], schema=_BITS)


def shared_bits(docs: DataFrame, keys_of: Callable[[bytes], np.ndarray]) -> DataFrame:
    """doc_id, rid, bits (arrays of packed bits, one for each equal row): of every document
    (doc_id, rid, text) the keys, in the order of ``keys_of(text)``, that others have."""
    buckets = 4 * parallelism(docs.sparkSession)
    packed = docs.select("doc_id", "rid", "text").mapInArrow(_gather(keys_of, buckets), _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(lambda key, table: _match(key, table), _PACKED)
    found = answers.groupBy("run").applyInArrow(_answers, "doc_id long, rid long, bits binary")
    return found.groupBy("doc_id", "rid").agg(F.collect_list("bits").alias("bits"))


_TOLD = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("extra", pa.binary()), ("keys", pa.binary())])


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers of keys by what a bucket knows of them: their upper 32 bits, and the bucket."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) + keys % np.uint64(buckets)


def _told(table: pa.Table, buckets: int) -> pa.Table:
    """One run: of each of its documents the shared keys' ``short`` numbers, in their order."""
    known, entries, at = None, [], 0
    for kind, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind:
            n = len(data) // 12
            entries.append((np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u8", n, 4 * n)))
        else:
            n = int(np.frombuffer(data, "<i8", 1)[0])
            docs = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2)
            counts = np.frombuffer(data, "<i8", n, 8 + 16 * n)
            at = 8 + 24 * n
            known = np.unpackbits(np.frombuffer(data, np.uint8, -(-int(counts.sum()) // 8), at), count=int(counts.sum())).astype(bool)
            at += -(-len(known) // 8)
            keys = np.zeros(len(known), np.uint64)
            keys[known] = short(np.frombuffer(data, "<u8", int(known.sum()), at), buckets)
            at += 8 * int(known.sum())
            sizes = np.frombuffer(data, "<i4", n, at)
            cuts = at + 4 * n + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            extra = data
    for place, own in entries:
        known[place], keys[place] = True, own
    ends = np.cumsum(counts)
    some = np.flatnonzero(np.add.reduceat(known, ends - counts, dtype=np.int64)).tolist()
    shared = [keys[a:b][known[a:b]].tobytes() for a, b in ((ends[i] - counts[i], ends[i]) for i in some)]
    return pa.Table.from_arrays([pa.array(docs[some, 0]), pa.array(docs[some, 1]), pa.array([extra[cuts[i] : cuts[i + 1]] for i in some], pa.binary()), pa.array(shared, pa.binary())], schema=_TOLD)


def shared_keys(docs: DataFrame, keys_of: Callable[[bytes], tuple[np.ndarray, bytes]]) -> DataFrame:
    """doc_id, rid, extra, keys: of every document (doc_id, rid, text) that has some, ``short`` numbers
    of the keys that others have, in the order of ``keys_of(text)[0]``, whose
    keys are distinct; and ``extra``, its second value. One row for each equal row."""
    buckets = 4 * parallelism(docs.sparkSession)
    packed = docs.select("doc_id", "rid", "text").mapInArrow(_gather(keys_of, buckets, True), _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(lambda key, table: _match(key, table, buckets), _PACKED)
    return answers.groupBy("run").applyInArrow(lambda table: _told(table, buckets), "doc_id long, rid long, extra binary, keys binary")


def marked(keys: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which keys of a document are shared, by all its bits. A key that stands twice in one
    document is marked at each place."""
    on = np.zeros(len(keys), bool)
    for b in bits:
        on |= np.unpackbits(np.frombuffer(b, np.uint8), count=len(keys)).astype(bool)
    return np.isin(keys, keys[on])
