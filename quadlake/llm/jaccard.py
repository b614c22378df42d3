"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents are sets of hashed word shingles. Equal sets are one class, found by a digest; its
least document stands for it. Two sets of similarity ``PERCENT`` share one of the first
n - ceil(s * n) + 1 elements of an order that is the same for all (hashes ascending, with
elements that are common in a bounded sample last; the sample decides only the order), and
k of the first n - ceil(s * n) + k. ``shared_keys`` finds which of these elements others have,
too; only documents with k of them go on (k follows from the size, see ``least_shared``).

Tiles are the documents that hold one element, sorted by size. Within a tile, sizes must lie in
one band (ratio >= s), and the signatures (a bit for the parity of the elements hashed to it) must
leave enough overlap: at least as many elements are in only one set as bits differ. Pairs that
pass meet their texts, and the sorted arrays of all their shingles are intersected exactly.

Near copies are not expanded into all pairs. First each document is paired with a few others that
stand for the tiles of its first ``FIRST`` keys (least ids and least hashes, by partial aggregates);
the pairs that link make groups. Tiles whose documents are all of one group can tell nothing
new; in the others, pairs between different groups are tested, all of them. Tiles of over ``CHUNK``
documents are worked on in blocks of two chunks, so that no task holds a hot element's tile.

Only texts of documents in pairs that passed are shuffled: a bitmap of fixed size, broadcast,
lets few others through.

Executors collect their heaps between the steps: the many small tables that follow a large step are then
written by small processes (see ``settle``).

Sets are compared by 64-bit hashes of shingles: two sets of n and m shingles have about
n * m / 2**64 false common elements.

Defined results: null text is empty; documents without words have an empty set and link with
nothing; with fewer words than the shingle's the whole sequence is the one shingle; rows of one
id are one vertex; rows with a null id are answered with their set's size and a null class;
extra columns are kept by ``one_of_each`` and ignored by ``classes``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import bitmap, flagged, forget, parallelism, prefix_hash, settle, slices, span_hash, text_of, texts, written
from quadlake.llm.components import components
from quadlake.llm.shared import shared_keys

WORDS, PERCENT = 5, 80
#: Bounds of the sample that orders elements: documents, and the share of them that makes an element common.
SAMPLE, COMMON = 1000, 0.005
#: Signature bits: the least power of two above the set's size, within these.
LEAST_BITS, MOST_BITS = 512, 1 << 16
MOST_SHARED = 16
#: Keys by which a document first enters tiles; signature bits in later tiles; documents in a tile's chunk.
FIRST, TILE_BITS, CHUNK = 8, 2048, 4096


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    space = np.flatnonzero(data == 32)
    start, end = np.append(0, space + 1), np.append(space, len(data))
    if len(start) > words:
        start, end = start[: len(start) - words + 1], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    return np.unique(span_hash(prefix_hash(data), start, end))


def least_shared(n: int) -> int:
    """How many of its first elements a set of n elements has in common with any similar set
    of at least n elements: so many are added to the first elements, beyond the first one."""
    return max(1, min(MOST_SHARED, n // 8))


def in_order(elements: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the order that is the same for all: common elements last."""
    if not len(common):
        return elements
    late = np.isin(elements, common)
    return np.concatenate([elements[~late], elements[late]])


def prefix(elements: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first elements of a set: of two similar sets, the first ``least_shared`` common elements
    (of the smaller set's number) are in both sets' first elements."""
    n = len(elements)
    return in_order(elements, common)[: n + (-percent * n) // 100 + least_shared(n)] if n else elements


def tile_keys(shared: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
    """The keys by which a document enters tiles, from the first elements that others have too.

    It has at least k = least_shared(its least similar size) in common with any similar set;
    the first of those is not among its last k - 1 shared elements, nor among the other's."""
    k = least_shared(-(-percent * n // 100))
    return shared[: max(0, len(shared) - k + 1)]


def signature(elements: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of elements hashed to each bit, as 64-bit words."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def bits_of(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(n, 1) - 1).bit_length()))


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A signature of fewer bits. A bit's place is its hash modulo the number of bits, so
    parities of the parts add up."""
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test of two sorted sets."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return bool(n) and 100 * n >= percent * (len(a) + len(b) - n)


def common_elements(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Elements that stand in more than a share of a bounded sample, those of the least hashed ids."""
    chosen = [r.doc_id for r in docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    counts: Counter = Counter()
    if chosen:
        rows = docs.where(F.col("doc_id").isin(chosen)).select("text").mapInArrow(_element_counts(words), "element long, n long")
        counts.update({r.element: r.n for r in rows.groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") > max(2, COMMON * len(chosen))).collect()})
    return np.array(sorted(counts), np.int64).view(np.uint64)


def _element_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x, words) for x in texts(part.column("text"))]
                element, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(n)], ["element", "n"])

    return run


def _sizes(words: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x, words) for x in texts(part.column("text"))]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary())], [*names, "n_shingles", "digest"])

    return run


def _described(words: int, common: np.ndarray, percent: int) -> Callable[[bytes], tuple[np.ndarray, bytes]]:
    """Of a text the first elements of its set, and the set's size (8 bytes) with its signature."""

    def run(text: bytes) -> tuple[np.ndarray, bytes]:
        own = shingles(text, words)
        return prefix(own, common, percent), len(own).to_bytes(8, "little") + signature(own, bits_of(len(own))).tobytes()

    return run


def _entries(percent: int):
    """doc_id, rid, n, signature, keys (those by which it enters tiles) of documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, rid, extra, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "extra", "keys")), strict=True):
                n = int.from_bytes(extra[:8], "little")
                keys = tile_keys(np.frombuffer(shared, "<i8"), n, percent)
                if len(keys):
                    rows.append((doc, rid, n, extra[8:], keys))
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["doc_id", "rid", "n", "signature", "keys"])

    return run


def may_link(n: int, m: int, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sets of n and m elements with signatures x and y can be similar."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    # |a & b| <= (n + m - differing bits) / 2, and similar sets have 100 |a & b| >= percent |a | b|.
    bits = 64 * min(len(x), len(y))
    return int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum()) <= (n + m) * (100 - percent) // (100 + percent)


def _passing(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, m = (part.column(c).to_pylist() for c in ("n", "m"))
                x, y = ([np.frombuffer(w, "<u8") for w in texts(part.column(c))] for c in ("x", "y"))
                ok = [may_link(*z, percent) for z in zip(n, m, x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = entries.select("doc_id", "n", "signature")
    half = pairs.join(own, F.col("b") == F.col("doc_id")).select("a", "b", F.col("n").alias("m"), F.col("signature").alias("y"))
    rows = half.join(own, F.col("a") == F.col("doc_id")).select("a", "b", "n", "m", F.col("signature").alias("x"), "y")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _light(entries: DataFrame) -> DataFrame:
    """Documents by their first keys, with a number of the band of their size."""
    band = (F.log("n") / F.lit(-np.log(PERCENT / 100))).cast("int")
    return entries.select("doc_id", band.alias("band"), F.explode(F.slice("keys", 1, FIRST)).alias("key"))


def _roots(entries: DataFrame) -> DataFrame:
    """_k, _b, r0 to r3: the documents that stand for a tile's band, and for the whole tile."""
    roots = _light(entries).groupBy("key", "band").agg(F.count("*").alias("count"), F.min("doc_id").alias("r0"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("r1"))
    whole = roots.groupBy("key").agg(F.sum("count").alias("count"), F.min("r0").alias("r2"), F.min_by("r1", F.xxhash64("r1")).alias("r3")).where("count > 1")
    whole = whole.select(F.col("key").alias("_k"), "r2", "r3")
    return written(roots.join(whole, F.col("key") == F.col("_k")).select("_k", F.col("band").alias("_b"), "r0", "r1", "r2", "r3"), "tiles")


def _stars(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents and those that stand for their tiles. The roots are a written table, so
    both sides of the join are plain exchanges: a hot tile is then split over tasks."""
    met = _light(entries).join(roots, (F.col("key") == F.col("_k")) & (F.col("band") == F.col("_b")))
    pairs = met.select("doc_id", F.explode(F.array_distinct(F.array("r0", "r1", "r2", "r3"))).alias("root")).where("doc_id <> root")
    return pairs.select(F.least("doc_id", "root").alias("a"), F.greatest("doc_id", "root").alias("b")).distinct()


class _Tiles:
    """Blocks of tiles: documents that hold one key, in order of size, from one chunk of the tile or two."""

    def __init__(self, rows: dict[str, np.ndarray], signatures: list[bytes], percent: int):
        """Columns key, i, j (the block's chunks), chunk, doc, group, n of each entry, and its signature."""
        self.percent = percent
        order = np.lexsort((rows["doc"], rows["n"], rows["j"], rows["i"], rows["key"]))
        self.key, self.i, self.j, self.chunk, self.doc, self.group, self.n = (rows[c][order] for c in ("key", "i", "j", "chunk", "doc", "group", "n"))
        own = [np.frombuffer(signatures[k], "<u8") for k in order.tolist()]
        self.bits = np.array([64 * len(w) for w in own])
        # Signatures folded to each length, of the entries that have as many bits.
        self.levels = []
        level = LEAST_BITS
        while level <= TILE_BITS:
            have = np.flatnonzero(self.bits >= level)
            row = np.full(len(own), -1)
            row[have] = np.arange(len(have))
            if len(have):
                self.levels.append((level, row, np.stack([folded(own[k], level) for k in have.tolist()])))
            level *= 2
        new = np.ones(len(order), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(order)))

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of entries may be similar, by signatures of ascending lengths."""
        ok = np.ones(len(a), bool)
        most = (self.n[a] + self.n[b]) * (100 - self.percent) // (100 + self.percent)
        for level, row, words in self.levels:
            at = np.flatnonzero(ok & (np.minimum(self.bits[a], self.bits[b]) >= level))
            x, y = row[a[at]], row[b[at]]
            ok[at] = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= most[at]
        return ok

    def steps(self, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of a block within one size band and of different groups (and, in a block
        of two chunks, of different ones), a bounded number at a time."""
        if not len(self.begin):
            return
        differ = np.maximum.reduceat(self.group, self.begin) != np.minimum.reduceat(self.group, self.begin)
        for lo, size in zip(self.begin[differ].tolist(), self.size[differ].tolist(), strict=True):
            n, group, chunk = (x[lo : lo + size] for x in (self.n, self.group, self.chunk))
            two = self.i[lo] != self.j[lo]
            # How many of the block follow in the band of each.
            count = np.searchsorted(n * self.percent, n * 100, "right") - np.arange(size) - 1
            sums = np.concatenate([[0], np.cumsum(count)])
            at = 0
            while at < size:
                to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
                c = count[at:to]
                left = np.repeat(np.arange(at, to), c)
                right = left + 1 + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                apart = group[left] != group[right]
                if two:
                    apart &= chunk[left] != chunk[right]
                yield lo + left[apart], lo + right[apart]
                at = to

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of documents (a < b) that pass, once in a while each (tiles share pairs)."""
        for x, y in self.steps():
            ok = self.passes(x, y)
            a, b = self.doc[x[ok]], self.doc[y[ok]]
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield both[:, 0], both[:, 1]


def _grouped(entries: DataFrame, groups: DataFrame) -> DataFrame:
    grouped = entries.join(groups, F.col("doc_id") == F.col("vertex"), "left")
    return grouped.select("doc_id", F.coalesce("component", "doc_id").alias("group"), F.explode("keys").alias("key"))


def _open_tiles(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """_k, chunks: the tiles with documents of several groups, and how many chunks they are cut to."""
    several = _grouped(entries, groups).groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("count")).where("low <> high")
    return written(several.select(F.col("key").alias("_k"), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "open-tiles")


def _between_groups(entries: DataFrame, groups: DataFrame, tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents of different groups that may be similar, from all open tiles."""
    buckets = 4 * parallelism(entries.sparkSession)
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    left = _grouped(entries, groups).join(tiles, F.col("key") == F.col("_k")).select(F.col("doc_id").alias("doc"), "group", "key", chunk.alias("chunk"), "chunks")
    blocks = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("doc", "group", "key", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)).cast("int"))
    rows = blocks.join(entries.select("doc_id", "n", "signature"), F.col("doc") == F.col("doc_id")).drop("doc_id")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of at most ``TILE_BITS``."""
        names = ["bucket", "doc", "group", "key", "chunk", "i", "j", "n"]
        for batch in batches:
            words = [folded(np.frombuffer(w, "<u8"), TILE_BITS).tobytes() for w in texts(batch.column("signature"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(words, pa.binary())], [*names, "signature"])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        numbers = {c: table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "chunk", "doc", "group", "n")}
        found = list(_Tiles(numbers, table.column("signature").to_pylist(), percent).pairs())
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        both = np.unique(np.stack([a, b], 1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    kind = "bucket int, doc long, group long, key long, chunk int, i int, j int, n long, signature binary"
    found = rows.select("bucket", "doc", "group", "key", "chunk", "i", "j", "n", "signature").mapInArrow(short, kind)
    return found.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def _chosen(source: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose id is in ``ids`` (vertex, distinct). A bitmap of hashed ids goes before
    the join, so that few other texts are shuffled; its size is fixed."""
    near = flagged(source.select("doc_id", "text"), "doc_id", bitmap(ids, "vertex")).where("_flag")
    return near.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("vertex"), "left_semi").select("doc_id", "text")


def _linked(pairs: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for part in slices(batch):
                ok = []
                for a, x, y in zip(part.column("a").to_pylist(), texts(part.column("x")), texts(part.column("y")), strict=True):
                    if last != (a, x):
                        last, own = (a, x), shingles(x, words)
                    ok.append(similar(own, shingles(y, words), percent))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    own = written(_chosen(source, ids), "texts")
    half = pairs.join(own, F.col("b") == F.col("doc_id")).select("a", "b", F.col("text").alias("y"))
    rows = half.join(own, F.col("a") == F.col("doc_id")).select("a", "b", F.col("text").alias("x"), "y")
    out = written(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    forget(own)
    return out


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid (hash of the text), n_shingles, component_id (the least id that links reach) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("rid", F.xxhash64("text"))
    sizes = written(source.mapInArrow(_sizes(words, ["doc_id", "rid"]), "doc_id long, rid long, n_shingles long, digest binary"), "set-sizes")
    known = sizes.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    # Equal sets: the least id stands for them. Written first, so that both sides of the join are
    # plain exchanges: a set that very many documents have is then split over tasks.
    least = written(known.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("first")), "least-of-equal")
    same = written(known.join(least, F.col("digest") == F.col("_digest")).select(F.col("first").alias("a"), F.col("doc_id").alias("b"), "rid"), "equal-sets")
    forget(least)
    settle(docs.sparkSession)
    common = common_elements(source, words)
    told = shared_keys(source.where(F.col("doc_id").isNotNull()), _described(words, common, percent))
    stand = same.where("a = b").select(F.col("b").alias("_b"), F.col("rid").alias("_s")).distinct()
    kept = told.mapInArrow(_entries(percent), "doc_id long, rid long, n long, signature binary, keys array<bigint>")
    kept = kept.join(stand, (F.col("doc_id") == F.col("_b")) & (F.col("rid") == F.col("_s")), "left_semi").dropDuplicates(["doc_id", "rid"])
    entries = written(kept.drop("rid"), "entries")
    settle(docs.sparkSession)
    roots = _roots(entries)
    pairs = written(_passing(_stars(entries, roots), entries, percent), "star-pairs")
    links = _linked(pairs, source, words, percent)
    settle(docs.sparkSession)
    groups = components(links)
    tiles = _open_tiles(entries, groups)
    more = written(_passing(_between_groups(entries, groups, tiles, percent), entries, percent), "pairs")
    later = _linked(more, source, words, percent)
    settle(docs.sparkSession)
    found = components(links.unionByName(later).unionByName(same.where("a <> b").select("a", "b")))
    forget(same, entries, roots, pairs, links, groups, tiles, more, later)
    return sizes.join(found, F.col("doc_id") == F.col("vertex"), "left").select("doc_id", "rid", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is its class's least; rows with a null id stay."""
    gone = classes(docs.select("doc_id", "text"), words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    # Few go: a bitmap of them lets most rows pass by the join. Columns are known by their places meanwhile.
    own = [f"c{i}" for i in range(len(docs.columns))]
    gone = written(gone, "near-duplicates")
    rows = flagged(docs.toDF(*own).withColumn("_id", F.col(own[docs.columns.index("doc_id")]).cast("long")), "_id", bitmap(gone, "_gone"))
    kept = rows.where("_flag").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return rows.where("not _flag").unionByName(kept).select(*own).toDF(*docs.columns)
