"""Suffix-array dedup over a run-length index.

Removed is every byte that lies in a string of ``LENGTH`` bytes which also starts in a
document with a smaller id.

1. Each window of ``LENGTH`` bytes chooses one of its ``GRAM``-byte grams (the last one of
   least hash), so equal windows choose equal grams. Grams that only one document chose
   cannot stand in a shared window; ``shared_bits`` finds the others.
2. The context of a chosen gram is the bytes of the consecutive windows that chose it. Equal
   contexts of a run of documents are met at once: all but those of the least id are
   covered wholly. The others are sent to the bucket of their gram, where the same is done.
3. Contexts of one gram that differ may share windows. Their ids are halved again and again; the
   contexts of the lower halves are indexed, those of the upper halves streamed through the index, so that any two
   ids meet once. The index is a run-length index: the Burrows-Wheeler transform as runs, with suffix
   positions sampled at both ends of each. Streaming a context backwards gives its matching
   statistics: a step within a run lengthens the match; else the nearest runs of the character are tried,
   whose end samples tell where the match goes on and how much of it remains. A
   match of at least ``LENGTH`` bytes is marked.
4. Spans meet their documents by a join, and are cut out. Documents without spans pass by it.

Contexts are equal if their 64-bit hashes are, and documents are told apart by id and the 64-bit hash of the text.

Defined results: null text is empty; matches never cross documents; rows with one id never
remove each other's bytes; repeated rows are answered each; rows with a null id neither remove nor
lose bytes. Extra columns of any name are kept by ``dedup`` (own columns of the names it adds are replaced).
Input must be a table that reads alike each time, as written tables do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import bitmap, bytewise, flagged, forget, parallelism, prefix_hash, slices, span_hash, texts, tidy, whole, window_hash, written
from quadlake.llm.shared import by_bucket, marked, shared_bits

LENGTH, GRAM = 50, 20
#: Bytes of contexts that a task holds before it sends them.
HELD = 16 << 20
#: Lower bits of a number that hold a place in a text (Spark's are below 2**31 bytes).
_PLACE = np.uint64((1 << 31) - 1)


def chosen(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the chosen grams in order of their places; those places; the first and last window start that
    chose each; and prefix sums for hashes of spans. Empty for texts of less than LENGTH bytes."""
    n, width = len(text) - LENGTH + 1, LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(1, np.uint64)
    data = np.frombuffer(text, np.uint8)
    sums = prefix_hash(data)
    h = window_hash(sums, GRAM)
    # The last place of the least hash among ``width`` grams, by doubling: hashes by their upper bits, places in their lower ones.
    least, have = (h | _PLACE) - np.arange(len(h), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    where = (_PLACE - (least[new] & _PLACE)).astype(np.int64)
    return h[where], where, new, np.append(new[1:], n) - 1, sums


def gram_keys(text: bytes) -> np.ndarray:
    return chosen(text)[0]


#: Symbols that are packed to one number for the first ranks; ranks of 3, 6, 12, ... symbols follow.
WORD = 3


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of contexts, with suffix positions sampled at both ends
    of its runs, and matching statistics of patterns.

    Each context belongs to a group (ascending in the row of contexts), and matches stay within a group:
    its symbols are its own. Suffixes that are equal up to their ends stand in order of their places.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        """Contexts laid in a row (bytes), their sizes and groups."""
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        symbol = np.zeros(n, np.int64)  # bytes + 1; 0 ends a context
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = data.astype(np.int64) + 1
        group = np.repeat(np.asarray(groups, np.int64), sizes + 1)
        self.left = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols before the end
        word = np.zeros(n, np.int64)
        for k in range(WORD):
            part = np.zeros(n, np.int64)
            part[: max(0, n - k)] = symbol[k:]
            word |= np.where(self.left > k, part, 0) << (9 * (WORD - 1 - k))
        self.word = word
        order, rank = self._dense((group << 9 * WORD) + word)
        self.ranks, h, most = [(WORD, rank)], WORD, int(sizes.max())
        while h < most:  # ranks by twice as many symbols
            after = np.zeros(n, np.int64)
            more = np.flatnonzero(self.left > h)
            after[more] = rank[more + h] + 1
            order, rank = self._dense(rank * (n + 1) + after)
            h *= 2
            self.ranks.append((h, rank))
        code = group * 257 + symbol
        before = np.where(np.concatenate([[0], symbol[:-1]]) > 0, np.concatenate([[0], code[:-1]]), -1)[order]
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        last = np.append(head[1:], n) - 1
        first = code[order]
        self.rows = n
        self.group_row = np.searchsorted(first, np.arange(int(group[-1]) + 2) * 257)
        # Runs by their character, then by their rows.
        by = np.sort(before[head] * len(head) + np.arange(len(head))) % len(head)
        by = by[np.searchsorted(before[head][by], 0) :]
        self.code, self.head, self.size = before[head][by], head[by], (last - head + 1)[by]
        self.key = self.code * n + self.head
        new = np.concatenate([[True], self.code[1:] != self.code[:-1]])[: len(by)]
        total = np.cumsum(self.size) - self.size
        self.target = np.searchsorted(first, self.code) + total - np.repeat(total[new], np.diff(np.append(np.flatnonzero(new), len(by))))
        self.sample_first, self.sample_last = order[self.head], order[self.head + self.size - 1]
        self.group_sample = order[np.minimum(self.group_row, n - 1)]

    @staticmethod
    def _dense(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of numbers, equal ones by their places, and their ranks. Numbers are sorted with their
        places in their lower digits, which is much quicker than by an order."""
        n = len(x)
        if int(x.max()) < (1 << 62) // n:
            packed = np.sort(x * n + np.arange(n))
            y = packed // n
            order = packed - y * n
        else:
            order = np.argsort(x, kind="stable")
            y = x[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.concatenate([[0], (y[1:] != y[:-1]).astype(np.int64)]))
        return order, out

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at places a and b have in common, at most ``most``."""
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        a, b, n = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for h, rank in reversed(self.ranks):
            same = (rank[a] == rank[b]) & (n < most)
            n += h * same
            np.minimum(a + h * same, self.rows - 1, out=a), np.minimum(b + h * same, self.rows - 1, out=b)
        differ = self.word[a] ^ self.word[b]
        lead = WORD - -(-_bit_length(differ) // 9)
        return np.minimum(n + lead, most)

    def statistics(self, data: np.ndarray, sizes: np.ndarray, groups: np.ndarray, least: int = 0) -> np.ndarray:
        """Matching statistics: of each place of the patterns laid in a row, the length of the longest string
        that begins there and stands in a context of the pattern's group. A pattern may be left, with 0 at its other
        places, as soon as no match of ``least`` symbols can begin at them."""
        data = data.astype(np.int64) + 1
        ends = np.cumsum(sizes)
        out = np.zeros(len(data), np.int64)
        which = np.argsort(-sizes, kind="stable")
        g = np.asarray(groups, np.int64)[which]
        at, rest = ends[which] - 1, sizes[which]
        row, place, length = self.group_row[g], self.group_sample[g], np.zeros(len(which), np.int64)
        for step in range(int(sizes.max())):
            live = int(np.searchsorted(-rest, -step, "left"))  # patterns with more than ``step`` characters
            g, at, row, place, length, rest = (x[:live] for x in (g, at, row, place, length, rest))
            able = length + rest >= least + step
            if 8 * np.count_nonzero(able) < 7 * live:
                g, at, row, place, length, rest = (x[able] for x in (g, at, row, place, length, rest))
            if not len(at):
                break
            code = g * 257 + data[at]
            k = np.searchsorted(self.key, code * self.rows + row, "right")
            prev, next_ = np.maximum(k - 1, 0), np.minimum(k, len(self.key) - 1)
            stay = (self.code[prev] == code) & (row < self.head[prev] + self.size[prev]) & (k > 0)
            new_row, new_length = self.target[prev] + row - self.head[prev], length + 1
            new_place = place - 1
            # Jumps to the nearest runs of the character: their ends' samples tell what remains of the match.
            away = np.flatnonzero(~stay)
            if len(away):
                c, most = code[away], length[away]
                p, n = prev[away], next_[away]
                up = np.where((k[away] > 0) & (self.code[p] == c), 0, -1)
                down = np.where((k[away] < len(self.key)) & (self.code[n] == c), 0, -1)
                far = np.flatnonzero((up == 0) & (most > 0))
                up[far] = self.common(place[away[far]], self.sample_last[p[far]], most[far])
                far = np.flatnonzero((down == 0) & (most > np.maximum(up, 0)))  # else it cannot be better
                down[far] = self.common(place[away[far]], self.sample_first[n[far]], most[far])
                back = (up >= 0) & (up >= down)
                best = np.maximum(up, down)
                none = best < 0
                group = g[away]
                new_row[away] = np.where(none, self.group_row[group], np.where(back, self.target[p] + self.size[p] - 1, self.target[n]))
                new_place[away] = np.where(none, self.group_sample[group], np.where(back, self.sample_last[p], self.sample_first[n]) - 1)
                new_length[away] = best + 1
            out[at] = new_length
            at, row, place, length = at - 1, new_row, new_place, new_length
        return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**63."""
    high = x >> 32
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((x & 0xFFFFFFFF).astype(np.float64))[1]).astype(np.int64)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans laid in a row."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def covered(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, groups: np.ndarray, ids: np.ndarray, length: int = LENGTH, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``data`` of contexts (begin, sizes): whether a string of ``length`` bytes
    begins there that also stands in a context of its group with a smaller id; for the contexts laid in a row.

    A group's ids are halved again and again: the contexts of a lower half are indexed, those of the
    upper half are streamed through the index. Any two ids are apart at one level. About ``most`` bytes
    are indexed and streamed at a time.
    """
    row = np.cumsum(sizes) - sizes
    found = np.zeros(int(sizes.sum()), bool)
    order = np.lexsort((ids, groups))
    g, d = groups[order], ids[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    step = np.cumsum(new | np.concatenate([[True], d[1:] != d[:-1]]))
    rank = step - np.maximum.accumulate(np.where(new, step, 0))  # of ids in their group; equal ids, equal ranks
    number = np.cumsum(new) - 1
    for level in range(int(rank.max(initial=0)).bit_length()):
        half, upper = rank >> (level + 1), (rank >> level) & 1
        block = np.cumsum(np.concatenate([[0], ((number[1:] != number[:-1]) | (half[1:] != half[:-1])).astype(np.int64)]))
        top = np.zeros(int(block[-1]) + 1, bool)
        top[block[upper == 1]] = True
        low, high = np.flatnonzero(top[block] & (upper == 0)), np.flatnonzero(upper == 1)
        # Lower halves are indexed in parts; the contexts of their blocks' upper halves are streamed through each.
        cuts = np.concatenate([[0], np.cumsum(sizes[order[low]] + 1)])
        at = 0
        while at < len(low):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
            part, at = low[at:to], to
            first = block[part[0]]
            own = order[part]
            index = RunLengthIndex(data[spread(begin[own], sizes[own])], sizes[own], block[part] - first)
            lo, hi = np.searchsorted(block[high], [first, block[part[-1]] + 1])
            share = np.cumsum(sizes[order[high[lo:hi]]]) // most
            for streamed in np.split(high[lo:hi], np.flatnonzero(np.diff(share)) + 1):
                which = order[streamed]
                hit = index.statistics(data[spread(begin[which], sizes[which])], sizes[which], block[streamed] - first, length) >= length
                found[spread(row[which], sizes[which])] |= hit
    return found, row


def hashes(data: np.ndarray, begin: np.ndarray, gram: np.ndarray, sizes: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts laid in a row, whose grams begin ``gram`` bytes on: hashes of the grams, of the contexts, and (two rows) of the
    grams with half of a window's other bytes before them or behind them, as far as the context has them. About
    ``most`` bytes at a time."""
    half = (LENGTH - GRAM) // 2
    out = np.zeros((4, len(begin)), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(data), most)), len(begin)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        base, z = begin[lo], sizes[lo:hi]
        a = begin[lo:hi] - base
        at, z = a + gram[lo:hi], a + z
        sums = prefix_hash(data[base : base + z[-1]])
        for row, start, end in zip(out, (at, a, np.maximum(a, at - half), at), (at + GRAM, z, at + GRAM, np.minimum(z, at + GRAM + half)), strict=True):
            row[lo:hi] = span_hash(sums, start, end)
    return out[0], out[1], out[2:]


def akin(halves: np.ndarray, gram: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which contexts can share a window with a context of another id. Equal windows hold their gram at one place, so
    they share half of their other bytes before it or half behind it (``halves``, as ``hashes`` gives them);
    contexts that share neither half need no index."""
    half = (LENGTH - GRAM) // 2
    out = np.zeros(len(ids), bool)
    for h, has in zip(halves, (gram >= half, sizes - gram >= GRAM + half), strict=True):
        at = np.flatnonzero(has)
        if len(at):
            order = at[np.argsort(h[at])]
            x, d = h[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            apart = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
            out[order[np.repeat(apart, np.diff(np.append(first, len(x))))]] = True
    return out


_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(ids: np.ndarray, rids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, grams: np.ndarray, body: bytes) -> bytes:
    """Columns of contexts in order of ids and rids: a table of documents, then starts, sizes, places of the grams, bytes."""
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1])]))
    counts = np.diff(np.append(first, len(ids)))
    data = b"".join([bytewise(np.diff(ids[first], prepend=0), "<i8"), rids[first].astype("<i8").tobytes(), bytewise(counts, "<u4"), bytewise(starts, "<u4"), sizes.astype("<u1").tobytes(), grams.astype("<u1").tobytes(), body])
    return np.array([len(first), len(ids), len(data)], "<i8").tobytes() + _ZSTD.compress(data, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, n, size = np.frombuffer(data, "<i8", 3).tolist()
    raw = _ZSTD.decompress(data[24:], size, asbytes=True)
    counts = whole(raw, m, 16 * m, "<u4").astype(np.int64)
    ids, rids = np.repeat(np.cumsum(whole(raw, m, 0, "<i8")), counts), np.repeat(np.frombuffer(raw, "<i8", m, 8 * m), counts)
    at = 20 * m
    return ids, rids, whole(raw, n, at, "<u4").astype(np.int64), np.frombuffer(raw, "<u1", n, at + 4 * n).astype(np.int64), np.frombuffer(raw, "<u1", n, at + 5 * n).astype(np.int64), np.frombuffer(raw, "<u1", offset=at + 6 * n)


_PART = "bucket int, doc_id long, rid long, data binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("spans", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "doc_id", "rid", "data"])


def _contexts(buckets: int):
    """Contexts of shared grams, as packed arrays by bucket of the gram; and spans of contexts
    that a smaller id of the same run of documents has, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        number = TaskContext.get().partitionId() << 24

        def full():
            nonlocal held, size, number
            table, key, hashed, start, end, gram, doc = held, *(np.concatenate(x) for x in zip(*((*h[3:], np.full(len(h[3]), i)) for i, h in enumerate(held)), strict=True))
            ids, rids = (np.array([h[c] for h in table], np.int64) for c in (0, 1))
            held, size, number = [], 0, number + 1
            order = np.lexsort((ids[doc], hashed, key))
            k, x, d = key[order], hashed[order], ids[doc[order]]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])]))
            least = np.repeat(d[first], np.diff(np.append(first, len(k))))
            out = []
            covered_ = order[d > least]
            covered_ = covered_[np.argsort(doc[covered_], kind="stable")]
            for part in np.split(covered_, np.flatnonzero(np.diff(doc[covered_])) + 1) if len(covered_) else []:
                h = table[doc[part[0]]]
                out.append(((number + len(out)) % buckets, h[0], h[1], np.stack([start[part], end[part]], 1).astype("<i8").tobytes()))
            # One of each (context, id) goes on; its other places in the same document follow it.
            rest = order[d == least]
            where, parts = by_bucket(key[rest], buckets)
            for b, lo, hi in parts:
                at = rest[where[lo:hi]]
                at = at[np.lexsort((start[at], rids[doc[at]], ids[doc[at]]))]
                body = b"".join([table[i][2][s:e] for i, s, e in zip(doc[at].tolist(), start[at].tolist(), end[at].tolist(), strict=True)])
                out.append((b, None, None, _pack(ids[doc[at]], rids[doc[at]], start[at], end[at] - start[at], gram[at] - start[at], body)))
            return _rows(out)

        for batch in batches:
            for part in slices(batch):
                for doc, rid, bits, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "rid", "bits")), texts(part.column("text")), strict=True):
                    keys, place, first, last, sums = chosen(text)
                    on = np.flatnonzero(marked(keys, bits))
                    a, b = first[on], last[on] + LENGTH
                    held.append((doc, rid, text, keys[on], span_hash(sums, a, b), a, b, place[on]))
                    size += int((b - a).sum()) + len(text)
                    if size >= HELD:
                        yield full()
        if held:
            yield full()

    return run


def _resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket: spans of its contexts that smaller ids cover; ready spans pass."""
    out_doc, out_rid, out, packs = [], [], [], []
    for doc, rid, data in zip(table.column("doc_id").to_pylist(), table.column("rid").to_pylist(), table.column("data").to_pylist(), strict=True):
        if doc is None:
            packs.append(_unpack(data))
        else:
            out_doc.append(doc), out_rid.append(rid), out.append(data)
    if packs:
        d, r, s, z, gram, data = map(np.concatenate, zip(*packs, strict=True))
        packs.clear()
        begin = np.cumsum(z) - z
        keys, equal, halves = hashes(data, begin, gram, z)
        # Equal contexts of a gram: all but those of the least id are covered.
        order = np.lexsort((d, equal, keys))
        k, x = keys[order], equal[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new = new_key | np.concatenate([[True], x[1:] != x[:-1]])
        head = np.flatnonzero(new)
        text = np.cumsum(new) - 1
        least = d[order[head]]
        later = order[d[order] > least[text]]
        row, a, b = [later], [s[later]], [s[later] + z[later]]
        # Grams with several texts: a text's windows may stand in another's.
        number = np.cumsum(new_key) - 1
        group = number[head]
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        own = order[head[several]]
        several = several[akin(halves[:, own], gram[own], z[own], least[several])]
        if len(several):
            first = order[head[several]]
            hits, laid = covered(data, begin[first], z[first], group[several], least[several])
            # Runs of places where matches start, in the row of texts; matches end within their text.
            edge = np.diff(np.concatenate([[0], hits.astype(np.int8), [0]]))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            of = np.searchsorted(laid, lo, "right") - 1
            # Every context of the least id of a text gets the text's runs.
            place = np.full(len(head), -1)
            place[several] = np.arange(len(several))
            p = place[text]
            own = np.flatnonzero((p >= 0) & (d[order] == least[text]))
            p = p[own]
            left, right = np.searchsorted(of, p, "left"), np.searchsorted(of, p, "right")
            n = right - left
            take, own = spread(left, n), np.repeat(order[own], n)
            base = s[own] - np.repeat(laid[p], n)
            row.append(own), a.append(base + lo[take]), b.append(base + hi[take] - 1 + LENGTH)
        row, a, b = map(np.concatenate, (row, a, b))
        order = np.lexsort((a, r[row], d[row]))
        row, a, b = row[order], a[order], b[order]
        cuts = np.flatnonzero((np.diff(d[row]) != 0) | (np.diff(r[row]) != 0)) + 1
        spans = np.stack([a, b], 1).astype("<i8")
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
            if lo < hi:
                out_doc.append(int(d[row[lo]])), out_rid.append(int(r[row[lo]])), out.append(spans[lo:hi].tobytes())
    tidy()
    return pa.Table.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_rid, pa.int64()), pa.array(out, pa.binary())], schema=_SPANS)


def merged(spans: list[bytes]) -> np.ndarray:
    """Maximal spans of a union of spans, in order."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    s = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return np.stack([s[new, 0], end[last]], 1)


def of_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of UTF-8 text, widened to the characters that they touch; in order, and they may meet."""
    out = spans.copy()
    if len(out):
        inside = np.append((np.frombuffer(text, np.uint8) & 0xC0) == 0x80, False)  # of a character, after its first byte
        inside[0] = False
        for _ in range(3):
            out[:, 0] -= inside[out[:, 0]]
            out[:, 1] += inside[out[:, 1]]
    return out


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    at = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, rid, spans (arrays of packed spans) of the documents (doc_id, rid, text) that lose bytes."""
    buckets = 4 * parallelism(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull())
    table = written(shared_bits(known, gram_keys), "gram-bits")
    bits = table.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "bits")
    some = flagged(known, "doc_id", bitmap(bits, "_d")).where("_flag")
    found = some.join(bits, (F.col("doc_id") == F.col("_d")) & (F.col("rid") == F.col("_r"))).select("doc_id", "rid", "bits", "text").mapInArrow(_contexts(buckets), _PART)
    spans = found.groupBy("bucket").applyInArrow(_resolve, "doc_id long, rid long, spans binary")
    out = written(spans.groupBy("doc_id", "rid").agg(F.collect_list("spans").alias("spans")), "spans")
    forget(table)
    return out


def dedup(docs: DataFrame, characters: bool = False) -> DataFrame:
    """``docs`` with columns n_bytes, n_removed, n_spans and kept (the remaining bytes; with ``characters`` those of
    characters that lose no byte)."""
    more = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*more)
    # Columns are known by their places in here, so that their names cannot clash.
    own = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    source = docs.toDF(*own).withColumn(text, F.coalesce(text, F.lit(""))).withColumn("rid", F.xxhash64(text))
    spans = spans_of(source.select(F.col(doc).cast("long").alias("doc_id"), "rid", F.col(text).alias("text"))).withColumnsRenamed({"doc_id": "_d", "rid": "_r"})
    marked_ = flagged(source.withColumn("doc", F.col(doc).cast("long")), "doc", bitmap(spans, "_d"))
    near = marked_.where("_flag").join(spans, (F.col("doc") == F.col("_d")) & (F.col("rid") == F.col("_r")), "left").select(*own, "spans")
    joined = near.unionByName(marked_.where("not _flag").select(*own, F.lit(None).cast("array<binary>").alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw = texts(part.column(text))
                cut = [merged(s or []) for s in part.column("spans").to_pylist()]
                kept = [kept_bytes(x, s) for x, s in zip(raw, cut, strict=True)]
                out = [pa.array(map(len, raw), pa.int64()), pa.array([len(x) - len(y) for x, y in zip(raw, kept, strict=True)], pa.int64()), pa.array(map(len, cut), pa.int64())]
                if characters:
                    kept = [kept_bytes(x, of_characters(x, s)) for x, s in zip(raw, cut, strict=True)]
                out.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *out], [*own, *more])

    kind = joined.drop("spans").schema
    for c in more[:3]:
        kind = kind.add(c, "long")
    return joined.mapInArrow(run, kind.add("kept", "binary")).toDF(*docs.columns, *more)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``dedup`` returns."""
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
