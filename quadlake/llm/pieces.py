"""SentencePiece encoding and decoding by suffix-array matching.

For a BPE model with byte fallback and no normalisation but the space mark. The text is cut
where no piece can cross (before a space mark that follows another character, and around
line ends); the distinct chunks that a worker has not met yet are encoded together:
their text is laid in a row and its suffix array built; every piece of the vocabulary is
binary-searched for its range of occurrences; the occurrences are the edges of a lattice over
the text; edges are sorted by position and relaxed from left to right, all chunks in step.

What is relaxed is which token ends the encoding of each prefix. An encoding by merges is right
exactly if each pair of neighbours is the encoding of their own text, so an edge extends a
prefix if its piece and the prefix's last token are such a pair; each position has one
such token. Pairs are checked by merging their few characters, and remembered in a table of fixed size.
Characters that the vocabulary lacks become edges of their own, written as byte pieces.

Defined results: null and empty texts have no ids; any text can be encoded; decoding gives the
text back, with the space mark character itself read as a space.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadlake.llm.common import slices, text_of, texts
from quadlake.llm.tokens import ChunkStore, vocabulary

MARK = "▁"
#: Bytes of text that are laid in a row at a time (or one chunk, if that is longer).
BLOCK = 1 << 18
_LETTERS = "A-Za-z" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))

#: Slots of the table of pairs, as a power of two.
PAIRS = 22
#: Bytes of a character by its first one.
_SIZES = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])

_loaded: dict[str, Encoder] = {}


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` sorted by the ``depth`` bytes that follow (by doubling from some)."""
    n = len(data)
    # Keys are sorted with their positions in their lower bits, which is much quicker than by an order.
    low = n.bit_length()
    h = min(8, (63 - low) // 8)
    padded = np.concatenate([data, np.zeros(h, np.uint8)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << 8) | padded[j : j + n]
    while True:
        if int(key.max()) < 1 << (63 - low):
            packed = np.sort(key << low | np.arange(n))
            order, by = packed & ((1 << low) - 1), packed >> low
        else:
            order = np.argsort(key, kind="stable")
            by = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], by[1:] != by[:-1]]))
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


class Encoder(ChunkStore):
    """Encoder and decoder of one model file; keeps the ids of chunks it has met."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        model = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        names = [model.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids_of = {names[i]: i for i in normal}
        self.names, self.scores = names, [model.get_score(i) for i in range(self.size)]
        raw = [names[i].encode() for i in normal]
        self.longest = max(map(len, raw))
        order = sorted(range(len(normal)), key=raw.__getitem__)
        self.piece_ids = np.array([normal[i] for i in order])
        self.piece_lengths = np.array([len(raw[i]) for i in order])
        self.first = np.array([raw[i] for i in order], f"S{self.longest}")
        self.last = np.array([raw[i].ljust(self.longest, b"\xff") for i in order], f"S{self.longest}")
        self.text_of_id = [n.encode() for n in names]
        for b, i in enumerate(self.bytes_ids.tolist()):
            self.text_of_id[i] = bytes([b])
        for i in range(self.size):
            if model.is_control(i):
                self.text_of_id[i] = b""
        # Where a letter meets one of these, no piece goes on.
        after = {b for n in self.ids_of for a, b in zip(n, n[1:], strict=False) if re.match(f"[{_LETTERS}]", a)}
        tail = "".join(re.escape(c) for c in "!\"),.:;?]" if c not in after)
        word = f"{MARK}*[{_LETTERS}]+(?=[{tail}])|" if tail else ""
        self.chunk = re.compile(f"{word}{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        if any(MARK in n.lstrip(MARK) or "\n" in n for n in self.ids_of):
            raise ValueError("pieces of this model cross space marks or line ends")
        #: State after a character outside the vocabulary, or at a chunk's begin.
        self.none = self.size
        # Pairs that were met, each in the slot of its hash: twice the pair's number, and 1 if it is valid.
        self.pairs = np.full(1 << PAIRS, -1, np.int32 if (self.size + 1) ** 2 < 1 << 30 else np.int64)
        super().__init__(np.uint16 if self.size <= 1 << 16 else np.uint32, most)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.scores[self.ids_of[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids_of]
            if not options:
                break
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may stand side by side."""
        codes = left * (self.size + 1) + right
        slots = (codes * -0x61C8864680B583EB >> 64 - PAIRS) & (len(self.pairs) - 1)
        met = self.pairs[slots]
        missing = np.flatnonzero(met >> 1 != codes)
        out = met & 1 == 1
        if len(missing):
            new, which = np.unique(codes[missing], return_inverse=True)
            ok = []
            for c in new.tolist():
                a, b = divmod(c, self.size + 1)
                own = [self.names[b]] if a == self.none else [self.names[a], self.names[b]]
                ok.append(self.merged("".join(own)) == own)
            valid = np.array(ok, bool)
            out[missing] = valid[which]
            self.pairs[slots[missing]] = (codes[missing] << 1) | out[missing]
        return out

    def _edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and piece of every occurrence of a piece."""
        order = suffix_array(data, self.longest)
        padded = np.concatenate([data, np.zeros(self.longest, np.uint8)])
        out = []
        low = high = np.zeros(len(self.first), np.int64)
        # The sorted suffixes are looked at in parts: each is its first bytes, as one string.
        part = 1 << 18
        for at in range(0, len(order), part):
            own = order[at : at + part]
            keys = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[own].copy().view(f"S{self.longest}").ravel()
            low, high = np.searchsorted(keys, self.first, "left"), np.searchsorted(keys, self.last, "right")
            n = high - low
            where = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
            out.append((own[where], np.repeat(self.piece_lengths, n), np.repeat(self.piece_ids, n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [c.encode("utf-8", "replace") for c in chunks]
        ends = np.cumsum([len(r) + 1 for r in raw])
        # The lattice takes some hundred bytes for each byte of text, so long batches go in blocks.
        cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(raw)]
        blocks = [self._encode(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        if not blocks:
            return np.zeros(0, self.kind), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))

    def _encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = starts + sizes
        begin, length, piece = self._edges(data)
        # Characters that no piece of their own covers.
        lone = (data & 0xC0) != 0x80
        lone[ends] = False
        lone[begin[length == _SIZES[data[begin]]]] = False
        char = np.flatnonzero(lone)
        begin, length, piece = np.concatenate([begin, char]), np.concatenate([length, _SIZES[data[char]]]), np.concatenate([piece, np.full(len(char), self.none)])
        step = (np.arange(len(data)) - np.repeat(starts, sizes + 1))[begin]
        order = np.argsort(step.astype(np.uint16) if len(data) <= 1 << 16 or int(step.max(initial=0)) < 1 << 16 else step, kind="stable")  # by position in the chunk
        begin, length, piece, step = begin[order], length[order], piece[order], step[order]
        state, back = np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        state[starts] = self.none
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(step)).tolist(), strict=True):
            b = begin[lo:hi]
            live = np.flatnonzero(state[b] >= 0)
            b, n, p = b[live], length[lo:hi][live], piece[lo:hi][live]
            ok = p == self.none
            known = np.flatnonzero(~ok)
            ok[known] = self._pairs(state[b[known]], p[known])
            b, n, p = b[ok], n[ok], p[ok]
            state[b + n], back[b + n] = p, b
        # Walk back from the ends, all chunks in step. Of each place the token that begins there, and its bytes.
        reached = (state[ends] >= 0) & (sizes > 0)
        at, first = ends[reached], starts[reached]
        token, size = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        while len(at):
            place = back[at]
            token[place], size[place] = state[at], at - place
            on = np.flatnonzero(place > first)
            at, first = place[on], first[on]
        at = np.flatnonzero(token >= 0)
        token, size, which = token[at], size[at], np.repeat(np.arange(len(raw)), sizes + 1)[at]
        spread = np.where(token == self.none, size, 1)
        first = np.repeat(np.cumsum(spread) - spread, spread)
        at = np.repeat(at, spread) + np.arange(len(first)) - first
        token, which = np.repeat(token, spread), np.repeat(which, spread)
        ids = np.where(token == self.none, self.bytes_ids[data[at]], token)
        if (sizes[~reached] > 0).any():
            raise AssertionError("a chunk has no encoding")
        return ids.astype(self.kind), np.bincount(which, minlength=len(raw)).astype(np.int32)

    def batch(self, values: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.index) > self.most:
            self.clear()
        return self.joined([self.chunk.findall(MARK + x.replace(" ", MARK)) if x else [] for x in values])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text_of_id.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encoder(path: str) -> Encoder:
    """The worker's encoder for a model file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, ids of every text."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, 512):
                ids = own.batch([x.decode("utf-8", "replace") for x in texts(part.column("text"))])
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), column], ["doc_id", "text", "ids"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (doc_id, text, ids) with the ids' text as ``decoded``."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids = part.column("ids")
                ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
                out = [own.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text", "ids")), pa.array(out, pa.string())], ["doc_id", "text", "ids", "decoded"])

    return rows.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def digests(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip
    of ``rows`` (doc_id, text, ids). The ids are decoded as ``decode`` does it, in one pass."""
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch):
                ids = part.column("ids")
                ends, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
                raw, back = texts(part.column("text")), [own.decode(flat[a:b]).encode() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([a.replace(MARK.encode(), b" ") == b for a, b in zip(raw, back, strict=True)]),
                ], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return rows.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
