"""Token ids and token counts of whole texts, and a digest cache for the counts.

``WordCache`` gives exactly the ids of the ``tokenizers`` library. The tokenizer drops
white space and never lets a token cross it, so a text's ids are those of its
white-space separated chunks in order. Chunks repeat a lot: Arrow numbers those of a few
hundred texts, each distinct one is cut to words, and words are encoded once for each
worker (the cache is emptied when it is full, which bounds its memory). That holds for
texts of plain Latin characters without "<|"; any other text goes to the library whole.

``count_tokens`` is the digest cache: (digest of the normalised text, digest of the
tokenizer version) -> count. Texts are joined to the stored counts, one copy of each
text that is missing is encoded, and the new counts are appended to the cache, a Parquet
table with a folder for each tokenizer version. Without a path of one's own it lies in the
scratch folder, so later calls on the same cluster find what earlier ones have counted.
Normalised texts differ from texts in letter case and spaces around them only, and only where the tokenizer
ignores both (see ``normalised``), so equal digests have equal counts.

Defined results: null text counts as empty; empty texts have 0 tokens; repeated rows are
answered each; null ids are kept; extra columns are ignored. A count that two calls have appended at
the same time stands twice in the cache, and is read once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import forget, scratch, slices, text_of, texts, written

#: Characters for which NFC, lower-casing by character and white space agree everywhere, and whose lower case is one of them.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u02ff]")
_LATIN = {k: "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
#: The tokenizer's words, for these characters, and the ends of the lines they stand in.
_WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[{L}]+|[{N}]|[^\\s{L}{N}]+|\n".format(**_LATIN))

_loaded: dict[str, WordCache] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class _Index(dict):
    """Numbers chunks as they are first met; ``new`` has those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.new.append(chunk)
        return i


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` at ``starts`` in a row."""
    ends = np.cumsum(counts, dtype=np.int64)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)]


class ChunkStore:
    """Ids of text chunks, each encoded once; emptied when it holds more than ``most`` chunks."""

    def __init__(self, kind: type, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and the number of each chunk's."""
        raise NotImplementedError

    def clear(self) -> None:
        self.index = _Index()
        self.counts = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, self.kind)
        self.used = 0

    def _learn(self) -> None:
        chunks, self.index.new = self.index.new, []
        first = len(self.index) - len(chunks)
        try:
            ids, counts = self.encode_chunks(chunks)
        except BaseException:
            self.clear()
            raise
        while len(self.counts) < len(self.index):
            self.counts, self.starts = np.resize(self.counts, 2 * len(self.counts)), np.resize(self.starts, 2 * len(self.starts))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        here = slice(first, first + len(chunks))
        self.counts[here] = counts
        self.starts[here] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def places(self, parts: list[list[str]]) -> np.ndarray:
        """Places of all parts' chunks in the store, which learns those it lacks."""
        n = sum(map(len, parts))
        out = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int32, n)
        if self.index.new:
            self._learn()
        return out

    def joined(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each part's chunks in a row."""
        places = self.places(parts)
        counts = self.counts[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[places] - ends[:-1], counts)]
        cuts = ends[np.cumsum([0, *map(len, parts)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class WordCache(ChunkStore):
    """Ids of texts by the ``tokenizers`` library, word by word.

    Of the chunks of many texts each distinct one is cut to words, as the library's pre-tokenizer
    does it, and the library's model encodes each distinct word once.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: Bytes of Latin characters as the byte level writes them; the others have no place in it.
        written = {c: chr(c) for c in range(0x80)}
        for c in range(0x80, 0x300):
            written |= zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True) if chr(c) not in "\x85\xa0" else ()
        self.written = "".join(written.get(b, "\ufffe") for b in range(256))
        super().__init__(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32, most)

    def clear(self) -> None:
        super().clear()
        self.index["\n"] = 0  # ends a chunk; has no ids

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.model.tokenize
        words = charmap_decode("\n".join(chunks).encode(), "strict", self.written)[0].split("\n")
        found = [[t.id for t in tokenize(w)] for w in words]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(counts.sum())), counts

    def _plain(self, text: str) -> bool:
        return "<|" not in text and not _OTHER.search(text)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _latin(self, values: list[str]) -> list[np.ndarray]:
        """The ids of each text; of plain texts in lower case."""
        lists = pc.ascii_split_whitespace(pa.array(values, pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py()
        places = self.places([_WORDS.findall(f"{chunks}\n")])
        counts = self.counts[places]
        ids = _gathered(self.ids, self.starts[places], counts)
        ends = np.cumsum(counts, dtype=np.int64)[places == 0]
        starts = np.concatenate([[0], ends[:-1]])
        coded = coded.indices.to_numpy()
        counts = (ends - starts)[coded]
        ids = _gathered(ids, starts[coded], counts)
        cuts = np.concatenate([[0], np.cumsum(counts)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def batch(self, values: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > self.most:
            self.clear()
        plain = [self._plain(x) for x in values]
        out = self._latin([x.lower() if ok else "" for x, ok in zip(values, plain, strict=True)])
        return [x if ok else self._whole(text) for text, ok, x in zip(values, plain, out, strict=True)]


def word_cache(path: str) -> WordCache:
    """The worker's cache for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            for part in slices(batch, 256):
                counts = [len(x) for x in cache.batch([x.decode("utf-8", "replace") for x in texts(part.column("text"))])]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def normalised(text: Column) -> Column:
    """The text in lower case without spaces around it where the tokenizer ignores both: in
    ASCII texts without "<|". Others stay as they are, so they differ from all of those."""
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("<|"))
    return F.when(plain, F.lower(F.trim(text))).otherwise(text)


def default_cache(spark: SparkSession) -> str:
    return f"{scratch(spark)}/token-cache"


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of a tokenizer version in the cache; empty if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache_path}/tokenizer={tokenizer}")
    kind = "digest binary, n_tokens long"
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(place.toString()).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, path: str | None = None, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text, by way of the digest cache at ``cache_path``, which is
    made or appended to."""
    path, cache_path = path or vocabulary(), cache_path or default_cache(spark)
    tokenizer = version_digest(path)
    plain = docs.select("doc_id", text_of().alias("text")).select("doc_id", normalised(F.col("text")).alias("text"), F.octet_length("text").cast("long").alias("n_bytes"))
    key = F.unhex(F.sha2("text", 256))
    keyed = plain.select("doc_id", key.alias("digest"), "n_bytes")
    stored = stored_counts(spark, cache_path, tokenizer)
    # One row for each missing digest, chosen before any text moves; only the chosen texts are shuffled.
    row = F.xxhash64("doc_id", "digest")
    chosen = keyed.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("first")).select("digest", F.col("first.doc_id").alias("doc_id"))
    chosen = chosen.join(stored, "digest", "left_anti").select(row.alias("row"), F.col("digest").alias("d"))
    source = plain.select(key.alias("digest"), "doc_id", "text").select(row.alias("row"), "digest", "text")
    misses = source.join(chosen, (source["row"] == chosen["row"]) & (source["digest"] == chosen["d"]), "left_semi")
    fresh = written(misses.select("digest", "text").mapInArrow(_count(path), "digest binary, n_tokens long").dropDuplicates(["digest"]), "token-counts")
    fresh.write.mode("append").parquet(f"{cache_path}/tokenizer={tokenizer}")
    forget(fresh)
    return keyed.join(stored_counts(spark, cache_path, tokenizer), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
