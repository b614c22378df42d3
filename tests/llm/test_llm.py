"""The operators against brute force, round trips and held-out accuracy, with nulls, empty and repeated rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadlake.llm import jaccard, maxscore, media, packing, pieces, queries, suffix, tokens, toxicity, warc
from quadlake.llm import license as licenses

SF = "/root/testdata/sf0.001"
LONG = "A passage that is quite a bit longer than fifty bytes, with ünïcode in the midst of it, and repeated. "


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, repeated rows, ties, near copies and a column with a clashing name."""
    words = [f"w{i}" for i in range(120)]
    near = words[:60] + ["changed"] + words[61:]
    rows = [(0, LONG * 2), (1, None), (2, ""), (3, "x " + LONG + "y"), (4, LONG * 2), (4, LONG * 2), (5, " ".join(words)), (6, " ".join(near)), (7, "one two"), (8, "ONE  two"), (None, LONG), (9, "ab" * 200), (10, "ba" * 100 + "<|endoftext|>"), (11, " ".join(words * 900))]
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, score int")


def removed(rows):
    first = {}
    for i, t in sorted(rows):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    out = []
    for i, t in rows:
        mark = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                mark[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((i, len(t), sum(mark), sum(1 for x in range(len(t)) if mark[x] and not (x and mark[x - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    own = [tuple(r) for r in suffix.digests(suffix.dedup(docs)).collect()]
    assert sorted(r for r in own if r[0] is not None) == removed([r for r in rows if r[0] is not None])
    assert [r[2] for r in own if r[0] is None] == [0]
    assert suffix.dedup(docs).columns == ["doc_id", "text", "lang", "score", "n_bytes", "n_removed", "n_spans", "kept"]


def test_suffix_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = sorted(tuple(r) for r in suffix.digests(suffix.dedup(docs.select("doc_id", "text"))).collect())
    assert own == removed([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])


def test_contexts_that_share_no_half_are_not_indexed(monkeypatch):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    gram, core = letters(20), letters(60)
    far = [letters(30) + gram + letters(30) for _ in range(6)]  # nothing but the gram is shared
    near = [core[:14] + gram + core[14:30] + letters(1 + i) for i in range(4)]  # one window is shared, begun before the gram
    texts_, gram_at = far + near, np.array([30] * 6 + [14] * 4)
    sizes, ids = np.array(list(map(len, texts_))), np.arange(10)
    begin, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(texts_), np.uint8)
    _, _, halves = suffix.hashes(data, begin, gram_at, sizes, most=100)
    assert suffix.akin(halves, gram_at, sizes, ids).tolist() == [False] * 6 + [True] * 4
    assert not suffix.akin(halves, gram_at, sizes, np.zeros(10, np.int64)).any()

    indexed = []
    own = suffix.RunLengthIndex
    monkeypatch.setattr(suffix, "RunLengthIndex", lambda data, sizes, groups: indexed.append(len(sizes)) or own(data, sizes, groups))
    zero = np.zeros(10, np.int64)
    row = pa.table({"doc_id": pa.array([None], pa.int64()), "rid": pa.array([None], pa.int64()), "data": [suffix._pack(ids, zero, zero, sizes, gram_at, data.tobytes())]})
    spans = suffix._resolve((), row).to_pydict()
    assert dict(zip(spans["doc_id"], map(lambda x: suffix.merged([x]).tolist(), spans["spans"]), strict=True)) == {i: [[0, 50]] for i in (7, 8, 9)}
    assert max(indexed) <= 2  # half of the four; all ten before


def test_statistics_of_patterns_that_are_left_early():
    rng = np.random.default_rng(6)
    part = lambda n: rng.integers(97, 99, n, dtype=np.uint8)
    for _ in range(20):
        own, sizes = part(400), rng.integers(20, 60, 8)
        index = suffix.RunLengthIndex(own[: int(sizes.sum())], sizes, np.sort(rng.integers(0, 2, 8)) if _ % 2 else np.zeros(8, np.int64))
        patterns = [np.concatenate([part(9), own[a : a + 20], part(9)]) for a in rng.integers(0, int(sizes.sum()) - 20, 12)]
        of = np.zeros(12, np.int64)
        data, lengths = np.concatenate(patterns), np.array(list(map(len, patterns)))
        assert ((index.statistics(data, lengths, of) >= 15) == (index.statistics(data, lengths, of, 15) >= 15)).all()


def test_chosen_grams_against_their_definition():
    rng = np.random.default_rng(7)
    for n in (49, 50, 51, 90, 700):
        text = bytes(rng.integers(97, 99, n, dtype=np.uint8)) if n % 2 else b"ab" * (n // 2)
        keys, place, first, last, sums = suffix.chosen(text)
        at = np.arange(max(0, n - 19))
        h = suffix.span_hash(sums, at, at + 20) if n >= 50 else []
        least = [max(range(w, w + 31), key=lambda i: (-int(h[i] >> np.uint64(31)), i)) for w in range(n - 49)]
        assert np.repeat(place, last - first + 1).tolist() == least and [int(h[i]) for i in place] == keys.tolist()


def components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*(w[j:] for j in range(5)), strict=False))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [True, False])
def test_jaccard(spark, docs, small):
    docs = docs if small else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if r.doc_id is not None]
    expected = components([(r.doc_id, r.text) for r in rows])
    found = jaccard.classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == expected
    assert len(found) == docs.count()


def test_jaccard_of_hot_elements(spark, monkeypatch):
    """Tiles of many documents in chunks: copies with changes, a passage that all have, sizes across bands."""
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    monkeypatch.setattr(jaccard, "FIRST", 1)
    rng = np.random.default_rng(5)
    passage, rows = [f"p{i}" for i in range(30)], []
    for i in range(90):
        own = [f"w{i % 6}-{j}" for j in range(60)]
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            own[at] = f"x{i}"
        rows.append((i, " ".join(passage + own[: 60 - int(rng.integers(0, 12))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()} == components(rows)


def test_tiles_agree_with_all_pairs():
    """Similar sets share first elements, their signatures pass, and the tiles find them in blocks of any chunks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < p], rng.integers(0, 1 << 62, n).astype(np.uint64)])) for p in (0.95, 0.9, 0.8, 0.5) for n in (0, 20, 80) for _ in range(4)]
    rng.shuffle(sets)
    linked = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard.similar(sets[i], sets[j])}
    for chunks in (1, 3):
        rows = [(k % 2, min(i % chunks, c), max(i % chunks, c), i % chunks, i, i, len(s)) for k in range(2) for i, s in enumerate(sets) for c in range(chunks)]
        columns = dict(zip(("key", "i", "j", "chunk", "doc", "group", "n"), np.array(rows).T, strict=True))
        tiles = jaccard._Tiles(columns, [jaccard.signature(sets[r[4]], jaccard.bits_of(r[6])).tobytes() for r in rows], 80)
        assert linked <= {(x, y) for a, b in tiles.pairs() for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for a, b in itertools.combinations(sets, 2):
        if jaccard.similar(a, b):
            none = np.zeros(0, np.uint64)
            assert len(np.intersect1d(jaccard.prefix(a, none), jaccard.prefix(b, none))) >= jaccard.least_shared(-(-80 * max(len(a), len(b)) // 100))
            assert jaccard.may_link(len(a), len(b), *(jaccard.signature(s, jaccard.bits_of(len(s))) for s in (a, b)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix.dedup(empty).count() == jaccard.classes(empty).count() == packing.pack(spark, empty).count() == 0
    assert tokens.count_tokens(spark, empty).count() == toxicity.toxicity(spark, empty, labels).count() == licenses.license_labels(empty).count() == 0
    assert pieces.decode(pieces.encode(empty)).count() == media.audio_columns(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert maxscore.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_license(docs, spark):
    rows = [(1, "Released under the MIT License. GNU General  Public-License, version 3."), (2, "the Apache\nlicense, version 2.0"), (3, None), (4, "limit license"), (5, "Licensed under CC BY-NC 4.0"), (6, "ü MIT LICENSE mit license"), (None, "all rights reserved"), (6, "ü MIT LICENSE mit license")]
    out = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (11, 2, 3, 6, "gpl,mit")
    assert "gpl-3.0" in out[1].labels.split(",") and "gpl" in out[1].labels.split(",")
    assert out[2].base_labels == "apache" and "apache-2.0" in out[2].labels
    assert (out[3].n_words, out[3].n_base, out[3].first_word, out[3].labels, out[3].score) == (0, 0, None, "", 0.0)
    assert out[4].n_base == 0 and out[5].labels == "cc-by-nc" and (out[6].first_word, out[6].last_word) == (1, 3) and out[None].labels == "proprietary"
    assert len(licenses.rules()) > 250 and licenses.license_labels(docs).count() == docs.count()


def scanned(text):
    """What the scan returns, with every rule tried on the whole text at each place of its keyword."""
    words = [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    base = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    hits = []
    for n, (label, keyword, priority, confidence, rx) in enumerate(licenses.rules()):
        for i in [i for i, w in enumerate(words) if w == keyword]:
            m = re.search(f"(?<= ){rx}(?= )", " " + " ".join([*words[:i], licenses.MARK + words[i], *words[i + 1 :]]) + " ")
            if m:
                start = i - m[0].split(licenses.MARK)[0].count(" ")
                hits.append((start, start + m[0].count(" ") + 1, priority, n, confidence, label))
    rank = lambda h: (h[2], h[1] - h[0], -h[3])
    kept = [h for h in hits if not any(o[0] <= h[0] and o[1] >= h[1] and rank(o) > rank(h) for o in hits)]
    assert all(e - s <= licenses.LEFT + licenses.RIGHT for s, e, *_ in hits)
    own = {label for _, label in base}
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {h[5] for h in kept})), max([h[4] for h in kept] + [0.8 if own else 0.0]))


def example(rx):
    """A text that a rule's expression matches: first branches, optional parts once left out and once taken."""
    from re import _constants as c
    from re import _parser

    def build(parsed, take):
        out = ""
        for op, value in parsed:
            if op is c.LITERAL:
                out += chr(value)
            elif op is c.NOT_LITERAL:
                out += "w"
            elif op is c.IN:
                out += chr(value[0][1] if value[0][0] is c.LITERAL else value[0][1][0])
            elif op is c.SUBPATTERN:
                out += build(value[3], take)
            elif op is c.BRANCH:
                out += build(value[1][-1 if take else 0], take)
            elif op is c.MAX_REPEAT:
                out += build(value[2], take) * (value[1] if take and value[1] < 20 else value[0])
        return out

    return [build(_parser.parse(rx), take).replace(licenses.MARK, "") for take in (False, True)]


def test_license_scan_against_brute_force(docs, spark):
    examples = [x for r in licenses.rules() for x in example(r[4])]
    for (label, _, _, _, rx), pair in zip(licenses.rules(), zip(examples[::2], examples[1::2], strict=True), strict=True):
        assert all(re.search(f"(?<= ){rx.replace(licenses.MARK, '')}(?= )", f" {x} ") for x in pair), (label, rx, pair)
    some = ["Released under MIT.", "distributed under CC BY-SA 4.0", "Apache 2.0", "MPL 2.0", "FreeBSD License", "0BSD license", "\u212aB license mit", None, "", "an ordinary text", " ".join(examples[:90]), "mit license " * 300, "license licence sublicense " * 150]
    texts = some + [f"a text, {x}; more" for x in examples] + [f"{a} {b}" for a, b in zip(examples[::3], examples[100::3], strict=False)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1_000_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = {r.doc_id: tuple(r)[1:] for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert out[i] == scanned(t), t
    assert all(out[i][5] for i in range(len(some), len(some) + len(examples)))


def test_license_scan_of_a_long_text(spark):
    line = "Released under the MIT License. GNU General Public License, version 3. All rights reserved. Licensed under CC BY-NC 4.0. "
    n = 2_000_000 // len(line)
    (out,) = licenses.license_labels(spark.createDataFrame([(1, line * n)], "doc_id long, text string")).collect()
    one = scanned(line * 3)
    assert (out.n_words, out.n_base, out.labels, out.score) == (one[0] // 3 * n, 2 * n, one[5], one[6])


def test_pieces_against_the_library(spark, docs):
    own = pieces.Encoder(tokens.vocabulary("piece_bpe_32k.model"))
    texts = ["", " ", "a  b\n\tc", "你好 🎉 ﹏", "aaaa bbbbb ------- !!!!!", "don't (stop), e.g.\n\n x"] + [r.text or "" for r in docs.collect()] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    mine = own.batch(texts)
    assert [x.tolist() for x in mine] == own.library.encode(texts)
    assert [own.decode(x) for x in mine] == texts
    back = pieces.decode(pieces.encode(docs))
    assert all(r.decoded == r.text.replace(pieces.MARK, " ") for r in back.collect())
    assert all(r.round_trip for r in pieces.digests(back).collect())
    # Blocks of any size give the same ids.
    whole, pieces.BLOCK = pieces.BLOCK, 64
    try:
        assert [x.tolist() for x in pieces.Encoder(tokens.vocabulary("piece_bpe_32k.model")).batch(texts[:60])] == [x.tolist() for x in mine[:60]]
    finally:
        pieces.BLOCK = whole


def test_pieces_with_a_small_table_of_pairs(spark, monkeypatch):
    """What is remembered of pairs is of one size, whatever the texts; pairs of one slot displace each other, and ids stay right."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60] + ["你好 🎉 ﹏▁", "\0\0a \0", "a" * 3000]
    for bits in (0, 6, 16):
        monkeypatch.setattr(pieces, "PAIRS", bits)
        own = pieces.Encoder(tokens.vocabulary("piece_bpe_32k.model"))
        assert [x.tolist() for x in own.batch(texts)] == own.library.encode(texts)
        assert own.pairs.nbytes == 4 << bits


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(8)
    for n, letters, depth in ((1, 2, 48), (700, 2, 48), (3000, 1, 48), (3000, 200, 5), (3000, 2, 20)):
        data = rng.integers(0, letters, n, dtype=np.uint8)
        raw = data.tobytes() + bytes(depth)
        part = [raw[i : i + depth] for i in range(n)]
        order = pieces.suffix_array(data, depth).tolist()
        assert sorted(order) == list(range(n)) and [part[i] for i in order] == sorted(part)


def test_token_counts(spark, docs, tmp_path, monkeypatch):
    library = tokens.WordCache(tokens.vocabulary()).library
    odd = spark.createDataFrame([(20, "İ ΑΣ x² don\u2019t we\'LL"), (21, "a<|startoftext|>b"), (22, " One\ttwo "), (23, "one two"), (24, "one\u00a0two"), (25, "a <|x b"), (26, "A <|X B"), (27, "  ONE TWO"), (28, "Tab\x01\x7f "), (29, "tab\x01\x7f")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expected = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), count(r.text)) for r in rows.collect())
    cache = str(tmp_path / "cache")
    own = lambda table: sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(spark, table, cache_path=cache).collect())
    assert own(rows) == expected
    normal = rows.select(tokens.normalised(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    assert all(count(r.text) == count(r.normal) for r in rows.select(F.coalesce("text", F.lit("")).alias("text")).select("text", tokens.normalised(F.col("text")).alias("normal")).collect())
    assert spark.read.parquet(cache).count() == normal.count() < rows.select(F.coalesce("text", F.lit(""))).distinct().count()

    # A second call encodes nothing: it has no encoder at all.
    def none(path):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows
                yield batch.select([])
        return run

    monkeypatch.setattr(tokens, "_count", none)
    assert own(rows) == expected and spark.read.parquet(cache).count() == normal.count()
    monkeypatch.undo()
    # One more text is the only miss; counts of another version are not read.
    more = rows.unionByName(spark.createDataFrame([(30, "something new")], "doc_id long, text string"))
    assert len(own(more)) == len(expected) + 1 and spark.read.parquet(cache).count() == normal.count() + 1
    assert tokens.stored_counts(spark, cache, "another").isEmpty()


def test_words_of_all_plain_characters():
    cache = tokens.WordCache(tokens.vocabulary())
    texts = [t for c in range(0x300) for t in (chr(c), f"a{chr(c)}B 1{chr(c)}", f"{chr(c)}{chr(c)} .{chr(c)}'s")]
    assert [x.tolist() for x in cache.batch(texts)] == [cache.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert cache.batch([]) == [] and [x.tolist() for x in cache.batch(["", " \n"])] == [[], []]
    # What lower-casing takes out of the range goes to the library whole.
    assert all(cache._plain(t.lower()) for t in texts if cache._plain(t))


def test_words_are_met_once(monkeypatch):
    met, made = [], []

    class Met(tokens._Index):
        def __getitem__(self, word):
            met.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(tokens, "_Index", Met)
    cache = tokens.WordCache(tokens.vocabulary())
    encode = cache.encode_chunks
    monkeypatch.setattr(cache, "encode_chunks", lambda words: made.extend(words) or encode(words))
    texts = ["one two. Two, (one)", "ONE\ttwo.  one!", " two, one\n"] * 50
    for _ in range(2):
        assert [x.tolist() for x in cache.batch(texts)] == [cache.library.encode(t, add_special_tokens=False).ids for t in texts]
    # A repeated chunk is neither cut nor looked up again; a word is encoded once, whatever stands beside it.
    assert len(met) < 2 * 25 and sorted(made) == sorted(set(made)) and {"one", "two"} < set(made) and not {"two.", "two,", "one!"} & set(made)
    # A full store is emptied and gives the same ids.
    small = tokens.WordCache(tokens.vocabulary(), most=2)
    assert [x.tolist() for t in texts[:6] for x in small.batch([t])] == [cache.library.encode(t, add_special_tokens=False).ids for t in texts[:6]]


def test_packing(spark, docs):
    library = tokens.WordCache(tokens.vocabulary()).library
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(spark, known).collect()
    ids = {r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for r in known.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[doc])
    assert by_doc.keys() == ids.keys()
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own = toxicity.toxicity(spark, docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in own) / len(own)
    found = sum(r.predicted and r.toxic for r in own) / max(1, sum(r.toxic for r in own))
    assert right > 0.95 and found > 0.8
    assert all(0 <= r.score <= 1 for r in own)


def test_toxicity_of_odd_rows(spark):
    bad, good = "you vile ünworthy idiot %d", "a walk by the quiet lake %d"
    rows = [(i, (bad if i % 3 == 0 else good) % (i % 7)) for i in range(300)] + [(300, None), (301, ""), (302, "x" * 300_000), (None, bad % 1), (7, good % 0), (7, good % 0), (3, "another text of a known id")]
    docs = spark.createDataFrame([(i, t, 9, "s") for i, t in rows], "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (4, None), (6, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(spark, docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 3)
    assert len({r.score for r in out if r.doc_id in (300, 301)}) == 1
    # Labels of held-out rows are never read.
    lied = labels.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    known = lambda rows: sorted((r.doc_id, r.score) for r in rows if r.doc_id is not None)
    assert known(toxicity.toxicity(spark, docs, lied).collect()) == known(out)


def test_toxicity_grams_are_of_characters():
    whole = toxicity.grams("äöü")
    assert [len(x) for x in whole] == [3, 2, 1]  # " äöü " has five characters
    assert [len(x) for x in toxicity.grams("")] == [0] and len(toxicity.grams("🎉🎉")[0]) == 2
    assert toxicity.grams("aä")[0][0] != toxicity.grams("aö")[0][0]


def test_media(spark, docs):
    more = spark.createDataFrame([(90, "x" * 64, "en", 1), (91, "x" * 65, "en", 1), (92, "ü🎉" * 50_000, "en", 1)], docs.schema)
    rows = docs.unionByName(more)
    raw = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in rows.collect()), key=str)
    out = sorted(media.digests(media.audio_columns(rows)).collect(), key=lambda r: str((r.doc_id is None, r.doc_id or 0, b"")) + r.payload_sha256)
    expected = []
    for null, doc, text in raw:
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt \x10\0\0\0\1\0\1\0" + (16000).to_bytes(4, "little") * 2 + b"\1\0\x08\0data" + len(payload).to_bytes(4, "little")
        stored = head + payload
        expected.append((None if null else doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:7]) for r in out)
    features = {}
    for r in out:
        features.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(x) == 1 for x in features.values())
    for r in media.audio_columns(docs).collect():
        assert media.from_ipc(bytes(r.log_mel)).shape[1:] == (media.BLOCK, media.BANDS) and all(s.start_ms < s.end_ms for s in r.spans)
    assert media.segments(np.array([0, 5, 10, 5, 0, 2, 0], np.float32)) == [(1, 4)]
    assert media.segments(np.zeros(4, np.float32)) == []


@pytest.mark.parametrize("up, down", [(media.UP, media.DOWN), (1, 2), (3, 2)])
def test_resampling_against_its_definition(up, down):
    assert len(media._phases(media.UP, media.DOWN, media.TAPS)) > 1
    x = np.random.default_rng(0).normal(size=997).astype(np.float32)
    h = media._phases(up, down, media.TAPS).T.ravel()  # the whole filter, at the rate between
    wide = np.zeros(len(x) * up + 2 * len(h))
    wide[: len(x) * up : up] = x
    direct = [sum(h[j] * wide[n * down - j + len(h) // 2 - up] for j in range(len(h)) if 0 <= n * down - j + len(h) // 2 - up) for n in range(-(-len(x) * up // down))]
    assert np.abs(media.resample(x, up, down) - np.array(direct)).max() < 1e-4
    tone = np.sin(np.arange(4000, dtype=np.float32) * 0.05)
    at = np.arange(-(-4000 * up // down)) * down / up
    assert np.abs(media.resample(tone, up, down) - np.sin(at * 0.05))[100:-100].max() < 0.05


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (500, [1.0] * 8), (501, [1.0] * 8), (600, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = maxscore.top_k(spark, table, F.col("vec_id") % 100 == 0, block=2)
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in maxscore.top_k(spark, table, F.col("vec_id") % 100 == 0).collect()}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in maxscore.top_k(spark, table, F.col("vec_id") % 100 == 0).collect()}
    sound = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and len(v) == 8 and not any(x is None or x != x for x in v)]
    for q, x in sound:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in sound if i != q)[:10]
            assert [got.pop((q, n)) for n in range(1, 11)] == [(i, -s) for s, i in best]
    assert not got


def test_top_k_of_large_numbers_and_repeated_rows(spark):
    rows = [(0, [1e7, 1e7]), (1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [1e7, 1e7]), (4, [2e7, 1e7]), (5, [float("inf"), 0.0]), (6, [3.1e38, 0.0])] + [(7, [0.0, 0.0])] * 30 + [(100, [1.0, 2.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i != 5]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    expected = []
    for q, x in sound:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in sound if i != q)[:10]
            expected += [(q, n + 1, i, clip(-s)) for n, (s, i) in enumerate(best)]
    got = [tuple(r) for r in maxscore.top_k(spark, table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(expected)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (2, None, None), (3, "http://c/\r\nx: y", "ü" * 40000), (4, "http://d/", "")], "page_id long, url string, html string")
    got = {r.id: (r.kind, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {"1": ("revisit", "5", 11), "5": ("response", None, 11), "2": ("revisit", "4", 0), "3": ("response", None, 80000), "4": ("response", None, 0)}
    data = b"".join(bytes(r.data) for r in warc.archives(pages).collect())
    whole = list(warc.salvage(data))
    assert len(whole) == 5 and all(r["kind"] != "gap" for r in whole)
    for at in (3, len(data) // 2, whole[1]["at"] + 40):
        hurt = bytearray(data)
        hurt[at] ^= 0xFF
        out = list(warc.salvage(bytes(hurt)))
        gaps = [r for r in out if r["kind"] == "gap"]
        assert len(gaps) == 1 and len(out) == 5 and gaps[0]["at"] <= at < gaps[0]["at"] + gaps[0]["size"]
    plain = b"".join(warc.record("response", str(i), "u", b"x" * i, i, warc.digest_of(b"x" * i)) for i in range(1, 4))
    assert [r.get("id") for r in warc.salvage(b"junk" + plain[:-3])] == [None, "1", "2", None]
    folder = str(tmp_path / "out")
    warc.write_files(warc.archives(pages), folder).collect()
    assert warc.read_archives(warc.read_files(spark, folder)).count() == 5


def test_warc_of_other_writers():
    def other(kind, ident, block, *lines):
        return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"warc-record-id: <urn:page:" + ident + b">", *lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])

    body = b"<p>x</p>"
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    one = other(b"warcinfo", b"0", b"software: x")
    two = other(b"response", b"1", http, b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha1:" + warc.digest_of(body).encode())
    wrong = other(b"response", b"2", b"y", b"WARC-Payload-Digest: sha1:" + warc.digest_of(b"z").encode())
    assert [(r["id"], r["payload_bytes"]) for r in warc.salvage(warc.member(one) + warc.member(two) + one)] == [("0", 11), ("1", len(http)), ("0", 11)]
    whole = warc.member(one + wrong + two)
    out = list(warc.salvage(whole + warc.member(one)))
    assert [r.get("id") for r in out] == ["0", None, "1", "0"] and out[1]["gap"] == "bad digest" and out[1]["size"] == len(whole)
    assert [r["kind"] for r in warc.salvage(warc.member(wrong))] == ["gap"]


def test_salvage_of_random_damage():
    rng = np.random.default_rng(3)
    for zipped in (True, False):
        parts = []
        for i in range(30):
            payload = rng.integers(0, 256, int(rng.integers(0, 4000)), np.uint8).tobytes() if i % 3 else b"text " * int(rng.integers(0, 900))
            one = warc.record("response", str(i), "u", payload, len(payload), warc.digest_of(payload))
            parts.append(warc.member(one) if zipped else one)
        data, ends = b"".join(parts), np.cumsum(list(map(len, parts)))
        for _ in range(40):
            hurt, at, n = bytearray(data), int(rng.integers(0, len(data))), int(rng.integers(1, 3000))
            how = int(rng.integers(0, 3))
            if how == 0:
                hurt[at : at + n] = bytes(min(n, len(hurt) - at))
            elif how == 1:
                del hurt[at : at + n]
            else:
                hurt[at:at] = (b"\x1f\x8b\x08\0" * n)[:n]
            out = list(warc.salvage(bytes(hurt)))
            touched = {i for i, end in enumerate(ends) if end - len(parts[i]) < at + (n if how < 2 else 0) and end > at}
            got = [int(r["id"]) for r in out if r["kind"] != "gap"]
            assert set(range(30)) - touched <= set(got) and len(got) == len(set(got))
            covered, last = 0, -1
            for r in out:
                if r["at"] != last:
                    assert r["at"] == covered
                    covered, last = r["at"] + r["size"], r["at"]
            assert covered == len(hurt)


def test_salvage_is_not_slowed_by_false_beginnings():
    import time

    def seconds(data):
        start = time.process_time()
        out = list(warc.salvage(data))
        assert out[-1]["kind"] == "response" and len(out) == 2
        return time.process_time() - start

    good = warc.member(warc.record("response", "1", "u", b"x", 1, warc.digest_of(b"x")))
    for false in (b"\x1f\x8b\x08\0\1\2\3", b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 99999999\r\n"):
        assert seconds(false * (2_000_000 // len(false)) + good) < 20


def test_cut_texts_keep_replacement_characters(spark):
    import corpus_pipeline

    cut = [("ä\ufffdb\x01b\x01a\x01".encode(), "ä\ufffdb\x01b\x01a\x01"), (b"a\xc3", "a"), (b"\xa4\xef\xbf\xbdb\xe2\x82", "\ufffdb"), (b"x\xe2\x82\xef\xbf\xbd", "x\ufffd"), (b"", "")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cut)], "i int, text binary")
    assert [r.t for r in df.select("i", corpus_pipeline._valid("text").alias("t")).orderBy("i").collect()] == [t for _, t in cut]


def test_cut_texts_have_no_characters_of_two_halves(spark):
    """What is left on the two sides of a cut is not read as a character that the text never had."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(30))
    # The second text shares the end of its first character, the words, and the begin of the next one.
    rows = [(1, f"é{words}é"), (2, f"ĩ{words}ó"), (3, f"a\ufffdĩ{words}óz\ufffd"), (4, f"€{words}\U0001f389"), (5, f"b\u02ac{words}\U0001f38ac")]
    assert b"\xc4" + b"\xb3" == "ĳ".encode()
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "", 3: "a\ufffdz\ufffd", 4: "€\U0001f389", 5: "bc"}
    assert suffix.of_characters("aĩ€".encode(), np.array([[0, 2], [4, 5]])).tolist() == [[0, 3], [3, 6]]
    assert suffix.of_characters(b"\x80" * 3, np.array([[0, 1]])).tolist() == [[0, 3]] and not len(suffix.of_characters(b"", np.zeros((0, 2), np.int64)))


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length"} <= set(rows[0].asDict())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_begin_with_collected_heaps(spark, odd):
    import corpus_pipeline

    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, odd)
        assert full() > before, name


def test_heaps_are_collected_between_steps(spark, docs, monkeypatch):
    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    seen = []
    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, tag: (seen.append((tag, full())), written(df, tag))[1])
    jaccard.classes(docs).collect()
    at = dict(reversed(seen))  # of each table the first time
    assert at["equal-sets"] < at["entries"] < at["tiles"] and at["links"] < at["open-tiles"] and seen[-1][1] < full()


ODD = "doc_id long, text string, lang string, n_chars long, score int, bits string, _d int, _flag int, spans int, kept string, component_id int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A small corpus with toxic rows, copies, near copies, repeats, nulls, repeated rows, and columns whose names the operators use."""
    bad, good = "you vile stupid worthless idiot number %d, get lost", "a quiet walk along the lake with friend number %d"
    words = [f"w{i}" for i in range(80)]
    texts_ = [(i, (bad if i % 4 == 0 else good) % i) for i in range(120)]
    texts_ += [(200, " ".join(words)), (201, " ".join(words[:40] + ["x"] + words[41:])), (202, " ".join(words).upper()), (203, LONG + "ä" * 40), (204, "ö " + LONG + "ü" * 30), (205, None), (206, ""), (207, LONG), (207, LONG), (None, LONG), (None, bad % 3), (208, "é" * 60 + "\ufffd"), (209, "z" + "é" * 60)]
    docs = spark.createDataFrame([(i, t, "en", None if t is None else len(t), 7, "b", 1, 2, 3, "k", 4) for i, t in texts_], ODD)
    folder = str(tmp_path_factory.mktemp("odd"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_against_brute_force(spark, odd):
    import corpus_pipeline

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, rows = docs.columns, sorted(map(tuple, docs.collect()), key=key)

    # Toxic texts go, with a null id too; everything else of the rows stays as it is.
    out = corpus_pipeline.drop_toxic(spark, docs, odd)
    kept = [r for r in rows if "idiot" not in (r[1] or "")]
    assert out.columns == columns and sorted(map(tuple, out.collect()), key=key) == kept

    # One document of each group stays.
    docs = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, odd)
    least = {i: c for i, (_, c) in components([r[:2] for r in kept if r[0] is not None]).items()}
    kept = [r for r in kept if r[0] is None or least[r[0]] == r[0]]
    assert len(least) > len([r for r in kept if r[0] is not None]) and out.columns == columns and sorted(map(tuple, out.collect()), key=key) == kept

    # Bytes that repeat a smaller document's go, and with them the rest of their characters.
    docs = spark.createDataFrame(kept, docs.schema)
    out = corpus_pipeline.cut_repeats(spark, docs, odd)
    first = {}
    for i, t in ((r[0], (r[1] or "").encode()) for r in kept if r[0] is not None):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    expected = []
    for r in kept:
        t, mark, at, own = (r[1] or "").encode(), bytearray(len((r[1] or "").encode())), 0, ""
        for j in range(len(t) - 49) if r[0] is not None else ():
            if first[t[j : j + 50]] < r[0]:
                mark[j : j + 50] = b"\1" * 50
        for c in r[1] or "":
            size = len(c.encode())
            own += "" if any(mark[at : at + size]) else c
            at += size
        expected.append((r[0], own, r[2], len(own), *r[4:]))
    assert any(len(e[1]) < len(r[1] or "") for e, r in zip(expected, kept, strict=True))
    assert out.columns == columns and sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)

    # All that is left is packed, each document's tokens once, and run() does the same.
    library = tokens.WordCache(tokens.vocabulary()).library
    want = sorted((str(r[0]), len(library.encode(r[1], add_special_tokens=False).ids) + 1) for r in expected)
    for pieces_ in (corpus_pipeline.pack(spark, spark.createDataFrame(expected, docs.schema), odd).collect(), corpus_pipeline.run(spark, odd).collect()):
        assert sum(p.length for p in pieces_) == sum(n for _, n in want)
        assert {(str(p.doc_id), p.doc_tokens) for p in pieces_} == set(want)


def test_pipeline_of_an_empty_table(spark, odd, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{odd}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_ignore_or_keep_clashing_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    n = docs.count()
    assert suffix.dedup(docs).columns == [*(c for c in docs.columns if c != "kept"), "n_bytes", "n_removed", "n_spans", "kept"] and suffix.dedup(docs).count() == n
    assert jaccard.one_of_each(docs).columns == docs.columns and jaccard.classes(docs).count() == n
    assert licenses.license_labels(docs).count() == tokens.count_tokens(spark, docs).count() == media.digests(media.audio_columns(docs)).count() == n
    assert toxicity.toxicity(spark, docs, spark.read.parquet(f"{odd}/labels.parquet").withColumn("text", F.lit("x"))).count() == n
    assert len({r.doc_id for r in packing.pack(spark, docs).collect()}) == len({r.doc_id for r in docs.select("doc_id").collect()})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, other = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(other.columns)
    rows = lambda names, values: sorted(tuple(str(r[names.index(c)]) for c in order) for r in values)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())
