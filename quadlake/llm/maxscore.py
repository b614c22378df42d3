"""Exact top-k search by inner product, with MaxScore.

Dimensions are the terms. A candidate's part for dimension d is taken from the least part
that its shard holds, so that parts are never negative; the term's bound is the largest
such part. For a query, terms in ascending order of bounds are non-essential as long as
their bounds together stay below the threshold, which is the k-th best score so far:
no candidate reaches it by non-essential terms alone. The essential terms' postings are traversed
for the whole shard; the other terms are probed, largest bounds first, only for candidates
whose partial score and remaining bound still compete. Shards' best are merged by a shuffle.

Queries and candidates are dealt out to pairs of a block of queries and a group of shards, by numbers that
are columns of data: the plan is the same for any number of queries, and a task holds one block and
one group. Thresholds carry on from shard to shard in a group. Of equal rows of a batch no
more than k are sent on, as more of them can be in no result.

Numbers are exact. Where a score might leave 62 bits, a shard's vectors are Python integers and all
terms are essential; a score beyond 64 bits is written as the nearest long, in its exact rank.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, as a query or a candidate, nor do rows with a null id, nor vectors with a component that is
not finite once scaled; vectors of another length
than the query's are no candidates of it; rows with the query's own id are no candidates;
repeated rows stand for themselves; ties go to the smaller id; fewer than k candidates: all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.llm.common import parallelism

#: Queries in a block, candidates in a group of shards (on average), and in a shard.
BLOCK, GROUP, SHARD = 16384, 65536, 8192
#: Numbers up to here are added without a check of each.
SAFE = 1 << 62


def integers(vectors: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of 64 bits, or Python's."""
    if not vectors.size or np.abs(vectors).max() < SAFE:
        return vectors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in vectors], object)


class Shard:
    """Candidates of one length, stored by dimension, with the range of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(integers(vectors)[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.reach = np.array([max(abs(int(a)), abs(int(b))) for a, b in zip(self.low, self.high, strict=True)], float)

    def search(self, query: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the shard's best k that reach ``threshold`` (None: no threshold yet)."""
        if 2 * float(self.reach @ np.abs(query).astype(float)) >= SAFE:
            return self._wide(query, own, k)
        query = query.astype(np.int64)
        base = np.where(query >= 0, query * self.low, query * self.high)  # the least parts
        bounds = np.where(query >= 0, query * self.high, query * self.low) - base
        order = np.argsort(bounds, kind="stable")
        floor = int(base.sum())
        sums = np.cumsum(bounds[order])
        cut = 0 if threshold is None else int(np.searchsorted(sums, np.clip(threshold - floor, -SAFE, SAFE), "left"))
        if cut == len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = query[order[cut:]] @ self.columns[order[cut:]] + int(base[order[:cut]].sum())
        alive = np.flatnonzero(self.ids != own)
        scores = scores[alive]
        for j in range(cut - 1, -1, -1):  # probe, while competitive
            keep = scores + int(sums[j]) >= threshold
            alive, scores = alive[keep], scores[keep]
            if not len(alive):
                break
            d = order[j]
            scores = scores + query[d] * self.columns[d][alive] - int(base[d])
        if threshold is not None:
            keep = scores >= threshold
            alive, scores = alive[keep], scores[keep]
        if len(alive) > k:
            kth = np.partition(scores, len(scores) - k)[-k]
            keep = scores >= kth
            alive, scores = alive[keep], scores[keep]
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]

    def _wide(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same where sums may not fit: every term is essential, numbers are Python's."""
        scores = [sum(int(q) * int(c) for q, c in zip(query, column, strict=True)) for column in self.columns.T]
        best = sorted((-s, int(i)) for s, i in zip(scores, self.ids, strict=True) if i != own)[:k]
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], object)


def _by_length(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each length, in order of ids and components: alike for alike rows."""
    values, ids = pa.concat_arrays(vectors.chunks), ids.to_numpy()
    ends = np.asarray(values.offsets)
    flat, lengths, out = np.asarray(values.values), np.diff(ends), []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        rows = flat[ends[at][:, None] + np.arange(n)]
        order = np.lexsort((*rows.T[::-1], ids[at]))
        out.append((ids[at][order], rows[order]))
    return out


#: Added to scores beyond a long before they are written as text of one width, whose order is theirs.
_LARGE = 1 << 2200


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out, first = [], 0
        held = {x.shape[1]: (ids, x) for ids, x in _by_length(rows.column("vec_id"), rows.column("vector"))} if rows.num_rows else {}
        for own, asked in _by_length(queries.column("vec_id"), queries.column("vector")) if held and queries.num_rows else []:
            number, first = first, first + len(own)
            if asked.shape[1] not in held:
                continue
            ids, vectors = held[asked.shape[1]]
            wanted = integers(asked)
            best = defaultdict(lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            for at in range(0, len(ids), SHARD):
                shard = Shard(ids[at : at + SHARD], vectors[at : at + SHARD])
                for i, query in enumerate(wanted):
                    have = best[i]
                    found = shard.search(query, own[i], k, int(have[1][k - 1]) if len(have[1]) >= k else None)
                    ids_, scores = np.append(have[0], found[0]), np.append(have[1], found[1])
                    order = np.lexsort((ids_, -scores))[:k] if scores.dtype != object else sorted(range(len(ids_)), key=lambda j: (-scores[j], ids_[j]))[:k]
                    best[i] = ids_[order], scores[order]
            out += [(number + i, int(own[i]), int(c), int(s)) for i, (found, scores) in best.items() for c, s in zip(found, scores, strict=True)]
        query, own, ids, scores = zip(*out, strict=True) if out else ((), (), (), ())
        low, high = -(1 << 63), (1 << 63) - 1
        text = [None if low < s < high else f"{s + _LARGE:0700d}" for s in scores]
        return pa.table({"query": pa.array(query, pa.int64()), "query_id": pa.array(own, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array([max(low, min(high, s)) for s in scores], pa.int64()), "exact": pa.array(text, pa.string())})

    return run


def _scaled(scale: int, k: int):
    """Of each batch, ids and floor(scale * x) of the rows that take part, equal rows k times at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            kept: dict[tuple[int, bytes], int] = defaultdict(int)
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                with np.errstate(all="ignore"):
                    x = np.floor(scale * np.asarray(v.values).astype(np.float64)) + 0.0
                key = (i, x.tobytes())
                kept[key] += 1
                if kept[key] <= k and np.isfinite(x).all():
                    ids.append(i), vectors.append(x)
            sizes = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0), *vectors])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], ["vec_id", "vector"])

    return run


def usable(table: DataFrame, scale: int, k: int) -> DataFrame:
    """vec_id and vector floor(scale * x) (whole doubles) of the rows that take part."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).mapInArrow(_scaled(scale, k), "vec_id long, vector array<double>")


def top_k(spark: SparkSession, table: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row that satisfies
    ``is_query``, a condition on the table's columns."""
    rows = usable(table, scale, k)
    # Every equal row is a query, and is answered: their numbers are dealt out below.
    queries = usable(table.where(is_query), scale, 1 << 62)
    blocks = max(1, -(-queries.count() // block))
    groups = max(-(-table.count() // GROUP), parallelism(spark))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("block", number(blocks)).withColumn("group", every(groups)).groupBy("block", "group")
    held = rows.withColumn("group", number(groups)).withColumn("block", every(blocks)).groupBy("block", "group")
    found = asked.cogroup(held).applyInArrow(lambda key, a, b: _numbered(key, _search(k)(a, b)), "block int, query long, query_id long, vec_id long, score long, exact string")
    window = Window.partitionBy("block", "query_id", "query").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _numbered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return table.add_column(0, "block", pa.array([key[0].as_py()] * table.num_rows, pa.int32()))
