"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes ratios.

Features are hashed n-grams of the lower-cased text's characters (code points). For each, the log ratio
of its smoothed document rates in toxic and other training texts is its scale; the features
whose rates differ most (by a z statistic) are kept, and a logistic regression is trained on
presence times scale. Only labelled texts train; the text alone is scored.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each class, those with the
least hash of their id, weighted back to the classes' shares. That bounds what the driver
holds: one text for each id (the least, where an id has several). Scoring is one pass over all texts, without a shuffle.

Defined results: null text is empty and gets the score of no features; a document with
several labels counts as toxic if one is 1; null labels and null ids train nothing; a null
id counts as held out; without labelled rows of both classes the score is the share of
toxic ones (0 with none). Repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import slices, text_of, texts

SAMPLE, KEPT, BITS, ORDERS, LEAST = 3000, 1024, 20, (3, 4, 5, 6), 4


@dataclass
class Model:
    """Place of each hashed n-gram in ``weights`` (0: none), weights with 0 in front, intercept."""

    place: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        z = self.intercept
        if len(self.weights) > 1:
            hits = np.concatenate([p[p > 0] for p in (self.place[g] for g in grams(text))])
            z += float(self.weights[np.unique(hits)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def prepared(text: bytes) -> str:
    return text.decode("utf-8", "replace").lower()


def grams(text: str) -> list[np.ndarray]:
    """Hashes of the n-grams of characters, of each order; a space stands before and after the text."""
    x = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    out, h = [], x
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                out.append((mixed >> np.uint64(64 - BITS)).astype(np.uint32))
    return out or [np.zeros(0, np.uint32)]


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept out of training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(rows: list[tuple[bytes, int]], share: float, rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Fit on (text, label) rows; ``share`` is the share of label 1 in all labelled rows."""
    place = np.zeros(1 << BITS, np.int32)
    labels = np.array([y for _, y in rows], bool)
    if not labels.any() or labels.all():
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(place, np.zeros(1), float(np.log(p / (1 - p))))
    counts = np.zeros((2, 1 << BITS), np.int32)
    for text, y in rows:
        counts[int(y)][np.unique(np.concatenate(grams(prepared(text))))] += 1
    n = np.array([(~labels).sum(), labels.sum()], float)
    rates = (counts + 0.5) / (n + 1)[:, None]
    ratio = np.log(rates[1] / rates[0])
    pooled = counts.sum(axis=0) / n.sum()
    z = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]) + 1e-9)
    z[counts.sum(axis=0) < LEAST] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:KEPT])
    kept = kept[z[kept] > 0]
    place[kept] = np.arange(1, len(kept) + 1)
    scale = ratio[kept]
    found = [np.unique(np.concatenate([p[p > 0] for p in (place[g] for g in grams(prepared(t)))])) - 1 for t, _ in rows]
    feature = np.concatenate(found)
    row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    x = scale[feature]
    weight = np.where(labels, share / n[1], (1 - share) / n[0])
    w, b, y = np.zeros(len(kept)), float(np.log(share / (1 - share))), labels.astype(float)
    first, second, b1, b2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0.9, 0.999
    for step in range(1, rounds + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[feature] * x, len(rows)), -500, 500)))
        gap = weight * (p - y)
        g = np.append(np.bincount(feature, gap[row] * x, len(kept)) + ridge * w / len(kept) ** 0.5, gap.sum())
        first, second = b1 * first + (1 - b1) * g, b2 * second + (1 - b2) * g * g
        move = 0.05 * (first / (1 - b1**step)) / (np.sqrt(second / (1 - b2**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(place, np.concatenate([[0.0], w * scale]), float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # two bounded samples of ids
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(r.text.encode("utf-8", "replace"), r.toxic) for r in rows], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` (an own column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                scores = pa.array([own.score(prepared(x)) for x in texts(part.column("text"))], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*names, "score"])

    kind = docs.select(*names).schema.add("score", "double")
    return docs.select(*names).mapInArrow(run, kind)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every text."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
