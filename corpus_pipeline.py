"""A corpus pipeline of four stages over ``documents``: toxic documents go, one document of each
near-duplicate group stays, bytes that repeat a smaller document's go, the rest is packed.

Each stage works on all rows that its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``. Before a stage the executors give back what memory their heaps have free.

Defined results: a null text counts as empty (and is empty after ``cut_repeats``); rows with a null id go if they are toxic, else
stay: they are in no group of near duplicates, lose no bytes and are packed under a null id. Repeated rows are
judged each; they have one id, so all of them stay or go, and they take no bytes from each other. Of ties (equal
texts) the least id stays. Empty tables give empty tables. Extra columns are kept to the last stage, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import jaccard, packing, suffix, toxicity
from quadlake.llm.common import settle, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is fitted on the labels of these documents."""
    settle(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Columns are known by their places meanwhile, so that their names cannot clash with the score.
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    return toxicity.score(docs.toDF(*names), model).where("score < 0.5").drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates."""
    settle(spark)
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat a smaller document's. A character that loses some of
    its bytes goes wholly; a document that loses all its text stays, with an empty one."""
    settle(spark)
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(_valid("kept"))
    kept = suffix.dedup(docs.toDF(*names), characters=True).withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn(names[docs.columns.index("n_chars")], F.length("text").cast("long"))
    return kept.select(*names).toDF(*docs.columns)


def _valid(column: str):
    """A binary column as text, without byte sequences that are not UTF-8. U+FFFD of the input is
    written as \\x01b (and \\x01 as \\x01a) while what is not valid goes."""
    text = F.col(column).cast("string")
    for a, b in (("\x01", "\x01a"), ("\ufffd", "\x01b")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(F.try_validate_utf8(F.make_valid_utf8(text)), F.lit("\ufffd"), F.lit(""))
    for a, b in (("\x01b", "\ufffd"), ("\x01a", "\x01")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    settle(spark)
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: No SQL: the classifier, the links and the packing are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = written(out, f"stage-{name}")
    return out
