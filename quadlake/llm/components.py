"""Connected components of a table of links, on the executors.

Each vertex takes the least label among its own and its neighbours', then its label's label;
rounds go on until no label changes. Every round's labels are written to the scratch folder, and
the ones before are deleted. Counts alone come to the driver. Least labels are aggregated
before the shuffle, so a vertex with very many links costs no task much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """vertex, component (its least reachable vertex) of every vertex of ``links`` (a, b).

    Null ends are left out; links may repeat, and may join a vertex to itself.
    """
    sound = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = written(sound.select("a", "b").unionByName(sound.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("vertex"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("component").alias("near"))
        # Both the vertex and the vertex that labelled it hear of a lower label.
        told = labels.join(near, labels["vertex"] == near["a"]).select("vertex", "component", F.least("near", "component").alias("low"))
        up = told.groupBy("component").agg(F.min("low").alias("up")).select(F.col("component").alias("root"), "up")
        step = told.join(up, told["component"] == up["root"], "left").select("vertex", "component", F.least("low", F.coalesce("up", "low")).alias("next"))
        new = written(step, "labels")
        changed = not new.where("next <> component").isEmpty()
        forget(labels)
        labels = new.select("vertex", F.col("next").alias("component"))
        labels._quadlake_path = new._quadlake_path
        if not changed:
            forget(both)
            return labels
