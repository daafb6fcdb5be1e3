"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``id, comp`` (the smallest id reachable) for every id of ``edges`` (``a, b``, longs).

    Each round takes the least label among the neighbours, then the label of
    that label (pointer jumping), so rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle, so a vertex of very
    many edges costs a row a task. Every round's labels are a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.where("a <> b"), f"{name}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp"))
    labels, turn = scratch.write(labels, f"{name}-0"), 0
    while True:
        turn += 1
        seen = both.hint("merge").join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.hint("merge").join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        least = least.hint("merge").join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        new = scratch.write(least, f"{name}-{turn}")
        if not new.where("old <> comp").limit(1).count():
            return new.select("id", "comp")
        if turn > 1:
            scratch.drop(f"{name}-{turn - 2}")
        labels = new.select("id", "comp")
