"""Labelled rows for the classifiers: the learning fold, and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5. Null ids are not held out and not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learning_ids(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, y``: one row for each labelled id outside the held-out fold (several labels: the largest)."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("y"))
    rows = rows.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def sample_ids(labels: DataFrame, column: str, of_each: int) -> DataFrame:
    """The same few ids of each class every time: those with the smallest hashes, ``of_each`` at most."""
    rows = learning_ids(labels, column)
    picks = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(of_each) for y in (0, 1)]
    return picks[0].unionByName(picks[1])


def sampled_texts(docs: DataFrame, labels: DataFrame, column: str, of_each: int) -> DataFrame:
    """``doc_id, y, text`` of the sampled ids. The broadcast holds two times ``of_each`` ids at most."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sample_ids(labels, column, of_each)), "doc_id")
