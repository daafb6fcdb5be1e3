"""Operator 1: exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are packed where they are scanned into blocks of at most ``BLOCK``
rows, query rows into blocks of ``QUERIES``. Query blocks are copied to every
bucket of candidate blocks (the stated query set against all rows, in blocks);
a task holds one pair of blocks. A block is kept as postings by term
(dimension); each query's non-zero terms scatter ``weight * value`` into a
dense score array over the block. A partition selection keeps the k best of
each block, and a window over these few rows merges the blocks.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; vectors may differ in length (absent terms count 0); repeated
ids are separate candidates, never of a query of that id, and one query (the
least vector) where they are queries; ties go to the smaller id; a null id can't
be queried and isn't a candidate. Scores must fit a long: components are
expected below 2^25.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

BLOCK, QUERIES = 4096, 256
SCALE = 256


def integer_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(256 x) of every component, for vectors that take part."""
    x = table["embedding"].cast("array<double>")
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """``ids, lengths, flat``: rows packed to blocks of at most ``most``, as bytes of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                ids, vectors = piece.column(0).to_numpy(zero_copy_only=False), piece.column(1)
                lengths = np.array([len(v) for v in vectors], np.int64)
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in (ids, lengths, flat)], names=["ids", "lengths", "flat"]
                )

    return rows.mapInArrow(run, "ids binary, lengths binary, flat binary")


def postings(lengths: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """By term: the rows that hold it (None: all) and their values."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = flat != 0
    row, term, value = row[keep], term[keep], flat[keep]
    order = np.argsort(term, kind="stable")
    row, term, value = row[order], term[order], value[order]
    cuts = np.searchsorted(term, np.arange(int(lengths.max(initial=0)) + 1))
    return [(None if b - a == len(lengths) else row[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:])]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids: a partition finds the k-th score, ties at it are settled by id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _accumulate(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    def ints(cell) -> np.ndarray:
        return np.frombuffer(cell.as_buffer(), np.int64)

    for batch in batches:
        for i in range(batch.num_rows):
            ids, lengths, flat, q_ids, q_lengths, q_flat = (ints(batch.column(c)[i]) for c in range(6))
            lists = postings(lengths, flat)
            out_q, out_v, out_s = [], [], []
            starts = np.cumsum(q_lengths) - q_lengths
            for q, start, size in zip(q_ids, starts, q_lengths):
                vector = q_flat[start : start + size]
                score = np.zeros(len(ids), np.int64)
                for term in np.flatnonzero(vector[: len(lists)]):
                    where, value = lists[term]
                    if where is None:
                        score += vector[term] * value
                    else:
                        score[where] += vector[term] * value
                own = ids == q
                names, score = (ids[~own], score[~own]) if own.any() else (ids, score)
                at = best(score, names, k)
                out_q.append(np.full(len(at), q))
                out_v.append(names[at])
                out_s.append(score[at])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each row whose id ``every`` divides."""
    spark = table.sparkSession
    rows = integer_vectors(table)
    buckets = max(2 * parts(spark), 8)
    candidates = _pack(rows, BLOCK).withColumn("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = _pack(asked, QUERIES).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "lengths", "flat")))
    pairs = candidates.hint("merge").join(queries, "bucket").select("ids", "lengths", "flat", "q_ids", "q_lengths", "q_flat")
    found = pairs.mapInArrow(lambda batches: _accumulate(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
