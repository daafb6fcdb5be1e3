"""Operator 9: quality by a factorisation machine.

Inputs of the machine: hashed lower-case words (share of the text, bucket by
hash), structure statistics of the text in quantile bins, and the text's size.
score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the sum-of-squares identity, so a text is scored in time linear in its words.

Fitted by Adagrad on at most ``of_each`` labelled rows of each class (bounded,
documented; their compact features come to the driver, never their texts);
every whole text is scored. Labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts have all statistics 0 and are scored like
any text; very long texts are read whole; repeated rows are scored alike; without labels of both classes the
score is that class (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_of, text_of
from .labelled import held_out, sampled_texts
from .pretokens import Memo

WORDS = 1 << 13
STATS, BINS = 18, 8
WIDTH = WORDS + STATS * BINS
RANK = 8

#: Byte classes: 0 other ASCII sign, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence sign, 7 beyond ASCII.
CLASS = np.zeros(256, np.uint8)
for _class, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (9, 11, 12, 13, 32)), (5, (10,)), (6, b".,;:"), (7, range(128, 256))):
    CLASS[list(_bytes)] = _class

SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def statistics(data: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text: shares of byte classes, repetition, word and line shape, size."""
    if not words:
        return [0.0] * STATS
    n, size = len(words), len(data)
    kinds = np.bincount(CLASS[np.frombuffer(data, np.uint8)], minlength=8) / size
    letters = max(kinds[1] + kinds[2], 1e-9)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(not (w[-1:].isalnum() or w[-1] > 127) for w in words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.max(), kinds[2] / letters, kinds[0], kinds[3], kinds[6], kinds[7], kinds[5],
        len(counts) / n, max(counts.values()) / n, same / n, len(set(lines)) / max(len(lines), 1), len(lines) / n, ends / n,
        float((lengths == 1).mean()), sum(k for w, k in counts.items() if not w.translate(None, SIGNS)) / n,
    ]


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORDS


class Features:
    """Sparse rows: word buckets with the root of their share, statistics as one bin each."""

    def __init__(self, edges: np.ndarray | None):
        self.edges, self.memo = edges, Memo(bucket, 200_000)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
        words = data.split()
        ids, n = np.unique(np.fromiter(map(self.memo.__getitem__, data.lower().split()), np.int64, len(words)), return_counts=True)
        value = np.sqrt(n / max(1, len(words)))
        return ids, value, statistics(data, words)

    def row(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids, value, stats = self.words(data)
        return np.concatenate([ids, self.bins(np.array(stats))]), np.concatenate([value, np.full(STATS, 0.5)])

    def bins(self, stats: np.ndarray) -> np.ndarray:
        return WORDS + np.arange(STATS) * BINS + (stats[:, None] > self.edges).sum(1)


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        z = self.bias + self.w[ids] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.08, ridge: float = 2e-4, seed: int = 7) -> Machine:
    """Mini-batch Adagrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK)), 0.0
    gw, gv, gb = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            ids = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            sizes = np.array([len(rows[i][0]) for i in batch])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[ids] * x[:, None]
            sums = np.add.reduceat(vx, first)
            z = bias + np.add.reduceat(w[ids] * x, first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
            each = np.repeat(err, sizes) * x
            used, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, each) + ridge * w[used]
            slope = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(inverse, slope[:, f]) for f in range(RANK)], 1) + ridge * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            bias -= rate * err.sum() / np.sqrt(gb)
    return Machine(bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, of_each: int = 4_000) -> Machine | float:
    sample = sampled_texts(docs, labels, "quality", of_each).select("y", "text")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(None)
        for batch in bounded(batches, 1):
            got = [make.words(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0].astype(np.int16).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["y", "ids", "x", "stats"],
            )

    got = sample.mapInArrow(compact, "y int, ids binary, x binary, stats array<double>").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["ids"]), bytes(r["x"])))
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    stats = np.array([r["stats"] for r in got])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    make = Features(edges)
    rows = [
        (np.concatenate([np.frombuffer(r["ids"], np.int16).astype(np.int64), make.bins(s)]), np.concatenate([np.frombuffer(r["x"], np.float32).astype(float), np.full(STATS, 0.5)]))
        for r, s in zip(got, stats)
    ]
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    machine = train(rows, y, weight)
    machine.edges = edges
    return machine


def quality(docs: DataFrame, labels: DataFrame, of_each: int = 4_000, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document. The broadcast machine has a fixed size (under 1 MB)."""
    scored = score_column(docs.select(id_of(docs), text_of(docs)), fit(docs, labels, of_each))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_column(rows: DataFrame, model: Machine | float, name: str = "score") -> DataFrame:
    """All columns of ``rows`` and, as ``name``, the score of its column ``text``."""
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    shared = rows.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v, model.edges))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w, v, edges = shared.value
        machine, make = Machine(bias, w, v), Features(edges)
        for batch in bounded(batches, at):
            out = [machine.score(*make.row((t or "").encode())) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*rows.schema.fields]).add(name, DoubleType())
    return rows.mapInArrow(run, schema)
