"""Operator 7: toxicity by compression distance.

Zstandard dictionaries are trained on windows of labelled text: one on ordinary
documents, and two on toxic ones, a half of these each. Every window of a text
is compressed with the ordinary dictionary and with each toxic one, behind which
the ordinary one stands as well: ordinary words are then explained alike, and a
window that gets shorter holds what only toxic documents hold.

Most windows of a toxic document are ordinary, so the toxic dictionaries are
trained in rounds. A dictionary of one half tells which windows of the other half
get shorter by a length that hardly any window of ordinary documents set aside
reaches (their share at most ``FALSE`` of that of the toxic ones); these windows
train the next dictionary, which looks at the first half again. No half is judged
by its own windows, and copies of a document are in the same half. A logistic
calibration, learnt on documents scored by the other half's dictionary and on the
ordinary ones set aside, turns the gains over a text into a score, so that 0.5 is
the calibrated threshold.

Learning uses at most ``of_each`` documents of each class, and at most
``WINDOWS`` windows of each group of them (bounded, documented); scoring takes
every window of every text. Labels, lang, source and doc_id are no inputs of a
score.

Defined cases: null and empty texts get the score of a text without windows; very
long texts are scored by all their windows;
repeated rows are scored alike; without labels of both classes, or with too few
toxic documents for two halves, the score is the share of toxic labels (0.5
without any); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, id_of, text_of
from .labelled import held_out, sampled_texts

WIDTH, STEP = 48, 36
#: Windows that come to the driver: of each toxic half and of the ordinary documents set aside, and of those that train the ordinary dictionary.
WINDOWS, ORDINARY_WINDOWS = 20_000, 40_000
#: Bytes of the dictionaries, their segments, training rounds, share of ordinary among toxic picks.
ORDINARY_BYTES, TOXIC_BYTES = 98_304, 4_096
ORDINARY_SEGMENT, TOXIC_SEGMENT = 64, 16
ROUNDS, FALSE = 4, 0.15
N_FEATURES = 11
#: Groups of learning documents: two toxic halves, ordinary ones for the dictionary, ordinary ones set aside.
HALVES, ORDINARY, ASIDE = (0, 1), 2, 3


def copy_key(text: str) -> int:
    """The least hash of a text's three-word shingles, which near copies share for the most part."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[i : i + WIDTH] for i in range(0, max(1, len(data) - (WIDTH - STEP)), STEP)] if data else []


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary trained on the samples; their own bytes if they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=6 if segment < 32 else 8).as_bytes()
    except z.ZstdError:
        return b" ".join(samples)[-size:]


def compressor(dictionary: bytes):
    """The length of a window under a dictionary."""
    import zstandard as z

    # Lazy matching of three bytes and more; tables large enough to reach the whole dictionary.
    how = z.ZstdCompressionParameters(
        min_match=3, strategy=z.STRATEGY_LAZY, window_log=17, chain_log=17, hash_log=17, search_log=4, target_length=32,
        write_content_size=False, write_dict_id=False, write_checksum=False,
    )
    kept = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=how)
    compress = z.ZstdCompressor(dict_data=kept, compression_params=how).compress
    return lambda parts: np.fromiter((len(compress(p)) for p in parts), np.int64, len(parts))


def fit_dictionaries(groups: dict[int, list[bytes]]) -> tuple[bytes, bytes, bytes]:
    """The ordinary dictionary and those of the two toxic halves, from the groups' windows."""
    ordinary = trained(groups[ORDINARY], ORDINARY_BYTES, ORDINARY_SEGMENT)
    plain = {g: compressor(ordinary)(groups[g]) for g in (*HALVES, ASIDE)}
    picked = {0: groups[0], 1: groups[1]}
    for turn in range(ROUNDS):
        own, other = turn % 2, 1 - turn % 2
        length = compressor(trained(picked[own], TOXIC_BYTES, TOXIC_SEGMENT) + ordinary)
        gain, null = plain[other] - length(groups[other]), plain[ASIDE] - length(groups[ASIDE])
        fair = (c for c in range(1, 15) if (gain >= c).any() and (null >= c).mean() <= FALSE * (gain >= c).mean())
        at = np.flatnonzero(gain >= next(fair, int(np.quantile(gain, 0.98)) + 1))
        if len(at) < 8:
            at = np.argsort(-gain, kind="stable")[: max(8, len(gain) // 50)]
        picked[other] = [groups[other][i] for i in at]
    return ordinary, *(trained(picked[h], TOXIC_BYTES, TOXIC_SEGMENT) for h in HALVES)


class Distances:
    """Compressors of the three dictionaries, and a text's features."""

    def __init__(self, ordinary: bytes, *toxic: bytes):
        self.plain, self.toxic = compressor(ordinary), [compressor(t + ordinary) for t in toxic]

    def features(self, text: str, which: tuple[int, ...] = HALVES) -> np.ndarray:
        """Shape of the gains over all windows, the mean of the dictionaries ``which``."""
        parts = windows(text)
        if not parts:
            return np.zeros(N_FEATURES)
        plain, out = self.plain(parts), []
        for i in which:
            gain = np.sort(plain - self.toxic[i](parts))[::-1]
            up = np.maximum(gain, 0)
            share = lambda c: float((gain >= c).mean())  # noqa: B023, E731
            out.append([
                min(gain[0], 12), up.mean(), np.sqrt(up.mean()), share(1), np.sqrt(min((gain >= 1).sum(), 40)), min((gain >= 2).sum(), 10), share(2),
                min((gain >= 4).sum(), 5), share(4), min(up[:3].mean(), 12), np.log(len(gain)),
            ])
        return np.mean(np.array(out, float), axis=0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features and their squares; returns mean, deviation and weights."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    a = expand(x, mean, dev)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w


def expand(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / dev, -8, 8)
    return np.hstack([z, z**2, np.ones((len(x), 1))])


def _learning(sample: DataFrame) -> DataFrame:
    """``y, g, other, text``: sampled documents, one of each family of copies, with their group and the half whose dictionary may judge them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            keys = pa.array([copy_key(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["doc_id", "y", "text", "copy"])

    keyed = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, text string, copy long")
    one = keyed.groupBy("y", "copy").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    h = F.xxhash64(F.lit("part"), "copy")
    half = F.pmod(h, F.lit(2)).cast("int")
    aside = F.when(F.pmod(F.shiftright(h, 8), F.lit(10)) < 6, ORDINARY).otherwise(ASIDE)
    return one.select("y", F.when(F.col("y") == 1, half).otherwise(aside).alias("g"), (1 - half).alias("other"), "text")


def _windows(rows: DataFrame) -> DataFrame:
    """``g, w``: every window of the learning documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = [windows(t) for t in batch.column(1).to_pylist()]
            g = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([w for f in found for w in f], pa.binary())], names=["g", "w"])

    return rows.select("g", "text").mapInArrow(run, "g int, w binary")


def fit(docs: DataFrame, labels: DataFrame, of_each: int = 3_000) -> dict:
    """Dictionaries and calibration from at most ``of_each`` labelled documents of each class."""
    scratch = Scratch(docs.sparkSession)
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    share = 0.5 if share is None else float(share)
    rows = scratch.write(_learning(sampled_texts(docs, labels, "toxic", of_each)), "learning")
    parts = scratch.write(_windows(rows), "windows")
    groups = {}
    for g in (*HALVES, ORDINARY, ASIDE):
        some = parts.where(F.col("g") == g).orderBy(F.xxhash64("w"), "w").limit(ORDINARY_WINDOWS if g == ORDINARY else WINDOWS)
        groups[g] = [bytes(r["w"]) for r in some.select("w").collect()]
    if not all(groups.values()):
        scratch.drop("learning", "windows")
        return {"constant": share}
    shared = docs.sparkSession.sparkContext.broadcast(fit_dictionaries(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Distances(*shared.value)
        for batch in bounded(batches, 2):
            x = [made.features(t, (o,)) for t, o in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["y", "x"])

    judged = rows.where(F.col("g") != ORDINARY).select("y", "other", "text").mapInArrow(run, "y int, x array<double>").collect()
    scratch.drop("learning", "windows")
    judged.sort(key=lambda r: (r["y"], r["x"]))
    y, x = np.array([r["y"] for r in judged], float), np.array([r["x"] for r in judged])
    mean, dev, w = fit_logistic(x, y)
    # The sample holds the classes in other shares than the labels do: shift the intercept to the labels' odds.
    odds = lambda p: np.log(p / (1 - p))
    w[-1] += odds(min(max(share, 0.001), 0.999)) - odds(min(max(y.mean(), 0.001), 0.999))
    return {"shared": shared, "mean": mean, "dev": dev, "w": w}


def toxicity(docs: DataFrame, labels: DataFrame, of_each: int = 3_000, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document. The broadcast dictionaries have a fixed size (about 0.1 MB)."""
    model = fit(docs, labels, of_each)
    rows = docs.select(id_of(docs), text_of(docs))
    if "constant" in model:
        scored = rows.select("doc_id", F.lit(model["constant"]).alias("score"))
    else:
        shared, mean, dev, w = model["shared"], model["mean"], model["dev"], model["w"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Distances(*shared.value)
            for batch in bounded(batches, 1):
                x = np.array([made.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
                score = 1 / (1 + np.exp(-np.clip(expand(x, mean, dev) @ w, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

        scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
