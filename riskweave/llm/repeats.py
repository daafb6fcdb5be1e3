"""Runs of windows that may start more than once in a corpus: how operator 6 routes text to its blocks.

A window is ``window`` consecutive bytes of one document. Its *gram* is the
least hash of ``gram`` bytes in it. Equal windows hold their gram at the same
offset, so windows of one document that share it form a *run*, and a window can
repeat only if the gram of its run does. A run is a row of a few numbers: the
gram's hash, the 128-bit xxh3 of the run's bytes, its place. Gram hashes only
route: different grams of one hash share a group, no more.

A gram with very many different surroundings (a common line) is lengthened
without loss: of the bytes around it a window holds at least half on one side,
so its windows go, by side, to runs of a gram that is longer by that half. Most
of these stand alone and drop out; the rest is lengthened again while a group
is too large. At full length a group has one content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded
from .hashing import Roller, byte_numbers, mix

#: Bytes of a text that are hashed at once; longer texts go by pieces that overlap by a window.
PIECE = 1 << 19
_POSITION = np.uint64((1 << 24) - 1)
RUN = "key long, content binary, rid long, start int, count int, at int"
PIECES = "key long, content binary, count int, at int, several boolean, piece binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def contents(data: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Of stretches of bytes, their hashes."""
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]


def runs(data: bytes, numbers: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """``key, start, count, at`` of every run of windows; ``at``: where the gram lies, from the start."""
    symbols = numbers[np.frombuffer(data, np.uint8)]
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(1, len(symbols) - window + 1), PIECE):
        piece = symbols[base : base + PIECE + window - 1]
        if len(piece) < window:
            break
        roller = Roller(piece)
        grams = roller.all(gram)
        # Hash above, position below: the least is the leftmost of the least grams.
        packed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        where = (sliding_min(packed, window - gram + 1) & _POSITION).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        end = np.append(start[1:], len(where))
        out.append((grams[where[start]], start + base, end - start, where[start] - start))
    if not out:
        return [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
    return [np.concatenate(x) for x in zip(*out)]


def halves(symbols: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Runs, whose grams have ``gram`` bytes, as runs of grams longer by half of what is left of the window.

    ``row, key, off, count, at``: of which run each is, and the first of its windows there.
    """
    half = (window - gram + 1) // 2
    roller, every = Roller(symbols), np.arange(len(start))
    left = np.clip(at - half + 1, 0, count)  # windows that begin so early that they hold ``half`` before the gram
    core = start + at
    out = []
    for side, (off, many, where, low, high) in enumerate(((0 * left, left, at - half, core - half, core + gram), (left, count - left, at - left, core, core + gram + half))):
        some = many > 0
        off, many, where, low, high = (x[some] for x in (off, many, where, low, high))
        out.append((every[some], mix(roller.some(low, high) + np.uint64(side)), off, many, where))
    return [np.concatenate(x) for x in zip(*out)]


def _batch(rids: np.ndarray, texts: list[bytes], found: list[list[np.ndarray]], window: int) -> pa.RecordBatch:
    key, start, count, at = (np.concatenate([f[i] for f in found]) for i in range(4))
    content = [c for t, f in zip(texts, found) for c in contents(t, f[1], f[1] + f[2] - 1 + window)]
    columns = [key.view(np.int64), pa.array(content, pa.binary()), np.repeat(rids, [len(f[0]) for f in found]), start.astype(np.int32), count.astype(np.int32), at.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "content", "rid", "start", "count", "at"])


def run_table(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """The runs of all texts (``rid, text``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_numbers()
        for batch in bounded(batches, 1):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield _batch(batch.column(0).to_numpy(), texts, [runs(t, table, window, gram) for t in texts], window)

    return rows.select("rid", "text").mapInArrow(work, RUN)


def lengthened(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs given by their bytes (``PIECES``), with longer grams; ``okey, ocontent, off``: of which run and from which window on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 5, PIECE):
            texts = batch.column(5).to_pylist()
            start = np.cumsum([0, *map(len, texts)])[:-1]
            key, count, at = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
            row, new, off, many, where = halves(byte_numbers()[np.frombuffer(b"".join(texts), np.uint8)], start, count, at, window, gram)
            cut = [texts[r][o : o + m - 1 + window] for r, o, m in zip(row.tolist(), off.tolist(), many.tolist())]
            same = pa.array([xxhash.xxh3_128_digest(c) for c in cut], pa.binary())
            columns = [new.view(np.int64), same, many.astype(np.int32), where.astype(np.int32), batch.column(4).to_numpy(zero_copy_only=False)[row], pa.array(cut, pa.binary()), key[row], batch.column(1).take(pa.array(row)), off.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "content", "count", "at", "several", "piece", "okey", "ocontent", "off"])

    return pieces.select("key", "content", "count", "at", "several", "piece").mapInArrow(work, f"{PIECES}, okey long, ocontent binary, off int")


def shared_runs(rows: DataFrame, window: int, gram: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``shared`` (all runs whose gram occurs again) and ``contents`` (``key, content, rid, start, count, at, times``: a place of each different run, and how often it occurs)."""
    table = scratch.write(run_table(rows, window, gram), "runs")
    # Written apart, so that the join may split a hot gram's rows.
    again = scratch.write(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "again")
    shared = scratch.write(table.hint("merge").join(again, "key"), "shared")
    scratch.drop("runs", "again")
    each = shared.groupBy("key", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", "start", "count", "at")).alias("one"))
    return shared.select("key", "content", "rid", "start"), each.select("key", "content", "times", "one.*")


def in_groups(pieces: DataFrame, window: int, gram: int, group: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """``pieces`` and their ``level``, in groups of ``group`` runs at most, and for each level beyond 0 where its runs lie in those of the level before."""
    todo, parts, places = pieces, [], []
    while True:
        level = len(places)
        large = scratch.write(todo.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("key"), f"large-{level}")
        some = bool(large.limit(1).count())
        parts.append((todo.hint("merge").join(large, "key", "left_anti") if some else todo).withColumn("level", F.lit(level)))
        if not some:
            break
        sub = scratch.write(lengthened(todo.hint("merge").join(large, "key", "left_semi"), window, gram), f"sub-{level}")
        again = sub.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("s")).where("n > 1 OR s").select("key")
        kept = sub.hint("merge").join(scratch.write(again, f"subagain-{level}"), "key")
        one = kept.groupBy("key", "content").agg(F.min(F.struct("count", "at", "piece")).alias("one"), (F.max("several") | (F.count(F.lit(1)) > 1)).alias("several"))
        todo = scratch.write(one.select("key", "content", "one.count", "one.at", "several", "one.piece"), f"pieces-{level + 1}")
        places.append(sub.select("key", "content", "okey", "ocontent", "off"))
        gram += (window - gram + 1) // 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, places
