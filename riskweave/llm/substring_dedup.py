"""Operator 10: substring dedup by level-wise doubling.

Every window of 9 words is counted first (35 halved twice, rounded up). Windows
that occur once drop out; a window of twice the length is a candidate only if
both its halves repeat. So 9 becomes 18, 18 becomes 35 (the last halves overlap
by a word), each level counts all its candidates, and the loop ends early when
no candidates survive.

Texts are packed into chunks of about ``CHUNK`` bytes, a table of buckets, so
that texts are shuffled once and later only the answers go to them. A level goes through two shuffles: a chunk sends the distinct hashes of its
candidates, cut by hash range into ``slices``; a slice counts in how many chunks
each hash stands and answers with one bit a hash; a chunk knows by itself which
hashes it holds twice. A window that stands in a third of all texts thus costs
one hash a chunk, and slices are even whatever the text. Words are hashed under
keys that are drawn anew for every call, so that no text can be written to
collide. A longer window's hash is an odd multiple of its first
half's, plus its second half's, mixed without loss: windows that differ in one
half alone never collide. Below the last level 40 bits of a hash are sent to its
slice: a collision only lets a candidate live on. The last level compares two
64-bit hashes of different keys; a pair of different windows passes both with a
probability of about 2^-128.

Defined cases: null, empty and blank texts have no words; texts shorter than a
window keep all words; repeated rows are further occurrences, so both lose
their windows; null ids take part; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, id_of, parts, text_of
from .hashing import WordHashes, mix, order_of

#: Bytes of text in a chunk, and windows in a slice: bounds of a task's memory.
CHUNK = 1 << 20
SLICE = 1 << 20
#: Words of a task that works on chunks.
TASK = 1 << 21
#: The first level's longest window.
FIRST = 9
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a hash that are sent below the last level, besides the slice's own bits: of a million hashes in a slice one in a million is taken for another.
SENT = 5
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels, ascending: ``window`` halved, rounded up, until ``first`` or less."""
    out = [window]
    while out[-1] > first:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """``chunk, ids, texts``: consecutive rows together, about ``size`` bytes (a longer text alone)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at, ids, texts), kinds)], names=["chunk", "ids", "texts"])

        for batch in bounded(batches, 1, size):
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(one)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield out()
                    at, ids, texts, held = at + 1, [], [], 0
        if ids:
            yield out()

    return docs.select(id_of(docs), text_of(docs)).mapInArrow(pack, "chunk long, ids array<long>, texts array<string>")


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte text begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~BLANK[data], [False]])))
    return edge[::2], edge[1::2]


class Windows:
    """The windows of a chunk of texts: their hashes level by level, and which of them are candidates."""

    def __init__(self, texts: list[bytes], levels: list[int], hashes: int, words: WordHashes):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        start, end = word_places(data)
        self.sizes = np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])))  # words of each text
        self.n, self.levels = len(start), levels
        self.left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(self.n)  # words to the end of the own text
        self.keys = [self._first(words.of(data, start, end, k), odd) for k, odd in enumerate(ODD[:hashes])]
        self.level = 0
        self.alive: np.ndarray | None = None

    def _first(self, symbols: np.ndarray, odd: np.uint64) -> np.ndarray:
        width = self.levels[0]
        out = np.full(max(0, self.n - width + 1), width, np.uint64)
        for j in range(width):
            out = out * odd + symbols[j : j + len(out)]
        return mix(out)

    def candidates(self) -> np.ndarray:
        """Where windows of this level start that may repeat: inside one text, and both halves repeat."""
        n = max(0, self.n - self.levels[self.level] + 1)
        if self.alive is None:
            return np.flatnonzero(self.left[:n] >= self.levels[0])
        step = self.levels[self.level] - self.levels[self.level - 1]
        return np.flatnonzero(self.alive[:n] & self.alive[step : step + n] & (self.left[:n] >= self.levels[self.level]))

    def survive(self, at: np.ndarray, repeated: np.ndarray) -> None:
        """On to the next level with the candidates that repeat."""
        self.alive = np.zeros(max(0, self.n - self.levels[self.level] + 1), bool)
        self.alive[at[repeated]] = True
        self.level += 1
        if self.level < len(self.levels):
            step = self.levels[self.level] - self.levels[self.level - 1]
            n = max(0, self.n - self.levels[self.level] + 1)
            self.keys = [mix(k[:n] * odd + k[step : step + n]) for k, odd in zip(self.keys, ODD)]

    def covered(self) -> np.ndarray:
        """Words in a surviving window of the last level."""
        edge = np.zeros(self.n + 1, np.int64)
        at = np.flatnonzero(self.alive)
        edge[at] += 1
        edge[at + self.levels[-1]] -= 1
        return np.cumsum(edge[:-1]) > 0


def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, which of them in this order are new, and the number of the distinct row for each row."""
    order = order_of(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, new, number


def cuts(key: np.ndarray, slices: int) -> np.ndarray:
    """Where the slices of ascending hashes begin and end."""
    return np.searchsorted(key >> np.uint64(1), (np.arange(slices + 1, dtype=np.float64) * (2.0**63 / slices)).astype(np.uint64))


def replayed(windows: Windows, answers: list | None, slices: int, upto: int):
    """Run the levels below ``upto`` again with the answers to them; returns the candidates of ``upto`` and their distinct keys."""
    told: dict[int, list] = {}
    for answer in answers or ():
        told.setdefault(answer["level"], []).append(answer)
    while True:
        at = windows.candidates()
        last = windows.level == len(windows.levels) - 1
        # Keys of one hash below the last level, as they were sent.
        keys = [k[at] for k in (windows.keys if last else windows.keys[:1])]
        order, new, number = distinct(keys)
        first = order[new]
        if windows.level == upto:
            return at, [k[first] for k in keys]
        repeated = np.bincount(number, minlength=len(first)) > 1
        edges = cuts(keys[0][first], slices)
        for answer in told.get(windows.level, ()):
            low, high = edges[answer["slice"]], edges[answer["slice"] + 1]
            repeated[low:high] |= np.unpackbits(np.frombuffer(answer["bits"], np.uint8))[: high - low].astype(bool)
        windows.survive(at, repeated[number])
        if windows.level == len(windows.levels):
            return None


def sent(packed: DataFrame, levels: list[int], level: int, slices: int, seed: int) -> DataFrame:
    """``slice, chunk, keys``: the distinct hashes of the candidates of one level, by hash range."""
    two = level == len(levels) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(seed)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, texts, answers = (batch.column(c)[i].as_py() for c in range(3))
                windows = Windows([t.encode() for t in texts], levels, 1 + two, words)
                _, keys = replayed(windows, answers, slices, level)
                edges = cuts(keys[0], slices)
                here = np.flatnonzero(np.diff(edges))
                if two:
                    out = [np.stack([k[edges[s] : edges[s + 1]] for k in keys]).tobytes() for s in here]
                else:
                    low = keys[0].view(np.uint8).reshape(-1, 8)[:, :SENT]
                    out = [low[edges[s] : edges[s + 1]].tobytes() for s in here]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(np.full(len(here), chunk)), pa.array(out, pa.binary())], names=["slice", "chunk", "keys"])

    return packed.select("chunk", "texts", "answers").mapInArrow(work, "slice int, chunk long, keys binary")


def answered(keys: DataFrame, level: int, hashes: int) -> DataFrame:
    """``level, slice, chunk, bits``: for the hashes of a chunk in a slice, whether other chunks hold them (null: none)."""

    def read(value: pa.BinaryScalar) -> np.ndarray:
        data = np.frombuffer(value.as_buffer(), np.uint8)
        if hashes > 1:
            return data.view(np.uint64).reshape(hashes, -1)
        out = np.zeros((len(data) // SENT, 8), np.uint8)
        out[:, :SENT] = data.reshape(-1, SENT)
        return out.view(np.uint64).reshape(1, -1)

    def work(table: pa.Table) -> pa.Table:
        rows = [read(x) for x in table.column("keys")]
        every = np.concatenate(rows, axis=1)
        _, _, number = distinct(list(every))
        common = (np.bincount(number) > 1)[number]  # a chunk sends a hash once
        ends = np.cumsum([r.shape[1] for r in rows])
        bits = [np.packbits(common[e - r.shape[1] : e]).tobytes() if common[e - r.shape[1] : e].any() else None for r, e in zip(rows, ends)]
        return pa.table({"level": pa.array(np.full(len(rows), level), pa.int32()), "slice": table.column("slice"), "chunk": table.column("chunk"), "bits": pa.array(bits, pa.binary())})

    return keys.groupBy("slice").applyInArrow(work, "level int, slice int, chunk long, bits binary")


def substring_dedup(docs: DataFrame, window: int = 35, with_text: bool = False, first: int = FIRST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document, and ``kept_text`` if ``with_text``.

    Words covered by a window that starts anywhere else are removed. Kept words
    are joined by one space; ``kept_text`` is the text itself where nothing went.
    """
    spark, scratch, levels = docs.sparkSession, Scratch(docs.sparkSession), lengths(window, first)
    # About; a set number of buckets, so that a task and its Arrow batches hold few chunks. It sizes tasks only.
    total = docs.select((F.octet_length(text_of(docs)) / 6).alias("n")).agg(F.sum("n")).first()[0] or 0
    slices = max(parts(spark), -(-int(total) // SLICE))
    tasks = max(parts(spark), -(-int(total) // TASK))
    table = scratch.bucketed(chunks(docs, chunk), "chunks", tasks, "chunk")
    answers, seed = None, secrets.randbits(63)

    def packed() -> DataFrame:
        if answers is None:
            return table.withColumn("answers", F.lit(None).cast("array<struct<level: int, slice: int, bits: binary>>"))
        told = answers.where("bits IS NOT NULL").repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("level", "slice", "bits")).alias("answers"))
        return table.hint("merge").join(told, "chunk", "left")

    for level in range(len(levels)):
        got = scratch.write(answered(sent(packed(), levels, level, slices, seed), level, 1 + (level == len(levels) - 1)), f"level-{level}")
        if not got.limit(1).count():  # no candidates survive
            break
        answers = got if answers is None else answers.unionByName(got)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(seed)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts, told = (batch.column(c)[i].as_py() for c in range(3))
                raw = [t.encode() for t in texts]
                windows = Windows(raw, levels, 2, words)
                replayed(windows, told, slices, len(levels))
                gone, out, at = windows.covered(), [], 0
                for data, text, size in zip(raw, texts, windows.sizes.tolist()):
                    w, here = data.split(), gone[at : at + size]
                    at += size
                    removed = int(here.sum())
                    kept = b" ".join(compress(w, (~here).tolist()) if removed else w)
                    out.append((len(w), removed, hashlib.sha256(kept).hexdigest(), (kept.decode() if removed else text) if with_text else None))
                n, removed, sha, kept = zip(*out)
                columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return packed().select("ids", "texts", "answers").mapInArrow(work, schema)
