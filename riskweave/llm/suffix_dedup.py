"""Operator 6: long repeated byte strings by a run-length index.

Runs of 200-byte windows that share their least 32-byte gram (``repeats``)
bring together what can match. Each different run goes to a block of whole
groups once, or twice if it occurs more often, so that the index itself finds
the copy. A block's strings are sorted by suffix, by prefix doubling over the
whole block; of the Burrows-Wheeler transform only the runs are kept, with the
text position of every run's first and last row and the common length with the
row before or after (sampled run ends). Matching statistics stream from the
samples: at any position the longest match elsewhere is the value of the last
sampled position before it, less the distance. Windows whose match reaches 200
bytes are marked, at every place where their run occurs; nothing else removes
bytes.

Blocks hold about ``BLOCK_BYTES``, and a group at most ``GROUP`` strings of less
than 400 bytes: the grams of larger groups are lengthened (``repeats``).

The index compares bytes. Only that two runs are copies is told by a hash, the
128-bit xxh3 of their bytes, among runs of one gram.

Defined cases: null and empty texts have no bytes; texts shorter than 200 bytes
keep all; repeated rows are further occurrences, so both lose their windows;
null ids take part; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, keyed
from .repeats import PIECES, in_groups, shared_runs

LENGTH, GRAM = 200, 32
GROUP = 2_000
BLOCK_BYTES = 1 << 17


class RunLengthIndex:
    """Suffix order of several byte strings, kept as the runs of its transform and their sampled ends.

    The strings are one sequence, with an end sign after each: a byte that UTF-8
    never holds, and different for each string (the earlier the lower), so that
    no match crosses two strings.
    """

    END = 0xFF
    FIRST = 8  # bytes in the first sort key

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(t) + 1 for t in strings], np.int64)
        ends = np.cumsum(sizes)
        self.n = int(ends[-1])
        self.symbols = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        self.left = (np.repeat(ends, sizes) - np.arange(self.n) - 1).astype(np.int32)  # bytes to the own end sign
        first = np.concatenate([[0], ends[:-1]])
        order, levels = self._sort(int(sizes.max()))
        before = np.empty(self.n, np.int32)
        before[1:] = self.symbols[:-1]
        before[first] = -1 - np.arange(len(first))  # before a string's begin stands an end sign, each a run of its own
        before = before[order]
        change = np.flatnonzero(before[1:] != before[:-1])
        self.heads = self._samples(order, levels, np.append(0, change + 1), -1)
        self.tails = self._samples(order, levels, np.append(change, self.n - 1), 1)

    def _sort(self, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by prefix doubling of what is still tied, and the ranks of every level."""
        n, width = self.n, self.FIRST
        key = np.zeros(n + width, np.uint64)
        key[:n] = self.symbols
        for step in (1, 2, 4):
            key[:-step] = (key[:-step] << np.uint64(8 * step)) | key[step:]
        key = key[:n]
        short = np.flatnonzero(self.left < width)  # blank what follows the end sign
        key[short] &= ~((np.uint64(1) << (np.uint64(8) * (width - 1 - self.left[short]).astype(np.uint64))) - np.uint64(1))
        order = np.argsort(key)
        alone = self.left[order] < width
        ended = order[alone]
        order[alone] = ended[np.lexsort((ended, key[ended]))]  # equal keys with an end sign: by the order of the strings
        key = key[order]
        new = alone.copy()
        new[0] = True
        new[1:] |= alone[:-1] | (key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        rank = np.zeros(n + 1, np.int32)
        rank[order] = group + 1
        levels = [(width, rank)]
        while width < longest:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = order[slots]
            far = rank[at + width].astype(np.uint64)  # what is tied doesn't reach the end
            if n < 1 << 21:  # group, rank and row fit in one number, which sorts several times faster than an index does
                key = np.sort((group[slots].astype(np.uint64) << np.uint64(42)) | (far << np.uint64(21)) | np.arange(len(slots), dtype=np.uint64))
                at = at[(key & np.uint64((1 << 21) - 1)).astype(np.int64)]
                key >>= np.uint64(21)
            else:
                key = (group[slots].astype(np.uint64) << np.uint64(32)) | far
                by = np.argsort(key)
                key, at = key[by], at[by]
            order[slots] = at
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slots] = fresh
            group[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
            rank = rank.copy()
            rank[at] = group[slots] + 1
            width *= 2
            levels.append((width, rank))
        return order, levels

    def _samples(self, order: np.ndarray, levels: list, rows: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of the rows, ascending, and the common length with the row on that side."""
        other = rows + side
        valid = (other >= 0) & (other < self.n)
        at, next_ = order[rows], order[np.where(valid, other, rows)]
        length = np.zeros(len(rows), np.int32)
        for width, rank in reversed(levels):
            length += np.where(rank[np.minimum(at + length, self.n)] == rank[np.minimum(next_ + length, self.n)], width, 0).astype(np.int32)
        for _ in range(self.FIRST):
            x = self.symbols[np.minimum(at + length, self.n - 1)]
            length += (x == self.symbols[np.minimum(next_ + length, self.n - 1)]) & (x != self.END)
        length = np.where(valid, length, 0)
        by = np.argsort(at)
        return at[by], length[by]

    def matching_statistics(self) -> np.ndarray:
        """Of every byte, string after string, the longest match that starts at another one."""
        out, here = np.zeros(self.n, np.int64), np.arange(self.n)
        for at, length in (self.heads, self.tails):
            last = np.repeat(np.arange(len(at)), np.diff(np.append(at, self.n)))
            out = np.maximum(out, length[last] - (here - at[last]))
        return out[self.symbols != self.END]


def _strings(rows: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """The runs of ``contents`` with their bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                out += [(f["key"], f["content"], f["count"], f["at"], f["times"] > 1, data[f["start"] : f["start"] + f["count"] + length - 1]) for f in found]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "content", "count", "at", "several", "piece"])

    lists = contents.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "start", "count", "at", "times")).alias("found"))
    return rows.hint("merge").join(lists, "rid").select("text", "found").mapInArrow(work, PIECES)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of a mask begin, and their lengths."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def index_marks(pieces: DataFrame, length: int) -> DataFrame:
    """``level, key, content, first, many``: windows of the runs that match elsewhere, block by block of whole groups.

    Runs are shuffled by gram and sorted within a task, so a block is cut between two grams.
    """

    def mark(block: list[tuple]) -> pa.RecordBatch:
        once, twice = [b[4] for b in block], [b[4] for b in block if b[3]]
        begin = np.cumsum([0, *map(len, once)])
        long = RunLengthIndex(once + twice).matching_statistics()[: begin[-1]] >= length
        at, size = spans(long)  # no stretch crosses two strings: the last bytes of a string match less than ``length``
        which = np.searchsorted(begin, at, side="right") - 1
        key, level = (np.array([b[i] for b in block], np.int64)[which] for i in (0, 2))
        content = pa.array([block[i][1] for i in which.tolist()], pa.binary())
        columns = [level.astype(np.int32), key, content, (at - begin[which]).astype(np.int32), size.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["level", "key", "content", "first", "many"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, key = 0, None
        for batch in bounded(batches, 4):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key and size >= BLOCK_BYTES:
                    yield mark(block)
                    block, size = [], 0
                key = row[0]
                block.append(row)
                size += len(row[4]) * (2 if row[3] else 1)
        if block:
            yield mark(block)

    placed = pieces.repartition("key").sortWithinPartitions("key")
    return placed.select("key", "content", "level", "several", "piece").mapInArrow(work, "level int, key long, content binary, first int, many int")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every document."""
    scratch = Scratch(docs.sparkSession)
    rows, _ = keyed(docs, scratch)
    shared, contents = shared_runs(rows, length, gram, scratch)
    pieces = scratch.write(_strings(rows, contents, length), "pieces")
    grouped, inside = in_groups(pieces, length, gram, group, scratch)
    marked = scratch.write(index_marks(grouped, length), "marked")
    at = lambda level: marked.where(F.col("level") == level).drop("level")
    found = at(len(inside))
    for level in range(len(inside), 0, -1):  # back to the runs that were lengthened
        up = inside[level - 1].hint("merge").join(found, ["key", "content"])
        up = up.select(F.col("okey").alias("key"), F.col("ocontent").alias("content"), (F.col("first") + F.col("off")).alias("first"), "many")
        found = scratch.write(at(level - 1).unionByName(up), f"found-{level}")
    places = shared.hint("merge").join(found, ["key", "content"]).select("rid", (F.col("start") + F.col("first")).alias("start"), "many")
    marks = scratch.write(places, "marks")
    scratch.drop("pieces", "shared", "marked", *(f"{name}-{level}" for level in range(len(inside) + 1) for name in ("large", "sub", "subagain", "pieces", "found")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = text.encode()
                cell = batch.column(2)[i].values
                if cell is None:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                start, many = (cell.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + many - 1 + length, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(spans(gone)[0]), hashlib.sha256(kept).hexdigest()))
            n, removed, runs, sha = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    marked = rows.hint("merge").join(marks.groupBy("rid").agg(F.collect_list(F.struct("start", "many")).alias("marks")), "rid", "left")
    return marked.select("doc_id", "text", "marks").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
