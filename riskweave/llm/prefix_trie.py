"""Operator 11: the prefix trie of conversations, by range minima over sorted common prefixes.

Turns become digests of 16 bytes (SHA-256 of role and text, cut), so that a
conversation is a byte string and the order of such strings is a walk through
the trie. Equal conversations are one sequence with its members. Distinct
sequences are sorted by ranges; in each range neighbours' common lengths go into
a sparse table of range minima, and every candidate prefix (a sequence and a
depth beyond what it shares with the one before) binary-searches how far left
and right the minimum stays at its depth: these are its members, without any
stack. Counts over an interval are differences of prefix sums, the smallest
member a range minimum too.

A prefix that two neighbouring ranges share is *open*: each range gives its part
of it and grouping by the prefix's digest adds them up. There are at most two
open paths a range, whatever the number of rows.

Hot groups: copies of a conversation are packed into blocks of ids by sorted
ranges before they meet, and meet as a stream; conversations that share their
first turns are ranged by more turns (``even_prefix``). A conversation's digests
(20 bytes a turn with the word count) are held together, its texts never.

Defined cases: rows of a null conv_id are no conversation; null turns come
first, rows of the same turn by their digest, repeated rows stay; null and empty
role or text are alike; a conversation without turns is a member of the root
alone; texts of any length are digested whole; no rows give no nodes; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, small

WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest, and turns of a range: bound of a task's memory (about 100 bytes a turn).
TURN = 16
RANGE = 1 << 17
#: Bytes of joined ids in a block of copies.
BLOCK = 1 << 16
FAMILY, SHARED = 20, 4
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``digest`` (hexadecimal) and ``words``."""
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turns = rows.select(rows["conv_id"].cast("long").alias("conv_id"), F.struct(rows["turn"].cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("int").alias("words")).alias("t"))
    each = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # array_sort puts nulls in fields first, as the order asks for.
    return each.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(each: DataFrame) -> DataFrame:
    """``conv_id, seq, words``: the first h turns of the family's first conversation, then the own ones after h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    first = each.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, SHARED - 1).alias("head"))
    own = each.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), h.cast("int").alias("h"))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    both = own.hint("merge").join(first, "family", "left").select("conv_id", F.concat(head, rest).alias("t"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("seq"), F.col("t.words").alias("words"))


def sequences(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``seq, words, n, conv, ends``: distinct sequences, their members' number, the smallest one, and the hash of their joined ids."""
    order = ["key", "conv_id"]
    ranged = convs.withColumn("key", F.unhex(F.sha2("seq", 256))).repartitionByRange(parts(convs.sparkSession), *order).sortWithinPartitions(*order)
    kinds = {"key": pa.binary(), "conv": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "seq": pa.binary(), "words": pa.list_(pa.int32())}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, first = None, [], 0, None
        out: list[tuple] = []

        def done() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))
            out.clear()
            return batch

        for batch in batches:
            for k, one, seq, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ids and (k != key or held >= BLOCK):
                    out.append((key, first[0], len(ids), ",".join(ids).encode(), *first[1:]))
                    ids, held = [], 0
                if not ids:
                    key, first = k, (one, seq, words)
                ids.append(str(one))
                held += len(ids[-1]) + 1
            if len(out) >= 1000:
                yield done()
        if ids:
            out.append((key, first[0], len(ids), ",".join(ids).encode(), *first[1:]))
        if out:
            yield done()

    blocks = scratch.write(ranged.select("key", "conv_id", "seq", "words").mapInArrow(pack, "key binary, conv long, n long, ids binary, seq binary, words array<int>"), "blocks")
    met = blocks.repartition(parts(convs.sparkSession), "key").sortWithinPartitions("key", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["seq", "words", "n", "conv", "ends"], [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        key, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for k, conv, n, ids, seq, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if k != key:
                    if state:
                        out.append((*state[:4], state[4].hexdigest()))
                    key, state = k, [seq, words, n, conv, hashlib.sha256(ids)]
                else:
                    state[2] += n
                    state[4].update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*state[:4], state[4].hexdigest()), types)], names=names)

    return scratch.write(met.mapInArrow(join, "seq binary, words array<int>, n long, conv long, ends string"), "sequences")


def even_prefix(distinct: DataFrame, ranges: int, rows: int, first: int = 8) -> int:
    """How many turns a range key has to hold, doubled from ``first`` until no prefix stands in more than twice a range's rows."""
    longest, turns = (distinct.agg(F.max(F.octet_length("seq"))).first()[0] or 0) // TURN, first
    while turns < longest:
        most = distinct.groupBy(F.substring("seq", 1, TURN * turns)).count().agg(F.max("count")).first()[0] or 0
        if most <= max(1000, 2 * rows // ranges):
            break
        turns *= 2
    return turns


class RangeMinimum:
    """Sparse table: minima of all stretches of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the values from ``low`` to ``high``, both included."""
        out = np.empty(len(low), self.table[0].dtype)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k, values in enumerate(self.table):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(values[low[at]], values[high[at] + 1 - (1 << k)])
        return out

    def reach(self, at: np.ndarray, least: np.ndarray, side: int) -> np.ndarray:
        """From each place, the farthest one to that side (1: right, -1: left) before a value falls below ``least``.

        ``values[i]`` stands between places i - 1 and i. A binary search: ever shorter stretches are stepped over if their minimum allows it.
        """
        at, n = at.copy(), len(self.table[0])
        for k in range(len(self.table) - 1, -1, -1):
            step, values = 1 << k, self.table[k]
            low = at + 1 if side > 0 else at - step + 1
            inside = np.flatnonzero((low >= 1) & (low + step <= n))
            moves = inside[values[low[inside]] >= least[inside]]
            at[moves] += side * step
        return at


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    other = np.flatnonzero(x != y)
    return (int(other[0]) if len(other) else n) // TURN


def range_nodes(seqs: list[bytes], words: list[list[int]], n: np.ndarray, conv: np.ndarray, ends: list[str], before: int, after: int) -> dict[str, list]:
    """The nodes of one range of sorted distinct sequences.

    ``before``, ``after``: turns shared with the neighbouring ranges (-1: there is
    none). Open nodes, at most so deep on the first and last sequence, carry their
    digest, their path and this range's part; the others are whole, but for the
    number of an open parent (``up``: the parent's digest).
    """
    m = len(seqs)
    size = np.array([len(s) // TURN for s in seqs], np.int64)
    lcp = np.array([-1, *(common_turns(a, b) for a, b in zip(seqs, seqs[1:]))], np.int64)
    # Candidate prefixes, in the order of a walk: those that begin at a sequence.
    first = lcp + 1
    many = np.maximum(size - lcp, 0)
    offset = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(m), many)
    depth = np.arange(offset[-1]) - np.repeat(offset[:-1] - first, many)
    gaps, least = RangeMinimum(lcp), RangeMinimum(conv)
    left, right = gaps.reach(row, depth, -1), gaps.reach(row, depth, 1)
    up = np.maximum(depth - 1, 0)
    outer = gaps.reach(row, up, -1)
    parent = offset[outer] + up - first[outer]
    parent[depth == 0] = -1
    total = np.concatenate([[0], np.cumsum(n)])
    count, who = total[right + 1] - total[left], least.least(left, right)
    last = np.concatenate([[0], *(np.array([0, *w], np.int64)[f : f + k] for w, f, k in zip(words, first.tolist(), many.tolist()))])[1:]
    is_open = np.zeros(len(row), bool)
    for at, deep in ((0, before), (m - 1, after)):
        d = np.arange(deep + 1)
        on = gaps.reach(np.full(len(d), at), d, -1)
        is_open[offset[on] + d - first[on]] = True
    inside = ~is_open
    kids = np.bincount(parent[inside & (parent >= 0)], minlength=len(row))
    below = lambda own: np.concatenate([[0], np.cumsum(own)])  # noqa: E731  a subtree is a stretch of the walk
    leaves = below(inside & (kids == 0))
    saved = below(np.where(inside, (count - 1) * last, 0))
    here, stop = np.arange(len(row)), offset[right + 1]
    out: dict[str, list] = {
        "conv_id": who.tolist(), "depth": depth.tolist(), "parent_conv_id": [None if p < 0 or is_open[p] else int(who[p]) for p in parent.tolist()], "n_convs": count.tolist(), "n_children": kids.tolist(),
        "n_leaves": (leaves[stop] - leaves[here]).tolist(), "saved_tokens": (saved[stop] - saved[here]).tolist(),
        "ends_sha256": [ends[r] if size[r] == d else NONE for r, d in zip(row.tolist(), depth.tolist())],
    }
    keys: dict[int, bytes] = {}
    for i in np.flatnonzero(is_open).tolist():
        keys[i] = hashlib.sha256(seqs[row[i]][: TURN * depth[i]]).digest()
    out["up"] = [keys.get(p) if p >= 0 else None for p in parent.tolist()]
    out["key"] = [keys.get(i) for i in here.tolist()]
    out["own_words"] = last.tolist()
    out["path"] = [None] * len(row)
    for i in sorted(keys):  # a parent comes before its children
        out["path"][i] = [*(out["path"][parent[i]] if parent[i] >= 0 else []), keys[i]]
    return out


PART = f"{NODE}, up binary, key binary, own_words long, path array<binary>"
KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary())]


def edges(placed: DataFrame) -> DataFrame:
    """``part, before, after``: turns that a range shares with its neighbours; of every range only its first and last sequence are compared."""
    ends = placed.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    both = ends.select("part", "low", "high", F.lag("high").over(order).alias("prev"), F.lead("low").over(order).alias("next"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, low, high, prev, next_ = (c.to_pylist() for c in batch.columns)
            shared = lambda a, b: -1 if a is None or b is None else common_turns(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(map(shared, prev, low), pa.int64()), pa.array(map(shared, high, next_), pa.int64())], names=["part", "before", "after"])

    return both.mapInArrow(work, "part int, before long, after long")


def merged(open_parts: DataFrame) -> DataFrame:
    """Open nodes put together from their ranges' parts: ``key`` and the columns of a node, ``up`` for the parent."""
    total = lambda c: F.sum(c).alias(c)
    ends = F.max(F.when(F.col("ends_sha256") != NONE, F.col("ends_sha256"))).alias("ends_sha256")
    each = open_parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), ends, F.first("own_words").alias("own_words"), F.first("path").alias("path"))
    return each.withColumn("own", (F.col("n_convs") - 1) * F.col("own_words"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    each = scratch.write(conversations(rows), "conversations")
    distinct = sequences(rebuilt(each), scratch)
    scratch.drop("conversations", "blocks")
    n, turns = distinct.agg(F.count(F.lit(1)), F.sum(F.octet_length("seq") / TURN + 1)).first()
    ranges = max(parts(spark), -(-int(turns or 0) // RANGE))
    prefix = F.substring("seq", 1, TURN * even_prefix(distinct, ranges, n))
    ranged = distinct.withColumn("_prefix", prefix).repartitionByRange(ranges, "_prefix").drop("_prefix")
    placed = scratch.write(ranged.withColumn("part", F.spark_partition_id()), "placed")
    near = scratch.write(edges(placed), "edges")

    def work(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("seq", "words", "n", "conv", "ends")}
        order = sorted(range(table.num_rows), key=columns["seq"].__getitem__)
        seq, words, n, conv, ends = ([c[i] for i in order] for c in columns.values())
        found = range_nodes(seq, words, np.array(n, np.int64), np.array(conv, np.int64), ends, table.column("before")[0].as_py(), table.column("after")[0].as_py())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(found.items(), KINDS)})

    # ``near`` has a row for each range.
    nodes = scratch.write(placed.join(F.broadcast(near), "part").groupBy("part").applyInArrow(work, PART), "nodes")
    columns: list[Column] = [F.col(c.split()[0]) for c in NODE.split(", ")]
    inside = nodes.where("key IS NULL AND (up IS NULL)").select(columns)
    opened = scratch.write(merged(nodes.where("key IS NOT NULL")), "open")
    # Of an open node: open children, and what its open descendants (itself included) save.
    kids = opened.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    own = opened.select("own", F.explode("path").alias("key")).groupBy("key").agg(F.sum("own").alias("more"))
    more = scratch.write(own.hint("merge").join(kids, "key", "left"), "more")
    named = opened.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    top = opened.hint("merge").join(more, "key").withColumns({"n_children": F.col("n_children") + F.coalesce("kids", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.col("more"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NONE))})
    under = nodes.where("key IS NULL AND up IS NOT NULL")
    shape = lambda df: df.join(F.broadcast(named) if small(named) else named.hint("merge"), "up", "left").withColumn("parent_conv_id", F.col("up_conv")).select(columns)
    return inside.unionByName(shape(under)).unionByName(shape(top.withColumn("parent_conv_id", F.lit(None).cast("long"))))
