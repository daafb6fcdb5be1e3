"""Operator 12: a Merkle manifest of a dataset, with octopus multiproofs.

Rows are leaves, ordered by id within their source; 16 neighbours become a node
until one is left, the source's subroot; the subroots become the root in the
same way. Leaves and nodes are made by DataFrame functions, a shuffle a level.

Proofs are made by leaf partitions, blocks of ``SPAN`` consecutive leaves of a
source. A block works out which node coordinates its leaves' proofs need and
cannot be derived from its own leaves (the minimal union: of all leaves of a
block these are the siblings above it only), fetches each once by a join,
derives the shared interior nodes, and expands the proof of every leaf locally.
A block is bounded, so a source that holds a third of all rows is many blocks.
Coordinates near a root are wanted by many blocks; their nodes are few, and the
levels that are small by count are broadcast.

Defined cases: a null value is ``-``; null sources are a source of their own,
the first; null ids come first and are never tampered with; rows of equal source
and id go by their leaf, so repeated rows are leaves side by side; a source with
one row has that leaf for subroot, a single source its subroot for root; texts
of any length are hashed whole; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, id_of, light, parts

ARITY = 16
#: Leaves of a block: bound of a task's memory (about 30 MB with the proofs).
SPAN = ARITY**3
#: The tree over the subroots, beside the sources' trees 0, 1, ...
TOP = -1
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of ``monotonically_increasing_id``: the partition above, the row below.
ROW_BITS = 33


def digest(*values: Column) -> Column:
    """SHA-256 of the values, each with its byte count."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, values)).cast("binary"), 256))


def hexed(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, tampered``: digests of every row and, for ids that the rule picks, of the row with its A-Z lower-cased."""
    source, lang, n_chars, text = (docs[c] for c in ("source", "lang", "n_chars", "text"))
    one = id_of(docs)
    key = docs["doc_id"].cast("long")
    other = digest(key, source, lang, n_chars, F.translate(text.cast("string"), LETTERS, LETTERS.lower()))
    return docs.select(one, source.cast("string").alias("source"), digest(key, source, lang, n_chars, text).alias("leaf"), F.when(F.crc32(key.cast("string").cast("binary")) % 5 == 0, other).alias("tampered"))


def in_order(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``number`` 0, 1, ... in that order.

    Sorted by ranges and written; a row's number is that within its range and the
    count of the ranges before. The counts are a row for each range.
    """
    n = parts(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = scratch.write(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_at", ROW_BITS)
    counts = sorted(tuple(r) for r in table.groupBy(part.alias("part")).count().collect())
    before, total = {}, 0
    for k, count in counts:
        before[k], total = total, total + count
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part long, _before long")
    both = table.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return both.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("_at", "_part", "_before")


def levels(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of all trees above ``leaves`` (``tree, pos, n, digest``; ``n``: nodes of the level), lowest first."""
    out, now, most = [], leaves, leaves.agg(F.max("n")).first()[0] or 0
    run = F.floor(F.col("pos") / ARITY).cast("long").alias("pos")
    children = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    up = F.unhex(F.sha2(F.array_join(F.transform(children, lambda x: hexed(x["digest"])), "").cast("binary"), 256))
    while most > 1:
        now = now.where("n > 1").groupBy("tree", run).agg(F.ceil(F.first("n") / ARITY).cast("long").alias("n"), up.alias("digest"))
        now = scratch.write(now.select("tree", "pos", "n", "digest"), f"{name}-{len(out) + 1}")
        out.append(now)
        most = -(-most // ARITY)
    return out


def missing(wanted: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Level by level the coordinates that the proofs of the wanted leaves of a tree of ``n`` need and cannot derive."""
    have, out, level = np.unique(wanted), [], 0
    while n > 1:
        runs = np.unique(have // ARITY)
        every = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(every[every < n], have, assume_unique=True)))
        have, n, level = runs, -(-n // ARITY), level + 1
    return out


def coordinates(wanted: DataFrame, sources: int) -> DataFrame:
    """``tree, block, of, level, pos``: what each block of wanted leaves (``tree, block, pos, n``) has to fetch, each once."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        found = [(tree, level, pos) for level, pos in missing(table.column("pos").to_numpy(), table.column("n")[0].as_py())]
        found += [(TOP, level, pos) for level, pos in missing(np.array([tree]), sources)]
        sizes = [len(p) for _, _, p in found]
        every = np.concatenate([np.empty(0, np.int64), *(p for _, _, p in found)])
        of, level = (np.repeat(np.array([f[i] for f in found], np.int64), sizes) for i in (0, 1))
        return pa.table({"tree": np.full(len(every), tree), "block": np.full(len(every), block), "of": of, "level": level.astype(np.int32), "pos": every})

    return wanted.groupBy("tree", "block").applyInArrow(work, "tree long, block long, of long, level int, pos long")


def fetched(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, block, of, level, pos, digest``: the coordinates with their nodes' digests. Levels that are small together, from the roots down, are broadcast."""
    height = (F.col("level") + F.when(F.col("tree") == TOP, 1000).otherwise(0)).alias("height")
    low, held = None, 0
    for h, count in sorted((tuple(r) for r in nodes.groupBy(height).count().collect()), reverse=True):
        if held + count > BROADCAST_ROWS:
            break
        low, held = h, held + count
    nodes, wanted = nodes.withColumnRenamed("tree", "of"), wanted.withColumn("height", F.col("level") + F.when(F.col("of") == TOP, 1000).otherwise(0))
    nodes = nodes.withColumn("height", F.col("level") + F.when(F.col("of") == TOP, 1000).otherwise(0))
    on, columns = ["of", "level", "pos"], ["tree", "block", "of", "level", "pos", "digest"]
    out = None
    if low is not None:
        out = wanted.where(F.col("height") >= low).drop("height").join(F.broadcast(nodes.where(F.col("height") >= low).drop("height")), on).select(columns)
    rest = wanted if low is None else wanted.where(F.col("height") < low)
    under = rest.drop("height").hint("merge").join(nodes.drop("height"), on).select(columns)
    return under if out is None else out.unionByName(under)


class Climb:
    """The way from some leaves to their root: derived interior nodes, and the siblings of each node on it."""

    def __init__(self, pos: list[int], hexes: list[str], n: int, got: dict[tuple[int, int], str], level: int = 0):
        self.steps: list[dict[int, str]] = []  # for each level, the runs met: their members' digests end to end
        now = dict(zip(pos, hexes))
        while n > 1:
            runs = {p // ARITY for p in now}
            member = lambda p, now=now, level=level: now[p] if p in now else got[level, p]
            self.steps.append({r: "".join(map(member, range(r * ARITY, min(n, r * ARITY + ARITY)))) for r in runs})
            now = {r: hashlib.sha256(s.encode()).hexdigest() for r, s in self.steps[-1].items()}
            n, level = -(-n // ARITY), level + 1
        self.top = now[0] if self.steps else hexes[0]

    def path(self, pos: int) -> list[tuple[str, str]]:
        """What stands left and right of the nodes on the way, level by level."""
        out = []
        for step in self.steps:
            run, at = divmod(pos, ARITY)
            s = step[run]
            out.append((s[: 64 * at], s[64 * at + 64 :]))
            pos = run
        return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def proofs(leaves: DataFrame, found: DataFrame, sources: int, root: str | None, with_siblings: bool) -> DataFrame:
    """The proof of every leaf, expanded block by block from the leaves of the block and what was fetched for it."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", siblings string" * with_siblings

    def work(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        got: dict[bool, dict[tuple[int, int], str]] = {False: {}, True: {}}
        for of, level, pos, d in zip(*(theirs.column(c).to_pylist() for c in ("of", "level", "pos", "digest"))):
            got[of == TOP][level, pos] = d.hex()
        if not mine.num_rows:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(schema.split(", "), kinds)})
        pos, leaf, other = (mine.column(c).to_pylist() for c in ("pos", "leaf", "tampered"))
        hexes = [x.hex() for x in leaf]
        inside = Climb(pos, hexes, mine.column("n")[0].as_py(), got[False])
        above = Climb([tree], [inside.top], sources, got[True])
        over, out = above.path(tree), []
        for p, h, t in zip(pos, hexes, other):
            path = inside.path(p) + over
            siblings = "".join(a + b for a, b in path)
            folded = fold(h if t is None else t.hex(), path)
            out.append((h, inside.top, root, hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == root, *([siblings] if with_siblings else [])))
        columns = [mine.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds[1:]))]
        return pa.table(dict(zip((f.split()[0] for f in schema.split(", ")), columns)))

    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.string()] * with_siblings]
    return leaves.groupBy("tree", "block").cogroup(found.groupBy("tree", "block")).applyInArrow(work, schema)


def manifest(docs: DataFrame, wanted: Column | None = None, with_siblings: bool = False) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, and the ``siblings`` themselves if asked for.

    ``wanted``: a condition on ``doc_id`` and ``source``; only the leaves for which
    it holds get proofs, and their blocks fetch what these don't derive.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.write(leaf_rows(docs), "leaves")
    first = lambda c: F.col(c).asc_nulls_first()
    # The last key deals out repeated rows; these are alike, so their order doesn't matter.
    placed = in_order(rows.withColumn("_tie", F.monotonically_increasing_id()), [first("source"), first("doc_id"), first("leaf"), first("_tie")], scratch, "placed")
    each = scratch.write(placed.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "each")
    sources = scratch.write(in_order(each, [first("source")], scratch, "sources").select(F.col("source").alias("_source"), F.col("number").alias("tree"), "first", "n"), "numbers")
    n_sources = sources.count()
    with_tree = placed.join(F.broadcast(sources) if light(sources, "_source") else sources.hint("merge"), F.col("source").eqNullSafe(F.col("_source")))
    pos = F.col("number") - F.col("first")
    leaves = scratch.write(with_tree.select("doc_id", "source", "leaf", "tampered", "tree", pos.alias("pos"), F.floor(pos / SPAN).cast("long").alias("block"), "n"), "trees")
    scratch.drop("leaves", "placed", "each")
    ground = leaves.select("tree", "pos", "n", F.col("leaf").alias("digest"))
    inner = levels(ground, scratch, "inner")
    tops = ground.where("n = 1")
    for level in inner:
        tops = tops.unionByName(level.where("n = 1"))
    over = scratch.write(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest"), "over-0")
    outer = levels(over, scratch, "over")
    root = ([over, *outer][-1]).first()
    asked = leaves if wanted is None else leaves.where(wanted)
    named = [(n, k) for k, n in enumerate([ground, *inner]) if k or wanted is not None] + [(n, k) for k, n in enumerate([over, *outer])]
    nodes = None
    for table, k in named:
        table = table.select("tree", F.lit(k).alias("level"), "pos", "digest")
        nodes = table if nodes is None else nodes.unionByName(table)
    coords = scratch.write(coordinates(asked.select("tree", "block", "pos", "n"), n_sources), "coordinates")
    found = scratch.write(fetched(coords, nodes), "fetched")
    return proofs(asked, found, n_sources, root["digest"].hex() if root else None, with_siblings)
