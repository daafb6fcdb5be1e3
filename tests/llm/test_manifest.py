"""Operator 12 against a plain Merkle tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm.merkle import manifest, missing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """All levels of a tree, lowest first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, at):
    """The siblings of the leaf ``at``, level by level, as (left, right)."""
    path = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        group = nodes[run : run + 16]
        path.append(("".join(group[: at - run]), "".join(group[at - run + 1 :])))
        at //= 16
    return path


def brute(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        picked = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaf = h(*map(value, (i, source, lang, n, text)))
        groups[source].append((i is not None, i or 0, leaf, h(*map(value, (i, source, lang, n, lower(text)))) if picked else leaf, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(g, key=lambda r: r[:3]) for s, g in groups.items()}
    trees = {s: tree([r[2] for r in leaves[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for at, r in enumerate(leaves[s]):
            path, folded = climb(trees[s], at) + climb(top, k), r[3]
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[4], r[2], top[0][k], root, h(*(a + b for a, b in path)), folded, folded == root))
    return out


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(4500):  # more than a block in one source
        source = "hot" if i < 4300 else f"s{i % 23}" if i < 4460 else f"one-{i}"
        rows.append((i, f"Text {rng.random()} Ä", "en", source, i, "x", 1))
    rows += [(9001, None, None, None, None, "x", 1), (9002, "", "en", None, 0, "x", 1), (None, "No Id", "en", "hot", 5, "x", 1), (None, "No Id", "en", "hot", 5, "x", 1), (9003, "A" * 300_000, "en", "Ünder", 1, "x", 1)]
    return rows + rows[:3] + [(7, "other TEXT of the same id", "en", "hot", 1, "x", 1), (-5, "Negative", "en", "", 1, "x", 1)]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_manifest_equals_a_plain_tree(spark):
    rows = corpus()
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    same(got, brute(rows))
    assert {r.verified for r in got} == {True, False}


def test_small_trees_and_none(spark):
    for rows in ([(1, "A", None, None, None, "x", 1)], [(1, "a", "en", "s", 1, "x", 1), (2, "b", "en", "t", 1, "x", 1)], [(i, None, None, None, None, "x", 1) for i in (3, None, 3)], [(i, "T", "en", "s", 1, "x", 1) for i in range(17)]):
        same(manifest(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_of_some_leaves_fetch_what_these_do_not_derive(spark):
    rows = [r for r in corpus() if r[3] != "hot" or (r[0] or 0) < 600]
    got = manifest(spark.createDataFrame(rows, SCHEMA), wanted=F.col("doc_id").isin(17, 18, 400, 4470), with_siblings=True)
    want = [r for r in brute(rows) if r[0] in (17, 18, 400, 4470)]
    same([r[:-1] for r in got.collect()], want)
    assert all(h(r.siblings) == r.proof_sha256 for r in got.collect())


def test_missing_is_the_minimal_union():
    assert [(k, p.tolist()) for k, p in missing(np.arange(16), 40)] == [(0, []), (1, [1, 2])]
    assert [(k, p.tolist()) for k, p in missing(np.array([0, 17, 17]), 20)] == [(0, [*range(1, 16), 16, 18, 19]), (1, [])]
    assert missing(np.array([0]), 1) == []
