"""Operators 5, 6 and 10 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskweave.llm.common import Scratch
from riskweave.llm.components import components
from riskweave.llm.hashing import WordHashes
from riskweave.llm.near_dup import near_duplicates
from riskweave.llm.substring_dedup import Windows, lengths, replayed, substring_dedup
from riskweave.llm.suffix_dedup import RunLengthIndex, suffix_dedup


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    """Copies, near copies of one base at several distances, shared passages, empties, one long text."""
    rng = random.Random(11)
    base, shared = words(rng, 150), words(rng, 90)
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base)]
    for edits in (1, 3, 6, 9, 12, 20, 40) * 6:
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for _ in range(12):
        at = rng.randrange(40)
        texts.append(" ".join([*words(rng, 60), *shared[at : at + 50], *words(rng, 30)]))
    texts += ["", None, "   ", "one", "one", "one two", "x " * 300, " ".join(words(rng, 20_000, 5_000)), "é à " * 120]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, rid string, start int").repartition(3)


def linked(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = corpus()
    sets, top = linked(rows, k, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), k, 80).collect()}
    assert got == {i: (len(sets[i]), top[i], top[i] == i) for i in range(len(rows))}


def test_near_duplicates_by_blocks(spark, monkeypatch):
    """The block comparison alone after one round of leaders, with several small blocks in a bucket."""
    from riskweave.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(near_dup, "OPEN_PAIRS", 10**9)
    rows = corpus()[:60]
    _, top = linked(rows, 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), 2, 80).collect()} == dict(enumerate(top))


def joined(spark, key):
    """Executions so far, and the rows that their inner merge joins on ``key`` of both sides have made."""
    store, java, rows = spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, {}
    for e in java(store.executionsList()):
        made = dict(java(store.executionMetrics(e.executionId())))
        for node in java(store.planGraph(e.executionId()).allNodes()):
            if re.match(rf"SortMergeJoin.* \[{key}#\d+L?\], \[{key}#\d+L?\], Inner", node.desc()):
                rows[e.executionId()] = rows.get(e.executionId(), 0) + sum(int(made.get(m.accumulatorId(), "0").replace(",", "")) for m in java(node.metrics()) if m.name() == "number of output rows")
    return rows


@pytest.mark.parametrize("size", [30, 60])
def test_open_members_are_joined_once(spark, monkeypatch, size):
    """Near copies that share buckets but not enough for links stay open; each of their rows meets its counts once and its codes once, in whatever number of rounds."""
    from riskweave.llm import near_dup

    monkeypatch.setattr(near_dup, "OPEN_PAIRS", 0)
    written, write = {}, Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    rng = random.Random(size)
    base, rows = words(rng, 150, 10**6), []
    for i in range(size):
        copy = list(base)
        for at in rng.sample(range(150), 3 if i % 10 == 0 else 6):
            copy[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    before = set(joined(spark, "rep"))
    _, top = linked(rows, 2, 80)
    assert 1 < len(set(top)) < size
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), 2, 80).collect()} == dict(enumerate(top))
    members, made = written["members"].count(), sum(n for e, n in joined(spark, "rep").items() if e not in before)
    assert "open-2" in written and 0 < made <= 2 * members <= 2 * near_dup.BANDS * size


def test_near_duplicates_odd_ids(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "z y x"), (None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["first"]) for r in near_duplicates(frame(spark, rows), 2).collect()), key=str)
    assert [g[:2] for g in got] == [(3, 3), (7, 7), (7, 7), (None, 7), (None, None)] and sum(g[3] for g in got) == 3
    assert near_duplicates(frame(spark, rows).where("doc_id = 99")).count() == 0


def windows(units, width):
    """Which windows of each unit also start elsewhere, by comparing them."""
    seen = Counter(u[p : p + width] for u in units for p in range(len(u) - width + 1))
    return [np.array([seen[u[p : p + width]] > 1 for p in range(len(u) - width + 1)], bool) for u in units]


def removed(units, width):
    for u, again in zip(units, windows(units, width)):
        gone = np.zeros(len(u), bool)
        for p in np.flatnonzero(again):
            gone[p : p + width] = True
        yield u, gone


def with_long(rows):
    """And texts beyond a piece of the run finder (2^19 bytes), one with passages of the others at its piece border and end."""
    rng = random.Random(12)
    long = words(rng, 130_000, 10**6)
    passage = next(t for _, t in rows if t and len(t.split()) == 140)
    at = next(i for i, n in enumerate(np.cumsum([len(w) + 1 for w in long])) if n > (1 << 19) - 300)
    long[at:at] = passage.split()
    return [*rows, (len(rows), " ".join([*long, *passage.split()])), (len(rows) + 1, "ab" * 300_000)]


@pytest.mark.parametrize("chunk", [1 << 21, 3000])
def test_substring_dedup(spark, chunk):
    rows = with_long(corpus())
    want = []
    for (i, _), (u, gone) in zip(rows, removed([tuple((t or "").encode().split()) for _, t in rows], 35)):
        want.append((i, len(u), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(u, gone) if not g)).hexdigest()))
    got = substring_dedup(frame(spark, rows), chunk=chunk).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize(("window", "levels"), [(35, [9, 18, 35]), (9, [9]), (40, [5, 10, 20, 40]), (2, [2])])
def test_levels(spark, window, levels):
    """At every level the candidates are the windows whose halves repeat, and those that repeat survive."""
    assert lengths(window) == levels
    units = [tuple((t or "").encode().split()) for _, t in corpus()]
    make = lambda: Windows([(t or "").encode() for _, t in corpus()], levels, 2, WordHashes(3))
    for n, width in enumerate(levels):
        at, _ = replayed(make(), None, 1, n)
        before = windows(units, levels[n - 1]) if n else None
        step = width - levels[n - 1] if n else 0
        base, want, keep = 0, [], []
        for k, (u, again) in enumerate(zip(units, windows(units, width))):
            some = [p for p in range(len(u) - width + 1) if not n or (before[k][p] and before[k][p + step])]
            want += [base + p for p in some]
            keep += [base + p for p in some if again[p]]
            base += len(u)
        assert at.tolist() == want
        if n + 1 < len(levels):
            replayed(run := make(), None, 1, n + 1)
            assert np.flatnonzero(run.alive).tolist() == keep
    texts = [(i, t) for i, t in corpus()]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(spark, texts), window).collect()}
    assert got == {i: int(g.sum()) for i, (_, g) in enumerate(removed(units, window))}


def test_substring_text(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup(frame(spark, rows), with_text=True).collect()}
    for (i, t), (u, gone) in zip(rows, removed([tuple((t or "").split()) for _, t in rows], 35)):
        assert got[i][1] == (" ".join(w for w, g in zip(u, gone) if not g) if gone.any() else t or "")


@pytest.mark.parametrize("most", [1000, 2, 1])
def test_suffix_dedup(spark, most):
    """Also with grams lengthened while a group has more than ``most`` contents, to full length at the end."""
    rows = with_long(corpus())
    want = []
    for (i, _), (u, gone) in zip(rows, removed([(t or "").encode() for _, t in rows], 200)):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(u), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(u, gone) if not g)).hexdigest()))
    got = suffix_dedup(frame(spark, rows), group=most).collect()
    assert sorted(map(tuple, got)) == want


def test_repeated_rows_and_empty_tables(spark):
    long = " ".join(f"u{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, None)]
    assert [r["n_removed"] for r in substring_dedup(frame(spark, rows)).orderBy("doc_id").collect()] == [0, 60, 60]
    assert [r["n_removed"] for r in suffix_dedup(frame(spark, rows)).orderBy("doc_id").collect()] == [0, len(long), len(long)]
    none = frame(spark, rows).where("doc_id = 99")
    assert substring_dedup(none).count() == 0 and suffix_dedup(none).count() == 0


def test_index_matches_everywhere():
    rng = random.Random(3)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [base[a : a + rng.randint(1, 60)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for a in (rng.randint(0, 50) for _ in range(6))]
        texts += [t for t in texts if rng.random() < 0.2]
        got = RunLengthIndex(texts).matching_statistics().tolist()
        flat = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]

        def common(x, y):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        assert got == [max(common(texts[t][i:], texts[u][j:]) for u, j in flat if (t, i) != (u, j)) for t, i in flat]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n], word[:n].translate(str.maketrans("ab", "ba"))


def test_texts_written_to_collide(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two; nothing of them repeats here."""
    for n in (1 << 10, 1 << 11, 1 << 12):
        one, other = thue_morse(n)
        rows = [(k, " ".join([*(f"w{i}" for i in range(17)), middle, *(f"w{i}" for i in range(17, 34))])) for k, middle in enumerate((one, other))]
        assert [r["n_removed"] for r in substring_dedup(frame(spark, rows)).collect()] == [0, 0]
    # Two documents that share a gram and else differ by words of that kind.
    gram = "".join(random.Random(5).choice("cdefghij") for _ in range(64))
    for n in (128, 1024):
        rows = [(k, gram + middle) for k, middle in enumerate(thue_morse(n))]
        want = [(i, int(g.sum())) for (i, _), (_, g) in zip(rows, removed([t.encode() for _, t in rows], 200))]
        assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup(frame(spark, rows)).collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
