"""Every stage against plain Python on the same rows; stages take effect, keep the columns, and survive odd rows."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from riskweave.llm.common import Scratch

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, _rid string, _kept int, _quality double, `a.b` int, doc_id_ int"
STAGES = dict(C.STAGES)


def rows():
    """Copies, near copies, shared passages, benchmark passages, nulls, empties, repeated and null ids, a very long text."""
    from pyarrow import parquet

    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = parquet.read_table(f"{DATA}/benchmark.parquet").column("text").to_pylist()
    base, shared = word(120), word(60)
    texts = [" ".join(base), " ".join(base), " ".join(base[:-2] + ["x", "y"]), " ".join(base[:60]), "", None, "  ", "a b c", "a b c"]
    texts += [" ".join([*word(40), *shared, *word(20)]) for _ in range(4)] + [" ".join([*word(80), *items[0].split(), *word(50)]), items[1].upper()]
    texts += [" ".join(word(60_000)), "x" * 300_000, " ".join(word(30)) + "  \n tail"]
    ids = [None if i == 3 else 1 if i in (7, 8) else i for i in range(len(texts))]
    return [(d, t, "en", "s", len(t or ""), "r", "clash", 4, 0.5, 6, i) for i, (d, t) in enumerate(zip(ids, texts))]


def run(spark, name, data):
    docs = spark.createDataFrame(data, SCHEMA)
    out = STAGES[name](spark, docs, DATA)
    assert out.columns == docs.columns
    return {r["doc_id_"]: r for r in out.collect()}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_near_duplicates_stage(spark):
    data = rows()
    sets = [shingles(r[1], 5) for r in data]
    group = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    got = run(spark, "MinHash near-dedup", data)
    assert Counter(group[i] for i in got) == dict.fromkeys(set(group), 1)
    assert all(tuple(r) == data[i] for i, r in got.items())


def test_substring_stage(spark):
    data = rows()
    units = [tuple((r[1] or "").split()) for r in data]
    seen = Counter(u[p : p + 35] for u in units for p in range(len(u) - 34))
    got = run(spark, "substring dedup", data)
    assert len(got) == len(data)
    for i, u in enumerate(units):
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - 34):
            if seen[u[p : p + 35]] > 1:
                gone[p : p + 35] = True
        text = " ".join(w for w, g in zip(u, gone) if not g) if gone.any() else data[i][1]
        want = (*data[i][:1], text, *data[i][2:4], len(text or "") if gone.any() else data[i][4], *data[i][5:])
        assert tuple(got[i]) == want


def test_decontamination_stage(spark):
    data = rows()
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = set()
    for t in items:
        s = shingles(t, 5)
        k = min(5, len((t or "").split()))
        bad |= {i for i, r in enumerate(data) if s and 5 * len(s & (shingles(r[1], k) if len((r[1] or "").split()) >= k else set())) >= 4 * len(s)}
    got = run(spark, "benchmark decontamination", data)
    assert bad and set(got) == set(range(len(data))) - bad and all(tuple(r) == data[i] for i, r in got.items())


def test_tokens_stage(spark):
    import public_tokenizers as P
    import tiktoken

    from riskweave.llm.byte_bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    data = [r for r in rows() if len(r[1] or "") < 290_000]
    want = []
    for r in data:
        ids = library.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), ids))
    got = STAGES["byte-level BPE"](spark, spark.createDataFrame(data, SCHEMA), DATA).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], list(r["ids"])) for r in got) == sorted(want)


def test_quality_stage(spark):
    """Kept are the rows whose score, all pairs summed one by one, reaches 0.3."""
    from riskweave.llm.quality import Features, fit

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 400"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = fit(docs, labels)
    make, want = Features(model.edges), set()
    for r in docs.collect():
        ids, x = make.row((r["text"] or "").encode())
        v = model.v[ids] * x[:, None]
        z = model.bias + model.w[ids] @ x + sum(v[i] @ v[j] for i in range(len(ids)) for j in range(i))
        if 1 / (1 + np.exp(-z)) >= 0.3:
            want.add(r["doc_id"])
    got = STAGES["quality classifier"](spark, docs, DATA)
    assert got.columns == docs.columns and 0 < len(want) < docs.count()
    assert {r["doc_id"] for r in got.collect()} == want


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, name):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = STAGES[name](spark, docs, DATA)
    last = name == C.STAGES[-1][0]
    assert last or out.columns == docs.columns
    assert out.count() <= docs.count() and STAGES[name](spark, docs.where("doc_id < -1"), DATA).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, scratch, before = docs.columns, Scratch(spark), docs.count()
    sizes = []
    for n, (_, stage) in enumerate(C.STAGES):
        docs = scratch.write(stage(spark, docs, DATA), f"s{n}")
        sizes.append(docs.count())
        if n < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert before > sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    assert docs.where("NOT round_trip").count() == 0
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert {r["doc_id"] for r in C.run(spark, DATA).select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
