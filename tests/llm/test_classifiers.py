"""Operators 7 and 9: held-out accuracy, linear-time identity, odd rows."""

import numpy as np
import pytest

from riskweave.llm.quality import Machine, quality
from riskweave.llm.toxicity import STEP, WIDTH, fit, toxicity

DATA = "/root/testdata/sf0.01"


def test_identity():
    rng = np.random.default_rng(1)
    m = Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)) * 0.2)
    ids, x = np.array([3, 9, 20, 41]), rng.random(4)
    z = m.bias + m.w[ids] @ x + sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j)
    assert abs(m.score(ids, x) - 1 / (1 + np.exp(-z))) < 1e-12


@pytest.mark.parametrize(("operator", "label", "accuracy", "recall", "area"), [(quality, "quality", 0.95, 0.9, 0.99), (toxicity, "toxic", 0.90, 0.6, 0.88)])
def test_held_out(spark, operator, label, accuracy, recall, area):
    """Accuracy, share of label 1 that is found, and share of pairs of both labels in the right order; a constant score fails."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = operator(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ones, zeros = got[got[label] == 1], got[got[label] == 0]
    right = np.subtract.outer(ones["score"].to_numpy(), zeros["score"].to_numpy())
    assert len(got) > 30 and (got["predicted"] == got[label]).mean() >= accuracy and got["score"].between(0, 1).all()
    assert (ones["predicted"] == 1).mean() >= recall and ((right > 0) + 0.5 * (right == 0)).mean() >= area


def test_toxicity_by_loops(spark):
    """Every score from lengths of every window of the whole text, worked out one by one."""
    import zstandard as z

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = fit(docs, labels)
    ordinary, *toxic = model["shared"].value
    how = z.ZstdCompressionParameters(
        min_match=3, strategy=z.STRATEGY_LAZY, window_log=17, chain_log=17, hash_log=17, search_log=4, target_length=32, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    kept = [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (ordinary, toxic[0] + ordinary, toxic[1] + ordinary)]

    def score(text):
        data, rows = text.lower().encode(), []
        parts, at = [], 0
        while data and (at == 0 or at < len(data) - (WIDTH - STEP)):
            parts.append(data[at : at + WIDTH])
            at += STEP
        lengths = [[len(c.compress(p)) for c in kept] for p in parts]
        for t in (1, 2):
            gains = sorted((r[0] - r[t] for r in lengths), reverse=True)
            n, up = max(len(gains), 1), [max(g, 0) for g in gains]
            over = lambda c: sum(g >= c for g in gains)  # noqa: B023, E731
            mean = sum(up) / n
            rows.append([min(gains[0], 12), mean, mean**0.5, over(1) / n, min(over(1), 40) ** 0.5, min(over(2), 10), over(2) / n, min(over(4), 5), over(4) / n, min(sum(up[:3]) / len(up[:3]), 12), np.log(n)] if gains else [0] * 11)
        x = [min(max(((a + b) / 2 - m) / d, -8), 8) for a, b, m, d in zip(*rows, model["mean"], model["dev"])]
        margin = sum(w * v for w, v in zip(model["w"], [*x, *(v * v for v in x), 1]))
        return 1 / (1 + np.exp(-min(max(margin, -30), 30)))

    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "short"), (900_004, "many words " * 40_000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r["score"] for r in toxicity(rows, labels).collect()}
    want = {r["doc_id"]: score(r["text"] or "") for r in rows.collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, operator):
    rows = [(1, "fine words here", "x"), (2, None, "x"), (3, "", "x"), (None, "text", "x"), (1, "fine words here", "x"), (4, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = operator(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    none = labels.where("doc_id < 0")
    assert {r["score"] for r in operator(docs, none).collect()} == {0.5}
    assert operator(docs.where("doc_id < 0"), labels).count() == 0
