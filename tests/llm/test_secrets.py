"""Operator 13: base spans and decoding against plain Python, the learnt field against values it has not seen."""

import hashlib
import random
import re

import numpy as np
import pytest

from riskweave.llm.secrets import (
    AROUND, BEGIN, FIELDS, INSIDE, NEVER, OUT, TOKEN, WIDTH, Field, Scores, base_spans, feature_rows, fit, labels_of, secret_scan, secret_spans, tagged_spans, text_features, train, viterbi, windows,
)

SCHEMA = "doc_id long, text string, k long, has string, spans int"
PLAIN = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def plain_base(text):
    out = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, pattern, holds) in enumerate(PLAIN) for m in pattern.finditer(text or "") if holds(m)]
    return [s for *_, s in sorted(out)]


def plain_viterbi(score, field):
    if not len(score):
        return []
    best, back = field.start + score[0], []
    for e in score[1:]:
        ways = best[:, None] + field.move
        back.append(ways.argmax(0))
        best = ways.max(0) + e
    label = int(best.argmax())
    out = [label]
    for b in reversed(back):
        label = int(b[label])
        out.append(label)
    return out[::-1]


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9)))
    hexes = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(160):
        words = [rng.choice([word(), word().title(), str(rng.randrange(10**6)), f"{word()}@{word()}.org", "Übung"]) for _ in range(rng.randrange(30, 90))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(['token = "%s"', "password: %s", "API_KEY='%s'", '"secret" : "%s"']) % rng.choice([hexes(), hexes(32)])
        if i % 8 == 1:
            words.insert(5, "AKIA" + "".join(rng.choice("ABCDEFGH0123") for _ in range(16)))
        rows.append((i, " ".join(words)))
    odd = [None, "", "  ", "token", "token=abc", "token=abcdef", "TOKEN=tokens=abcdef secret:x", "apikey=\"\" api_key = 'aaaaaa", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "f" * 23, "f" * 24, "secret: " + "e" * 30, "ſecret=abcdefg toKen=abcdefg", "é token=ü token=aaaaaaé"]
    rows += [(1000 + k, t) for k, t in enumerate(odd)] + [(2000, "x1 " * 50_000 + "token=zzzzzz9"), (None, "no id token=abcdef1"), (0, rows[0][1]), (0, rows[0][1])]
    return rows


@pytest.fixture(scope="module")
def field():
    return train([w for _, t in corpus() for w in windows(t or "") if len(w[1])])


def test_query_columns_equal_plain_python(spark, field):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(5)
    got = secret_spans(df, field).collect()
    want = []
    for i, t in rows:
        t, base = t or "", plain_base(t)
        tokens = TOKEN.findall(t)
        score = np.stack([field.weight[f].sum(0) for f in feature_rows(tokens, text_features(t), 0, len(tokens))]) if tokens else np.zeros((0, 3))
        labels = np.array(plain_viterbi(score, field), int)
        found = [tuple(map(int, s.split(":")[1:])) for s in base]
        more = [(a, b) for a, b in tagged_spans(t, labels) if all(b < x or y < a for x, y in found)]
        kinds = ["assign", "access", "hex", "tagged"]
        every = sorted(base + [f"tagged:{a}:{b}" for a, b in more], key=lambda s: (int(s.split(":")[1]), kinds.index(s.split(":")[0])))
        n = [sum(s.startswith(k) for s in base) for k in kinds[:3]]
        want.append((i, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_learns_from_base_matches_and_finds_others(spark):
    unseen = [(3000, 'then signing = "%s" and more words' % hashlib.sha1(b"1").hexdigest().upper()), (3001, "mail joe@site.org or call 555-1234, it costs 12.50 in 2024"), (3002, "no id " * 9 + "secret=abc.def-1")]
    known, new = (spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA) for rows in (corpus(), unseen))
    got = {r.doc_id: r for r in secret_spans(new, fit(known, of_each=100), with_spans=True).collect()}
    assert "tagged:" in got[3000].spans and got[3000].found[0].kind == "tagged" and got[3000].n_hex == 0
    assert got[3001].spans == "" and got[3002].spans == "assign:54:70"


def test_scan_learns_from_its_own_table(spark):
    rows = corpus()
    got = secret_scan(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(set(r.spans.split(",")) >= set(plain_base(t)) for i, t in rows if i and i < 1000 for r in got if r.doc_id == i and plain_base(t))


def test_field_finds_the_values_of_held_out_texts(field):
    rng, hit, wrong, total, scores = random.Random(9), 0, 0, 0, Scores(field)
    for _ in range(60):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        text = f'{rng.choice(["der Die das", "some words 12", "x@y.org"])} {rng.choice(["token", "cookie", "signing"])} = "{value}" after 2024 it'
        score, sizes = scores.of([text])
        spans = [text[a:b] for a, b in tagged_spans(text, viterbi(score, sizes, field))]
        hit, wrong, total = hit + (value in spans), wrong + sum(s != value for s in spans), total + 1
    assert hit >= 0.9 * total and wrong <= 0.05 * total


def test_decoding_is_exact():
    rng = np.random.default_rng(2)
    for step in (1, 2, 5, 128):
        field = Field(np.zeros((WIDTH, 3)), rng.normal(0, 1, (3, 3)))
        sizes = np.array([0, 1, 7, 5, 0, 23, 2, 300, 0])
        score = rng.normal(0, 1, (sizes.sum(), 3))
        want = [x for part in np.split(score, np.cumsum(sizes)[:-1]) for x in plain_viterbi(part, field)]
        assert viterbi(score, sizes, field, step).tolist() == want
    assert field.move[OUT, INSIDE] == NEVER and len(viterbi(np.zeros((0, 3)), np.zeros(3, int), field)) == 0


def test_memo_is_bounded_and_changes_nothing(field, monkeypatch):
    texts = [t or "" for _, t in corpus()]
    want, sizes = Scores(field).of(texts)
    monkeypatch.setattr("riskweave.llm.secrets.MEMO", 50)
    scores = Scores(field)
    assert np.allclose(np.concatenate([scores.of([t])[0] for t in texts]), want, atol=1e-4)
    assert len(scores.kinds) < 600


def test_labels_and_features():
    text = 'a token = "ab.cd" b'
    places = [m.span() for m in TOKEN.finditer(text)]
    y = labels_of([(text.index("ab"), text.index('" b'))], places)
    assert [text[a:b] for (a, b), label in zip(places, y) if label == BEGIN] == ["ab"] and (y == INSIDE).sum() == 2
    assert feature_rows(["a", "b"], text_features("a b"), 0, 2).shape == (2, FIELDS) and len(AROUND) == 5
    assert [s[:3] for s in base_spans("token=abcdef")] == [(0, 12, "assign")]


def test_no_matches_no_rows(spark):
    assert fit(spark.createDataFrame([(1, "plain words", 1, "x", 1)], SCHEMA)) is None
    assert [tuple(r)[1:4] for r in secret_scan(spark.createDataFrame([(1, "plain words", 1, "x", 1), (2, None, 1, "x", 1)], SCHEMA)).collect()] == [(0, 0, 0)] * 2
    assert secret_scan(spark.createDataFrame([], SCHEMA)).count() == 0
