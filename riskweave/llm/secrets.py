"""Operator 13: secrets by a linear-chain conditional random field.

Text is cut into tokens; a field over the labels *outside*, *begin*, *inside*
scores every token by its own shape, by the words around it and by features of
the whole text, and every pair of labels in a row; Viterbi finds the best labels
of a whole text. What is tagged and no base pattern has found is added as kind
``tagged``.

The field is trained here. Matches of the base patterns serve as labels (the
value of an assignment, the whole of other matches), on a bounded sample: texts
with a match and texts without, at most ``of_each`` of either, those of the
smallest hashes, and at most ``WINDOWS`` stretches of ``STRETCH`` tokens of each.
While it learns, the words around, or the token's fine shape, are left out at
random, so that either alone has to do: it then finds values after names that
the patterns don't know and unnamed values of other shapes. Every whole text is
tagged.

All features depend on one token and its distance, so a token's scores are
worked out once and kept in a bounded memo; a text's scores are sums of rows.
Viterbi runs over stretches side by side (a matrix of the best scores between
their ends), then from stretch to stretch.

Defined cases: null and empty texts have no spans; matches of a kind don't
overlap, those of different kinds may; a tagged span that touches a base span is
not added; without any match in the table nothing is learnt or added; repeated
rows and null ids are rows like others; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_of, text_of

# The base patterns, and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 6
KINDS = ("assign", "access", "hex", "tagged")
#: The same for Spark's filter; it only picks texts to learn from.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"""

TOKEN = re.compile(r"[\w+/-]+|[^\w\s+/-]")
OUT, BEGIN, INSIDE = range(3)
WITH_DIGITS = {"digits", "mixed", "signs9", "hex", "HEX", "lower9", "UPPER9", "Mixed9"}
#: Hashed features; distances of the words around; features of a token itself, around it, and of the text.
WIDTH = 1 << 15
AROUND = (-4, -3, -2, -1, 1)
OWN, NEAR, WHOLE = 8, 2, 4
#: Of a token's own features those of its kind and word.
FINE = [1, 2, 7]
FIELDS = OWN + NEAR * len(AROUND) + 2 * WHOLE
SIZES = [1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 41, 64]
#: Odd numbers that spread a word's number, for the token itself and each distance.
TIMES = np.array([2654435761 + 2 * 104729 * k for k in range(1 + len(AROUND))], np.int64)
STRETCH, WINDOWS = 64, 8
NEVER = -1e9
MEMO = 300_000
#: Tokens of a stretch that is decoded beside others.
STEP = 128


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, kind, value's start`` of every match, by start and then kind."""
    out = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    out += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def hashed(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) % WIDTH


def kind_of(token: str) -> str:
    """Which signs a token is made of."""
    if len(token) == 1 and not token.isalnum():
        return token if token.isascii() else "sign"
    if token.isalpha():
        return "word" if not token.isascii() else "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "camel"
    if token.isdigit():
        return "digits"
    if not token.isascii():
        return "mixed"
    if not any(map(str.isdigit, token)):
        return "signs"
    if not token.isalnum():
        return "signs9"
    return "hex" if not token.strip("0123456789abcdef") else "HEX" if not token.strip("0123456789ABCDEF") else "lower9" if token.islower() else "UPPER9" if token.isupper() else "Mixed9"


def shape(token: str) -> tuple:
    """Kind, size and, of tokens with digits, their share, the changes between digits, small and capital letters, and the number of different signs."""
    kind, size, n = kind_of(token), bisect.bisect_right(SIZES, len(token)), len(token)
    digits = sum(map(str.isdigit, token)) if kind in WITH_DIGITS else 0
    if not digits:
        return kind, size
    turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token[:64], token[1:64]))
    return kind, size, 4 * digits // n, min(8, turns), min(6, len(set(token)) // 3)


def shape_features(of: tuple) -> tuple[list[int], list[int]]:
    """Of a shape, for the token itself and for each distance at which it may stand."""
    kind, size, *more = of
    share, turns, signs = more or (-1, -1, -1)
    own = [hashed("bias"), hashed("kind", kind), hashed("kind-size", kind, size), hashed("size", size, share >= 0), hashed("digits", share), hashed("turns", turns, size > 7), hashed("signs", signs)]
    return own, [hashed("near-kind", d, kind, size) for d in AROUND]


def word_code(token: str, kind: str) -> int:
    """A number for the word, whatever its case; one for all long tokens and those with digits."""
    return zlib.crc32(token.lower().encode()) if len(token) <= 20 and kind not in WITH_DIGITS else 1


def word_features(codes: np.ndarray) -> np.ndarray:
    """Of words, a row each: for the token itself and for each distance."""
    return ((codes[:, None] * TIMES) & 0xFFFFFFFF) >> 17


def text_features(text: str) -> tuple[str, ...]:
    """Classes of the whole text: assignment signs, digits, length of lines, size."""
    data = text.encode()
    n = max(1, len(data))
    of = lambda signs: (n - len(data.translate(None, signs))) / n
    place = lambda name, x, *edges: f"{name}{sum(x > e for e in edges)}"
    return place("assign", of(b"=:"), 0.001, 0.01, 0.03), place("digits", of(b"0123456789"), 0.005, 0.05, 0.15), place("lines", n / (data.count(b"\n") + 1), 40, 100, 400), place("size", n, 300, 2_000, 10_000)


def whole_features(classes: tuple[str, ...], kind: str) -> list[int]:
    """Of the text, alone and with the token's kind."""
    return [hashed("text", c) for c in classes] + [hashed("text-kind", c, kind) for c in classes]


def feature_rows(tokens: list[str], classes: tuple[str, ...], low: int, high: int) -> np.ndarray:
    """The features of tokens ``low`` to ``high``, a row each: own, around, of the text."""
    reach = range(low + min(AROUND), high + max(AROUND))
    own, near, words, kinds = [], [], [], []
    for i in reach:
        token = tokens[i] if 0 <= i < len(tokens) else None
        of = shape(token) if token is not None else ("edge", 0)
        a, b = shape_features(of)
        own.append(a)
        near.append(b)
        words.append(word_code(token, of[0]) if token is not None else 0)
        kinds.append(of[0])
    w, n = word_features(np.array(words, np.int64)), high - low
    near_, at = np.array(near), -min(AROUND)
    columns = [np.array(own)[at : at + n], w[at : at + n, :1]]
    for k, d in enumerate(AROUND):
        columns += [w[at + d : at + d + n, k + 1 : k + 2], near_[at + d : at + d + n, k : k + 1]]
    columns.append(np.array([whole_features(classes, k) for k in kinds[at : at + n]]))
    return np.concatenate(columns, axis=1).astype(np.uint16)


def labels_of(spans: list[tuple[int, int]], places: list[tuple[int, int]]) -> np.ndarray:
    """The label of every token: those that lie in a span begin or continue it."""
    out = np.zeros(len(places), np.uint8)
    starts = np.array([p[0] for p in places], np.int64)
    for start, end in sorted(spans, reverse=True):
        low, high = np.searchsorted(starts, start), np.searchsorted(starts, end)
        if low < high:
            out[low:high] = INSIDE
            out[low] = BEGIN
    return out


def windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stretches to learn from, features and labels: around matches, and around tokens that might be taken for a secret."""
    places = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in places]
    y = labels_of([(value, end) for _, end, _, value in base_spans(text)], places)
    classes = text_features(text)
    like = [i for i, t in enumerate(tokens) if y[i] == OUT and (len(t) > 11 or any(map(str.isdigit, t)))] or list(range(0, len(tokens), 50))
    out = []
    for centres in (np.flatnonzero(y == BEGIN).tolist(), like):
        for i in centres[:: max(1, 2 * len(centres) // WINDOWS)][: WINDOWS // 2]:
            low = max(0, i - STRETCH // 2)
            high = min(len(tokens), low + STRETCH)
            out.append((feature_rows(tokens, classes, low, high), y[low:high]))
    return out


class Field:
    """Weights of features by label, and of labels in a row (``move[before, after]``)."""

    def __init__(self, weight: np.ndarray, move: np.ndarray):
        self.weight, self.move = weight, move
        self.move[OUT, INSIDE] = NEVER
        self.start = np.array([0.0, 0.0, NEVER])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-5, seed: int = 13) -> Field:
    """Adagrad on the likelihood of the labels, by forward and backward sums over batches of stretches."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((WIDTH, 3)), np.zeros((3, 3)))
    gw, gm = np.full((WIDTH, 3), 1e-6), np.full((3, 3), 1e-6)
    near = np.arange(OWN, OWN + NEAR * len(AROUND))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = [rows[i] for i in order[at : at + 64]]
            n, t = len(batch), max(len(y) for _, y in batch)
            ids, y, mask = np.zeros((n, t, FIELDS), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
            for k, (f, labels) in enumerate(batch):
                ids[k, : len(f)], y[k, : len(f)], mask[k, : len(f)] = f, labels, True
            used = (rng.random((n, 1, FIELDS)) < 0.7).astype(float)
            used[np.ix_(rng.random(n) < 0.3, [0], near)] = 0.0
            used[np.ix_(rng.random(n) < 0.3, [0], FINE)] = 0.0
            e = (field.weight[ids] * used[..., None]).sum(2) * mask[..., None]
            ahead, behind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            ahead[:, 0] = e[:, 0] + field.start
            for i in range(1, t):
                ahead[:, i] = np.where(mask[:, i, None], log_sum(ahead[:, i - 1, :, None] + field.move, 1) + e[:, i], ahead[:, i - 1])
            for i in range(t - 2, -1, -1):
                behind[:, i] = np.where(mask[:, i + 1, None], log_sum(field.move + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2), behind[:, i + 1])
            z = log_sum(ahead[:, -1], 1)
            p = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
            pair = np.exp(np.minimum(ahead[:, :-1, :, None] + field.move + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * mask[:, 1:, None, None]
            slope = (p - np.eye(3)[y] * mask[..., None]) / n
            flat = ids[mask].ravel()
            each = np.repeat(slope[mask], FIELDS, axis=0) * np.broadcast_to(used, ids.shape)[mask].ravel()[:, None]
            hit, inverse = np.unique(flat, return_inverse=True)
            dw = np.stack([np.bincount(inverse, each[:, c]) for c in range(3)], 1) + ridge * field.weight[hit]
            seen = np.zeros((3, 3))
            np.add.at(seen, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1.0 / n)
            dm = pair.sum((0, 1)) / n - seen
            gw[hit] += dw**2
            gm += dm**2
            field.weight[hit] -= rate * dw / np.sqrt(gw[hit])
            field.move -= rate * 0.3 * dm / np.sqrt(gm)
            field.move[OUT, INSIDE] = NEVER
    return field


class Scores:
    """Scores of texts' tokens by label, from a bounded memo: a token's scores for itself and for each distance at which it may stand."""

    def __init__(self, field: Field):
        w = self.weight = field.weight.astype(np.float32)
        self.shapes: dict[tuple, np.ndarray] = {}
        self.edge = np.stack([w[f] for f in shape_features(("edge", 0))[1]]) + w[word_features(np.zeros(1, np.int64))[0, 1:]]
        self.wholes: dict[tuple, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows, self.kinds = [np.zeros((0, 3), np.float32)] * (1 + len(AROUND)), np.zeros(0, np.int64)
        self.names: dict[str, int] = {}
        self.wholes.clear()

    def learn(self, tokens: list[str]) -> None:
        """Adds tokens to the memo."""
        shapes = list(map(shape, tokens))
        for of in set(shapes) - self.shapes.keys():
            own, near = shape_features(of)
            self.shapes[of] = np.concatenate([self.weight[own].sum(0)[None], self.weight[near]])
        codes = np.array([word_code(t, of[0]) for t, of in zip(tokens, shapes)], np.int64)
        rows = np.array([self.shapes[of] for of in shapes]) + self.weight[word_features(codes)]
        kinds = np.array([self.names.setdefault(of[0], len(self.names)) for of in shapes])
        self.number.update(zip(tokens, range(len(self.kinds), len(self.kinds) + len(tokens))))
        self.rows, self.kinds = [np.concatenate([old, rows[:, k]]) for k, old in enumerate(self.rows)], np.concatenate([self.kinds, kinds])

    def whole(self, text: str) -> np.ndarray:
        """What a text adds to tokens of each kind."""
        classes = text_features(text)
        got = self.wholes.get(classes)
        if got is None or len(got) < len(self.names):
            got = self.wholes[classes] = np.stack([self.weight[whole_features(classes, k)].sum(0) for k in self.names])
        return got

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the tokens of all texts, end to end, and each text's number of tokens."""
        tokens = [TOKEN.findall(t) for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        if not sizes.sum():
            return np.zeros((0, 3), np.float32), sizes
        if len(self.kinds) > MEMO:
            self.forget()
        new = list(set().union(*tokens) - self.number.keys())
        if new:
            self.learn(new)
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
        score = self.rows[0].take(ids, axis=0)
        end = np.cumsum(sizes)
        low, high, here = np.repeat(end - sizes, sizes), np.repeat(end, sizes), np.arange(len(ids))
        for k, d in enumerate(AROUND):
            other = here + d
            beyond = np.flatnonzero((other < low) | (other >= high))
            more = self.rows[k + 1].take(ids.take(other, mode="clip"), axis=0)
            more[beyond] = self.edge[k]
            score += more
        kinds = self.kinds[ids]
        for text, n, stop in zip(texts, sizes.tolist(), end.tolist()):
            if n:
                score[stop - n : stop] += self.whole(text)[kinds[stop - n : stop]]
        return score, sizes


def viterbi(score: np.ndarray, sizes: np.ndarray, field: Field, step: int = STEP) -> np.ndarray:
    """The best labels of every text (scores end to end), exactly.

    Texts are cut into stretches of ``step`` tokens. For all stretches at once the
    best scores from each label at the first token to each at the last are worked
    out; then, text by text, the best way from stretch to stretch; then the labels
    within all stretches backwards.
    """
    many = -(-sizes // step)
    first = np.cumsum(many) - many
    text = np.repeat(np.arange(len(sizes)), many)
    begin = (np.cumsum(sizes) - sizes)[text] + (np.arange(int(many.sum())) - first[text]) * step
    length = np.minimum(step, np.cumsum(sizes)[text] - begin)
    n = len(begin)
    out = np.zeros(len(score), np.int8)
    if not n:
        return out
    # best[c, a, b]: from label a at the stretch's first token to b at the present one. Longer stretches come first.
    order = np.argsort(-length, kind="stable")
    begins, lengths = begin[order], length[order]
    move = field.move.astype(score.dtype)
    ways = np.full((n, 3, 3), 2 * NEVER, score.dtype)
    for a in range(3):
        ways[:, a, a] = score[begins, a]
    back = np.zeros((int(lengths[0]), n, 3, 3), np.int8)
    alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # stretches with more than i tokens
    for i in range(1, len(back)):
        k = alive[i]
        now = ways[:k]
        top, from_ = now[:, :, :1] + move[0], np.zeros((k, 3, 3), np.int8)
        for a in (1, 2):
            other = now[:, :, a : a + 1] + move[a]
            np.copyto(from_, np.int8(a), where=other > top)
            np.maximum(top, other, out=top)
        back[i, :k] = from_
        ways[:k] = top + score[begins[:k] + i][:, None, :]
    best = np.empty_like(ways)
    best[order] = ways
    last = np.empty(n, np.int64)  # the label at each stretch's first and last token
    head = np.empty(n, np.int64)
    for low, k in zip(first.tolist(), many.tolist()):
        if not k:
            continue
        total, froms = field.start[:, None] + best[low], []
        reach, entry = total.max(0), total.argmax(0)
        froms.append(entry)
        prevs = []
        for c in range(low + 1, low + k):
            enter = reach[:, None] + field.move  # label before, label at the first token
            prev = enter.argmax(0)
            total = enter.max(0)[:, None] + best[c]
            entry, reach = total.argmax(0), total.max(0)
            froms.append(entry)
            prevs.append(prev)
        label = int(reach.argmax())
        for c in range(low + k - 1, low - 1, -1):
            last[c], head[c] = label, froms[c - low][label]
            if c > low:
                label = int(prevs[c - low - 1][head[c]])
    now, head = last[order], head[order]
    every = np.arange(n)
    for i in range(len(back) - 1, -1, -1):
        k = alive[i]
        out[begins[:k] + i] = now[:k]
        if i:
            now[:k] = back[i, every[:k], head[:k], now[:k]]
    return out


def tagged_spans(text: str, labels: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of text that the labels mark."""
    out: list[tuple[int, int]] = []
    for m, label in zip(TOKEN.finditer(text), labels.tolist()):
        if label == BEGIN:
            out.append(m.span())
        elif label == INSIDE and out:
            out[-1] = (out[-1][0], m.end())
    return out


def fit(docs: DataFrame, of_each: int = 800) -> Field | None:
    """The field learnt from at most ``of_each`` texts with a base match and as many without; None if nothing matches.

    Features of stretches come to the driver (about 3 KB each), never texts.
    """
    rows = docs.select(F.xxhash64(docs["doc_id"]).alias("k"), text_of(docs))
    keyed = rows.select("k", F.col("text").rlike(ANY).alias("has"))
    picks = [keyed.where(F.col("has") == has).orderBy("k").limit(of_each).agg(F.max("k").alias("top"), F.lit(has).alias("has")) for has in (True, False)]
    tops = {r["has"]: r["top"] for r in picks[0].unionByName(picks[1]).collect()}
    if tops[True] is None:
        return None
    chosen = (F.col("k") <= F.lit(tops[True])) & F.col("text").rlike(ANY)
    if tops[False] is not None:
        chosen = chosen | (F.col("k") <= F.lit(tops[False]))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            keys, has, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for k, text, h in zip(keys, batch.column(1).to_pylist(), has):
                found = windows(text)
                out.append((k, h, zlib.crc32(text.encode()), [f.tobytes() for f, _ in found], [y.tobytes() for _, y in found]))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["k", "has", "sum", "features", "labels"])

    table = rows.where(chosen).select("k", "text", F.col("text").rlike(ANY).alias("has")).mapInArrow(compact, "k long, has boolean, sum long, features array<binary>, labels array<binary>")
    got = table.orderBy("k", "sum").limit(2 * of_each).collect()  # rows of one id may be many
    pairs = [(np.frombuffer(f, np.uint16).reshape(-1, FIELDS), np.frombuffer(y, np.uint8)) for r in got for f, y in zip(r["features"], r["labels"])]
    return train([(f, y) for f, y in pairs if len(y)])


def secret_spans(docs: DataFrame, field: Field | None, with_spans: bool = False) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document, and ``found`` (spans as structs) if asked for. The broadcast field has a fixed size (800 KB)."""
    shared = docs.sparkSession.sparkContext.broadcast(None if field is None else (field.weight, field.move))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared.value is None else Field(*(x.copy() for x in shared.value))
        scores = None if own is None else Scores(own)
        for batch in bounded(batches, 1):
            texts, out = batch.column(1).to_pylist(), []
            labels, sizes = None, [0] * len(texts)
            if scores is not None:
                score, counts = scores.of(texts)
                labels, sizes = viterbi(score, counts, own), counts.tolist()
            at = 0
            for text, size in zip(texts, sizes):
                base = [s[:3] for s in base_spans(text)]
                every = base
                if labels is not None and labels[at : at + size].any():
                    more = [(a, b, "tagged") for a, b in tagged_spans(text, labels[at : at + size]) if not any(x <= b and a <= y for x, y, _ in base)]
                    every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                at += size
                joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
                n = [sum(k == kind for *_, k in base) for kind in KINDS[:3]]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [{"kind": k, "start": a, "end": b} for a, b, k in every]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 3, pa.string(), pa.string(), FOUND))]
            columns, names = [batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays(columns[: 6 + with_spans], names=names[: 6 + with_spans])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", found array<struct<kind: string, start: long, end: long>>" * with_spans
    return docs.select(id_of(docs), text_of(docs)).mapInArrow(work, schema)


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_scan(docs: DataFrame, of_each: int = 800, with_spans: bool = False) -> DataFrame:
    """``secret_spans`` with a field learnt from the documents themselves."""
    return secret_spans(docs, fit(docs, of_each), with_spans)
