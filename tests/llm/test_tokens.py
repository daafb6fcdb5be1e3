"""Operators 3 and 4 against the libraries themselves."""

import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskweave.llm.byte_bpe import encode_decode, read_ranks, sentencepiece_model
from riskweave.llm.pretokens import splitter
from riskweave.llm.token_counts import proven, token_counts

TEXTS = [
    "Hello world, it's a test.", "", None, "   \n\n  x  ", "<|endoftext|> a<|endoftext|>b", "日本語 テスト १२३", "՘a₏ x ǅ", "a\x1cb\x85 c d", "'s 'll don't''re",
    "é" * 500, "a b " * 20_000, "1²½ ٣ x", "🙂🙂 ok", "Hello world, it's a test.", "x" * 3000,
]


def frame(spark, texts=TEXTS):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")


def test_counts(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)
    got = token_counts(frame(spark), path).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert [r["doc_id"] for r in got].count(None) == 1


def test_encoding(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    want = []
    for t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = encode_decode(frame(spark), path, with_ids=True).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


def test_empty(spark):
    none = frame(spark).where("doc_id < 0")
    assert token_counts(none, P.path("byte_bpe_50k.json")).count() == 0
    assert encode_decode(none, P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_proven_strings():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        ones = proven(file.read())
    assert " the" in ones and "<|endoftext|>" not in {o for o in ones if len(o) < 5} and len(ones) > 40_000


def test_model_is_the_vocabulary():
    import sentencepiece

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    s = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
    assert s.vocab_size() == len(ranks) + 1 and s.is_unknown(len(ranks)) and s.get_score(1000) == -1000.0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé\x1c\x85 ²ª!.,trevmldЖ日"), max_size=60))
def test_splitter(text):
    import regex

    assert splitter(P.PATTERN, P.PATTERN)(text) == regex.findall(P.PATTERN, text)
