"""Operator 3: token counts with the whole-token shortcut.

Offline, once on the driver, every vocabulary string that is one pre-token is
encoded by the library; those that come back as one token are proven and count
1 wherever they occur as a pre-token. Only the remaining pre-tokens are merged.
The pattern splits a pre-token taken alone into itself (its only look-ahead
asks for white space or the end), so counts per pre-token add up to the text's.

Defined cases: null or empty text has 0 bytes and 0 tokens; a null ``doc_id``
stays null; repeated rows are counted each by itself; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, id_of, text_of
from .pretokens import Memo, splitter

MEMO = 400_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary strings, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven(tokenizer_json: str) -> set[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token."""
    from tokenizers import Tokenizer

    library, back = Tokenizer.from_str(tokenizer_json), byte_letters()
    texts = []
    for piece in json.loads(tokenizer_json)["model"]["vocab"]:
        try:
            texts.append(bytes(back[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    ones = library.encode_batch(texts, add_special_tokens=False)
    split = library.pre_tokenizer.pre_tokenize_str
    return {t for t, e in zip(texts, ones) if len(e.ids) == 1 and len(split(t)) == 1}


def _rank_merges(spec: dict) -> dict[bytes, int] | None:
    """Ranks for a merge by rank, if the file's ids are in the order of its merges; else None."""
    back, vocab = byte_letters(), spec["model"]["vocab"]
    ranks = {bytes(back[c] for c in p): i for p, i in vocab.items() if all(c in back for c in p)}
    last = max([-1, *(ranks[k] for k in ranks if len(k) == 1)])
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made = vocab.get(left + right, -1)
        if made <= last:
            return None
        last = made
    for special in spec.get("added_tokens", []):
        ranks.pop(special["content"].encode(), None)
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document.

    ``tokenizer_path``: a byte-level BPE ``.json``. The vocabulary (a few MB,
    whatever the corpus) is broadcast; texts are never cut.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    spec = json.loads(source)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((source, sorted(proven(source)), _rank_merges(spec)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        text_json, ones, ranks = shared.value
        library = Tokenizer.from_str(text_json)
        split = splitter(public_tokenizers.PATTERN, public_tokenizers.PATTERN)
        if ranks:
            merge = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            merge = lambda piece: library.encode(piece, add_special_tokens=False).ids
        sizes = Memo(lambda piece: len(merge(piece)), MEMO, dict.fromkeys(ones, 1))
        special = [t["content"] for t in json.loads(text_json).get("added_tokens", [])]
        odd = regex.compile("|".join([r"[^\x00-ɏ]", *map(regex.escape, special)])).search

        for batch in bounded(batches, 1):
            tokens = []
            for text in batch.column(1).to_pylist():
                if odd(text):  # special strings, and letters on which the library's Unicode tables can differ
                    if any(s in text for s in special):
                        tokens.append(len(library.encode(text, add_special_tokens=False).ids))
                    else:
                        tokens.append(sum(sizes[text[a:b]] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)))
                else:
                    tokens.append(sum(map(sizes.__getitem__, split(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    from pyspark.sql import functions as F

    rows = docs.select(id_of(docs), text_of(docs)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
