"""Operator 4: byte-level BPE encoding and decoding by a serialised sentencepiece model.

The model is written straight from the rank file: every vocabulary string in
its printable byte mapping is a BPE piece with score ``-rank``, the normaliser
is the identity, no prefix or white-space rule is set. Sentencepiece merges the
pair with the best score, leftmost first, which is the merge by lowest rank.
Each pre-token is encoded by itself; decoding maps ids back to their bytes.

Defined cases: null and empty text give no ids (hashes of the empty string);
null ``doc_id`` stays null; repeated rows give repeated results; strings of
special tokens are ordinary text; very long texts are encoded whole, in a batch
of their own; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, id_of, text_of
from .pretokens import Memo, splitter
from .token_counts import byte_letters

MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece and rank from each ``base64 rank`` line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A ModelProto whose piece ids are the ranks; the id after the last is the unknown piece that sentencepiece asks for."""
    letter = {b: c for c, b in byte_letters().items()}
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    # Field numbers of sentencepiece_model.proto; type 2 of a piece is UNKNOWN, model type 2 is BPE.
    out = bytearray()
    for piece in by_rank:
        out += _field(1, _field(1, "".join(letter[b] for b in piece).encode()) + _field(2, float(-ranks[piece])))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5)))
    return bytes(out)


def encode_decode(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip`` for every document, and ``ids`` if ``with_ids``.

    ``round_trip``: the decoded bytes are those of the text. The broadcast holds
    the rank table and its model, a few MB that don't depend on the corpus.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, sentencepiece_model(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import sentencepiece

        table, model = shared.value
        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = byte_letters()
        letters = {b: c for c, b in back.items()}
        pieces = [bytes(back[c] for c in encoder.id_to_piece(i)) for i in range(len(table))]
        split = splitter(public_tokenizers.PATTERN, public_tokenizers.PATTERN)
        encode = encoder.encode

        def packed(pre: str) -> bytes:
            raw = pre.encode()
            whole = table.get(raw)  # a pre-token in the vocabulary is its own id, as in the rank library
            ids = [whole] if whole is not None else encode(raw.decode("latin-1").translate(letters))
            return struct.pack(f"<{len(ids)}I", *ids)

        memo = Memo(packed, MEMO)
        for batch in bounded(batches, 1):
            n, sha, decoded, same, flat = [], [], [], [], bytearray()
            for text in batch.column(1).to_pylist():
                data = b"".join(map(memo.__getitem__, split(text)))
                text_back = b"".join(map(pieces.__getitem__, memoryview(data).cast("I"))) if data else b""
                n.append(len(data) // 4)
                sha.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(text_back).hexdigest())
                same.append(text_back == text.encode())
                if with_ids:
                    flat += data
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:  # one buffer of 32-bit ids and the offsets into it
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                out, names = [*out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32)))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(id_of(docs), text_of(docs)).mapInArrow(run, schema)
