"""Byte-level BPE encoding and decoding with a local rank file.

``encode(docs)`` gives the token ids of every text, ``decode(frame)`` the bytes of every id list.
Texts longer than ``PIECE_CHARS`` are cut before a single blank that stands between two characters
that are not white space: there the splitting pattern always begins a new match, so the ids are
those of the uncut text while no call ever holds all of a long text's matches.

Null texts count as empty and give no ids. Repeated rows each give a row. Extra columns are dropped.
A text without any safe place is encoded in one call.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import batches

PIECE_CHARS = 50_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (one ``base64 rank`` pair a line), kept per worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut at the first safe place at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str, rank_file: str, pattern: str, size: int = PIECE_CHARS) -> list[int]:
    enc = encoder(rank_file, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text, size):
        out += enc.encode_ordinary(piece)
    return out


def _default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    default_file, default_pattern = _default_files()
    rank_file, pattern = rank_file or default_file, pattern or default_pattern

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode_text(t or "", rank_file, pattern) for t in batch.column("text").to_pylist()]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(docs.select("doc_id", "text"), step, f"doc_id {kind}, ids array<int>")


def decode(
    encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(doc_id, ids, decoded) with the raw bytes of every id list; null lists give no bytes."""
    default_file, default_pattern = _default_files()
    rank_file, pattern = rank_file or default_file, pattern or default_pattern

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(rank_file, pattern)
        raw = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary())],
            names=["doc_id", "ids", "decoded"],
        )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return batches(
        encoded.select("doc_id", "ids"), step, f"doc_id {kind}, ids array<int>, decoded binary"
    )


def round_trip(
    docs: DataFrame, rank_file: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Encode and decode every text, and give the digests of ids and bytes.

    Columns: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256.
    Ids stay inside the worker between the two halves, so nothing but digests leaves it.
    """
    default_file, default_pattern = _default_files()
    rank_file, pattern = rank_file or default_file, pattern or default_pattern

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(rank_file, pattern)
        counts, of_ids, of_bytes = [], [], []
        for text in batch.column("text"):
            ids = encode_text(text.as_py() or "", rank_file, pattern)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(
        docs.select("doc_id", F.col("text").cast("string").alias("text")),
        step,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
