"""Byte-level BPE encoding and decoding by tiktoken with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .pretokens import PATTERN, safe_pieces


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, rank_file: str, pattern: str = PATTERN, piece: int = 1 << 16) -> list[int]:
    enc = encoding(rank_file, pattern)
    if len(text) <= piece or pattern != PATTERN:
        return enc.encode_ordinary(text)
    return [i for p in safe_pieces(text, piece) for i in enc.encode_ordinary(p)]


def _encoder(rank_file: str, pattern: str, piece: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):  # small output batches: memory stays bounded
                part = b.slice(k, 500)
                ids = [np.asarray(encode_text(t, rank_file, pattern, piece), "<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return encode


def _decoder(rank_file: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                raw = [enc.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return decode


def _round_trip(rank_file: str, pattern: str, piece: int):
    """Encoding and decoding in one worker: ranks are held once, and ids don't travel between them."""
    encode, decode = _encoder(rank_file, pattern, piece), _decoder(rank_file, pattern)
    return lambda batches: decode(encode(batches))


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 16) -> DataFrame:
    """(doc_id, ids, decoded) for each row: bpe_encode, and bpe_decode of its ids."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_round_trip(rank_file, pattern, piece), "doc_id long, ids binary, decoded binary")


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", piece: int = 1 << 16) -> DataFrame:
    """(doc_id, ids) for each row: ids are little-endian unsigned 32-bit integers in one binary value.

    A null or empty text has no ids. Strings of special tokens are ordinary text. Null and repeated ids
    pass through; an empty table gives no rows; other columns are ignored. Rows never meet: no shuffle.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_encoder(rank_file, pattern, piece), "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids, decoded) for rows of bpe_encode: the raw bytes, also where ids end inside a character."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(_decoder(rank_file, pattern), "doc_id long, ids binary, decoded binary")
