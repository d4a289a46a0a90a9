"""Encoding with a public byte-level BPE vocabulary by forced boundaries.

A byte pair that occurs inside no vocabulary token can never end up inside one, so a text may be cut there before merging.
The pre-splitting pattern is kept intact by cutting only after a character that is no white space and never before an
apostrophe or inside a character: the pattern's one look-ahead concerns white space, and its contractions begin with an
apostrophe. A run of letters or of marks that a cut divides is one run on either side. The fragments, mostly words, are encoded one by one with a memo and their ids are joined again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import spread
from srcatlas.session import materialize

TOKENIZER_FOLDER = os.environ.get("SRCATLAS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-splitting pattern that belongs to the vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more bytes than this are encoded in pieces by several tasks.
PIECE_BYTES = 1 << 20
MEMO_ENTRIES = 200_000


#: First two bytes of all white space characters of three bytes in UTF-8 (and of some others), and first byte of those of two.
SPACE_STARTS, SPACE_START = (0xE19A, 0xE280, 0xE281, 0xE380), 0xC2


def _may_be_space(x: np.ndarray) -> np.ndarray:
    """Whether a byte ends a character beyond ASCII that may be white space."""
    out = np.zeros(len(x), bool)
    out[1:] = x[:-1] == SPACE_START
    if len(x) > 2:
        out[2:] |= np.isin((x[:-2] << 8) | x[1:-1], SPACE_STARTS)
    return out


class ForcedBoundaryEncoder:
    """Encodes UTF-8 bytes to token ids; special tokens in the text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8)
            inside[t[:-1], t[1:]] = True
        a, b = np.arange(256)[:, None], np.arange(256)[None, :]
        plain = (a > 32) & (a < 127) | ((a & 0xC0) == 0x80)
        start = ((b & 0xC0) != 0x80) & (b != ord("'"))
        self.cut = (~inside & plain & start).ravel()
        self.memo: dict[bytes, list[int]] = {}

    def cuts(self, data: bytes) -> np.ndarray:
        """Offsets at which the bytes may be cut."""
        x = np.frombuffer(data, np.uint8).astype(np.uint16)
        ok = self.cut[(x[:-1] << 8) | x[1:]]
        if not data.isascii():
            ok &= ~_may_be_space(x)[:-1]
        return np.flatnonzero(ok) + 1

    def _fragment(self, part: bytes) -> list[int]:
        ids = self.memo.get(part)
        if ids is None:
            ids = self.whole.encode_ordinary(part.decode())
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            if len(part) <= 64:
                self.memo[part] = ids
        return ids

    def encode(self, data: bytes) -> list[int]:
        at = [0, *self.cuts(data).tolist(), len(data)] if len(data) > 1 else [0, len(data)]
        return list(chain.from_iterable(map(self._fragment, [data[i:j] for i, j in zip(at, at[1:]) if j > i])))

    def pieces(self, data: bytes, size: int) -> list[bytes]:
        """Pieces of about `size` bytes whose encodings, joined, are the encoding of the whole."""
        at, last = [0], 0
        for c in self.cuts(data).tolist():
            if c - last >= size:
                at.append(c)
                last = c
        at.append(len(data))
        return [data[i:j] for i, j in zip(at, at[1:])]


@lru_cache(maxsize=2)
def encoder(folder: str, name: str = VOCABULARY) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(os.path.join(folder, name))


def _piece_batches(folder: str, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            *keys, texts = b.columns
            row, no, part = [], [], []
            for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                for k, p in enumerate(enc.pieces(text, piece)):
                    row.append(i), no.append(k), part.append(p)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(k.take(at) for k in keys), pa.array(no, pa.int32()), pa.array(part, pa.binary())], [*b.schema.names[:-1], "piece", "data"]
            )

    return run


def _encode_batches(folder: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            *keys, data = b.columns
            out, ends = [], [0]
            for text in data.cast(pa.large_binary()).to_pylist():
                got = enc.encode(text) if text else []
                if not count_only:
                    out.append(np.asarray(got, np.int32))
                ends.append(ends[-1] + len(got))
            if count_only:
                value = pa.array(np.diff(ends), pa.int64())
            else:
                value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*keys, value], [*b.schema.names[:-1], "value"])

    return run


def _encoded(documents: DataFrame, keys: list[str], folder: str, piece_bytes: int, count_only: bool) -> DataFrame:
    kind = "bigint" if count_only else "array<int>"
    d = spread(documents.select(*keys, "text"))
    types = dict(d.dtypes)
    short = d.where(F.col("text").isNull() | (F.octet_length("text") <= piece_bytes))
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", value {kind}"
    direct = short.mapInArrow(_encode_batches(folder, count_only), schema)
    long = d.where(F.octet_length("text") > piece_bytes)
    # each row has a key of its own, written with its pieces, so repeated and null ids stay apart and retries agree
    given = ", ".join(["row string", *(f"`{k}` {types[k]}" for k in keys), "piece int"])
    cut = long.select(F.expr("uuid()").alias("row"), *keys, "text").mapInArrow(_piece_batches(folder, piece_bytes), f"{given}, data binary")
    parts = materialize(cut, "long-texts").repartition("row", "piece")
    done = parts.mapInArrow(_encode_batches(folder, count_only), f"{given}, value {kind}")
    if count_only:
        value = F.sum("value")
    else:
        value = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x["value"]))
    joined = done.groupBy("row", *keys).agg(value.alias("value"))
    return direct.unionByName(joined.select(*keys, "value"))


def encode_corpus(documents: DataFrame, folder: str = TOKENIZER_FOLDER, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, ids): token ids of every document, without special tokens.

    Null and empty texts have the empty list. Very long texts are cut at forced boundaries into pieces that several tasks
    encode; these pieces are written to the shared folder when the query is built. Repeated rows give repeated rows, and rows
    with a null doc_id stay rows of their own; ids of one document are in text order.
    """
    return _encoded(documents, ["doc_id"], folder, piece_bytes, False).withColumnRenamed("value", "ids")


def count_tokens(documents: DataFrame, folder: str = TOKENIZER_FOLDER, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, source, n_tokens) by the same encoder; null and empty texts count 0."""
    return _encoded(documents, ["doc_id", "source"], folder, piece_bytes, True).withColumnRenamed("value", "n_tokens")
