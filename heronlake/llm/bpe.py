"""Byte-level BPE encoding and decoding with the tiktoken library and a local file of ranks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, passed

#: Texts above this many characters are cut at safe boundaries before encoding.
PIECE_CHARS = 65_536


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, made once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text so that the pattern finds the same matches in the pieces as in the whole.

    A cut stands between a character that is not white space and a single
    space followed by an ASCII letter or digit: every alternative of the
    pattern ends before that space or starts with it, and the match that
    starts there doesn't look back.  Where no such place follows, the piece
    grows: no text is lost or shortened.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and text[cut + 1].isascii() and text[cut + 1].isalnum():
                break
            cut += 1
        if cut >= n:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    own = encoding(path, pattern)
    if len(text) <= PIECE_CHARS:
        return own.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.concatenate([own.encode_to_numpy(x, disallowed_special=()) for x in safe_pieces(text)]).astype("<u4", copy=False)


def decode_ids(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8."""
    return encoding(path, pattern).decode_bytes(ids.tolist())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add a column ``ids`` (array of int) with the token ids of every whole text.

    Null texts count as empty: no ids.  A column already named ``ids`` is
    replaced.  Rows are independent; there is no shuffle.
    """
    keep = list(passed(tuple(docs.columns), (ids,)))
    source = docs.select(*keep)
    schema = docs.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType()))
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, at, 4 << 20):
            found = [encode_text(t or "", path, pattern) for t in part.column(at).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*keep, ids])

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add a binary column ``out`` with the bytes that the ids stand for; null ids give null."""
    keep = list(passed(tuple(docs.columns), (out,)))
    source = docs.select(*keep)
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = [None if x is None else own.decode_bytes(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*keep, out])

    return source.mapInArrow(run, docs.select(*keep).schema.add(out, "binary"))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode and digest every text in one pass over it.

    Result: the columns ``keep``, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256.  Null texts
    count as empty.  A kept column with one of those three names gives way to it.
    """
    keep = passed(keep, ("n_tokens", "ids_sha256", "decoded_sha256"))
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 4 << 20):
            counts, digests, decoded = [], [], []
            for t in part.column(len(keep)).to_pylist():
                ids = encode_text(t or "", path, pattern)
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], names=schema.names)

    return source.mapInArrow(run, schema)
