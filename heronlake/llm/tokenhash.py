"""Hashes of the words and word n-grams of a whole column of texts, without a loop over words.

The value buffer of an Arrow string column is one array of bytes.  Words are
runs of bytes in it; the hash of a word is the sum, modulo 2**64, of a random
number for each byte times a power for its place, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
#: Bytes that are hashed at once.
BLOCK = 1 << 19

#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word of letters and digits: all of ASCII but those.
PUNCT = np.ones(256, dtype=bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False


def powers(n: int) -> np.ndarray:
    """The first n powers of the multiplier."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            steps = np.full(size, _STEP, dtype=np.uint64)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its start and its last part."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts, with the end; nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    all_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of each word, and the index of each row's first word, with the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~ends[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    before[rows] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A to Z count as a to z.

    Words are hashed in blocks of about BLOCK bytes, so that memory doesn't
    grow by a multiple of the texts; a longer word stands alone.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    upto = np.cumsum(lengths)
    cuts = np.searchsorted(upto, np.arange(BLOCK, int(upto[-1]), BLOCK))
    edges = np.unique(np.concatenate([[0], cuts, [len(starts)]])).tolist()
    return np.concatenate([_block_hashes(data, starts[a:b], lengths[a:b], lower) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def _block_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool) -> np.ndarray:
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    at = place + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        parts = (_LOWER if lower else _BYTE)[data[at]] * powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(parts, first) + lengths.astype(np.uint64))


def ngram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; rows must be cut apart by the caller."""
    out = words[: max(0, len(words) - size + 1)]
    for k in range(1, size):
        out = combine(out, words[k : len(words) - size + 1 + k])
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, dtype) -> np.ndarray:
    """What :func:`pack` was given."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(size, len(raw) // size)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending unsigned integers, packed by their differences."""
    steps = numbers.copy()
    steps[1:] -= numbers[:-1]
    return pack(steps)


def unpack_sorted(packed: bytes, dtype) -> np.ndarray:
    """What :func:`pack_sorted` was given."""
    return np.cumsum(unpack(packed, dtype), dtype=dtype)
