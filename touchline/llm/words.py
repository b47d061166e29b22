"""Words and word shingles of Arrow text columns, found with numpy over whole slices of a batch.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. These bytes never occur inside a multi-byte UTF-8
character, so words are found on bytes. NULL texts count as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import LongType

# Executors need not have the package installed: the small functions below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20  # numpy temporaries of a slice take up to 60 times this
PRIME, GOLDEN = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_POWERS: dict[str, np.ndarray] = {}


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    if not len(texts):
        return
    texts = texts.fill_null("")
    _, ends = flat(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = max(stop, start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows after one another, and the offsets of the rows in them (one more than rows)."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each row (one more than rows)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    before[offsets] = True  # a row begins after a gap
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[offsets] = True
    starts = np.flatnonzero(before[:-1] & ~space)
    ends = np.flatnonzero(after[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _count(texts: pa.Array) -> pa.Array:
    out = [np.zeros(0, np.int64)]
    for part in slices(texts):
        out.append(np.diff(word_spans(*flat(part))[2]))
    return pa.array(np.concatenate(out))


_count_words = arrow_udf(_count, LongType())


def count_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return _count_words(text.cast("string"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64 (the public splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps)
    return have[:n]


def byte_codes(lower: bool = True) -> np.ndarray:
    """A 64-bit code for each byte, the same for A-Z and a-z if ``lower``."""
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum over the bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(lower)[data] * powers("up", PRIME, n), out=sums[1:])
    back = powers("down", pow(PRIME, -1, 1 << 64), n + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z lower-cased.

    A text of fewer words gives one shingle, all its words; a text without words gives none.
    """
    for part in slices(texts):
        data, offsets = flat(part)
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        places = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(PRIME)) | np.uint64(1)
        full = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for i in range(k if len(full) else 0):
            full += words[i : i + len(full)] * places[i]
        full = mix64(full)
        for row in range(len(part)):
            a, n = first[row], first[row + 1] - first[row]
            if n >= k:
                yield np.unique(full[a : a + n - k + 1])
            elif n:
                short = (words[a : a + n] * places[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * np.uint64(GOLDEN)
                yield mix64(short)
            else:
                yield np.zeros(0, np.uint64)
