"""Winnowed fingerprints: rolling hashes of k characters, the smallest of every window, the rightmost among equals."""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.words import GOLDEN, PRIME, mix64, powers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, WINDOW = 12, 24  # code points; any GRAM + WINDOW - 1 code points that two texts share leave a common entry in both
SLICE_CHARS = 1 << 20
RANGE_ROWS, MOST_RANGES = 2048, 20_000
LOWEST = -(1 << 63)


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each whole text the selected 32-bit hashes and their places, in the order of places.

    A text shorter than ``gram`` is one gram; a text with fewer than ``window`` grams is one window; an empty text selects nothing.
    """
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > SLICE_CHARS:
            yield from _winnow_run(run, gram, window)
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield from _winnow_run(run, gram, window)


def _winnow_run(texts: list[str], gram: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    n = len(chars)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(chars.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(1)) * powers("up", PRIME, n), out=sums[1:])
    back = powers("down", pow(PRIME, -1, 1 << 64), n + 1)
    grams = np.where(length > 0, np.maximum(length - gram + 1, 1), 0)
    held = np.where(length > 0, np.maximum(grams, window), 0)  # a text of few grams is filled up to one window
    first = np.cumsum(held) - held
    owner = np.repeat(np.arange(len(texts)), grams)
    inside = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    start = begin[owner] + inside
    stop = np.minimum(start + gram, begin[owner] + length[owner])
    hashes = mix64((sums[stop] - sums[start]) * back[start]) >> np.uint64(32)
    slot = first[owner] + inside
    keys = np.full(int(held.sum()), np.iinfo(np.uint64).max, np.uint64)
    # the later place makes the smaller key, so that the rightmost of equal hashes is the smallest
    keys[slot] = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - slot.astype(np.uint64))
    low, width = keys, 1
    while width < window and len(low):
        step = min(width, window - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    windows = np.where(held > 0, held - window + 1, 0)
    for i in range(len(texts)):
        if not held[i]:
            yield np.zeros(0, np.uint32), np.zeros(0, np.int64)
            continue
        chosen = low[first[i] : first[i] + windows[i]]
        place = np.int64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]  # the places of the minima never go back
        yield (chosen[fresh] >> np.uint64(32)).astype(np.uint32), place[fresh] - first[i]


def encoded(hashes: np.ndarray, places: np.ndarray) -> str:
    """Five bytes an entry, in base64: the hash and the distance from the entry before (at most a window)."""
    out = np.zeros((len(hashes), 5), np.uint8)
    out[:, :4] = np.ascontiguousarray(hashes.astype("<u4")).view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(places, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 5)
    return np.ascontiguousarray(raw[:, :4]).view("<u4").ravel(), np.cumsum(raw[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``hashes``, ``places`` (from 0, in code points) of every whole text; NULL as empty. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(winnow(batch.column("text").to_pylist()))
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int32)), pa.array(
                np.concatenate([np.zeros(0, np.int64), *(f[i].astype(np.int64) for f in found)]))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "hashes", "places"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, hashes array<long>, places array<long>")


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts lie below the value, by halving."""
    steps = [1 << s for s in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.lit(cuts).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < value, at + step).otherwise(at)) if cuts else F.lit(0)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each range followed by the row that comes next after it; the last row waits for the next batch."""
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("range", "next", "doc_id", "text")), strict=True))
        held = rows[-1:]
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
        if not pairs:
            continue
        texts = [a[3] for a, _ in pairs]
        changed = [t[: len(t) - len(t) // 3] + b[3][: len(t) // 3] for t, (_, b) in zip(texts, pairs, strict=True)]
        position = {id(a): i for i, (a, _) in enumerate(pairs)}
        alone = [b for _, b in pairs if id(b) not in position]
        own, edited, others = (list(winnow(x)) for x in (texts, changed, [b[3] for b in alone]))
        sets, edited_sets, other_sets = ([np.unique(f[0]) for f in x] for x in (own, edited, others))
        extra = {id(b): s for b, s in zip(alone, other_sets, strict=True)}
        following = [sets[position[id(b)]] if id(b) in position else extra[id(b)] for _, b in pairs]
        yield pa.RecordBatch.from_arrays([
            pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([encoded(*f) for f in own]), pa.array([encoded(*f) for f in edited]),
            pa.array([likeness(a, b) for a, b in zip(sets, edited_sets, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(sets, following, strict=True)], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_likeness(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The last third (rounded down) of a text's code points is replaced by the first as many, or all, of the next text in
    descending order of doc_id; the first follows the last. Rows are dealt once, into ranges of doc_id; the row that
    follows a range is also dealt to it. NULL ids come last, rows of equal ids are ordered by their text. NULL texts are
    empty: no entries, an empty fingerprint, alike to empty texts (1) and to no other (0). A single row follows itself.
    Other columns are left aside; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), text.alias("text"))
    count, highest = rows.agg(F.count("*"), F.max("key")).first()
    parts = min(-(-count // range_rows), MOST_RANGES) or 1
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("key", shares, 10 * parts)).first()[0] if shares and count else []
    cuts = sorted({c for c in found if c < highest})  # ids that occur; a range ends with one
    below = _below(cuts, F.col("key"))
    places = F.array(
        F.struct(below.alias("range"), F.lit(False).alias("next")),
        F.when(F.get(F.lit(cuts).cast("array<bigint>"), below) == F.col("key"), F.struct((below + 1).alias("range"), F.lit(True).alias("next"))),
        F.when(F.col("key") == F.lit(highest), F.struct(F.lit(0).alias("range"), F.lit(True).alias("next"))))
    dealt = rows.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("_place.*", "doc_id", "key", "text")
    ordered = dealt.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "next", F.desc("key"), F.xxhash64("text"), "text")
    return ordered.select("range", "next", "doc_id", "text").mapInArrow(
        _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
