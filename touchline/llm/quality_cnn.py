"""Quality of whole documents by a byte-level convolutional network in numpy."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import DoubleType

from touchline.llm.labelled import fold, sample, sigmoid

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HALF = 128  # bytes; a chunk is two halves, and the next chunk begins at its second half
PAIR, SPAN = 2, 3  # a filter moves by a pair of bytes and sees three pairs
CODE = 12  # numbers by which a byte is known to the filters
FILTERS, UNITS = 32, 16
STEPS, RATE, BATCH_BYTES = 700, 4e-3, 60_000
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 16_384  # labelled rows of each class that are learned from, and their longest text
SLICE_BYTES = 1 << 18
THRESHOLD = 0.3


@dataclass
class Network:
    filters: np.ndarray  # (SPAN * PAIR * CODE, FILTERS)
    bias: np.ndarray
    units: np.ndarray  # (FILTERS, UNITS)
    unit_bias: np.ndarray
    out: np.ndarray  # largest and mean of every unit over the chunks, then a constant


def byte_codes() -> np.ndarray:
    """A fixed seeded code for each byte; the filters over the codes are what is learned."""
    codes = np.random.default_rng(5).standard_normal((256, CODE)).astype(np.float32)
    return codes / np.sqrt(CODE * PAIR * SPAN)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with zero bytes after each up to whole halves (one at least), and the number of halves of each."""
    halves = np.array([-(-(len(t) + 1) // HALF) for t in texts])
    data = b"".join(t.ljust(h * HALF, b"\0") for t, h in zip(texts, halves.tolist(), strict=True))
    return np.frombuffer(data, np.uint8), halves


def _columns(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One row for each place of a filter: the codes of the bytes that it sees there."""
    pairs = codes[data].reshape(-1, PAIR * CODE)
    out = np.zeros((len(pairs), SPAN * PAIR * CODE), np.float32)
    for i in range(SPAN):
        out[: len(pairs) - i, i * PAIR * CODE : (i + 1) * PAIR * CODE] = pairs[i:]
    return out


def _pooled(columns: np.ndarray, halves: np.ndarray, net: Network) -> np.ndarray:
    """Filter answers at all places, by half: (halves, places, filters). What would reach into the next text is 0."""
    answers = columns @ net.filters
    answers += net.bias
    np.maximum(answers, 0, out=answers)
    last = np.cumsum(halves) * (HALF // PAIR)
    for i in range(1, SPAN):
        answers[last - i] = 0
    return answers.reshape(-1, HALF // PAIR, FILTERS)


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk (a lone half twice), and where the chunks of each text begin."""
    count = np.maximum(halves - 1, 1)
    begin = np.cumsum(count) - count
    first = np.arange(count.sum()) + np.repeat(np.cumsum(halves) - halves - begin, count)
    return first, first + np.repeat((halves > 1).astype(np.int64), count), begin


def probabilities(texts: list[bytes], net: Network) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, halves = padded(texts)
    largest = _pooled(_columns(data, byte_codes()), halves, net).max(1)
    first, second, begin = _chunks(halves)
    return sigmoid(_score(np.maximum(largest[first], largest[second]), begin, halves, net)[0])


def _score(chunks: np.ndarray, begin: np.ndarray, halves: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = np.maximum(chunks @ net.units + net.unit_bias, 0)
    count = np.maximum(halves - 1, 1)
    text = np.concatenate([np.maximum.reduceat(units, begin), np.add.reduceat(units, begin) / count[:, None], np.ones((len(halves), 1))], 1)
    return text @ net.out, units, text


def train(rows: list[tuple[bytes, int]], steps: int = STEPS, seed: int = 3) -> Network | None:
    """Adam on batches of whole texts, both classes alike often. None without rows of both classes."""
    by_class = [sorted({t for t, y in rows if y == c}) for c in (0, 1)]
    if not all(by_class):
        return None
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = Network(normal(SPAN * PAIR * CODE, FILTERS), np.zeros(FILTERS, np.float32), normal(FILTERS, UNITS) / np.float32(FILTERS**0.5),
                  np.zeros(UNITS, np.float32), np.r_[normal(2 * UNITS) / np.float32(UNITS), np.float32(0)].astype(np.float32))
    names = ("filters", "bias", "units", "unit_bias", "out")
    first_moment, second_moment = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    codes = byte_codes()
    queues: list[list[int]] = [[], []]
    for step in range(1, steps + 1):
        texts, labels, size = [], [], 0
        while size < BATCH_BYTES or len(texts) < 16:
            c = len(texts) & 1
            if not queues[c]:
                queues[c] = rng.permutation(len(by_class[c])).tolist()
            texts.append(by_class[c][queues[c].pop()])
            labels.append(c)
            size += len(texts[-1])
        data, halves = padded(texts)
        columns = _columns(data, codes)
        answers = _pooled(columns, halves, net)
        at = answers.argmax(1)
        largest = np.take_along_axis(answers, at[:, None], 1)[:, 0]
        first, second, begin = _chunks(halves)
        later = largest[second] > largest[first]
        chunks = np.where(later, largest[second], largest[first])
        z, units, text = _score(chunks, begin, halves, net)
        dz = ((sigmoid(z) - np.array(labels)) / len(texts)).astype(np.float32)
        grad = {"out": text.T @ dz}
        count = np.maximum(halves - 1, 1)
        owner = np.repeat(np.arange(len(halves)), count)
        top = units == text[owner, :UNITS]
        d_units = (dz[owner, None] * (top * net.out[:UNITS] + net.out[UNITS : 2 * UNITS] / count[owner, None])).astype(np.float32) * (units > 0)
        grad["units"], grad["unit_bias"] = chunks.T @ d_units, d_units.sum(0)
        d_chunks = d_units @ net.units.T
        d_largest = np.zeros_like(largest)
        np.add.at(d_largest, first, d_chunks * ~later)
        np.add.at(d_largest, second, d_chunks * later)
        d_largest *= largest > 0
        place = at + np.arange(len(at))[:, None] * (HALF // PAIR)
        grad["filters"] = np.stack([columns[place[:, f]].T @ d_largest[:, f] for f in range(FILTERS)], 1)
        grad["bias"] = d_largest.sum(0)
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for n in names:
            g = grad[n].astype(np.float32)
            first_moment[n] = 0.9 * first_moment[n] + 0.1 * g
            second_moment[n] = 0.99 * second_moment[n] + 0.01 * g * g
            setattr(net, n, getattr(net, n) - (rate * (first_moment[n] / (1 - 0.9**step)) / (np.sqrt(second_moment[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
    return net


def _runs(texts: list[bytes]):
    """Texts in runs of about SLICE_BYTES padded bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) + HALF > SLICE_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + HALF
    if run:
        yield run


def score(text: Column, net: Network | None, prior: float) -> Column:
    """Probability of quality, 0 to 1, from the whole text; NULL counts as empty."""
    def run(texts: pa.Array) -> pa.Array:
        raw = [t.encode() for t in texts.fill_null("").to_pylist()]
        if net is None:
            return pa.array(np.full(len(raw), prior))
        return pa.array(np.concatenate([np.zeros(0), *(probabilities(r, net).astype(float) for r in _runs(raw))]))

    return arrow_udf(run, DoubleType())(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id``, ``held_out`` (crc32 fold 0 of 5, never learned from), ``score``, ``predicted`` for every row of ``docs``.

    Filters move over the whole text; their answers are pooled to the largest in overlapping chunks, a layer of units
    looks at each chunk, and the largest and mean answer of every unit over all chunks give one probability. An empty
    or NULL text is one chunk of padding. Without labels of both classes the score is the share of class 1 (1 without
    labels). A NULL doc_id stays NULL; it is never learned from. Repeated rows score alike; other columns are left aside.
    """
    known = sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, rows, max_chars)
    prior = sum(y for _, y in known) / len(known) if known else 1.0
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text"), train(known), prior).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
