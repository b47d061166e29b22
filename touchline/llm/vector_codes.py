"""Product codes of vectors: an integer codebook for each part, searched through memoised cells of a grid.

A part is hashed to its coarse cell. For a cell that is new, the distances from all codebook entries to its box are
bounded once: an entry whose least distance is above the smallest of the largest distances cannot be the nearest
anywhere in the box. The entries that are left are remembered for the cell, and only they are evaluated exactly for the
parts inside, so that codes do not depend on the grid.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage, join_statistics
from touchline.llm.vectors import dimension, finite, floored, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
CELLS = 1 << 16  # cells that a task remembers for a part; beyond that it forgets them all and begins anew


def cell_shift(entries: np.ndarray) -> int:
    """Bits below a cell's number: the widest side of the codebook is cut into four to eight cells."""
    return max(0, int(np.ptp(entries, axis=0).max()).bit_length() - 3)


class Cells:
    """The codebook of one part and what is remembered of the cells met so far."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.shift, self.known = entries, cell_shift(entries), {}

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """For every cell, which entries are not dominated across its box."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        nearest = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        farthest = np.maximum(np.abs(low - self.entries), np.abs(high - self.entries))
        least, most = (nearest**2).sum(2), (farthest**2).sum(2)
        return least <= most.min(1)[:, None]

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        keys = [c.tobytes() for c in cells]
        if len(self.known) + len(keys) > CELLS:
            self.known.clear()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for i, found in zip(some, self._candidates(cells[some]), strict=True):
                self.known[keys[i]] = found
        return np.array([self.known[k] for k in keys])

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every part; ties go to the lower index."""
        if not len(parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = parts >> self.shift
        odd = np.random.default_rng(11).integers(1 << 62, size=parts.shape[1], dtype=np.int64) * 2 + 1
        _, first, cell = np.unique((cells * odd).sum(1), return_index=True, return_inverse=True)
        met = self.candidates(cells[first])[cell]
        met[(cells != cells[first][cell]).any(1)] = True  # another cell with the same hash
        row, entry = np.nonzero(met)
        gap = ((parts[row] - self.entries[entry]) ** 2).sum(1)
        error = np.minimum.reduceat(gap, np.searchsorted(row, np.arange(len(parts))))
        least = np.flatnonzero(gap == error[row])[::-1]
        code = np.zeros(len(parts), np.int64)
        code[row[least]] = entry[least]  # of several least ones the lowest is written last
        return code, error


def _books(codebooks: np.ndarray) -> list[Cells]:
    return [Cells(part) for part in codebooks]


def _sums(codebooks: np.ndarray):
    """Map function: count and component sums of the parts next to each entry, added up over a task."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts, sums = _books(codebooks), np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = floored(matrix(batch.column(0), parts * width), SCALE).reshape(-1, parts, width)
            for p, book in enumerate(books):
                code, _ = book.assign(x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, x[:, p])
        used = counts.ravel() > 0
        names = np.indices((parts, entries)).reshape(2, -1)[:, used]
        columns = [names[0], names[1], counts.ravel()[used], *sums.reshape(-1, width)[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return run


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of the usable rows ``vec_id``, ``vector``: one pass over the rows a round.

    The driver holds the codebooks and one row of sums for each of their entries. Fewer rows than ``entries`` give as
    many entries as rows; without rows there are none. Rows of one id are ordered by their vectors.
    """
    dims = dimension(vectors, "vector")
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = floored(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dims), SCALE)
    books = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    if not books.size:
        return books
    width = dims // parts
    schema = "part long, entry long, n long, " + ", ".join(f"s{i} long" for i in range(width))
    for _ in range(rounds):
        found = vectors.select("vector").mapInArrow(_sums(books), schema).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect()
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def _codes(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        for batch in batches:
            x = floored(matrix(batch.column("vector"), parts * width), SCALE).reshape(-1, parts, width)
            found = [book.assign(x[:, p]) for p, book in enumerate(books)]
            digits = np.stack([c for c, _ in found], 1).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in digits], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), code, pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    return run


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable row of ``vec_id, embedding, label``.

    Rows whose vector is NULL or holds NULL or non-finite components are left out; an empty table gives no rows. NULL ids
    are kept and are the last to seed a codebook; repeated rows each give a row. NULL labels are one label. Vectors
    without components have an empty code and no error. Ties go to the lower index. Vectors of different lengths, of a length that is no
    multiple of ``parts``, or with a component beyond 32,767 raise ``ValueError``. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part")
    rows = embeddings.filter(finite(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("vector"))
    books = fit(rows, parts, entries, rounds)
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if books.size:
        coded = rows.mapInArrow(_codes(books), schema)
    else:
        coded = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = cut_lineage(coded.withColumns({"named": F.col("label").isNotNull(), "label": F.coalesce("label", F.lit(0).cast(kinds["label"]))}))
    errors = coded.groupBy("named", "label").agg(F.sum("error").alias("label_error"))
    return join_statistics(coded, errors, ["named", "label"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes in SQL: every part against every entry, round by round."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {parts} AS width
  FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM v WHERE e IS NULL OR isnan(e) OR isinf(e)),
p AS MATERIALIZED (
  SELECT vec_id, label, i // width AS part, i % width AS pos, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS x
  FROM v WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM p) ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM p JOIN seed USING (vec_id))"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT vec_id, part, CAST(min(d) // {entries} AS BIGINT) AS d, CAST(min(d) % {entries} AS BIGINT) AS entry
  FROM (SELECT p.vec_id, p.part, sum((p.x - c.x) * (p.x - c.x)) * {entries} + c.entry AS d
        FROM p JOIN c{t} c ON p.part = c.part AND p.pos = c.pos GROUP BY p.vec_id, p.part, c.entry)
  GROUP BY vec_id, part)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM c{t} c LEFT JOIN (
    SELECT p.part, a.entry, p.pos, sum(p.x) AS s, count(*) AS n FROM p JOIN a{t} a ON p.vec_id = a.vec_id AND p.part = a.part
    GROUP BY p.part, a.entry, p.pos) m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)""")
    steps.append(f"""h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT DISTINCT vec_id, label FROM p)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN l USING (vec_id), h""")
    return ",\n".join(steps)
