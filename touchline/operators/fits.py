"""Many k-means and mixture fits over the same rows in the same passes.

A run is a number of clusters, a seeded start and a sample (a column of row weights). One pass over the rows moves the
centres of all runs: a task adds up its rows for every (run, cluster) first, and Spark adds the tasks' sums. The driver
holds centres and sums, whose number depends on the runs alone, and the number of passes on the iterations alone.

Features lie on a grid of 2^-20 (they are standardised columns, so this is far below their noise): sums are whole
numbers, the same in every order, and a fit does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import exp, log, pi

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRID = 1 << 20
PRIME = (1 << 31) - 1
SEEDING, DRAWING = 1, 2  # what a hash is for
MOST_ITERATIONS = 300
MIXTURE_ITERATIONS, MIXTURE_TOLERANCE, RIDGE = 100, 1e-3, 1e-6
CELLS = 1 << 20  # numbers that a task holds at a time
BLOCK = 1 << 16  # the same where all of them should stay in a core's cache
BORDER_FROM = 250_000  # rows times runs from which runs go on with their border rows alone
REACH = 3  # steps of its last length that a reach must span to be worth while
HELD = 1 << 23  # bytes of border rows that a task holds at a time
PACKED = 64  # rows side by side in one stored row of many passes


@dataclass(frozen=True)
class Run:
    k: int
    start: int = 0
    sample: int = 0


def runs(k_values: list[int], n_init: int, samples: int = 1) -> list[Run]:
    return [Run(k, start, sample) for k in k_values for sample in range(samples) for start in range(n_init)]


# ---- hashes that SQL can follow ---------------------------------------------------------


def mixed(*numbers: int) -> int:
    """A pseudo-random number below :data:`PRIME`: each number is added and the sum squared, so that close numbers give unrelated ones."""
    t = 123_456_789
    for v in (*numbers, 0, 0):
        t = ((t + v) ** 2 + 48_271) % PRIME
    return t


def row_hash(key: Column) -> Column:
    """A number below :data:`PRIME` from the first 32 bits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(PRIME))


def linear(*numbers: int) -> tuple[int, int]:
    """Factor and offset of a linear hash."""
    return 1 + mixed(*numbers, 0) % (PRIME - 1), mixed(*numbers, 1)


def uniform(h: np.ndarray, *numbers: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes, by a member of a family of linear hashes chosen by ``numbers``."""
    return _uniform(h, *linear(*numbers))


def _uniform(h: np.ndarray, factor: int | np.ndarray, offset: int | np.ndarray) -> np.ndarray:
    return ((h * factor + offset) % PRIME + 1) / (PRIME + 1.0)


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) distribution, up to the last step that a number of 31 bits can tell from 1."""
    below, mass, steps = 0.0, exp(-1.0), []
    while 1 - below > 2.0**-32 and len(steps) < 20:
        below += mass
        steps.append(below)
        mass /= len(steps)
    return steps


def drawn(h: Column, resamples: int, seed: int) -> Column:
    """How often each bootstrap resample holds a row: Poisson(1) by hash, so that each row draws its own counts."""
    numbers = F.array(*[F.array(*map(F.lit, linear(seed, DRAWING, b))).cast("array<long>") for b in range(resamples)])
    steps = F.array(*[F.lit(s) for s in poisson_steps()])
    u = lambda c: ((h * c[0] + c[1]) % PRIME + 1) / (PRIME + 1.0)
    return F.transform(numbers, lambda c: F.aggregate(steps, F.lit(0), lambda n, s: n + (s <= u(c)).cast("int")))


# ---- rows -------------------------------------------------------------------------------


def on_grid(features: Column) -> Column:
    return F.transform(features, lambda v: F.floor(v * float(GRID) + 0.5).cast("long"))


def points(df: DataFrame, key: str | None = None, weights: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """``h``, ``x`` (array on the grid), ``w`` (a weight for each sample) and the columns ``keep``, stored once.

    ``key`` seeds the row's hashes; without one its features do. ``weights`` is an array of whole numbers that may use the column ``h``.
    """
    x = on_grid(vector_to_array("features"))
    # a task for 4,000 rows, and one for each core at most: the files that were read may be few
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, df.count() // 4000))
    base = df.select(*keep, x.alias("x"), row_hash(F.col(key) if key else F.array_join(x.cast("array<string>"), ",")).alias("h"))
    return cut_lineage(base.repartition(tasks, "h").withColumn("w", (F.array(F.lit(1)) if weights is None else weights).cast("array<int>")))


def packed(points: DataFrame) -> DataFrame:
    """``h``, ``x`` and ``w`` with :data:`PACKED` rows behind each other in one, as bytes, stored once: what is read in hundreds of passes."""
    if dict(points.dtypes)["h"] != "bigint":
        return points

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                ends, out = np.append(np.arange(0, n, PACKED), n), []
                for c in batch.columns:
                    flat = _numbers(c, None)
                    out.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * (flat.nbytes // n)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]))
                yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return cut_lineage(points.select("h", "x", "w").mapInArrow(pack, "h binary, x binary, w binary"))


def _numbers(column: pa.Array, kind: type | None) -> np.ndarray:
    """The numbers of a column one after the other: of a plain one, of lists, or of bytes, which hold ``kind``."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    return (column if pa.types.is_integer(column.type) else column.flatten()).to_numpy()


def _batches(batches: Iterator[pa.RecordBatch], width: int, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, features and weights of so many rows, packed or not, that ``width`` numbers for each of them fit."""
    for batch in batches:
        if batch.num_rows:
            h, x, w = (_numbers(batch.column(c), kind) for c, kind in (("h", np.int64), ("x", np.int64), ("w", np.int32)))
            n, size = len(h), max(1, cells // width)
            x, w = x.reshape(n, -1), w.reshape(n, -1)
            for at in range(0, n, size):
                yield h[at : at + size], x[at : at + size], w[at : at + size].astype(np.int64)


class Centres:
    """Centres of several runs side by side; runs with fewer clusters than the largest have places at infinity."""

    def __init__(self, models: list[np.ndarray]):
        self.models, self.factors = models, None
        self.most = max(len(m) for m in models)
        self.at = np.zeros((len(models), self.most, models[0].shape[1]))
        self.away = np.full((len(models), self.most), np.inf)
        for r, m in enumerate(models):
            self.at[r, : len(m)], self.away[r, : len(m)] = m, 0

    @property
    def width(self) -> int:
        return self.away.size

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances (row, run, cluster), added up dimension by dimension."""
        points = x / GRID
        out = (points[:, 0, None, None] - self.at[None, :, :, 0]) ** 2
        for i in range(1, points.shape[1]):
            out += (points[:, i, None, None] - self.at[None, :, :, i]) ** 2
        return out + self.away

    def two(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(row, run): the nearest cluster as ``gaps(x).argmin(2)`` has it, the least squared distance and what the second
        least has more, and how far these two may be off.

        Distances come from products with the centres in single precision, one cluster of all runs at a time. Where the two
        nearest are too close for that, the pair is settled by the plain distances.
        """
        if self.factors is None:
            size, norms = np.array([len(m) for m in self.models]), (self.at**2).sum(2)
            self.factors, self.norm = np.concatenate([-2 * self.at, norms[:, :, None]], 2).transpose(1, 2, 0).astype(np.float32), norms.max()
            for c in range(self.most):
                self.factors[c][:-1, size <= c], self.factors[c][-1, size <= c] = 0, np.inf
            self.factors = [np.ascontiguousarray(f) for f in self.factors]
        points, shape = x / GRID, (len(x), len(self.models))
        square = (points**2).sum(1)
        ones = np.concatenate([points, np.ones((len(x), 1))], 1).astype(np.float32)
        kind = np.int8 if self.most < 128 else np.int32
        label, best, second = np.zeros(shape, kind), ones @ self.factors[0], np.full(shape, np.inf, np.float32)
        gap, other, less, place = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, bool), np.empty(shape, kind)
        for c in range(1, self.most):
            np.matmul(ones, self.factors[c], out=gap)
            np.less(gap, best, out=less)
            np.multiply(less, kind(c), out=place)
            np.maximum(label, place, out=label)
            np.maximum(best, gap, out=other)
            np.minimum(second, other, out=second)
            np.minimum(best, gap, out=best)
        np.subtract(second, best, out=second)
        off = float(4 * (x.shape[1] + 4) * np.finfo(np.float32).eps * (square.max(initial=0.0) + self.norm))
        row, run = np.nonzero(second <= off)
        if len(row):
            out = (points[row, 0, None] - self.at[run, :, 0]) ** 2
            for i in range(1, points.shape[1]):
                out += (points[row, i, None] - self.at[run, :, i]) ** 2
            label[row, run] = (out + self.away[run]).argmin(1)
        return label, best + square[:, None], second, off


def _added(x: np.ndarray, weight: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers (cluster, run, 1 + dimension): weights, and weighted features of the rows that have the cluster's label."""
    sizes = np.concatenate([weight[:, None], weight[:, None] * x], 1).T.astype(float)
    rows = _exact(sizes)
    return np.stack([_sums(sizes, (label == c).astype(float), rows) for c in range(most)])


def _exact(sizes: np.ndarray) -> int:
    """How many columns of whole numbers can be added up in double precision without loss."""
    return max(1, int(2.0**53 / max(np.abs(sizes).max(initial=0.0), 1.0)))


def _sums(sizes: np.ndarray, taken: np.ndarray, rows: int) -> np.ndarray:
    """Whole numbers: the columns of ``sizes`` added up as often as each column of ``taken`` says, so many at a time as are exact."""
    out = np.zeros((taken.shape[1], len(sizes)), np.int64)
    for at in range(0, len(taken), rows):
        out += (sizes[:, at : at + rows] @ taken[at : at + rows]).T.astype(np.int64)
    return out


Side = tuple[int, list[int], Centres]  # a sample, the places of its runs among all runs, and their centres


def _sides(models: list[np.ndarray], samples: list[int], most: int | None = None) -> list[Side]:
    """The runs of each sample, ``most`` at a time."""
    places: dict[int, list[int]] = {}
    for i, sample in enumerate(samples):
        places.setdefault(sample, []).append(i)
    parts = [(sample, at[i : i + (most or len(at))]) for sample, at in places.items() for i in range(0, len(at), most or len(at))]
    return [(sample, at, Centres([models[i] for i in at])) for sample, at in parts]


def _drawn_rows(batches: Iterator[pa.RecordBatch], sides: list[Side], cells: int = BLOCK, deep: bool = False) -> Iterator[tuple]:
    """Sample by sample the hashes, features and weights of the rows that it holds, with its places and centres: rows of weight 0 take no part.

    There are so many rows that ``cells`` numbers fit for all runs of a sample, or with ``deep`` for all their centres.
    """
    width = max(8, *(centres.width if deep else len(at) for _, at, centres in sides))
    for h, x, w in _batches(batches, width, cells):
        w = np.ascontiguousarray(w.T)
        for sample, at, centres in sides:
            on = np.flatnonzero(w[sample])
            if len(on) == len(h):
                yield h, x, w[sample], at, centres
            elif len(on):
                yield h[on], x[on], w[sample][on], at, centres


def _collect(points: DataFrame, run, schema: str, keys: list[str], sums: list[str]) -> list:
    """What every task has added up by ``keys``, added up over the tasks."""
    return points.select("h", "x", "w").mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).collect()


# ---- k-means ------------------------------------------------------------------------------


def seeds(points: DataFrame, wanted: list[Run], seed: int) -> list[np.ndarray]:
    """Starting centres of all runs: one pass for each centre.

    Every row runs a race of length ``-ln(u) / (weight * squared distance to the centres so far)`` and the shortest
    wins, which takes a row with a chance in proportion to its weight and squared distance. A run gets fewer centres
    where there are fewer different rows.
    """
    found: list[list[list[float]]] = [[] for _ in wanted]
    for step in range(max(r.k for r in wanted)):
        active = [i for i, r in enumerate(wanted) if step < r.k and len(found[i]) == step]
        if not active:
            break
        # before the first centre every row is as far away as any other: the places of the runs are all that counts
        sides = _sides([np.array(found[i]) if step else np.zeros((1, 1)) for i in active], [wanted[i].sample for i in active])
        hashes = np.array([linear(seed, SEEDING, wanted[i].start, wanted[i].sample, step) for i in active]).T

        def race(batches, active=active, sides=sides, hashes=hashes, step=step):
            best: dict[int, tuple] = {}
            for h, x, w, at, so_far in _drawn_rows(batches, sides, deep=True):
                pull = w[:, None] * (so_far.gaps(x).min(2) if step else np.ones((len(h), len(at))))
                with np.errstate(divide="ignore"):
                    length = np.where(pull > 0, -np.log(_uniform(h[:, None], *hashes[:, at])) / pull, np.inf)
                first = length.argmin(0)
                for j, (row, i) in enumerate(zip(first.tolist(), at, strict=True)):
                    if length[row, j] < np.inf:
                        best[active[i]] = min(best.get(active[i], (np.inf,)), (float(length[row, j]), int(h[row]), x[row].tolist()))
            yield pa.RecordBatch.from_arrays([
                pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()), pa.array([b[1] for b in best.values()], pa.int64()),
                pa.array([b[2] for b in best.values()], pa.list_(pa.int64()))], ["run", "length", "h", "x"])

        won = points.select("h", "x", "w").mapInArrow(race, "run int, length double, h long, x array<long>").groupBy("run").agg(
            F.min(F.struct("length", "h", "x")).alias("b")).collect()
        for r in won:
            found[r["run"]].append([v / GRID for v in r["b"]["x"]])
    return [np.array(f, float) for f in found]


def _moved(points: DataFrame, models: list[np.ndarray], samples: list[int]) -> list[np.ndarray]:
    """The mean of the rows next to every centre; a centre without rows stays."""
    sides, dims, most = _sides(models, samples), models[0].shape[1], max(len(m) for m in models)
    names = ["n", *(f"s{i}" for i in range(dims))]

    def add(batches):
        totals = np.zeros((most, len(models), 1 + dims), np.int64)
        for _, x, w, at, centres in _drawn_rows(batches, sides):
            totals[: centres.most, at] += _added(x, w, centres.two(x)[0], centres.most)
        totals = totals.transpose(2, 1, 0).reshape(1 + dims, -1)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(t[used]) for t in totals)], ["place", *names])

    out = [m.copy() for m in models]
    for r in _collect(points, add, "place int, " + ", ".join(f"{s} long" for s in names), ["place"], names):
        run, cluster = divmod(r["place"], most)
        out[run][cluster] = _mean([r[s] for s in names])
    return out


def _mean(sums: list[int]) -> list[float]:
    """A centre from whole numbers: the weight of its rows and their weighted features."""
    return [v / sums[0] / GRID for v in sums[1:]]


def _step(now: np.ndarray, before: np.ndarray) -> float:
    """How far the centre that went furthest has gone; 0 at rest alone."""
    return 0.0 if np.array_equal(now, before) else max(float(np.sqrt(((now - before) ** 2).sum(1).max())), np.finfo(float).tiny)


def _went(now: np.ndarray, before: np.ndarray) -> float:
    """How far the two centres that went furthest have gone together."""
    return float(np.sort(np.sqrt(((now - before) ** 2).sum(1)))[-2:].sum())


def _sure(went: float) -> float:
    """The distance, above that of its nearest centre, from which on no other centre can have become the nearest one of a row."""
    return went * (1 + 1e-6) + 1e-9


@dataclass
class Settled:
    model: np.ndarray
    passes: int  # steps made
    step: float  # the furthest that a centre went in the last of them; 0 at rest
    border: int  # rows that were looked at


def _margin(least: np.ndarray, more: np.ndarray, off: float) -> np.ndarray:
    """From what :meth:`Centres.two` gives, how much further the second nearest centre of a row is off than its nearest, at least."""
    least = np.maximum(least, 0) + off
    with np.errstate(invalid="ignore"):  # a single centre has no second: no number, which is below no bound
        # a difference of distances times their sum is that of their squares
        return (more - 2 * off) / (np.sqrt(least) + np.sqrt(least + more + off))


def _settle(model: np.ndarray, inner: np.ndarray, x: np.ndarray, sizes: np.ndarray, places: np.ndarray, wide: float, most: int) -> Settled:
    """Steps of :func:`_moved` for one run, until it rests, its centres have gone further than ``wide``, or ``most`` steps are made.

    ``inner`` has the sums (cluster, 1 + dimension) of rows that keep their cluster meanwhile. The others have features ``x`` on the grid,
    ``sizes`` (weight and weighted features) and ``places`` (features and 1), which are turned. A step looks at those alone whose margin the
    centres may have used up since all were looked at, and puts right the sums of those that have another centre now.
    """
    begun, origin, spent, dims = model, None, 0, len(places) - 1
    square, rows, each = float((places[:dims] ** 2).sum(0).max(initial=0.0)), _exact(sizes), np.arange(len(model))
    for passes in range(1, most + 1):
        if origin is not None:
            on = np.flatnonzero(margin <= _sure(_went(model, origin)))
            spent += len(on)
        if origin is None or spent > 2 * len(x):
            origin, spent = model, 0
            label, least, more, off = (v if np.isscalar(v) else v[:, 0] for v in Centres([model]).two(x))
            margin = _margin(least, more, off)
            sums = whole = inner + np.concatenate([_sums(sizes, (label == c).astype(float)[:, None], rows) for c in each])
        else:
            norms = (model**2).sum(1)
            far = np.concatenate([-2 * model, norms[:, None]], 1) @ places[:, on]
            own = label[on] * np.intp(len(on)) + np.arange(len(on))
            mine = far.ravel()[own]
            far.ravel()[own] = np.inf
            # where another centre is as near but for rounding, plain distances tell
            on = on[far.min(0) <= mine + 8 * (dims + 4) * np.finfo(float).eps * (square + norms.max())]
            now = Centres([model]).gaps(x[on]).argmin(2)[:, 0]
            turned = now != label[on]
            on, now = on[turned], now[turned]
            sums = whole + _sums(sizes[:, on], (now[:, None] == each).astype(float) - (label[on, None] == each), rows)
        moved = model.copy()
        for c, total in enumerate(sums.tolist()):
            if total[0]:
                moved[c] = _mean(total)
        step, model = _step(moved, model), moved
        if not step or _went(model, begun) > wide:
            break
    return Settled(model, passes, step, len(x))


def _settled(points: DataFrame, models: list[np.ndarray], samples: list[int], reach: list[float], left: list[int]) -> list[Settled]:
    """Many steps of :func:`_moved` in one job: for every run as many as its border rows tell, and ``left`` at most.

    A row whose second nearest centre is more than twice the reach further off than its nearest keeps its cluster while no two centres
    together go further than that. Such rows are added up where they lie. The others, the border rows, meet in one place for some runs of a
    sample.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    sides, dims, most = _sides(models, samples, max(1, len(models) // (4 * cores))), models[0].shape[1], max(len(m) for m in models)
    wide, names = np.array([2 * r for r in reach]), ["side", "run", "sums", "x", "w"]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def find(batches):
        totals, held, size = np.zeros((most, len(models), 1 + dims), np.int64), [], 0
        number = {at[0]: i for i, (_, at, _) in enumerate(sides)}
        for _, x, w, at, centres in _drawn_rows(batches, sides):
            on = np.arange(len(x))
            if np.isfinite(wide[at]).all():
                label, *far = centres.two(x)
                near = (_margin(*far) <= _sure(wide[at])).any(1)
                on = np.flatnonzero(near)
                totals[: centres.most, at] += _added(x[~near], w[~near], label[~near], centres.most)
            if len(on):
                x, w = x[on], w[on].astype(np.int32)
                held.append((number[at[0]], None, None, x.astype(np.min_scalar_type(-int(np.abs(x).max()) - 1)).tobytes(), w.tobytes()))
                size += len(held[-1][3]) + len(held[-1][4])
            if size >= HELD:
                yield batch(held)
                held, size = [], 0
        for i, (_, at, _) in enumerate(sides):
            held += [(i, r, totals[: len(models[r]), r].ravel().tolist(), None, None) for r in at if totals[:, r, 0].any()]
        if held:
            yield batch(held)

    def settle(table: pa.Table) -> pa.Table:
        at = sides[table.column("side")[0].as_py()][1]
        inner, parts = {r: np.zeros((len(models[r]), 1 + dims), np.int64) for r in at}, [(np.zeros((0, dims), np.int64), np.zeros(0, np.int64))]
        for run, sums, x, w in zip(*(table.column(c).to_pylist() for c in names[1:]), strict=True):
            if sums:
                inner[run] += np.reshape(sums, inner[run].shape)
            else:
                w = np.frombuffer(w, np.int32)
                parts.append((np.frombuffer(x, f"i{len(x) // len(w) // dims}").reshape(len(w), dims).astype(np.int64), w.astype(np.int64)))
        x, w = map(np.concatenate, zip(*parts))
        sizes = np.concatenate([w[None], w * x.T]).astype(float)
        places = np.concatenate([x.T / GRID, np.ones((1, len(x)))])
        out = [_settle(models[r], inner[r], x, sizes, places, wide[r], left[r]) for r in at]
        return pa.table({"run": pa.array(at, pa.int32()), "passes": pa.array([s.passes for s in out], pa.int32()), "step": pa.array([s.step for s in out], pa.float64()),
                         "border": pa.array([s.border for s in out], pa.int64()), "centres": pa.array([s.model.ravel().tolist() for s in out], pa.list_(pa.float64()))})

    found = points.select("h", "x", "w").mapInArrow(find, "side int, run int, sums array<long>, x binary, w binary").repartition(
        min(len(sides), 16 * cores), "side").groupBy("side").applyInArrow(settle, "run int, passes int, step double, border long, centres array<double>")
    out = [Settled(m, 1, 0.0, 0) for m in models]  # a run without rows rests
    for r in found.collect():
        out[r["run"]] = Settled(np.array(r["centres"]).reshape(-1, dims), r["passes"], r["step"], r["border"])
    return out


def _costs(points: DataFrame, models: list[np.ndarray], samples: list[int]) -> list[int]:
    """Weighted squared distances to the nearest centres, each rounded to the grid."""
    sides = _sides(models, samples)

    def add(batches):
        total = np.zeros(len(models), np.int64)
        for _, x, w, at, centres in _drawn_rows(batches, sides, deep=True):
            total[at] += (w[:, None] * np.floor(centres.gaps(x).min(2) * GRID + 0.5).astype(np.int64)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(total)], ["run", "cost"])

    found = {r["run"]: r["cost"] for r in _collect(points, add, "run int, cost long", ["run"], ["cost"])}
    return [found.get(i, 0) for i in range(len(models))]


def kmeans(points: DataFrame, wanted: list[Run], seed: int = 42, iterations: int = MOST_ITERATIONS) -> list[np.ndarray]:
    """Centres of every run after it has come to rest.

    Whole passes move all runs together. From :data:`BORDER_FROM` on, a run whose steps are short goes on with its border rows in one place,
    for as many steps as these rows tell; all rows are border rows where few enough can meet there.
    """
    many, points = points.count(), packed(points)
    models = seeds(points, wanted, seed)
    left = {i: iterations for i, m in enumerate(models) if m.size and iterations}
    # so many rows can meet in one place; where there are more, a share of the distance of the closest centres is the reach that about so many
    # rows are within, put right by how many are found
    room = CELLS // (1 + max((m.shape[1] for m in models if m.size), default=0))
    share = dict.fromkeys(left, np.inf if many <= room else 0.2 * room / many)
    at_borders = many * len(left) >= BORDER_FROM
    step: dict[int, float] = {}

    def reach(i: int) -> float:
        if share[i] < np.inf:
            far = share[i] * _closest(models[i]) if len(models[i]) > 1 else 0.0
            return far if far >= REACH * step.get(i, np.inf) else 0.0
        return np.inf

    while left:
        on = list(left)
        reaches = [reach(i) for i in on] if at_borders else []
        if any(reaches):
            made = _settled(points, [models[i] for i in on], [wanted[i].sample for i in on], reaches, [left[i] for i in on])
        else:
            moved = _moved(points, [models[i] for i in on], [wanted[i].sample for i in on])
            made = [Settled(m, 1, _step(m, models[i]), 0) for i, m in zip(on, moved, strict=True)]
        for j, (i, s) in enumerate(zip(on, made, strict=True)):
            models[i], step[i], left[i] = s.model, s.step, left[i] - s.passes
            if any(reaches) and 0 < reaches[j] < np.inf:
                share[i] *= min(max(room / max(s.border, 1), 0.5), 2.0)
            if s.step == 0 or not left[i]:
                del left[i]
    return models


def _closest(model: np.ndarray) -> float:
    """Distance of the two closest centres."""
    gaps = ((model[:, None] - model[None]) ** 2).sum(2)
    return float(np.sqrt(gaps[~np.eye(len(model), dtype=bool)].min()))


def best(points: DataFrame, wanted: list[Run], seed: int = 42, models: list[np.ndarray] | None = None) -> dict[tuple[int, int], np.ndarray]:
    """By (k, sample) the centres of the cheapest run, ties to the first start. ``models`` are the runs at rest, where they are known."""
    models = kmeans(points, wanted, seed) if models is None else models
    full = [i for i, m in enumerate(models) if m.size]
    if not full:
        return {}
    costs = _costs(points, [models[i] for i in full], [wanted[i].sample for i in full])
    out: dict[tuple[int, int], tuple] = {}
    for i, cost in zip(full, costs, strict=True):
        name = (wanted[i].k, wanted[i].sample)
        out[name] = min(out.get(name, (cost, wanted[i].start, i)), (cost, wanted[i].start, i))
    return {name: models[i] for name, (_, _, i) in out.items()}


def nearest(x: Column, centres: np.ndarray) -> Column:
    """Index of the nearest centre to an array on the grid; ties to the first."""
    def gap(c):
        out = None
        for i, v in enumerate(c.tolist()):
            part = x[i] / float(GRID) - v
            out = part * part if out is None else out + part * part
        return out

    return F.array_min(F.array(*[F.struct(gap(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]


def labels(points: DataFrame, models: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep``, ``w`` and ``labels``: the cluster of each row in every model."""
    centres = Centres(models)
    kinds = dict(points.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, CELLS // centres.width)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                found = centres.gaps(x).argmin(2).astype(np.int32)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*keep, "w")), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*keep, "w", "labels"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keep, "w"))
    return points.select(*dict.fromkeys([*keep, "x", "w"])).mapInArrow(run, f"{schema}, labels array<int>")


def qualities(points: DataFrame, models: list[np.ndarray]) -> list[dict[str, float | None]]:
    """Silhouette (squared distances), Calinski-Harabasz, Davies-Bouldin and inertia of every model, in two passes for all.

    Rows count once, whatever their weights.
    """
    centres, dims = Centres(models), models[0].shape[1]
    names = ["n", "q", *(f"s{i}" for i in range(dims))]

    def first(batches):
        totals = np.zeros((2 + dims, centres.width))
        for _, x, _w in _batches(batches, centres.width):
            place = (centres.gaps(x).argmin(2) + np.arange(len(models)) * centres.most).ravel()
            values = x / GRID
            for t, v in zip(totals, [np.ones(len(x)), (values**2).sum(1), *values.T], strict=True):
                t += np.bincount(place, weights=np.repeat(v, len(models)), minlength=centres.width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(centres.width, dtype=np.int32)), *(pa.array(t) for t in totals)], ["place", *names])

    n, q, s = np.zeros(centres.width), np.zeros(centres.width), np.zeros((centres.width, dims))
    for r in _collect(points, first, "place int, " + ", ".join(f"{c} double" for c in names), ["place"], names):
        n[r["place"]], q[r["place"]], s[r["place"]] = r["n"], r["q"], [r[f"s{i}"] for i in range(dims)]
    shape = (len(models), centres.most)
    n, q, means = n.reshape(shape), q.reshape(shape), (s / np.maximum(n, 1)[:, None]).reshape(*shape, dims)

    def second(batches):
        totals = np.zeros((2, centres.width))
        for _, x, _w in _batches(batches, centres.width * 2):
            label = centres.gaps(x).argmin(2)
            values = x / GRID
            each = np.arange(len(models))
            with np.errstate(invalid="ignore", divide="ignore"):
                # mean squared distance to the rows of every cluster, from its count, sum and sum of squares
                mean = (values**2).sum(1)[:, None, None] + (q / n)[None] - 2 * np.einsum("ni,rki->nrk", values, means)
                own = n[each, label]
                inner = np.take_along_axis(mean, label[:, :, None], 2)[:, :, 0] * own / np.maximum(own - 1, 1)
                np.put_along_axis(mean, label[:, :, None], np.inf, 2)
                outer = np.where(n[None] > 0, mean, np.inf).min(2)
                width = np.maximum(inner, outer)
                value = np.where((own == 1) | (width <= 0) | ~np.isfinite(outer), 0, (outer - inner) / width)
                spread = np.sqrt(((values[:, None] - means[each, label]) ** 2).sum(2))
            place = (label + each * centres.most).ravel()
            totals[0] += np.bincount(place, weights=value.ravel(), minlength=centres.width)
            totals[1] += np.bincount(place, weights=spread.ravel(), minlength=centres.width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(centres.width, dtype=np.int32)), *(pa.array(t) for t in totals)], ["place", "v", "d"])

    v, d = np.zeros(centres.width), np.zeros(centres.width)
    for r in _collect(points, second, "place int, v double, d double", ["place"], ["v", "d"]):
        v[r["place"]], d[r["place"]] = r["v"], r["d"]
    v, d, out = v.reshape(shape), d.reshape(shape), []
    for r in range(len(models)):
        on = np.flatnonzero(n[r])
        k, rows, m = len(on), n[r].sum(), means[r, on]
        whole = (n[r, on, None] * m).sum(0) / max(rows, 1)
        within = float((q[r, on] - n[r, on] * (m**2).sum(1)).sum())
        between = float((n[r, on] * ((m - whole) ** 2).sum(1)).sum())
        spread, gaps = d[r, on] / n[r, on], np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        worst = [max((spread[i] + spread[j]) / gaps[i, j] for j in range(k) if j != i) for i in range(k)] if k > 1 else []
        out.append({
            "silhouette": float(v[r].sum() / rows) if rows else None, "inertia": within,
            "calinski_harabasz": float((between / (k - 1)) / (within / (rows - k))) if k > 1 and rows > k and within > 0 else None,
            "davies_bouldin": float(np.mean(worst)) if worst else None})
    return out


# ---- mixtures -----------------------------------------------------------------------------


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray  # lower triangles of the covariances
    likelihood: float = -np.inf  # mean log-likelihood of the rows before the last step

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, (row, component): the triangles are solved dimension by dimension."""
        dims = x.shape[1]
        out = np.log(self.weights) - dims / 2 * log(2 * pi) - np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(1) + np.zeros((len(x), 1))
        solved: list[np.ndarray] = []
        for i in range(dims):
            left = x[:, i, None] - self.means[None, :, i]
            if i:
                less = solved[0] * self.factors[:, i, 0]
                for j in range(1, i):
                    less += solved[j] * self.factors[:, i, j]
                left -= less
            left /= self.factors[:, i, i]
            solved.append(left)
            out -= left * left / 2
        return out


def _maximised(points: DataFrame, count: list[int], dims: int, share) -> list[Mixture | None]:
    """One step for all runs: weights, sums and outer products of every component by ``share(x)``: a column of shares
    for each component of each run after the other, and the log-likelihoods of the runs.

    A component without weight keeps a place of its own and no rows.
    """
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    names = ["n", *(f"s{i}" for i in range(dims)), *(f"p{i}_{j}" for i, j in pairs)]
    begin = np.concatenate([[0], np.cumsum(count)])

    def add(batches):
        totals, likelihood, rows = np.zeros((len(names), begin[-1])), np.zeros(len(count)), 0
        for _, x, _w in _batches(batches, int(begin[-1]), BLOCK):
            values = x / GRID
            rows += len(x)
            moments = np.stack([np.ones(len(x)), *values.T, *(values[:, i] * values[:, j] for i, j in pairs)])
            shares, total = share(values)
            totals += moments @ shares
            likelihood += total
        place = np.arange(-1 - len(count), begin[-1], dtype=np.int32)  # before the components: rows, and the likelihood of every run
        first = np.concatenate([[rows], likelihood, totals[0]])
        rest = [np.concatenate([np.zeros(1 + len(count)), t]) for t in totals[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(first), *map(pa.array, rest)], ["place", *names])

    got = {r["place"]: r for r in _collect(points, add, "place int, " + ", ".join(f"{c} double" for c in names), ["place"], names)}
    rows, out = got[-1 - len(count)]["n"] if got else 0, []
    for r, k in enumerate(count):
        if not rows:
            out.append(None)
            continue
        n = np.array([got[int(begin[r]) + c]["n"] for c in range(k)]) + 10 * np.finfo(float).eps
        means = np.array([[got[int(begin[r]) + c][f"s{i}"] for i in range(dims)] for c in range(k)]) / n[:, None]
        spread = np.zeros((k, dims, dims))
        for c in range(k):
            for i, j in pairs:
                spread[c, i, j] = spread[c, j, i] = got[int(begin[r]) + c][f"p{i}_{j}"] / n[c] - means[c, i] * means[c, j]
            spread[c] += RIDGE * np.eye(dims)
        out.append(Mixture(n / n.sum(), means, np.linalg.cholesky(spread), got[r - len(count)]["n"] / rows))
    return out


def mixture_start(points: DataFrame, models: list[np.ndarray]) -> list[Mixture | None]:
    """Mixtures whose components are the clusters of the models."""
    centres = Centres(models)

    def share(values: np.ndarray):
        label = centres.gaps(values * GRID).argmin(2)
        return np.concatenate([np.eye(len(m))[label[:, r]] for r, m in enumerate(models)], 1), 0.0

    return _maximised(points, [len(m) for m in models], models[0].shape[1], share)


def mixture_steps(points: DataFrame, mixtures: list[Mixture]) -> list[Mixture]:
    """One step of expectation and maximisation for every mixture, in one pass."""
    side_by_side = Mixture(*(np.concatenate([getattr(m, f) for m in mixtures]) for f in ("weights", "means", "factors")))
    count = np.array([len(m.weights) for m in mixtures])
    begin = np.cumsum(count) - count

    def share(values: np.ndarray):
        joint = side_by_side.log_joint(values)
        top = np.maximum.reduceat(joint, begin, axis=1)
        out = np.exp(joint - np.repeat(top, count, axis=1))
        whole = np.add.reduceat(out, begin, axis=1)
        return out / np.repeat(whole, count, axis=1), (top + np.log(whole)).sum(0)

    return _maximised(points, [len(m.weights) for m in mixtures], mixtures[0].means.shape[1], share)


def mixtures(points: DataFrame, models: list[np.ndarray]) -> list[Mixture]:
    """A mixture grown from each model, until its mean log-likelihood gains less than the tolerance."""
    points = packed(points)
    found = mixture_start(points, models) if models else []
    active = [i for i, m in enumerate(found) if m is not None]
    for m in found:
        if m is not None:
            m.likelihood = -np.inf
    for _ in range(MIXTURE_ITERATIONS):
        if not active:
            break
        after = mixture_steps(points, [found[i] for i in active])
        still = [abs(a.likelihood - found[i].likelihood) >= MIXTURE_TOLERANCE for i, a in zip(active, after, strict=True)]
        for i, a in zip(active, after, strict=True):
            found[i] = a
        active = [i for i, s in zip(active, still, strict=True) if s]
    return found


def best_mixtures(points: DataFrame, k_values: list[int], n_init: int = 20, seed: int = 42,
                  rested: list[np.ndarray] | None = None) -> dict[int, Mixture]:
    """By k the likeliest mixture grown from ``n_init`` seeded k-means runs (``rested``, where they are known).

    Runs that rest at the same centres are grown once.
    """
    wanted = runs(k_values, n_init)
    models: dict[tuple, np.ndarray] = {}
    for r, m in zip(wanted, kmeans(points, wanted, seed) if rested is None else rested, strict=True):
        if m.size:
            models.setdefault((r.k, tuple(sorted(map(tuple, m.tolist())))), m)
    out: dict[int, Mixture] = {}
    for (k, _), m in zip(models, mixtures(points, list(models.values())), strict=True):
        if k not in out or round(m.likelihood, 9) > round(out[k].likelihood, 9):
            out[k] = m
    return out


def _once(value: Column, use) -> Column:
    """``use(value)``, where ``value`` stands once in the plan and is worked out once for a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shares(x: Column, mixture: Mixture) -> Column:
    """Probabilities of the components for an array on the grid, as an expression.

    The triangles are inverted here, so that a solved difference is one sum over dimensions and does not repeat those before it.
    """
    def joint(at: Column) -> Column:
        out = []
        for weight, mean, factor in zip(mixture.weights.tolist(), mixture.means.tolist(), mixture.factors, strict=True):
            value = F.lit(log(weight) - len(mean) / 2 * log(2 * pi) - float(np.log(np.diagonal(factor)).sum()))
            for i, row in enumerate(np.linalg.inv(factor).tolist()):
                solved = reduce(lambda a, b: a + b, [(at[j] - mean[j]) * row[j] for j in range(i + 1)])
                value = value - solved * solved / 2.0
            out.append(value)
        return F.array(*out)

    scaled = lambda v: _once(F.array_max(v), lambda top: F.transform(v, lambda a: F.exp(a - top)))
    part = lambda e: _once(F.aggregate(e, F.lit(0.0), lambda s, b: s + b), lambda total: F.transform(e, lambda a: a / total))
    return _once(F.transform(x, lambda v: v / float(GRID)), lambda at: _once(joint(at), lambda v: _once(scaled(v), part)))
