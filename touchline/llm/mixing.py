"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage
from touchline.llm.words import count_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1 << 14  # words that are left to the exact fit of a source, at least
BUCKET_BITS = 10  # the seeded order of a length is counted in so many leading bits first
BROADCAST_ROWS = 250_000  # (source, length) rows, of under 100 bytes each, up to which they are broadcast


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source``, ``words``.

    Sources in code-point order (NULL last) weigh ``weights`` in turn and share all words by weight. A target
    stops at ``most`` times its source's size; the excess is shared again among the others by weight. Sorted by
    size over weight, the sources that stop come first, so running sums find the level at once.
    """
    totals = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weighed = totals.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1).cast("double").alias("w"))
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    run = order.rowsBetween(W.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    levels = weighed.select(
        "*", cap.alias("cap"),
        ((F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(run), F.lit(0)))
         / (F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(run), F.lit(0.0)))).alias("level"))
    # the level of the first source that it does not fill holds for all after it
    free = F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("_level", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take, so that the words come as near ``budget`` as they can.

    Every length first gives its share of the budget but for ``window`` words, then long documents fill it down to those,
    and a bounded knapsack over the rest fits what is left: bit i of a number says that i words can be reached.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= 0 or budget <= 0:
        return [0] * len(lengths)
    taken = [min(c, c * max(budget - window, 0) // total) for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in order:
        if lengths[i] and rest > window:
            more = min(counts[i] - taken[i], (rest - window) // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    if rest <= 0:
        return taken
    mask, reach, steps = (1 << (2 * rest + 1)) - 1, 1, []
    for i in reversed(order):
        n, left = lengths[i], counts[i] - taken[i]
        if not 0 < n <= 2 * rest or not left or reach >> rest & 1:
            continue
        left = min(left, 2 * rest // n)
        steps.append((i, reach))
        used, size = 0, 1
        while used < left:  # 1, 2, 4 ... copies reach every number of copies
            size = min(size, left - used)
            reach |= reach << (size * n) & mask
            used, size = used + size, size * 2
    at = next(s for d in range(rest + 1) for s in (rest - d, rest + d) if reach >> s & 1)
    for i, before in reversed(steps):
        while not before >> at & 1:
            taken[i] += 1
            at -= lengths[i]
    return taken


def _fit_source(rows: pd.DataFrame, most: int, window: int) -> pd.DataFrame:
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = min(int(target // size), most) if size else 0
    budget = 0 if whole == most else int(np.floor(target - whole * size + 0.5))
    rows = rows.sort_values("words")
    extra = fit_budget(rows["words"].tolist(), rows["n"].tolist(), budget, window)
    return pd.DataFrame({
        "source": rows["source"], "words": rows["words"], "source_size": rows["source_size"], "target": rows["target"],
        "whole": np.int64(whole), "extra": np.array(extra, np.int64)})


def seeded(docs: DataFrame, seed: int) -> DataFrame:
    """Only what is decided on: ``doc_id``, ``source``, ``words`` and the seeded ``place`` of a row among its length."""
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), count_words(text).alias("words"), place_of(seed).alias("place"))


def place_of(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def quotas(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, window: int = WINDOW) -> DataFrame:
    """For each (source, words): ``whole`` copies of every row, and one more of those placed up to ``cut``.

    ``rows`` are those of :func:`seeded`. Lengths are counted with the leading bits of the place, so that the cut
    of a length held by a third of all rows is looked for among a thousandth of them.
    """
    bucket = F.shiftrightunsigned("place", 64 - BUCKET_BITS).alias("bucket")
    counted = cut_lineage(rows.groupBy("source", "words", bucket).agg(F.count("*").alias("n")))
    lengths = counted.groupBy("source", "words").agg(F.sum("n").alias("n"))
    targets = source_targets(counted.select("source", (F.col("words") * F.col("n")).alias("words")), weights, most)
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    joined = lengths.join(targets, same(lengths, targets, "source")).select(lengths["source"], "words", "n", "source_size", "target")
    fitted = cut_lineage(joined.groupBy("source").applyInPandas(
        lambda g: _fit_source(g, most, window), "source string, words long, source_size long, target double, whole long, extra long"))
    running = W.partitionBy("source", "words").orderBy("bucket")
    sums = counted.withColumn("upto", F.sum("n").over(running))
    edge = sums.join(fitted.filter("extra > 0"), same(sums, fitted, "source") + [sums["words"] == fitted["words"]]).filter(
        (F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("n") < F.col("extra"))
    ).select(sums["source"], sums["words"], "bucket", (F.col("extra") - F.col("upto") + F.col("n")).alias("_need"))
    placed = rows.withColumn("bucket", bucket)
    near = placed.join(edge, same(placed, edge, "source") + [placed[x] == edge[x] for x in ("words", "bucket")]).select(
        placed["source"], placed["words"], "place", "_need")
    by_place = near.groupBy("source", "words", "place").agg(F.count("*").alias("n"), F.first("_need").alias("_need"))
    ranked = by_place.withColumn("upto", F.sum("n").over(W.partitionBy("source", "words").orderBy("place")))
    # rows that repeat in full stand at one place and go together, where that comes nearer
    cuts = ranked.filter(2 * (F.col("upto") - F.col("_need")) <= F.col("n")).groupBy("source", "words").agg(F.max("place").alias("cut"))
    cuts = edge.join(cuts, same(edge, cuts, "source") + [edge["words"] == cuts["words"]], "left").select(
        edge["source"], edge["words"], F.struct("bucket", "cut").alias("cut"))
    return fitted.join(cuts, same(fitted, cuts, "source") + [fitted["words"] == cuts["words"]], "left").select(
        fitted["source"].alias("_source"), fitted["words"].alias("_words"), "source_size", "target", "whole", "cut")


def with_copies(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """Rows with ``source``, ``words`` and ``place``, and with ``source_size``, ``target`` and ``copies``.

    The quotas (one row per source and length) are broadcast up to :data:`BROADCAST_ROWS` rows; more are joined by key.
    """
    quota = cut_lineage(quota)
    if quota.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        quota = F.broadcast(quota)
    joined = rows.join(quota, rows["source"].eqNullSafe(quota["_source"]) & (rows["words"] == quota["_words"]), "left")
    bucket = F.shiftrightunsigned("place", 64 - BUCKET_BITS)
    more = F.col("cut").isNotNull() & (
        (bucket < F.col("cut.bucket")) | ((bucket == F.col("cut.bucket")) & F.coalesce(F.col("place") <= F.col("cut.cut"), F.lit(False))))
    return joined.withColumn("copies", F.col("whole") + more.cast("long")).drop("_source", "_words", "whole", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, window: int = WINDOW) -> DataFrame:
    """How often each document is taken, so that every source comes to its target: ``doc_id``, ``size``, ``source``,
    ``source_size``, ``target``, ``copies``, ``taken``, one row per row of ``docs``.

    Whole copies of a source come first; for the remaining budget documents are counted by exact length, the counts
    to take are fitted (:func:`fit_budget`), and among equals of a length a seeded hash decides. Reruns agree.
    NULL texts have size 0; a NULL source is a source of its own and comes last; a NULL doc_id is a value like others.
    Rows that repeat in full are taken together. An empty table gives an empty result; other columns are left aside.
    """
    rows = cut_lineage(seeded(docs, seed))
    return with_copies(rows, quotas(rows, weights, most, window)).select(
        "doc_id", F.col("words").alias("size"), "source", "source_size", "target", "copies", (F.col("words") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it. The columns stay as they are, whatever their names."""
    quota = quotas(cut_lineage(seeded(docs, seed)), weights, most, window)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[
        c.alias(n) for c, n in ((F.col("source").cast("string"), "source"), (count_words(F.col("text")), "words"), (place_of(seed), "place"))])
    rows = with_copies(whole, quota).filter("copies > 0")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
