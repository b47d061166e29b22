"""Exact ranks and quantiles in one lazy plan, without a whole group in one task.

Values are cut into cells by a number that follows their order: sign and binary logarithm, ``FINE`` cells to an octave, in
blocks of ``BLOCK`` cells. Cells follow from the values alone, so every branch of a plan and every retried task cuts
alike, the number of cells in use grows with the data, and far outliers or tiny scales cost nothing. Blocks and cells are
counted with map-side combine and numbered by running sums; values are ordered only inside their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FINE = 1 << 17
BLOCK = 1 << 12
ABOVE = 1100 * FINE  # cells of positive values begin here: no logarithm of a double is below -1,100
ENDLESS = 1 << 40


def cell(value: Column) -> Column:
    """A number that never falls where the value rises; NaN is above all others."""
    v = value.cast("double")
    size = F.abs(v)
    steps = F.when(size == float("inf"), F.lit(ENDLESS)).otherwise(F.floor(F.log2(F.when(size < float("inf"), size)) * float(FINE)) + ABOVE)
    return F.when(F.isnan(v), F.lit(2 * ENDLESS)).when(v == 0, F.lit(0)).when(v < 0, -steps).otherwise(steps).cast("long")


def _celled(df: DataFrame, groups: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """Rows with a value, with ``_cell`` and ``_block``; a constant stands for no groups."""
    rows = df.filter(F.col(value).isNotNull())
    rows = (rows if groups else rows.withColumn("_all", F.lit(0))).withColumn("_cell", cell(F.col(value)))
    return rows.withColumn("_block", F.floor(F.col("_cell") / float(BLOCK))), groups or ["_all"]


def _running(name: str, window) -> Column:
    """Sum over the rows before this one."""
    return F.coalesce(F.sum(name).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))


def value_positions(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per (group, value): ``n`` copies, ``below`` rows under it, ``dense`` rank.

    NULL values are left out. Group totals are ``total`` (rows) and ``levels`` (distinct values).
    """
    rows, keys = _celled(df, groups, value)
    counts = rows.groupBy(*keys, "_block", "_cell", value).agg(F.count("*").alias("n"))
    cells = counts.groupBy(*keys, "_block", "_cell").agg(F.sum("n").alias("_rows"), F.count("*").alias("_levels"))
    blocks = cells.groupBy(*keys, "_block").agg(F.sum("_rows").alias("_rows"), F.sum("_levels").alias("_levels"))
    whole, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_block")
    blocks = blocks.select(
        *keys, "_block", _running("_rows", order).alias("_rows_before"), _running("_levels", order).alias("_levels_before"),
        F.sum("_rows").over(whole).alias("total"), F.sum("_levels").over(whole).alias("levels"))
    order = W.partitionBy(*keys, "_block").orderBy("_cell")
    cells = cells.select(*keys, "_block", "_cell", _running("_rows", order).alias("_r"), _running("_levels", order).alias("_l")).join(
        blocks, [*keys, "_block"]).select(
        *keys, "_block", "_cell", (F.col("_r") + F.col("_rows_before")).alias("_r"), (F.col("_l") + F.col("_levels_before")).alias("_l"), "total", "levels")
    order = W.partitionBy(*keys, "_block", "_cell").orderBy(value)
    out = counts.withColumns({"_b": _running("n", order), "_d": F.row_number().over(order)}).join(cells, [*keys, "_block", "_cell"])
    return out.select(
        *groups, value, "n", (F.col("_b") + F.col("_r")).alias("below"), (F.col("_d") + F.col("_l")).alias("dense"), "total", "levels")


def average_rank() -> Column:
    """Average rank (ascending, from 1) over a ``value_positions`` row."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def scaled_rank() -> Column:
    """Average rank scaled to 0..1, 0.5 in a group of one row."""
    return F.when(F.col("total") <= 1, F.lit(0.5)).otherwise(
        (average_rank() - 1) / F.nullif((F.col("total") - 1).cast("double"), F.lit(0.0))
    )


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form, so that many columns are ranked by one shuffle instead of one each."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias(value)) for v in values])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")


def repivot(long: DataFrame, keys: list[str], columns: dict[str, str], name: str = "metric", value: str = "value") -> DataFrame:
    """Inverse of :func:`unpivot`; ``columns`` maps a metric to its output column."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == m, F.col(value))).alias(out) for m, out in columns.items()]
    )


def rank_columns(df: DataFrame, keys: list[str], groups: list[str], columns: dict[str, str], score) -> DataFrame:
    """``keys`` plus one score per column; ``score`` is an expression over a positions row."""
    long = unpivot(df, list(dict.fromkeys(keys + groups)), list(columns))
    positions = value_positions(long, groups + ["metric"], "value")
    scored = long.join(positions, groups + ["metric", "value"], "left").withColumn("_score", score)
    return repivot(scored, keys, columns, value="_score")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, qs: list[float], few_groups: bool = False) -> DataFrame:
    """Linear-interpolated quantiles, long form: groups, ``q``, ``value``.

    The block that holds a wanted place is found from counts of blocks, its cell from the cells of that block, and only
    the values of that cell are ordered: what is shuffled does not grow with the number of different values. With
    ``few_groups`` the caller vouches that there are few (metric names of a report, say), and the wanted places, two for
    each group and quantile, are broadcast; else adaptive planning decides.
    """
    rows, keys = _celled(df, groups, value)
    hinted = F.broadcast if few_groups or not groups else (lambda d: d)
    holds = (F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("n"))

    def narrowed(found: DataFrame, by: list[str], column: str) -> DataFrame:
        """Of the places ``found`` in ``by``, the ``column`` that holds each, and the place inside it."""
        inside = rows if by == keys else rows.join(hinted(found.select(*by).distinct()), by, "left_semi")
        counts = inside.groupBy(*by, column).agg(F.count("*").alias("n"))
        counts = counts.withColumn("below", _running("n", W.partitionBy(*by).orderBy(column)))
        if by == keys:
            target = F.col("q") * (F.col("total") - 1)
            ends = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(end).alias("end")) for q in qs for end in (0, 1)])
            met = counts.withColumn("total", F.sum("n").over(W.partitionBy(*by))).select("*", F.explode(ends).alias("_e")).select("*", "_e.*").withColumns(
                {"place": F.when(F.col("end") == 0, F.floor(target)).otherwise(F.ceil(target)), "share": target - F.floor(target)})
        else:
            met = counts.join(hinted(found), by)
        return met.filter(holds).select(*by, column, "q", "end", "share", (F.col("place") - F.col("below")).alias("place"))

    found, by = None, keys
    for column in ("_block", "_cell", value):
        found = narrowed(found, by, column)
        by = [*by, column]
    end = lambda i: F.max(F.when(F.col("end") == i, F.col(value).cast("double")))
    return found.groupBy(*keys, "q").agg(end(0).alias("_lo"), end(1).alias("_hi"), F.max("share").alias("_w")).select(
        *groups, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("value"))


def quantile_scalars(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """Whole-table quantiles of several columns as scalar subqueries from one long pass."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    qs = sorted({q for _, q in wanted.values()})
    table = exact_quantiles(unpivot(df, [], columns), ["metric"], "value", qs, few_groups=True)
    row = table.agg(F.struct(*[
        F.max(F.when((F.col("metric") == c) & (F.col("q") == float(q)), F.col("value"))).alias(k)
        for k, (c, q) in wanted.items()
    ]).alias("s")).scalar()
    return {k: row.getField(k) for k in wanted}
