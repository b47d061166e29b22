"""Normalising and clipping of columns, over a whole table or per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip, scalar_stats
from touchline.functions.lineage import join_groups
from touchline.functions.ranks import (
    average_rank, quantile_scalars, rank_columns, repivot, scaled_rank, unpivot, value_positions,
)

LOG_FLOOR = 1e-6


def rank_norm(df: DataFrame, keys: list[str], groups: list[str], columns: dict[str, str]) -> DataFrame:
    """Average rank scaled to 0..1 per group; ``columns`` maps input to output column."""
    return rank_columns(df, keys, groups, columns, scaled_rank())


def percentile_99(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Average rank over the count of present values, times 99."""
    score = average_rank() / F.col("total") * 99.0
    ranked = rank_columns(df, keys, [], {c: f"{c}_percentile" for c in columns}, score)
    return df.join(ranked, keys, "left")


def zscore(df: DataFrame, groups: list[str], columns: dict[str, str]) -> DataFrame:
    """Sample z-score per group, 0 where the deviation is 0 or undefined.

    The moments are aggregated with map-side combine and joined back: they are one row
    per group, so a large group is never gathered.
    """
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    df = join_groups(df, df.groupBy(*groups).agg(*aggs), groups) if groups else _attach(df, aggs)
    for c, out in columns.items():
        s = F.col(f"_s_{c}")
        df = df.withColumn(out, F.when(F.col(c).isNull(), F.lit(None)).when(
            s.isNull() | (s == 0), F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.nullif(s, F.lit(0.0))))
    return df.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def _attach(df: DataFrame, aggs: list) -> DataFrame:
    """Add whole-table aggregates as columns through one scalar subquery."""
    row = df.agg(F.struct(*aggs).alias("s")).scalar()
    return df.withColumn("_stats", row).select("*", "_stats.*").drop("_stats")


def min_max(
    df: DataFrame, columns: dict[str, str], groups: list[str] = (), high: float = 100.0, constant: float | None = 50.0,
    lower_is_better: tuple[str, ...] = (),
) -> DataFrame:
    """Min-max scaling to 0..high; a constant column becomes ``constant``."""
    groups = list(groups)
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    df = join_groups(df, df.groupBy(*groups).agg(*aggs), groups) if groups else _attach(df, aggs)
    for c, out in columns.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        num = (hi - F.col(c)) if c in lower_is_better else (F.col(c) - lo)
        scaled = num / F.nullif((hi - lo).cast("double"), F.lit(0.0)) * high
        df = df.withColumn(out, F.when(hi == lo, F.lit(constant)).otherwise(scaled))
    return df.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def z_radar(df: DataFrame, group: str, columns: list[str], inverted: tuple[str, ...] = ()) -> DataFrame:
    """Group means as 0.5 +- 0.2 z against all rows, clipped to 0.1..0.9; long form."""
    stats = scalar_stats(df, **{f"{n}_{c}": f(c) for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    means = df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])
    for c in columns:
        sd = stats[f"s_{c}"]
        z = F.when(sd != 0, (F.col(c) - stats[f"m_{c}"]) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
        means = means.withColumn(c, clip(0.5 + z * (-0.2 if c in inverted else 0.2), 0.1, 0.9))
    return unpivot(means, [group], columns)


def cap_outliers(df: DataFrame, upper: dict[str, float], lower: dict[str, float] | None = None) -> DataFrame:
    """Clip columns at exact quantiles of the whole table."""
    lower = lower or {}
    wanted = {f"hi_{c}": (c, q) for c, q in upper.items()} | {f"lo_{c}": (c, q) for c, q in lower.items()}
    cut = quantile_scalars(df, wanted)
    for c in upper:
        df = df.withColumn(c, F.least(F.when(F.col(c).isNotNull(), cut[f"hi_{c}"]), F.col(c)))
    for c in lower:
        df = df.withColumn(c, F.greatest(F.when(F.col(c).isNotNull(), cut[f"lo_{c}"]), F.col(c)))
    return df


def normalise_columns(
    df: DataFrame, keys: list[str], groups: list[str], methods: dict[str, tuple[str, str]]
) -> DataFrame:
    """Per-group normalisation of many columns: ``methods`` maps output to (column, method).

    Methods: rank, log, log1p, zscore. NULLs take part with the mean of their group and
    are NULL again in the result. All ranked columns share one long table and one ranking.
    """
    out = df
    ranked = {o: (c, m) for o, (c, m) in methods.items() if m != "zscore"}
    if ranked:
        wide = df.select(*dict.fromkeys(keys + groups), *[F.col(c).cast("double").alias(o) for o, (c, _) in ranked.items()])
        long = unpivot(wide, list(dict.fromkeys(keys + groups)), list(ranked))
        by = groups + ["metric"]
        means = long.groupBy(*by).agg(F.avg("value").alias("mean"))
        filled = join_groups(long, means, by).withColumn("filled", F.coalesce("value", "mean"))
        # log and log1p keep the order, so only values under the log floor change: they tie
        logged = [o for o, (_, m) in ranked.items() if m == "log"]
        filled = filled.withColumn("filled", F.when(
            F.col("metric").isin(logged) & (F.col("filled") < LOG_FLOOR), F.lit(LOG_FLOOR)).otherwise(F.col("filled")))
        filled = filled.drop("mean")
        positions = value_positions(filled, by, "filled")
        scored = filled.join(positions, by + ["filled"], "left").withColumn(
            "score", F.when(F.col("value").isNotNull(), scaled_rank())
        )
        out = out.join(repivot(scored, keys, {o: o for o in ranked}, value="score"), keys, "left")
    zs = {o: c for o, (c, m) in methods.items() if m == "zscore"}
    if zs:
        # a NULL filled with the mean adds no deviation, only a row: n changes, the mean does not
        stats = df.groupBy(*groups).agg(F.count("*").alias("_n"), *[
            f(c).alias(f"_{n}_{o}") for o, c in zs.items() for n, f in (("m", F.avg), ("v", F.var_pop), ("k", F.count))])
        out = join_groups(out, stats, groups)
        for o, c in zs.items():
            sd = F.sqrt(F.col(f"_v_{o}") * F.col(f"_k_{o}") / F.nullif((F.col("_n") - 1).cast("double"), F.lit(0.0)))
            out = out.withColumn(o, F.when(F.col(c).isNotNull(), F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(
                (F.col(c) - F.col(f"_m_{o}")) / F.nullif(sd, F.lit(0.0)))))
        out = out.drop("_n", *[f"_{n}_{o}" for o in zs for n in "mvk"])
    return out
