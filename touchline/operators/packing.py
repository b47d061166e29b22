"""Packing: opponents inside the bounding box of a completed pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import in_box, in_match, ladder, sum_flag, with_season, zone
from touchline.operators.progression import progressive_passes

KEYS = ["match_id", "player", "team"]


def _packed(events, three_sixty, match_id) -> DataFrame:
    """One row per completed pass with its packed opponents.

    A pass without a tracked opponent counts 0; a pass with opponents but none in the
    box is left out. This is the rule of the metric, so it is kept.
    """
    gain = F.col("pass_end_location_x") - F.col("location_x")
    passes = in_match(events, match_id).filter(
        (F.col("type") == "Pass") & F.col("pass_outcome").isNull()
        & F.col("location_x").isNotNull() & F.col("pass_end_location_x").isNotNull()
    ).select(
        F.col("id").alias("event_uuid"), *KEYS, F.col("location_x").alias("x0"), F.col("location_y").alias("y0"),
        F.col("pass_end_location_x").alias("x1"), F.col("pass_end_location_y").alias("y1"),
        F.coalesce((gain >= 10) | in_box(F.col("pass_end_location_x"), F.col("pass_end_location_y")), F.lit(False)).alias("prog"),
    )
    opponents = in_match(three_sixty, match_id).filter(
        (F.col("teammate") == F.lit(False)) & (F.col("actor") == F.lit(False)) & (F.col("keeper") == F.lit(False))
    ).select("match_id", "event_uuid", F.col("location_x").alias("ox"), F.col("location_y").alias("oy"))
    inside = F.col("ox").between(F.least("x0", "x1"), F.greatest("x0", "x1")) & F.col("oy").between(
        F.least("y0", "y1"), F.greatest("y0", "y1")
    )
    spot = F.when(F.col("ox").isNotNull() & F.col("oy").isNotNull(), F.struct("ox", "oy"))
    return (
        passes.join(opponents, ["match_id", "event_uuid"], "left")
        .filter(F.col("ox").isNull() | inside)
        .groupBy("event_uuid", *KEYS, "prog", "x0").agg(F.count_distinct(spot).alias("packed"))
    )


def packing(events, three_sixty, matches=None, match_id=None, min_passes: int = 5) -> DataFrame:
    out = _packed(events, three_sixty, match_id).groupBy(*KEYS).agg(
        F.count("*").alias("total_passes"), F.sum("packed").alias("total_opponents_packed"),
        F.round(F.avg("packed"), 2).alias("avg_packing_per_pass"),
        sum_flag(F.col("prog")).alias("progressive_passes"),
        F.round(F.avg(F.when(F.col("prog"), F.col("packed"))), 2).alias("avg_packing_progressive"),
    ).filter(F.col("total_passes") >= min_passes)
    return with_season(out, matches)


def packing_by_zone(events, three_sixty, match_id=None) -> DataFrame:
    """Packing per player and third of the pass start."""
    return _packed(events, three_sixty, match_id).groupBy("player", "team", zone(F.col("x0")).alias("zone")).agg(
        F.count("*").alias("passes"), F.round(F.avg("packed"), 2).alias("avg_packing")
    )


def packing_vs_progression(events, three_sixty, matches=None, match_id=None, min_passes: int = 5) -> DataFrame:
    """Packing beside progressive passing per (match, player, team), with a passer label."""
    left = packing(events, three_sixty, None, match_id, min_passes).withColumnRenamed(
        "progressive_passes", "progressive_passes_packing"
    )
    right = progressive_passes(events, match_id=match_id).select(
        *KEYS, F.col("progressive_passes").alias("progressive_passes_prog"), "progressive_pass_pct"
    )
    rows = left.join(right, KEYS, "full").fillna(0)
    packed, prog = F.col("avg_packing_per_pass") > 2, F.col("progressive_pass_pct") > 30
    rows = rows.withColumn("passer_type", ladder(
        "Conservative", (packed & prog, "Elite Line-Breaker"), (prog, "Safe Progressor"), (packed, "Short Incisive")
    ))
    return with_season(rows, matches)
