"""Pressing and defensive actions per (match, team, player)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import in_match, ladder, pct, ratio, sum_flag, with_season, zone
from touchline.operators.minutes import PLAYER, minutes_played

REGAINS = ["Interception", "Tackle", "Ball Recovery", "Duel", "Clearance"]
ACTIONS = ["Tackle", "Interception", "Pressure", "Block", "Clearance", "Duel", "Ball Recovery", "Foul Committed"]
CORE = ["Tackle", "Interception", "Pressure", "Block"]


def _with_minutes(df: DataFrame, lineups, events) -> DataFrame:
    if lineups is None:
        return df.withColumn("minutes_played", F.lit(0))
    return df.join(minutes_played(lineups, events), PLAYER, "left").withColumn(
        "minutes_played", F.coalesce("minutes_played", F.lit(0))
    )


def pressure_metrics(
    events, matches=None, lineups=None, match_id=None, player=None, reach: int = 5, block: int = 64
) -> DataFrame:
    """Pressures, counterpresses and regains within the next ``reach`` event numbers.

    The look-ahead is a range window over blocks of event numbers. The first
    ``reach`` numbers of a block are also sent to the block before it, so a block sees
    all it needs and a match of any length is spread over many tasks.
    """
    rows = (
        in_match(events, match_id)
        .filter((F.col("type") == "Pressure") | F.col("type").isin(REGAINS))
        .select(*PLAYER, "index_num", "type", "location_x", "counterpress")
        .withColumn("home_block", F.floor(F.col("index_num") / block))
    )
    spread = F.when(
        F.col("index_num") % block < reach, F.array(F.col("home_block"), F.col("home_block") - 1)
    ).otherwise(F.array("home_block"))
    ahead = W.partitionBy("match_id", "team", "block").orderBy("index_num").rangeBetween(0, reach)
    pressed = (
        rows.withColumn("block", F.explode(spread))
        .withColumn("regain", F.max(F.col("type").isin(REGAINS)).over(ahead))
        .filter((F.col("type") == "Pressure") & (F.col("block") == F.col("home_block")))
    )
    if player is not None:
        pressed = pressed.filter(F.col("player") == player)
    out = pressed.groupBy(*PLAYER).agg(
        F.count("*").alias("total_pressures"),
        sum_flag(F.col("counterpress")).alias("counterpresses"),
        sum_flag(F.col("regain")).alias("pressure_regains"),
        sum_flag(F.col("location_x") >= 80).alias("high_pressures"),
    ).withColumn("pressure_success_pct", pct(F.col("pressure_regains"), F.col("total_pressures")))
    out = _with_minutes(out, lineups, events).withColumn(
        "pressures_per_90", ratio(F.col("total_pressures"), F.col("minutes_played"), 2, 90.0)
    )
    return with_season(out, matches)


def defensive_actions(events, matches=None, lineups=None, match_id=None, player=None) -> DataFrame:
    """Counts of eight action types, thirds, duels and high ball wins."""
    kind, x = F.col("type"), F.col("location_x")
    third = zone(x)
    rows = in_match(events, match_id, player=player).filter(kind.isin(ACTIONS) & F.col("player").isNotNull())
    named = {
        "tackles": "Tackle", "interceptions": "Interception", "pressures": "Pressure", "blocks": "Block",
        "clearances": "Clearance", "ball_recoveries": "Ball Recovery", "fouls_committed": "Foul Committed",
    }
    out = rows.groupBy(*PLAYER).agg(
        *[sum_flag(kind == name).alias(column) for column, name in named.items()],
        sum_flag((kind == "Duel") & (F.col("duel_outcome") == "Won")).alias("duels_won"),
        sum_flag(kind == "Duel").alias("total_duels"),
        sum_flag(third == "Defensive Third").alias("defensive_third_actions"),
        sum_flag(third == "Middle Third").alias("middle_third_actions"),
        sum_flag(third == "Attacking Third").alias("attacking_third_actions"),
        sum_flag((x >= 72) & kind.isin("Tackle", "Interception", "Ball Recovery")).alias("high_turnovers"),
        sum_flag(kind.isin(CORE)).alias("total_defensive_actions"),
    ).filter(F.col("total_defensive_actions") > 0)
    out = out.withColumn("duel_win_pct", pct(F.col("duels_won"), F.col("total_duels")))
    return with_season(_with_minutes(out, lineups, events), matches)


def defensive_profile(events, matches=None, lineups=None, match_id=None, min_actions: int = 10) -> DataFrame:
    """Action shares and a five-way style label."""
    rows = defensive_actions(events, matches, lineups, match_id).filter(F.col("total_defensive_actions") >= min_actions)
    total = F.col("total_defensive_actions")
    thirds = F.col("defensive_third_actions") + F.col("middle_third_actions") + F.col("attacking_third_actions")
    rows = (
        rows.withColumn("pressure_pct", pct(F.col("pressures"), total))
        .withColumn("tackle_interception_pct", pct(F.col("tackles") + F.col("interceptions"), total))
        .withColumn("high_turnover_pct", pct(F.col("high_turnovers"), total))
        .withColumn("attacking_third_pct", pct(F.col("attacking_third_actions"), thirds))
    )
    return rows.withColumn("defensive_profile", ladder(
        "Balanced Defender",
        ((F.col("pressure_pct") > 40) & (F.col("high_turnover_pct") > 30), "Aggressive Presser"),
        (F.col("tackle_interception_pct") > 50, "Ball Winner"),
        (F.col("blocks") + F.col("clearances") > total * F.lit(0.4), "Protector"),
        ((F.col("duels_won") > 0) & (F.col("duel_win_pct") > 65), "Dominant Duelist"),
    ))
