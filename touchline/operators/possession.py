"""Possession and territory metrics per (match, team).

Each metric makes one pass over the events: conditional aggregates with map-side
combine, then joins on the few aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import (
    clock_seconds, in_match, ladder, pct, ratio, sum_flag, with_season, zone,
)

SIDE = ["match_id", "team"]
# Which event types count for a metric.
PRESS_ACTIONS = ["Interception", "Tackle", "Foul Committed", "Duel"]
ON_BALL = ["Pass", "Carry", "Shot", "Dribble"]
RECOVERIES = ["Interception", "Tackle", "Ball Recovery"]
ZONE_ACTIONS = ["Interception", "Tackle", "Block", "Clearance"]
THIRDS = ["Defensive Third", "Middle Third", "Attacking Third"]


def ppda(events: DataFrame, matches: DataFrame | None = None, match_id=None) -> DataFrame:
    """Opponent passes allowed per defensive action beyond x = 48."""
    high = F.col("location_x") > 48
    sides = in_match(events, match_id).groupBy(*SIDE).agg(
        sum_flag((F.col("type") == "Pass") & high).alias("passes"),
        sum_flag(F.col("type").isin(PRESS_ACTIONS) & high).alias("actions"),
    )
    # The sides of a match are two rows; pairing them inside the match row avoids a second scan.
    paired = (
        sides.groupBy("match_id").agg(F.collect_list(F.struct("team", "passes", "actions")).alias("sides"))
        .select("match_id", "sides", F.explode("sides").alias("own"))
        .select(
            "match_id", "own",
            F.explode_outer(F.filter("sides", lambda s: (s["team"] != F.col("own.team")) & (s["passes"] > 0))).alias("opp"),
        )
    )
    passes = F.coalesce(F.col("opp.passes"), F.lit(0).cast("long"))
    out = paired.select(
        "match_id", F.col("own.team").alias("team"), passes.alias("opponent_passes"),
        F.col("own.actions").alias("defensive_actions"),
        ratio(passes, F.col("own.actions"), 2).alias("ppda"),
    )
    return with_season(out, matches)


def field_tilt(events, matches=None, match_id=None) -> DataFrame:
    """Share of on-ball actions in the final third."""
    rows = in_match(events, match_id).filter(F.col("type").isin(ON_BALL) & F.col("location_x").isNotNull())
    out = rows.groupBy(*SIDE).agg(
        F.count("*").alias("total_actions"),
        sum_flag(F.col("location_x") > 80).alias("final_third_actions"),
    ).withColumn("field_tilt_pct", pct(F.col("final_third_actions"), F.col("total_actions")))
    return with_season(out, matches)


def possession_percentage(events, matches=None, match_id=None) -> DataFrame:
    """Share of the passes of a match."""
    passes = in_match(events, match_id).filter(F.col("type") == "Pass").groupBy(*SIDE).agg(F.count("*").alias("passes"))
    out = passes.withColumn("total_passes", F.sum("passes").over(W.partitionBy("match_id"))).withColumn(
        "possession_pct", pct(F.col("passes"), F.col("total_passes"))
    )
    return with_season(out, matches)


def possession_by_zone(events, matches=None, match_id=None) -> DataFrame:
    """Share of a team's passes per third."""
    rows = in_match(events, match_id).filter((F.col("type") == "Pass") & F.col("location_x").isNotNull())
    out = (
        rows.groupBy(*SIDE, zone(F.col("location_x"), "Final Third").alias("zone")).agg(F.count("*").alias("passes"))
        .withColumn("total_passes", F.sum("passes").over(W.partitionBy(*SIDE)))
        .withColumn("zone_pct", pct(F.col("passes"), F.col("total_passes")))
    )
    return with_season(out, matches)


def high_turnovers(events, matches=None, match_id=None) -> DataFrame:
    """Ball wins at x >= 72, and how many of them beyond 88 and 102."""
    rows = in_match(events, match_id).filter(F.col("type").isin(RECOVERIES) & (F.col("location_x") >= 72))
    out = rows.groupBy(*SIDE).agg(
        F.count("*").alias("high_turnovers"),
        sum_flag(F.col("location_x") >= 88).alias("final_third_turnovers"),
        sum_flag(F.col("location_x") >= 102).alias("box_turnovers"),
    )
    return with_season(out, matches)


def possession_value(events, match_id=None) -> DataFrame:
    """Possession share per expected goal (EPR) with its style label."""
    shot = (F.col("type") == "Shot") & F.col("shot_statsbomb_xg").isNotNull()
    sides = in_match(events, match_id).filter((F.col("type") == "Pass") | shot).groupBy(*SIDE).agg(
        sum_flag(F.col("type") == "Pass").alias("passes"),
        F.coalesce(F.sum(F.when(shot, F.col("shot_statsbomb_xg"))), F.lit(0.0)).alias("total_xg"),
    )
    share = pct(F.col("passes"), F.sum("passes").over(W.partitionBy("match_id")))
    out = sides.withColumn("possession_pct", share).filter(F.col("passes") > 0)
    out = out.withColumn("epr", ratio(F.col("possession_pct"), F.col("total_xg"), 2))
    style = ladder(
        "Patient Build-up",
        (F.col("epr").isNull() & (F.col("possession_pct") > 50), "All Bark, No Bite"),
        (F.col("epr").isNull(), "No Threat Created"),
        (F.col("epr") < 20, "Clinical/Direct"),
        (F.col("epr") <= 40, "Balanced"),
    )
    return out.select(*SIDE, "possession_pct", "total_xg", "epr", style.alias("style"))


def sequence_length(events, matches=None, match_id=None) -> DataFrame:
    """Passes per possession, over possessions that hold a pass."""
    runs = in_match(events, match_id).filter(F.col("type") == "Pass").groupBy(*SIDE, "possession").agg(F.count("*").alias("n"))
    out = runs.groupBy(*SIDE).agg(
        F.count("*").alias("total_sequences"),
        F.sum("n").alias("total_passes"),
        F.round(F.avg("n"), 2).alias("avg_passes_per_sequence"),
        F.max("n").alias("longest_sequence"),
    )
    return with_season(out, matches)


def counter_attack_speed(events, matches=None, match_id=None, max_time_window: float = 10) -> DataFrame:
    """Ground gained per second by the actions that follow a ball win in the same possession.

    The sequence join is keyed by time slot as well as possession: a slot is one
    time window long, and every ball win is sent to its own slot and the next one.
    A pair is built only when it lies within two windows of each other, whatever
    the length of the possession.
    """
    window = float(max_time_window)
    rows = (
        in_match(events, match_id)
        .filter(F.col("location_x").isNotNull() & F.col("type").isin(RECOVERIES + ["Pass", "Carry", "Shot"]))
        .select(*SIDE, "possession", "index_num", "type", "location_x", clock_seconds(F.col("timestamp")).alias("t"))
        .filter(F.col("t").isNotNull())
        .withColumn("slot", F.floor(F.col("t") / window))
    )
    wins = rows.filter(F.col("type").isin(RECOVERIES)).select(
        *SIDE, "possession", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"),
        F.col("index_num").alias("i0"), F.col("location_x").alias("x0"), F.col("t").alias("t0"),
    )
    gain, elapsed = F.col("location_x") - F.col("x0"), F.col("t") - F.col("t0")
    pairs = (
        rows.filter(F.col("type").isin("Pass", "Carry", "Shot"))
        .join(wins, SIDE + ["possession", "slot"])
        .filter((F.col("index_num") > F.col("i0")) & (gain > 0) & (elapsed > 0) & (elapsed <= window))
        .select(*SIDE, "possession", gain.alias("gain"), elapsed.alias("elapsed"))
    )
    # Per possession first, so that distinct possessions are counted without an expand.
    runs = pairs.groupBy(*SIDE, "possession").agg(
        F.count("*").alias("n"), F.sum("gain").alias("g"), F.sum("elapsed").alias("e"),
        F.sum(F.col("gain") / F.col("elapsed")).alias("s"),
    )
    out = runs.groupBy(*SIDE).agg(
        F.count("*").alias("counter_attacks"),
        F.round(F.sum("g") / F.sum("n"), 2).alias("avg_distance_gained"),
        F.round(F.sum("e") / F.sum("n"), 2).alias("avg_time_elapsed"),
        F.round(F.sum("s") / F.sum("n"), 2).alias("avg_speed_units_per_sec"),
    )
    return with_season(out, matches)


def _zone_rows(events, match_id):
    return in_match(events, match_id).filter(F.col("type").isin(ZONE_ACTIONS) & F.col("location_x").isNotNull())


def defensive_actions_by_zone(events, matches=None, match_id=None) -> DataFrame:
    """Interceptions, tackles, blocks and clearances per third."""
    out = _zone_rows(events, match_id).groupBy(*SIDE, zone(F.col("location_x")).alias("zone")).agg(
        F.count("*").alias("defensive_actions")
    )
    return with_season(out, matches)


def defensive_line_height(events, matches=None, match_id=None) -> DataFrame:
    """Mean third (1 to 3) of the defensive actions, third shares and a style label."""
    d, m, a = (F.col(c) for c in THIRDS)
    third = zone(F.col("location_x"))
    out = (
        _zone_rows(events, match_id).groupBy(*SIDE)
        .agg(*[sum_flag(third == name).alias(name) for name in THIRDS])
        .withColumn("total_defensive_actions", d + m + a)
    )
    total = F.col("total_defensive_actions")
    out = out.select(
        *SIDE, "total_defensive_actions",
        ratio(d + m * 2 + a * 3, total, 3).alias("defensive_line_height"),
        pct(d, total).alias("defensive_third_pct"),
        pct(m, total).alias("middle_third_pct"),
        pct(a, total).alias("attacking_third_pct"),
        *THIRDS,
    )
    out = out.withColumn(
        "defensive_style",
        ladder(
            "Balanced",
            (F.col("attacking_third_pct") > 30, "High Press"),
            (F.col("middle_third_pct") > 50, "Mid-Block"),
            (F.col("defensive_third_pct") > 50, "Low Block"),
        ),
    )
    return with_season(out, matches)


def possession_quality(events, matches=None, match_id=None) -> DataFrame:
    """Possession against territory, with five labels. One scan feeds all of its inputs."""
    located = F.col("location_x").isNotNull()
    is_pass = F.col("type") == "Pass"
    sides = in_match(events, match_id).filter(F.col("type").isin(ON_BALL)).groupBy(*SIDE).agg(
        sum_flag(is_pass).alias("passes"),
        sum_flag(located).alias("actions"),
        sum_flag(F.col("location_x") > 80).alias("final_actions"),
        sum_flag(is_pass & (F.col("location_x") >= 80)).alias("final_third_passes"),
    ).filter((F.col("passes") > 0) & (F.col("actions") > 0))
    match = W.partitionBy("match_id")
    rows = (
        sides.withColumn("total_passes", F.sum("passes").over(match))
        .withColumn("possession_pct", pct(F.col("passes"), F.col("total_passes")))
        .withColumn("field_tilt_pct", pct(F.col("final_actions"), F.col("actions")))
        .withColumn("pass_efficiency_pct", pct(F.col("final_third_passes"), F.col("passes")))
        .withColumn("sides", F.collect_list(F.struct("team", "field_tilt_pct")).over(match))
    )
    others = F.sort_array(F.filter("sides", lambda s: s["team"] != F.col("team")))
    rows = rows.withColumn(
        "tilt_differential",
        F.coalesce(F.round(F.col("field_tilt_pct") - F.get(others, F.lit(0))["field_tilt_pct"], 2), F.lit(0.0)),
    ).withColumn("possession_quality_gap", F.round(F.col("possession_pct") - F.col("field_tilt_pct") * 2, 2))
    eff, diff, gap = F.col("pass_efficiency_pct"), F.col("tilt_differential"), F.col("possession_quality_gap")
    poss, tilt = F.col("possession_pct"), F.col("field_tilt_pct")
    rows = (
        rows.withColumn("verticality", ladder(
            "Horizontal", (eff > 35, "Ultra-Vertical"), (eff > 28, "Vertical"), (eff > 22, "Balanced"), (eff > 18, "Patient")))
        .withColumn("territorial_control", ladder(
            "Pinned Back", (diff > 15, "Total Dominance"), (diff > 8, "Strong Control"),
            (diff > -8, "Contested"), (diff > -15, "Under Pressure")))
        .withColumn("gap_interpretation", ladder(
            "Ultra-Efficient", (gap > 15, "Sterile Possession"), (gap > 5, "Patient Build-up"),
            (gap > -5, "Balanced"), (gap > -15, "Direct & Efficient")))
        .withColumn("possession_style", ladder(
            "Contested",
            ((poss > 55) & (tilt > 30), "The Steamroller"),
            ((poss > 55) & (tilt < 20), F.when(gap > 15, "The U-Shape (Sterile)").otherwise("The U-Shape")),
            ((poss < 45) & (tilt > 30), F.when(gap < -15, "Efficiency Experts (Elite)").otherwise("Efficiency Experts")),
            ((poss < 45) & (tilt < 20), "Counter-Punchers"),
            (tilt > 30, "Attacking"),
            (tilt < 20, "Defensive"),
        ))
    )
    out = rows.select(
        *SIDE, "possession_pct", "passes", "total_passes", "field_tilt_pct", "tilt_differential",
        "territorial_control", "pass_efficiency_pct", "verticality", "final_third_passes",
        "possession_quality_gap", "gap_interpretation", "possession_style",
    )
    return with_season(out, matches)


def match_summary(events, matches, match_id=None) -> DataFrame:
    """Shots, xG, pass accuracy and touch share of both sides, for one match or all of them."""
    is_pass = F.col("type") == "Pass"
    sides = in_match(events, match_id).groupBy(*SIDE).agg(
        sum_flag(F.col("type") == "Shot").alias("shots"),
        F.round(F.sum(F.when(F.col("type") == "Shot", F.col("shot_statsbomb_xg")).otherwise(0.0)), 2).alias("xg"),
        sum_flag(is_pass).alias("n_pass"),
        sum_flag(is_pass & F.col("pass_outcome").isNull()).alias("n_ok"),
        sum_flag(F.col("type").isin("Pass", "Carry", "Dribble")).alias("touches"),
    )
    sides = sides.select(
        *SIDE, "shots", "xg", pct(F.col("n_ok"), F.col("n_pass"), 1).alias("pass_accuracy_pct"),
        pct(F.col("touches"), F.sum("touches").over(W.partitionBy("match_id")), 1).alias("possession_pct"),
    )
    # home OR away becomes two keyed rows, so that the join stays an equi-join
    info = ["season_name", "match_id", "home_team", "away_team", "home_score", "away_score"]
    long = in_match(matches, match_id).select(
        *info, F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team")
    )
    return long.join(sides, SIDE).select(*info, "team", "shots", "xg", "pass_accuracy_pct", "possession_pct")


def pass_completion_by_zone(events, matches=None, match_id=None) -> DataFrame:
    rows = in_match(events, match_id).filter((F.col("type") == "Pass") & F.col("location_x").isNotNull())
    out = rows.groupBy(*SIDE, zone(F.col("location_x")).alias("zone")).agg(
        F.count("*").alias("total_passes"),
        sum_flag(F.col("pass_outcome").isNull()).alias("completed_passes"),
    ).withColumn("completion_pct", pct(F.col("completed_passes"), F.col("total_passes")))
    return with_season(out, matches)
