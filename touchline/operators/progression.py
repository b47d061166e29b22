"""Progressive passes, carries and receptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import OPEN_PLAY, in_box, in_match, ladder, pct, ratio, sum_flag, with_season
from touchline.functions.lineage import cut_lineage
from touchline.functions.ranks import quantile_scalars
from touchline.operators.minutes import PLAYER, minutes_played

SIDE = ["match_id", "team"]


def _pass_gain():
    return F.col("pass_end_location_x") - F.col("location_x")


def _pass_is_progressive():
    return in_box(F.col("pass_end_location_x"), F.col("pass_end_location_y")) | (
        (F.col("location_x") >= 48) & (_pass_gain() >= 10)
    )


def _carry_gain():
    return F.col("carry_end_location_x") - F.col("location_x")


def _carry_is_progressive():
    x = F.col("location_x")
    return (
        in_box(F.col("carry_end_location_x"), F.col("carry_end_location_y"))
        | ((x >= 72) & (_carry_gain() >= 5))
        | ((x >= 48) & (x < 72) & (_carry_gain() >= 10))
    )


def _open_passes(events, match_id=None):
    return in_match(events, match_id).filter(
        (F.col("type") == "Pass") & F.col("play_pattern").isin(*OPEN_PLAY)
        & F.col("location_x").isNotNull() & F.col("pass_end_location_x").isNotNull()
        & F.col("pass_end_location_y").isNotNull()
    )


def _open_carries(events, match_id=None):
    return in_match(events, match_id).filter(
        (F.col("type") == "Carry") & F.col("play_pattern").isin(*OPEN_PLAY)
        & F.col("location_x").isNotNull() & F.col("carry_end_location_x").isNotNull()
        & F.col("carry_end_location_y").isNotNull()
    )


def progressive_passes(events, matches=None, match_id=None, player=None) -> DataFrame:
    rows = in_match(_open_passes(events, match_id), player=player).withColumn("intent", _pass_is_progressive())
    done = F.col("intent") & F.col("pass_outcome").isNull()
    out = rows.groupBy(*PLAYER).agg(
        F.count("*").alias("total_passes"),
        sum_flag(done).alias("progressive_passes"),
        sum_flag(F.col("intent")).alias("progressive_passes_attempted"),
        F.round(F.avg(F.when(done, _pass_gain())), 2).alias("avg_progressive_distance"),
        F.round(F.avg(F.when(done, F.col("pass_length"))), 2).alias("avg_progressive_pass_length"),
    ).filter(F.col("progressive_passes") > 0)
    out = out.withColumn(
        "progressive_pass_completion_pct", pct(F.col("progressive_passes"), F.col("progressive_passes_attempted"))
    ).withColumn("progressive_pass_pct", pct(F.col("progressive_passes"), F.col("total_passes")))
    return with_season(out, matches)


def progressive_carries(events, matches=None, match_id=None, player=None) -> DataFrame:
    dx, dy = _carry_gain(), F.col("carry_end_location_y") - F.col("location_y")
    rows = in_match(_open_carries(events, match_id), player=player).withColumn("prog", _carry_is_progressive()).withColumn(
        "length", F.sqrt(dx * dx + dy * dy)
    )
    prog = F.col("prog")
    out = rows.groupBy(*PLAYER).agg(
        F.count("*").alias("total_carries"),
        sum_flag(prog).alias("progressive_carries"),
        F.round(F.avg(F.when(prog, dx)), 2).alias("avg_progressive_distance"),
        F.round(F.avg(F.when(prog, F.col("length"))), 2).alias("avg_progressive_carry_length"),
        F.round(F.avg(F.when(prog, ratio(dx, F.col("length")))) * 100.0, 2).alias("progressive_carry_directness_pct"),
        sum_flag(prog & (F.col("carry_end_location_x") >= 80)).alias("progressive_carries_into_final_third"),
        sum_flag(prog & in_box(F.col("carry_end_location_x"), F.col("carry_end_location_y"))).alias("progressive_carries_into_penalty_area"),
    ).filter(F.col("progressive_carries") > 0)
    out = out.withColumn("progressive_carry_pct", pct(F.col("progressive_carries"), F.col("total_carries")))
    return with_season(out, matches)


def progressive_passes_received(events, matches=None, match_id=None, player=None) -> DataFrame:
    rows = _open_passes(events, match_id).filter(F.col("pass_outcome").isNull() & F.col("pass_recipient").isNotNull())
    rows = in_match(rows, pass_recipient=player).withColumn("prog", _pass_is_progressive())
    prog, ex, ey = F.col("prog"), F.col("pass_end_location_x"), F.col("pass_end_location_y")
    out = rows.groupBy(*SIDE, F.col("pass_recipient").alias("player")).agg(
        F.count("*").alias("total_passes_received"),
        sum_flag(prog).alias("progressive_passes_received"),
        sum_flag(prog & (ex >= 80)).alias("progressive_receptions_final_third"),
        sum_flag(prog & ex.between(80, 102) & ey.between(25, 55)).alias("progressive_receptions_zone_14"),
        F.round(F.avg(F.when(prog, ex)), 2).alias("avg_reception_x"),
        F.round(F.avg(F.when(prog, ey)), 2).alias("avg_reception_y"),
        F.round(F.avg(F.when(prog, _pass_gain())), 2).alias("avg_progressive_distance"),
    ).filter(F.col("progressive_passes_received") > 0)
    out = out.withColumn(
        "progressive_passes_received_pct", pct(F.col("progressive_passes_received"), F.col("total_passes_received"))
    )
    return with_season(out, matches)


def progressive_actions(events, matches=None, match_id=None) -> DataFrame:
    """Passes, carries and receptions of a player in one row, from one scan.

    Each event is turned into the one or two credits it gives, and the credits are
    summed; this equals the zero-filled full join of the three metrics.
    """
    is_pass = (F.col("type") == "Pass") & F.col("pass_end_location_x").isNotNull() & F.col("pass_end_location_y").isNotNull()
    is_carry = (F.col("type") == "Carry") & F.col("carry_end_location_x").isNotNull() & F.col("carry_end_location_y").isNotNull()
    done = is_pass & F.col("pass_outcome").isNull() & _pass_is_progressive()
    carried = is_carry & _carry_is_progressive()
    credit = lambda who, kind: F.struct(who.alias("player"), F.lit(kind).alias("kind"))
    rows = (
        in_match(events, match_id)
        .filter(F.col("play_pattern").isin(*OPEN_PLAY) & F.col("location_x").isNotNull() & (done | carried))
        .select(*SIDE, F.explode(
            F.when(carried, F.array(credit(F.col("player"), "carry")))
            .when(F.col("pass_recipient").isNotNull(), F.array(credit(F.col("player"), "pass"), credit(F.col("pass_recipient"), "received")))
            .otherwise(F.array(credit(F.col("player"), "pass")))
        ).alias("c"))
        .select(*SIDE, "c.player", "c.kind")
    )
    out = rows.groupBy(*PLAYER).agg(
        sum_flag(F.col("kind") == "pass").alias("progressive_passes"),
        sum_flag(F.col("kind") == "carry").alias("progressive_carries"),
        sum_flag(F.col("kind") == "received").alias("progressive_passes_received"),
        F.count("*").alias("progressive_actions"),
    )
    return with_season(out, matches)


def progressive_actions_no_overlap(events, matches=None, match_id=None, player=None) -> DataFrame:
    """Ground covered once per (possession, player): lowest start to highest end."""
    is_pass, is_carry = F.col("type") == "Pass", F.col("type") == "Carry"
    end = F.coalesce("pass_end_location_x", "carry_end_location_x")
    rows = in_match(events, match_id, player=player).filter(
        F.col("play_pattern").isin(*OPEN_PLAY) & (F.col("location_x") >= 48)
        & ((is_pass & F.col("pass_end_location_x").isNotNull() & F.col("pass_outcome").isNull())
           | (is_carry & F.col("carry_end_location_x").isNotNull()))
    )
    runs = rows.groupBy(*PLAYER, "possession").agg(
        (F.max(end) - F.min("location_x")).alias("ground"), F.count("*").alias("actions"),
        sum_flag(is_pass).alias("passes"), sum_flag(is_carry).alias("carries"),
    )
    prog = F.col("ground") >= 10
    out = runs.groupBy(*PLAYER).agg(
        F.count("*").alias("possessions_contributed"),
        sum_flag(prog).alias("progressive_possessions"),
        F.round(F.sum("ground"), 2).alias("total_unique_progressive_distance"),
        F.round(F.avg(F.when(prog, F.col("ground"))), 2).alias("avg_unique_progressive_distance"),
        pct(F.sum("passes"), F.sum("actions")).alias("progressive_action_pass_pct"),
        pct(F.sum("carries"), F.sum("actions")).alias("progressive_action_carry_pct"),
    ).filter(F.col("progressive_possessions") > 0)
    return with_season(out, matches)


def progression_profile(events, lineups, match_id=None, min_minutes: float = 30) -> DataFrame:
    """Progressive actions per 90 minutes with a label from the P75 and P50 of all players."""
    minutes = minutes_played(lineups, in_match(events, match_id) if match_id is not None else events)
    total = minutes.groupBy("team", "player").agg(F.sum("minutes_played").alias("total_mins"))
    names = ["progressive_passes", "progressive_carries", "progressive_passes_received"]
    acts = progressive_actions(events, match_id=match_id).groupBy("team", "player").agg(*[F.sum(n).alias(n) for n in names])
    rows = total.join(acts, ["team", "player"], "left").fillna(0, names).filter(F.col("total_mins") >= min_minutes)
    for n in names:
        rows = rows.withColumn(f"{n}_p90", F.round(F.col(n) / F.col("total_mins").cast("double") * 90.0, 2))
    p, c, r = (F.col(f"{n}_p90") for n in names)
    rows = rows.withColumn("total_progressive_actions_p90", F.round(p + c + r, 2))
    rows = cut_lineage(rows)  # one row per player, read by the quantiles and by the labels
    cut = quantile_scalars(rows, {
        "p75": ("progressive_passes_p90", 0.75), "c75": ("progressive_carries_p90", 0.75),
        "r75": ("progressive_passes_received_p90", 0.75),
        "p50": ("progressive_passes_p90", 0.5), "c50": ("progressive_carries_p90", 0.5),
    })
    return rows.withColumn("progression_type", ladder(
        "Limited Progression",
        ((p >= cut["p75"]) & (c >= cut["c75"]), "Complete Progressor"),
        (p >= cut["p75"], "Progressive Passer"),
        (c >= cut["c75"], "Ball Carrier"),
        (r >= cut["r75"], "Progression Outlet"),
        ((p >= cut["p50"]) | (c >= cut["c50"]), "Supporting Progressor"),
    ))


def team_progression_summary(events, matches=None, match_id=None) -> DataFrame:
    names = ["progressive_passes", "progressive_carries", "progressive_passes_received", "progressive_actions"]
    out = progressive_actions(events, match_id=match_id).groupBy(*SIDE).agg(*[F.sum(n).alias(n) for n in names])
    total = F.col("progressive_actions")
    out = out.withColumn("progressive_carry_pct", pct(F.col("progressive_carries"), total)).withColumn(
        "progressive_pass_pct", pct(F.col("progressive_passes"), total)
    )
    return with_season(out, matches)


def team_progression_detail(events, matches=None, match_id=None) -> DataFrame:
    """Team pass and carry progression side by side, with the share of carries."""
    passes = progressive_passes(events, match_id=match_id).groupBy(*SIDE).agg(
        F.sum("progressive_passes").alias("progressive_passes"), F.sum("total_passes").alias("total_passes"),
        F.avg("avg_progressive_distance").alias("avg_progressive_pass_distance"),
        F.avg("avg_progressive_pass_length").alias("avg_progressive_pass_length"),
    )
    carries = progressive_carries(events, match_id=match_id).groupBy(*SIDE).agg(
        F.sum("progressive_carries").alias("progressive_carries"), F.sum("total_carries").alias("total_carries"),
        F.avg("avg_progressive_distance").alias("avg_progressive_carry_distance"),
        F.avg("avg_progressive_carry_length").alias("avg_progressive_carry_length"),
        F.sum("progressive_carries_into_final_third").alias("progressive_carries_into_final_third"),
        F.sum("progressive_carries_into_penalty_area").alias("progressive_carries_into_penalty_area"),
    )
    out = reduce(lambda a, b: a.join(b, SIDE, "full"), [passes, carries]).fillna(0)
    both = F.col("progressive_carries") + F.col("progressive_passes")
    out = out.withColumn("progression_method_ratio", ratio(F.col("progressive_carries"), both, 3)).withColumn(
        "total_progressive_actions", both
    )
    return with_season(out, matches)
