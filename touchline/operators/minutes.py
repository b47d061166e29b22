"""Minutes on the pitch, from line-up intervals or from substitution events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clock_seconds, in_match

PLAYER = ["match_id", "team", "player"]
SENT_OFF = ["Red Card", "Second Yellow"]


def minutes_played(lineups: DataFrame, events: DataFrame) -> DataFrame:
    """Summed line-up intervals in whole minutes (half to even); an open end runs to the last event."""
    length = events.groupBy("match_id").agg(F.max(F.col("minute") * 60 + F.col("second")).alias("match_seconds"))
    start = clock_seconds(F.col("from_time"))
    spans = (
        lineups.filter(F.col("player_name").isNotNull() & F.col("from_time").isNotNull())
        .join(length, "match_id")
        .select(
            "match_id", F.col("team_name").alias("team"), F.col("player_name").alias("player"),
            (F.coalesce(clock_seconds(F.col("to_time")), F.col("match_seconds").cast("double"))
             - F.coalesce(start, F.lit(0.0))).alias("span"),
        )
    )
    return spans.groupBy(*PLAYER).agg(
        F.bround(F.greatest(F.sum("span"), F.lit(0.0)) / 60.0).cast("int").alias("minutes_played")
    )


def lineup_clock(lineups: DataFrame) -> DataFrame:
    """Per player of a match: seconds in closed line-up intervals, the number of open ones and the sum of their starts."""
    begin, end = F.coalesce(clock_seconds(F.col("from_time")), F.lit(0.0)), clock_seconds(F.col("to_time"))
    return lineups.filter(F.col("player_name").isNotNull() & F.col("from_time").isNotNull()).groupBy(
        "match_id", F.col("team_name").alias("team"), F.col("player_name").alias("player")).agg(
        F.coalesce(F.sum(end - begin), F.lit(0.0)).alias("closed"), F.count(F.when(end.isNull(), 1)).alias("open"),
        F.coalesce(F.sum(F.when(end.isNull(), begin)), F.lit(0.0)).alias("open_from"))


def clock_minutes(match_seconds: Column) -> Column:
    """Minutes of a :func:`lineup_clock` row in a match of that length, as :func:`minutes_played` has them."""
    still_on = F.coalesce(F.col("open") * match_seconds - F.col("open_from"), F.lit(0.0))
    return F.bround(F.greatest(F.col("closed") + still_on, F.lit(0.0)) / 60.0).cast("int")


def minutes_from_events(events: DataFrame, match_id=None, team=None) -> DataFrame:
    """Minutes from the starting line-up, substitutions and dismissals."""
    rows = in_match(events, match_id, team=team)
    kind = F.col("type")
    starters = rows.filter((kind == "Starting XI") & F.col("player").isNotNull()).select(
        *PLAYER, F.lit(0).alias("minute_on")
    ).distinct()
    joined = rows.filter((kind == "Substitution") & F.col("substitution_replacement_name").isNotNull()).select(
        "match_id", "team", F.col("substitution_replacement_name").alias("player"), F.col("minute").alias("minute_on")
    )
    left = rows.filter(
        F.col("player").isNotNull()
        & (
            (kind == "Substitution")
            | ((kind == "Bad Behaviour") & F.col("bad_behaviour_card").isin(SENT_OFF))
            | ((kind == "Foul Committed") & F.col("foul_committed_card").isin(SENT_OFF))
        )
    ).groupBy(*PLAYER).agg(F.min("minute").alias("left_at"))
    length = rows.groupBy("match_id").agg(F.max("minute").alias("total_minutes"))
    out = reduce(
        lambda df, step: df.join(step[0], step[1], "left"),
        [(left, PLAYER), (length, ["match_id"])],
        starters.unionByName(joined),
    )
    end = F.coalesce("left_at", "total_minutes")
    return out.select(*PLAYER, "minute_on", end.alias("minute_out"), (end - F.col("minute_on")).alias("minutes_played"))
