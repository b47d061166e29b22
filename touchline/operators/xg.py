"""Shot and expected-goal metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import in_match, ladder, pct, ratio, scalar_stats, sum_flag, with_season
from touchline.operators.minutes import clock_minutes, lineup_clock

SIDE = ["match_id", "team"]
RUN = ["match_id", "possession", "team"]
PLAYER = ["match_id", "team", "player"]
XG = "shot_statsbomb_xg"


def total(xg: Column) -> Column:
    """Aggregate: sum of expected goals as decimals of ten places, so that the order of the rows cannot matter."""
    return F.sum(xg.cast("decimal(28,10)")).cast("double")


def mean(xg: Column) -> Column:
    return total(xg) / F.nullif(F.count(xg).cast("double"), F.lit(0.0))


def _shots(events, match_id=None):
    return in_match(events, match_id).filter((F.col("type") == "Shot") & F.col(XG).isNotNull())


def xg_by_team(events, matches=None, match_id=None) -> DataFrame:
    goal, open_shot = F.col("shot_outcome") == "Goal", F.col("shot_type") != "Penalty"
    out = _shots(events, match_id).groupBy(*SIDE).agg(
        F.count("*").alias("total_shots"),
        F.round(total(F.col(XG)), 3).alias("total_xg"),
        F.round(total(F.when(open_shot, F.col(XG)).otherwise(0.0)), 3).alias("npxg"),
        sum_flag(goal).alias("total_goals"),
        sum_flag(goal & open_shot).alias("np_goals"),
        F.round(mean(F.when(open_shot, F.col(XG))), 3).alias("avg_npxg_per_shot"),
    )
    return with_season(out, matches)


def xg_by_player(events, matches=None, match_id=None, min_shots: int = 3) -> DataFrame:
    """Finishing per (season, player, team); groups with fewer shots are left out."""
    shots = in_match(events, match_id).filter((F.col("type") == "Shot") & F.col("player").isNotNull())
    # One row per match first: the season join and the distinct match count then see few rows.
    per_match = shots.groupBy(*PLAYER).agg(
        F.count("*").alias("shots"), total(F.col(XG)).alias("xg"), sum_flag(F.col("shot_outcome") == "Goal").alias("goals")
    )
    keys = ["player", "team"]
    if matches is not None:
        per_match = per_match.join(matches.select("match_id", "season_name"), "match_id", "left")
        keys = ["season_name"] + keys
    return (
        per_match.groupBy(*keys)
        .agg(
            F.count("*").alias("matches"), F.sum("shots").alias("shots"),
            F.round(total(F.col("xg")), 2).alias("xg"), F.sum("goals").alias("goals"),
            F.round(F.sum("goals") - total(F.col("xg")), 2).alias("goals_minus_xg"),
        )
        .filter(F.col("shots") >= min_shots)
    )


def possession_grain(events, match_id=None) -> DataFrame:
    """One row per (match, possession, team, player) from one scan, with what the chain metrics need of it.

    ``touches`` without and ``shot_touches`` of shots, ``tries`` (shot rows: one per key pass, or none), their ``worth``
    and ``best``, ``shots``, ``goals``, and the last second of the match seen in the row. The ``run_`` columns are the
    same over the whole possession. Rows without a player or a possession stay in, for totals of the team and of the match.
    """
    rows = in_match(events, match_id)
    shot, valued = F.col("type") == "Shot", F.col(XG).isNotNull()
    kind = F.when(shot & valued, "valued").when(shot, "shot").when(F.col("type").isin("Pass", "Carry", "Dribble"), "touch").otherwise("other")
    of_kind = lambda *kinds: F.col("kind").isin(*kinds)
    # a few rows for each player of a possession leave a task
    small = rows.withColumn("kind", kind).withColumn("given", F.when(F.col("kind") == "valued", F.col("shot_key_pass_id"))).groupBy(
        *RUN, "player", "kind", "given").agg(
        F.count_distinct(F.when(F.col("kind") != "other", F.col("id"))).alias("ids"), F.count("*").alias("n"), F.max(XG).alias("xg"),
        sum_flag(F.col("shot_outcome") == "Goal").alias("goals"), F.max(F.col("minute") * 60 + F.col("second")).alias("second"))
    sums = lambda c, *kinds: F.sum(F.when(of_kind(*kinds), F.col(c)).otherwise(0))
    grain = small.repartition(*RUN).groupBy(*RUN, "player").agg(
        sums("ids", "touch").alias("touches"), sums("ids", "valued", "shot").alias("shot_touches"), sums("n", "valued").alias("shots"),
        sums("goals", "valued").alias("goals"), sum_flag(of_kind("valued")).alias("tries"),
        F.sum(F.when(of_kind("valued"), F.col("xg").cast("decimal(28,10)"))).alias("worth"),
        F.max(F.when(of_kind("valued"), F.col("xg"))).alias("best"), F.max("second").alias("second"))
    run = W.partitionBy(*RUN)
    named = F.when(F.col("player").isNotNull(), F.col("tries"))
    return grain.withColumns({
        "run_xg": F.max("best").over(run), "run_shots": F.sum("shots").over(run), "run_goals": F.sum("goals").over(run),
        "run_tries": F.sum("tries").over(run), "named_tries": F.coalesce(F.sum(named).over(run), F.lit(0)), "run_worth": F.sum("worth").over(run),
        "lead": F.row_number().over(run.orderBy("player")) == 1,  # one row stands for the possession in totals
        "placed": F.col("player").isNotNull() & F.col("possession").isNotNull() & F.col("team").isNotNull() & F.col("match_id").isNotNull()})


def _per_player(grain: DataFrame, part: Column, lineups, *metrics: Column) -> DataFrame:
    """``metrics`` per player of a match over the rows with ``part``, the team's ``side_xg``, and ``minutes_played``."""
    worth = F.col("run_xg").cast("decimal(28,10)")
    out = grain.groupBy(*PLAYER).agg(
        sum_flag(part).alias("_rows"), F.sum(F.when(F.col("lead"), worth)).alias("_lead"), F.max("second").alias("_second"), *metrics)
    out = out.withColumns({
        "side_xg": F.sum("_lead").over(W.partitionBy(*SIDE)).cast("double"), "_length": F.max("_second").over(W.partitionBy("match_id"))})
    out = out.filter(F.col("_rows") > 0).drop("_lead", "_second")
    if lineups is None:
        return out.withColumn("minutes_played", F.lit(0)).drop("_rows", "_length")
    return out.join(lineup_clock(lineups), PLAYER, "left").withColumn(
        "minutes_played", F.coalesce(clock_minutes(F.col("_length")), F.lit(0))).drop("_rows", "_length", "closed", "open", "open_from")


def xg_chain(events, matches=None, lineups=None, match_id=None, min_touches: int = 1) -> DataFrame:
    """Possession xG credited to every player with a touch in the possession."""
    touches = F.col("touches") + F.col("shot_touches")
    part = F.col("placed") & (F.col("run_shots") > 0) & (touches > 0)
    mine = lambda c: F.when(part, c)
    out = _per_player(
        possession_grain(events, match_id), part, lineups,
        sum_flag(part).alias("possessions_with_shot"), F.round(total(mine(F.col("run_xg"))), 3).alias("xg_chain"),
        F.sum(mine(F.col("run_shots"))).alias("shots_in_chain"), F.sum(mine(F.col("run_goals"))).alias("goals_in_chain"),
        F.round(mean(mine(F.col("run_xg"))), 3).alias("avg_xg_per_possession"), F.sum(mine(touches)).alias("total_touches_in_chains"))
    out = out.filter(F.col("total_touches_in_chains") >= min_touches)
    out = out.withColumn("xg_chain_per90", ratio(F.col("xg_chain"), F.col("minutes_played"), 3, 90.0)).withColumn(
        "team_involvement_pct", ratio(F.col("xg_chain"), F.col("side_xg"), 2, 100.0))
    return with_season(out.drop("side_xg"), matches)


def xg_buildup(events, matches=None, lineups=None, match_id=None, min_touches: int = 1) -> DataFrame:
    """xG of possessions where the player took part but neither shot nor assisted.

    A possession counts once per (shooter, key pass) row, and its touches once per
    such row of another player. Both factors are counts of the possession,
    so the fan-out is multiplied instead of materialised. Who gave a key pass is looked up among all events by its id.
    """
    grain = possession_grain(events, match_id)
    given = in_match(events, match_id).filter((F.col("type") == "Shot") & F.col(XG).isNotNull() & F.col("shot_key_pass_id").isNotNull()).select(
        *RUN, F.col("shot_key_pass_id").alias("id"))
    assists = given.join(events.select("match_id", "id", "player"), ["match_id", "id"]).select(*RUN, "player").distinct()
    grain = grain.join(assists.withColumn("assisted", F.lit(True)), RUN + ["player"], "left")
    # a touch survives when at least one shot row has another shooter
    part = F.col("placed") & (F.col("touches") > 0) & (F.col("named_tries") > F.col("tries")) & F.col("assisted").isNull()
    mine = lambda c: F.when(part, c)
    out = _per_player(
        grain, part, lineups, sum_flag(part).alias("possessions_with_buildup"), F.sum(mine(F.col("run_worth"))).cast("double").alias("xg_sum"),
        F.sum(mine(F.col("run_tries"))).alias("rows"), F.sum(mine(F.col("touches") * F.col("run_tries"))).alias("total_touches_in_buildup"))
    out = out.filter(F.col("total_touches_in_buildup") >= min_touches).select(
        *PLAYER, "possessions_with_buildup",
        F.round("xg_sum", 3).alias("xg_buildup"),
        F.round(F.col("xg_sum") / F.col("rows"), 3).alias("avg_xg_per_possession"),
        "total_touches_in_buildup", "minutes_played",
        ratio(F.col("xg_sum"), F.col("minutes_played"), 3, 90.0).alias("xg_buildup_per90"),
    )
    return with_season(out, matches)


def team_xg_buildup(events, matches=None, match_id=None) -> DataFrame:
    players = xg_buildup(events, matches=matches, match_id=match_id)
    keys = (["season_name"] if matches is not None else []) + SIDE
    out = players.groupBy(*keys).agg(
        F.sum("possessions_with_buildup").alias("buildup_possessions"),
        F.round(total(F.col("xg_buildup")), 3).alias("total_xg_from_buildup"),
        F.sum("total_touches_in_buildup").alias("total_touches_in_buildup"),
    )
    return out.withColumn(
        "avg_xg_per_buildup_possession", ratio(F.col("total_xg_from_buildup"), F.col("buildup_possessions"), 3)
    ).withColumn(
        "avg_touches_per_buildup_possession", ratio(F.col("total_touches_in_buildup"), F.col("buildup_possessions"), 2)
    )


def team_xg(events) -> DataFrame:
    """Total and mean xG and shots per team over all events."""
    return _shots(events).groupBy("team").agg(
        F.round(total(F.col(XG)), 3).alias("total_xg"), F.round(mean(F.col(XG)), 3).alias("avg_xg_per_shot"),
        F.count("*").alias("total_shots"),
    )


def goal_timing(events) -> DataFrame:
    """Goals and their share per 15-minute bin and per period."""
    minute = F.col("minute")
    bins = ladder(
        F.lit(None).cast("string"), (minute <= 15, "0-15"), (minute <= 30, "16-30"), (minute <= 45, "31-45"),
        (minute <= 60, "46-60"), (minute <= 75, "61-75"), (minute <= 120, "76-90+"),
    )
    goals = events.filter((F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal") & minute.isNotNull())
    # Counted per (period, minute) once; both groupings and the total read that small table.
    cells = goals.groupBy("period", "minute").agg(F.count("*").alias("n"))
    label = lambda kind, col: F.struct(F.lit(kind).alias("grouping_kind"), col.alias("label"))
    long = cells.select("n", F.explode(F.array(
        label("minutes", bins), label("period", F.col("period").cast("string")), label("all", F.lit("all"))
    )).alias("g")).groupBy("g.grouping_kind", "g.label").agg(F.sum("n").alias("goals"))
    total = F.max(F.when(F.col("grouping_kind") == "all", F.col("goals"))).over(W.partitionBy(F.lit(0)))
    return (
        long.withColumn("share_pct", pct(F.col("goals"), total, 1))
        .filter((F.col("grouping_kind") != "all") & F.col("label").isNotNull())
    )


def high_intensity_minutes(events, q: float = 0.9, n: int = 10) -> DataFrame:
    """Match minutes (summed over matches) whose event count exceeds the q-quantile, top n."""
    cells = events.filter(F.col("minute").isNotNull()).groupBy("minute").agg(F.count("*").alias("events"))
    cut = scalar_stats(cells, cut=F.percentile("events", F.lit(q)))["cut"]  # a few hundred minutes at most
    return cells.filter(F.col("events") > cut).orderBy(F.desc("events"), "minute").limit(n)
