"""Profiles of tables: counts, shares, missing values, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import clock_seconds, ladder, pct, ratio, scalar_stats, sum_flag
from touchline.functions.ranks import exact_quantiles, unpivot
from touchline.functions.scale import min_max


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col(column).asc_nulls_first()).limit(n)


def top_rows(df: DataFrame, columns: list[str], by: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return df.select(*columns).orderBy(F.desc_nulls_last(by), *([tie] if tie else [])).limit(n)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, NULLs, mean, deviation, extremes and exact quartiles per column."""
    long = unpivot(df, [], columns)
    stats = long.groupBy("metric").agg(
        F.count("value").alias("count"), (F.count("*") - F.count("value")).alias("null_count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["metric"], "value", [0.25, 0.5, 0.75], few_groups=True).groupBy("metric").agg(
        *[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for v, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return stats.join(q, "metric", "left")


def sectioned_counts(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """Counts and shares of many groupings from one scan: (section, label, n, share_pct).

    NULL labels are left out of their section; shares are of the labelled rows.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("section"), c.cast("string").alias("label")) for s, c in sections.items()])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.section", "c.label").agg(F.count("*").alias("n")).filter(F.col("label").isNotNull())
    total = counts.groupBy("section").agg(F.sum("n").alias("total"))
    return counts.join(total, "section").select("section", "label", "n", pct(F.col("n"), F.col("total")).alias("share_pct"))


def quality_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """NULLs per column with their share, and the rows that repeat a key."""
    n = F.count("*")
    row = df.agg(n.alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    missing = row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"m{i}").alias("bad")) for i, c in enumerate(df.columns)])).alias("r"))
    missing = missing.select(F.lit("missing").alias("check"), "r.item", "r.bad", pct(F.col("r.bad"), F.col("n")).alias("bad_pct"))
    repeated = df.groupBy(*keys).agg(n.alias("k")).agg(
        F.lit("duplicate key rows").alias("check"), F.lit(",".join(keys)).alias("item"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("bad"), F.sum("k").alias("all"))
    return missing.unionByName(repeated.select("check", "item", "bad", pct(F.col("bad"), F.col("all")).alias("bad_pct")))


# ---- matches (E2, E8, E10, E13-E16) --------------------------------------------------


def result(df_home: str = "home_score", df_away: str = "away_score") -> Column:
    h, a = F.col(df_home), F.col(df_away)
    return F.when(h > a, "Home Win").when(a > h, "Away Win").when(h == a, "Draw")


def match_profile(matches: DataFrame) -> DataFrame:
    day = F.to_date("match_date")
    goals = F.col("home_score") + F.col("away_score")
    return sectioned_counts(matches, {
        "result": result(), "year": F.year(day), "weekday": F.date_format(day, "EEEE"), "competition": F.col("competition"), "season": F.col("season_name"),
        "scoreline": F.concat_ws("-", "home_score", "away_score"), "goal_difference": F.col("home_score") - F.col("away_score"),
        "goals": ladder(F.lit(None).cast("string"), (goals >= 6, "6 or more"), (goals == 0, "goalless")),
    })


def match_totals(matches: DataFrame) -> DataFrame:
    goals = F.col("home_score") + F.col("away_score")
    return matches.agg(
        F.count("*").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
        F.sum(goals).alias("goals"), F.round(F.avg(goals), 2).alias("goals_per_match"), F.round(F.avg("home_score"), 2).alias("home_goals"),
        F.round(F.avg("away_score"), 2).alias("away_goals"))


def competition_by_year(matches: DataFrame, top: int = 12, low: int = 2010, high: int = 2025) -> DataFrame:
    """Matches per competition and year, the smaller competitions as Others."""
    rows = matches.withColumn("year", F.year(F.to_date("match_date"))).filter(F.col("year").between(low, high))
    counts = rows.groupBy("competition", "year").agg(F.count("*").alias("n"))
    big = counts.groupBy("competition").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "competition").limit(top).select("competition", F.lit(True).alias("_b"))
    named = counts.join(big, "competition", "left").withColumn("competition", F.when(F.col("_b"), F.col("competition")).otherwise("Others"))
    return named.groupBy("competition", "year").agg(F.sum("n").alias("matches"))


def yearly_style(events: DataFrame, matches: DataFrame, since: int = 2010) -> DataFrame:
    """Pressures, carries, shots and passes per match and year, with min-max positions over the years."""
    kinds = {"pressures": "Pressure", "carries": "Carry", "shots": "Shot", "passes": "Pass"}
    per_match = events.groupBy("match_id").agg(*[sum_flag(F.col("type") == k).alias(c) for c, k in kinds.items()])
    years = matches.select("match_id", F.year(F.to_date("match_date")).alias("year")).filter(F.col("year") >= since)
    rates = per_match.join(years, "match_id").groupBy("year").agg(
        F.count("*").alias("matches"), *[(F.sum(c) / F.count("*")).alias(f"{c}_per_match") for c in kinds])
    return min_max(rates, {f"{c}_per_match": f"{c}_scaled" for c in kinds}, high=1.0, constant=0.0)


def cross_dataset(markets: DataFrame, matches: DataFrame) -> DataFrame:
    span = lambda df, name, t: df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.min(F.to_date(t)).alias("first"), F.max(F.to_date(t)).alias("last"))
    return span(markets, "markets", "created_at").unionByName(span(matches, "matches", "match_date"))


def dataset_overview(matches: DataFrame, events: DataFrame, lineups: DataFrame) -> DataFrame:
    one = lambda df, *aggs: df.agg(F.struct(*aggs).alias("s")).scalar()
    m = one(matches, F.count("*").alias("n"), F.count_distinct("competition").alias("c"))
    e = one(events, F.count("*").alias("n"), F.count_distinct("type").alias("t"), F.count("location_x").alias("l"))
    p = one(lineups, F.count("*").alias("n"), F.count_distinct("player_name").alias("p"))
    base = matches.sparkSession.range(1).select(m.alias("m"), e.alias("e"), p.alias("p"))
    return base.select(
        F.col("m.n").alias("total_matches"), F.col("m.c").alias("competitions"), F.col("e.n").alias("total_events"), F.col("e.t").alias("event_types"),
        pct(F.col("e.l"), F.col("e.n")).alias("location_coverage_pct"), F.col("p.n").alias("lineup_rows"), F.col("p.p").alias("unique_players"))


def _chosen(matches: DataFrame, competition=None, season=None, team=None) -> DataFrame:
    if competition is not None:
        matches = matches.filter(F.col("competition") == competition)
    if season is not None:
        matches = matches.filter(F.col("season_name") == season)
    if team is not None:
        matches = matches.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    return matches


def dashboard_stats(matches: DataFrame, events: DataFrame, lineups: DataFrame, competition=None, season=None, team=None) -> DataFrame:
    """Matches, events, players and goals per match of a selection."""
    chosen = _chosen(matches, competition, season, team)
    keys = chosen.select("match_id")
    one = lambda df, agg: df.agg(agg.alias("v")).scalar()
    return chosen.agg(F.count("*").alias("total_matches"), F.round(F.avg(F.col("home_score") + F.col("away_score")), 2).alias("avg_goals")).select(
        "total_matches", one(events.join(keys, "match_id", "left_semi"), F.count("*")).alias("total_events"),
        one(lineups.join(keys, "match_id", "left_semi"), F.count_distinct("player_name")).alias("unique_players"), "avg_goals")


def dashboard_results(matches: DataFrame, competition=None, season=None, team=None) -> DataFrame:
    return _chosen(matches, competition, season, team).groupBy(result().alias("result")).agg(F.count("*").alias("count"))


def dashboard_goals(matches: DataFrame, competition=None, season=None, team=None) -> DataFrame:
    return _chosen(matches, competition, season, team).groupBy("competition").agg(
        F.round(F.avg(F.col("home_score") + F.col("away_score")), 4).alias("avg_goals"))


def gender_profile(matches: DataFrame) -> DataFrame:
    """Matches, share, dates, competitions, goals and teams per gender, in one pass."""
    long = matches.select("gender", "match_id", "match_date", "competition", (F.col("home_score") + F.col("away_score")).alias("g"),
                          F.explode(F.array("home_team", "away_team")).alias("team"))
    out = long.groupBy("gender").agg(
        (F.count("*") / 2).cast("long").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
        F.count_distinct("competition").alias("competitions"), F.round(F.avg("g"), 2).alias("goals_per_match"), F.count_distinct("team").alias("unique_teams"))
    total = scalar_stats(matches, n=F.count("*"))["n"]
    return out.withColumn("share_pct", pct(F.col("matches"), total, 1))


def temporal_bias(matches: DataFrame, densest: int = 2) -> DataFrame:
    """Matches and share per year, the rank by size and whether the year is among the densest."""
    years = matches.groupBy(F.year(F.to_date("match_date")).alias("year")).agg(F.count("*").alias("matches"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("matches"), "year")  # one row per year
    total = F.sum("matches").over(W.partitionBy(F.lit(0)))
    return years.withColumn("rank", F.row_number().over(order)).withColumn("share_pct", pct(F.col("matches"), total, 1)).withColumn(
        "cumulative_pct", pct(F.sum("matches").over(order.rowsBetween(W.unboundedPreceding, 0)), total, 1)).withColumn("densest", F.col("rank") <= densest)


# ---- events (E3, E12) ----------------------------------------------------------------


def event_profile(events: DataFrame) -> DataFrame:
    m, x = F.col("minute"), F.col("location_x")
    none = F.lit(None).cast("string")
    bins = ladder(none, (m <= 0, none), (m <= 15, "0-15"), (m <= 30, "16-30"), (m <= 45, "31-45"), (m <= 60, "46-60"), (m <= 75, "61-75"), (m <= 90, "76-90"), (m <= 120, "90+"))
    third = ladder(none, (x <= 0, none), (x <= 40, "Defensive"), (x <= 80, "Middle"), (x <= 120, "Attacking"))
    return sectioned_counts(events, {
        "type": F.col("type"), "team": F.col("team"), "period": F.col("period"), "minute": bins, "zone": third, "play_pattern": F.col("play_pattern"),
        "shot_outcome": F.when(F.col("type") == "Shot", F.col("shot_outcome")), "incomplete_pass": F.when(F.col("type") == "Pass", F.col("pass_outcome")),
    })


def event_totals(events: DataFrame) -> DataFrame:
    """Volumes, coverage, shot quality and pass completion as one row."""
    shot, done, xg = F.col("type") == "Shot", F.col("type") == "Pass", F.col("shot_statsbomb_xg")
    return events.agg(
        F.count("*").alias("events"), F.count_distinct("match_id").alias("matches"), F.count_distinct("player").alias("players"),
        sum_flag(F.col("player").isNull()).alias("without_player"), sum_flag(F.col("location_x").isNotNull() & F.col("location_y").isNotNull()).alias("with_location"),
        sum_flag(F.col("minute") > 90).alias("after_90"), sum_flag(shot).alias("shots"), F.round(F.sum(F.when(shot, xg)), 3).alias("total_xg"),
        F.round(F.avg(F.when(shot, xg)), 3).alias("xg_per_shot"), sum_flag(shot & (xg > 0.3)).alias("big_chances"), sum_flag(done).alias("passes"),
        sum_flag(done & F.col("pass_outcome").isNull()).alias("completed"), sum_flag(F.col("counterpress")).alias("counterpress"))


def location_histogram(points: DataFrame, bins: tuple[int, int] = (40, 30), size: tuple[float, float] = (120.0, 80.0)) -> DataFrame:
    """Counts of locations on a grid; the far edge belongs to the last cell."""
    def cell(c: str, n: int, top: float) -> Column:
        return F.least(F.floor(F.col(c) * (n / top)), F.lit(n - 1)).cast("int")
    x, y = F.col("location_x"), F.col("location_y")
    return points.filter(x.between(0, size[0]) & y.between(0, size[1])).groupBy(
        cell("location_x", bins[0], size[0]).alias("x_bin"), cell("location_y", bins[1], size[1]).alias("y_bin")).agg(F.count("*").alias("n"))


def busiest_match(frames: DataFrame) -> DataFrame:
    """The match with most tracking rows, first by id on a tie."""
    return frames.groupBy("match_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match_id").limit(1)


# ---- line-ups (E4, E9, E11) ----------------------------------------------------------


def _minutes(column: str, default: float | None = None) -> Column:
    value = clock_seconds(F.col(column)) / 60.0
    return value if default is None else F.coalesce(value, F.lit(default))


def lineup_profile(lineups: DataFrame) -> DataFrame:
    """Roles, playing-time bands, cards, countries, shirts and positions from one scan."""
    span = _minutes("to_time") - _minutes("from_time")
    played = F.when(span.between(0, 130), span)
    starter, on = F.coalesce(F.col("from_time") == "00:00", F.lit(False)), F.coalesce(played > 0, F.lit(False))
    band = F.when(played > 0, ladder("<15", (played >= 90, "90+"), (played >= 60, "60-90"), (played >= 30, "30-60"), (played >= 15, "15-30")))
    return sectioned_counts(lineups, {
        "role": ladder("Unused bench", (starter & on, "Starter played"), (starter, "Starter unused"), (on, "Substitute")), "minutes": band,
        "card": F.col("card_type"), "country": F.col("country_name"), "shirt": F.col("jersey_number"), "position": F.col("position_name"), "team": F.col("team_name"),
    })


def participation(lineups: DataFrame, end: float = 90.0) -> DataFrame:
    """Player-matches with their minutes (an open end is minute 90), summed over position changes, as one row."""
    spans = lineups.select("match_id", "player_name", (_minutes("to_time", end) - _minutes("from_time", end)).alias("d"), F.coalesce(F.col("from_time") == "00:00", F.lit(False)).alias("s"))
    pm = spans.groupBy("match_id", "player_name").agg(F.sum("d").alias("d"), F.max("s").alias("started"), F.count("*").alias("rows"))
    on = F.col("d") > 0
    band = lambda lo, hi: sum_flag(on & (F.col("d") >= lo) & (F.col("d") < hi))
    return pm.agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("duplicate_rows"), sum_flag(on).alias("played"),
        F.round(sum_flag(on & ~F.col("started")) / F.count_distinct("match_id"), 1).alias("subs_per_match"),
        F.round(F.avg(F.when(on & F.col("started"), F.col("d"))), 1).alias("starter_minutes"), F.round(F.avg(F.when(on & ~F.col("started"), F.col("d"))), 1).alias("sub_minutes"),
        band(90, 1e9).alias("min_90"), band(60, 90).alias("min_60_90"), band(30, 60).alias("min_30_60"), band(0, 30).alias("min_under_30"))


def card_leaders(lineups: DataFrame, by: str = "player_name", n: int = 5) -> DataFrame:
    """Most cards per player or team, with cards per match."""
    rows = lineups.groupBy(by, "match_id").agg(sum_flag(F.col("card_type").isNotNull()).alias("c")).groupBy(by).agg(
        F.sum("c").alias("cards"), F.count("*").alias("matches"))
    return rows.filter(F.col("cards") > 0).withColumn("cards_per_match", ratio(F.col("cards"), F.col("matches"), 2)).orderBy(F.desc("cards"), by).limit(n)


def versatility(lineups: DataFrame, n: int = 5) -> DataFrame:
    return lineups.groupBy("player_name").agg(F.count_distinct("position_name").alias("unique_positions")).orderBy(
        F.desc("unique_positions"), "player_name").limit(n)


def position_minutes(lineups: DataFrame, matches: DataFrame, player: str, positions: list[str]) -> DataFrame:
    """Minutes per season of the players whose name contains ``player``, one column per position."""
    rows = lineups.filter(F.lower("player_name").contains(player.lower())).join(matches.select("match_id", "season_name"), "match_id")
    mins = _minutes("to_time", 90.0) - _minutes("from_time", 90.0)
    return rows.groupBy("season_name").agg(*[
        F.round(F.coalesce(F.sum(F.when(F.trim("position_name") == p, mins)), F.lit(0.0)), 2).alias(p) for p in positions])


def position_lifespan(lineups: DataFrame, end: float = 95.0) -> DataFrame:
    return lineups.groupBy("position_name").agg(F.avg(_minutes("to_time", end)).alias("mean_minutes"), F.count("*").alias("rows"))


# ---- tracking and reference (E6, E7) -------------------------------------------------


def tracking_profile(frames: DataFrame) -> DataFrame:
    per_event = frames.groupBy("match_id", "event_uuid").agg(
        F.count("*").alias("n"), sum_flag(F.col("teammate")).alias("t"), sum_flag(F.col("actor")).alias("a"), sum_flag(F.col("keeper")).alias("k"),
        sum_flag(F.col("location_x").isNotNull() & F.col("location_y").isNotNull()).alias("l"), sum_flag(F.col("visible_area").isNotNull()).alias("v"))
    return per_event.agg(
        F.sum("n").alias("frames"), F.count("*").alias("events"), F.count_distinct("match_id").alias("matches"), F.round(F.avg("n"), 2).alias("frames_per_event"),
        F.min("n").alias("min_frames"), F.max("n").alias("max_frames"), F.sum("t").alias("teammates"), F.sum("a").alias("actors"), F.sum("k").alias("keepers"),
        F.sum("l").alias("with_location"), F.sum("v").alias("with_area"))


def tracking_coverage(frames: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with tracking per competition against all its matches."""
    seen = frames.select("match_id").distinct().withColumn("_t", F.lit(1))
    return matches.select("match_id", "competition").join(seen, "match_id", "left").groupBy("competition").agg(
        F.count("_t").alias("tracked"), F.count("*").alias("matches")).withColumn("coverage_pct", pct(F.col("tracked"), F.col("matches"), 1))


def name_collisions(reference: DataFrame) -> DataFrame:
    """Names that stand for several ids inside one lookup table."""
    return reference.groupBy("table_name", "name").agg(F.count_distinct("id").alias("id_count")).filter(F.col("id_count") > 1)
