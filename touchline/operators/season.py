"""Match rows to season rows: aggregation rules, sample filter, recency weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import require_columns, scalar_stats, weighted_mean, weighted_mean_present

KEYS = ["player", "team", "season_name", "season_year"]

# The aggregation rule of each metric column.
SUMMED = [
    "possessions_with_shot", "xg_chain", "shots_in_chain", "goals_in_chain", "total_touches_in_chains",
    "possessions_with_buildup", "xg_buildup", "total_touches_in_buildup",
    "passes_made", "passes_received", "total_pass_involvement",
    "tackles", "interceptions", "pressures", "blocks", "clearances", "ball_recoveries", "fouls_committed",
    "duels_won", "total_duels", "defensive_third_actions", "middle_third_actions", "attacking_third_actions",
    "high_turnovers", "total_defensive_actions",
    "total_pressures", "counterpresses", "pressure_regains", "high_pressures", "minutes_played",
]
WEIGHTED = [
    "xg_chain_per90", "team_involvement_pct", "xg_buildup_per90", "avg_xg_per_possession",
    "network_involvement_pct", "degree_centrality", "pressures_per_90", "pressure_success_pct",
    "duel_win_pct", "pressure_pct", "tackle_interception_pct", "high_turnover_pct", "attacking_third_pct",
]
MODAL = ["defensive_profile", "unique_receivers", "unique_passers"]
DECAY = {"2023/2024": 1.0, "2022/2023": 0.9, "2021/2022": 0.8, "2024": 1.0, "2023": 0.9, "2022": 0.8}
HARD_THRESHOLD, SHRINKAGE_FLOOR = 270, 180


@dataclass(frozen=True)
class Metric:
    """One scored metric: where it comes from and how it is filtered, transformed and grouped."""

    key: str
    table: str
    column: str
    category: str
    transform: str = "rank"
    filter_column: str = "minutes_played"
    filter_threshold: int | None = None


# The thirteen metrics of the player score.
METRICS = [
    Metric("finishing_quality", "xg_totals", "goals_per_xg", "Final_Third_Output", "rank", "matches", 3),
    Metric("xg_volume", "xg_totals", "xg", "Final_Third_Output", "log", "matches", 3),
    Metric("progressive_passes", "progression_profile", "progressive_passes_p90", "Progression", "log1p"),
    Metric("progressive_carries", "progression_profile", "progressive_carries_p90", "Progression", "log1p"),
    Metric("packing", "packing", "avg_packing_per_pass", "Progression", "log1p", "total_passes", 30),
    Metric("xg_chain", "xg_chain", "xg_chain_per90", "Progression", "log"),
    Metric("team_involvement", "xg_chain", "team_involvement_pct", "Progression", "rank"),
    Metric("xg_buildup", "xg_buildup", "xg_buildup_per90", "Final_Third_Output", "log"),
    Metric("network_centrality", "network_centrality", "network_involvement_pct", "Control", "rank"),
    Metric("defensive_actions", "defensive_profile", "total_defensive_actions", "Mobility_Intensity", "log"),
    Metric("high_turnovers", "defensive_profile", "high_turnovers", "Mobility_Intensity", "log1p"),
    Metric("pressure_volume", "pressures", "pressures_per_90", "Mobility_Intensity", "rank"),
    Metric("pressure_success", "pressures", "pressure_success_pct", "Mobility_Intensity", "rank"),
]


def season_year(name: Column) -> Column:
    """Largest all-digit part of a season name: '2023/2024' gives 2024."""
    parts = F.filter(F.split(F.regexp_replace(name, "-", "/"), "/"), lambda p: p.rlike("^[0-9]+$"))
    return F.array_max(F.transform(parts, lambda p: p.cast("int")))


def with_season_year(df: DataFrame) -> DataFrame:
    return df.withColumn("season_year", season_year(F.col("season_name")))


def team_league_map(matches: DataFrame) -> DataFrame:
    """Distinct (team, competition, season) from both sides of the matches, in one scan."""
    return matches.select(
        F.explode(F.array("home_team", "away_team")).alias("team"),
        F.col("competition").alias("competition_name"), "season_name",
    ).distinct()


def main_competition(matches: DataFrame) -> DataFrame:
    """One competition per (team, season): the most frequent, the first by name on a tie."""
    counts = matches.select(
        F.explode(F.array("home_team", "away_team")).alias("team"), F.col("competition").alias("competition_name"), "season_name"
    ).groupBy("team", "season_name", "competition_name").agg(F.count("*").alias("n"))
    return counts.groupBy("team", "season_name").agg(
        F.min_by("competition_name", F.struct(-F.col("n"), F.col("competition_name"))).alias("competition_name")
    )


def match_to_season(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sum, minutes-weighted mean or mode per column; a column without a rule is left out."""
    require_columns(df, "minutes_played", *keys)
    exprs = []
    for name in df.columns:
        if name in SUMMED:
            exprs.append(F.coalesce(F.sum(name), F.lit(0)).alias(name))
        elif name in WEIGHTED:
            exprs.append(weighted_mean(F.col(name), F.col("minutes_played")).alias(name))
        elif name in MODAL:
            exprs.append(F.mode(name, True).alias(name))
    return df.groupBy(*keys).agg(*exprs)


def packing_to_season(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Packing averages weighted again by the passes behind them."""
    return df.groupBy(*keys).agg(
        F.sum("total_passes").alias("total_passes"), F.sum("total_opponents_packed").alias("total_opponents_packed"),
        F.sum("progressive_passes").alias("progressive_passes"),
        weighted_mean(F.col("avg_packing_per_pass"), F.col("total_passes")).alias("avg_packing_per_pass"),
        weighted_mean(F.col("avg_packing_progressive"), F.col("progressive_passes")).alias("avg_packing_progressive"),
    )


def season_level(df: DataFrame) -> DataFrame:
    """Rows already per season: common minutes name and a season year."""
    df = df.withColumnRenamed("total_mins", "minutes_played")
    if "season_year" not in df.columns and "season_name" in df.columns:
        df = with_season_year(df)
    return df


def aggregate_all(
    tables: dict[str, DataFrame], matches: DataFrame, season_tables=("xg_totals", "progression_profile"),
    packing_table: str = "packing", one_competition: bool = True,
) -> dict[str, DataFrame]:
    """Route each table through its rule, then attach the competition of (team, season).

    With ``one_competition`` a team that played several competitions in a season keeps
    its most frequent one; without it each row is repeated per competition.
    """
    league = main_competition(matches) if one_competition else team_league_map(matches)
    out = {}
    for name, df in tables.items():
        if name in season_tables:
            df = season_level(df)
        elif name == packing_table:
            df = packing_to_season(df)
        elif "match_id" in df.columns:
            df = match_to_season(df)
        if {"team", "season_name"} <= set(df.columns):
            df = df.join(league, ["team", "season_name"], "left")
        out[name] = df
    return out


def sample_filter(
    df: DataFrame, column: str = "minutes_played", threshold: int | None = None,
    hard: int = HARD_THRESHOLD, floor: int = SHRINKAGE_FLOOR,
) -> DataFrame:
    """Drop rows below the floor and flag those under the threshold.

    For a proxy column (matches, passes) the floor is scaled to its threshold.
    """
    if column not in df.columns:
        return df.withColumn("shrinkage_flag", F.lit(False))
    threshold = hard if threshold is None else threshold
    low = floor if column == "minutes_played" else int(round(floor / hard * threshold))
    return df.filter(F.col(column) >= low).withColumn("shrinkage_flag", F.col(column) < threshold)


def filter_all(tables: dict[str, DataFrame], metrics: list[Metric] = METRICS, **limits) -> dict[str, DataFrame]:
    out = {}
    for name, df in tables.items():
        spec = next((m for m in metrics if m.table == name), None)
        if spec is None:
            out[name] = df.withColumn("shrinkage_flag", F.lit(False))
        else:
            out[name] = sample_filter(df, spec.filter_column, spec.filter_threshold, **limits)
    return out


def apply_decay(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Recency weight of the season; an unknown season weighs 1."""
    if "season_name" not in df.columns:
        return df.withColumn("decay_weight", F.lit(1.0))
    pairs = [F.lit(x) for item in (weights or DECAY).items() for x in item]
    return df.withColumn("decay_weight", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("season_name")), F.lit(1.0)))


def time_decay_weight(year: Column, current_year: int = 2026, rate: float = 0.6) -> Column:
    return F.exp(F.lit(-float(rate)) * (F.lit(current_year) - year))


def time_decayed_metric(
    df: DataFrame, column: str, metric: str, volume: str | None = "minutes_played", min_volume: float = 400,
    current_year: int = 2026, rate: float = 0.6,
) -> DataFrame:
    """Exponentially decayed mean per player, kept above a volume threshold."""
    weight = time_decay_weight(F.col("season_year"), current_year, rate)
    out = df.groupBy("player").agg(
        weighted_mean(F.col(column), weight).alias(metric),
        (F.sum(volume) if volume else F.count("*")).alias("volume"),
    )
    return out.filter(F.col("volume") >= min_volume) if volume else out


def shrink_to_mean(df: DataFrame, column: str, volume: str = "volume", k: float = 10) -> DataFrame:
    """Prior-mean shrinkage (v*n + mean*k) / (n + k) toward the mean of all rows."""
    mean = scalar_stats(df, m=F.avg(column))["m"]
    n = F.col(volume)
    return df.withColumn(column, (F.col(column) * n + mean * k) / (n + k))


def recency_factor(df: DataFrame) -> DataFrame:
    """Per player: 1.0 in the latest season, 0.85 one season before, 0.70 earlier."""
    last = df.groupBy("player").agg(F.max("season_year").alias("last_year"))
    latest = scalar_stats(df, y=F.max("season_year"))["y"]
    # only players seen in the latest year or the one before get the higher factors
    return last.select("player", "last_year", F.when(F.col("last_year") == latest, 1.0).when(
        F.col("last_year") == latest - 1, 0.85).otherwise(0.70).alias("recency_factor"))


def player_means(df: DataFrame, value: str, weight: str = "minutes_played", min_mins: float = 400, min_matches: int = 5) -> DataFrame:
    """NULL-safe weighted mean per (player, team) above a row and a minutes floor."""
    return df.groupBy("player", "team").agg(
        weighted_mean_present(F.col(value), F.col(weight)).alias(value),
        F.sum(weight).alias("total_mins"), F.count("*").alias("n_matches"),
    ).filter((F.col("n_matches") >= min_matches) & (F.col("total_mins") >= min_mins))
