"""Player scores end to end: event metrics, season rows, normalising, shrinkage, composite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import clip, weighted_mean
from touchline.functions.lineage import cut_lineage
from touchline.functions.scale import normalise_columns, percentile_99
from touchline.operators import defence, network, packing, progression, scoring, season, xg
from touchline.operators.season import METRICS, Metric


def metric_tables(events: DataFrame, matches: DataFrame, lineups: DataFrame, three_sixty: DataFrame) -> dict[str, DataFrame]:
    """The match- and season-level metric tables the scores are built from.

    The progression profile is per season in the source layout, so it is built from
    per-season minutes and actions.
    """
    names = ["progressive_passes", "progressive_carries", "progressive_passes_received"]
    with_season = lambda df: season.with_season_year(df)
    minutes = progression.minutes_played(lineups, events).join(matches.select("match_id", "season_name"), "match_id", "left")
    total = minutes.groupBy("season_name", "team", "player").agg(F.sum("minutes_played").alias("total_mins"))
    acts = progression.progressive_actions(events, matches).groupBy("season_name", "team", "player").agg(*[F.sum(n).alias(n) for n in names])
    profile = total.join(acts, ["season_name", "team", "player"], "left").fillna(0, names)
    for n in names:
        profile = profile.withColumn(f"{n}_p90", F.round(F.col(n) / F.nullif(F.col("total_mins").cast("double"), F.lit(0.0)) * 90.0, 2))
    return {
        "xg_totals": with_season(xg.xg_by_player(events, matches)).withColumn(
            "goals_per_xg", F.col("goals") / clip(F.col("xg"), low=0.1)),
        "progression_profile": with_season(profile),
        "packing": with_season(packing.packing(events, three_sixty, matches, min_passes=1)),
        "xg_chain": with_season(xg.xg_chain(events, matches, lineups)),
        "xg_buildup": with_season(xg.xg_buildup(events, matches, lineups)),
        "network_centrality": with_season(network.pass_network_centrality(events, matches, lineups)),
        "defensive_profile": with_season(defence.defensive_profile(events, matches, lineups, min_actions=1)),
        "pressures": with_season(defence.pressure_metrics(events, matches, lineups)),
    }


def score_players(
    tables: dict[str, DataFrame], matches: DataFrame, lineups: DataFrame, events: DataFrame, rosters: DataFrame,
    club_tiers: DataFrame, metrics: list[Metric] = METRICS,
) -> DataFrame:
    """Season rows, sample filter, decay, per-season normalising, shrinkage, segmentation, scores."""
    lookup = cut_lineage(scoring.position_lookup(lineups, matches))
    ready = {}
    for name, df in season.filter_all(season.aggregate_all(tables, matches), metrics).items():
        own = [m for m in metrics if m.table == name and m.column in df.columns]
        df = cut_lineage(season.apply_decay(df))  # season rows are read by the ranking and by the scores
        keys = ["player", "team", "season_name"]
        df = normalise_columns(df, keys, ["season_name"], {f"{m.key}_norm": (m.column, m.transform) for m in own})
        sample = own[0].filter_column if own and own[0].filter_column in df.columns else None
        df = scoring.apply_shrinkage(df, [f"{m.key}_norm" for m in own], lookup, sample)
        ready[name] = cut_lineage(scoring.apply_segmentation(df))
    return scoring.build_scores(ready, rosters, club_tiers, scoring.position_map(events), metrics)


def older_score(
    rows: DataFrame, columns: dict[str, str], traits: dict[str, list[str]], latest: DataFrame, club_tiers: DataFrame,
    current_year: int = 2026, min_volume: float = 400, shrunk: str | None = None,
) -> DataFrame:
    """Decayed metrics, league multiplier, percentiles, traits by position and the recency factor."""
    weight = season.time_decay_weight(F.col("season_year"), current_year)
    metrics = rows.groupBy("player").agg(
        *[weighted_mean(F.col(c), weight).alias(m) for m, c in columns.items()], F.sum("minutes_played").alias("volume"),
    ).filter(F.col("volume") >= min_volume)
    if shrunk is not None:
        metrics = season.shrink_to_mean(metrics, shrunk)
    tiers = club_tiers.select(F.col("club").alias("latest_club"), scoring.lookup(F.col("tier"), scoring.LEAGUE_MULTIPLIERS).alias("league_mult"))
    metrics = reduce(lambda a, b: a.join(b[0], b[1], "left"), [
        (season.recency_factor(rows).select("player", "recency_factor"), "player"), (latest, "player"), (tiers, "latest_club")], metrics)
    metrics = metrics.withColumns({m: F.col(m) * F.coalesce("league_mult", F.lit(1.0)) for m in columns}).drop("volume")
    metrics = percentile_99(cut_lineage(metrics), ["player"], list(columns))
    scored = scoring.trait_scores(metrics, {t: [f"{m}_percentile" for m in ms] for t, ms in traits.items()})
    scored = scoring.overall_quality(scoring.position_weights(scored))
    return scored.withColumn("overall_quality", clip(F.col("overall_quality") * F.col("recency_factor"), 0, 100))
