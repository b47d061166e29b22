"""Position lookup, shrinkage, season collapse, percentile and composite player scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import ladder, row_mean, weighted_mean_present
from touchline.functions.lineage import cut_lineage, join_groups
from touchline.functions.ranks import rank_columns, value_positions
from touchline.operators.season import METRICS, Metric

HARD_THRESHOLD, SHRINKAGE_FLOOR = 270, 180

# Position groups, labels, trait weights and multipliers.
POSITION_GROUPS = {
    "Goalkeeper": "GK",
    "Left Back": "FB", "Right Back": "FB", "Left Wing Back": "FB", "Right Wing Back": "FB",
    "Left Center Back": "CB", "Right Center Back": "CB", "Center Back": "CB",
    "Left Defensive Midfield": "DM", "Right Defensive Midfield": "DM", "Center Defensive Midfield": "DM",
    "Left Midfield": "CM", "Right Midfield": "CM", "Left Center Midfield": "CM", "Right Center Midfield": "CM",
    "Center Midfield": "CM",
    "Left Attacking Midfield": "AM", "Right Attacking Midfield": "AM", "Center Attacking Midfield": "AM",
    "Left Wing": "W", "Right Wing": "W",
    "Left Center Forward": "FW", "Right Center Forward": "FW", "Center Forward": "FW", "Secondary Striker": "FW",
}
GROUP_LABELS = {
    "CB": "Centre-Back", "FB": "Fullback / Wing-Back", "DM": "Defensive Midfielder", "CM": "Central Midfielder",
    "AM": "Attacking Midfielder", "W": "Winger", "FW": "Forward / Striker",
}
CATEGORIES = ["Mobility_Intensity", "Progression", "Control", "Final_Third_Output"]
GROUP_WEIGHTS = {  # per position group, in the order of CATEGORIES
    "FW": (0.05, 0.20, 0.05, 0.70),
    "W": (0.15, 0.40, 0.10, 0.35),
    "AM": (0.10, 0.35, 0.20, 0.35),
    "CM": (0.15, 0.35, 0.40, 0.10),
    "DM": (0.10, 0.35, 0.50, 0.05),
    "CB": (0.40, 0.35, 0.25, 0.00),
    "FB": (0.25, 0.50, 0.20, 0.05),
}
SEASON_ALIASES = {"2022": "2021/2022", "2023": "2022/2023", "2024": "2023/2024"}
CLUB_MULTIPLIERS = {"Tier_1": 1.00, "Tier_2": 0.95, "Tier_3": 0.88, "Tier_4": 0.75, "Tier_5": 0.60}
UNLISTED_CLUB = 0.80
COMPETITION_MULTIPLIERS = {
    "La Liga": 1.00, "Premier League": 1.00, "Serie A": 1.00, "1. Bundesliga": 1.00, "Ligue 1": 1.00,
    "Champions League": 1.00, "UEFA Europa League": 0.85, "Copa del Rey": 0.80, "Liga Profesional": 0.80,
    "Major League Soccer": 0.70, "North American League": 0.65, "Indian Super league": 0.55,
    "FIFA World Cup": 0.75, "UEFA Euro": 0.75, "Copa America": 0.70, "African Cup of Nations": 0.65,
    "FIFA U20 World Cup": 0.50,
}
UNLISTED_COMPETITION = 0.65
CLUB_COMPETITIONS = [
    "La Liga", "Premier League", "Serie A", "1. Bundesliga", "Ligue 1", "Champions League", "UEFA Europa League",
    "Liga Profesional", "Major League Soccer",
]
TOURNAMENTS = ["FIFA World Cup", "UEFA Euro", "Copa America", "African Cup of Nations", "FIFA U20 World Cup"]
CONFIDENCE = {"A": 1.00, "B": 0.97, "C": 0.90, "D": 0.80}
# League multipliers of the older score, by tier.
LEAGUE_MULTIPLIERS = {"Tier_1": 1.3, "Tier_2": 1.15, "Tier_3": 1.05, "Tier_4": 0.85, "Tier_5": 0.65}


def lookup(key: Column, values: dict, default=None) -> Column:
    """Small fixed dictionary as a map literal."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def position_lookup(lineups: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Most frequent position group per (player, season), the first by name on a tie."""
    rows = lineups.select(
        F.col("player_name").alias("player"), "match_id", lookup(F.col("position_name"), POSITION_GROUPS).alias("archetype")
    ).filter(F.col("player").isNotNull() & F.col("archetype").isNotNull())
    if matches is None:
        rows = rows.withColumn("season_name", F.lit("unknown"))
    else:
        rows = rows.join(matches.select("match_id", "season_name"), "match_id", "left")
    counts = rows.groupBy("player", "season_name", "archetype").agg(F.count("*").alias("n"))
    return counts.groupBy("player", "season_name").agg(
        F.min_by("archetype", F.struct(-F.col("n"), F.col("archetype"))).alias("archetype")
    )


def position_map(events: DataFrame) -> DataFrame:
    """Modal position group per player over all events, the first by name on a tie."""
    rows = events.select("player", lookup(F.col("position"), POSITION_GROUPS).alias("archetype"))
    counts = rows.filter(F.col("player").isNotNull() & F.col("archetype").isNotNull()).groupBy("player", "archetype").agg(
        F.count("*").alias("n"))
    return counts.groupBy("player").agg(F.min_by("archetype", F.struct(-F.col("n"), F.col("archetype"))).alias("archetype"))


def apply_shrinkage(
    df: DataFrame, columns: list[str], positions: DataFrame, sample: str | None = "minutes_played",
    threshold: float = HARD_THRESHOLD, floor: float = SHRINKAGE_FLOOR,
) -> DataFrame:
    """Pull flagged rows toward the mean of their (season, position group).

    The thresholds are in the unit of ``sample``. The defaults are minutes; a proxy
    column compared with them is shrunk fully, which is the published behaviour.
    """
    keys = [k for k in ("player", "season_name") if k in df.columns]
    df = df.join(positions.withColumnRenamed("archetype", "position_archetype"), keys, "left").fillna("CM", ["position_archetype"])
    if "shrinkage_flag" not in df.columns:
        return df
    group = [k for k in ("season_name", "position_archetype") if k in df.columns]
    # One row per (season, group): aggregated, then joined back.
    means = df.filter(~F.col("shrinkage_flag")).groupBy(*group).agg(*[F.avg(c).alias(f"_mu_{c}") for c in columns])
    df = join_groups(df, means, group)
    if sample and sample in df.columns:
        m = F.col(sample)
        lam = F.when(m >= threshold, 0.0).when(m <= floor, 1.0).otherwise(1.0 - (m - floor) / float(threshold - floor))
    else:
        lam = F.lit(0.5)
    for c in columns:
        pulled = (1.0 - lam) * F.col(c) + lam * F.coalesce(F.col(f"_mu_{c}"), F.lit(0.5))
        df = df.withColumn(c, F.when(F.col("shrinkage_flag"), pulled).otherwise(F.col(c)))
    return df.drop(*[f"_mu_{c}" for c in columns])


def apply_segmentation(df: DataFrame) -> DataFrame:
    """Keep outfield position groups and add their label."""
    if "position_archetype" not in df.columns:
        return df
    return df.filter(F.col("position_archetype").isin(list(GROUP_LABELS))).withColumn(
        "archetype_label", lookup(F.col("position_archetype"), GROUP_LABELS))


META = ["team", "position_archetype", "archetype_label", "decay_weight", "shrinkage_flag", "competition_name"]


def unified_table(tables: dict[str, DataFrame], fan_out: bool = True) -> DataFrame:
    """All tables on (player, season), as outer joins give it; descriptive columns take the first present value in the order of the tables.

    The tables are stacked and folded by one aggregate. A key that tables repeat (a player with two teams) gives every
    combination of their rows; without ``fan_out`` it gives one row, with mean values and the descriptions of its first team by name.
    """
    keys = ["player", "season_name"]
    parts = []
    for df in tables.values():
        norms = [c for c in df.columns if c.endswith("_norm")]
        if norms:
            season = F.coalesce(lookup(F.col("season_name"), SEASON_ALIASES), F.col("season_name")).alias("season_name")
            parts.append(df.select("player", season, *[c for c in META if c in df.columns], *norms))
    columns = list(dict.fromkeys(c for p in parts for c in p.columns if c not in keys))
    meta = [c for c in META if c in columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    named = F.col("player").isNotNull() & F.col("season_name").isNotNull()
    if not fan_out:
        order = F.struct("_part", *[c for c in ("team",) if c in meta])
        first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c)
        return stacked.filter(named).groupBy(*keys).agg(*[first(c) for c in meta], *[F.avg(c).alias(c) for c in columns if c not in meta])
    own = [[c for c in p.columns if c not in keys] for p in parts]
    out = stacked.filter(named).groupBy(*keys).agg(*[F.collect_list(F.when(F.col("_part") == i, F.struct(*cs))).alias(f"_t{i}") for i, cs in enumerate(own)])
    for i in range(len(parts)):
        out = out.withColumn(f"_t{i}", F.explode_outer(f"_t{i}"))
    value = lambda c: F.coalesce(*[F.col(f"_t{i}")[c] for i, cs in enumerate(own) if c in cs]).alias(c)
    # a row without a player or a season meets no other
    return out.select(*keys, *map(value, columns)).unionByName(stacked.filter(~named).select(*keys, *columns))


def decay_collapse(unified: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One row per player: decay-weighted means, modal descriptions and the list of seasons."""
    if positions is not None:
        unified = unified.join(positions.withColumnRenamed("archetype", "_pos"), "player", "left").withColumn(
            "position_archetype", F.coalesce("position_archetype", "_pos")).drop("_pos")
    unified = unified.filter(F.col("position_archetype").isNotNull())
    if "decay_weight" not in unified.columns:
        unified = unified.withColumn("decay_weight", F.lit(1.0))
    norms = [c for c in unified.columns if c.endswith("_norm")]
    modal = [c for c in ("team", "position_archetype", "archetype_label", "competition_name") if c in unified.columns]
    return unified.groupBy("player").agg(
        *[F.mode(c, True).alias(c) for c in modal],
        F.array_sort(F.collect_set("season_name")).alias("seasons_present"),
        F.max("decay_weight").alias("decay_weight_max"),
        *[weighted_mean_present(F.col(c), F.col("decay_weight")).alias(c) for c in norms],
    )


def dense_percentile() -> Column:
    """Dense rank over its maximum times 100, 50 for a group of one, over a positions row."""
    return F.when(F.col("total") <= 1, 50.0).otherwise(F.col("dense") / F.col("levels") * 100.0)


def group_percentiles(df: DataFrame, keys: list[str], group: str, columns: dict[str, str]) -> DataFrame:
    """Dense percentile of each column inside its group."""
    present = df.filter(F.col(group).isNotNull())
    return df.join(rank_columns(present, keys, [group], columns, dense_percentile()).drop(group), keys, "left")


def category_score(columns: list[str]) -> Column:
    """Mean of the present percentiles; packing counts only where its normalised value is above zero."""
    cols = [
        F.when(F.col("packing_norm").isNotNull() & (F.col("packing_norm") != 0), F.col(c)) if c == "packing_pct" else F.col(c)
        for c in columns
    ]
    return row_mean(cols)


def composite(group: Column, scores: dict[str, Column]) -> Column:
    """Position-weighted mean of the present categories; a plain mean for an unknown group."""
    known = lookup(group, {g: True for g in GROUP_WEIGHTS}, False)
    weight = {c: lookup(group, {g: w[i] for g, w in GROUP_WEIGHTS.items()}) for i, c in enumerate(CATEGORIES)}
    num = reduce(lambda a, b: a + b, [F.coalesce(s * weight[c], F.lit(0.0)) for c, s in scores.items()])
    den = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), weight[c]).otherwise(0.0) for c, s in scores.items()])
    return F.when(known, num / F.nullif(den, F.lit(0.0))).otherwise(row_mean(list(scores.values())))


def age_multiplier(age: Column) -> Column:
    return F.when(age <= 29, 1.0).when(age <= 31, 0.97).when(age <= 33, 0.93).when(age <= 35, 0.88).otherwise(0.82)


def with_club_and_age(df: DataFrame, rosters: DataFrame, club_tiers: DataFrame) -> DataFrame:
    """Club, club multiplier, age and age multiplier; the competition decides for unlisted players."""
    roster = rosters.groupBy("player").agg(F.max_by(F.struct("club", "age"), F.struct("country", "club")).alias("r"))
    tiers = club_tiers.select("club", lookup(F.col("tier"), CLUB_MULTIPLIERS).alias("_tier_mult"))
    df = (
        df.join(roster.select("player", F.col("r.club").alias("club"), F.col("r.age").alias("_age")), "player", "left")
        .join(tiers, "club", "left")
    )
    by_competition = lookup(F.col("competition_name"), COMPETITION_MULTIPLIERS, UNLISTED_COMPETITION)
    return (
        df.withColumn("club_weight", F.when(
            F.col("club").isNotNull(), F.coalesce(F.col("_tier_mult"), F.lit(UNLISTED_CLUB))).otherwise(by_competition))
        .withColumn("team", F.coalesce("club", "team"))
        .withColumn("age", F.coalesce(F.col("_age"), F.lit(27)))
        .withColumn("age_multiplier", age_multiplier(F.col("age")))
        .drop("club", "_tier_mult", "_age")
    )


def coverage_tier(seasons: Column, competition: Column) -> Column:
    club = F.coalesce(competition.isin(CLUB_COMPETITIONS), F.lit(False))
    n = F.size(seasons)
    return ladder("D", (club & (n >= 2), "A"), (club & (n >= 1), "B"), (competition.isin(TOURNAMENTS), "C"))


def coverage_confidence(tier: Column) -> Column:
    return lookup(tier, CONFIDENCE, 0.80)


def build_scores(
    tables: dict[str, DataFrame], rosters: DataFrame, club_tiers: DataFrame, positions: DataFrame | None = None,
    metrics: list[Metric] = METRICS, min_categories: int = 3,
) -> DataFrame:
    """Unified table to ranked composite scores. ``rank`` counts all players, ties share it."""
    players = with_club_and_age(decay_collapse(unified_table(tables), positions), rosters, club_tiers)
    players = cut_lineage(players)  # read by the percentile ranking and by the score
    norms = {f"{m.key}_norm": f"{m.key}_pct" for m in metrics if f"{m.key}_norm" in players.columns}
    players = group_percentiles(players, ["player"], "position_archetype", norms)
    scores = {}
    for category in CATEGORIES:
        pcts = [f"{m.key}_pct" for m in metrics if m.category == category and f"{m.key}_norm" in norms]
        players = players.withColumn(f"{category}_score", category_score(pcts) if pcts else F.lit(None).cast("double"))
        scores[category] = F.col(f"{category}_score")
    players = (
        players.withColumn("coverage_tier", coverage_tier(F.col("seasons_present"), F.col("competition_name")))
        .withColumn("confidence", coverage_confidence(F.col("coverage_tier")))
        .withColumn("composite_score", composite(F.col("position_archetype"), scores)
                    * F.col("club_weight") * F.col("age_multiplier") * F.col("confidence"))
    )
    players = rank_descending(players, "composite_score")
    present = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores.values()])
    return players.filter(present >= min_categories)


def rank_descending(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Competition rank from the highest value down; NULL values have no rank."""
    df = cut_lineage(df)
    positions = value_positions(df, [], column)
    ranks = positions.select(column, (F.col("total") - F.col("below") - F.col("n") + 1).alias(name))
    return df.join(ranks, column, "left")


def blend_external_list(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """Blend with an external ranked list (player, team, rank): the weight depends on the rank tier.

    Players outside the list are capped at 70; players only in the list are appended. ``rank`` is made anew from the final
    score over all of them; ties share it and players without a score have none.
    """
    r = F.col("list_rank")
    scored = scored.drop("rank")
    listed = ranked.select("player", F.col("team").alias("list_team"), F.col("rank").alias("list_rank"))
    # Scores and weights by place in the list.
    score = (
        F.when(r <= 10, 90.0 - (r - 1) * (7.0 / 9.0)).when(r <= 30, 82.0 - (r - 11) * (10.0 / 19.0))
        .otherwise(71.0 - (r - 31) * (16.0 / 69.0))
    )
    weight = F.when(r <= 10, 0.40).when(r <= 30, 0.25).otherwise(0.15)
    only = F.when(r <= 10, 65.0 - (r - 1) * (5.0 / 9.0)).otherwise(40.0 - (r - 11) * (10.0 / 89.0))
    value = F.col("composite_score")
    both = scored.join(listed.drop("list_team"), "player", "left").withColumn("final_score", F.when(
        value.isNull(), F.lit(None)).when(r.isNotNull(), (1.0 - weight) * value + weight * score).otherwise(F.least(value, F.lit(70.0))))
    extra = listed.join(scored.select("player"), "player", "left_anti").select(
        "player", F.col("list_team").alias("team"), F.lit("D").alias("coverage_tier"), only.alias("final_score"))
    return rank_descending(both.drop("list_rank").unionByName(extra, allowMissingColumns=True), "final_score")


# ---- the older score ------------------------------------------------------------------

# Trait weights by position words, in the order of CATEGORIES; the first match counts.
ROLE_WEIGHTS = [
    ("goalkeeper", (0.1, 0.3, 0.2, 0.0)),
    ("cent(er|re) back", (0.45, 0.55, 0.55, 0.15)),
    ("left back|right back|wing back", (0.85, 1.0, 0.65, 0.55)),
    ("defensive midfield", (0.75, 0.75, 0.85, 0.4)),
    ("cent(er|re) midfield", (0.80, 0.80, 0.80, 0.65)),
    ("attacking midfield", (0.65, 0.85, 0.95, 1.0)),
    ("wing", (1.0, 0.80, 0.75, 1.0)),
    ("forward|striker", (0.50, 0.55, 0.75, 1.0)),
]
OTHER_ROLE = (0.75, 0.85, 0.85, 0.75)


def role_weight(position: Column, trait: str) -> Column:
    """Trait weight from the words of a position name; 1 without a position."""
    i, name = CATEGORIES.index(trait), F.lower(position)
    steps = [(name.rlike(words) & ((F.lit(words != "wing")) | ~name.contains("back")), F.lit(w[i])) for words, w in ROLE_WEIGHTS]
    return F.when(position.isNull(), F.lit(1.0)).otherwise(ladder(F.lit(OTHER_ROLE[i]), *steps))


def trait_scores(df: DataFrame, traits: dict[str, list[str]]) -> DataFrame:
    """0.7 of the best and 0.3 of the mean percentile of each trait, NULL as 0."""
    for trait, columns in traits.items():
        filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
        best = F.greatest(*filled) if len(filled) > 1 else filled[0]
        df = df.withColumn(trait, best * 0.7 + reduce(lambda a, b: a + b, filled) / float(len(filled)) * 0.3)
    return df


def position_weights(df: DataFrame, position: str = "position") -> DataFrame:
    for trait in CATEGORIES:
        if trait in df.columns:
            df = df.withColumn(trait, F.col(trait) * role_weight(F.col(position), trait))
    return df


def overall_quality(df: DataFrame, position: str = "position") -> DataFrame:
    """Weighted mean of the traits; the weight of a NULL trait stays in the denominator."""
    traits = [t for t in CATEGORIES if t in df.columns]
    w = {t: role_weight(F.col(position), t) for t in traits}
    num = reduce(lambda a, b: a + b, [F.coalesce(F.col(t) * w[t], F.lit(0.0)) for t in traits])
    den = reduce(lambda a, b: a + b, [w[t] for t in traits])
    return df.withColumn("overall_quality", F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0)))
