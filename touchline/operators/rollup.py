"""Entity roll-ups: squads to teams, composite readiness, rankings and standings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import ladder, pct, ratio, row_mean, sum_flag
from touchline.functions.lineage import join_statistics
from touchline.functions.ranks import average_rank, quantile_scalars, rank_columns
from touchline.functions.scale import min_max
from touchline.operators.scoring import lookup

# Position lines and the places each is guaranteed.
LINES = {"CB": "DEF", "FB": "DEF", "DM": "MID", "CM": "MID", "AM": "MID", "FW": "ATT", "W": "ATT"}
PLACES = {"DEF": 3, "MID": 3, "ATT": 2}
MIN_PLAYER_WEIGHT = 0.40
ARCHETYPE_SCORES = {
    "High Press / High Output": 85, "Possession Dominant": 75, "Compact Transition": 65,
    "Mid-Block Reactive": 60, "Moderate Possession": 50, "Low Intensity": 40,
}
COMPONENT_WEIGHTS = {
    "player_quality": 0.35, "tactical_archetype": 0.20, "fifa_score": 0.15, "club_cohesion": 0.10,
    "squad_age": 0.05, "coach_tenure": 0.05, "tournament_exp": 0.05, "confederation": 0.05,
}
TRAVEL = {"UEFA": 2.5, "CONMEBOL": 1.0, "CAF": 2.0, "AFC": 2.5, "CONCACAF": 0.0}
ADVANTAGE_WEIGHTS = {"Squad_Quality": 0.40, "Star_Power": 0.25, "Stability": 0.20, "Cohesion": 0.10, "Recovery": 0.05}
STAGES = {
    "Champion": "p_champion", "Runner-up": "p_runner_up", "Semi-final": "p_semi_final",
    "Quarter-final": "p_quarter_final", "Round of 16": "p_round_of_16", "Round of 32": "p_round_of_32",
    "Group Stage": "p_group_exit",
}


# ---- scores of single factors (R5) ---------------------------------------------------


def rank_score(rank: Column, worst: int = 90) -> Column:
    """Log scale: rank 1 gives 100, the worst rank 20."""
    return F.round(100.0 - F.log(rank.cast("double")) / F.log(F.lit(float(worst))) * 80.0, 1)


def tenure_score(years: Column) -> Column:
    return (
        F.when(years < 1, 50.0).when(years <= 3, 50.0 + (years - 1) * 15.0).when(years <= 7, 80.0 + (years - 3) * 2.5)
        .when(years <= 10, 90.0 - (years - 7) * 5.0).otherwise(F.greatest(75.0 - (years - 10) * 3.0, F.lit(50.0)))
    )


def experience_score(appearances: Column, most: int = 22) -> Column:
    return F.when(appearances == 0, 20.0).otherwise(
        F.round(40.0 + F.log(appearances + F.lit(1.0)) / F.log(F.lit(float(most + 1))) * 60.0, 1))


def squad_age_score(mean_age: Column) -> Column:
    """100 for a mean age of 26 to 29, 8 points off per year outside, not under 30 for old squads."""
    return (
        F.when(mean_age.isNull(), 70.0).when(mean_age.between(26, 29), 100.0)
        .when(mean_age < 26, F.round(100.0 - (26.0 - mean_age) * 8.0, 1))
        .otherwise(F.round(F.greatest(100.0 - (mean_age - 29.0) * 8.0, F.lit(30.0)), 1))
    )


def external_factors(countries: DataFrame) -> DataFrame:
    return countries.select(
        "country", rank_score(F.coalesce("fifa_rank", F.lit(80))).alias("fifa_score"),
        F.round(tenure_score(F.coalesce("coach_years", F.lit(1.0))), 1).alias("coach_tenure_score"),
        experience_score(F.coalesce("wc_appearances", F.lit(0))).alias("tournament_exp_score"),
    )


# ---- squads (R1-R4, R6, R7) ----------------------------------------------------------


def _matched(rosters: DataFrame, scored: DataFrame) -> DataFrame:
    keep = [c for c in ("player", "position_archetype", "final_score") if c in scored.columns]
    return rosters.select("country", "player").join(scored.select(*keep), "player")


def coverage_confidence(rosters: DataFrame, scored: DataFrame, baseline: int = 11) -> DataFrame:
    """Share of a starting eleven that has a score, at most 1."""
    n = _matched(rosters, scored).groupBy("country").agg(F.count("*").alias("n_players_scored"))
    return rosters.select("country").distinct().join(n, "country", "left").fillna(0, ["n_players_scored"]).withColumn(
        "player_coverage_confidence", F.round(F.least(F.col("n_players_scored") / float(baseline), F.lit(1.0)), 3))


def top_players_balanced(rosters: DataFrame, scored: DataFrame) -> DataFrame:
    """Best players per country with guaranteed places per line, filled up by score.

    The size is 60 % of the roster, at least 8 and at most 15. Both windows keep
    a fixed number of rows, so Spark trims each group before the shuffle.
    """
    size = rosters.groupBy("country").agg(
        F.greatest(F.lit(8), F.least(F.lit(15), F.floor(F.count("*") * 0.6).cast("int"))).alias("top_n"))
    order = [F.desc_nulls_last("final_score"), "player"]
    rows = _matched(rosters, scored).withColumn("line", lookup(F.col("position_archetype"), LINES))
    lined = W.partitionBy("country", "line").orderBy(*order)
    places = lookup(F.col("line"), PLACES)
    # no more than 15 rows of a line can be chosen, so the rest is cut early
    rows = rows.withColumn("line_rank", F.row_number().over(lined)).filter(F.col("line_rank") <= 15)
    rows = rows.withColumn("guaranteed", F.coalesce(F.col("line_rank") <= places, F.lit(False)))
    overall = W.partitionBy("country").orderBy(F.desc("guaranteed"), *order)
    return (
        rows.withColumn("pick", F.row_number().over(overall)).filter(F.col("pick") <= 15)
        .join(size, "country").filter(F.col("pick") <= F.col("top_n"))
        .select("country", "player", "position_archetype", "final_score", "guaranteed", "top_n")
    )


def player_quality(rosters: DataFrame, scored: DataFrame, countries: DataFrame) -> DataFrame:
    """Mean of the five best, blended with the ranking fallback by coverage (at least 40 % players)."""
    five = W.partitionBy("country").orderBy(F.desc_nulls_last("final_score"), "player")
    best = (
        _matched(rosters, scored).withColumn("k", F.row_number().over(five)).filter(F.col("k") <= 5)
        .groupBy("country").agg(
            F.avg("final_score").alias("mean5"), F.min_by("player", "k").alias("top_player"),
            F.max("final_score").alias("top_score"))
    )
    out = coverage_confidence(rosters, scored).join(best, "country", "left").join(
        countries.select("country", "fifa_rank"), "country", "left")
    fallback = rank_score(F.coalesce("fifa_rank", F.lit(60))) * 0.75
    w = F.greatest(F.col("player_coverage_confidence"), F.lit(MIN_PLAYER_WEIGHT))
    return out.select(
        "country", F.round("mean5", 2).alias("player_quality_score"),
        F.when(F.col("n_players_scored") == 0, F.round(fallback, 2))
        .otherwise(F.round(w * F.col("mean5") + (1.0 - w) * fallback, 2)).alias("effective_score"),
        "player_coverage_confidence", "n_players_scored", "top_player", F.round("top_score", 2).alias("top_player_score"),
    )


def player_quality_table(rosters, scored, countries) -> tuple[DataFrame, DataFrame]:
    """Country summary (NULL scores last) and the player rows behind it."""
    summary = player_quality(rosters, scored, countries).orderBy(F.desc_nulls_last("player_quality_score"), "country")
    detail = rosters.select("country", "player").join(scored.drop("country"), "player")
    return summary, detail


def club_cohesion(rosters: DataFrame) -> DataFrame:
    """Share of a squad at its largest club, and the Herfindahl concentration of clubs."""
    counts = rosters.groupBy("country", "club").agg(F.count("*").alias("n"))
    n, total = F.col("n"), F.sum("n")
    known = F.when(F.col("club").isNotNull(), n)
    return counts.groupBy("country").agg(
        F.min_by("club", F.struct(-n, F.col("club"))).alias("top_club"), F.max("n").alias("cohesion_count"),
        F.least(F.max("n") / total * 100.0, F.lit(100.0)).alias("cohesion_score"),
        (F.sum(known * known) / F.nullif(total * total, F.lit(0)) * 10.0).alias("herfindahl_cohesion"),
    )


# ---- readiness (R8, R9, R10) ---------------------------------------------------------


def team_readiness(rosters, scored, countries, archetypes: DataFrame | None = None) -> DataFrame:
    """Weighted components per country; a missing tactical component hands its weight to the rest."""
    quality = player_quality(rosters, scored, countries)
    ages = rosters.groupBy("country").agg(F.avg("age").alias("mean_age"))
    cohesion = club_cohesion(rosters).select("country", "cohesion_score")
    df = reduce(lambda a, b: a.join(b, "country", "left"), [
        quality, external_factors(countries), cohesion, ages, countries.select("country", "confederation_bonus")])
    if archetypes is not None:
        df = df.join(archetypes.select(F.col("team").alias("country"), "archetype", "archetype_score", "gmm_confidence"), "country", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("archetype_score", "gmm_confidence")}).withColumn("archetype", F.lit(None).cast("string"))
    tactical = F.when(F.col("archetype").isNotNull(), F.coalesce(
        F.col("archetype_score").cast("double"), lookup(F.col("archetype"), ARCHETYPE_SCORES, 60).cast("double")))
    fifa, conf = F.coalesce("fifa_score", rank_score(F.lit(80))), F.coalesce(F.col("gmm_confidence"), F.lit(1.0))
    df = df.withColumn("tactical_archetype", tactical).withColumn("archetype_available", tactical.isNotNull())
    blended = F.when(conf == 0.0, F.col("tactical_archetype")).otherwise(
        conf * F.col("tactical_archetype") + (1.0 - conf) * fifa * 0.8)
    parts = {
        "player_quality": F.coalesce(F.col("effective_score"), fifa * 0.8), "fifa_score": fifa,
        "club_cohesion": F.coalesce("cohesion_score", F.lit(0.0)), "coach_tenure": F.coalesce("coach_tenure_score", F.lit(50.0)),
        "tournament_exp": F.coalesce("tournament_exp_score", F.lit(20.0)), "squad_age": squad_age_score(F.col("mean_age")),
    }
    rest = sum(w for k, w in COMPONENT_WEIGHTS.items() if k != "tactical_archetype")
    full = reduce(lambda a, b: a + b, [v * COMPONENT_WEIGHTS[k] for k, v in parts.items()]) + blended * COMPONENT_WEIGHTS["tactical_archetype"]
    without = reduce(lambda a, b: a + b, [v * round(COMPONENT_WEIGHTS[k] / rest, 4) for k, v in parts.items()])
    bonus = F.coalesce(F.col("confederation_bonus"), F.lit(1.0))
    return df.withColumn("_c", F.when(F.col("archetype_available"), full).otherwise(without)).select(
        "country", F.round(F.col("_c") * bonus, 2).alias("final_score"), F.round("_c", 2).alias("composite_score"),
        bonus.alias("confederation_bonus"), F.round(parts["player_quality"], 2).alias("player_quality_score"),
        "player_coverage_confidence", "n_players_scored", "tactical_archetype", F.when(F.col("archetype_available"), conf).alias("gmm_confidence"),
        F.round(fifa, 2).alias("fifa_score"), F.round(parts["club_cohesion"], 2).alias("club_cohesion_score"),
        F.round(parts["coach_tenure"], 2).alias("coach_tenure_score"), F.round(parts["tournament_exp"], 2).alias("tournament_exp_score"),
        F.round(parts["squad_age"], 2).alias("squad_age_score"), "archetype_available",
    )


def system_fit(
    squads: DataFrame, squad_sizes: DataFrame, countries: DataFrame, success: DataFrame,
    local_clubs: DataFrame, hosts: list[str], current_year: int = 2026, prior: float = 55.0,
) -> DataFrame:
    """Squad quality adjusted for stability, stars, travel, hosting, cohesion and the record of the style.

    ``squads`` holds the matched players (country, player, overall_quality, club);
    ``success`` the record per cluster (cluster, archetype_name, winner_pct, qf_plus_pct).
    """
    squads = squads.dropDuplicates(["country", "player"])
    top = W.partitionBy("country").orderBy(F.desc_nulls_last("overall_quality"), "player")
    stars = squads.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= 3).groupBy("country").agg(
        F.avg("overall_quality").alias("top3"))
    clubs = squads.filter(F.col("club").isNotNull()).groupBy("country", "club").agg(F.count("*").alias("n")).groupBy("country").agg(
        F.sum(F.col("n") * F.col("n")).alias("sq"))
    base = squads.join(local_clubs.select("club").distinct().withColumn("_local", F.lit(1)), "club", "left").groupBy("country").agg(
        F.count("*").alias("found"), F.avg("overall_quality").alias("q"), F.count("_local").alias("local"))
    df = reduce(lambda a, b: a.join(b, "country", "left"), [base, stars, clubs, squad_sizes, countries]).join(
        success.select("cluster", "archetype_name", "winner_pct", "qf_plus_pct"), "cluster", "left")
    found, size = F.col("found"), F.col("squad_size")
    thin = F.when(found == 1, 8.0).when(found < 4, 3.0).otherwise(0.0)
    tenure = F.lit(current_year) - F.coalesce("manager_since", F.lit(2025))
    stability = F.least(F.lit(1.05), 0.90 + tenure * 0.02)
    star = F.when(F.col("top3") > 58, (F.col("top3") - 58.0) * 0.25).otherwise(0.0)
    recovery = F.col("local") / size * 5.0
    host = F.when(F.col("country").isin(hosts), 2.0).otherwise(0.0)
    travel = lookup(F.coalesce("confederation", F.lit("UEFA")), TRAVEL, 2.0)
    trust = found / 5.0
    quality = F.when(found < 5, trust * F.col("q") + (1.0 - trust) * prior).otherwise(F.col("q"))
    cohesion = F.when(found >= 3, F.coalesce(F.col("sq"), F.lit(0)) / (found * found) * 10.0).otherwise(0.0)
    bonus = F.coalesce(F.round(F.col("winner_pct") / 100.0 * 3.0 + F.col("qf_plus_pct") / 100.0 * 2.0, 2), F.lit(0.0))
    return df.select(
        F.col("country").alias("National_Team"),
        F.round(quality * stability + host + cohesion + star + recovery + bonus - travel - thin, 2).alias("Readiness_Score"),
        F.coalesce("archetype_name", F.lit("Unknown")).alias("Archetype"), bonus.alias("Archetype_Bonus"),
        F.round(quality, 2).alias("Squad_Quality"), F.round(star, 2).alias("Star_Power"), F.round(stability, 2).alias("Stability"),
        tenure.alias("Manager_Tenure"), F.round(cohesion, 2).alias("Cohesion"), F.round(recovery, 2).alias("Recovery"),
        travel.alias("Travel_Penalty"), F.coalesce("confederation", F.lit("UEFA")).alias("Confederation"),
        F.when(host > 0, "Yes").otherwise("No").alias("Host_Adv"), found.alias("Players_Found"), size.alias("Squad_Size"),
        F.round(found / size * 100.0, 1).alias("Coverage_Pct"),
    )


def upset_index(df: DataFrame) -> DataFrame:
    return df.withColumn("Upset_Index", ratio(F.col("Star_Power") + F.col("Cohesion"), F.col("Readiness_Score"), 2, 100.0))


# ---- comparison of entities (R11-R15, R20, R21) --------------------------------------


def net_advantage(df: DataFrame, pairs: DataFrame, weights: dict[str, float] = ADVANTAGE_WEIGHTS, key: str = "National_Team") -> DataFrame:
    """Weighted difference of min-max dimensions for the wanted pairs (row_team, col_team).

    The difference is linear, so each entity gets one number and a pair is two
    equi-joins. Hand in the pairs of interest, such as the fixtures of a round.
    """
    scaled = min_max(df, {c: f"_n_{c}" for c in weights})
    strength = scaled.select(key, reduce(lambda a, b: a + b, [F.col(f"_n_{c}") * w for c, w in weights.items()]).alias("s"))
    a = strength.select(F.col(key).alias("row_team"), F.col("s").alias("_a"))
    b = strength.select(F.col(key).alias("col_team"), F.col("s").alias("_b"))
    return pairs.join(a, "row_team").join(b, "col_team").select(
        "row_team", "col_team", F.when(F.col("row_team") != F.col("col_team"), F.round(F.col("_a") - F.col("_b"), 2)).alias("net_advantage"))


def quadrant(df: DataFrame, x: str, y: str, labels: tuple[str, str, str, str], name: str = "Tag") -> DataFrame:
    """Label by the exact medians of x and y: (high x, high y), (low x, high y), (high x, low y), low both."""
    cut = quantile_scalars(df, {"x": (x, 0.5), "y": (y, 0.5)})
    hi_x, hi_y = F.col(x) >= cut["x"], F.col(y) >= cut["y"]
    return df.withColumn(name, ladder(labels[3], (hi_x & hi_y, labels[0]), (~hi_x & hi_y, labels[1]), (hi_x & ~hi_y, labels[2])))


def signal_disagreement(df: DataFrame, key: str, signals: dict[str, str], top: int = 15) -> DataFrame:
    """Descending average ranks per signal, their sample deviation and the best against the worst signal."""
    names = list(signals)
    down = F.col("total") - average_rank() + 1
    ranks = rank_columns(df, [key], [], {c: f"_r{i}" for i, c in enumerate(signals.values())}, down)
    cols = [F.col(f"_r{i}") for i in range(len(names))]
    mean = row_mean(cols)
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    ss = reduce(lambda a, b: a + b, [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols])
    tagged = F.array(*[F.struct(c.alias("r"), F.lit(i).alias("i"), F.lit(nm).alias("n")) for i, (nm, c) in enumerate(zip(names, cols))])
    present = F.filter(tagged, lambda s: s["r"].isNotNull())
    best = F.array_min(present)["n"]
    worst = F.array_max(F.transform(present, lambda s: F.struct(s["r"], (-s["i"]).alias("i"), s["n"])))["n"]
    return ranks.select(
        key, *[c.alias(f"{nm.lower().replace(' ', '_')}_rank") for nm, c in zip(names, cols)],
        F.sqrt(ss / F.nullif((n - 1).cast("double"), F.lit(0.0))).alias("rank_std"),
        F.when(n == 0, "—").otherwise(F.concat(best, F.lit(" ↑  vs  "), worst, F.lit(" ↓"))).alias("gap_label"),
    ).orderBy(F.desc_nulls_last("rank_std"), key).limit(top)


def score_waterfall(df: DataFrame, key: str = "team") -> DataFrame:
    """Stages from the base score to the readiness score, with the running base of each bar."""
    base, blend, final, ready = (F.col(c) for c in ("archetype_score", "blend_score", "final_score", "readiness_score"))
    adj = F.col("quality_adjustment")
    discount = final - F.coalesce(adj, F.lit(0.0)) - blend
    steps = [
        ("Base Archetype", base, True), ("GMM Blend", blend - base, False),
        ("Evidence Discount", F.when(F.abs(discount) > 0.01, discount), False), ("Quality Adj", adj, False),
        ("Tactical Score", final, True), ("Player + Context Lift", ready - F.coalesce(final, F.lit(0.0)), False),
        ("Readiness Score", ready, True),
    ]
    rows = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), v.cast("double").alias("value"), F.lit(t).alias("is_total"))
        for i, (s, v, t) in enumerate(steps)])).alias("s")).select(key, "s.*").filter(F.col("value").isNotNull())
    # at most seven rows per entity; a total restarts the running sum
    before = W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    part = W.partitionBy(key, "block").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("block", F.coalesce(F.sum(F.col("is_total").cast("int")).over(before.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return rows.select(key, "step", "stage", "value", "is_total", F.when(F.col("is_total"), 0.0).otherwise(
        F.coalesce(F.sum("value").over(part), F.lit(0.0))).alias("base"))


def master_table(outcomes: DataFrame, tactical: DataFrame, quality: DataFrame) -> DataFrame:
    """Outcome shares with tactical and player results beside them; a missing style is labelled."""
    clash = [c for c in tactical.columns if c in outcomes.columns and c != "team"]
    for c in clash:
        tactical = tactical.withColumnRenamed(c, f"{c}_tac")
    df = outcomes.join(tactical, "team", "left").join(quality.withColumnRenamed("country", "team"), "team", "left")
    return df.withColumn("has_tactical", F.col("archetype").isNotNull()).fillna("No Tactical Data", ["archetype"])


def peers(df: DataFrame, key: str = "team", group: str = "archetype", score: str = "readiness_score", k: int = 3) -> DataFrame:
    """The k best other members of each entity's group.

    Only the k+1 best of a group can be anyone's peers, so the join has k+1 rows per group on one side.
    """
    order = W.partitionBy(group).orderBy(F.desc_nulls_last(score), key)
    best = df.select(group, F.col(key).alias("peer"), F.col(score).alias("peer_score"), F.row_number().over(order).alias("r")).filter(F.col("r") <= k + 1)
    pairs = join_statistics(df.select(key, group), best, [group], "inner").filter(F.col(key) != F.col("peer"))
    return pairs.withColumn("peer_rank", F.row_number().over(W.partitionBy(key).orderBy("r"))).filter(F.col("peer_rank") <= k).select(
        key, group, "peer", "peer_score", "peer_rank")


def headline_stats(df: DataFrame, cutoff: float = 53.0) -> DataFrame:
    """Favourite, mean readiness, best squad and best entity under the cut-off, as one row.

    Equal values go to the first name.
    """
    under = F.when(F.col("readiness_score") < cutoff, F.col("p_champion"))
    order = lambda value: F.when(value.isNotNull(), F.struct(-value, F.col("team")))
    first = lambda value: F.min_by(F.struct(F.col("team"), value.alias("v")), order(value))
    row = df.agg(
        first(F.col("p_champion")).alias("f"), F.avg("readiness_score").alias("m"),
        first(F.col("player_quality_score")).alias("s"), first(under).alias("u"))
    return row.select(
        F.col("f.team").alias("favourite"), F.round("f.v", 1).alias("favourite_p"), F.round("m", 1).alias("avg_readiness"),
        F.col("s.team").alias("best_squad"), F.round("s.v", 1).alias("best_squad_score"),
        F.col("u.team").alias("underdog"), F.round("u.v", 1).alias("underdog_p"))


def confidence_band(value: Column) -> Column:
    return ladder("LOW CONFIDENCE", (value >= 0.8, "HIGH CONFIDENCE"), (value >= 0.4, "PARTIAL CONFIDENCE"))


# ---- tournament tables (R16-R19) -----------------------------------------------------


def group_standings(results: DataFrame) -> DataFrame:
    """Points, goal difference and goals per team; 3 for a win, 1 for a draw. Ties end by name."""
    side = lambda team, own, other: F.struct(F.col(team).alias("team"), F.col(own).alias("gf"), F.col(other).alias("ga"))
    long = results.select("group", F.explode(F.array(
        side("team_a", "goals_a", "goals_b"), side("team_b", "goals_b", "goals_a"))).alias("s")).select("group", "s.*")
    table = long.groupBy("group", "team").agg(
        F.sum(F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)).alias("points"),
        F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf"))
    order = W.partitionBy("group").orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return table.withColumn("position", F.row_number().over(order))


def best_third_place(standings: DataFrame, n: int = 8) -> DataFrame:
    return standings.filter(F.col("position") == 3).orderBy(
        F.desc("points"), F.desc("gd"), F.desc("gf"), "team").limit(n).select("team", "group", "points", "gd", "gf")


def win_probability(a: Column, b: Column, scale: float = 15.0) -> Column:
    return 1.0 / (1.0 + F.exp(-(a - b) / scale))


def fixture_probabilities(fixtures: DataFrame, scores: DataFrame) -> DataFrame:
    a = scores.select(F.col("team").alias("team_a"), F.col("score").alias("score_a"))
    b = scores.select(F.col("team").alias("team_b"), F.col("score").alias("score_b"))
    return fixtures.join(a, "team_a").join(b, "team_b").withColumn("p_a", win_probability(F.col("score_a"), F.col("score_b")))


def outcome_shares(outcomes: DataFrame) -> DataFrame:
    """Share of each final stage per team over a table of outcomes (team, stage), in percent."""
    return outcomes.groupBy("team").agg(*[
        pct(sum_flag(F.col("stage") == stage), F.count("*"), 1).alias(name) for stage, name in STAGES.items()])
