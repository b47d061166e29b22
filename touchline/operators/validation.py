"""Checks of a grouping against outcomes, raters and time, and derived team and player tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import ladder, pct, ratio, round_half, row_mean, scalar_stats, sum_flag
from touchline.functions.lineage import cut_lineage, join_statistics
from touchline.functions.ranks import average_rank, exact_quantiles, rank_columns, unpivot, value_positions
from touchline.functions.scale import min_max
from touchline.functions.tests_of_difference import f_tail
from touchline.operators.season import player_means
from touchline.operators.rollup import ARCHETYPE_SCORES

# Outcome scales, archetype scores and evidence weights.
OUTCOME_RANK = {"Winner": 7, "Runner-up": 6, "Third": 5, "Fourth": 4, "Quarter-final": 3, "Round of 16": 2, "Group Stage": 1}
STAGE_NAMES = {0: "Group Stage", 1: "Round of 16", 2: "Quarter-final", 3: "Semi-final", 4: "Final", 5: "Winner"}
STYLE_SCORE = {
    "High Press / High Output": 95, "Possession Dominant": 82, "Compact Transition": 70, "Mid-Block Reactive": 63,
    "Moderate Possession": 48, "Low Intensity": 35,
}
UNKNOWN_STYLE, PREDICTED_FROM, QUARTER_FINAL = 50, 65, 3
CAPPED_STYLE, STYLE_CAP = "High Press / High Output", 80
ABSENT_WEIGHT = 0.75


def _map(key: Column, values: dict, default=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


# ---- statistics of a grouping --------------------------------------------------------


def anova(rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """One-way F per metric over the groups with more than one value.

    Moments per (metric, group) are enough, so the rows are read once for all metrics.
    """
    cells = unpivot(rows, [group], metrics).filter(F.col(group).isNotNull()).groupBy("metric", group).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).filter(F.col("n") > 1)
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    sums = cells.groupBy("metric").agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(n * v).alias("within"), F.sum(n * m).alias("s"),
        F.collect_list(F.struct("n", "m")).alias("groups")).filter(F.col("k") > 1)  # one entry per group
    grand = F.col("s") / F.col("total")  # squares about the grand mean: no difference of large sums
    between = F.aggregate("groups", F.lit(0.0), lambda t, g: t + g["n"] * (g["m"] - grand) * (g["m"] - grand))
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    stat = (between / d1) / F.nullif(F.col("within") / F.nullif(d2.cast("double"), F.lit(0.0)), F.lit(0.0))
    out = sums.select("metric", stat.alias("f"), d1.alias("d1"), d2.alias("d2")).withColumn("p", f_tail(F.col("f"), F.col("d1"), F.col("d2")))
    return out.select("metric", F.round("f", 3).alias("F_statistic"), F.round("p", 4).alias("p_value"), (F.col("p") <= 0.05).alias("significant"))


def temporal_stability(labels: DataFrame, key: str = "team", period: str = "period", label: str = "cluster") -> DataFrame:
    """Share of the modal label per entity, over the entities present in every period."""
    periods = scalar_stats(labels, n=F.count_distinct(period))["n"]
    counts = labels.groupBy(key, label).agg(F.count("*").alias("n"), F.collect_set(period).alias("p"))
    out = counts.groupBy(key).agg(
        F.sum("n").alias("labels"), F.max("n").alias("modal"), F.size(F.array_distinct(F.flatten(F.collect_list("p")))).alias("seen"))
    return out.filter(F.col("seen") == periods).select(key, ratio(F.col("modal"), F.col("labels")).alias("stability_rate"))


def binary_auc(rows: DataFrame, score: str, truth: str) -> Column:
    """Area under the curve by the rank sum of the positives, ties at half."""
    positions = value_positions(rows, [], score)
    positives = rows.filter(F.col(truth) == 1).groupBy(score).agg(F.count("*").alias("pos"))
    joined = positions.join(positives, score, "left")
    p = F.coalesce(F.col("pos"), F.lit(0))
    n_pos, n = F.sum(p).cast("double"), F.sum("n").cast("double")
    area = (F.sum(p * average_rank()) - n_pos * (n_pos + 1) / 2.0) / F.nullif(n_pos * (n - n_pos), F.lit(0.0))
    return joined.agg(area.alias("auc")).scalar()


def baseline_comparison(rows: DataFrame, score: str, truth: str, cutoff: float) -> DataFrame:
    """Accuracy and AUC of the majority class and of a score with a cut-off."""
    y = F.col(truth)
    stats = rows.agg(
        F.avg(y.cast("double")).alias("base"), F.avg(((F.col(score) >= cutoff).cast("int") == y).cast("double")).alias("acc"))
    auc = F.coalesce(binary_auc(rows, score, truth), F.lit(0.5))
    row = lambda name, acc, a: F.struct(F.lit(name).alias("model"), F.round(acc, 3).alias("accuracy"), F.round(a, 3).alias("auc"))
    return stats.select(F.explode(F.array(
        row("Majority class baseline", F.greatest("base", 1.0 - F.col("base")), F.lit(0.5)),
        row("Score", F.col("acc"), auc))).alias("r")).select("r.*")


def expected_vs_actual(rows: DataFrame, group: str, actual: str) -> DataFrame:
    """Group mean as expectation; error and its size per row."""
    means = rows.groupBy(group).agg(F.round(F.avg(actual), 2).alias("expected_rank"))
    out = join_statistics(rows, means, [group], "inner").withColumn("error", F.round(F.col(actual) - F.col("expected_rank"), 2))
    return out.withColumn("abs_error", F.abs("error"))


def mean_absolute_error(rows: DataFrame) -> DataFrame:
    """Of :func:`expected_vs_actual` rows, as one row."""
    return rows.agg(F.round(F.avg("abs_error"), 3).alias("mae"), F.count("abs_error").alias("teams"))


def archetype_predictor(rows: DataFrame, cutoff: float = PREDICTED_FROM) -> DataFrame:
    """How well the score of a style alone tells who reaches the quarter-final, beside the majority class."""
    score = F.coalesce(_map(F.col("archetype"), ARCHETYPE_SCORES).cast("double"), F.lit(float(UNKNOWN_STYLE)))
    scored = rows.filter(F.col("outcome_rank").isNotNull()).select(score.alias("score"), (F.col("outcome_rank") >= QUARTER_FINAL).cast("int").alias("reached"))
    return baseline_comparison(scored, "score", "reached", cutoff)


def biggest_surprises(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` rows furthest from what their group does; equal ones go by key."""
    return rows.orderBy(F.desc("abs_error"), key).limit(n)


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa, its verbal band and the raw agreement, from label counts."""
    cells = rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select("n", (F.col("a") == F.col("b")).alias("same"), F.explode(F.array(
        F.struct(F.lit("a").alias("s"), F.col("a").alias("l")), F.struct(F.lit("b").alias("s"), F.col("b").alias("l")))).alias("k"))
    by_label = sides.groupBy("k.l").agg(
        F.sum(F.when(F.col("k.s") == "a", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("k.s") == "b", F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("same") & (F.col("k.s") == "a"), F.col("n")).otherwise(0)).alias("agree"))
    total = F.sum("na").cast("double")
    sums = by_label.agg(F.sum("agree") / total, (F.sum(F.col("na") * F.col("nb")) / (total * total)), F.sum("na")).toDF("po", "pe", "n")
    kappa = (F.col("po") - F.col("pe")) / F.nullif(1.0 - F.col("pe"), F.lit(0.0))
    band = ladder("Almost perfect", (kappa < 0.2, "Slight"), (kappa < 0.4, "Fair"), (kappa < 0.6, "Moderate"), (kappa < 0.8, "Substantial"))
    return sums.select(F.round(kappa, 4).alias("kappa"), band.alias("interpretation"), F.round("po", 3).alias("agreement_rate"), F.col("n").alias("n_teams"))


# ---- outcomes per group (C18, C21, C22, C24) -----------------------------------------


def merge_outcomes(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    return rows.join(outcomes.select("team", "outcome"), "team", "left").withColumn("outcome_rank", _map(F.col("outcome"), OUTCOME_RANK))


def outcome_summary(rows: DataFrame) -> DataFrame:
    """Mean and best outcome and the number of entities per group."""
    names = {v: k for k, v in OUTCOME_RANK.items()}
    out = rows.filter(F.col("outcome").isNotNull()).groupBy("archetype").agg(
        F.round(F.avg("outcome_rank"), 2).alias("avg_outcome_rank"), F.max("outcome_rank").alias("best_finish_rank"), F.count("*").alias("n_teams"))
    return out.withColumn("best_finish", _map(F.col("best_finish_rank"), names))


def archetype_success(profiles: DataFrame, progression: DataFrame) -> DataFrame:
    """Spread of progression scores and stage-reach percentages per cluster."""
    s = F.coalesce(F.col("progression_score"), F.lit(0))
    rows = profiles.join(progression.select("team", "progression_score"), "team", "left").withColumn("s", s)
    x = F.col("s")
    return rows.groupBy("cluster").agg(
        F.round(F.avg("s"), 3).alias("avg_progression"), F.round(F.stddev_samp("s"), 3).alias("std_progression"), F.count("*").alias("n_teams"),
        F.min("s").alias("min_progression"), F.max("s").alias("max_progression"),
        pct(sum_flag(x >= 1), F.count("*"), 4).alias("r16_plus_pct"), pct(sum_flag(x >= 2), F.count("*"), 4).alias("qf_plus_pct"),
        pct(sum_flag(x >= 3), F.count("*"), 4).alias("sf_plus_pct"), pct(sum_flag(x >= 4), F.count("*"), 4).alias("final_plus_pct"),
        pct(sum_flag(x == 5), F.count("*"), 4).alias("winner_pct"))


def best_progression(results: DataFrame) -> DataFrame:
    """Best result per team and where it was reached, the first tournament by name on a tie."""
    return results.groupBy("team").agg(
        F.max("score").alias("progression_score"), F.min_by("tournament", F.struct(-F.col("score"), F.col("tournament"))).alias("best_tournament"))


def merge_progression(rows: DataFrame, progression: DataFrame) -> DataFrame:
    out = rows.join(progression, "team", "left").fillna(0, ["progression_score"])
    return out.withColumn("best_stage", _map(F.col("progression_score"), STAGE_NAMES))


def composition_by_stage(rows: DataFrame, group: str = "cluster", score: str = "progression_score") -> DataFrame:
    """Share of each group among the rows at or past a stage.

    Each row is counted once at its own score; a running sum over the few scores gives
    the rows at or past each stage.
    """
    stages = F.array(*[F.lit(i) for i in range(5)])
    counts = rows.groupBy(group, F.least(F.col(score), F.lit(4)).cast("int").alias("s")).agg(F.count("*").alias("n"))
    reached = counts.select(group, "n", F.explode(F.filter(stages, lambda t: t <= F.col("s"))).alias("stage")).groupBy(group, "stage").agg(F.sum("n").alias("n"))
    names = F.array(*[F.lit(n) for n in ("Group Stage", "Round of 16", "Quarter-final", "Semi-final", "Final/Winner")])
    return reached.select(group, F.element_at(names, F.col("stage") + 1).alias("stage"), pct(F.col("n"), F.sum("n").over(W.partitionBy("stage")), 4).alias("share_pct"))


def matchups(matches: DataFrame, groups: DataFrame, competitions: list[str] | None = None) -> DataFrame:
    """Wins and draws per ordered pair of groups, counting each match from both sides."""
    if competitions:
        matches = matches.filter(F.lower("competition").rlike("|".join(c.lower() for c in competitions)))
    g = groups.select("team", F.col("archetype_name").alias("g"))
    played = matches.join(g.withColumnsRenamed({"team": "home_team", "g": "home_g"}), "home_team").join(
        g.withColumnsRenamed({"team": "away_team", "g": "away_g"}), "away_team")
    counts = played.groupBy("home_g", "away_g").agg(
        sum_flag(F.col("home_score") > F.col("away_score")).alias("hw"), sum_flag(F.col("home_score") < F.col("away_score")).alias("aw"), F.count("*").alias("n"))
    side = lambda a, b, w, lo: F.struct(F.col(a).alias("archetype_a"), F.col(b).alias("archetype_b"), F.col(w).alias("a_wins"), F.col(lo).alias("b_wins"), F.col("n"))
    both = counts.select(F.explode(F.array(side("home_g", "away_g", "hw", "aw"), side("away_g", "home_g", "aw", "hw"))).alias("s")).select("s.*")
    out = both.groupBy("archetype_a", "archetype_b").agg(F.sum("n").alias("matches"), F.sum("a_wins").alias("a_wins"), F.sum("b_wins").alias("b_wins"))
    out = out.withColumn("draws", F.col("matches") - F.col("a_wins") - F.col("b_wins"))
    return out.withColumns({f"{c}_pct": pct(F.col(s), F.col("matches"), 4) for c, s in (("a_win", "a_wins"), ("b_win", "b_wins"), ("draw", "draws"))})


# ---- final style score (C19, C20) ----------------------------------------------------


def final_scores(rows: DataFrame, names: list[str], presence: DataFrame, key: str = "team", cap: bool = True) -> DataFrame:
    """Blend of the two likeliest styles, weighted by evidence and adjusted by in-style quality.

    ``rows`` needs cluster, proba (aligned to the cluster numbers), n_matches, npxg and epr;
    ``presence`` has (team, outcome_rank) of the entities seen at the reference event. ``key`` is one of a kind in both;
    names that recur need another one.
    """
    style = F.array(*[F.lit(n) for n in names])
    others = F.transform("proba", lambda p, i: F.struct(F.when(i == F.col("cluster"), -1.0).otherwise(p).alias("p"), (-i).alias("j")))
    df = rows.withColumn("archetype", F.element_at(style, F.col("cluster") + 1)).withColumn("_second", F.array_max(others)).withColumns({
        "gmm_confidence": F.element_at("proba", F.col("cluster") + 1), "_c2": F.element_at("proba", -F.col("_second.j") + 1),
        "second_archetype": F.element_at(style, -F.col("_second.j") + 1),
    })
    df = df.join(presence.select(key, F.col("outcome_rank").alias("_rank")), key, "left")
    score = _map(F.col("archetype"), STYLE_SCORE).cast("double")
    if cap:
        score = F.when((F.col("archetype") == CAPPED_STYLE) & F.col("_rank").isNull(), float(STYLE_CAP)).otherwise(score)
    df = df.withColumn("archetype_score", score).withColumn("second_archetype_score", _map(F.col("second_archetype"), STYLE_SCORE).cast("double"))
    c1, c2 = F.col("gmm_confidence"), F.col("_c2")
    total = F.when(c1 + c2 > 0, c1 + c2).otherwise(1.0)
    blend = round_half((c1 * F.col("archetype_score") + c2 * F.col("second_archetype_score")) / total, 1)
    df = df.withColumn("blend_score", F.when(c1 >= 0.10, blend).otherwise(round_half(F.col("archetype_score"), 1)))
    df = df.withColumn("sample_weight", round_half(0.60 + 0.40 * (F.least(F.col("n_matches"), F.lit(9)) / 9.0), 4)).withColumn(
        "wc_presence_weight", F.coalesce(round_half(0.80 + 0.20 * (F.col("_rank") / 7.0), 4), F.lit(ABSENT_WEIGHT)))
    df = df.withColumn("_q", F.col("npxg") * 0.7 + F.lit(1.0) / F.nullif(F.least(F.col("epr"), F.lit(261.47)), F.lit(0.0)) * 30.0)
    df = cut_lineage(df.drop("_second", "_c2"))
    pct_rank = rank_columns(df, [key], ["archetype"], {"_q": "_pr"}, average_rank() / F.col("total"))
    df = df.join(pct_rank, key, "left")
    base = F.least(F.greatest(F.col("blend_score") * F.col("sample_weight") * F.col("wc_presence_weight"), F.lit(0.0)), F.lit(100.0))
    df = df.withColumn("quality_adjustment", round_half((F.col("_pr") - 0.5) * 8.0 * F.col("sample_weight"), 1))
    final = F.least(F.greatest(base + F.col("quality_adjustment"), F.lit(0.0)), F.lit(100.0))
    # the parts have one or two decimals, so halves are common: the nudge settles them upward
    return df.withColumn("final_score", round_half(final + 1e-9, 1)).drop("_q", "_pr", "_rank")


def reconcile_names(rows: DataFrame, renames: dict[str, str], known: DataFrame, key: str = "team") -> DataFrame:
    """Renamed entities with a flag for those in the known list."""
    pairs = known.select(F.col(key)).distinct().withColumn("_k", F.lit(True))
    new = F.coalesce(_map(F.col(key), renames), F.col(key)) if renames else F.col(key)
    return rows.withColumn(key, new).join(pairs, key, "left").withColumn("matched", F.coalesce("_k", F.lit(False))).drop("_k")


# ---- team and player tables (L10, C29-C34) -------------------------------------------


def match_results(matches: DataFrame) -> DataFrame:
    """Outcome W, D or L of both sides of each match."""
    side = lambda team, own, other: F.struct(F.col(team).alias("team"), F.when(F.col(own) > F.col(other), "W").when(
        F.col(own) < F.col(other), "L").otherwise("D").alias("outcome"))
    return matches.select("match_id", F.explode(F.array(
        side("home_team", "home_score", "away_score"), side("away_team", "away_score", "home_score"))).alias("s")).select("match_id", "s.*")


def volatility(metrics: DataFrame, min_matches: int = 3) -> DataFrame:
    out = metrics.groupBy("team").agg(
        F.stddev_samp("ppda").alias("ppda_std"), F.stddev_samp("possession_pct").alias("poss_std"), F.count("match_id").alias("n"))
    return out.filter((F.col("n") >= min_matches) & F.col("ppda_std").isNotNull() & F.col("poss_std").isNotNull())


def outcome_by_quadrant(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """Win, draw and loss rates by the median split of pressing and possession."""
    long = unpivot(metrics, [], ["ppda", "possession_pct"])
    med = exact_quantiles(long, ["metric"], "value", [0.5], few_groups=True).agg(F.struct(
        F.max(F.when(F.col("metric") == "ppda", F.col("value"))).alias("p"),
        F.max(F.when(F.col("metric") == "possession_pct", F.col("value"))).alias("q")).alias("s")).scalar()
    low, high = F.col("ppda") <= med.getField("p"), F.col("possession_pct") >= med.getField("q")
    quadrant = ladder(
        "Low Press / Low Possession", (low & high, "High Press / High Possession"),
        ((F.col("ppda") > med.getField("p")) & high, "Low Press / High Possession"),
        (low & (F.col("possession_pct") < med.getField("q")), "High Press / Low Possession"))
    rows = metrics.select("match_id", "team", quadrant.alias("quadrant")).join(results, ["match_id", "team"], "left")
    rate = lambda o: F.avg(F.coalesce((F.col("outcome") == o).cast("double"), F.lit(0.0)))
    return rows.groupBy("quadrant").agg(rate("W").alias("win_rate"), rate("D").alias("draw_rate"), rate("L").alias("loss_rate"), F.count("*").alias("n"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, long form; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    row = rows.agg(*[F.corr(both(a, b), both(b, a)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [(x, y, i) for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("r")) for x, y, i in cells])).alias("c")).select("c.*")


def player_consistency(rows: DataFrame, value: str, min_mins: float = 400, min_matches: int = 5) -> DataFrame:
    """Mean, deviation and coefficient of variation per player over qualifying (player, team) groups.

    Means and squared deviations of the (player, team) groups are combined about the mean of all of them, so the rows
    are read once and large values lose no digits.
    """
    v = F.col(value)
    groups = rows.groupBy("player", "team").agg(
        F.count("*").alias("rows"), F.sum("minutes_played").alias("mins"), F.count(v).alias("k"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    kept = groups.filter((F.col("rows") >= min_matches) & (F.col("mins") >= min_mins) & (F.col("k") > 0))
    parts = kept.groupBy("player").agg(F.sum("k").alias("n"), F.collect_list(F.struct("k", "m", "v")).alias("parts"))  # one part per team of a player
    mean = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["m"] * p["k"] / F.col("n"))
    centred = parts.withColumn("mean", mean)
    squares = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["k"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    out = centred.select("player", "mean", F.sqrt(squares / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))).alias("std"), "n")
    return out.withColumn("cv", F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).filter(F.col("cv").isNotNull() & F.col("std").isNotNull())


def player_trajectory(rows: DataFrame, metrics: dict[str, str], min_mins: float = 400) -> DataFrame:
    """Seasonal min-max composite per player and a label of its course.

    ``metrics`` maps a value column to its minutes column; the rows carry a season.
    """
    parts = []
    for value, minutes in metrics.items():
        means = rows.groupBy("season", "player", "team").agg(
            (F.sum(F.col(value) * F.col(minutes)) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(minutes))).cast("double"), F.lit(0.0))).alias("v"),
            F.sum(minutes).alias("mins")).filter(F.col("mins") >= min_mins)
        scaled = min_max(means, {"v": f"{value}_norm"}, ["season"], 1.0, 0.5)
        parts.append(scaled.select("season", "player", "team", f"{value}_norm"))
    wide = reduce(lambda a, b: a.join(b, ["season", "player", "team"], "full"), parts)
    comp = wide.withColumn("composite", row_mean([F.col(f"{m}_norm") for m in metrics]))
    order = F.struct("season", "team")
    out = comp.groupBy("player").agg(
        F.count("*").alias("n_seasons"), F.min_by("composite", order).alias("first"), F.max_by("composite", order).alias("last"),
        F.stddev_samp("composite").alias("sd")).filter(F.col("n_seasons") >= 2)
    delta = F.col("last") - F.col("first")
    return out.select("player", "n_seasons", "first", "last", delta.alias("delta"), ladder(
        "Peak / Stable", (delta > 0.1, "Ascending"), (delta < -0.1, "Declining"), (F.col("sd") > 0.15, "Inconsistent")).alias("trajectory"))


def specialist_matrix(chain: DataFrame, progression: DataFrame, defence: DataFrame, pressing: DataFrame, bins: int = 25, **limits) -> DataFrame:
    """Counts of players on a grid of attacking against defensive quality, both 0 to 100."""
    key = ["player", "team"]
    join = lambda a, b, x, y, wx, wy, name: a.join(b.select(*key, y), key, "left").select(
        *key, (F.coalesce(x, F.lit(0.0)) * wx + F.coalesce(y, F.lit(0.0)) * wy).alias(name))
    attack = join(player_means(chain, "xg_chain_per90", **limits), player_means(progression, "total_progressive_actions_p90", "total_mins", **limits),
                  "xg_chain_per90", "total_progressive_actions_p90", 0.6, 0.4, "attacking_quality")
    defend = join(player_means(defence, "total_defensive_actions", **limits), player_means(pressing, "pressures_per_90", **limits),
                  "total_defensive_actions", "pressures_per_90", 0.5, 0.5, "defensive_quality")
    both = min_max(attack.join(defend, key), {"attacking_quality": "a", "defensive_quality": "d"}, constant=0.0)
    cell = lambda c: F.least(F.floor(F.col(c) / (100.0 / bins)), F.lit(bins - 1)).cast("int")
    return both.groupBy(cell("a").alias("attack_bin"), cell("d").alias("defence_bin")).agg(F.count("*").alias("players"))
