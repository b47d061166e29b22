"""Queries for season aggregation, normalisation, scoring and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.event_queries import INVOLVED, MINUTES
from touchline.catalog.registry import query
from touchline.functions import scale
from touchline.operators import rollup, scoring, season, xg
from touchline.functions.columns import rounded
from touchline.operators.season import Metric
from touchline.plans import player_scores

KEYS = ["player_id", "season_year"]

# ---- A: season aggregation ------------------------------------------------------------


def _chain_rows(t):
    return season.with_season_year(xg.xg_chain(t.v_events, t.v_matches, t.v_lineups))


CHAIN = f"""{MINUTES}, {INVOLVED},
 ch AS (SELECT season_name, (CASE WHEN season_name LIKE '%/%' THEN SPLIT_PART(season_name, '/', 2) ELSE season_name END)::INT AS season_year,
   chain.*, COALESCE(minutes_played, 0) AS minutes_played, ROUND(xg_chain * 90e0 / NULLIF(minutes_played, 0), 3) AS xg_chain_per90,
   ROUND(xg_chain * 100e0 / NULLIF(whole, 0), 2) AS team_involvement_pct
  FROM chain LEFT JOIN mins USING (match_id, team, player) LEFT JOIN side_xg USING (match_id, team) LEFT JOIN v_matches USING (match_id)),
 sea AS (SELECT player, team, season_name, season_year, SUM(possessions_with_shot)::BIGINT AS possessions_with_shot, ROUND(SUM(xg_chain), 3) AS xg_chain,
   SUM(shots_in_chain)::BIGINT AS shots_in_chain, SUM(goals_in_chain)::BIGINT AS goals_in_chain,
   SUM(total_touches_in_chains)::BIGINT AS total_touches_in_chains, SUM(minutes_played)::BIGINT AS minutes_played,
   ROUND(SUM(avg_xg_per_possession * minutes_played) / NULLIF(SUM(minutes_played), 0), 4) AS avg_xg_per_possession,
   ROUND(SUM(xg_chain_per90 * minutes_played) / NULLIF(SUM(minutes_played), 0), 4) AS xg_chain_per90,
   ROUND(SUM(team_involvement_pct * minutes_played) / NULLIF(SUM(minutes_played), 0), 4) AS team_involvement_pct
  FROM ch GROUP BY player, team, season_name, season_year)"""

query("a1_match_to_season", lambda t: rounded(season.match_to_season(_chain_rows(t))), f"WITH {CHAIN} SELECT * FROM sea")

query("a2_weighted_mean", lambda t: rounded(t.v_player_season.groupBy("team").agg(
    season.weighted_mean(F.col("m_control"), F.col("minutes_played")).alias("m_control"),
    season.weighted_mean_present(F.col("m_control"), F.col("minutes_played")).alias("m_control_present"))), """
SELECT team, ROUND(SUM(m_control * minutes_played) / SUM(minutes_played), 4) AS m_control,
  ROUND(SUM(m_control * minutes_played) / SUM(CASE WHEN m_control IS NOT NULL THEN minutes_played END), 4) AS m_control_present
FROM v_player_season GROUP BY team""")

query("a3_packing_to_season", lambda t: rounded(season.packing_to_season(t.v_player_season.select(
    "player", "team", "season_name", "season_year", "total_passes", F.col("goals").alias("total_opponents_packed"),
    F.col("matches").alias("progressive_passes"), F.col("m_defence").alias("avg_packing_per_pass"),
    F.col("m_control").alias("avg_packing_progressive")), ["team", "season_name", "season_year"])), """
SELECT team, season_name, season_year, SUM(total_passes)::BIGINT AS total_passes, SUM(goals)::BIGINT AS total_opponents_packed,
  SUM(matches)::BIGINT AS progressive_passes, ROUND(SUM(m_defence * total_passes) / NULLIF(SUM(total_passes), 0), 4) AS avg_packing_per_pass,
  ROUND(SUM(m_control * matches) / NULLIF(SUM(matches), 0), 4) AS avg_packing_progressive
FROM v_player_season GROUP BY team, season_name, season_year""")

query("a4_season_level", lambda t: season.season_level(t.v_player_season.select(
    "player", "season_name", F.col("minutes_played").alias("total_mins"))), """
SELECT player, season_name, minutes_played, season_year FROM v_player_season""")

query("a5_aggregate_all", lambda t: rounded(season.aggregate_all({"xg_chain": _chain_rows(t)}, t.v_matches)["xg_chain"]), f"""
WITH {CHAIN}, lm AS (SELECT team, season_name, competition, COUNT(*) AS n FROM (
   SELECT home_team AS team, season_name, competition FROM v_matches UNION ALL SELECT away_team, season_name, competition FROM v_matches) q GROUP BY ALL),
 lk AS (SELECT team, season_name, competition AS competition_name FROM lm
   QUALIFY ROW_NUMBER() OVER (PARTITION BY team, season_name ORDER BY n DESC, competition) = 1)
SELECT * FROM sea LEFT JOIN lk USING (team, season_name)""")

query("a6_sample_filter", lambda t: season.sample_filter(t.v_player_season.select("player", "season_year", "minutes_played"), hard=400, floor=200), """
SELECT player, season_year, minutes_played, minutes_played < 400 AS shrinkage_flag FROM v_player_season WHERE minutes_played >= 200""")
query("a6_sample_filter_proxy", lambda t: season.sample_filter(t.v_player_season.select("player", "season_year", "total_passes"), "total_passes", 30), """
SELECT player, season_year, total_passes, total_passes < 30 AS shrinkage_flag FROM v_player_season WHERE total_passes >= 20""")

query("a7_apply_decay", lambda t: season.apply_decay(t.v_matches.select("match_id", "season_name"), {"2022": 0.9, "2022/2023": 0.8}), """
SELECT match_id, season_name, CASE season_name WHEN '2022' THEN 0.9e0 WHEN '2022/2023' THEN 0.8e0 ELSE 1e0 END AS decay_weight FROM v_matches""")

query("a8_time_decayed_metric", lambda t: rounded(season.time_decayed_metric(
    t.v_player_season, "m_control", "control", "minutes_played", 800, current_year=2001)), """
SELECT player, ROUND(SUM(m_control * EXP(-0.6e0 * (2001 - season_year))) / SUM(EXP(-0.6e0 * (2001 - season_year))), 4) AS control,
  SUM(minutes_played)::BIGINT AS volume FROM v_player_season GROUP BY player HAVING SUM(minutes_played) >= 800""")

query("a9_shrink_to_mean", lambda t: rounded(season.shrink_to_mean(
    t.v_player_season.select("player", "season_year", "m_control", "matches"), "m_control", "matches")), """
SELECT player, season_year, matches, ROUND((m_control * matches + (SELECT AVG(m_control) FROM v_player_season) * 10) / (matches + 10), 4) AS m_control
FROM v_player_season""")

query("a10_recency_factor", lambda t: season.recency_factor(t.v_player_season), """
SELECT player, MAX(season_year) AS last_year, CASE WHEN MAX(season_year) = (SELECT MAX(season_year) FROM v_player_season) THEN 1e0
  WHEN MAX(season_year) = (SELECT MAX(season_year) FROM v_player_season) - 1 THEN 0.85e0 ELSE 0.7e0 END AS recency_factor
FROM v_player_season GROUP BY player""")

query("a11_player_means", lambda t: rounded(season.player_means(t.v_player_season, "m_control", min_mins=500, min_matches=2)), """
SELECT player, team, ROUND(SUM(m_control * minutes_played) / SUM(CASE WHEN m_control IS NOT NULL THEN minutes_played END), 4) AS m_control,
  SUM(minutes_played)::BIGINT AS total_mins, COUNT(*) AS n_matches FROM v_player_season GROUP BY player, team
HAVING COUNT(*) >= 2 AND SUM(minutes_played) >= 500""")

# ---- N: normalisation -----------------------------------------------------------------

AVG_RANK = "(RANK() OVER (PARTITION BY {p} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {p}, {c}) - 1) / 2e0)"


def _norm_sql(col, part="season_year"):
    return f"CASE WHEN COUNT(*) OVER (PARTITION BY {part}) <= 1 THEN 0.5e0 ELSE ({AVG_RANK.format(p=part, c=col)} - 1) / (COUNT(*) OVER (PARTITION BY {part}) - 1) END"


query("n1_rank_norm", lambda t: rounded(scale.rank_norm(
    t.v_player_season, KEYS, ["season_year"], {"m_progression": "p", "m_defence": "d"})), f"""
SELECT player_id, season_year, ROUND({_norm_sql('m_progression')}, 4) AS p, ROUND({_norm_sql('m_defence')}, 4) AS d FROM v_player_season""")

query("n2_zscore", lambda t: rounded(scale.zscore(
    t.v_player_season.select(*KEYS, "m_progression", "m_control"), ["season_year"], {"m_progression": "z", "m_control": "zc"})), """
SELECT player_id, season_year, ROUND(m_progression, 4) AS m_progression, ROUND(m_control, 4) AS m_control,
  ROUND((m_progression - AVG(m_progression) OVER w) / STDDEV_SAMP(m_progression) OVER w, 4) AS z,
  ROUND((m_control - AVG(m_control) OVER w) / STDDEV_SAMP(m_control) OVER w, 4) AS zc
FROM v_player_season WINDOW w AS (PARTITION BY season_year)""")

query("n3_log_rank", lambda t: rounded(scale.normalise_columns(
    t.v_player_season.select(*KEYS, "m_defence", "goals"), KEYS, ["season_year"],
    {"d": ("m_defence", "log"), "g": ("goals", "log1p")})), f"""
WITH b AS (SELECT player_id, season_year, m_defence, goals, LN(GREATEST(m_defence, 1e-6)) AS l, LN(goals + 1) AS l1 FROM v_player_season)
SELECT player_id, season_year, m_defence, goals, ROUND({_norm_sql('l')}, 4) AS d, ROUND({_norm_sql('l1')}, 4) AS g FROM b""")

query("n4_normalise_columns", lambda t: rounded(scale.normalise_columns(
    t.v_player_season.select(*KEYS, "m_control", "m_progression"), KEYS, ["season_year"],
    {"control_norm": ("m_control", "rank"), "prog_norm": ("m_progression", "log1p"), "control_z": ("m_control", "zscore")})
    .drop("m_control", "m_progression")), f"""
WITH b AS (SELECT *, COALESCE(m_control, AVG(m_control) OVER (PARTITION BY season_year)) AS f FROM v_player_season),
 r AS (SELECT *, {_norm_sql('f')} AS cn, {_norm_sql('m_progression')} AS pn,
  (f - AVG(f) OVER (PARTITION BY season_year)) / STDDEV_SAMP(f) OVER (PARTITION BY season_year) AS z FROM b)
SELECT player_id, season_year, ROUND(CASE WHEN m_control IS NOT NULL THEN cn END, 4) AS control_norm, ROUND(pn, 4) AS prog_norm,
  ROUND(CASE WHEN m_control IS NOT NULL THEN z END, 4) AS control_z FROM r""")

query("n5_percentile_99", lambda t: rounded(scale.percentile_99(
    t.v_player_season.select(*KEYS, "m_control"), KEYS, ["m_control"]).drop("m_control")), """
SELECT player_id, season_year, CASE WHEN m_control IS NOT NULL THEN ROUND((RANK() OVER (ORDER BY m_control NULLS LAST)
  + (COUNT(*) OVER (PARTITION BY m_control) - 1) / 2e0) / COUNT(m_control) OVER () * 99, 4) END AS m_control_percentile FROM v_player_season""")

query("n6_min_max", lambda t: rounded(scale.min_max(
    t.v_player_season.select(*KEYS, "m_control", "m_defence"), {"m_control": "c", "m_defence": "d"}).drop("m_control", "m_defence")), """
SELECT player_id, season_year, ROUND((m_control - MIN(m_control) OVER ()) / (MAX(m_control) OVER () - MIN(m_control) OVER ()) * 100, 4) AS c,
  ROUND((m_defence - MIN(m_defence) OVER ()) / (MAX(m_defence) OVER () - MIN(m_defence) OVER ()) * 100, 4) AS d FROM v_player_season""")

query("n7_z_radar", lambda t: rounded(scale.z_radar(
    t.v_player_season, "competition_name", ["m_control", "m_defence"], inverted=("m_defence",))), """
WITH l AS (SELECT competition_name, 'm_control' AS metric, m_control AS v, 1 AS sg FROM v_player_season
  UNION ALL SELECT competition_name, 'm_defence', m_defence, -1 FROM v_player_season),
 g AS (SELECT metric, AVG(v) AS gm, STDDEV_SAMP(v) AS gs FROM l GROUP BY metric)
SELECT competition_name, metric, ROUND(GREATEST(0.1e0, LEAST(0.9e0, 0.5e0 + ANY_VALUE(sg) * 0.2e0 * (AVG(v) - ANY_VALUE(gm)) / ANY_VALUE(gs))), 4) AS value
FROM l JOIN g USING (metric) GROUP BY competition_name, metric""")

query("n8_cap_outliers", lambda t: rounded(scale.cap_outliers(
    t.v_player_season.select(*KEYS, "m_control", "xg"), {"m_control": 0.95, "xg": 0.99}, {"xg": 0.01})), """
WITH q AS (SELECT QUANTILE_CONT(m_control, 0.95) AS c, QUANTILE_CONT(xg, 0.99) AS h, QUANTILE_CONT(xg, 0.01) AS l FROM v_player_season)
SELECT player_id, season_year, CASE WHEN m_control IS NOT NULL THEN ROUND(LEAST(m_control, c), 4) END AS m_control,
  ROUND(GREATEST(LEAST(xg, h), l), 4) AS xg FROM v_player_season, q""")

# ---- S: scoring -----------------------------------------------------------------------

GROUP_CASE = """CASE position_name WHEN 'Goalkeeper' THEN 'GK' WHEN 'Left Back' THEN 'FB' WHEN 'Right Back' THEN 'FB' WHEN 'Center Back' THEN 'CB'
  WHEN 'Left Center Back' THEN 'CB' WHEN 'Center Defensive Midfield' THEN 'DM' WHEN 'Left Midfield' THEN 'CM' WHEN 'Center Midfield' THEN 'CM'
  WHEN 'Center Attacking Midfield' THEN 'AM' WHEN 'Left Wing' THEN 'W' WHEN 'Right Wing' THEN 'W' WHEN 'Center Forward' THEN 'FW' WHEN 'Secondary Striker' THEN 'FW' END"""

query("s1_position_lookup", lambda t: scoring.position_lookup(t.v_lineups, t.v_matches), f"""
WITH c AS (SELECT player_name AS player, season_name, {GROUP_CASE} AS archetype, COUNT(*) AS n FROM v_lineups LEFT JOIN v_matches USING (match_id)
  WHERE player_name IS NOT NULL GROUP BY ALL HAVING {GROUP_CASE} IS NOT NULL)
SELECT player, season_name, archetype FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY player, season_name ORDER BY n DESC, archetype) = 1""".replace(
    "GROUP BY ALL HAVING " + GROUP_CASE + " IS NOT NULL", f"AND {GROUP_CASE} IS NOT NULL GROUP BY ALL"))

query("s2_position_map", lambda t: scoring.position_map(t.v_events), f"""
WITH c AS (SELECT player, {GROUP_CASE.replace('position_name', 'position')} AS archetype, COUNT(*) AS n FROM v_events WHERE player IS NOT NULL
  AND position IS NOT NULL GROUP BY ALL)
SELECT player, archetype FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY player ORDER BY n DESC, archetype) = 1""")

PS_POS = "(SELECT DISTINCT player, season_name, archetype FROM v_player_season WHERE archetype IS NOT NULL)"


def _flagged(t):
    return season.sample_filter(t.v_player_season.select(
        "player", "player_id", "team", "season_name", "season_year", "minutes_played", "competition_name",
        (F.col("m_progression") / 97.0).alias("p_norm"), (F.col("m_control") / 97.0).alias("c_norm")), hard=400, floor=180)


def _positions(t):
    return t.v_player_season.filter(F.col("archetype").isNotNull()).select("player", "season_name", "archetype").distinct()


SHRUNK = f"""fl AS (SELECT s.player, player_id, team, season_name, season_year, minutes_played, competition_name, m_progression / 97e0 AS p_norm, m_control / 97e0 AS c_norm,
   minutes_played < 400 AS shrinkage_flag, COALESCE(q.archetype, 'CM') AS position_archetype
  FROM v_player_season s LEFT JOIN {PS_POS} q USING (player, season_name) WHERE minutes_played >= 180),
 mu AS (SELECT season_name, position_archetype, AVG(p_norm) AS mp, AVG(c_norm) AS mc FROM fl WHERE NOT shrinkage_flag GROUP BY ALL),
 sh AS (SELECT * EXCLUDE (p_norm, c_norm, mp, mc, lam),
   CASE WHEN shrinkage_flag THEN (1 - lam) * p_norm + lam * COALESCE(mp, 0.5e0) ELSE p_norm END AS p_norm,
   CASE WHEN shrinkage_flag THEN (1 - lam) * c_norm + lam * COALESCE(mc, 0.5e0) ELSE c_norm END AS c_norm
  FROM (SELECT *, CASE WHEN minutes_played >= 400 THEN 0 WHEN minutes_played <= 180 THEN 1 ELSE 1 - (minutes_played - 180) / 220e0 END AS lam
   FROM fl LEFT JOIN mu USING (season_name, position_archetype)) z)"""

query("s3_apply_shrinkage", lambda t: rounded(scoring.apply_shrinkage(
    _flagged(t), ["p_norm", "c_norm"], _positions(t), threshold=400, floor=180), 6), f"""
WITH {SHRUNK} SELECT * REPLACE (ROUND(p_norm, 6) AS p_norm, ROUND(c_norm, 6) AS c_norm) FROM sh""")

query("s4_apply_segmentation", lambda t: scoring.apply_segmentation(
    t.v_player_season.select("player", "season_year", F.col("archetype").alias("position_archetype"))), """
SELECT player, season_year, archetype AS position_archetype, CASE archetype WHEN 'CB' THEN 'Centre-Back' WHEN 'FB' THEN 'Fullback / Wing-Back'
  WHEN 'DM' THEN 'Defensive Midfielder' WHEN 'CM' THEN 'Central Midfielder' WHEN 'AM' THEN 'Attacking Midfielder' WHEN 'W' THEN 'Winger'
  ELSE 'Forward / Striker' END AS archetype_label FROM v_player_season WHERE archetype <> 'GK'""")


def _two_tables(t):
    rows = t.v_player_season.withColumn("decay_weight", F.when(F.col("season_year") % 2 == 0, 1.0).otherwise(0.8)).withColumn(
        "position_archetype", F.coalesce("archetype", F.lit("CM")))
    meta = ["player", "team", "season_name", "position_archetype", "decay_weight", "competition_name"]
    a = rows.filter(F.col("season_year") < 2000).select(*meta, (F.col("m_progression") / 100.0).alias("p_norm"))
    b = rows.filter(F.col("season_year") > 1996).select(*meta, (F.col("m_control") / 100.0).alias("c_norm"))
    return {"a": a, "b": b}


UNIFIED = """un AS (SELECT player, season_name, team, COALESCE(archetype, 'CM') AS position_archetype,
   CASE WHEN season_year % 2 = 0 THEN 1e0 ELSE 0.8e0 END AS decay_weight, competition_name,
   CASE WHEN season_year < 2000 THEN m_progression / 100e0 END AS p_norm, CASE WHEN season_year > 1996 THEN m_control / 100e0 END AS c_norm
  FROM v_player_season)"""

query("s5_unified_table", lambda t: rounded(scoring.unified_table(_two_tables(t))),
      f"WITH {UNIFIED} SELECT * REPLACE (ROUND(p_norm, 4) AS p_norm, ROUND(c_norm, 4) AS c_norm) FROM un")

query("s6_decay_collapse", lambda t: rounded(scoring.decay_collapse(scoring.unified_table(_two_tables(t))).withColumn(
    "seasons_present", F.array_join("seasons_present", ",")), 6), f"""
WITH {UNIFIED} SELECT player, MODE(team) AS team, MODE(position_archetype) AS position_archetype, MODE(competition_name) AS competition_name,
  STRING_AGG(season_name, ',' ORDER BY season_name) AS seasons_present, MAX(decay_weight) AS decay_weight_max,
  ROUND(SUM(p_norm * decay_weight) / SUM(CASE WHEN p_norm IS NOT NULL THEN decay_weight END), 6) AS p_norm,
  ROUND(SUM(c_norm * decay_weight) / SUM(CASE WHEN c_norm IS NOT NULL THEN decay_weight END), 6) AS c_norm FROM un GROUP BY player""")

query("s7_group_percentiles", lambda t: rounded(scoring.group_percentiles(
    t.v_player_season.filter(F.col("archetype").isNotNull()).select(*KEYS, "archetype", "m_control"), KEYS, "archetype",
    {"m_control": "pct"}).drop("m_control")), """
WITH b AS (SELECT *, DENSE_RANK() OVER (PARTITION BY archetype ORDER BY m_control NULLS LAST) AS d, COUNT(m_control) OVER (PARTITION BY archetype) AS n
  FROM v_player_season WHERE archetype IS NOT NULL)
SELECT player_id, season_year, archetype, CASE WHEN m_control IS NULL THEN NULL WHEN n <= 1 THEN 50e0 ELSE
  ROUND(d * 100e0 / MAX(CASE WHEN m_control IS NOT NULL THEN d END) OVER (PARTITION BY archetype), 4) END AS pct FROM b""")

query("s8_category_score", lambda t: rounded(t.v_player_season.withColumnsRenamed({"m_progression": "a_pct", "m_control": "b_pct"}).withColumn(
    "packing_pct", F.col("m_defence")).withColumn("packing_norm", F.when(F.col("goals") > 0, F.col("m_defence"))).select(
    *KEYS, scoring.category_score(["a_pct", "b_pct", "packing_pct"]).alias("score"))), """
SELECT player_id, season_year, ROUND((m_progression + COALESCE(m_control, 0) + CASE WHEN goals > 0 AND m_defence <> 0 THEN m_defence ELSE 0 END)
  / (1 + (m_control IS NOT NULL)::INT + (goals > 0 AND m_defence <> 0)::INT), 4) AS score FROM v_player_season""")

WEIGHT_ROWS = """w(archetype, wm, wp, wc, wf) AS (VALUES ('FW', 0.05e0, 0.2e0, 0.05e0, 0.7e0), ('W', 0.15e0, 0.4e0, 0.1e0, 0.35e0),
  ('AM', 0.1e0, 0.35e0, 0.2e0, 0.35e0), ('CM', 0.15e0, 0.35e0, 0.4e0, 0.1e0), ('DM', 0.1e0, 0.35e0, 0.5e0, 0.05e0),
  ('CB', 0.4e0, 0.35e0, 0.25e0, 0e0), ('FB', 0.25e0, 0.5e0, 0.2e0, 0.05e0))"""

query("s9_composite", lambda t: rounded(t.v_player_season.select(*KEYS, scoring.composite(F.col("archetype"), {
    "Mobility_Intensity": F.col("m_defence"), "Progression": F.col("m_progression"), "Control": F.col("m_control"),
    "Final_Third_Output": F.col("xg")}).alias("composite")), 6), f"""
WITH {WEIGHT_ROWS} SELECT player_id, season_year, ROUND(CASE WHEN wm IS NULL
  THEN (m_defence + m_progression + COALESCE(m_control, 0) + xg) / (3 + (m_control IS NOT NULL)::INT)
  ELSE (m_defence * wm + m_progression * wp + COALESCE(m_control * wc, 0) + xg * wf) / (wm + wp + wf + CASE WHEN m_control IS NOT NULL THEN wc ELSE 0 END) END, 6) AS composite
FROM v_player_season LEFT JOIN w USING (archetype)""")


def _tiers(t):
    return t.v_rosters.select("club").distinct().withColumn("tier", F.concat(F.lit("Tier_"), F.substring("club", -1, 1))).filter("tier < 'Tier_6'")


def _meta(t):
    return t.v_player_season.select("player", "team", "competition_name")


query("s10_club_and_age", lambda t: scoring.with_club_and_age(_meta(t), t.v_rosters.filter("age > 20"), _tiers(t)), """
WITH r AS (SELECT player, club, age, CASE RIGHT(club, 1) WHEN '1' THEN 1e0 WHEN '2' THEN 0.95e0 WHEN '3' THEN 0.88e0 WHEN '4' THEN 0.75e0
   WHEN '5' THEN 0.6e0 ELSE 0.8e0 END AS m FROM v_rosters WHERE age > 20)
SELECT player, COALESCE(club, team) AS team, competition_name, CASE WHEN club IS NOT NULL THEN m ELSE CASE competition_name WHEN 'La Liga' THEN 1e0
   WHEN 'Premier League' THEN 1e0 WHEN 'FIFA World Cup' THEN 0.75e0 ELSE 0.65e0 END END AS club_weight, COALESCE(age, 27) AS age,
  CASE WHEN COALESCE(age, 27) <= 29 THEN 1e0 WHEN age <= 31 THEN 0.97e0 WHEN age <= 33 THEN 0.93e0 WHEN age <= 35 THEN 0.88e0 ELSE 0.82e0 END AS age_multiplier
FROM v_player_season LEFT JOIN r USING (player)""")

query("s11_coverage", lambda t: t.v_player_season.groupBy("player").agg(
    F.array_sort(F.collect_set("season_name")).alias("s"), F.mode("competition_name", True).alias("competition_name")).select(
    "player", scoring.coverage_tier(F.col("s"), F.col("competition_name")).alias("coverage_tier")).withColumn(
    "confidence", scoring.coverage_confidence(F.col("coverage_tier"))), """
WITH p AS (SELECT player, COUNT(DISTINCT season_name) AS n, MODE(competition_name) AS c FROM v_player_season GROUP BY player),
 r AS (SELECT player, CASE WHEN c IN ('La Liga','Premier League') THEN CASE WHEN n >= 2 THEN 'A' ELSE 'B' END WHEN c = 'FIFA World Cup' THEN 'C' ELSE 'D' END AS coverage_tier FROM p)
SELECT *, CASE coverage_tier WHEN 'A' THEN 1e0 WHEN 'B' THEN 0.97e0 WHEN 'C' THEN 0.9e0 ELSE 0.8e0 END AS confidence FROM r""")

THREE = [Metric("p", "a", "m_progression", "Progression"), Metric("c", "b", "m_control", "Control"), Metric("d", "c", "m_defence", "Mobility_Intensity")]


def _scored(t):
    meta = ["player", "team", "season_name", F.coalesce("archetype", F.lit("CM")).alias("position_archetype"),
            F.lit("x").alias("archetype_label"), F.lit(1.0).alias("decay_weight"), "competition_name"]
    rows = t.v_player_season
    # whole numbers, so that means and ties are the same in both engines
    tables = {k: rows.select(*meta, c.alias(f"{k}_norm")) for k, c in
              (("p", F.round(F.col("m_progression") * 10)), ("c", F.col("m_control") * 4), ("d", F.col("m_defence")))}
    return scoring.build_scores(tables, t.v_rosters, _tiers(t), metrics=THREE)


query("s12_build_scores", lambda t: rounded(_scored(t).select("player", "coverage_tier", "club_weight", "age_multiplier", "confidence").drop_duplicates()), """
WITH r AS (SELECT player, age, CASE RIGHT(club, 1) WHEN '1' THEN 1e0 WHEN '2' THEN 0.95e0 WHEN '3' THEN 0.88e0 WHEN '4' THEN 0.75e0
   WHEN '5' THEN 0.6e0 WHEN '0' THEN 0.8e0 ELSE 0.8e0 END AS club_weight FROM v_rosters),
 p AS (SELECT player, COUNT(DISTINCT season_name) AS n, MODE(competition_name) AS c, COUNT(m_control) AS k FROM v_player_season GROUP BY player),
 q AS (SELECT player, CASE WHEN c IN ('La Liga','Premier League') THEN CASE WHEN n >= 2 THEN 'A' ELSE 'B' END WHEN c = 'FIFA World Cup' THEN 'C' ELSE 'D' END AS coverage_tier FROM p WHERE k > 0)
SELECT player, coverage_tier, club_weight, CASE WHEN age <= 29 THEN 1e0 WHEN age <= 31 THEN 0.97e0 WHEN age <= 33 THEN 0.93e0 WHEN age <= 35 THEN 0.88e0 ELSE 0.82e0 END AS age_multiplier,
  CASE coverage_tier WHEN 'A' THEN 1e0 WHEN 'B' THEN 0.97e0 WHEN 'C' THEN 0.9e0 ELSE 0.8e0 END AS confidence FROM q JOIN r USING (player)""")

query("s12_ranked_scores", lambda t: rounded(_scored(t).select("player", "rank", "composite_score", "Progression_score", "Control_score")), f"""
WITH {WEIGHT_ROWS}, r AS (SELECT player, age, CASE RIGHT(club, 1) WHEN '1' THEN 1e0 WHEN '2' THEN 0.95e0 WHEN '3' THEN 0.88e0 WHEN '4' THEN 0.75e0 WHEN '5' THEN 0.6e0 ELSE 0.8e0 END AS cw FROM v_rosters),
 pl AS (SELECT player, COALESCE(MIN(archetype), 'CM') AS archetype, COUNT(DISTINCT season_name) AS n, MODE(competition_name) AS cn, AVG(ROUND(m_progression * 10)) AS p, AVG(m_control * 4) AS c,
   AVG(m_defence) AS d FROM v_player_season GROUP BY player),
 dr AS (SELECT *, DENSE_RANK() OVER (PARTITION BY archetype ORDER BY p) AS dp, DENSE_RANK() OVER (PARTITION BY archetype ORDER BY c NULLS LAST) AS dc, DENSE_RANK() OVER (PARTITION BY archetype ORDER BY d) AS dd FROM pl),
 pc AS (SELECT *, dp / MAX(dp) OVER g * 100e0 AS pp, CASE WHEN c IS NOT NULL THEN dc / MAX(CASE WHEN c IS NOT NULL THEN dc END) OVER g * 100e0 END AS cp, dd / MAX(dd) OVER g * 100e0 AS mp FROM dr WINDOW g AS (PARTITION BY archetype)),
 sc AS (SELECT player, pp, cp, c, CASE WHEN wm IS NULL THEN (mp + pp + COALESCE(cp, 0)) / (2 + (cp IS NOT NULL)::INT)
    ELSE (mp * wm + pp * wp + COALESCE(cp * wc, 0)) / (wm + wp + CASE WHEN cp IS NOT NULL THEN wc ELSE 0 END) END * cw
   * CASE WHEN age <= 29 THEN 1e0 WHEN age <= 31 THEN 0.97e0 WHEN age <= 33 THEN 0.93e0 WHEN age <= 35 THEN 0.88e0 ELSE 0.82e0 END
   * CASE WHEN cn IN ('La Liga','Premier League') THEN CASE WHEN n >= 2 THEN 1e0 ELSE 0.97e0 END WHEN cn = 'FIFA World Cup' THEN 0.9e0 ELSE 0.8e0 END AS comp
  FROM pc JOIN r USING (player) LEFT JOIN w USING (archetype)),
 rk AS (SELECT *, RANK() OVER (ORDER BY comp DESC) AS rank FROM sc)
SELECT player, rank, ROUND(comp, 4) AS composite_score, ROUND(pp, 4) AS "Progression_score", ROUND(cp, 4) AS "Control_score" FROM rk WHERE c IS NOT NULL""")


def _list(t):
    return t.customer.filter("c_custkey % 3 = 0").select(
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "C").otherwise("X"), F.col("c_custkey")).alias("player"),
        F.lit("club").alias("team"), (F.col("c_custkey") / 3 % 100 + 1).cast("int").alias("rank"))


query("s13_blend_external_list", lambda t: rounded(scoring.blend_external_list(
    t.v_rosters.select("player", F.col("club").alias("team"), F.lit("A").alias("coverage_tier"), F.col("final_score").alias("composite_score")), _list(t))), """
WITH g AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'X' END || c_custkey AS player, (c_custkey // 3 % 100)::INT + 1 AS r FROM customer
   WHERE c_custkey % 3 = 0),
 h AS (SELECT player, r, CASE WHEN r <= 10 THEN 90 - (r - 1) * (7 / 9e0) WHEN r <= 30 THEN 82 - (r - 11) * (10 / 19e0) ELSE 71 - (r - 31) * (16 / 69e0) END AS s,
   CASE WHEN r <= 10 THEN 0.4e0 WHEN r <= 30 THEN 0.25e0 ELSE 0.15e0 END AS w FROM g),
 fs AS (SELECT v.player, club AS team, 'A' AS coverage_tier, final_score AS composite_score,
   CASE WHEN final_score IS NULL THEN NULL WHEN r IS NOT NULL THEN (1 - w) * final_score + w * s ELSE LEAST(final_score, 70) END AS final_score
  FROM v_rosters v LEFT JOIN h USING (player)
  UNION ALL SELECT player, 'club', 'D', NULL, CASE WHEN r <= 10 THEN 65 - (r - 1) * (5 / 9e0) ELSE 40 - (r - 11) * (10 / 89e0) END
  FROM h WHERE player NOT IN (SELECT player FROM v_rosters))
SELECT player, team, coverage_tier, ROUND(composite_score, 4) AS composite_score, ROUND(final_score, 4) AS final_score,
  CASE WHEN final_score IS NOT NULL THEN RANK() OVER (ORDER BY final_score DESC NULLS LAST) END AS rank FROM fs""")

query("s14_trait_scores", lambda t: rounded(scoring.trait_scores(t.v_player_season.select(*KEYS, "m_control", "m_defence", "m_progression"), {
    "Control": ["m_control"], "Progression": ["m_progression", "m_control", "m_defence"]}).select(*KEYS, "Control", "Progression")), """
SELECT player_id, season_year, ROUND(COALESCE(m_control, 0), 4) AS "Control",
  ROUND(0.7e0 * GREATEST(m_progression, COALESCE(m_control, 0), m_defence) + 0.3e0 * (m_progression + COALESCE(m_control, 0) + m_defence) / 3, 4) AS "Progression"
FROM v_player_season""")


def _roles(t):
    return t.v_player_season.select("player", F.when(F.col("player_id") % 4 == 0, "Right Wing Back").when(
        F.col("player_id") % 4 == 1, "Left Wing").when(F.col("player_id") % 4 == 2, "Goalkeeper").alias("position"),
        F.col("m_defence").alias("Mobility_Intensity"), F.col("m_progression").alias("Progression"), F.col("m_control").alias("Control"), F.col("xg").alias("Final_Third_Output"))


query("s15_position_weights", lambda t: rounded(scoring.overall_quality(scoring.position_weights(_roles(t)))), """
WITH b AS (SELECT player, CASE player_id % 4 WHEN 0 THEN 'Right Wing Back' WHEN 1 THEN 'Left Wing' WHEN 2 THEN 'Goalkeeper' END AS position,
   m_defence AS m, m_progression AS p, m_control AS c, xg AS f, CASE player_id % 4 WHEN 0 THEN [0.85e0, 1, 0.65, 0.55] WHEN 1 THEN [1e0, 0.8, 0.75, 1]
   WHEN 2 THEN [0.1e0, 0.3, 0.2, 0] ELSE [1e0, 1, 1, 1] END AS w FROM v_player_season)
SELECT player, position, ROUND(m * w[1], 4) AS "Mobility_Intensity", ROUND(p * w[2], 4) AS "Progression", ROUND(c * w[3], 4) AS "Control", ROUND(f * w[4], 4) AS "Final_Third_Output",
  ROUND((m * w[1] * w[1] + p * w[2] * w[2] + COALESCE(c * w[3] * w[3], 0) + f * w[4] * w[4]) / (w[1] + w[2] + w[3] + w[4]), 4) AS overall_quality FROM b""")

query("s16_score_players", lambda t: rounded(player_scores.older_score(
    t.v_player_season, {"control": "m_control", "progression": "m_progression", "mobility": "m_defence"},
    {"Control": ["control"], "Progression": ["progression"], "Mobility_Intensity": ["mobility"]},
    t.v_rosters.select("player", F.col("club").alias("latest_club"), F.when(F.col("age") < 30, "Left Wing").alias("position")),
    _tiers(t), current_year=2001).select("player", "control_percentile", "Progression", "recency_factor", "overall_quality")), """
WITH y AS (SELECT *, EXP(-0.6e0 * (2001 - season_year)) AS w FROM v_player_season),
 m AS (SELECT player, SUM(m_control * w) / SUM(w) AS c, SUM(m_progression * w) / SUM(w) AS p, SUM(m_defence * w) / SUM(w) AS d, MAX(season_year) AS ly FROM y GROUP BY player HAVING SUM(minutes_played) >= 400),
 j AS (SELECT player, ly, age < 30 AS wing, c * lm AS c, p * lm AS p, d * lm AS d FROM m JOIN (SELECT player, age, CASE RIGHT(club, 1) WHEN '1' THEN 1.3e0 WHEN '2' THEN 1.15e0 WHEN '3' THEN 1.05e0
   WHEN '4' THEN 0.85e0 WHEN '5' THEN 0.65e0 ELSE 1e0 END AS lm FROM v_rosters) r USING (player)),
 q AS (SELECT player, ly, wing, CASE WHEN c IS NOT NULL THEN (RANK() OVER (ORDER BY c NULLS LAST) + (COUNT(*) OVER (PARTITION BY c) - 1) / 2e0) / COUNT(c) OVER () * 99 END AS c,
   (RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2e0) / COUNT(p) OVER () * 99 AS p, (RANK() OVER (ORDER BY d) + (COUNT(*) OVER (PARTITION BY d) - 1) / 2e0) / COUNT(d) OVER () * 99 AS d FROM j),
 f AS (SELECT *, CASE WHEN ly = (SELECT MAX(season_year) FROM v_player_season) THEN 1e0 WHEN ly = (SELECT MAX(season_year) FROM v_player_season) - 1 THEN 0.85e0 ELSE 0.7e0 END AS rf,
   CASE WHEN wing THEN 0.8e0 ELSE 1 END AS wp, CASE WHEN wing THEN 0.75e0 ELSE 1 END AS wc FROM q)
SELECT player, ROUND(c, 4) AS control_percentile, ROUND(p * wp, 4) AS "Progression", rf AS recency_factor,
  ROUND(LEAST(100, GREATEST(0, (d + p * wp * wp + COALESCE(c, 0) * wc * wc) / (1 + wp + wc) * rf)), 4) AS overall_quality FROM f""")

query("plan_player_scores", lambda t: rounded(player_scores.score_players(
    player_scores.metric_tables(t.v_events, t.v_matches, t.v_lineups, t.v_frames), t.v_matches, t.v_lineups,
    t.v_events, t.v_rosters, _tiers(t)).select(
    "player", "position_archetype", "composite_score", "rank", "coverage_tier", *[f"{c}_score" for c in scoring.CATEGORIES])))

# ---- R: roll-ups ----------------------------------------------------------------------

SC = "(SELECT player, position_archetype, final_score FROM v_rosters WHERE final_score IS NOT NULL)"


def _sc(t):
    return t.v_rosters.filter(F.col("final_score").isNotNull()).select("player", "position_archetype", "final_score", F.col("club").alias("team"))


def _ro(t):
    return t.v_rosters.select("country", "player", "club", "age")


query("r1_coverage_confidence", lambda t: rollup.coverage_confidence(_ro(t), _sc(t), 60), """
SELECT country, COUNT(final_score) AS n_players_scored, ROUND(LEAST(COUNT(final_score) / 60e0, 1), 3) AS player_coverage_confidence FROM v_rosters GROUP BY country""")

query("r2_top_players_balanced", lambda t: rollup.top_players_balanced(_ro(t), _sc(t)), """
WITH s AS (SELECT country, GREATEST(8, LEAST(15, FLOOR(COUNT(*) * 0.6e0)::INT)) AS top_n FROM v_rosters GROUP BY country),
 m AS (SELECT country, player, position_archetype, final_score, CASE WHEN position_archetype IN ('CB','FB') THEN 3 WHEN position_archetype IN ('DM','CM','AM') THEN 3 ELSE 2 END AS quota,
   ROW_NUMBER() OVER (PARTITION BY country, CASE WHEN position_archetype IN ('CB','FB') THEN 1 WHEN position_archetype IN ('DM','CM','AM') THEN 2 ELSE 3 END
     ORDER BY final_score DESC, player) AS lr FROM v_rosters WHERE final_score IS NOT NULL),
 p AS (SELECT *, lr <= quota AS guaranteed, ROW_NUMBER() OVER (PARTITION BY country ORDER BY (lr <= quota) DESC, final_score DESC, player) AS pick FROM m)
SELECT country, player, position_archetype, final_score, guaranteed, top_n FROM p JOIN s USING (country) WHERE pick <= top_n""")

RANKS = "ROUND(100 - LN({r}) / LN(90e0) * 80, 1)"
QUALITY = f"""rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY final_score DESC NULLS LAST, player) AS k FROM v_rosters WHERE final_score IS NOT NULL),
 b AS (SELECT country, AVG(final_score) AS m, MAX(final_score) AS mx, MIN_BY(player, k) AS tp FROM rk WHERE k <= 5 GROUP BY country),
 n AS (SELECT country, COUNT(final_score) AS n, ROUND(LEAST(COUNT(final_score) / 11e0, 1), 3) AS conf FROM v_rosters GROUP BY country),
 pq AS (SELECT country, ROUND(m, 2) AS player_quality_score, CASE WHEN n = 0 THEN ROUND({RANKS.format(r='fifa_rank')} * 0.75, 2)
   ELSE ROUND(GREATEST(conf, 0.4e0) * m + (1 - GREATEST(conf, 0.4e0)) * {RANKS.format(r='fifa_rank')} * 0.75, 2) END AS effective_score,
   conf AS player_coverage_confidence, n AS n_players_scored, tp AS top_player, ROUND(mx, 2) AS top_player_score
  FROM n LEFT JOIN b USING (country) LEFT JOIN v_countries USING (country))"""

query("r3_player_quality", lambda t: rollup.player_quality(_ro(t), _sc(t), t.v_countries), f"WITH {QUALITY} SELECT * FROM pq")
query("r4_player_quality_table", lambda t: rollup.player_quality_table(_ro(t), _sc(t), t.v_countries)[0], f"""
WITH {QUALITY} SELECT * FROM pq ORDER BY player_quality_score DESC NULLS LAST, country""")
query("r4_player_quality_detail", lambda t: rollup.player_quality_table(_ro(t), _sc(t), t.v_countries)[1], f"""
SELECT country, player, position_archetype, final_score, club AS team FROM v_rosters WHERE final_score IS NOT NULL""")

TENURE = """CASE WHEN coach_years < 1 THEN 50e0 WHEN coach_years <= 3 THEN 50 + (coach_years - 1) * 15 WHEN coach_years <= 7 THEN 80 + (coach_years - 3) * 2.5e0
  WHEN coach_years <= 10 THEN 90 - (coach_years - 7) * 5 ELSE GREATEST(75 - (coach_years - 10) * 3, 50) END"""
EXPERIENCE = "CASE WHEN wc_appearances = 0 THEN 20e0 ELSE ROUND(40 + LN(wc_appearances + 1) / LN(23e0) * 60, 1) END"
SQUAD_AGE = """CASE WHEN AVG(age) BETWEEN 26 AND 29 THEN 100e0 WHEN AVG(age) < 26 THEN ROUND(100 - (26 - AVG(age)) * 8, 1) ELSE ROUND(GREATEST(100 - (AVG(age) - 29) * 8, 30), 1) END"""

query("r5_external_factors", lambda t: rollup.external_factors(t.v_countries), f"""
SELECT country, {RANKS.format(r='fifa_rank')} AS fifa_score, ROUND({TENURE}, 1) AS coach_tenure_score, {EXPERIENCE} AS tournament_exp_score FROM v_countries""")
query("r5_squad_age_score", lambda t: t.v_rosters.groupBy("club").agg(F.avg("age").alias("a")).select("club", rollup.squad_age_score(F.col("a")).alias("squad_age_score")), f"""
SELECT club, {SQUAD_AGE} AS squad_age_score FROM v_rosters GROUP BY club""")

COHESION = """cc AS (SELECT country, club, COUNT(*) AS n FROM v_rosters GROUP BY ALL),
 ch AS (SELECT country, ARG_MIN(club, (-n, club)) AS top_club, MAX(n) AS cohesion_count, LEAST(MAX(n) * 100e0 / SUM(n), 100) AS cohesion_score,
   SUM(n * n) / (SUM(n) * SUM(n))::DOUBLE * 10 AS herfindahl_cohesion FROM cc GROUP BY country)"""
query("r6_club_cohesion", lambda t: rounded(rollup.club_cohesion(_ro(t)).drop("herfindahl_cohesion")),
      f"WITH {COHESION} SELECT country, top_club, cohesion_count, ROUND(cohesion_score, 4) AS cohesion_score FROM ch")
query("r7_herfindahl_cohesion", lambda t: rounded(rollup.club_cohesion(_ro(t)).select("country", "herfindahl_cohesion")),
      f"WITH {COHESION} SELECT country, ROUND(herfindahl_cohesion, 4) AS herfindahl_cohesion FROM ch")

READY = f"""{QUALITY}, {COHESION}, ag AS (SELECT country, {SQUAD_AGE} AS sa FROM v_rosters GROUP BY country),
 cmp AS (SELECT pq.*, confederation_bonus, {RANKS.format(r='fifa_rank')} AS ff, ROUND({TENURE}, 1) AS te, {EXPERIENCE} AS ex, cohesion_score AS co, sa,
   CASE archetype WHEN 'High Press / High Output' THEN 85e0 WHEN 'Possession Dominant' THEN 75 WHEN 'Compact Transition' THEN 65 WHEN 'Mid-Block Reactive' THEN 60
    WHEN 'Moderate Possession' THEN 50 WHEN 'Low Intensity' THEN 40 END AS ta, gmm_confidence AS g
  FROM pq JOIN v_countries USING (country) JOIN ch USING (country) JOIN ag USING (country)),
 fin AS (SELECT *, CASE WHEN ta IS NULL THEN effective_score * 0.4375e0 + ff * 0.1875e0 + co * 0.125e0 + te * 0.0625e0 + ex * 0.0625e0 + sa * 0.0625e0
   ELSE effective_score * 0.35e0 + ff * 0.15e0 + co * 0.1e0 + te * 0.05e0 + ex * 0.05e0 + sa * 0.05e0
    + 0.2e0 * CASE WHEN g = 0 THEN ta ELSE g * ta + (1 - g) * ff * 0.8e0 END END AS c FROM cmp)"""
query("r8_team_readiness", lambda t: rollup.team_readiness(_ro(t), _sc(t), t.v_countries, t.v_countries.filter("archetype IS NOT NULL").select(
    F.col("country").alias("team"), "archetype", F.lit(None).cast("double").alias("archetype_score"), "gmm_confidence")), f"""
WITH {READY} SELECT country, ROUND(c * confederation_bonus, 2) AS final_score, ROUND(c, 2) AS composite_score, confederation_bonus,
  ROUND(effective_score, 2) AS player_quality_score, player_coverage_confidence, n_players_scored, ta AS tactical_archetype,
  CASE WHEN ta IS NOT NULL THEN g END AS gmm_confidence, ROUND(ff, 2) AS fifa_score, ROUND(co, 2) AS club_cohesion_score, ROUND(te, 2) AS coach_tenure_score,
  ROUND(ex, 2) AS tournament_exp_score, ROUND(sa, 2) AS squad_age_score, ta IS NOT NULL AS archetype_available FROM fin""")


def _fit(t):
    squads = t.v_rosters.filter(F.col("final_score").isNotNull()).select("country", "player", F.col("final_score").alias("overall_quality"), "club")
    sizes = t.v_rosters.groupBy("country").agg(F.count("*").alias("squad_size"))
    success = t.nation.groupBy((F.col("n_nationkey") % 6).alias("cluster")).agg(F.min(F.lit("style")).alias("archetype_name"),
        (F.avg("n_nationkey") * 2).alias("winner_pct"), F.avg("n_nationkey").alias("qf_plus_pct")).filter("cluster < 5")
    return rollup.system_fit(squads, sizes, t.v_countries, success, t.v_rosters.filter("club LIKE '%3'").select("club"), ["N0", "N1", "N2"])


FIT = """f AS (SELECT country, COUNT(*) AS n, AVG(final_score) AS q, COUNT(*) FILTER (WHERE club LIKE '%3') AS loc FROM v_rosters WHERE final_score IS NOT NULL GROUP BY country),
 t3 AS (SELECT country, AVG(final_score) AS t FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY country ORDER BY final_score DESC, player) AS k FROM v_rosters
   WHERE final_score IS NOT NULL) z WHERE k <= 3 GROUP BY country),
 hh AS (SELECT country, SUM(n * n) AS sq FROM (SELECT country, club, COUNT(*) AS n FROM v_rosters WHERE final_score IS NOT NULL GROUP BY ALL) z GROUP BY country),
 sz AS (SELECT country, COUNT(*) AS size FROM v_rosters GROUP BY country),
 su AS (SELECT n_nationkey % 6 AS cluster, AVG(n_nationkey) * 2 AS w, AVG(n_nationkey) AS qf FROM nation WHERE n_nationkey % 6 < 5 GROUP BY n_nationkey % 6),
 j AS (SELECT country, n, size, q, loc, tn, st, CASE WHEN t > 58 THEN (t - 58) * 0.25e0 ELSE 0 END AS star, loc / size::DOUBLE * 5 AS rec,
   CASE WHEN country IN ('N0','N1','N2') THEN 2e0 ELSE 0 END AS host, tp, confederation, CASE WHEN n = 1 THEN 8 WHEN n < 4 THEN 3 ELSE 0 END AS thin,
   CASE WHEN n < 5 THEN n / 5e0 * q + (1 - n / 5e0) * 55 ELSE q END AS qual, CASE WHEN n >= 3 THEN sq / (n * n)::DOUBLE * 10 ELSE 0 END AS coh,
   COALESCE(ROUND(w / 100 * 3 + qf / 100 * 2, 2), 0) AS bon, CASE WHEN w IS NULL THEN 'Unknown' ELSE 'style' END AS arch
  FROM f JOIN t3 USING (country) JOIN hh USING (country) JOIN sz USING (country) JOIN (SELECT *, 2026 - manager_since AS tn,
    LEAST(1.05e0, 0.9e0 + (2026 - manager_since) * 0.02e0) AS st, CASE confederation WHEN 'UEFA' THEN 2.5e0 WHEN 'CONMEBOL' THEN 1 WHEN 'CAF' THEN 2 ELSE 2.5 END AS tp
    FROM v_countries) c USING (country) LEFT JOIN su USING (cluster)),
 fit AS (SELECT country AS "National_Team", ROUND(qual * st + host + coh + star + rec + bon - tp - thin, 2) AS "Readiness_Score", arch AS "Archetype", bon AS "Archetype_Bonus",
  ROUND(qual, 2) AS "Squad_Quality", ROUND(star, 2) AS "Star_Power", ROUND(st, 2) AS "Stability", tn AS "Manager_Tenure", ROUND(coh, 2) AS "Cohesion", ROUND(rec, 2) AS "Recovery",
  tp AS "Travel_Penalty", confederation AS "Confederation", CASE WHEN host > 0 THEN 'Yes' ELSE 'No' END AS "Host_Adv", n AS "Players_Found", size AS "Squad_Size",
  ROUND(n / size::DOUBLE * 100, 1) AS "Coverage_Pct" FROM j)"""
query("r9_system_fit", _fit, f"WITH {FIT} SELECT * FROM fit")
query("r10_upset_index", lambda t: rollup.upset_index(_fit(t)).select("National_Team", "Upset_Index"), f"""
WITH {FIT} SELECT "National_Team", ROUND(("Star_Power" + "Cohesion") / "Readiness_Score" * 100, 2) AS "Upset_Index" FROM fit""")


def _fixtures(t):
    return t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("row_team"), F.concat(F.lit("N"), (F.col("n_nationkey") * 3 + 1) % 25).alias("col_team"))


query("r11_net_advantage", lambda t: rollup.net_advantage(_fit(t), _fixtures(t)), f"""
WITH {FIT}, z AS (SELECT "National_Team" AS k, COALESCE(("Squad_Quality" - MIN("Squad_Quality") OVER ()) / NULLIF(MAX("Squad_Quality") OVER () - MIN("Squad_Quality") OVER (), 0) * 100, 50) * 0.4e0
   + COALESCE(("Star_Power" - MIN("Star_Power") OVER ()) / NULLIF(MAX("Star_Power") OVER () - MIN("Star_Power") OVER (), 0) * 100, 50) * 0.25e0
   + COALESCE(("Stability" - MIN("Stability") OVER ()) / NULLIF(MAX("Stability") OVER () - MIN("Stability") OVER (), 0) * 100, 50) * 0.2e0
   + COALESCE(("Cohesion" - MIN("Cohesion") OVER ()) / NULLIF(MAX("Cohesion") OVER () - MIN("Cohesion") OVER (), 0) * 100, 50) * 0.1e0
   + COALESCE(("Recovery" - MIN("Recovery") OVER ()) / NULLIF(MAX("Recovery") OVER () - MIN("Recovery") OVER (), 0) * 100, 50) * 0.05e0 AS s FROM fit)
SELECT a.k AS row_team, b.k AS col_team, CASE WHEN a.k <> b.k THEN ROUND(a.s - b.s, 2) END AS net_advantage
FROM nation n JOIN z a ON a.k = 'N' || n.n_nationkey JOIN z b ON b.k = 'N' || ((n.n_nationkey * 3 + 1) % 25)""")

query("r12_quadrant", lambda t: rollup.quadrant(t.v_player_season.filter("m_control IS NOT NULL").select(*KEYS, "m_control", "m_progression"), "m_control", "m_progression",
      ("ELITE", "DARK HORSE", "GRINDER", "ALSO-RAN")).drop("m_control", "m_progression"), """
WITH b AS (SELECT * FROM v_player_season WHERE m_control IS NOT NULL), q AS (SELECT MEDIAN(m_control) AS x, MEDIAN(m_progression) AS y FROM b)
SELECT player_id, season_year, CASE WHEN m_control >= x AND m_progression >= y THEN 'ELITE' WHEN m_progression >= y THEN 'DARK HORSE'
  WHEN m_control >= x THEN 'GRINDER' ELSE 'ALSO-RAN' END AS "Tag" FROM b, q""")

query("r13_signal_disagreement", lambda t: rounded(rollup.signal_disagreement(
    t.v_countries.select("country", "fifa_rank", "coach_years", F.col("wc_appearances").cast("double")), "country",
    {"Rank": "fifa_rank", "Coach": "coach_years", "Cups": "wc_appearances"})), """
WITH r AS (SELECT country, RANK() OVER (ORDER BY fifa_rank DESC) + (COUNT(*) OVER (PARTITION BY fifa_rank) - 1) / 2e0 AS a,
   RANK() OVER (ORDER BY coach_years DESC) + (COUNT(*) OVER (PARTITION BY coach_years) - 1) / 2e0 AS b,
   RANK() OVER (ORDER BY wc_appearances DESC) + (COUNT(*) OVER (PARTITION BY wc_appearances) - 1) / 2e0 AS c FROM v_countries)
SELECT country, a AS rank_rank, b AS coach_rank, c AS cups_rank, ROUND(SQRT(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 2), 4) AS rank_std,
  CASE WHEN a <= b AND a <= c THEN 'Rank' WHEN b <= c THEN 'Coach' ELSE 'Cups' END || ' ↑  vs  ' ||
  CASE WHEN a >= b AND a >= c THEN 'Rank' WHEN b >= c THEN 'Coach' ELSE 'Cups' END || ' ↓' AS gap_label
FROM r ORDER BY SQRT(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 2) DESC, country LIMIT 15""")


def _waterfall_rows(t):
    return t.customer.select(F.col("c_name").alias("team"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 90 + 0.0).alias("archetype_score"),
        (F.col("c_custkey") % 80 + 0.0).alias("blend_score"), (F.col("c_custkey") % 70 + 0.0).alias("final_score"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 8 - 4.0).alias("quality_adjustment"), (F.col("c_custkey") % 100 + 0.0).alias("readiness_score"))


query("r14_score_waterfall", lambda t: rollup.score_waterfall(_waterfall_rows(t)), """
WITH c AS (SELECT c_name AS team, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 90)::DOUBLE END AS a, (c_custkey % 80)::DOUBLE AS b, (c_custkey % 70)::DOUBLE AS f,
   CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 8 - 4e0 END AS q, (c_custkey % 100)::DOUBLE AS r FROM customer),
 l AS (SELECT team, 0 AS step, 'Base Archetype' AS stage, a AS value, TRUE AS is_total, 0e0 AS base FROM c UNION ALL SELECT team, 1, 'GMM Blend', b - a, FALSE, a FROM c
   UNION ALL SELECT team, 2, 'Evidence Discount', CASE WHEN ABS(f - COALESCE(q, 0) - b) > 0.01 THEN f - COALESCE(q, 0) - b END, FALSE, CASE WHEN a IS NULL THEN 0 ELSE b END FROM c
   UNION ALL SELECT team, 3, 'Quality Adj', q, FALSE, CASE WHEN a IS NULL THEN 0 ELSE b END + CASE WHEN ABS(f - COALESCE(q, 0) - b) > 0.01 THEN f - COALESCE(q, 0) - b ELSE 0 END FROM c
   UNION ALL SELECT team, 4, 'Tactical Score', f, TRUE, 0 FROM c UNION ALL SELECT team, 5, 'Player + Context Lift', r - f, FALSE, f FROM c
   UNION ALL SELECT team, 6, 'Readiness Score', r, TRUE, 0 FROM c)
SELECT * FROM l WHERE value IS NOT NULL""")


def _board(t):
    return t.customer.select(F.col("c_name").alias("team"), F.concat(F.lit("A"), F.col("c_nationkey") % 7).alias("archetype"),
        (F.col("c_custkey") * 37 % 1009 / 10.0).alias("readiness_score"), (F.col("c_custkey") * 53 % 1013 / 10.0).alias("p_champion"),
        (F.col("c_custkey") * 71 % 1019 / 10.0).alias("player_quality_score"))


BOARD = """bd AS (SELECT c_name AS team, 'A' || (c_nationkey % 7) AS archetype, (c_custkey * 37 % 1009) / 10e0 AS readiness_score,
  (c_custkey * 53 % 1013) / 10e0 AS p_champion, (c_custkey * 71 % 1019) / 10e0 AS player_quality_score FROM customer)"""

query("r15_master_table", lambda t: rollup.master_table(
    _board(t).select("team", "readiness_score"), t.customer.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("team"), F.col("c_mktsegment").alias("archetype")),
    t.customer.select(F.col("c_name").alias("country"), F.col("c_acctbal").alias("player_quality_score"))), f"""
WITH {BOARD} SELECT team, readiness_score, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'No Tactical Data' END AS archetype,
  c_acctbal AS player_quality_score, c_custkey % 3 = 0 AS has_tactical FROM bd JOIN customer ON c_name = team""")


def _results(t):
    return t.v_matches.select(F.concat(F.lit("G"), F.col("match_id") % 5).alias("group"), F.col("home_team").alias("team_a"),
        F.col("away_team").alias("team_b"), F.col("home_score").alias("goals_a"), F.col("away_score").alias("goals_b"))


STAND = """lg AS (SELECT 'G' || (match_id % 5) AS "group", home_team AS team, home_score AS gf, away_score AS ga FROM v_matches
   UNION ALL SELECT 'G' || (match_id % 5), away_team, away_score, home_score FROM v_matches),
 st AS (SELECT "group", team, SUM(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END)::BIGINT AS points, SUM(gf - ga)::BIGINT AS gd, SUM(gf)::BIGINT AS gf FROM lg GROUP BY ALL),
 sp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "group" ORDER BY points DESC, gd DESC, gf DESC, team) AS position FROM st)"""
query("r16_group_standings", lambda t: rollup.group_standings(_results(t)), f"WITH {STAND} SELECT * FROM sp")
query("r17_best_third_place", lambda t: rollup.best_third_place(rollup.group_standings(_results(t)), 3), f"""
WITH {STAND} SELECT team, "group", points, gd, gf FROM sp WHERE position = 3 ORDER BY points DESC, gd DESC, gf DESC, team LIMIT 3""")
query("r18_win_probability", lambda t: rounded(rollup.fixture_probabilities(
    t.v_matches.select("match_id", F.col("home_team").alias("team_a"), F.col("away_team").alias("team_b")),
    t.v_matches.groupBy(F.col("home_team").alias("team")).agg(F.avg("home_score").alias("score")))), """
WITH s AS (SELECT home_team AS team, AVG(home_score) AS score FROM v_matches GROUP BY home_team)
SELECT match_id, home_team AS team_a, away_team AS team_b, ROUND(a.score, 4) AS score_a, ROUND(b.score, 4) AS score_b, ROUND(1 / (1 + EXP(-(a.score - b.score) / 15)), 4) AS p_a
FROM v_matches m JOIN s a ON a.team = home_team JOIN s b ON b.team = away_team""")
query("r19_outcome_shares", lambda t: rollup.outcome_shares(t.orders.select(F.concat(F.lit("T"), F.col("o_custkey") % 48).alias("team"), F.when(
    F.col("o_orderkey") % 9 == 0, "Champion").when(F.col("o_orderkey") % 9 == 1, "Semi-final").when(F.col("o_orderkey") % 9 < 5, "Round of 16").otherwise("Group Stage").alias("stage"))), """
WITH o AS (SELECT 'T' || (o_custkey % 48) AS team, o_orderkey % 9 AS k FROM orders)
SELECT team, ROUND(COUNT(*) FILTER (WHERE k = 0) * 100e0 / COUNT(*), 1) AS p_champion, 0e0 AS p_runner_up, ROUND(COUNT(*) FILTER (WHERE k = 1) * 100e0 / COUNT(*), 1) AS p_semi_final,
  0e0 AS p_quarter_final, ROUND(COUNT(*) FILTER (WHERE k BETWEEN 2 AND 4) * 100e0 / COUNT(*), 1) AS p_round_of_16, 0e0 AS p_round_of_32,
  ROUND(COUNT(*) FILTER (WHERE k > 4) * 100e0 / COUNT(*), 1) AS p_group_exit FROM o GROUP BY team""")
query("r20_peers", lambda t: rollup.peers(_board(t)), f"""
WITH {BOARD}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY archetype ORDER BY readiness_score DESC, team) AS r FROM bd),
 p AS (SELECT a.team, a.archetype, b.team AS peer, b.readiness_score AS peer_score, ROW_NUMBER() OVER (PARTITION BY a.team ORDER BY b.r) AS peer_rank
  FROM bd a JOIN o b ON a.archetype = b.archetype AND a.team <> b.team AND b.r <= 4)
SELECT * FROM p WHERE peer_rank <= 3""")
query("r21_headline_stats", lambda t: rollup.headline_stats(_board(t)), f"""
WITH {BOARD} SELECT ARG_MIN(team, (-p_champion, team)) AS favourite, ROUND(MAX(p_champion), 1) AS favourite_p, ROUND(AVG(readiness_score), 1) AS avg_readiness,
  ARG_MIN(team, (-player_quality_score, team)) AS best_squad, ROUND(MAX(player_quality_score), 1) AS best_squad_score,
  ARG_MIN(team, (-p_champion, team)) FILTER (WHERE readiness_score < 53) AS underdog, ROUND(MAX(p_champion) FILTER (WHERE readiness_score < 53), 1) AS underdog_p FROM bd""")
query("r21_confidence_band", lambda t: rollup.coverage_confidence(_ro(t), _sc(t), 70).select("country", rollup.confidence_band(F.col("player_coverage_confidence")).alias("band")), """
SELECT country, CASE WHEN ROUND(LEAST(COUNT(final_score) / 70e0, 1), 3) >= 0.8 THEN 'HIGH CONFIDENCE' WHEN ROUND(LEAST(COUNT(final_score) / 70e0, 1), 3) >= 0.4
  THEN 'PARTIAL CONFIDENCE' ELSE 'LOW CONFIDENCE' END AS band FROM v_rosters GROUP BY country""")
