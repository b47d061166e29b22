"""Queries for loading, scoping and profiling."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from touchline.catalog.registry import query
from touchline.functions.columns import rounded
from touchline.functions.lineage import shared_folder
from touchline.operators import profiling, season, validation
from touchline.sources import loading

EV = "id, match_id, team, player, type"


def _ids(df):
    return df.select("id", "match_id", "team", "player", "type")


query("l1_events_by_seasons", lambda t: _ids(loading.events_by_seasons(t.v_events, t.v_matches, ["2022", "2023/2024"], ["UEFA Euro"])), f"""
SELECT {EV} FROM v_events WHERE match_id IN (SELECT match_id FROM v_matches WHERE season_name IN ('2022','2023/2024') AND competition NOT IN ('UEFA Euro'))""")
query("l2_events_by_scope", lambda t: _ids(loading.events_by_scope(t.v_events, t.v_matches, ["2022", "2024"], ["FIFA World Cup", "La Liga"])), f"""
SELECT {EV} FROM v_events WHERE match_id IN (SELECT match_id FROM v_matches WHERE season_name IN ('2022','2024') AND competition IN ('FIFA World Cup','La Liga'))""")
query("l3_stack_tables", lambda t: loading.stack_tables([
    {"m": t.v_player_season.filter("season_year < 1998").select("player", "season_name", "m_control")},
    {"m": t.v_player_season.filter("season_year >= 1998").select("player", "season_name", "m_defence")}])["m"].transform(season.with_season_year), """
SELECT player, season_name, season_year, CASE WHEN season_year < 1998 THEN m_control END AS m_control, CASE WHEN season_year >= 1998 THEN m_defence END AS m_defence FROM v_player_season""")


def _season_folders(t, columns):
    """The seasons written out as CSV folders, to be loaded as a scope."""
    base = f"{shared_folder(t.spark)}/scope-{uuid4().hex}"
    years = sorted(r["season_year"] for r in t.v_player_season.select("season_year").distinct().collect())  # a handful of seasons
    for y in years:
        t.v_player_season.filter(F.col("season_year") == y).select(*columns).write.option("header", True).csv(f"{base}/{y}/metrics.csv")
    return base, [str(y) for y in years]


def _scope(t):
    base, folders = _season_folders(t, ["player", "team", "minutes_played", "m_defence"])
    return loading.load_scope(t.spark, base, folders, ["metrics.csv", "missing.csv"])["metrics.csv"]


def _team_metrics(t):
    folder = f"{shared_folder(t.spark)}/teams-{uuid4().hex}"
    t.v_team_match.select("match_id", "team", "ppda", F.lit(1).alias("other")).write.option("header", True).csv(f"{folder}/possession__team__ppda.csv")
    return loading.load_team_metrics(t.spark, folder)["ppda"]


query("l3_load_scope", _scope, """
SELECT player, team, minutes_played::DOUBLE AS minutes_played, m_defence::DOUBLE AS m_defence, season_year::VARCHAR AS season_name, season_year FROM v_player_season""")
query("l5_team_metrics", _team_metrics, "SELECT match_id::INT AS match_id, team, ppda FROM v_team_match")
query("l4_season_year", lambda t: season.with_season_year(t.v_player_season.select("player", "season_name")), "SELECT player, season_name, season_year FROM v_player_season")
query("l6_match_events", lambda t: _ids(loading.match_events(t.v_events, 3)), f"SELECT {EV} FROM v_events WHERE match_id = 3")
query("l6_player_events", lambda t: _ids(loading.player_events(t.v_events, "T3_P7")), f"SELECT {EV} FROM v_events WHERE player = 'T3_P7'")


def _sql(t):
    loading.register(t.spark, {"l7_matches": t.v_matches, "l7_events": t.v_events})
    return loading.run_sql(t.spark, "SELECT competition, COUNT(*) AS shots FROM l7_events JOIN l7_matches USING (match_id) WHERE type = :kind GROUP BY competition", kind="Shot")


query("l7_named_sql", _sql, "SELECT competition, COUNT(*) AS shots FROM v_events JOIN v_matches USING (match_id) WHERE type = 'Shot' GROUP BY competition")
query("l8_data_summary", lambda t: loading.data_summary(t.v_matches, t.v_events, t.v_frames), """
SELECT 'total_matches' AS item, NULL AS label, COUNT(*) AS value FROM v_matches UNION ALL SELECT 'competitions', NULL, COUNT(DISTINCT competition) FROM v_matches
UNION ALL SELECT 'total_events', NULL, COUNT(*) FROM v_events UNION ALL SELECT 'tracked_events', NULL, COUNT(DISTINCT event_uuid) FROM v_frames
UNION ALL SELECT 'event_type', type, n FROM (SELECT type, COUNT(*) AS n FROM v_events GROUP BY type ORDER BY n DESC, type LIMIT 10) z""")
query("l9_team_league_map", lambda t: season.team_league_map(t.v_matches), """
SELECT home_team AS team, competition AS competition_name, season_name FROM v_matches UNION SELECT away_team, competition, season_name FROM v_matches""")
query("l10_match_results", lambda t: validation.match_results(t.v_matches), """
SELECT match_id, home_team AS team, CASE WHEN home_score > away_score THEN 'W' WHEN home_score < away_score THEN 'L' ELSE 'D' END AS outcome FROM v_matches
UNION ALL SELECT match_id, away_team, CASE WHEN away_score > home_score THEN 'W' WHEN away_score < home_score THEN 'L' ELSE 'D' END FROM v_matches""")
query("l11_repair_epoch_millis", lambda t: loading.repair_epoch_millis(t.events.select("event_id", (F.lit(1704067200000) + F.col("event_id") * 977).alias("timestamp")), "timestamp").select(
    "event_id", F.unix_millis("timestamp").alias("millis")), "SELECT event_id, 1704067200000 + event_id * 977 AS millis FROM events")
query("l12_audit_timestamps", lambda t: loading.audit_timestamps(t.orders.select(
    (F.lit(1700000000) + F.col("o_orderkey")).alias("created_s"), (F.lit(1500000000000) + F.col("o_orderkey") * 1000).alias("end_ms"), F.timestamp_micros(F.lit(1704067200) + F.col("o_orderkey")).alias("trade_ts")), "orders").select(
    "file", "column", "total", "nulls", "pre_cutoff", "diagnosis"), """
SELECT 'orders' AS file, c AS "column", COUNT(*) AS total, 0 AS nulls, CASE WHEN c = 'created_s' THEN 0 ELSE COUNT(*) END AS pre_cutoff,
  CASE c WHEN 'created_s' THEN 'OK' WHEN 'end_ms' THEN 'CORRUPTED (pre-2020 values)' ELSE 'CORRUPTED (ms-as-ns, fix: cast Int64->Datetime(ms))' END AS diagnosis
FROM orders, (VALUES ('created_s'), ('end_ms'), ('trade_ts')) v(c) GROUP BY c""")

query("e1_value_counts", lambda t: profiling.value_counts(t.v_events, "type", 12), "SELECT type, COUNT(*) AS count FROM v_events GROUP BY type ORDER BY count DESC, type LIMIT 12")
query("e1_top_rows", lambda t: profiling.top_rows(t.lineitem, ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice", 10, "l_orderkey"), """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 10""")
query("e1_describe", lambda t: rounded(profiling.describe(t.lineitem, ["l_quantity", "l_extendedprice"]), 3), """
WITH l AS (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT metric, COUNT(v) AS count, COUNT(*) - COUNT(v) AS null_count, ROUND(AVG(v), 3) AS mean, ROUND(STDDEV_SAMP(v), 3) AS std, MIN(v) AS min, MAX(v) AS max, ROUND(QUANTILE_CONT(v, 0.25), 3) AS q25,
  ROUND(QUANTILE_CONT(v, 0.5), 3) AS q50, ROUND(QUANTILE_CONT(v, 0.75), 3) AS q75 FROM l GROUP BY metric""")


def _sections(cells, source):
    parts = " UNION ALL ".join(f"SELECT '{s}' AS section, ({e})::VARCHAR AS label FROM {source}" for s, e in cells.items())
    return f"""WITH l AS ({parts}), c AS (SELECT section, label, COUNT(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT section, label, n, ROUND(n * 100e0 / SUM(n) OVER (PARTITION BY section), 2) AS share_pct FROM c"""


query("e2_match_profile", lambda t: profiling.match_profile(t.v_matches), _sections({
    "result": "CASE WHEN home_score > away_score THEN 'Home Win' WHEN away_score > home_score THEN 'Away Win' ELSE 'Draw' END", "year": "YEAR(match_date::DATE)", "weekday": "DAYNAME(match_date::DATE)",
    "competition": "competition", "season": "season_name", "scoreline": "home_score || '-' || away_score", "goal_difference": "home_score - away_score",
    "goals": "CASE WHEN home_score + away_score >= 6 THEN '6 or more' WHEN home_score + away_score = 0 THEN 'goalless' END"}, "v_matches"))
query("e2_match_totals", lambda t: profiling.match_totals(t.v_matches), """
SELECT COUNT(*) AS matches, MIN(match_date) AS first_date, MAX(match_date) AS last_date, SUM(home_score + away_score)::BIGINT AS goals, ROUND(AVG(home_score + away_score), 2) AS goals_per_match,
  ROUND(AVG(home_score), 2) AS home_goals, ROUND(AVG(away_score), 2) AS away_goals FROM v_matches""")
BIN = "CASE WHEN minute <= 0 THEN NULL WHEN minute <= 15 THEN '0-15' WHEN minute <= 30 THEN '16-30' WHEN minute <= 45 THEN '31-45' WHEN minute <= 60 THEN '46-60' WHEN minute <= 75 THEN '61-75' WHEN minute <= 90 THEN '76-90' WHEN minute <= 120 THEN '90+' END"
query("e3_event_profile", lambda t: profiling.event_profile(t.v_events), _sections({
    "type": "type", "team": "team", "period": "period", "minute": BIN, "zone": "CASE WHEN location_x <= 0 THEN NULL WHEN location_x <= 40 THEN 'Defensive' WHEN location_x <= 80 THEN 'Middle' WHEN location_x <= 120 THEN 'Attacking' END",
    "play_pattern": "play_pattern", "shot_outcome": "CASE WHEN type = 'Shot' THEN shot_outcome END", "incomplete_pass": "CASE WHEN type = 'Pass' THEN pass_outcome END"}, "v_events"))
query("e3_event_totals", lambda t: profiling.event_totals(t.v_events), """
SELECT COUNT(*) AS events, COUNT(DISTINCT match_id) AS matches, COUNT(DISTINCT player) AS players, COUNT(*) FILTER (WHERE player IS NULL) AS without_player,
  COUNT(*) FILTER (WHERE location_x IS NOT NULL AND location_y IS NOT NULL) AS with_location, COUNT(*) FILTER (WHERE minute > 90) AS after_90, COUNT(*) FILTER (WHERE type = 'Shot') AS shots,
  ROUND(SUM(shot_statsbomb_xg), 3) AS total_xg, ROUND(AVG(shot_statsbomb_xg), 3) AS xg_per_shot, COUNT(*) FILTER (WHERE shot_statsbomb_xg > 0.3) AS big_chances, COUNT(*) FILTER (WHERE type = 'Pass') AS passes,
  COUNT(*) FILTER (WHERE type = 'Pass' AND pass_outcome IS NULL) AS completed, COUNT(*) FILTER (WHERE counterpress) AS counterpress FROM v_events""")

SPAN = """ls AS (SELECT *, SPLIT_PART(from_time, ':', 1)::INT + SPLIT_PART(from_time, ':', 2)::INT / 60e0 AS a, SPLIT_PART(to_time, ':', 1)::INT + SPLIT_PART(to_time, ':', 2)::INT / 60e0 AS b FROM v_lineups)"""
LROLE = "CASE WHEN COALESCE(from_time = '00:00', FALSE) THEN CASE WHEN COALESCE(b - a > 0 AND b - a <= 130, FALSE) THEN 'Starter played' ELSE 'Starter unused' END WHEN COALESCE(b - a > 0 AND b - a <= 130, FALSE) THEN 'Substitute' ELSE 'Unused bench' END"
LBAND = "CASE WHEN b - a > 0 AND b - a <= 130 THEN CASE WHEN b - a >= 90 THEN '90+' WHEN b - a >= 60 THEN '60-90' WHEN b - a >= 30 THEN '30-60' WHEN b - a >= 15 THEN '15-30' ELSE '<15' END END"
query("e4_lineup_profile", lambda t: profiling.lineup_profile(t.v_lineups), _sections({
    "role": LROLE, "minutes": LBAND, "card": "card_type", "country": "country_name", "shirt": "jersey_number", "position": "position_name", "team": "team_name"}, "ls").replace("WITH l AS", f"WITH {SPAN}, l AS"))
query("e4_participation", lambda t: profiling.participation(t.v_lineups), f"""
WITH {SPAN}, p AS (SELECT match_id, player_name, SUM(COALESCE(b, 90) - COALESCE(a, 90)) AS d, BOOL_OR(COALESCE(from_time = '00:00', FALSE)) AS s, COUNT(*) AS k FROM ls GROUP BY ALL)
SELECT SUM(k)::BIGINT AS "rows", COALESCE(SUM(k) FILTER (WHERE k > 1), 0)::BIGINT AS duplicate_rows, COUNT(*) FILTER (WHERE d > 0) AS played, ROUND(COUNT(*) FILTER (WHERE d > 0 AND NOT s) / COUNT(DISTINCT match_id)::DOUBLE, 1) AS subs_per_match,
  ROUND(AVG(d) FILTER (WHERE d > 0 AND s), 1) AS starter_minutes, ROUND(AVG(d) FILTER (WHERE d > 0 AND NOT s), 1) AS sub_minutes, COUNT(*) FILTER (WHERE d >= 90) AS min_90, COUNT(*) FILTER (WHERE d >= 60 AND d < 90) AS min_60_90,
  COUNT(*) FILTER (WHERE d >= 30 AND d < 60) AS min_30_60, COUNT(*) FILTER (WHERE d > 0 AND d < 30) AS min_under_30 FROM p""")
query("e4_card_leaders", lambda t: profiling.card_leaders(t.v_lineups), """
SELECT player_name, COUNT(card_type) AS cards, COUNT(DISTINCT match_id) AS matches, ROUND(COUNT(card_type) / COUNT(DISTINCT match_id)::DOUBLE, 2) AS cards_per_match FROM v_lineups GROUP BY player_name
HAVING COUNT(card_type) > 0 ORDER BY cards DESC, player_name LIMIT 5""")
query("e4_versatility", lambda t: profiling.versatility(t.v_lineups), """
SELECT player_name, COUNT(DISTINCT position_name) AS unique_positions FROM v_lineups GROUP BY player_name ORDER BY unique_positions DESC, player_name LIMIT 5""")
LCOLS = ["match_id", "team_name", "player_name", "position_name", "from_time", "to_time", "card_type", "jersey_number", "country_name"]
query("e5_quality_report", lambda t: profiling.quality_report(t.v_lineups.select(*LCOLS), ["match_id", "jersey_number"]), " UNION ALL ".join(
    f"SELECT 'missing' AS \"check\", '{c}' AS item, COUNT(*) - COUNT({c}) AS bad, ROUND((COUNT(*) - COUNT({c})) * 100e0 / COUNT(*), 2) AS bad_pct FROM v_lineups" for c in LCOLS) + """
UNION ALL SELECT 'duplicate key rows', 'match_id,jersey_number', COALESCE(SUM(k - 1), 0)::BIGINT, ROUND(COALESCE(SUM(k - 1), 0) * 100e0 / SUM(k), 2) FROM (SELECT COUNT(*) AS k FROM v_lineups GROUP BY match_id, jersey_number) z""")
query("e6_tracking_profile", lambda t: profiling.tracking_profile(t.v_frames), """
WITH e AS (SELECT match_id, event_uuid, COUNT(*) AS n FROM v_frames GROUP BY ALL)
SELECT (SELECT COUNT(*) FROM v_frames) AS frames, COUNT(*) AS events, COUNT(DISTINCT match_id) AS matches, ROUND(AVG(n), 2) AS frames_per_event, MIN(n) AS min_frames, MAX(n) AS max_frames,
  (SELECT COUNT(*) FILTER (WHERE teammate) FROM v_frames) AS teammates, (SELECT COUNT(*) FILTER (WHERE actor) FROM v_frames) AS actors, (SELECT COUNT(*) FILTER (WHERE keeper) FROM v_frames) AS keepers,
  (SELECT COUNT(*) FILTER (WHERE location_x IS NOT NULL AND location_y IS NOT NULL) FROM v_frames) AS with_location, (SELECT COUNT(visible_area) FROM v_frames) AS with_area FROM e""")
query("e6_tracking_coverage", lambda t: profiling.tracking_coverage(t.v_frames.filter("match_id % 3 <> 0"), t.v_matches), """
WITH s AS (SELECT DISTINCT match_id, 1 AS t FROM v_frames WHERE match_id % 3 <> 0) SELECT competition, COUNT(t) AS tracked, COUNT(*) AS matches, ROUND(COUNT(t) * 100e0 / COUNT(*), 1) AS coverage_pct
FROM v_matches LEFT JOIN s USING (match_id) GROUP BY competition""")
query("e7_name_collisions", lambda t: profiling.name_collisions(t.part.select(F.lit("part").alias("table_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))), """
SELECT 'part' AS table_name, p_name AS name, COUNT(DISTINCT p_partkey) AS id_count FROM part GROUP BY p_name HAVING COUNT(DISTINCT p_partkey) > 1""")
query("e8_competition_by_year", lambda t: profiling.competition_by_year(t.v_matches, 2), """
WITH m AS (SELECT competition, YEAR(match_date::DATE)::INT AS year FROM v_matches), b AS (SELECT competition FROM m GROUP BY competition ORDER BY COUNT(*) DESC, competition LIMIT 2)
SELECT CASE WHEN b.competition IS NULL THEN 'Others' ELSE m.competition END AS competition, year, COUNT(*) AS matches FROM m LEFT JOIN b ON m.competition = b.competition WHERE year BETWEEN 2010 AND 2025 GROUP BY ALL""")
query("e9_position_minutes", lambda t: profiling.position_minutes(t.v_lineups, t.v_matches, "t1_p", ["Goalkeeper", "Left Back", "Center Forward"]), f"""
WITH {SPAN}, r AS (SELECT season_name, position_name, COALESCE(b, 90) - COALESCE(a, 90) AS d FROM ls JOIN v_matches USING (match_id) WHERE CONTAINS(LOWER(player_name), 't1_p'))
SELECT season_name, ROUND(COALESCE(SUM(d) FILTER (WHERE position_name = 'Goalkeeper'), 0), 2) AS "Goalkeeper", ROUND(COALESCE(SUM(d) FILTER (WHERE position_name = 'Left Back'), 0), 2) AS "Left Back",
  ROUND(COALESCE(SUM(d) FILTER (WHERE position_name = 'Center Forward'), 0), 2) AS "Center Forward" FROM r GROUP BY season_name""")
KINDS = {"pressures": "Pressure", "carries": "Carry", "shots": "Shot", "passes": "Pass"}
query("e10_yearly_style", lambda t: rounded(profiling.yearly_style(t.v_events, t.v_matches)), f"""
WITH y AS (SELECT YEAR(match_date::DATE)::INT AS year, COUNT(DISTINCT match_id) AS matches, {', '.join(f"COUNT(*) FILTER (WHERE type = '{k}') / COUNT(DISTINCT match_id)::DOUBLE AS {c}" for c, k in KINDS.items())}
  FROM v_events JOIN v_matches USING (match_id) WHERE YEAR(match_date::DATE) >= 2010 GROUP BY 1)
SELECT year, matches, {', '.join(f"ROUND({c}, 4) AS {c}_per_match, ROUND(COALESCE(({c} - MIN({c}) OVER ()) / NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 0), 4) AS {c}_scaled" for c in KINDS)} FROM y""")
query("e11_position_lifespan", lambda t: rounded(profiling.position_lifespan(t.v_lineups)), f"""
WITH {SPAN} SELECT position_name, ROUND(AVG(COALESCE(b, 95)), 4) AS mean_minutes, COUNT(*) AS "rows" FROM ls GROUP BY position_name""")
query("e12_location_histogram", lambda t: profiling.location_histogram(t.v_frames), """
SELECT LEAST(FLOOR(location_x * (40 / 120e0)), 39)::INT AS x_bin, LEAST(FLOOR(location_y * (30 / 80e0)), 29)::INT AS y_bin, COUNT(*) AS n FROM v_frames WHERE location_x BETWEEN 0 AND 120 AND location_y BETWEEN 0 AND 80 GROUP BY ALL""")
query("e12_busiest_match", lambda t: profiling.busiest_match(t.v_frames), "SELECT match_id, COUNT(*) AS n FROM v_frames GROUP BY match_id ORDER BY n DESC, match_id LIMIT 1")
query("e13_cross_dataset", lambda t: profiling.cross_dataset(t.v_markets, t.v_matches), """
SELECT 'markets' AS dataset, COUNT(*) AS "rows", MIN(created_at)::DATE AS first, MAX(created_at)::DATE AS last FROM v_markets UNION ALL SELECT 'matches', COUNT(*), MIN(match_date::DATE), MAX(match_date::DATE) FROM v_matches""")
query("e13_dataset_overview", lambda t: profiling.dataset_overview(t.v_matches, t.v_events, t.v_lineups), """
SELECT (SELECT COUNT(*) FROM v_matches) AS total_matches, (SELECT COUNT(DISTINCT competition) FROM v_matches) AS competitions, (SELECT COUNT(*) FROM v_events) AS total_events, (SELECT COUNT(DISTINCT type) FROM v_events) AS event_types,
  (SELECT ROUND(COUNT(location_x) * 100e0 / COUNT(*), 2) FROM v_events) AS location_coverage_pct, (SELECT COUNT(*) FROM v_lineups) AS lineup_rows, (SELECT COUNT(DISTINCT player_name) FROM v_lineups) AS unique_players""")
SEL = "SELECT * FROM v_matches WHERE competition = 'La Liga' AND (home_team = 'T4' OR away_team = 'T4')"
query("e14_dashboard_stats", lambda t: profiling.dashboard_stats(t.v_matches, t.v_events, t.v_lineups, "La Liga", None, "T4"), f"""
WITH s AS ({SEL}) SELECT COUNT(*) AS total_matches, (SELECT COUNT(*) FROM v_events WHERE match_id IN (SELECT match_id FROM s)) AS total_events,
  (SELECT COUNT(DISTINCT player_name) FROM v_lineups WHERE match_id IN (SELECT match_id FROM s)) AS unique_players, ROUND(AVG(home_score + away_score), 2) AS avg_goals FROM s""")
query("e14_dashboard_results", lambda t: profiling.dashboard_results(t.v_matches, None, "2022"), """
SELECT CASE WHEN home_score > away_score THEN 'Home Win' WHEN away_score > home_score THEN 'Away Win' ELSE 'Draw' END AS result, COUNT(*) AS count FROM v_matches WHERE season_name = '2022' GROUP BY 1""")
query("e14_dashboard_goals", lambda t: profiling.dashboard_goals(t.v_matches), "SELECT competition, ROUND(AVG(home_score + away_score), 4) AS avg_goals FROM v_matches GROUP BY competition")
query("e15_gender_profile", lambda t: profiling.gender_profile(t.v_matches), """
WITH l AS (SELECT gender, home_team AS team FROM v_matches UNION ALL SELECT gender, away_team FROM v_matches), u AS (SELECT gender, COUNT(DISTINCT team) AS unique_teams FROM l GROUP BY gender)
SELECT gender, COUNT(*) AS matches, MIN(match_date) AS first_date, MAX(match_date) AS last_date, COUNT(DISTINCT competition) AS competitions, ROUND(AVG(home_score + away_score), 2) AS goals_per_match, ANY_VALUE(unique_teams) AS unique_teams,
  ROUND(COUNT(*) * 100e0 / (SELECT COUNT(*) FROM v_matches), 1) AS share_pct FROM v_matches JOIN u USING (gender) GROUP BY gender""")
query("e16_temporal_bias", lambda t: profiling.temporal_bias(t.v_matches), """
WITH y AS (SELECT YEAR(match_date::DATE)::INT AS year, COUNT(*) AS matches FROM v_matches GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY matches DESC, year)::INT AS rank, SUM(matches) OVER () AS tot FROM y)
SELECT year, matches, rank, ROUND(matches * 100e0 / tot, 1) AS share_pct, ROUND(SUM(matches) OVER (ORDER BY rank) * 100e0 / tot, 1) AS cumulative_pct, rank <= 2 AS densest FROM r""")
