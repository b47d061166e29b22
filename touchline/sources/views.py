"""Football and market shaped views over the generic tables.

Every view is one SELECT over the given tables, in SQL that both Spark and DuckDB
read, so the same rows feed an operator and its oracle. Key spaces (matches, players,
markets) grow with the tables, and no view needs a shuffle to number its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# 400 events make a match; 8 make a possession of one event every two seconds.
V_EVENTS = """
SELECT
  'e' || CAST(event_id AS STRING) AS id, match_id, index_num, period, minute, second, ts_text AS timestamp,
  possession, team, player, type, play_pattern, location_x, location_y, position,
  CASE WHEN type = 'Pass' THEN end_x END AS pass_end_location_x,
  CASE WHEN type = 'Pass' THEN end_y END AS pass_end_location_y,
  CASE WHEN type = 'Pass' THEN CAST(event_id * 3 % 50 AS DOUBLE) END AS pass_length,
  CASE WHEN type = 'Pass' AND event_id % 5 = 0 THEN 'Incomplete' END AS pass_outcome,
  CASE WHEN type = 'Pass' AND event_id % 23 <> 0
       THEN team || '_P' || CAST((num + 1 + event_id % 5) % 14 AS STRING) END AS pass_recipient,
  CASE WHEN type = 'Carry' THEN end_x END AS carry_end_location_x,
  CASE WHEN type = 'Carry' THEN end_y END AS carry_end_location_y,
  CASE WHEN type = 'Shot' AND event_id % 41 <> 0 THEN (event_id * 11 % 97) / 97e0 END AS shot_statsbomb_xg,
  CASE WHEN type = 'Shot' THEN CASE WHEN event_id % 7 = 0 THEN 'Goal' ELSE 'Saved' END END AS shot_outcome,
  CASE WHEN type = 'Shot' THEN CASE WHEN event_id % 11 = 0 THEN 'Penalty' ELSE 'Open Play' END END AS shot_type,
  CASE WHEN type = 'Shot' AND index_num % 8 <> 1 AND event_id % 3 <> 0
       THEN 'e' || CAST(event_id - 1 AS STRING) END AS shot_key_pass_id,
  CASE WHEN event_id % 3 = 0 THEN TRUE END AS counterpress,
  CASE WHEN type = 'Duel' THEN CASE WHEN event_id % 2 = 0 THEN 'Won' ELSE 'Lost' END END AS duel_outcome,
  CASE WHEN type = 'Substitution'
       THEN team || '_P' || CAST((num + 7) % 14 AS STRING) END AS substitution_replacement_name,
  CASE WHEN type = 'Bad Behaviour'
       THEN CASE WHEN event_id % 3 = 0 THEN 'Red Card' ELSE 'Yellow Card' END END AS bad_behaviour_card,
  CASE WHEN type = 'Foul Committed' AND event_id % 5 = 0 THEN 'Second Yellow' END AS foul_committed_card
FROM (
  SELECT *, team || '_P' || CAST(num AS STRING) AS player,
    LPAD(CAST(CAST(FLOOR(clock / 3600) AS INT) AS STRING), 2, '0') || ':' ||
    LPAD(CAST(CAST(FLOOR(clock / 60) AS INT) % 60 AS STRING), 2, '0') || ':' ||
    LPAD(CAST(clock % 60 AS STRING), 2, '0') || '.' ||
    LPAD(CAST(event_id * 250 % 1000 AS STRING), 3, '0') AS ts_text,
    CAST(FLOOR(clock / 60) AS INT) AS minute, clock % 60 AS second,
    CASE num WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Left Back' WHEN 2 THEN 'Right Back' WHEN 3 THEN 'Center Back'
      WHEN 4 THEN 'Left Center Back' WHEN 5 THEN 'Center Defensive Midfield' WHEN 6 THEN 'Left Midfield'
      WHEN 7 THEN 'Center Midfield' WHEN 8 THEN 'Center Attacking Midfield' WHEN 9 THEN 'Left Wing'
      WHEN 10 THEN 'Right Wing' WHEN 11 THEN 'Center Forward' WHEN 12 THEN 'Secondary Striker' END AS position
  FROM (
    SELECT *,
      'T' || CAST(CASE WHEN user_id % 2 = 0 THEN match_id % 12
        ELSE (match_id % 12 + 1 + CAST(FLOOR(match_id / 12) AS INT) % 11) % 12 END AS STRING) AS team,
      CAST((user_id + CAST(FLOOR(event_id / 3) AS BIGINT)) % 14 AS INT) AS num,
      CAST(FLOOR((index_num - 1) / 8) AS INT) AS possession,
      CAST(FLOOR((index_num - 1) / 8) AS INT) * 112 + ((index_num - 1) % 8) * 2 + CAST(match_id * 13 % 50 AS INT) AS clock,
      CASE WHEN index_num <= 200 THEN 1 ELSE 2 END AS period,
      CASE
        WHEN index_num <= 16 THEN 'Starting XI' WHEN kind < 8 THEN 'Pass' WHEN kind < 12 THEN 'Carry'
        WHEN kind = 12 THEN 'Dribble' WHEN kind < 15 THEN 'Shot' WHEN kind = 15 THEN 'Interception'
        WHEN kind = 16 THEN 'Tackle' WHEN kind = 17 THEN 'Ball Recovery' WHEN kind = 18 THEN 'Duel'
        WHEN kind = 19 THEN 'Block' WHEN kind = 20 THEN 'Clearance' WHEN kind < 23 THEN 'Pressure'
        WHEN kind = 23 THEN 'Foul Committed' WHEN kind = 24 THEN 'Substitution' ELSE 'Bad Behaviour' END AS type,
      CASE WHEN event_id % 4 = 0 THEN 'From Corner' WHEN event_id % 7 = 1 THEN 'From Counter'
        ELSE 'Regular Play' END AS play_pattern,
      CASE WHEN event_id % 89 <> 0 THEN CAST(event_id * 37 % 121 AS DOUBLE) END AS location_x,
      CAST(event_id * 17 % 81 AS DOUBLE) AS location_y,
      CAST(event_id * 53 % 121 AS DOUBLE) AS end_x, CAST(event_id * 29 % 81 AS DOUBLE) AS end_y
    FROM (
      SELECT event_id, user_id, CAST(FLOOR(event_id / 400) AS INT) AS match_id,
        CAST(event_id % 400 AS INT) + 1 AS index_num, (event_id * 31 + user_id * 7) % 26 AS kind
      FROM events
    ) a
  ) b
) c
"""

V_MATCHES = """
SELECT match_id,
  'T' || CAST(h AS STRING) AS home_team,
  'T' || CAST((h + 1 + CAST(FLOOR(match_id / 12) AS INT) % 11) % 12 AS STRING) AS away_team,
  match_id * 7 % 5 AS home_score, match_id * 3 % 4 AS away_score,
  CASE match_id % 5 WHEN 0 THEN '2021/2022' WHEN 1 THEN '2022/2023' WHEN 2 THEN '2023/2024'
    WHEN 3 THEN '2022' ELSE '2024' END AS season_name,
  CASE match_id % 4 WHEN 0 THEN 'La Liga' WHEN 1 THEN 'Premier League' WHEN 2 THEN 'FIFA World Cup'
    ELSE 'UEFA Euro' END AS competition,
  CAST(2018 + match_id % 7 AS STRING) || '-0' || CAST(1 + match_id % 9 AS STRING) || '-'
    || CAST(10 + match_id * 5 % 19 AS STRING) AS match_date,
  CASE WHEN match_id % 3 = 0 THEN 'female' ELSE 'male' END AS gender
FROM (SELECT DISTINCT CAST(FLOOR(event_id / 400) AS INT) AS match_id,
        CAST(FLOOR(event_id / 400) AS INT) % 12 AS h FROM events) a
"""

V_LINEUPS = """
SELECT match_id, team_name, player_name, position_name,
  CASE WHEN num = 13 THEN CAST(NULL AS STRING) ELSE LPAD(CAST(CAST(FLOOR(lo / 60) AS INT) AS STRING), 2, '0')
    || ':' || LPAD(CAST(lo % 60 AS STRING), 2, '0') END AS from_time,
  CASE WHEN num % 2 = 1 THEN LPAD(CAST(CAST(FLOOR(hi / 60) AS INT) AS STRING), 2, '0')
    || ':' || LPAD(CAST(hi % 60 AS STRING), 2, '0') END AS to_time,
  CASE WHEN (match_id + num) % 9 = 0 THEN 'Yellow Card' WHEN (match_id + num) % 31 = 0 THEN 'Red Card' END AS card_type,
  num + 1 AS jersey_number,
  'Country' || CAST((match_id + num) % 6 AS STRING) AS country_name
FROM (
  SELECT match_id, team AS team_name, player AS player_name, position AS position_name,
    CAST(SPLIT_PART(player, 'P', 2) AS INT) AS num,
    MIN(minute * 60 + second) AS lo, MAX(minute * 60 + second) AS hi
  FROM v_events GROUP BY match_id, team, player, position
) a
"""

V_FRAMES = """
SELECT event_uuid, match_id, k = 0 AS actor, k = 1 AS teammate, k = 2 AND index_num % 5 = 0 AS keeper,
  CAST((index_num * 31 + k * 23) % 121 AS DOUBLE) AS location_x,
  CAST((index_num * 13 + k * 19) % 81 AS DOUBLE) AS location_y,
  CASE WHEN index_num % 4 <> 0 THEN '[0,0,120,80]' END AS visible_area
FROM (
  SELECT id AS event_uuid, match_id, index_num, UNNEST(RANGE(0, 5)) AS k
  FROM v_events WHERE type = 'Pass' AND index_num % 3 <> 0
) a
"""

# A player-season table: customers are players, order years are seasons.
V_PLAYER_SEASON = """
SELECT 'C' || CAST(o_custkey AS STRING) AS player, 'T' || CAST(o_custkey % 40 AS STRING) AS team,
  CAST(o_custkey AS BIGINT) AS player_id, season_year,
  CASE WHEN season_year % 2 = 0 THEN CAST(season_year AS STRING)
    ELSE CAST(season_year - 1 AS STRING) || '/' || CAST(season_year AS STRING) END AS season_name,
  CASE o_custkey % 9 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' WHEN 2 THEN 'FB' WHEN 3 THEN 'DM' WHEN 4 THEN 'CM'
    WHEN 5 THEN 'AM' WHEN 6 THEN 'W' WHEN 7 THEN 'FW' END AS archetype,
  CASE o_custkey % 4 WHEN 0 THEN 'La Liga' WHEN 1 THEN 'Premier League' WHEN 2 THEN 'FIFA World Cup'
    ELSE 'Eredivisie' END AS competition_name,
  n_orders * 90 + o_custkey % 90 AS minutes_played, n_orders AS matches,
  n_orders * 17 % 120 AS total_passes,
  CAST(n_urgent AS BIGINT) AS goals, CAST(cents % 700 AS DOUBLE) / 100e0 AS xg,
  CAST(cents % 977 AS DOUBLE) / 10e0 AS m_progression,
  CASE WHEN o_custkey % 7 <> 0 THEN CAST(cents % 389 AS DOUBLE) / 4e0 END AS m_control,
  CAST(cents % 53 AS DOUBLE) AS m_defence
FROM (
  SELECT o_custkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS season_year, COUNT(*) AS n_orders,
    SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS n_urgent,
    SUM(CAST(ROUND(o_totalprice) AS BIGINT)) AS cents
  FROM orders GROUP BY o_custkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT)
) a
"""

V_TOKENS = """
SELECT DISTINCT 'M' || CAST(user_id AS STRING) AS market_id,
  'M' || CAST(user_id AS STRING) || '-' || event_type AS token_id,
  CASE event_type WHEN 'view' THEN 'Yes' WHEN 'click' THEN 'No' ELSE event_type END AS outcome
FROM events WHERE NOT (event_type = 'view' AND user_id % 6 = 0)
"""

V_ODDS = """
SELECT 'M' || CAST(user_id AS STRING) AS market_id,
  'M' || CAST(user_id AS STRING) || '-' || event_type AS token_id, ts AS timestamp,
  CAST(event_id * 73 % 1000 AS DOUBLE) / 1000e0 AS price, event_id
FROM events
"""

V_MARKETS = """
SELECT 'M' || CAST(user_id AS STRING) AS market_id, user_id,
  CASE user_id % 6 WHEN 0 THEN 'Will T' || CAST(user_id % 12 AS STRING) || ' win the world cup?'
    WHEN 1 THEN 'Will Customer' || CAST(user_id AS STRING) || ' be the top goalscorer at Euro 2024?'
    WHEN 2 THEN 'T' || CAST(user_id % 12 AS STRING) || ' vs T' || CAST((user_id + 5) % 12 AS STRING) || ' winner'
    WHEN 3 THEN 'Will any player be sent off in the Copa America final?'
    WHEN 4 THEN 'Champions League: who reaches the semi-final?'
    ELSE 'Premier League relegation ' || CAST(user_id % 12 AS STRING) END AS question,
  'slug-' || CASE user_id % 3 WHEN 0 THEN 'euro-2024' WHEN 1 THEN 'copa-america' ELSE 'league' END
    || '-' || CAST(user_id AS STRING) AS slug,
  'ev-' || CAST(user_id % 20 AS STRING) AS event_slug,
  volume, TRUE AS active, user_id % 2 = 0 AS closed, created_at, end_date
FROM (
  SELECT user_id, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100e0 AS volume,
    MIN(ts) AS created_at, MAX(ts) AS end_date
  FROM events GROUP BY user_id
) a
"""

V_TRADES = """
SELECT 'O' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS trade_id,
  'M' || CAST(l_orderkey % 2000 AS STRING) AS market_id,
  'M' || CAST(l_orderkey % 2000 AS STRING) || '-' ||
    CASE l_linenumber % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error'
      WHEN 3 THEN 'signup' ELSE 'purchase' END AS token_id,
  l_shipdate AS timestamp, l_discount AS price, l_quantity AS size,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side
FROM lineitem
"""

V_ROSTERS = """
SELECT 'N' || CAST(c_nationkey AS STRING) AS country, 'C' || CAST(c_custkey AS STRING) AS player,
  c_mktsegment || CAST(c_custkey % 9 AS STRING) AS club, CAST(18 + c_custkey % 20 AS INT) AS age,
  CASE c_custkey % 8 WHEN 0 THEN 'CB' WHEN 1 THEN 'FB' WHEN 2 THEN 'DM' WHEN 3 THEN 'CM' WHEN 4 THEN 'AM'
    WHEN 5 THEN 'W' WHEN 6 THEN 'FW' ELSE 'CB' END AS position_archetype,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 37 % 997 AS DOUBLE) / 9.97e0 END AS final_score
FROM customer
"""

V_COUNTRIES = """
SELECT 'N' || CAST(n_nationkey AS STRING) AS country, n_nationkey * 7 % 85 + 1 AS fifa_rank,
  n_nationkey % 14 + 0.5e0 AS coach_years, n_nationkey * 3 % 24 AS wc_appearances,
  CASE WHEN n_nationkey % 5 = 0 THEN 1.05e0 ELSE 1e0 END AS confederation_bonus,
  CASE n_nationkey % 4 WHEN 0 THEN 'UEFA' WHEN 1 THEN 'CONMEBOL' WHEN 2 THEN 'CAF' ELSE 'AFC' END AS confederation,
  2012 + n_nationkey % 14 AS manager_since, n_nationkey % 6 AS cluster,
  CASE WHEN n_nationkey % 7 <> 0 THEN CASE n_nationkey % 6 WHEN 0 THEN 'Possession Dominant' WHEN 1 THEN 'Low Intensity'
    WHEN 2 THEN 'High Press / High Output' WHEN 3 THEN 'Compact Transition' WHEN 4 THEN 'Mid-Block Reactive'
    ELSE 'Moderate Possession' END END AS archetype,
  CASE WHEN n_nationkey % 5 = 1 THEN 0e0 ELSE (n_nationkey * 13 % 100) / 100e0 END AS gmm_confidence
FROM nation
"""

# Match-level team metrics: one row per customer and year.
V_TEAM_MATCH = """
SELECT player_id * 10 + season_year % 10 AS match_id, team, season_year, competition_name, m_progression + 1e0 AS ppda,
  1e0 + m_defence / 26e0 AS defensive_line_height, total_passes * 0.8e0 AS field_tilt_pct,
  CAST(minutes_played % 61 + 20 AS DOUBLE) AS possession_pct, CAST(matches * 3 + goals AS BIGINT) AS progressive_carries,
  CAST(total_passes % 37 + 1 AS BIGINT) AS progressive_passes, m_control AS epr, xg AS npxg, xg + 0.1e0 AS total_xg,
  xg / (matches + 1) AS avg_xg_per_buildup_possession
FROM v_player_season
"""

# Four features, each the sum of a quarter of the 64 dimensions, added in one order by both engines.
V_FEATURES = "SELECT vec_id, label, " + ", ".join(
    " + ".join(f"CAST(LIST_EXTRACT(embedding, {16 * f + i}) AS DOUBLE)" for i in range(1, 17)) + f" AS f{f + 1}" for f in range(4)) + " FROM embeddings"

# view name -> (SQL, names it reads)
VIEWS = {
    "v_events": (V_EVENTS, ["events"]),
    "v_matches": (V_MATCHES, ["events"]),
    "v_lineups": (V_LINEUPS, ["v_events"]),
    "v_frames": (V_FRAMES, ["v_events"]),
    "v_player_season": (V_PLAYER_SEASON, ["orders"]),
    "v_tokens": (V_TOKENS, ["events"]),
    "v_odds": (V_ODDS, ["events"]),
    "v_markets": (V_MARKETS, ["events"]),
    "v_trades": (V_TRADES, ["lineitem"]),
    "v_rosters": (V_ROSTERS, ["customer"]),
    "v_countries": (V_COUNTRIES, ["nation"]),
    "v_team_match": (V_TEAM_MATCH, ["v_player_season"]),
    "v_features": (V_FEATURES, ["embeddings"]),
}

_READ: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view, as a lazy DataFrame. Nothing is registered in the session."""
    if name in BASE:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _READ:  # the schema is read from the footer once, not once per query
            _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return _READ[key]
    sql, reads = VIEWS[name]
    sql = sql.replace("UNNEST(RANGE(0, 5))", "EXPLODE(SEQUENCE(0, 4))").replace("LIST_EXTRACT(", "ELEMENT_AT(")
    for source in reads:
        sql = _reference(sql, source)
    return spark.sql(sql, **{source: table(spark, sf_dir, source) for source in reads})


def _reference(sql: str, source: str) -> str:
    return sql.replace(f"FROM {source}", f"FROM {{{source}}}")


def with_views(sql: str) -> str:
    """Prefix a query with the CTEs of the views it names, in dependency order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, (body, _) in VIEWS.items():
            if name in text and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
