"""Queries for markets, pricing and names in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.registry import f_tail_sql, query
from touchline.functions.columns import rounded
from touchline.operators import markets, matching


def _summary(t):
    return t.v_tokens.groupBy("market_id").agg((F.count("*") + F.when(F.substring("market_id", -1, 1) == "7", 1).otherwise(0)).alias("token_count")).filter("market_id NOT LIKE '%9'")


def _event_stats(t):
    return t.v_markets.select("event_slug").distinct().unionByName(t.region.select(F.col("r_name").alias("event_slug")))


SUMMARY = """sm AS (SELECT market_id, COUNT(*) + CASE WHEN RIGHT(market_id, 1) = '7' THEN 1 ELSE 0 END AS token_count FROM v_tokens WHERE market_id NOT LIKE '%9' GROUP BY market_id),
 es AS (SELECT DISTINCT event_slug FROM v_markets UNION ALL SELECT r_name FROM region)"""
query("q1_integrity_report", lambda t: markets.integrity_report(t.v_markets, t.v_tokens, t.v_trades, t.v_odds, _summary(t), _event_stats(t)), f"""
WITH {SUMMARY}, c AS (
 SELECT 'tokens reference missing markets' AS "check", COUNT(*) AS bad FROM v_tokens WHERE market_id NOT IN (SELECT market_id FROM v_markets)
 UNION ALL SELECT 'markets missing tokens', COUNT(*) FROM v_markets WHERE market_id NOT IN (SELECT market_id FROM v_tokens)
 UNION ALL SELECT 'trades reference missing markets', COUNT(*) FROM v_trades WHERE market_id NOT IN (SELECT market_id FROM v_markets)
 UNION ALL SELECT 'trades reference missing tokens', COUNT(*) FROM v_trades WHERE token_id NOT IN (SELECT token_id FROM v_tokens)
 UNION ALL SELECT 'trades have valid pairs', COUNT(*) FROM (SELECT DISTINCT market_id, token_id FROM v_trades EXCEPT SELECT market_id, token_id FROM v_tokens) z
 UNION ALL SELECT 'odds reference missing markets', COUNT(*) FROM v_odds WHERE market_id NOT IN (SELECT market_id FROM v_markets)
 UNION ALL SELECT 'odds reference missing tokens', COUNT(*) FROM v_odds WHERE token_id NOT IN (SELECT token_id FROM v_tokens)
 UNION ALL SELECT 'odds have valid pairs', COUNT(*) FROM (SELECT DISTINCT market_id, token_id FROM v_odds EXCEPT SELECT market_id, token_id FROM v_tokens) z
 UNION ALL SELECT 'summary references missing markets', COUNT(*) FROM sm WHERE market_id NOT IN (SELECT market_id FROM v_markets)
 UNION ALL SELECT 'markets missing summary rows', COUNT(*) FROM v_markets WHERE market_id NOT IN (SELECT market_id FROM sm)
 UNION ALL SELECT 'events not found in markets', COUNT(*) FROM es WHERE event_slug NOT IN (SELECT event_slug FROM v_markets)
 UNION ALL SELECT 'summary token count matches', COUNT(*) FROM sm LEFT JOIN (SELECT market_id, COUNT(*) AS n FROM v_tokens GROUP BY market_id) n USING (market_id) WHERE n IS NULL OR n <> token_count)
SELECT *, CASE WHEN bad = 0 THEN 'OK' ELSE 'FAIL' END AS status FROM c""")
query("q1_orphan_trades", lambda t: markets.orphans(t.v_trades, t.v_tokens, ["market_id", "token_id"]).select("trade_id", "market_id", "token_id"), """
SELECT trade_id, market_id, token_id FROM v_trades r WHERE NOT EXISTS (SELECT 1 FROM v_tokens k WHERE k.market_id = r.market_id AND k.token_id = r.token_id)""")

query("q2_markets_per_month", lambda t: markets.markets_per_month(t.v_trades.select("market_id", F.col("timestamp").alias("created_at"))), """
SELECT DATE_TRUNC('month', timestamp)::DATE AS created_month, COUNT(*) AS market_count FROM v_trades GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
query("q2_event_lifetime", lambda t: rounded(markets.event_lifetime(t.v_markets).drop("first_market", "last_market")), """
SELECT event_slug, COUNT(*) AS market_count, ROUND(SUM(volume), 4) AS total_volume, FLOOR(EPOCH(DATE_TRUNC('second', MAX(end_date)) - DATE_TRUNC('second', MIN(created_at))) / 86400)::INT AS duration_days
FROM v_markets GROUP BY event_slug""")
query("q2_top_markets", lambda t: markets.top_markets(t.v_markets).select("market_id", "volume"), """
SELECT market_id, volume FROM v_markets ORDER BY volume DESC, market_id LIMIT 15""")
query("q3_trades_overview", lambda t: rounded(markets.market_overview(t.v_trades, ["market_id", "token_id"], ["size"])), """
SELECT COUNT(*) AS "rows", COUNT(DISTINCT market_id) AS n_market_id, COUNT(DISTINCT token_id) AS n_token_id, ROUND(SUM(size), 4) AS sum_size FROM v_trades""")
query("q3_markets_overview", lambda t: rounded(markets.market_overview(t.v_markets, ["market_id", "event_slug"], ["volume"], ["active", "closed"]), 2), """
SELECT COUNT(*) AS "rows", COUNT(DISTINCT market_id) AS n_market_id, COUNT(DISTINCT event_slug) AS n_event_slug, ROUND(SUM(volume), 2) AS sum_volume,
  COUNT(*) FILTER (WHERE active) AS n_active, COUNT(*) FILTER (WHERE closed) AS n_closed FROM v_markets""")



def _market_tables(t):
    trades = t.v_trades.groupBy("market_id").agg(F.count("*").alias("trade_count"), F.min("timestamp").alias("first_trade"), F.max("timestamp").alias("last_trade"))
    return {
        "markets": t.v_markets.withColumn("category", F.concat(F.lit("c"), F.col("user_id") % 4)), "tokens": t.v_tokens, "trades": t.v_trades, "odds": t.v_odds,
        "events": markets.event_lifetime(t.v_markets), "summary": trades.withColumn("active", F.col("trade_count") % 2 == 0)}


def _report_sql(kind, source):
    plan, parts = markets.REPORTS[kind], [("overview", "rows", "COUNT(*)")]
    parts += [("overview", f"distinct {c}", f"COUNT(DISTINCT {c})") for c in plan.get("distinct", [])] + [("overview", f"total {c}", f"SUM({c})") for c in plan.get("sums", [])]
    parts += [("overview", c, f"COUNT(*) FILTER (WHERE {c})") for c in plan.get("flags", [])]
    parts += [("overview", f"{n} {c}", f"FLOOR(EPOCH({f}({c})))") for c in plan.get("times", []) for n, f in (("first", "MIN"), ("last", "MAX"))]
    for c in plan.get("stats", []):
        parts += [(f"distribution of {c}", i, v) for i, v in (
            ("count", f"COUNT({c})"), ("null_count", f"COUNT(*) - COUNT({c})"), ("mean", f"AVG({c})"), ("std", f"STDDEV_SAMP({c})"), ("min", f"MIN({c})"),
            ("q25", f"QUANTILE_CONT({c}, 0.25)"), ("q50", f"QUANTILE_CONT({c}, 0.5)"), ("q75", f"QUANTILE_CONT({c}, 0.75)"), ("max", f"MAX({c})"))]
    rows = [f"SELECT '{s}' AS section, '{i}' AS item, ROUND(({v})::DOUBLE, 4) AS value FROM src" for s, i, v in parts]
    rows += [f"SELECT '{c}', {c}, COUNT(*)::DOUBLE FROM src GROUP BY {c}" for c in plan.get("counts", [])]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(rows)


for _kind, _source in {
    "markets": "SELECT *, 'c' || user_id % 4 AS category FROM v_markets", "tokens": "SELECT * FROM v_tokens", "trades": "SELECT * FROM v_trades", "odds": "SELECT * FROM v_odds",
    "events": "SELECT event_slug, COUNT(*) AS market_count, SUM(volume) AS total_volume FROM v_markets GROUP BY event_slug",
    "summary": "SELECT *, trade_count % 2 = 0 AS active FROM (SELECT market_id, COUNT(*) AS trade_count, MIN(timestamp) AS first_trade, MAX(timestamp) AS last_trade FROM v_trades GROUP BY market_id) z",
}.items():
    query(f"q3_{_kind}_report", lambda t, kind=_kind: rounded(markets.table_report(_market_tables(t)[kind], kind)), _report_sql(_kind, _source))

query("q3_top_summary", lambda t: markets.top_markets(_market_tables(t)["summary"], "trade_count").select("market_id", "trade_count"), """
SELECT market_id, COUNT(*) AS trade_count FROM v_trades GROUP BY market_id ORDER BY trade_count DESC, market_id LIMIT 15""")
query("q3_top_events", lambda t: rounded(_market_tables(t)["events"].orderBy(F.desc_nulls_last("total_volume"), "event_slug").limit(15).select(
    "event_slug", "market_count", "total_volume")), """
SELECT event_slug, COUNT(*) AS market_count, ROUND(SUM(volume), 4) AS total_volume FROM v_markets GROUP BY event_slug ORDER BY SUM(volume) DESC, event_slug LIMIT 15""")

MAIN = "mt AS (SELECT market_id, ARG_MIN(token_id, (NOT (LOWER(outcome) LIKE '%yes%'), token_id)) AS token_id FROM v_tokens GROUP BY market_id)"
query("q4_final_market_odds", lambda t: markets.final_market_odds(t.v_odds, t.v_tokens).drop("last_seen"), f"""
WITH {MAIN} SELECT market_id, token_id, ARG_MAX(price, (timestamp, price)) AS final_odds FROM v_odds JOIN mt USING (market_id, token_id) GROUP BY market_id, token_id""")
query("q4_last_snapshot", lambda t: markets.last_snapshot(t.v_odds), """
SELECT market_id, ARG_MAX(token_id, (timestamp, token_id)) AS token_id, ARG_MAX(price, (timestamp, token_id)) AS final_odds FROM v_odds GROUP BY market_id""")
query("q5_main_token", lambda t: markets.main_token(t.v_tokens), f"WITH {MAIN} SELECT * FROM mt")
query("q6_team_odds", lambda t: markets.team_odds(t.v_markets.select("market_id", F.when(F.col("user_id") % 2 == 0, "SIGN").otherwise("purch").alias("team")), t.v_odds, t.v_tokens), """
WITH n AS (SELECT market_id, CASE WHEN user_id % 2 = 0 THEN 'SIGN' ELSE 'purch' END AS team FROM v_markets),
 k AS (SELECT market_id, team, MIN(token_id) AS token_id FROM n JOIN v_tokens USING (market_id) WHERE CONTAINS(LOWER(outcome), LOWER(team)) GROUP BY ALL)
SELECT market_id, token_id, team, ARG_MAX(price, (timestamp, price)) AS final_odds FROM k JOIN v_odds USING (market_id, token_id) GROUP BY ALL""")

# ---- names in text --------------------------------------------------------------------

EDGE = r"[^\p{L}\p{N}_]"


def _text_dictionary(t):
    return t.benchmark.select(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 3)).alias("name"), (F.col("item_id") % 2 == 0).alias("strict")).dropDuplicates(["name"])


DICT = "dc AS (SELECT DISTINCT SPLIT_PART(text, ' ', 1) || ' ' || SPLIT_PART(text, ' ', 2) || ' ' || SPLIT_PART(text, ' ', 3) AS name FROM benchmark)"


def _found(t: str, n: str) -> str:
    # the plain search comes first, so that the pattern is only compiled for pairs that can match
    return f"CASE WHEN CONTAINS(LOWER({t}), LOWER({n})) THEN REGEXP_MATCHES(LOWER({t}), '(^|{EDGE})' || REGEXP_ESCAPE(LOWER({n})) || '($|{EDGE})') ELSE FALSE END"


query("q7_teams_in_documents", lambda t: matching.teams_in_text(t.documents, "doc_id", "text", _text_dictionary(t).withColumn("strict", F.lit(True))), f"""
WITH {DICT} SELECT doc_id, name FROM documents JOIN dc ON {_found(t='documents.text', n='name')}""")
query("q7_club_names_in_documents", lambda t: matching.teams_in_text(t.documents, "doc_id", "text", _text_dictionary(t).withColumn("strict", F.lit(False))), f"""
WITH {DICT}, p AS (SELECT name, LIST_FILTER(STRING_SPLIT(LOWER(name), ' '), lambda x: LENGTH(x) >= 5) AS ps FROM dc)
SELECT DISTINCT doc_id, name FROM documents JOIN p ON {_found(t='documents.text', n='name')}
  OR (LENGTH(ps) > 0 AND {_found(t='documents.text', n="COALESCE(ps[1], '')")} AND (LENGTH(ps) < 2 OR {_found(t='documents.text', n="COALESCE(ps[2], '')")})
    AND (LENGTH(ps) < 3 OR {_found(t='documents.text', n="COALESCE(ps[3], '')")}))""")
query("q7_teams_in_markets", lambda t: matching.names_per_text(t.v_markets.select("market_id", "question", "slug"), "market_id", *[
    matching.teams_in_text(t.v_markets, "market_id", c, t.v_matches.select(F.col("home_team").alias("name"), F.lit(True).alias("strict"))) for c in ("question", "slug")]).select(
    "market_id", F.array_join("names", "; ").alias("names"), "num_names"), f"""
WITH n AS (SELECT DISTINCT home_team AS name FROM v_matches), f AS (SELECT market_id, name FROM v_markets JOIN n ON {_found(t='question', n='name')} OR {_found(t='slug', n='name')}),
 g AS (SELECT market_id, STRING_AGG(name, '; ' ORDER BY name) AS names, COUNT(*)::INT AS k FROM f GROUP BY market_id)
SELECT market_id, COALESCE(names, '') AS names, COALESCE(k, 0) AS num_names FROM v_markets LEFT JOIN g USING (market_id)""")


def _person_dictionary(t):
    w = F.split("text", " ")
    return t.benchmark.select(F.regexp_replace(F.concat_ws(" ", w[0], w[1], w[2], w[4]), r"[^\p{L} ]", "").alias("name")).distinct()


def _turns(t):
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")


def _persons_oracle(key: str, source: str) -> str:
    """Words with their character offsets stand in for the proximity pattern."""
    return f"""
WITH w AS (SELECT STRING_SPLIT(text, ' ') AS w FROM benchmark), n AS (SELECT DISTINCT REGEXP_REPLACE(w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[5], '[^\\p{{L}} ]', '', 'g') AS name FROM w),
 p AS (SELECT name, LOWER(STRING_SPLIT(name, ' ')[1]) AS a, LOWER(STRING_SPLIT(name, ' ')[-1]) AS b FROM n), c AS ({source}),
 k AS (SELECT {key}, UNNEST(STRING_SPLIT_REGEX(LOWER(text), '{EDGE}')) AS tok, UNNEST(RANGE(1, 1 + LENGTH(STRING_SPLIT_REGEX(LOWER(text), '{EDGE}')))) AS i FROM c),
 o AS (SELECT {key}, tok, SUM(LENGTH(tok) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) - LENGTH(tok) AS pos FROM k),
 ends AS (SELECT DISTINCT a AS e FROM p UNION SELECT b FROM p), f AS (SELECT {key}, tok, pos FROM o JOIN ends ON tok = e)
SELECT {key}, name FROM c JOIN p ON {_found('text', 'name')}
UNION SELECT x.{key}, name FROM p JOIN f x ON x.tok = a JOIN f y ON y.{key} = x.{key} AND y.tok = b AND ABS(x.pos - y.pos) <= 50"""


query("q8_players_in_documents", lambda t: matching.players_in_text(t.documents, "doc_id", "text", _person_dictionary(t)),
      _persons_oracle("doc_id", "SELECT doc_id, text FROM documents"))
query("q8_players_in_conversations", lambda t: matching.players_in_text(_turns(t), "turn_id", "text", _person_dictionary(t)),
      _persons_oracle("turn_id", "SELECT conv_id || '-' || turn AS turn_id, text FROM conversations"))


def _queries(t):
    return t.supplier.select(F.concat_ws(" ", F.element_at(F.split("s_name", "#"), 2), F.lit("ring"), F.when(F.col("s_suppkey") % 2 == 0, "steel").otherwise("small")).alias("query")).unionByName(
        t.part.select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.element_at(F.split("p_name", " "), 1), F.lit("extra")).alias("query")))


def _part_names(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("overall_quality"))


query("q10_best_name_match", lambda t: matching.best_name_match(_queries(t), _part_names(t)), """
WITH q AS (SELECT DISTINCT query FROM (SELECT SPLIT_PART(s_name, '#', 2) || ' ring ' || CASE WHEN s_suppkey % 2 = 0 THEN 'steel' ELSE 'small' END AS query FROM supplier
   UNION ALL SELECT SPLIT_PART(p_name, ' ', 2) || ' ' || SPLIT_PART(p_name, ' ', 1) || ' extra' FROM part) z),
 n AS (SELECT p_name AS name, MAX(p_retailprice) AS s FROM part GROUP BY p_name),
 p AS (SELECT query, name, s, LIST_DISTINCT(STRING_SPLIT(LOWER(query), ' ')) AS a, LIST_DISTINCT(STRING_SPLIT(LOWER(name), ' ')) AS b FROM q JOIN n ON TRUE),
 r AS (SELECT query, name, s, CASE WHEN LOWER(query) = LOWER(name) THEN 1 WHEN LIST_HAS_ALL(b, a) THEN 2 WHEN LIST_HAS_ALL(a, b) THEN 3 WHEN LENGTH(LIST_INTERSECT(a, b)) / LENGTH(a)::DOUBLE >= 0.6 THEN 4 END AS rule FROM p)
SELECT query, ARG_MIN(name, (rule, -s, name)) AS name, MIN(rule)::INT AS rule FROM r WHERE rule IS NOT NULL GROUP BY query""")


def _typos(t):
    return t.customer.select(F.concat_ws(" ", F.substring("c_mktsegment", 1, 7), F.concat(F.lit("c"), F.col("c_custkey") % 97)).alias("query")).distinct()


def _segments(t):
    return t.customer.select(F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("c"), F.col("c_custkey") % 31)).alias("name")).distinct()


query("q9_fuzzy_name_match", lambda t: matching.fuzzy_name_match(_typos(t), _segments(t)), """
WITH q AS (SELECT DISTINCT LEFT(c_mktsegment, 7) || ' c' || (c_custkey % 97) AS query FROM customer), n AS (SELECT DISTINCT c_mktsegment || ' c' || (c_custkey % 31) AS name FROM customer),
 k AS (SELECT query, name, LIST_SORT(LIST_DISTINCT(STRING_SPLIT(LOWER(query), ' '))) AS a, LIST_SORT(LIST_DISTINCT(STRING_SPLIT(LOWER(name), ' '))) AS b FROM q JOIN n ON TRUE),
 s AS (SELECT query, name, GREATEST(ROUND(100 * (1 - LEVENSHTEIN(ARRAY_TO_STRING(a, ' '), ARRAY_TO_STRING(b, ' ')) / GREATEST(LENGTH(ARRAY_TO_STRING(a, ' ')), LENGTH(ARRAY_TO_STRING(b, ' ')))::DOUBLE), 0),
   CASE WHEN (LENGTH(a) >= 2 AND LIST_HAS_ALL(b, a)) OR (LENGTH(b) >= 2 AND LIST_HAS_ALL(a, b)) THEN 90 ELSE 0 END) AS score FROM k)
SELECT query, ARG_MIN(name, (-score, name)) AS name, MAX(score) AS score FROM s WHERE score >= 80 GROUP BY query""")

CONTAINS_ANY = lambda col, ks: "(" + " OR ".join(f"CONTAINS({col}, '{k}')" for k in ks) + ")"
INTERNATIONAL = ["euro 2024", "euro2024", "uefa euro", "copa america", "copa américa", "afcon", "african cup", "africa cup", "olympic", "world cup", "fifa", "nations league", "tournament", "qualify", "qualification"]
CLUB = ["champions league", "ucl", "europa league", "uel", "conference league", "bundesliga", "premier league", "la liga", "serie a", "ligue 1", "epl", "pl"]
TXT = "tx AS (SELECT *, LOWER(question || ' ' || slug) AS t FROM v_markets)"
query("q11_market_context", lambda t: t.v_markets.select("market_id", matching.market_context(F.col("question"), F.col("slug")).alias("context")), f"""
WITH {TXT} SELECT market_id, CASE WHEN {CONTAINS_ANY('t', INTERNATIONAL)} THEN 'international' WHEN {CONTAINS_ANY('t', CLUB)} THEN 'club'
  WHEN {CONTAINS_ANY('t', ['vs', 'versus', 'beat', 'win on', 'draw'])} THEN 'match_market' ELSE 'unknown' END AS context FROM tx""")
OLYMPIC = "end_date >= TIMESTAMP '2024-07-24' AND end_date <= TIMESTAMP '2024-08-10'"
query("q11_tournament_from_text", lambda t: t.v_markets.select("market_id", matching.tournament_from_text(F.col("question"), F.col("slug"), F.col("end_date")).alias("tournament")), f"""
WITH {TXT} SELECT market_id, CASE WHEN CONTAINS(t, 'euro 2024') THEN 'UEFA Euro 2024' WHEN {CONTAINS_ANY('t', ['copa america', 'copa américa'])} THEN 'Copa America 2024'
  WHEN {CONTAINS_ANY('t', ['afcon', 'african cup of nations', 'africa cup of nations'])} THEN 'AFCON 2024' WHEN CONTAINS(t, 'gold') AND CONTAINS(t, 'football') AND {OLYMPIC} THEN 'Olympics 2024'
  WHEN {CONTAINS_ANY('t', ['champions league', 'ucl'])} THEN 'Champions League' WHEN {CONTAINS_ANY('t', ['europa league', 'uel'])} THEN 'Europa League' WHEN CONTAINS(t, 'win the bundesliga') THEN '1. Bundesliga'
  WHEN CONTAINS(t, 'mls cup') THEN 'MLS' ELSE 'unknown' END AS tournament FROM tx""")
query("q11_tournament_final", lambda t: t.v_markets.select("market_id", matching.tournament_final(F.concat("question", F.when(F.col("user_id") % 4 == 1, " ghana").otherwise("")), F.col("slug"), F.col("end_date")).alias("tournament")), f"""
WITH tx AS (SELECT *, LOWER(question || CASE WHEN user_id % 4 = 1 THEN ' ghana' ELSE '' END || ' ' || slug) AS t FROM v_markets) SELECT market_id, CASE WHEN {CONTAINS_ANY('t', ['euro 2024', 'european championship'])} THEN 'UEFA Euro 2024'
  WHEN {CONTAINS_ANY('t', ['copa america', 'copa américa'])} THEN 'Copa America 2024' WHEN {CONTAINS_ANY('t', ['afcon', 'african cup of nations', 'africa cup of nations'])} THEN 'AFCON 2024' WHEN CONTAINS(t, 'win the bundesliga') THEN '1. Bundesliga'
  WHEN end_date >= TIMESTAMP '2024-01-13' AND end_date <= TIMESTAMP '2024-02-11' AND {CONTAINS_ANY('t', ['ghana', 'africa'])} THEN 'AFCON 2024'
  WHEN {CONTAINS_ANY('t', ['champions league', 'ucl'])} THEN 'Champions League' WHEN CONTAINS(t, 'europa league') THEN 'Europa League'
  WHEN (CONTAINS(t, 'olympic') OR (CONTAINS(t, 'gold') AND CONTAINS(t, 'football'))) AND {OLYMPIC} THEN 'Olympics 2024' WHEN CONTAINS(t, 'mls') THEN 'MLS' ELSE 'unknown' END AS tournament FROM tx""")
query("q11_market_type", lambda t: t.v_markets.select("market_id", matching.market_type(F.col("question"), F.col("user_id") % 4).alias("market_type"), matching.player_market_type(F.col("question")).alias("player_market")), f"""
WITH b AS (SELECT market_id, LOWER(question) AS q, user_id % 4 AS n FROM v_markets) SELECT market_id, CASE WHEN {CONTAINS_ANY('q', ['scorer', 'player of', 'golden boot'])} THEN 'player_prop'
  WHEN n = 2 THEN CASE WHEN CONTAINS(q, 'draw') THEN 'match_draw' WHEN {CONTAINS_ANY('q', ['vs', 'beat', 'win', 'advance'])} THEN 'match_winner' ELSE 'match_other' END
  WHEN n = 1 THEN CASE WHEN {CONTAINS_ANY('q', ['win', 'champion', 'qualify', 'gold', 'medal', 'advance to', 'reach'])} THEN 'tournament_future' WHEN {CONTAINS_ANY('q', ['vs', 'beat'])} THEN 'match_incomplete' ELSE 'other' END
  WHEN n = 0 THEN 'no_teams' ELSE 'unknown' END AS market_type,
  CASE WHEN {CONTAINS_ANY('q', ['top scorer', 'golden boot'])} THEN 'top_scorer' WHEN {CONTAINS_ANY('q', ['player of the tournament', 'player of tournament'])} THEN 'player_of_tournament' ELSE 'other' END AS player_market FROM b""")
query("q12_player_from_question", lambda t: t.v_markets.select("market_id", matching.player_from_question(F.regexp_replace("question", "any player", "another player")).alias("player")), """
SELECT market_id, CASE WHEN LOWER(REGEXP_EXTRACT(REPLACE(question, 'any player', 'another player'), 'Will (.+?) be', 1)) NOT IN ('another player', 'any other player', '')
  THEN TRIM(REGEXP_EXTRACT(question, 'Will (.+?) be', 1)) END AS player FROM v_markets""")

# ---- tournament statistics and pricing ------------------------------------------------

query("q13_team_tournament_stats", lambda t: markets.team_tournament_stats(t.v_matches, t.v_events), """
WITH x AS (SELECT match_id, team, SUM(shot_statsbomb_xg) AS xg FROM v_events WHERE type = 'Shot' GROUP BY ALL),
 l AS (SELECT match_id, competition, home_team AS team, home_score AS gf, away_score AS ga FROM v_matches UNION ALL SELECT match_id, competition, away_team, away_score, home_score FROM v_matches),
 j AS (SELECT l.*, COALESCE(a.xg, 0) AS xf, COALESCE((SELECT SUM(b.xg) FROM x b WHERE b.match_id = l.match_id AND b.team <> l.team), 0) AS xa FROM l LEFT JOIN x a USING (match_id, team))
SELECT competition AS tournament, team, COUNT(*) AS matches_played, SUM(gf)::BIGINT AS goals_for, SUM(ga)::BIGINT AS goals_against, SUM(gf - ga)::BIGINT AS goal_diff, ROUND(SUM(xf), 2) AS xg_for,
  ROUND(SUM(xa), 2) AS xg_against, ROUND(SUM(xf) - SUM(xa), 2) AS xg_diff, ROUND(SUM(xf) / COUNT(*), 2) AS xg_per_match FROM j GROUP BY ALL""")
query("q14_player_tournament_stats", lambda t: markets.player_tournament_stats(t.v_matches, t.v_lineups, t.v_events), """
WITH p AS (SELECT competition, player_name AS player, SUM(COALESCE(SPLIT_PART(to_time, ':', 1)::INT, 90) - COALESCE(SPLIT_PART(from_time, ':', 1)::INT, 0))::BIGINT AS m FROM v_lineups JOIN v_matches USING (match_id) GROUP BY ALL),
 s AS (SELECT competition, player, COALESCE(SUM(shot_statsbomb_xg), 0) AS x, COUNT(*) AS n, COUNT(*) FILTER (WHERE shot_outcome = 'Goal') AS g FROM v_events JOIN v_matches USING (match_id) WHERE type = 'Shot' GROUP BY ALL)
SELECT competition AS tournament, player, m AS minutes_played, ROUND(COALESCE(x, 0), 2) AS total_xg, CASE WHEN m > 0 THEN ROUND(COALESCE(x, 0) / (m / 90e0), 2) ELSE 0 END AS xg_per_90,
  COALESCE(n, 0) AS shots, COALESCE(g, 0) AS goals FROM p LEFT JOIN s USING (competition, player)""")
query("q15_find_match", lambda t: markets.find_match(t.v_matches.select(F.col("away_team").alias("team_a"), F.col("home_team").alias("team_b"), F.col("competition").alias("tournament"), F.col("match_id").alias("market")), t.v_matches), """
SELECT w.away_team AS team_a, w.home_team AS team_b, w.competition AS tournament, w.match_id AS market, (SELECT ARG_MIN(m.match_id, (m.match_date, m.match_id)) FROM v_matches m WHERE m.competition = w.competition
  AND ((m.home_team = w.home_team AND m.away_team = w.away_team) OR (m.home_team = w.away_team AND m.away_team = w.home_team))) AS match_id FROM v_matches w""")


def _priced(t):
    return t.v_team_match.filter("epr IS NOT NULL").select("match_id", "team", F.col("ppda").alias("xg_diff"), (F.col("epr") / 98.0).alias("implied_prob"), F.col("npxg").alias("xg_against"))


PRICED = "pr AS (SELECT match_id, team, ppda AS x, epr / 98e0 AS p, npxg AS xa FROM v_team_match WHERE epr IS NOT NULL)"
LINE = f"{PRICED}, f AS (SELECT REGR_SLOPE(p, x) AS s, REGR_INTERCEPT(p, x) AS i, REGR_R2(p, x) AS r2, COUNT(*) AS n FROM pr), mp AS (SELECT pr.*, LEAST(GREATEST(s * x + i, 0), 1) AS e, LEAST(GREATEST(s * x + i, 0), 1) - p AS m FROM pr, f)"
query("q16_pearson", lambda t: rounded(markets.pearson(_priced(t), "xg_diff", "implied_prob").drop("p_value")), f"WITH {PRICED} SELECT ROUND(CORR(x, p), 4) AS r, COUNT(*) AS n FROM pr")
query("q16_spearman", lambda t: rounded(markets.spearman(_priced(t), "match_id", "xg_diff", "implied_prob").drop("p_value")), f"""
WITH {PRICED}, k AS (SELECT RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2e0 AS a, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2e0 AS b FROM pr)
SELECT ROUND(CORR(a, b), 4) AS r, COUNT(*) AS n FROM k""")
query("q16_pearson_p_value", lambda t: rounded(markets.pearson(_priced(t), "xg_diff", "implied_prob")), f"""
WITH {PRICED}, c AS (SELECT CORR(x, p) AS r, COUNT(*) AS n FROM pr)
SELECT ROUND(r, 4) AS r, n, ROUND({f_tail_sql("r * r * (n - 2) / (1 - r * r)", "1", "n - 2")}, 4) AS p_value FROM c""")
query("q17_mispricing", lambda t: rounded(markets.mispricing(_priced(t), "xg_diff", "implied_prob").select("match_id", "expected_prob", "residual", "mispricing"), 6), f"""
WITH {LINE} SELECT match_id, ROUND(e, 6) AS expected_prob, ROUND(-m, 6) AS residual, ROUND(m, 6) AS mispricing FROM mp""")
query("q17_mispricing_summary", lambda t: rounded(markets.mispricing_summary(_priced(t), "xg_diff", "implied_prob").drop("p_value"), 5), f"""
WITH {LINE} SELECT ROUND(ANY_VALUE(f.s), 5) AS slope, ROUND(ANY_VALUE(f.i), 5) AS intercept, ROUND(ANY_VALUE(r2), 5) AS r2, ANY_VALUE(n) AS n, ROUND(AVG(ABS(m)), 5) AS mae, ROUND(MAX(m), 5) AS max_underpriced,
  ROUND(MIN(m), 5) AS max_overpriced, ROUND(STDDEV_SAMP(m), 5) AS std, COUNT(*) FILTER (WHERE m > 0.05) AS n_value, COUNT(*) FILTER (WHERE m < -0.05) AS n_overpriced FROM mp, f""")
TTEST = """t AS (SELECT COUNT(*) FILTER (WHERE g) AS n_a, AVG(v) FILTER (WHERE g) AS mean_a, VAR_SAMP(v) FILTER (WHERE g) AS va, COUNT(*) FILTER (WHERE NOT g) AS n_b, AVG(v) FILTER (WHERE NOT g) AS mean_b, VAR_SAMP(v) FILTER (WHERE NOT g) AS vb FROM gr)
SELECT n_a, ROUND(mean_a, 5) AS mean_a, n_b, ROUND(mean_b, 5) AS mean_b, ROUND((mean_a - mean_b) / SQRT(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1e0 / n_a + 1e0 / n_b)), 5) AS t_statistic FROM t"""
query("q18_median_split_test", lambda t: rounded(markets.median_split_test(markets.mispricing(_priced(t), "xg_diff", "implied_prob"), "mispricing", "xg_against").drop("p_value"), 5), f"""
WITH {LINE}, gr AS (SELECT xa < (SELECT MEDIAN(xa) FROM mp) AS g, m AS v FROM mp), {TTEST}""")
query("q18_favourites_test", lambda t: rounded(markets.t_test(_priced(t), "xg_diff", F.col("implied_prob") > 0.05).drop("p_value"), 5), f"""
WITH {PRICED}, gr AS (SELECT p > 0.05 AS g, x AS v FROM pr), {TTEST}""")


def _finished(t):
    return markets.finishing(markets.team_tournament_stats(t.v_matches, t.v_events).withColumn("key", F.concat_ws("/", "tournament", "team")))


FIN = """x AS (SELECT match_id, team, SUM(shot_statsbomb_xg) AS xg FROM v_events WHERE type = 'Shot' GROUP BY ALL),
 l AS (SELECT match_id, competition, home_team AS team, home_score AS gf, away_score AS ga FROM v_matches UNION ALL SELECT match_id, competition, away_team, away_score, home_score FROM v_matches),
 fn AS (SELECT competition || '/' || team AS key, SUM(gf) - ROUND(SUM(xg), 2) AS finishing FROM l JOIN x USING (match_id, team) GROUP BY competition, team)"""
query("q19_finishing_extremes", lambda t: rounded(markets.extremes(_finished(t), "key", "finishing")), f"""
WITH {FIN} SELECT * FROM (SELECT key, ROUND(finishing, 4) AS finishing, 'top' AS "end" FROM fn ORDER BY finishing DESC, key LIMIT 3) a
UNION ALL SELECT * FROM (SELECT key, ROUND(finishing, 4), 'bottom' FROM fn ORDER BY finishing, key LIMIT 3) b""")
query("q19_finishing_correlation", lambda t: rounded(markets.pearson(_finished(t), "finishing", "defensive_performance").drop("p_value")), """
WITH x AS (SELECT match_id, team, SUM(shot_statsbomb_xg) AS xg FROM v_events WHERE type = 'Shot' GROUP BY ALL), mx AS (SELECT match_id, SUM(xg) AS tot FROM x GROUP BY match_id),
 l AS (SELECT match_id, competition, home_team AS team, home_score AS gf, away_score AS ga FROM v_matches UNION ALL SELECT match_id, competition, away_team, away_score, home_score FROM v_matches),
 s AS (SELECT SUM(gf) - ROUND(SUM(COALESCE(xg, 0)), 2) AS f, ROUND(SUM(COALESCE(tot, 0) - COALESCE(xg, 0)), 2) - SUM(ga) AS d FROM l LEFT JOIN x USING (match_id, team) LEFT JOIN mx USING (match_id) GROUP BY competition, team)
SELECT ROUND(CORR(f, d), 4) AS r, COUNT(*) AS n FROM s""")
query("q20_pre_event_refit", lambda t: rounded(markets.mispricing_summary(_priced(t).filter("implied_prob < 0.20"), "xg_diff", "implied_prob").select("slope", "intercept", "r2", "n"), 5), f"""
WITH {PRICED} SELECT ROUND(REGR_SLOPE(p, x), 5) AS slope, ROUND(REGR_INTERCEPT(p, x), 5) AS intercept, ROUND(REGR_R2(p, x), 5) AS r2, COUNT(*) AS n FROM pr WHERE p < 0.2""")


def _forecasts(t):
    k = F.col("match_id")
    return markets.forecast_cases(t.v_matches.select("match_id", "home_team", "away_team", "home_score", "away_score", (k * 13 % 11).alias("home_xg"), (k * 5 % 7).alias("away_xg"),
        F.when(k % 6 != 0, k * 17 % 19).alias("home_odds"), (k * 23 % 17).alias("away_odds")))


CASES = """fc AS (SELECT match_id, CASE WHEN match_id * 17 % 19 > match_id * 23 % 17 THEN home_team ELSE away_team END AS m, CASE WHEN match_id * 13 % 11 > match_id * 5 % 7 THEN home_team ELSE away_team END AS x,
  CASE WHEN home_score > away_score THEN home_team WHEN away_score > home_score THEN away_team ELSE 'Draw' END AS a FROM v_matches WHERE match_id % 6 <> 0)"""
query("q21_forecast_cases", lambda t: _forecasts(t).select("match_id", "market_favourite", "xg_favourite", "actual", "case"), f"""
WITH {CASES} SELECT match_id, m AS market_favourite, x AS xg_favourite, a AS actual, CASE WHEN m = x AND x = a THEN 'PERFECT ALIGNMENT' WHEN m = a THEN 'MARKET RIGHT, xG WRONG' WHEN x = a THEN 'MARKET WRONG, xG RIGHT'
  ELSE 'UPSET / HIGH VARIANCE' END AS "case" FROM fc""")
query("q21_forecast_tally", lambda t: markets.forecast_tally(_forecasts(t)), f"""
WITH {CASES} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE m = a) AS market_correct, COUNT(*) FILTER (WHERE x = a) AS xg_correct, COUNT(*) FILTER (WHERE m = a AND x = a) AS both_correct,
  COUNT(*) FILTER (WHERE m <> a AND x <> a) AS both_wrong FROM fc""")
query("q22_brier", lambda t: rounded(t.v_trades.withColumn("y", F.when(F.col("side") == "BUY", 1.0).otherwise(0.0)).groupBy("side").agg(markets.brier("price", "y").alias("brier")), 6), """
SELECT side, ROUND(AVG((price - CASE WHEN side = 'BUY' THEN 1 ELSE 0 END) ** 2), 6) AS brier FROM v_trades GROUP BY side""")


def _goals(t):
    return t.v_odds.filter("event_id % 9 = 0").select(F.col("event_id").alias("goal_id"), "market_id", F.col("timestamp").alias("ts"))


query("q23_event_price_impact", lambda t: markets.event_price_impact(_goals(t), t.v_odds, 600, 300), """
WITH g AS (SELECT event_id AS goal_id, market_id, timestamp AS g FROM v_odds WHERE event_id % 9 = 0),
 j AS (SELECT goal_id, market_id, token_id, price, timestamp AS t, g FROM v_odds JOIN g USING (market_id) WHERE timestamp BETWEEN g - INTERVAL 600 MINUTE AND g + INTERVAL 600 MINUTE),
 a AS (SELECT goal_id, market_id, token_id, ARG_MAX(price, (t, price)) FILTER (WHERE t < g) AS price_before, ARG_MIN(price, (t, price)) FILTER (WHERE t >= g AND t <= g + INTERVAL 300 MINUTE) AS price_after,
   ARG_MAX(price, (t, price)) FILTER (WHERE t >= g) AS price_end, COUNT(*) AS snapshots FROM j GROUP BY ALL)
SELECT *, ROUND((price_after - price_before) / NULLIF(price_before, 0) * 100, 2) AS change_pct FROM a""")
query("q24_xg_win_probability", lambda t: rounded(markets.xg_win_probability(t.v_matches.select("match_id", ((F.col("match_id") * 7 % 31) / 10.0).alias("a"), ((F.col("match_id") * 11 % 29) / 10.0).alias("b")), "a", "b"), 6).withColumn(
    "edge", markets.value_edge(F.col("p_win"), (F.col("match_id") % 10) / 10.0)), """
WITH m AS (SELECT match_id, (match_id * 7 % 31) / 10e0 AS a, (match_id * 11 % 29) / 10e0 AS b FROM v_matches),
 g AS (SELECT match_id, a, b, i, EXP(-a) * POWER(a, i) / GAMMA(i + 1) AS pa, EXP(-b) * POWER(b, i) / GAMMA(i + 1) AS pb FROM m, (SELECT UNNEST(RANGE(0, 40)) AS i) z),
 c AS (SELECT *, COALESCE(SUM(pb) OVER (PARTITION BY match_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM g),
 w AS (SELECT match_id, a, b, ROUND(SUM(pa * cb), 6) AS p_win, ROUND(SUM(pa * pb), 6) AS p_draw, ROUND(1 - SUM(pa * cb) - SUM(pa * pb), 6) AS p_loss FROM c GROUP BY match_id, a, b)
SELECT *, CASE WHEN p_win - (match_id % 10) / 10e0 > 0.15 THEN 'Strong value' WHEN p_win - (match_id % 10) / 10e0 > 0.1 THEN 'Significant value' WHEN p_win - (match_id % 10) / 10e0 > 0.05 THEN 'Small value' ELSE 'No value' END AS edge FROM w""")
query("q25_period_overlap", lambda t: markets.period_overlap(t.lineitem, "l_shipdate", t.orders, "o_orderdate"), """
WITH s AS (SELECT MIN(l_shipdate)::DATE AS lo, MAX(l_shipdate)::DATE AS hi FROM lineitem UNION ALL SELECT MIN(o_orderdate)::DATE, MAX(o_orderdate)::DATE FROM orders)
SELECT MAX(lo) AS overlap_start, MIN(hi) AS overlap_end, CASE WHEN MAX(lo) < MIN(hi) THEN (MIN(hi) - MAX(lo))::INT ELSE 0 END AS days FROM s""")
query("q25_common_years", lambda t: markets.common_years(t.lineitem, "l_shipdate", t.orders, "o_orderdate"), """
SELECT * FROM (SELECT YEAR(l_shipdate)::INT AS year, COUNT(*) AS a_rows FROM lineitem GROUP BY 1) a JOIN (SELECT YEAR(o_orderdate)::INT AS year, COUNT(*) AS b_rows FROM orders GROUP BY 1) b USING (year)""")
