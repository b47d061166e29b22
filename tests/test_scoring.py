import duckdb
import pytest
from helpers import rows
from pyspark.sql import functions as F

from __spark_entry__ import ORACLES, QUERIES
from touchline.operators import rollup, scoring, season, validation


def test_season_year(spark):
    df = spark.createDataFrame([("2023/2024",), ("2022",), ("2021-2022",), ("none",)], "season_name string")
    assert rows(season.with_season_year(df), "season_name", "season_year") == [("2021-2022", 2022), ("2022", 2022), ("2023/2024", 2024), ("none", None)]


def _matches(spark):
    return spark.createDataFrame([(1, "A", "B", "Cup", "2022"), (2, "A", "C", "League", "2022"), (3, "A", "D", "League", "2022")], "match_id int, home_team string, away_team string, competition string, season_name string")


def test_competition_join_with_and_without_fan_out(spark):
    rows_in = spark.createDataFrame([("p", "A", "2022", 2022, 1, 90, 0.5)], "player string, team string, season_name string, season_year int, match_id int, minutes_played int, xg_chain double")
    one = season.aggregate_all({"xg_chain": rows_in}, _matches(spark))["xg_chain"]
    many = season.aggregate_all({"xg_chain": rows_in}, _matches(spark), one_competition=False)["xg_chain"]
    assert rows(one, "competition_name") == [("League",)] and rows(many, "competition_name") == [("Cup",), ("League",)]


def test_filter_floor_scales_for_proxy(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "matches int")
    assert rows(season.sample_filter(df, "matches", 3), "matches", "shrinkage_flag") == [(2, True), (3, False)]


def test_unified_outer_join_fans_out_for_two_teams(spark):
    a = spark.createDataFrame([("p", "2022", "X", "CM", 0.1), ("p", "2022", "Y", "CM", 0.3)], "player string, season_name string, team string, position_archetype string, a_norm double")
    b = spark.createDataFrame([("p", "2021/2022", "X", 0.5), ("p", "2021/2022", "Y", 0.7), ("q", "2024", "Z", 0.9)], "player string, season_name string, team string, b_norm double")
    got = rows(scoring.unified_table({"a": a, "b": b}), "player", "season_name", "a_norm", "b_norm")
    assert len(got) == 5 and ("q", "2023/2024", None, 0.9) in got


def test_unified_table_is_one_exchange_and_can_fold_repeated_keys(spark):
    meta = "player string, season_name string, team string, decay_weight double"
    a = spark.createDataFrame([("p", "2022", "Y", None, 0.1), ("p", "2022", "X", 1.0, 0.3), (None, "2022", "N", 1.0, 0.5), ("r", "2024", "R", 1.0, None)], f"{meta}, a_norm double")
    b = spark.createDataFrame([("p", "2021/2022", "Z", 0.8, 0.5), (None, "2022", "N", 1.0, 0.7), ("q", "2024", "Q", 0.6, 0.9)], f"{meta}, b_norm double")
    c = spark.createDataFrame([("p", "2021/2022", "Z", 0.7, 1.0), ("p", "2021/2022", "W", 0.7, 2.0)], f"{meta}, c_norm double")
    wide = scoring.unified_table({"a": a, "b": b, "c": c})
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    joined = a.select("player", F.lit("2021/2022").alias("season_name"), "team", "a_norm").filter("player = 'p'").join(b.select("player", "season_name", "b_norm"), ["player", "season_name"], "full").join(
        c.select("player", "season_name", "c_norm"), ["player", "season_name"], "full").filter("player = 'p'")
    cols = ["player", "season_name", "team", "a_norm", "b_norm", "c_norm"]
    assert rows(wide.filter("player = 'p'"), *cols) == rows(joined, *cols) and wide.filter("player = 'p'").count() == 4
    assert rows(wide.filter("player IS NULL"), "team", "a_norm", "b_norm") == [("N", 0.5, None), ("N", None, 0.7)]
    folded = scoring.unified_table({"a": a, "b": b, "c": c}, fan_out=False)
    assert rows(folded.filter("player = 'p'"), "team", "decay_weight", "a_norm", "b_norm", "c_norm") == [("X", 1.0, 0.2, 0.5, 1.5)]


def test_blend_ranks_anew(spark):
    scored = spark.createDataFrame([("a", "t", 80.0, 1), ("b", "t", 75.0, 2), ("c", "t", 72.0, 3), ("d", "t", None, None)], "player string, team string, composite_score double, rank int")
    listed = spark.createDataFrame([("c", "t", 1), ("e", "u", 12)], "player string, team string, rank int")
    got = rows(scoring.blend_external_list(scored, listed), "player", "final_score", "rank")
    assert got == [("a", 70.0, 2), ("b", 70.0, 2), ("c", 0.6 * 72 + 0.4 * 90, 1), ("d", None, None), ("e", 40 - 10 / 89, 4)]


def test_shrinkage_endpoints(spark):
    df = spark.createDataFrame([("a", "s", 400, False, 0.8), ("b", "s", 180, True, 0.0), ("c", "s", 225, True, 0.0), ("d", "t", 180, True, 0.0)],
                               "player string, season_name string, minutes_played int, shrinkage_flag boolean, v_norm double")
    pos = spark.createDataFrame([("a", "s", "CB"), ("b", "s", "CB"), ("c", "s", "CB"), ("d", "t", "CB")], "player string, season_name string, archetype string")
    assert rows(scoring.apply_shrinkage(df, ["v_norm"], pos), "player", "v_norm") == [("a", 0.8), ("b", 0.8), ("c", 0.4), ("d", 0.5)]


def test_dense_percentile_and_single_group(spark):
    df = spark.createDataFrame([(1, "CB", 1.0), (2, "CB", 1.0), (3, "CB", 4.0), (4, "FW", 2.0), (5, "FW", None)], "id int, g string, v double")
    got = {r["id"]: r["p"] for r in scoring.group_percentiles(df, ["id"], "g", {"v": "p"}).collect()}
    assert got == {1: 50.0, 2: 50.0, 3: 100.0, 4: 50.0, 5: None}


def test_role_words_in_order(spark):
    df = spark.createDataFrame([("Left Wing Back",), ("Right Wing",), ("Center Defensive Midfield",), ("Sweeper",), (None,)], "p string")
    got = {r["p"]: r["w"] for r in df.select("p", scoring.role_weight(F.col("p"), "Control").alias("w")).collect()}
    assert got == {"Left Wing Back": 0.65, "Right Wing": 0.75, "Center Defensive Midfield": 0.85, "Sweeper": 0.85, None: 1.0}


def test_blend_caps_and_appends(spark):
    scored = spark.createDataFrame([("a", 80.0), ("b", 80.0), ("c", None)], "player string, composite_score double")
    listed = spark.createDataFrame([("a", "T", 1), ("z", "T", 11)], "player string, team string, rank int")
    assert rows(scoring.blend_external_list(scored, listed), "player", "final_score") == [("a", pytest.approx(84.0)), ("b", 70.0), ("c", None), ("z", 40.0)]


def test_top_players_guarantee_lines(spark):
    ros = [("N", f"p{i:02d}", "club", 25, "FW" if i < 15 else "CB", 100.0 - i) for i in range(20)]
    df = spark.createDataFrame(ros, "country string, player string, club string, age int, position_archetype string, final_score double")
    got = rollup.top_players_balanced(df.select("country", "player", "club", "age"), df).collect()
    assert len(got) == 12 and sum(r["position_archetype"] == "CB" for r in got) == 3


def test_readiness_without_archetype_redistributes(spark):
    ros = spark.createDataFrame([("N", "p", "c", 27)], "country string, player string, club string, age int")
    sc = spark.createDataFrame([("p", "CB", 50.0)], "player string, position_archetype string, final_score double")
    co = spark.createDataFrame([("N", 1, 5.0, 0, 1.0)], "country string, fifa_rank int, coach_years double, wc_appearances int, confederation_bonus double")
    r = rollup.team_readiness(ros, sc, co).first()
    quality = 0.4 * 50 + 0.6 * 75
    want = quality * 0.4375 + 100 * 0.1875 + 100 * 0.125 + 85 * 0.0625 + 20 * 0.0625 + 100 * 0.0625
    assert not r["archetype_available"] and r["final_score"] == pytest.approx(want, abs=0.005)


def test_standings_order(spark):
    res = spark.createDataFrame([("G", "a", "b", 2, 0), ("G", "c", "d", 1, 1), ("G", "a", "c", 0, 0)], "group string, team_a string, team_b string, goals_a int, goals_b int")
    assert rows(rollup.group_standings(res), "position", "team", "points") == [(1, "a", 4), (2, "c", 2), (3, "d", 1), (4, "b", 0)]


def test_final_scores_of_recurring_names_and_of_halves(spark):
    """Rank 147 of 160 is 3.35 above the middle, which is 3.3499999999999996 as a double and goes to 3.4; teams share two names."""
    teams = spark.range(160).select(
        F.col("id").alias("key"), F.concat(F.lit("T"), F.col("id") % 2).alias("team"), F.lit(1).alias("cluster"), F.array(F.lit(0.2), F.lit(0.8)).alias("proba"),
        F.lit(9).alias("n_matches"), (F.col("id") + 1.0).alias("npxg"), F.lit(30.0).alias("epr"))
    presence = teams.filter("key % 4 = 0").select("key", F.lit(7).alias("outcome_rank"))
    got = {r["key"]: r for r in validation.final_scores(teams, ["High Press / High Output", "Possession Dominant"], presence, key="key").collect()}
    assert len(got) == 160 and got[146]["quality_adjustment"] == 3.4 and got[156]["quality_adjustment"] == 3.9
    assert all(got[k]["wc_presence_weight"] == (1.0 if k % 4 == 0 else 0.75) for k in got)


def test_c19_keeps_customers_of_one_name_apart(spark, tmp_path):
    customers = spark.createDataFrame([(i, f"Customer#{i % 7}") for i in range(42)], "c_custkey long, c_name string")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    got = QUERIES["c19_final_scores"](spark, str(tmp_path)).collect()
    want = duckdb.connect().execute(f"WITH customer AS (SELECT * FROM '{tmp_path}/customer.parquet/*.parquet') SELECT * FROM ({ORACLES['c19_final_scores']}) z").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 42
