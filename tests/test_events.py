import random

import pytest
from helpers import events, rows
from pyspark.sql import functions as F

from touchline.operators import defence, minutes, network, packing, possession, progression, xg


def test_ppda_edges(spark):
    ev = events(spark, [
        {"team": "A", "location_x": 60.0}, {"team": "A", "location_x": 48.0}, {"team": "B", "type": "Tackle", "location_x": 70.0},
        {"team": "B", "type": "Duel", "location_x": None}, {"team": "C", "match_id": 2, "type": "Tackle", "location_x": 90.0}])
    got = rows(possession.ppda(ev), "match_id", "team", "opponent_passes", "defensive_actions", "ppda")
    assert got == [(1, "A", 0, 0, None), (1, "B", 1, 1, 1.0), (2, "C", 0, 1, 0.0)]


def test_zone_edges_and_shares(spark):
    ev = events(spark, [{"location_x": x} for x in (39.9, 40.0, 79.9, 80.0, None)])
    got = rows(possession.possession_by_zone(ev), "zone", "passes", "zone_pct")
    assert got == [("Defensive Third", 1, 25.0), ("Final Third", 1, 25.0), ("Middle Third", 2, 50.0)]


def test_possession_value_without_xg(spark):
    ev = events(spark, [{"team": "A"}] * 3 + [{"team": "B"}])
    got = rows(possession.possession_value(ev), "team", "total_xg", "epr", "style")
    assert got == [("A", 0.0, None, "All Bark, No Bite"), ("B", 0.0, None, "No Threat Created")]


def _random_events(spark, n=400, seed=3):
    rng = random.Random(seed)
    kinds = ["Pass", "Carry", "Shot", "Interception", "Tackle", "Ball Recovery", "Pressure", "Duel", "Clearance"]
    return [{"index_num": i + 1, "possession": i // 60, "team": rng.choice("AB"), "player": rng.choice("xyz"), "type": rng.choice(kinds), "location_x": float(rng.randrange(121)),
             "timestamp": f"00:{i // 120:02d}:{(i // 2) % 60:02d}.{rng.randrange(1000):03d}"} for i in range(n)]


def test_counter_attack_equals_all_pairs(spark):
    data = _random_events(spark)
    sec = lambda t: sum(float(p) * f for p, f in zip(t.split(":"), (3600, 60, 1)))
    want = {}
    for w in data:
        if w["type"] not in ("Interception", "Tackle", "Ball Recovery"):
            continue
        for a in data:
            if a["type"] in ("Pass", "Carry", "Shot") and a["team"] == w["team"] and a["possession"] == w["possession"] and a["index_num"] > w["index_num"]:
                g, d = a["location_x"] - w["location_x"], sec(a["timestamp"]) - sec(w["timestamp"])
                if g > 0 and 0 < d <= 10:
                    want.setdefault(a["team"], []).append((a["possession"], g, d))
    for r in possession.counter_attack_speed(events(spark, data)).collect():
        pairs = want[r["team"]]
        assert r["counter_attacks"] == len({p for p, _, _ in pairs})
        assert r["avg_distance_gained"] == pytest.approx(sum(g for _, g, _ in pairs) / len(pairs), abs=0.0051)
        assert r["avg_speed_units_per_sec"] == pytest.approx(sum(g / d for _, g, d in pairs) / len(pairs), abs=0.0051)


@pytest.mark.parametrize("block", [6, 64])
def test_regain_window_equals_exists(spark, block):
    data = _random_events(spark, 300, 5)
    want = {}
    for e in data:
        if e["type"] == "Pressure":
            hit = any(o["team"] == e["team"] and o["type"] in defence.REGAINS and e["index_num"] <= o["index_num"] <= e["index_num"] + 5 for o in data)
            k = (e["team"], e["player"])
            want[k] = tuple(x + y for x, y in zip(want.get(k, (0, 0)), (1, int(hit))))
    got = {(r["team"], r["player"]): (r["total_pressures"], r["pressure_regains"]) for r in defence.pressure_metrics(events(spark, data), block=block).collect()}
    assert got == want


def test_minutes_rounding_and_open_end(spark):
    ev = events(spark, [{"minute": 90, "second": 0}])
    lu = spark.createDataFrame([
        (1, "A", "half", "00:00", "02:30"), (1, "A", "open", "60:00", None), (1, "A", "bench", None, None), (1, "A", "two", "00:00", "10:00"),
        (1, "A", "two", "20:00", "30:00"), (9, "A", "no match", "00:00", "10:00"), (1, "A", "negative", "50:00", "40:00")],
        "match_id int, team_name string, player_name string, from_time string, to_time string")
    assert rows(minutes.minutes_played(lu, ev), "player", "minutes_played") == [("half", 2), ("negative", 0), ("open", 30), ("two", 20)]


def test_minutes_from_events(spark):
    ev = events(spark, [
        {"type": "Starting XI", "player": "a"}, {"type": "Starting XI", "player": "b"}, {"type": "Substitution", "player": "a", "minute": 60, "substitution_replacement_name": "c"},
        {"type": "Bad Behaviour", "player": "b", "minute": 70, "bad_behaviour_card": "Red Card"}, {"type": "Pass", "player": "c", "minute": 95}])
    assert rows(minutes.minutes_from_events(ev), "player", "minute_on", "minute_out", "minutes_played") == [("a", 0, 60, 60), ("b", 0, 70, 70), ("c", 60, 95, 35)]


def test_buildup_fan_out_per_shot_row(spark):
    # two shooters in one possession: a third player's touches and xG count once per shot row
    ev = events(spark, [
        {"id": "p1", "player": "m"}, {"id": "p2", "player": "k"}, {"type": "Shot", "player": "s1", "shot_statsbomb_xg": 0.2, "shot_key_pass_id": "p2"},
        {"type": "Carry", "player": "s1"}, {"type": "Shot", "player": "s2", "shot_statsbomb_xg": 0.5}])
    got = rows(xg.xg_buildup(ev), "player", "possessions_with_buildup", "xg_buildup", "total_touches_in_buildup")
    assert got == [("m", 1, 0.7, 2), ("s1", 1, 0.7, 2)]  # the assister k is out; s1 did not take the second shot


def test_chain_uses_best_shot(spark):
    ev = events(spark, [{"player": "m"}, {"type": "Shot", "player": "s", "shot_statsbomb_xg": 0.2, "shot_outcome": "Goal"}, {"type": "Shot", "player": "s", "shot_statsbomb_xg": 0.5}])
    got = rows(xg.xg_chain(ev), "player", "xg_chain", "shots_in_chain", "goals_in_chain", "team_involvement_pct", "xg_chain_per90")
    assert got == [("m", 0.5, 2, 1, 100.0, None), ("s", 0.5, 2, 1, 100.0, None)]


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_chain_reads_the_events_once(spark):
    ev = events(spark, [{"player": "m"}, {"type": "Shot", "player": "s", "shot_statsbomb_xg": 0.2}])
    lineups = spark.createDataFrame([(1, "A", "m", "00:00", None)], "match_id int, team_name string, player_name string, from_time string, to_time string")
    assert _leaves(xg.xg_chain(ev)) == 1 and _leaves(xg.xg_chain(ev, lineups=lineups)) == 2 and _leaves(xg.xg_buildup(ev)) <= 3


def test_chain_of_rows_without_names(spark):
    # shots without a possession or a player count for the team and credit nobody
    ev = events(spark, [{"player": "m"}, {"type": "Shot", "player": None, "shot_statsbomb_xg": 0.2}, {"type": "Shot", "player": "s", "possession": None, "shot_statsbomb_xg": 0.3},
                        {"type": "Shot", "player": "s", "possession": 2, "shot_statsbomb_xg": None}, {"player": "s", "possession": None}])
    assert rows(xg.xg_chain(ev), "player", "xg_chain", "team_involvement_pct", "total_touches_in_chains") == [("m", 0.2, 40.0, 1)]


def test_chain_minutes_are_those_of_the_lineups(spark):
    ev = events(spark, [{"player": "m"}, {"type": "Shot", "player": "s", "shot_statsbomb_xg": 0.2}, {"player": "x", "minute": 93, "second": 30, "possession": 9}])
    lineups = spark.createDataFrame([
        (1, "A", "m", "00:00", "45:00"), (1, "A", "m", "60:00", None), (1, "A", "s", None, None), (2, "A", "s", "00:00", None), (1, "A", "x", "00:00", None)],
        "match_id int, team_name string, player_name string, from_time string, to_time string")
    from touchline.operators.minutes import minutes_played
    want = dict(rows(minutes_played(lineups, ev), "player", "minutes_played"))
    assert rows(xg.xg_chain(ev, lineups=lineups), "player", "minutes_played") == [("m", want["m"]), ("s", 0)] and want["m"] == 78


def test_packing_drops_pass_with_all_opponents_outside(spark):
    end = {"pass_end_location_x": 80.0, "pass_end_location_y": 60.0}
    ev = events(spark, [dict(end, id="in"), dict(end, id="out"), dict(end, id="none"), dict(end, id="lost", pass_outcome="Out"),
                        dict(end, id="in", match_id=2), dict(end, id="far", match_id=2)])
    fr = spark.createDataFrame([
        (1, "in", False, False, False, 60.0, 50.0), (1, "in", False, False, False, 60.0, 50.0), (1, "in", True, False, False, 61.0, 50.0),
        (1, "in", False, False, True, 62.0, 50.0), (1, "out", False, False, False, 10.0, 10.0),
        # the same event name in another match has its own opponents
        (2, "in", False, False, False, 60.0, 50.0), (2, "in", False, False, False, 61.0, 50.0), (2, "far", False, False, False, 10.0, 10.0)],
        "match_id int, event_uuid string, teammate boolean, actor boolean, keeper boolean, location_x double, location_y double")
    got = rows(packing.packing(ev, fr, min_passes=1), "match_id", "total_passes", "total_opponents_packed", "avg_packing_per_pass", "progressive_passes")
    assert got == [(1, 2, 1, 0.5, 2), (2, 1, 2, 2.0, 1)]


def test_network_degrees(spark):
    ev = events(spark, [{"player": "a", "pass_recipient": "b"}, {"player": "a", "pass_recipient": "b"}, {"player": "b", "pass_recipient": "c"}, {"player": "a", "pass_recipient": "c", "pass_outcome": "Out"}])
    got = rows(network.pass_network_centrality(ev), "player", "passes_made", "passes_received", "degree_centrality", "network_involvement_pct")
    assert got == [("a", 2, 0, 1, 66.67), ("b", 1, 2, 2, 100.0), ("c", 0, 1, 1, 33.33)]


def test_progression_box_and_gain(spark):
    ev = events(spark, [
        {"pass_end_location_x": 102.0, "pass_end_location_y": 18.0, "location_x": 10.0, "pass_recipient": "r"}, {"pass_end_location_x": 57.9, "pass_end_location_y": 1.0, "location_x": 48.0},
        {"pass_end_location_x": 58.0, "pass_end_location_y": 1.0, "location_x": 48.0, "pass_outcome": "Out"}, {"type": "Carry", "location_x": 72.0, "carry_end_location_x": 77.0, "carry_end_location_y": 1.0},
        {"type": "Carry", "location_x": 71.0, "carry_end_location_x": 76.0, "carry_end_location_y": 1.0}, {"play_pattern": "From Corner", "pass_end_location_x": 110.0, "pass_end_location_y": 40.0}])
    assert rows(progression.progressive_passes(ev), "total_passes", "progressive_passes", "progressive_passes_attempted") == [(3, 1, 2)]
    assert rows(progression.progressive_carries(ev), "total_carries", "progressive_carries") == [(2, 1)]
    assert rows(progression.progressive_actions(ev), "player", "progressive_actions") == [("p", 2), ("r", 1)]


def test_invariants(spark):
    ev = events(spark, _random_events(spark))
    shares = possession.possession_percentage(ev).groupBy("match_id").agg(F.sum("possession_pct").alias("s")).first()["s"]
    assert shares == pytest.approx(100, abs=0.02)
