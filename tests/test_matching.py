import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from touchline.operators import markets, matching


def _texts(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "id int, text string")


def test_team_rules(spark):
    teams = spark.createDataFrame([("Bayer Leverkusen", False), ("FC Köln", False), ("Georgia", True), ("Real Sociedad", False), ("South Africa", True), ("Inter", False), ("Borussia Dortmund", False)], "name string, strict boolean")
    t = _texts(spark, "Leverkusen to win", "köln-slug vs georgian side", "Will Georgia advance?", "sociedad or the real thing", "africa cup, south", "interest in inter.", None, "Dortmund beat Borussia Dortmund")
    got = rows(matching.teams_in_text(t, "id", "text", teams), "id", "name")
    assert got == [(0, "Bayer Leverkusen"), (1, "FC Köln"), (2, "Georgia"), (3, "Real Sociedad"), (5, "Inter"), (7, "Borussia Dortmund")]


def test_only_spaces_part_the_words_of_a_club_name(spark):
    teams = spark.createDataFrame([("Borussia\nAlpha Dortmund", False)], "name string, strict boolean")
    t = _texts(spark, "dortmund, borussia", "Dortmund beat Borussia\nAlpha", "borussia alpha dortmund", "the borussia\nalpha dortmund side")
    assert rows(matching.teams_in_text(t, "id", "text", teams), "id") == [(1,), (3,)]


def test_players_brute_force(spark):
    rng = random.Random(2)
    first, last = ["Ana", "Bo", "Cristiano", "Dee"], ["Lima", "Ro", "Ana", "Stone"]
    names = [f"{a} {b}" for a in first for b in last] + [f"{a} de {b}" for a in first for b in last] + ["Solo"]
    words = first + last + ["de", "x", "filler" * 4]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["Ana" + " x" * 30 + " Lima"]

    def brute(text, name):
        low, parts = text.lower(), name.split()
        pos = lambda w: [m.start() for m in re.finditer(r"\b" + re.escape(w.lower()) + r"\b", low)]
        return bool(pos(name)) or (len(parts) >= 3 and any(abs(a - b) <= 50 for a in pos(parts[0]) for b in pos(parts[-1])))

    want = sorted((i, n) for i, t in enumerate(texts) for n in names if brute(t, n))
    players = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(matching.players_in_text(_texts(spark, *texts), "id", "text", players), "id", "name") == sorted(want, key=repr)


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("threshold", [80, 65])
def test_fuzzy_filter_loses_nothing(spark, threshold):
    rng = random.Random(4)
    base = ["luis diaz", "jon stone", "marcus rash", "kylian mbappe lottin", "ab", "a", "vinicius junior", "son heung min"]
    mutate = lambda s: "".join(c if rng.random() > 0.15 else rng.choice(["", "z", c + "q"]) for c in s)
    queries = sorted({mutate(b).strip() for b in base for _ in range(12)} - {""})
    norm = lambda s: " ".join(sorted(set(s.split())))
    want = {}
    for q in queries:
        best = None
        for n in base:
            a, b = norm(q), norm(n)
            ratio = 100 * (1 - _lev(a, b) / max(len(a), len(b)))
            score = float(int(ratio + 0.5))
            qs, ns = set(q.split()), set(n.split())
            if (len(qs) >= 2 and qs <= ns) or (len(ns) >= 2 and ns <= qs):
                score = max(score, 90.0)
            if score >= threshold and (best is None or (-score, n) < best):
                best = (-score, n)
        if best:
            want[q] = (best[1], -best[0])
    df = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {r["query"]: (r["name"], r["score"]) for r in matching.fuzzy_name_match(df(queries, "query"), df(base, "name"), threshold).collect()}
    assert got == want


def test_candidates_of_a_common_piece_stay_few(spark):
    """All names end alike; a query meets those it can match, not all that share the common piece."""
    rng = random.Random(5)
    endings = ["".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(13)) + "zzz" for _ in range(400)]
    endings[41] = endings[40][:3] + "q" + endings[40][4:]
    n = matching._normed(spark.createDataFrame([(x,) for x in endings], "name string"), "name")
    q = matching._normed(spark.createDataFrame([(x,) for x in endings[::40]], "query string"), "query")
    pairs = {(r["query"], r["name"]) for r in matching.edit_candidates(q, n, 80).collect()}
    norm = lambda x: " ".join(sorted(set(x.split())))
    similar = {(a, b) for a in endings[::40] for b in endings if int(100 * (1 - _lev(norm(a), norm(b)) / max(len(norm(a)), len(norm(b)))) + 0.5) >= 80}
    assert (endings[40], endings[41]) in similar and similar <= pairs and len(pairs) < 0.2 * 10 * 400
    clubs = matching._normed(spark.createDataFrame([(f"club{i} united",) for i in range(20)], "name string"), "name")
    ranked = dict(rows(matching._by_rarity(clubs, "name", "t", matching._word_counts(clubs.select("t"))), "name", "rare"))
    assert len(ranked) == 20 and all(r[-1] == "united" for r in ranked.values())


def test_best_match_priorities(spark):
    names = spark.createDataFrame([("Luis Gerardo Chávez Magallón", 60.0), ("Luis Chávez", 50.0), ("Pelé", 99.0), ("Ana Maria Lopez Diaz", 10.0)], "name string, overall_quality double")
    q = spark.createDataFrame([("luis chavez",), ("Gerardo Magallon",), ("O Rei Pelé",), ("Ana Lopez Silva",), ("nobody",)], "query string")
    assert rows(matching.best_name_match(q, names), "query", "name", "rule") == [
        ("Ana Lopez Silva", "Ana Maria Lopez Diaz", 4), ("Gerardo Magallon", "Luis Gerardo Chávez Magallón", 2), ("O Rei Pelé", "Pelé", 3), ("luis chavez", "Luis Chávez", 1)]


def test_fold_name(spark):
    df = spark.createDataFrame([("  Đorđe  ÇÉŠØ  Müller ",), ("Ångström 東",)], "n string")
    assert rows(df.select(matching.fold_name(F.col("n")).alias("f")), "f") == [("angstrom",), ("ore ces muller",)]


def test_market_rules(spark):
    df = spark.createDataFrame([
        ("Gold in football?", "x", "2024-08-09 10:00:00"), ("Gold in football?", "x", "2024-08-10 00:00:00"), ("Gold in football?", "x", "2024-08-10 00:00:01"), ("Ghana to win", "x", "2024-02-01 00:00:00"),
        ("Who will win the Bundesliga", "x", None)], "q string, s string, e string").withColumn("e", F.to_timestamp_ntz("e"))
    got = [tuple(r) for r in df.select(matching.tournament_from_text(F.col("q"), F.col("s"), F.col("e")), matching.tournament_final(F.col("q"), F.col("s"), F.col("e"))).collect()]
    assert got == [("Olympics 2024", "Olympics 2024"), ("Olympics 2024", "Olympics 2024"), ("unknown", "unknown"), ("unknown", "AFCON 2024"), ("1. Bundesliga", "1. Bundesliga")]


def test_main_token_without_yes(spark):
    t = spark.createDataFrame([("m", "t2", "B"), ("m", "t1", "A"), ("n", "t4", "No"), ("n", "t9", "YES")], "market_id string, token_id string, outcome string")
    assert rows(markets.main_token(t), "market_id", "token_id") == [("m", "t1"), ("n", "t9")]


def test_poisson_probabilities_sum_to_one(spark):
    r = markets.xg_win_probability(spark.createDataFrame([(1.8, 0.9), (0.0, 0.0)], "a double, b double"), "a", "b").collect()
    assert r[0]["p_win"] + r[0]["p_draw"] + r[0]["p_loss"] == pytest.approx(1.0) and r[0]["p_win"] == pytest.approx(0.588, abs=0.01)
    assert r[1]["p_draw"] == 1.0


def test_t_test_known(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, True), (2.0, False), (4.0, False), (6.0, False)], "v double, g boolean")
    r = markets.t_test(df, "v", F.col("g")).first()
    assert r["t_statistic"] == pytest.approx(-1.5492, abs=1e-3) and r["p_value"] == pytest.approx(0.1963, abs=1e-3)
