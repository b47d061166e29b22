"""Counter-examples to shortcuts: large degrees, many clusters, large means, values far from zero."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.tests_of_difference import regularised_beta, t_two_sided
from touchline.operators import clustering, markets, validation, xg


@pytest.mark.parametrize("dof, p", [(1, 0.295167235), (2, 0.183503419), (5, 0.101939479), (30, 0.054625042), (1e3, 0.045770345), (1e4, 0.045527261), (1e6, 0.045500533), (1e9, 0.045500264)])
def test_t_tail_for_all_degrees(spark, dof, p):
    row = spark.range(1).select(t_two_sided(F.lit(2.0), F.lit(float(dof))).alias("p")).first()
    assert row["p"] == pytest.approx(p, abs=1e-6)


def test_beta_is_symmetric_and_never_cut_short():
    x, a, b = np.array([0.2, 0.5, 0.9]), np.array([3.0, 1e6, 2e4]), np.array([4.0, 1e6, 2e3])
    assert np.allclose(regularised_beta(x, a, b) + regularised_beta(1 - x, b, a), 1, atol=1e-9)
    assert regularised_beta(np.array([0.5]), np.array([1e6]), np.array([1e6])) == pytest.approx(0.5, abs=1e-9)


def test_alignment_is_exact_for_any_number_of_clusters(spark):
    rng = np.random.default_rng(1)
    for k in (3, 8):
        counts = rng.integers(0, 9, (k, k))
        rows = [(i, j) for i in range(k) for j in range(k) for _ in range(counts[i, j])]
        found = clustering.align_labels(spark.createDataFrame(rows, "a int, b int"), "a", "b", k)
        total = sum(counts[x, y] for y, x in found.items())
        assert sorted(found.values()) == list(range(k))
        assert total == max(sum(counts[p[j], j] for j in range(k)) for p in permutations(range(k)))
    rows = [(i, i) for i in range(12) for _ in range(2)] + [(i, (i + 1) % 12) for i in range(12)]
    assert clustering.align_labels(spark.createDataFrame(rows, "a int, b int"), "a", "b", 12) == {i: i for i in range(12)}


def test_win_probability_of_large_means(spark):
    df = spark.createDataFrame([(80.0, 20.0), (800.0, 800.0), (0.0, 0.0), (1.5, 1.0), (2000.0, 10.0), (None, 1.0)], "a double, b double")
    rows = [r.asDict() for r in markets.xg_win_probability(df, "a", "b").collect()]
    for r in rows[:-1]:
        assert r["p_win"] + r["p_draw"] + r["p_loss"] == pytest.approx(1, abs=1e-9)
    assert rows[0]["p_win"] > 0.999999 and rows[1]["p_win"] == pytest.approx(rows[1]["p_loss"]) and rows[2]["p_draw"] == 1 and rows[4]["p_win"] == pytest.approx(1)
    assert rows[5]["p_win"] is None


def test_consistency_far_from_zero(spark):
    values = [1e8 + d for d in (0.1, 0.3, 0.5, 0.2, 0.6, 0.4)]
    df = spark.createDataFrame([("p", "t" if i % 2 else "u", 500.0, v) for i, v in enumerate(values)], "player string, team string, minutes_played double, v double")
    row = validation.player_consistency(df, "v", 400, 2).first()
    assert row["std"] == pytest.approx(np.std(values, ddof=1), rel=1e-6)


def test_bootstrap_draws_are_poisson(spark):
    n = 200_000
    draws = {int(r["w"]): r["count"] / n for r in spark.range(n).select(clustering.bootstrap_weight(F.col("id"), 0, 42).alias("w")).groupBy("w").count().collect()}
    mass = np.exp(-1)
    for i in range(8):
        assert draws.get(i, 0) == pytest.approx(mass, abs=0.004)
        mass /= i + 1
    assert max(draws) >= 7


def test_xg_sums_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 1, "A", f"p{i % 3}", float(round(0.001 * (i * 37 % 900), 3))) for i in range(500)]
    df = spark.createDataFrame(rows, "match_id int, possession int, team string, player string, x double")
    sums = set()
    for parts in (1, 4, 50):
        sums.add(df.repartition(parts).agg(xg.total(F.col("x")).alias("s")).first()["s"])
    assert len(sums) == 1
