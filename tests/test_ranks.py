import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions.ranks import average_rank, cell, exact_quantiles, rank_columns, value_positions
from touchline.functions.scale import cap_outliers, min_max, normalise_columns, zscore


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    # one group holds most rows, with ties, NULLs, negatives and a far outlier
    data = [(i, "hot" if rng.random() < 0.8 else f"g{i % 3}", None if i % 17 == 0 else round(rng.gauss(0, 3), 1)) for i in range(600)]
    data += [(600, "hot", 1e9), (601, "single", 4.0)]
    return spark.createDataFrame(data, "id int, g string, v double"), pd.DataFrame(data, columns=["id", "g", "v"])


def exchanged(df):
    """Bytes that the exchanges of the executed plan have written."""
    df._jdf.collectToPython()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            found = node.metrics().get("shuffleBytesWritten")
            total += found.get().value() if found.isDefined() else 0
            open_ += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_positions_match_pandas(table):
    df, pdf = table
    got = {(r["g"], r["v"]): r for r in value_positions(df, ["g"], "v").collect()}
    for g, part in pdf.dropna().groupby("g"):
        counts = part["v"].value_counts().sort_index()
        below = counts.cumsum() - counts
        for i, (v, n) in enumerate(counts.items()):
            r = got.pop((g, v))
            assert (r["n"], r["below"], r["dense"], r["total"], r["levels"]) == (n, below[v], i + 1, len(part), len(counts))
    assert not got


def test_cells_follow_the_order_of_values(spark):
    values = [float("-inf"), -1.7e308, -3.0, -2.9999999999, -2.0, -1e-3, -5e-324, 0.0, 5e-324, 1e-300, 0.1, 0.30000000000000004, 1.0, 1.0000000000000002,
              2.0, 1.7e9, 1.7e9 + 1e-6, 2.0**53, 1.7e308, float("inf"), float("nan")]
    rows_ = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r["c"] for r in rows_.orderBy("i").select(cell(F.col("v")).alias("c")).collect()]
    assert cells == sorted(cells) and len(set(cells)) >= len(cells) - 4
    assert [r["dense"] for r in value_positions(rows_, [], "v").orderBy("v").collect()] == list(range(1, len(values) + 1))


@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e9])
def test_average_rank_matches_pandas(table, scale):
    df, pdf = table
    got = {r["id"]: r["r"] for r in rank_columns(df.withColumn("v", F.col("v") * scale), ["id"], ["g"], {"v": "r"}, average_rank()).collect()}
    want = pdf.groupby("g")["v"].rank(method="average")
    for i, w in zip(pdf["id"], want):
        assert (got[i] is None) == bool(pd.isna(w))
        if not pd.isna(w):
            assert got[i] == pytest.approx(w)


def test_quantiles_match_numpy(table):
    df, pdf = table
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    assert len(got) == 5 * 5
    for g, part in pdf.dropna().groupby("g"):
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert got[(g, q)] == pytest.approx(np.quantile(part["v"], q))
    whole = exact_quantiles(df, [], "v", [0.3]).collect()
    assert [r["value"] for r in whole] == [pytest.approx(np.quantile(pdf["v"].dropna(), 0.3))]
    assert exact_quantiles(df.filter("v > 1e12"), [], "v", [0.3]).count() == 0


def test_nothing_runs_before_an_action(spark, table):
    df, _ = table
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        rank_columns(df, ["id"], ["g"], {"v": "r"}, average_rank())
        exact_quantiles(df, ["g"], "v", [0.5])
        cap_outliers(df, {"v": 0.9})
        zscore(df, ["g"], {"v": "o"})
        min_max(df, {"v": "o"}, ["g"])
        normalise_columns(df, ["id"], ["g"], {"a": ("v", "rank"), "b": ("v", "log"), "c": ("v", "zscore"), "d": ("id", "zscore")})
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_quantiles_do_not_shuffle_the_values(spark):
    """Five times the different values over the same range: ranks shuffle them all, quantiles only what shares a cell."""
    few, many = (spark.range(n).select((1 + F.col("id") / float(n)).alias("v")) for n in (300_000, 1_500_000))
    quantiles = [exchanged(exact_quantiles(d, [], "v", [0.25, 0.5, 0.9])) for d in (few, many)]
    assert quantiles[1] < 1.5 * quantiles[0]
    assert exchanged(value_positions(many, [], "v")) > 5 * quantiles[1]
    assert exact_quantiles(many, [], "v", [0.5]).first()["value"] == pytest.approx(1 + 749_999.5 / 1_500_000)


def test_normalise_null_takes_part_as_mean(spark):
    df = spark.createDataFrame([(1, "s", 1.0), (2, "s", None), (3, "s", 5.0), (4, "t", 9.0)], "id int, season string, v double")
    got = {r["id"]: r["o"] for r in normalise_columns(df, ["id"], ["season"], {"o": ("v", "rank")}).collect()}
    assert got == {1: 0.0, 2: None, 3: 1.0, 4: 0.5}


def test_normalise_log_floor_ties(spark):
    df = spark.createDataFrame([(1, "s", -3.0), (2, "s", 0.0), (3, "s", 2.0)], "id int, season string, v double")
    got = {r["id"]: r["o"] for r in normalise_columns(df, ["id"], ["season"], {"o": ("v", "log")}).collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 1.0}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, v double")
    assert {r["o"] for r in min_max(df, {"v": "o"}).collect()} == {50.0}
    assert {r["o"] for r in zscore(df, [], {"v": "o"}).collect()} == {0.0}


def test_cap_keeps_null(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    got = sorted((r["v"] for r in cap_outliers(df, {"v": 0.9}).collect()), key=lambda x: (x is None, x))
    assert got[-2:] == [9.0, None] and got[9] == 9.0
    assert df.agg(F.count("*")).first()[0] == len(got)


def test_several_z_columns_share_one_aggregate(spark):
    df = spark.createDataFrame([(1, "s", 1.0, 4.0), (2, "s", None, 6.0), (3, "s", 5.0, 8.0), (4, "t", 9.0, 1.0), (5, None, 2.0, 2.0)], "id int, season string, v double, w double")
    out = normalise_columns(df, ["id"], ["season"], {"a": ("v", "zscore"), "b": ("w", "zscore")})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {r["id"]: (r["a"], r["b"]) for r in out.collect()}
    filled = np.array([1.0, 3.0, 5.0])
    assert got[1] == pytest.approx(((1 - 3) / filled.std(ddof=1), -1.0)) and got[2] == (None, 0.0) and got[4] == (0.0, 0.0)
