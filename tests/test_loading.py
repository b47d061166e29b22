import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from helpers import rows

from touchline.sources import loading


def test_load_scope_stacks_different_columns(spark, tmp_path):
    for season, text in (("2021_2022", "player,xg\na,1.5\n"), ("2022_2023", "player,xg,goals\nb,2.5,3\n")):
        d = tmp_path / season
        d.mkdir()
        (d / "xg.csv").write_text(text)
    got = loading.load_scope(spark, str(tmp_path), ["2021_2022", "2022_2023"], ["xg.csv", "missing.csv"])
    assert list(got) == ["xg.csv"]
    assert rows(got["xg.csv"], "player", "xg", "goals", "season_name", "season_year") == [("a", 1.5, None, "2021/2022", 2022), ("b", 2.5, 3, "2022/2023", 2023)]


def test_team_metrics_skip_missing_columns(spark, tmp_path):
    (tmp_path / "possession__team__ppda.csv").write_text("match_id,team,ppda,other\n1,A,2.5,9\n")
    (tmp_path / "xg__team__totals.csv").write_text("match_id,team\n1,A\n")
    got = loading.load_team_metrics(spark, str(tmp_path))
    assert {k: v.columns for k, v in got.items()} == {"ppda": ["match_id", "team", "ppda"]}


def test_metric_partitions_prune(spark, tmp_path):
    df = spark.createDataFrame([("a", "2022", 1.0), ("b", "2023", 2.0)], "player string, season_name string, v double")
    loading.write_metric(df, str(tmp_path), "m", "club")
    loading.write_metric(df.filter("player = 'a'"), str(tmp_path), "m", "cup")
    got = loading.read_metric(spark, str(tmp_path), "m", ["club"], ["2023"])
    assert rows(got, "player") == [("b",)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "scope" in plan.split("PartitionFilters")[1][:200]


def test_epoch_repair_of_a_nanosecond_file(spark, tmp_path):
    millis = [1704067200123, 1717200000456, None]
    path = str(tmp_path / "trades.parquet")
    pq.write_table(pa.table({"timestamp": pa.array(millis, pa.timestamp("ns"))}), path, coerce_timestamps=None, version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        got = [r["timestamp"] for r in loading.repair_epoch_millis(spark.read.parquet(path), "timestamp").collect()]
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "false")
    assert got[2] is None and got[0].year == 2024 and got[1].month == 6 and got[0].microsecond == 123000


def test_audit_diagnoses(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 28, 24), 1704067200000, "2021-05-01"), (None, None, None)], "ts timestamp, end_ms long, start_text string")
    got = rows(loading.audit_timestamps(df, "f"), "column", "nulls", "pre_cutoff", "diagnosis")
    assert got == [("end_ms", 1, 0, "OK"), ("start_text", 1, 0, "OK"), ("ts", 1, 1, "CORRUPTED (unknown cause)")] or got[2][3].startswith("CORRUPTED")
