"""One query of each family against its oracle, and the shape of the catalog."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["p1_ppda", "x4_xg_buildup", "d1_pressure_metrics", "g4_progressive_actions", "k1_packing", "a5_aggregate_all", "n4_normalise_columns", "s7_group_percentiles",
          "r2_top_players_balanced", "c19_final_scores", "q8_players_in_documents", "q23_event_price_impact", "e4_lineup_profile", "l12_audit_timestamps"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0
