from helpers import rows

from touchline.operators import clustering, markets

PAIR = "market_id string, token_id string"


def _tables(spark):
    frame = spark.createDataFrame
    return [
        frame([("m1", "e1"), ("m2", "e1"), ("m3", None), (None, "e3")], "market_id string, event_slug string"),
        frame([("m1", "t1"), ("m1", "t2"), ("m2", "t3"), ("mx", "t4"), (None, "t5"), (None, "t5")], PAIR),
        frame([("m1", "t1"), ("m1", "t3"), ("m1", "t3"), ("my", "t1"), (None, None), (None, "t5"), ("m2", None)], PAIR),
        frame([("m2", "t3"), ("mx", "t4"), ("m9", "t9"), ("m9", "t9")], PAIR),
        frame([("m1", 2), ("m2", 2), ("m3", 0), ("m4", None), (None, 1), ("mx", None)], "market_id string, token_count int"),
        frame([("e1",), ("e2",), (None,), ("e2",)], "event_slug string")]


def test_integrity_counts_are_those_of_joins_table_by_table(spark):
    m, t, r, o, s, e = _tables(spark)
    pair = ["market_id", "token_id"]
    anti = lambda child, parent, keys: markets.orphans(child, parent, keys).count()
    want = [anti(t, m, ["market_id"]), anti(m, t, ["market_id"]), anti(r, m, ["market_id"]), anti(r, t, ["token_id"]), anti(r.distinct(), t, pair),
            anti(o, m, ["market_id"]), anti(o, t, ["token_id"]), anti(o.distinct(), t, pair), anti(s, m, ["market_id"]), anti(m, s, ["market_id"]),
            anti(e, m, ["event_slug"]), markets.token_count_mismatch(s, t).count()]
    report = markets.integrity_report(m, t, r, o, s, e)
    assert {x["check"]: x["bad"] for x in report.collect()} == dict(zip(markets.CHECKS, want)) and min(want) > 0
    assert {x["status"] for x in report.collect()} == {"FAIL"}


def test_integrity_reads_every_table_once(spark):
    report = markets.integrity_report(*_tables(spark))
    plan = report._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 6 and plan.toString().count("Join") == 0


def test_integrity_of_empty_tables(spark):
    report = markets.integrity_report(*[t.limit(0) for t in _tables(spark)])
    assert [(r["bad"], r["status"]) for r in report.collect()] == [(0, "OK")] * 12


def test_report_of_a_market_table(spark):
    trades = spark.createDataFrame([("m1", 2.0, 0.5, "BUY"), ("m1", 4.0, None, "BUY"), ("m2", 6.0, 0.7, None)], "market_id string, size double, price double, side string")
    got = {(r["section"], r["item"]): r["value"] for r in markets.table_report(trades, "trades").collect()}
    assert got["overview", "rows"] == 3 and got["overview", "distinct market_id"] == 2 and got["overview", "total size"] == 12.0
    assert got["side", "BUY"] == 2 and got["side", None] == 1 and got["distribution of size", "q50"] == 4.0 and got["distribution of price", "null_count"] == 1
    assert ("overview", "first timestamp") not in got  # the table has no such column


def test_metric_tables_fold_to_the_sides_of_the_first(spark):
    a = spark.createDataFrame([(1, "A", 3.0), (1, "B", None), (None, "A", 5.0)], "match_id int, team string, progressive_carries double")
    b = spark.createDataFrame([(1, "A", 1.0), (2, "A", 9.0), (None, "A", 7.0)], "match_id int, team string, progressive_passes double")
    merged = clustering.merge_metrics([a, b])
    assert rows(merged, "match_id", "team", "progressive_carries", "progressive_passes", "progressive_carry_pct") == [
        (1, "A", 3.0, 1.0, 75.0), (1, "B", None, None, None), (None, "A", 5.0, None, None)]
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
