"""Named queries: each is an operator over the given tables, with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.views import table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to tables and views by attribute: ``t.v_events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_views(sql)


def f_tail_sql(f: str, d1: str, d2: str, steps: int = 20_000) -> str:
    """P(F > f) for the oracle: the incomplete beta integral over an angle, by the midpoint rule."""
    angle = f"ATAN2(SQRT(({d2})::DOUBLE), SQRT(({d1}) * ({f})))"
    at = f"({angle} * (i + 0.5e0) / {steps})"
    density = (f"EXP((({d2}) - 1) * LN(SIN{at}) + (({d1}) - 1) * LN(COS{at}) + LGAMMA((({d1}) + ({d2})) / 2e0)"
               f" - LGAMMA(({d1}) / 2e0) - LGAMMA(({d2}) / 2e0))")
    return f"(SELECT SUM({density}) * 2 * {angle} / {steps} FROM RANGE({steps}) t(i))"
