"""Column helpers shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pitch marks on the 120 x 80 grid.
DEFENSIVE_EDGE = 40.0
MIDDLE_EDGE = 80.0
BOX_X = 102.0
BOX_Y = (18.0, 62.0)
OPEN_PLAY = ("Regular Play", "From Counter")


def zone(x: Column, last: str = "Attacking Third") -> Column:
    """Third of the pitch; a NULL x falls into the last third, as a CASE would put it."""
    return (
        F.when(x < DEFENSIVE_EDGE, "Defensive Third")
        .when(x < MIDDLE_EDGE, "Middle Third")
        .otherwise(last)
    )


def in_box(x: Column, y: Column) -> Column:
    return (x >= BOX_X) & y.between(*BOX_Y)


def ladder(default, *steps) -> Column:
    """First label whose condition holds. A NULL condition does not hold."""
    out = None
    for condition, label in steps:
        label = label if isinstance(label, Column) else F.lit(label)
        out = F.when(condition, label) if out is None else out.when(condition, label)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def ratio(num: Column, den: Column, scale: int | None = None, factor: float = 1.0) -> Column:
    """``factor * num / den`` as double, NULL for a zero denominator."""
    value = num.cast("double") * F.lit(float(factor)) / F.nullif(den.cast("double"), F.lit(0.0))
    return value if scale is None else F.round(value, scale)


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    return ratio(num, den, scale, 100.0)


def round_half(value: Column, scale: int) -> Column:
    """Rounded as ``round(x * 10^scale) / 10^scale``, so that a product that lies on a half goes away from zero.

    ``F.round`` looks at the shortest decimal of the value instead and takes 3.3499999999999996 to 3.3.
    """
    step = 10.0**scale
    return F.round(value.cast("double") * step) / F.lit(step)


def clip(value: Column, low=None, high=None) -> Column:
    if low is not None:
        value = F.when(value < low, F.lit(float(low))).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(float(high))).otherwise(value)
    return value


def clock_seconds(text: Column) -> Column:
    """Seconds of an ``MM:SS``, ``HH:MM:SS`` or ``HH:MM:SS.mmm`` string; NULL and '' give NULL."""
    parts = F.split(F.nullif(text, F.lit("")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60.0 + p.cast("double"))


def row_mean(columns: list[Column]) -> Column:
    """Mean of the non-NULL values of a row, NULL when there are none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return total / F.nullif(present.cast("double"), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(v*w)/sum(w) with the weights of NULL values kept in the denominator."""
    return F.sum(value * weight) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def weighted_mean_present(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over the rows where the value is present."""
    kept = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(kept).cast("double"), F.lit(0.0))


def sum_flag(condition: Column) -> Column:
    """Aggregate: number of rows where the condition holds."""
    return F.count(F.when(condition, F.lit(1)))


def scalar_stats(df: DataFrame, **exprs: Column) -> dict[str, Column]:
    """Whole-table aggregates as one scalar subquery; each value is a column usable anywhere."""
    stats = df.agg(F.struct(*[e.alias(k) for k, e in exprs.items()]).alias("s")).scalar()
    return {k: stats.getField(k) for k in exprs}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def in_match(df: DataFrame, match_id=None, **equals) -> DataFrame:
    """Optional point filters; they reach the parquet scan as pushed predicates."""
    if match_id is not None:
        df = df.filter(F.col("match_id") == match_id)
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def with_season(df: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Left join of the season name. Runs after aggregation, so only group rows are joined."""
    if matches is None:
        return df
    season = matches.select("match_id", "season_name")
    return df.join(season, "match_id", "left").select("season_name", *df.columns)


def rounded(df: DataFrame, scale: int = 4) -> DataFrame:
    """All double columns rounded, for reports and comparisons."""
    return df.select(*[F.round(c, scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
