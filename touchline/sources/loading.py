"""Reading, scoping and writing of match data and metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import in_match
from touchline.operators.season import season_year

# The team metric files and the columns taken from each.
TEAM_FILES = {
    "ppda": ("possession__team__ppda.csv", ["ppda"]),
    "field_tilt": ("possession__team__field_tilt.csv", ["field_tilt_pct"]),
    "possession_pct": ("possession__team__percentage.csv", ["possession_pct"]),
    "epr": ("possession__team__value_epr.csv", ["epr"]),
    "line_height": ("defensive__team__line_height.csv", ["defensive_line_height"]),
    "xg": ("xg__team__totals.csv", ["npxg"]),
    "progression": ("progression__team__summary.csv", ["progressive_passes", "progressive_carries"]),
    "buildup": ("advanced__team__xg_buildup.csv", ["avg_xg_per_buildup_possession"]),
}
TIME_HINTS = ("timestamp", "date", "created", "start", "end", "first", "last")


# ---- scope (L1, L2, L6) --------------------------------------------------------------


def events_by_seasons(events: DataFrame, matches: DataFrame, seasons: list[str], exclude_competitions: list[str] = ()) -> DataFrame:
    """Events of the matches of some seasons, without some competitions."""
    chosen = matches.filter(F.col("season_name").isin(list(seasons)))
    if exclude_competitions:
        chosen = chosen.filter(~F.col("competition").isin(list(exclude_competitions)))
    return events.join(chosen.select("match_id"), "match_id", "left_semi")


def events_by_scope(events: DataFrame, matches: DataFrame, seasons: list[str] | None = None, competitions: list[str] | None = None) -> DataFrame:
    """Events of the matches in both lists; a missing list does not restrict."""
    chosen = matches
    if seasons:
        chosen = chosen.filter(F.col("season_name").isin(list(seasons)))
    if competitions:
        chosen = chosen.filter(F.col("competition").isin(list(competitions)))
    return events.join(chosen.select("match_id"), "match_id", "left_semi")


def match_events(events: DataFrame, match_id) -> DataFrame:
    return in_match(events, match_id).orderBy("period", "minute", "second", "index_num")


def player_events(events: DataFrame, player: str) -> DataFrame:
    return events.filter(F.col("player") == player)


# ---- named tables and summary (L7, L8) -----------------------------------------------


def register(spark: SparkSession, tables: dict[str, DataFrame | str]) -> None:
    """Register DataFrames or parquet paths under names that :func:`run_sql` can use."""
    for name, source in tables.items():
        (spark.read.parquet(source) if isinstance(source, str) else source).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    return spark.sql(sql, args=args or None)


def data_summary(matches: DataFrame, events: DataFrame, frames: DataFrame, top: int = 10) -> DataFrame:
    """Totals and the most frequent event types: (item, label, value)."""
    row = lambda df, item, agg: df.agg(F.lit(item).alias("item"), F.lit(None).cast("string").alias("label"), agg.cast("long").alias("value"))
    types = events.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(top)
    parts = [
        row(matches, "total_matches", F.count("*")), row(matches, "competitions", F.count_distinct("competition")), row(events, "total_events", F.count("*")),
        row(frames, "tracked_events", F.count_distinct("event_uuid")), types.select(F.lit("event_type").alias("item"), "label", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- metric tables (L3, L5) ----------------------------------------------------------


def write_metric(df: DataFrame, base: str, metric: str, scope: str, season_column: str = "season_name") -> None:
    """Store one metric table, partitioned by scope and season, so a scope or season is a pruned read."""
    out = df.withColumn("scope", F.lit(scope))
    if season_column not in df.columns:
        out = out.withColumn(season_column, F.lit("all"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", season_column).parquet(f"{base}/{metric}")


def read_metric(spark: SparkSession, base: str, metric: str, scopes: list[str] | None = None, seasons: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{base}/{metric}")
    if scopes:
        df = df.filter(F.col("scope").isin(list(scopes)))
    return df.filter(F.col("season_name").isin(list(seasons))) if seasons else df


TEXT_COLUMNS = {
    "player", "player_name", "team", "team_name", "season_name", "competition", "competition_name", "position", "position_name", "archetype", "country",
    "club", "zone", "scope", "name", "defensive_profile", "network_role", "passer_type", "progressive_profile"}
ID_COLUMNS = {"match_id", "season_year"}


def season_of_folder(folder: str) -> str:
    """'2021_2022' names the season '2021/2022'."""
    return folder.replace("_", "/", 1)


def read_metric_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV metric file with declared types, the same in every season: :data:`TEXT_COLUMNS`, whole-number
    :data:`ID_COLUMNS`, and doubles. The rows are read once; text where a number belongs is an error, not a NULL."""
    df = spark.read.csv(path, header=True)
    kind = lambda c: "string" if c in TEXT_COLUMNS else "int" if c in ID_COLUMNS else "double"
    return df.select(*[F.col(f"`{c}`").cast(kind(c)).alias(c) for c in df.columns])


def load_season(spark: SparkSession, folder: str, files: list[str], season: str) -> dict[str, DataFrame]:
    """CSV metric files of one season folder; files that are not there are left out."""
    out = {}
    for name in files:
        path = f"{folder}/{name}"
        if not _exists(spark, path):
            continue
        df = read_metric_file(spark, path)
        df = df if "season_name" in df.columns else df.withColumn("season_name", F.lit(season))
        out[name] = df.withColumn("season_name", F.col("season_name").cast("string")).withColumn("season_year", season_year(F.col("season_name")))
    return out


def load_scope(spark: SparkSession, base: str, folders: list[str], files: list[str]) -> dict[str, DataFrame]:
    """Season folders stacked per file; columns missing in a season are NULL."""
    seasons = [load_season(spark, f"{base}/{folder}", files, season_of_folder(folder)) for folder in folders]
    return stack_tables(seasons)


def load_multiple_scopes(spark: SparkSession, scopes: dict[str, list[str]], files: list[str]) -> dict[str, DataFrame]:
    return stack_tables([load_scope(spark, base, folders, files) for base, folders in scopes.items()])


def stack_tables(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    names = dict.fromkeys(n for part in parts for n in part)
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[n] for p in parts if n in p]) for n in names}


def load_team_metrics(spark: SparkSession, folder: str, files: dict[str, tuple[str, list[str]]] = TEAM_FILES) -> dict[str, DataFrame]:
    """The team metric files projected to their columns; a missing file or column leaves the metric out."""
    out = {}
    for key, (name, columns) in files.items():
        path = f"{folder}/{name}"
        if not _exists(spark, path):
            continue
        df = read_metric_file(spark, path)
        if set(columns) <= set(df.columns):
            out[key] = df.select("match_id", "team", *columns)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


# ---- timestamps (L11, L12) -----------------------------------------------------------


def repair_epoch_millis(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps from milliseconds that a file declares as nanoseconds.

    Read such a file with ``spark.sql.legacy.parquet.nanosAsLong=true``; the column then holds the
    stored number. A column already rewritten to a timestamp is restored to the second.
    """
    types = dict(df.dtypes)
    for c in columns:
        millis = F.col(c) if types[c] == "bigint" else F.unix_micros(F.col(c).cast("timestamp")) * 1000
        df = df.withColumn(c, F.timestamp_millis(millis))
    return df


def _readings(column: str, kind: str) -> tuple[Column, Column]:
    """(value as it stands, value read as milliseconds) in epoch seconds."""
    if kind in ("timestamp", "timestamp_ntz"):
        seconds = F.unix_micros(F.col(column).cast("timestamp")) / 1e6
        return seconds, F.unix_micros(F.col(column).cast("timestamp"))  # ms stored as ns: micros are seconds
    if kind in ("bigint", "int"):
        v = F.abs(F.col(column).cast("double"))
        return F.when(v >= 1e12, F.col(column) / 1e3).when(v >= 1e9, F.col(column).cast("double")), F.lit(None).cast("double")
    return F.unix_timestamp(F.try_to_timestamp(F.col(column))).cast("double"), F.lit(None).cast("double")


def audit_timestamps(df: DataFrame, name: str, cutoff: str = "2020-01-01") -> DataFrame:
    """Per time column: totals, values before the cut-off, range and a diagnosis. One aggregation for all columns."""
    fields = [(c, t) for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz") or (t in ("bigint", "int", "string") and any(h in c.lower() for h in TIME_HINTS))]
    limit = F.unix_timestamp(F.to_timestamp(F.lit(cutoff))).cast("double")
    aggs = [F.count("*").alias("n")]
    for i, (c, t) in enumerate(fields):
        plain, millis = _readings(c, t)
        aggs += [F.count(plain).alias(f"k{i}"), sum_flag_lt(plain, limit).alias(f"p{i}"), F.min(plain).alias(f"lo{i}"), F.max(plain).alias(f"hi{i}"), F.min(millis).alias(f"alt{i}")]
    row = df.agg(*aggs)
    out = []
    for i, (c, t) in enumerate(fields):
        stamp = t.startswith("timestamp")
        fixed = F.col(f"alt{i}") >= limit
        bad = F.when(fixed, "CORRUPTED (ms-as-ns, fix: cast Int64->Datetime(ms))").otherwise("CORRUPTED (unknown cause)") if stamp else F.lit("CORRUPTED (pre-2020 values)")
        out.append(F.struct(
            F.lit(c).alias("column"), F.col("n").alias("total"), (F.col("n") - F.col(f"k{i}")).alias("nulls"), F.col(f"p{i}").alias("pre_cutoff"),
            F.col(f"lo{i}").alias("min_epoch"), F.col(f"hi{i}").alias("max_epoch"), F.when(F.col(f"p{i}") > 0, bad).otherwise("OK").alias("diagnosis")))
    return row.select(F.lit(name).alias("file"), F.explode(F.array(*out)).alias("r")).select("file", "r.*")


def sum_flag_lt(value: Column, limit: Column) -> Column:
    return F.count(F.when(value < limit, F.lit(1)))
