"""Prediction-market prices against results: integrity, final odds, pricing and impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import ladder, ratio, sum_flag
from touchline.functions.lineage import cut_lineage
from touchline.functions.ranks import average_rank, quantile_scalars, rank_columns
from touchline.functions.tests_of_difference import t_two_sided
from touchline.operators.profiling import describe


# ---- integrity and volume (Q1-Q3) ----------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``child`` whose key has no row in ``parent``."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def token_count_mismatch(summary: DataFrame, tokens: DataFrame) -> DataFrame:
    actual = tokens.groupBy("market_id").agg(F.count("*").alias("actual_token_count"))
    return summary.join(actual, "market_id", "left").filter(
        F.col("actual_token_count").isNull() | (F.col("token_count") != F.col("actual_token_count"))
    ).select("market_id", "token_count", "actual_token_count")


CHECKS = [
    "tokens reference missing markets", "markets missing tokens", "trades reference missing markets", "trades reference missing tokens",
    "trades have valid pairs", "odds reference missing markets", "odds reference missing tokens", "odds have valid pairs",
    "summary references missing markets", "markets missing summary rows", "events not found in markets", "summary token count matches"]


def integrity_report(markets, tokens, trades, odds, summary, event_stats) -> DataFrame:
    """One row per check with the number of bad rows or pairs.

    Every table is read once and reduced to its keys with their counts. The keys of all tables meet in one aggregate
    with a count of each table, and all checks are sums over it. A NULL in a key belongs to no other table.
    """
    names = ["markets", "tokens", "trades", "odds", "summary", "events"]
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")

    def keyed(table: DataFrame, name: str, keys: list[str], kinds: list[tuple[str, str | None, str | None]], listed=None) -> DataFrame:
        counts = table.groupBy(*keys).agg(F.count("*").alias("n"))
        key = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text(a).alias("a"), text(b).alias("b")) for k, a, b in kinds]))
        stated = F.struct(F.col(listed).cast("long").alias("count"), F.col("n")) if listed else F.lit(None).cast("struct<count:long,n:long>")
        return counts.select(key.alias("k"), stated.alias("stated"), *[(F.col("n") if m == name else F.lit(0).cast("long")).alias(m) for m in names]).select("k.*", "stated", *names)

    by_pair = [("market", "market_id", None), ("token", None, "token_id"), ("pair", "market_id", "token_id")]
    pair = ["market_id", "token_id"]
    parts = [
        keyed(markets, "markets", ["market_id", "event_slug"], [("market", "market_id", None), ("slug", "event_slug", None)]),
        keyed(tokens, "tokens", pair, by_pair), keyed(trades, "trades", pair, by_pair), keyed(odds, "odds", pair, by_pair),
        keyed(summary, "summary", ["market_id", "token_count"], [("market", "market_id", None)], "token_count"),
        keyed(event_stats, "events", ["event_slug"], [("slug", "event_slug", None)])]
    # the summary rows of a market state a handful of counts at most
    met = reduce(DataFrame.unionByName, parts).groupBy("kind", "a", "b").agg(*[F.sum(n).alias(n) for n in names], F.collect_list("stated").alias("stated"))
    known = {"market": F.col("a").isNotNull(), "token": F.col("b").isNotNull(), "pair": F.col("a").isNotNull() & F.col("b").isNotNull(), "slug": F.col("a").isNotNull()}

    def lost(kind: str, table: str, other: str, amount: Column | None = None) -> Column:
        """Rows of ``table`` with a key that ``other`` has no row for."""
        return F.sum(F.when((F.col("kind") == kind) & ~(known[kind] & (F.col(other) > 0)), F.col(table) if amount is None else amount))

    some = lambda table: (F.col(table) > 0).cast("long")
    actual = F.when(known["market"] & (F.col("tokens") > 0), F.col("tokens"))
    differs = F.aggregate("stated", F.lit(0).cast("long"), lambda s, x: s + F.when(actual.isNull() | (x["count"] != actual), x["n"]).otherwise(0))
    sums = [lost("market", "tokens", "markets"), lost("market", "markets", "tokens"), lost("market", "trades", "markets"), lost("token", "trades", "tokens"),
            lost("pair", "trades", "tokens", some("trades")), lost("market", "odds", "markets"), lost("token", "odds", "tokens"),
            lost("pair", "odds", "tokens", some("odds")), lost("market", "summary", "markets"), lost("market", "markets", "summary"),
            lost("slug", "events", "markets"), F.sum(F.when(F.col("kind") == "market", differs))]
    found = met.agg(*[F.coalesce(s, F.lit(0).cast("long")).alias(f"c{i}") for i, s in enumerate(sums)])
    out = found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("bad")) for i, n in enumerate(CHECKS)])).alias("r")).select("r.*")
    return out.withColumn("status", F.when(F.col("bad") == 0, "OK").otherwise("FAIL"))


def markets_per_month(markets: DataFrame, months: int = 24) -> DataFrame:
    """Market counts of the last months that have any."""
    return markets.filter(F.col("created_at").isNotNull()).groupBy(
        F.trunc(F.to_date("created_at"), "MM").alias("created_month")).agg(F.count("*").alias("market_count")).orderBy(
        F.desc("created_month")).limit(months)


def event_lifetime(markets: DataFrame) -> DataFrame:
    """Markets, volume and days from the first market to the last end per event."""
    out = markets.groupBy("event_slug").agg(
        F.min("created_at").alias("first_market"), F.max("end_date").alias("last_market"),
        F.count("market_id").alias("market_count"), F.sum("volume").alias("total_volume"))
    seconds = epoch_seconds(F.col("last_market")) - epoch_seconds(F.col("first_market"))
    return out.withColumn("duration_days", F.floor(seconds / 86400.0).cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, read as it stands, whatever the session zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def top_markets(markets: DataFrame, by: str = "volume", n: int = 15) -> DataFrame:
    return markets.orderBy(F.desc_nulls_last(by), "market_id").limit(n)


def market_overview(df: DataFrame, distinct: list[str], sums: list[str], flags: list[str] = (), times: list[str] = ()) -> DataFrame:
    """Row count, distinct keys, totals, flag counts and time range of one market table."""
    return df.agg(
        F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct], *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[sum_flag(F.col(c)).alias(f"n_{c}") for c in flags], *[f(c).alias(f"{n}_{c}") for c in times for n, f in (("first", F.min), ("last", F.max))])


# What a report of each market table holds: distinct keys, totals, flags, time columns, value counts and distributions.
REPORTS = {
    "markets": {"distinct": ["market_id"], "sums": ["volume"], "flags": ["active", "closed"], "counts": ["category"]},
    "tokens": {"distinct": ["market_id", "token_id"], "counts": ["outcome"]},
    "trades": {"distinct": ["market_id"], "sums": ["size"], "times": ["timestamp"], "counts": ["side"], "stats": ["size", "price"]},
    "odds": {"distinct": ["market_id", "token_id"], "stats": ["price"]},
    "events": {"sums": ["market_count", "total_volume"]},
    "summary": {"sums": ["trade_count"], "flags": ["active"], "times": ["first_trade", "last_trade"]},
}


def table_report(df: DataFrame, kind: str) -> DataFrame:
    """Report of a market table in long form: (section, item, value).

    Sections are the overview (rows, distinct keys, totals, flags, first and last second of the time columns), a section of counts for
    each of the table's category columns, and a section for each distribution. Columns that ``df`` lacks are passed over.
    """
    has = {k: [c for c in v if c in df.columns] for k, v in REPORTS[kind].items()}
    row = lambda s, i, v: F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.cast("double").alias("value"))
    cells = {"rows": F.count("*")}
    cells |= {f"distinct {c}": F.count_distinct(c) for c in has.get("distinct", [])} | {f"total {c}": F.sum(c) for c in has.get("sums", [])}
    cells |= {c: sum_flag(F.col(c)) for c in has.get("flags", [])}
    cells |= {f"{n} {c}": epoch_seconds(f(c)) for c in has.get("times", []) for n, f in (("first", F.min), ("last", F.max))}
    out = df.agg(*[v.alias(f"c{i}") for i, v in enumerate(cells.values())]).select(
        F.explode(F.array(*[row("overview", n, F.col(f"c{i}")) for i, n in enumerate(cells)])).alias("r")).select("r.*")
    if has.get("counts"):
        named = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("item")) for c in has["counts"]])
        out = out.unionByName(df.select(F.explode(named).alias("r")).groupBy("r.section", "r.item").agg(F.count("*").cast("double").alias("value")))
    if has.get("stats"):
        items = ["count", "null_count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        out = out.unionByName(describe(df, has["stats"]).select(F.explode(F.array(*[
            F.struct(F.concat(F.lit("distribution of "), F.col("metric")).alias("section"), F.lit(i).alias("item"), F.col(i).cast("double").alias("value"))
            for i in items])).alias("r")).select("r.*"))
    return out


# ---- prices (Q4-Q6, Q23) -------------------------------------------------------------


def main_token(tokens: DataFrame) -> DataFrame:
    """The "Yes" token of each market, or its first token by id."""
    yes = F.coalesce(F.lower("outcome").contains("yes"), F.lit(False))
    return tokens.groupBy("market_id").agg(F.min_by("token_id", F.struct((~yes).alias("k"), F.col("token_id"))).alias("token_id"))


def last_prices(odds: DataFrame, keys: list[str]) -> DataFrame:
    """Latest price per key; partial maxima are merged, so a busy market is never gathered."""
    return odds.groupBy(*keys).agg(F.max_by("price", F.struct("timestamp", "price")).alias("final_odds"), F.max("timestamp").alias("last_seen"))


def final_market_odds(odds: DataFrame, tokens: DataFrame) -> DataFrame:
    """Last price of the main token of each market."""
    keys = ["market_id", "token_id"]
    return last_prices(odds.join(main_token(tokens), keys, "left_semi"), keys)


def last_snapshot(odds: DataFrame) -> DataFrame:
    """The last snapshot of each market, whatever its token."""
    order = F.struct("timestamp", "token_id")
    return odds.groupBy("market_id").agg(F.max_by(F.struct("token_id", "price"), order).alias("r")).select(
        "market_id", "r.token_id", F.col("r.price").alias("final_odds"))


def team_odds(markets_teams: DataFrame, odds: DataFrame, tokens: DataFrame) -> DataFrame:
    """Last price of the token whose outcome names the team, for (market_id, team) rows."""
    named = markets_teams.select("market_id", "team").join(tokens, "market_id").filter(
        F.lower("outcome").contains(F.lower("team"))).groupBy("market_id", "team").agg(F.min("token_id").alias("token_id"))
    prices = last_prices(odds.join(named.select("market_id", "token_id").distinct(), ["market_id", "token_id"], "left_semi"), ["market_id", "token_id"])
    return named.join(prices.drop("last_seen"), ["market_id", "token_id"])


def event_price_impact(goals: DataFrame, odds: DataFrame, minutes: int = 5, soon: int = 2) -> DataFrame:
    """Price just before a goal, right after it and at the end of the window.

    ``goals`` has goal_id, market_id and ts. A goal is sent to the three time slots its window
    can touch; odds rows meet only the goals of their own market and slot.
    """
    width = minutes * 60
    slot = F.floor(epoch_seconds(F.col("ts")) / width)
    g = goals.select("goal_id", "market_id", F.col("ts").alias("goal_ts"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    o = odds.select("market_id", "token_id", "price", F.col("timestamp").alias("t"), F.floor(epoch_seconds(F.col("timestamp")) / width).alias("slot"))
    span = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    near = o.join(g, ["market_id", "slot"]).filter(F.col("t").between(F.col("goal_ts") - span(minutes), F.col("goal_ts") + span(minutes)))
    before, after = F.col("t") < F.col("goal_ts"), F.col("t") >= F.col("goal_ts")
    at = lambda f, cond: f("price", F.when(cond, F.struct("t", "price")))
    out = near.groupBy("goal_id", "market_id", "token_id").agg(
        at(F.max_by, before).alias("price_before"), at(F.min_by, after & (F.col("t") <= F.col("goal_ts") + span(soon))).alias("price_after"),
        at(F.max_by, after).alias("price_end"), F.count("*").alias("snapshots"))
    return out.withColumn("change_pct", ratio(F.col("price_after") - F.col("price_before"), F.col("price_before"), 2, 100.0))


# ---- tournament statistics (Q13-Q15, Q25) --------------------------------------------


def team_tournament_stats(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Goals and xG for and against per (tournament, team)."""
    xg = events.filter(F.col("type") == "Shot").groupBy("match_id", "team").agg(F.sum("shot_statsbomb_xg").alias("xg"))
    total = xg.groupBy("match_id").agg(F.sum("xg").alias("match_xg"))
    side = lambda t, a, b: F.struct(F.col(t).alias("team"), F.col(a).alias("gf"), F.col(b).alias("ga"))
    long = matches.select("match_id", F.col("competition").alias("tournament"), F.explode(F.array(
        side("home_team", "home_score", "away_score"), side("away_team", "away_score", "home_score"))).alias("s")).select("match_id", "tournament", "s.*")
    own = F.coalesce(F.col("xg"), F.lit(0.0))
    rows = long.join(xg, ["match_id", "team"], "left").join(total, "match_id", "left")
    out = rows.groupBy("tournament", "team").agg(
        F.count("*").alias("matches_played"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
        F.sum(own).alias("xf"), F.sum(F.coalesce(F.col("match_xg"), F.lit(0.0)) - own).alias("xa"))
    return out.select(
        "tournament", "team", "matches_played", "goals_for", "goals_against", (F.col("goals_for") - F.col("goals_against")).alias("goal_diff"),
        F.round("xf", 2).alias("xg_for"), F.round("xa", 2).alias("xg_against"), F.round(F.col("xf") - F.col("xa"), 2).alias("xg_diff"),
        F.round(F.col("xf") / F.col("matches_played"), 2).alias("xg_per_match"))


def player_tournament_stats(matches: DataFrame, lineups: DataFrame, events: DataFrame, end_minute: int = 90) -> DataFrame:
    """Minutes, xG, xG per 90, shots and goals per (tournament, player); an open end counts as minute 90."""
    where = matches.select("match_id", F.col("competition").alias("tournament"))
    minute = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1)).cast("int")
    played = lineups.select("match_id", F.col("player_name").alias("player"), (
        F.coalesce(minute("to_time"), F.lit(end_minute)) - F.coalesce(minute("from_time"), F.lit(0))).alias("m"))
    played = played.groupBy("match_id", "player").agg(F.sum("m").alias("m")).join(where, "match_id").groupBy("tournament", "player").agg(F.sum("m").alias("minutes_played"))
    shots = events.filter((F.col("type") == "Shot") & F.col("player").isNotNull()).groupBy("match_id", "player").agg(
        F.sum("shot_statsbomb_xg").alias("xg"), F.count("*").alias("shots"), sum_flag(F.col("shot_outcome") == "Goal").alias("goals"))
    shots = shots.join(where, "match_id").groupBy("tournament", "player").agg(
        F.sum("xg").alias("xg"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    x, m = F.coalesce("xg", F.lit(0.0)), F.col("minutes_played")
    return played.join(shots, ["tournament", "player"], "left").select(
        "tournament", "player", "minutes_played", F.round(x, 2).alias("total_xg"),
        F.when(m > 0, F.round(x / (F.nullif(m.cast("double"), F.lit(0.0)) / 90.0), 2)).otherwise(0.0).alias("xg_per_90"),
        F.coalesce("shots", F.lit(0)).cast("long").alias("shots"), F.coalesce("goals", F.lit(0)).cast("long").alias("goals"))


def find_match(wanted: DataFrame, matches: DataFrame) -> DataFrame:
    """Earliest match of an unordered pair of teams in a tournament, for (team_a, team_b, tournament) rows."""
    pair = lambda a, b: [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]
    first = matches.select("match_id", "match_date", F.col("competition").alias("tournament"), *pair("home_team", "away_team")).groupBy(
        "tournament", "_x", "_y").agg(F.min_by("match_id", F.struct("match_date", "match_id")).alias("match_id"))
    return wanted.select("*", *pair("team_a", "team_b")).join(first, ["tournament", "_x", "_y"], "left").drop("_x", "_y")


def period_overlap(a: DataFrame, a_time: str, b: DataFrame, b_time: str) -> DataFrame:
    """Common date range of two tables and its length; no days when they do not meet."""
    span = lambda df, t: df.agg(F.min(F.to_date(t)).alias("lo"), F.max(F.to_date(t)).alias("hi"))
    both = span(a, a_time).unionByName(span(b, b_time)).agg(F.max("lo").alias("overlap_start"), F.min("hi").alias("overlap_end"))
    meets = F.col("overlap_start") < F.col("overlap_end")
    return both.withColumn("days", F.when(meets, F.datediff("overlap_end", "overlap_start")).otherwise(0))


def common_years(a: DataFrame, a_time: str, b: DataFrame, b_time: str) -> DataFrame:
    """Years present in both tables with the row counts of each."""
    count = lambda df, t, n: df.groupBy(F.year(F.to_date(t)).alias("year")).agg(F.count("*").alias(n))
    return count(a, a_time, "a_rows").join(count(b, b_time, "b_rows"), "year")


# ---- pricing statistics (Q16-Q22, Q24) -----------------------------------------------


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation over complete pairs with its two-sided p-value."""
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = kept.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    dof = F.col("n") - 2
    t = F.col("r") * F.sqrt(dof / F.nullif(1.0 - F.col("r") * F.col("r"), F.lit(0.0)))
    return out.withColumn("_t", t).withColumn("p_value", t_two_sided(F.col("_t"), dof)).drop("_t")


def spearman(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Correlation of the average ranks."""
    kept = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, x, y)
    ranks = rank_columns(kept, [key], [], {x: "_rx", y: "_ry"}, average_rank())
    return pearson(ranks, "_rx", "_ry")


def mispricing(df: DataFrame, x: str, price: str) -> DataFrame:
    """Simple regression of the price, clipped expectation, residual and mispricing per row."""
    fit = df.agg(F.struct(F.regr_slope(price, x).alias("slope"), F.regr_intercept(price, x).alias("intercept")).alias("f")).scalar()
    out = df.withColumn("_f", fit)
    line = F.col("_f.slope") * F.col(x) + F.col("_f.intercept")
    out = out.withColumn("expected_prob", F.when(line.isNotNull(), F.least(F.greatest(line, F.lit(0.0)), F.lit(1.0))))
    return out.withColumn("residual", F.col(price) - F.col("expected_prob")).withColumn("mispricing", -F.col("residual")).drop("_f")


def mispricing_summary(df: DataFrame, x: str, price: str, edge: float = 0.05) -> DataFrame:
    """Regression line, fit and the size of the mispricing, as one row."""
    rows = mispricing(df, x, price)
    m, n = F.col("mispricing"), F.regr_count(price, x)
    out = rows.agg(
        F.regr_slope(price, x).alias("slope"), F.regr_intercept(price, x).alias("intercept"), F.regr_r2(price, x).alias("r2"), n.alias("n"),
        F.avg(F.abs(m)).alias("mae"), F.max(m).alias("max_underpriced"), F.min(m).alias("max_overpriced"), F.stddev_samp(m).alias("std"),
        sum_flag(m > edge).alias("n_value"), sum_flag(m < -edge).alias("n_overpriced"))
    dof = F.col("n") - 2
    t = F.sqrt(F.col("r2") * dof / F.nullif(1.0 - F.col("r2"), F.lit(0.0)))
    return out.withColumn("_t", t).withColumn("p_value", t_two_sided(F.col("_t"), dof)).drop("_t")


def t_test(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Two-sample t-test with pooled variance between the rows where ``group`` holds and the rest."""
    kept = df.withColumn("_g", group).filter(F.col(value).isNotNull() & F.col("_g").isNotNull())
    stat = lambda f, g: f(F.when(F.col("_g") == g, F.col(value)))
    out = kept.agg(*[stat(f, g).alias(f"{n}_{s}") for g, s in ((True, "a"), (False, "b")) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.coalesce("var_a", F.lit(0.0)) + (nb - 1) * F.coalesce("var_b", F.lit(0.0))) / F.nullif((na + nb - 2).cast("double"), F.lit(0.0))
    se = F.sqrt(pooled * (1.0 / F.nullif(na.cast("double"), F.lit(0.0)) + 1.0 / F.nullif(nb.cast("double"), F.lit(0.0))))
    out = out.withColumn("t_statistic", (F.col("mean_a") - F.col("mean_b")) / F.nullif(se, F.lit(0.0)))
    return out.withColumn("p_value", t_two_sided(F.col("t_statistic"), na + nb - 2)).drop("var_a", "var_b")


def median_split_test(df: DataFrame, value: str, split: str) -> DataFrame:
    """t-test of the rows under the median of ``split`` against the rest."""
    df = cut_lineage(df)
    median = quantile_scalars(df, {"m": (split, 0.5)})["m"]
    return t_test(df.withColumn("_low", F.col(split) < median), value, F.col("_low"))


def finishing(df: DataFrame) -> DataFrame:
    """Goals over xG and xG over goals conceded."""
    return df.withColumn("finishing", F.col("goals_for") - F.col("xg_for")).withColumn(
        "defensive_performance", F.col("xg_against") - F.col("goals_against"))


def extremes(df: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """The n largest and n smallest rows of a column."""
    top = df.select(key, column).filter(F.col(column).isNotNull()).orderBy(F.desc(column), key).limit(n).withColumn("end", F.lit("top"))
    low = df.select(key, column).filter(F.col(column).isNotNull()).orderBy(column, key).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low)


def forecast_cases(df: DataFrame) -> DataFrame:
    """Market favourite, xG favourite, actual winner and the case label per match with both prices."""
    kept = df.filter(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull())
    pick = lambda a, b: F.when(F.col(a) > F.col(b), F.col("home_team")).otherwise(F.col("away_team"))
    actual = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).when(
        F.col("away_score") > F.col("home_score"), F.col("away_team")).otherwise("Draw")
    out = kept.withColumn("market_favourite", pick("home_odds", "away_odds")).withColumn("xg_favourite", pick("home_xg", "away_xg")).withColumn("actual", actual)
    m, x, a = F.col("market_favourite"), F.col("xg_favourite"), F.col("actual")
    return out.withColumn("case", ladder(
        "COMPLEX", ((m == x) & (x == a), "PERFECT ALIGNMENT"), ((m == a) & (x != a), "MARKET RIGHT, xG WRONG"),
        ((x == a) & (m != a), "MARKET WRONG, xG RIGHT"), ((m != a) & (x != a), "UPSET / HIGH VARIANCE")))


def forecast_tally(cases: DataFrame) -> DataFrame:
    m, x = F.col("market_favourite") == F.col("actual"), F.col("xg_favourite") == F.col("actual")
    return cases.agg(F.count("*").alias("total"), sum_flag(m).alias("market_correct"), sum_flag(x).alias("xg_correct"),
                     sum_flag(m & x).alias("both_correct"), sum_flag(~m & ~x).alias("both_wrong"))


def brier(p: str, y: str) -> Column:
    """Aggregate: mean squared difference of probability and outcome."""
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def xg_win_probability(df: DataFrame, a: str, b: str) -> DataFrame:
    """Win, draw and loss probabilities of two independent Poisson scores.

    Goals are summed from 0 to twelve deviations above the larger mean of the row, where the rest of both tails is
    below the precision of a double. Each term comes from its logarithm, so that no mean is too large to start from,
    and win and loss are sums of their own.
    """
    la, lb = F.col(a).cast("double"), F.col(b).cast("double")
    ok = la.isNotNull() & lb.isNotNull() & (la >= 0) & (lb >= 0)
    high = F.greatest(la, lb)
    last = F.ceil(high + 12 * F.sqrt(high) + 30).cast("int")

    def term(mean: Column, i: Column, log_factorial: Column) -> Column:
        return F.when(mean > 0, F.exp(i * F.log(mean) - mean - log_factorial)).otherwise(F.when(i == 0, 1.0).otherwise(0.0))

    start = F.struct(*[F.lit(0.0).alias(n) for n in ("fact", "below_a", "below_b", "win", "draw", "loss")])

    def step(s, i):
        fact = s["fact"] + F.when(i > 0, F.log(i.cast("double"))).otherwise(0.0)
        pa, pb = term(la, i, fact), term(lb, i, fact)
        return F.struct(fact.alias("fact"), (s["below_a"] + pa).alias("below_a"), (s["below_b"] + pb).alias("below_b"), (s["win"] + pa * s["below_b"]).alias("win"),
                        (s["draw"] + pa * pb).alias("draw"), (s["loss"] + pb * s["below_a"]).alias("loss"))

    folded = F.aggregate(F.sequence(F.lit(0), last), start, step)
    df = df.withColumn("_f", F.when(ok, folded))
    return df.withColumn("p_win", F.col("_f.win")).withColumn("p_draw", F.col("_f.draw")).withColumn("p_loss", F.col("_f.loss")).drop("_f")


def value_edge(p: Column, price: Column) -> Column:
    edge = p - price
    return ladder("No value", (edge > 0.15, "Strong value"), (edge > 0.10, "Significant value"), (edge > 0.05, "Small value"))
