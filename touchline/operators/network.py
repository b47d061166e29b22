"""Pass network: edges, node degrees, average positions and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import in_match, ladder, pct, ratio, with_season
from touchline.operators.minutes import PLAYER, minutes_played


def _completed(events, match_id, team):
    return in_match(events, match_id, team=team).filter(
        (F.col("type") == "Pass") & F.col("pass_outcome").isNull() & F.col("player").isNotNull()
    )


def pass_network_centrality(events, matches=None, lineups=None, match_id=None, team=None) -> DataFrame:
    """Passes made and received, distinct partners, and the share of the team's passes.

    An edge is unique after the first aggregation, so a node's distinct partners are
    its edge count. Both ends are emitted from the edge and folded by one ``groupBy``,
    in place of two node aggregates and a full join.
    """
    edges = (
        _completed(events, match_id, team).filter(F.col("pass_recipient").isNotNull())
        .groupBy("match_id", "team", "player", "pass_recipient").agg(F.count("*").alias("n"))
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = edges.select("match_id", "team", F.explode(F.array(
        F.struct(F.col("player").alias("player"), F.col("n").alias("made"), zero.alias("got"), one.alias("out"), zero.alias("inn")),
        F.struct(F.col("pass_recipient").alias("player"), zero.alias("made"), F.col("n").alias("got"), zero.alias("out"), one.alias("inn")),
    )).alias("e")).select("match_id", "team", "e.*")
    nodes = ends.groupBy(*PLAYER).agg(
        F.sum("made").alias("passes_made"), F.sum("got").alias("passes_received"),
        F.sum("out").alias("unique_receivers"), F.sum("inn").alias("unique_passers"),
    )
    side = W.partitionBy("match_id", "team")
    out = nodes.select(
        *PLAYER, "passes_made", "passes_received",
        (F.col("passes_made") + F.col("passes_received")).alias("total_pass_involvement"),
        "unique_receivers", "unique_passers",
        (F.col("unique_receivers") + F.col("unique_passers")).alias("degree_centrality"),
        pct(F.col("passes_made") + F.col("passes_received"), F.sum("passes_made").over(side)).alias("network_involvement_pct"),
    )
    if lineups is None:
        out = out.withColumn("minutes_played", F.lit(0))
    else:
        out = out.join(minutes_played(lineups, events), PLAYER, "left").withColumn(
            "minutes_played", F.coalesce("minutes_played", F.lit(0))
        )
    return with_season(out, matches)


def pass_network_positions(events, matches=None, match_id=None, team=None) -> DataFrame:
    """Average pass origin per player."""
    rows = _completed(events, match_id, team).filter(F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
    out = rows.groupBy(*PLAYER).agg(
        F.round(F.avg("location_x"), 2).alias("avg_x"), F.round(F.avg("location_y"), 2).alias("avg_y"),
        F.count("*").alias("pass_count"),
    )
    return with_season(out, matches)


def network_role(events, matches=None, match_id=None, min_involvement: float = 5.0) -> DataFrame:
    """Role label from involvement, degree and the made/received balance."""
    rows = pass_network_centrality(events, matches, match_id=match_id).filter(
        F.col("network_involvement_pct") >= min_involvement
    )
    rows = rows.withColumn("pass_balance", ratio(F.col("passes_made"), F.col("passes_received") + 1, 2))
    return rows.withColumn("network_role", ladder(
        "Balanced",
        (F.col("network_involvement_pct") > 15, "Hub/Orchestrator"),
        (F.col("degree_centrality") > 10, "Connector"),
        (F.col("pass_balance") > 1.5, "Distributor"),
        (F.col("pass_balance") < 0.7, "Target"),
    ))
