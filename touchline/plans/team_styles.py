"""Team styles end to end: match metrics, team features, clusters, mixture, final score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage
from touchline.operators import clustering, possession, progression, validation, xg

# Style names from the most to the least aggressive press (lowest PPDA first).
STYLES = [
    "High Press / High Output", "Possession Dominant", "Compact Transition", "Mid-Block Reactive", "Moderate Possession", "Low Intensity",
]


def match_metrics(events: DataFrame) -> DataFrame:
    """The eight match-level metric tables joined on (match, team)."""
    side = clustering.SIDE
    tables = [
        possession.ppda(events).select(*side, "ppda"),
        possession.field_tilt(events).select(*side, "field_tilt_pct"),
        possession.possession_value(events).select(*side, "possession_pct", "epr"),
        possession.defensive_line_height(events).select(*side, "defensive_line_height"),
        xg.xg_by_team(events).select(*side, "npxg", "total_xg"),
        progression.team_progression_summary(events).select(*side, "progressive_carries", "progressive_passes"),
        xg.team_xg_buildup(events).select(*side, "avg_xg_per_buildup_possession"),
    ]
    return clustering.merge_metrics(tables)


def team_styles(
    metrics: DataFrame, presence: DataFrame, k: int = 6, n_init: int = 20, exclude: list[str] = (), renames: dict[str, str] | None = None,
    known: DataFrame | None = None, cap: bool = True,
) -> DataFrame:
    """Clustered teams with blended, evidence-weighted scores."""
    # a row for each team, read many times over: the events are gone through once
    teams = cut_lineage(clustering.team_level(metrics)).filter(~F.col("team").isin(list(exclude)))
    scaled = clustering.cap_and_scale(teams)
    names = STYLES[:k]
    rested = clustering.runs_at_rest(scaled, k, n_init)
    rows, _ = clustering.fit_kmeans(scaled.withColumn("_press", -F.col("ppda")), ["_press"], k, n_init, names, "_press", rested=rested)
    rows = clustering.mixture_probabilities(rows, k, n_init=n_init, rested=rested)
    out = validation.final_scores(rows, names, presence, cap=cap)
    if known is not None:
        out = validation.reconcile_names(out, renames or {}, known)
    drop = [c for c in out.columns if c.endswith("_z")] + ["features", "_press", "proba", "gmm", "gmm_aligned"]
    return reduce(lambda d, c: d.withColumn(c, F.round(c, 4)), [c for c in clustering.CORE_METRICS if c in out.columns], out.drop(*drop))
