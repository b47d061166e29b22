"""Team features, k-means and mixtures (``fits``), and their fit statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.columns import ratio, row_mean, scalar_stats
from touchline.functions.lineage import cut_lineage, join_statistics
from touchline.functions.ranks import unpivot
from touchline.functions.scale import cap_outliers
from touchline.operators import fits

CORE_METRICS = [
    "ppda", "defensive_line_height", "field_tilt_pct", "possession_pct", "progressive_carry_pct", "epr", "npxg",
    "avg_xg_per_buildup_possession",
]
CLUSTER_FEATURES = CORE_METRICS + ["ppda_std", "possession_pct_std"]
SIDE = ["match_id", "team"]


# ---- features (C1-C5) ----------------------------------------------------------------


def carry_share() -> Column:
    carries, passes = F.col("progressive_carries"), F.col("progressive_passes")
    return ratio(carries, carries + passes, None, 100.0)


def merge_metrics(tables: list[DataFrame]) -> DataFrame:
    """The sides (match, team) of the first table with the metrics of all, and the share of carries.

    The tables are stacked and folded by one aggregate; each has a row for a side at most.
    """
    parts = [tables[0].withColumn("_first", F.lit(1)), *(t.dropna(subset=SIDE) for t in tables[1:])]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    metrics = [c for c in stacked.columns if c not in (*SIDE, "_first")]
    merged = stacked.groupBy(*SIDE).agg(*[F.max(c).alias(c) for c in metrics], F.max("_first").alias("_first")).filter("_first = 1").drop("_first")
    return merged.withColumn("progressive_carry_pct", carry_share())


def team_level(metrics: DataFrame) -> DataFrame:
    """Means of the core metrics, the spread of two of them and the match count per team."""
    return metrics.groupBy("team").agg(
        *[F.avg(c).alias(c) for c in CORE_METRICS],
        F.stddev_samp("ppda").alias("ppda_std"), F.stddev_samp("possession_pct").alias("possession_pct_std"),
        F.count("match_id").alias("n_matches"),
    )


def quality_audit(teams: DataFrame, columns: list[str] = CORE_METRICS, low: int = 2) -> DataFrame:
    """Long report: NULL counts, duplicate names, thin samples and 3-sigma outliers."""
    row = lambda check, col, name, v: F.struct(
        F.lit(check).alias("check"), F.lit(col).alias("column"), name.alias("team"), v.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    totals = teams.agg(
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in columns],
        (F.count("*") - F.count_distinct("team")).alias("dup"))
    summary = totals.select(F.explode(F.array(
        *[row("null_count", c, none, F.col(f"n_{c}")) for c in columns], row("duplicate_rows", "team", none, F.col("dup")))).alias("r")).select("r.*")
    stats = scalar_stats(teams, **{f"{n}_{c}": f(c) for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    flags = F.array(
        F.when(F.col("n_matches") <= low, row("low_sample", "n_matches", F.col("team"), F.col("n_matches"))),
        *[F.when(F.abs(F.col(c) - stats[f"m_{c}"]) > 3 * stats[f"s_{c}"], row("outlier_3_sigma", c, F.col("team"), F.col(c))) for c in columns])
    rows = teams.select(F.explode(flags).alias("r")).filter(F.col("r").isNotNull()).select("r.*")
    return summary.unionByName(rows)


def team_profile(metrics: DataFrame) -> DataFrame:
    """Eight profile dimensions per team from merged match metrics, in one aggregation."""
    inverse = lambda c: F.lit(1.0) / F.nullif(F.avg(c), F.lit(0.0))
    return metrics.groupBy("team").agg(
        inverse("ppda").alias("pressing_intensity"), F.avg("field_tilt_pct").alias("territorial_dominance"),
        F.avg("possession_pct").alias("ball_control"), inverse("epr").alias("possession_efficiency"),
        F.avg("defensive_line_height").alias("defensive_positioning"), F.avg("total_xg").alias("attacking_threat"),
        ratio(F.sum("progressive_passes"), F.sum("progressive_carries")).alias("progression_style"),
        F.avg("avg_xg_per_buildup_possession").alias("buildup_quality"),
    )


def standardise(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Population-deviation scaling of whole columns."""
    stats = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("s")).scalar()
    df = df.withColumn("_st", stats)
    for c in columns:
        sd = F.col(f"_st.s_{c}")
        df = df.withColumn(c + suffix, (F.col(c) - F.col(f"_st.m_{c}")) / F.when(sd == 0, 1.0).otherwise(sd))
    return df.drop("_st")


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def cap_and_scale(teams: DataFrame, upper: dict[str, float] | None = None, columns: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """Cap, then standardise, then build the vector; the order keeps outliers out of the deviation."""
    upper = {"ppda": 0.95, "epr": 0.95} if upper is None else upper
    capped = cap_outliers(teams, upper)
    return cut_lineage(assemble(standardise(capped, columns), [f"{c}_z" for c in columns]))


# ---- fits (C6, C7, C10, C13, C27) ----------------------------------------------------


def runs_at_rest(df: DataFrame, k: int, n_init: int = 20, seed: int = 42, key: str | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """The stored rows of a fit and its k-means runs, for a k-means fit and a mixture of the same rows and settings (``rested``)."""
    rows = fits.points(df, key)
    return rows, fits.kmeans(rows, fits.runs([k], n_init), seed)


def fit_kmeans(df: DataFrame, columns: list[str], k: int = 6, n_init: int = 20, names: list[str] | None = None, order_by: str | None = None,
               seed: int = 42, key: str | None = None, rested: tuple[DataFrame, list[np.ndarray]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled rows and centroids in original units, from the cheapest of ``n_init`` seeded starts that run side by side.

    Cluster numbers of a fit carry no meaning, so clusters are renumbered by the mean of
    ``order_by`` (highest first) and named in that order. A column ``key`` seeds the starts; without one the features do.
    """
    points, models = rested or runs_at_rest(df, k, n_init, seed, key)
    model = fits.best(points, fits.runs([k], n_init), seed, models)[k, 0]
    rows = df.withColumn("_x", fits.on_grid(vector_to_array("features"))).withColumn("_c", fits.nearest(F.col("_x"), model)).drop("_x")
    means = rows.groupBy("_c").agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("size"))
    order_by = order_by or columns[0]
    # k rows: the ranks of the clusters
    found = [r["_c"] for r in means.orderBy(F.desc(order_by), "_c").select("_c").collect()]
    number = F.create_map(*[F.lit(x) for i, c in enumerate(found) for x in (c, i)])
    label = F.create_map(*[F.lit(x) for i, c in enumerate(found) for x in (i, (names or [f"Cluster {j}" for j in range(len(found))])[i])])
    named = lambda d: d.withColumn("cluster", number[F.col("_c")]).withColumn("archetype", label[F.col("cluster")]).drop("_c")
    return named(rows), named(means)


def fit_mixture(df: DataFrame, k: int, seed: int = 42, n_init: int = 20, key: str | None = None,
                rested: tuple[DataFrame, list[np.ndarray]] | None = None) -> DataFrame:
    """Mixture label ``gmm`` and probabilities ``gmm_p`` per row, from the likeliest mixture grown from ``n_init`` seeded starts."""
    points, models = rested or runs_at_rest(df, k, n_init, seed, key)
    model = fits.best_mixtures(points, [k], n_init, seed, models)[k]
    rows = df.withColumn("gmm_p", fits.shares(fits.on_grid(vector_to_array("features")), model))
    return rows.withColumn("gmm", F.array_position("gmm_p", F.array_max("gmm_p")).cast("int") - 1)


def align_labels(rows: DataFrame, a: str, b: str, k: int) -> dict[int, int]:
    """One-to-one map of b's labels onto a's with the largest agreement, from the k x k counts."""
    counts = {(r[a], r[b]): r["n"] for r in rows.groupBy(a, b).agg(F.count("*").alias("n")).collect()}
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for y in range(k):  # the best way to give the first labels of b each set of a's labels, set by set
        nxt: dict[int, tuple[int, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for x in range(k):
                if not used >> x & 1:
                    found = (total + counts.get((x, y), 0), chosen + (x,))
                    if used | 1 << x not in nxt or found[0] > nxt[used | 1 << x][0]:
                        nxt[used | 1 << x] = found
        best = nxt
    return dict(enumerate(best[(1 << k) - 1][1]))


def mixture_probabilities(rows: DataFrame, k: int, label: str = "cluster", seed: int = 42, n_init: int = 20, key: str | None = None,
                          rested: tuple[DataFrame, list[np.ndarray]] | None = None) -> DataFrame:
    """Mixture probabilities with positions aligned to ``label``, 4 decimals."""
    fitted = cut_lineage(fit_mixture(rows, k, seed, n_init, key, rested))
    to_label = align_labels(fitted, label, "gmm", k)
    source = [next(g for g, c in to_label.items() if c == i) for i in range(k)]
    aligned = F.array(*[F.round(F.element_at("gmm_p", g + 1), 4) for g in source])
    mapping = F.create_map(*[F.lit(x) for kv in to_label.items() for x in kv])
    return fitted.withColumn("proba", aligned).withColumn("gmm_aligned", mapping[F.col("gmm")]).drop("gmm_p")


def mixture_disagreements(both: DataFrame, k: int, key: str = "team", label: str = "cluster", names: list[str] | None = None,
                          metrics: list[str] = ()) -> DataFrame:
    """Rows of :func:`mixture_probabilities` with different labels, both style names (``names`` by cluster number) and the columns ``metrics``."""
    style = F.array(*[F.lit(n) for n in names or [f"Cluster {i}" for i in range(k)]])
    return both.filter(F.col(label) != F.col("gmm_aligned")).select(
        key, label, "gmm_aligned", style[F.col(label)].alias("kmeans_archetype"), style[F.col("gmm_aligned")].alias("gmm_archetype"), *metrics)


def mixture_agreement(rows: DataFrame, k: int, key: str = "team", label: str = "cluster", seed: int = 42, n_init: int = 20, names: list[str] | None = None,
                      metrics: list[str] = (), rested: tuple[DataFrame, list[np.ndarray]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row: adjusted Rand index, raw agreement and the silhouettes of both labellings, rows with different labels).

    The rows show both style names (``names`` by cluster number) and the columns ``metrics``.
    """
    both = cut_lineage(mixture_probabilities(rows, k, label, seed, n_init, key, rested))
    same = F.avg((F.col(label) == F.col("gmm_aligned")).cast("double"))
    ari = adjusted_rand(both, label, "gmm")
    stats = both.agg(F.round(same, 3).alias("raw_agreement"), F.count("*").alias("rows")).withColumn("ari", F.round(ari, 3))
    for name, column in (("kmeans_silhouette", label), ("gmm_silhouette", "gmm_aligned")):
        stats = stats.withColumn(name, F.round(cluster_quality(both, column)[0].select("silhouette").scalar(), 3))
    return stats, mixture_disagreements(both, k, key, label, names, metrics)


def sensitivity(df: DataFrame, key: str, anchors: DataFrame, k_values: list[int], n_init: int = 20, seed: int = 42) -> DataFrame:
    """Which anchors share a cluster at each k: (k, cluster, members). Anchors are a short list; all fits run side by side."""
    rows = fits.points(df, key, keep=[key])
    models = fits.best(rows, fits.runs(k_values, n_init), seed)
    listed = fits.labels(rows.join(anchors.select(key).distinct(), key, "left_semi"), [models[k, 0] for k in k_values], [key])
    long = listed.select(key, F.posexplode("labels").alias("_i", "cluster")).withColumn("k", F.array(*[F.lit(k) for k in k_values])[F.col("_i")])
    return long.groupBy("k", "cluster").agg(F.array_join(F.array_sort(F.collect_set(key)), ", ").alias("members"), F.count("*").alias("n_members")).select(
        "cluster", "members", "n_members", "k")


def _distance(features: Column, centre: list[float]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(features[i] - float(c)) * (features[i] - float(c)) for i, c in enumerate(centre)]))


def leave_one_out(df: DataFrame, key: str, anchors: list, k: int = 6, n_init: int = 20, seed: int = 42) -> DataFrame:
    """Refit without each anchor; does its nearest new centre match its old cluster?

    A fit without a row is a fit in which it weighs nothing, so all fits run side by side over the same rows.
    """
    weights = F.array(F.lit(1), *[F.when(F.col(key) == a, 0).otherwise(1) for a in anchors])
    rows = fits.points(df, key, weights, [key])
    models = fits.best(rows, fits.runs([k], n_init, 1 + len(anchors)), seed)
    base = models[k, 0]
    # each new centre stands for the old centre next to it; k x k model parameters
    match = [[int(((base - c) ** 2).sum(1).argmin()) for c in models[k, i + 1]] for i in range(len(anchors))]
    listed = fits.labels(rows.filter(F.col(key).isin(anchors)), [base, *(models[k, i + 1] for i in range(len(anchors)))], [key])
    at = F.array_position(F.array(*[F.lit(a) for a in anchors]), F.col(key)).cast("int")
    refitted = F.array(*[F.array(*[F.lit(m) for m in ms]) for ms in match])[at - 1][F.col("labels")[at]]
    return listed.select(key, F.col("labels")[0].alias("original"), refitted.alias("refitted")).withColumn("stable", F.col("original") == F.col("refitted"))


def principal_components(df: DataFrame, keys: list[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores of the centred rows on the ``n`` main axes of the covariance, and the shares of variance.

    One aggregate gives means and the upper triangle of the covariance; its axes are found on the driver (dimensions squared
    numbers). The largest loading of an axis is positive, the first of equal ones. A table without spread gives shares of 0.
    """
    rows = df.withColumn("_x", vector_to_array("features"))
    dims = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    x = F.col("_x")
    found = rows.agg(*[F.avg(x[i]) for i in range(dims)], *[F.covar_samp(x[i], x[j]) for i, j in pairs]).first() if dims else []
    mean, spread = [v or 0.0 for v in found[:dims]], np.zeros((dims, dims))
    for (i, j), v in zip(pairs, found[dims:], strict=True):
        spread[i, j] = spread[j, i] = v or 0.0
    values, axes = np.linalg.eigh(spread)
    values, axes = values[::-1][:n], axes[:, ::-1][:, :n].T
    axes = [a * (-1 if a[np.abs(np.round(a, 9)).argmax()] < 0 else 1) for a in axes]
    score = lambda a: reduce(lambda s, t: s + t, [(x[i] - m) * float(a[i]) for i, m in enumerate(mean)])
    shares = [float(v) / float(np.trace(spread)) if np.trace(spread) > 0 else 0.0 for v in values]
    return rows.select(*keys, *[score(a).alias(f"pc{i + 1}") for i, a in enumerate(axes)]), shares


# ---- fit statistics (C8, C9, C11, C26) -----------------------------------------------


def adjusted_rand(rows: DataFrame, a: str, b: str) -> Column:
    """Adjusted Rand index of two labellings as a scalar subquery over the contingency counts."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    kinds = cells.select("n", F.explode(F.array(
        F.struct(F.lit("cell").alias("kind"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")),
        F.struct(F.lit("a").alias("kind"), F.col(a).cast("string").alias("x"), F.lit("").alias("y")),
        F.struct(F.lit("b").alias("kind"), F.lit("").alias("x"), F.col(b).cast("string").alias("y")),
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("x"), F.lit("").alias("y")),
    )).alias("k")).groupBy("k.kind", "k.x", "k.y").agg(F.sum("n").cast("double").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, pairs).otherwise(0.0))
    expected = of("a") * of("b") / F.nullif(of("all"), F.lit(0.0))
    value = (of("cell") - expected) / F.nullif((of("a") + of("b")) / 2.0 - expected, F.lit(0.0))
    return kinds.agg(F.coalesce(value, F.lit(1.0)).alias("ari")).scalar()


def _cluster_stats(rows: DataFrame, label: str) -> list:
    """Per cluster: label, size, mean vector and sum of squared norms. One row per cluster, so k rows."""
    norm = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x)
    return rows.groupBy(F.col(label).alias("c")).agg(
        F.count("*").alias("n"), Summarizer.mean(F.col("features")).alias("mean"), F.sum(norm).alias("sq")).orderBy("c").collect()


def cluster_quality(rows: DataFrame, label: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """(one row: silhouette, Calinski-Harabasz, Davies-Bouldin, inertia, variance explained; silhouette per cluster).

    The silhouette uses squared Euclidean distances, whose cluster averages follow from
    sizes, means and norms: one pass over the rows instead of all pairs.
    """
    stats = _cluster_stats(rows, label)
    k, n = len(stats), sum(s["n"] for s in stats)
    means = [s["mean"].toArray() for s in stats]
    total = sum(s["n"] * m for s, m in zip(stats, means)) / n
    within = sum(s["sq"] - s["n"] * float(m @ m) for s, m in zip(stats, means))
    between = sum(s["n"] * float((m - total) @ (m - total)) for s, m in zip(stats, means))
    x = vector_to_array("features")
    dot = lambda m: reduce(lambda a, b: a + b, [F.col("_x")[i] * float(v) for i, v in enumerate(m)])
    own = [F.col(label) == F.lit(s["c"]) for s in stats]
    norm = F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v)
    mean_sq = [norm + float(s["sq"]) / s["n"] - 2.0 * dot(m) for s, m in zip(stats, means)]
    inner = reduce(lambda a, b: a.when(b[0], b[1]), [
        (o, d * (float(s["n"]) / max(s["n"] - 1, 1))) for o, d, s in zip(own[1:], mean_sq[1:], stats[1:])],
        F.when(own[0], mean_sq[0] * (float(stats[0]["n"]) / max(stats[0]["n"] - 1, 1))))
    outer = F.array_min(F.array(*[F.when(~o, d) for o, d in zip(own, mean_sq)]))
    alone = reduce(lambda a, b: a | b, [o & F.lit(s["n"] == 1) for o, s in zip(own, stats)])
    sil = F.when(alone, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0)))
    spread = reduce(lambda a, b: a.when(b[0], b[1]), [(o, _distance(F.col("_x"), m.tolist())) for o, m in zip(own[1:], means[1:])],
                    F.when(own[0], _distance(F.col("_x"), means[0].tolist())))
    scored = rows.withColumn("_x", x).withColumn("_a", inner).withColumn("_b", outer).withColumn("_s", sil).withColumn("_d", spread)
    per = cut_lineage(scored.groupBy(F.col(label).alias("cluster")).agg(
        F.avg("_s").alias("silhouette"), F.sum("_s").alias("sum_s"), F.avg("_d").alias("spread"), F.count("*").alias("n_rows")))
    s = {r["cluster"]: r["spread"] for r in per.collect()}
    gaps = [[float((a - b) @ (a - b)) ** 0.5 for b in means] for a in means]
    db = sum(max((s[stats[i]["c"]] + s[stats[j]["c"]]) / gaps[i][j] for j in range(k) if j != i) for i in range(k)) / k if k > 1 else None
    overall = per.agg((F.sum("sum_s") / F.sum("n_rows")).alias("silhouette")).withColumns({
        "calinski_harabasz": F.lit((between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within > 0 else None).cast("double"),
        "davies_bouldin": F.lit(db).cast("double"), "inertia": F.lit(within),
        "variance_explained": F.lit(between / (within + between) if within + between else None).cast("double"),
    })
    return overall, per.select("cluster", "silhouette", "n_rows")


def sweep_k(df: DataFrame, k_values=range(2, 10), n_init: int = 20, seed: int = 42, mixture: bool = True, key: str | None = None) -> DataFrame:
    """Fit statistics per k, with the agreement of a mixture fit. The fits of all k and starts run side by side."""
    rows = fits.points(df, key)
    ks = list(k_values)
    rested = fits.kmeans(rows, fits.runs(ks, n_init), seed)
    models = fits.best(rows, fits.runs(ks, n_init), seed, rested)
    quality = fits.qualities(rows, [models[k, 0] for k in ks])
    found = df.sparkSession.createDataFrame(
        [(k, q["silhouette"], q["calinski_harabasz"], q["davies_bouldin"], q["inertia"]) for k, q in zip(ks, quality, strict=True)],
        "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double")
    ari = F.lit(None).cast("double")
    if mixture:
        grown = fits.best_mixtures(rows, ks, n_init, seed, rested)
        both = cut_lineage(fits.labels(rows, [models[k, 0] for k in ks], ["x"]).select("labels", *[
            F.array_position(p, F.array_max(p)).alias(f"g{k}") for k in ks for p in [fits.shares(F.col("x"), grown[k])]]))
        each = df.sparkSession.range(1).select(*[
            adjusted_rand(both.select(F.col("labels")[i].alias("a"), f"g{k}"), "a", f"g{k}").alias(f"a{k}") for i, k in enumerate(ks)]).first()
        ari = F.create_map(*[F.lit(v) for i, k in enumerate(ks) for v in (k, each[i])])[F.col("k")]
    return found.select("k", F.round("silhouette", 3).alias("silhouette"), F.round("calinski_harabasz", 1).alias("calinski_harabasz"),
                        F.round("davies_bouldin", 3).alias("davies_bouldin"), F.round(ari, 3).alias("gmm_ari"), F.round("inertia", 1).alias("inertia"))


def decision_matrix(sweep: DataFrame) -> DataFrame:
    """Average ranks of the four criteria per k; the table has one row per tried k."""
    def rank(c: str, down: bool) -> Column:
        order = W.partitionBy(F.lit(0)).orderBy(F.desc(c) if down else F.asc(c))
        ties = F.count("*").over(W.partitionBy(c))
        return F.floor(F.rank().over(order) + (ties - 1) / 2.0).cast("int")

    ranked = sweep.withColumn("rank_sil", rank("silhouette", True)).withColumn("rank_ch", rank("calinski_harabasz", True)).withColumn(
        "rank_db", rank("davies_bouldin", False)).withColumn("rank_ari", rank("gmm_ari", True))
    return ranked.withColumn("avg_rank", F.round((F.col("rank_sil") + F.col("rank_ch") + F.col("rank_db") + F.col("rank_ari")) / 4.0, 2))


def bootstrap_weight(key: Column, resample: int, seed: int) -> Column:
    """How often a resample of :func:`bootstrap_labels` holds the row of that key."""
    return fits.drawn(fits.row_hash(key), resample + 1, seed)[resample].cast("double")


def bootstrap_labels(df: DataFrame, key: str, n_bootstrap: int = 100, k: int = 6, seed: int = 42, n_init: int = 10) -> DataFrame:
    """Long table (resample, key, cluster, weight): a weighted fit per resample, all side by side."""
    rows = fits.points(df, key, fits.drawn(F.col("h"), n_bootstrap, seed), [key])
    models = fits.best(rows, fits.runs([k], n_init, n_bootstrap), seed)
    drawn = sorted(b for _, b in models)  # a resample of a very small table can be empty
    listed = fits.labels(rows, [models[k, b] for b in drawn], [key])
    long = listed.select(key, "w", F.posexplode("labels").alias("_i", "cluster")).withColumn("resample", F.array(*[F.lit(b) for b in drawn])[F.col("_i")])
    return cut_lineage(long.select("resample", key, "cluster", F.col("w")[F.col("resample")].cast("double").alias("weight")).filter(F.col("weight") > 0))


def bootstrap_stability(labels: DataFrame, key: str, threshold: float = 0.70) -> DataFrame:
    """Share of sampled partners in the same cluster per row, pooled over the resamples.

    The number of partners a row shares a cluster with is the size of that cluster, so
    no pair of rows is ever built.
    """
    size = labels.groupBy("resample", "cluster").agg(F.sum("weight").alias("in_cluster"))
    total = labels.groupBy("resample").agg(F.sum("weight").alias("in_sample"))
    own = F.col("weight")
    rows = labels.join(size, ["resample", "cluster"]).join(total, "resample")
    out = rows.groupBy(key).agg((F.sum(own * (F.col("in_cluster") - own)) / F.nullif(F.sum(own * (F.col("in_sample") - own)), F.lit(0.0))).alias("r"))
    return out.select(key, F.round("r", 3).alias("mean_cooccurrence"), (F.col("r") >= threshold).alias("stable"))


def bootstrap_pairs(labels: DataFrame, key: str, anchors: DataFrame) -> DataFrame:
    """Co-occurrence rate of a short list of anchors with every other row, and the anchor's mean over its partners."""
    a = labels.join(anchors.select(key).distinct(), key, "left_semi").select(
        "resample", F.col(key).alias("anchor"), F.col("cluster").alias("_ca"), F.col("weight").alias("_wa"))
    w = F.col("weight") * F.col("_wa")
    # the anchors go to the rows, which have too few resamples to be dealt out by
    rates = join_statistics(labels, a, ["resample"], "inner").filter(F.col(key) != F.col("anchor")).groupBy("anchor", F.col(key).alias("partner")).agg(
        (F.sum(F.when(F.col("cluster") == F.col("_ca"), w).otherwise(0.0)) / F.sum(w)).alias("rate"))
    rates = cut_lineage(rates)
    return join_statistics(rates, rates.groupBy("anchor").agg(F.avg("rate").alias("mean_rate")), ["anchor"])


# ---- descriptions of groups (C25, C28, C35, C36) -------------------------------------


def characterise(rows: DataFrame, centres: DataFrame, columns: list[str], key: str, top: int = 3, near: int = 5) -> DataFrame:
    """Per cluster: the dimensions furthest above and below the mean, and the rows nearest the centre."""
    stats = scalar_stats(rows, **{f"{n}_{c}": f(c) for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    z = centres.select("cluster", *[((F.col(c) - stats[f"m_{c}"]) / F.nullif(stats[f"s_{c}"], F.lit(0.0))).alias(c) for c in columns])
    long = unpivot(z, ["cluster"], columns, "item", "value")
    hi, lo = W.partitionBy("cluster").orderBy(F.desc("value"), "item"), W.partitionBy("cluster").orderBy("value", "item")
    traits = long.withColumn("h", F.row_number().over(hi)).withColumn("l", F.row_number().over(lo))
    high = traits.filter(F.col("h") <= top).select("cluster", F.lit("high").alias("kind"), F.col("h").alias("position"), "item", "value")
    low = traits.filter(F.col("l") <= top).select("cluster", F.lit("low").alias("kind"), F.col("l").alias("position"), "item", "value")
    joined = rows.select(key, "cluster", *columns).join(centres.select("cluster", *[F.col(c).alias(f"_c_{c}") for c in columns]), "cluster")
    d = F.sqrt(reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_c_{c}")) ** 2 for c in columns]))
    closest = joined.select("cluster", F.col(key).cast("string").alias("item"), d.alias("value")).withColumn(
        "position", F.row_number().over(W.partitionBy("cluster").orderBy("value", "item"))).filter(F.col("position") <= near)
    return high.unionByName(low).unionByName(closest.select("cluster", F.lit("nearest").alias("kind"), "position", "item", "value"))


# The two dimensions of each trait.
TRAITS = {
    "Mobility_Intensity": ["pressing_intensity", "defensive_positioning"],
    "Progression": ["progression_style", "territorial_dominance"],
    "Control": ["ball_control", "possession_efficiency"],
    "Final_Third_Output": ["attacking_threat", "buildup_quality"],
}


def trait_map(centres: DataFrame, profiles: DataFrame, traits: dict[str, list[str]] = TRAITS) -> DataFrame:
    """Mean min-max position of the centre on the full range, per trait, 0 to 100."""
    dims = [d for ds in traits.values() for d in ds]
    r = scalar_stats(profiles, **{f"{n}_{d}": f(d) for d in dims for n, f in (("lo", F.min), ("hi", F.max))})
    place = lambda d: (F.col(d) - r[f"lo_{d}"]) / F.nullif(r[f"hi_{d}"] - r[f"lo_{d}"], F.lit(0.0))
    return centres.select("cluster", *[(row_mean([place(d) for d in ds]) * 100.0).alias(t) for t, ds in traits.items()])


def radar_averages(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Min-max positions averaged per group beside the overall average, long form."""
    r = scalar_stats(rows, **{f"{n}_{c}": f(c) for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))})
    means = unpivot(rows.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns]), [group], columns)
    # min-max is linear, so the mean of the scaled values is the scaled mean
    at = lambda n: reduce(lambda a, c: a.when(F.col("metric") == c, r[f"{n}_{c}"]), columns[1:], F.when(F.col("metric") == columns[0], r[f"{n}_{columns[0]}"]))
    width = at("hi") - at("lo") + 1e-9
    return means.select(group, "metric", ((F.col("value") - at("lo")) / width).alias("group_avg"), ((at("m") - at("lo")) / width).alias("overall_avg"))


def centroid_radar(centres: DataFrame, rows: DataFrame, columns: list[str], inverted: tuple[str, ...] = ("ppda",), floor: float = 0.15) -> DataFrame:
    """Centroids on the full range of the rows, one metric inverted, lifted by a floor.

    An inverted centroid is measured from the largest centroid, the rows from their largest row.
    """
    r = scalar_stats(rows, **{f"{n}_{c}": f(c) for c in columns for n, f in (("lo", F.min), ("hi", F.max))})
    top = scalar_stats(centres, **{f"t_{c}": F.max(c) for c in inverted})
    out = []
    for c in columns:
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        value = (top[f"t_{c}"] - F.col(c)) if c in inverted else F.col(c) - lo
        out.append((floor + (1.0 - floor) * value / F.nullif(hi - lo, F.lit(0.0))).alias(c))
    return centres.select("cluster", *out)

