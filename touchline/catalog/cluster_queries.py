"""Queries for team features, clusters and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog import fit_sql
from touchline.catalog.registry import f_tail_sql, query
from touchline.functions.columns import rounded
from touchline.operators import clustering, validation
from touchline.plans import team_styles

FEATURES = ["f1", "f2", "f3", "f4"]
STYLES6 = ["'High Press / High Output'", "'Possession Dominant'", "'Compact Transition'", "'Mid-Block Reactive'", "'Moderate Possession'", "'Low Intensity'"]
STYLE_CASE = "CASE {k} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STYLES6)) + " END"


def _tables(t):
    m = t.v_team_match
    side = ["match_id", "team"]
    return [m.select(*side, "ppda", "defensive_line_height", "field_tilt_pct"), m.filter("match_id % 10 <> 0").select(*side, "possession_pct", "epr"),
            m.select(*side, "progressive_carries", "progressive_passes", "npxg", "total_xg", "avg_xg_per_buildup_possession")]


CARRY = "progressive_carries * 100e0 / NULLIF(progressive_carries + progressive_passes, 0)"
query("c1_merge_metrics", lambda t: rounded(clustering.merge_metrics(_tables(t)).select(
    "match_id", "team", "ppda", "possession_pct", "epr", "npxg", "progressive_carry_pct")), f"""
SELECT match_id, team, ROUND(ppda, 4) AS ppda, CASE WHEN match_id % 10 <> 0 THEN possession_pct END AS possession_pct,
  ROUND(CASE WHEN match_id % 10 <> 0 THEN epr END, 4) AS epr, ROUND(npxg, 4) AS npxg, ROUND({CARRY}, 4) AS progressive_carry_pct FROM v_team_match""")


def _merged(t):
    return t.v_team_match.withColumn("progressive_carry_pct", clustering.carry_share())


TEAM = f"""tl AS (SELECT team, AVG(ppda) AS ppda, AVG(defensive_line_height) AS defensive_line_height, AVG(field_tilt_pct) AS field_tilt_pct,
   AVG(possession_pct) AS possession_pct, AVG({CARRY}) AS progressive_carry_pct, AVG(epr) AS epr, AVG(npxg) AS npxg,
   AVG(avg_xg_per_buildup_possession) AS avg_xg_per_buildup_possession, STDDEV_SAMP(ppda) AS ppda_std, STDDEV_SAMP(possession_pct) AS possession_pct_std,
   COUNT(match_id) AS n_matches FROM v_team_match GROUP BY team)"""
CORE = clustering.CORE_METRICS
FEATS = clustering.CLUSTER_FEATURES
query("c2_team_level", lambda t: rounded(clustering.team_level(_merged(t))),
      f"WITH {TEAM} SELECT team, n_matches, {', '.join(f'ROUND({c}, 4) AS {c}' for c in FEATS)} FROM tl")

query("c3_quality_audit", lambda t: rounded(clustering.quality_audit(_merged(t).select("team", "season_year", *[c for c in CORE]).withColumn(
    "n_matches", F.col("season_year") - 1994), CORE, 1)), f"""
WITH r AS (SELECT team, season_year - 1994 AS n_matches, ppda, defensive_line_height, field_tilt_pct, possession_pct, {CARRY} AS progressive_carry_pct, epr, npxg,
   avg_xg_per_buildup_possession FROM v_team_match),
 l AS (UNPIVOT (SELECT team, COALESCE(ppda, -1e99) AS ppda, COALESCE(defensive_line_height, -1e99) AS defensive_line_height, COALESCE(field_tilt_pct, -1e99) AS field_tilt_pct,
   COALESCE(possession_pct, -1e99) AS possession_pct, COALESCE(progressive_carry_pct, -1e99) AS progressive_carry_pct, COALESCE(epr, -1e99) AS epr, COALESCE(npxg, -1e99) AS npxg,
   COALESCE(avg_xg_per_buildup_possession, -1e99) AS avg_xg_per_buildup_possession FROM r) ON {', '.join(CORE)} INTO NAME col VALUE v),
 s AS (SELECT col, COUNT(*) FILTER (WHERE v = -1e99) AS nn, AVG(v) FILTER (WHERE v > -1e99) AS m, STDDEV_SAMP(v) FILTER (WHERE v > -1e99) AS sd FROM l GROUP BY col)
SELECT 'null_count' AS "check", col AS "column", NULL AS team, nn::DOUBLE AS value FROM s
UNION ALL SELECT 'duplicate_rows', 'team', NULL, (COUNT(*) - COUNT(DISTINCT team))::DOUBLE FROM r
UNION ALL SELECT 'low_sample', 'n_matches', team, n_matches::DOUBLE FROM r WHERE n_matches <= 1
UNION ALL SELECT 'outlier_3_sigma', col, team, ROUND(v, 4) FROM l JOIN s USING (col) WHERE v > -1e99 AND ABS(v - m) > 3 * sd""")

query("c4_team_profile", lambda t: rounded(clustering.team_profile(t.v_team_match)), """
SELECT team, ROUND(1 / AVG(ppda), 4) AS pressing_intensity, ROUND(AVG(field_tilt_pct), 4) AS territorial_dominance, ROUND(AVG(possession_pct), 4) AS ball_control,
  ROUND(1 / AVG(epr), 4) AS possession_efficiency, ROUND(AVG(defensive_line_height), 4) AS defensive_positioning, ROUND(AVG(total_xg), 4) AS attacking_threat,
  ROUND(SUM(progressive_passes) / SUM(progressive_carries)::DOUBLE, 4) AS progression_style, ROUND(AVG(avg_xg_per_buildup_possession), 4) AS buildup_quality
FROM v_team_match GROUP BY team""")

query("c5_cap_and_scale", lambda t: rounded(clustering.cap_and_scale(clustering.team_level(_merged(t))).select("team", *[f"{c}_z" for c in FEATS])), f"""
WITH {TEAM}, c AS (SELECT * REPLACE (LEAST(ppda, (SELECT QUANTILE_CONT(ppda, 0.95) FROM tl)) AS ppda, LEAST(epr, (SELECT QUANTILE_CONT(epr, 0.95) FROM tl)) AS epr) FROM tl)
SELECT team, {', '.join(f'ROUND(({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER (), 4) AS {c}_z' for c in FEATS)} FROM c""")


def _vectors(t):
    return clustering.cut_lineage(clustering.assemble(t.v_features, FEATURES))


# Settings of the fits: clusters, starts, resamples and the tried numbers of clusters. Whole numbers that must match.
K, STARTS, RESAMPLES, RESAMPLE_STARTS, TRIED = 6, 20, 100, 10, list(range(2, 10))
DIMS = len(FEATURES)


def _clustered(t):
    return clustering.fit_kmeans(_vectors(t), FEATURES, K, STARTS, key="vec_id")


def _clustered_at_rest(t):
    """Labelled rows, and the runs they come from: the mixtures grow from the same."""
    vectors = _vectors(t)
    rested = clustering.runs_at_rest(vectors, K, STARTS, key="vec_id")
    return clustering.fit_kmeans(vectors, FEATURES, K, STARTS, key="vec_id", rested=rested)[0], rested


def _mixture(t):
    rows, rested = _clustered_at_rest(t)
    return clustering.mixture_probabilities(rows, K, n_init=STARTS, key="vec_id", rested=rested)


FIT = fit_sql.kmeans("v_features", "vec_id", FEATURES, [K], STARTS)
NUMBERED = f"""{FIT}, nu AS (SELECT l.cluster AS c, row_number() OVER (ORDER BY avg(f1) DESC, l.cluster)::INT - 1 AS cluster, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)}, count(*) AS size
  FROM lab l JOIN v_features ON vec_id = id GROUP BY l.cluster),
cl AS MATERIALIZED (SELECT id, nu.cluster FROM lab JOIN nu ON lab.cluster = nu.c)"""
query("c6_fit_kmeans", lambda t: _clustered(t)[0].select("vec_id", "cluster", "archetype"), f"""
{NUMBERED} SELECT id AS vec_id, cluster, 'Cluster ' || cluster AS archetype FROM cl""")
query("c6_centroids", lambda t: rounded(_clustered(t)[1].select("cluster", "archetype", "size", *FEATURES)), f"""
{NUMBERED} SELECT cluster, 'Cluster ' || cluster AS archetype, size, {', '.join(f'ROUND({f}, 4) AS {f}' for f in FEATURES)} FROM nu""")
GROWN = f"""{NUMBERED}, {fit_sql.mixtures(DIMS)},
both2 AS MATERIALIZED (SELECT DISTINCT id, cluster, gmm FROM post JOIN cl USING (id)), {fit_sql.aligned('both2', K)},
pr AS MATERIALIZED (SELECT b.id, b.cluster, a.gmm_aligned::INT AS gmm_aligned, b.gmm FROM both2 b JOIN al a ON a.gmm = b.gmm)"""
query("c7_mixture_probabilities", lambda t: _mixture(t).select(
    "vec_id", "cluster", "gmm_aligned", *[F.col("proba")[i].alias(f"p{i}") for i in range(K)]), f"""
{GROWN} SELECT pr.id AS vec_id, cluster, pr.gmm_aligned, {', '.join(f'ROUND(MAX(r) FILTER (WHERE al.gmm_aligned = {i}), 4) AS p{i}' for i in range(K))}
FROM pr JOIN post USING (id) JOIN al ON al.gmm = post.comp GROUP BY ALL""")
SWEEP = f"""{fit_sql.kmeans("v_features", "vec_id", FEATURES, TRIED, STARTS)}, {fit_sql.mixtures(DIMS)}, {fit_sql.quality('lab', DIMS)},
gp AS MATERIALIZED (SELECT DISTINCT lab.k, id, cluster AS a, gmm AS b FROM lab JOIN post USING (k, id)),
sw AS MATERIALIZED (SELECT k::INT AS k, ROUND(silhouette, 3) AS silhouette, ROUND(calinski_harabasz, 1) AS calinski_harabasz, ROUND(davies_bouldin, 3) AS davies_bouldin,
  ROUND(ari, 3) AS gmm_ari, ROUND(inertia, 1) AS inertia FROM ql JOIN ({fit_sql.rand_index('gp')}) r USING (k))"""
query("c8_sweep_k", lambda t: clustering.sweep_k(_vectors(t), TRIED, STARTS, key="vec_id"), f"{SWEEP} SELECT * FROM sw")


def _rank_sql(column, order):
    return f"FLOOR(RANK() OVER (ORDER BY {column} {order}) + (COUNT(*) OVER (PARTITION BY {column}) - 1) / 2e0)::INT"


query("c8_decision_matrix", lambda t: clustering.decision_matrix(clustering.sweep_k(_vectors(t), TRIED, STARTS, key="vec_id")), f"""
{SWEEP}, rk AS (SELECT *, {_rank_sql('silhouette', 'DESC')} AS rank_sil, {_rank_sql('calinski_harabasz', 'DESC')} AS rank_ch, {_rank_sql('davies_bouldin', 'ASC')} AS rank_db,
  {_rank_sql('gmm_ari', 'DESC')} AS rank_ari FROM sw)
SELECT *, ROUND((rank_sil + rank_ch + rank_db + rank_ari) / 4e0, 2) AS avg_rank FROM rk""")


def _agreement(t):
    rows, rested = _clustered_at_rest(t)
    return clustering.mixture_agreement(rows, K, "vec_id", n_init=STARTS, names=team_styles.STYLES, metrics=FEATURES, rested=rested)


query("c9_mixture_agreement", lambda t: _agreement(t)[0], f"""
{GROWN}, two AS MATERIALIZED (SELECT 0 AS k, id, cluster FROM pr UNION ALL SELECT 1, id, gmm_aligned FROM pr), {fit_sql.quality('two', DIMS)}, ab AS (SELECT 0 AS k, cluster AS a, gmm AS b FROM pr)
SELECT ROUND(AVG((cluster = gmm_aligned)::INT), 3) AS raw_agreement, COUNT(*) AS "rows", (SELECT ROUND(ari, 3) FROM ({fit_sql.rand_index('ab')}) r) AS ari,
  (SELECT ROUND(silhouette, 3) FROM ql WHERE k = 0) AS kmeans_silhouette, (SELECT ROUND(silhouette, 3) FROM ql WHERE k = 1) AS gmm_silhouette FROM pr""")
query("c9_mixture_disagreements", lambda t: rounded(clustering.mixture_disagreements(_mixture(t), K, "vec_id", names=team_styles.STYLES, metrics=FEATURES)), f"""
{GROWN} SELECT vec_id, cluster, gmm_aligned, {STYLE_CASE.format(k='cluster')} AS kmeans_archetype, {STYLE_CASE.format(k='gmm_aligned')} AS gmm_archetype, {', '.join(f'ROUND({f}, 4) AS {f}' for f in FEATURES)}
FROM pr JOIN v_features ON vec_id = id WHERE cluster <> gmm_aligned""")
query("c9_adjusted_rand", lambda t: rounded(t.embeddings.select("label", (F.col("vec_id") % 5).alias("b"), (F.col("label") % 3).alias("c")).transform(
    lambda d: d.sparkSession.range(1).select(clustering.adjusted_rand(d, "label", "b").alias("ari_random"), clustering.adjusted_rand(d, "label", "c").alias("ari_coarse")))), """
WITH p AS (SELECT label AS a, vec_id % 5 AS b, label % 3 AS c FROM embeddings),
 t AS (SELECT COUNT(*) * (COUNT(*) - 1) / 2e0 AS n FROM p), sa AS (SELECT SUM(n * (n - 1) / 2e0) AS s FROM (SELECT COUNT(*) AS n FROM p GROUP BY a) z),
 sb AS (SELECT SUM(n * (n - 1) / 2e0) AS s FROM (SELECT COUNT(*) AS n FROM p GROUP BY b) z), sc AS (SELECT SUM(n * (n - 1) / 2e0) AS s FROM (SELECT COUNT(*) AS n FROM p GROUP BY c) z),
 ab AS (SELECT SUM(n * (n - 1) / 2e0) AS s FROM (SELECT COUNT(*) AS n FROM p GROUP BY a, b) z), ac AS (SELECT SUM(n * (n - 1) / 2e0) AS s FROM (SELECT COUNT(*) AS n FROM p GROUP BY a, c) z)
SELECT ROUND((ab.s - sa.s * sb.s / t.n) / ((sa.s + sb.s) / 2 - sa.s * sb.s / t.n), 4) AS ari_random,
  ROUND((ac.s - sa.s * sc.s / t.n) / ((sa.s + sc.s) / 2 - sa.s * sc.s / t.n), 4) AS ari_coarse FROM t, sa, sb, sc, ab, ac""")
query("c10_sensitivity", lambda t: clustering.sensitivity(_vectors(t), "vec_id", t.v_features.filter("vec_id < 12"), [K - 1, K, K + 1], STARTS).drop("cluster"), f"""
{fit_sql.kmeans("v_features", "vec_id", FEATURES, [K - 1, K, K + 1], STARTS)}
SELECT k::INT AS k, STRING_AGG(id::VARCHAR, ', ' ORDER BY id) AS members, COUNT(*) AS n_members FROM lab WHERE id < 12 GROUP BY k, cluster""")
BOOTSTRAP = f"""{fit_sql.kmeans("v_features", "vec_id", FEATURES, [K], RESAMPLE_STARTS, RESAMPLES, fit_sql.drawn(RESAMPLES))},
bl AS MATERIALIZED (SELECT l.sample, l.id, l.cluster, w.w FROM lab l JOIN wt w ON w.id = l.id AND w.sample = l.sample)"""


def _bootstrap(t):
    return clustering.bootstrap_labels(_vectors(t), "vec_id", RESAMPLES, K, n_init=RESAMPLE_STARTS)


query("c11_bootstrap_stability", lambda t: clustering.bootstrap_stability(_bootstrap(t), "vec_id"), f"""
{BOOTSTRAP}, g AS (SELECT id, w, SUM(w) OVER (PARTITION BY sample, cluster) AS c, SUM(w) OVER (PARTITION BY sample) AS s FROM bl),
 r AS (SELECT id, SUM(w * (c - w)) / SUM(w * (s - w))::DOUBLE AS r FROM g GROUP BY id)
SELECT id AS vec_id, ROUND(r, 3) AS mean_cooccurrence, r >= 0.7 AS stable FROM r""")
query("c11_bootstrap_pairs", lambda t: rounded(clustering.bootstrap_pairs(_bootstrap(t), "vec_id", t.v_features.filter("vec_id < 5"))), f"""
{BOOTSTRAP}, r AS (SELECT a.id AS anchor, b.id AS partner, SUM(CASE WHEN a.cluster = b.cluster THEN a.w * b.w ELSE 0 END) / SUM(a.w * b.w)::DOUBLE AS rate
  FROM bl a JOIN bl b ON a.sample = b.sample AND a.id <> b.id WHERE a.id < 5 GROUP BY a.id, b.id)
SELECT anchor, partner, ROUND(rate, 4) AS rate, ROUND(AVG(rate) OVER (PARTITION BY anchor), 4) AS mean_rate FROM r""")
ANOVA = """l AS (UNPIVOT (SELECT label, f1, f2, f3, f4 FROM v_features) ON f1, f2, f3, f4 INTO NAME metric VALUE v),
 c AS (SELECT metric, label, COUNT(*) AS n, AVG(v) AS m, VAR_POP(v) AS s FROM l GROUP BY metric, label HAVING COUNT(*) > 1),
 g AS (SELECT metric, COUNT(*) AS k, SUM(n) AS nn, SUM(n * s) AS w, SUM(n * m * m) - SUM(n * m) * SUM(n * m) / SUM(n) AS b FROM c GROUP BY metric)"""
query("c12_anova", lambda t: validation.anova(t.v_features, "label", FEATURES).drop("p_value", "significant"), f"""
WITH {ANOVA} SELECT metric, ROUND((b / (k - 1)) / (w / (nn - k)), 3) AS "F_statistic" FROM g""")
query("c12_anova_p_values", lambda t: validation.anova(t.v_features, "label", FEATURES), f"""
WITH {ANOVA}, f AS (SELECT metric, (b / (k - 1)) / (w / (nn - k)) AS f, k - 1 AS d1, nn - k AS d2 FROM g),
 p AS (SELECT *, {f_tail_sql("f", "d1", "d2")} AS p FROM f)
SELECT metric, ROUND(f, 3) AS "F_statistic", ROUND(p, 4) AS p_value, p <= 0.05 AS significant FROM p""")
ANCHORS = list(range(1, 11))
LOO_WEIGHTS = f"SELECT id, sample, 1 AS w FROM pts, (SELECT range AS sample FROM range({len(ANCHORS) + 1})) WHERE sample = 0 OR id <> [{', '.join(map(str, ANCHORS))}][sample]"
query("c13_leave_one_out", lambda t: clustering.leave_one_out(_vectors(t), "vec_id", ANCHORS, K, STARTS).select("vec_id", "stable"), f"""
{fit_sql.kmeans("v_features", "vec_id", FEATURES, [K], STARTS, len(ANCHORS) + 1, LOO_WEIGHTS)},
 mt AS (SELECT n.sample, n.cluster, arg_min(o.cluster, {fit_sql.gap('n', 'o', DIMS, 'c', 'c')}) AS old FROM centre n, centre o WHERE o.sample = 0 AND n.sample > 0 GROUP BY n.sample, n.cluster)
SELECT l.id AS vec_id, b.cluster = mt.old AS stable FROM lab l JOIN mt ON mt.sample = l.sample AND mt.cluster = l.cluster JOIN lab b ON b.id = l.id AND b.sample = 0
WHERE l.sample > 0 AND l.id = [{', '.join(map(str, ANCHORS))}][l.sample]""")

PERIOD = "SELECT 'T' || (o_custkey % 400) AS team, EXTRACT(YEAR FROM o_orderdate)::INT % 3 AS period, o_orderkey % 4 AS cluster FROM orders"
query("c14_temporal_stability", lambda t: rounded(validation.temporal_stability(t.orders.select(
    F.concat(F.lit("T"), F.col("o_custkey") % 400).alias("team"), (F.year("o_orderdate") % 3).alias("period"), (F.col("o_orderkey") % 4).alias("cluster")))), f"""
WITH p AS ({PERIOD}), c AS (SELECT team, cluster, COUNT(*) AS n FROM p GROUP BY ALL), k AS (SELECT team FROM p GROUP BY team HAVING COUNT(DISTINCT period) = (SELECT COUNT(DISTINCT period) FROM p))
SELECT team, ROUND(MAX(n) / SUM(n)::DOUBLE, 4) AS stability_rate FROM c WHERE team IN (SELECT team FROM k) GROUP BY team""")


def _binary(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("quality", (F.col("n_chars") % 997).alias("score"))


query("c15_baseline_comparison", lambda t: validation.baseline_comparison(_binary(t), "score", "quality", 400), """
WITH b AS (SELECT quality AS y, n_chars % 997 AS s FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT y, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2e0 AS k, s FROM b),
 a AS (SELECT (SUM(k) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2e0) / (SUM(y) * (COUNT(*) - SUM(y))) AS auc, AVG(y) AS base, AVG(((s >= 400)::INT = y)::INT) AS acc FROM r)
SELECT 'Majority class baseline' AS model, ROUND(GREATEST(base, 1 - base), 3) AS accuracy, 0.5e0 AS auc FROM a UNION ALL SELECT 'Score', ROUND(acc, 3), ROUND(auc, 3) FROM a""")

OUT = f"""ot AS (SELECT 'N' || n_nationkey AS team, {STYLE_CASE.format(k='n_nationkey % 6')} AS archetype,
  CASE n_nationkey * 5 % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Group Stage' WHEN 2 THEN 'Round of 16' WHEN 3 THEN 'Quarter-final' WHEN 4 THEN 'Fourth' WHEN 5 THEN 'Third' WHEN 6 THEN 'Runner-up' ELSE 'Winner' END AS outcome,
  NULLIF(n_nationkey * 5 % 8, 0) AS outcome_rank FROM nation)"""
RANKED = ["Group Stage", "Round of 16", "Quarter-final", "Fourth", "Third", "Runner-up", "Winner"]


def _outcomes(t):
    k = F.col("n_nationkey")
    names = F.array(*[F.lit(s.strip("'")) for s in STYLES6])
    results = F.array(*[F.lit(s) for s in RANKED])
    rows = t.nation.select(F.concat(F.lit("N"), k).alias("team"), F.element_at(names, k % 6 + 1).alias("archetype"))
    out = t.nation.filter(k * 5 % 8 != 0).select(F.concat(F.lit("N"), k).alias("team"), F.element_at(results, k * 5 % 8).alias("outcome"))
    return validation.merge_outcomes(rows, out)


query("c16_expected_vs_actual", lambda t: validation.expected_vs_actual(_outcomes(t).filter("outcome IS NOT NULL"), "archetype", "outcome_rank"), f"""
WITH {OUT}, e AS (SELECT archetype, ROUND(AVG(outcome_rank), 2) AS expected_rank FROM ot WHERE outcome IS NOT NULL GROUP BY archetype)
SELECT team, archetype, outcome, outcome_rank, expected_rank, ROUND(outcome_rank - expected_rank, 2) AS error, ABS(ROUND(outcome_rank - expected_rank, 2)) AS abs_error
FROM ot JOIN e USING (archetype) WHERE outcome IS NOT NULL""")
EXPECTED = """e AS (SELECT archetype, ROUND(AVG(outcome_rank), 2) AS x FROM ot WHERE outcome IS NOT NULL GROUP BY archetype),
 er AS (SELECT team, ABS(ROUND(outcome_rank - x, 2)) AS d FROM ot JOIN e USING (archetype) WHERE outcome IS NOT NULL)"""
_errors = lambda t: validation.expected_vs_actual(_outcomes(t).filter("outcome IS NOT NULL"), "archetype", "outcome_rank")
query("c16_mean_absolute_error", lambda t: validation.mean_absolute_error(_errors(t)), f"WITH {OUT}, {EXPECTED} SELECT ROUND(AVG(d), 3) AS mae, COUNT(*) AS teams FROM er")
query("c16_biggest_surprises", lambda t: validation.biggest_surprises(_errors(t), "team").select("team", "abs_error"), f"""
WITH {OUT}, {EXPECTED} SELECT team, d AS abs_error FROM er ORDER BY d DESC, team LIMIT 5""")
query("c15_archetype_predictor", lambda t: validation.archetype_predictor(_outcomes(t)), f"""
WITH {OUT}, b AS (SELECT (outcome_rank >= 3)::INT AS y, CASE archetype WHEN 'High Press / High Output' THEN 85 WHEN 'Possession Dominant' THEN 75 WHEN 'Compact Transition' THEN 65
   WHEN 'Mid-Block Reactive' THEN 60 WHEN 'Moderate Possession' THEN 50 WHEN 'Low Intensity' THEN 40 ELSE 50 END AS s FROM ot WHERE outcome_rank IS NOT NULL),
 w AS (SELECT COALESCE(AVG(CASE WHEN p.s > q.s THEN 1 WHEN p.s = q.s THEN 0.5 ELSE 0 END), 0.5) AS auc FROM b p JOIN b q ON p.y = 1 AND q.y = 0),
 a AS (SELECT AVG(y) AS base, AVG(((s >= 65)::INT = y)::INT) AS acc FROM b)
SELECT 'Majority class baseline' AS model, ROUND(GREATEST(base, 1 - base), 3) AS accuracy, 0.5e0 AS auc FROM a UNION ALL SELECT 'Score', ROUND(acc, 3), ROUND(auc, 3)::DOUBLE FROM a, w""")
query("c17_cohen_kappa", lambda t: validation.cohen_kappa(t.embeddings.select("label", F.when(F.col("vec_id") % 3 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("b")), "label", "b"), """
WITH p AS (SELECT label AS a, CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS b FROM embeddings), n AS (SELECT COUNT(*) AS n, AVG((a = b)::INT) AS po FROM p),
 e AS (SELECT SUM(x.c * y.c) / (SELECT n * n FROM n)::DOUBLE AS pe FROM (SELECT a, COUNT(*) AS c FROM p GROUP BY a) x JOIN (SELECT b, COUNT(*) AS c FROM p GROUP BY b) y ON a = b),
 k AS (SELECT (po - pe) / (1 - pe) AS k, po, n FROM n, e)
SELECT ROUND(k, 4) AS kappa, CASE WHEN k < 0.2 THEN 'Slight' WHEN k < 0.4 THEN 'Fair' WHEN k < 0.6 THEN 'Moderate' WHEN k < 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS interpretation,
  ROUND(po, 3) AS agreement_rate, n AS n_teams FROM k""")
query("c18_merge_outcomes", lambda t: _outcomes(t), f"WITH {OUT} SELECT * FROM ot")
query("c18_outcome_summary", lambda t: validation.outcome_summary(_outcomes(t)), f"""
WITH {OUT} SELECT archetype, ROUND(AVG(outcome_rank), 2) AS avg_outcome_rank, MAX(outcome_rank) AS best_finish_rank, COUNT(*) AS n_teams, ARG_MAX(outcome, outcome_rank) AS best_finish
FROM ot WHERE outcome IS NOT NULL GROUP BY archetype""")


def _scored_rows(t):
    k = F.col("c_custkey")
    p = [(k * m % 100) / 100.0 for m in (7, 13, 29, 31, 17, 11)]
    return t.customer.select(k, F.col("c_name").alias("team"), (k % 6).cast("int").alias("cluster"), F.array(*p).alias("proba"), (k % 12 + 1).alias("n_matches"),
                             (k * 37 % 211 / 100.0).alias("npxg"), (k * 41 % 307 + 1.0).alias("epr"))


query("c19_final_scores", lambda t: validation.final_scores(
    _scored_rows(t), [s.strip("'") for s in STYLES6], t.customer.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 7 + 1).alias("outcome_rank")), key="c_custkey").select(
    "team", "archetype", "archetype_score", "second_archetype", "second_archetype_score", "gmm_confidence", "blend_score", "sample_weight", "wc_presence_weight", "quality_adjustment", "final_score"), f"""
WITH b AS (SELECT c_name AS team, c_custkey AS k, (c_custkey % 6)::INT AS c, [(c_custkey * 7 % 100) / 100e0, (c_custkey * 13 % 100) / 100e0, (c_custkey * 29 % 100) / 100e0, (c_custkey * 31 % 100) / 100e0,
   (c_custkey * 17 % 100) / 100e0, (c_custkey * 11 % 100) / 100e0] AS p, c_custkey % 12 + 1 AS n, c_custkey * 37 % 211 / 100e0 * 0.7e0 + 1e0 / LEAST(c_custkey * 41 % 307 + 1e0, 261.47e0) * 30 AS q,
   CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 + 1 END AS r FROM customer),
 s AS (SELECT b.*, g.i AS c2 FROM b JOIN LATERAL (SELECT i FROM (SELECT UNNEST([0, 1, 2, 3, 4, 5]) AS i) u WHERE i <> b.c ORDER BY b.p[i + 1] DESC, i LIMIT 1) g ON TRUE),
 v AS (SELECT *, [95, 82, 70, 63, 48, 35] AS sc, p[c + 1] AS p1, p[c2 + 1] AS p2, ROUND(0.6e0 + 0.4e0 * (LEAST(n, 9) / 9e0), 4) AS sw,
   COALESCE(ROUND(0.8e0 + 0.2e0 * (r / 7e0), 4), 0.75e0) AS pw, (RANK() OVER (PARTITION BY c ORDER BY q) + (COUNT(*) OVER (PARTITION BY c, q) - 1) / 2e0) / COUNT(*) OVER (PARTITION BY c) AS pr FROM s),
 w AS (SELECT *, CASE WHEN c = 0 AND r IS NULL THEN 80e0 ELSE sc[c + 1]::DOUBLE END AS s1, sc[c2 + 1]::DOUBLE AS s2 FROM v),
 x AS (SELECT *, CASE WHEN p1 >= 0.1 THEN ROUND((p1 * s1 + p2 * s2) / CASE WHEN p1 + p2 > 0 THEN p1 + p2 ELSE 1 END, 1) ELSE ROUND(s1, 1) END AS bl, ROUND((pr - 0.5e0) * 8 * sw, 1) AS qa FROM w)
SELECT team, {STYLE_CASE.format(k='c')} AS archetype, s1 AS archetype_score, {STYLE_CASE.format(k='c2')} AS second_archetype, s2 AS second_archetype_score, p1 AS gmm_confidence, bl AS blend_score,
  sw AS sample_weight, pw AS wc_presence_weight, qa AS quality_adjustment, ROUND(GREATEST(0, LEAST(100, GREATEST(0, LEAST(100, bl * sw * pw)) + qa)) + 1e-9, 1) AS final_score FROM x""")
query("c20_reconcile_names", lambda t: validation.reconcile_names(
    t.nation.select(F.col("n_name").alias("team")), {"NATION_3": "Three"}, t.nation.filter("n_nationkey % 2 = 1").select(F.when(F.col("n_nationkey") == 3, "Three").otherwise(F.col("n_name")).alias("team"))), """
SELECT CASE WHEN n_nationkey = 3 THEN 'Three' ELSE n_name END AS team, n_nationkey % 2 = 1 AS matched FROM nation""")


def _progress(t):
    return t.orders.select(F.concat(F.lit("T"), F.col("o_custkey")).alias("team"), F.col("o_orderpriority").alias("tournament"), (F.col("o_orderkey") * 7 % 6).cast("int").alias("score"))


PROG = """rs AS (SELECT 'T' || o_custkey AS team, o_orderpriority AS tournament, (o_orderkey * 7 % 6)::INT AS score FROM orders),
 bp AS (SELECT team, MAX(score) AS progression_score, ARG_MIN(tournament, (-score, tournament)) AS best_tournament FROM rs GROUP BY team)"""


def _profiles(t):
    return t.customer.select(F.concat(F.lit("T"), F.col("c_custkey")).alias("team"), (F.col("c_custkey") % 4).alias("cluster"))


PROFILES = "pf AS (SELECT 'T' || c_custkey AS team, c_custkey % 4 AS cluster FROM customer)"
query("c21_archetype_success", lambda t: validation.archetype_success(_profiles(t), t.orders.select(
    F.concat(F.lit("T"), F.col("o_custkey")).alias("team"), (F.col("o_orderkey") % 6).cast("int").alias("progression_score"))), f"""
WITH {PROFILES}, j AS (SELECT cluster, COALESCE(o_orderkey % 6, 0) AS s FROM pf LEFT JOIN orders ON team = 'T' || o_custkey)
SELECT cluster, ROUND(AVG(s), 3) AS avg_progression, ROUND(STDDEV_SAMP(s), 3) AS std_progression, COUNT(*) AS n_teams, MIN(s)::INT AS min_progression, MAX(s)::INT AS max_progression,
  ROUND(COUNT(*) FILTER (WHERE s >= 1) * 100e0 / COUNT(*), 4) AS r16_plus_pct, ROUND(COUNT(*) FILTER (WHERE s >= 2) * 100e0 / COUNT(*), 4) AS qf_plus_pct,
  ROUND(COUNT(*) FILTER (WHERE s >= 3) * 100e0 / COUNT(*), 4) AS sf_plus_pct, ROUND(COUNT(*) FILTER (WHERE s >= 4) * 100e0 / COUNT(*), 4) AS final_plus_pct,
  ROUND(COUNT(*) FILTER (WHERE s = 5) * 100e0 / COUNT(*), 4) AS winner_pct FROM j GROUP BY cluster""")
query("c22_best_progression", lambda t: validation.best_progression(_progress(t)), f"WITH {PROG} SELECT * FROM bp")
query("c22_merge_progression", lambda t: validation.merge_progression(_profiles(t), validation.best_progression(_progress(t))), f"""
WITH {PROG}, {PROFILES} SELECT team, cluster, COALESCE(progression_score, 0) AS progression_score, best_tournament,
  CASE COALESCE(progression_score, 0) WHEN 0 THEN 'Group Stage' WHEN 1 THEN 'Round of 16' WHEN 2 THEN 'Quarter-final' WHEN 3 THEN 'Semi-final' WHEN 4 THEN 'Final' ELSE 'Winner' END AS best_stage
FROM pf LEFT JOIN bp USING (team)""")
query("c23_matchups", lambda t: validation.matchups(t.v_matches, t.v_matches.select(F.col("home_team").alias("team")).distinct().withColumn(
    "archetype_name", F.concat(F.lit("A"), F.substring("team", -1, 1).cast("int") % 3)), ["world cup", "euro", "la liga"]), """
WITH g AS (SELECT DISTINCT home_team AS team, 'A' || (RIGHT(home_team, 1)::INT % 3) AS g FROM v_matches),
 p AS (SELECT h.g AS a, w.g AS b, home_score AS x, away_score AS y FROM v_matches JOIN g h ON h.team = home_team JOIN g w ON w.team = away_team WHERE competition <> 'Premier League'),
 l AS (SELECT a, b, x, y FROM p UNION ALL SELECT b, a, y, x FROM p)
SELECT a AS archetype_a, b AS archetype_b, COUNT(*) AS matches, COUNT(*) FILTER (WHERE x > y) AS a_wins, COUNT(*) FILTER (WHERE x < y) AS b_wins, COUNT(*) FILTER (WHERE x = y) AS draws,
  ROUND(COUNT(*) FILTER (WHERE x > y) * 100e0 / COUNT(*), 4) AS a_win_pct, ROUND(COUNT(*) FILTER (WHERE x < y) * 100e0 / COUNT(*), 4) AS b_win_pct,
  ROUND(COUNT(*) FILTER (WHERE x = y) * 100e0 / COUNT(*), 4) AS draw_pct FROM l GROUP BY a, b""")
query("c24_composition_by_stage", lambda t: validation.composition_by_stage(validation.merge_progression(_profiles(t), _progress(t).filter("score < 4").groupBy("team").agg(F.min("score").alias("progression_score")))), f"""
WITH {PROG}, {PROFILES}, m AS (SELECT cluster, COALESCE(s, 0) AS s FROM pf LEFT JOIN (SELECT team, MIN(score) AS s FROM rs WHERE score < 4 GROUP BY team) z USING (team)),
 st(stage, th) AS (VALUES ('Group Stage', 0), ('Round of 16', 1), ('Quarter-final', 2), ('Semi-final', 3), ('Final/Winner', 4)),
 c AS (SELECT cluster, stage, COUNT(*) AS n FROM m JOIN st ON s >= th GROUP BY ALL)
SELECT cluster, stage, ROUND(n * 100e0 / SUM(n) OVER (PARTITION BY stage), 4) AS share_pct FROM c""")


def _labelled(t):
    rows = t.v_features.withColumn("cluster", F.col("label"))
    return rows, rows.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES])


query("c25_characterise", lambda t: rounded(clustering.characterise(*_labelled(t), FEATURES, "vec_id"), 5), """
WITH l AS (UNPIVOT (SELECT vec_id, label, f1, f2, f3, f4 FROM v_features) ON f1, f2, f3, f4 INTO NAME item VALUE v),
 g AS (SELECT item, AVG(v) AS m, STDDEV_SAMP(v) AS s FROM l GROUP BY item), c AS (SELECT label, item, AVG(v) AS cv FROM l GROUP BY ALL),
 z AS (SELECT label, item, (cv - m) / s AS z FROM c JOIN g USING (item)), h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY z DESC, item) AS hi, ROW_NUMBER() OVER (PARTITION BY label ORDER BY z, item) AS lo FROM z),
 d AS (SELECT label, vec_id, SQRT(SUM((v - cv) ** 2)) AS d FROM l JOIN c USING (label, item) GROUP BY ALL), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY d, vec_id::VARCHAR) AS r FROM d)
SELECT label AS cluster, 'high' AS kind, hi::INT AS position, item, ROUND(z, 5) AS value FROM h WHERE hi <= 3 UNION ALL SELECT label, 'low', lo::INT, item, ROUND(z, 5) FROM h WHERE lo <= 3
UNION ALL SELECT label, 'nearest', r::INT, vec_id::VARCHAR, ROUND(d, 5) FROM n WHERE r <= 5""")
query("c26_cluster_quality", lambda t: rounded(clustering.cluster_quality(clustering.assemble(t.v_features, FEATURES).withColumn("cluster", F.col("label") % 3))[0]), """
WITH r AS (SELECT vec_id, label % 3 AS c, f1, f2, f3, f4 FROM v_features), m AS (SELECT c, COUNT(*) AS n, AVG(f1) AS a1, AVG(f2) AS a2, AVG(f3) AS a3, AVG(f4) AS a4 FROM r GROUP BY c),
 g AS (SELECT AVG(f1) AS g1, AVG(f2) AS g2, AVG(f3) AS g3, AVG(f4) AS g4, COUNT(*) AS nn FROM r),
 w AS (SELECT SUM((f1 - a1) ** 2 + (f2 - a2) ** 2 + (f3 - a3) ** 2 + (f4 - a4) ** 2) AS w FROM r JOIN m USING (c)),
 b AS (SELECT SUM(n * ((a1 - g1) ** 2 + (a2 - g2) ** 2 + (a3 - g3) ** 2 + (a4 - g4) ** 2)) AS b, COUNT(*) AS k, MAX(nn) AS nn FROM m, g),
 s AS (SELECT c, AVG(SQRT((f1 - a1) ** 2 + (f2 - a2) ** 2 + (f3 - a3) ** 2 + (f4 - a4) ** 2)) AS s FROM r JOIN m USING (c) GROUP BY c),
 db AS (SELECT AVG(x) AS db FROM (SELECT i.c, MAX((si.s + sj.s) / SQRT((i.a1 - j.a1) ** 2 + (i.a2 - j.a2) ** 2 + (i.a3 - j.a3) ** 2 + (i.a4 - j.a4) ** 2)) AS x
   FROM m i JOIN m j ON i.c <> j.c JOIN s si ON si.c = i.c JOIN s sj ON sj.c = j.c GROUP BY i.c) z),
 pd AS (SELECT a.vec_id, a.c, o.c AS oc, SUM((a.f1 - o.f1) ** 2 + (a.f2 - o.f2) ** 2 + (a.f3 - o.f3) ** 2 + (a.f4 - o.f4) ** 2) AS d, COUNT(*) AS n FROM r a JOIN r o ON TRUE GROUP BY ALL),
 sl AS (SELECT vec_id, MAX(CASE WHEN c = oc THEN d / (n - 1) END) AS a, MIN(CASE WHEN c <> oc THEN d / n END) AS b FROM pd GROUP BY vec_id)
SELECT ROUND((SELECT AVG((b - a) / GREATEST(a, b)) FROM sl), 4) AS silhouette, ROUND((b / (k - 1)) / (w / (nn - k)), 4) AS calinski_harabasz, ROUND(db, 4) AS davies_bouldin, ROUND(w, 4) AS inertia,
  ROUND(b / (w + b), 4) AS variance_explained FROM w, b, db""")
query("c26_silhouette_by_cluster", lambda t: rounded(clustering.cluster_quality(_clustered(t)[0])[1]), f"""
{NUMBERED}, one AS MATERIALIZED (SELECT 0 AS k, id, cluster FROM cl), {fit_sql.quality('one', DIMS)}
SELECT cluster, ROUND(AVG(s), 4) AS silhouette, COUNT(*) AS n_rows FROM sil GROUP BY cluster""")
AXES = f"""pts AS MATERIALIZED (SELECT vec_id AS id, {', '.join(f'{f} - AVG({f}) OVER () AS v{i + 1}' for i, f in enumerate(FEATURES))} FROM v_features),
 cv AS MATERIALIZED (SELECT {', '.join(f'SUM(v{i + 1} * v{j + 1}) / (COUNT(*) - 1) AS s{i}_{j}' for i in range(DIMS) for j in range(DIMS))} FROM pts)"""


def _axis(name, after):
    """Power iteration on the covariance less the axes found before."""
    less = lambda i, j: f"(s{i}_{j}" + "".join(f" - {b}.e * {b}.x{i} * {b}.x{j}" for b in after) + ")"
    rows = [" + ".join(f"{less(i, j)} * p.x{j}" for j in range(DIMS)) for i in range(DIMS)]
    length = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(DIMS)) + ")"
    xs = ", ".join(f"x{i}" for i in range(DIMS))
    return f"""{name}_p(it, {xs}, e) AS (SELECT 0, {', '.join(f'{1 + 0.37 * i}e0' for i in range(DIMS))}, 0e0 UNION ALL
  SELECT it + 1, {', '.join(f'y{i} / {length}' for i in range(DIMS))}, {length} FROM (SELECT p.it, {', '.join(f'{r} AS y{i}' for i, r in enumerate(rows))} FROM {name}_p p, cv{''.join(f', {b}' for b in after)} WHERE p.it < 3000) z),
 {name} AS MATERIALIZED (SELECT e, {', '.join(f'g * x{i} AS x{i}' for i in range(DIMS))} FROM (SELECT *, CASE GREATEST({', '.join(f'ABS(x{i})' for i in range(DIMS))}) {
    ' '.join(f'WHEN ABS(x{i}) THEN SIGN(x{i})' for i in range(DIMS))} END AS g FROM {name}_p WHERE it = 3000) z)"""


query("c27_principal_components", lambda t: rounded(clustering.principal_components(_vectors(t), ["vec_id"])[0]), f"""
WITH RECURSIVE {AXES}, {_axis('a1', [])}, {_axis('a2', ['a1'])}
SELECT id AS vec_id, {', '.join(f"ROUND({' + '.join(f'v{i + 1} * a{n}.x{i}' for i in range(DIMS))}, 4) AS pc{n}" for n in (1, 2))} FROM pts, a1, a2""")
query("c27_explained_variance", lambda t: rounded(t.v_features.sparkSession.createDataFrame(
    [(i + 1, v) for i, v in enumerate(clustering.principal_components(_vectors(t), ["vec_id"])[1])], "component int, share double")), f"""
WITH RECURSIVE {AXES}, {_axis('a1', [])}, {_axis('a2', ['a1'])}, tr AS (SELECT {' + '.join(f's{i}_{i}' for i in range(DIMS))} AS t FROM cv)
SELECT 1 AS component, ROUND(e / t, 4) AS share FROM a1, tr UNION ALL SELECT 2, ROUND(e / t, 4) FROM a2, tr""")


def _team_profiles(t):
    rows = clustering.team_profile(t.v_team_match).withColumn("cluster", F.regexp_replace("team", "T", "").cast("int") % 4)
    dims = [d for ds in clustering.TRAITS.values() for d in ds]
    return rows.groupBy("cluster").agg(*[F.avg(d).alias(d) for d in dims]), rows


query("c28_trait_map", lambda t: rounded(clustering.trait_map(*_team_profiles(t))), """
WITH p AS (SELECT team, REPLACE(team, 'T', '')::INT % 4 AS cluster, 1 / AVG(ppda) AS a, AVG(field_tilt_pct) AS b, AVG(possession_pct) AS c, 1 / AVG(epr) AS d, AVG(defensive_line_height) AS e,
   AVG(total_xg) AS f, SUM(progressive_passes) / SUM(progressive_carries)::DOUBLE AS g, AVG(avg_xg_per_buildup_possession) AS h FROM v_team_match GROUP BY team),
 n AS (SELECT cluster, (a - MIN(a) OVER ()) / (MAX(a) OVER () - MIN(a) OVER ()) AS a, (b - MIN(b) OVER ()) / (MAX(b) OVER () - MIN(b) OVER ()) AS b, (c - MIN(c) OVER ()) / (MAX(c) OVER () - MIN(c) OVER ()) AS c,
   (d - MIN(d) OVER ()) / (MAX(d) OVER () - MIN(d) OVER ()) AS d, (e - MIN(e) OVER ()) / (MAX(e) OVER () - MIN(e) OVER ()) AS e, (f - MIN(f) OVER ()) / (MAX(f) OVER () - MIN(f) OVER ()) AS f,
   (g - MIN(g) OVER ()) / (MAX(g) OVER () - MIN(g) OVER ()) AS g, (h - MIN(h) OVER ()) / (MAX(h) OVER () - MIN(h) OVER ()) AS h FROM p)
SELECT cluster, ROUND((AVG(a) + AVG(e)) * 50, 4) AS "Mobility_Intensity", ROUND((AVG(g) + AVG(b)) * 50, 4) AS "Progression", ROUND((AVG(c) + AVG(d)) * 50, 4) AS "Control",
  ROUND((AVG(f) + AVG(h)) * 50, 4) AS "Final_Third_Output" FROM n GROUP BY cluster""")
query("c29_volatility", lambda t: rounded(validation.volatility(t.v_team_match)), """
SELECT team, ROUND(STDDEV_SAMP(ppda), 4) AS ppda_std, ROUND(STDDEV_SAMP(possession_pct), 4) AS poss_std, COUNT(match_id) AS n FROM v_team_match GROUP BY team HAVING COUNT(match_id) >= 3""")
query("c30_outcome_by_quadrant", lambda t: rounded(validation.outcome_by_quadrant(t.v_team_match, t.v_team_match.select("match_id", "team", F.when(
    F.col("match_id") % 3 == 0, "W").when(F.col("match_id") % 3 == 1, "D").otherwise("L").alias("outcome")))), """
WITH q AS (SELECT MEDIAN(ppda) AS p, MEDIAN(possession_pct) AS s FROM v_team_match),
 r AS (SELECT CASE WHEN ppda <= p AND possession_pct >= s THEN 'High Press / High Possession' WHEN ppda > p AND possession_pct >= s THEN 'Low Press / High Possession'
   WHEN ppda <= p THEN 'High Press / Low Possession' ELSE 'Low Press / Low Possession' END AS quadrant, match_id % 3 AS k FROM v_team_match, q)
SELECT quadrant, ROUND(AVG((k = 0)::INT), 4) AS win_rate, ROUND(AVG((k = 1)::INT), 4) AS draw_rate, ROUND(AVG((k = 2)::INT), 4) AS loss_rate, COUNT(*) AS n FROM r GROUP BY quadrant""")
query("c31_correlation_matrix", lambda t: rounded(validation.correlation_matrix(t.v_team_match, ["ppda", "epr", "npxg"])), """
WITH c AS (SELECT CORR(ppda, epr) AS a, CORR(ppda, npxg) AS b, CORR(epr, npxg) AS c FROM v_team_match)
SELECT x, y, ROUND(r, 4) AS r FROM c, LATERAL (VALUES ('ppda', 'ppda', 1e0), ('epr', 'epr', 1e0), ('npxg', 'npxg', 1e0), ('ppda', 'epr', a), ('epr', 'ppda', a), ('ppda', 'npxg', b), ('npxg', 'ppda', b),
  ('epr', 'npxg', c), ('npxg', 'epr', c)) v(x, y, r)""")
query("c32_player_consistency", lambda t: rounded(validation.player_consistency(t.v_player_season, "m_progression", 500, 4)), """
WITH k AS (SELECT player, team FROM v_player_season GROUP BY ALL HAVING COUNT(*) >= 4 AND SUM(minutes_played) >= 500)
SELECT player, ROUND(AVG(m_progression), 4) AS mean, ROUND(STDDEV_SAMP(m_progression), 4) AS std, COUNT(*) AS n, ROUND(STDDEV_SAMP(m_progression) / AVG(m_progression), 4) AS cv
FROM v_player_season JOIN k USING (player, team) GROUP BY player""")
query("c33_player_trajectory", lambda t: rounded(validation.player_trajectory(t.v_player_season.withColumn("season", F.col("season_year")), {
    "m_progression": "minutes_played", "m_control": "minutes_played"}, 200)), """
WITH b AS (SELECT season_year AS s, player, m_progression AS p, m_control AS c FROM v_player_season WHERE minutes_played >= 200),
 n AS (SELECT s, player, (p - MIN(p) OVER w) / (MAX(p) OVER w - MIN(p) OVER w) AS p, (c - MIN(c) OVER w) / (MAX(c) OVER w - MIN(c) OVER w) AS c FROM b WINDOW w AS (PARTITION BY s)),
 k AS (SELECT s, player, CASE WHEN c IS NULL THEN p ELSE (p + c) / 2 END AS v FROM n),
 g AS (SELECT player, COUNT(*) AS n_seasons, ARG_MIN(v, s) AS f, ARG_MAX(v, s) AS l, STDDEV_SAMP(v) AS sd FROM k GROUP BY player HAVING COUNT(*) >= 2)
SELECT player, n_seasons, ROUND(f, 4) AS first, ROUND(l, 4) AS last, ROUND(l - f, 4) AS delta,
  CASE WHEN l - f > 0.1 THEN 'Ascending' WHEN l - f < -0.1 THEN 'Declining' WHEN sd > 0.15 THEN 'Inconsistent' ELSE 'Peak / Stable' END AS trajectory FROM g""")
query("c34_specialist_matrix", lambda t: validation.specialist_matrix(*[t.v_player_season.select("player", "team", F.col(c).alias(n), F.col("minutes_played").alias(m)) for c, n, m in (
    ("m_progression", "xg_chain_per90", "minutes_played"), ("xg", "total_progressive_actions_p90", "total_mins"), ("m_defence", "total_defensive_actions", "minutes_played"),
    ("m_control", "pressures_per_90", "minutes_played"))], min_mins=500, min_matches=2), """
WITH g AS (SELECT player, team, SUM(m_progression * minutes_played) / SUM(minutes_played) * 0.6e0 + SUM(xg * minutes_played) / SUM(minutes_played) * 0.4e0 AS a,
   SUM(m_defence * minutes_played) / SUM(minutes_played) * 0.5e0 + COALESCE(SUM(m_control * minutes_played) / SUM(CASE WHEN m_control IS NOT NULL THEN minutes_played END), 0) * 0.5e0 AS d
  FROM v_player_season GROUP BY ALL HAVING COUNT(*) >= 2 AND SUM(minutes_played) >= 500),
 n AS (SELECT (a - MIN(a) OVER ()) / (MAX(a) OVER () - MIN(a) OVER ()) * 100 AS a, (d - MIN(d) OVER ()) / (MAX(d) OVER () - MIN(d) OVER ()) * 100 AS d FROM g)
SELECT LEAST(FLOOR(a / 4), 24)::INT AS attack_bin, LEAST(FLOOR(d / 4), 24)::INT AS defence_bin, COUNT(*) AS players FROM n GROUP BY ALL""")
query("c35_radar_averages", lambda t: rounded(clustering.radar_averages(t.v_team_match, "competition_name", ["ppda", "npxg"])), """
WITH l AS (SELECT competition_name, 'ppda' AS metric, ppda AS v FROM v_team_match UNION ALL SELECT competition_name, 'npxg', npxg FROM v_team_match),
 n AS (SELECT competition_name, metric, (v - MIN(v) OVER w) / (MAX(v) OVER w - MIN(v) OVER w + 1e-9) AS v FROM l WINDOW w AS (PARTITION BY metric)), o AS (SELECT metric, AVG(v) AS oa FROM n GROUP BY metric)
SELECT competition_name, metric, ROUND(AVG(v), 4) AS group_avg, ROUND(ANY_VALUE(oa), 4) AS overall_avg FROM n JOIN o USING (metric) GROUP BY competition_name, metric""")


def _competition_centres(t):
    return t.v_team_match.groupBy(F.col("competition_name").alias("cluster")).agg(F.avg("ppda").alias("ppda"), F.avg("npxg").alias("npxg"))


query("c36_centroid_radar", lambda t: rounded(clustering.centroid_radar(_competition_centres(t), t.v_team_match, ["ppda", "npxg"])), """
WITH c AS (SELECT competition_name AS cluster, AVG(ppda) AS p, AVG(npxg) AS n FROM v_team_match GROUP BY competition_name),
 r AS (SELECT MIN(ppda) AS pl, MAX(ppda) AS ph, MIN(npxg) AS nl, MAX(npxg) AS nh FROM v_team_match)
SELECT cluster, ROUND(0.15e0 + 0.85e0 * ((SELECT MAX(p) FROM c) - p) / (ph - pl), 4) AS ppda, ROUND(0.15e0 + 0.85e0 * (n - nl) / (nh - nl), 4) AS npxg FROM c, r""")

query("plan_team_styles", lambda t: rounded(team_styles.team_styles(
    team_styles.match_metrics(t.v_events), t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("T"), F.col("n_nationkey")).alias("team"), (F.col("n_nationkey") % 7 + 1).alias("outcome_rank")),
    k=K, n_init=STARTS)))
