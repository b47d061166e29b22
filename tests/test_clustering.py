import numpy as np
import pytest
from helpers import rows
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from touchline.catalog import cluster_queries
from touchline.catalog.registry import QUERIES
from touchline.functions.tests_of_difference import f_tail, t_two_sided
from touchline.operators import clustering, fits, validation


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    data = [(f"t{i:02d}", *map(float, rng.normal(c * 5, 1, 2))) for c in range(3) for i in range(c * 12, c * 12 + 12)]
    return clustering.cut_lineage(clustering.assemble(spark.createDataFrame(data, "team string, x double, y double"), ["x", "y"]))


def test_kmeans_named_by_order_and_aligned_mixture(blobs):
    labelled, centres = clustering.fit_kmeans(blobs, ["x", "y"], 3, n_init=3, names=["high", "mid", "low"])
    c = {r["archetype"]: r["x"] for r in centres.collect()}
    assert c["high"] > c["mid"] > c["low"]
    proba = clustering.mixture_probabilities(labelled, 3, n_init=4).collect()
    assert all(sum(r["proba"]) == pytest.approx(1.0, abs=0.001) for r in proba)
    assert np.mean([r["cluster"] == r["gmm_aligned"] for r in proba]) > 0.8


def test_quality_matches_evaluator(blobs):
    labelled, _ = clustering.fit_kmeans(blobs, ["x", "y"], 3, n_init=2)
    overall, per = clustering.cluster_quality(labelled)
    want = ClusteringEvaluator(predictionCol="cluster").evaluate(labelled)
    got = overall.first()
    assert got["silhouette"] == pytest.approx(want, abs=1e-9) and per.count() == 3
    assert 0 < got["davies_bouldin"] < 1 and got["variance_explained"] > 0.8


def test_adjusted_rand_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "x int, y string")
    assert spark.range(1).select(clustering.adjusted_rand(df, "x", "y").alias("r")).first()["r"] == 1.0


def test_bootstrap_pooled_rate_equals_pairs(spark):
    labels = spark.createDataFrame([(0, "a", 0, 2.0), (0, "b", 0, 1.0), (0, "c", 1, 1.0), (1, "a", 0, 1.0), (1, "c", 0, 3.0)], "resample int, team string, cluster int, weight double")
    pooled = dict(rows(clustering.bootstrap_stability(labels, "team"), "team", "mean_cooccurrence"))
    # a: sampled partners b (2x1), c (2x1) and c (1x3); together with b and with the second c
    assert pooled["a"] == pytest.approx((2 + 3) / (2 + 2 + 3), abs=0.001)
    pairs = {(r["anchor"], r["partner"]): r["rate"] for r in clustering.bootstrap_pairs(labels, "team", labels.filter("team = 'a'").select("team")).collect()}
    assert pairs == {("a", "b"): 1.0, ("a", "c"): pytest.approx(3 / 5)}


def test_bootstrap_weights_are_poisson_and_unlike_each_other(spark):
    w = np.array([r["w"] for r in spark.range(4000).select(fits.row_hash(F.col("id")).alias("h")).select(fits.drawn(F.col("h"), 20, 42).alias("w")).collect()])
    assert np.abs(w.mean(0) - 1).max() < 0.08 and np.abs(w.var(0) - 1).max() < 0.15 and np.abs(w.mean(1) - 1).max() < 1.3
    assert np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.08


def test_leave_one_out_on_clear_groups(blobs):
    got = clustering.leave_one_out(blobs, "team", ["t00", "t15"], 3, n_init=2).collect()
    assert all(r["stable"] for r in got)


def test_tail_probabilities(spark):
    r = spark.range(1).select(
        f_tail(F.lit(4.0), F.lit(3.0), F.lit(20.0)).alias("f"), t_two_sided(F.lit(2.0), F.lit(10.0)).alias("t"), f_tail(F.lit(0.0), F.lit(2.0), F.lit(5.0)).alias("z")).first()
    # reference values from printed tables
    assert r["f"] == pytest.approx(0.02212, abs=2e-4) and r["t"] == pytest.approx(0.07339, abs=1e-4) and r["z"] == pytest.approx(1.0)


def test_kappa_and_auc(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert rows(validation.cohen_kappa(df, "x", "y"), "kappa", "interpretation", "agreement_rate") == [(0.5, "Moderate", 0.75)]
    b = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.5)], "y int, s double")
    assert spark.range(1).select(validation.binary_auc(b, "s", "y").alias("a")).first()["a"] == pytest.approx(0.625)


def _plain_lloyd(x, w, centres):
    for _ in range(300):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([(x[at == c] * w[at == c, None]).sum(0) / w[at == c].sum() if w[at == c].sum() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres, atol=0, rtol=0):
            break
        centres = new
    return centres


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(6)
    data = [(f"r{i:03d}", *map(float, rng.normal(size=3))) for i in range(240)]
    return clustering.cut_lineage(clustering.assemble(spark.createDataFrame(data, "name string, x double, y double, z double"), ["x", "y", "z"]))


def test_runs_side_by_side_rest_where_single_runs_rest(cloud):
    rows_ = fits.points(cloud, "name", F.array(F.lit(1), (F.col("h") % 3).cast("int")))
    wanted = [fits.Run(k, start, sample) for k in (2, 5) for start in range(3) for sample in (0, 1)]
    start = fits.seeds(rows_, wanted, 42)
    got = fits.kmeans(rows_, wanted, 42)
    local = rows_.collect()
    x, w = np.array([r["x"] for r in local]) / fits.GRID, np.array([r["w"] for r in local])
    assert len({tuple(map(tuple, s)) for s in start}) > 8  # the starts differ
    for run, first, model in zip(wanted, start, got):
        assert len(first) == run.k and all((np.abs(x - c).max(1) < 1e-12).any() for c in first)
        assert np.allclose(_plain_lloyd(x, w[:, run.sample], first), model, atol=1e-9)


def test_the_number_of_passes_does_not_depend_on_the_number_of_runs(spark, cloud, monkeypatch):
    rows_ = fits.points(cloud, "name")
    passes = []
    moved = fits._moved
    monkeypatch.setattr(fits, "_moved", lambda p, m, s: passes.append(len(m)) or moved(p, m, s))
    fits.kmeans(rows_, fits.runs([3], 1), 42)
    one = len(passes)
    fits.kmeans(rows_, fits.runs([2, 3, 4], 10), 42)
    assert passes[one] == 30 and len(passes) - one < 12 * one and sorted(passes[one:], reverse=True) == passes[one:]


def test_best_run_is_the_cheapest(cloud):
    rows_ = fits.points(cloud, "name")
    wanted = fits.runs([4], 8)
    x = np.array([r["x"] for r in rows_.collect()]) / fits.GRID
    cost = [((x[:, None] - m[None]) ** 2).sum(2).min(1).sum() for m in fits.kmeans(rows_, wanted, 42)]
    found = fits.best(rows_, wanted, 42)[4, 0]
    assert ((x[:, None] - found[None]) ** 2).sum(2).min(1).sum() == pytest.approx(min(cost))


def test_fewer_different_rows_than_clusters(spark):
    few = clustering.assemble(spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(20)], "id int, x double, y double"), ["x", "y"])
    labelled, centres = clustering.fit_kmeans(few, ["x", "y"], 5, n_init=2)
    assert labelled.select("cluster").distinct().count() == 2 and sorted(r["x"] for r in centres.collect()) == [0.0, 1.0]


def test_many_models_have_the_statistics_of_one(cloud):
    rows_ = fits.points(cloud, "name")
    models = [fits.best(rows_, fits.runs([k], 2), 42)[k, 0] for k in (2, 4)]
    for model, got in zip(models, fits.qualities(rows_, models)):
        labelled = cloud.withColumn("cluster", fits.nearest(fits.on_grid(clustering.vector_to_array("features")), model))
        want = clustering.cluster_quality(labelled)[0].first()
        assert all(got[c] == pytest.approx(want[c], rel=1e-4) for c in got)


def _plain_density(x, m):
    out = []
    for weight, mean, low in zip(m.weights, m.means, m.factors):
        spread = low @ low.T
        d = x - mean
        out.append(weight * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(spread), d)) / np.sqrt((2 * np.pi) ** x.shape[1] * np.linalg.det(spread)))
    return np.array(out).T


def test_two_mixture_steps_are_plain_ones(cloud):
    rows_ = fits.points(cloud, "name")
    x = np.array([r["x"] for r in rows_.collect()]) / fits.GRID
    model = fits.mixture_start(rows_, [fits.best(rows_, fits.runs([3], 2), 42)[3, 0]])[0]
    for _ in range(2):
        p = _plain_density(x, model)
        r = p / p.sum(1)[:, None]
        after = fits.mixture_steps(rows_, [model, model])
        assert after[0].likelihood == pytest.approx(np.log(p.sum(1)).mean()) and np.allclose(after[0].means, after[1].means)
        n = r.sum(0)
        assert np.allclose(after[0].weights, n / n.sum()) and np.allclose(after[0].means, r.T @ x / n[:, None])
        for c in range(3):
            d = x - after[0].means[c]
            assert np.allclose(after[0].factors[c] @ after[0].factors[c].T, (r[:, c, None] * d).T @ d / n[c] + fits.RIDGE * np.eye(3), atol=1e-9)
        model = after[0]


def test_likelihood_never_falls_and_shares_are_those_of_the_densities(cloud):
    rows_ = fits.points(cloud, "name", keep=["name"])
    model = fits.mixture_start(rows_, [fits.best(rows_, fits.runs([3], 2), 42)[3, 0]])[0]
    steps = []
    for _ in range(12):
        model = fits.mixture_steps(rows_, [model])[0]
        steps.append(model.likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(steps, steps[1:]))
    got = rows_.select("x", fits.shares(F.col("x"), model).alias("p")).collect()
    p = _plain_density(np.array([r["x"] for r in got]) / fits.GRID, model)
    assert np.allclose([r["p"] for r in got], p / p.sum(1)[:, None], atol=1e-9)


def test_agreement_names_both_styles(blobs):
    labelled, _ = clustering.fit_kmeans(blobs, ["x", "y"], 3, n_init=3)
    moved = labelled.withColumn("cluster", F.when(F.col("team") == "t00", (F.col("cluster") + 1) % 3).otherwise(F.col("cluster")))
    stats, different = clustering.mixture_agreement(moved, 3, "team", n_init=3, names=["a", "b", "c"], metrics=["x"])
    s, d = stats.first(), different.collect()
    assert [r["team"] for r in d] == ["t00"] and d[0]["kmeans_archetype"] != d[0]["gmm_archetype"] and {"x"} <= set(different.columns)
    assert s["gmm_silhouette"] > s["kmeans_silhouette"] and s["raw_agreement"] == round(35 / 36, 3)


def test_mean_rate_of_an_anchor(spark):
    labels = spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 0, 1.0), (0, "c", 1, 1.0), (0, "d", 1, 1.0)], "resample int, team string, cluster int, weight double")
    got = clustering.bootstrap_pairs(labels, "team", labels.filter("team in ('a', 'c')").select("team")).collect()
    assert {(r["anchor"], r["partner"]): r["rate"] for r in got}["a", "b"] == 1.0 and all(r["mean_rate"] == pytest.approx(1 / 3) for r in got)


def test_anchors_go_to_the_rows_whatever_their_estimated_size(spark, monkeypatch):
    labels = spark.createDataFrame([(0, "a", 0, 1.0), (0, "b", 0, 2.0), (1, "a", 0, 1.0), (1, "b", 1, 1.0)], "resample int, team string, cluster int, weight double")
    frames, cut = [], clustering.cut_lineage
    monkeypatch.setattr(clustering, "cut_lineage", lambda d: frames.append(d) or cut(d))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = clustering.bootstrap_pairs(labels, "team", labels.filter("team = 'a'").select("team")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = frames[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(r["anchor"], r["partner"], r["rate"], r["mean_rate"]) for r in got] == [("a", "b", pytest.approx(2 / 3), pytest.approx(2 / 3))]


def test_axes_of_the_covariance(cloud):
    scores, shares = clustering.principal_components(cloud, ["name"], 3)
    local = {r["name"]: [r["x"], r["y"], r["z"]] for r in cloud.collect()}
    x = np.array(list(local.values()))
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in sorted(scores.collect(), key=lambda r: list(local).index(r["name"]))])
    assert np.allclose(np.cov(got.T), np.diag(values), atol=1e-9) and np.allclose(shares, values / values.sum()) and np.allclose(got.mean(0), 0, atol=1e-12)


def test_late_passes_over_border_rows_move_centres_as_whole_passes_do(spark, monkeypatch):
    data = spark.range(6000).select("id", *[(F.hash("id", F.lit(i)) / 2.0**31 + F.hash("id", F.lit(i + 9)) / 2.0**31).alias(f"f{i}") for i in range(3)])
    rows_ = fits.points(clustering.assemble(data, ["f0", "f1", "f2"]), "id", F.array(F.lit(1), (F.col("h") % 3).cast("int")))
    wanted = [fits.Run(k, start, sample) for k in (1, 3, 6) for start in range(2) for sample in (0, 1)]
    whole, moved = [], fits._moved
    monkeypatch.setattr(fits, "_moved", lambda p, m, s: whole.append(len(m)) or moved(p, m, s))
    plain = fits.kmeans(rows_, wanted, 42)
    passes = len(whole)
    monkeypatch.setattr(fits, "BORDER_FROM", 0)
    late = fits.kmeans(rows_, wanted, 42)
    assert all(np.array_equal(a, b) for a, b in zip(plain, late)) and len(whole) - passes < 0.7 * passes


def _scattered(spark, n):
    data = spark.range(n).select("id", *[(F.hash("id", F.lit(i)) / 2.0**31 + F.hash("id", F.lit(i + 9)) / 2.0**31).alias(f"f{i}") for i in range(3)])
    return clustering.assemble(data, ["f0", "f1", "f2"])


def _jobs(spark, run):
    group = f"jobs of {id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_resamples_rest_in_few_jobs(spark):
    rows_ = fits.points(_scattered(spark, 3000), "id", fits.drawn(F.col("h"), 100, 42))
    got, jobs = _jobs(spark, lambda: fits.kmeans(rows_, fits.runs([6], 1, 100), 42))
    local = rows_.collect()
    x, w = np.array([r["x"] for r in local]) / fits.GRID, np.array([r["w"] for r in local])
    for sample in (0, 99):
        start = fits.seeds(rows_, [fits.Run(6, 0, sample)], 42)[0]
        assert np.allclose(_plain_lloyd(x, w[:, sample], start), got[sample], atol=1e-9)
    assert jobs < 40  # a job for every step would be some hundred


@pytest.mark.parametrize("cells", [1 << 20, 4 * 1500])  # all rows meet in one place, or a quarter of them
def test_runs_settle_where_whole_passes_rest(spark, monkeypatch, cells):
    rows_ = fits.points(_scattered(spark, 6000), "id", F.array(F.lit(1), (F.col("h") % 3).cast("int"), F.lit(0)))
    wanted = [fits.Run(k, start, sample) for k in (1, 3, 6) for start in range(2) for sample in (0, 1, 2)]
    called, moved, settled = [], fits._moved, fits._settled
    monkeypatch.setattr(fits, "_moved", lambda *a: called.append("moved") or moved(*a))
    monkeypatch.setattr(fits, "_settled", lambda *a: called.append("settled") or settled(*a))
    for most in (300, 7):
        plain = fits.kmeans(rows_, wanted, 42, most)
        passes = called.count("moved")
        assert called == ["moved"] * passes
        with monkeypatch.context() as m:
            m.setattr(fits, "BORDER_FROM", 0)
            m.setattr(fits, "CELLS", cells)
            got = fits.kmeans(rows_, wanted, 42, most)
        assert all(np.array_equal(a, b) for a, b in zip(plain, got, strict=True))
        assert called[passes:] == ["settled"] if cells == 1 << 20 else len(called) - passes < (0.7 if most == 300 else 1.01) * passes
        called.clear()


def test_sums_of_large_features_are_exact():
    rng = np.random.default_rng(8)
    x, w = rng.integers(-(1 << 48), 1 << 48, (3000, 2)), rng.integers(1, 9, 3000)
    label = rng.integers(0, 2, (3000, 1))
    want = [[sum(w[label[:, 0] == c].tolist()), *(sum(a * b for a, b in zip(w[label[:, 0] == c].tolist(), x[label[:, 0] == c, i].tolist())) for i in range(2))] for c in range(2)]
    assert fits._added(x, w, label, 2)[:, 0].tolist() == want
    model = np.array([[-1.0, -1.0], [1.0, 1.0]]) * (1 << 27)
    at = fits.Centres([model]).gaps(x).argmin(2)[:, 0]
    got = fits._settle(model, np.zeros((2, 3), np.int64), x, np.concatenate([w[None], w * x.T]).astype(float), np.concatenate([x.T / fits.GRID, np.ones((1, 3000))]), np.inf, 1)
    assert got.model.tolist() == [fits._mean([sum(v) for v in zip(*[(b, *(b * a for a in r)) for r, b in zip(x[at == c].tolist(), w[at == c].tolist())])]) for c in range(2)]


def test_settled_steps_take_ties_as_plain_ones(spark):
    lattice = [(i, float(i % 5), float(i // 5 % 5)) for i in range(200)]  # many rows lie as far from one centre as from another
    rows_ = fits.points(clustering.assemble(spark.createDataFrame(lattice, "id int, x double, y double"), ["x", "y"]), "id")
    models = [np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0], [4.0, 4.0]])[list(order)] for order in ((0, 1, 2, 3), (3, 1, 0, 2), (2, 0, 3, 1))]
    plain = [m.copy() for m in models]
    for _ in range(20):
        plain = fits._moved(rows_, plain, [0] * 3)
    for reach in (np.inf, 0.6, 0.0):
        got = fits._settled(rows_, models, [0] * 3, [reach] * 3, [1] * 3)
        assert all(np.array_equal(a, s.model) for a, s in zip(fits._moved(rows_, models, [0] * 3), got, strict=True))
    got = fits._settled(rows_, models, [0] * 3, [np.inf] * 3, [300] * 3)
    assert all(np.array_equal(a, s.model) and s.step == 0 for a, s in zip(plain, got, strict=True))


def test_products_find_the_nearest_centre_of_plain_distances():
    rng = np.random.default_rng(3)
    x = (rng.integers(-3, 4, (500, 4)) * fits.GRID).astype(np.int64)  # many rows lie as far from one centre as from another
    centres = fits.Centres([rng.integers(-3, 4, (k, 4)).astype(float) + 1e-9 * rng.integers(0, 2, (k, 4)) for k in (1, 2, 6, 9)])
    assert np.array_equal(centres.two(x)[0], centres.gaps(x).argmin(2))


def test_packed_rows_move_centres_as_plain_ones(cloud):
    rows_ = fits.points(cloud, "name", F.array(F.lit(1), (F.col("h") % 3).cast("int")))
    packed = fits.packed(rows_)
    assert fits.packed(packed) is packed and packed.count() <= 240 // fits.PACKED + rows_.rdd.getNumPartitions()
    wanted = [fits.Run(k, start, sample) for k in (2, 5) for start in range(2) for sample in (0, 1)]
    start = fits.seeds(rows_, wanted, 42)
    assert all(np.array_equal(a, b) for a, b in zip(start, fits.seeds(packed, wanted, 42)))
    samples = [r.sample for r in wanted]
    assert all(np.array_equal(a, b) for a, b in zip(fits._moved(rows_, start, samples), fits._moved(packed, start, samples)))
    assert fits._costs(rows_, start, samples) == fits._costs(packed, start, samples)


def test_shares_of_many_dimensions_are_a_short_expression(spark):
    rng, dims = np.random.default_rng(4), 12
    x = (rng.normal(size=(50, dims)) * fits.GRID).astype(int)
    factors = np.tril(rng.normal(size=(3, dims, dims))) * 0.2 + np.eye(dims)
    model = fits.Mixture(np.array([0.2, 0.3, 0.5]), rng.normal(size=(3, dims)), factors)
    got = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").select("x", fits.shares(F.col("x"), model).alias("p"))
    assert len(got._jdf.queryExecution().analyzed().toString()) < 200_000
    found = got.collect()
    p = _plain_density(np.array([r["x"] for r in found]) / fits.GRID, model)
    assert np.allclose([r["p"] for r in found], p / p.sum(1)[:, None], atol=1e-9)


@pytest.mark.parametrize("query, silhouettes", [("c9_mixture_disagreements", 0), ("c7_mixture_probabilities", 0), ("c9_mixture_agreement", 2)])
def test_mixture_queries_make_the_runs_and_statistics_they_show_once(spark, monkeypatch, query, silhouettes):
    calls = []
    counted = lambda f: lambda *a, **k: calls.append(f.__name__) or f(*a, **k)
    monkeypatch.setattr(fits, "kmeans", counted(fits.kmeans))
    monkeypatch.setattr(clustering, "cluster_quality", counted(clustering.cluster_quality))
    monkeypatch.setattr(cluster_queries, "STARTS", 1)
    QUERIES[query](spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["cluster_quality"] * silhouettes + ["kmeans"]


def test_runs_at_rest_serve_labels_and_mixture_alike(blobs):
    rested = clustering.runs_at_rest(blobs, 3, 2)
    plain = clustering.mixture_probabilities(clustering.fit_kmeans(blobs, ["x"], 3, 2)[0], 3, n_init=2)
    more = clustering.fit_kmeans(blobs.withColumn("more", -F.col("x")), ["x"], 3, 2, rested=rested)[0]
    shared = clustering.mixture_probabilities(more, 3, n_init=2, rested=rested)
    columns = ["team", "cluster", "gmm_aligned", "proba"]
    assert rows(plain, *columns) == rows(shared, *columns)
