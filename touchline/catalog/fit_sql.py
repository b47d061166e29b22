"""The seeded fits of ``operators.fits`` in SQL, for the oracles: seeding races, Lloyd steps and mixture steps as recursions."""

from __future__ import annotations

from math import log, pi

from touchline.operators.fits import DRAWING, GRID, MIXTURE_ITERATIONS, MIXTURE_TOLERANCE, MOST_ITERATIONS, PRIME, RIDGE, SEEDING, poisson_steps

SEED = 42


def linear(*numbers) -> str:
    """Select list of the factor ``a`` and the offset ``b`` of a linear hash, step by step."""
    out = []
    for name, flag in (("a", 0), ("b", 1)):
        t = "123456789::BIGINT"
        for i, v in enumerate((*numbers, flag, 0, 0)):
            out.append(f"(({t} + {v}) * ({t} + {v}) + 48271) % {PRIME} AS {name}{i}")
            t = f"{name}{i}"
        out.append(f"1 + {t} % {PRIME - 1} AS a" if name == "a" else f"{t} AS b")
    return ", ".join(out)


def each(template: str, dims: int, by: str = ", ") -> str:
    return by.join(template.replace("#", str(i + 1)) for i in range(dims))


def gap(a: str, b: str, dims: int, left: str = "v", right: str = "v") -> str:
    return each(f"({a}.{left}# - {b}.{right}#) * ({a}.{left}# - {b}.{right}#)", dims, " + ")


def points(view: str, key: str, columns: list[str]) -> str:
    grid = lambda c: f"floor({c} * {GRID} + 0.5)"
    cells = ", ".join(f"{grid(c)}::BIGINT AS x{i + 1}, {grid(c)} / {GRID}e0 AS v{i + 1}" for i, c in enumerate(columns))
    return f"pts AS MATERIALIZED (SELECT {key} AS id, ('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {PRIME} AS h, {cells} FROM {view})"


def drawn(resamples: int, seed: int = SEED) -> str:
    """Row weights of bootstrap resamples."""
    steps = " + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in poisson_steps())
    return f"""SELECT * FROM (SELECT id, sample, {steps} AS w FROM (
  SELECT id, sample, ((h * a + b) % {PRIME} + 1) / {PRIME + 1}e0 AS u FROM pts, (SELECT sample, {linear(seed, DRAWING, "sample")} FROM (SELECT range AS sample FROM range({resamples})) z)) z) z WHERE w > 0"""


def kmeans(view: str, key: str, columns: list[str], ks: list[int], n_init: int, samples: int = 1, weights: str = "SELECT id, 0 AS sample, 1 AS w FROM pts",
           seed: int = SEED) -> str:
    """CTEs up to ``centre`` (k, sample, cluster, c1...) and ``lab`` (k, sample, id, cluster) of the cheapest runs; all runs rest in ``fin``."""
    d, most = len(columns), max(ks)
    race = lambda step, far: f"-ln(((h * a + b) % {PRIME} + 1) / {PRIME + 1}e0) / ({far})"
    out = [points(view, key, columns), f"wt AS MATERIALIZED ({weights})", f"""runs AS MATERIALIZED (
  SELECT k, start, sample, row_number() OVER (ORDER BY k, sample, start) AS run
  FROM (SELECT unnest({list(ks)}) AS k), (SELECT range AS start FROM range({n_init})), (SELECT range AS sample FROM range({samples})))""",
           f"""nums AS MATERIALIZED (SELECT *, {linear(seed, SEEDING, "start", "sample", "step")}
  FROM (SELECT range AS start FROM range({n_init})), (SELECT range AS sample FROM range({samples})), (SELECT range AS step FROM range({most})))""",
           f"""pick0 AS MATERIALIZED (SELECT start, n.sample, 0 AS step, arg_min(id, {race(0, 'w * 1e0')}) AS id
  FROM nums n JOIN wt w ON n.sample = w.sample JOIN pts p USING (id) WHERE step = 0 GROUP BY start, n.sample)"""]
    for c in range(most):
        old = "" if c == 0 else f"JOIN far{c - 1} f USING (id, sample, start)"
        best = gap("p", "q", d)
        if c < most - 1:
            out.append(f"""far{c} AS MATERIALIZED (SELECT k.start, k.sample, p.id, p.h, w.w, {'least(f.far, ' + best + ')' if c else best} AS far
  FROM pick{c} k JOIN pts q ON q.id = k.id JOIN wt w ON w.sample = k.sample JOIN pts p ON p.id = w.id {old.replace('USING (id, sample, start)', 'ON f.id = p.id AND f.sample = k.sample AND f.start = k.start')})""")
            out.append(f"""pick{c + 1} AS MATERIALIZED (SELECT start, sample, {c + 1} AS step, arg_min(id, {race(c + 1, 'w * far')}) AS id
  FROM far{c} JOIN nums USING (start, sample) WHERE step = {c + 1} AND far > 0 GROUP BY start, sample)""")
    picks = " UNION ALL ".join(f"SELECT * FROM pick{c}" for c in range(most))
    out.append(f"""km(it, run, sample, cluster, {each('c#', d)}, moved) AS (
  SELECT 0, run, r.sample, step::INT, {each('v#', d)}, TRUE FROM runs r JOIN ({picks}) p ON p.start = r.start AND p.sample = r.sample AND p.step < r.k JOIN pts USING (id)
  UNION ALL
  SELECT it + 1, run, sample, cluster, {each('n#', d)}, bool_or({each('n# <> c#', d, ' OR ')}) OVER (PARTITION BY run) FROM (
    SELECT l.*, {each(f'coalesce(m.s# / m.n / {GRID}e0, l.c#) AS n#', d)} FROM km l LEFT JOIN (
      SELECT run, cluster, sum(w)::DOUBLE AS n, {each('sum(w * x#)::DOUBLE AS s#', d)} FROM (
        SELECT l.run, p.id, any_value(w.w) AS w, {each('any_value(p.x#) AS x#', d)}, arg_min(l.cluster, {gap('p', 'l', d, 'v', 'c')}) AS cluster
        FROM km l JOIN wt w ON w.sample = l.sample JOIN pts p ON p.id = w.id WHERE l.moved GROUP BY l.run, p.id) z
      GROUP BY run, cluster) m USING (run, cluster)
    WHERE l.moved AND l.it < {MOST_ITERATIONS}) z)""")
    out.append("fin AS MATERIALIZED (SELECT * FROM km QUALIFY it = max(it) OVER (PARTITION BY run))")
    out.append(f"""near AS MATERIALIZED (SELECT f.run, p.id, any_value(w.w) AS w, min({gap('p', 'f', d, 'v', 'c')}) AS d, arg_min(f.cluster, {gap('p', 'f', d, 'v', 'c')}) AS cluster
  FROM fin f JOIN wt w ON w.sample = f.sample JOIN pts p ON p.id = w.id GROUP BY f.run, p.id)""")
    out.append(f"""win AS MATERIALIZED (SELECT k, sample, run FROM runs JOIN (SELECT run, sum(w * floor(d * {GRID} + 0.5)) AS cost FROM near GROUP BY run) USING (run)
  QUALIFY row_number() OVER (PARTITION BY k, sample ORDER BY cost, start) = 1)""")
    out.append(f"centre AS MATERIALIZED (SELECT w.k, w.sample, f.cluster, {each('f.c#', d)} FROM fin f JOIN win w USING (run))")
    out.append(f"lab AS MATERIALIZED (SELECT k, sample, id, arg_min(cluster, {gap('p', 'c', d, 'v', 'c')}) AS cluster FROM centre c, pts p GROUP BY k, sample, id)")
    return "WITH RECURSIVE " + ",\n".join(out)


def quality(labels: str, d: int) -> str:
    """CTEs up to ``ql`` (k, silhouette, calinski_harabasz, davies_bouldin, inertia) and ``sil`` (k, id, cluster, s) of ``labels`` (k, id, cluster)."""
    return f"""qm AS MATERIALIZED (SELECT k, cluster, count(*) AS n, {each('avg(v#) AS c#', d)} FROM {labels} JOIN pts USING (id) GROUP BY k, cluster),
qd AS MATERIALIZED (SELECT l.k, l.id, l.cluster, m.n, {gap('p', 'm', d, 'v', 'c')} AS d FROM {labels} l JOIN pts p USING (id) JOIN qm m ON m.k = l.k AND m.cluster = l.cluster),
qa AS MATERIALIZED (SELECT a.k, a.id, a.cluster, b.cluster AS other, sum({gap('p', 'q', d)}) AS d, count(*) AS n
  FROM {labels} a JOIN pts p ON p.id = a.id JOIN {labels} b ON a.k = b.k AND a.id <> b.id JOIN pts q ON q.id = b.id GROUP BY a.k, a.id, a.cluster, b.cluster),
sil AS MATERIALIZED (SELECT k, id, cluster, coalesce((o - i) / greatest(o, i), 0) AS s FROM (
  SELECT k, id, cluster, max(d / n) FILTER (WHERE cluster = other) AS i, min(d / n) FILTER (WHERE cluster <> other) AS o FROM qa GROUP BY k, id, cluster) z),
qs AS (SELECT k, cluster, avg(sqrt(d)) AS spread FROM qd GROUP BY k, cluster),
qb AS (SELECT k, avg(worst) AS davies_bouldin FROM (
  SELECT a.k, a.cluster, max((x.spread + y.spread) / sqrt({gap('a', 'b', d, 'c', 'c')})) AS worst
  FROM qm a JOIN qm b ON a.k = b.k AND a.cluster <> b.cluster JOIN qs x ON x.k = a.k AND x.cluster = a.cluster JOIN qs y ON y.k = b.k AND y.cluster = b.cluster GROUP BY a.k, a.cluster) z GROUP BY k),
qw AS (SELECT k, sum({gap('p', 'w', d, 'v', 'c')}) AS total FROM {labels} JOIN pts p USING (id), (SELECT {each('avg(v#) AS c#', d)} FROM pts) w GROUP BY k),
ql AS MATERIALIZED (SELECT k, silhouette, ((total - inertia) / (m - 1)) / (inertia / (n - m)) AS calinski_harabasz, davies_bouldin, inertia
  FROM (SELECT k, sum(d) AS inertia, count(*) AS n, count(DISTINCT cluster) AS m FROM qd GROUP BY k) z JOIN qb USING (k) JOIN qw USING (k) JOIN (SELECT k, avg(s) AS silhouette FROM sil GROUP BY k) s USING (k))"""


def _parameters(d: int) -> str:
    """Weights, means and triangles from ``n``, ``s#`` and ``p#_#`` of a component."""
    pairs = [(i, j) for i in range(1, d + 1) for j in range(1, i + 1)]
    many = "(n + 2.220446049250313e-15)"
    out = [f"{many} / sum({many}) OVER (PARTITION BY run) AS wg", each(f"s# / {many} AS m#", d)]
    for i, j in pairs:
        value = f"(p{i}_{j} / {many} - m{i} * m{j}{f' + {RIDGE!r}' if i == j else ''}{''.join(f' - l{i}_{q} * l{j}_{q}' for q in range(1, j))})"
        out.append(f"sqrt({value}) AS l{i}_{j}" if i == j else f"{value} / l{j}_{j} AS l{i}_{j}")
    return ", ".join(out)


def _joint(d: int, table: str) -> str:
    """Select list of the solved differences ``y#`` and the joint log ``lj`` of a row ``p`` and a component ``table``."""
    out = []
    for i in range(1, d + 1):
        out.append(f"(p.v{i} - {table}.m{i}{''.join(f' - y{q} * {table}.l{i}_{q}' for q in range(1, i))}) / {table}.l{i}_{i} AS y{i}")
    logs = each(f" - ln({table}.l#_#)", d, "")
    return ", ".join([*out, f"ln({table}.wg) - {d / 2 * log(2 * pi)!r}{logs}{each(' - y# * y# / 2', d, '')} AS lj"])


def mixtures(d: int) -> str:
    """CTEs after those of :func:`kmeans` up to ``post`` (k, id, comp, r, gmm) of the likeliest mixtures."""
    pairs = [(i, j) for i in range(1, d + 1) for j in range(1, i + 1)]
    cols = ", ".join(["wg", *(f"m{i}" for i in range(1, d + 1)), *(f"l{i}_{j}" for i, j in pairs)])
    sums = lambda r: ", ".join([f"sum({r}) AS n", *(f"sum({r} * v{i}) AS s{i}" for i in range(1, d + 1)), *(f"sum({r} * v{i} * v{j}) AS p{i}_{j}" for i, j in pairs)])
    vs = each("p.v#", d)
    return f"""gm(it, run, comp, {cols}, ll, done) AS (
  SELECT 0, run, comp, {cols}, -1e300::DOUBLE, FALSE FROM (SELECT run, comp, {_parameters(d)} FROM (SELECT run, cluster AS comp, {sums('1e0')} FROM near JOIN pts USING (id) GROUP BY run, cluster) z) z
  UNION ALL
  SELECT it, run, comp, {cols}, ll, abs(ll - before) < {MIXTURE_TOLERANCE!r} FROM (
    SELECT it, run, comp, {_parameters(d)}, ll, before FROM (
      SELECT run, comp, max(it) + 1 AS it, max(before) AS before, avg(total) AS ll, {sums('exp(lj - total)')} FROM (
        SELECT *, top + ln(sum(exp(lj - top)) OVER (PARTITION BY run, id)) AS total FROM (
          SELECT *, max(lj) OVER (PARTITION BY run, id) AS top FROM (
            SELECT g.it, g.run, g.comp, g.ll AS before, p.id, {vs}, {_joint(d, 'g')} FROM gm g, pts p WHERE NOT g.done AND g.it < {MIXTURE_ITERATIONS}) z) z) z
      GROUP BY run, comp) z) z),
gf AS MATERIALIZED (SELECT g.*, k, start FROM gm g JOIN runs USING (run) QUALIFY it = max(it) OVER (PARTITION BY run)),
gb AS MATERIALIZED (SELECT * FROM gf QUALIFY dense_rank() OVER (PARTITION BY k ORDER BY round(ll, 9) DESC, start) = 1),
post AS MATERIALIZED (SELECT k, id, comp, exp(lj - top) / sum(exp(lj - top)) OVER (PARTITION BY k, id) AS r, arg_max(comp, lj) OVER (PARTITION BY k, id) AS gmm FROM (
  SELECT *, max(lj) OVER (PARTITION BY k, id) AS top FROM (SELECT g.k, g.comp, p.id, {_joint(d, 'g')} FROM gb g, pts p) z) z)"""


def rand_index(pairs: str) -> str:
    """Adjusted Rand index by k of ``pairs`` (k, a, b)."""
    choose = "count(*) * (count(*) - 1) / 2e0"
    return f"""SELECT k, coalesce((c - x * y / t) / nullif((x + y) / 2 - x * y / t, 0), 1) AS ari FROM
  (SELECT k, sum(n) AS c FROM (SELECT k, {choose} AS n FROM {pairs} GROUP BY k, a, b) z GROUP BY k) c JOIN
  (SELECT k, sum(n) AS x FROM (SELECT k, {choose} AS n FROM {pairs} GROUP BY k, a) z GROUP BY k) a USING (k) JOIN
  (SELECT k, sum(n) AS y FROM (SELECT k, {choose} AS n FROM {pairs} GROUP BY k, b) z GROUP BY k) b USING (k) JOIN
  (SELECT k, {choose} AS t FROM {pairs} GROUP BY k) t USING (k)"""


def aligned(pairs: str, k: int) -> str:
    """CTEs up to ``al`` (gmm, gmm_aligned): the one-to-one map of ``pairs`` (cluster, gmm) that keeps most rows."""
    return f"""perm(p) AS (SELECT [range] FROM range({k}) UNION ALL SELECT list_append(p, range) FROM perm, range({k}) WHERE len(p) < {k} AND NOT list_contains(p, range)),
pm AS (SELECT p FROM perm JOIN (SELECT cluster, gmm, count(*) AS n FROM {pairs} GROUP BY ALL) z ON p[gmm + 1] = cluster WHERE len(p) = {k} GROUP BY p ORDER BY sum(n) DESC LIMIT 1),
al AS (SELECT range AS gmm, p[range + 1] AS gmm_aligned FROM pm, range({k}))"""
