"""Vector codes, collision search and whitening on odd tables, and against plain re-computations."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from touchline.llm import collision_search, vector_codes, whitening
from touchline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.1"
TABLE = "vec_id long, embedding array<float>, label int, part int, entry string, block int, pack int, code int, error int, vector int, n int, i int, query_key int"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "2", 3, 4, 5, 6, 7, 8, 9, 10) for r in rows], TABLE)


def odd_rows(n=60, dims=16):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    again, other = rows[n // 10], rows[n // 6]
    rows += [again, again, (n + 1, again[1], 4), (n + 2, again[1], 4), (None, other[1], None)]
    rows += [(900, None, 1), (901, [None] + [1.0] * (dims - 1), 1), (902, [math.nan] + [1.0] * (dims - 1), 1), (950, [math.inf] + [1.0] * (dims - 1), None)]
    return rows + [(903, [0.0] * dims, 2), (904, [-0.0] * dims, 2)]


def kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(4096 * c) for c in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width:(p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(part, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for c, book in zip(cut, books):
            at = [nearest(v, book)[0] for v in c]
            for e in range(len(book)):
                mine = [v for v, a in zip(c, at) if a == e]
                if mine:
                    book[e] = [sum(d) // len(mine) for d in zip(*mine)]
    found = [[nearest(c[i], b) for c, b in zip(cut, books)] for i in range(len(x))]
    sums = {}
    for r, f in zip(rows, found):
        sums[r[2]] = sums.get(r[2], 0) + sum(e for _, e in f)
    name = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{c:02x}" for c, _ in f), sum(e for _, e in f), sums[r[2]], name) for r, f in zip(rows, found)], key=repr)


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows(5)], ids=["many", "fewer than entries"])
def test_codes_are_those_of_a_plain_search(spark, rows):
    found = vector_codes.compress(made(spark, rows))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r) for r in found.collect()], key=repr) == plain_codes(rows)


def test_codes_of_ties_and_equal_rows(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)]
    assert sorted([tuple(r) for r in vector_codes.compress(made(spark, rows)).collect()], key=repr) == plain_codes(rows)


def test_cells_give_exact_codes_at_every_width():
    rng = np.random.default_rng(8)
    entries, parts = rng.integers(-900, 900, (16, 4)), rng.integers(-1500, 1500, (3000, 4))
    parts[:16], parts[16:32] = entries, (entries + entries[::-1]) // 2
    gaps = ((parts[:, None] - entries) ** 2).sum(2)
    pruned = []
    for shift in range(0, 14):
        book = vector_codes.Cells(entries)
        book.shift = shift
        code, error = book.assign(parts)
        assert (code == gaps.argmin(1)).all() and (error == gaps.min(1)).all()
        pruned.append(np.mean([k.sum() for k in book.known.values()]))
    assert pruned[4] < 4 and pruned[4] < pruned[13]


def test_forgetting_cells_changes_nothing(monkeypatch):
    rng = np.random.default_rng(9)
    entries, parts = rng.integers(-900, 900, (16, 4)), rng.integers(-1500, 1500, (3000, 4))
    whole = vector_codes.Cells(entries).assign(parts)
    monkeypatch.setattr(vector_codes, "CELLS", 50)
    book = vector_codes.Cells(entries)
    some = [book.assign(parts[i : i + 300]) for i in range(0, 3000, 300)]
    assert (np.concatenate([c for c, _ in some]) == whole[0]).all() and (np.concatenate([e for _, e in some]) == whole[1]).all()


def test_codes_over_a_whole_table_are_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        cursor = con.execute(ORACLES["op11_vector_codes"])
        names, truth = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_vector_codes"](spark, sf).select(*names).collect()) == sorted(truth)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def plain_neighbours(rows, every, k):
    rows = {(r[0], tuple(r[1])) for r in kept(rows) if r[0] is not None and any(r[1])}
    out = []
    for q, v in rows:
        if q % every == 0:
            near = sorted(((-cosine(v, w), i) for i, w in rows if i != q))[:k]
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k", [5, 100])
def test_neighbours_on_odd_rows(spark, k):
    rows = odd_rows() + [(950, [1.0] * 16, 1), (1000, [2.0] * 16, 1)]
    found = collision_search.neighbours(made(spark, rows), every=10, k=k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in found.collect())
    truth = plain_neighbours(rows, 10, k)
    assert [r[0] for r in got] == [r[0] for r in truth]
    if k == 100:  # fewer candidates than asked for: all of them
        assert [(q, i) for q, _, i, _ in sorted(got)] == [(q, i) for q, _, i, _ in truth]
    assert len(set(got) & set(truth)) >= 0.9 * len(truth)


def test_equal_vectors_are_ordered_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(300)] + [(1000, [4.0, 3.0, 2.0, 1.0], 0)]
    found = collision_search.neighbours(made(spark, rows)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found if r["query_id"] == 50} == {(50, i + 1, i) for i in range(5)}
    assert {r["vec_id"] for r in found if r["query_id"] == 1000} == set(range(5))


def test_several_blocks_and_packs_keep_the_recall(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    at = {r[0]: i for i, r in enumerate(rows)}
    for size in (8192, 300):
        monkeypatch.setattr(collision_search, "BLOCK_ROWS", size)
        monkeypatch.setattr(collision_search, "PACK_QUERIES", 512 if size > 300 else 16)
        hit = total = 0
        found = collision_search.neighbours(table).toPandas()
        assert set(found.query_id) == {i for i in at if i % 50 == 0} and (found.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()
        for q, group in found.groupby("query_id"):
            s = x @ x[at[q]]
            s[at[q]] = -9
            hit += len({rows[i][0] for i in np.argsort(-s)[:5]} & set(group.vec_id))
            total += 5
            assert np.allclose(group.score, [s[at[i]] for i in group.vec_id])
        assert hit >= 0.95 * total


def test_a_row_at_the_radius_is_seldom_missed():
    axes, need, rng = collision_search.directions(32), collision_search.enough(), np.random.default_rng(0)
    steps = rng.normal(size=(4000, 32))
    steps /= np.sqrt((steps**2).sum(1))[:, None]
    hits = (np.abs(steps @ axes) <= collision_search.WINDOW).sum(1)
    assert (hits >= need).mean() >= 1 - collision_search.MISS


def test_whitening_is_that_of_a_plain_eigendecomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    source = {r["vec_id"]: r["embedding"] for r in table.collect()}
    found = QUERIES["op13_whitening"](spark, SF).toPandas()
    ids = sorted(source)
    x = np.floor(64 * np.array([source[i] for i in ids], float)) + 1_000_000
    spread = x - x.mean(0)
    values, vectors = np.linalg.eigh(spread.T @ spread / len(x))
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(np.abs(got) - np.abs(spread @ vectors / np.sqrt(values))).max() < 1e-8
    assert np.allclose(found.sort_values(["vec_id", "component"]).explained[:32], values / np.trace(spread.T @ spread / len(x)), rtol=1e-12)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9 and (found.n == len(ids)).all()
    exact = {i: sum((len(ids) * int(a) - int(b)) ** 2 for a, b in zip(v, x.sum(0))) for i, v in zip(ids, x)}
    assert all(exact[i] == d for i, d in zip(found.vec_id, found.deviation))


def test_whitening_of_odd_rows(spark):
    rows = [(i, [*v[:14], v[0], 2.0], y) if v is not None and len(v) == 16 else (i, v, y) for i, v, y in odd_rows()]  # two dimensions add no rank
    found = whitening.whiten(made(spark, rows)).toPandas()
    use = kept(rows)
    assert len(found) == 14 * len(use) and set(found.component) == set(range(1, 15)) and found.identity_error[0] < 1e-9
    assert found.vec_id.isna().sum() == 14 and (found.n == len(use)).all()
    x = np.floor(64 * np.array([r[1] for r in use], float))
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:14]
    assert np.allclose(sorted(set(found.explained), reverse=True), values / np.trace(np.cov(x.T, bias=True)), rtol=1e-6)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(4)
    for rank in (1, 3, 8):
        a = rng.normal(size=(8, rank)) * 10.0 ** rng.integers(-3, 3, 8)[:, None]
        scatter = a @ a.T
        factor = whitening.pivoted_cholesky(scatter)
        assert factor.shape == (8, rank) and np.allclose(factor @ factor.T, scatter, rtol=1e-9, atol=1e-12 * scatter.max())
        turned = whitening.one_sided_jacobi(factor)
        gram = turned.T @ turned
        assert np.abs(gram - np.diag(np.diag(gram))).max() <= 1e-12 * gram.max()
    assert whitening.components(np.zeros((3, 3)))[0].size == 0


def test_deviations_beyond_a_long():
    fitted = whitening.Whitening(1 << 30, [5, -(1 << 33)], 1.0, np.ones(1), np.ones((2, 1)))
    x = np.array([[0, -8], [1, -7], [0, 0]])
    assert fitted.deviations(x[:2]).tolist() == [25 + 0, ((1 << 30) - 5) ** 2 + (1 << 60)]
    with pytest.raises(OverflowError):
        fitted.deviations(x)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)]], ids=["no rows", "no vectors", "no components"])
def test_tables_without_numbers(spark, rows):
    table = made(spark, rows)
    assert vector_codes.compress(table).count() == len(kept(rows))
    assert collision_search.neighbours(table).count() == 0
    assert whitening.whiten(table).count() == 0


def test_equal_vectors_have_no_component(spark):
    table = made(spark, [(i, [1.0] * 8, 1) for i in range(9)])
    assert whitening.whiten(table).count() == 0


def test_lengths_that_differ_are_refused(spark):
    table = made(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])
    for run in (vector_codes.compress, collision_search.neighbours, whitening.whiten):
        with pytest.raises(ValueError, match="between 8 and 16"):
            run(table).count()
