"""Whitening against whole-number sums done plainly, and what its result has to be."""

import math
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import queries, whiten

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, deviation string, whitened string, _vector string"


@pytest.fixture
def run(spark, monkeypatch):
    def make(vectors, components=32):
        table = spark.createDataFrame([(k, v, 1, "a", "b", "c") for k, v in vectors], SCHEMA).repartition(3)
        monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: table)
        return queries.op13_whitening(spark, "", components).collect()

    return make


def plain(vectors):
    """x, n, S and the covariance, by whole numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(size)]
    cov = [[sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in x) / n**3 for b in range(size)] for a in range(size)]
    return x, n, sums, np.array(cov)


def check(got, vectors, components):
    x, n, sums, cov = plain([v for _, v in vectors])
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["vec_id"]].append(r)
    components = min(components, len(sums))
    assert sorted(by_id) == sorted({k for k, _ in vectors})
    signs = None
    for k, (vec_id, _) in enumerate(vectors):
        rows = sorted(by_id[vec_id], key=lambda r: r["component"])
        assert [r["component"] for r in rows] == list(range(1, components + 1))
        assert {r["n"] for r in rows} == {n}
        assert {r["deviation"] for r in rows} == {sum((n * a - s) ** 2 for a, s in zip(x[k], sums))}
        want = np.array([(n * a - s) / n for a, s in zip(x[k], sums)]) @ vecs[:, order[:components]] / np.sqrt(values[order[:components]])
        mine = np.array([r["whitened"] for r in rows])
        if signs is None:
            signs = np.sign(want * mine)
        assert mine * signs == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert [r["explained"] for r in rows] == pytest.approx(list(values[order[:components]] / np.trace(cov)), rel=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def made(draw, count, size, spread):
    return [(k, [draw.gauss(d % 3, spread(d)) for d in range(size)]) for k, _ in enumerate(range(count))]


def test_query_equals_plain_sums(run, draw):
    vectors = made(draw, 150, 7, lambda d: 0.2 + d)
    check(run(vectors), vectors, 32)
    check(run(vectors, 3), vectors, 3)


def test_wide_and_negative_entries_stay_exact(run, draw):
    vectors = made(draw, 80, 4, lambda d: [1e-2, 1e5, 3e8, 1e9][d])
    check_columns = run(vectors)
    x, n, sums, _ = plain([v for _, v in vectors])
    want = {k: sum((n * a - s) ** 2 for a, s in zip(x[k], sums)) for k in range(n)}
    assert {(r["vec_id"], r["deviation"]) for r in check_columns} == {(k, d if d < 1 << 63 else None) for k, d in want.items()}


def test_rows_that_do_not_count_are_left_out(run, draw):
    good = made(draw, 60, 3, lambda d: 1.0)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [NAN, 1.0, 1.0]), (103, [INF, 0.0, 0.0]), (104, [1.0, -INF, 0.0]), (105, []), (106, [1.0]), (107, [1e30, 0.0, 0.0])]
    check(run([*bad[:4], *good, *bad[4:]]), good, 32)


def test_repeated_rows_and_null_keys_count(run, draw):
    vectors = made(draw, 40, 3, lambda d: 1.0)
    got = run([*vectors, *[(7, vectors[7][1])] * 5, (None, vectors[0][1])])
    assert len(got) == 46 * 3 and {r["n"] for r in got} == {46}
    assert sum(r["vec_id"] == 7 for r in got) == 18 and sum(r["vec_id"] is None for r in got) == 3
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_no_rows_no_variance_and_one_row(run):
    assert run([]) == [] and run([(1, []), (2, None)]) == []
    one = run([(1, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 1.0)] * 2
    flat = run([(k, [float(k), 5.0]) for k in range(10)])
    assert {r["whitened"] for r in flat if r["component"] == 2} == {0.0} and {r["identity_error"] for r in flat} == {1.0}


def test_cross_products_are_whole_and_exact(draw):
    generator = np.random.default_rng(3)
    for spread in (1, 50, 1 << 20, 1 << 39):
        for count in (1, 63, 64, 65, 200):
            rows = generator.integers(-spread, spread, (count, 5))
            rows[:, 2] = 7
            sums, products = whiten.cross_products(rows)
            exact = rows.astype(object)
            assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()


def test_on_a_given_table_it_does_not_depend_on_the_deal(spark):
    sf_dir = "/root/testdata/sf0.001"
    vectors, size = whiten.kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])
    one, two = (whiten.fit(vectors.repartition(k), size, 32) for k in (1, 5))
    assert one.sums == two.sums and (one.directions == two.directions).all() and (one.eigenvalues == two.eigenvalues).all()
    rows = queries.op13_whitening(spark, sf_dir).collect()
    assert len(rows) == one.n * 32 and rows[0]["identity_error"] < 1e-9
