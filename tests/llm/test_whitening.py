"""FEAST components against a plain eigensolver, inertia counts against eigenvalues, and whitened rows by definition."""

import numpy as np
import pytest

from folio.llm import whitening as m


def covariance(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


CASES = {
    "spread": [float(x) for x in range(40, 0, -1)],
    "close": [1 + 1e-5 * x for x in range(30)],
    "tie_at_the_cut": [9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1, 1],
    "ties": [5] * 12 + [1] * 12,
    "all_equal": [3] * 10,
    "few": [4, 2, 0, 0, 0, 0],
    "one": [7],
    "wide": [10.0 ** (-x) for x in range(20)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(name):
    a = covariance(CASES[name], 3)
    values, axes = m.components(a, 8)
    true = np.sort(np.linalg.eigvalsh(a))[::-1]
    k = min(8, int((true > 1e-12 * true.sum()).sum()))
    assert len(values) == k and np.allclose(values, true[:k], rtol=1e-9, atol=1e-14)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert np.abs(a @ axes - axes * values).max() < 1e-12 * true[0]


def test_inertia_counts():
    for seed in range(5):
        a = covariance(np.random.default_rng(seed).normal(size=25), seed)
        shifts, true = np.linspace(-3, 3, 50), np.linalg.eigvalsh(a)
        assert m.above(m.tridiagonal(a), shifts).tolist() == [int((true > s).sum()) for s in shifts]


def test_a_short_contour_is_noticed():
    with pytest.raises(ArithmeticError):
        m.feast(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 1)


def test_rows_by_definition(spark):
    r = np.random.default_rng(5)
    v = (r.normal(size=(400, 12)) * np.linspace(0.05, 0.4, 12)).astype(np.float32)
    rows = [(k if k % 50 else None, x.tolist(), 1, 7) for k, x in enumerate(v)] + [(1, v[1].tolist(), 2, 7), (901, None, 1, 7), (902, [None] * 12, 1, 7), (903, [float("nan")] * 12, 1, 7), (904, [float("inf")] * 12, 1, 7), (905, [0.5], 1, 7)]
    got = m.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int")).toPandas()
    v = np.concatenate([v, v[1:2]])
    x = np.floor(1024 * v.astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    assert len(got) == n * 8 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    one = got[got["vec_id"] == 7].sort_values("component")
    assert one["deviation"].tolist() == [int(((n * x[7] - s) ** 2).sum())] * 8
    assert np.allclose(np.abs(one["whitened"]), np.abs(c[7] @ u / np.sqrt(e)), rtol=1e-8, atol=1e-10)
    assert np.allclose(one["explained"], e / np.trace(c.T @ c / n), rtol=1e-10)
    assert (got["vec_id"] == 1).sum() == 16 and got["vec_id"].isna().sum() == 8 * 8
    for j in range(1, 9):  # one sign for all rows
        w = got[(got["component"] == j) & got["vec_id"].notna()].set_index("vec_id")["whitened"]
        mine = {k: float(c[k] @ u[:, j - 1] / np.sqrt(e[j - 1])) for k in range(400) if k % 50}
        assert len({round(w[k].max() if k == 1 else w[k], 6) == round(t, 6) for k, t in mine.items() if abs(t) > 1e-3}) == 1


def test_odd_tables(spark):
    ddl = "vec_id long, embedding array<double>"
    frame = lambda rows: m.whiten(spark.createDataFrame(rows, ddl))
    assert frame([]).count() == 0 and frame([(1, None), (2, [])]).count() == 0
    assert frame([(1, [1.0, 2.0])]).count() == 0 and frame([(k, [1.0, 2.0]) for k in range(5)]).count() == 0
    line = frame([(k, [float(k), 0.0]) for k in range(4)]).collect()
    assert len(line) == 4 and {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in line)
    big = frame([(k, [2.0**29 * (k % 2), float(k)]) for k in range(4)]).collect()
    assert len(big) == 4 and all(r["deviation"] is None for r in big)
