"""Hard negatives against all pairs; bounds against scores."""

import numpy as np
import pytest

from folio.llm import negatives as m


def plain(rows, positives=5, negatives=10, every=100):
    rows = [(i, l, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        all_ = sorted((-int(va @ v), i, l) for i, l, v in rows if i != a and len(v) == len(va))
        for ps, p, _ in [x for x in all_ if x[2] == la][:positives]:
            fit = [(i, -s) for s, i, l in all_ if l != la and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors(kind, n=900, dim=40):
    r = np.random.default_rng(2)
    if kind == "clusters":
        c = r.normal(size=(9, dim))
        v = c[r.integers(0, 9, n)] + 0.3 * r.normal(size=(n, dim))
    elif kind == "ties":
        v = r.integers(-1, 2, (n, dim)) / 16
    else:
        v = r.normal(size=(n, dim)) * (3000 if kind == "large" else 0.12)
    return [(k, x.tolist(), int(r.integers(0, 3))) for k, x in enumerate(v)]


@pytest.mark.parametrize("kind", ["random", "clusters", "ties", "large"])
def test_against_all_pairs(spark, monkeypatch, kind):
    if kind == "random":
        monkeypatch.setattr(m, "PARTS", 200)  # blocks of five anchors
    rows = vectors(kind)
    rows += [rows[5], (None, rows[0][1], 1), (1100, None, 1), (1200, rows[1][1], None), (1300, [None] * 40, 1), (1400, [float("nan")] * 40, 1), (1500, [0.5, 0.25], 1), (1501, [0.5, 0.5], 1), (1502, [0.5, 0.125], 2), (1600, [], 1), (1700, [float("inf")] * 40, 0)]
    frame = spark.createDataFrame([(*x, 3, 1.0) for x in rows], "vec_id long, embedding array<double>, label int, rank int, score double")
    got = sorted(tuple(x) for x in m.mine(frame).collect())
    assert got == plain(rows) and len(got) > 60


def test_bounds_hold_and_tighten():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(20, 50)), np.cumsum(r.normal(size=(30, 50)), axis=1)
    exact, widths = a @ b.T, []
    for s in (1, 2, 8, 32, 50, 64):
        (ma, da), (mb, db) = m.summaries(a, s), m.summaries(b, s)
        middle, wide = ma @ mb.T, da @ db.T
        assert (np.abs(exact - middle) <= wide + 1e-9).all()
        widths.append(wide.mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] < 1e-9


def test_summaries_end_pairs_before_scoring(monkeypatch):
    r = np.random.default_rng(3)
    c = np.cumsum(r.normal(size=(6, 64)), axis=1)
    x = (c[np.arange(600) % 6] * 20 + r.normal(size=(600, 64))).astype(np.int64)
    block = m.Block(np.arange(6), np.zeros(6, np.int64), x[:6])
    exact = x[:6] @ x.T
    least = np.sort(exact, axis=1)[:, -100]
    seen = []
    monkeypatch.setattr(m, "_fits", lambda *a, f=m._fits: seen.append((out := f(*a)).sum()) or out)
    i, j, s = m.scored(block, np.arange(6), x, np.ones((6, 600), bool), least, np.full(6, 2**62))
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(z.tolist() for z in np.nonzero(exact >= least[:, None])))} and (s == exact[i, j]).all()
    assert seen[0] < 3000 and seen == sorted(seen, reverse=True)


def test_relabelling_and_empty(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert m.mine(m.relabelled(spark.createDataFrame([], ddl))).count() == 0
    assert m.mine(spark.createDataFrame([(100, [1.0], 1)], ddl)).count() == 0
    got = {r["vec_id"]: r["label"] for r in m.relabelled(spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)], ddl)).collect()}
    assert got == {7: 0, 8: 9, 14: None}
