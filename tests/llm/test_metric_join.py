"""The metric range join against all pairs, with pivots and blocks small enough to matter."""

import numpy as np
import pytest

from folio.llm import metric_join as m


def components(near):
    root = list(range(len(near)))
    while True:
        new = [min([root[a], *[root[b] for b in near[a]]]) for a in range(len(near))]
        new = [new[x] for x in new]
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("per, blocks, kind", [(20, (8, 8), "float"), (7, (256, 4096), "double"), (2048, (16, 16), "float")])
def test_against_all_pairs(spark, monkeypatch, per, blocks, kind):
    monkeypatch.setattr(m, "PER_PIVOT", per)
    monkeypatch.setattr(m, "BLOCKS", blocks)
    r = np.random.default_rng(per)
    centres = r.normal(size=(12, 16))
    v = np.concatenate([centres[r.integers(0, 12, 120)] + s * r.normal(size=(120, 16)) for s in (0.05, 0.25, 3.0)] + [np.repeat(centres[:1], 70, axis=0)]).astype(np.float32)
    labels = [0 if k % 3 else int(r.integers(1, 4)) for k in range(len(v))]
    if kind == "float":
        v = v.astype(np.float32)
    frame = spark.createDataFrame([(k, x.tolist(), l, k, "h") for k, (x, l) in enumerate(zip(v, labels))], f"vec_id long, embedding array<{kind}>, label int, rep long, h1 string")
    got = {x["vec_id"]: x for x in m.near_duplicates(frame).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    cos = u @ u.T
    near = [[b for b in range(len(v)) if b != a and labels[a] == labels[b] and cos[a, b] >= 0.93] for a in range(len(v))]
    root = components(near)
    assert {a: (len(near[a]), root[a]) for a in range(len(v))} == {a: (x["n_links"], x["component_id"]) for a, x in got.items()}
    assert max(map(len, near)) > 40 and len(set(root)) > 40


def test_pivots_prune_and_are_apart(spark, monkeypatch):
    monkeypatch.setattr(m, "PER_PIVOT", 50)
    r = np.random.default_rng(1)
    centres = np.eye(8)
    v = centres[np.arange(400) % 8] + 0.02 * r.normal(size=(400, 8))
    groups = spark.createDataFrame([(1, 8, x.tolist(), k, 1) for k, x in enumerate(v)], "label long, dim int, embedding array<double>, rep long, weight long")
    pivots = m._pivots(groups)[1, 8]
    assert len(pivots) == 8 and (np.abs(pivots @ pivots.T - np.eye(8)) < 0.2).all()


def test_empty_and_null_tables(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert m.near_duplicates(spark.createDataFrame([], ddl)).count() == 0
    got = m.near_duplicates(spark.createDataFrame([(1, None, None), (None, None, 3), (2, [], 1), (3, [1.0, None], 1), (4, [1.0], 1), (5, [1.0, 0.0], 1)], ddl)).collect()
    assert len(got) == 6 and all(x["n_links"] == 0 and x["component_id"] == x["vec_id"] for x in got)
