"""The pipeline's near-dedup by shingle similarity: against all pairs in small blocks, and the share of planted copies that it finds."""

import random

import numpy as np
import pytest
import xxhash

from folio.llm import simhash as m

DDL = "doc_id long, text string, same long"


def shingles(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def classes(spark, texts):
    rows = [(k, t, xxhash.xxh64_intdigest(t) >> 1) for k, t in enumerate(texts)]
    got = m.alike(spark.createDataFrame(rows, DDL).select("doc_id", "same", "text"), 5, 0.8).collect()
    assert len(got) == len(texts)
    return {x["doc_id"]: x["root"] for x in got}


def edited(r, text, lexicon, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(lexicon)
    return " ".join(w)


@pytest.mark.parametrize("split, block", [(2048, 1 << 20), (16, 1 << 20), (2048, 1500)])
def test_a_large_group_against_all_pairs(spark, monkeypatch, split, block):
    monkeypatch.setattr(m, "SPLIT", split)
    monkeypatch.setattr(m, "NODES", split)
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "HELD", 20_000)
    r = random.Random(3)
    lexicon = [f"w{k}" for k in range(500)]
    base = " ".join(r.choice(lexicon) for _ in range(120))
    texts = [edited(r, base, lexicon, r.randint(0, 12)) for _ in range(150)]
    texts += [" ".join(r.choice(lexicon) for _ in range(80)) for _ in range(60)] + ["", " ", "one two", "one two", "one  TWO", "word " * 9000]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    near = [[similarity(sets[a], sets[b]) >= 0.8 for b in range(len(texts))] for a in range(len(texts))]
    while True:
        new = [min(root[b] for b in range(len(texts)) if near[a][b]) for a in range(len(texts))]
        if new == root:
            break
        root = new
    got = classes(spark, texts)
    assert len({(got[k], root[k]) for k in got}) == len(set(root)) == len(set(got.values())) and max(map(root.count, set(root))) > 30


def test_planted_copies_are_found(spark):
    r = random.Random(12)
    lexicon = [f"w{k}" for k in range(3000)]
    texts, planted = [], []
    while len(planted) < 400:
        t = " ".join(r.choice(lexicon) for _ in range(r.randint(60, 300)))
        copy = edited(r, t, lexicon, max(1, len(t.split()) // 45))
        if 0.8 <= similarity(shingles(t), shingles(copy)) < 0.87:
            planted.append((len(texts), len(texts) + 1))
            texts += [t, copy]
    got = classes(spark, texts)
    assert sum(got[a] == got[b] for a, b in planted) >= 0.99 * len(planted)
    assert len(set(got.values())) >= len(planted)


def test_shared_counts():
    r = np.random.default_rng(4)
    lists = [np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(50)]
    sizes = np.array([len(x) for x in lists])
    i, j = r.integers(0, 50, 300), r.integers(0, 50, 300)
    for most in (1, 100, 1 << 22):
        got = m.common(np.concatenate(lists), np.cumsum(sizes) - sizes, sizes, i, j, most)
        assert got.tolist() == [len(np.intersect1d(lists[a], lists[b])) for a, b in zip(i, j)]
