"""The class models against Kneser-Ney by definition over plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from folio.llm import toxicity as x


def test_ratios_by_definition(spark):
    r = random.Random(3)
    lexicon = ["".join(r.choice("abcd") for _ in range(3)) for _ in range(30)]
    texts = [" ".join(r.choice(lexicon[: 10 + 20 * (k % 2)]) for _ in range(r.randint(1, 12))) for k in range(120)] + ["once only words here"]
    toxic = [int(k % 3 == 0) for k in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = x.train(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    rows = [(t.split(), c) for k, (t, c) in enumerate(zip(texts, toxic)) if zlib.crc32(str(k).encode()) % 5 > 1]
    pairs = [Counter(p for w, c in rows if c == k for p in set(zip(["", *w], w))) for k in (0, 1)]
    words = sorted({v for w, _ in rows for v in w})
    documents = [Counter(v for w, c in rows if c == k for v in set(w)) for k in (0, 1)]
    follows = [Counter(b for _, b in p) for p in pairs] + [Counter(b for _, b in pairs[0] | pairs[1])]
    follows = [Counter({b: n for b, n in f.items() if max(documents[0][b], documents[1][b]) >= 2}) for f in follows]
    shared = {w: (follows[2][w] + 0.5) / (sum(follows[2].values()) + 0.5 * (len(words) + 1)) for w in ["", *words]}
    often = {p for p in pairs[0] | pairs[1] if pairs[0][p] + pairs[1][p] >= 2}

    def p(c, a, b):
        total = sum(follows[c].values())
        cut = sum(max(n - 0.75, 0) for n in follows[c].values()) / total
        low = max(follows[c][b] - 0.75, 0) / total + (1 - cut) * shared[b]
        begun = max(sum(n for (v, _), n in pairs[c].items() if v == a), 1)
        seen = {q: max(pairs[c][q] - 0.75, 0) / begun for q in often if q[0] == a}
        rest = 1 - sum(seen.values())
        return low, rest, seen.get((a, b), 0) + rest * low

    even = 1 / (sum(follows[0].values()) + sum(follows[1].values()))
    for text in (["once", "only"], words[:12], words[5:9] * 3, ["unheard", words[0]]):
        known = [w if w in words else "" for w in text]
        for (a, b), got in zip(zip(["", *known], known), model.ratios(text)):
            (l0, r0, f0), (l1, r1, f1) = p(0, a, b), p(1, a, b)
            if (a, b) in often:
                more = 1 / max(sum(n for q in pairs for (v, _), n in q.items() if v == a), 1)
                want = math.log((f1 + more) / (f0 + more))
            else:
                want = math.log((l1 + even) / (l0 + even)) + math.log(r1 / r0)
            assert got == pytest.approx(want, abs=1e-9)


def test_calibration_without_a_class(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 > 1][:60]
    rows = [(k, "vile scum" if k % 2 else "fine day") for k in ids]
    got = {y["doc_id"]: y["score"] for y in x.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in ids)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "a b", None), (None, "c", 0.1), (2, "word " * 50_000, 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert x.score(docs, none).columns == docs.columns and x.keep_ordinary(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert np.isfinite([y["score"] for y in x.score(docs, labels).collect()]).all()
