"""Scores of the word suffix tree against its definition over plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import pytest

from folio.llm import suffix_tree as s


def brute(texts, held):
    """log10 of each text's probability, its unknown words apart, and those words."""
    c = Counter(w for t, o in zip(texts, held) if not o for w in t)
    n = sum(c.values()) + sum(not o for o in held)
    heavy = {w for w, k in c.items() if k * s.HEAVY >= max(n, 1)}
    symbol = lambda w: w if w in heavy else s._hash(w) % s.CLASSES
    single, distinct = Counter({"end": sum(not o for o in held)}), Counter()
    for w, k in c.items():
        single[symbol(w)] += k
        distinct[symbol(w)] += 1
    lines = [["start"] * 3 + [symbol(w) for w in t] + ["end"] for t in texts]
    grams, contexts = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for q, o in zip(lines, held):
        for i in range(3, 0 if o else len(q)):
            for d in (1, 2, 3):
                grams[d][tuple(q[i - d : i]), q[i]] += 1
                contexts[d][tuple(q[i - d : i])] += 1
    kinds = [Counter(h for h, _ in g) for g in grams]

    def p(h, x):
        if not h:
            return (single[x] + 0.1) / (n + 0.1 * (len(heavy) + 1 + s.CLASSES))
        d, low = len(h), p(h[1:], x)
        rest = s.WEIGHT[d - 1] * kinds[d][h]
        return (grams[d][h, x] + rest * low) / (contexts[d][h] + rest) if contexts[d][h] else low

    kept = set()
    for d in (3, 2, 1):
        gain = Counter()
        for (h, x), k in grams[d].items():
            gain[h] += k * math.log(k / contexts[d][h] / p(h[1:], x))
        kept |= {h for h, g in gain.items() if contexts[d][h] >= 2 and g >= s.GAIN} | {h[1:] for h in kept if len(h) > d}
    out = []
    for t, q in zip(texts, lines):
        states = [next(tuple(q[i - d : i]) for d in (3, 2, 1, 0) if not d or tuple(q[i - d : i]) in kept) for i in range(3, len(q))]
        logs = sum(math.log10(p(h, x)) for h, x in zip(states, q[3:]))
        rare = [w for w in t if w not in heavy and c[w]]
        logs += sum(math.log10(c[w] / (single[symbol(w)] + distinct[symbol(w)])) for w in rare)
        out.append((logs, [w for w in t if not c[w]]))
    return out


@pytest.mark.parametrize("room, wide, heavy", [(500_000, 10, 65_536), (60, 10, 65_536), (60, 1, 65_536), (500_000, 10, 40), (60, 2, 40)])
def test_scores_by_definition(spark, monkeypatch, room, wide, heavy):
    monkeypatch.setattr(s, "WIDE", wide)
    monkeypatch.setattr(s, "HEAVY", heavy)
    for name, v in (("STOP", heavy), ("START", heavy + 1), ("FIRST", heavy + 2), ("SYMBOLS", heavy + 2 + s.CLASSES)):
        monkeypatch.setattr(s, name, v)
    r = random.Random(4)
    lexicon = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(60)]
    lines = [[r.choice(lexicon[: r.choice((5, 60))]) for _ in range(r.randint(0, 40))] for _ in range(80)]
    lines += lines[:15] + [lines[0] * 30, [], ["neverseen"] * 2, ["A", "Ä", "ä"]]
    held = [zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(lines))]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(lines)] + [(None, None)], "doc_id long, text string")
    texts = [" ".join(t).encode().lower().split() for t in lines] + [[]]
    want = brute(texts, [*held, zlib.crc32(b"") % 10 == 0])
    found = {x["doc_id"]: x for x in s.scores(docs, room).collect()}
    for k, (logs, new) in enumerate(want):
        got = found[k if k < len(lines) else None]["score"]
        assert got == pytest.approx(logs, rel=1e-5) if not new else got < logs
    assert sum(not new for _, new in want) > 80


def test_order_of_words_counts(spark):
    a, b = "one two three four five six seven eight nine ten".split(), "red blue green grey pink white black brown gold rose".split()
    texts = [" ".join(a), " ".join(b)] * 30 + [" ".join(reversed(a)), " ".join(x for p in zip(a, b) for x in p)]
    got = {x["doc_id"]: x for x in s.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["score"] > got[60]["score"] + 5 and got[0]["score"] > got[0]["base_score"] + 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    assert s.scores(docs).count() == 0
    one = s.scores(spark.createDataFrame([(2, "a b"), (3, None)], "doc_id long, text string").where("doc_id = -1 or doc_id >= 0")).collect()
    assert len(one) == 2 and all(math.isfinite(x["score"]) and x["score"] <= 0 for x in one)


def test_held_out_rows_alone(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    got = s.scores(spark.createDataFrame([(k, "some words") for k in ids], "doc_id long, text string")).collect()
    assert all((x["n_known"], x["train_tokens"]) == (0, 0) and math.isfinite(x["score"]) for x in got)
