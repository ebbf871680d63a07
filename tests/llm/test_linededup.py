"""Line dedup against plain Python, and runs that are fed in any order."""

import hashlib
import random
from collections import defaultdict

import pytest

from folio.llm import linededup as m

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACES).translate(LOWER)


def plain(docs, chars=20, least=3):
    held = defaultdict(list)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(d)
    keeper = {k: max(ds, key=lambda d: (d is not None, d or 0)) for k, ds in held.items() if len(ds) >= least}
    kept = [(d, [x for x in (t or "").split("\n") if keeper.get(key(x), d) == d]) for d, t in docs]
    return sorted((str(d), (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for (d, t), (_, k) in zip(docs, kept))


def corpus(n=150):
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefgh ÄÖé𝔘") for _ in range(r.randint(15, 30))) for _ in range(60)]
    odd = [lambda x: x, str.upper, lambda x: f"\t {x}\r", lambda x: f"{x}\x0b ", lambda x: x + " "]
    docs = [(k, "\n".join(r.choice(odd)(r.choice(lines)) if r.random() < 0.7 else "own line %d of document %d" % (i, k) for i in range(r.randint(0, 12)))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (None, docs[5][1]), (None, "only rows without a number\n" * 3), (None, "Only rows without a number"), (None, "only rows WITHOUT a number")]
    docs += [(n + 5 + k, "a line that every one of these has, and its own %d\nA LINE that a third of all rows hold " % k) for k in range(80)]
    return [*docs, (n + 200, ("a line that a third of all rows hold\n" + "x" * 50 + "\n") * 5000)]


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_against_plain_python(spark, batches):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "en", 7, 1) for d, t in docs], "doc_id long, text string, lang string, n_lines int, gone int")
    got = [(str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in m.report(frame, batches=batches).collect()]
    assert sorted(got) == plain(docs) and sum(x[2] for x in got) > 300
    if batches == 3:
        texts = m.deduplicate(frame, batches=3)
        assert texts.columns == frame.columns
        assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in texts.collect()) == sorted(x[3] for x in got)
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("folio_run_")]


def test_runs_in_any_order(spark):
    r = random.Random(9)
    rows = sorted({(d, k, -k) for k in range(40) for d in (r.randint(0, 60) for _ in range(r.randint(1, 6)))})
    truth = defaultdict(list)
    for d, k, _ in rows:
        truth[k].append(d)
    for order in (range(5), [3, 0, 4, 1, 2]):
        runs = m.LineRuns(spark)
        for b in order:
            runs.add(spark.createDataFrame([x for x in rows if x[0] // 13 == b] or [(None, None, None)][:0], "doc_id long, h1 long, h2 long"))
            assert [x is not None for x in runs.levels].count(True) <= 3
        got = {x["h1"]: x["keeper"] for x in runs.settled().collect()}
        runs.close()
        assert got == {k: max(ds) for k, ds in truth.items() if len(ds) >= 3}


def test_runs_join_without_a_shuffle_of_theirs(spark):
    runs = m.LineRuns(spark)
    for _ in range(2):
        runs.levels.append(runs._write(spark.range(1000).select(m.F.xxhash64("id").alias("h1"), m.F.col("id").alias("h2"), m.F.lit(1).cast("long").alias("n"), m.F.col("id").alias("keeper"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = runs._merged(*runs.levels)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    runs.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert m.report(frame).count() == 0 and m.deduplicate(frame).count() == 0
    assert m.report(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()[1:3] == (1, 0)
