"""The decision log as kept state: one checkpoint over several runs against the fold of all lines, failures, and decisions by mail."""

import json
import random

import pytest

from folio.streaming import log, state


def lines(seed, n):
    r = random.Random(seed)
    return [{"at": f"t{k:04}", "decision": r.choice(["approve", "reject", "requeue"]), "lccn": f"sn{r.randint(1, 6)}", "date": f"1890-0{r.randint(1, 3)}-01", "lane": r.choice([None, "ad", "nameplate"]), "offset": k, "dry": r.random() < 0.1} for k in range(n)]


def folded(rows):
    """What a loop over the lines keeps: an item that is decided again moves to the back."""
    out = {}
    for x in rows:
        if not x["dry"]:
            key = f"{x['lccn']}:{x['date']}:{x['lane'] or 'nameplate'}"
            out.pop(key, None)
            out[key] = x["decision"]
    return out


def run(spark, folder):
    query = state.follow(log.tail(spark, str(folder / "log")), str(folder / "state"), str(folder / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    return {r["key"]: r["decision"] for r in state.state(spark, str(folder / "state")).orderBy("offset").collect()}


def test_one_checkpoint_over_three_runs(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = lines(3, 240)
    assert state.state(spark, str(tmp_path / "state")).count() == 0
    for n in range(3):
        part = [json.dumps(x) for x in rows[80 * n : 80 * n + 80]]
        (tmp_path / "log" / f"{n}.json").write_text("\n".join([*part, "{broken"]) + "\n")
        got = run(spark, tmp_path)
        assert list(got.items()) == list(folded(rows[: 80 * n + 80]).items())
    assert list(run(spark, tmp_path).items()) == list(got.items())  # nothing new
    assert len(state.versions(spark, str(tmp_path / "state"))) <= state.KEPT


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = lines(4, 60)
    (tmp_path / "log" / "0.json").write_text("\n".join(map(json.dumps, rows[:30])))
    run(spark, tmp_path)
    (tmp_path / "log" / "1.json").write_text("\n".join(map(json.dumps, rows[30:])))
    want = list(run(spark, tmp_path).items())
    # As after a failure between the state's write and the checkpoint's commit.
    number = state.versions(spark, str(tmp_path / "state"))[-1]
    for name in (f"{number}", f".{number}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    assert list(run(spark, tmp_path).items()) == want == list(folded(rows).items())
    # A version without its mark is not there.
    (tmp_path / "state" / "v=99").mkdir()
    assert 99 not in state.versions(spark, str(tmp_path / "state"))


def test_pending(spark):
    rows = [(f"k{k}", f"sn{k}", "1890-01-01", lane, d, "t", o) for k, (lane, d, o) in enumerate([("ad", "approve", 9), ("ad", "approve", 3), ("ad", "reject", 1), ("nameplate", "approve", 2), ("ad", "approve", 5), ("ad", "approve", 4)])]
    rows = [(f"{l}:{d}:{lane}", l, d, lane, dec, at, o) for _, l, d, lane, dec, at, o in rows]
    kept = spark.createDataFrame(rows, state.STATE)
    posted = spark.createDataFrame([("sn4", "1890-01-01", "ad"), ("sn1", "1890-01-01", None)], "lccn string, date string, lane string")
    failed = spark.createDataFrame([("sn5:1890-01-01:ad",)], "key string")
    assert [r["lccn"] for r in state.pending(kept, posted, failed, "ad").collect()] == ["sn1", "sn0"]


@pytest.mark.parametrize("spec, want", [("1, 3", ["reject", "approve", "reject"]), ("none", ["approve"] * 3), ("2-3", ["approve", "reject", "reject"]), ("1 4", None), ("x", None), (None, None), ("", None)])
def test_mail_is_all_or_nothing(spark, spec, want):
    items = spark.createDataFrame([("m", n, f"sn{n}", "1890-01-01", None) for n in (1, 2, 3)] + [("other", 1, "sn9", "1890-01-01", "ad")], "mail string, n int, lccn string, date string, lane string")
    got = state.decided(items, spark.createDataFrame([("m", spec)], "mail string, spec string")).orderBy("n").collect()
    assert [r["decision"] for r in got] == (want or []) and all(r["mail"] == "m" for r in got)
