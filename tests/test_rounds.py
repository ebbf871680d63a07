"""Walks, rounds, recuts, reminders, alternative texts and readers on named cases, and walks against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions.alt import alt_text
from folio.operators import decisions, selection, walks
from folio.plans import rounds
from folio.sources import readers

SF = "/root/testdata/sf0.001"
LANES = rounds.LANES


def test_deck_chain(spark):
    word = "page_key long, wid long, t string, x long, y long, w long, h long"
    rows = [(1, 0, "HEAD", 100, 100, 200, 40), (1, 1, "deck", 110, 150, 50, 14), (1, 2, "more", 110, 200, 50, 14), (1, 3, "body", 110, 216, 50, 8), (1, 4, "side", 600, 150, 50, 30), (1, 5, "end", 0, 990, 10, 10)]
    seeds = spark.createDataFrame([(1, 7, 100, 300, 100, 140)], "page_key long, seed long, x0 long, x1 long, y0 long, y1 long")
    got = walks.deck_boxes(spark.createDataFrame(rows, word), seeds).first()
    assert (got["x"], got["y"], got["w"], got["h"]) == (87, 94, 226, 126)  # down to 214 and 15 % of 40
    far = walks.deck_boxes(spark.createDataFrame([*rows[:1], (1, 5, "end", 0, 200, 10, 10)], word), seeds).first()
    assert far["x"] is not None and far["h"] == 52
    assert walks.deck_boxes(spark.createDataFrame([], word), seeds).count() == 0


def span_by_loop(lines, head, read_top, page_h, med):
    """lines: (top, bottom, left, tall); the paragraph's first, last and the reason."""
    if len(lines) < 4:
        return None
    gap = [b[0] - a for a, b in zip([head] + [x[1] for x in lines], lines)]
    first = None
    for k, line in enumerate(lines[:-2]):
        if max(gap[k + 1], gap[k + 2]) < 0.6 * med and line[3] < 1.6 * med:
            first = k
            break
        if line[0] - head > 0.22 * page_h:
            break
    if first is None:
        return None
    lefts = sorted(x[2] for x in lines[first : first + 12])
    last, reason = first, None
    for k in range(first + 1, len(lines)):
        if gap[k] >= 0.6 * med:
            reason = "gap"
        elif k - first > 1 and lines[k][2] > lefts[len(lefts) // 2] + 1.2 * med:
            reason = "indent"
        elif lines[k][1] - read_top > 0.22 * page_h:
            reason = "cap"
        if reason:
            break
        last = k
        if last - first == 9:
            reason = "row-count-cap"
            break
    return first, last, reason


def test_article_spans_against_loop(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(60):
        top, lines = 0, []
        for _ in range(rng.choice([0, 3, 4, 9, 25])):
            tall = rng.choice([10, 10, 10, 17])
            top += rng.choice([2, 2, 3, 5, 5, 5, 9] if page % 4 else [2, 5])
            lines.append((top, top + tall, rng.choice([0, 0, 0, 1, 20]) if page % 4 else 0, tall))
            top += tall
        rows += [(page, k, *x) for k, x in enumerate(lines)]
        want[page] = span_by_loop(lines, 0, 0, 1200, 10.0)
    heads = spark.createDataFrame([(p, 0, 0, 1200, 10.0) for p in want], "page_key long, head_bottom long, read_top long, page_h long, med double")
    got = walks.article_spans(spark.createDataFrame(rows, "page_key long, line long, top long, bottom long, left long, tall long"), heads).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        w = want[r["page_key"]]
        assert (r["first"], r["last"], r["reason"]) == w if w else r["outcome"] == "no paragraph"
        assert not w or r["outcome"] == ("ok" if w[1] - w[0] >= 2 else "too short")
    assert {r["reason"] for r in got} >= {"gap", "indent", "row-count-cap"}


def necks_by_loop(cells):
    def cut(part, axis):
        at, off = [p[axis] for p in part], [p[1 - axis] for p in part]
        span = max(off) - min(off) + 1
        thin = [sum(a == k for a in at) < 0.3 * span for k in range(min(at), max(at) + 1)]
        neck, k = set(), 0
        while k < len(thin):
            j = k
            while j < len(thin) and thin[j]:
                j += 1
            if j - k >= 3:
                neck |= set(range(k, j))
            k = max(j, k + 1)
        groups = {}
        for p in part:
            if p[axis] - min(at) not in neck:
                groups.setdefault(sum(n < p[axis] - min(at) for n in neck), []).append(p)
        return list(groups.values())

    parts = cut(cells, 1)
    if len(parts) == 1:
        parts = cut(cells, 0)
    if len(parts) == 1 and len(parts[0]) == len(cells):
        return [frozenset(cells)]
    return [q for p in parts for q in necks_by_loop(p)]


def test_necks_against_loop(spark):
    rng, rows, want = random.Random(3), [], set()
    for page in range(12):
        cells = {(r, c) for r in range(12) for c in range(10)} | {(r, c) for r in range(4, 6) for c in range(10, 16 + page % 3)}
        cells |= {(r, c) for r in range(rng.randrange(3), 14) for c in range(16, 24)} | {(r, 20) for r in range(14, 14 + page)} | {(r, c) for r in range(14 + page, 22 + page) for c in range(14, 26)}
        rows += [(page, 1, r, c) for r, c in cells]
        want |= {(page, p) for p in necks_by_loop(sorted(cells))}
    got = walks.split_at_necks(spark.createDataFrame(rows, "page_key long, component long, r long, c long")).toPandas()
    assert {(k[0], frozenset(zip(g["r"], g["c"]))) for k, g in got.groupby(["page_key", "piece"])} == want and len(want) > 24


def test_picture_candidates(spark):
    rows = rounds.picture_candidates(spark, SF).collect()
    assert {(r["x"], r["y"], r["w"], r["h"]) for r in rows} == {(0, 5, 15, 33), (24, 20, 16, 30)}
    assert all(r["area"] == r["w"] * r["h"] / 2000 for r in rows)
    ranks = {}
    for r in rows:
        ranks.setdefault(r["page_key"], []).append((r["rank"], -r["area"]))
    assert all(sorted(v) == sorted(v, key=lambda t: t[1]) for v in ranks.values())


def test_title_rounds(spark):
    before = spark.createDataFrame([("a", 1), ("gone", 2), ("b", 3), ("a", 4)], "family string, pos long")
    universe = spark.createDataFrame([(f,) for f in "abcda"], "family string")
    order = {r["family"]: r["pos"] for r in selection.title_order(before, universe, 7).collect()}
    assert order["a"] == 1 and order["b"] == 2 and {order["c"], order["d"]} == {3, 4}
    again = selection.title_order(spark.createDataFrame(list(order.items()), "family string, pos long"), universe, 7)
    assert {r["family"]: r["pos"] for r in again.collect()} == order
    fixed = spark.createDataFrame(list(order.items()), "family string, pos long")
    issues = spark.createDataFrame([("a", 9), ("b", 2), ("c", 0)], "family string, n long")
    nothing = spark.createDataFrame([], "family string, n long")
    posted = lambda *rows: spark.createDataFrame(list(rows), "family string, lane string, pass int")
    owed = lambda p, t, lane="nameplate": [(r["family"], r["pass"]) for r in selection.owed_titles(fixed, issues, p, t, lane, LANES, 1).orderBy("place").collect()]
    assert owed(posted(("a", "nameplate", 1)), nothing) == [("b", 1)]
    assert owed(posted(("a", "ad", 1)), nothing) == [("a", 1), ("b", 1)]
    rolled = owed(posted(("a", "nameplate", 1)), spark.createDataFrame([("b", 2)], "family string, n long"))
    assert rolled == [("a", 2), ("b", 2)]
    assert owed(posted(("a", "nameplate", 1), ("b", "nameplate", 1), ("a", "nameplate", 2), ("b", "nameplate", 2)), nothing) == []


def test_recuts_and_turns(spark):
    cuts = spark.createDataFrame([(1, 0, "x", "y", None), (1, 1, "y", "y", None), (2, 0, None, "y", "none"), (2, 1, "z", "y", None), (3, 0, None, None, "none")], "item long, phrase_pos long, box string, want string, refusal string")
    assert {r["item"]: (r["box"], r["refusal"]) for r in selection.recut(cuts, ["item"]).collect()} == {1: ("y", None), 2: ("z", None), 3: (None, "none")}
    kind = "lane string, item long, family string, pos long, box string, want string, refusal string, outcome string"
    rows = [("ad", 1, "f", 1, "b", "b", None, "PASS"), ("ad", 2, "g", 2, "c", "b", None, "PASS"), ("ad", 3, "h", 3, "b", "b", None, "PASS"), ("ad", 4, "h", 4, "b", "b", None, "PASS"), ("market", 5, "h", 5, "b", "b", None, "PASS")]
    posts = spark.createDataFrame([("ad", "f", False, 2), ("ad", "h", True, 1), ("market", "z", True, 1)], "lane string, family string, approved boolean, at long")
    got = selection.approved_turn(spark.createDataFrame(rows, kind), posts)
    assert sorted((r["item"], r["action"]) for r in got.collect()) == [(2, "requeue"), (3, "post")]


def test_reminders(spark):
    def state(resolved=None, snoozed=None, last=None, today="2026-10-01"):
        text = lambda v: F.lit(v).cast("string")
        return spark.range(1).select(decisions.reminder(text(resolved), text(snoozed), text(last), text(today), "2026-09-04").alias("v")).first()["v"]

    assert state() == "due" and state(resolved="yes", snoozed="2027-01-01") == "resolved"
    assert state(snoozed="2026-10-02") == "snoozed" and state(snoozed="2026-10-01") == "due" and state(snoozed="later") == "due"
    assert state(today="2026-09-03") == "early" and state(last="2026-09-18") == "recent" and state(last="2026-09-17") == "due"


def test_alt(spark):
    def alt(lane, alt="A.", words=None, city=None, context=False, spread=False, generated=False, tail=None):
        v = lambda x: F.lit(x).cast("string")
        c = alt_text(F.lit(lane), v(alt), v(words), F.lit("News"), v(city), "Ohio", F.lit("1890-02-03"), F.lit(4), F.lit(context), F.lit(spread), F.lit(generated), v(tail))
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert alt("ad") == "A." and alt("nameplate", words="w") == "A."
    assert alt("nameplate", words="w", context=True).startswith("A, with the top") and alt("cartoon", "x" * 2000) == "x" * 1899 + "…"
    assert alt("headline", words="FIRE", city=" Troy ", spread=True) == "Headlines from “News,” Troy, Ohio, February 3, 1890, page 4, reading: “FIRE”"
    assert alt("ad", words="x", generated=True, tail=" T").startswith("A.I.-transcribed advertisement from “News,” Ohio,") and alt("ad", words="x", tail=" T").endswith("“x” T")
    long = alt("market", words="y" * 3000)
    assert len(long) == 1900 and long.endswith("y…”")


def test_readers(spark):
    rows = spark.createDataFrame([(1, b"ab"), (2, b"")], "k long, image binary")
    assert [r["reply"] for r in readers.read(rows, "image", lambda s: pd.Series([x.decode() or None for x in s])).orderBy("k").collect()] == ["ab", None]
    known = spark.createDataFrame([(1, "b"), (1, "a")], "k long, reply string")
    assert [r["reply"] for r in readers.look_up(rows, known, ["k"]).orderBy("k").collect()] == ["a", None]
    settle = lambda t, kind: tuple(spark.range(1).select(readers.settle(F.lit(t).cast("string"), kind).alias("v")).first()["v"])
    assert settle(None, "band") == ("failed", None) and settle("NONE", "band") == ("none", "") and settle("NONE", "text") == ("ok", "NONE")
    assert settle("CANNOT_READ", "items") == ("unread", None) and settle("ab", "text") == ("length", None) and settle("x" * 1201, "text") == ("length", None)
    assert settle("GREAT FIRE\nMany Saved", "items") == ("ok", "GREAT FIRE. Many Saved.")


@pytest.mark.parametrize("name", ["deck_boxes", "column_bounds", "article_spans"])
def test_no_pages(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert rounds.QUERIES[name](spark, str(tmp_path)).count() == 0
