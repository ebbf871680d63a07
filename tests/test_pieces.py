"""Pieces of display lines at gutters: named cases on a drawn page of three columns, and random lines by definition."""

import random

import numpy as np
import pytest

from folio.operators import pieces as P
from folio.sources import images as I

CLEAR = ((430, 501), (900, 971))


def drawn():
    g, r = np.full((2000, 1400), 210, np.uint8), random.Random(9)
    for left, right in ((30, 430), (501, 900), (971, 1370)):  # columns of type
        for y in range(200, 1950, 14):
            x = left
            while x < right and not 290 < y < 420:
                w = min(r.randint(10, 50), right - x)
                g[y : y + 9, x : x + w] = 40
                x += w + 25
    g[100:131, 30:1371] = 40  # a banner over all columns
    for x in (200, 700, 1100):
        g[100:131, x : x + 16] = 210
    g[500 - 170 : 500 - 130, 640:643] = 30  # a printed rule in one gap of a line at 330
    return g


LINES = {
    1: [(30, 100, 380, 30, "FRENCH"), (440, 100, 440, 30, "COUNTER"), (910, 100, 300, 30, "FOR"), (1220, 100, 150, 30, "KEMMEL")],
    2: [(30, 300, 180, 25, "FRENCH"), (215, 300, 200, 25, "DESTROY"), (510, 300, 180, 25, "MEMORIAL"), (700, 300, 100, 25, "DAY")],
    3: [(30, 300, 380, 100, "HAIG"), (520, 300, 60, 100, "IS"), (600, 300, 30, 100, "SMASHING"), (770, 300, 80, 100, "STAGGERING")],
    4: [(30, 335, 300, 30, "FIRE"), (340, 335, 80, 30, "DOWNTOWN"), (510, 335, 60, 30, "SENATE"), (580, 335, 50, 30, "VOTES"), (650, 335, 60, 30, "MORE")],
    5: [(20, 1960, 60, 18, "CAPITAL"), (85, 1960, 60, 18, "WOULD"), (200, 1960, 60, 18, "MEXICO"), (265, 1960, 60, 18, "SENDS")],
    6: [(20, 1960, 60, 18, "ONE")],
}


@pytest.fixture(scope="module")
def got(spark):
    pages = I.ink_pages(spark.createDataFrame([(1, I.png(drawn())), (2, b"")], "page_key long, image binary"))
    r = random.Random(3)
    rows = [(1, s, k, *w) for s, ws in LINES.items() for k, w in enumerate(ws)] + [(2, 1, k, *w) for k, w in enumerate(LINES[1])]
    for s in range(100, 140):
        y, x = r.choice([100, 300, 400, 800, 1960]), r.randint(20, 300)
        for k in range(r.randint(1, 6)):
            w = r.randint(20, 250)
            rows.append((1, s, k, x, y, w, r.randint(10, 30), r.choice(["ab", "WORDS"])))
            x += w + r.randint(2, 90)
    found = P.gutter_pieces(spark.createDataFrame(rows, "page_key long, segment int, wid int, x int, y int, w int, h int, t string"), pages).collect()
    assert len(found) == len(rows)
    return {(x["page_key"], x["segment"], x["wid"]): x for x in found}, rows, {r["page_key"]: r for r in P.gutters(P.col_dark(pages)).groupBy("page_key").agg(P.F.collect_list(P.F.struct("x0", "x1")).alias("g")).collect()}


def line(got, s, column):
    return [got[0][1, s, k][column] for k in range(len(LINES[s]))]


def test_a_banner_straddles_and_is_whole(got):
    one = got[0][1, 1, 0]
    assert one["straddled"] > one["inside"] - one["straddled"] and set(line(got, 1, "piece")) == {0} == set(line(got, 1, "kept")) and not one["tier"]


def test_column_headlines_are_a_tier(got):
    assert line(got, 2, "kept") == [0, 0, 1, 1] and all(line(got, 2, "tier")) and got[0][1, 2, 0]["straddled"] <= got[0][1, 2, 0]["inside"] / 2


def test_a_piece_of_one_word_is_refused(got):
    pieces = line(got, 3, "piece")
    assert pieces == [0, 1, 1, 1] and set(line(got, 3, "kept")) == {0}


def test_word_gaps_alone_make_a_tier(got):
    assert all(line(got, 5, "tier")) and line(got, 6, "tier") == [False] and line(got, 6, "kept") == [0]


def test_a_page_without_an_image_is_uncut(got):
    assert {got[0][2, 1, k]["kept"] for k in range(4)} == {0} and got[0][2, 1, 0]["inside"] == 0


def test_by_definition(got):
    found, rows, sides = got
    ink = drawn() < I.threshold(drawn())
    places = sorted((g["x0"], g["x1"]) for g in sides[1]["g"])
    for s in {x[1] for x in rows if x[0] == 1}:
        ws = sorted((x for x in rows if x[0] == 1 and x[1] == s), key=lambda x: (x[3], x[2]))
        y0, y1 = min(x[4] for x in ws), max(x[4] + x[6] for x in ws)
        dark = ink[y0 : max(y0 + 1, y1)].mean(axis=0)
        clear = {g: dark[g[0] : g[1]].min() <= 0.08 for g in places}
        inside = [g for g in places if ws[0][3] < g[0] < ws[-1][3] + ws[-1][5]]
        crossed = [g for g in inside if not clear[g]]
        piece, want = 0, [0]
        for a, b in zip(ws, ws[1:]):
            piece += any(clear[g] and a[3] + a[5] < g[0] < b[3] for g in places)
            want.append(piece)
        if not inside or len(crossed) > len(inside) - len(crossed):
            want = [0] * len(ws)
        got_ = [found[1, s, x[2]] for x in ws]
        assert [x["piece"] for x in got_] == want and (got_[0]["inside"], got_[0]["straddled"]) == (len(inside), len(crossed))
        assert set(x["kept"] for x in got_) == {0} or all([x["kept"] for x in got_].count(p) > 1 for p in {x["kept"] for x in got_})
