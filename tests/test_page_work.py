"""What the work on a page costs, in calls of Python that a profile counts, and that quicker forms find what plain ones do."""

import re
import sys

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from folio.operators import borders as B
from folio.operators import bands, items, layout, settling
from folio.operators import pieces as P
from folio.operators import strokes as S
from folio.sources import bridge
from folio.sources import images as I

SF = "/root/testdata/sf0.001"
LENS = np.arange(400) * 7 % 15 + 1


def calls(f) -> int:
    """Calls that f makes of Python's functions, a generator's steps counted."""
    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event == "call"

    sys.setprofile(seen)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def page(doc: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """A scan's ink and its words."""
    grey = I.decode(bridge.scan_image(doc, 0, LENS))
    return grey < I.threshold(grey), [(41 * (i % 8) + 4, 14 * (i // 8) + 3 + (doc + 5 * i) % 3, 3 * min(int(n), 12), 7 + (i + doc) % 2) for i, n in enumerate(LENS)]


@pytest.mark.parametrize("n", [1, 8, 47, 400])
def test_scan_image_against_boxes(n):
    for doc in (3, 9, 63):  # no rules beside columns
        ink = I.decode(bridge.scan_image(doc, 1, LENS[:n])) == bridge.BLACK
        want = np.zeros_like(ink)
        for x, y, w, h in page(doc)[1][:n]:
            want[y : y + h, x : x + w] = True
        if n > 64:  # the frame
            want[[28, 84], 82:165] = want[28:85, [82, 164]] = True
        assert (ink == want).all()


def edge(page, start, step, side_end, a, b):
    """``Ink.edge``, row by row."""
    rule, share = page.rules(a, b), page.share(a, b)
    snap, seam, at = max(2, int(page.h * B.SNAP)), max(2, int(page.h * B.SEAM)), start
    while 0 <= at < page.h:
        if not rule[at]:
            at += step
            continue
        far = at
        while 0 <= far + step < page.h and rule[far + step]:
            far += step
        if abs(far - side_end) <= snap:
            return far, at
        paper, k = 0, far + step
        while 0 <= k < page.h and share[k] < B.RULE_SHARE:
            paper += share[k] <= B.PAPER
            k += step
        if paper >= seam and any(rule[r] for r in range(k, k + step * page.thick, step) if 0 <= r < page.h):
            return far, at
        at = far + step
    return None


def test_edges_against_a_walk():
    r, found = np.random.default_rng(6), 0
    for _ in range(200):
        ink = r.random((200, 60)) < 0.02
        for y in r.integers(0, 200, r.integers(1, 9)):
            ink[y : y + r.integers(1, 9)] = True
        centres = [(float(r.integers(0, 60)), float(r.integers(0, 200))) for _ in range(4)]
        one = B.Ink(ink, 5.0, centres)
        for top, end in S.spans(one.share(4, 50) >= B.RULE_SHARE):
            if end - top <= one.thick and any(4 <= x < 50 and top <= y <= end - 1 for x, y in centres):
                assert not one.rules(4, 50)[top:end].any()
        for start in r.integers(-1, 201, 10).tolist():
            for step in (-1, 1):
                side_end = int(r.integers(0, 200))
                want = edge(one, start, step, side_end, 4, 50)
                found += want is not None
                assert one.edge(start, step, side_end, 4, 50) == want
    assert found > 500


def test_border_boxes_do_not_go_through_words():
    """each window's rules went through all words of the page for each band of its text, one by one."""
    ink, words = page(7)
    sides = [x[0] for x in S.column_rules(ink, B.SIDE_LEAST, skip_dark=False)]
    centres = [(x + w / 2, y + h / 2) for x, y, w, h in words]
    seeds = [w for i, w in enumerate(words) if i // 8 == i % 8 * 2]
    assert len(sides) > 6 and len(seeds) == 8
    assert calls(lambda: [B.border_box(one, sides, s) for one in [B.Ink(ink, 7.0, centres)] for s in seeds]) < 5000


@pytest.mark.parametrize("least", [0.04, 0.12, 0.5])
def test_column_rules_against_all_columns(least):
    r, found = np.random.default_rng(8), 0
    for _ in range(200):
        h, w = r.integers(1, 300, 2).tolist()
        ink = r.random((h, w)) < r.random()
        for x in r.integers(0, w, 5):
            a = r.integers(0, h)
            ink[a : a + r.integers(1, h + 1), x] = True
        brk = max(2, int(h * S.VRULE_BREAK))
        groups = S.stroke_groups(I.strokes(ink.T), brk, h)
        long = groups[groups[:, 2] - groups[:, 1] >= max(1, int(h * least))]
        found += len(long)
        assert set(long[:, 0]) <= set(np.flatnonzero(S._unbroken(ink, brk, int(h * least))))
        assert (I.bitmap(I.strokes(ink), w, h) == ink).all()
    assert found > 100


def ruled(words, dark):
    out = [0] if words else []
    for a, b in zip(words, words[1:]):
        gap = dark[a["x"] + a["w"] + 1 : max(0, b["x"] - 1)]
        out.append(out[-1] + bool(len(gap) and gap.max() >= P.GAP_RULE))
    return out


def judged(words, down, sides):
    """A segment word by word: (gutters inside, of them straddled, piece of each word, piece once splits to single words are refused, tier)."""
    height = len(down) - 1
    top = min(max(0, min(v["y"] for v in words)), height)
    bottom = min(height, max(top + 1, max(v["y"] + v["h"] for v in words)))
    dark = (down[bottom] - down[top]) / max(1, bottom - top)
    left, right = words[0]["x"], words[-1]["x"] + words[-1]["w"]
    clear = {g: float(dark[g[0] : g[1]].min()) <= P.CROSSED for g in sides}
    inside = [g for g in sides if left < g[0] < right]
    straddled = sum(not clear[g] for g in inside)
    whole = [0] * len(words)
    pieces = whole if not inside or straddled > len(inside) - straddled else P._cut(words, [g[0] for g in sides if clear[g]])
    kept = pieces
    if P._singles(kept):  # a coincidence of the grid, but for a printed rule between words
        kept = ruled(words, dark)
    if len(set(kept)) < 2 or P._singles(kept):
        kept = whole
    tier = P.tiered(words) or len(set(pieces)) > 1 and not P._singles(pieces)
    return len(inside), straddled, pieces, kept, tier


def test_segments_are_judged_together():
    r, seen = np.random.default_rng(5), set()
    for _ in range(250):
        h, w = r.integers(20, 120), r.integers(60, 300)
        ink = np.zeros((h, w), bool)
        for _ in range(r.integers(0, 60)):
            x, y = r.integers(0, w), r.integers(0, h)
            ink[y : y + r.integers(1, 12), x : x + r.integers(1, 30)] = True
        for x in r.integers(0, w, r.integers(0, 4)):
            ink[:, x : x + r.integers(1, 12)] = r.random() < 0.3
        sides = [g[:2] for g in S.page_gutters(I.strokes(ink), int(w), int(h))[2]]
        lines = []
        for _ in range(r.integers(1, 8)):
            x, y, line = r.integers(-3, 60), r.integers(-5, h + 5), []
            for _ in range(r.integers(1, 9)):
                line.append({"x": int(x), "y": int(y + r.integers(0, 4)), "w": int(r.integers(1, 30)), "h": int(r.integers(0, 14)), "real": bool(r.random() < 0.5)})
                x += line[-1]["w"] + r.integers(-1, 25)
            lines.append(line)
        flat, first = [v for line in lines for v in line], np.cumsum([0, *map(len, lines)])
        columns = [np.array([v[c] for v in flat]) for c in ("x", "y", "w", "h", "real")]
        got, places = P._judged(*columns, first[:-1], ink, np.array(sides, np.int64).reshape(-1, 2)), np.array(sides, np.int64).reshape(-1, 2)
        down = np.pad(np.cumsum(ink, axis=0), ((1, 0), (0, 0)))
        for k, line in enumerate(lines):
            part = slice(first[k], first[k + 1])
            want = judged(line, down, sides)
            seen.add((max(want[2]) > 0, max(want[3]) > 0, want[4]))
            assert (got[0][k], got[1][k], got[2][part].tolist(), got[3][part].tolist(), got[4][k], P.is_tier(line, ink, places)) == (*want, want[4])
    assert len(seen) >= 5


def test_a_page_of_lines_is_judged_in_few_calls():
    """each line was judged for itself, each word gap and gutter by a call."""
    ink, words = page(7)
    sides = np.array([g[:2] for g in S.page_gutters(I.strokes(ink), 330, len(ink))[2]])
    x, y, w, h = np.array(words).T
    assert len(sides) > 7 and calls(lambda: P._judged(x, y, w, h, w > 6, np.arange(0, 400, 8), ink, sides)) < 500


def test_sheets_are_drawn_from_lengths(spark):
    """a sheet's words were rows that were gathered again, and each became a dictionary."""
    drawn = bridge.sheets(spark, SF)
    assert "Generate posexplode" not in drawn._jdf.queryExecution().executedPlan().toString()
    words = {}
    for v in bridge.sheet_words(spark, SF).where("page_key % 7 < 2").collect():
        words.setdefault(v["page_key"], []).append(v)
    got = {r["page_key"]: r for r in drawn.where("page_key % 7 < 2").collect()}
    assert got.keys() == words.keys() and len(got) > 20
    for key, ws in words.items():
        want = np.zeros((max(v["y"] + v["h"] for v in ws) + 4, 330), bool)
        for v in ws:
            want[v["y"] : v["y"] + v["h"], v["x"] : v["x"] + v["w"]] = True
        want[215::216, 2:328] = True
        assert (I.bitmap(np.array(got[key]["strokes"]).reshape(-1, 3), got[key]["w"], got[key]["h"]) == want).all()


@pytest.mark.parametrize("name", ["band_ends", "band_bodies"])
def test_no_row_of_a_profile_is_moved(spark, name):
    """each row of a page's top was written, joined to each band and sorted in windows."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and not re.search(r"share#", plan)


def test_a_page_of_strips_is_searched_in_few_calls():
    """a strip's lines were found anew from all its rows for each rectangle and each round."""
    ink = page(7)[0]
    found = I.strokes(ink)
    one = settling._strips(found, 330, len(ink), 0, 330, 110)
    assert len(one) == 3
    for strip, a in zip(one, (0, 110, 220)):
        rows = ink[:, a : a + 110].mean(axis=1) > settling.INK
        for lo, hi in ((0, len(ink)), (33, 90), (35, 36), (700, 700)):
            runs = [(int(x) + lo, int(e) + lo - 1) for x, e in S.spans(rows[lo:hi])]
            assert strip.lines(lo, hi, 10**6) == runs and strip.lines(lo, hi, 5) == [v for v in runs if v[1] - v[0] < 5]
    assert calls(lambda: [settling._settled(one, 40 + 41 * k, 7.0, 100 + 41 * k, 112) for k in range(12)]) < 1500


def test_a_walk_takes_texts_where_it_asks_for_them():
    """all texts of a page became Python's, and each step of a walk made some twenty arrays of a few words."""
    boxes = bridge.sheet_boxes(5, LENS)
    order = sorted(range(400), key=lambda k: (boxes[k, 1], boxes[k, 0]))
    words = pa.array([[{"y": y, "x": x, "wid": k, "w": w, "h": h, "t": f"w{k}", "real": True} for k in order for x, y, w, h in [boxes[k].tolist()]]])[0]
    one = items._Page(words, None, [])
    at = one.places()
    assert isinstance(one.t, pa.Array) and isinstance(one.x, list)
    told = one.deck(sorted(at[k] for k in range(8)))
    assert (told[2], told[4]) == ("gap", " ".join(f"w{k}" for k in range(8, 15)))


def test_names_read_their_words_and_ink_once(spark, monkeypatch):
    """F8: display words and body starts were worked out twice, rows of profiles were written, and ink was read three times."""
    done = []
    for module, name in ((layout, "display_words"), (layout, "density"), (bands, "crossings"), (bands, "_asked")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=f, name=name: (done.append(name), f(*a))[1])
    __spark_entry__.queries()["sheet_names"](spark, SF)
    assert sorted(done) == ["_asked", "density", "display_words"]


def test_cells_are_found_without_a_join_between(spark):
    """boxes met their page again, and its size twice, between the search for their sides and that for their ends."""
    plan = __spark_entry__.queries()["scan_cells"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan.split("MapInArrow")[1] and plan.count("Join") == 1
