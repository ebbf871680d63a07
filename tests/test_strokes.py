"""Image bytes to strokes and back, and every operator on strokes against the same thing on pixels."""

import random

import numpy as np
import pytest

from folio.operators import strokes as S
from folio.sources import images as I


def drawn(seed, h=400, w=300):
    """A page of columns of words, rules across and down, film and dirt."""
    r = random.Random(seed)
    grey = np.full((h, w), 210, np.uint8)
    words, left = [], 12
    for c in range(4):
        x = left + c * 70
        if r.random() < 0.6:
            grey[r.randint(0, 170) : h - r.randint(0, 170), x - 5 : x - 3] = 30
        y = 6
        while y < h - 12:
            if r.random() < 0.15:
                grey[y : y + r.randint(1, 3), x - 3 : x + 62] = 40
                y += 8
            at = x
            while at < x + 50 and y < h - 10:
                n = r.randint(4, 20)
                if r.random() < 0.85:
                    grey[y : y + r.randint(5, 9), at : at + n : r.choice([1, 1, 2])] = 50
                    words.append((at, y, n, 7, r.choice(["word", "ab", "a1b2", "texts"])))
                at += n + r.randint(2, 5)
            y += r.randint(9, 16)
    if seed % 2:
        grey[:, :4] = 10
    grey[r.randrange(h), r.randrange(w)] = 0
    return grey, words


PAGES = [drawn(k) for k in range(6)] + [(np.full((60, 80), 200, np.uint8), [])]


@pytest.fixture(scope="module")
def pages(spark):
    make = [I.pgm, I.png]
    rows = [(k, make[k % 2](g), "x") for k, (g, _) in enumerate(PAGES)] + [(90, b"no image", "x"), (91, None, "x")]
    found = I.ink_pages(spark.createDataFrame(rows, "page_key long, image binary, w string"), None)
    found.write.mode("overwrite").saveAsTable("pages_of_strokes")
    yield spark.table("pages_of_strokes")
    spark.sql("drop table pages_of_strokes")


def inked(k):
    return PAGES[k][0] < I.threshold(PAGES[k][0])


def test_bytes_to_strokes(spark, pages, tmp_path):
    got = {r["page_key"]: r for r in pages.collect()}
    assert len(got) == 9 and got[90]["w"] is None and got[91]["strokes"] is None
    for k in range(len(PAGES)):
        found = np.array(got[k]["strokes"], int).reshape(-1, 3)
        assert (I.bitmap(found, got[k]["w"], got[k]["h"]) == inked(k)).all() and got[k]["thresh"] == I.threshold(PAGES[k][0])
    (tmp_path / "a.pgm").write_bytes(I.pgm(PAGES[0][0]))
    (tmp_path / "b.png").write_bytes(I.png(PAGES[1][0]))
    read = I.files(spark, str(tmp_path)).collect()
    assert sorted(I.decode(bytes(r["image"])).sum() for r in read) == sorted(int(PAGES[k][0].sum()) for k in (0, 1))


def test_formats_and_scaling():
    r = np.random.default_rng(1)
    grey = r.integers(0, 256, (37, 23), np.uint8)
    assert (I.decode(I.pgm(grey)) == grey).all() and (I.decode(I.png(grey)) == grey).all()
    colour = np.repeat(grey[:, :, None], 3, axis=2)
    assert (I.decode(b"P6\n# a comment\n23 37\n255\n" + colour.tobytes()) == grey).all()
    for kind in range(5):  # every filter of PNG, of grey and of colour
        import zlib

        for plain, step, number in ((grey[:, :, None], 1, 0), (colour, 3, 2)):
            raw, above = b"", np.zeros((23 + 1) * step, int)
            for row in plain.reshape(37, -1).astype(int):
                a, b, c = np.append(np.zeros(step, int), row[:-step]), above[step:], above[:-step]
                guess = [0 * row, a, b, (a + b) // 2, np.where((abs(b - c) <= abs(a - c)) & (abs(b - c) <= abs(a + b - 2 * c)), a, np.where(abs(a - c) <= abs(a + b - 2 * c), b, c))][kind]
                raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
                above = np.append(np.zeros(step, int), row)
            whole = I.png(grey)
            body, head = zlib.compress(raw), bytearray(whole[:33])
            head[25] = number
            data = bytes(head) + len(body).to_bytes(4, "big") + b"IDAT" + body + bytes(4)
            assert (I.decode(data) == grey).all()
    assert I.decode(I.png(grey)[:60]) is None and I.decode(b"P5 9 9 255\nxx") is None and I.decode(b"") is None
    flat = np.kron(r.integers(0, 256, (9, 7), np.uint8), np.ones((4, 4), np.uint8))
    assert (I.scaled(flat, 7) == flat[::4, ::4]).all() and I.scaled(flat, 14).shape == (18, 14) and abs(I.scaled(flat, 5).mean() - flat.mean()) < 1


def test_crops(spark):
    g = PAGES[0][0]
    rows = [(I.png(g), 10, 20, 30, 40), (I.pgm(g), -5, -5, 10, 10), (I.pgm(g), 900, 0, 5, 5), (b"?", 0, 0, 5, 5), (None, 0, 0, 5, 5), (I.pgm(g), None, 0, 5, 5)]
    got = [r["crop"] for r in I.crops(spark.createDataFrame(rows, "image binary, x int, y int, w int, h int")).collect()]
    assert (I.decode(bytes(got[0])) == g[20:60, 10:40]).all() and (I.decode(bytes(got[1])) == g[:5, :5]).all() and got[2:] == [None] * 4


def test_profiles_and_gutters(pages):
    steps = S.col_dark(pages)
    rows, edges, found = S.row_dark(pages).collect(), {r["page_key"]: r for r in S.film_edges(steps).collect()}, S.gutters(steps).collect()
    segments = steps.collect()
    for k in range(len(PAGES)):
        ink = inked(k)
        dark = ink[::2].sum(axis=0) / (ink.shape[0] / 2.0)
        wide = np.full(ink.shape[1], np.nan)
        for r in segments:
            if r["page_key"] == k:
                wide[r["x0"] : r["x1"]] = r["dark"]
        assert (wide == dark).all()
        assert {r["y"]: r["dark"] for r in rows if r["page_key"] == k} == {int(y): ink[y].sum() / ink.shape[1] for y in np.flatnonzero(ink.any(axis=1))}
        bright = np.flatnonzero(dark <= S.EDGE_DARK)
        a, b = (bright[0], bright[-1] + 1) if len(bright) else (len(dark), len(dark))
        assert (edges[k]["x0"], edges[k]["x1"]) == (a, b)
        want, x = [], a
        while x < b:
            kind = lambda x: "paper" if dark[x] <= 0.10 else "rule" if dark[x] >= 0.45 else ""
            y = x
            while y < b and kind(y) == kind(x):
                y += 1
            if kind(x) == "rule" or kind(x) == "paper" and y - x >= 2:
                want.append((kind(x), x, y))
            x = y
        assert sorted((r["kind"], r["x0"], r["x1"]) for r in found if r["page_key"] == k) == sorted(want)


def rules_by_pixels(ink, least, skip_dark):
    h, w = ink.shape
    brk, dark, out = max(2, int(h * 0.004)), ink[::2].sum(axis=0) / (h / 2.0), []
    inside = np.flatnonzero(dark <= 0.55)
    for x in range(w):
        if (dark[x] > 0.55) if skip_dark else not (len(inside) and inside[0] <= x <= inside[-1]):
            continue
        best, start, last = (0, 0, 0), None, None
        for y in [*np.flatnonzero(ink[:, x]).tolist(), None]:
            if start is not None and (y is None or y - last - 1 > brk):
                end = last + 1 if y is None and h - 1 - last <= brk else last
                if end - start > best[0]:
                    best = (end - start, start, end)
                start = None
            if y is not None:
                start, last = y if start is None else start, y
        if best[0] and best[0] >= int(h * least):
            out.append((x, best[1], best[2]))
    merged = []
    for c in out:
        if merged and c[0] - merged[-1][-1][0] <= 2:
            merged[-1].append(c)
        else:
            merged.append([c])
    return [(sum(c[0] for c in g) // len(g), min(c[1] for c in g), max(c[2] for c in g)) for g in merged]


@pytest.mark.parametrize("least, skip_dark", [(0.12, True), (0.04, False)])
def test_column_rules(pages, least, skip_dark):
    got = S.vrules(pages, least, skip_dark).collect()
    for k in range(len(PAGES)):
        want = rules_by_pixels(inked(k), least, skip_dark)
        assert sorted((r["x"], r["y0"], r["y1"]) for r in got if r["page_key"] == k) == sorted(want)
    assert len(got) >= 5


def items_of(seed=1, n=25):
    r = random.Random(seed)
    out = []
    for k, (g, _) in enumerate(PAGES):
        h, w = g.shape
        for i in range(n):
            x, y = r.randrange(w), r.randrange(h)
            out.append((k, i, x, y, r.randint(1, 60), r.randint(1, 30)))
    return [*out, (90, 0, 1, 1, 1, 1)]


def walk_rows(ink, item, x0, x1, rules_only, keep):
    h = ink.shape[0]
    _, _, x, y, w, hh = item
    cap = int(h * 0.35)
    top, bottom = max(0, y + hh - cap), min(h, y + cap)
    rows = [int(ink[r, x0:x1].sum()) / max(1, x1 - x0) for r in range(top, bottom)]
    base = sorted(rows)[len(rows) // 10] if rows else 0.0
    clear, rule, gap = [v <= base + 0.02 for v in rows], [v >= 0.45 for v in rows], max(2, int(h * 0.004))

    def go(i, step):
        if keep and 0 <= i < len(rows) and clear[i] and not rule[i]:
            return i
        run = 0
        while 0 <= i < len(rows):
            if rule[i]:
                return i - step
            if not rules_only:
                run = run + 1 if clear[i] else 0
                if run >= gap:
                    return i - step * (gap - 1)
            i += step

    a, b = go(max(0, y - top), -1), go(min(len(rows) - 1, y + hh - top), 1)
    return (None, None) if a is None or b is None else (top + a, top + b + 1)


@pytest.mark.parametrize("rules_only, keep", [(False, False), (True, False), (False, True)])
def test_vertical_bounds(spark, pages, rules_only, keep):
    items = items_of()
    r = random.Random(2)
    spans = [(max(0, i[2] - r.randint(0, 40)), i[2] + r.randint(1, 60)) for i in items]
    frame = spark.createDataFrame([(*i, a, min(b, 300)) for i, (a, b) in zip(items, spans)], "page_key long, item int, x int, y int, w int, h int, x0 int, x1 int")
    got = {(r["page_key"], r["item"]): (r["y0"], r["y1"]) for r in S.vertical_bounds(frame, pages, rules_only, keep).collect()}
    want = {i[:2]: walk_rows(inked(i[0]), i, a, min(b, PAGES[i[0]][0].shape[1]) if b <= PAGES[i[0]][0].shape[1] else min(b, 300), rules_only, keep) for i, (a, b) in zip(items[:-1], spans) if i[0] < 6}
    assert {k: v for k, v in got.items() if k[0] < 6} == want and len({v for v in want.values()}) > 20


def paper_by_pixels(ink, item):
    h, w = ink.shape
    _, _, x, y, ww, hh = item
    y0, y1, pad = max(0, y), min(h, y + hh), int(w * 0.08)
    lx, rx = max(0, x - pad), min(w, x + ww + pad)
    cols = [int(ink[y0:y1, c].sum()) / max(1, y1 - y0) for c in range(lx, rx)]
    n, need = len(cols), max(2, int(w * 0.002))
    if not n:
        return None, None
    base = sorted(cols)[n // 10]

    def out(i, step):
        run = 0
        while 0 <= i < n:
            run = run + 1 if cols[i] <= base + 0.02 else 0
            if run >= need:
                return i - step * (need - 1)
            i += step

    a, b, more = out(x - lx, -1), out(x + ww - 1 - lx, 1), max(2, int(w * 0.004))
    return (None, None) if a is None or b is None else (max(0, lx + a - more), min(w, lx + b + 1 + more))


def columns_by_pixels(ink, item):
    h, w = ink.shape
    _, _, x, y, ww, hh = item
    y0, y1, span = max(0, y), min(h, y + hh), int(h * 0.06)
    if y1 - y0 < span:
        mid = (y0 + y1) // 2
        y0, y1 = max(0, mid - span // 2), min(h, mid + span // 2)
    cols, dark = ink[y0:y1].sum(axis=0) / max(1, y1 - y0), ink[::2].sum(axis=0) / (h / 2.0)
    inside = np.flatnonzero(dark <= 0.55)
    left, right = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (w, w)
    kinds, at, sides = ["paper" if d <= 0.10 else "rule" if d >= 0.45 else "" for d in dark], left, []
    while at < right:
        end = at
        while end < right and kinds[end] == kinds[at]:
            end += 1
        if kinds[at] == "rule" or kinds[at] == "paper" and end - at >= 2:
            near = [*cols[max(0, at - 2) : at], *cols[end : end + 2]] if kinds[at] == "rule" else [*cols[at:end]]
            if not (near and min(near) > 0.08):
                sides.append((at, end))
        at = end
    a, b = [e for _, e in sides if e <= x], [s for s, _ in sides if s >= x + ww]
    if not a and not b:
        return None, None
    x0, x1 = max(a, default=left), min(b, default=right)
    return (x0, x1) if x1 > x0 else (None, None)


@pytest.mark.parametrize("mode", ["paper", "column"])
def test_sides_and_cells(spark, pages, mode):
    items = items_of(5)
    frame = spark.createDataFrame(items, "page_key long, item int, x int, y int, w int, h int")
    got = {(r["page_key"], r["item"]): (r["x0"], r["x1"]) for r in (S.paper_bounds if mode == "paper" else S.column_bounds)(frame, pages).collect() if r["page_key"] < 90}
    want = {i[:2]: (paper_by_pixels if mode == "paper" else columns_by_pixels)(inked(i[0]), i) for i in items[:-1]}
    assert got == want and len(set(want.values())) > 8
    cells = {(r["page_key"], r["item"]): tuple(r)[2:] for r in S.snap(frame, pages, mode, border=True).collect()}
    for i in items[:-1]:
        h, w = inked(i[0]).shape
        a, b = want[i[:2]]
        box = (None,) * 4
        if a is not None and b - a >= w * 0.05:
            c, d = walk_rows(inked(i[0]), i, a, b, False, mode == "paper")
            if c is not None and 0 < d - c <= h * 0.35:
                m = max(3, int(w * 0.006))
                box = (max(0, a - m), max(0, c - m), min(w, b + m), min(h, d + m))
        assert cells[i[:2]] == box
    assert cells[90, 0] == (None,) * 4 and sum(v[0] is not None for v in cells.values()) > 3


def rule_by_pixels(ink, words, a, b, text_h):
    h, w = ink.shape
    brk, reach, thick = max(2, int(w * 0.0045)), max(4, int(w * 0.02)), max(2, int(1.4 * text_h))
    share = ink[:, a:b].sum(axis=1) / max(1, b - a)
    out = []
    for y in np.flatnonzero(share >= 0.20):
        top = bottom = int(y)
        while top > 0 and share[top - 1] >= 0.20:
            top -= 1
        while bottom < h - 1 and share[bottom + 1] >= 0.20:
            bottom += 1
        best = now = gap = 0
        for x in range(a, b):
            if ink[y, x]:
                now, gap = now + gap + 1, 0
                best = max(best, now)
            else:
                gap += 1
                if gap > brk:
                    now = gap = 0
        read = any(sum(c.isalpha() for c in t) >= 3 and a <= x + ww / 2 < b and top <= yy + hh / 2 <= bottom for x, yy, ww, hh, t in words)
        if bottom - top + 1 <= thick and not read and best / max(1, b - a) >= 0.38 and ink[top : bottom + 1, a : a + reach].sum(axis=1).max() >= 3 and ink[top : bottom + 1, b - reach : b].sum(axis=1).max() >= 3:
            out.append(int(y))
    return out


def test_rule_rows(spark, pages):
    r, windows = random.Random(7), []
    for k in range(6):
        windows += [(k, c, 9 + 70 * c, 9 + 70 * c + r.choice([60, 65, 135]), 7.0) for c in range(3)] + [(k, 9, 0, 300, 7.0)]
    words = [(k, *x) for k, (_, ws) in enumerate(PAGES) for x in ws if r.random() < 0.7]
    got = S.rule_rows(spark.createDataFrame(windows, "page_key long, item int, x0 int, x1 int, text_h double"), pages, spark.createDataFrame(words, "page_key long, x int, y int, w int, h int, t string")).collect()
    for k, i, a, b, th in windows:
        assert sorted(x["y"] for x in got if (x["page_key"], x["item"]) == (k, i)) == rule_by_pixels(inked(k), [x[1:] for x in words if x[0] == k], a, b, th), (k, i)
    assert len(got) > 20


# Rows' darkness where tight lines have no rule between them, and where one is (fixed values).
NO_RULE = {554: 0.134, 555: 0.006, 559: 0.128, 560: 0.430, 561: 0.475, 562: 0.413, 563: 0.307, 566: 0.050, 567: 0.318, 568: 0.458, 569: 0.380, 570: 0.341, 571: 0.028, 573: 0.078, 574: 0.330, 575: 0.464, 576: 0.358}
A_RULE = {678: 0.017, 679: 0.078, 680: 0.151, 681: 0.134, 682: 0.106, 683: 0.117, 684: 0.006, 689: 0.430, 690: 0.011, 692: 0.006, 693: 0.335, 694: 0.436, 695: 0.285, 696: 0.279, 697: 0.324}


def test_rule_between(spark):
    pages = []
    for k, dark in enumerate([NO_RULE, A_RULE, {}, {100: 0.9}]):
        pages.append((k, 1000, 800, 1, [(y, 0, int(1000 * d)) for y, d in sorted(dark.items()) if d]))
    frame = spark.createDataFrame(pages, I._PAGE_DDL)
    spans = spark.createDataFrame([(0, 0, 0, 1000, 558, 571), (1, 0, 0, 1000, 684, 692), (2, 0, 0, 1000, 100, 120), (3, 0, 0, 1000, 96, 104), (3, 1, 0, 1000, 300, 310)], "page_key long, item int, x0 int, x1 int, ya int, yb int")
    got = {(r["page_key"], r["item"]): r["rule"] for r in S.rule_between(spans, frame).collect()}
    assert got == {(0, 0): False, (1, 0): True, (2, 0): False, (3, 0): True, (3, 1): False}


def test_no_batch_holds_many_pages():
    ink = np.full((704, 330), 210, np.uint8)
    ink[::2, ::4] = 40
    many = ((k, I.pgm(ink) if k % 50 else None) for k in range(200))
    found = list(I.inked(many, None))
    assert max(len(b.column(4).flatten()) for b in found) <= I.BATCH + 704 * 330 // 8 + 704
    assert [k for b in found for k in b.column(0).to_pylist()] == list(range(200))
    assert [v is None for b in found for v in b.column(4).to_pylist()] == [k % 50 == 0 for k in range(200)]


def test_images_are_made_one_at_a_time():
    """Ten thousand rows in a batch, whose images would be over 2 GB: none is made before the strokes of those before have gone."""
    ahead = []

    def draw(batches):
        for k in range(10_000):
            ahead.append(k)
            yield k, I.pgm(np.full((704, 330), 210 if k % 4 else 40, np.uint8))

    pages = I.inked(draw(None), None)
    next(pages)
    assert len(ahead) <= I.BATCH // 100


def test_written_pages_lie_in_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from folio.sources.bridge import GROUP, written

    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(0, 1 << 30, (4000, 3)).tolist()) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_key long, s array<array<int>>").coalesce(1)
    found = written(pages)
    assert found.count() == 300
    (file,) = glob.glob(found.inputFiles()[0].removeprefix("file://"))
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1 and max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 3 * GROUP
