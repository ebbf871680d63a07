"""Cells as bits of a page's row, and lines and columns as arrays: the same results as rows that were sorted, without the sort."""

import random

import numpy as np
import pytest

import __spark_entry__
from folio.operators import desk, pages, raster, walks

SF = "/root/testdata/sf0.001"
CELL = "page_key long, r long, c long, ink long"


@pytest.mark.parametrize("name", ["row_spans", "row_crossings", "column_bounds", "line_continues", "ad_blocks", "market_blocks", "closure_audit"])
def test_no_word_or_cell_is_sorted(spark, name):
    """Windows, joins and sorted aggregates over all words or cells spilled, the more the larger the input."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort ", "SortAggregate", "SortMergeJoin")), plan


def _cells(seed):
    """Pages of cells with gaps, far apart, left of the first column, and a full one."""
    rng = random.Random(seed)
    out = [(k, r * (1 + k % 3), c * (1 + 40 * (k % 2)) - 70, int(rng.random() < (0.9 if c % 5 == 0 else 0.3))) for k in range(8) for r in range(9) for c in range(12) if rng.random() < (1 if k == 7 else 0.8)]
    rng.shuffle(out)
    return out


def test_longest_strokes(spark):
    cells, want = _cells(1), {}
    for k, r in {v[:2] for v in cells}:
        best, first, last = 0, None, None
        for c in sorted(v[2] for v in cells if v[:2] == (k, r) and v[3]):
            first = c if last is None or c - last - 1 > 1 else first
            last, best = c, max(best, c - first + 1)
        if best:
            want[k, r] = best
    found = raster.row_span(spark.createDataFrame(cells, CELL)).collect()
    assert {(v.page_key, v.r): v.span for v in found} == want and len(found) == len(want)


def test_crossings_where_cells_are_missing(spark):
    cells, want = _cells(2), {}
    for k in {v[0] for v in cells}:
        columns = {}
        for _, r, c, ink in sorted(v for v in cells if v[0] == k):
            columns.setdefault(c, []).append((r, ink))
        kept = {c: np.mean([i for _, i in v]) < 0.55 for c, v in columns.items()}
        few = np.mean([kept[c] for c, v in columns.items() for _ in v]) < 0.5
        rows = {}
        for c, v in columns.items():
            for n, (r, ink) in enumerate(v):
                if kept[c] or few:
                    rows.setdefault(r, []).append(ink * v[min(n + 2, len(v) - 1)][1])
        want |= {(k, r): np.mean(v) for r, v in rows.items()}
    found = {(v.page_key, v.r): v.share for v in raster.row_crossing(spark.createDataFrame(cells, CELL), 2).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_bounds_of_pages_without_cells_and_of_odd_items(spark):
    dark = lambda r, c: int(c in (10, 30) or r in (2, 3) and c == 20 or c % 20 in (4, 5) and r % 2)
    cells = spark.createDataFrame([(k, r, c, dark(r, c)) for k in (1, None) for r in range(20) for c in range(40)], CELL)
    items = [(1, 0, 12, 10, 3, 4), (1, 1, 12, 2, 3, 4), (1, 2, None, 2, 3, 4), (1, 3, 12, None, 3, 4), (2, 0, 12, 10, 3, 4), (None, 0, 12, 10, 3, 4)]
    found = walks.column_bounds(spark.createDataFrame(items, "page_key long, item int, x long, y long, w long, h long"), cells, 20)
    got = {(v.page_key, v.item): (v.x0, v.x1) for v in found.collect()}
    assert dict(found.dtypes)["item"] == "int" and len(got) == len(items)
    assert got[1, 0] == (11, 16) or got[1, 0][0] in (11, 12)
    assert got[2, 0] == got[None, 0] == (None, None)


def _walk(rows, seed, page_h, display, most):
    """Step by step: up from the seed, then down, with the reason and gap that stopped each."""
    rows = {v[0]: v for v in rows}

    def why(gap, rule, tall, away, grace, beyond, name):
        shown = tall >= 16
        for test, said in ((gap > 22 and not (shown and display), "gap"), (rule, "rule"), (not display and shown, "display-boundary"), (not display and gap > 13 and grace, "paragraph-gap"), (not display and away > 80, "row-count-cap"), (beyond, name)):
            if test:
                return said

    lo, hi, up, down = seed, seed, None, None
    while lo - 1 in rows:
        v = rows[lo - 1]
        up = why(rows[lo][1] - v[2], rows[lo][5], v[3], seed - v[0], True, rows[seed][2] - v[1] > most * page_h, "refused")
        if up:
            break
        lo -= 1
    while hi + 1 in rows:
        v = rows[hi + 1]
        down = why(v[1] - rows[hi][2], v[5], v[3], v[0] - seed, v[0] - seed > 3, v[2] - rows[lo][1] > most * page_h, "cap")
        if down:
            break
        hi += 1
    return rows[lo][1], rows[hi][2], hi - lo + 1, up, down


@pytest.mark.parametrize("display", [True, False])
def test_blocks_are_those_of_a_walk(spark, display):
    rng, rows, want = random.Random(5), [], {}
    for k in range(60):
        top, col = 0, []
        for n in range(rng.randint(1, 30)):
            top += rng.choice([2, 2, 2, 2, 5, 14, 23])
            tall = rng.choice([10, 10, 10, 10, 10, 17])
            col.append((n, top, top + tall, tall, 10.0, rng.random() < 0.05))
            top += tall
        seed = rng.randrange(len(col))
        want[k] = _walk(col, seed, 900, display, 0.2)
        rows += [(k, k % 3, *v[:5], 900, seed, v[5] or None) for v in col]
    rng.shuffle(rows)
    found = pages.block_around(spark.createDataFrame(rows, "page_key long, col long, row long, top long, bottom long, tall long, med double, page_h long, seed long, rule_above boolean"), display, 0.2)
    assert {v.page_key: (v.top, v.bottom, v.rows, v.top_reason, v.bottom_reason) for v in found.collect()} == want


def test_leftmost_word_of_a_line(spark):
    words = spark.createDataFrame([(1, 0, 9, 0, "Up"), (1, 0, 3, 2, "Éa"), (1, 0, 3, 1, "éa"), (1, 1, 0, 3, "9"), (2, 0, 0, 0, None)], "page_key long, line long, x long, wid long, t string")
    assert {(v.page_key, v.line): v.continues for v in desk.continues(words, ["page_key", "line"]).collect()} == {(1, 0): True, (1, 1): False, (2, 0): None}
