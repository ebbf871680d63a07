"""Page folds that take many pages a task, and plans that move documents before their words and cells are made."""

import random
from collections import deque

import pytest

import __spark_entry__
from folio.operators import raster

SF = "/root/testdata/sf0.001"


def _flood(cells):
    left, found = set(cells), {}
    for cell in sorted(left):
        if cell in found:
            continue
        found[cell], todo = cell, deque([cell])
        while todo:
            r, c = todo.popleft()
            for near in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if near in left and near not in found:
                    found[near] = cell
                    todo.append(near)
    return {k: r * 10000 + c for k, (r, c) in found.items()}


def test_components_of_many_pages_at_once(spark):
    rng = random.Random(4)
    grids = {k: [(r, c) for r in range(25) for c in range(25) if rng.random() < 0.55] for k in range(60)}
    comb = [(0, c) for c in range(0, 40, 2)] + [(r, c) for r in range(1, 30) for c in range(0, 40, 2)] + [(30, c) for c in range(40)]
    grids |= {100: comb, 101: [(5, 5)], None: [(0, 0), (0, 1), (9, 9)]}
    rows = [(k, r, c, 1) for k, cells in grids.items() for r, c in cells] + [(101, 5, 5, 1), (101, 5, 6, 0)]
    rng.shuffle(rows)
    found = raster.components(spark.createDataFrame(rows, "page_key long, r long, c long, ink long")).collect()
    assert len(found) == sum(map(len, grids.values()))
    for k, cells in grids.items():
        assert {(v.r, v.c): v.component for v in found if v.page_key == k} == _flood(cells)


def test_folds_call_python_by_many_pages(spark):
    """A call for each page, or each component, took longer than its work."""
    for name in ("deck_boxes", "cell_components", "picture_candidates"):
        plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "GroupsIn" not in plan and "CoGroups" not in plan


@pytest.mark.parametrize("name, most", [("row_spans", 1), ("row_crossings", 1), ("reading_text", 3)])
def test_documents_move_before_their_words_and_cells_are_made(spark, name, most):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert steps and len(steps) <= most
    if most == 1:
        below = plan.splitlines()
        at = next(i for i, line in enumerate(below) if "Exchange hashpartitioning" in line)
        assert not any("Generate" in line for line in below[at:])
