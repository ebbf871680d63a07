"""Strokes as bytes: the same ink in a small part of the room, and operators whose strokes never leave a page's row."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from folio.operators import strokes as S
from folio.plans import scans as plans
from folio.sources import bridge
from folio.sources import images as I

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shape", [(1, 1), (40, 30), (700, 330)])
def test_packed_strokes_are_the_same(shape):
    rng = np.random.default_rng(3)
    for share in (0, 0.3, 1):
        found = I.strokes(rng.random(shape) < share)
        assert np.array_equal(I.stroke_rows(pa.scalar(I.packed(found), pa.binary())), found)


def test_operators_take_packed_strokes(spark):
    images = [(k, bytes(I.pgm(np.where(np.random.default_rng(k).random((200, 90)) < np.where(np.arange(90) % 30 < 4, 0, 0.2), 30, 210).astype(np.uint8)))) for k in range(4)] + [(9, b"")]
    frame = spark.createDataFrame(images, "page_key long, image binary")
    r = random.Random(2)
    items = spark.createDataFrame([(k, i, r.randrange(60), r.randrange(180), 9, 8, 10, 40) for k in (0, 1, 2, 3, 9) for i in range(5)], "page_key long, item long, x int, y int, w int, h int, x0 int, x1 int")
    plain, packed = I.ink_pages(frame, None), I.ink_pages(frame, None, pack=True)
    assert dict(packed.dtypes)["strokes"] == "binary" and packed.where("strokes is null").count() == 1
    for found in (S.col_dark, lambda p: S.gutters(S.col_dark(p)), lambda p: S.vertical_bounds(items, p), lambda p: S.column_bounds(items, p), lambda p: S.paper_bounds(items, p)):
        rows = sorted(map(str, found(plain).collect()))
        assert rows and rows == sorted(map(str, found(packed).collect()))


def test_written_scans_are_small(spark):
    pages = plans._pages(spark, SF)
    room = sum(os.path.getsize(f.removeprefix("file://")) for f in pages.inputFiles())
    n = pages.count()
    assert n == bridge.scans(spark, SF).count() and room < 5000 * n


@pytest.mark.parametrize("name", ["scan_spans", "scan_rule_rows"])
def test_strokes_stay_in_their_page(spark, name):
    """Each stroke within each window was a row that was shuffled, sorted and grouped."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and not re.search(r"keys=\[page_key#\w+, item#\w+, y#", plan)
