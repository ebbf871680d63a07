"""Words counted by band, and measured against their page, where they lie."""

import re
from collections import Counter

import pytest

import __spark_entry__
from folio.operators import layout


def test_density_by_hand(spark):
    rows = [(k, w, (w * 37 + k) % 300, 5) for k in range(12) for w in range(1, 40 * k)] + [(None, 1, 3, 4), (50, 1, 10, 0)]
    got = layout.density(spark.createDataFrame(rows, "page_key long, wid long, y long, h long")).collect()
    pages = {k for k, *_ in rows}
    assert len(got) == 40 * len(pages)
    for k in pages:
        mine = [(y, h) for p, _, y, h in rows if p == k]
        high = max(y + h for y, h in mine)
        counts = Counter(y * 40 // high for y, _ in mine) if k is not None else {}
        assert {r["band"]: (r["n"], r["page_h"], r["words"]) for r in got if r["page_key"] == k} == {b: (counts.get(b, 0), high, len(mine)) for b in range(40)}


@pytest.mark.parametrize("name", ["word_density", "body_starts", "largest_items"])
def test_words_are_not_sorted_by_page(spark, name):
    """A task sorted all its words to meet their page's height, and moved bands by page and band."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "hashpartitioning(page_key#" in plan
    steps = plan.splitlines()
    assert not any("Exchange hashpartitioning" in v and "band" in v for v in steps)
    assert not any(re.search(r"Sort \[page_key#\w+ ASC NULLS FIRST\],", v) and "Generate" in "".join(steps[i + 1 : i + 4]) for i, v in enumerate(steps))


def test_boxes_meet_words_without_sorting_them(spark):
    """uncut_boxes sorted every word of a task to meet its page's boxes, and read words as rows of Python."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()["uncut_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan


def test_deck_reads_words_as_columns():
    import pyarrow as pa

    from folio.operators.items import _Page

    words = [{"y": 0, "x": 0, "wid": 5, "w": 30, "h": 20, "t": "Head", "real": True}, {"y": 22, "x": 0, "wid": 5, "w": 30, "h": 19, "t": None, "real": False}]
    page = _Page(pa.array([[], words])[1], None, [])
    assert page.places() == {5: 0} and page.text(page.between(-1, 30)) == "Head " and _Page(pa.array([words, []])[1], None, []).places() == {}
