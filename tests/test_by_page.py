"""Pages in buckets, and what is found in a page's row instead of tables of its columns."""

import numpy as np
import pytest

import __spark_entry__
from folio.operators import strokes as S
from folio.plans import scans as plans
from folio.sources import images as I

SF = "/root/testdata/sf0.001"


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pages_are_not_moved_again(spark):
    pages = plans._pages(spark, SF)
    assert "Exchange" not in _plan(pages.groupBy("page_key").count())
    plan = _plan(pages.hint("merge").join(plans._seeds(spark, SF).groupBy("page_key").count(), "page_key"))
    above = plan[: plan.index("spark_catalog.default.folio")]
    assert "SortMergeJoin" in above and "Exchange" not in above, plan


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_gutters_of_a_page_are_those_of_the_table(spark, share):
    rng = np.random.default_rng(7)
    frames = [(k, bytes(I.pgm(np.where(rng.random((60, 90)) < np.where(np.arange(90) % 17 < 3 + k, share, rng.choice([0.0, 0.05, 0.9])), 30, 210).astype(np.uint8)))) for k in range(6)]
    pages = I.ink_pages(spark.createDataFrame(frames, "page_key long, image binary"), None).localCheckpoint()
    steps = S.col_dark(pages)
    film = {r["page_key"]: (r["x0"], r["x1"]) for r in S.film_edges(steps).collect()}
    found = {k: [] for k in range(6)}
    for r in S.gutters(steps).collect():
        found[r["page_key"]].append((r["x0"], r["x1"], r["kind"] == "rule"))
    for r in pages.collect():
        e0, e1, sides = S.page_gutters(np.array([tuple(s) for s in r["strokes"]], np.int32).reshape(-1, 3), r["w"], r["h"])
        assert (e0, e1) == film[r["page_key"]] and sides == sorted(found[r["page_key"]])


@pytest.mark.parametrize("name, folds", [("scan_cells", 2), ("scan_paper_sides", 1)])
def test_columns_are_no_rows(spark, name, folds):
    """Each page's steps of columns were rows that windows sorted, and a cell's sides were found twice."""
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    assert "Window" not in plan and plan.count("MapInArrow") == folds


@pytest.mark.parametrize("name", ["nameplate_boxes", "display_pieces"])
def test_words_are_not_joined_by_word(spark, name):
    """A fold's rows met the words again by page and number, both moved for it, and windows sorted all words of a page."""
    plan = _plan(__spark_entry__.queries()[name](spark, SF))
    assert "MapInArrow" in plan and "SortMergeJoin [page_key" not in plan.split("MapInArrow", 1)[1] and "wid#" not in "".join(line for line in plan.splitlines() if "Join" in line or "Exchange" in line)


def test_pages_go_to_more_tasks_than_documents(spark):
    """A task that held all the words of a shuffle partition's pages took more memory than an executor has."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plans.scan_words(spark, SF).rdd.getNumPartitions() > n and f"SelectedBucketsCount: {4 * n} out of {4 * n}" in _plan(plans._pages(spark, SF).groupBy("page_key").count())
