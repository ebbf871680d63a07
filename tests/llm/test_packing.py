"""The search of best-fit packing: what it must do that best fit alone does not."""

import random

import numpy as np
import pytest

from folio.llm import packing as p


def lengths_of(seed, n=400, capacity=1000):
    r = random.Random(seed)
    return [min(capacity, 1 + int(r.lognormvariate(5.3, 0.9))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_search_empties_bins_that_best_fit_leaves(seed):
    sizes = lengths_of(seed)
    start = p.best_fit(sizes, 1000)
    search = p.Search(start, sizes, 1000)
    squares = [sum(f * f for f in search.fill)]
    applied = search._apply

    def watched(*args):
        donor = applied(*args)
        squares.append(sum(f * f for f in search.fill))
        return donor

    search._apply = watched
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 1000
    assert len(bins) <= search.least + 1 and (len(bins) < len(start) or len(start) == search.least + 1)
    assert all(a < b for a, b in zip(squares, squares[1:])) and search.moves and search.exchanges


def test_each_kind_of_step():
    one = p.Search([[0, 1], [2]], [60, 30, 40], 100)
    assert one._fill([1]) and one.exchanges == 1 and sorted(one.fill) == [30, 100]
    two = p.Search([[0, 1, 2], [3]], [50, 20, 25, 50], 100)
    assert two._fill([1]) and two.pairs == 1 and sorted(two.fill) == [45, 100]
    move = p.Search([[0], [1, 2]], [70, 30, 5], 100)
    assert move._fill([1]) and move.moves == 1 and sorted(move.fill) == [5, 100]


def test_small_cases_against_all_packings():
    def fewest(sizes, capacity, bins=()):
        if not sizes:
            return len(bins)
        found = [fewest(sizes[1:], capacity, (*bins, sizes[0]))]
        for k, f in enumerate(bins):
            if f + sizes[0] <= capacity and f not in bins[:k]:
                found.append(fewest(sizes[1:], capacity, (*bins[:k], f + sizes[0], *bins[k + 1 :])))
        return min(found)

    r, more = random.Random(1), 0
    for _ in range(60):
        sizes = [r.randint(1, 60) for _ in range(8)]
        more += len(p.packed(sizes, 100)) - fewest(sizes, 100)
    assert more <= 6


def test_edges(spark):
    ddl = p._PIECE_DDL + ", _group string, sequence_id string, offset string"
    assert p.pack(spark.createDataFrame([], ddl), 100).count() == 0
    rows = [(None if k % 2 else 1, 0, 0, 10, 7, "g", "s", "o") for k in range(300)]
    got = p.pack(spark.createDataFrame(rows, ddl), 100, 50).collect()
    fill = {}
    for x in got:
        assert x["_group"] == "g"
        fill.setdefault(x["sequence_id"], []).append(x["offset"])
    assert len(got) == 300 and all(sorted(v) == list(range(0, 10 * len(v), 10)) for v in fill.values()) and len(fill) <= 33
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_is_what_the_query_gives(spark):
    got = p.op3_best_fit_packing(spark, "/root/testdata/sf0.001").toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= p.CAPACITY and len(fill) <= -(-int(fill.sum()) // p.CAPACITY) + 1
    assert np.array_equal(got.groupby("sequence_id")["offset"].min().unique(), [0])
