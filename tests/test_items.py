"""Items of display type: named cases of the deck walk, walls of ink, lanes on a drawn page, and the query against its SQL."""

import duckdb
import numpy as np
import pytest

from folio.operators import items
from folio.plans import sheets, slate
from folio.sources import images

SF = "/root/testdata/sf0.001"
BODY = [(20 + (i * 31) % 600, 400 + (i // 20) * 14, 25, 10, "the") for i in range(200)]
HEAD = [(20, 100, 60, 30, "FIRE"), (85, 100, 70, 30, "DOWNTOWN"), (160, 100, 90, 30, "TONIGHT")]
DECKED = [(20, 140, 210, 28, "TONIGHT"), (20, 180, 120, 17, "Blaze"), (150, 180, 60, 17, "spreads")]
CASES = {
    "deck": [*DECKED, (20, 210, 25, 10, "the"), (50, 210, 25, 10, "body")],
    "neighbour": [(200, 140, 130, 28, "OTHER")],
    "taller": [(20, 140, 100, 42, "AMERICUS"), (130, 140, 120, 42, "TIMES")],
    "tallest": [(20, 140, 60, 24, "MILLS"), (85, 140, 70, 24, "CLOSE"), (160, 140, 90, 28, "TODAY")],
    "tier": [(20, 140, 60, 18, "CAPITAL"), (85, 140, 60, 18, "WOULD"), (200, 140, 60, 18, "MEXICO"), (265, 140, 60, 18, "SENDS")],
    "wider": [(30, 140, 130, 30, "SENDS"), (170, 140, 100, 30, "APPEAL"), (290, 140, 80, 30, "NORTH"), (420, 140, 80, 30, "APART")],
    "grew": [(20, 140, 100, 17, "Between"), (20, 160, 100, 20, "French")],
    "carries": [(20, 140, 100, 17, "Wash"), (20, 160, 100, 20, "ington")],
    "far": [(20, 220, 100, 18, "Later")],
    "last": [],
    "many": [(20, 140 + 18 * k, 200, 16 if k else 17, "line") for k in range(12)] + [(20, 890, 25, 10, "foot")],
}


@pytest.fixture(scope="module")
def got(spark):
    rows, seeds = [], []
    for key, more in enumerate(CASES.values()):
        body = BODY if list(CASES)[key] != "last" else [w for w in BODY if w[1] < 100]
        if list(CASES)[key] == "last":
            body = [(300 + i, 10, 20, 10, "the") for i in range(90)]
        page = HEAD + more + body
        rows += [(key, n, *w) for n, w in enumerate(page)]
        seeds += [(key, 7, n) for n in range(len(HEAD))]
    words = spark.createDataFrame(rows, "page_key long, wid long, x long, y long, w long, h long, t string")
    found = items.deck_items(words, spark.createDataFrame(seeds, "page_key long, segment long, wid long"))
    return {list(CASES)[r["page_key"]]: r for r in found.collect()}


def test_same_size_lines_and_decks_join_and_body_does_not(got):
    r = got["deck"]
    assert (r["x"], r["y"], r["w"], r["h"], r["lines"]) == (20, 100, 230, 97, 3)
    assert (r["stop"], r["said"]) == ("boundary", "the body")


def test_a_line_that_fills_little_of_the_span_is_another_columns(got):
    assert (got["neighbour"]["stop"], got["neighbour"]["h"]) == ("boundary", 30)


def test_a_taller_line_is_another_item(got):
    assert (got["taller"]["stop"], got["taller"]["said"], got["taller"]["h"]) == ("other item", "AMERICUS TIMES", 30)


def test_a_line_is_judged_by_its_tallest_word(got):
    assert got["tallest"]["lines"] == 2 and got["tallest"]["h"] == 68


def test_a_tier_ends_the_item(got):
    assert (got["tier"]["stop"], got["tier"]["lines"]) == ("tier", 1)


def test_a_wider_line_is_taken_whole_up_to_a_gap(got):
    assert got["wider"]["lines"] == 2 and got["wider"]["x"] + got["wider"]["w"] == 370


def test_a_deck_does_not_grow_but_a_lower_case_line_goes_on(got):
    assert (got["grew"]["stop"], got["grew"]["said"]) == ("deck grew", "French")
    assert got["carries"]["lines"] == 3


def test_reach_and_the_end_of_a_page(got):
    assert got["far"]["stop"] == "gap" and got["far"]["ratio"] == pytest.approx((90 - 45) / 45) and got["far"]["said"] == "Later"
    assert got["last"]["stop"] == "end" and got["last"]["ratio"] is None and got["last"]["said"] is None


def test_depth_is_bounded(got):
    # Decks end at 140 + 18 k + 16: the eighth is the first past six heights of the headline below its top.
    assert (got["many"]["stop"], got["many"]["lines"], got["many"]["h"]) == ("deep", 9, 140 + 18 * 7 + 16 - 100)


def test_too_deep_for_the_page_has_no_box(spark):
    page = [(1, n, *w) for n, w in enumerate([*HEAD, *DECKED, *[(20, 250, 25, 10, "the")] * 20])]
    words = spark.createDataFrame(page, "page_key long, wid long, x long, y long, w long, h long, t string")
    (r,) = items.deck_items(words, words.where("wid < 3").selectExpr("page_key", "1 as segment", "wid")).collect()
    assert r["lines"] == 3 and (r["x"], r["h"]) == (None, None)


def drawn(words, walls=(), size=(900, 700)):
    g = np.full(size, 210, np.uint8)
    for x, y, w, h, _ in words:
        for a in range(x, x + w, 6):  # letters, so that no word is a printed rule
            g[y : y + h - 2, a : a + 4] = 40
    for x, a, b in walls:
        g[a:b, x : x + 2] = 20
    return images.png(g)


def test_a_line_does_not_grow_across_a_printed_rule(spark):
    more = [(20, 140, 210, 30, "MILLS"), (262, 140, 90, 30, "NORTH")]
    pages = images.ink_pages(spark.createDataFrame([(1, drawn(HEAD + more + BODY)), (2, drawn(HEAD + more + BODY, [(245, 138, 172)]))], "page_key long, image binary"), None)
    rows = [(key, n, *w) for key in (1, 2, 3) for n, w in enumerate(HEAD + more + BODY)]
    words = spark.createDataFrame(rows, "page_key long, wid long, x long, y long, w long, h long, t string")
    found = items.deck_items(words, words.where("wid < 3").selectExpr("page_key", "1 as segment", "wid"), pages.where("w is not null")).collect()
    ends = {r["page_key"]: (r["x"] + r["w"], r["lines"]) for r in found}
    assert ends == {1: (352, 2), 2: (250, 2), 3: (352, 2)}  # page 3 has no image: gaps alone


def test_lanes_on_a_drawn_page(spark):
    low = [(30, 600, 100, 30, "SALE"), (140, 600, 110, 30, "TODAY")]
    name = [(20, 20, 300, 40, "CHRONICLE")]
    page = name + HEAD + DECKED + BODY + low
    pages = images.ink_pages(spark.createDataFrame([(1, drawn(page))], "page_key long, image binary"), None)
    words = spark.createDataFrame([(1, n, *w) for n, w in enumerate(page)], "page_key long, wid long, x long, y long, w long, h long, t string")
    floors = spark.createDataFrame([(1, 65)], "page_key long, floor long")
    found = items.lane_items(words, pages, "headline", floors).collect()
    texts = [r["text"] for r in found]
    assert "FIRE DOWNTOWN TONIGHT" in texts and not any("CHRONICLE" in t or "SALE" in t for t in texts)
    for r in found:
        assert r["y0"] >= r["top"] and r["y1"] > r["y0"]
    assert not any("FIRE" in r["text"] for r in items.lane_items(words, pages, "ad").collect())


def test_empty_tables_null_pages_and_unknown_words(spark):
    schema = "page_key long, wid long, x long, y long, w long, h long, t string, stop string"
    none = spark.createDataFrame([], schema)
    assert items.deck_items(none, none.selectExpr("page_key", "1 as segment", "wid")).count() == 0
    words = spark.createDataFrame([(None, 0, 1, 1, 5, 5, "a", ""), (1, 0, 1, 1, 5, 5, None, ""), (1, 0, 1, 1, 5, 5, None, "")], schema)
    seeds = spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, 2, 99)], "page_key long, segment long, wid long")
    (r,) = items.deck_items(words, seeds).collect()
    assert (r["page_key"], r["segment"], r["stop"]) == (1, 1, "end")


def test_deck_items_equal_their_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["page_key", "segment", "x", "y", "w", "h", "lines", "stop", "ratio", "said"]
    want = sorted(c.execute(f"select {', '.join(names)} from ({slate.ORACLES['deck_items']})").fetchall(), key=str)
    found = sorted((tuple(r) for r in sheets.deck_items(spark, SF).select(*names).collect()), key=str)
    assert found == want and {"boundary", "tier", "other item", "deck grew", "end"} <= {r[7] for r in found}
