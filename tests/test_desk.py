"""Notices, profiles and the desk's operators on named and hand-made cases."""

import pytest
from pyspark.sql import functions as F

from folio.functions import notices
from folio.operators import desk, layout, profiles, raster


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("row, opens, loose", [
    ("FOR SALE—Nice fat fryers", True, True), ("ROOM—Large cool room", True, True), ("i ROOM—Large cool room", True, True), ("WASHINGTON—The Senate", False, True),
    ("FOR RENT Three unfurnished rooms", True, True), ("For rent three rooms", False, False), ("Strayed or stolen — $5 reward", True, True), ("FOR SAJ E—Nice fat fryers", False, True), (None, False, False), ("", False, False),
])
def test_notice_rows(spark, row, opens, loose):
    t = F.lit(row).cast("string")
    assert (one(spark, notices.opens_notice(t)), one(spark, notices.opens_notice(t, True))) == (opens, loose)


@pytest.mark.parametrize("words, heading, shown", [
    ("TO rentT", True, "TO RENT"), ("Horse Stolen", True, "HORSE STOLEN"), ("Lost", True, "LOST"), ("Wanted to Rent", True, "WANTED TO RENT"), ("Lost at sea", False, "LOST AT SEA"), ("houseboat", False, "HOUSE"),
    ("to let or rent now", False, "TO LET OR RENT NOW"), ("—", False, ""),
])
def test_notice_headings(spark, words, heading, shown):
    row = F.split(F.lit(words), " ")
    assert (one(spark, notices.notice_heading(row)), one(spark, notices.heading_text(row))) == (heading, shown)


@pytest.mark.parametrize("dark, found", [
    ([0.1, 0.1, 0.475, 0.1, 0.1], [(2, 3)]), ([0.1, 0.1, 0.43, 0.43, 0.1, 0.1], [(2, 4)]), ([0.1, 0.2, 0.475, 0.1, 0.1], []), ([0.43, 0.43, 0.43, 0.1, 0.1], []), ([0.475, 0.1, None, 0.475], [(0, 1), (3, 4)]),
])
def test_isolated_rules(spark, dark, found):
    rows = spark.createDataFrame([(1, r, d) for r, d in enumerate(dark)], "page_key long, r long, dark double")
    assert sorted((x["y0"], x["y1"]) for x in profiles.isolated_rules(rows).collect()) == found


def test_ink_threshold_and_shares(spark):
    greys = [200] * 60 + [40] * 40
    assert one(spark, profiles.ink_threshold(F.array(*map(F.lit, greys)))) == 200 - 64
    assert one(spark, profiles.ink_threshold(F.array(*map(F.lit, [90] * 9)))) == 65
    counts = profiles.prefix_counts(F.array(*map(F.lit, [1, 0, 1, 1])))
    assert one(spark, counts) == [0, 1, 1, 2, 3] and one(spark, profiles.span_share(counts, F.lit(1), F.lit(4))) == pytest.approx(2 / 3) and one(spark, profiles.span_share(counts, F.lit(2), F.lit(2))) == 0


def test_film_and_boxes(spark):
    span = lambda *v: tuple(one(spark, profiles.inside_film(*map(F.lit, v))))
    assert span(0, 200, 20, 180) == (28, 172) and span(0, 5, 3, 180) == (0, 5)
    box = [F.lit(v) for v in (11, 11, 1, 40)]
    assert tuple(one(spark, profiles.from_ocr(*box, F.lit(0.25)))) == (2, 2, 1, 10) and tuple(one(spark, profiles.to_ocr(*box, F.lit(2.0)))) == (6, 6, 0, 20)


def test_cell_cover_unites_boxes(spark):
    rows = [(1, 0, 0, 24, 24, 100, 100), (1, 0, 0, 24, 24, 100, 100), (1, 30, 0, 1, 1, 100, 100), (1, 99, 99, 50, 50, 100, 100)]
    got = {(x["r"], x["c"]): x["cover"] for x in profiles.cell_cover(spark.createDataFrame(rows, "page_key long, x long, y long, w long, h long, page_w long, page_h long"), 4, 4).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1 / 16, (3, 3): 1 / 16}


def test_choices(spark):
    cands = [("ad", k, k % 4, k == 6) for k in range(9)] + [("market", k, k, False) for k in range(5)]
    made = spark.createDataFrame(cands, "lane string, key int, family int, postable boolean")
    tried, recent = spark.createDataFrame([("ad", 0), ("market", 1)], "lane string, key int"), spark.createDataFrame([("ad", 1)], "lane string, family int")
    got = sorted((x["lane"], x["key"], x["pos"], x["chosen"]) for x in desk.choose_search(made, tried, recent, "key", [F.col("key")], 4).collect())
    assert got == [("ad", 2, 1, False), ("ad", 3, 2, False), ("ad", 4, 3, False), ("ad", 6, 4, True), ("market", 0, 1, False), ("market", 2, 2, False), ("market", 3, 3, False), ("market", 4, 4, False)]


def test_gates_and_reviews(spark):
    gate = lambda *v: one(spark, desk.shape_gate(*[F.lit(x) for x in v]))
    assert (gate(1600, 300, 1597), gate(1600, 300, 1596), gate(1600, 700, 1600), gate(1600, 0, 1600)) == (None, "width", "shape", "shape")
    page = lambda a: one(spark, desk.choose_page(F.lit(a).cast("int"), F.lit(4)))
    assert (page(None), page(3), page(5), page(0)) == (1, 3, None, None)
    review = lambda o, why: one(spark, desk.reviewed(F.lit(o), F.array(F.lit("a")), F.lit(why).cast("string")))
    assert review("REFUSE", "x") is None and review("PASS", None)["outcome"] == "PASS" and review("PASS", "x")["reasons"] == ["a", "x; a person decides, this is not a rejection"]


def test_addresses(spark):
    path = "batch a/b c*~+é"
    assert one(spark, desk.quoted(F.lit(path))) == "batch%20a%2Fb%20c%2A~%2B%C3%A9"
    assert one(spark, desk.service_path(F.concat(F.lit("https://x/iiif/2/"), desk.quoted(F.lit(path))))) == path and one(spark, desk.service_path(F.lit("https://x/other"))) is None


def test_families_roster_and_search(spark):
    fams = spark.createDataFrame([("b", "a")], "member string, canonical string")
    got = desk.canonical(spark.createDataFrame([("a",), ("b",), ("z",)], "lccn string"), fams, "lccn").collect()
    assert {x["lccn"]: x["family"] for x in got} == {"a": "a", "b": "a", "z": "z"}
    listed = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, label string")
    details = spark.createDataFrame([(1, "", ["A", "B"]), (2, "Two", [])], "k int, title string, cities array<string>")
    assert sorted(tuple(x) for x in desk.roster(listed, details, "k").collect()) == [(1, "one", "A"), (2, "Two", None), (3, "three", None)]
    pages = spark.createDataFrame([("Market Report", "1878-01-01", 1), ("market report", "1879-01-01", 2), (None, "1878-05-05", 1)], "text string, date string, sequence int")
    assert [(x["date"], x["total"]) for x in desk.search(pages, "market report", "1878-01-01", "1878-12-31").collect()] == [("1878-01-01", 1)]
    assert desk.search(pages, "nothing", "1878-01-01", "1878-12-31", 1).count() == 0


def test_folds_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = spark.createDataFrame([(p, k, 10 * (k % 5), 20 * (k // 5) + k % 3, 8, 10) for p in (1, 2, 3) for k in range(40)], "page_key long, wid long, x long, y long, w long, h long")
        got = layout.rows_anchor(words).collect()
        assert len(got) == 120 and all(x["row_id"] == x["wid"] // 5 for x in got)
        cells = [(p, r, c, int((r * 3 + c * 5 + p) % 4 > 0)) for p in (1, 2, 9) for r in range(6) for c in range(7) if (r + c) % 11]
        ink = {x[:3]: x[3] for x in cells}
        out = raster.close_cells(spark.createDataFrame(cells, "page_key long, r long, c long, ink long")).collect()
        near = lambda p, r, c: sum(ink.get((p, r + i, c + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
        assert {tuple(x)[:3]: x["ink"] for x in out} == {k: max(v, int(near(*k) >= 5)) for k, v in ink.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
