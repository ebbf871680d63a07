"""Replies, pages, rasters, connectors and the log on named cases, and folds against brute force."""

import json

import pytest
from pyspark.sql import functions as F

from folio.functions import replies as R
from folio.operators import layout, pages, raster, selection
from folio.sources import archive
from folio.streaming import log

WORD = "page_key long, wid long, t string, x long, y long, w long, h long"


@pytest.fixture(scope="module")
def one(spark):
    return lambda e: spark.range(1).select(e.alias("v")).first()["v"]


def test_items_and_blocks(one):
    assert one(R.items_of(F.lit('```\n "A  b" \n\n C!\n```'))) == ["A b", "C!"]
    assert one(R.join_items(F.array(F.lit("A"), F.lit("B!"), F.lit(" ")))) == "A. B!"
    assert one(R.blocks_of(F.lit("Been Es-\ntablished\n\nBetween Wash-\n\nington AND"))) == ["Been Established", "Between Washington AND"]
    assert one(R.blocks_of(F.lit("one\ntwo"))) == ["one", "two"]
    assert one(R.blocks_of(F.lit("Suffer­\ning\n\nRE-\n\nPORT"))) == ["Suffering", "RE-", "PORT"]
    assert one(R.blocks_of(F.lit(None).cast("string"))) == []
    assert one(R.join_broken_words(F.lit("REPRESENTA- TIVES 1- 2 a - b"))) == "REPRESENTATIVES 1- 2 a - b"
    assert one(R.curl(F.lit("\"A\" (\"b\") it's"))) == "“A” (“b”) it’s"


def test_refusals(one):
    shape = lambda t: one(R.story_shape(F.lit(t)))
    assert shape("JACKSON, Oct. 8.—The mayor spoke") is None and shape("By Associated Press the news") is None
    assert shape("BERNE, Nov. 24.—One. NEW YORK, Nov. 26.—Two") == "two datelines"
    assert shape("Remember—We have the goods") == "no dateline" and shape("Washington—After consideration") is None
    assert shape("The mayor said yesterday") == "no dateline"
    check = lambda t, h=False: one(R.check_transcription(F.lit(t), h, 2, ("slave",)))["refusal"]
    assert check("to be") == "too short" and check("Great fire destroys three buildings") is None
    assert check("Great [illegible] destroys three buildings", True) == "unread word"
    assert check("Dyspepsia remedy helps people everywhere") == "advertisement"
    own = lambda t: one(R.own_title(F.lit(t), F.lit("The Atlanta Georgian and News")))
    assert own("AND NEWS LANTA") == "part of the title" and own("X, GA., WEDNESDAY, JULY") == "dateline" and own("Fire downtown") is None
    assert one(R.drop_furniture(F.lit("Fire downtown. Griffin, Ga., Tuesday. All well."), F.lit("x"))) == "Fire downtown. All well."
    assert one(R.is_commentary(F.lit("I can't zoom further"))) and not one(R.is_commentary(F.lit("COTTON IS HIGHER")))
    assert one(R.unsupported_claims(F.lit("FOUND | a"))) == [] and one(R.unsupported_claims(F.lit("?"))) is None
    assert one(R.unsupported_claims(F.lit("ABSENT | a hat | no\nFOUND | b"))) == ["a hat"]
    assert one(R.review_words(F.lit("Reward for the arrest, a colored man"))) == ["arrest", "colored man"]


def test_replies(one):
    got = one(R.parse_reply(F.lit('KIND: Comic strip (a)\nTITLE: NONE\nWORDS: "Hi | There!\nPICTURE: A dog\nPICTURE: A cat\nCARICATURE: yes')))
    assert got.asDict() == {"kind": "comic-strip", "title": "", "words": "Hi. There!", "picture": "A cat", "caricature": True}
    assert one(R.parse_reply(F.lit("KIND: nonsense\nPICTURE: x"))) is None and one(R.parse_reply(F.lit("CANNOT_READ"))) is None
    skips = lambda t: one(R.parse_skips(F.lit(t), F.lit(4)))
    assert skips("1, 2 & 4") == [1, 2, 4] and skips("1–3") == [1, 2, 3] and skips("None") == [] and skips("2 and 4") == [2, 4]
    assert skips("3-1") is None and skips("5") is None and skips("x") is None and skips("") is None


def test_titles_and_keys(one):
    assert one(R.display_title(F.lit("The DeKalb news and advertiser-republican."))) == "The DeKalb News and Advertiser-Republican"
    assert one(R.post_date(F.lit("1898-01-06"))) == "January 6, 1898" and one(R.post_date(F.lit("x"))) is None
    shown = F.array(F.lit("none"), F.lit("http://x/lccn/sn1/1890-01-02/ed-3/"))
    assert tuple(one(R.identify(F.lit("x"), shown))) == ("sn1", "1890-01-02", 3)
    assert tuple(one(R.identify(F.lit("dlg_ghn_sn9-1890-01-02-ed-1"), F.lit(None).cast("array<string>")))) == ("sn9", "1890-01-02", 1)
    assert one(R.valid_ident(F.lit("sn89053729"), F.lit("1890-01-02"))) and not one(R.valid_ident(F.lit("gua1"), F.lit("1890-01-02")))
    margins = F.from_json(F.lit('{"top": {"reason": "gap", "ratio": 0.1}, "bottom": {"reason": "rule"}, "left": null}'), "map<string,struct<reason:string,ratio:double,text:string>>")
    assert one(R.flags(margins)) == ["top"]


def test_drop_initial_keeps_its_row(spark):
    boxes = [("T", 0, 0, 60, 80), ("he", 62, 4, 30, 12), ("day", 95, 5, 30, 12), ("was", 62, 30, 30, 12), ("on", 0, 90, 20, 12)]
    rows = spark.createDataFrame([(1, k, *b) for k, b in enumerate(boxes)], WORD)
    assert {r["wid"]: r["row_id"] for r in pages.reading_order(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_nameplate(spark):
    title = [(1, 0, "DAILY", 100, 20, 200, 70), (1, 1, "NEWS", 320, 22, 200, 68)]
    date = [(1, 2 + k, "May", 100 * k, 110, 50, 12) for k in range(3)]
    body = [(1, 100 + k, "body", (k % 10) * 70, 260 + (k // 10) * 15, 60, 8) for k in range(600)]
    plain = spark.createDataFrame(title + date + body, WORD)
    got = pages.nameplates(plain).collect()
    assert [(r["w"], r["h"]) for r in got] == [(690, 114)]  # 114.5 to the even number
    assert pages.nameplates(spark.createDataFrame(body, WORD)).count() == 0


def test_display_rows_split(spark):
    big = [(1, 0, "FIRE", 0, 0, 100, 40), (1, 1, "DOWN", 110, 2, 100, 40), (1, 2, "WAR", 400, 1, 100, 40), (1, 3, "x", 800, 0, 10, 40)]
    small = [(1, 10 + k, "body", 0, 100 + 12 * k, 40, 8) for k in range(50)]
    got = {r["wid"]: r["piece"] for r in pages.display_rows(spark.createDataFrame(big + small, WORD)).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_lines_and_stories(spark):
    rows = spark.createDataFrame([(1, 0, 0, 30, 10.0), (1, 1, 20, 32, 10.0), (1, 2, 31, 40, 10.0)], "page_key long, row_id long, top long, bottom long, med double")
    assert {r["row_id"]: r["line"] for r in pages.fold_lines(rows).collect()} == {0: 0, 1: 0, 2: 1}
    words = spark.createDataFrame([(1, k, "w", 0, 20 * k, 10, 30 if k == 1 else 10) for k in range(6)], WORD)
    assert pages.story_start(pages.spread_lines(words, F.lit(10.0))).first()["bottom"] == 90


def block(spark, gaps, display=False, rules=(), seed=5, most=0.5):
    top, rows = 0, []
    for k, g in enumerate([0, *gaps]):
        top += g
        rows.append((1, 0, k, top, top + 10, 10, 10.0, 1000, seed, k in rules))
        top += 10
    return pages.block_around(spark.createDataFrame(rows, "page_key long, col long, row long, top long, bottom long, tall long, med double, page_h long, seed long, rule_above boolean"), display, most).first()


def test_blocks(spark):
    got = block(spark, [2, 30, 2, 2, 2, 2, 2, 2, 2, 2, 14, 2])
    assert (got["rows"], got["top_reason"], got["bottom_reason"], got["outcome"]) == (9, "gap", "paragraph-gap", "ok")
    assert got["top_ratio"] == pytest.approx(8 / 22) and got["bottom_ratio"] == pytest.approx(1 / 13)
    whole = block(spark, [2] * 11)
    assert (whole["rows"], whole["top_reason"], whole["bottom_reason"]) == (12, None, None)
    assert block(spark, [2] * 11, rules=(3,))["top_reason"] == "rule"
    assert block(spark, [2] * 11, most=0.03)["outcome"] == "too tall" and block(spark, [2] * 11, seed=0, most=0.06)["bottom_reason"] == "cap"
    assert block(spark, [40] * 11)["outcome"] == "too small"


def test_boxes(one):
    L = lambda *v: [F.lit(x).cast("long") for x in v]
    assert tuple(one(pages.to_image(*L(0, 0, 796, 200), F.lit(3080 / 796), *L(3080, 4607)))) == (0, 0, 3080, 774)
    assert one(pages.to_image(*L(900, 0, 10, 10), F.lit(1.0), *L(800, 800))) is None
    assert tuple(one(pages.loosen(*L(5, 50, 90, 10), *L(100, 200), 0.1, 0.1))) == (0, 30, 100, 50)


def cells(spark, rows):
    return spark.createDataFrame([(1, r, c, int(v == "#")) for r, row in enumerate(rows) for c, v in enumerate(row)], "page_key long, r long, c long, ink long")


def test_raster(spark):
    grid = cells(spark, ["#..#.", "#..#.", "#....", "#..#.", "#...#"])
    assert tuple(raster.film_edges(raster.col_dark(grid)).first())[1:] == (1, 5)
    found = raster.components(grid)
    assert sorted(r["area"] for r in raster.component_stats(found).collect()) == [1, 1, 2, 5]
    rules = raster.vrules(cells(spark, ["." * 5, ".#...", ".....", ".#...", ".#...", "....."]), 6, 0.5)
    assert [tuple(r)[1:] for r in rules.collect()] == [(1, 1, 5)]


def test_candidates_leave_room_for_later_phrases(spark):
    hits = [("a", 0, k, k) for k in range(3)] + [("a", 1, 0, 9), ("b", 0, 0, 1), ("b", 0, 1, 9), ("b", 1, 0, 7)]
    rows = spark.createDataFrame(hits, "phrase string, decade long, rank long, key long")
    got = {r["key"]: r["phrase"] for r in selection.search_candidates(rows, ["key"], ["a", "b"], 2).collect()}
    assert got == {0: "a", 1: "a", 2: "a", 9: "b", 7: "b"}


def test_next_lane(spark):
    rows = lambda *l: spark.createDataFrame([(k, v) for k, v in enumerate(l)], "at long, lane string")  # noqa: E731, E741
    lane = lambda d: selection.next_lane(d, ("x", "y", "z"), [F.col("at")]).first()["lane"]
    assert lane(rows("x", "z")) == "x" and lane(rows("x", "held")) == "z" and lane(rows()) == "x"


def test_connectors(spark, tmp_path):
    (tmp_path / "roster.csv").write_text("lccn,title\na,One\nb,Two\na,Three\n")
    assert {r["lccn"]: r["title"] for r in archive.roster(spark, str(tmp_path / "roster.csv"), "lccn string, title string").collect()} == {"a": "Three", "b": "Two"}
    pages_ = tmp_path / "rights"
    pages_.mkdir()
    docs = [{"id": "dlg_ghn_sn9-1890-01-02-ed-1"}, {"id": "x", "edm_is_shown_by": "h/lccn/sn1/1931-01-02/ed-1"}, {"id": "y", "edm_is_shown_by": ["h/lccn/sn9/1890-01-02/ed-1"]}, {"id": "z"}]
    (pages_ / "p1.json").write_text(json.dumps({"response": {"docs": docs}}, indent=1))
    (pages_ / "p2.json").write_text("{broken")
    assert sorted(tuple(r) for r in archive.rights_issues(spark, str(pages_)).collect()) == [("sn1", "1931-01-02", 1), ("sn9", "1890-01-02", 1)]
    assert archive.rights_issues(spark, str(pages_), "1931").count() == 1
    words = json.dumps({"width": 10, "coords": {"hi": [[1, 2, 3, 4], ["5", "6", "7", "x"], [1]], "yo": [[9, 9, 9, 9]]}})
    page = spark.createDataFrame([(1, words), (2, "{"), (3, None)], "page_key long, j string")
    assert sorted(tuple(r)[1:] for r in archive.coordinates(page, "page_key", F.col("j")).collect()) == [("hi", 1, 2, 3, 4), ("yo", 9, 9, 9, 9)]
    canvas = lambda s: {"width": 8, "height": 9, "images": [{"resource": {"service": {"@id": s}}}] if s else []}
    issue = spark.createDataFrame([(1, json.dumps({"sequences": [{"canvases": [canvas(None), canvas("u2"), canvas("u3")]}]})), (2, "{}")], "k long, j string")
    found = archive.manifest_pages(issue, "k", F.col("j"))
    assert [(r["seq"], r["service"]) for r in found.orderBy("seq").collect()] == [(2, "u2"), (3, "u3")]
    assert archive.front_pages(found, "k").first()["seq"] == 2


def test_log_stream(spark, tmp_path):
    path, kept = tmp_path / "log", str(tmp_path / "check")
    event = lambda k, d, dry=False: {"at": "t", "decision": d, "lccn": "a", "date": "1890", "offset": k, "dry": dry}
    path.mkdir()
    (path / "a.json").write_text("\n".join(map(json.dumps, [event(1, "approve"), event(3, "reject", True)])) + "\nnot json\n")
    for n, (more, want) in enumerate([(None, "approve"), (event(2, "requeue"), "requeue")]):
        if more:
            (path / "b.json").write_text(json.dumps(more))
        query = log.follow(log.latest(log.tail(spark, str(path))), f"log_{n}", kept)
        query.awaitTermination(60)
        assert [(r["lane"], r["decision"]) for r in spark.table(f"log_{n}").collect()] == [("nameplate", want)]
        if not n:
            query.stop()
            kept += "2"


def test_refusals_find_tokens_once(spark):
    """Each column of the query found the text's tokens for itself, some of them twice."""
    import __spark_entry__

    plan = __spark_entry__.queries()["reply_refusals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([a-z]+)") == 1
    assert "RepartitionByExpression" in plan[plan.index("([a-z]+)") :]
