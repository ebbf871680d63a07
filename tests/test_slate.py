"""Every query with SQL against DuckDB, on the smallest tables; the others against brute force."""

import decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import decisions, layout, raster
from folio.plans import editions, rounds, slate  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 9) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(slate.ORACLES))
def test_matches_sql(spark, duck, name):
    df = slate.QUERIES[name](spark, SF)
    got = duck.execute(slate.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    have = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert have == want and (want or name == "approved_pending")


def test_anchor_fold_is_not_islands(spark):
    """Each word is near the one before it, but the third is far from the row's first."""
    rows = spark.createDataFrame([(1, k, "w", 0, 6 * k, 10, 10) for k in range(4)], "page_key long, wid long, t string, x long, y long, w long, h long")
    ids = {r["wid"]: r["row_id"] for r in layout.rows_anchor(rows).collect()}
    assert ids == {0: 0, 1: 0, 2: 1, 3: 1}
    assert layout.reading_text(rows, layout.rows_anchor(rows)).first()["text"] == "w w w w"


def test_anchor_fold_against_brute_force(spark):
    from folio.sources.bridge import words

    rows = words(spark, SF).where("page_key < 20")
    got = {(r["page_key"], r["wid"]): r["row_id"] for r in layout.rows_anchor(rows).collect()}
    pages = {}
    for r in rows.collect():
        pages.setdefault(r["page_key"], []).append((r["y"], r["x"], r["wid"], r["h"]))
    for page, found in pages.items():
        row, first = -1, None
        for y, _, wid, h in sorted(found):
            if first is None or abs(y - first[0]) > 0.6 * max(first[1], h) + 1e-9:
                row, first = row + 1, (y, h)
            assert got[page, wid] == row


def judge(spark, **kw):
    base = {"known": True, "postable": True, "date": "1890-01-01", "min_date": "1880-01-01", "geometry": True, "crop": [], "page": []} | kw
    a = {k: F.lit(v) if not isinstance(v, list) else (F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")) for k, v in base.items()}
    v = decisions.verdict(a["known"], a["postable"], a["date"].cast("string"), a["min_date"].cast("string"), a["geometry"], a["crop"], a["page"], F.lit(True))
    return spark.range(1).select(v.alias("v")).first()["v"]


def test_gate_algebra(spark):
    assert judge(spark)["outcome"] == "PASS" and judge(spark)["reasons"] == []
    assert judge(spark, page=["slave"])["outcome"] == "REVIEW"
    assert judge(spark, crop=["slave"])["outcome"] == "REVIEW"
    both = judge(spark, crop=["klux"], page=["klux"])
    assert both["outcome"] == "REVIEW" and len(both["reasons"]) == 2
    assert judge(spark, known=False)["reasons"] == ["not in the roster"]
    worst = judge(spark, postable=False, date="1850-01-01", geometry=False, crop=["x"], page=["y"])
    assert worst["outcome"] == "REFUSE" and len(worst["reasons"]) == 4
    assert judge(spark, date=None)["outcome"] == "REFUSE"
    assert judge(spark, date="1880-01-01")["outcome"] == "PASS"


def test_text(spark):
    one = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one(T.norm(F.lit("It's AB cd"))) == "it" and one(T.norm(F.lit("12"))) == ""
    assert one(T.hits(F.lit("Slavery, lynch law"), T.SUBJECT_PREFIXES)) == ["slave", "lynch"]
    assert one(T.hits(F.lit("kl"), ("kl",))) == []
    assert one(T.cut_band(F.lit("a" * 200 + ". " + "b" * 200))) == "a" * 200 + "…"
    assert one(T.cut_band(F.lit("a" * 400))) == "a" * 300 + "…"
    assert one(T.town_tag(F.lit("st. mary's"))) == "StMaryS" and one(T.town_tag(F.lit("--"))) is None
    assert one(T.legibility(F.lit("a b c"))) == 0.0


def test_raster(spark):
    cells = spark.createDataFrame([(1, 0, c, int(c not in (3, 6, 7))) for c in range(10)], "page_key long, r long, c long, ink long")
    assert raster.row_span(cells).first()["span"] == 6
    ring = spark.createDataFrame([(1, r, c, int((r, c) != (1, 1))) for r in range(3) for c in range(3)], "page_key long, r long, c long, ink long")
    assert raster.close_cells(ring).agg(F.sum("ink")).first()[0] == 9
