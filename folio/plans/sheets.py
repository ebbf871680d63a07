"""Queries over sheets: pages set in several sizes of type, and the items found on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import bands, items, layout, pages, settling
from folio.plans.slate import query
from folio.sources.bridge import SHEET_SQL, SHEET_W, sheet_words, sheets, written


def _pages(spark, sf_dir) -> DataFrame:
    """Decoded once, as scans are."""
    return written(sheets(spark, sf_dir, pack=True), "page_key")


def _all(v: str, key: str, fold: str) -> str:
    return f"list_{fold}(list_transform({v}, lambda u: {key}))"


def _upto(v: str, fails: str) -> str:
    """A list up to the first place i at which ``fails`` holds."""
    return f"{v}[1 : coalesce(list_min(list_filter(range(1, len({v}) + 1), lambda i: {fails})), len({v}) + 1) - 1]"


def _row(v: str) -> str:
    return _upto(v, f"abs({v}[i].y - {v}[1].y) * 10 > 6 * greatest({v}[i].h, {v}[1].h)")


def _tier(v: str) -> str:
    real = f"list_filter(range(1, len({v}) + 1), lambda i: {v}[i].r)"
    return f"len(list_filter(range(2, len({v}) + 1), lambda b: ({v}[b].x - {v}[b - 1].x - {v}[b - 1].w) * 10 > 12 * greatest({v}[b].h, {v}[b - 1].h) and list_min({real}) < b and list_max({real}) >= b)) > 0"


def _whole(source: str, line: str, name: str) -> str:
    """A source with one more column: a line, words by x, with the rest of it on both sides."""
    edge = {k: f"{name}_{k}" for k in ("top", "end", "tall", "near", "lhs", "rhs", "all")}
    top, end, tall, near, lhs, rhs, every = edge.values()
    return f"""(select * exclude ({', '.join(edge.values())}), case when len({every}) = len({line}) or {_tier(every)} then {line} else {every} end as {name} from (
      select *, list_concat(list_reverse({_upto(lhs, f"((case when i = 1 then {line}[1].x else {lhs}[i - 1].x end) - {lhs}[i].x - {lhs}[i].w) * 10 > 12 * greatest({tall}, {lhs}[i].h)")}), {line},
        {_upto(rhs, f"({rhs}[i].x - (case when i = 1 then {line}[-1].x + {line}[-1].w else {rhs}[i - 1].x + {rhs}[i - 1].w end)) * 10 > 12 * greatest({tall}, {rhs}[i].h)")}) as {every} from (
      select *, list_reverse(list_filter({near}, lambda v: v.x + v.w <= {line}[1].x)) as {lhs}, list_filter({near}, lambda v: v.x >= {line}[-1].x + {line}[-1].w) as {rhs} from (
      select *, list_sort(list_filter(ws, lambda v: 2 * v.y + v.h >= 2 * {top} and 2 * v.y + v.h <= 2 * {end} and 100 * v.h >= 60 * {tall} and 100 * v.h <= 160 * {tall} and not list_contains({line}, v))) as {near} from (
      select *, {_all(line, 'u.y', 'min')} as {top}, {_all(line, 'u.y + u.h', 'max')} as {end}, {_all(line, 'u.h', 'max')} as {tall} from {source})))))"""


_MET = f"""(select *, list_sort(found) as line, {_all('found', 'u.h', 'max')} as size from (select *, {_row('met')} as found, {_row('under')} as below from (
  select walk.*, ws, med, list_filter(ws, lambda v: 2 * v.y > 2 * tp + tall and 2 * v.y <= 2 * fin + 3 * head and v.x + v.w > x0 and v.x < x1) as met, list_filter(ws, lambda v: v.y > fin and v.x + v.w > x0 and v.x < x1) as under
  from walk join pw using (page_key) where stop is null)))"""
_FIRST = f"(select * exclude (grown), case when 100 * size >= 85 * head and 100 * size <= 125 * head then grown else line end as tried from {_whole(_MET, 'line', 'grown')})"
_SAID = "array_to_string(list_transform({}, lambda u: u.t), ' ')"
_STEP = f"""select page_key, segment, x0, x1, y0, head, case when go then least(lft, {_all('taken', 'u.x', 'min')}) else lft end, case when go then greatest(rgt, {_all('taken', 'u.x + u.w', 'max')}) else rgt end,
  case when go then {_all('taken', 'u.y', 'min')} else tp end, case when go then {_all('taken', 'u.h', 'max')} else tall end, case when go then {_all('taken', 'u.y + u.h', 'max')} else fin end, case when go then n + 1 else n end,
  case when not go then why when {_all('taken', 'u.y + u.h', 'max')} - y0 > 6 * head then 'deep' when n = 8 then 'lines' end,
  case when why = 'gap' then ({_all('below', 'u.y', 'min')} - fin - 1.5 * head)::double / (1.5 * head) end, case when why = 'gap' then {_SAID.format('list_sort(below)')} when why <> 'end' then {_SAID.format('tried')} end
  from (select *, why is null as go from (select *, case when len(met) = 0 then case when len(under) = 0 then 'end' else 'gap' end when 100 * size > 125 * head then 'other item'
    when 100 * size >= 85 * head then case when 100 * (least({_all('tried', 'u.x + u.w', 'max')}, x1) - greatest(tried[1].x, x0)) < 60 * (x1 - x0) then 'boundary' when {_tier('tried')} then 'tier' end
    when 100 * size >= 30 * head and 100 * size >= 160 * med then case when 100 * size > 105 * tall and not coalesce(regexp_matches(line[1].t, '^\\p{{Ll}}'), false) then 'deck grew' when {_tier('tried')} then 'tier' end
    else 'boundary' end as why from {_whole(_FIRST, 'tried', 'taken')}))"""


@query(f"""with recursive {SHEET_SQL}, pw as (select page_key, list(struct_pack(x := x, wid := wid, y := y, w := w, h := h, t := t, r := length(regexp_replace(t, '\\P{{L}}', '', 'g')) >= 3) order by y, x, wid) as ws, median(h) as med, max(y + h) as high from dw group by 1),
walk(page_key, segment, x0, x1, y0, head, lft, rgt, tp, tall, fin, n, stop, ratio, said) as (
  select page_key, wid // 8, min(x), max(x + w), min(y), max(h), min(x), max(x + w), min(y), max(h), max(y + h), 1::bigint, null::varchar, null::double, null::varchar from dw where size >= 18 and ((wid // 8) % 2 = 0 or wid % 8 between 2 and 5) group by 1, 2
  union all {_STEP})
select page_key, segment, case when ok then lft end as x, case when ok then y0 end as y, case when ok then rgt - lft end as w, case when ok then fin - y0 end as h, n as lines, stop, ratio, said
from (select *, fin - y0 <= 0.30 * high as ok from walk join (select page_key, high from pw) using (page_key) where stop is not null)""")
def deck_items(spark, sf_dir):
    """From every row of the three large sizes, or of every other the middle of it: the item that begins there."""
    words = sheet_words(spark, sf_dir)
    seeds = words.where("size >= 18 and (floor(wid / 8) % 2 = 0 or wid % 8 between 2 and 5)").select("page_key", F.floor(F.col("wid") / 8).alias("segment"), "wid")
    return items.deck_items(words, seeds)


@query()
def sheet_headlines(spark, sf_dir):
    return items.lane_items(sheet_words(spark, sf_dir), _pages(spark, sf_dir))


@query()
def sheet_ads(spark, sf_dir):
    return items.lane_items(sheet_words(spark, sf_dir), _pages(spark, sf_dir), "ad")


@query()
def sheet_names(spark, sf_dir):
    """The band of each sheet's name, moved to where its ink ends."""
    words = sheet_words(spark, sf_dir)
    display, body = written(layout.display_words(words)), written(layout.body_start(layout.density(words)))
    return bands.refine(written(pages.nameplates(words, display, body).select("page_key", "h")), _pages(spark, sf_dir), words, display, body)


_WORD = "struct_pack(x0 := {0}, y0 := {1}, x1 := {2}, y1 := {3})"
_PAST = _WORD.format("case when w.x0 < s.x0 and s.x0 < w.x1 then w.x0 else s.x0 end", "case when w.y0 < s.y0 and s.y0 < w.y1 then w.y1 + 1 else s.y0 end", "case when w.x0 < s.x1 and s.x1 < w.x1 then w.x1 else s.x1 end",
    "case when w.y0 < s.y1 and s.y1 < w.y1 then case when w.y1 + 1 <= most then w.y1 + 1 else w.y0 - 1 end else s.y1 end")
_UNDER = _WORD.format("s.x0", "s.y0", "s.x1", "w.y1 + 1")


@query(f"""with recursive {SHEET_SQL}, pw as (select page_key, list({_WORD.format('x::double', 'y::double', '(x + w)::double', '(y + h)::double')} order by y, x, w, h) as ws from dw where h > 13 group by 1),
rc as (select page_key, k as item, 30 + 9 * k as x, 10 + 45 * k as y, 90 + 13 * k as deep from pg, (select unnest(range(12)) as k)),
walk(page_key, item, r, most, n, settled) as (select page_key, item, {_WORD.format('x::double', 'y::double', '(x + 150)::double', '(y + deep)::double')}, y + deep + 60.0::double, 0::bigint, false from rc
  union all select page_key, item, q, most, n + 1, q = r from (select *, list_reduce(list_prepend(p, coalesce(ws, [])), lambda s, w: case when w.x1 > s.x0 and w.x0 < s.x1 and s.y1 <= w.y0 and w.y0 <= s.y1 + 13 and w.y1 + 1 <= most then {_UNDER} else s end) as q
    from (select walk.*, ws, list_reduce(list_prepend(r, coalesce(ws, [])), lambda s, w: case when w.x1 <= s.x0 or w.x0 >= s.x1 or w.y1 <= s.y0 or w.y0 >= s.y1 then s else {_PAST} end) as p from walk left join pw using (page_key) where not settled and n < 20)))
select page_key, item, r.x0 as x0, r.y0 as y0, r.x1 as x1, r.y1 as y1, n as rounds, settled from walk where settled or n = 20""")
def uncut_boxes(spark, sf_dir):
    """Twelve boxes a sheet, their edges moved out of its display type."""
    words = sheet_words(spark, sf_dir)
    k = F.col("item")
    rects = words.select("page_key").distinct().withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumns({"x0": 30 + 9 * k, "y0": 10 + 45 * k})
    rects = rects.withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 90 + 13 * k, "least": F.lit(13)}).withColumn("most", F.col("y1") + 60)
    return settling.uncut(rects, words)


@query()
def sheet_bottoms(spark, sf_dir):
    """Twelve bottoms a sheet, moved out of its lines of ink in three strips."""
    found = _pages(spark, sf_dir)
    y1 = 40 + 41 * F.col("item")
    rects = found.select("page_key", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("item"))
    rects = rects.withColumns({"x0": F.lit(0), "x1": F.lit(SHEET_W), "y1": y1, "text_h": F.lit(7.0), "cap": y1 + 60, "strip": F.lit(SHEET_W // 3)})
    return settling.settle_bottoms(rects, found)
