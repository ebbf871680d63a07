"""Queries over scanned pages: image bytes to strokes, and what the operators on strokes find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import bands, borders, pieces, strokes
from folio.plans.slate import query
from folio.sources.bridge import COLUMN, SCAN_SQL, scan_words, scans, scratch, table, written
from folio.streaming import state


def _pages(spark, sf_dir) -> DataFrame:
    """Decoded once, to a table by page that the query reads as often as it needs, and only the columns that it needs."""
    return written(scans(spark, sf_dir, pack=True), "page_key")


@query(f"""with {SCAN_SQL} select page_key, any_value(pw) as w, any_value(ph) as h, count(*) as strokes, sum(x1 - x0)::bigint as ink from st join pg using (page_key) group by 1""")
def scan_strokes(spark, sf_dir):
    size = F.aggregate("strokes", F.lit(0).cast("long"), lambda n, s: n + s["x1"] - s["x0"])
    return scans(spark, sf_dir).select("page_key", "w", "h", F.size("strokes").cast("long").alias("strokes"), size.alias("ink"))


@query(f"""with {SCAN_SQL}, px as (select page_key, x0 + k as c, count(*) as n from st, (select unnest(range(330)) as k) where y % 2 = 0 and k < x1 - x0 group by 1, 2),
cd as (select pg.page_key, c, coalesce(n, 0) / (ph / 2.0) as dark from pg cross join (select unnest(range(330)) as c) left join px using (page_key, c)),
fe as (select page_key, coalesce(min(case when dark <= 0.55 then c end), 330) as e0, coalesce(max(case when dark <= 0.55 then c end) + 1, 330) as e1 from cd group by 1),
k as (select page_key, c, case when dark <= 0.10 then 'paper' when dark >= 0.45 then 'rule' end as kind from cd join fe using (page_key) where c >= e0 and c < e1),
i as (select *, c - row_number() over (partition by page_key, kind order by c) as g from k where kind is not null)
select page_key, kind, min(c) as x0, max(c) + 1 as x1 from i group by page_key, kind, g having kind = 'rule' or count(*) >= 2""")
def scan_gutters(spark, sf_dir):
    return strokes.gutters(strokes.col_dark(_pages(spark, sf_dir)))


@query()
def scan_column_rules(spark, sf_dir):
    return strokes.vrules(_pages(spark, sf_dir))


def _seeds(spark, sf_dir) -> DataFrame:
    """Of each page eight words, from all columns and rows further and further down."""
    return scan_words(spark, sf_dir, dealt=False).where("floor(wid / 8) = wid % 8 * 6").withColumnRenamed("wid", "item").drop("t")


@query(f"""with {SCAN_SQL}, it as (select page_key, wid as item, x, y, w, h, 41 * (wid % 8) + 1 as x0, 41 * (wid % 8) + 41 as x1, ph, trunc(ph * 0.35)::bigint as cap from sw join pg using (page_key) where wid // 8 = wid % 8 * 6),
lim as (select *, greatest(0, y + h - cap) as top, least(ph, y + cap) - greatest(0, y + h - cap) as n, greatest(2, trunc(ph * 0.004)::bigint) as gap from it),
rw as (select page_key, item, unnest(range(n)) as r from lim),
ik as (select l.page_key, item, st.y - top as r, sum(least(st.x1, l.x1) - greatest(st.x0, l.x0)) / 40.0 as dark from lim l join st on st.page_key = l.page_key and st.y >= top and st.y < top + n and st.x0 < l.x1 and st.x1 > l.x0 group by 1, 2, 3),
pr as (select page_key, item, r, coalesce(dark, 0) as dark from rw left join ik using (page_key, item, r)),
bs as (select page_key, item, list_sort(list(dark))[count(*) // 10 + 1] as base from pr group by 1, 2),
fl as (select pr.*, dark <= base + 0.02 as clear, dark >= 0.45 as ruled from pr join bs using (page_key, item)),
cg as (select *, r - row_number() over (partition by page_key, item, clear order by r) as g from fl),
cr as (select page_key, item, min(r) as a, max(r) as b from cg where clear group by page_key, item, g),
cs as (select l.page_key, l.item, max(case when least(b, greatest(0, y - top)) - a + 1 >= gap then least(b, greatest(0, y - top)) end) as cu, min(case when b - greatest(a, least(n - 1, y + h - top)) + 1 >= gap then greatest(a, least(n - 1, y + h - top)) end) as cd from lim l left join cr using (page_key, item) group by 1, 2),
rs as (select l.page_key, l.item, max(case when r <= greatest(0, y - top) then r end) as ru, min(case when r >= least(n - 1, y + h - top) then r end) as rd from lim l left join (select * from fl where ruled) using (page_key, item) group by 1, 2),
o as (select l.page_key, l.item, top, case when ru is not null and (cu is null or ru >= cu - gap + 1) then ru + 1 else cu end as u, case when rd is not null and (cd is null or rd <= cd + gap - 1) then rd - 1 else cd end as d from lim l join cs using (page_key, item) join rs using (page_key, item))
select page_key, item, case when u is not null and d is not null then top + u end as y0, case when u is not null and d is not null then top + d + 1 end as y1 from o""")
def scan_spans(spark, sf_dir):
    column = F.col("item") % 8 * COLUMN
    return strokes.vertical_bounds(_seeds(spark, sf_dir).withColumns({"x0": column + 1, "x1": column + COLUMN}), _pages(spark, sf_dir))


@query()
def scan_cells(spark, sf_dir):
    return strokes.snap(_seeds(spark, sf_dir), _pages(spark, sf_dir), border=True)


@query()
def scan_paper_sides(spark, sf_dir):
    return strokes.paper_bounds(_seeds(spark, sf_dir), _pages(spark, sf_dir))


_WINDOWS = "list_append(list_transform(range(8), lambda c: {'item': c, 'x0': 41 * c + 1, 'x1': 41 * c + 41}), {'item': 8, 'x0': 4, 'x1': 328})"


@query(f"""with {SCAN_SQL}, wi as (select page_key, unnest({_WINDOWS}, recursive := true) from pg),
pt as (select page_key, item, wi.x0 as a, wi.x1 as b, st.y, greatest(st.x0, wi.x0) as s0, least(st.x1, wi.x1) as s1 from wi join st using (page_key) where st.x0 < wi.x1 and st.x1 > wi.x0),
gp as (select *, s0 - coalesce(lag(s1) over w, a) as gap from pt window w as (partition by page_key, item, y order by s0)),
sn as (select *, sum(case when gap > 2 then 1 else 0 end) over (partition by page_key, item, y order by s0) as k from gp),
ls as (select page_key, item, y, a, b, max(s1) - min_by(s0 - gap % 3, s0) as long, sum(s1 - s0) as ink, sum(greatest(0, least(s1, a + 6) - s0)) as l, sum(greatest(0, s1 - greatest(s0, b - 6))) as r from sn group by page_key, item, y, a, b, k),
rw as (select page_key, item, y, a, b, max(long) as long, sum(l) as l, sum(r) as r from ls group by 1, 2, 3, 4, 5 having sum(ink) >= 0.20 * (b - a)),
bd as (select *, y - row_number() over (partition by page_key, item order by y) as g from rw),
bn as (select page_key, item, g, a, b, min(y) as top, max(y) as bottom from bd group by 1, 2, 3, 4, 5 having max(y) - min(y) + 1 <= 9 and max(l) >= 3 and max(r) >= 3),
ce as (select page_key, x + w / 2.0 as cx, y + h / 2.0 as cy from sw where length(regexp_replace(t, '\\P{{L}}', '', 'g')) >= 3),
ok as (select * from bn where not exists (select 1 from ce where ce.page_key = bn.page_key and cx >= a and cx < b and cy >= top and cy <= bottom))
select page_key, item, y from bd semi join ok using (page_key, item, g) where long >= 0.38 * (b - a)""")
def scan_rule_rows(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    windows = F.array(*[F.struct(F.lit(c).cast("long").alias("item"), F.lit(COLUMN * c + 1).alias("x0"), F.lit(COLUMN * c + COLUMN).alias("x1")) for c in range(8)], F.struct(F.lit(8).cast("long").alias("item"), F.lit(4).alias("x0"), F.lit(328).alias("x1")))
    return strokes.rule_rows(pages.select("page_key", F.inline(windows)).withColumn("text_h", F.lit(7.0)), pages, scan_words(spark, sf_dir))


@query()
def scan_borders(spark, sf_dir):
    pages, words = _pages(spark, sf_dir), scan_words(spark, sf_dir)
    seeds = words.where("floor(wid / 8) = wid % 8 * 2").withColumnRenamed("wid", "item").drop("t")
    found = borders.border_boxes(seeds, pages, words, pages.select("page_key", F.lit(7.0).alias("text_h")))
    return found.select("page_key", "item", "x0", "y0", "x1", "y1")


_SAID = "case when event_type = 'purchase' then 'approve' when event_type = 'click' then 'reject' when event_type = 'view' then 'requeue' end"


@query(f"""with l as (select 'u' || user_id as lccn, strftime(ts, '%Y-%m') as date, case when user_id % 3 = 0 then 'ad' else 'nameplate' end as lane, {_SAID} as decision, event_id as "offset" from events where {_SAID} is not null)
select lccn || ':' || date || ':' || lane as key, max_by(decision, "offset") as decision, max("offset") as last from l group by 1""")
def decision_state(spark, sf_dir):
    """The event log as a stream, folded into a kept table. The path is a pattern, so that a table may be a file or a folder."""
    lines = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("decision", F.expr(_SAID)).where("decision is not null")
    lane = F.when(F.col("user_id") % 3 == 0, "ad")
    log = lines.select(F.concat(F.lit("u"), "user_id").alias("lccn"), F.date_format("ts", "yyyy-MM").alias("date"), lane.alias("lane"), "decision", F.col("ts").cast("string").alias("at"), F.col("event_id").alias("offset"))
    at = scratch(spark)
    running = state.follow(log, f"{at}/state", f"{at}/checkpoint")
    running.awaitTermination()
    return state.state(spark, f"{at}/state").select("key", "decision", F.col("offset").alias("last"))


@query()
def scan_pieces(spark, sf_dir):
    """Every line of the scans, cut where its page's gutters are clear on its rows."""
    words = scan_words(spark, sf_dir).withColumn("segment", F.floor(F.col("wid") / 8))
    return pieces.gutter_pieces(words, _pages(spark, sf_dir))


_TOP_SQL = f"""{SCAN_SQL.rstrip()},
tp as (select page_key, doc_id, ph, round_even(ph * 0.22, 0)::bigint as n, greatest(4, round_even(ph * 0.004, 0)::bigint) as stride, greatest(3, round_even(ph * 0.004, 0)::bigint) as gap, greatest(2, round_even(ph * 0.002, 0)::bigint) as edge, greatest(4, round_even(ph * 0.009, 0)::bigint) as tall from pg),
sc as (select page_key, n, stride, y, x0, x1 from st join tp using (page_key) where y < n),
cd as (select page_key, n, c, count(*) as k from (select page_key, n, unnest(range(x0, x1)) as c from sc) group by 1, 2, 3),
fc as (select page_key, case when count(*) > 165 then [] else list(c) end as film from cd where k / n >= 0.55 group by 1),
ov as (select a.page_key, a.y, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) - len(list_filter(coalesce(film, []), lambda c: c >= greatest(a.x0, b.x0) and c < least(a.x1, b.x1)))) as k
       from sc a join sc b on a.page_key = b.page_key and b.y = least(a.n - 1, a.y + a.stride) and a.x0 < b.x1 and a.x1 > b.x0 left join fc on fc.page_key = a.page_key group by 1, 2),
rw as (select page_key, y, coalesce(k, 0)::double / (330 - len(coalesce(film, []))) as share from (select page_key, unnest(range(n)) as y from tp) left join ov using (page_key, y) left join fc using (page_key)),
lm as (select page_key, count(*) as n, list_sort(list(share))[count(*) // 10 + 1] + 0.005::double as lim from rw group by 1),
bd as (select page_key, k as item, 14 * k + 3 + doc_id % 11 as band, greatest(0, 14 * k - 9 + doc_id % 5) as cluster, ph, lm.n, lim, stride, gap, edge, tall from tp join lm using (page_key), (select unnest(range(12)) as k))
"""


def _bands(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Twelve bands of each page, from row to row of its words."""
    pages = _pages(spark, sf_dir)
    doc, k = F.floor(F.col("page_key") / 100_000), F.col("item")
    asked = pages.select("page_key", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("item"))
    asked = asked.select("page_key", k.cast("long").alias("item"), (14 * k + 3 + doc % 11).alias("band"), F.greatest(F.lit(0), 14 * k - 9 + doc % 5).alias("cluster"))
    return asked, pages


@query(f"""with {_TOP_SQL}, q as (select *, greatest(0, least(band, n)) as b, greatest(0, greatest(0, least(band, n)) - stride) as probe from bd),
me as (select page_key, item, b, n, lim, gap, edge, stride, probe, cluster, y, share, share <= lim as clear, y >= probe as below, y >= probe - edge and y < probe as win from q join rw using (page_key)),
rn as (select *, y - row_number() over (partition by page_key, item, below, clear order by y) as run, min(case when y >= probe and share <= lim then y end) over (partition by page_key, item) as paper,
  bool_or(win and share > 0.08) over (partition by page_key, item) and not bool_or(y >= cluster and y < probe and clear) over (partition by page_key, item) as through from me),
lg as (select *, row_number() over (partition by page_key, item, below, clear, run order by y) as long from rn),
fo as (select page_key, item, any_value(b) as b, any_value(n) as n, any_value(gap) as gap, any_value(stride) as stride, any_value(lim) as lim, max(case when win then share end) as darkest, min(case when below and clear and long >= gap then y end) as met,
  min(case when below and share > 0.08 and (not through or y > coalesce(paper, n)) then y end) as large from lg group by 1, 2),
re as (select *, case when b = 0 then 'none' when darkest is null or darkest <= lim then 'clear' when large is not null and (met is null or large <= met) then 'big' when met is null then 'none' else 'walked' end as stop from fo)
select page_key, item, case stop when 'clear' then b when 'walked' then least(re.n, met - re.gap + 1 + re.stride) end as "end", coalesce(stop, 'none') as stop, case when stop = 'clear' then (re.lim - darkest) / 0.005 end as ratio from bd left join re using (page_key, item)""")
def band_ends(spark, sf_dir):
    asked, pages = _bands(spark, sf_dir)
    return bands.ink_bottoms(asked, None, pages)


@query(f"""with {_TOP_SQL}, m0 as (select page_key, item, band, n, lim, gap, tall, y, share, least(n, band) as last, coalesce(min(case when share <= 0.8 then y end) over w, least(n, band)) as film from bd join rw using (page_key) where y < band window w as (partition by page_key, item)),
m1 as (select *, case when film > 0 then last else least(last, 3 * gap) end as bound, min(case when y >= film and share <= 0.08 then y end) over (partition by page_key, item) as paper from m0),
m2 as (select *, y - lag(y) over (partition by page_key, item order by y) > gap as fresh from m1 where y >= greatest(film, least(coalesce(paper, bound), bound)) and share > lim),
m3 as (select *, sum(case when fresh then 1 else 0 end) over (partition by page_key, item order by y) as body from m2),
m4 as (select page_key, item, body from m3 group by 1, 2, 3 having count(*) >= any_value(tall) and count(*) filter (share > 0.08) >= 3 and count(*) filter (share <= 0.8) > count(*) // 2)
select page_key, item, count(body) as bodies from bd left join m4 using (page_key, item) group by 1, 2""")
def band_bodies(spark, sf_dir):
    asked, pages = _bands(spark, sf_dir)
    return bands.large_objects(asked.withColumnRenamed("band", "upto"), None, pages)
