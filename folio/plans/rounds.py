"""Queries over walks, title rounds, recuts, reminders and alternative texts; registered with those of slate."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.alt import alt_text
from folio.operators import decisions, raster, selection, walks
from folio.plans.editions import _PRINTED, LANES, _printed
from folio.plans.slate import _JUDGED_SQL, ORACLES, QUERIES, _judged, query  # noqa: F401
from folio.sources.bridge import INK_SQL, WORDS_SQL, ink, table, words

_DECK = 0.2  # the formula's pages have no words of 30 % of a tall one's height in its column
_HOP = "(select max(w.y + w.h) from word w where w.page_key = {p}.page_key and w.y > {p}.e and w.y <= {p}.e + 1.5 * {p}.h and w.x + w.w > {p}.x0 and w.x < {p}.x1 and w.h >= 0.2 * {p}.h)"
_HOPS = "".join(f", s{k} as (select p.* exclude (e), coalesce({_HOP.format(p='p')}, p.e) as e from s{k - 1} p)" for k in range(1, 5))


@query(f"""with {WORDS_SQL}, s0 as (select page_key, wid as seed, x as x0, x + w as x1, y as y0, h, y + h as e from word where wid % 53 = 0){_HOPS},
g as (select page_key, max(x + w) as pw, max(y + h) as ph from word group by 1),
b as (select *, greatest(0, trunc(x0 - 0.02 * pw)::bigint) as a, least(pw, trunc(x1 + 0.02 * pw)::bigint) as b, greatest(0, trunc(y0 - 0.15 * h)::bigint) as c, least(ph, trunc(e + 0.15 * h)::bigint) as d from s4 join g using (page_key)),
o as (select *, b > a and d > c and d - c <= 0.35 * ph as ok from b)
select page_key, seed, case when ok then a end as x, case when ok then c end as y, case when ok then b - a end as w, case when ok then d - c end as h from o""")
def deck_boxes(spark, sf_dir):
    page = words(spark, sf_dir)
    seeds = page.where("wid % 53 = 0").select("page_key", F.col("wid").alias("seed"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("h")).alias("y1"))
    return walks.deck_boxes(page, seeds, _DECK)


@query(f"""with {WORDS_SQL}, l as (select page_key, wid // 8 as line, wid // 8 * 20 + (page_key * 7 + wid // 8 * 13) % 9 as top, 12 + (wid * 5 + page_key) % 7 as tall, case when (wid // 8 + page_key) % 11 = 10 then 30 else (wid // 8 * 3) % 5 end as l from word where wid % 8 = 0),
g as (select *, top + tall as bottom, top - coalesce(lag(top + tall) over w, -4) as gap, row_number() over w - 1 as i, count(*) over (partition by page_key) as n from l window w as (partition by page_key order by line)),
t as (select *, gap < 9 as tight, lead(gap < 9, 1) over w and lead(gap < 9, 2) over w and tall < 24 as st from g window w as (partition by page_key order by line)),
f as (select page_key, min(case when st then i end) as a0, min(case when top + 4 > 220 then i end) as past, max(n) as n from t group by 1),
s as (select page_key, n, case when n >= 4 and (past is null or past >= a0) then a0 end as first from f),
m as (select page_key, list_sort(list(l))[count(*) // 2 + 1] as mode from t join s using (page_key) where i between first and first + 11 group by 1),
y as (select t.*, first, case when i > first then case when not tight then 'gap' when i - first >= 2 and l > mode + 18 then 'indent' when bottom + 60 > 220 then 'cap' end end as why from t join s using (page_key) left join m using (page_key)),
z as (select page_key, max(first) as first, min(case when why is not null then i end) as stop, max(n) as n from y group by 1),
e as (select *, case when first is not null then least(stop - 1, first + 9, n - 1) end as last from z)
select e.page_key, e.first, e.last, max(case when i = e.last then trunc(bottom + 9.0)::bigint end) as bottom,
  case when e.last = e.first + 9 then 'row-count-cap' else max(case when i = stop then why end) end as reason,
  case when e.last is distinct from e.first + 9 or e.last is null then max(case when i = stop and why = 'gap' then (gap - 9.0) / 9.0 end) end as ratio,
  case when e.first is null then 'no paragraph' when e.last - e.first < 2 then 'too short' else 'ok' end as outcome
from e join y using (page_key) group by e.page_key, e.first, e.last""")
def article_spans(spark, sf_dir):
    row = F.floor(F.col("wid") / 8)
    lines = words(spark, sf_dir).where("wid % 8 = 0").select("page_key", row.alias("line"), (row * 20 + (F.col("page_key") * 7 + row * 13) % 9).alias("top"), (12 + (F.col("wid") * 5 + F.col("page_key")) % 7).alias("tall"), F.when((row + F.col("page_key")) % 11 == 10, 30).otherwise(row * 3 % 5).alias("left"))
    lines = lines.withColumn("bottom", F.col("top") + F.col("tall"))
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_key"), F.lit(-4).alias("head_bottom"), F.lit(-60).alias("read_top"), F.lit(1000).alias("page_h"), F.lit(15.0).alias("med"))
    return walks.article_spans(lines, heads)


_INKED = "cr as (select page_key, r, c, case when c % 10 = 0 then (r < 26)::int when c % 10 in (1, 9) and (page_key + r // 10) % 5 <> 0 then 0 when c % 10 in (1, 9) then ink else ink end as ink from cell)"


@query(f"""with {INK_SQL}, {_INKED}, cd as (select page_key, c, sum(ink) / count(*) as dark from cr where r % 2 = 0 group by 1, 2),
fe as (select page_key, coalesce(min(case when dark <= 0.55 then c end), 40) as e0, coalesce(max(case when dark <= 0.55 then c end) + 1, 40) as e1 from cd group by 1),
k as (select page_key, c, case when dark <= 0.10 then 'paper' when dark >= 0.45 then 'rule' end as kind from cd join fe using (page_key) where c >= e0 and c < e1),
i as (select *, c - row_number() over (partition by page_key, kind order by c) as g from k where kind is not null),
gu as (select page_key, kind, min(c) as g0, max(c) + 1 as g1 from i group by page_key, kind, g having kind = 'rule' or count(*) >= 2),
it as (select doc_id as page_key, k as item, (doc_id * 3 + k * 11) % 30 as x, 4 + k as w, (k * 15 + doc_id) % 40 as y, 8 as h from documents, (select unnest([0, 1, 2]) as k)),
dk as (select page_key, item, c, sum(ink) / count(*) as dark from it join cr using (page_key) where r >= y and r < y + h group by 1, 2, 3),
x as (select page_key, item, kind, g0, min(dark) > 0.08 as crossed from dk join gu using (page_key) where case when kind = 'rule' then (c >= g0 - 2 and c < g0) or (c >= g1 and c < g1 + 2) else c >= g0 and c < g1 end group by 1, 2, 3, 4),
sd as (select page_key, item, max(case when g1 <= it.x then g1 end) as l, min(case when g0 >= it.x + w then g0 end) as r from it join gu using (page_key) left join x using (page_key, item, kind, g0) where not coalesce(crossed, false) group by 1, 2),
o as (select it.page_key, it.item, coalesce(l, e0) as a, coalesce(r, e1) as b, l is not null or r is not null as ok from it left join sd using (page_key, item) left join fe on fe.page_key = it.page_key)
select page_key, item, case when ok and b > a then a end as x0, case when ok and b > a then b end as x1 from o""")
def column_bounds(spark, sf_dir):
    tenth, band = F.col("c") % 10, (F.col("page_key") + F.floor(F.col("r") / 10)) % 5
    cells = ink(spark, sf_dir).withColumn("ink", F.when(tenth == 0, (F.col("r") < 26).cast("long")).when(tenth.isin(1, 9) & (band != 0), 0).otherwise(F.col("ink")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_key"), F.explode(F.array(*map(F.lit, range(3)))).alias("item"))
    items = docs.select("page_key", "item", ((F.col("page_key") * 3 + F.col("item") * 11) % 30).alias("x"), (F.col("item") + 4).alias("w"), ((F.col("item") * 15 + F.col("page_key")) % 40).alias("y"), F.lit(8).alias("h"))
    return walks.column_bounds(items, cells, 50)


def _blobs(spark, sf_dir):
    """Cells of two blocks, bridged by a few rows on every second page."""
    r, c = F.col("r"), F.col("c")
    left, right = (r >= 3) & (r < 38) & (c < 15), (r >= 20) & (c >= 24)
    bridge = (F.col("page_key") % 2 == 0) & (r >= 25) & (r < 28)
    return ink(spark, sf_dir).withColumn("ink", (left | right | bridge).cast("long"))


@query()
def picture_candidates(spark, sf_dir):
    """No SQL: necks are cut until none is left; tests hold it against brute force."""
    return walks.picture_candidates(walks.split_at_necks(raster.components(_blobs(spark, sf_dir))), 50, 40)


_ROWS = f"with {INK_SQL}, {_PRINTED}, rd as (select page_key, r, sum(ink) / count(*) as dark from pr group by 1, 2)"


@query(f"""{_ROWS}, i as (select *, r - row_number() over (partition by page_key order by r) as g from rd where dark >= 0.40), k as (select *, count(*) over (partition by page_key, g) as n from i)
select page_key, r from k where n <= 2""")
def thin_rules(spark, sf_dir):
    return raster.thin_rules(raster.row_dark(_printed(spark, sf_dir)), 0.40)


@query(f"{_ROWS} select page_key, avg((dark <= 0.25)::int) as clear from rd group by 1")
def clear_shares(spark, sf_dir):
    return raster.clear_share(raster.row_dark(_printed(spark, sf_dir)), 0.25)


@query(f"""with {INK_SQL}, {_PRINTED}, k as (select page_key, c, avg(ink) < 0.55 as kept from pr group by 1, 2), f as (select page_key, avg(kept::int) < 0.5 as few from k group by 1)
select a.page_key, a.r, avg(a.ink * b.ink) as share from pr a join pr b on a.page_key = b.page_key and a.c = b.c and b.r = least(49, a.r + 4) join k on k.page_key = a.page_key and k.c = a.c join f on f.page_key = a.page_key where kept or few group by 1, 2""")
def row_crossings(spark, sf_dir):
    return raster.row_crossing(_printed(spark, sf_dir), 4)


_ORDER_SQL = """u as (select distinct c_custkey // 2 as family from customer where c_custkey % 5 <> 0),
kp as (select family, row_number() over (order by min(-c_custkey), family) as pos from (select c_custkey // 2 as family, c_custkey from customer where c_custkey % 3 = 0) where family in (select family from u) group by family),
fr as (select family, n + row_number() over (order by md5((20260911 + n)::varchar || ':' || family::varchar), family) as pos from u, (select count(*) as n from kp) where family not in (select family from kp)),
ord as (select * from kp union all select * from fr)"""


def _order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("family"))
    return rows, selection.title_order(rows.where("c_custkey % 3 = 0").select("family", (-F.col("c_custkey")).alias("pos")), rows.where("c_custkey % 5 <> 0").select("family"), 20260911)


@query(f"with {_ORDER_SQL} select family, pos from ord")
def title_order(spark, sf_dir):
    return _order(spark, sf_dir)[1]


@query(f"""with {_ORDER_SQL}, i as (select c_custkey // 2 as family, sum(c_custkey % 7) as n from customer where c_custkey % 4 <> 0 group by 1)
select family, (pos - 1 - s * 2 // 7 + s) % s as place, 3 as pass from ord join i using (family), (select count(*) as s from ord) where family % 6 < least(5, n) and not (family % 4 = 0)""")
def owed_titles(spark, sf_dir):
    rows, order = _order(spark, sf_dir)
    families = rows.select("family").distinct()
    posted = families.where("family % 4 = 0").select("family", F.lit("article").alias("lane"), F.lit(3).alias("pass"))
    return selection.owed_titles(order, rows.where("c_custkey % 4 <> 0").select("family", (F.col("c_custkey") % 7).alias("n")), posted, families.select("family", (F.col("family") % 6).alias("n")), "article", LANES, 3)


@query("""with c as (select o_custkey, o_orderkey, o_orderkey % 5 as box, case when o_custkey % 4 <> 0 then o_custkey % 5 end as want, case when o_orderkey % 3 = 0 then 'no phrase' end as refusal from orders),
r as (select *, row_number() over (partition by o_custkey order by case when refusal is not null then 2 when want is null or box = want then 0 else 1 end, o_orderkey) as k from c)
select o_custkey, case when refusal is null then box end as box, want, refusal from r where k = 1""")
def recut_choices(spark, sf_dir):
    cuts = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("phrase_pos"), (F.col("o_orderkey") % 5).alias("box"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 5).alias("want"), F.when(F.col("o_orderkey") % 3 == 0, "no phrase").alias("refusal"))
    return selection.recut(cuts, ["o_custkey"])


@query("""with p as (select o_custkey as lane, o_orderkey as item, o_orderkey % 3 as family, o_orderkey % 4 as box, case when o_orderkey % 5 = 0 then 'not found' end as refusal, case when o_orderkey % 6 = 0 then 'REFUSE' else 'PASS' end as outcome from orders),
l as (select c_custkey as lane, c_custkey % 3 as f, c_custkey % 2 = 0 as a from customer where c_custkey % 5 <> 0),
t as (select p.*, row_number() over (partition by lane order by item) as try from p left join l using (lane) where not coalesce(a, false) and not coalesce(family = f, false)),
x as (select lane, item, try, case when refusal is not null then 'retry' when outcome = 'REFUSE' then 'drop' when box <> 1 then 'requeue' else 'post' end as action from t where try <= 2),
w as (select *, min(case when action = 'post' then try end) over (partition by lane) as won from x) select lane, item, try, action from w where won is null or try <= won""")
def approved_turns(spark, sf_dir):
    k = F.col("o_orderkey")
    pending = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lane"), k.alias("item"), (k % 3).alias("family"), k.alias("pos"), (k % 4).alias("box"), F.lit(1).cast("long").alias("want"), F.when(k % 5 == 0, "not found").alias("refusal"), F.when(k % 6 == 0, "REFUSE").otherwise("PASS").alias("outcome"))
    c = F.col("c_custkey")
    posts = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(c.alias("lane"), (c % 3).alias("family"), (c % 2 == 0).alias("approved"), c.alias("at"))
    return selection.approved_turn(pending, posts)


@query("""with d as (select o_orderkey, o_orderdate::date as t, case when o_orderkey % 7 = 0 then 'answered' end as r, case when o_orderkey % 3 = 0 then o_orderdate::date + 3 when o_orderkey % 3 = 1 then o_orderdate::date - 3 end as s, case when o_orderkey % 2 = 0 then o_orderdate::date - (o_orderkey % 30)::int end as l from orders)
select o_orderkey, case when r is not null then 'resolved' when coalesce(t < s, false) then 'snoozed' when t < date '1994-01-01' then 'early' when coalesce(t - l < 14, false) then 'recent' else 'due' end as state from d""")
def reminder_states(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    snoozed = F.when(k % 3 == 0, iso(F.date_add(day, 3))).when(k % 3 == 1, iso(F.date_sub(day, 3))).otherwise("soon")
    last = F.when(k % 2 == 0, iso(F.date_sub(day, (k % 30).cast("int"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", decisions.reminder(F.when(k % 7 == 0, "answered"), snoozed, last, iso(day), "1994-01-01").alias("state"))


@query(f"""with {_JUDGED_SQL}, k as (select *, row_number() over (partition by lane, date order by case outcome when 'PASS' then 0 when 'REVIEW' then 1 else 2 end, doc_id) as k from judged where date is not null)
select lane, date, doc_id, outcome from k where k = 1""")
def best_candidates(spark, sf_dir):
    return decisions.best_of(_judged(spark, sf_dir).where("date is not null").drop("reasons"), ["lane", "date"], F.col("doc_id"))


_NOUNS = "map {'headline': 'headline', 'article': 'article', 'ad': 'advertisement', 'market': 'market report', 'classified': 'classified advertisements'}"


@query(rf"""with d as (select doc_id, (['nameplate','headline','article','ad','market','classified','cartoon'])[doc_id % 7 + 1] as lane, coalesce(text, '') as words, 'Page ' || doc_id || '.' as alt, strftime(date '1880-01-01' + (doc_id % 9000)::int, '%B %-d, %Y') as posted from documents),
n as (select *, case when doc_id % 9 = 0 then 'headlines' else {_NOUNS}[lane] end as noun from d),
f as (select *, case when lane = 'cartoon' then alt when lane = 'nameplate' then case when doc_id % 2 = 0 and words <> '' then rtrim(alt, '.') || ', with the top of the page beneath it. A.I.-transcribed, the band beneath reads: “' || words || '”' else alt end
  when words = '' then alt else case when doc_id % 3 = 0 then 'A.I.-transcribed ' || noun else upper(noun[1]) || substr(noun, 2) end || ' from “The Daily,” ' || case when doc_id % 4 = 0 then 'Georgia' else 'Macon, Georgia' end || ', ' || posted || ', page 1, reading: “' || words || '”' || case when doc_id % 5 = 0 then ' Beneath, a picture.' else '' end end as t from n)
select doc_id, case when length(t) <= 1900 then t when lane = 'cartoon' or (lane <> 'nameplate' and doc_id % 5 = 0) then regexp_replace(substr(t, 1, 1899), '\s+$', '') || '…' else regexp_replace(substr(t, 1, 1898), '\s+$', '') || '…”' end as alt from f""")
def alternative_texts(spark, sf_dir):
    k = F.col("doc_id")
    lane = F.element_at(F.array(*map(F.lit, LANES)), (k % 7 + 1).cast("int"))
    date = F.date_format(F.date_add(F.lit("1880-01-01").cast("date"), (k % 9000).cast("int")), "yyyy-MM-dd")
    alt = alt_text(lane, F.concat(F.lit("Page "), k, F.lit(".")), F.col("text"), F.lit("The Daily"), F.when(k % 4 != 0, " Macon"), "Georgia", date, F.lit(1), k % 2 == 0, k % 9 == 0, k % 3 == 0, F.when(k % 5 == 0, " Beneath, a picture."))
    return table(spark, sf_dir, "documents").select("doc_id", alt.alias("alt"))


@query(f"""with {WORDS_SQL}, bx as (select doc_id as page_key, k as box, k * 330 as x0, (k + 1) * 330 as x1, 40 * k as y0, 400 + 40 * k as y1, 15.0 as med from documents, (select unnest([0, 1]) as k)),
bd as (select page_key, box, 1 as band, y0 as top, 160 as bottom from bx union all select page_key, box, 2, 164, y1 from bx),
vr as (select doc_id as page_key, v as x, 0 as y0, 300 + doc_id % 200 as y1 from documents, (select unnest([108, 215, 435, 545]) as v)),
mw as (select w.*, box, band, x0, x1, med from word w join bx using (page_key) join bd using (page_key, box) where x + w / 2.0 >= x0 and x + w / 2.0 < x1 and y + h / 2.0 >= top and y + h / 2.0 < bottom),
ex as (select page_key, box, band, min(y) as a, max(y + h) as b, max(x0) as x0, max(x1) as x1 from mw group by 1, 2, 3),
ct as (select ex.page_key, box, band, vr.x as v from ex join vr using (page_key) where vr.x > x0 + 6 and vr.x < x1 - 6 and least(y1, b) - greatest(y0, a) >= 0.95 * (b - a)),
ok as (select * from ct where not exists (select 1 from mw where mw.page_key = ct.page_key and mw.box = ct.box and mw.band = ct.band and least(v - mw.x, mw.x + mw.w - v) > 3.75)),
cl as (select mw.page_key, mw.box, mw.band, mw.wid, any_value(t) as t, any_value(mw.x) as x, any_value(2 * y + h) as c, count(v) as col from mw left join ok on ok.page_key = mw.page_key and ok.box = mw.box and ok.band = mw.band and v <= mw.x + mw.w / 2.0 group by 1, 2, 3, 4),
ln as (select *, coalesce(c - lag(c) over (partition by page_key, box, band, col order by c, wid) > 15, false)::int as nw from cl),
li as (select *, sum(nw) over (partition by page_key, box, band, col order by c, wid) as line from ln),
pc as (select page_key, box, band, col, string_agg(t, ' ' order by line, x, wid) as p from li group by 1, 2, 3, 4),
en as (select *, case when row_number() over (partition by page_key, box order by band desc, col desc) = 1 or right(p, 1) in ('.', '!', '?', ',', ';', ':', '”', '"') then p else p || '.' end as q from pc),
tx as (select page_key, box, string_agg(q, ' ' order by band, col) as text from en group by 1, 2)
select page_key, box, text from bx left join tx using (page_key, box)""")
def column_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_key"))
    box = F.explode(F.array(F.lit(0), F.lit(1)))
    boxes = docs.withColumn("box", box).select("page_key", "box", (F.col("box") * 330).alias("x0"), (F.col("box") * 330 + 330).alias("x1"), (F.col("box") * 40).alias("y0"), (F.col("box") * 40 + 400).alias("y1"), F.lit(15.0).alias("med"))
    rows = boxes.select("page_key", "box", F.explode(F.array(F.lit(160), F.lit(163))).alias("y"))
    rules = docs.select("page_key", F.explode(F.array(*map(F.lit, (108, 215, 435, 545)))).alias("x"), F.lit(0).alias("y0"), (F.col("page_key") % 200 + 300).alias("y1"))
    return walks.column_text(words(spark, sf_dir), boxes.select("page_key", "box", "x0", "x1", "med"), walks.bands(rows, boxes), rules)


@query("""with bx as (select doc_id as page_key, k as box, k * 300 as x0, k * 300 + 330 as x1, 100 + 50 * k as y1 from documents, (select unnest([0, 1, 2]) as k)),
vr as (select doc_id as page_key, v as x, (doc_id * 7 + v) % 400 as b from documents, (select unnest([108, 215, 435, 545, 700]) as v)),
m as (select page_key, box, count(*) as n, max(x) as v, max(x0) as x0, max(x1) as x1 from bx join vr using (page_key) where x > x0 + 4 and x < x1 - 4 and b > y1 + 60 group by 1, 2)
select page_key, box, x0, v as x1 from m where n = 1 and least(v - x0, x1 - v) >= 0.3 * (x1 - x0)""")
def heading_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_key"))
    boxes = docs.withColumn("box", F.explode(F.array(*map(F.lit, range(3))))).withColumns({"x0": F.col("box") * 300, "x1": F.col("box") * 300 + 330, "y1": F.col("box") * 50 + 100})
    rules = docs.select("page_key", F.explode(F.array(*map(F.lit, (108, 215, 435, 545, 700)))).alias("x")).withColumn("y1", (F.col("page_key") * 7 + F.col("x")) % 400)
    return walks.heading_split(boxes, rules, 1000)
