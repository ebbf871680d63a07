"""Queries over replies, titles, blocks, rasters and selection; registered with those of slate."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import replies as R
from folio.functions import text as T
from folio.operators import decisions, layout, pages, raster, selection
from folio.plans.slate import _JUDGED_SQL, ORACLES, QUERIES, _judged, query  # noqa: F401
from folio.sources import archive
from folio.sources.bridge import INK_SQL, WORDS_SQL, ink, table, word_columns, words

LANES = tuple(p[0] for p in decisions.POLICIES)


def _docs(spark, sf_dir, **columns):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in columns.items()])


@query(r"""select doc_id, trim(trim(trim(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '"')) as cleaned from documents""")
def cleaned_replies(spark, sf_dir):
    return _docs(spark, sf_dir, cleaned=R.clean(F.col("text")))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(trim(trim(regexp_replace(x, '\s+', ' ', 'g')), '"'))), lambda x: x <> '') as l from documents)
select doc_id, len(l) as n, array_to_string(list_transform(l, lambda x: case when regexp_matches(x, '[.!?…]$') then x else x || '.' end), ' ') as joined from l""")
def reply_items(spark, sf_dir):
    items = R.items_of(F.col("text"))
    return _docs(spark, sf_dir, n=F.size(items).cast("long"), joined=R.join_items(items))


@query()
def reply_blocks(spark, sf_dir):
    """No SQL: hyphens are rejoined by a fold within and across blocks; tests hold it against cases and brute force."""
    return _docs(spark, sf_dir, blocks=F.array_join(R.blocks_of(F.col("text")), "\n"))


@query(r"""select doc_id, regexp_replace(regexp_replace(text, '([A-Za-z])- ([A-Za-z])', '\1\2', 'g'), '([A-Za-z])- ([A-Za-z])', '\1\2', 'g') as joined from documents""")
def broken_words(spark, sf_dir):
    return _docs(spark, sf_dir, joined=R.join_broken_words(F.col("text")))


@query(r"""with d as (select doc_id, replace(regexp_replace(coalesce(text, ''), '(^|[\s(\[])"', '\1“', 'g'), '"', '”') as t from documents)
select doc_id, replace(regexp_replace(t, '(^|[\s(\[])''', '\1‘', 'g'), '''', '’') as curled from d""")
def curled_quotes(spark, sf_dir):
    return _docs(spark, sf_dir, curled=R.curl(F.col("text")))


@query()
def reply_refusals(spark, sf_dir):
    """No SQL: word boundaries beside accented letters differ between the engines; tests use the named cases."""
    # Tokens are a column of their own, or each of these would find them again. Documents are dealt first: a file of one row group is read by one task.
    t, words = F.col("text"), F.col("words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    docs = docs.select("doc_id", "text", T.tokens(t).alias("words"))
    check = R.check_transcription(t, False, 4, ("that", "thin"), words)
    return docs.select("doc_id", check["refusal"].alias("refusal"), F.array_join(check["hits"], ",").alias("hits"), R.is_commentary(t).alias("commentary"), R.story_shape(t, words).alias("shape"), R.own_title(t, F.lit("The Daily Journal"), words).alias("own"), F.array_join(R.review_words(t), ",").alias("review"))


@query(r"""with w as (select p_partkey, string_split(p_name || ' of the ' || lower(p_type) || '-' || lower(p_brand) || '.', ' ') as w from part)
select p_partkey, array_to_string(list_transform(w, lambda x, i: case when i > 1 and list_contains(['a','an','and','the','of','for','on','in','at','to','by','or','&','de','la'], lower(x)) then lower(x)
  else array_to_string(list_transform(string_split(case when i = len(w) then rtrim(x, '.') else x end, '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '-') end), ' ') as title from w""")
def display_titles(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" of the "), F.lower("p_type"), F.lit("-"), F.lower("p_brand"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", R.display_title(raw).alias("title"))


@query("""select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') as posted, 'sn' || lpad(cast(o_custkey as varchar), 8, '0') || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':nameplate' as key, true as valid from orders""")
def issue_keys(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    lccn = F.concat(F.lit("sn"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.post_date(iso).alias("posted"), R.item_key(lccn, R.compact_date(F.date_format("o_orderdate", "yyyyMMdd")), F.lit(None).cast("string")).alias("key"), R.valid_ident(lccn, iso).alias("valid"))


@query(f"with {WORDS_SQL} select page_key, t, x, y, w, h from word")
def coordinates_flattened(spark, sf_dir):
    """Word boxes written as the archive's JSON, a key per word with all its boxes, and read back; a page bounds each group."""
    boxes = words(spark, sf_dir).groupBy("page_key", "t").agg(F.collect_list(F.array(*[F.col(c).cast("string") for c in "xywh"])).alias("b"))
    page = boxes.groupBy("page_key").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("t", "b"))).alias("coords"))).alias("json"))
    return archive.coordinates(page, "page_key", F.col("json"))


@query()
def reading_rows(spark, sf_dir):
    """No SQL: a fold with a drop initial's state; tests hold it against cases."""
    return pages.reading_order(words(spark, sf_dir))


@query()
def nameplate_boxes(spark, sf_dir):
    """No SQL: the rows of the cluster come from an anchor fold."""
    return pages.nameplates(words(spark, sf_dir))


@query()
def display_pieces(spark, sf_dir):
    """No SQL: as nameplate_boxes."""
    return pages.display_rows(words(spark, sf_dir))


_LINES = f"""{WORDS_SQL}, c as (select *, 2 * y + h as c, (2 * y + h) - lag(2 * y + h) over (partition by page_key order by 2 * y + h, x, wid) > 15.0 as nw from word),
n as (select *, sum(coalesce(nw::int, 0)) over (partition by page_key order by c, x, wid) as line from c),
lines as (select page_key, line, min(y) as top, max(y + h) as bottom, max(h) as tall from n group by 1, 2)"""


@query(f"with {_LINES} select page_key, line, top, bottom, tall from lines")
def centre_lines(spark, sf_dir):
    return pages.spread_lines(words(spark, sf_dir), F.lit(15.0)).drop("med")


@query(f"""with {_LINES}, r as (select *, sum(case when tall <= 1.3 * 15.0 then 1 else 0 end) over (partition by page_key order by line rows between 2 preceding and current row) as run from lines)
select page_key, arg_min(bottom, line) as bottom from r where run = 3 group by page_key""")
def story_starts(spark, sf_dir):
    return pages.story_start(pages.spread_lines(words(spark, sf_dir), F.lit(15.0)))


def _blocks(spark, sf_dir, display: bool, most: float):
    rows = F.transform("rows", lambda v: F.struct(*[v[c].alias(c) for c in ("row", "top", "bottom", "tall")], F.lit(15.0).alias("med"), (v["row"] % 29 == 28).alias("rule_above")))
    columns = word_columns(spark, sf_dir).withColumn("rows", rows)
    return pages.blocks_in(columns.withColumn("seed", pages.nearest_in(F.col("rows"), F.col("page_h") / 2)), display, most)


def _blocks_sql(display: bool, most: float) -> str:
    def why(gap, rule, away, grace, beyond, name):
        mid = "" if display else f" when tall >= 24 then 'display-boundary' when {gap} > 19.5 and {grace} then 'paragraph-gap' when {away} > 80 then 'row-count-cap'"
        return f"case when {gap} > 2.2 * 15.0{' and not tall >= 24' if display else ''} then 'gap' when {rule} then 'rule'{mid} when {beyond} then '{name}' end"

    ratio = lambda w, g: f"case {w} when 'gap' then ({g} - 2.2 * 15.0) / (2.2 * 15.0) when 'paragraph-gap' then ({g} - 1.3 * 15.0) / (1.3 * 15.0) end"
    return f"""with {WORDS_SQL}, b as (select page_key, wid % 8 as col, wid // 8 as row, y as top, y + h as bottom, h as tall, max(y + h) over (partition by page_key) as page_h, (wid // 8) % 29 = 28 as ru from word),
s as (select page_key, col, arg_min(row, struct_pack(a := abs(top + tall / 2 - page_h / 2), r := row)) as seed from b group by 1, 2),
g as (select *, lead(top) over w - bottom as ug, top - lag(bottom) over w as dg, coalesce(lead(ru) over w, false) as ur, max(case when row = seed then bottom end) over (partition by page_key, col) as sb
      from b join s using (page_key, col) window w as (partition by page_key, col order by row)),
u as (select *, case when row < seed then {why('ug', 'ur', 'seed - row', 'true', f'sb - top > {most} * page_h', 'refused')} end as up from g),
l as (select *, coalesce(max(case when up is not null then row end) over (partition by page_key, col) + 1, 0) as lo from u),
t as (select *, max(case when row = lo then top end) over (partition by page_key, col) as lt from l),
d as (select *, case when row > seed then {why('dg', 'ru', 'row - seed', 'row - seed > 3', f'bottom - lt > {most} * page_h', 'cap')} end as down from t),
h as (select *, coalesce(min(case when down is not null then row end) over (partition by page_key, col) - 1, max(row) over (partition by page_key, col)) as hi from d),
o as (select page_key, col, max(lt) as top, max(case when row = hi then bottom end) as bottom, max(hi) - max(lo) + 1 as rows, max(page_h) as page_h,
  max(case when row = lo - 1 then up end) as top_reason, max(case when row = lo - 1 then {ratio('up', 'ug')} end) as top_ratio, max(case when row = hi + 1 then down end) as bottom_reason, max(case when row = hi + 1 then {ratio('down', 'dg')} end) as bottom_ratio from h group by 1, 2)
select page_key, col, top, bottom, rows, top_reason, top_ratio, bottom_reason, bottom_ratio,
  case when top_reason = 'refused' then 'too tall' when rows < 4 or bottom - top < 0.015 * page_h then 'too small' else 'ok' end as outcome from o"""


@query(_blocks_sql(True, 0.25))
def ad_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, True, 0.25)


@query(_blocks_sql(False, 0.40))
def market_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir, False, 0.40)


@query(f"""with k as ({_blocks_sql(True, 0.25)}), f as (select outcome, (bottom_reason = 'gap' and bottom_ratio < 0.15) or (top_reason = 'gap' and top_ratio < 0.15) as bad from k)
select case when outcome <> 'ok' then 'not checked' when coalesce(bad, false) then 'flagged' else 'clean' end as status, count(*) as n from f group by 1""")
def closure_audit(spark, sf_dir):
    rows = pages.margins(_blocks(spark, sf_dir, True, 0.25))
    status = F.when(F.col("margins").isNull(), "not checked").when(F.size(R.flags(F.col("margins"))) > 0, "flagged").otherwise("clean")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_SCALED = f"""with {WORDS_SQL}, p as (select page_key, max(x + w) as pw, max(y + h) as ph from word group by 1),
e as (select page_key, wid, pw, ph, greatest(0, round_even(x * 2.5, 0)::bigint) as x0, greatest(0, round_even(y * 2.5, 0)::bigint) as y0, least(2000, round_even((x + w) * 2.5, 0)::bigint) as x1, least(ph * 2, round_even((y + h) * 2.5, 0)::bigint) as y1,
  greatest(0, x - trunc(pw * 0.02)::bigint) as lx, greatest(0, y - trunc(ph * 0.015)::bigint) as ly, least(pw, x + w + trunc(pw * 0.02)::bigint) as lr, least(ph, y + h + trunc(ph * 0.015)::bigint) as lb from word join p using (page_key))"""


@query(f"""{_SCALED} select page_key, wid, case when x1 > x0 and y1 > y0 then concat_ws(',', x0, y0, x1 - x0, y1 - y0) end as image_box, concat_ws(',', lx, ly, lr - lx, lb - ly) as loose_box from e""")
def scaled_boxes(spark, sf_dir):
    rows = words(spark, sf_dir)
    met = rows.join(rows.groupBy("page_key").agg(F.max(F.col("x") + F.col("w")).alias("pw"), F.max(F.col("y") + F.col("h")).alias("ph")), "page_key")
    met = pages.image_edges(met, 2.5, F.lit(2000), F.col("ph") * 2)
    image = F.when(F.col("image_x").isNotNull(), F.concat_ws(",", "image_x", "image_y", "image_w", "image_h"))
    loose = pages.loosen(*[F.col(c) for c in "xywh"], F.col("pw"), F.col("ph"), 0.02, 0.015)
    return met.select("page_key", "wid", image.alias("image_box"), F.concat_ws(",", *[loose[c] for c in "xywh"]).alias("loose_box"))


def _printed(spark, sf_dir):
    """The painted cells with a rule down half of every tenth column and paper beside it."""
    tenth = F.col("c") % 10
    return ink(spark, sf_dir).withColumn("ink", F.when(tenth == 0, (F.col("r") < 26).cast("long")).when(tenth.isin(1, 9), 0).otherwise(F.col("ink")))


_PRINTED = "pr as (select page_key, r, c, case when c % 10 = 0 then (r < 26)::int when c % 10 in (1, 9) then 0 else ink end as ink from cell)"
_DARK = f"{INK_SQL}, {_PRINTED}, cd as (select page_key, c, sum(ink) / count(*) as dark from pr where r % 2 = 0 group by 1, 2), fe as (select page_key, coalesce(min(case when dark <= 0.55 then c end), 40) as x0, coalesce(max(case when dark <= 0.55 then c end) + 1, 40) as x1 from cd group by 1)"


@query(f"""with {_DARK}, k as (select page_key, c, case when dark <= 0.10 then 'paper' when dark >= 0.45 then 'rule' end as kind from cd join fe using (page_key) where c >= x0 and c < x1),
i as (select *, c - row_number() over (partition by page_key, kind order by c) as g from k where kind is not null)
select page_key, kind, min(c) as x0, max(c) + 1 as x1 from i group by page_key, kind, g having kind = 'rule' or count(*) >= 2""")
def page_gutters(spark, sf_dir):
    return raster.gutters(raster.col_dark(_printed(spark, sf_dir)))


@query(f"with {_DARK} select page_key, x0, x1 from fe")
def film_edges(spark, sf_dir):
    return raster.film_edges(raster.col_dark(_printed(spark, sf_dir)))


@query(f"""with {_DARK}, m as (select page_key, c, r, r - lag(r) over (partition by page_key, c order by r) - 1 > 2 as nw from pr join cd using (page_key, c) where ink = 1 and dark <= 0.55),
i as (select *, sum(coalesce(nw::int, 0)) over (partition by page_key, c order by r) as k from m),
s as (select page_key, c, k, min(r) as y0, max(r) + case when 49 - max(r) <= 2 then 1 else 0 end as y1 from i group by 1, 2, 3),
b as (select * from (select *, row_number() over (partition by page_key, c order by y1 - y0 desc, y0) as o from s) where o = 1 and y1 - y0 >= 25),
j as (select *, c - lag(c) over (partition by page_key order by c) > 2 as nw from b), n as (select *, sum(coalesce(nw::int, 0)) over (partition by page_key order by c) as g from j)
select page_key, cast(floor(avg(c)) as bigint) as x, min(y0) as y0, max(y1) as y1 from n group by page_key, g""")
def vertical_rules(spark, sf_dir):
    return raster.vrules(_printed(spark, sf_dir), 50, 0.5)


@query()
def cell_components(spark, sf_dir):
    """No SQL at this size: labels spread step by step; tests hold it against brute force."""
    return raster.component_stats(raster.components(_printed(spark, sf_dir)))


_POSTED = "(select ts, event_id, (['nameplate','headline','article','ad','market','classified','cartoon','held'])[event_id % 8 + 1] as lane from events where event_type = 'purchase')"


@query(f"""with p as {_POSTED}, o as (select count(*) as n, arg_max(lane, struct_pack(a := ts, b := event_id)) as last from p), l as (select ['nameplate','headline','article','ad','market','classified','cartoon'] as l)
select l[case when list_position(l, last) > 0 then list_position(l, last) else n end % 7 + 1] as lane from o, l""")
def lane_rotation(spark, sf_dir):
    lane = F.element_at(F.array(*map(F.lit, (*LANES, "held"))), (F.col("event_id") % 8 + 1).cast("int"))
    return selection.next_lane(table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("lane", lane), LANES, [F.col("ts"), F.col("event_id")])


@query(f"""with {_JUDGED_SQL}, p as (select *, row_number() over (partition by lane order by md5('choose:' || doc_id), doc_id) as pos from judged), w as (select *, min(case when outcome = 'PASS' then pos end) over (partition by lane) as won from p where pos <= 40)
select lane, doc_id, pos, outcome, coalesce(pos = won, false) as chosen from w where won is null or pos <= won""")
def chosen_candidates(spark, sf_dir):
    rows = selection.first_pass(_judged(spark, sf_dir), ["lane"], [selection.seeded("choose", F.col("doc_id")), F.col("doc_id")], 40)
    return rows.select("lane", "doc_id", F.col("pos").cast("long").alias("pos"), "outcome", "chosen")


_PHRASES = ("that", "with", "from")


def _phrases_sql() -> str:
    """One step a phrase: its hits that no phrase before took, by whole decades until the cap is reached."""
    steps = ["d as (select doc_id, doc_id % 8 as decade, lower(coalesce(text, '')) as t from documents)"]
    for k, phrase in enumerate(_PHRASES):
        left = "".join(f" and doc_id not in (select doc_id from t{j})" for j in range(k))
        steps.append(f"h{k} as (select * from d where contains(t, '{phrase}'){left})")
        steps.append(f"k{k} as (select decade from (select decade, coalesce(sum(count(*)) over (order by decade rows between unbounded preceding and 1 preceding), 0) as b from h{k} group by decade) where b < 200)")
        steps.append(f"t{k} as (select doc_id, '{phrase}' as phrase, decade from h{k} semi join k{k} using (decade))")
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select * from t{k}" for k in range(len(_PHRASES)))


@query(_phrases_sql())
def phrase_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = F.filter(F.array(*map(F.lit, _PHRASES)), lambda p: F.contains(F.lower(F.coalesce("text", F.lit(""))), p))
    hits = docs.select("doc_id", (F.col("doc_id") % 8).alias("decade"), F.col("doc_id").alias("rank"), F.explode(found).alias("phrase"))
    return selection.search_candidates(hits, ["doc_id"], list(_PHRASES), 200)


@query("""select event_id, event_type as lane from events where event_type in ('click', 'view') and event_id % 5 <> 0 and ts >= timestamp '2024-02-01 00:00:00' - interval 7 day""")
def recent_posts(spark, sf_dir):
    at = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("lane"), at.alias("at"))
    return selection.recent(rows, "2024-02-01 00:00:00", 7, ("click", "view")).select("event_id", "lane")
