"""The engine's queries over the given tables, each with SQL that computes the same apart from Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import replies
from folio.functions import text as T
from folio.operators import decisions, layout, raster, selection
from folio.sources.bridge import INK_SQL, WORDS_SQL, ink, table, words

#: The given prose has none of the default vocabulary, so the queries pass words that it has.
CROP, PAGE = ("tion",), ("that", "thin")
MARKERS = ("that", "with", "this", "from")
PERSON, SALE = ("that", "with"), ("from", "this")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _sql_hits(prefixes: tuple[str, ...], of: str = "text") -> str:
    tests = ", ".join(f"case when len(list_filter(toks, lambda w: length(w) >= 4 and starts_with(w, '{p}'))) > 0 then '{p}' end" for p in prefixes)
    return f"list_filter([{tests}], lambda z: z is not null)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lanes = [p[0] for p in decisions.POLICIES]
    rows = docs.select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, lanes)), (F.col("doc_id") % 7 + 1).cast("int")).alias("lane"),
        F.when(F.col("doc_id") % 11 != 0, F.date_format(F.date_add(F.lit("1850-01-01").cast("date"), (F.col("doc_id") % 30000).cast("int")), "yyyy-MM-dd")).alias("date"),
        (F.col("doc_id") % 13 != 0).alias("postable"),
        (F.col("doc_id") % 17 != 0).alias("geometry"),
        T.hits(F.col("text"), CROP).alias("crop"),
        T.hits(F.col("text"), PAGE).alias("page"),
    )
    rows = rows.join(F.broadcast(decisions.policies(spark)), "lane", "left")  # seven rows; a lane without a policy is refused, not lost
    return rows.withColumn("v", decisions.verdict(F.col("page_gate").isNotNull(), F.col("postable"), F.col("date"), F.col("min_date"), F.col("geometry"), F.col("crop"), F.col("page"), F.col("page_gate"))).select("doc_id", "lane", "date", "v.*")


_POLICY_SQL = ", ".join(f"('{a}', {repr(b) if b else 'null'})" for a, b in decisions.POLICIES)
_JUDGED_SQL = f"""
toks as (select *, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as toks from documents),
rows_ as (select doc_id, (['nameplate','headline','article','ad','market','classified','cartoon'])[doc_id % 7 + 1] as lane,
           case when doc_id % 11 <> 0 then strftime(date '1850-01-01' + cast(doc_id % 30000 as integer), '%Y-%m-%d') end as date,
           doc_id % 13 <> 0 as postable, doc_id % 17 <> 0 as geometry, {_sql_hits(CROP)} as crop, {_sql_hits(PAGE)} as page from toks),
pol(lane, min_date) as (values {_POLICY_SQL}),
m as (select *, coalesce(date < min_date, false) as era from rows_ join pol using (lane)),
r as (select *, not postable or date is null or era or not geometry as refuse from m),
judged as (select doc_id, lane, date,
    case when refuse then 'REFUSE' when len(crop) > 0 or len(page) > 0 then 'REVIEW' else 'PASS' end as outcome,
    list_filter([case when not postable then 'no recorded issue' end, case when date is null then 'no issue date' end,
      case when era then 'era gate: starts at ' || min_date end, case when not geometry then 'no confident crop geometry' end,
      case when len(crop) > 0 then 'the crop carries ' || array_to_string(list_sort(crop), ',') end,
      case when len(page) > 0 and not refuse then 'the page carries ' || array_to_string(list_sort(page), ',') end], lambda z: z is not null) as reasons
  from r)
"""


@query(f"with {_JUDGED_SQL} select lane, outcome, count(*) as n from judged group by lane, outcome")
def gate_distribution(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("lane", "outcome").agg(F.count("*").alias("n"))


@query(f"with {_JUDGED_SQL} select doc_id, lane, outcome, array_to_string(reasons, '; ') as reasons, outcome = 'PASS' as postable from judged")
def gate_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "lane", "outcome", F.array_join("reasons", "; ").alias("reasons"), (F.col("outcome") == "PASS").alias("postable"))


@query(f"with {_JUDGED_SQL} select coalesce(substr(date, 1, 3) || '0s', 'undated') as decade, outcome, count(*) as n, grouping(substr(date, 1, 3) || '0s') as total from judged group by grouping sets ((substr(date, 1, 3) || '0s', outcome), (outcome))")
def gate_outcomes_by_decade(spark, sf_dir):
    rows = _judged(spark, sf_dir).withColumn("d", T.decade(F.col("date")))
    return rows.groupingSets([[F.col("d"), F.col("outcome")], [F.col("outcome")]], "d", "outcome").agg(F.count("*").alias("n"), F.grouping("d").cast("long").alias("total")).select(F.coalesce("d", F.lit("undated")).alias("decade"), "outcome", "n", "total")


@query("""with w as (select unnest(regexp_extract_all(coalesce(text, ''), '\\S+')) as t from documents),
n as (select list_reduce(list_concat([''], regexp_extract_all(lower(t), '[a-z]+')), lambda a, b: case when length(b) > length(a) then b else a end) as n from w)
select p as prefix, count(*) as n from n, (values ('tion'), ('that'), ('thin')) v(p) where length(n) >= 4 and starts_with(n, p) group by p""")
def vocab_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(T.blanks(F.col("text"))).alias("t")).select(T.norm(F.col("t")).alias("n")).where(F.length("n") >= 4)
    found = rows.select(F.explode(F.filter(F.array(*map(F.lit, CROP + PAGE)), lambda p: F.startswith(F.col("n"), p))).alias("prefix"))
    return found.groupBy("prefix").agg(F.count("*").alias("n"))


@query(f"""with toks as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as toks from documents)
select doc_id, array_to_string({_sql_hits(CROP + PAGE)}, ',') as hits from toks""")
def vocab_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.hits(F.col("text"), CROP + PAGE), ",").alias("hits"))


@query("""with b as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') as toks from documents)
select doc_id, array_to_string(list_sort(list_concat(list_filter(['that','with','this','from'], lambda w: list_contains(toks, w)),
  case when regexp_matches(coalesce(text, ''), '\\$\\d|\\b\\d+[\\s-]?c(ts|ents?)?\\b|¢') then ['$'] else [] end)), ',') as markers from b""")
def ad_marker_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.ad_markers(F.col("text"), MARKERS), ",").alias("markers"))


@query(r"""with b as (select doc_id, regexp_extract_all(coalesce(text, ''), '\S+') as l from documents)
select doc_id,
  case when len(l) >= 6 then len(list_filter(l, lambda t: length(trim(t, '.,;:!?()[]"''“”‘’-')) >= 2 and 5 * length(regexp_replace(trim(t, '.,;:!?()[]"''“”‘’-'), '\P{L}', '', 'g')) >= 4 * length(trim(t, '.,;:!?()[]"''“”‘’-')))) / len(l) else 0.0 end as legibility,
  case when len(l) >= 1 then len(list_filter(l, lambda t: regexp_matches(t, '\d') and length(regexp_replace(t, '\P{L}', '', 'g')) <= 2)) / len(l) else 0.0 end as tabular
from b""")
def text_shares(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.legibility(F.col("text")).alias("legibility"), T.tabular(F.col("text")).alias("tabular"))


@query(r"""with b as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''’]*'), lambda w: length(w) > 1) as w from documents)
select doc_id, len(w) >= 6 and len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]'))) / greatest(len(w), 1) > 0.45 as described from b""")
def described_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_described(F.col("text")).alias("described"))


@query("""select n_name, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as tag, right(regexp_replace(n_name || ' / ' || r_name, '[^A-Za-z0-9]+', '_', 'g'), 160) as slug
from nation join region on n_regionkey = r_regionkey where regexp_full_match(n_name, '[A-Za-z]+')
union all select n_name, array_to_string(list_transform(regexp_extract_all(n_name, '[A-Za-z]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ''), right(regexp_replace(n_name || ' / ' || r_name, '[^A-Za-z0-9]+', '_', 'g'), 160)
from nation join region on n_regionkey = r_regionkey where not regexp_full_match(n_name, '[A-Za-z]+')""")
def town_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", T.town_tag(F.col("n_name")).alias("tag"), T.slug(F.concat("n_name", F.lit(" / "), F.col("r_name"))).alias("slug"))


@query(r"""with h as (select doc_id, text, left(text, 300) as h from documents),
c as (select *, 300 - strpos(reverse(h), ' .') - 1 as stop, 300 - strpos(reverse(h), ' ') as blank, contains(h, '. ') as s, contains(h, ' ') as b from h),
a as (select *, case when s and stop >= 150 then stop when b and blank > 0 then blank else 300 end as cut from c)
select doc_id, case when length(text) <= 300 then text else regexp_replace(regexp_replace(left(h, cut), '\s+$', ''), '\.+$', '') || '…' end as band from a""")
def cut_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_band(F.col("text")).alias("band"))


_RECORDS = r"""r as (select page_id, 'sn' || lpad(cast(page_id as varchar), 8, '0') as lccn, strftime(date '1880-01-01' + cast(page_id % 9000 as integer), '%Y-%m-%d') as date from pages),
i as (select page_id, case when page_id % 5 = 0 then 'other ' || page_id else 'dlg_ghn_' || lccn || '-' || date || '-ed-' || (page_id % 3 + 1) end as id,
  case when page_id % 4 = 0 then [url, 'https://x.example/lccn/' || lccn || '/' || date || '/ed-' || (page_id % 7) || '/'] when page_id % 4 = 1 then [] else [url] end as shown from r join pages using (page_id)),
u as (select *, list_filter(shown, lambda s: regexp_matches(s, '/lccn/([^/]+)/(\d{4}-\d{2}-\d{2})/ed-(\d+)'))[1] as found from i)"""


@query(rf"""with {_RECORDS} select page_id,
case when found is not null then regexp_extract(found, '/lccn/([^/]+)/(\d{{4}}-\d{{2}}-\d{{2}})/ed-(\d+)', 1) else nullif(regexp_extract(id, '^dlg_ghn_(.+?)-(\d{{4}}-\d{{2}}-\d{{2}})-ed-(\d+)$', 1), '') end as lccn,
case when found is not null then regexp_extract(found, '/lccn/([^/]+)/(\d{{4}}-\d{{2}}-\d{{2}})/ed-(\d+)', 2) else nullif(regexp_extract(id, '^dlg_ghn_(.+?)-(\d{{4}}-\d{{2}}-\d{{2}})-ed-(\d+)$', 2), '') end as date,
cast(case when found is not null then regexp_extract(found, '/ed-(\d+)', 1) else nullif(regexp_extract(id, '^dlg_ghn_(.+?)-ed-(\d+)$', 2), '') end as integer) as ed from u""")
def identify_records(spark, sf_dir):
    key, lccn = F.col("page_id"), F.concat(F.lit("sn"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    date = F.date_format(F.date_add(F.lit("1880-01-01").cast("date"), (key % 9000).cast("int")), "yyyy-MM-dd")
    record = F.when(key % 5 == 0, F.concat(F.lit("other "), key)).otherwise(F.concat(F.lit("dlg_ghn_"), lccn, F.lit("-"), date, F.lit("-ed-"), key % 3 + 1))
    address = F.concat(F.lit("https://x.example/lccn/"), lccn, F.lit("/"), date, F.lit("/ed-"), key % 7, F.lit("/"))
    shown = F.when(key % 4 == 0, F.array("url", address)).when(key % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("url"))
    found = replies.identify(record, shown)
    return table(spark, sf_dir, "pages").select("page_id", found["lccn"].alias("lccn"), found["date"].alias("date"), found["ed"].alias("ed"))


@query("""select c_custkey, count(o_orderkey) as issues, min(strftime(o_orderdate, '%Y-%m-%d')) as first, max(strftime(o_orderdate, '%Y-%m-%d')) as last,
case when count(o_orderkey) > 0 then 'yes' else 'no' end as postable from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def roster_rights_join(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    rows = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("issues"), iso("a").alias("first"), iso("b").alias("last"), F.when(F.col("n") > 0, "yes").otherwise("no").alias("postable"))


@query("select distinct o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def rights_orphans(spark, sf_dir):
    roster = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(roster, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_custkey").distinct()


@query("""select distinct o_custkey as title, strftime(o_orderdate, '%Y-%m-%d') as date from orders
where strftime(o_orderdate, '%Y-%m-%d') < '1998-01-01' and exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)""")
def issue_distinct_semijoin(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).where("date < '1998-01-01'")
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("title"))
    return rows.join(good, "title", "left_semi").distinct()


@query("""select o_custkey as title, count(*) / (max(year(o_orderdate)) - min(year(o_orderdate)) + 1) as per_year from orders group by o_custkey
having count(*) / (max(year(o_orderdate)) - min(year(o_orderdate)) + 1) >= 2""")
def dailies(spark, sf_dir):
    years = F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate")) + 1
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("title")).agg((F.count("*") / years).alias("per_year")).where("per_year >= 2")


@query(f"""select lane, count(*) as issues, count(distinct o_custkey) as titles from orders, (values {_POLICY_SQL}) p(lane, min_date)
where min_date is null or strftime(o_orderdate - interval 100 year, '%Y-%m-%d') >= min_date group by lane""")
def policy_eligible(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.date_format(F.add_months("o_orderdate", -1200), "yyyy-MM-dd").alias("date"))
    met = rows.join(F.broadcast(decisions.policies(spark)), F.col("min_date").isNull() | (F.col("date") >= F.col("min_date")))  # seven rows
    return met.groupBy("lane").agg(F.count("*").alias("issues"), F.countDistinct("o_custkey").alias("titles"))


@query("select c_custkey, row_number() over (partition by c_nationkey order by md5('title:1:ad:' || c_custkey), c_custkey) as pos, c_nationkey as family from customer")
def seeded_order(spark, sf_dir):
    w = W.partitionBy("c_nationkey").orderBy(selection.seeded("title:1:ad", F.col("c_custkey")), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("pos"), F.col("c_nationkey").alias("family"))


@query("select o_orderkey from orders order by md5('20260826:' || o_orderkey), o_orderkey limit 120")
def sample_n(spark, sf_dir):
    return selection.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "20260826", "o_orderkey", 120)


@query("""with o as (select n_nationkey, row_number() over (order by md5('order:' || n_nationkey)) - 1 as pos, count(*) over () as n from nation)
select lane, n_nationkey, ((pos - (lane * n) // 7) % n + n) % n as turn from o, (select unnest(range(7)) as lane)""")
def title_rotation(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.row_number().over(W.orderBy(selection.seeded("order", F.col("n_nationkey")))) - 1).cast("long").alias("pos"), F.count("*").over(W.partitionBy()).alias("n"))
    rows = rows.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return rows.select("lane", "n_nationkey", F.pmod(F.col("pos") - F.floor(F.col("lane") * F.col("n") / 7), F.col("n")).alias("turn"))


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1""")
def latest_decision(spark, sf_dir):
    return selection.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""with l as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type in ('view', 'click')) where k = 1 and event_type = 'click')
select user_id, event_id from l where user_id not in (select user_id from events where event_type = 'purchase' and event_id % 7 = 0) and user_id not in (select user_id from events where event_type = 'error' and event_id % 7 = 0)""")
def approved_pending(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    last = selection.latest(log.where(F.col("event_type").isin("view", "click")), ["user_id"], [F.desc("ts"), F.desc("event_id")]).where("event_type = 'click'")
    for done in ("purchase", "error"):
        last = last.join(log.where((F.col("event_type") == done) & (F.col("event_id") % 7 == 0)).select("user_id"), "user_id", "left_anti")
    return last.select("user_id", "event_id")


@query("""select event_type, user_id, event_id, k from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 30""")
def recent_window(spark, sf_dir):
    return selection.top_per(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 30, "k").select("event_type", "user_id", "event_id", F.col("k").cast("long").alias("k"))


@query(f"""with {WORDS_SQL}, s as (select page_key, list_sort(list(h)) as hs, median(h) as m from word where h > 0 group by page_key)
select page_key, m as median_h, hs[len(hs) // 2 + 1] as upper_half, hs[len(hs) // 10 + 1] as upper_tenth, hs[len(hs) // 20 + 1] as upper_twentieth from s""")
def page_medians(spark, sf_dir):
    return layout.page_medians(words(spark, sf_dir))


@query(f"""with {WORDS_SQL}, p as (select page_key, median(h) filter (h > 0) as m, max(y + h) as ph from word group by page_key)
select page_key, wid, x, y, w, h, t from word join p using (page_key) where h >= greatest(ph * 0.012, 2.0 * m) and y <= ph * 0.09""")
def display_words(spark, sf_dir):
    return layout.display_words(words(spark, sf_dir))


_BANDS = f"""{WORDS_SQL}, p as (select page_key, max(y + h) as ph, count(*) as words from word group by page_key),
e as (select *, unnest(range(40)) as band from p), n as (select page_key, y * 40 // ph as band, count(*) as n from word join p using (page_key) group by 1, 2),
b as (select e.page_key, e.band, ph, words, coalesce(n, 0) as n from e left join n on e.page_key = n.page_key and e.band = n.band)"""


@query(f"with {_BANDS} select page_key, band, n from b")
def word_density(spark, sf_dir):
    return layout.density(words(spark, sf_dir)).select("page_key", "band", "n")


@query(f"""with {_BANDS}, d as (select *, n >= 3 and n * 40 >= words as d, lead(n >= 3 and n * 40 >= words) over (partition by page_key order by band) as nxt from b)
select page_key, min(case when d and coalesce(nxt, false) then band end) * max(ph) / 40 as body_y from d group by page_key""")
def body_starts(spark, sf_dir):
    return layout.body_start(layout.density(words(spark, sf_dir)))


@query(f"""with {WORDS_SQL}, m as (select *, y >= max(y + h) over (partition by page_key order by y, x, wid rows between unbounded preceding and 1 preceding) as nw from word)
select page_key, wid, sum(coalesce(nw::int, 0)) over (partition by page_key order by y, x, wid) as group_id from m""")
def y_overlap_groups(spark, sf_dir):
    return layout.overlap_groups(words(spark, sf_dir)).select("page_key", "wid", "group_id")


@query(f"""with {WORDS_SQL}, m as (select *, wid // 8 as line, lag(x + w) over k as e, lag(h) over k as lh from word window k as (partition by page_key, wid // 8 order by x, wid))
select page_key, line, wid, sum(coalesce(((x - e) * 10 > 12 * greatest(h, lh))::int, 0)) over (partition by page_key, line order by x, wid) as piece from m""")
def gap_pieces(spark, sf_dir):
    return layout.gap_pieces(words(spark, sf_dir), F.floor(F.col("wid") / 8)).select("page_key", "line", "wid", "piece")


_GRID = f"""{WORDS_SQL}, p as (select page_key, min(x) as x0, min(y) as y0, max(x + w) as x1, max(y + h) as y1 from word group by page_key),
g as (select page_key, t, ((2 * x + w - 2 * x0) * 6) // (2 * (x1 - x0)) as gx, ((2 * y + h - 2 * y0) * 6) // (2 * (y1 - y0)) as gy from word join p using (page_key))"""


@query(f"with {_GRID} select page_key, gx, gy, count(*) as n from g group by 1, 2, 3")
def words_in_grid(spark, sf_dir):
    return layout.grid_counts(words(spark, sf_dir)).groupBy("page_key", "gx", "gy").agg(F.count("*").alias("n"))


@query(f"""with {_GRID} select page_key, gx, gy from g group by 1, 2, 3
having max(starts_with(lower(t), 'that') or starts_with(lower(t), 'with')) and max(starts_with(lower(t), 'from') or starts_with(lower(t), 'this'))""")
def cooccurrence_blocks(spark, sf_dir):
    some = lambda terms: F.max(F.lower("t").rlike("^(" + "|".join(terms) + ")"))
    return layout.grid_counts(words(spark, sf_dir)).groupBy("page_key", "gx", "gy").agg(some(PERSON).alias("p"), some(SALE).alias("s")).where("p and s").select("page_key", "gx", "gy")


@query(f"""with {WORDS_SQL}, n as (select page_key, wid, list_reduce(list_concat([''], regexp_extract_all(lower(t), '[a-z]+')), lambda a, b: case when length(b) > length(a) then b else a end) as n from word),
l as (select *, lead(n) over (partition by page_key order by wid) as m from n)
select page_key, min(wid) as pos from l where starts_with(n, 'of') and starts_with(m, 'th') group by page_key""")
def phrase_hits(spark, sf_dir):
    return layout.phrase_hits(words(spark, sf_dir), T.norm(F.col("t")), ("of", "th"))


@query(f"""with {_GRID}, j as (select page_key, gx, gy, max(starts_with(lower(t), 'tion')) as hit from g group by 1, 2, 3),
d as (select page_key, concat(cast(185 + page_key % 8 as varchar), '0s') as decade, max(hit) as page_hit, count(*) as crops, sum(hit::int) as crop_hits from j group by page_key)
select coalesce(decade, 'all') as decade, count(*) as pages, sum(page_hit::int) as pages_hit, sum(crops) as crops, sum(crop_hits) as crops_hit, sum(crop_hits) / sum(crops) as rate from d group by grouping sets ((decade), ())""")
def crop_rate_by_decade(spark, sf_dir):
    crops = layout.grid_counts(words(spark, sf_dir)).groupBy("page_key", "gx", "gy").agg(F.max(F.startswith(F.lower("t"), F.lit("tion"))).cast("long").alias("hit"))
    pages = crops.groupBy("page_key").agg(F.max("hit").alias("page_hit"), F.count("*").alias("crops"), F.sum("hit").alias("crop_hits")).withColumn("d", F.concat((185 + F.col("page_key") % 8).cast("string"), F.lit("0s")))
    out = pages.groupingSets([[F.col("d")], []], "d").agg(F.count("*").alias("pages"), F.sum("page_hit").alias("pages_hit"), F.sum("crops").alias("crops"), F.sum("crop_hits").alias("crops_hit"), (F.sum("crop_hits") / F.sum("crops")).alias("rate"))
    return out.select(F.coalesce("d", F.lit("all")).alias("decade"), "pages", "pages_hit", "crops", "crops_hit", "rate")


def _folded_sql(tenths: int) -> str:
    """Words by page in order, and the rows that a fold over them makes: the state is the row's first word and the rows so far."""
    state = "{'y': v.y, 'h': v.h, 'rows': [0::bigint]}"
    far = f"abs(b.y - a.y) * 10 > {tenths} * greatest(a.h, b.h)"
    return f"""ord as (select page_key, list({{'wid': wid, 'x': x, 'y': y, 'h': h, 't': t}} order by y, x, wid) as ws from word group by 1),
fold as (select page_key, ws, list_reduce(list_transform(ws, lambda v: {state}), lambda a, b: case when {far}
  then {{'y': b.y, 'h': b.h, 'rows': list_append(a.rows, a.rows[len(a.rows)] + 1)}} else {{'y': a.y, 'h': a.h, 'rows': list_append(a.rows, a.rows[len(a.rows)])}} end) as f from ord),
folded as (select page_key, unnest(ws, recursive := false) as v, unnest(f.rows) as row_id from fold)"""


@query(f"with {WORDS_SQL}, {_folded_sql(6)} select page_key, v.wid as wid, row_id from folded")
def rows_anchor(spark, sf_dir):
    return layout.rows_anchor(words(spark, sf_dir))


@query(f"with {WORDS_SQL}, {_folded_sql(5)} select page_key, string_agg(v.t, ' ' order by row_id, v.x, v.wid) as text from folded group by 1")
def reading_text(spark, sf_dir):
    rows = words(spark, sf_dir)
    return layout.reading_text(rows, layout.rows_anchor(rows, 5))


@query(f"""with {INK_SQL}, d as (select page_key, r, sum(ink) / count(*) as dark from cell group by 1, 2)
select page_key, min(r) as x0, max(r) as x1 from (select page_key, r, r - row_number() over (partition by page_key order by r) as k from d where dark >= 0.4) group by page_key, k having count(*) >= 2""")
def gutter_runs(spark, sf_dir):
    return raster.runs(raster.row_dark(ink(spark, sf_dir)), "r", F.col("dark") >= 0.4, 2)


@query(f"""with {INK_SQL}, m as (select *, c - lag(c) over (partition by page_key, r order by c) - 1 > 1 as nw from cell where ink = 1),
i as (select *, sum(coalesce(nw::int, 0)) over (partition by page_key, r order by c) as k from m)
select page_key, r, max(s) as span from (select page_key, r, k, max(c) - min(c) + 1 as s from i group by 1, 2, 3) group by 1, 2""")
def row_spans(spark, sf_dir):
    return raster.row_span(ink(spark, sf_dir))


@query(f"""with {INK_SQL}, o as (select i, j from (select unnest(range(-1, 2)) as i), (select unnest(range(-1, 2)) as j) where i <> 0 or j <> 0),
n as (select page_key, r + i as r, c + j as c, count(*) as n from cell, o where ink = 1 group by 1, 2, 3)
select page_key, sum(greatest(ink, case when coalesce(n, 0) >= 5 then 1 else 0 end)) as inked from cell left join n using (page_key, r, c) group by page_key""")
def cell_closing(spark, sf_dir):
    return raster.close_cells(ink(spark, sf_dir)).groupBy("page_key").agg(F.sum("ink").alias("inked"))
