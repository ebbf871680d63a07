"""The desk's smaller operators: families, tries, searches, reports, gates and the order of what is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import blanks, norm

# Fixed values.
WIDTH_SLACK, LEAST_ASPECT = 3, 2.5


def canonical(rows: DataFrame, families: DataFrame, key: str) -> DataFrame:
    """Rows with ``family``: the canonical id of (member, canonical), each member once, or the key itself."""
    return rows.join(families.select(F.col("member").alias(key), F.col("canonical").alias("family")), key, "left").withColumn("family", F.coalesce("family", key))


def tried_phrase(posts: DataFrame, tried: DataFrame, keys: list[str]) -> DataFrame:
    """Posts with the phrase by which each was found; null where none was tried."""
    return posts.join(tried.select(*keys, "phrase"), keys, "left")


def titles_with(titles: DataFrame, name: str, prefixes: dict[str, tuple[str, ...]]) -> DataFrame:
    """(vocabulary, titles, carrying): how many titles have a token of four letters or more that begins with a prefix of each vocabulary."""
    words = F.filter(F.transform(blanks(F.col(name)), norm), lambda w: F.length(w) >= 4)
    has = lambda some: F.exists(words, lambda w: F.exists(F.array(*map(F.lit, some)), lambda p: F.startswith(w, p)))
    counts = titles.agg(F.count("*").alias("titles"), *[F.count_if(has(some)).alias(k) for k, some in prefixes.items()])
    return counts.select(F.expr(f"stack({len(prefixes)}, {', '.join(f"'{k}', titles, {k}" for k in prefixes)}) as (vocabulary, titles, carrying)"))


def post_status(posts: DataFrame, now: int) -> DataFrame:
    """One row: posts in all and of this pass, and the last one by (at, id)."""
    return posts.agg(F.count("*").alias("posted"), F.count_if(F.coalesce(F.col("pass") == now, F.lit(False))).alias("this_pass"), F.max_by("id", F.struct("at", "id")).alias("last"))


def search(pages: DataFrame, phrase: str, first: str, last: str, sequence: int | None = None) -> DataFrame:
    """Pages(text, date, sequence, ...) that carry the phrase between two dates, with ``total``, how many there are; both ends count."""
    found = pages.where(F.col("date").between(first, last) & F.contains(F.lower("text"), F.lit(phrase.lower())))
    if sequence is not None:
        found = found.where(F.col("sequence") == sequence)
    return found.withColumn("total", found.agg(F.count("*")).scalar())


def roster(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Titles with the first of their details' cities; an empty or missing title is the list's label."""
    rows = listed.join(details, key, "left")
    return rows.select(key, F.coalesce(F.nullif("title", F.lit("")), F.col("label")).alias("title"), F.try_element_at("cities", F.lit(1)).alias("city"))


def shape_gate(width: Column, height: Column, wanted: Column) -> Column:
    """Null for a strip of the wanted width; else 'width' or 'shape'."""
    bad = (height <= 0) | (width < LEAST_ASPECT * height)
    return F.when(F.abs(width - wanted) > WIDTH_SLACK, "width").when(F.coalesce(bad, F.lit(True)), "shape")


def choose_page(asked: Column, pages: Column) -> Column:
    """The asked page if there is such a one, null if not; the first page where none is asked for."""
    return F.when(asked.isNull(), F.lit(1)).when(asked.between(1, pages), asked)


def reviewed(outcome: Column, reasons: Column, reason: Column) -> Column:
    """struct(outcome, reasons): REVIEW with the reason added where there is one, never back to PASS; null for a refusal, which goes no further."""
    more = F.concat(reasons, F.array(F.concat(reason, F.lit("; a person decides, this is not a rejection"))))
    return F.when(outcome != "REFUSE", F.struct(F.when(reason.isNull(), outcome).otherwise("REVIEW").alias("outcome"), F.when(reason.isNull(), reasons).otherwise(more).alias("reasons")))


def choose_search(candidates: DataFrame, tried: DataFrame, recent: DataFrame, key: str, order: list[Column], tries: int) -> DataFrame:
    """Candidates(lane, key, family, postable) that are looked at, by lane, in order, with ``pos`` and ``chosen``, the first postable one.

    Tried keys and recent families are left out, and at most ``tries`` are looked at; what follows the chosen one is not.
    """
    open_ = candidates.join(tried.select("lane", key), ["lane", key], "left_anti").join(recent.select("lane", "family"), ["lane", "family"], "left_anti")
    looked = open_.withColumn("pos", F.row_number().over(W.partitionBy("lane").orderBy(*order))).where(F.col("pos") <= tries)
    won = F.min(F.when(F.col("postable"), F.col("pos"))).over(W.partitionBy("lane"))
    return looked.withColumn("won", won).where("won is null or pos <= won").withColumn("chosen", F.coalesce(F.col("pos") == F.col("won"), F.lit(False))).drop("won")


def pick(approved: DataFrame, searched: DataFrame, ordered: DataFrame, search_lanes: tuple[str, ...], both: str) -> DataFrame:
    """(lane, id, source): what each lane posts: an approved one first; then the search's for search lanes, the order's for others; ``both`` takes the search's, then the order's."""
    lanes = approved.select("lane").union(searched.select("lane")).union(ordered.select("lane")).distinct()
    rows = lanes
    for name, some in (("approved", approved), ("search", searched), ("order", ordered)):
        rows = rows.join(some.select("lane", F.col("id").alias(name)), "lane", "left")
    searches, orders = F.col("lane").isin(*search_lanes, both), ~F.col("lane").isin(*search_lanes)
    source = F.when(F.col("approved").isNotNull(), "approved").when(searches & F.col("search").isNotNull(), "search").when(orders & F.col("order").isNotNull(), "order")
    return rows.select("lane", F.when(source == "approved", F.col("approved")).when(source == "search", F.col("search")).when(source == "order", F.col("order")).alias("id"), source.alias("source"))


def service_path(url: Column) -> Column:
    """The identifier in an image service's address, unquoted; null where there is none."""
    found = F.nullif(F.regexp_extract(url, r"/iiif/2/(.*)$", 1), F.lit(""))
    return F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B")))


def quoted(t: Column) -> Column:
    """Percent-encoded, as a path's part: letters, digits and _.-~ stay."""
    form = F.url_encode(t)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def crop_url(host: str, path: Column, x: Column, y: Column, w: Column, h: Column, width: int) -> Column:
    return F.concat(F.lit(f"https://{host}/iiif/2/"), quoted(path), F.lit("/"), F.concat_ws(",", x, y, w, h), F.lit(f"/{width},/0/default.jpg"))


def picture_rank(clear: Column, markers: Column, area: Column) -> list[Column]:
    """The order in which pictures are looked at: clearest last, fewest advertisement marks, largest first."""
    return [F.bround(clear, 2), markers, -area]


def largest(items: DataFrame, keys: list[str], floor: Column, order: str) -> DataFrame:
    """The item of the largest area of at least ``floor``; the first by ``order`` of equals. Groups with none are missing."""
    rows = items.withColumn("area", F.col("w") * F.col("h")).where(F.col("area") >= floor)
    best = F.max_by(F.struct(order, "area"), F.struct("area", -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def continues(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of words(x, wid, t) with ``continues``: whether the leftmost word begins in lower case."""
    held = lines.groupBy(*keys).agg(F.collect_list(F.struct("x", "wid", "t")).alias("words"))
    return held.select(*keys, continues_in(F.col("words")).alias("continues"))


def continues_in(words: Column) -> Column:
    """``continues`` of a line that has its words (x, wid, t, ...) as an array: none of them is sorted or moved."""
    return F.regexp_like(F.array_min(F.transform(words, lambda v: F.struct(v["x"], v["wid"], v["t"])))["t"], F.lit(r"^\p{Ll}"))


def next_line(words: DataFrame, current: DataFrame) -> DataFrame:
    """current(page_key, x0, x1, cur) with ``below``: the top of the nearest word under ``cur`` that lies in [x0, x1); null where none is."""
    met = words.select("page_key", "x", "y", "w").join(current, "page_key").where("x + w > x0 and x < x1 and y > cur")
    return current.join(met.groupBy("page_key", "x0").agg(F.min("y").alias("below")), ["page_key", "x0"], "left")
