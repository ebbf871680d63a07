"""Items of a page: reading order, display rows, nameplates, lines, blocks grown from a seed, and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.text import letters
from folio.operators import layout

# Body heights, shares of a page, and rows.
GAP, PARAGRAPH, DISPLAY = 2.2, 1.3, 1.6
LEAST_ROWS, LEAST_SHARE, MOST_ROWS = 4, 0.015, 80
#: Why a block ends.
REASONS = (None, "gap", "rule", "display-boundary", "paragraph-gap", "row-count-cap", "refused", "cap")


def reading_order(words: DataFrame) -> DataFrame:
    """word to (page_key, wid, row_id), where a drop initial's neighbours are held to the row's first ordinary word.

    A fold, as in layout.rows_anchor.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, row, first, ordinary, begun = None, -1, None, None, False
        for b in batches:
            ids = []
            for key, x, y, w, h, tall in zip(*(b.column(k).to_pylist() for k in ("page_key", "x", "y", "w", "h", "tall"))):
                if not begun or key != page:
                    page, row, first, ordinary, begun = key, -1, None, None, True
                joins = False
                if first is not None:
                    beside = first[3] > tall >= h and x >= first[0] + 0.25 * first[2] and y < first[1] + first[3]
                    top = ordinary[1] if beside and ordinary else first[1]
                    size = max(ordinary[3], h) if beside and ordinary else h if beside else max(first[3], h)
                    joins = abs(y - top) <= 0.5 * size
                if not joins:
                    row, first, ordinary = row + 1, (x, y, w, h), None
                if ordinary is None and h <= tall:
                    ordinary = (x, y, w, h)
                ids.append(row)
            yield pa.RecordBatch.from_arrays([b.column("page_key"), b.column("wid"), pa.array(ids, pa.int64())], names=["page_key", "wid", "row_id"])

    rows = words.select(F.col("page_key").cast("long").alias("page_key"), F.col("wid").cast("long").alias("wid"), "x", "y", "w", "h")
    order = F.sort_array(F.collect_list("h"))
    tall = rows.groupBy("page_key").agg((2.5 * F.get(order, F.floor(F.size(order) / 2).cast("int"))).alias("tall"))
    met = rows.join(tall.withColumnRenamed("page_key", "_page"), F.col("page_key").eqNullSafe(F.col("_page"))).drop("_page")
    return layout.by_page(met, ["y", "x", "wid"]).mapInArrow(fold, "page_key long, wid long, row_id long")


def cluster(display: DataFrame) -> DataFrame:
    """The display words of the topmost rows that belong together: near the row above, and at least 0.65 of the first's height."""
    met = layout.rows_anchor(display, keep=("x", "y", "w", "h")).where("page_key is not null and wid is not null").repartition("page_key")
    rows = met.groupBy("page_key", "row_id").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("h").alias("tall"))
    w = W.partitionBy("page_key").orderBy("row_id")
    above = lambda c: F.lag(c).over(w)
    fails = (F.col("top") - above("bottom") > 1.2 * above("tall")) | (F.col("tall") < 0.65 * F.first("tall").over(w))
    kept = rows.withColumn("_fails", F.coalesce(fails, F.lit(False))).withColumn("_fails", F.max("_fails").over(w)).where("not _fails")
    return met.join(kept.select("page_key", "row_id"), ["page_key", "row_id"], "left_semi").drop("row_id")


def nameplates(words: DataFrame, display: DataFrame | None = None, body: DataFrame | None = None) -> DataFrame:
    """(page_key, w, h): the band of the page's name, of full width; no row where there is no confident one.

    ``display`` and ``body``: ``layout.display_words`` and ``body_start`` of the words, where a caller has them."""
    run = cluster(layout.display_words(words) if display is None else display).groupBy("page_key").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    size = F.col("bottom") - F.col("top")

    def with_page(page: DataFrame, *found: Column) -> DataFrame:
        """The page's columns and what its words say; the pages' side is held, and no word is sorted or moved."""
        seen = words.join(page.hint("shuffle_hash"), "page_key").groupBy("page_key").agg(*[F.first(c).alias(c) for c in page.columns[1:]], *found)
        return seen

    page = with_page(run, F.max(F.col("x") + F.col("w")).alias("page_w"), F.max(F.col("y") + F.col("h")).alias("page_h"), F.min(F.when(F.col("y") > F.col("bottom"), F.col("y"))).alias("next"))
    line = (F.col("y") > F.col("bottom")) & (F.col("y") < F.col("next") + 0.6 * size)
    page = with_page(page, F.count(F.when(line, 1)).alias("n"), F.max(F.when(line, F.col("h"))).alias("tallest"), F.max(F.when(line, F.col("y") + F.col("h"))).alias("end"))
    page = with_page(page, F.min(F.when(F.col("y") > F.col("end"), F.col("y"))).alias("after"))
    sparse = (F.col("n") <= 12) & (F.col("tallest") <= size)
    limit = F.when(F.col("next").isNull(), F.col("page_h")).when(sparse, F.coalesce("after", "page_h")).otherwise(F.col("next"))
    page = page.withColumn("band", F.least(limit.cast("double"), F.col("bottom") + 0.35 * size, F.col("page_h").cast("double")))
    page = page.join(layout.body_start(layout.density(words)) if body is None else body, "page_key", "left").where((size > 0) & (F.col("band") > 0) & (F.col("body_y").isNull() | (F.col("band") <= F.col("body_y"))) & (F.col("band") <= 0.22 * F.col("page_h")))
    return page.select("page_key", F.col("page_w").alias("w"), F.bround("band").cast("long").alias("h"))


def display_rows(words: DataFrame) -> DataFrame:
    """(page_key, wid, row_id, group_id, piece): display words of the whole page by row, by overlap in y, by gaps in x; pieces need a word of 3 letters."""
    return shown_rows(words).drop("x", "y", "w", "h", "t")


def shown_rows(words: DataFrame) -> DataFrame:
    """``display_rows`` with the words' x, y, w, h and t, dealt by page."""
    page = words.groupBy("page_key").agg(F.median(F.when(F.col("h") > 0, F.col("h"))).alias("m"), F.max(F.col("y") + F.col("h")).alias("page_h"))
    display = words.join(page.hint("shuffle_hash"), "page_key").where(F.col("h") >= F.greatest(F.col("page_h") * 0.012, 2.0 * F.col("m")))
    met = layout.rows_anchor(display, keep=("x", "y", "w", "h", "t")).where("page_key is not null and wid is not null").repartition("page_key")
    w = W.partitionBy("page_key", "row_id").orderBy("y", "x", "wid")
    high = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(W.unboundedPreceding, -1))
    met = layout.islands(met.withColumn("_new", F.col("y") >= high), ["page_key", "row_id"], ["y", "x", "wid"], F.col("_new"), "group_id")
    keys = ["page_key", "row_id", "group_id"]
    w = W.partitionBy(*keys).orderBy("x", "wid")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    met = layout.islands(met.withColumn("_new", gap * 10 > 12 * F.greatest("h", F.lag("h").over(w))), keys, ["x", "wid"], F.col("_new"), "piece")
    real = F.max(letters(F.col("t")) >= 3).over(W.partitionBy(*keys, "piece"))
    return met.withColumn("_real", real).where("_real").select("page_key", "wid", "row_id", "group_id", "piece", "x", "y", "w", "h", "t")


def spread_lines(words: DataFrame, median: Column) -> DataFrame:
    """(page_key, line, top, bottom, tall, med): words by their centres, apart where the next centre is over half a median height on."""
    w = W.partitionBy("page_key").orderBy("_c", "x", "wid")
    rows = words.withColumns({"_c": 2 * F.col("y") + F.col("h"), "med": median})
    rows = layout.islands(rows.withColumn("_new", F.col("_c") - F.lag("_c").over(w) > F.col("med")), ["page_key"], ["_c", "x", "wid"], F.col("_new"), "line")
    return rows.groupBy("page_key", "line").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("h").alias("tall"), F.max("med").alias("med"))


def story_start(lines: DataFrame) -> DataFrame:
    """(page_key, bottom): where the first three lines of body size in a row end; no row without such lines."""
    w = W.partitionBy("page_key").orderBy("line")
    body = F.when(F.col("tall") <= 1.3 * F.col("med"), 1).otherwise(0)
    runs = lines.withColumn("_run", F.sum(body).over(w.rowsBetween(-2, 0)))
    return runs.where("_run = 3").groupBy("page_key").agg(F.min_by("bottom", "line").alias("bottom"))


def fold_lines(rows: DataFrame) -> DataFrame:
    """row(page_key, row_id, top, bottom, med) with ``line``: a row joins while its top is above the line's bottom by 0.2 med.

    The bottom is the line's own running maximum, which a window over all rows before is not: a fold per page.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("row_id")
        ids, line, end = [], -1, 0
        for top, bottom, med in page[["top", "bottom", "med"]].itertuples(index=False):
            if line < 0 or top >= end - 0.2 * med:
                line, end = line + 1, bottom
            end = max(end, bottom)
            ids.append(line)
        return page.assign(line=ids)

    return rows.select("page_key", "row_id", "top", "bottom", "med").groupBy("page_key").applyInPandas(fold, "page_key long, row_id long, top long, bottom long, med double, line long")


def nearest_row(rows: DataFrame, at: Column) -> DataFrame:
    """(page_key, col, seed): the row whose middle is nearest; the first of equals."""
    away = F.abs(F.col("top") + F.col("tall") / 2 - at)
    return rows.groupBy("page_key", "col").agg(F.min_by("row", F.struct(away.alias("a"), F.col("row").alias("r"))).alias("seed"))


def nearest_in(rows: Column, at: Column) -> Column:
    """``nearest_row`` of a column whose rows are an array of (row, top, tall, ...)."""
    return F.array_min(F.transform(rows, lambda v: F.struct(F.abs(v["top"] + v["tall"] / 2 - at).alias("a"), v["row"].alias("r"))))["r"]


def block_around(rows: DataFrame, display: bool, most: float = 0.25) -> DataFrame:
    """Blocks grown up, then down, from a seed row of a column; why each walk stopped, and by how much.

    rows(page_key, col, row, top, bottom, tall, med, page_h, seed, rule_above), gathered by column for ``blocks_in``.
    """
    held = F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("row", "top", "bottom", "tall")], F.col("med").cast("double").alias("med"), "rule_above"))
    return blocks_in(rows.groupBy("page_key", "col").agg(F.max("page_h").alias("page_h"), F.max("seed").alias("seed"), held.alias("rows")), display, most)


def blocks_in(columns: DataFrame, display: bool, most: float = 0.25) -> DataFrame:
    """column(page_key, col, page_h, seed, rows: array of (row, top, bottom, tall, med, rule_above)) to its block.

    Whether a walk passes a row depends on that
    row and its neighbour, and downwards on where the walk upwards ended: so the first failing row each way
    is a minimum or maximum over the column's rows. A null reason: the column ends there. The outcome is 'ok', 'too tall' (the
    walk upwards met the cap) or 'too small'. A column's rows are in one row: nothing is sorted, joined or spilled.
    """
    names = {"top": pa.int64(), "bottom": pa.int64(), "rows": pa.int64(), "top_reason": pa.string(), "top_ratio": pa.float64(), "bottom_reason": pa.string(), "bottom_ratio": pa.float64(), "outcome": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _blocks(*[b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3)], b.column(4), display, most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, kind, from_pandas=True) for v, kind in zip(found, names.values())]], names=["page_key", "col", *names])

    kinds = dict(columns.dtypes)
    given = columns.where(F.size("rows") > 0).select("page_key", "col", "page_h", "seed", "rows")
    return given.mapInArrow(run, f"page_key {kinds['page_key']}, col {kinds['col']}, top long, bottom long, rows long, top_reason string, top_ratio double, bottom_reason string, bottom_ratio double, outcome string")


def _blocks(page_h: np.ndarray, seed: np.ndarray, lists: pa.ListArray, display: bool, most: float) -> tuple[np.ndarray, ...]:
    """The blocks of many columns at once, see ``blocks_in``; what is missing is NaN or None."""
    ends, (row, top, bottom, tall, med, rule) = layout.listed(lists, "row", "top", "bottom", "tall", "med", "rule_above")
    col = np.repeat(np.arange(len(page_h)), np.diff(ends))
    order = np.lexsort((row, col))
    row, top, bottom, tall, med = (v[order].astype(float) for v in (row, top, bottom, tall, med))
    rule, at, tip = np.array(rule[order] == True, bool), ends[:-1], ends[1:] - 1  # noqa: E712  null is no rule
    seed, cap = seed[col], (most * page_h)[col]
    shown = tall >= DISPLAY * med
    ug, dg, ur = np.full(len(row), np.nan), np.full(len(row), np.nan), np.zeros(len(row), bool)
    same = col[1:] == col[:-1]
    ug[:-1], dg[1:], ur[:-1] = np.where(same, top[1:] - bottom[:-1], np.nan), np.where(same, top[1:] - bottom[:-1], np.nan), same & rule[1:]

    def reasons(where, gap, rule, away, grace, beyond, name):
        """The place in ``REASONS`` of the first that holds, in order; 0 for none."""
        tests = [((gap > GAP * med) & ~(shown & display), "gap"), (rule, "rule")]
        if not display:
            tests += [(shown, "display-boundary"), ((gap > PARAGRAPH * med) & grace, "paragraph-gap"), (away > MOST_ROWS, "row-count-cap")]
        out = np.zeros(len(row), np.int8)
        for test, said in reversed([*tests, (beyond, name)]):
            out[test] = REASONS.index(said)
        return np.where(where, out, np.int8(0))

    def pick(where, value):
        """A column's largest value where it holds, NaN for none."""
        return np.fmax.reduceat(np.where(where, value, np.nan), at)

    up = reasons(row < seed, ug, ur, seed - row, True, pick(row == seed, bottom)[col] - top > cap, "refused")
    lo = pick(up > 0, row) + 1
    lo = np.where(np.isnan(lo), row[at], lo)
    first = pick(row == lo[col], top)
    down = reasons(row > seed, dg, rule, row - seed, row - seed > 3, bottom - first[col] > cap, "cap")
    hi = -pick(down > 0, -row) - 1
    hi = np.where(np.isnan(hi), row[tip], hi)
    last = pick(row == hi[col], bottom)

    def stop(where, why, gap):
        """The reason and the ratio at the row behind the block; a row number stands once in a column."""
        here = np.flatnonzero(where & (why > 0))
        reason, ratio = np.full(len(page_h), None, object), np.full(len(page_h), np.nan)
        said = np.array(REASONS, object)[why[here]]
        k = np.select([said == "gap", said == "paragraph-gap"], [GAP, PARAGRAPH], np.nan) * med[here]
        reason[col[here]], ratio[col[here]] = said, (gap[here] - k) / k
        return reason, ratio

    top_reason, top_ratio = stop(row == lo[col] - 1, up, ug)
    bottom_reason, bottom_ratio = stop(row == hi[col] + 1, down, dg)
    small = (hi - lo + 1 < LEAST_ROWS) | (last - first < LEAST_SHARE * page_h)
    outcome = np.where(top_reason == "refused", "too tall", np.where(small, "too small", "ok")).astype(object)
    return first, last, hi - lo + 1, top_reason, top_ratio, bottom_reason, bottom_ratio, outcome


def margins(blocks: DataFrame) -> DataFrame:
    """Blocks with map<side, struct(reason, ratio, text)> for the closure audit; a null side has nothing outside; null for refused ones."""
    side = lambda s: F.when(F.col(f"{s}_reason").isNotNull(), F.struct(F.col(f"{s}_reason").alias("reason"), F.col(f"{s}_ratio").alias("ratio"), F.lit("").alias("text")))
    return blocks.withColumn("margins", F.when(F.col("outcome") == "ok", F.create_map(F.lit("top"), side("top"), F.lit("bottom"), side("bottom"))))


def image_edges(rows: DataFrame, scale: float, image_w: Column, image_h: Column) -> DataFrame:
    """Boxes (x, y, w, h) with image_x, image_y, image_w, image_h in image pixels, clamped to the page; nulls for an empty one.

    Each edge is a column of its own, worked out once.
    """
    edge = lambda v: F.rint(v * F.lit(scale)).cast("long")
    x, y, w, h = (F.col(c) for c in "xywh")
    rows = rows.withColumns({"_x0": F.greatest(F.lit(0), edge(x)), "_y0": F.greatest(F.lit(0), edge(y)), "_x1": F.least(image_w, edge(x + w)), "_y1": F.least(image_h, edge(y + h))})
    some = (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))
    sides = {"image_x": F.col("_x0"), "image_y": F.col("_y0"), "image_w": F.col("_x1") - F.col("_x0"), "image_h": F.col("_y1") - F.col("_y0")}
    return rows.withColumns({k: F.when(some, v) for k, v in sides.items()}).drop("_x0", "_y0", "_x1", "_y1")


def to_image(x: Column, y: Column, w: Column, h: Column, scale: Column, image_w: Column, image_h: Column) -> Column:
    """A box in image pixels, clamped to the page; null for an empty one or an unknown scale."""
    edge = lambda v: F.rint(v * scale).cast("long")
    x0, y0 = F.greatest(F.lit(0), edge(x)), F.greatest(F.lit(0), edge(y))
    x1, y1 = F.least(image_w, edge(x + w)), F.least(image_h, edge(y + h))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def loosen(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, wide: float, high: float) -> Column:
    """A box with a margin of shares of the page, clamped to it."""
    mx, my = (page_w * wide).cast("long"), (page_h * high).cast("long")
    x0, y0 = F.greatest(F.lit(0), x - mx), F.greatest(F.lit(0), y - my)
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(page_w, x + w + mx) - x0).alias("w"), (F.least(page_h, y + h + my) - y0).alias("h"))
