"""Walks from a start: deck chains under a headline, paragraphs, a column's bounds, and pictures cut at their necks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators import layout, raster

# Shares of a headline's height or of a page, body heights, and lines.
DECK_LEAST, DECK_GAP, DECK_PAD, DECK_SIDE, DECK_MOST = 0.30, 1.5, 0.15, 0.02, 0.35
TIGHT, INDENT, LINES, ARTICLE_MOST, DISPLAY = 0.6, 1.2, 10, 0.22, 1.6
CROSSED, LEAST_SPAN = 0.08, 0.06
NECK, NECK_RUN = 0.30, 3
SPAN, CROSS, LINE, MARKS = 0.95, 0.25, 0.5, ".!?,;:”\""
AREA, WIDE, HIGH, FILL, SKIP = 0.02, 0.10, 0.05, 0.35, 0.10


def deck_boxes(words: DataFrame, seeds: DataFrame, least: float = DECK_LEAST, hops: int = 4) -> DataFrame:
    """seed(page_key, seed, x0, x1, y0, y1) to (page_key, seed, x, y, w, h): the headline with the lines chained beneath it.

    A hop takes the words of sufficient height that begin within 1.5 headline heights and overlap the
    headline in x; one that finds none ends the chain. A null box is empty or deeper than 35 % of the page; a page without
    words has no row. Pages stream through a task, words before seeds and in order of y, and are searched for each hop.
    """
    names = ("page_key", "seed", "x0", "x1", "y0", "y1", "end", "pw", "ph")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in layout.whole_pages(batches, 100_000):
            is_seed, left, top, wide, high_ = (t.column(c).to_numpy() for c in ("is_seed", "x", "y", "w", "h"))
            at, out = [], []
            for i, j in layout.page_slices(t):
                k = i + int(np.searchsorted(is_seed[i:j], 1))
                if k in (i, j):
                    continue
                x, y, h = left[i:k], top[i:k], high_[i:k]
                right, under = x + wide[i:k], y + h
                pw, ph = max(0, int(right.max())), max(0, int(under.max()))
                for n in range(k, j):
                    x0, x1, y0, y1 = int(left[n]), int(wide[n]), int(top[n]), int(high_[n])
                    cur, high = y1, y1 - y0
                    for _ in range(hops):
                        a, b = np.searchsorted(y, [cur, cur + DECK_GAP * high], side="right")
                        met = (right[a:b] > x0) & (x[a:b] < x1) & (h[a:b] >= least * high)
                        if not met.any():
                            break
                        cur = int(under[a:b][met].max())
                    at.append(n)
                    out.append((x0, x1, y0, y1, cur, pw, ph))
            if at:
                chosen = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks().take(chosen) for c in ("page_key", "seed")], *[pa.array(c, pa.int64()) for c in zip(*out)]], schema=schema)

    long = lambda c, name: F.col(c).cast("long").alias(name)
    none = F.lit(None).cast("long").alias("seed")
    both = words.select(long("page_key", "page_key"), F.lit(0).alias("is_seed"), none, *[long(c, c) for c in "xywh"])
    both = both.unionByName(seeds.select(long("page_key", "page_key"), F.lit(1).alias("is_seed"), long("seed", "seed"), long("x0", "x"), long("y0", "y"), long("x1", "w"), long("y1", "h")))
    rows = layout.by_page(both, ["is_seed", "y"]).mapInArrow(fold, ", ".join(f"{c} long" for c in names))
    pad, high = F.col("pw") * DECK_SIDE, F.col("y1") - F.col("y0")
    a, b = F.greatest(F.lit(0), (F.col("x0") - pad).cast("long")), F.least("pw", (F.col("x1") + pad).cast("long"))
    c, d = F.greatest(F.lit(0), (F.col("y0") - DECK_PAD * high).cast("long")), F.least("ph", (F.col("end") + DECK_PAD * high).cast("long"))
    ok = (b > a) & (d > c) & (d - c <= DECK_MOST * F.col("ph"))
    return rows.select("page_key", "seed", *[F.when(ok, v).alias(k) for k, v in (("x", a), ("y", c), ("w", b - a), ("h", d - c))])


def article_spans(lines: DataFrame, heads: DataFrame, most: float = ARTICLE_MOST, most_lines: int = LINES) -> DataFrame:
    """The first paragraph under each headline, by spacing rather than size.

    line(page_key, line, top, bottom, left, tall), head(page_key, head_bottom, read_top, page_h, med) to
    (page_key, first, last, bottom, reason, ratio, outcome). It begins at the first line of body size that two tight gaps
    follow and ends before a loose gap, an indented line (from the third on), the depth cap, or at ten lines. A
    null reason: the page ends there. Outcomes: 'ok', 'no paragraph', 'too short' (under three lines); the first has 4 lines at least.
    """
    page = W.partitionBy("page_key")
    w = page.orderBy("line")
    rows = lines.join(heads, "page_key").withColumns({"i": F.row_number().over(w).cast("long") - 1, "n": F.count("*").over(page)})
    rows = rows.withColumn("gap", F.col("top") - F.coalesce(F.lag("bottom").over(w), F.col("head_bottom")))
    rows = rows.withColumn("tight", F.col("gap") < TIGHT * F.col("med"))
    starts = F.lead("tight", 1).over(w) & F.lead("tight", 2).over(w) & (F.col("tall") < DISPLAY * F.col("med"))
    beyond = F.col("top") - F.col("head_bottom") > most * F.col("page_h")
    rows = rows.withColumns({"_at": F.min(F.when(F.coalesce(starts, F.lit(False)), F.col("i"))).over(page), "_past": F.min(F.when(beyond, F.col("i"))).over(page)})
    rows = rows.withColumn("first", F.when((F.col("n") >= 4) & (F.col("_past").isNull() | (F.col("_past") >= F.col("_at"))), F.col("_at")))
    near = F.when(F.col("i").between(F.col("first"), F.col("first") + 11), F.col("left"))
    lefts = F.sort_array(F.collect_list(near).over(page))
    rows = rows.withColumn("mode", F.try_element_at(lefts, (F.floor(F.size(lefts) / 2) + 1).cast("int")))
    indented = (F.col("i") - F.col("first") >= 2) & (F.col("left") > F.col("mode") + INDENT * F.col("med"))
    why = F.when(~F.col("tight"), "gap").when(indented, "indent").when(F.col("bottom") - F.col("read_top") > most * F.col("page_h"), "cap")
    rows = rows.withColumn("why", F.when(F.col("i") > F.col("first"), why))
    stop = F.min(F.when(F.col("why").isNotNull(), F.col("i"))).over(page)
    rows = rows.withColumn("stop", stop).withColumn("last", F.least(F.col("stop") - 1, F.col("first") + most_lines - 1, F.col("n") - 1))
    rows = rows.withColumn("last", F.when(F.col("first").isNotNull(), F.col("last")))
    counted = F.max("last") == F.max("first") + most_lines - 1
    stopped = F.max(F.when(F.col("i") == F.col("stop"), F.col("why")))
    ratio = F.max(F.when((F.col("i") == F.col("stop")) & (F.col("why") == "gap"), (F.col("gap") - TIGHT * F.col("med")) / (TIGHT * F.col("med"))))
    out = rows.groupBy("page_key").agg(
        F.max("first").alias("first"), F.max("last").alias("last"), F.max(F.when(F.col("i") == F.col("last"), (F.col("bottom") + 0.6 * F.col("med")).cast("long"))).alias("bottom"),
        F.when(counted, "row-count-cap").otherwise(stopped).alias("reason"), F.when(~counted, ratio).alias("ratio"),
    )
    return out.withColumn("outcome", F.when(F.col("first").isNull(), "no paragraph").when(F.col("last") - F.col("first") < 2, "too short").otherwise("ok"))


def column_bounds(items: DataFrame, cells: DataFrame, height: int) -> DataFrame:
    """item(page_key, item, x, y, w, h) to (page_key, item, x0, x1): the nearest gutters each side that nothing crosses on its rows.

    A gutter is crossed where even its clearest column is inked there; a rule is judged on the two columns each side of it. Without a
    gutter on one side the film's edge bounds the column; without any, both are null. A page's items meet its cells, as bits, in one row.
    """
    kinds = dict(items.dtypes)
    held = items.groupBy("page_key").agg(F.collect_list(F.struct("item", *[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("items"))
    met = held.join(raster.packed(cells.where("ink is not null")).hint("shuffle_hash"), "page_key", "left").select("page_key", "items", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, boxes = layout.listed(b.column(1), *"xywh")
            at, fields = layout.listed(b.column(2), "r", "k", "has", "inked")
            boxes = np.stack([x.astype(float) for x in boxes], axis=1)
            out = []
            for n in range(b.num_rows):
                i, j = at[n], at[n + 1]
                page = _gutters(*[f[i:j] for f in fields]) if j > i else None
                out += [_column(*page, *box, height) if page else (None, None) for box in boxes[ends[n] : ends[n + 1]]]
            number = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(number), b.column(1).flatten().field("item"), *[pa.array([v[k] for v in out], pa.int64()) for k in (0, 1)]], names=["page_key", "item", "x0", "x1"])

    return met.mapInArrow(run, f"page_key {kinds['page_key']}, item {kinds['item']}, x0 long, x1 long")


def _gutters(r: np.ndarray, k: np.ndarray, has: np.ndarray, inked: np.ndarray) -> tuple:
    """A page's rows, first column, cells and ink summed from above, film's edges, and gutters (first column, end, rule): ``raster.gutters`` of one page."""
    rows, low, (there, ink) = raster.grid(r, k, has, inked)
    even = rows % 2 == 0
    many = there[even].sum(axis=0)
    c = np.flatnonzero(many)
    dark = ink[even].sum(axis=0)[c] / many[c]
    down = [np.pad(np.cumsum(x, axis=0, dtype=np.int32), ((1, 0), (0, 0))) for x in (there, ink)]
    if not len(c):
        return rows, low, *down, None, None, []
    paper = c[dark <= 0.55]
    e0, e1 = (int(paper[0]), int(paper[-1]) + 1) if len(paper) else (int(c[-1]) + 1, int(c[-1]) + 1)
    found = []
    for rule, test in ((False, dark <= 0.10), (True, (dark >= 0.45) & (dark > 0.10))):
        at = c[test & (c >= e0) & (c < e1)]
        if len(at):
            found += [(int(p[0]), int(p[-1]) + 1, rule) for p in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if rule or len(p) >= 2]
    return rows, low, *down, e0, e1, found


def _column(rows: np.ndarray, low: int, there: np.ndarray, ink: np.ndarray, e0: int | None, e1: int | None, gutters: list, x: float, y: float, w: float, h: float, height: int) -> tuple[int | None, int | None]:
    """One item's bounds, see ``column_bounds``; columns count from the page's first, ``low``."""
    if e0 is None:
        return None, None
    span, mid = int(height * LEAST_SPAN), np.floor(y + h / 2)
    a, b = (max(0, mid - span // 2), min(height, mid + span // 2)) if h < span else (y, y + h)
    a, b = (0, 0) if a != a or b != b else np.searchsorted(rows, (a, b))
    many = there[max(a, b)] - there[a]
    dark = np.where(many > 0, (ink[max(a, b)] - ink[a]) / np.maximum(1, many), np.inf)

    def crossed(g0: int, g1: int, rule: bool) -> bool:
        near = np.concatenate((dark[max(0, g0 - 2) : g0], dark[g1 : g1 + 2])) if rule else dark[g0:g1]
        near = near[np.isfinite(near)]
        return len(near) > 0 and near.min() > CROSSED

    left = max((g[1] for g in gutters if g[1] + low <= x and not crossed(*g)), default=None)
    right = min((g[0] for g in gutters if g[0] + low >= x + w and not crossed(*g)), default=None)
    p, q = e0 if left is None else left, e1 if right is None else right
    return (low + p, low + q) if (left is not None or right is not None) and q > p else (None, None)


def _cut(cells: np.ndarray, axis: int) -> list[np.ndarray]:
    """The cells between the necks along an axis: runs of lines that hold few cells for the extent across."""
    at, across = cells[:, axis] - cells[:, axis].min(), cells[:, 1 - axis]
    thin = np.bincount(at) < NECK * (np.ptp(across) + 1)
    bounds = np.flatnonzero(np.diff(np.r_[False, thin, False].astype(np.int8))).reshape(-1, 2)
    neck = np.zeros(len(thin), bool)
    for a, b in bounds[bounds[:, 1] - bounds[:, 0] >= NECK_RUN]:
        neck[a:b] = True
    if not neck.any():
        return [cells]
    side, kept = np.cumsum(neck)[at], ~neck[at]
    return [cells[kept & (side == k)] for k in np.unique(side[kept])] or [cells]


def split_at_necks(labels: DataFrame) -> DataFrame:
    """(page_key, r, c, component) to the same with ``piece``, cut until no piece has a neck; cells of necks go.

    Pages stream through a task; where a piece is cut depends on the cuts before. A component within three lines both ways has no neck.
    """
    schema = pa.schema([(k, pa.int64()) for k in ("page_key", "component", "piece", "r", "c")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in layout.whole_pages(batches, 100_000):
            slices = layout.page_slices(t, "page_key", "component")
            cells = np.stack([t.column(k).to_numpy() for k in "rc"], axis=1)
            starts = np.array([a for a, _ in slices])
            large = np.flatnonzero((np.maximum.reduceat(cells, starts) - np.minimum.reduceat(cells, starts) >= NECK_RUN).any(axis=1))
            piece, dropped = np.zeros(len(cells), np.int64), np.zeros(len(cells), bool)
            for k in large:
                a, b = slices[k]
                done, left = [], [np.column_stack((cells[a:b], np.arange(a, b)))]
                while left:
                    part = left.pop()
                    parts = _cut(part, 1)
                    if len(parts) == 1:
                        parts = _cut(part, 0)
                    if len(parts) == 1 and len(parts[0]) == len(part):
                        done.append(part)
                    else:
                        left += parts
                done.sort(key=lambda p: tuple(p[np.lexsort((p[:, 1], p[:, 0]))[0], :2]))
                dropped[a:b] = True
                for n, p in enumerate(done):
                    piece[p[:, 2]], dropped[p[:, 2]] = n, False
            kept = pa.array(np.flatnonzero(~dropped))
            of = {k: t.column(k).combine_chunks() for k in ("page_key", "component", "r", "c")} | {"piece": pa.array(piece)}
            yield pa.RecordBatch.from_arrays([of[k].take(kept) for k in schema.names], schema=schema)

    rows = labels.select(*[F.col(k).cast("long").alias(k) for k in ("page_key", "component", "r", "c")])
    return layout.by_page(rows, ["component"]).mapInArrow(pieces, "page_key long, component long, piece long, r long, c long")


def picture_candidates(pieces: DataFrame, rows: int, columns: int, skip: float = SKIP) -> DataFrame:
    """(page_key, rank, area, x, y, w, h) in cells: pieces large, wide, high and full enough, largest first, with the page's head clipped off.

    The pass on coordinates alone; with ink given, ``area`` over 0.60 is for the caller to refuse.
    """
    keys = ["page_key", "component", "piece"]
    under = F.col("r") >= skip * rows
    box = lambda of, name: [F.count(of).alias(f"n{name}"), *[f(of).alias(f"{k}{name}") for k, f in (("b", F.max), ("t", F.min))]]
    clip = F.when(under, F.col("r"))
    got = pieces.groupBy(*keys).agg(*box(F.col("r"), ""), F.min("c").alias("l"), F.max("c").alias("e"), *box(clip, "_"), F.min(F.when(under, F.col("c"))).alias("l_"), F.max(F.when(under, F.col("c"))).alias("e_"))
    high, wide = F.col("b") - F.col("t") + 1, F.col("e") - F.col("l") + 1
    got = got.where((F.col("n") >= AREA * rows * columns) & (wide >= WIDE * columns) & (high >= HIGH * rows) & (F.col("n") >= FILL * wide * high))
    got = got.where((F.col("n_") >= AREA * rows * columns) & (F.col("b_") - F.col("t_") + 1 >= HIGH * rows))
    order = W.partitionBy("page_key").orderBy(F.col("n_").desc(), "component", "piece")
    return got.select("page_key", F.row_number().over(order).cast("long").alias("rank"), (F.col("n_") / (rows * columns)).alias("area"), F.col("l_").alias("x"), F.col("t_").alias("y"), (F.col("e_") - F.col("l_") + 1).alias("w"), (F.col("b_") - F.col("t_") + 1).alias("h"))


def bands(rules: DataFrame, boxes: DataFrame, least_rows: float = 2.0) -> DataFrame:
    """Boxes cut at their full-width rules: (page_key, box, band, top, bottom), half-open, without bands under two text heights.

    rule(page_key, box, y): rows of a rule, joined over breaks of up to two rows; box(page_key, box, y0, y1, med).
    """
    w = W.partitionBy("page_key", "box").orderBy("y")
    runs = layout.islands(rules.withColumn("_new", F.col("y") - F.lag("y").over(w) > 3), ["page_key", "box"], ["y"], F.col("_new"))
    runs = runs.groupBy("page_key", "box", "island").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    edges = runs.select("page_key", "box", "a", (F.col("b") + 1).alias("next")).unionByName(boxes.select("page_key", "box", F.col("y1").alias("a"), F.lit(None).cast("long").alias("next")))
    w = W.partitionBy("page_key", "box").orderBy("a", F.col("next").asc_nulls_last())
    rows = edges.join(boxes.select("page_key", "box", "y0", "med"), ["page_key", "box"]).withColumn("top", F.coalesce(F.lag("next").over(w), F.col("y0")))
    rows = rows.where(F.col("a") - F.col("top") > least_rows * F.col("med"))
    return rows.select("page_key", "box", F.row_number().over(W.partitionBy("page_key", "box").orderBy("a")).cast("long").alias("band"), "top", F.col("a").alias("bottom"))


def column_text(words: DataFrame, boxes: DataFrame, cut_bands: DataFrame, rules: DataFrame, edge: int = 6) -> DataFrame:
    """(page_key, box, text): a box read band by band, column by column and line by line; null text where no band has words.

    word(page_key, wid, t, x, y, w, h), box(page_key, box, x0, x1, med), band as from ``bands``, vertical rule(page_key, x, y0, y1). A
    rule parts columns where it spans 95 % of the band's text and no word reaches over it by more than a quarter of a
    text height (two at least). Words begin a line where their centre is over half a text height below the one before. A
    column that is not the last gets a period unless a mark ends it.
    """
    keys = ["page_key", "box", "band"]
    met = words.join(boxes, "page_key").where((F.col("x") + F.col("w") / 2 >= F.col("x0")) & (F.col("x") + F.col("w") / 2 < F.col("x1")))
    met = met.join(cut_bands, ["page_key", "box"]).where((F.col("y") + F.col("h") / 2 >= F.col("top")) & (F.col("y") + F.col("h") / 2 < F.col("bottom"))).drop("top", "bottom")
    extent = met.groupBy(*keys).agg(F.min("y").alias("a"), F.max(F.col("y") + F.col("h")).alias("b"), *[F.first(c).alias(c) for c in ("x0", "x1", "med")])
    lines = rules.select("page_key", F.col("x").alias("v"), F.col("y0").alias("v0"), F.col("y1").alias("v1"))
    spans = F.least("v1", "b") - F.greatest("v0", "a") >= SPAN * (F.col("b") - F.col("a"))
    cuts = extent.join(lines, "page_key").where((F.col("v") > F.col("x0") + edge) & (F.col("v") < F.col("x1") - edge) & spans).select(*keys, "v", F.greatest(F.lit(2.0), F.col("med") * CROSS).alias("slop"))
    over = F.least(F.col("v") - F.col("x"), F.col("x") + F.col("w") - F.col("v")) > F.col("slop")
    bad = met.select(*keys, "x", "w").join(cuts, keys).where(over).select(*keys, "v").distinct()
    cuts = cuts.join(bad, [*keys, "v"], "left_anti").groupBy(*keys).agg(F.collect_set("v").alias("cuts"))
    met = met.join(cuts, keys, "left")
    centre = F.col("x") + F.col("w") / 2
    met = met.withColumns({"col": F.coalesce(F.size(F.filter("cuts", lambda v: v <= centre)), F.lit(0)), "_c": 2 * F.col("y") + F.col("h")})
    w = W.partitionBy(*keys, "col").orderBy("_c", "wid")
    met = layout.islands(met.withColumn("_new", F.col("_c") - F.lag("_c").over(w) > 2 * LINE * F.col("med")), [*keys, "col"], ["_c", "wid"], F.col("_new"), "line")
    read = F.transform(F.sort_array(F.collect_list(F.struct("line", "x", "wid", "t"))), lambda s: s["t"])
    pieces = met.groupBy(*keys, "col").agg(F.trim(F.regexp_replace(F.array_join(read, " "), r"\s+", " ")).alias("piece")).where("piece <> ''")
    whole = pieces.groupBy("page_key", "box").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "col", "piece"))), lambda s: s["piece"]).alias("p"))
    ended = F.transform("p", lambda p, i: F.when((i == F.size("p") - 1) | F.contains(F.lit(MARKS), F.substring(p, -1, 1)), p).otherwise(F.concat(p, F.lit("."))))
    return boxes.select("page_key", "box").join(whole.select("page_key", "box", F.array_join(ended, " ").alias("text")), ["page_key", "box"], "left")


def heading_split(boxes: DataFrame, rules: DataFrame, height: int, share: float = 0.30) -> DataFrame:
    """box(page_key, box, x0, x1, y1) to the same keys and (x0, x1) of its left part, for boxes that exactly one vertical rule parts.

    The rule lies inside by more than four columns, reaches below the heading by more than 6 % of the page, and leaves
    at least 30 % of the width on both sides; other boxes have no row.
    """
    inside = (F.col("x") > F.col("x0") + 4) & (F.col("x") < F.col("x1") - 4) & (F.col("_end") > F.col("y1") + LEAST_SPAN * height)
    met = boxes.join(rules.select("page_key", "x", F.col("y1").alias("_end")), "page_key").where(inside)
    one = met.groupBy("page_key", "box").agg(F.count("*").alias("n"), F.max("x").alias("v"), F.max("x0").alias("x0"), F.max("x1").alias("x1")).where("n = 1")
    return one.where(F.least(F.col("v") - F.col("x0"), F.col("x1") - F.col("v")) >= share * (F.col("x1") - F.col("x0"))).select("page_key", "box", "x0", F.col("v").alias("x1"))
