"""Operators on run-length ink: a row a page with its strokes, array of (y, x0, x1) in order, or the same packed.

Profiles come from the strokes' ends: a column's ink changes only where a stroke begins or ends, so columns are steps of equal darkness,
and rows are sums of clipped strokes. A page's items and windows meet it in one row, where its strokes are filtered and cut; what leaves
that row is what was found, never its strokes or pixels. Where a walk looks for the next rule or clear run, it searches the runs of the rows of one item's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.sources.images import bitmap, stroke_rows, strokes

# Fixed values, as shares of a page's width or height where they are below one.
EDGE_DARK, GUTTER_DARK, RULE_DARK, CROSSED = 0.55, 0.10, 0.45, 0.08
CELL_DEEP, CELL_NARROW, SPAN_LEAST = 0.35, 0.05, 0.06
HRULE_DARK, GAP, CLEAR, PAPER_RUN, PAPER_PAD, EDGE_PAD, BORDER_PAD = 0.45, 0.004, 0.02, 0.002, 0.08, 0.004, 0.006
RULE_SHARE, RULE_SPAN, RULE_BREAK, RULE_REACH, RULE_THICK = 0.20, 0.38, 0.0045, 0.02, 1.40
VRULE_LEAST, VRULE_BREAK = 0.12, 0.004
LETTERS = 3


def _int(c: Column) -> Column:
    return c.cast("long")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """What the pages of a batch have given, as one batch: a batch for each page costs more than most pages do."""
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def worded(t: Column) -> Column:
    """Whether a text has ``LETTERS`` letters at least."""
    return F.regexp_like(t, F.lit(r"\P{L}*".join([r"\p{L}"] * LETTERS)))


def strokes_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_key", F.inline("strokes"))


def row_dark(pages: DataFrame) -> DataFrame:
    """(page_key, y, dark) of the rows that have ink."""
    return pages.select("page_key", "w", F.inline("strokes")).groupBy("page_key", "y").agg((F.sum(F.col("x1") - F.col("x0")) / F.first("w")).alias("dark"))


def spans(rows: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of True."""
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    turns = np.empty(len(rows) + 1, bool)
    turns[0], turns[-1] = rows[0], rows[-1]
    np.not_equal(rows[1:], rows[:-1], out=turns[1:-1])
    return turns.nonzero()[0].reshape(-1, 2)


def inked(ink: np.ndarray) -> np.ndarray:
    """Ink by column of rows of a bitmap."""
    return np.add.reduce(ink.view(np.uint8), axis=0, dtype=np.int32)


def _shares(found: np.ndarray, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Where steps of columns begin, with the page's width behind the last, and the steps' shares of ink on every second row."""
    found = found[found[:, 0] % 2 == 0]
    at, place = np.unique(np.concatenate(([0, w], np.maximum(found[:, 1], 0), np.minimum(found[:, 2], w))), return_inverse=True)
    change = np.concatenate((np.zeros(2), np.ones(len(found)), -np.ones(len(found))))
    return at, np.cumsum(np.bincount(place, change))[:-1] / (h / 2.0)


def col_dark(pages: DataFrame) -> DataFrame:
    """(page_key, x0, x1, dark): steps of columns by ink share, of every second row."""
    schema = pa.schema([("page_key", pa.int64()), ("x0", pa.int64()), ("x1", pa.int64()), ("dark", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                at, dark = _shares(stroke_rows(b.column(3)[k]), b.column(1)[k].as_py(), b.column(2)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dark), b.column(0)[k].as_py(), np.int64)), pa.array(at[:-1], pa.int64()), pa.array(at[1:], pa.int64()), pa.array(dark)], schema=schema)

    seen = pages.where("page_key is not null and w is not null and strokes is not null")
    return seen.select("page_key", "w", "h", "strokes").mapInArrow(run, "page_key long, x0 long, x1 long, dark double")


def film_edges(steps: DataFrame) -> DataFrame:
    """(page_key, x0, x1): the columns between the dark ones at both edges; both are the width if all are dark."""
    paper, width = F.col("dark") <= EDGE_DARK, F.max("x1")
    return steps.groupBy("page_key").agg(F.coalesce(F.min(F.when(paper, F.col("x0"))), width).alias("x0"), F.coalesce(F.max(F.when(paper, F.col("x1"))), width).alias("x1"))


def gutters(steps: DataFrame) -> DataFrame:
    """(page_key, kind, x0, x1): runs of columns inside the film that are paper, two wide at least, or rule. Steps are gone through once."""
    page, paper = W.partitionBy("page_key"), F.col("dark") <= EDGE_DARK
    film = steps.withColumns({"e0": F.coalesce(F.min(F.when(paper, F.col("x0"))).over(page), F.max("x1").over(page)), "e1": F.coalesce(F.max(F.when(paper, F.col("x1"))).over(page), F.max("x1").over(page))})
    kind = F.when(F.col("dark") <= GUTTER_DARK, "paper").when(F.col("dark") >= RULE_DARK, "rule").otherwise("")
    rows = film.where("x1 > e0 and x0 < e1").select("page_key", F.greatest("x0", "e0").alias("x0"), F.least("x1", "e1").alias("x1"), kind.alias("kind"))
    w = W.partitionBy("page_key").orderBy("x0")
    rows = rows.withColumn("new", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    found = rows.where("kind <> ''").groupBy("page_key", "kind", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return found.where("kind = 'rule' or x1 - x0 >= 2").drop("run")


def page_gutters(found: np.ndarray, w: int, h: int) -> tuple[int, int, list[tuple[int, int, bool]]]:
    """(first and end column inside the film, gutters as (x0, x1, rule) in order) of one page's strokes: what ``film_edges`` and ``gutters`` find in a table."""
    even = np.clip(found[found[:, 0] % 2 == 0, 1:], 0, w)
    at, dark = np.arange(w + 1), np.cumsum(np.bincount(even[:, 0], minlength=w + 1) - np.bincount(even[:, 1], minlength=w + 1))[:-1] / (h / 2.0)
    paper = np.flatnonzero(dark <= EDGE_DARK)
    e0, e1 = (int(at[paper[0]]), int(at[paper[-1] + 1])) if len(paper) else (int(at[-1]), int(at[-1]))
    kind = np.where(dark <= GUTTER_DARK, 1, np.where(dark >= RULE_DARK, 2, 0))
    inside = (at[1:] > e0) & (at[:-1] < e1)
    kind, x0, x1 = kind[inside], at[:-1][inside], at[1:][inside]
    first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(kind)) - 1
    runs = ((int(max(x0[a], e0)), int(min(x1[b], e1)), int(kind[a])) for a, b in zip(first, last))
    return e0, e1, [(a, b, k == 2) for a, b, k in runs if k == 2 or k and b - a >= 2]


def stroke_groups(found: np.ndarray, brk: int, length: int) -> np.ndarray:
    """(line, start, end) of strokes with gaps of up to ``brk`` bridged. A group inside the page ends at its last inked place; one that comes within ``brk`` of the end, behind it."""
    if not len(found):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] - found[:-1, 2] > brk)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1
    end = found[last, 2].astype(np.int64)
    return np.stack((found[first, 0], found[first, 1], np.where(length - end <= brk, end, end - 1)), axis=1)


def _unbroken(ink: np.ndarray, brk: int, long: int) -> np.ndarray:
    """Which columns may hold a stroke of ``long`` rows, gaps of up to ``brk`` bridged: it covers a whole block of half as many rows, which holds no wider gap."""
    h, size = len(ink), long // 2
    if size <= brk + 1:
        return np.ones(ink.shape[1], bool)
    near = ink.copy()  # whether there is ink in a row or in one of the next ``brk``
    for k in range(1, brk + 1):
        near[:-k] |= ink[k:]
    blocks = near[: h // size * size].reshape(-1, size, ink.shape[1])[:, : size - brk]
    return blocks.all(axis=1).any(axis=0)


def column_rules(ink: np.ndarray, least: float = VRULE_LEAST, skip_dark: bool = True) -> list[tuple[int, int, int]]:
    """(x, y0, y1) of a page's column rules: each column's longest stroke of at least a share of the height, those of columns at most two apart merged."""
    h, w = ink.shape
    dark = inked(ink[::2]) / (h / 2.0)
    bright = np.flatnonzero(dark <= EDGE_DARK)
    allowed = dark <= EDGE_DARK
    if not skip_dark:
        allowed = np.zeros(w, bool)
        if len(bright):
            allowed[bright[0] : bright[-1] + 1] = True
    brk, long = max(2, int(h * VRULE_BREAK)), int(h * least)
    allowed = np.flatnonzero(allowed & _unbroken(ink, brk, long))
    groups = stroke_groups(strokes(ink.T[allowed]), brk, h)
    groups[:, 0] = allowed[groups[:, 0]]
    size = groups[:, 2] - groups[:, 1]
    keep = (size >= long) & (size > 0)
    groups, size = groups[keep], size[keep]
    order = np.lexsort((groups[:, 1], -size, groups[:, 0]))
    groups = groups[order]
    groups = groups[np.append(True, groups[1:, 0] != groups[:-1, 0])] if len(groups) else groups
    parts = np.split(groups, np.flatnonzero(np.diff(groups[:, 0]) > 2) + 1) if len(groups) else []
    return [(int(p[:, 0].sum() / len(p)), int(p[:, 1].min()), int(p[:, 2].max())) for p in parts]


def page_of(row_strokes, w: int, h: int) -> np.ndarray:
    """A page's bitmap, from the strokes of its row as Arrow gives them."""
    return bitmap(stroke_rows(row_strokes), w, h)


def vrules(pages: DataFrame, least: float = VRULE_LEAST, skip_dark: bool = True) -> DataFrame:
    """(page_key, x, y0, y1): the column rules of each page."""
    schema = pa.schema([("page_key", pa.int64()), ("x", pa.int64()), ("y0", pa.int64()), ("y1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                found = column_rules(page_of(b.column(3)[k], b.column(1)[k].as_py(), b.column(2)[k].as_py()), least, skip_dark)
                out += [(b.column(0)[k].as_py(), *x) for x in found]
            yield batch_of(out, schema)

    return pages.where("w is not null").select("page_key", "w", "h", "strokes").mapInArrow(run, "page_key long, x long, y0 long, y1 long")


def _met(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with their page's size; those of a page without an image go."""
    return items.join(pages.where("w is not null").select("page_key", F.col("w").alias("pw"), F.col("h").alias("ph")), "page_key")


def _clipped(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """window(page_key, item, a, b, c, d) to (page_key, item, y, s0, s1): the strokes on columns [a, b) and rows [c, d), cut to them.

    A page's windows meet its strokes in one row; as strokes are in order of y, a window looks at those of its rows alone."""
    held = windows.where("a is not null and b is not null and c < d").groupBy("page_key").agg(F.collect_list(F.struct(*[_int(F.col(c)).alias(c) for c in ("item", *"abcd")])).alias("windows"))
    rows = pages.where("w is not null").select("page_key", "strokes").join(held, "page_key").select("page_key", "strokes", "windows")
    schema = pa.schema([(c, pa.int64()) for c in ("page_key", "item", "y", "s0", "s1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                y, x0, x1 = stroke_rows(batch.column(1)[k]).T
                parts = []
                for v in batch.column(2)[k].as_py():
                    lo, hi = np.searchsorted(y, (v["c"], v["d"]))
                    at = lo + np.flatnonzero((x0[lo:hi] < v["b"]) & (x1[lo:hi] > v["a"]))
                    parts.append((np.full(len(at), v["item"]), y[at], np.maximum(x0[at], v["a"]), np.minimum(x1[at], v["b"])))
                items, *rest = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), batch.column(0)[k].as_py())), pa.array(items), *map(pa.array, rest)], schema=schema)

    return rows.mapInArrow(run, "page_key long, item long, y long, s0 long, s1 long")


def _walked(dark: np.ndarray, up: int, down: int, need: int, rules_only: bool, keep_clear: bool) -> tuple[int, int] | None:
    """First and last row of a cell: from rows ``up`` and ``down`` out to the nearest rule or clear run of ``need`` rows; None where a side has neither."""
    n = len(dark)
    if not n:
        return None
    base = np.partition(dark, n // 10)[n // 10]
    clear, ruled = dark <= base + CLEAR, np.flatnonzero(dark >= HRULE_DARK)
    first, last = spans(clear).T
    last = last - 1

    def walk(start: int, back: bool) -> int | None:
        if not 0 <= start < n:
            return None
        if keep_clear and clear[start] and dark[start] < HRULE_DARK:
            return start
        if back:
            rule, free = ruled[ruled <= start][-1:], np.minimum(last, start)
            free = free[free - first + 1 >= need][-1:]
        else:
            rule, free = ruled[ruled >= start][:1], np.maximum(first, start)
            free = free[last - free + 1 >= need][:1]
        way = -1 if back else 1
        if rules_only:
            free = free[:0]
        if len(rule) and (not len(free) or (rule[0] - free[0]) * way <= need - 1):
            return int(rule[0]) - way
        return int(free[0]) if len(free) else None

    top, bottom = walk(up, True), walk(down, False)
    return None if top is None or bottom is None else (top, bottom)


def vertical_bounds(items: DataFrame, pages: DataFrame, rules_only: bool = False, keep_clear: bool = False) -> DataFrame:
    """item(page_key, item, x, y, w, h, x0, x1) to (page_key, item, y0, y1): out to the nearest rule or clear run above and below within [x0, x1).

    Null where a side does not close within ``CELL_DEEP`` of the page. ``rules_only`` walks past clear runs; with ``keep_clear`` an edge in paper stays.
    A page's items meet its strokes in one row, and only the two ends of each leave it.
    """
    names = ["item", "y", "h", "x0", "x1"]
    held = items.groupBy("page_key").agg(F.collect_list(F.struct(*[_int(F.col(c)).alias(c) for c in names])).alias("items"))
    rows = pages.where("w is not null").join(held, "page_key").select("page_key", "h", "strokes", "items")
    schema = pa.schema([(c, pa.int64()) for c in ("page_key", "item", "y0", "y1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, found, high = b.column(0)[k].as_py(), stroke_rows(b.column(2)[k]), b.column(1)[k].as_py()
                out += [(key, v["item"], *_ends(found, high, v, rules_only, keep_clear)) for v in b.column(3)[k].as_py()]
            yield batch_of(out, schema)

    return rows.mapInArrow(run, "page_key long, item long, y0 long, y1 long")


def _ends(found: np.ndarray, high: int, v: dict, rules_only: bool, keep_clear: bool) -> tuple[int | None, int | None]:
    """The ends of one item, see ``vertical_bounds``."""
    if v["y"] is None or v["h"] is None:
        return None, None
    cap = int(high * CELL_DEEP)
    top = max(0, v["y"] + v["h"] - cap)
    n = max(0, min(high, v["y"] + cap) - top)
    dark = np.zeros(n)
    if n and v["x0"] is not None and v["x1"] is not None:
        lo, hi = np.searchsorted(found[:, 0], (top, top + n))
        y, x0, x1 = found[lo:hi].T
        at = (x0 < v["x1"]) & (x1 > v["x0"])
        dark = np.bincount(y[at] - top, np.minimum(x1[at], v["x1"]) - np.maximum(x0[at], v["x0"]), n) / max(1, v["x1"] - v["x0"])
    cell = _walked(dark, max(0, v["y"] - top), min(n - 1, v["y"] + v["h"] - top), max(2, int(high * GAP)), rules_only, keep_clear)
    return (top + cell[0], top + cell[1] + 1) if cell else (None, None)


def paper_bounds(items: DataFrame, pages: DataFrame) -> DataFrame:
    """item(page_key, item, x, y, w, h) to (page_key, item, x0, x1): out from the box to the first clear run of columns each side, and a pad.

    A column is clear within ``CLEAR`` of the region's own floor, the tenth of its sorted darkness. Null where a side has no clear run near.
    A page's items meet its strokes in one row."""
    held = items.groupBy("page_key").agg(F.collect_list(F.struct(*[_int(F.col(c)).alias(c) for c in ("item", "x", "y", "w", "h")])).alias("items"))
    rows = pages.where("w is not null").join(held, "page_key").select("page_key", "w", "h", "strokes", "items")
    schema = pa.schema([(c, pa.int64()) for c in ("page_key", "item", "x0", "x1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, wide, high, found = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py(), stroke_rows(b.column(3)[k])
                out += [(key, v["item"], *_paper(found, wide, high, v)) for v in b.column(4)[k].as_py()]
            yield batch_of(out, schema)

    return rows.mapInArrow(run, "page_key long, item long, x0 long, x1 long")


def _paper(found: np.ndarray, wide: int, high: int, v: dict) -> tuple[int | None, int | None]:
    """The sides of one box, see ``paper_bounds``; without a height, the page's rows to its end count."""
    if v["x"] is None or v["w"] is None:
        return None, None
    pad, need, more = int(wide * PAPER_PAD), max(2, int(wide * PAPER_RUN)), max(2, int(wide * EDGE_PAD))
    top, bottom = max(0, v["y"] or 0), high if v["y"] is None or v["h"] is None else min(high, v["y"] + v["h"])
    left, right = max(0, v["x"] - pad), min(wide, v["x"] + v["w"] + pad)
    n = right - left
    if n <= 0:
        return None, None
    _, x0, x1 = found[slice(*np.searchsorted(found[:, 0], (top, max(top, bottom))))].T
    met = (x0 < right) & (x1 > left)
    begun, ended = (np.bincount(at, minlength=n + 1) for at in (np.maximum(x0[met], left) - left, np.minimum(x1[met], right) - left))
    dark = np.cumsum(begun - ended)[:n] / max(1, bottom - top)
    clear = dark <= np.partition(dark, n // 10)[n // 10] + CLEAR
    first, last = spans(clear).T
    last = last - 1
    near, far = v["x"] - left, v["x"] + v["w"] - 1 - left
    if not (0 <= near < n and 0 <= far < n):
        return None, None
    before, after = np.minimum(last, near), np.maximum(first, far)
    before, after = before[before - first + 1 >= need][-1:], after[last - after + 1 >= need][:1]
    if not len(before) or not len(after):
        return None, None
    return max(0, left + int(before[0]) - more), min(wide, left + int(after[0]) + 1 + more)


def column_bounds(items: DataFrame, pages: DataFrame) -> DataFrame:
    """item(page_key, item, x, y, w, h) to (page_key, item, x0, x1): the nearest gutters each side that nothing crosses on its rows; the film's edge where a side has none, null where both have none.

    A gutter is crossed where even its clearest column is inked on those rows; a rule, which is always dark, is judged by the two columns each side of it.
    A page's items and strokes meet in one row; its gutters are found there, and sums down its bitmap's columns are taken on an item's rows alone.
    """
    item = ["page_key", "item"]
    boxes = items.groupBy("page_key").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("item", "x", "y", "w", "h")])).alias("items"))
    rows = pages.where("w is not null and strokes is not null").join(boxes, "page_key").select("page_key", "w", "h", "strokes", "items")
    schema = pa.schema([(c, pa.int64()) for c in ("page_key", "item", "x0", "x1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, w, h, row, boxes = (b.column(c)[k] for c in ("page_key", "w", "h", "strokes", "items"))
                found, w, h = stroke_rows(row), w.as_py(), h.as_py()
                e0, e1, sides = page_gutters(found, w, h)
                ink = bitmap(found, w, h)
                out += [(key.as_py(), v["item"], *_sides(ink, v, sides, e0, e1)) for v in boxes.as_py()]
            yield batch_of(out, schema)

    return items.select(*item).join(rows.mapInArrow(run, "page_key long, item long, x0 long, x1 long"), item, "left")


def _sides(ink: np.ndarray, item: dict, sides: list[tuple[int, int, bool]], e0: int, e1: int) -> tuple[int | None, int | None]:
    height, x, x1 = len(ink), item["x"], item["x"] + item["w"]
    top, bottom, span = max(0, item["y"]), min(height, item["y"] + item["h"]), int(height * SPAN_LEAST)
    if bottom - top < span:  # so that the spaces of a few words do not line up
        mid = (top + bottom) // 2
        top, bottom = max(0, mid - span // 2), min(height, mid + span // 2)
    dark = inked(ink[top : max(top, bottom)]) / max(1, bottom - top)

    def open_(a: int, b: int, rule: bool) -> bool:
        near = np.concatenate((dark[max(0, a - 2) : a], dark[b : b + 2])) if rule else dark[a:b]
        return not (len(near) and near.min() > CROSSED)

    left = next((g[1] for g in reversed(sides) if g[1] <= x and open_(*g)), None)
    right = next((g[0] for g in sides if g[0] >= x1 and open_(*g)), None)
    if left is None and right is None:
        return None, None
    a, b = e0 if left is None else left, e1 if right is None else right
    return (a, b) if b > a else (None, None)


def snap(items: DataFrame, pages: DataFrame, mode: str = "column", rules_only: bool = False, border: bool = False, keep_clear: bool | None = None) -> DataFrame:
    """item(page_key, item, x, y, w, h) to (page_key, item, x0, y0, x1, y1): the cell around a box; nulls where it can't be closed, is a sliver or too deep. With ``border`` its rules stay inside.

    A page's items meet its strokes in one row, which passes through two folds: their sides are found, and then their ends."""
    held = items.groupBy("page_key").agg(F.collect_list(F.struct(*[_int(F.col(c)).alias(c) for c in ("item", "x", "y", "w", "h")])).alias("items"))
    rows = held.join(pages.where("w is not null and strokes is not null"), "page_key", "left").select(F.col("page_key").cast("long"), "w", "h", "strokes", "items")
    kinds = dict(rows.dtypes)
    boxed = pa.list_(pa.struct([(c, pa.int64()) for c in ("item", "y", "h", "x0", "x1")]))
    schema = pa.schema([(c, pa.int64()) for c in ("page_key", "item", "x0", "y0", "x1", "y1")])
    keep = mode == "paper" if keep_clear is None else keep_clear

    def sides(found: np.ndarray, w: int, h: int, boxes: list[dict]) -> list[dict]:
        if mode == "paper":
            return [v | dict(zip(("x0", "x1"), _paper(found, w, h, v))) for v in boxes]
        (e0, e1, places), ink = page_gutters(found, w, h), bitmap(found, w, h)
        return [v | dict(zip(("x0", "x1"), _sides(ink, v, places, e0, e1))) for v in boxes]

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages as they come, their boxes with sides."""
        for b in batches:
            rows = zip(*(b.column(c) for c in ("w", "h", "strokes", "items")))
            boxes = [sides(stroke_rows(row), w.as_py(), h.as_py(), v.as_py()) if w.is_valid else v.as_py() for w, h, row, v in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(boxes, boxed)], names=["page_key", "w", "h", "strokes", "items"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, w, h, row, boxes = (b.column(c)[k] for c in ("page_key", "w", "h", "strokes", "items"))
                key, w, h, found = key.as_py(), w.as_py(), h.as_py(), stroke_rows(row) if w.is_valid else None
                m = max(3, int(w * BORDER_PAD)) if border and w else 0
                for v in boxes.as_py():
                    x0, x1, y0, y1 = v["x0"], v["x1"], None, None
                    if x0 is not None and x1 - x0 >= w * CELL_NARROW:
                        y0, y1 = _ends(found, h, v, rules_only, keep)
                    ok = y0 is not None and 0 < y1 - y0 <= h * CELL_DEEP
                    out.append((key, v["item"], *((max(0, x0 - m), max(0, y0 - m), min(w, x1 + m), min(h, y1 + m)) if ok else (None,) * 4)))
            yield batch_of(out, schema)

    pages_ = rows.mapInArrow(sided, f"page_key long, w {kinds['w']}, h {kinds['h']}, strokes {kinds['strokes']}, items array<struct<item:long,y:long,h:long,x0:long,x1:long>>")
    return pages_.mapInArrow(cells, "page_key long, item long, x0 long, y0 long, x1 long, y1 long")


def rule_rows(windows: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """window(page_key, item, x0, x1, text_h) and word(page_key, x, y, w, h, t) to (page_key, item, y): rows of printed rules that run the window's width.

    A rule is a thin band of rows that are dark, reaches both ends of the window somewhere in it and holds no centre of a word with letters (an interval
    anti-join); its rows are those with one long stroke, gaps of up to ``RULE_BREAK`` of the width bridged.
    """
    names = ["item", "x0", "x1"]
    held = windows.groupBy("page_key").agg(F.collect_list(F.struct(*[_int(F.col(c)).alias(c) for c in names], F.col("text_h").cast("double").alias("text_h"))).alias("windows"))
    rows = pages.where("w is not null").join(held, "page_key").select("page_key", "w", "strokes", "windows")
    ys = pa.list_(pa.int64())
    schema = pa.schema([*[(c, pa.int64()) for c in ("page_key", "item", "a", "b", "top", "bottom")], ("ys", ys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, w, found = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), stroke_rows(batch.column(2)[k])
                out = [(key, v["item"], v["x0"], v["x1"], *band) for v in batch.column(3)[k].as_py() for band in _thin_bands(found, w, v)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    bands = rows.mapInArrow(run, "page_key long, item long, a long, b long, top long, bottom long, ys array<long>")
    centres = words.where(F.length(F.regexp_replace("t", r"\P{L}", "")) >= LETTERS).select(F.col("page_key").alias("_page"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    on = (F.col("page_key") == F.col("_page")) & (F.col("cx") >= F.col("a")) & (F.col("cx") < F.col("b")) & (F.col("cy") >= F.col("top")) & (F.col("cy") <= F.col("bottom"))
    return bands.join(centres, on, "left_anti").select("page_key", "item", F.explode("ys").alias("y"))


def _thin_bands(found: np.ndarray, w: int, v: dict) -> list[tuple[int, int, list[int]]]:
    """(first, last row, rows with a long stroke) of a window's thin bands that reach both its ends, those without such a row left out."""
    a, b = v["x0"], v["x1"]
    if a is None or b is None or v["text_h"] is None:
        return []
    brk, reach, wide = max(2, int(w * RULE_BREAK)), max(4, int(w * RULE_REACH)), max(1, b - a)
    y, s0, s1 = found[(found[:, 1] < b) & (found[:, 2] > a)].T
    if not len(y):
        return []
    s0, s1 = np.maximum(s0, a), np.minimum(s1, b)
    row = np.append(True, y[1:] != y[:-1])
    gap = s0 - np.where(row, a, np.append(0, s1[:-1]))
    lines, strokes_ = np.flatnonzero(row), np.flatnonzero(row | (gap > brk))
    # A stroke takes in what paper before it the bridging has counted: the gap's rest by one more than the longest bridge.
    long = s1[np.append(strokes_[1:], len(y)) - 1] - s0[strokes_] + gap[strokes_] % (brk + 1)
    long = np.maximum.reduceat(long, np.searchsorted(strokes_, lines))
    part = lambda lo, hi: np.add.reduceat(np.maximum(0, np.minimum(s1, hi) - np.maximum(s0, lo)), lines)
    dark = np.add.reduceat(s1 - s0, lines) >= RULE_SHARE * wide
    rows, long, left, right = y[lines][dark], long[dark], part(a, a + reach)[dark], part(b - reach, b)[dark]
    if not len(rows):
        return []
    first = np.flatnonzero(np.append(True, np.diff(rows) > 1))
    last = np.append(first[1:], len(rows)) - 1
    thin = rows[last] - rows[first] + 1 <= max(2, int(v["text_h"] * RULE_THICK))
    ends = (np.maximum.reduceat(left, first) >= 3) & (np.maximum.reduceat(right, first) >= 3)
    out = []
    for p in np.flatnonzero(thin & ends):
        at = np.arange(first[p], last[p] + 1)
        at = at[long[at] >= RULE_SPAN * wide]
        if len(at):
            out.append((int(rows[first[p]]), int(rows[last[p]]), rows[at].tolist()))
    return out


def rule_between(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """span(page_key, item, x0, x1, ya, yb) to (page_key, item, rule): whether a thin run of dark rows with paper beside it lies within the rows, and a little about them."""
    from folio.operators.profiles import CANDIDATE, ISOLATION, MOST_RUN, PAPER

    key, pad = ["page_key", "item"], 4 + ISOLATION
    met = _met(spans, pages).withColumns({"a": F.greatest(F.lit(0), F.col("ya") - pad), "n": F.col("yb") + pad}).withColumn("n", F.least(F.col("n"), F.col("ph")) - F.col("a"))
    parts = _clipped(met.select(*key, F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("a").alias("c"), (F.col("a") + F.col("n")).alias("d")), pages)
    parts = parts.join(met.select(*key, F.greatest(F.lit(1), F.col("x1") - F.col("x0")).alias("wide")), key)
    rows = parts.groupBy(*key, F.col("y").alias("r")).agg((F.sum(F.col("s1") - F.col("s0")) / F.first("wide")).alias("dark"))
    w = W.partitionBy(*key).orderBy("r")
    near = lambda lo, hi: F.coalesce(F.max("dark").over(w.rangeBetween(lo, hi)), F.lit(0.0))
    rows = rows.withColumns({"before": near(-ISOLATION, -1), "after": near(1, ISOLATION)}).where(F.col("dark") >= CANDIDATE).withColumn("run", F.col("r") - F.row_number().over(w))
    runs = rows.groupBy(*key, "run").agg(F.count("*").alias("size"), F.min_by("before", "r").alias("before"), F.max_by("after", "r").alias("after"))
    found = runs.where((F.col("size") <= MOST_RUN) & (F.col("before") <= PAPER) & (F.col("after") <= PAPER)).select(*key).distinct().withColumn("rule", F.lit(True))
    return met.select(*key).join(found, key, "left").select(*key, F.coalesce("rule", F.lit(False)).alias("rule"))
