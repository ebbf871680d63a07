"""Items of display type: a line's whole printed width, the deck beneath a headline, and the items of a page closed to their cells.

A page's words, the segments that start its items and, where it has an image, its strokes, gutters and column rules meet in one row. A walk looks only at the
words between two heights, found by search in the words' order, so its cost is that of the lines near it and not of the page. With an image, words are in its pixels.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators import pages as P
from folio.operators.pieces import GAP_RULE, SPLIT_GAP, darkest_least, gutter_pieces, is_tier, tiered
from folio.operators.strokes import CROSSED, batch_of, column_rules, inked, page_gutters, snap, worded
from folio.sources.bridge import written
from folio.sources.images import bitmap, stroke_rows

# Fixed values in hundredths: a line's size by the headline's, its share of the headline's span, a deck's size by the body's and by the line above, and peers' sizes.
SAME, OVER, FILLS, DECK, BODY, GROWN, PEER = 85, 125, 60, 30, 160, 105, (60, 160)
LINES, DEEP, MOST = 8, 6, 0.30
BANDS = {"headline": (0.0, 0.5), "ad": (0.5, 1.0)}


class _Page:
    """A page's words in order of y, x and wid, and what its image says of their gaps. A walk's windows hold few words, so they are lists, not arrays."""

    def __init__(self, words: pa.ListScalar, ink: np.ndarray | None, sides: list[tuple[int, int]]):
        flat, self.ink, self.sides = words.values, ink, np.array(sides, np.int64).reshape(-1, 2)
        x, y, w, h = (flat.field(c).to_numpy() for c in "xywh")  # a null fails
        # Texts become Python's where a walk asks for them.
        self.wid, self.t, self.real = flat.field("wid").to_pylist(), flat.field("t"), flat.field("real").to_pylist()
        self.x, self.y, self.w, self.h, self.right, self.under = (c.tolist() for c in (x, y, w, h, x + w, y + h))
        self.tallest = max([0, *self.h])
        self.median = float(np.median(h[h > 0])) if (h > 0).any() else 1.0
        self._rules: list[tuple[int, int, int]] | None = None
        self._walls: dict[tuple[int, int], tuple[np.ndarray, list[int]]] = {}

    def places(self) -> dict[int, int]:
        """The first place of each wid."""
        return {w: n for n, w in reversed(list(enumerate(self.wid)))}

    def between(self, above: float, upto: float) -> range:
        """Places of the words whose top is above ``above`` and at most ``upto``."""
        return range(bisect_right(self.y, above), bisect_right(self.y, max(above, upto)))

    def first_row(self, ids: list[int]) -> list[int]:
        """The words in order up to the first that is not within tolerance of the first of all."""
        y, h = self.y[ids[0]], self.h[ids[0]]
        for n, k in enumerate(ids):
            if abs(self.y[k] - y) * 10 > 6 * max(self.h[k], h):
                return ids[:n]
        return ids

    def by_x(self, ids: Iterable[int]) -> list[int]:
        return sorted(ids, key=self.x.__getitem__)

    def text(self, ids: Iterable[int]) -> str:
        return " ".join(self.t[k].as_py() or "" for k in self.by_x(ids))

    def tier(self, ids: list[int]) -> bool:
        line = [{"x": self.x[k], "y": self.y[k], "w": self.w[k], "h": self.h[k], "real": self.real[k]} for k in self.by_x(ids)]
        return tiered(line) if self.ink is None else is_tier(line, self.ink, self.sides)

    def _parting(self, a: int, b: int) -> tuple[np.ndarray, list[int]]:
        """How dark columns are on rows, and where a clear gutter or a column rule stands."""
        if (a, b) not in self._walls:
            if self._rules is None:
                self._rules = column_rules(self.ink)
            last = min(len(self.ink), max(a + 1, b))
            dark = inked(self.ink[a:last]) / max(1, last - a)
            places = self.sides[darkest_least(dark, self.sides) <= CROSSED, 0].tolist()
            self._walls[a, b] = dark, places + [x for x, r0, r1 in self._rules if 2 * (min(r1, b) - max(r0, a)) >= max(1, b - a)]
        return self._walls[a, b]

    def walls(self, top: int, bottom: int) -> Callable[[int, int], bool]:
        """Whether something parts two words of the rows: a clear gutter or a column rule between them, or a printed rule in the gap itself."""
        if self.ink is None:
            return lambda a, z: False
        height = len(self.ink)
        rows = min(max(0, top), height), min(max(0, bottom), height)

        def parted(left: int, right: int) -> bool:
            dark, places = self._parting(*rows)
            gap = dark[max(0, left + 1) : max(0, right - 1)]
            return any(left < g < right for g in places) or bool(len(gap) and gap.max() >= GAP_RULE)

        return parted

    def whole_line(self, ids: list[int]) -> list[int]:
        """A part of a printed line with the rest of it on both sides: words of like size with their middle on its rows, each within a word's gap
        of the last and nothing in between. The part itself, where the whole were a tier of several items."""
        ids = self.by_x(ids)
        x, right, own = self.x, self.right, set(ids)
        top, bottom, tall = min(self.y[k] for k in ids), max(self.under[k] for k in ids), max(self.h[k] for k in ids)
        like = lambda k: 2 * top <= 2 * self.y[k] + self.h[k] <= 2 * bottom and PEER[0] * tall <= 100 * self.h[k] <= PEER[1] * tall
        near = self.by_x(k for k in self.between(top - PEER[1] * tall / 100 - 1, bottom) if k not in own and like(k))
        parted, lo, hi, grown = self.walls(top, bottom), x[ids[0]], right[ids[-1]], list(ids)
        far = lambda gap, k: gap * 10 > round(SPLIT_GAP * 10) * max(tall, self.h[k])
        for k in [k for k in near if right[k] <= lo][::-1]:
            if far(lo - right[k], k) or parted(right[k], lo):
                break
            grown.insert(0, k)
            lo = x[k]
        for k in [k for k in near if x[k] >= hi]:
            if far(x[k] - hi, k) or parted(hi, x[k]):
                break
            grown.append(k)
            hi = right[k]
        return ids if len(grown) == len(ids) or self.tier(grown) else grown

    def deck(self, ids: list[int]) -> tuple[tuple[int, int, int, int], int, str, float | None, str | None]:
        """(box, lines, stop, ratio, said) of the item that begins with a segment's words."""
        least, most = lambda c, ids: min(c[k] for k in ids), lambda c, ids: max(c[k] for k in ids)
        x0, x1, y0, end, head = least(self.x, ids), most(self.right, ids), least(self.y, ids), most(self.under, ids), most(self.h, ids)
        left, right, top, tall = x0, x1, y0, head
        within = lambda ids: [k for k in ids if self.right[k] > x0 and self.x[k] < x1]
        for n in range(1, LINES + 1):
            met = within(self.between(top + tall / 2, end + 1.5 * head))
            if not met:
                return (left, y0, right, end), n, *self._below(within, end, 1.5 * head)
            line = self.first_row(met)
            size, taken = most(self.h, line), False
            if 100 * size > OVER * head:
                return (left, y0, right, end), n, "other item", None, self.text(line)
            if 100 * size >= SAME * head:
                line = self.whole_line(line)
                shared = min(most(self.right, line), x1) - max(least(self.x, line), x0)
                taken = 100 * shared >= FILLS * (x1 - x0)
            elif 100 * size >= DECK * head and 100 * size >= BODY * self.median:
                if 100 * size > GROWN * tall and not (self.t[self.by_x(line)[0]].as_py() or "")[:1].islower():
                    return (left, y0, right, end), n, "deck grew", None, self.text(line)
                taken = True
            if not taken or self.tier(line):
                return (left, y0, right, end), n, "tier" if taken else "boundary", None, self.text(line)
            line = self.whole_line(line)
            left, right = min(left, least(self.x, line)), max(right, most(self.right, line))
            top, tall, end = least(self.y, line), most(self.h, line), most(self.under, line)
            if end - y0 > DEEP * head:
                return (left, y0, right, end), n + 1, "deep", None, None
        return (left, y0, right, end), LINES + 1, "lines", None, None

    def _below(self, within: Callable, end: int, reach: float) -> tuple[str, float | None, str | None]:
        """What lies under an item whose window is empty: nothing, or a line and by what share of the window it is too far."""
        first = next((k for at in range(bisect_right(self.y, end), len(self.y), 256) for k in within(range(at, min(len(self.y), at + 256)))), None)
        if first is None:
            return "end", None, None
        row = self.first_row(within(self.between(self.y[first] - 1, self.y[first] + 0.6 * self.tallest)))
        return "gap", (float(min(self.y[k] for k in row)) - end - reach) / reach if reach else None, self.text(row)


def deck_items(words: DataFrame, segments: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """word(page_key, wid, x, y, w, h, t) and segment(page_key, segment, wid) to (page_key, segment, x, y, w, h, lines, stop, ratio, said).

    An item is its segment and the lines chained under it, one at a time and judged by their tallest word: one of the headline's size that fills most of its span, or
    a smaller one that is clearly display and no taller than the line above (one that begins in lower case may be). ``stop`` says what ended it: ``other item``
    (a taller line), ``deck grew``, ``boundary`` (body, or another column's line), ``tier`` (several items side by side), ``deep``, ``lines`` (eight), ``gap``
    (the next line is too far, by ``ratio`` of the reach) or ``end`` (there is none). ``said``: the line at which it stopped. The box is null where it is deeper than 30 % of the page.
    Without ``pages`` (page_key, w, h, strokes), or for a page that has no image, gaps alone tell tiers and a page is as high as its words. Words of a null
    page, and segments of no known word, have no row; a word twice in a page keeps its first place.
    """
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in ("y", "x", "wid", "w", "h")], F.col("t"), worded(F.coalesce("t", F.lit(""))).alias("real"))
    rows = words.where("page_key is not null").groupBy("page_key").agg(F.sort_array(F.collect_list(one)).alias("words"))
    starts = segments.groupBy("page_key", "segment").agg(F.sort_array(F.collect_list(F.col("wid").cast("long"))).alias("wids"))
    rows = rows.join(starts.groupBy("page_key").agg(F.collect_list(F.struct(F.col("segment").cast("long").alias("segment"), "wids")).alias("starts")), "page_key")
    if pages is None:
        rows = rows.selectExpr("page_key", "words", "starts", "cast(null as int) as pw", "cast(null as int) as ph", "array() as strokes")
    else:
        sized = pages.select("page_key", F.col("w").alias("pw"), F.col("h").alias("ph"), "strokes")
        rows = rows.join(sized, "page_key", "left").select("page_key", "words", "starts", "pw", "ph", "strokes")
    longs = ["x", "y", "w", "h", "lines"]
    schema = pa.schema([("page_key", pa.int64()), ("segment", pa.int64()), *[(c, pa.int64()) for c in longs], ("stop", pa.string()), ("ratio", pa.float64()), ("said", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, said, starts, pw, ph, row = (b.column(c)[k] for c in ("page_key", "words", "starts", "pw", "ph", "strokes"))
                ink, sides = None, []
                if pw.as_py() is not None:
                    found, size = stroke_rows(row), (pw.as_py(), ph.as_py())
                    ink, sides = bitmap(found, *size), [g[:2] for g in page_gutters(found, *size)[2]]
                page = _Page(said, ink, sides)
                at = page.places()
                high = ph.as_py() or max([0, *page.under])
                for s in starts.as_py():
                    ids = sorted({at[w] for w in s["wids"] if w in at})
                    if ids:
                        (x0, y0, x1, y1), *told = page.deck(ids)
                        box = (x0, y0, x1 - x0, y1 - y0) if y1 - y0 <= MOST * high else (None,) * 4
                        out.append((key.as_py(), s["segment"], *box, *told))
            yield batch_of(out, schema)

    return rows.mapInArrow(run, "page_key long, segment long, " + ", ".join(f"{c} long" for c in longs) + ", stop string, ratio double, said string")


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.withColumn("segment", F.dense_rank().over(W.partitionBy("page_key").orderBy(*by)).cast("long"))


def lane_items(words: DataFrame, pages: DataFrame, lane: str = "headline", floors: DataFrame | None = None) -> DataFrame:
    """(page_key, item, x0, y0, x1, y1, top, text): a page's headlines (its upper half) or display advertisements (its lower half), top first, closed to their cells.

    Segments are the page's display rows; a headline's begins under ``floors`` (page_key, floor), such as the nameplate's band, and is cut at clear gutters. A
    headline's cell never begins above its own first line (``top``); an advertisement's sides and ends are printed rules. Items that can't be closed, or fill over 30 % of the page, have no row.
    """
    sized = pages.select("page_key", F.col("h").alias("ph"))
    rows = _numbered(P.shown_rows(words), ["row_id", "group_id", "piece"])
    lo, hi = BANDS[lane]
    top = F.min("y").over(W.partitionBy("page_key", "segment"))
    rows = rows.withColumn("_top", top).join(sized, "page_key").where((F.col("_top") >= lo * F.col("ph")) & (F.col("_top") < hi * F.col("ph")))
    if lane == "headline":
        if floors is not None:
            rows = rows.join(floors.select("page_key", "floor"), "page_key", "left").where("floor is null or _top > floor")
        kept = gutter_pieces(rows.select("page_key", "segment", "wid", "x", "y", "w", "h", "t"), pages).select("page_key", "segment", "wid", "kept")
        rows = _numbered(rows.join(kept, ["page_key", "segment", "wid"]).withColumnRenamed("segment", "_row"), ["_row", "kept"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "wid", "t"))), lambda s: s["t"]), " ").alias("text")
    rows = written(rows.select("page_key", "segment", "wid", "x", "t"))
    found = deck_items(words, rows.select("page_key", "segment", "wid"), pages).where("x is not null")
    # Read for the boxes and again for the texts.
    items = written(found.join(rows.groupBy("page_key", "segment").agg(text), ["page_key", "segment"]).select("page_key", F.col("segment").alias("item"), "x", "y", "w", "h", "text"))
    boxes = items.drop("text")
    cells = written(snap(boxes, pages, mode="paper") if lane == "headline" else snap(boxes, pages, rules_only=True, border=True))
    cells = cells.join(items.select("page_key", "item", F.col("y").alias("top"), "text"), ["page_key", "item"]).join(sized, "page_key")
    if lane == "headline":
        cells = cells.withColumn("y0", F.greatest("y0", "top"))
    # Nulls of boxes that could not be closed fail the test too.
    return cells.where((F.col("y1") - F.col("y0") <= MOST * F.col("ph")) & F.col("x0").isNotNull()).select("page_key", "item", "x0", "y0", "x1", "y1", "top", "text")
