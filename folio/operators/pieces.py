"""Lines of display type told apart at a page's gutters: one banner, or a tier of headlines side by side.

A page's words, in order of segments, and its strokes meet in one row a page, where its gutters are found and all segments are judged at once. On a segment's own rows, a gutter is straddled where even its clearest
column is inked. A banner's letters straddle the gutters between its word spaces and column headlines clear them, so a segment is cut only
where it clears at least as many gutters as it straddles, and then at every clear gutter that stands between two of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.strokes import CROSSED, col_dark, gutters, inked, page_gutters, worded  # noqa: F401
from folio.sources.images import bitmap, stroke_rows

# How dark a gap's darkest column is where a printed rule stands in it, and the widest word space, by the taller neighbour's height.
GAP_RULE, SPLIT_GAP, LETTERS = 0.5, 1.2, 3


def _cut(words: list[dict], starts: list[int]) -> list[int]:
    """The piece of each word, words in order of x: a new one where one of the places lies in the gap before it."""
    out = [0] if words else []
    for a, b in zip(words, words[1:]):
        out.append(out[-1] + any(a["x"] + a["w"] < g < b["x"] for g in starts))
    return out


def _singles(pieces: list[int]) -> bool:
    return any(pieces.count(p) < 2 for p in set(pieces))


def tiered(words: list[dict]) -> bool:
    """Whether word gaps alone make it several pieces with a real word."""
    pieces, real = [0] if words else [], set()
    for a, b in zip(words, words[1:]):
        pieces.append(pieces[-1] + (b["x"] - a["x"] - a["w"] > SPLIT_GAP * max(a["h"], b["h"])))
    for p, v in zip(pieces, words):
        if v["real"]:
            real.add(p)
    return len(real) > 1


def is_tier(words: list[dict], ink: np.ndarray, sides: np.ndarray) -> bool:
    """Whether a line is several items side by side, by word gaps or by pieces, on a page's bitmap; ``sides``: gutters as (first, end) in order."""
    if tiered(words):
        return True
    left, right = words[0]["x"], words[-1]["x"] + words[-1]["w"]
    inside = (sides[:, 0] > left) & (sides[:, 0] < right)
    if not inside.any():
        return False
    top = min(max(0, min(v["y"] for v in words)), len(ink))
    bottom = min(len(ink), max(top + 1, max(v["y"] + v["h"] for v in words)))
    clear = darkest_least(inked(ink[top:bottom]) / max(1, bottom - top), sides) <= CROSSED
    if 2 * np.count_nonzero(inside & ~clear) > np.count_nonzero(inside):
        return False
    pieces = _cut(words, sides[clear, 0].tolist())
    return pieces[-1] > 0 and not _singles(pieces)


def darkest_least(dark: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """How dark each gutter's clearest column is; rows of columns, if there are several, each for itself."""
    pad = [(0, 0)] * (dark.ndim - 1) + [(0, 1)]
    return np.minimum.reduceat(np.pad(dark, pad, constant_values=np.inf), sides.ravel(), axis=-1)[..., ::2] if len(sides) else dark[..., :0]


def _per(f: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return f.reduceat(values, first)


def _pieced(new: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece of each word by whether one begins with it, and for each segment whether a piece has one word alone."""
    new = new.copy()
    new[first] = True
    number = np.cumsum(new) - 1
    alone = np.bincount(number) == 1
    return number - np.repeat(number[first], size), np.logical_or.reduceat(alone, number[first])


def _judged(x, y, w, h, real, first, ink: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gutters inside, of them straddled) by segment, (piece, piece once splits to single words are refused) by word and whether a segment is a tier, for all segments of a page.

    Words of a segment stand together in order of x, and ``first`` says where each segment begins; ``sides``: gutters as (first, end) in order."""
    n, (height, wide) = len(x), ink.shape
    size = np.diff(np.append(first, n))
    of = np.repeat(np.arange(len(first)), size)
    right = x + w
    top = np.clip(_per(np.minimum, y, first), 0, height)
    bottom = np.minimum(height, np.maximum(top + 1, _per(np.maximum, y + h, first)))
    dark = np.stack([inked(ink[a:b]) for a, b in zip(top.tolist(), bottom.tolist())]) / np.maximum(1, bottom - top)[:, None]
    # Nothing stands before a segment's first word.
    end = np.append(x[:1], right[:-1])
    end[first] = x[first]
    gap = x - end
    gap[first] = 0
    beside = np.ones(n, bool)
    beside[first] = False
    inside, straddled, new = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(n, bool)
    if len(sides):
        at = sides[:, 0]
        clear = darkest_least(dark, sides) <= CROSSED
        within = (at > x[first][:, None]) & (at < right[np.append(first[1:], n) - 1][:, None])
        inside, straddled = within.sum(axis=1), (within & ~clear).sum(axis=1)
        cut = (inside > 0) & (straddled <= inside - straddled)
        new = ((end[:, None] < at) & (at < x[:, None]) & clear[of]).any(axis=1) & cut[of] & beside
    piece, alone = _pieced(new, first, size)
    kept, single = piece, alone
    if alone.any():  # a coincidence of the grid, but for a printed rule between words
        upto = np.pad(np.cumsum(dark >= GAP_RULE, axis=1), ((0, 0), (1, 0)))
        lo, hi = end + 1, np.maximum(0, x - 1)
        lo, hi = np.clip(np.where(lo < 0, lo + wide, lo), 0, wide), np.minimum(hi, wide)
        found = (upto[of, np.maximum(lo, hi)] > upto[of, lo]) & beside
        kept, single = _pieced(np.where(alone[of], found, new), first, size)
    whole = single | (_per(np.maximum, kept, first) < 1)
    kept = np.where(whole[of], 0, kept)
    before = np.append(h[:1], h[:-1])
    parts = np.cumsum((gap > SPLIT_GAP * np.maximum(before, h)) & beside)
    least, most = _per(np.minimum, np.where(real, parts, n + 1), first), _per(np.maximum, np.where(real, parts, -1), first)
    tier = (most >= 0) & (most > least) | (_per(np.maximum, piece, first) > 0) & ~alone
    return inside, straddled, piece, kept, tier


def gutter_pieces(words: DataFrame, pages: DataFrame) -> DataFrame:
    """word(page_key, segment, wid, x, y, w, h, t) to (page_key, segment, wid, inside, straddled, piece, kept, tier).

    ``inside`` and ``straddled``: gutters within the segment's span, and of them those that its ink crosses. ``piece``: where the clear ones cut it.
    ``kept``: the cut that stays, as pieces of one word are refused; in their place only printed rules between words cut. ``tier``: whether
    it is several items side by side, by word gaps or by pieces. Segments of a page without an image, or of an empty one, go uncut.
    """
    one = F.struct(*[F.col(c).cast("long").alias(c) for c in ("segment", "x", "wid", "y", "w", "h")], worded(F.col("t")).alias("real"))
    held = words.groupBy("page_key").agg(F.sort_array(F.collect_list(one)).alias("words"))
    rows = held.join(pages, "page_key", "left").select("page_key", "w", "h", "strokes", "words")
    names = ["page_key", "segment", "wid", "inside", "straddled", "piece", "kept"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("tier", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                key, w, h, row, said = (b.column(c)[k] for c in ("page_key", "w", "h", "strokes", "words"))
                ink, sides = np.zeros((1, 1), bool), np.zeros((0, 2), np.int64)
                if w.as_py() is not None:
                    found = stroke_rows(row)
                    ink, sides = bitmap(found, w.as_py(), h.as_py()), np.array([g[:2] for g in page_gutters(found, w.as_py(), h.as_py())[2]], np.int64).reshape(-1, 2)
                flat = said.values
                segment, wid = flat.field("segment"), flat.field("wid")
                x, y, wide, tall = (flat.field(c).to_numpy() for c in ("x", "y", "w", "h"))  # a null fails
                number = pc.fill_null(segment, np.iinfo(np.int64).min).to_numpy()
                first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                real = pc.fill_null(flat.field("real"), False).to_numpy(zero_copy_only=False)
                size = np.diff(np.append(first, len(x)))
                inside, straddled, piece, kept, tier = _judged(x, y, wide, tall, real, first, ink, sides)
                found = [pa.array(np.repeat(v, size)) for v in (inside, straddled)] + [pa.array(piece), pa.array(kept), pa.array(np.repeat(tier, size))]
                out.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key.as_py(), pa.int64()), len(x)), segment, wid, *found], schema=schema))
            yield from pa.Table.from_batches(out, schema).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", tier boolean")
