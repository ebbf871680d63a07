"""Profiles and runs over inked cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.layout import by_page, islands, listed, page_slices, whole_pages


#: Grid cells that a task spreads out at once.
GRID = 1 << 25
#: Pages whose bits a task spreads out at once.
PAGES = 200


def row_dark(cells: DataFrame) -> DataFrame:
    return cells.groupBy("page_key", "r").agg((F.sum("ink") / F.count("*")).alias("dark"))


def runs(profile: DataFrame, key: str, test, least: int = 1) -> DataFrame:
    """Maximal runs (page_key, x0, x1) of places where ``test`` holds, of at least ``least``; the last is closed at the end."""
    w = W.partitionBy("page_key").orderBy(key)
    rows = profile.where(test).withColumn("_new", F.col(key) != F.lag(key).over(w) + 1)
    found = islands(rows, ["page_key"], [key], F.col("_new")).groupBy("page_key", "island").agg(F.min(key).alias("x0"), F.max(key).alias("x1"))
    return found.where(F.col("x1") - F.col("x0") + 1 >= least).drop("island")


def packed(cells: DataFrame) -> DataFrame:
    """(page_key, rows): a page's cells in one row, array of (r, k, has, inked), where bit i of two longs stands for column 64 k + i.

    Bits are joined in a hash table, so cells are neither sorted nor spilled; cells without a row or column have no place and go."""
    c = F.col("c").cast("long")
    bit = F.expr("shiftleft(1L, cast(pmod(cast(c as long), 64L) as int))")
    words = cells.where("r is not null and c is not null").groupBy("page_key", F.col("r").cast("long").alias("r"), F.shiftright(c, 6).alias("k")).agg(F.bit_or(bit).alias("has"), F.coalesce(F.bit_or(F.when(F.col("ink") == 1, bit)), F.lit(0)).alias("inked"))
    return words.groupBy("page_key").agg(F.collect_list(F.struct("r", "k", "has", "inked")).alias("rows"))


def bits(words: np.ndarray) -> np.ndarray:
    """Longs to a row of 64 bits each."""
    return np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def row_span(cells: DataFrame, gap: int = 1) -> DataFrame:
    """The longest stroke of each row, gaps of up to ``gap`` bridged and counted."""
    schema = pa.schema([(k, pa.int64()) for k in ("page_key", "r", "span")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                ends, (r, k, inked) = listed(part.column(1), "r", "k", "inked")
                number = np.repeat(np.arange(part.num_rows), np.diff(ends))
                order = np.lexsort((k, r, number))
                number, r, k = number[order], r[order], k[order]
                word, bit = np.nonzero(bits(inked[order]))
                c, line = 64 * k[word] + bit, np.cumsum(np.append(0, (np.diff(number) != 0) | (np.diff(r) != 0)))[word]
                first = np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(c) - 1 > gap)))
                size = c[np.append(first[1:], len(c)) - 1] - c[first] + 1
                row = np.flatnonzero(np.append(True, np.diff(line[first]) != 0))
                of = word[first[row]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(number[of])), pa.array(r[of]), pa.array(np.maximum.reduceat(size, row))], schema=schema)

    pages = packed(cells.where("ink = 1").withColumn("page_key", F.col("page_key").cast("long")))
    return pages.mapInArrow(run, "page_key long, r long, span long")


def close_cells(cells: DataFrame, least: int = 5) -> DataFrame:
    """One closing pass: a cell with at least five of eight inked neighbours is inked; all cells change at once."""
    schema = pa.schema([("page_key", pa.int64()), ("r", pa.int64()), ("c", pa.int64()), ("ink", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pages(batches, 200_000):
            page, r, c, ink = (x.to_numpy() for x in t.columns)
            number = np.cumsum(np.concatenate(([0], page[1:] != page[:-1])))
            low, wide, high = c.min() - 1, int(c.max() - c.min()) + 3, int(r.max() - r.min()) + 3
            at = (number * high + r - r.min() + 1) * wide + c - low
            near = np.zeros(len(at), np.int8)
            for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(number // max(1, GRID // (wide * high)))) + 1):  # pages of some grid cells at once
                base = at[k].min() - wide - 1
                inked = np.zeros(int(at[k].max() - base) + wide + 2, bool)
                inked[at[k][ink[k] == 1] - base] = True
                near[k] = sum(inked[at[k] - base + i * wide + j].astype(np.int8) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (page, r, c, np.maximum(ink, near >= least).astype(np.int64))], schema=schema)

    rows = cells.select(*[F.col(k).cast("long").alias(k) for k in ("page_key", "r", "c", "ink")])
    return by_page(rows, []).mapInArrow(run, "page_key long, r long, c long, ink long")


def col_dark(cells: DataFrame) -> DataFrame:
    """(page_key, c, dark): ink share by column, of every second row."""
    return cells.where("r % 2 = 0").groupBy("page_key", "c").agg((F.sum("ink") / F.count("*")).alias("dark"))


def film_edges(columns: DataFrame, edge: float = 0.55) -> DataFrame:
    """(page_key, x0, x1): the columns between the dark runs at both edges, half-open; both are the width if all are dark."""
    paper = F.when(F.col("dark") <= edge, F.col("c"))
    width = F.max("c") + 1
    return columns.groupBy("page_key").agg(F.coalesce(F.min(paper), width).alias("x0"), F.coalesce(F.max(paper) + 1, width).alias("x1"))


def gutters(columns: DataFrame, paper: float = 0.10, rule: float = 0.45) -> DataFrame:
    """(page_key, kind, x0, x1): runs inside the film of paper, at least two wide, or of rule; half-open."""
    kind = F.when(F.col("dark") <= paper, "paper").when(F.col("dark") >= rule, "rule")
    rows = columns.join(film_edges(columns), "page_key").where("c >= x0 and c < x1").select("page_key", "c", kind.alias("kind")).where("kind is not null")
    w = W.partitionBy("page_key", "kind").orderBy("c")
    found = islands(rows.withColumn("_new", F.col("c") != F.lag("c").over(w) + 1), ["page_key", "kind"], ["c"], F.col("_new"))
    found = found.groupBy("page_key", "kind", "island").agg(F.min("c").alias("x0"), (F.max("c") + 1).alias("x1"))
    return found.where("kind = 'rule' or x1 - x0 >= 2").drop("island")


def vrules(cells: DataFrame, height: int, least: float, edge: float = 0.55) -> DataFrame:
    """(page_key, x, y0, y1): columns' longest strokes of at least a share of the page, breaks bridged, merged when within two columns.

    A stroke that ends inside the page ends at its last inked row; one that reaches the bottom ends after it.
    """
    gap, need = max(2, int(height * 0.004)), int(height * least)
    dark = col_dark(cells).where(F.col("dark") <= edge).select("page_key", "c")
    w = W.partitionBy("page_key", "c").orderBy("r")
    rows = cells.where("ink = 1").join(dark, ["page_key", "c"], "left_semi").withColumn("_new", F.col("r") - F.lag("r").over(w) - 1 > gap)
    runs_ = islands(rows, ["page_key", "c"], ["r"], F.col("_new")).groupBy("page_key", "c", "island").agg(F.min("r").alias("y0"), F.max("r").alias("_last"))
    runs_ = runs_.withColumn("y1", F.col("_last") + F.when(height - 1 - F.col("_last") <= gap, 1).otherwise(0)).withColumn("_n", F.col("y1") - F.col("y0"))
    best = runs_.groupBy("page_key", "c").agg(F.max_by(F.struct("y0", "y1", "_n"), F.struct("_n", -F.col("y0"))).alias("s")).select("page_key", "c", "s.*").where(F.col("_n") >= need)
    w = W.partitionBy("page_key").orderBy("c")
    merged = islands(best.withColumn("_new", F.col("c") - F.lag("c").over(w) > 2), ["page_key"], ["c"], F.col("_new"))
    return merged.groupBy("page_key", "island").agg(F.floor(F.avg("c")).alias("x"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).drop("island")


def _labels(number: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of cells in order of page, row and column, without repeats: the first cell's place in each one's component."""
    wide, high = int(c.max() - c.min()) + 2, int(r.max() - r.min()) + 2
    at = (number * high + r - r.min()) * wide + c - c.min()
    below = np.searchsorted(at, at + wide)
    met = np.flatnonzero(at[np.minimum(below, len(at) - 1)] == at + wide)
    beside = np.flatnonzero(np.diff(at) == 1)
    p, q = np.concatenate((beside, met)), np.concatenate((beside + 1, below[met]))
    root = np.arange(len(at))
    while True:  # the larger of two roots that touch hangs below the smaller; then every cell is led to its root
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def components(cells: DataFrame) -> DataFrame:
    """(page_key, r, c, component): inked cells joined over their four sides; a component's number is its first cell's r * 10000 + c.

    Pages stream through a task, many at once; labels spread over any distance within a page.
    """
    schema = pa.schema([(k, pa.int64()) for k in ("page_key", "r", "c", "component")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_pages(batches, 200_000):
            number = np.concatenate([np.full(b - a, k) for k, (a, b) in enumerate(page_slices(t))])
            r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
            order = np.lexsort((c, r, number))
            number, r, c = number[order], r[order], c[order]
            first = np.append(True, (np.diff(number) != 0) | (np.diff(r) != 0) | (np.diff(c) != 0))
            order, number, r, c = order[first], number[first], r[first], c[first]
            root = _labels(number, r, c)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(pa.array(order)), *map(pa.array, (r, c, r[root] * 10000 + c[root]))], schema=schema)

    rows = cells.where("ink = 1").select(*[F.col(k).cast("long").alias(k) for k in ("page_key", "r", "c")])
    return by_page(rows, []).mapInArrow(run, "page_key long, r long, c long, component long")


def component_stats(labels: DataFrame) -> DataFrame:
    """Area, extent and fill by component."""
    out = labels.groupBy("page_key", "component").agg(F.count("*").alias("area"), F.min("c").alias("x0"), F.min("r").alias("y0"), F.max("c").alias("x1"), F.max("r").alias("y1"))
    return out.withColumn("fill", F.col("area") / ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)))


def thin_rules(profile: DataFrame, dark: float = 0.45, most: int = 2) -> DataFrame:
    """(page_key, r): rows of printed rules, which are dark and in runs no taller than a rule."""
    rows = runs(profile, "r", F.col("dark") >= dark).where(F.col("x1") - F.col("x0") < most)
    return rows.select("page_key", F.explode(F.sequence("x0", "x1")).alias("r"))


def clear_share(profile: DataFrame, paper: float = 0.02) -> DataFrame:
    """(page_key, clear): the share of rows that are paper."""
    return profile.groupBy("page_key").agg(F.avg((F.col("dark") <= paper).cast("double")).alias("clear"))


def row_crossing(cells: DataFrame, stride: int, edge: float = 0.55) -> DataFrame:
    """(page_key, r, share): columns inked both at a row and ``stride`` below it (at most the last row); columns of film's edge, unless they are over half, do not count.

    A page's cells meet in one row, as bits."""
    schema = pa.schema([("page_key", pa.int64()), ("r", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                ends, fields = listed(part.column(1), "r", "k", "has", "inked")
                found = [_crossed(*[f[i:j] for f in fields], stride, edge) for i, j in zip(ends[:-1], ends[1:])]
                page = np.repeat(np.arange(part.num_rows), [len(r) for r, _ in found])
                r, share = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(page)), pa.array(r), pa.array(share)], schema=schema)

    pages = packed(cells.where("ink is not null").withColumn("page_key", F.col("page_key").cast("long")))
    return pages.mapInArrow(run, "page_key long, r long, share double")


def grid(r: np.ndarray, k: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """A page's rows in order, its first column, and for each kind of bits (rows, columns) of them."""
    rows, at = np.unique(r, return_inverse=True)
    low = int(k.min())
    out = []
    for w in words:
        held = np.zeros((len(rows), int(k.max()) - low + 1, 64), bool)
        held[at, k - low] = bits(w)
        out.append(held.reshape(len(rows), -1))
    return rows, 64 * low, out


def _crossed(r: np.ndarray, k: np.ndarray, has: np.ndarray, inked: np.ndarray, stride: int, edge: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their shares, see ``row_crossing``: a column's cells are counted, not its row numbers, so one that lacks cells is as they follow each other."""
    rows, _, (there, ink) = grid(r, k, has, inked)
    column, row = np.nonzero(there.T)
    value, many = ink.T[column, row], there.sum(axis=0)
    last = np.cumsum(many) - 1
    both = value & value[np.minimum(np.arange(len(value)) + stride, last[column])]
    kept = (ink.sum(axis=0) / np.maximum(1, many) < edge)[column]
    if kept.sum() / len(kept) < 0.5:
        kept[:] = True
    seen, share = np.bincount(row[kept], minlength=len(rows)), np.bincount(row[kept & both], minlength=len(rows))
    some = seen > 0
    return rows[some], share[some] / seen[some]
