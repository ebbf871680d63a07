"""Grouping word boxes: anchor folds, interval merges, neighbour gaps and histograms, by page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_page(rows: DataFrame, order: list[str]) -> DataFrame:
    """A page's rows together and in order, so that a fold can stream through many pages a task."""
    return rows.repartition("page_key").sortWithinPartitions("page_key", *order)


def whole_pages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole pages, of about ``least`` rows, from rows in order of their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if sum(x.num_rows for x in held) >= least:
            last = held[-1].column(0)[-1]
            same = next((k for k in range(b.num_rows) if b.column(0)[k] != last), b.num_rows)
            if same < b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(0, same)])
                held, b = [], b.slice(same)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def page_slices(t: pa.Table, *keys: str) -> list[tuple[int, int]]:
    """The first row and the end of each page, or of each value of more keys, in rows in their order; nulls are one page."""
    if not t.num_rows:
        return []
    new = np.zeros(t.num_rows - 1, bool)
    for k in keys or (t.column_names[0],):
        v = pc.fill_null(t.column(k), np.iinfo(np.int64).min).to_numpy()
        new |= v[1:] != v[:-1]
    at = np.flatnonzero(new) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), t.num_rows]))


def listed(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each list of structs begins, with the end behind the last, and fields of them all; nulls are NaN."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))).astype(np.int64)
    flat = lists.flatten()
    return ends, [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def rows_anchor(words: DataFrame, tenths: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """word to (page_key, wid, row_id) and the columns to ``keep``: a word joins the row while it is within tolerance of the row's *first* word.

    A fold in (y, x, wid) order: neighbours alone do not decide. Pages pass through a task one after another. What is kept need not be joined to the words again.
    """
    kinds = dict(words.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, row, fy, fh, begun = None, -1, 0, 0, False
        for b in batches:
            ids = []
            for key, y, h in zip(*(b.column(k).to_pylist() for k in ("page_key", "y", "h"))):
                if not begun or key != page:
                    page, row, begun = key, -1, True
                if row < 0 or abs(y - fy) * 10 > tenths * max(fh, h):
                    row, fy, fh = row + 1, y, h
                ids.append(row)
            yield pa.RecordBatch.from_arrays([b.column("page_key"), b.column("wid"), pa.array(ids, pa.int64()), *map(b.column, keep)], names=["page_key", "wid", "row_id", *keep])

    rows = words.select(F.col("page_key").cast("long").alias("page_key"), F.col("wid").cast("long").alias("wid"), "x", "y", "h", *[c for c in keep if c not in ("x", "y", "h")])
    return by_page(rows, ["y", "x", "wid"]).mapInArrow(fold, ", ".join(["page_key long, wid long, row_id long", *[f"{c} {kinds[c]}" for c in keep]]))


def reading_text(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_key, text): rows in order, words by x."""
    met = words.select("page_key", "wid", "x", "t").join(rows, ["page_key", "wid"])
    return met.groupBy("page_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "x", "wid", "t"))), lambda s: s["t"]), " ").alias("text"))


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the groups that begin where ``starts`` holds; keys and order say within what and how."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts.cast("long"), F.lit(0))).over(w))


def overlap_groups(words: DataFrame) -> DataFrame:
    """Interval merge: a group ends where the next top is at or below the running bottom of all before."""
    w = W.partitionBy("page_key").orderBy("y", "x", "wid")
    high = F.max(F.col("y") + F.col("h")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return islands(words.withColumn("_new", F.col("y") >= high), ["page_key"], ["y", "x", "wid"], F.col("_new"), "group_id").drop("_new")


def gap_pieces(words: DataFrame, line: Column) -> DataFrame:
    """Pieces of a line, apart where the gap in x is over 1.2 heights of the taller neighbour."""
    w = W.partitionBy("page_key", "line").orderBy("x", "wid")
    rows = words.withColumn("line", line).withColumns({"_end": F.lag(F.col("x") + F.col("w")).over(w), "_h": F.lag("h").over(w)})
    rows = rows.withColumn("_new", (F.col("x") - F.col("_end")) * 10 > 12 * F.greatest("h", "_h"))
    return islands(rows, ["page_key", "line"], ["x", "wid"], F.col("_new"), "piece").drop("_new", "_end", "_h")


def page_medians(words: DataFrame) -> DataFrame:
    """Exact median, and upper picks without interpolation: sorted[n // 2], sorted[n // 10], sorted[n // 20]."""
    pick = lambda k: F.element_at(F.col("hs"), (F.floor(F.size("hs") / k) + 1).cast("int"))
    rows = words.where("h > 0").groupBy("page_key").agg(F.median("h").alias("median_h"), F.sort_array(F.collect_list("h")).alias("hs"))
    return rows.select("page_key", "median_h", pick(2).alias("upper_half"), pick(10).alias("upper_tenth"), pick(20).alias("upper_twentieth"))


def display_words(words: DataFrame) -> DataFrame:
    """Words at least 1.2 % of the page and twice its median height, in its top 9 %."""
    page = words.groupBy("page_key").agg(F.median(F.when(F.col("h") > 0, F.col("h"))).alias("m"), F.max(F.col("y") + F.col("h")).alias("page_h"))
    return words.join(page.hint("shuffle_hash"), "page_key").where((F.col("h") >= F.greatest(F.col("page_h") * 0.012, 2.0 * F.col("m"))) & (F.col("y") <= F.col("page_h") * 0.09)).select(words.columns)


def density(words: DataFrame, bands: int = 40) -> DataFrame:
    """(page_key, band, n): words by 40 equal bands of y, zeros included."""
    page = words.groupBy("page_key").agg(F.max(F.col("y") + F.col("h")).alias("page_h"), F.count("*").alias("words"))
    # Pages are the side that is held, so that words are neither sorted nor moved again; bands are counted by page and filled in where the page's counts lie.
    counts = words.join(page.select("page_key", "page_h").hint("shuffle_hash"), "page_key").groupBy("page_key", F.floor(F.col("y") * bands / F.col("page_h")).alias("band")).agg(F.count("*").alias("n"))
    held = counts.groupBy("page_key").agg(F.collect_list(F.struct("band", "n")).alias("counts"))
    every = page.join(held, "page_key", "left").withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))))
    n = F.get(F.filter("counts", lambda v: v["band"] == F.col("band")), F.lit(0))["n"]
    return every.select("page_key", "band", "page_h", "words", F.coalesce(n, F.lit(0)).alias("n"))


def body_start(bands: DataFrame) -> DataFrame:
    """The first of two neighbouring bands that both hold at least 3 words and 2.5 % of the page's; null if there is none."""
    w = W.partitionBy("page_key").orderBy("band")
    dense = (F.col("n") >= 3) & (F.col("n") * 40 >= F.col("words"))
    rows = bands.withColumn("d", dense).withColumn("next", F.lead("d").over(w))
    return rows.groupBy("page_key").agg(F.min(F.when(F.col("d") & F.coalesce("next", F.lit(False)), F.col("band"))).alias("band"), F.max("page_h").alias("page_h")).select("page_key", (F.col("band") * F.col("page_h") / 40).alias("body_y"))


def grid_counts(words: DataFrame, n: int = 6) -> DataFrame:
    """Words by cell of a 6 x 6 grid over the words' extent, a word being where its centre is (half-open)."""
    page = words.groupBy("page_key").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    met = words.join(page, "page_key")
    cut = lambda v, size, lo, hi: F.floor((2 * F.col(v) + F.col(size) - 2 * F.col(lo)) * n / (2 * (F.col(hi) - F.col(lo))))
    return met.select("page_key", cut("x", "w", "x0", "x1").alias("gx"), cut("y", "h", "y0", "y1").alias("gy"), "t")


def phrase_hits(words: DataFrame, normed: Column, phrase: tuple[str, ...]) -> DataFrame:
    """(page_key, pos): the first place where consecutive normalised words start with the phrase's."""
    w = W.partitionBy("page_key").orderBy("wid")
    rows = words.withColumn("n", normed)
    test = F.lit(True)
    for k, p in enumerate(phrase):
        test = test & F.startswith(F.lead("n", k).over(w) if k else F.col("n"), F.lit(p))
    return rows.withColumn("hit", test).where("hit").groupBy("page_key").agg(F.min("wid").alias("pos"))
