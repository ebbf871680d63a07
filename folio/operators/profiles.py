"""Row and column profiles of a page: ink threshold, shares from prefix sums, isolated rules, film insets, and cells covered by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
INK_LEAST, INK_SHARE = 25, 0.40
CANDIDATE, MOST_RUN, ISOLATION, PAPER = 0.30, 2, 2, 0.15
INSET = 0.05
SUB = 4


def ink_threshold(greys: Column) -> Column:
    """The grey below which a pixel is ink, from a sample of a page's greys: a share of the way from paper, the median, to dark, the twentieth; null for no sample."""
    order = F.array_sort(greys)
    n = F.size(order)
    paper, dark = F.get(order, F.floor(n / 2).cast("int")), F.get(order, F.floor(n / 20).cast("int"))
    return paper - F.greatest(F.lit(INK_LEAST), F.floor(INK_SHARE * (paper - dark)).cast("int"))


def prefix_counts(ink: Column) -> Column:
    """Ink before each place of a row and at its end, from an array of 0 and 1: n + 1 counts."""
    return F.aggregate(ink, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def span_share(counts: Column, x0: Column, x1: Column) -> Column:
    """The share of ink in [x0, x1) by two lookups in ``prefix_counts``."""
    return (F.get(counts, x1) - F.get(counts, x0)) / F.greatest(F.lit(1), x1 - x0)


def isolated_rules(profile: DataFrame) -> DataFrame:
    """(page_key, r, dark), a row each, to (page_key, y0, y1): runs of dark rows, ``MOST_RUN`` at most, with paper ``ISOLATION`` rows to either side.

    At the profile's ends there may be fewer rows, or none, beside a run. A null dark counts as paper.
    """
    page = W.partitionBy("page_key").orderBy("r")
    near = lambda a, b: F.coalesce(F.max("d").over(page.rowsBetween(a, b)), F.lit(0.0))
    rows = profile.withColumn("d", F.coalesce(F.col("dark"), F.lit(0.0))).withColumn("on", F.col("d") >= CANDIDATE)
    rows = rows.withColumns({"before": near(-ISOLATION, -1), "after": near(1, ISOLATION), "group": F.col("r") - F.sum(F.col("on").cast("long")).over(page)})
    runs = rows.where("on").groupBy("page_key", "group").agg(F.min("r").alias("y0"), (F.max("r") + 1).alias("y1"), F.min_by("before", "r").alias("before"), F.max_by("after", "r").alias("after"))
    return runs.where((F.col("y1") - F.col("y0") <= MOST_RUN) & (F.col("before") <= PAPER) & (F.col("after") <= PAPER)).select("page_key", "y0", "y1")


def inside_film(x: Column, w: Column, film0: Column, film1: Column) -> Column:
    """struct(x0, x1): the span with the film's edges and a share of what is left cut off; the span itself where nothing would be left."""
    a, b = F.greatest(x, film0), F.least(x + w, film1)
    inset = F.greatest(F.lit(3), ((b - a) * INSET).cast("long"))
    left = b - inset > a + inset
    return F.struct(F.when(left, a + inset).otherwise(x).alias("x0"), F.when(left, b - inset).otherwise(x + w).alias("x1"))


def cell_cover(words: DataFrame, rows: int, columns: int) -> DataFrame:
    """(page_key, x, y, w, h, page_w, page_h) to (page_key, r, c, cover): the share of ``SUB`` by ``SUB`` parts of a cell that any word box touches.

    Cells that no word touches are missing. Boxes are united, so two words on one part count once.
    """
    sw, sh = columns * SUB, rows * SUB
    low = lambda v, n, page: F.greatest(F.lit(0).cast("long"), F.floor(F.col(v) * n / F.col(page)))
    high = lambda v, d, n, page: F.least(F.lit(n).cast("long"), F.floor((F.col(v) + F.col(d)) * n / F.col(page)) + 1) - 1
    span = lambda a, b: F.when(a <= b, F.sequence(a, b))
    parts = words.withColumn("sy", F.explode(span(low("y", sh, "page_h"), high("y", "h", sh, "page_h")))).withColumn("sx", F.explode(span(low("x", sw, "page_w"), high("x", "w", sw, "page_w"))))
    cell = parts.select("page_key", F.floor(F.col("sy") / SUB).alias("r"), F.floor(F.col("sx") / SUB).alias("c"), F.call_function("shiftleft", F.lit(1), ((F.col("sy") % SUB) * SUB + F.col("sx") % SUB).cast("int")).alias("bit"))
    return cell.groupBy("page_key", "r", "c").agg((F.bit_count(F.bit_or("bit")) / (SUB * SUB)).alias("cover"))


def from_ocr(x: Column, y: Column, w: Column, h: Column, scale: Column) -> Column:
    """A box in the small page's pixels, cut to whole ones, at least one wide and high."""
    whole = lambda v: (v * scale).cast("long")
    return F.struct(whole(x).alias("x"), whole(y).alias("y"), F.greatest(F.lit(1), whole(w)).alias("w"), F.greatest(F.lit(1), whole(h)).alias("h"))


def to_ocr(x: Column, y: Column, w: Column, h: Column, scale: Column) -> Column:
    """A box back in OCR units, rounded half to even."""
    near = lambda v: F.bround(v / scale).cast("long")
    return F.struct(near(x).alias("x"), near(y).alias("y"), near(w).alias("w"), near(h).alias("h"))
