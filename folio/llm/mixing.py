"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources, in code-point order with null last, weigh 5, 2, 1 and so on and share 150 % of all
words; a target stops at twice its source's words, and the excess is shared anew by weight.
Blocks: a source's documents are shuffled by a hash and laid end to end on its line of words, which is cut into
equal blocks (but for rounding to words) of at most ``block`` words and at most a ``FINEST``-th of its own (one word at least), so that a source however small comes near its target; its slots are its target over their length.
Schedule: of N slots, slot t goes to the source in whose part of the unit interval the point frac((t * m mod N + 1/2) / N)
falls, m being about N times the golden ratio and without a common divisor, parts being in proportion to the slots. The points
are a permutation of equal steps, so a source however small gets its slots but for less than one. Slots are ranked
per source, and the r-th one takes the source's r-th block, starting over where the blocks end.

No source's rows are ever brought together: positions and ranks come from sums over buckets of bounded
size and then within buckets. Rows that are alike are rows apiece. A null or empty text has size 0 and is
taken 0 times. A source with no words has target 0. Reruns give the same: nothing depends on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import WORD, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK, FINEST = 256, 64
#: Rows in a bucket of a source's documents, or of slots, on average.
BUCKET = 4096
GOLDEN = 0.6180339887498949


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target), one row per source.

    Water-filling: by growing size per weight, a source keeps its cap while the level that the rest
    could then share is above it.
    """
    w = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("rank", F.row_number().over(w)).withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size").cast("double"))
    up = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = W.partitionBy()
    rows = rows.withColumns({"before": F.sum("cap").over(up) - F.col("cap"), "rest": F.sum("weight").over(every) - F.sum("weight").over(up) + F.col("weight"), "all": F.sum("source_size").over(every) * SHARE})
    level = (F.col("all") - F.col("before")) / F.col("rest")
    # The level rises over the sources that stop at their cap and falls after them, so its height is what the rest share.
    return rows.withColumn("target", F.least("cap", F.max(level).over(every) * F.col("weight"))).select("source", "source_size", "rank", "target")


def _before(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over what comes before each row in its group, by (bucket, order)."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_in"))
    sums = sums.withColumn("_upto", F.sum("_in").over(W.partitionBy(*group).orderBy(bucket)) - F.col("_in")).drop("_in")
    inside = F.sum(value).over(W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.join(sums, [*group, bucket]).withColumn(name, F.col("_upto") + F.coalesce(inside, F.lit(0))).drop("_upto")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, source) to doc_id, size, source_size, target, taken, source; one row per row."""
    return _mix(docs, block).drop("same")


def _mix(docs: DataFrame, block: int) -> DataFrame:
    """``mix`` with ``same``, a hash of the text."""
    sized = save(docs.select(F.xxhash64(F.col("text").cast("string")).alias("same"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = targets(per).join(per.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / F.least(F.lit(block), F.greatest(F.lit(1.0), F.col("source_size") / FINEST)))).withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    parts = goals.withColumn("upto", F.sum("slots").over(W.orderBy("rank"))).withColumn("from", F.col("upto") - F.col("slots"))
    parts = save(parts.withColumn("total", F.sum("slots").over(W.partitionBy())), "goals")
    total = parts.agg(F.max("total"), F.count("*")).first()
    slots_n = round(total[0] or 0)
    step = next((m for m in range(max(1, round(slots_n * GOLDEN)), slots_n + 1) if math.gcd(m, slots_n) == 1), 1)

    # Each source's line of words.
    key = F.xxhash64("doc_id", "same", F.lit("mix"))
    rows = sized.join(parts.select(F.col("source").alias("_s"), "rank", "rows"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumns({"key": key, "bucket": F.pmod(F.shiftright(key, 20), F.ceil(F.col("rows") / BUCKET))}).drop("rows", "_s")
    order = ["key", "doc_id", "size", "same"]
    rows = _before(rows, ["rank"], "bucket", order, F.col("size"), "start")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("rank", "bucket").orderBy(*order)))

    # The schedule: how often each block of a source is taken.
    unit = (F.pmod(F.col("id") * F.lit(step).cast("long"), F.lit(max(1, slots_n)).cast("long")) + 0.5) / max(1, slots_n)
    point = unit * F.col("total")
    slots = docs.sparkSession.range(slots_n).withColumn("bucket", F.floor(F.col("id") / BUCKET))
    edges = parts.where("slots > 0").agg(F.sort_array(F.collect_list(F.struct("upto", "rank", "blocks"))).alias("parts"), F.max("total").alias("total")) if total[1] <= 4096 else None
    if edges is not None:  # few sources, counted: their parts go along as an array
        slots = slots.join(F.broadcast(edges)).withColumn("at", F.element_at(F.filter("parts", lambda p: p["upto"] > point), 1)).select("id", "bucket", "at.rank", "at.blocks")
    else:  # sources and slots in cells of the unit interval, so that each slot meets few sources
        cells = max(1, int(total[1]))
        spread = parts.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / F.col("total") * cells), F.least(F.floor(F.col("upto") / F.col("total") * cells), F.lit(cells - 1)))))
        slots = slots.withColumn("u", unit).withColumn("cell", F.floor(F.col("u") * cells))
        slots = slots.join(spread, "cell").where("u * total >= `from` and u * total < upto").select("id", "bucket", "rank", "blocks")
    slots = _before(slots.where("rank is not null"), ["rank"], "bucket", ["id"], F.lit(1).cast("long"), "nth")
    slots = slots.where(F.col("nth") < CAP * F.col("blocks"))
    taken = slots.groupBy("rank", F.pmod("nth", "blocks").alias("block")).agg(F.count("*").alias("times"))

    # Documents meet the blocks that they lie in: word w in block w * blocks div source_size.
    lies = rows.join(parts.select("rank", "source_size", F.col("blocks").alias("_blocks")), "rank").where("size > 0")
    lies = lies.withColumn("block", F.explode(F.expr("sequence(start * _blocks div source_size, (start + size - 1) * _blocks div source_size)")))
    first = lambda b: F.expr(f"({b} * source_size + _blocks - 1) div _blocks")
    over = F.least(F.col("start") + F.col("size"), first("(block + 1)")) - F.greatest(F.col("start"), first("block"))
    got = lies.withColumn("over", over).join(taken, ["rank", "block"]).groupBy("rank", "bucket", "nth").agg(F.sum(F.col("over") * F.col("times")).alias("taken"))
    out = rows.join(got, ["rank", "bucket", "nth"], "left").join(parts.select("rank", "source_size", "target"), "rank")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "same")


def resample(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: each as often as it is taken whole, and once more from half of its size on; columns stay.

    Rows that share doc_id and text are taken as the mean of them; rows with a null doc_id are kept once.
    Names that begin with __folio_ are reserved; an empty table gives an empty one.
    """
    plan = _mix(docs, block)
    times = plan.where("size > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("__folio_id"), F.col("same").alias("__folio_same")).agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("__folio_times"))
    named = docs.where("doc_id is not null").withColumns({"__folio_id": F.col("doc_id").cast("long"), "__folio_same": F.xxhash64(F.col("text").cast("string"))}).join(times.where("__folio_times > 0"), ["__folio_id", "__folio_same"])
    named = named.withColumn("__folio_copy", F.explode(F.array_repeat(F.lit(1), F.col("__folio_times"))))
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return mix(table(spark, sf_dir, "documents"))
