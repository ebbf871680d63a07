"""Deterministic, seeded and stratified choice, and logs folded to their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: str, key: Column) -> Column:
    """A fixed shuffle's sort key: the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))


def sample(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """n rows without replacement; here the limit is the feature."""
    return rows.orderBy(seeded(seed, F.col(key)), key).limit(n)


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key."""
    return top_per(log, keys, order, 1, "_rank").drop("_rank")


def next_lane(posted: DataFrame, lanes: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row: the lane after the last post's, or by the number of posts where that lane is not in the rotation."""
    one = posted.agg(F.count("*").alias("n"), F.max_by("lane", F.struct(*order)).alias("last"))
    turns = F.array(*map(F.lit, lanes))
    at = F.array_position(turns, F.col("last"))
    return one.select(F.element_at(turns, (F.when(at > 0, at).otherwise(F.col("n")) % len(lanes) + 1).cast("int")).alias("lane"))


def first_pass(judged: DataFrame, keys: list[str], order: list[Column], tries: int) -> DataFrame:
    """The first PASS of each key's first ``tries`` candidates and those rejected before it, with their place."""
    rows = top_per(judged, keys, order, tries, "pos")
    won = F.min(F.when(F.col("outcome") == "PASS", F.col("pos"))).over(W.partitionBy(*keys))
    return rows.withColumn("_won", won).where(F.col("_won").isNull() | (F.col("pos") <= F.col("_won"))).withColumn("chosen", F.coalesce(F.col("pos") == F.col("_won"), F.lit(False))).drop("_won")


def search_candidates(hits: DataFrame, key: list[str], phrases: list[str], per_phrase: int) -> DataFrame:
    """Hits by phrase in turn, each key once; a phrase takes whole decades until it has ``per_phrase`` new keys.

    hits(phrase, decade, rank, *key). The few phrases are taken one after another, as what one leaves out the next may take.
    """
    taken = None
    for phrase in phrases:
        rows = top_per(hits.where(F.col("phrase") == phrase), key, [F.col("decade"), F.col("rank")], 1, "_k").drop("_k")
        rows = rows if taken is None else rows.join(taken.select(*key), key, "left_anti")
        decades = rows.groupBy("decade").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.orderBy("decade").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        kept = decades.withColumn("_before", before).where(F.col("_before") < per_phrase).select("decade")
        rows = rows.join(F.broadcast(kept), "decade", "left_semi").select(*key, "phrase", "decade")  # a row per decade
        taken = rows if taken is None else taken.unionByName(rows)
    return taken


def recent(posts: DataFrame, now: str, days: int, lanes: tuple[str, ...]) -> DataFrame:
    """Posts of some lanes at most ``days`` before ``now``; a time that cannot be read drops its post."""
    at = F.try_to_timestamp(F.col("at"))
    return posts.where(F.col("lane").isin(*lanes) & (at >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")))


def title_order(before: DataFrame, universe: DataFrame, seed: int) -> DataFrame:
    """(family, pos): the order so far without what has gone or repeats, then new families shuffled; never reshuffled.

    before(family, pos), universe(family), which must hold every lane's titles. A roster bounds both, so one window numbers them.
    """
    universe = universe.distinct()
    kept = before.join(universe, "family", "left_semi").groupBy("family").agg(F.min("pos").alias("_p"))
    kept = kept.select("family", F.row_number().over(W.orderBy("_p", "family")).cast("long").alias("pos"))
    n = kept.agg(F.count("*").alias("_n"))
    fresh = universe.join(kept, "family", "left_anti").crossJoin(F.broadcast(n))  # one row
    key = F.md5(F.concat_ws(":", F.col("_n") + seed, F.col("family").cast("string")).cast("binary"))
    return kept.unionByName(fresh.select("family", (F.row_number().over(W.orderBy(key, "family")) + F.col("_n")).alias("pos")))


def owed_titles(order: DataFrame, issues: DataFrame, posted: DataFrame, tried: DataFrame, lane: str, lanes: tuple[str, ...], now: int, tries: int = 5) -> DataFrame:
    """(family, place, pass): families a lane still owes a post this pass, from its own start in the order.

    issues(family, n), posted(family, lane, pass), tried(family, n). Where none is owed, the next pass opens with nothing tried; no
    rows if that owes none either.
    """
    size = order.agg(F.count("*").alias("_size"))
    start = F.floor(F.lit(lanes.index(lane)) * F.col("_size") / len(lanes))
    rows = order.crossJoin(F.broadcast(size)).withColumn("place", F.pmod(F.col("pos") - 1 - start, F.col("_size")))  # one row
    counts = lambda df, name: df.groupBy("family").agg(F.sum("n").alias(name))
    rows = rows.join(counts(issues, "_issues"), "family").join(counts(tried, "_tried"), "family", "left")
    rows = rows.withColumn("pass", F.explode(F.array(F.lit(now), F.lit(now + 1))))
    used = F.when(F.col("pass") == now, F.coalesce("_tried", F.lit(0))).otherwise(0)
    rows = rows.where(used < F.least(F.lit(tries), F.col("_issues")))
    rows = rows.join(posted.where(F.col("lane") == lane).select("family", "pass"), ["family", "pass"], "left_anti").select("family", "place", "pass")
    return rows.join(F.broadcast(rows.agg(F.min("pass").alias("pass"))), "pass").select("family", "place", "pass")


def recut(cuts: DataFrame, key: list[str]) -> DataFrame:
    """One cut per key from those by phrase: the first on the wanted box (any, where none is wanted), else the first that worked.

    cuts(*key, phrase_pos, box, want, refusal); where none worked, the first refusal stays and box is null.
    """
    rank = F.when(F.col("refusal").isNotNull(), 2).when(F.col("want").isNull() | F.col("box").eqNullSafe(F.col("want")), 0).otherwise(1)
    best = F.min_by(F.struct(F.when(F.col("refusal").isNull(), F.col("box")).alias("box"), "want", "refusal"), F.struct(rank.alias("a"), F.col("phrase_pos").alias("b")))
    return cuts.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def approved_turn(pending: DataFrame, posts: DataFrame, tries: int = 2) -> DataFrame:
    """What becomes of each lane's approved items on its turn: (lane, item, try, action), up to the one that is posted.

    pending(lane, item, family, pos, box, want, refusal, outcome), posts(lane, family, approved, at). A lane whose last post was
    approved waits, and so do items of that post's family. Actions: 'retry' (not cut), 'drop' (refused), 'requeue' (box changed), 'post'.
    """
    last = posts.groupBy("lane").agg(F.max_by(F.struct(F.col("family").alias("_family"), F.col("approved").alias("_approved")), "at").alias("_l")).select("lane", "_l.*")
    rows = pending.join(last, "lane", "left").where("not coalesce(_approved, false) and not coalesce(family = _family, false)")
    rows = top_per(rows, ["lane"], [F.col("pos"), F.col("item")], tries, "try")
    action = F.when(F.col("refusal").isNotNull(), "retry").when(F.col("outcome") == "REFUSE", "drop").when(F.col("want").isNotNull() & ~F.col("box").eqNullSafe(F.col("want")), "requeue").otherwise("post")
    rows = rows.withColumn("action", action)
    won = F.min(F.when(F.col("action") == "post", F.col("try"))).over(W.partitionBy("lane"))
    return rows.withColumn("_won", won).where("_won is null or try <= _won").select("lane", "item", F.col("try").cast("long").alias("try"), "action")
