"""The three-way decision: PASS, REVIEW or REFUSE, with every reason kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lane, first date that it takes (none: any).
POLICIES = (("nameplate", None), ("headline", "1880-01-01"), ("article", "1880-01-01"), ("ad", "1867-01-01"), ("market", "1867-01-01"), ("classified", "1867-01-01"), ("cartoon", "1900-01-01"))


def verdict(known: Column, postable: Column, date: Column, min_date: Column, geometry: Column, crop_hits: Column, page_hits: Column, page_gate: Column) -> Column:
    """struct(outcome, reasons): all failing conditions are collected; a page hit is a reason only where nothing refuses."""
    era = F.coalesce(date < min_date, F.lit(False))
    refuse = ~postable | date.isNull() | era | ~geometry
    crop, page = F.size(crop_hits) > 0, (F.size(page_hits) > 0) & page_gate
    reasons = F.array_compact(
        F.array(
            F.when(~postable, "no recorded issue"),
            F.when(date.isNull(), "no issue date"),
            F.when(era, F.concat(F.lit("era gate: starts at "), min_date)),
            F.when(~geometry, "no confident crop geometry"),
            F.when(crop, F.concat(F.lit("the crop carries "), F.array_join(F.sort_array(crop_hits), ","))),
            F.when(page & ~refuse, F.concat(F.lit("the page carries "), F.array_join(F.sort_array(page_hits), ","))),
        )
    )
    outcome = F.when(refuse, "REFUSE").when(crop | page, "REVIEW").otherwise("PASS")
    return F.when(~known, F.struct(F.lit("REFUSE").alias("outcome"), F.array(F.lit("not in the roster")).alias("reasons"))).otherwise(F.struct(outcome.alias("outcome"), reasons.alias("reasons")))


def policies(spark) -> DataFrame:
    return spark.createDataFrame([(a, b, True) for a, b in POLICIES], "lane string, min_date string, page_gate boolean")


def reminder(resolved: Column, snoozed: Column, last: Column, today: Column, not_before: str, repeat: int = 14) -> Column:
    """'resolved', 'snoozed', 'early', 'recent' or 'due'; all but the first input are ISO dates as text, and one that cannot be read counts for nothing."""
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    now = day(today)
    return (
        F.when(is_(F.length(resolved) > 0), "resolved").when(is_(now < day(snoozed)), "snoozed").when(now < F.lit(not_before).cast("date"), "early")
        .when(is_(F.datediff(now, day(last)) < repeat), "recent").otherwise("due")
    )


def best_of(judged: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The best candidate of each key: PASS before REVIEW before REFUSE, the first of equals."""
    rank = F.element_at(F.create_map(F.lit("PASS"), F.lit(0), F.lit("REVIEW"), F.lit(1), F.lit("REFUSE"), F.lit(2)), F.col("outcome"))
    rest = [c for c in judged.columns if c not in keys]
    return judged.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("a"), order.alias("b"))).alias("_b")).select(*keys, "_b.*")
