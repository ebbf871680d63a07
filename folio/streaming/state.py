"""The decision log as kept state: the latest decision of each item, folded batch by batch into a table that outlives the query.

Each batch of new lines meets the state that the batch before it left and becomes the next version, a folder of Parquet that is whole or not there.
A batch that is run again after a failure reads the same older version and writes its own anew, so nothing counts twice. State grows with the items, not
with the log. An item that is decided again moves to the back: order is that of the latest decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.replies import item_key, parse_skips

KEPT = 2  # versions: the newest, and the one before it for a batch that runs again
STATE = "key string, lccn string, date string, lane string, decision string, at string, offset long"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions of a state, in order."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if fs.exists(_folder(spark, f"{p}/_SUCCESS")[0]))


def state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest whole version, or the newest before a batch; empty where there is none."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    if not found:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/v={found[-1]}")


def fold(log: DataFrame) -> DataFrame:
    """(lccn, date, lane, decision, at, offset) or states of it to the latest decision by item; a missing lane is the nameplate's."""
    rows = log.withColumn("lane", F.coalesce("lane", F.lit("nameplate")))
    rows = rows.withColumn("key", item_key(F.col("lccn"), F.col("date"), F.col("lane"))).where("lccn is not null and date is not null and offset is not null")
    last = F.max_by(F.struct("lccn", "date", "lane", "decision", "at", "offset"), F.struct("offset", F.coalesce("at", F.lit("")), F.coalesce("decision", F.lit(""))))
    return rows.groupBy("key").agg(last.alias("s")).select("key", "s.*")


def follow(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold the stream's new lines into the state at ``path``; another call with the same checkpoint goes on where this one ended."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = state(spark, path, number)
        columns = [c for c in old.columns if c != "key"]
        fold(old.select(columns).unionByName(batch.select(columns))).write.mode("overwrite").parquet(f"{path}/v={number}")
        for v in versions(spark, path)[:-KEPT]:
            at, fs = _folder(spark, f"{path}/v={v}")
            fs.delete(at, True)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(kept: DataFrame, posted: DataFrame, failed: DataFrame, lane: str) -> DataFrame:
    """Approved items of a lane that are neither posted (lccn, date, lane) nor given up (key), with their place in the order of approval, from 1."""
    done = posted.select(item_key(F.col("lccn"), F.col("date"), F.col("lane")).alias("key"))
    rows = kept.where((F.col("decision") == "approve") & (F.col("lane") == lane)).join(done, "key", "left_anti").join(failed.select("key"), "key", "left_anti")
    return rows.orderBy("offset", "key")


def decided(items: DataFrame, replies: DataFrame) -> DataFrame:
    """mail(mail, n, lccn, date, lane) and (mail, spec) to a decision an item: the numbers that the reply names are rejected, all others approved.

    All or nothing: a reply that can't be read, or names a number that the mail does not have, records no decision of it."""
    counts = items.groupBy("mail").agg(F.count("*").cast("int").alias("count"))
    read = replies.join(counts, "mail").select("mail", parse_skips(F.col("spec"), F.col("count")).alias("skips")).where("skips is not null")
    said = items.join(read, "mail")
    return said.select("mail", "n", "lccn", "date", "lane", F.when(F.array_contains("skips", F.col("n").cast("int")), "reject").otherwise("approve").alias("decision"))
