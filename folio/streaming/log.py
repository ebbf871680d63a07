"""The append-only event log as a stream: new lines since the last checkpoint, and the latest decision by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DECISION = "at string, decision string, lccn string, date string, lane string, offset long, dry boolean"


def tail(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """Lines of JSON as they come; lines that cannot be read, dry ones and those that do not say are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path).where("not dry")


def latest(log: DataFrame) -> DataFrame:
    """The last decision by (lccn, date, lane), a missing lane being the nameplate's; state grows with the keys."""
    keyed = log.withColumn("lane", F.coalesce("lane", F.lit("nameplate")))
    return keyed.groupBy("lccn", "date", "lane").agg(F.max_by("decision", "offset").alias("decision"), F.max("offset").alias("offset"))


def follow(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Fold all that has come so far into the in-memory table ``name``, and stop."""
    return log.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
