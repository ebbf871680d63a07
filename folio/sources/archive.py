"""Connectors for the archive's files: rosters, rights pages, issue manifests, word coordinates and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.replies import identify

ROSTER = "lccn string, title string, city string, county string, start_year string, end_year string, noc_issues int, noc_first string, noc_last string, postable string"
COORDINATES = "struct<width:string,height:string,coords:map<string,array<array<string>>>>"
MANIFEST = "struct<sequences:array<struct<canvases:array<struct<width:int,height:int,images:array<struct<resource:struct<service:struct<`@id`:string>>>>>>>>>"


def roster(spark: SparkSession, path: str, schema: str = ROSTER) -> DataFrame:
    """A roster by lccn; of repeated keys the last row stays."""
    rows = spark.read.csv(path, schema=schema, header=True).withColumn("_at", F.monotonically_increasing_id())
    last = rows.groupBy("lccn").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "_at"]), "_at").alias("r"))
    return last.select("r.*")


def write_roster(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def rights_issues(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """Distinct (lccn, date, ed) in pages of rights records; files that are no JSON are skipped, addresses may be one or many."""
    pages = spark.read.text(path, wholetext=True)
    docs = F.from_json(F.get_json_object("value", "$.response.docs"), "array<struct<id:string,edm_is_shown_by:string>>")
    shown = F.coalesce(F.from_json("d.edm_is_shown_by", "array<string>"), F.array("d.edm_is_shown_by"))
    found = pages.select(F.explode(docs).alias("d")).select(identify(F.col("d.id"), shown).alias("i")).where("i is not null").select("i.*")
    return (found.where(F.col("date") < before) if before else found).distinct()


def coordinates(pages: DataFrame, key: str, json: Column) -> DataFrame:
    """(key, t, x, y, w, h): every box of every word key; boxes that are not four numbers are dropped."""
    rows = pages.select(key, F.explode(F.from_json(json, COORDINATES)["coords"]).alias("t", "boxes")).select(key, "t", F.explode("boxes").alias("b"))
    number = lambda i: F.try_element_at("b", F.lit(i)).try_cast("long")
    return rows.select(key, "t", *[number(i + 1).alias(c) for i, c in enumerate("xywh")]).dropna(subset=list("xywh"))


def manifest_pages(issues: DataFrame, key: str, json: Column) -> DataFrame:
    """(key, seq, image_w, image_h, service): pages numbered from 1 before those without an image service are skipped."""
    canvases = F.try_element_at(F.from_json(json, MANIFEST)["sequences"], F.lit(1))["canvases"]
    rows = issues.select(key, F.posexplode(canvases).alias("_pos", "c"))
    service = F.try_element_at("c.images", F.lit(1))["resource"]["service"]["@id"]
    return rows.select(key, (F.col("_pos") + 1).alias("seq"), F.col("c.width").alias("image_w"), F.col("c.height").alias("image_h"), service.alias("service")).where("service is not null")


def front_pages(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key).agg(F.min_by(F.struct("seq", "image_w", "image_h", "service"), "seq").alias("p")).select(key, "p.*")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
