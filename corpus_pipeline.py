"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows of the one before, and is written as Parquet and read
again before the next. All but the last give the columns of documents; the last gives a row per piece.
Toxicity: documents that score 0.5 or more go. SimHash near-dedup: the smallest doc_id of each
class of documents with 5-word shingle sets 0.8 alike stays.
Secret scans: secrets are masked in the text; no document goes. Mixing: a document comes as often as the
mix takes it, none to two times. Packing: pieces with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import save, table
from folio.llm.mixing import resample
from folio.llm.packing import pack_documents
from folio.llm.secrets import redact
from folio.llm.simhash import deduplicate
from folio.llm.toxicity import keep_ordinary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_ordinary(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs, words=5, least=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mix", source_mix), ("best_fit_packing", packing)]

#: Toxicity, SimHash and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
