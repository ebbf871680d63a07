"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_drop_local, found.removeprefix("file://"))
    return found.rstrip("/")


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of an executor.

    The files stay for what is derived from the result, until ``forget`` or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path.rpartition("/")[0])
    out = spark.read.schema(df.schema).parquet(path)
    out.folio_path = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``save`` wrote, where nothing reads it any more."""
    if path := getattr(df, "folio_path", None):
        _drop(df.sparkSession, path.rpartition("/")[0])


def held_out(key: Column, folds: int) -> Column:
    """crc32(key as text) mod folds = 0; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that no list of Python strings grows with Arrow's batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 4096, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and about so many characters of the column ``text``."""
    for b in slices(batches, rows):
        sizes = np.cumsum([len(t or "") for t in b.column(text).to_pylist()])
        at = 0
        while at < b.num_rows:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + chars, "right")))
            yield b.slice(at, to - at)
            at = to


def cells(dealt: DataFrame, by: str, split: int) -> DataFrame:
    """Rows (bucket, n, ...) with ``sub``: buckets of n > split rows are dealt to pairs of blocks, so that any two rows still meet."""
    k = F.ceil(F.col("n") / split)
    own = F.pmod(F.xxhash64(by), k)
    subs = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda x: F.least(x, own) * k + F.greatest(x, own))
    return dealt.withColumn("sub", F.explode(subs))


def grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of longs (bucket, sub, ...), in order of both, as columns, and how many rows of its group follow each; some whole groups at once."""
    held: list[np.ndarray] = []
    size = 0

    def whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        ends = np.append(new, rows.shape[1])
        return rows, np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - 1 - np.arange(rows.shape[1])

    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        size += b.num_rows
        if size >= least:
            rows = np.concatenate(held, axis=1)
            cut = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield whole(np.ascontiguousarray(rows[:, :cut]))
            held = [rows[:, cut:]]
            size = rows.shape[1] - cut
    if size:
        yield whole(np.ascontiguousarray(np.concatenate(held, axis=1)))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
