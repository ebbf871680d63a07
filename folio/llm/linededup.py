"""Line dedup with levelled sorted runs of line hashes. All of it is DataFrame work.

A line's key is the line without white space (\\x20, \\x09-\\x0D) at both ends, A-Z lower-cased. Keys of at least ``chars`` code
points that ``least`` documents hold lose all their lines but those of the largest doc_id that holds them.

``LineRuns`` is the index: a run is a table of (h1, h2, n, keeper), the 128-bit hash of a key, in how many documents and the largest of
their doc_ids, bucketed and sorted by the hash, so that runs join each other and batches as sorted files, without a
shuffle of theirs. A batch of documents is counted by key, merge-anti-joined with the settled rows of the runs (keys that have enough documents
and a keeper no smaller than the batch's, to which the batch adds nothing), and what is left becomes a run of its own. As in a binary
counter, two runs of a level merge into one of the next, so a row is written again only with the logarithm of the
number of batches. Batches may come in any order; falling doc_ids settle keys soonest. At the end all runs merge, and the
lines of settled keys are joined by hash, as (document, position), never with their text.

A row is a document: rows of one doc_id count as several, and all of the largest doc_id keep the line. A null doc_id is smaller than all
others. A null or empty text is one empty line; a text that loses all lines becomes empty. Texts are split whole. An empty table gives no
rows. Other columns stay; names that begin with __folio_ are reserved. Hot lines are counted before they are shuffled, and
joined with their keeper, one row a key, where adaptive skew-join splits them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import SPACES, _drop, forget, save, shared_dir, shuffles, table

BATCHES, CHARS, DOCUMENTS = 8, 20, 3
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class LineRuns:
    """Runs by level, at most one each; ``close`` removes them."""

    def __init__(self, spark: SparkSession, least: int = DOCUMENTS):
        self.spark, self.least, self.levels, self.files = spark, least, [], {}

    def _write(self, rows: DataFrame) -> str:
        name = f"folio_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.select(*_HASH, "n", "keeper").write.bucketBy(shuffles(self.spark), *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        self.files[name] = path
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        _drop(self.spark, self.files.pop(name))

    def _merged(self, a: str, b: str) -> DataFrame:
        a, b = self.spark.table(a).alias("a"), self.spark.table(b).alias("b")
        one = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        n = F.coalesce(F.col("a.n"), F.lit(0)) + F.coalesce(F.col("b.n"), F.lit(0))
        met = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full")
        return met.select(one("h1"), one("h2"), n.alias("n"), F.greatest("a.keeper", "b.keeper").alias("keeper"))

    def _put(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(None)
        if (other := self.levels[level]) is None:
            self.levels[level] = run
            return
        both = self._write(self._merged(run, other))
        self.levels[level] = None
        self._remove(run)
        self._remove(other)
        self._put(both, level + 1)

    def add(self, batch: DataFrame) -> None:
        """(doc_id, h1, h2): a row for each document and key that it holds."""
        own = batch.groupBy(*_HASH).agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).alias("own")
        for run in filter(None, self.levels):
            settled = self.spark.table(run).where(F.col("n") >= self.least).alias("run")
            no_larger = F.coalesce(F.col("own.keeper") <= F.col("run.keeper"), F.col("own.keeper").isNull())
            own = own.join(settled, (F.col("own.h1") == F.col("run.h1")) & (F.col("own.h2") == F.col("run.h2")) & no_larger, "left_anti").alias("own")
        self._put(self._write(own), 0)

    def settled(self) -> DataFrame:
        """(h1, h2, keeper) of all keys with enough documents. Merges what runs there are."""
        runs = [x for x in self.levels if x]
        while len(runs) > 1:
            both = self._write(self._merged(*runs[:2]))
            for x in runs[:2]:
                self._remove(x)
            runs = [both, *runs[2:]]
        self.levels = [None] * len(self.levels) + runs
        return self.spark.table(runs[0]).where(F.col("n") >= self.least).select(*_HASH, "keeper")

    def close(self) -> None:
        for name in list(self.files):
            self._remove(name)
        self.levels = []


def _located(docs: DataFrame, chars: int) -> DataFrame:
    """(doc_id, th, at array of (pos, h1, h2)) for the rows with lines of so many code points."""
    keys = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("pos"), key_of(x).alias("key")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= chars)
    at = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), at.alias("at")).where(F.size("at") > 0)


def _batches(located: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of doc_id of about equal numbers of rows, falling; the last has null ones too."""
    cuts = sorted({int(x) for x in located.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.01)}, reverse=True) if n > 1 else []
    key = F.col("doc_id")
    ends = zip([*cuts, None], [None, *cuts])
    return [located.where((key > low if low is not None else F.lit(True)) & (key <= high if high is not None else F.lit(True)) if low is not None or high is None else (key <= high) | key.isNull()) for low, high in ends]


def _marked(docs: DataFrame, chars: int, least: int, batches: int) -> DataFrame:
    """With __folio_lines, and __folio_kept: the positions, from 1, of those that stay."""
    located = save(_located(docs, chars), "lines")
    runs = LineRuns(docs.sparkSession, least)
    try:
        for batch in _batches(located, batches):
            one = F.array_distinct(F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
            runs.add(batch.select("doc_id", F.inline(one)))
        settled = save(runs.settled(), "settled")  # no bucketed table, so that both sides are shuffled and a hot line's rows are split
        lines = located.select("doc_id", "th", F.inline("at"))
        lost = lines.join(settled, _HASH).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        gone = save(lost.groupBy("doc_id", "th").agg(F.collect_set(F.col("pos") + 1).alias("gone")), "gone")
    finally:
        runs.close()
    forget(located)
    gone = gone.select(F.col("doc_id").alias("__folio_id"), F.col("th").alias("__folio_th"), F.col("gone").alias("__folio_gone"))
    rows = docs.withColumns({"__folio_key": F.col("doc_id").cast("long"), "__folio_text": F.xxhash64(F.col("text").cast("string"))})
    met = rows.join(gone, F.col("__folio_key").eqNullSafe(F.col("__folio_id")) & (F.col("__folio_text") == F.col("__folio_th")), "left")
    met = met.withColumn("__folio_lines", lines_of(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(1), F.size("__folio_lines")), F.coalesce("__folio_gone", F.array().cast("array<int>")))
    return met.withColumn("__folio_kept", kept)


def _joined() -> Column:
    return F.array_join(F.transform("__folio_kept", lambda i: F.get(F.col("__folio_lines"), i - 1)), "\n")


def deduplicate(docs: DataFrame, chars: int = CHARS, least: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """The documents, their texts without the lines that another keeps; all rows and columns stay."""
    return _marked(docs, chars, least, batches).withColumn("text", _joined()).select(docs.columns)


def report(docs: DataFrame, chars: int = CHARS, least: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text; one row per row."""
    n = F.size("__folio_lines").cast("long")
    return _marked(docs.select("doc_id", "text"), chars, least, batches).select("doc_id", n.alias("n_lines"), (n - F.size("__folio_kept")).alias("n_dropped"), F.sha2(_joined().cast("binary"), 256).alias("kept_sha256"))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
settled AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN settled s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
