"""Hard-negative mining with segment summaries.

A vector's segments are even stretches of its components, at levels of 2, 8 and 32 of them. A level keeps each segment's mean and
deviation (the root of the sum of squares about the mean). Of two vectors, a segment of m components adds m times the means'
product to the inner product, give or take the product of deviations at most, by Cauchy and Schwarz. So two matrix
products bound the scores of a block of rows against a block of anchors. Pairs that can't enter an anchor's list any more, or
lie outside the scores that it takes, end at the level that shows it; finer segments bound the rest, and only what the
finest leaves is scored, in whole numbers.

Anchors are the stated query set. They are broadcast in blocks of ``PARTS`` components at most, each of which is compared with all rows
where these lie: no vector is shuffled, and tasks put out only their best rows of an anchor. A first run over the rows with one
hash in ``OPENING`` gives each anchor the score that a row has to reach (the k-th of some rows is no better than the k-th of all), so that what the run over
all rows puts out does not grow with the number of tasks. It is a bound to start from: all rows are looked at, and results do not depend on it.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part, nor those with a component of 2^20 or
more in size, whose scores a long might not hold. Rows of another length than an anchor have no score with it. Repeated rows count as rows; rows with an
anchor's own vec_id are none of its positives, and an anchor that comes twice is mined twice. Anchors without another row
of their label, and positives without a row that fits, give no rows; so do an empty table and positives of a negative score. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import record, save, slices, table

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 10, 100, 256
#: A negative's score, as percentages of the positive's.
LOW, HIGH = 30, 90
LEVELS, LARGEST = (2, 8, 32), 2.0**20
#: Components of a block of anchors, pairs of an anchor and a row that are bounded at once, and rows behind each of the opening run.
PARTS, PAIRS, OPENING = 1 << 20, 1 << 21, 64
_NONE = np.iinfo(np.int64).min


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means by the root of the segment's length, and deviations: bounds are products of the first plus or minus those of the second."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))[:-1]
    size = np.diff(np.append(edges, x.shape[1]))
    mean = np.add.reduceat(x, edges, axis=1) / size
    off = x - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(off * off, edges, axis=1))


class Block:
    """Anchors of one length with their summaries at all levels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.levels = [summaries(x.astype(np.float64), s) for s in LEVELS]


def scored(block: Block, at: np.ndarray, x: np.ndarray, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors ``at`` against rows ``x``: (i, j, score) of the pairs of ``alive`` with least[i] <= score <= most[i]."""
    rows = x.astype(np.float64)
    for segments, (mean, off) in zip(LEVELS, block.levels):
        m, d = summaries(rows, segments)
        some, cols = alive.any(axis=1), alive.any(axis=0)
        if not some.any():
            break
        a, b = np.flatnonzero(some), np.flatnonzero(cols)
        part = alive[np.ix_(a, b)]
        if part.sum() * 8 > part.size:
            middle, wide = mean[at[a]] @ m[b].T, off[at[a]] @ d[b].T
            i, j = np.nonzero(part & _fits(middle, wide, least[a][:, None], most[a][:, None]))
        else:
            i, j = np.nonzero(part)
            middle = np.einsum("ij,ij->i", mean[at[a[i]]], m[b[j]])
            ok = _fits(middle, np.einsum("ij,ij->i", off[at[a[i]]], d[b[j]]), least[a[i]], most[a[i]])
            i, j = i[ok], j[ok]
        alive = np.zeros_like(alive)
        alive[a[i], b[j]] = True
    i, j = np.nonzero(alive)
    exact = float(np.abs(block.x[at]).max(initial=0)) * float(np.abs(rows).max(initial=0)) * x.shape[1] < 2.0**53
    if exact and len(i) * 8 > alive.size:
        score = (block.x[at].astype(np.float64) @ rows.T)[i, j].astype(np.int64)
    else:
        score = np.concatenate([np.einsum("ij,ij->i", block.x[at[i[k : k + 65536]]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
    ok = (score >= least[i]) & (score <= most[i])
    return i[ok], j[ok], score[ok]


def _fits(middle: np.ndarray, wide: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    spare = 0.5 + 1e-9 * (np.abs(middle) + wide)
    return (middle + wide + spare >= least) & (middle - wide - spare <= most)


class Best:
    """The k best rows of each query, by falling score and then id."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[query]
        if not keep.any():
            return
        query, ids, score = (np.concatenate(x) for x in ((self.query, query[keep]), (self.ids, ids[keep]), (self.score, score[keep])))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.append(0, np.flatnonzero(np.diff(query)) + 1)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        top = rank < self.k
        self.query, self.ids, self.score = query[top], ids[order][top], score[order][top]
        full = rank == self.k - 1
        self.floor[query[full]] = score[order][full]


def _parts(block: Block, labels: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors and rows of a batch to compare, few enough pairs at once; rows of the anchors' label alone where ``same``."""
    for label in np.unique(labels) if same else [None]:
        at = np.flatnonzero(block.labels == label) if same else np.arange(len(block.ids))
        rows = np.flatnonzero(labels == label) if same else np.arange(len(labels))
        step = max(1, PAIRS // max(1, len(at)))
        for k in range(0, len(rows) if len(at) else 0, step):
            yield at, rows[k : k + step]


def _found(rows: DataFrame, block: Block, same: bool, k: int, least: np.ndarray, most: np.ndarray) -> DataFrame:
    """(query, other, score): the k best rows within [least, most] of each query; query q is of anchor q // the columns of ``least``, shaped (anchors, queries each)."""
    sent = rows.sparkSession.sparkContext.broadcast((block, least, most))
    dim, each = block.x.shape[1], least.shape[1]
    schema = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least, most = sent.value
        best = Best(k, least.ravel())
        for b in slices(batches, 1024):
            ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = np.floor(SCALE * v).astype(np.int64)
            for at, js in _parts(block, labels, same):
                alive = (block.ids[at][:, None] != ids[js][None]) & ((block.labels[at][:, None] == labels[js][None]) == same)
                floor = best.floor.reshape(-1, each)[at]
                i, j, score = scored(block, at, x[js], alive, floor.min(axis=1), most[at].max(axis=1))
                for q in range(each):
                    ok = (score >= least[at[i], q]) & (score <= most[at[i], q])
                    best.add(at[i[ok]] * each + q, ids[js[j[ok]]], score[ok])
        yield record(schema, best.query, best.ids, best.score)

    found = rows.where(F.size("v") == dim).mapInArrow(run, "query long, other long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("rank") <= k)


def _opened(rows: DataFrame, block: Block, same: bool, k: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``least``, raised to the k-th best score of the opening rows."""
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("opening")), F.lit(OPENING)) == 0)
    out = least.copy().ravel()
    for r in _found(some, block, same, k, least, most).where(F.col("rank") == k).select("query", "score").toLocalIterator():
        out[r["query"]] = max(out[r["query"]], r["score"])
    return out.reshape(least.shape)


def _blocks(anchors: DataFrame) -> Iterator[Block]:
    """Anchors in order of length and id, as many at once as fit ``PARTS`` components."""
    held: list = []
    for r in anchors.orderBy(F.size("v"), "vec_id").toLocalIterator():
        if held and (len(r["v"]) != len(held[0][2]) or (len(held) + 1) * max(1, len(r["v"])) > PARTS):
            yield _block(held)
            held = []
        held.append((r["vec_id"], r["label"], r["v"]))
    if held:
        yield _block(held)


def _block(held: list) -> Block:
    ids, labels, v = zip(*held)
    return Block(np.array(ids, np.int64), np.array(labels, np.int64), np.floor(SCALE * np.array(v, np.float64)).astype(np.int64))


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(vec_id, embedding, label) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between ``low`` and ``high`` percent of its positive's, ends included."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)) & (F.size("v") > 0))
    anchors = save(rows.where(F.col("vec_id") % every == 0), "anchors")
    ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out: list[DataFrame] = []
    for block in _blocks(anchors):
        n = len(block.ids)
        least, most = np.full((n, 1), _NONE), np.full((n, 1), np.iinfo(np.int64).max)
        near = save(_found(rows, block, True, positives, _opened(rows, block, True, positives, least, most), most), "positives")
        least, most, chosen = np.full((n, positives), 1), np.full((n, positives), 0), []
        for r in near.toLocalIterator():
            least[r["query"], r["rank"] - 1] = -(-low * r["score"] // 100)
            most[r["query"], r["rank"] - 1] = high * r["score"] // 100
            chosen.append((r["query"] * positives + r["rank"] - 1, int(block.ids[r["query"]]), r["other"], r["score"]))
        if not chosen:
            continue
        far = _found(rows, block, False, negatives, _opened(rows, block, False, negatives, least, most), most)
        named = rows.sparkSession.createDataFrame(chosen, "query long, anchor_id long, positive_id long, positive_score long")
        found = far.join(F.broadcast(named), "query")
        out.append(save(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return rows.sparkSession.createDataFrame([], ddl)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, the label is the next of ten."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
entries AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sound),
scores AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other, b.label AS other_label, CAST(sum(a.x * b.x) AS BIGINT) AS score
    FROM entries a JOIN entries b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL
),
positives AS (
    SELECT * FROM scores WHERE anchor_label = other_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
    n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND n.other_label <> p.anchor_label AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) <= 10
"""
