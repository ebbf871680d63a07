"""Embedding near-dedup as an exact metric range join.

Vectors are compared by angle, a metric. Each label's distinct vectors are partitioned by its own pivots, one for every ``PER_PIVOT``
of them, chosen far from each other (at most ``PIVOTS`` in all, so their broadcast is bounded): each vector has the cell of its nearest pivot. If two vectors within angle r have cells p and q, then
by the triangle inequality the one of p is at most 2 r farther from q's pivot than from p's; so a vector visits the
lower-numbered cells for which this holds, and every pair within r meets in exactly one cell. Cells
join independently. A cell's rows are dealt to blocks, and pairs of blocks join as matrices in
double precision, so no task holds a whole cell however large it is. Tasks give link counts and spanning links, never
pairs. Vectors travel in the precision that they have, packed.

Equal vectors of a label, by a hash of 128 bits, are one row with a weight. Vectors that are null, zero or hold null or non-finite components,
rows without a label or vec_id, and vectors of another length link with nothing; those rows have n_links 0, their
own vec_id as component_id, and are kept, but for a null vec_id, which has a null component_id and is not kept. A vec_id names
a vector: rows of one vec_id with different vectors share their links. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import record, save, slices
from folio.llm.components import connected_components
from folio.llm.simhash import spanning

LEAST = 0.93
PIVOTS, CHOICES = 4096, 3
#: Distinct vectors of a label for each pivot, components in a block of a cell, and its least and most vectors.
PER_PIVOT, PARTS, BLOCKS = 2048, 1 << 20, (256, 4096)
#: Angles are compared with this much to spare, so that rounding loses no pair.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Rows of packed components."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _keys(rows: DataFrame) -> DataFrame:
    """With h1 and h2, that name the vector, null where it links with nothing."""
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.withColumns({"h1": F.when(sound, F.xxhash64(v)), "h2": F.when(sound, F.xxhash64(F.lit(1), F.size(v), v))})


def _apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the unit vectors, each as far as can be from those before it."""
    at, away = [0], np.arccos(np.clip(vectors @ vectors[0], -1, 1))
    while len(at) < min(n, len(vectors)):
        at.append(int(away.argmax()))
        away = np.minimum(away, np.arccos(np.clip(vectors @ vectors[at[-1]], -1, 1)))
    return vectors[at]


def _pivots(groups: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """By label and length; labels of at most ``PER_PIVOT`` vectors have none."""
    sizes = groups.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > PER_PIVOT)
    per = max(PER_PIVOT, -(-(sizes.agg(F.sum("n")).first()[0] or 0) * 2 // PIVOTS))  # so that there are no more than PIVOTS
    wanted = sizes.withColumn("wanted", F.ceil(F.col("n") / per)).where("wanted > 1")
    # About CHOICES for each, by a hash: at most PIVOTS rows of ``wanted`` and so many times CHOICES of vectors.
    some = groups.join(F.broadcast(wanted), ["label", "dim"]).where(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.col("n")) < CHOICES * F.col("wanted"))
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for label, dim, n, v in some.select("label", "dim", "wanted", "embedding").orderBy("label", "dim", F.xxhash64("rep"), "rep").toLocalIterator():
        found.setdefault((label, dim), (n, []))[1].append(v)
    return {k: _apart(_unit(np.array(v)), n) for k, (n, v) in found.items()}


def links(groups: DataFrame, least: float = LEAST) -> DataFrame:
    """(label, dim, embedding, rep, weight), saved, to rows (a, b, n): b null: a has n further links; else a spanning link."""
    angle = math.acos(least)
    kind = "<f4" if groups.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    table = groups.sparkSession.sparkContext.broadcast(_pivots(groups))
    homes = pa.schema([("cell", pa.int64()), ("visit", pa.bool_()), ("rep", pa.int64()), ("weight", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])
    ddl = "cell long, visit boolean, rep long, weight long, label long, dim int, vector binary"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            labels, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for label, dim in sorted(set(zip(labels.tolist(), dims.tolist()))):
                part = b.filter(pa.array((labels == label) & (dims == dim)))
                raw = np.stack([np.asarray(v.values) for v in part.column(2)]).astype(kind)
                at = table.value.get((label, dim))
                away = np.arccos(np.clip(_unit(raw) @ at.T, -1, 1)) if at is not None else np.zeros((len(raw), 1))
                home = away.argmin(axis=1)
                near = away - away[np.arange(len(raw)), home][:, None] <= 2 * angle + SLACK
                near &= np.arange(away.shape[1]) <= home[:, None]
                i, cell = np.nonzero(near)
                packed = [v.tobytes() for v in raw]
                take = pa.array(i)
                yield record(homes, cell, cell != home[i], part.column(3).take(take), part.column(4).take(take), np.full(len(i), label), np.full(len(i), dim, np.int32), [packed[k] for k in i])

    placed = save(groups.select(F.col("label").cast("long").alias("label"), "dim", "embedding", "rep", "weight").mapInArrow(dealt, ddl), "cells")
    block = F.greatest(F.lit(BLOCKS[0]), F.least(F.lit(BLOCKS[1]), F.floor(PARTS / F.col("dim"))))
    counts = placed.groupBy("label", "dim", "cell").agg(F.count_if(~F.col("visit")).alias("homes"), F.count_if("visit").alias("visits"))
    counts = counts.where("homes > 0").select("label", "dim", "cell", F.ceil(F.col("homes") / block).alias("h"), F.ceil(F.col("visits") / block).alias("v"))
    rows = placed.join(counts, ["label", "dim", "cell"])
    # Home blocks are 0 ... h - 1, visitors' follow. Pairs (i, j): i a home block, j the same or a later one.
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("visit"), F.col("v")).otherwise(F.col("h"))) + F.when(F.col("visit"), F.col("h")).otherwise(0)
    rows = rows.withColumn("own", own)
    pairs = F.when(F.col("visit"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("own")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))),
            F.filter(F.transform(F.sequence(F.col("own"), F.col("h") + F.col("v") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))), lambda p: p["j"] > F.col("own")),
        )
    )
    key = ["label", "dim", "cell", "i", "j"]
    rows = rows.withColumn("pair", F.explode(pairs)).select("label", "dim", "cell", "pair.i", "pair.j", (F.col("own") == F.col("pair.i")).alias("left"), "rep", "weight", "vector")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def join(t: pa.Table) -> pa.RecordBatch:
            rep, weight = t.column("rep").to_numpy(), t.column("weight").to_numpy()
            left, unit = t.column("left").to_numpy(zero_copy_only=False), _unit(_matrix(t.column("vector"), t.column("dim")[0].as_py(), kind))
            same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            a, b = (np.arange(len(rep)), np.arange(len(rep))) if same else (np.flatnonzero(left), np.flatnonzero(~left))
            n_, pairs_ = np.zeros(len(rep), np.int64), []
            for k in range(0, len(a), 512):
                part = a[k : k + 512]
                x, y = np.nonzero(unit[part] @ unit[b].T >= least)
                x, y = part[x], b[y]
                if same:
                    x, y = x[x < y], y[x < y]
                np.add.at(n_, x, weight[y])
                np.add.at(n_, y, weight[x])
                pairs_.append((x, y))
            x, y = (np.concatenate(z) for z in zip(*pairs_)) if pairs_ else (np.zeros(0, int), np.zeros(0, int))
            root = spanning(len(rep), x, y)
            some, far = np.flatnonzero(n_), np.flatnonzero(root != np.arange(len(rep)))
            return record(out, np.concatenate((rep[some], rep[far])), pa.array([None] * len(some) + rep[root[far]].tolist(), pa.int64()), np.concatenate((n_[some], np.zeros(len(far), np.int64))))

        now = None
        for b in slices(batches, 1024):
            ids = np.stack([b.column(k).to_numpy() for k in range(5)], axis=1)
            for part in np.split(np.arange(len(ids)), np.flatnonzero((np.diff(ids, axis=0) != 0).any(axis=1)) + 1):
                if not len(part):
                    continue
                if now is not None and (ids[part[0]] != now).any():
                    yield join(pa.Table.from_batches(held))
                    held = []
                now = ids[part[0]]
                held.append(b.slice(part[0], len(part)))
        if held:
            yield join(pa.Table.from_batches(held))

    found = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(joined, "a long, b long, n long")
    return found


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id, kept; one row per row."""
    exact = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if exact else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = _keys(rows)
    key = ["label", "h1", "h2"]
    named = save(rows.select("vec_id", *key), "keys")
    classes = save(named.where("h1 is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    groups = rows.where("h1 is not null").join(classes.withColumnRenamed("rep", "vec_id"), [*key, "vec_id"]).dropDuplicates(["vec_id", *key])
    groups = save(groups.select("label", F.size("embedding").alias("dim"), "embedding", F.col("vec_id").alias("rep"), "weight", "h1", "h2"), "groups")
    found = save(links(groups, least), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("far"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    out = classes.join(counts, classes.rep == counts.a, "left").join(roots, classes.rep == roots.node, "left")
    out = out.select(*key, (F.coalesce("far", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "rep").alias("component"))
    met = named.join(out, key, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return met.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_metric_range_join(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
