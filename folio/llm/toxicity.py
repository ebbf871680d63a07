"""Toxicity by class-conditional Kneser-Ney models.

Two word-bigram models, one per class, are interpolated with absolute discounting. A pair counts once a document, so that
what one document repeats says no more. Both back off to their class's continuation counts, the number of distinct words
that a word follows, and these to the continuation counts that the classes share, which smooth rare expressions; one pair more
at either level for both classes alike makes a rare word say little in a class of few documents.
Words and pairs that are in a single document of a class, at most, say nothing of that document's class and back off: by a fixed number,
whatever the size of the input or the class. A passage's score is the length-normalised
toxic minus ordinary log-likelihood; insults being few in long texts, a document has those of its strongest passages of 1, 4 and 16 words
and of the whole, which a logistic curve, fitted on a fold of the training rows that the counts leave out, turns into a
score from 0 to 1. Where that fold lacks a class, the curve is fitted on the rows that the counts have.

Only labelled rows outside the held-out fold are learnt from, at most ``per_class`` documents a class
for the counts and ``calibration`` for the curve, the first by a hash of doc_id: the bounded sample of
labelled rows. Every whole text is scored. A null text is empty and gets what the curve gives for no
words; with no training rows of both classes every score is the share of toxic ones (0 with none).
A doc_id that is labelled more than once counts as toxic if any label says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import held_out, record, save, slices

PASSAGES = (1, 4, 16)
WIDE = len(PASSAGES) + 2
DISCOUNT = 0.75
FOLDS = 5
PER_CLASS = 8_000
CALIBRATION = 16_000
#: Documents of either class that a word must be in, and of both together that a pair must be in; by neither the input's nor the sample's size.
MIN_DF = 2
#: Pairs of the last level, which the classes share evenly, by word and by pair.
EVEN = 1.0
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class Model:
    """Log-likelihood ratios of words after words, as arrays by the vocabulary's numbers; 0 is any other word."""

    def __init__(self, vocabulary: dict[str, int], uni: np.ndarray, follows: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        """uni: pairs that begin so, by class and number; follows: distinct words before each, by class and for both together; keys: first * size + second; counts: by class and key."""
        size = len(vocabulary) + 1
        self.vocabulary, self.size, self.keys = vocabulary, size, keys
        first, second = keys // size, keys % size
        shared = follows[2] + 0.5
        shared = shared / shared.sum()
        low, gap, found = [], [], []
        for c in range(2):
            kept = np.maximum(follows[c] - DISCOUNT, 0) / max(follows[c].sum(), 1.0)
            continuation = kept + (1 - kept.sum()) * shared
            tokens = np.maximum(uni[c], 1.0)
            seen = np.maximum(counts[c] - DISCOUNT, 0) / tokens[first]
            rest = np.maximum(1 - np.bincount(first, weights=seen, minlength=size), 1e-9)
            low.append(continuation)
            gap.append(rest)
            found.append(seen + rest[first] * continuation[second])
        # The classes' last level is one they share evenly, so that few documents of a small class say little.
        even = EVEN / max(follows[:2].sum(), 1.0)
        self.low = np.log(low[1] + even) - np.log(low[0] + even)
        self.gap = np.log(gap[1]) - np.log(gap[0])
        even = EVEN / np.maximum(uni.sum(axis=0), 1.0)[first]
        self.found = np.log(found[1] + even) - np.log(found[0] + even)
        self.curve: tuple[np.ndarray, np.ndarray, np.ndarray]

    def ratios(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        before = np.concatenate(([0], ids[:-1]))
        out = self.low[ids] + self.gap[before]
        if len(self.keys):
            key = before * self.size + ids
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            out[hit] = self.found[at[hit]]
        return out

    def features(self, text: str | None) -> list[float]:
        """The ratio a word of the strongest passage of each length, that of the whole text, and the log of its length."""
        w = words_of(text)
        if not w:
            return [0.0] * WIDE
        sums = np.concatenate(([0.0], np.cumsum(self.ratios(w))))
        n = len(w)
        best = [float((sums[k:] - sums[:-k]).max() / k if n > k else sums[-1] / n) for k in PASSAGES]
        return [*best, float(sums[-1] / n), math.log1p(n)]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.curve[1]) / self.curve[2]
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[0][:-1] + self.curve[0][-1], -30, 30)))

    def fit(self, features: np.ndarray, labels: np.ndarray) -> None:
        mean, spread = features.mean(axis=0), features.std(axis=0)
        spread[spread < 1e-9] = 1
        x = np.c_[(features - mean) / spread, np.ones(len(features))]
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton's steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - labels) + 1e-2 * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (w, mean, spread)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    toxic = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return toxic.withColumn("fold", fold).where("fold <> 0")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> Model | float:
    """The model, or the toxic share where one class has no rows."""
    spark = docs.sparkSession
    known = _labelled(docs, labels)
    # The bounded sample: doc_ids alone are ranked, then joined.
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = pick(known.where("fold <> 1 and toxic = 1"), per_class).unionByName(pick(known.where("fold <> 1 and toxic <> 1"), per_class)).unionByName(pick(known.where("fold = 1"), calibration))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most 2 * per_class + calibration numbers are broadcast, so no text but the sample's is shuffled.
    rows = rows.join(F.broadcast(some.withColumn("toxic", (F.col("toxic") == 1).cast("int"))), "doc_id").select("doc_id", "text", "toxic", "fold")
    rows = save(rows.dropDuplicates(["doc_id", "text"]), "sample")

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("df", pa.int64())])

        for b in slices(batches, 2048):
            df = (Counter(), Counter())
            for text, c, fold in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("fold").to_pylist()):
                if fold != 1:
                    df[c].update({"", *words_of(text)})  # the empty word counts documents
            for c in range(2):
                if df[c]:
                    yield record(schema, list(df[c]), [c] * len(df[c]), list(df[c].values()))

    totals = rows.mapInArrow(singles, "word string, toxic long, df long").groupBy("word").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("df"))).alias(f"df{c}") for c in (0, 1)]).fillna(0)
    rare = totals.where("word = ''").selectExpr("df0", "df1").first()
    ordinary, toxic = (int(rare[0]), int(rare[1])) if rare else (0, 0)
    if not ordinary or not toxic:
        return float(toxic > 0)
    kept = totals.where(F.col("word") != "").select("word", (F.greatest("df0", "df1") >= MIN_DF).alias("often")).toArrow().sort_by("word")  # of the bounded sample; as Arrow, so that no row is an object on the driver
    vocabulary = {w: k + 1 for k, w in enumerate(kept["word"].to_pylist())}
    size = len(vocabulary) + 1
    shared = spark.sparkContext.broadcast(vocabulary)  # words of the bounded sample

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("toxic", pa.int64()), ("n", pa.int64())])
        get = shared.value.get
        for b in slices(batches, 2048):
            held = ([], [])
            for text, c, fold in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("fold").to_pylist()):
                if fold != 1 and (w := words_of(text)):
                    ids = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
                    held[c].append(np.unique(np.concatenate(([0], ids[:-1])) * size + ids))
            for c in range(2):
                if held[c]:
                    key, n = np.unique(np.concatenate(held[c]), return_counts=True)
                    yield record(schema, key, np.full(len(key), c), n)

    bigrams = rows.mapInArrow(pairs, "key long, toxic long, n long").groupBy("key").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n"))).alias(f"n{c}") for c in (0, 1)]).fillna(0)
    bigrams = save(bigrams, "pairs")
    tokens = bigrams.groupBy(F.floor(F.col("key") / size).alias("first")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    after = bigrams.groupBy((F.col("key") % size).alias("second")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"), F.count("*").alias("n2")).toArrow()
    uni, follows = np.zeros((2, size)), np.zeros((3, size))
    for c in range(2):
        uni[c, tokens["first"].to_numpy()] = tokens[f"n{c}"].to_numpy()
    for c in range(3):
        follows[c, after["second"].to_numpy()] = after[f"n{c}"].to_numpy()
    follows[:, 1:] *= kept["often"].to_numpy(zero_copy_only=False)
    often = bigrams.where(F.col("n0") + F.col("n1") >= MIN_DF).toArrow().sort_by("key")  # rarer ones back off; of the bounded sample
    model = Model(vocabulary, uni, follows, often["key"].to_numpy(), np.array([often["n0"].to_numpy(), often["n1"].to_numpy()], np.float64))
    held = spark.sparkContext.broadcast(model)

    both = rows.where("fold = 1").agg(F.countDistinct("toxic")).first()[0] == 2

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int64())])
        for b in slices(batches):
            got = [(held.value.features(t), c) for t, c, f in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("fold").to_pylist()) if (f == 1) == both]
            if got:
                yield record(schema, *zip(*got))

    fitted = rows.mapInArrow(measured, "x array<double>, toxic long").orderBy("x", "toxic").toPandas()
    model.fit(np.array(fitted["x"].tolist(), float), fitted["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, name: str = "score", **limits: int) -> DataFrame:
    """All rows of docs with the given columns (all), and ``score`` or another name; a column of that name is replaced."""
    model = train(docs, labels, **limits)
    columns = [c for c in columns or docs.columns if c != name]
    if isinstance(model, float):
        return docs.select(*columns, F.lit(model).alias(name))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.select(columns).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([held.value.features(t) for t in b.column("text").to_pylist()], np.float64).reshape(-1, WIDE)
            yield b.select(columns).append_column(name, pa.array(held.value.score(x)))

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, out)


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with their columns; names that begin with __folio_ are reserved."""
    return score(docs, labels, name="__folio_score").where("__folio_score < 0.5").select(docs.columns)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
