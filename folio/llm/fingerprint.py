"""Document fingerprints by randomised edit embedding.

A shared random walk reads the characters: at step j it emits the character it stands on and then moves
on or stays, as a random bit for (j, character) says, so that texts a few edits apart emit sequences of
small Hamming distance (Chakraborty, Goldenberg and Koucky, 2016). The bits repeat with period 64 in
j and characters are dealt to 32 classes, so the walk is an automaton of 64 states; it is run in lockstep
over many texts, three characters a step, from tables. ``SAMPLES`` coordinates of the embedding are sampled,
each the one with the least random key among those the walk reaches, so texts of different lengths mostly
sample the same ones. A fingerprint holds a byte per sample: a hash of the three characters where the
walk stands then. Likeness is the share of equal bytes: an estimate of one minus the relative
Hamming distance. Bands of sampled bytes give candidate pairs, which whole fingerprints then verify.

Every whole text is read. A null text is empty; the empty text has a fingerprint of zeros, and equal texts
equal ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import cells, grouped, record, save, slices, text_slices
from folio.llm.components import connected_components
from folio.llm.simhash import spanning

STATES, CLASSES, SAMPLES = 64, 32, 64
#: Distinct fingerprints in a block of a bucket, and rows that a task compares at once.
SPLIT, BATCH = 1024, 1 << 15
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_WIDE = CLASSES**3


class Walk:
    """The shared random tables; the seed is part of what a fingerprint means."""

    def __init__(self, seed: int = 42, longest: int = 1 << 42):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (STATES, CLASSES))
        bits[rng.integers(0, STATES, CLASSES), np.arange(CLASSES)] = 1  # each class moves on somewhere
        wait = np.zeros((STATES, CLASSES), np.int64)  # steps until the walk leaves a character
        for s in range(STATES):
            for c in range(CLASSES):
                wait[s, c] = 1 + next(k for k in range(STATES) if bits[(s + k) % STATES, c])
        self.wait = wait
        s = np.repeat(np.arange(STATES), _WIDE)
        code = np.tile(np.arange(_WIDE), STATES)
        steps = np.zeros(len(s), np.int64)
        for c in (code // CLASSES**2, code // CLASSES % CLASSES, code % CLASSES):
            steps += wait[(s + steps) % STATES, c]
        self.steps = steps.astype(np.int16)  # by state * CLASSES**3 + three classes
        # The coordinates that a sample would take, by how far the walk reaches: records of falling random keys.
        self.records = []
        for _ in range(SAMPLES):
            at, key, found = 0, 1.0, []
            while at < longest:
                found.append(at)
                key *= rng.random()
                at += 1 + int(rng.exponential() / -np.log1p(-key)) if key < 1 else 1
            self.records.append(np.array(found, np.int64))

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of SAMPLES bytes for each text."""
        out = np.zeros((len(texts), SAMPLES), np.uint8)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        order = [i for i in order if texts[i]]
        if not order:
            return out
        chars = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in order]
        lengths = np.array([len(c) for c in chars])
        triples = -(-lengths // 3)
        starts = np.concatenate(([0], np.cumsum(triples)))
        flat = np.zeros(3 * starts[-1], np.uint32)
        for c, a in zip(chars, starts):
            flat[3 * a : 3 * a + len(c)] = c
        classes = ((flat * np.uint32(2654435761)) >> np.uint32(27)).astype(np.int64)
        code = classes[0::3] * CLASSES**2 + classes[1::3] * CLASSES + classes[2::3]
        # Lockstep: texts in order of length, so those still walking are the first ones.
        reached = np.zeros(len(code), np.int64)  # coordinates before each three characters
        j = np.zeros(len(order), np.int64)
        live = len(order)
        for k in range(int(triples[0])):
            while triples[live - 1] <= k:
                live -= 1
            at = starts[:live] + k
            now = j[:live]
            reached[at] = now
            now += self.steps[(now & (STATES - 1)) * _WIDE + code[at]]
        for r, i in enumerate(order):
            a, b = starts[r], starts[r + 1]
            before = reached[a:b]
            own = classes[3 * a : 3 * a + lengths[r]]
            letters = chars[r]
            end = int(before[-1]) + 1  # the sampled coordinates: those up to where the last three begin
            picks = np.array([p[np.searchsorted(p, end) - 1] for p in self.records])
            t = np.searchsorted(before, picks, "right") - 1
            at, step = 3 * t, before[t]
            for _ in range(2):  # find the character among the three
                more = np.minimum(at + 1, len(own) - 1)
                there = step + self.wait[step & (STATES - 1), own[at]]
                go = (there <= picks) & (more > at)
                at, step = np.where(go, more, at), np.where(go, there, step)
            mark = np.zeros(SAMPLES, np.uint64)
            for k in range(3):
                mark = (mark ^ letters[np.minimum(at + k, len(letters) - 1)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mark ^= mark >> np.uint64(29)
            out[i] = (mark >> np.uint64(40)).astype(np.uint8)
        return out


_walks: dict[int, Walk] = {}


def walk(seed: int = 42) -> Walk:
    if seed not in _walks:
        _walks[seed] = Walk(seed)
    return _walks[seed]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def fingerprints(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, text) to doc_id and fingerprint (hexadecimal)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield record(schema, b.column(0), [x.tobytes().hex() for x in walk(seed)([t or "" for t in b.column(1).to_pylist()])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _alike(least: float):
    """Rows (bucket, sub, node, eight longs of a fingerprint), in order of bucket and sub, to spanning links between nodes."""
    need = math.ceil(least * SAMPLES - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, rest in grouped(batches, BATCH):
            marks = np.ascontiguousarray(rows[3:].T).view(np.uint8)
            found, live = [np.zeros((2, 0), np.int64)], np.flatnonzero(rest >= 1)
            for s in range(1, int(rest.max(initial=0)) + 1):
                live = live[rest[live] >= s]
                for k in range(0, len(live), 1 << 16):
                    i = live[k : k + (1 << 16)]
                    i = i[np.count_nonzero(marks[i] == marks[i + s], axis=1) >= need]
                    found.append(np.stack([i, i + s]))
                if sum(x.shape[1] for x in found) > 1 << 21:  # only what spans need be held
                    root = spanning(len(marks), *np.concatenate(found, axis=1))
                    found = [np.stack([np.arange(len(root)), root])]
            i, j = np.concatenate(found, axis=1)
            root = spanning(len(marks), i, j)
            far = np.flatnonzero(root != np.arange(len(root)))
            yield record(_EDGE, rows[2][far], rows[2][root[far]])

    return run


def neighbours(marks: DataFrame, least: float = 0.8, band: int = 4, split: int = SPLIT) -> DataFrame:
    """(doc_id, fingerprint, ...) with component_id: the least doc_id of the class linked by banding and verification.

    ``SAMPLES // band`` bands of ``band`` sampled bytes. Equal fingerprints are one node; all nodes of a band's bucket are
    compared with each other by whole fingerprints, large buckets block by block, so no link within a bucket is lost.
    A row whose doc_id is null links nothing by itself; its component_id is null where no other row has its fingerprint.
    """
    node = F.xxhash64("fingerprint")
    groups = save(marks.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).withColumn("node", node), "marks")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("fingerprint", 2 * band * k + 1, 2 * band)) for k in range(SAMPLES // band)])
    dealt = groups.select("node", F.explode(bands).alias("bucket"))
    dealt = dealt.join(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    # As longs: two halves of 32 bits each, as conv stops at 63.
    half = lambda k: F.conv(F.substring("fingerprint", k, 8), 16, 10).cast("long")
    longs = [F.shiftleft(half(16 * k + 1), 32).bitwiseOR(half(16 * k + 9)).alias(f"m{k}") for k in range(SAMPLES // 8)]
    rows = cells(dealt, "node", split).join(groups.select("node", *longs), "node").select("bucket", "sub", "node", *[f"m{k}" for k in range(SAMPLES // 8)])
    links = rows.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub").mapInArrow(_alike(least), "a long, b long")
    roots = connected_components(links)
    found = groups.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("fingerprint", "rep", F.coalesce("root", "node").alias("root"))
    least_doc = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marks.join(found.join(least_doc, "root").select("fingerprint", "component_id"), "fingerprint", "left").select(*marks.columns, "component_id")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Row:
    """A document on its way past its next one."""

    __slots__ = ("doc", "text", "mark")

    def __init__(self, doc: int | None, text: str, mark: np.ndarray):
        self.doc, self.text, self.mark = doc, text, mark


def _compared(rows: list[_Row], seed: int) -> pa.RecordBatch:
    """All rows but the last, each against the one after it."""
    new = [edited(a.text, b.text) for a, b in zip(rows, rows[1:])]
    marks = walk(seed)(new)
    own = np.stack([r.mark for r in rows])
    return record(
        _OUT,
        [r.doc for r in rows[:-1]],
        [len(r.text) for r in rows[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        [r.mark.tobytes().hex() for r in rows[:-1]],
        [m.tobytes().hex() for m in marks],
        likeness(own[:-1], marks),
        likeness(own[:-1], own[1:]),
    )


def with_edits(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next document's.

    The next document: in ascending order of doc_id, null first, then of the text where ids repeat; after the
    last comes the first. Rows are sorted by range partitions, each of which passes through its task with
    one row held back; the first and last rows of the partitions then meet in a join of a row for each.
    """
    ends = pa.schema([*_OUT, ("part", pa.int64()), ("place", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def end(place: str) -> pa.RecordBatch:
            r = held[0]
            return record(ends, [r.doc], [len(r.text)], [None], [r.mark.tobytes().hex()], [None], [None], [None], [part], [place], [r.text])

        for b in text_slices(batches, "text"):
            texts = b.column(1).to_pylist()
            begins = not held
            held += [_Row(d, t, m) for d, t, m in zip(b.column(0).to_pylist(), texts, walk(seed)(texts))]
            if begins and held:
                yield end("first")
            if len(held) > 1:
                done = _compared(held, seed)
                blank = [pa.nulls(done.num_rows, t) for t in ends.types[len(_OUT) :]]
                yield pa.RecordBatch.from_arrays([*done.columns, *blank], schema=ends)
            held = held[-1:]
        if held:
            yield end("last")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _DDL + ", part long, place string, text string")
    met = save(met, "fingerprints")
    # One number per partition decides which follows which; the first follows the last.
    order = W.orderBy("part")
    follows = met.where("place = 'first'").select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())))
    last = met.where("place = 'last'").select("part", "doc_id", "text", "fingerprint").join(follows, "part")
    first = met.where("place = 'first'").select(F.col("part").alias("next"), F.col("text").alias("text2"), F.col("fingerprint").alias("mark2"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda x: np.frombuffer(bytes.fromhex(x), np.uint8)
        for b in slices(batches, 64):
            for doc, text, own, text2, mark2 in zip(*[c.to_pylist() for c in b.columns]):
                yield _compared([_Row(doc, text, mark(own)), _Row(None, text2, mark(mark2))], seed)

    closed = last.join(first, "next").select("doc_id", "text", "fingerprint", "text2", "mark2").mapInArrow(close, _DDL)
    return met.where("place is null").select(_OUT.names).unionByName(closed)


def op10_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return neighbours(save(with_edits(table(spark, sf_dir, "documents")), "edits"))
