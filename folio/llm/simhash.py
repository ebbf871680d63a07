"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: 64 majority bits over the XXH64 hashes of a text's word shingles. Two fingerprints
that differ in at most two bits agree in two of four 16-bit blocks, so each distinct fingerprint is
dealt to six buckets of 32 agreed bits. A bucket that holds more than ``SPLIT`` distinct fingerprints
is dealt once more, by two of the four 8-bit blocks of the other 32 bits; 16 bits are then left, so no
bucket can hold more than 65,536. Within a batch of buckets, bit planes are stored vertically, the
members are compared with those at every shift in the order at once, and carry-save counters keep
the distances; words of 64 lanes are abandoned as soon as each lane is past the radius.

Pipelines take ``deduplicate`` with its own shingles and similarity instead of the two bits: see ``alike``.

A fingerprint has at most 64 + 2,016 others within two bits, so links grow with the rows; only
spanning links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cells, forget, grouped, record, save, slices
from folio.llm.components import connected_components

SPLIT = 2048
BATCH = 1 << 18
RADIUS = 2
#: SimHashes of sets whose Jaccard similarity is 0.8 differ in about 10 bits, in more than 22 once in 10,000 pairs or less.
WIDE = 22
#: Bands of min-hashes: at a similarity of 0.8 one of 16 bands of 4 agrees for all but 2 in 10,000 pairs.
BANDS, WIDTH = 16, 4
#: Longs that hold a byte of each min-hash. At 0.8 less than 36 of 64 agree once in 100,000 pairs.
SIGNS, AGREED = BANDS * WIDTH // 8, 36
#: Nodes and shingles of a block of a group, and bytes of shingle hashes that a task holds before it compares whole groups.
NODES, BLOCK, HELD = 1024, 1 << 20, 1 << 24
_rng = np.random.default_rng(9)
_MIX = _rng.integers(0, 2**64, BANDS * WIDTH, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * WIDTH, dtype=np.uint64)
#: The bits of each byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text: 0 where there are no words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        marks = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536])]), np.uint8).reshape(-1, 8)
        for k in range(8):  # the digest's bytes come highest first
            ones[8 * (7 - k) : 8 * (8 - k)] += np.bincount(marks[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long), one row each; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield record(_FP, b.column(0), np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _fingerprinted(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, same, text) to (doc_id, same, fp)."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield record(schema, b.column(0), b.column(1), np.array([simhash(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64))

    return rows.mapInArrow(run, "doc_id long, same long, fp long")


def _blocks(c: Column, of: list[int], width: int) -> list[Column]:
    """The values of pairs of the blocks at these bits."""
    block = lambda at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))
    return [F.shiftleft(block(x), width).bitwiseOR(block(y)) for x, y in combinations(of, 2)]


def _rest(c: Column) -> Column:
    """For each of the six pairs of 16-bit blocks, the 32 bits of the other two."""
    block = lambda at: F.shiftrightunsigned(c, at).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations([0, 16, 32, 48], 2))
    return F.array(*[F.array(*_blocks(F.shiftleft(block(p), 16).bitwiseOR(block(q)), [0, 8, 16, 24], 8)) for x, y in pairs for p, q in [[z for z in (0, 16, 32, 48) if z not in (x, y)]]])


def _found(fp: np.ndarray, rest: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of positions with j - i <= rest[i] whose fingerprints differ in at most ``radius`` bits, shift by shift."""
    n = len(fp)
    words = (n + 63) // 64
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.zeros((64, words + (n >> 6) + 3), np.uint64)
    planes[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    del bits
    left = np.full(words * 64, 0, np.int64)
    left[:n] = rest
    live = np.flatnonzero(left >= 1)

    def past(count: np.ndarray) -> np.ndarray:
        """Lanes whose counters, lowest plane first and the overflow last, are beyond the radius."""
        more, even = count[-1].copy(), np.full(count.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(len(count) - 2, -1, -1):
            if radius >> k & 1:
                even &= count[k]
            else:
                more |= even & count[k]
                even &= ~count[k]
        return more

    for s in range(1, int(left.max(initial=0)) + 1):
        live = live[left[live] >= s]
        at = np.unique(live >> 6)
        count = np.zeros((radius.bit_length() + 1, len(at)), np.uint64)
        count[-1] = ~np.packbits(left.reshape(-1, 64)[at] >= s, axis=1, bitorder="little").view(np.uint64)[:, 0]
        off, bit = s >> 6, np.uint64(s & 63)
        for b in range(64):
            row = planes[b]
            other = row[at + off] >> bit
            if bit:
                other |= row[at + off + 1] << (np.uint64(64) - bit)
            d = row[at] ^ other
            for k in range(len(count) - 1):
                carry = count[k] & d
                count[k] ^= d
                d = carry
            count[-1] |= d
            if b % 8 == 7:
                keep_ = past(count) != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not keep_.all():
                    at, count = at[keep_], count[:, keep_]
                    if not len(at):
                        break
        if len(at):
            ok = ~past(count)
            w, lane = np.nonzero(np.unpackbits(ok.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[w] * 64 + lane
            yield i, i + s


def _within(fp: np.ndarray, rest: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_found(fp, rest, radius)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each position the smallest one that links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sub, fp, rep), in order of bucket and sub, to spanning links between reps."""
    for rows, rest in grouped(batches, BATCH):
        i, j = _within(rows[2].view(np.uint64), rest)
        root = spanning(rows.shape[1], i, j)
        far = np.flatnonzero(root != np.arange(len(root)))
        yield record(_EDGE, rows[3][far], rows[3][root[far]])


def near_links(groups: DataFrame, split: int = SPLIT) -> DataFrame:
    """groups(fp, rep), each fp once, to spanning links (a, b) between reps of fingerprints within two bits."""
    pairs = list(combinations([0, 16, 32, 48], 2))
    keys = [F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(key) for k, key in enumerate(_blocks(F.col("fp"), [0, 16, 32, 48], 16))]
    assert len(keys) == len(pairs)
    dealt = groups.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(sizes, "bucket")
    subs = F.element_at(_rest(F.col("fp")), (F.shiftright("bucket", 32) + 1).cast("int"))
    sub = F.when(F.col("n") > split, F.transform(subs, lambda v, i: F.shiftleft(i.cast("long") + 1, 16).bitwiseOR(v))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.select("bucket", "fp", "rep", F.explode(sub).alias("sub")).select("bucket", "sub", "fp", "rep")
    return dealt.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub").mapInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, fp long, component_id), one row per input row.

    Equal fingerprints link, zero ones too. A row whose doc_id is null links nothing by itself; its
    component_id is that of the other rows with its fingerprint, null where there is none.
    """
    fps = save(fingerprints(docs, words), "fingerprints")
    groups = save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "groups")
    roots = connected_components(near_links(groups))
    classes = groups.join(roots, groups.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marks(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[words - 1 :].tolist() or [len(joined)]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n))


def _sketch(marks: np.ndarray) -> tuple[int, int, list[int], np.ndarray]:
    """A number for the set, the SimHash of its shingles, a key for each of its min-hash bands and a byte of each min-hash, as longs."""
    node = xxhash.xxh64_intdigest(marks.tobytes(), 7)
    if not len(marks):
        return node, 0, [], np.zeros(SIGNS, np.int64)
    ones, least = np.zeros(64, np.int64), np.full(BANDS * WIDTH, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(marks), 4096):
        part = marks[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        mixed = _MIX[:, None] * (part ^ (part >> np.uint64(31))) + _ADD[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    fp = int(np.packbits(2 * ones > len(marks), bitorder="little").view(np.uint64)[0])
    return node, fp, [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, WIDTH))], (least >> np.uint64(24)).astype(np.uint8).view(np.int64)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, same, text) to (doc_id, same, node, size, fp, bands, signs)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", longs), ("signs", longs)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = [_marks(t, words) for t in b.column(2).to_pylist()]
            got = [_sketch(m) for m in marks]
            yield record(schema, b.column(0), b.column(1), [signed(x[0]) for x in got], [len(m) for m in marks], [signed(x[1]) for x in got], [[signed(y) for y in x[2]] for x in got], [x[3].tolist() for x in got])

    return rows.mapInArrow(run, "doc_id long, same long, node long, size long, fp long, bands array<long>, signs array<long>")


class _Classes:
    """Classes of positions that grow with links; ``apart`` says which pairs are of different classes, as of the last look."""

    def __init__(self, n: int):
        self.root, self.links, self.new = np.arange(n), [], 0

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.root[i] != self.root[j]

    def link(self, i: np.ndarray, j: np.ndarray, soon: int = 4096) -> None:
        self.links.append((i, j))
        self.new += len(i)
        if self.new > soon:
            self.close()

    def close(self) -> np.ndarray:
        if self.new:
            far = np.flatnonzero(self.root != np.arange(len(self.root)))
            i, j = (np.concatenate(x) for x in zip(*self.links, (far, self.root[far])))
            self.root, self.links, self.new = spanning(len(self.root), i, j), [], 0
        return self.root


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sub, fp, node, signs...), in order of bucket and sub, to spanning links between nodes that SimHash and min-hashes find near."""
    for rows, rest in grouped(batches, BATCH):
        signs = np.ascontiguousarray(rows[4:].T).view(np.uint8)
        classes = _Classes(rows.shape[1])
        for i, j in _found(rows[2].view(np.uint64), rest, WIDE):
            new = classes.apart(i, j)
            i, j = i[new], j[new]
            near = (signs[i] == signs[j]).sum(axis=1) >= AGREED
            classes.link(i[near], j[near])
        root = classes.close()
        far = np.flatnonzero(root != np.arange(len(root)))
        yield record(_EDGE, rows[3][far], rows[3][root[far]])


def common(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """How many of the distinct ``ids`` from starts[i] on, sizes[i] of them, each pair of positions shares; about ``most`` ids at once."""
    out = np.zeros(len(i), np.int64)
    upto = np.cumsum(sizes[i] + sizes[j])
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        who = np.stack((i[at:to], j[at:to]), axis=1).ravel()
        n = sizes[who]
        where = np.repeat(starts[who] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys = np.sort((np.repeat(np.arange(len(who)) >> 1, n).astype(np.int64) << 32) | ids[where])
        out[at:to] = np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 32, minlength=to - at)
        at = to
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Rows (group, sub, fp, node, marks), in order of group and sub: the longs, how many rows of its group follow each, and the marks; some whole groups at once."""
    held, marks, size = [], [], 0

    def cut(rows: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        ends = np.append(np.flatnonzero((np.diff(rows[:2]) != 0).any(axis=0)) + 1, rows.shape[1])
        return rows, np.repeat(ends, np.diff(np.append(0, ends))) - 1 - np.arange(rows.shape[1]), marks

    for b in slices(batches, 256):
        held.append(np.stack([c.to_numpy() for c in b.columns[:4]]))
        marks += b.column(4).to_pylist()
        size += sum(map(len, marks[-b.num_rows :]))
        if size >= HELD:
            rows = np.concatenate(held, axis=1)
            other = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
            if len(other):
                to = int(other[-1]) + 1
                yield cut(np.ascontiguousarray(rows[:, :to]), marks[:to])
                rows, marks = rows[:, to:], marks[to:]
            held, size = [rows], sum(map(len, marks)) if len(other) else 0
    if marks:
        yield cut(np.concatenate(held, axis=1), marks)


def _alike(least: float):
    """Rows (group, sub, fp, node, marks) to spanning links between nodes whose shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, rest, marks in _whole_groups(batches):
            sizes = np.array([len(m) >> 3 for m in marks], np.int64)
            starts = np.cumsum(sizes) - sizes
            _, ids = np.unique(np.frombuffer(b"".join(marks), np.uint64), return_inverse=True)
            classes = _Classes(rows.shape[1])
            for i, j in _found(rows[2].view(np.uint64), rest, WIDE):
                new = classes.apart(i, j) & (np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]))
                i, j = i[new], j[new]
                both = common(ids, starts, sizes, i, j)
                ok = both >= least * (sizes[i] + sizes[j] - both)
                classes.link(i[ok], j[ok], 256)
            root = classes.close()
            far = np.flatnonzero(root != np.arange(len(root)))
            yield record(_EDGE, rows[3][far], rows[3][root[far]])

    return run


def _marked(texts: DataFrame, words: int) -> DataFrame:
    """(group, sub array, fp, node, text) to the same with ``marks``, the text's distinct shingles in order, instead of it."""
    schema = pa.schema([("group", pa.int64()), ("sub", pa.list_(pa.int64())), ("fp", pa.int64()), ("node", pa.int64()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            yield record(schema, *b.columns[:4], [_marks(t, words).tobytes() for t in b.column(4).to_pylist()])

    return texts.mapInArrow(run, "group long, sub array<long>, fp long, node long, marks binary")


def alike(docs: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, same, text) to (doc_id, same, root): classes linked by Jaccard similarity of distinct shingles of at least ``least``.

    Rows with equal shingle sets are one node. Blocks of SimHash bits can't select at such a similarity (at 0.8 about
    10 of 64 bits differ), so bands of min-hashes deal nodes to buckets. In a bucket, nodes are compared bit-sliced by SimHash within
    ``WIDE`` bits, then by how many of 64 min-hashes agree, ``AGREED`` at least; what this leaves is joined to groups, by spanning
    links alone. Only nodes in groups of two or more have their texts moved, once, and turned to shingle hashes. A group, dealt to pairs of blocks
    where it is large, is compared bit-sliced again, every node with every other, and what is near and not yet of one class is
    verified by the hashes. No pair leaves a task.
    """
    sketched = save(_sketches(docs, words), "sketches")
    nodes = save(sketched.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signs").alias("signs"), F.min(F.struct("doc_id", "same")).alias("rep")), "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    dealt = dealt.join(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    dealt = dealt.join(nodes.select("node", "fp", *[F.col("signs")[k].alias(f"s{k}") for k in range(SIGNS)]), "node")
    dealt = cells(dealt, "node", SPLIT).select("bucket", "sub", "fp", "node", *[f"s{k}" for k in range(SIGNS)])
    near = save(dealt.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub").mapInArrow(_close, "a long, b long"), "near")
    groups = connected_components(near)
    member = nodes.join(groups, "node", "left").select("node", "fp", "size", "rep.*", F.coalesce("root", "node").alias("group"))
    sums = groups.groupBy(F.col("root").alias("group")).agg(F.count("*").alias("others"))
    member = save(member.join(sums, "group"), "members")
    heavy = member.groupBy("group").agg(F.greatest(F.count("*") / NODES, F.sum("size") / BLOCK).alias("n"))
    k = F.ceil("n")
    own = F.pmod(F.xxhash64("node"), k)
    subs = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda x: F.least(x, own) * k + F.greatest(x, own))
    placed = member.join(heavy, "group").select("doc_id", "same", "node", "fp", "group", subs.alias("sub"))
    texts = docs.join(placed, ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]).select("group", "sub", "fp", "node", "text")
    marked = _marked(texts, words).select("group", F.explode("sub").alias("sub"), "fp", "node", "marks")
    links = marked.repartition("group", "sub").sortWithinPartitions("group", "sub").mapInArrow(_alike(least), "a long, b long")
    found = save(links, "links")
    roots = connected_components(found)
    out = save(sketched.join(roots, "node", "left").select("doc_id", "same", F.coalesce("root", "node").alias("root")), "classes")
    for x in (sketched, nodes, near, groups, member, found, roots):
        forget(x)
    return out


def deduplicate(docs: DataFrame, words: int = 3, least: float | None = None) -> DataFrame:
    """The documents of which none with a smaller doc_id is in the same component; all columns stay.

    Components are those of fingerprints within two bits or, with ``least``, of shingle sets so alike. Rows that repeat a
    doc_id with the same text collapse to one, those with different texts are documents apiece; a null doc_id stays.
    Names that begin with __folio_ are reserved; an empty table gives an empty one.
    """
    rows = docs.where("doc_id is not null").withColumns({"__folio_id": F.col("doc_id").cast("long"), "__folio_same": F.xxhash64(F.col("text").cast("string"))})
    plain = rows.select(F.col("__folio_id").alias("doc_id"), F.col("__folio_same").alias("same"), F.col("text").cast("string").alias("text"))
    if least is None:
        fps = save(_fingerprinted(plain, words), "fingerprints")
        roots = connected_components(near_links(fps.select("fp", F.col("fp").alias("rep")).distinct()))
        found = fps.join(roots, fps.fp == roots.node, "left").select("doc_id", "same", F.coalesce("root", "fp").alias("root"))
    else:
        found = alike(plain, words, least)
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "same")).alias("c")).select(F.col("c.doc_id").alias("__folio_id"), F.col("c.same").alias("__folio_same"))
    named = rows.join(chosen, ["__folio_id", "__folio_same"], "left_semi").dropDuplicates(["__folio_id", "__folio_same"])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
