"""LM scoring with a probabilistic suffix tree over words.

Symbols are the lower-cased words and one for the end of the text. Words of at least 1/65,536 of the tokens are symbols of their
own, all others are dealt by a hash to ``CLASSES`` classes, and a word's probability is its class's in context times its own in
its class, so the table of single symbols is bounded and the contexts are not. A context is the up to ``DEPTH`` symbols before, over
all borders of words, from the beginning of the text, which is a symbol too. Contexts that the training texts have twice
or more are kept where the next symbols diverge from those that the shorter context foretells: count times
Kullback-Leibler divergence of at least ``GAIN`` nats; what is a suffix of a kept one stays too. A context's next-symbol distribution is smoothed
by the shorter one's (Witten-Bell, the shorter one weighing ``WEIGHT`` times the number of distinct next symbols), down to single symbols, each
with 0.1 added. A symbol is scored in the state of the longest kept suffix. In its class a word has its share, next to
one part for each distinct word that goes to words never seen in training, which are spelt by a suffix tree over bytes, learnt from the distinct words.

No tree is gathered: of a text only its positions travel, packed, each to the cell of the symbol before it, where all contexts
that end in this symbol have all their counts; the cell tests, smooths and scores, and sends back sums by document. A symbol that is
before more than ``room`` positions stays a state for the longer contexts' sake, and its cell goes through its positions in parts, by the two symbols before. One
that is before more than ``WIDE`` times as many has no cell: its positions go to those of (symbol, next symbol), which count these pairs, and with the counts
on to those of (two symbols before, symbol). So a cell holds at most what one symbol of bounded
frequency has or one pair; and rows are packed blocks, with the bucket of a cell as a key.

A text's rarer words get their counts by a hash join: distinct words and what batches of documents ask of them meet in buckets. Words meet by 64-bit hashes.
A null text is empty: it has the end token alone. With no training rows all counts are zero and all words are new.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import held_out, record, save, shuffles, slices, text_slices

DEPTH = 3
GAIN = 4.0
WEIGHT = (3.0, 2.0, 1.0)
FOLDS = 10
HEAVY, CLASSES = 65_536, 1 << 20
#: Symbols: heavy words by rank, the end of a text, what is before its beginning, the classes.
STOP, START, FIRST = HEAVY, HEAVY + 1, HEAVY + 2
SYMBOLS, BITS = FIRST + CLASSES, 21
ADDED = 0.1
#: Positions in a cell's bucket, on average; words that a task counts before it hands them on; distinct words in a bucket.
ROOM, WIDE, HELD, BUCKET = 500_000, 10, 400_000, 250_000
#: The spelling of words outside the vocabulary: contexts of so many bytes, of at least this share of all, and pairs of context and byte.
SPELT, LEAST, PAIRS = 4, 2.0**-16, 2.0**-20
SPACE = 32
_RNG = np.random.default_rng(20240229)
_AT = _RNG.integers(0, 2**63, (SPELT + 1, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEXT = _RNG.integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Positions:
    """The symbols of a batch of words and the hashes of what came before them."""

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        line = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8)  # a space before and after each
        if not len(words):
            line = line[:0]
        starts = np.concatenate(([0], np.cumsum(size + 2)[:-1])) if len(words) else np.zeros(0, np.int64)
        self.word = np.repeat(np.arange(len(words)), size + 1)
        self.off = np.arange(len(self.word)) - np.repeat(np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(words) else starts, size + 1) + 1
        self.at = starts[self.word] + self.off
        self.line, self.symbol = line, line[self.at].astype(np.int64)

    def contexts(self, depth: int) -> np.ndarray:
        """Hashes of the last ``depth`` bytes; only right where ``off`` is at least that."""
        h = np.zeros(len(self.at), np.uint64)
        for k in range(1, depth + 1):
            h ^= _AT[k][self.line[np.maximum(self.at - k, 0)]]
        return h


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


class Tree:
    """Kept contexts by level, with smoothed distributions as arrays of hashes."""

    def __init__(self, root: np.ndarray, levels: list[tuple[np.ndarray, ...]]):
        """root: counts of the 257 symbols' codes; levels: rows (context, shorter context, symbol, count) of each depth."""
        total = root.sum()
        self.root = (root + 0.5) / (total + 0.5 * len(root))
        above, found = None, []
        for ctx, shorter, symbol, n in levels:
            order = np.lexsort((symbol, ctx))
            ctx, shorter, symbol, n = ctx[order], shorter[order], symbol[order], n[order].astype(np.float64)
            new = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, np.int64)
            names, parents = ctx[new], shorter[new]
            which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ctx))))
            c, m = np.bincount(which, n, len(new)), np.bincount(which, minlength=len(new)).astype(np.float64)
            low = self._of(above, shorter, symbol)
            p = (n + m[which] * low) / (c + m)[which]
            gain = np.bincount(which, n * np.log(n / c[which] / low), len(new)) if len(n) else np.zeros(0)
            above = {"names": names, "parents": parents, "gain": gain, "rest": m / (c + m), "above": above, "keys": ctx ^ _NEXT[symbol], "p": p}
            order = np.argsort(above["keys"])
            above["keys"], above["p"], above["owner"] = above["keys"][order], p[order], which[order]
            found.append(above)
        need = np.zeros(0, np.uint64)
        self.levels = []
        for x in reversed(found):
            stays = (x["gain"] >= GAIN) | np.isin(x["names"], need)
            need = np.unique(x["parents"][stays])
            mine = stays[x["owner"]] if len(x["owner"]) else np.zeros(0, bool)
            self.levels.insert(0, (x["names"][stays], np.log10(x["rest"][stays]), x["keys"][mine], np.log10(x["p"][mine])))

    def _of(self, level: dict | None, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The smoothed probability of each symbol after each context of a level."""
        if level is None:
            return self.root[symbol]
        at = member(ctx ^ _NEXT[symbol], level["keys"])
        out = np.empty(len(ctx))
        hit = at >= 0
        out[hit] = level["p"][at[hit]]
        if not hit.all():
            own = member(ctx[~hit], level["names"])
            out[~hit] = level["rest"][own] * self._of(level["above"], level["parents"][own], symbol[~hit])
        return out

    def logs(self, p: Positions) -> np.ndarray:
        """log10 of each symbol's probability in the state of its longest kept suffix."""
        n = len(p.at)
        hashes, state = [np.zeros(n, np.uint64)], []
        alive = np.ones(n, bool)
        for k, (names, *_rest) in enumerate(self.levels, 1):
            hashes.append(hashes[-1] ^ _AT[k][p.line[np.maximum(p.at - k, 0)]])
            at = np.full(n, -1)
            go = np.flatnonzero(alive & (p.off >= k))
            at[go] = member(hashes[k][go], names)
            alive = at >= 0
            state.append(at)
        out, todo = np.zeros(n), np.arange(n)
        for k in range(len(self.levels), 0, -1):
            _, rest, keys, logp = self.levels[k - 1]
            mine = todo[state[k - 1][todo] >= 0]
            at = member(hashes[k][mine] ^ _NEXT[p.symbol[mine]], keys)
            hit = at >= 0
            out[mine[hit]] += logp[at[hit]]
            out[mine[~hit]] += rest[state[k - 1][mine[~hit]]]
            done = np.zeros(n, bool)
            done[mine[hit]] = True
            todo = todo[~done[todo]]
        out[todo] += np.log10(self.root[p.symbol[todo]])
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        p = Positions(words)
        return np.bincount(p.word, self.logs(p), len(words)) if len(words) else np.zeros(0)


def count_words(rows: DataFrame) -> DataFrame:
    """(text, out boolean) to (word binary, n): occurrences in the training texts; words of held-out texts alone have zero."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in slices(batches, 256):
            for text, out in zip(b.column("text").to_pylist(), b.column("out").to_pylist()):
                if out:
                    for w in set(tokens_of(text)):
                        held[w] += 0
                else:
                    held.update(tokens_of(text))
            if len(held) > HELD:
                yield record(schema, list(held), list(held.values()))
                held.clear()
        if held:
            yield record(schema, list(held), list(held.values()))

    return rows.select("text", "out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _grow(words: DataFrame, depth: int, known: np.ndarray) -> DataFrame:
    """Counts (ctx, symbol, shorter, n) at a depth, once a distinct word, after contexts of the depth before that are known."""
    schema = pa.schema([("ctx", pa.int64()), ("shorter", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])
    held = words.sparkSession.sparkContext.broadcast(known)  # at most 1 / LEAST hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 65536):
            p = Positions(b.column(0).to_pylist())
            own, shorter = p.contexts(depth), p.contexts(depth - 1)
            at = np.flatnonzero(p.off >= depth)
            if depth > 1:
                at = at[member(shorter[at], held.value) >= 0]
            if len(at):
                _, first, n = np.unique(own[at] ^ _NEXT[p.symbol[at]], return_index=True, return_counts=True)
                one = at[first]
                yield record(schema, own[one].view(np.int64), shorter[one].view(np.int64), p.symbol[one].astype(np.int32), n)

    return words.select("word").mapInArrow(run, "ctx long, shorter long, symbol int, n long").groupBy("ctx", "symbol").agg(F.min("shorter").alias("shorter"), F.sum("n").alias("n"))


def spelling(words: DataFrame) -> Tree:
    """The byte tree of the distinct words of (word, n) with n > 0: of a size that LEAST and PAIRS bound."""
    some = words.where("n > 0")
    schema = pa.schema([("symbol", pa.int32()), ("n", pa.int64())])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 65536):
            got = np.bincount(Positions(b.column(0).to_pylist()).symbol, minlength=256)
            yield record(schema, np.flatnonzero(got).astype(np.int32), got[got > 0])

    root = np.zeros(256)
    for symbol, n in some.select("word").mapInArrow(single, "symbol int, n long").groupBy("symbol").agg(F.sum("n")).collect():
        root[symbol] = n
    levels, known = [], np.zeros(0, np.uint64)
    for depth in range(1, SPELT + 1):
        grown = _grow(some, depth, known).where(F.col("n") >= max(1.0, PAIRS * root.sum()))
        kept = grown.groupBy("ctx").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1.0, LEAST * root.sum()))
        rows = grown.join(kept.select("ctx"), "ctx").select("ctx", "shorter", "symbol", "n").toArrow()  # at most 1 / PAIRS rows
        ctx, shorter, symbol, n = (c.to_numpy() for c in rows.columns)
        if not len(n):
            break
        levels.append((ctx.view(np.uint64), shorter.view(np.uint64), symbol.astype(np.int64), n))
        known = np.unique(levels[-1][0])
    return Tree(root, levels)


def state_logs(codes: np.ndarray, train: np.ndarray, single: np.ndarray, first: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 of each position's symbol in the state of its longest kept suffix.

    codes: the symbols one, two and three before and the symbol itself; the positions are all those of their first symbols, or
    where ``first`` gives (count of symbol and next, count of symbol, distinct next ones), all those of their first two.
    """
    h, n = codes.astype(np.int64), codes.shape[1]
    low, ctx = single[h[3]], np.zeros(n, np.int64)
    chain, kept = [low], []
    for d in range(DEPTH):
        ctx = np.unique(ctx << BITS | h[d], return_inverse=True)[1]
        if d == 0 and first is not None:
            with_next, total, kinds = first
            stays = np.ones(int(ctx.max(initial=-1)) + 1, bool)
        else:
            _, one, gram = np.unique(ctx << BITS | h[3], return_index=True, return_inverse=True)
            grams, totals = np.bincount(gram, train), np.bincount(ctx, train)
            distinct = np.bincount(ctx[one], grams > 0, len(totals))
            with_next, total, kinds = grams[gram], totals[ctx], distinct[ctx]
            gain = np.zeros(n)
            gain[train] = np.log(with_next[train] / total[train] / low[train])
            stays = (totals >= 2) & (np.bincount(ctx, gain) >= GAIN)
        rest = WEIGHT[d] * kinds
        low = np.where(total > 0, (with_next + rest * low) / np.maximum(total + rest, 1), low)
        chain.append(low)
        kept.append((ctx, stays))
    out, below, open_ = chain[0].copy(), np.zeros(n, bool), np.ones(n, bool)
    for d in range(DEPTH - 1, -1, -1):
        ctx, stays = kept[d]
        if n:
            stays = stays | (np.bincount(ctx, below) > 0)
        below = stays[ctx]
        go = below & open_
        out[go], open_ = chain[d + 1][go], open_ & ~below
    return np.log10(out)


def cell_logs(codes: np.ndarray, train: np.ndarray, single: np.ndarray, before: np.ndarray, room: int) -> np.ndarray:
    """``state_logs`` of all positions of some first symbols, in parts of about ``room``; first symbols before more than that stay states."""
    out = np.empty(codes.shape[1])
    many = before[codes[0]] > room
    for go in (np.flatnonzero(~many), np.flatnonzero(many)):
        if not len(go):
            continue
        first = None
        parts = max(1, -(-len(go) // room))
        if many[go[0]]:
            _, one, gram = np.unique(codes[0, go].astype(np.int64) << BITS | codes[3, go], return_index=True, return_inverse=True)
            grams = np.bincount(gram, train[go])
            distinct = np.bincount(codes[0, go[one]], grams > 0, len(before))
            first = (grams[gram], before[codes[0, go]], distinct[codes[0, go]])
        for part in _split(_dealt(codes[0, go], 0 if first is None else codes[1, go], parts)):
            at = go[part]
            out[at] = state_logs(codes[:, at], train[at], single, None if first is None else tuple(x[part] for x in first))
    return out


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed, behind the number of values."""
    x = np.ascontiguousarray(x)
    return len(x).to_bytes(4, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _values(packed: bytes, kind: type) -> np.ndarray:
    n, wide = int.from_bytes(packed[:4], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(packed[4:], n * wide, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(wide, n).T).view(kind).reshape(n)


_ROW = "bucket long, kind int, batch long, keys binary, a binary, b binary"
_ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
WORDS, ASK, NEAR, PAIR, OWN, KINDS, PASSED, ANSWER, TOLD = range(9)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _positions(found: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Codes and documents of packed positions, and how many each block has."""
    docs = [np.cumsum(_values(x, np.uint32), dtype=np.uint32) for _, x in found]
    codes = np.concatenate([_values(x, np.uint32).reshape(DEPTH + 1, -1) for x, _ in found], axis=1)
    return codes, np.concatenate(docs), [len(x) for x in docs]


def _dealt(a: np.ndarray, b: np.ndarray | int, buckets: int) -> np.ndarray:
    """Buckets of symbols or pairs of symbols."""
    x = (a.astype(np.uint64) << np.uint64(BITS) | np.asarray(b, np.uint64)) * _ODD
    return ((x ^ x >> np.uint64(29)) * _ODD >> np.uint64(24)).astype(np.int64) % buckets


def _split(at: np.ndarray) -> list[np.ndarray]:
    """Positions with equal values, in order."""
    order = np.argsort(at, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []


def _sent(kind: int, at: np.ndarray, batch: int, codes: np.ndarray, docs: np.ndarray, more: tuple[np.ndarray, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Positions packed by bucket."""
    out = []
    for part in _split(at):
        extra = [_squeezed(x[part]) for x in more]
        out.append((int(at[part[0]]), kind, batch, _squeezed(codes[:, part].reshape(-1)), _squeezed(np.diff(docs[part], prepend=np.uint32(0))), b"".join(len(x).to_bytes(4, "little") + x for x in extra) or None))
    if out:
        yield record(_ROWS, *zip(*out))


def _sums(batch: np.ndarray, docs: np.ndarray, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the positions add to documents, for each batch."""
    order = np.lexsort((docs, batch))
    batch, docs, logs = batch[order], docs[order], logs[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(batch) != 0) | (np.diff(docs) != 0)))) if len(docs) else np.zeros(0, np.int64)
    if len(new):
        total, batch, docs = np.add.reduceat(logs, new), batch[new], docs[new]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(batch)) + 1, [len(batch)]))
        out = [(0, ANSWER, int(batch[a]), _squeezed(docs[a:b]), None, total[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield record(_ROWS, *zip(*out))


def scores(docs: DataFrame, room: int = ROOM) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("out", held_out(F.col("doc_id"), FOLDS))
    texts = rows.where("not out").count()
    words = save(count_words(rows), "words")
    sums = words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count("*")).first()
    total, kinds = (sums[0] or 0) + texts, sums[1] + (texts > 0)
    base = lambda c: np.log10((np.asarray(c, float) + 0.1) / (total + 0.1 * (kinds + 1)))
    is_heavy = F.col("n") * HEAVY >= max(total, 1)
    heavy = words.where(is_heavy).orderBy(F.desc("n"), "word").select("word", "n").toArrow()  # at most HEAVY rows
    names = heavy["word"].to_pylist()

    # Single symbols: their counts, a table of SYMBOLS numbers.
    signed = lambda h: h.astype(np.uint64) % np.uint64(CLASSES)
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("distinct", pa.int64())])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 65536):
            at = signed(np.fromiter(map(_hash, b.column(0).to_pylist()), np.uint64, b.num_rows)).astype(np.int64)
            got = np.unique(at)
            n = np.bincount(at, b.column(1).to_numpy(), CLASSES)[got].astype(np.int64)
            yield record(schema, got, n, np.bincount(at, minlength=CLASSES)[got])

    got = words.where(~is_heavy & (F.col("n") > 0)).mapInArrow(classed, "class long, n long, distinct long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).toArrow()
    counts, distinct = np.zeros(SYMBOLS, np.int64), np.zeros(CLASSES, np.int64)
    counts[: len(names)], counts[STOP] = heavy["n"].to_numpy(), texts
    counts[FIRST + got["class"].to_numpy()], distinct[got["class"].to_numpy()] = got["n"].to_numpy(), got["distinct"].to_numpy()
    single = (counts + ADDED) / (total + ADDED * (len(names) + 1 + CLASSES))
    before = counts.copy()  # as what is before a symbol: the end never is, the beginning is once a text
    before[STOP], before[START] = 0, texts
    buckets, shelves = max(shuffles(spark), -(-total // room)), max(shuffles(spark), -(-sums[2] // BUCKET))
    hot = np.flatnonzero(before > WIDE * room)
    held = spark.sparkContext.broadcast((dict(zip(names, range(len(names)))), base(heavy["n"].to_numpy()), single, before, distinct, hot, spelling(words)))
    end = (float(texts > 0), float(base(texts)))

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their counts and the logs of their shares of their classes, packed by bucket."""
        of_class, kinds_, tree = held.value[3][FIRST:], held.value[4], held.value[6]
        for b in slices(batches, 65536):
            w, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            h = np.fromiter(map(_hash, w), np.uint64, len(w))
            at = signed(h).astype(np.int64)
            whole = of_class[at] + kinds_[at]
            share = np.log10(np.where(n > 0, n, np.maximum(kinds_[at], 1)) / np.maximum(whole, 1))
            new = np.flatnonzero(n == 0)
            share[new] += np.minimum(0, tree.words([w[k] for k in new]) + math.log10(CLASSES))  # of all spellings, a class has one in CLASSES
            to = (h >> np.uint64(32)).astype(np.int64) % shelves
            out = [(int(to[part[0]]), WORDS, 0, h[part].tobytes(), _squeezed(n[part]), _squeezed(share[part].astype(np.float32))) for part in _split(to)]
            if out:
                yield record(_ROWS, *zip(*out))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch of documents: what is known of it here, the hashes of its rarer words, and its positions."""
        number = TaskContext.get().partitionId() << 32
        places, logs, _, _, _, hot_, _ = held.value
        for b in text_slices(batches, "text", 4096, 8_000_000):
            size, far, hashes, codes = [], [], [], []
            sums_ = np.zeros((b.num_rows, 3))
            for k, text in enumerate(b.column(1).to_pylist()):
                w = tokens_of(text)
                got = np.fromiter((places.get(x, -1) for x in w), np.int64, len(w))
                rare = np.flatnonzero(got < 0)
                ids = np.delete(got, rare) if len(rare) else got
                rest = np.fromiter((_hash(w[i]) for i in rare.tolist()), np.uint64, len(rare))
                got[rare] = FIRST + signed(rest).astype(np.int64)
                sums_[k, 0], sums_[k, 1] = len(ids) + end[0], logs[ids].sum() + end[1]
                size.append(len(w) + 1)
                far.append(len(rare))
                hashes.append(rest)
                codes.append(np.append(got, STOP))
            ids, sizes, out = b.column(0), np.array(size), np.array(b.column(2).to_pylist(), np.int64)
            own = np.stack([np.array(ids.fill_null(0), np.int64), np.array(ids.is_null(), np.int64), sizes, out], axis=1)
            yield record(_ROWS, [number % buckets], [OWN], [number], [None], [own.tobytes()], [sums_.tobytes()])
            which, far_ = np.repeat(np.arange(b.num_rows, dtype=np.uint32), far), np.concatenate(hashes)
            order = np.argsort(far_, kind="stable")
            far_, which = far_[order], which[order]
            new = np.flatnonzero(np.concatenate(([True], far_[1:] != far_[:-1]))) if len(far_) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(far_)))
            asks = []
            for part in _split((far_[new] >> np.uint64(32)).astype(np.int64) % shelves):
                each = np.repeat(new[part], times[part]) + np.arange(times[part].sum()) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
                asks.append((int(far_[new[part[0]]] >> np.uint64(32)) % shelves, ASK, number, far_[new[part]].tobytes(), _squeezed(which[each]), _squeezed(times[part].astype(np.uint32))))
            if asks:
                yield record(_ROWS, *zip(*asks))
            flat = np.concatenate(codes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            grams = np.stack([*[np.where(place >= d, np.roll(flat, d), START) for d in range(1, DEPTH + 1)], flat]).astype(np.uint32)
            doc = np.repeat(np.arange(b.num_rows, dtype=np.uint32) * 2 + (1 - out).astype(np.uint32), sizes)
            pair = np.isin(grams[0], hot_)
            for kind, go in ((NEAR, ~pair), (PAIR, pair)):
                some = grams[:, go]
                yield from _sent(kind, _dealt(some[0], some[3] if kind == PAIR else 0, buckets), number, some, doc[go])
            number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket and kind: answers to what batches asked of it, summed by document, and its pairs' counts with their positions."""
        now, h, own, parts, held_ = None, None, None, [], ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            for kind, found in zip((NEAR, PAIR), held_):
                if not found:
                    continue
                codes, docs_, each = _positions([(x, y) for _, x, y in found])
                batch = np.repeat([n for n, _, _ in found], each)
                train = (docs_ & 1).astype(bool)
                found.clear()
                if kind == NEAR:
                    yield from _sums(batch, docs_ >> 1, cell_logs(codes, train, held.value[2], held.value[3], room))
                    continue
                _, one, gram = np.unique(codes[0].astype(np.int64) << BITS | codes[3], return_index=True, return_inverse=True)
                n = np.bincount(gram, train).astype(np.int64)
                seen = one[n > 0]
                for part in _split(codes[0][seen]):
                    yield record(_ROWS, [int(codes[0][seen[part[0]]])], [KINDS], [len(part)], [None], [None], [None])
                yield from _sent(PASSED, _dealt(codes[0], codes[1], buckets), 0, codes, docs_, (n[gram], batch.astype(np.int64)))

        for b in slices(batches, 64):
            for bucket, kind, batch, keys, a, x in zip(*[c.to_pylist() for c in b.columns]):
                if bucket != now:
                    yield from done()
                    now, h, parts = bucket, None, []
                if kind == WORDS:
                    n = _values(a, np.int64)
                    parts.append((np.frombuffer(keys, np.uint64), np.stack([n > 0, base(n), _values(x, np.float32)])))
                elif kind == ASK:
                    if h is None:
                        h, own = np.concatenate([y for y, _ in parts]), np.concatenate([y for _, y in parts], axis=1)
                        order = np.argsort(h)
                        h, own, parts = h[order], own[:, order], []
                    which = _values(a, np.uint32)
                    got = np.repeat(own[:, np.searchsorted(h, np.frombuffer(keys, np.uint64))], _values(x, np.uint32), axis=1)
                    seen = np.unique(which)
                    told = np.stack([np.bincount(which, y)[seen] for y in got])
                    yield record(_ROWS, [0], [TOLD], [batch], [_squeezed(seen)], [_squeezed(told[:2].reshape(-1))], [_squeezed(told[2].astype(np.float32))])
                elif kind == OWN:
                    yield record(_ROWS, [bucket], [kind], [batch], [None], [a], [x])
                else:
                    held_[kind == PAIR].append((batch, keys, a))
        yield from done()

    known = words.where(~is_heavy).mapInArrow(lexicon, _ROW)
    met = known.unionByName(rows.select("doc_id", "text", "out").mapInArrow(asked, _ROW)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "batch").mapInArrow(answer, _ROW)
    if len(hot):
        met = save(met, "answers")  # read for the pairs' kinds, for what goes on and for the answers
        found = met.where(F.col("kind") == KINDS).groupBy("bucket").agg(F.sum("batch").alias("n")).toArrow()  # a row for each hot symbol, at most
        kinds_of = np.zeros(SYMBOLS, np.int64)
        kinds_of[found["bucket"].to_numpy()] = found["n"].to_numpy()
        more = spark.sparkContext.broadcast((before, kinds_of))

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by bucket: positions after hot symbols, with the counts of symbol and next one."""
            now, found_ = None, []

            def done() -> Iterator[pa.RecordBatch]:
                codes, docs_, _ = _positions([(x, y) for x, y, _ in found_])
                n, batch = [], []
                for _, _, x in found_:
                    cut = 4 + int.from_bytes(x[:4], "little")
                    n.append(_values(x[4:cut], np.int64))
                    batch.append(_values(x[cut + 4 :], np.int64))
                found_.clear()
                c, k = more.value
                logs = state_logs(codes, (docs_ & 1).astype(bool), held.value[2], (np.concatenate(n), c[codes[0]], k[codes[0]]))
                yield from _sums(np.concatenate(batch), docs_ >> 1, logs)

            for b in slices(batches, 64):
                for bucket, keys, a, x in zip(*[b.column(k).to_pylist() for k in ("bucket", "keys", "a", "b")]):
                    if bucket != now and found_:
                        yield from done()
                    now = bucket
                    found_.append((keys, a, x))
            if found_:
                yield from done()

        on = met.where(F.col("kind") == PASSED).repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(passed, _ROW)
        met = met.where(F.col("kind").isin(OWN, ANSWER, TOLD)).unionByName(on)

    out_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by batch, its own first: a row per document."""
        own = sums_ = None

        def done() -> pa.RecordBatch:
            ids = pa.array(own[:, 0], mask=own[:, 1] > 0)
            return record(out_schema, ids, own[:, 3] > 0, own[:, 2], np.rint(sums_[:, 0]).astype(np.int64), np.full(len(own), total), sums_[:, 1], sums_[:, 2])

        for b in slices(batches, 64):
            for kind, keys, a, x in zip(*[b.column(k).to_pylist() for k in ("kind", "keys", "a", "b")]):
                if kind == OWN:
                    if own is not None:
                        yield done()
                    own, sums_ = np.frombuffer(a, np.int64).reshape(-1, 4), np.frombuffer(x).reshape(-1, 3).copy()
                elif kind == TOLD:
                    at = _values(keys, np.uint32)
                    sums_[at, :2] += _values(a, np.float64).reshape(2, -1).T
                    sums_[at, 2] += _values(x, np.float32)
                else:
                    sums_[_values(keys, np.uint32), 2] += np.frombuffer(x, np.float32)
        if own is not None:
            yield done()

    return met.repartition("batch").sortWithinPartitions("batch", "kind", "keys", "a", "b").mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    from folio.llm.common import table

    return scores(table(spark, sf_dir, "documents"))
